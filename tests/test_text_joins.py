"""Edit-similarity and cosine joins against all pairs, and how few pairs meet."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hectara.operators import similarity as V
from hectara.operators import text_joins as J


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed, n, letters, longest):
    rng = random.Random(seed)
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]
    for w in out[: n // 2]:  # near copies
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)], ["ż"]])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("above", [0.5, 0.6, 0.75, 0.9])
def test_edit_similarity_is_exact(spark, above):
    a, b = words(1, 90, "abc", 12), words(2, 80, "abcd", 14) + words(1, 20, "abc", 12) + ["", "a", None, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaab"]
    left, right = (spark.createDataFrame([(w,) for w in ws], f"{c} string") for ws, c in ((a + ["", None], "x"), (b, "y")))
    got = {(r.x, r.y): r.score for r in J.similar_pairs(left, "x", right, "y", above).collect()}
    want = {}
    for x in {w for w in a if w}:
        for y in {w for w in b if w}:
            score = 1 - edits(x, y) / max(len(x), len(y))
            if score > above:
                want[(x, y)] = score
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_few_unlike_texts_meet(spark):
    """1,000 by 1,000 random strings of one length, every one unlike every other."""
    rng = random.Random(3)
    sides = [spark.createDataFrame([("".join(rng.choice("0123456789abcdef") for _ in range(12)),) for _ in range(1000)], f"{c} string") for c in "xy"]
    for above, share in ((0.5, 0.12), (0.75, 0.002)):
        assert J.edit_candidates(sides[0], "x", sides[1], "y", above).count() < share * 1_000_000


def test_cosine_is_exact_and_skips_frequent_tokens(spark):
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(4)], [f"r{i}" for i in range(400)]
    texts = {k: [rng.choice(common) for _ in range(6)] + rng.sample(rare, rng.randint(0, 5)) for k in range(300)}
    texts |= {k + 1000: texts[k][:-1] + ["x"] for k in range(40)}
    texts[5000] = ["c0"] * 3
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "k int, t string")
    left = V.word_vectors(rows, ["k"], "t")
    right = left.withColumnRenamed("k", "j")

    def cosine(a, b):
        x, y = Counter(a), Counter(b)
        return sum(x[w] * y[w] for w in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    every = {(a, b): cosine(texts[a], texts[b]) for a in texts for b in texts}
    for threshold in (0.7, 0.9):
        got = {(r.k, r.j): r.similarity for r in J.cosine_at_least(left, ["k"], right, ["j"], "token", threshold).collect()}
        sure = {p for p, c in every.items() if c >= threshold + 1e-7}
        assert sure <= got.keys() <= {p for p, c in every.items() if c >= threshold - 1e-7}
        assert all(got[p] == pytest.approx(every[p]) for p in got)
    wordy = spark.createDataFrame([(k, " ".join([rng.choice(common)] + rng.sample(rare, 6))) for k in range(400)], "k int, t string")
    left = V.word_vectors(wordy, ["k"], "t")
    assert J.cosine_candidates(left, ["k"], left.withColumnRenamed("k", "j"), ["j"], "token", 0.9).count() < 400 * 400 / 20


def test_empty_sides(spark):
    none = spark.createDataFrame([], "x string")
    some = spark.createDataFrame([("abc",)], "y string")
    assert J.similar_pairs(none, "x", some, "y", 0.5).count() == 0 and J.similar_pairs(some, "y", none, "x", 0.5).count() == 0
    vectors = V.name_grams(some, "y").withColumnRenamed("gram", "g")
    assert J.cosine_at_least(vectors.filter(F.lit(False)), ["y"], vectors.withColumnRenamed("y", "z"), ["z"], "g", 0.7).count() == 0
