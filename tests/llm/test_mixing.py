import random

import pytest

from hectara.llm import mixing
from hectara.llm.queries import MIX_SQL


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture
def docs(make_docs):
    rows = [(i, words(3 + i * 7 % 40), "en", ["b", "a", None, "", "c"][i % 5]) for i in range(200)]
    rows += [(900, None, "en", "a"), (901, "", None, "b"), (902, " \t\n ", "en", "z"), (None, words(9), "en", "c"), (903, words(5000), "en", "b")]
    rows += [(7, words(11), "en", "a")] * 9  # repeated rows
    return make_docs(rows)


def test_against_sql(spark, docs, run_sql, same):
    same(mixing.mix_counts(docs), run_sql(MIX_SQL, documents=docs))


def test_budgets(docs):
    rows = mixing.mix_counts(docs).collect()
    total = {}
    for r in rows:
        assert r.taken <= 2 * r["size"]
        total.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 10 for (_, target), t in total.items())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_counts(docs.repartition(7)).collect()), key=repr)


def reshared(sizes, share, cap, weights):
    """As stated: share by weight, cut those above their limit, share the excess again until none is above."""
    limits, targets = {s: cap * n for s, n in sizes.items()}, {}
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_:
        parts = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if parts[s] > limits[s]}
        if not over:
            return targets | parts
        targets |= {s: limits[s] for s in over}
        left -= sum(limits[s] for s in over)
        open_ -= over
    return targets


def test_levels_reshare_the_excess(spark):
    rng = random.Random(5)
    for _ in range(6):
        n = rng.randint(1, 30)
        sizes = {f"={i:02d}": rng.choice([0, 1, rng.randint(1, 60), rng.randint(1, 5000)]) for i in range(n)} | ({"": 5} if n % 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "_source string, source_size long")
        got = {r._source: r.target for r in mixing.targets(df, 1.5, 2.0, (3, 1, 2)).collect()}
        order = sorted(sizes, key=lambda s: (s == "", s))
        want = reshared(sizes, 1.5, 2.0, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
        assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixed_rows(docs):
    clash = docs.selectExpr("*", "1 as size", "'x' as _source", "2 as taken")
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    taken = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        taken[r.source, r.doc_id] = taken.get((r.source, r.doc_id), 0) + len(r.text.split())
    want = {}
    for r, source in zip(mixing.mix_counts(docs).collect(), [r.source for r in docs.collect()]):
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for (_, doc), n in taken.items():
        want[doc] -= n
    assert not any(want.values())


def test_cut_keeps_the_first_words(spark):
    df = spark.createDataFrame([(" a  b\tc d ", 2), ("a b", 2), ("x\ny z", 1)], "t string, n int")
    got = [r[0] for r in df.select(mixing.first_words(mixing.F.col("t"), mixing.F.col("n"))).collect()]
    assert got == [" a  b", "a b", "x"]


def test_empty(make_docs):
    assert mixing.mix_counts(make_docs([])).count() == 0 and mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix_counts(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
