import hashlib
import random

import pytest

from hectara.llm import decontamination as dc
from hectara.llm.queries import LEAK_SQL


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture
def case(spark, make_docs):
    rng = random.Random(4)
    vocabulary = [f"W{i}x" for i in range(60)] + ["Ünder", "élan", "7"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 40])))) for i in range(30)]
    bench += [(30, None), (31, "..."), (32, bench[0][1]), (33, "solo"), (5, bench[5][1])]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if i % 3 == 0:
            item = rng.choice(bench[:30])[1].split()
            at = rng.randint(0, len(words))
            words[at:at] = item[rng.randint(0, 2):]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 7 == 0 else " -- ".join(words)))
    docs += [(500, None), (501, ""), (502, "?!"), (503, "SOLO."), (None, bench[1][1]), (0, docs[0][1]), (504, bench[3][1] + " " + "filler " * 800 + bench[4][1])]
    return make_docs(docs), items(spark, bench)


@pytest.mark.parametrize("block_bytes", [1 << 24, 700])
def test_against_sql(case, run_sql, same, block_bytes):
    docs, bench = case
    got = dc.find_items(docs.selectExpr("*", "'x' as items"), bench, keep_text=False, block_bytes=block_bytes)
    same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), run_sql(LEAK_SQL, documents=docs, benchmark=bench))


def test_removal(spark, case):
    docs, bench = case
    clash = docs.selectExpr("*", "1 as contaminated", "2 as hit_places")
    found = {(r.doc_id, r.text): r for r in dc.find_items(docs, bench).collect()}
    left = dc.decontaminate(clash, bench)
    assert left.columns == clash.columns
    assert sorted((r.doc_id or -1 for r in left.collect())) == sorted((d or -1) for d, t in found for _ in range(2 if d == 0 else 1) if not found[d, t].contaminated)
    spans = dc.decontaminate(clash, bench, remove="spans")
    assert spans.columns == clash.columns
    by_id = {r.doc_id: r for r in spans.collect()}
    for (doc, text), r in found.items():
        words = dc.words_of(text)
        places = set(r.hit_places)
        assert dc.words_of(by_id[doc].text) == [w for k, w in enumerate(words) if k not in places]
        assert r.contaminated or by_id[doc].text == text
        assert not r.contaminated or by_id[doc].n_chars == len(by_id[doc].text)
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, remove="all")


def test_very_long_text(spark, make_docs):
    docs = make_docs([(1, "filler " * 100_000 + "k1 k2 k3 k4 " + "filler " * 100_000)])
    r = dc.find_items(docs, items(spark, [(9, "k1 k2 k3 k4")])).first()
    assert (r.n_words, r.n_hit, r.items, r.hit_places) == (200_004, 4, ["9"], list(range(100_000, 100_004)))


def test_spans_keep_what_is_around():
    assert dc.without_words("Keep this, remove me now! And this.", [2, 3, 4]) == "Keep this, ! And this."


def test_null_item_id_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, "one two three")])
    r = dc.find_items(docs, items(spark, [(None, "two")])).first()
    assert (r.n_hit, r.items, r.items_sha256) == (1, [""], hashlib.sha256(b"").hexdigest())
    assert not dc.find_items(docs, items(spark, [])).first().contaminated
    assert dc.find_items(make_docs([]), items(spark, [(1, "a")])).count() == 0
