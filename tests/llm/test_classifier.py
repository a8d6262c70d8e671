import zlib

import numpy as np
import pytest

from hectara.llm import classifier as cl
from hectara.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = truth.sum()
    return (ranks[truth == 1].sum() - good * (good + 1) / 2) / (good * (len(truth) - good))


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op9_quality_classifier"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i in labels if i in rows and rows[i].held_out]
    scores, truth = np.array([rows[i].score for i in held]), np.array([labels[i] for i in held])
    assert auc(scores, truth) > 0.97 and ((scores - truth) ** 2).mean() < 0.05


def test_context_sums_by_brute_force(spark, make_docs):
    texts = ["One two three, one.", None, "", "A b A b", "two ONE!! x", "One two three, one."]
    got = {r.place: (r.n, [r[2 + i] for i in range(cl.WIDTH)]) for r in cl.context_sums(make_docs(list(enumerate(texts))).repartition(3)).collect()}
    want = {}
    for text in texts:
        laid = cl.tokens([text])[0].tolist()
        for i, a in enumerate(laid):
            n, v = want.setdefault(a, [0, np.zeros(cl.WIDTH, int)])
            want[a][0] += 1
            for j in range(max(0, i - cl.WINDOW), min(len(laid), i + cl.WINDOW + 1)):
                if j != i:
                    np.add.at(v, cl.INDEX_DIMS[laid[j]], cl.INDEX_SIGNS[laid[j]])
    assert got == {k: (n, v.tolist()) for k, (n, v) in want.items()}


def test_pooling_does_not_depend_on_neighbours():
    vectors = np.random.default_rng(0).normal(size=(cl.PLACES, cl.WIDTH)).astype(np.float32)
    weights = np.ones(cl.PLACES, np.float32)
    texts = ["a b c", None, "", "a a a a", "Long " * 30_000, "a b c"]
    together = cl.pool(texts, vectors, weights)
    for text, row in zip(texts, together):
        assert np.allclose(cl.pool([text], vectors, weights)[0], row, atol=1e-4)
    assert not together[1].any() and not together[2].any() and together[3][4 * cl.WIDTH] == 0.75


def test_temperature():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < cl.sigmoid(z)).astype(float)
    assert cl.best_temperature(3 * z, y) == pytest.approx(3, rel=0.1) and cl.best_temperature(z[:0], y[:0]) == 1


def test_defined_results(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None), (None, "a"), (1, "a b")]).selectExpr("*", "0.5 as score", "1 as pooled")
    for rows, base in (([], 0.5), ([(1, 1), (1, 1), (3, None)], 1.0), ([(1, 1), (1, 0)], 0.0)):
        out = cl.score_documents(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(out) == 4 and all(r.score == base for r in out)
        assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert cl.score_documents(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_sample_is_bounded_and_leaves_out_the_held(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    rows = cl.sample_of(labels, 50).collect()
    assert len(rows) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
