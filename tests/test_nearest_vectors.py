"""The batch vector search against comparing every query with every row."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from hectara.operators.graph import kind_embedding, node_embedding
from hectara.operators.similarity import PIVOTS, _meetings, nearest_for_each


def brute(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    place = {i: n for n, i in enumerate(ids)}
    out = {}
    for q in asked:
        others = sorted((-sims[place[q], place[i]], i) for i in ids if i != q)[:k]
        out[q] = [(i, -s) for s, i in others]
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], "id long, vec array<double>")


def answers(df, queries, k):
    out = {}
    for r in nearest_for_each(df, "id", "vec", queries, k).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.neighbour, r.similarity))
    return out


@pytest.fixture(scope="module")
def clustered():
    """A third copies of one vector, the rest around forty directions, some only scaled."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    near = np.repeat(centres, 10, axis=0) + rng.normal(scale=0.03, size=(400, 24))
    copies = np.tile(centres[:1], (220, 1)) * np.repeat([1.0, 2.0], 110)[:, None]
    return np.arange(620), np.vstack([copies, near])


def test_equal_to_all_pairs(spark, clustered):
    ids, vectors = clustered
    asked = [0, 5, 219, *range(220, 620, 9)]
    df = frame(spark, ids, vectors)
    got = answers(df, df.filter(F.col("id").isin(asked)), 7)
    want = brute(list(ids), vectors, asked, 7)
    assert got.keys() == want.keys()
    for q in asked:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)


def test_bounds_leave_few_pairs(spark, clustered):
    ids, vectors = clustered
    df = frame(spark, ids, vectors)
    rows, asked, met = _meetings(df, "id", "vec", df, 3, PIVOTS)
    classes = rows.select("class").distinct().count()
    assert classes == 401 and met.select("asked", "class").distinct().count() == met.count()
    assert met.count() < 0.1 * classes**2


def test_unclustered_few_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(60, 5))
    df = frame(spark, range(60), vectors)
    odd = frame(spark, [100, 101, 102], [[0.0] * 5, None, [float("nan")] * 5]).unionByName(spark.createDataFrame([(None, [1.0] * 5)], df.schema))
    table = df.unionByName(odd).withColumns({"class": F.lit("own"), "ring": F.lit(1)})
    assert answers(table, table, 3).keys() == set(range(60))
    want = brute(list(range(60)), vectors, range(60), 3)
    got = answers(table, table, 3)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in range(60))
    few = answers(df.filter("id < 3"), df, 10)  # fewer rows than neighbours asked for
    assert {q: len(v) for q, v in few.items()} == {0: 2, 1: 2, 2: 2}
    assert answers(df.limit(0), df, 3) == {} and answers(df, df.limit(0), 3) == {}


def test_embedding_is_the_same_in_any_order(spark):
    rng = np.random.default_rng(1)
    links = [(f"p{i}", f"d{rng.integers(4)}", "LOCATED_IN") for i in range(40)] + [(f"p{i}", f"q{i % 3}", "HAS_SIZE") for i in range(40)]
    once = {r.id: r.embedding for r in node_embedding(spark.createDataFrame(links, "src string, dst string, rel string"), dimension=20).collect()}
    again = {r.id: r.embedding for r in node_embedding(spark.createDataFrame(links[::-1], "src string, dst string, rel string").repartition(3), dimension=20).collect()}
    assert once.keys() == again.keys() and len(once["p0"]) == 20
    assert all(np.allclose(once[i], again[i], atol=1e-12) for i in once)
    same = [i for i in once if dict((s + r, d) for s, d, r in links)[i + "LOCATED_IN"] == dict((s + r, d) for s, d, r in links)["p0LOCATED_IN"] and int(i[1:]) % 3 == 0]
    assert all(np.allclose(once[i], once["p0"], atol=1e-12) for i in same)


def test_vectors_of_a_label_serve_all_its_keys(spark, clustered):
    """One row a label gives the answers of one row a key; keys without a label or a vector are neither found nor answered."""
    ids, vectors = clustered
    labels = spark.createDataFrame([(int(i), float(i % 2), [float(x) for x in v]) for i, v in enumerate(vectors[200:260])], "label long, class double, vec array<double>")
    members = spark.createDataFrame([(i, i % 60 if i % 7 else None) for i in range(300)] + [(None, 3), (900, 99)], "id long, label long")
    table = members.join(labels, "label").select("id", "vec")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 7, 61, 150, 299, 900)], "id long")
    got = nearest_for_each(labels, "id", "vec", asked, 7, members=members)
    want = nearest_for_each(table, "id", "vec", asked, 7)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_kinds_of_the_embedding_are_few(spark):
    links = spark.createDataFrame([(f"p{i}", f"d{i % 4}", "LOCATED_IN") for i in range(80)] + [(f"p{i}", f"q{i % 3}", "HAS_SIZE") for i in range(80)], "src string, dst string, rel string")
    kinds, vectors = kind_embedding(links, dimension=16)
    assert kinds.count() == 80 and vectors.count() == 12
    assert node_embedding(links, dimension=16).count() == 80
