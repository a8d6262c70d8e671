import numpy as np
import pytest
from pyspark.sql import functions as F

from hectara.operators import spatial as S
from hectara.operators.edges import adjacent_pairs


def skewed(n, seed, copies=0.34):
    """A third of all points on one spot, a third in a tight cluster, the rest anywhere."""
    rng = np.random.default_rng(seed)
    a, b = int(n * copies), int(n * 0.33)
    pts = np.vstack([np.tile([[700.0, 700.0]], (a, 1)), rng.normal(2000, 3, (b, 2)), rng.uniform(0, 10000, (n - a - b, 2))])
    return pts


@pytest.fixture(scope="module")
def data(spark):
    q, f = skewed(300, 1), skewed(900, 2)
    kind = np.array(["a", "b", "c"])[np.arange(len(f)) % 3]
    queries = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(q)], "qid bigint, x double, y double")
    feats = spark.createDataFrame([(int(i), float(x), float(y), str(k)) for i, ((x, y), k) in enumerate(zip(f, kind))], "fid bigint, x double, y double, kind string")
    d = np.sqrt(((q[:, None, :] - f[None, :, :]) ** 2).sum(-1))
    return queries, feats, d, kind


@pytest.mark.parametrize("k,cap", [(1, None), (3, None), (2, 900.0)])
def test_nearest_is_exact_under_skew(data, k, cap):
    queries, feats, d, kind = data
    got = {}
    for r in S.nearest(queries, "qid", feats, "fid", ["a", "b", "missing"], "kind", k=k, max_distance=cap, strict=True).collect():
        got[(r.qid, r["cat"], r["rank"])] = (r.fid, r.distance)
    want = {}
    for i in range(d.shape[0]):
        for c in "ab":
            ids = np.where(kind == c)[0]
            order = sorted(ids, key=lambda j: (d[i, j], j))[:k]
            for rank, j in enumerate(order, 1):
                if cap is None or d[i, j] < cap:
                    want[(i, c, rank)] = (j, d[i, j])
    assert got.keys() == want.keys()
    for key, (fid, dist) in want.items():
        assert got[key][1] == pytest.approx(dist, abs=1e-6)
        if abs(dist) > 0:
            assert got[key][0] == fid or abs(d[key[0], got[key][0]] - dist) < 1e-6


def test_within_radius_is_exact_under_skew(data):
    queries, feats, d, _ = data
    for radius in (5.0, 500.0, 4000.0):
        got = {r.qid: (r.n, r.first) for r in S.within_radius(queries, "qid", feats, radius, first=F.col("fid")).collect()}
        inside = d <= radius
        assert {i: n for i, (n, _) in got.items()} == {i: int(inside[i].sum()) for i in range(len(d)) if inside[i].any()}
        assert all(got[i][1] == int(np.where(inside[i])[0].min()) for i in got)


def test_no_features_at_all(data):
    queries, feats, _, _ = data
    empty = feats.filter("fid < 0")
    assert S.within_radius(queries, "qid", empty, 9.0, first=F.col("fid"), with_strict=True).columns == ["qid", "n", "n_strict", "first"]
    assert S.nearest(queries, "qid", empty, "fid", ["a"], "kind").count() == 0


def test_neighbour_at_the_threshold_is_left_out(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0)], "qid bigint, x double, y double")
    f = spark.createDataFrame([(1, 200.0, 0.0, "a"), (2, 199.0, 0.0, "a")], "fid bigint, x double, y double, kind string")
    assert [r.fid for r in S.nearest(q, "qid", f, "fid", ["a"], "kind", k=5, max_distance=200.0, strict=True).collect()] == [2]


def square(i, x, y, w=10.0, h=10.0):
    pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return (i, [[{"x": float(a), "y": float(b)} for a, b in pts]])


def test_adjacency_rules(spark):
    turned = [(50, 50), (60, 60), (50, 70), (40, 60), (50, 50)]
    beside = [(60, 60), (70, 70), (60, 80), (50, 70), (60, 60)]
    rows = [
        square(1, 0, 0), square(2, 10, 0), square(3, 10, 10),  # 1-2 and 2-3 share a side, 1-3 a corner
        square(4, 5, -5, 10, 10),  # overlaps 1 and 2
        square(5, 20, 9.95),  # 5 cm beside 2, a full side beside 3
        (6, [[{"x": float(a), "y": float(b)} for a, b in turned]]), (7, [[{"x": float(a), "y": float(b)} for a, b in beside]]),
    ]
    df = spark.createDataFrame(rows, "plot_id int, rings array<array<struct<x:double,y:double>>>")
    got = {(r.id1, r.id2): r.shared_border_m for r in adjacent_pairs(df, "plot_id", cell=4.0).collect()}
    assert set(got) == {(1, 2), (2, 3), (3, 5), (6, 7)}
    assert got[(1, 2)] == 10 and got[(6, 7)] == pytest.approx(14.14)


def test_overlap_pairs_of_very_different_sizes(spark):
    rng = np.random.default_rng(5)
    boxes = [square(i, *rng.uniform(0, 1000, 2), *(10 ** rng.uniform(0, 3, 2))) for i in range(80)]
    df = spark.createDataFrame(boxes, "id int, rings array<array<struct<x:double,y:double>>>")
    a = S.with_envelope(df.withColumnRenamed("id", "a").select("a", "rings"), "rings", S.ENV_A).drop("rings")
    b = S.with_envelope(df.withColumnRenamed("id", "b").select("b", "rings"), "rings", S.ENV_B).drop("rings")
    got = [(r.a, r.b) for r in S.envelope_pairs(a, b).select("a", "b").collect()]
    box = {i: (r[0][0]["x"], r[0][0]["y"], r[0][2]["x"], r[0][2]["y"]) for i, r in boxes}
    want = {(i, j) for i in box for j in box if box[i][0] <= box[j][2] and box[j][0] <= box[i][2] and box[i][1] <= box[j][3] and box[j][1] <= box[i][3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_radius_search_is_dealt_out_above_the_broadcast_limit(spark, monkeypatch):
    """Queries of one file must not walk the whole pyramid in one task, however many points there are."""
    monkeypatch.setattr(S, "BROADCAST_POINTS", 9)
    rows = [(i, float(i * 37 % 211), float(i * 53 % 199)) for i in range(600)]
    points = spark.createDataFrame(rows, "fid long, x double, y double")
    queries = points.filter("fid < 60").select(F.col("fid").alias("qid"), "x", "y").coalesce(1)
    dealt = []
    start = S._search_start
    monkeypatch.setattr(S, "_search_start", lambda p, seeds, radius: dealt.append(seeds.rdd.glom().map(len).collect()) or start(p, seeds, radius))
    got = {r.qid: r.n for r in S.within_radius(queries, "qid", points, 60.0).collect()}
    assert got == {q: sum((x - a) ** 2 + (y - b) ** 2 <= 3600 for _, x, y in rows) for q, a, b in rows[:60]}
    assert dealt and all(sum(n > 0 for n in sizes) > 1 for sizes in dealt)
