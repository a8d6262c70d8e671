import random

import pytest
from pyspark.sql import functions as F

from hectara.functions import labels as L
from hectara.functions import scores as X
from hectara.functions import texts as T
from hectara.operators import graph, matching, ranking, relations, statistics
from hectara.sources import readers, writers


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r.w, r.v): r.score for r in matching.similar_pairs(df, "w", df.withColumnRenamed("w", "v"), "v", 0.5).collect()}
    want = {}
    for a in words:
        for b in words:
            s = 1 - edit_distance(a, b) / max(len(a), len(b))
            if s > 0.5:
                want[(a, b)] = s
    assert got == pytest.approx(want)


def test_contains_pairs_match_brute_force(spark):
    words = ["a", "ab", "abc", "bcab", "cabca", "xyz", "yz", "aa"]
    df = spark.createDataFrame([(w,) for w in words], "needle string")
    got = {(r.needle, r.hay) for r in matching.contains_pairs(df, df.withColumnRenamed("needle", "hay")).collect()}
    assert got == {(a, b) for a in words for b in words if a in b}


def test_exact_median_refines_large_groups(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3001)] + [("even", float(v)) for v in (1, 2, 10, 20)] + [("copies", 5.0)] * 9
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r["median"] for r in statistics.exact_median(df, ["k"], "v", rows=50).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == pytest.approx({"hot": hot[1500], "even": 6.0, "copies": 5.0})


def test_running_sequence_is_gapless(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(13)
    got = [(r.v, r.id) for r in ranking.with_sequence(df, ["v"]).collect()]
    assert [i for _, i in sorted(got)] == list(range(1, 5001))


def test_fusion_bonus(spark):
    def lst(*ids):
        return spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id string, rank int")

    out = {r.id: r for r in ranking.fuse({"graph": lst("x", "y"), "spatial": lst("x"), "semantic": lst("y", "x")}, ["id"], {"graph": [], "spatial": [], "semantic": []}).collect()}
    assert out["x"].score == pytest.approx((0.45 / 61 + 0.2 / 61 + 0.35 / 62) * 1.3)
    assert out["y"].score == pytest.approx((0.45 / 62 + 0.35 / 61) * 1.1) and out["x"].sources == ["graph", "semantic", "spatial"]


def test_band_edges_and_half_even(spark):
    row = spark.range(1).select(
        *[L.size_class(F.lit(a)).alias(f"s{a}") for a in (499, 500, 1499, 1500, 4999, 5000)], L.band(F.lit(80), "quietness").alias("q"), L.band(F.lit(None).cast("int"), "nature").alias("n"),
        X.half_even(F.lit(0.5)).alias("h0"), X.half_even(F.lit(1.5)).alias("h1"), X.half_even(F.lit(2.5)).alias("h2"), X.half_even(F.lit(0.575), 2).alias("h3"), X.price_text(F.lit(1_250_000)).alias("p"), X.price_text(F.lit(999_999)).alias("k"),
    ).first()
    assert [row[f"s{a}"] for a in (499, 500, 1499, 1500, 4999, 5000)] == ["mala", "pod_dom", "pod_dom", "duza", "duza", "bardzo_duza"]
    assert (row.q, row.n, row.h0, row.h1, row.h2, row.h3) == ("bardzo_cicha", "nieznana", 0, 2, 2, 0.57)
    assert (row.p, row.k) == ("1.25 mln zł", "999k zł")


def test_message_numbers(spark):
    df = spark.createDataFrame([("mam 500 tys",), ("500000 zł i 1200 m²",), ("budżet to 850000",), ("nic",), ("działka 90 metrów, 2500",)], "c string")
    got = [(r.b, r.s) for r in df.select(T.budget(F.col("c")).alias("b"), T.plot_size(F.col("c")).alias("s")).collect()]
    assert got[0][0] == 500000 and got[1] == (500000, 1200) and got[2][0] == 850000 and got[3] == (None, None) and got[4][1] == 2500


def test_last_rating_wins_and_similarity_pairs_stay_small(spark):
    feats = ", ".join(f"{f} " + ("boolean" if f.startswith(("has", "is")) else "string") for f in ranking.FEATURES)
    rows = [(1, f"p{i}", 1.0, "d", "s", "q", "n", "o", True, True, "far") for i in range(200)] + [(1, "fav", 1.0, "d", "s", "q", "n", "o", True, True, "far")]
    res = spark.createDataFrame(rows, "user_id bigint, id string, score double, " + feats)
    out = {r.id: r for r in ranking.rerank(res, spark.createDataFrame([(1, "fav", "favorite")], "user_id bigint, id string, kind string")).collect()}
    assert out["p3"].adjusted == pytest.approx(1.5) and out["fav"].is_favorite and len(out) == 201


def test_node_embedding_properties(spark):
    rows = [(f"p{i}", "a" if i % 2 else "b", "HAS") for i in range(40)] + [(f"p{i}", "z", "IN") for i in range(0, 40, 4)]
    e = spark.createDataFrame(rows, "src string, dst string, rel string")
    one = {r.id: r.embedding for r in graph.node_embedding(e, 64).collect()}
    two = {r.id: r.embedding for r in graph.node_embedding(e.repartition(5), 64).collect()}
    assert all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)

    def cos(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    assert cos(one["p1"], one["p3"]) == pytest.approx(1) and cos(one["p1"], one["p3"]) > cos(one["p1"], one["p2"])


def test_paths_never_turn_back(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "id1 int, id2 int, shared_border_m double")
    d = spark.createDataFrame([(i, "q") for i in (1, 2, 3)], "plot_id int, district string")
    got = {(r.id1, r.id2, r.hops): r.paths for r in relations.same_district_paths(pairs, d).collect()}
    assert got[(1, 2, 1)] == 1 and got[(1, 3, 2)] == 1 and got[(1, 1, 3)] == 2 and (1, 1, 2) not in got


def test_price_fallbacks(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "B", "x"), (4, "A", None)], "i int, c string, d string")
    p = spark.createDataFrame([("A", "X", 10, 20, "HIGH")], "city string, district string, price_min int, price_max int, segment string")
    cp = spark.createDataFrame([("A", 1, 2, "LOW")], "city string, price_min int, price_max int, segment string")
    got = {r.i: (r.p.price_min if r.p else None, r.confidence) for r in relations.price_lookup(rows, "c", "d", p, cp).collect()}
    assert got == {1: (10, "HIGH"), 2: (1, "LOW"), 3: (None, None), 4: (1, "LOW")}


def test_map_ways(spark):
    n = lambda i: ("node", i, float(i), float(i * i), None, {})
    rows = [n(1), n(2), n(3), ("way", 1, None, None, [1, 2, 3, 1], {"a": "b"}), ("way", 2, None, None, [1, 2], {"a": "b"}), ("way", 3, None, None, [1], {"a": "b"}), ("way", 4, None, None, [1, 9], {"a": "b"}), ("way", 5, None, None, [1, 2], {})]
    df = spark.createDataFrame(rows, "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>")
    got = {r.osm_id: (r.gtype, len(r.line)) for r in readers.map_features(df).collect()}
    assert got == {"way/1": ("Polygon", 4), "way/2": ("LineString", 2)}


def test_upsert_overwrites_with_null(spark):
    base = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id int, v string, w string")
    upd = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert {tuple(r) for r in writers.upsert(base, upd, "id").collect()} == {(1, "a", "k"), (2, None, "k"), (3, "c", None)}
