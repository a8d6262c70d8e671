import math
import random

import pytest
from pyspark.sql import functions as F

from hectara.functions import geometry as G

RINGS = "rings array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


L_SHAPE = [ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3))]
WITH_HOLE = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((2, 2), (4, 2), (4, 4), (2, 4))]
CLOCKWISE = [list(reversed(L_SHAPE[0]))]


def moved(rings, dx, dy):
    return [[{"x": v["x"] + dx, "y": v["y"] + dy} for v in r] for r in rings]


def shapes(spark, *items):
    return spark.createDataFrame([(i, r) for i, r in enumerate(items)], "id int, " + RINGS)


def test_area_centroid_perimeter(spark):
    df = shapes(spark, L_SHAPE, WITH_HOLE, CLOCKWISE, moved(L_SHAPE, 1e6, 2e6))
    c = G.centroid(F.col("rings"))
    rows = df.select("id", G.area(F.col("rings")).alias("a"), c.alias("c"), G.perimeter(F.col("rings")).alias("p")).orderBy("id").collect()
    assert [r.a for r in rows] == pytest.approx([6, 96, 6, 6])
    assert rows[0].c.x == pytest.approx((4 * 2 + 2 * 0.5) / 6) and rows[0].c.y == pytest.approx((4 * 0.5 + 2 * 2) / 6)
    assert rows[1].c.x == pytest.approx((100 * 5 - 4 * 3) / 96)
    assert rows[3].c.x - rows[0].c.x == pytest.approx(1e6) and rows[2].c.x == pytest.approx(rows[0].c.x)
    assert rows[0].p == pytest.approx(14)


def test_point_in_polygon_with_hole_and_shared_border(spark):
    square, right = [ring((0, 0), (1, 0), (1, 1), (0, 1))], [ring((1, 0), (2, 0), (2, 1), (1, 1))]
    df = spark.createDataFrame([(3.0, 3.0), (5.0, 5.0), (1.0, 0.5), (11.0, 1.0)], "x double, y double")
    for shape, want in ((WITH_HOLE, [False, True, True, False]), (square, [False, False, False, False]), (right, [False, False, True, False])):
        got = df.crossJoin(shapes(spark, shape)).select("x", "y", G.contains_point(F.col("rings"), F.col("x"), F.col("y")).alias("i")).collect()
        assert [r.i for r in got] == want


def test_overlap_area_against_sampling(spark):
    triangle = [ring((0.5, -1), (5, 0.5), (0.5, 4))]
    df = shapes(spark, L_SHAPE).withColumnRenamed("rings", "a").crossJoin(shapes(spark, triangle, CLOCKWISE, WITH_HOLE).withColumnRenamed("rings", "b").drop("id"))
    got = [r.o for r in df.select(G.overlap_area(G.signed_edges(F.col("a")), G.signed_edges(F.col("b")), F.lit(-5.0)).alias("o")).collect()]
    assert got[1] == pytest.approx(6)

    def inside(rings, x, y):
        odd = False
        for r in rings:
            for a, b in zip(r, r[1:]):
                if (a["y"] <= y) != (b["y"] <= y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                    odd = not odd
        return odd

    n = 200
    cells = [(x / n * 4 + 2 / n, y / n * 3 + 1.5 / n) for x in range(n) for y in range(n)]
    for k, other in ((0, triangle), (2, WITH_HOLE)):
        hits = sum(inside(L_SHAPE, *c) and inside(other, *c) for c in cells)
        assert got[k] == pytest.approx(hits * 12 / n / n, abs=0.05)


def test_disc_area(spark):
    square, far = [ring((-1, -1), (1, -1), (1, 1), (-1, 1))], [ring((50, 50), (51, 50), (51, 51))]
    quarter = [ring((0, 0), (9, 0), (9, 9), (0, 9))]
    df = shapes(spark, square, far, quarter, WITH_HOLE).withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)).withColumn("edges", G.oriented_edges(F.col("rings"))).drop("rings")
    got = {r.id: r.s for r in G.disc_pieces(df, "x", "y", "edges", 2.5).groupBy("id").agg(F.sum("piece").alias("s")).collect()}
    assert got[0] == pytest.approx(4) and got[1] == pytest.approx(0, abs=1e-9) and got[2] == pytest.approx(math.pi * 2.5**2 / 4)
    assert got[3] == pytest.approx(got[2] - 0.0, abs=0.2) and got[3] <= got[2]


def test_projection_on_the_meridian_and_round_trip(spark):
    df = spark.createDataFrame([(52.0, 19.0), (54.35, 18.65), (49.5, 22.9)], "lat double, lon double")
    x, y = G.to_grid(F.col("lat"), F.col("lon"))
    rows = df.select("lat", "lon", x.alias("x"), y.alias("y")).collect()
    assert rows[0].x == pytest.approx(500000, abs=1e-3) and rows[0].y == pytest.approx(459309, abs=2)
    lat, lon = G.from_grid(F.col("x"), F.col("y"))
    back = spark.createDataFrame(rows).select(lat.alias("lat"), lon.alias("lon")).collect()
    for a, b in zip(rows, back):
        assert (a.lat, a.lon) == pytest.approx((b.lat, b.lon), abs=1e-8)


def test_box(spark):
    test = lambda *b: [r.v for r in shapes(spark, L_SHAPE).select(G.intersects_box(F.col("rings"), *b).alias("v")).collect()][0]
    assert test(0.2, 0.2, 0.3, 0.3) and test(-5, -5, 9, 9) and test(3, 0.5, 5, 2) and not test(2, 1.5, 3, 2.5) and not test(5, 5, 6, 6)


def test_distance_to_polygon_random(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(-3, 7), rng.uniform(-3, 6)) for _ in range(60)]
    df = spark.createDataFrame(pts, "x double, y double").crossJoin(shapes(spark, L_SHAPE))
    for r in df.select("x", "y", G.distance_to_boundary(F.col("rings"), F.col("x"), F.col("y")).alias("d")).collect():
        best = 1e9
        for a, b in zip(L_SHAPE[0], L_SHAPE[0][1:]):
            for k in range(2001):
                px, py = a["x"] + (b["x"] - a["x"]) * k / 2000, a["y"] + (b["y"] - a["y"]) * k / 2000
                best = min(best, math.hypot(px - r.x, py - r.y))
        assert r.d == pytest.approx(best, abs=3e-3)


def test_line_sampling_by_exact_step(spark):
    line = [[{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}, {"x": 100.0, "y": 70.0}]]
    df = spark.createDataFrame([("LineString", line), ("Point", [[{"x": 5.0, "y": 6.0}]])], "g string, " + RINGS)
    pts = sorted((round(r.p.x, 6), round(r.p.y, 6)) for r in G.sample_points(df, "g", "rings", 50, normalised=False).collect())
    assert pts == [(0, 0), (5, 6), (50, 0), (100, 0), (100, 50)]
