"""Tessellated polygons against testing every edge."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hectara.operators import spatial as S
from hectara.operators.tessellation import LEAF_EDGES, tessellate

BOX = ("x0", "y0", "x1", "y1")
RINGS = "array<array<struct<x:double,y:double>>>"


def star(n, seed, cx=0.0, cy=0.0, radius=1000.0, rough=0.3):
    """A closed outline of n vertices, uneven in density: half of them on an eighth of the turn."""
    rng = np.random.default_rng(seed)
    angle = np.sort(np.concatenate([rng.uniform(0, 2 * math.pi, n // 2), rng.uniform(0, math.pi / 4, n - n // 2)]))
    r = radius * (1 - rough * rng.random(n))
    ring = [(float(cx + a * math.cos(t)), float(cy + a * math.sin(t))) for a, t in zip(r, angle)]
    return ring + ring[:1]


def holds(rings, x, y):
    """Even-odd rule over all edges at once."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if ay != by:
                odd ^= ((ay <= y) != (by <= y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def polygons(spark, shapes):
    rows = [(i, [[{"x": x, "y": y} for x, y in ring] for ring in rings], f"name {i}") for i, rings in shapes.items()]
    return S.with_envelope(spark.createDataFrame(rows, f"zid long, rings {RINGS}, note string"), "rings", BOX)


def points(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "pid long, px double, py double")


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(5)
    wild = [(float(a), float(b)) for a, b in rng.uniform(-900, 900, (150, 2))]
    steps = [(float(a), float(b)) for a, b in rng.integers(-8, 9, (200, 2)) * 64.0]  # vertices and edges on cell borders, many of them level
    return {
        1: [star(3000, 1)],
        2: [star(400, 2, 300, -200, 700), star(300, 3, 300, -200, 300)],  # with a hole
        3: [wild + wild[:1]],  # crosses itself
        4: [star(200, 4, 0, 0, 500)[:-1]],  # open ring
        5: [steps + steps[:1]],
        6: [[(-600.0, -600.0), (600.0, -600.0), (600.0, 600.0), (-600.0, 600.0), (-600.0, -600.0)]],  # small
        7: [star(500, 6, 5e5, 6e5, 40.0)],  # map coordinates
        8: [],
    }


def test_same_rows_as_testing_every_edge(spark, shapes):
    rng = np.random.default_rng(9)
    spots = [rng.uniform(-1100, 1100, (700, 2)), rng.integers(-9, 10, (200, 2)) * 64.0, np.array([v for r in (shapes[1][0], shapes[3][0]) for v in r[:100]])]
    spots += [np.array(shapes[7][0][:60]), rng.uniform(-45, 45, (200, 2)) + [5e5, 6e5], np.tile([[10.0, 10.0]], (50, 1))]
    xy = np.vstack(spots)
    x, y = xy[:, 0], xy[:, 1]
    table = points(spark, x, y).unionByName(spark.createDataFrame([(-1, None, 1.0)], "pid long, px double, py double"))
    got = S.points_in_polygons(table, "px", "py", polygons(spark, shapes), BOX)
    assert "rings" not in got.columns and "note" in got.columns
    rows = sorted((r.zid, r.pid) for r in got.collect())
    want = sorted((i, int(p)) for i, rings in shapes.items() if rings for p in np.where(holds(rings, x, y))[0] if min(v[0] for r in rings for v in r) <= x[p])
    # An open ring may claim points outside its box; those are no hits in either way.
    boxes = {i: [f(v[k] for r in rings for v in r) for f in (min, max) for k in (0, 1)] for i, rings in shapes.items() if rings}
    want = [(i, p) for i, p in want if boxes[i][0] <= x[p] <= boxes[i][2] and boxes[i][1] <= y[p] <= boxes[i][3]]
    assert rows == want
    whole = S.points_in_polygons(table, "px", "py", polygons(spark, shapes), BOX, leaf_edges=10**9)
    assert sorted((r.zid, r.pid) for r in whole.collect()) == rows


def test_a_large_outline_is_spread_over_many_keys(spark):
    n = 100_000
    shape = S.with_envelope(
        spark.range(1).select(
            F.lit(1).alias("zid"),
            F.array(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(
                ((F.cos((i % n) * 2 * math.pi / n)) * (1e5 + F.sin((i % n) * 0.05) * 900)).alias("x"), ((F.sin((i % n) * 2 * math.pi / n)) * (1e5 + F.sin((i % n) * 0.05) * 900)).alias("y")
            ))).alias("rings"),
        ), "rings", BOX,
    )
    cells = tessellate(shape, F.lit(18), BOX)
    size = F.coalesce(F.size("_edges"), F.lit(0))
    row = cells.agg(F.count(F.lit(1)).alias("cells"), F.max(size).alias("most"), F.count(F.when(size > 0, 1)).alias("border"),
                    F.sum(F.when(size == 0, F.size("_breaks"))).alias("odd"), F.sum(F.when(size == 0, F.pow(F.lit(4.0), "level"))).alias("inner")).first()
    assert row.most <= LEAF_EDGES and row.border > 3000 and row.odd == 0
    assert row.cells < n and 0.9 < row.inner / (math.pi * 1e10) < 1.0  # most of the ground needs no edge at all
    assert cells.groupBy("level", "cx", "cy").count().filter("count > 1").isEmpty()


def test_copies_clashing_names_and_no_rows(spark, shapes):
    two = polygons(spark, {1: shapes[1]}).unionByName(polygons(spark, {1: shapes[1]})).withColumns({c: F.lit("own") for c in ("base", "breaks", "edges", "n", "v")})
    spot = points(spark, [0.0, 5000.0], [0.0, 0.0])
    assert [tuple(r) for r in S.points_in_polygons(spot, "px", "py", two, BOX).select("pid", "zid").collect()] == [(0, 1), (0, 1)]
    assert S.points_in_polygons(spot.limit(0), "px", "py", two, BOX).isEmpty()
    assert S.points_in_polygons(spot, "px", "py", two.limit(0), BOX).isEmpty()


def test_only_equal_keys_meet(spark, shapes):
    zones = polygons(spark, {1: shapes[1], 2: shapes[1]}).withColumn("town", F.concat(F.lit("t"), F.col("zid")))
    spot = points(spark, [0.0], [0.0]).withColumn("town", F.lit("t2"))
    assert [r.zid for r in S.points_in_polygons(spot, "px", "py", zones, BOX, on=["town"]).collect()] == [2]
