"""Upright rectangles meet points and discs by their envelope, with the rows of the vertex test."""
from pyspark.sql import functions as F

from hectara.functions.geometry import contains_point, distance_to_polygon, is_rectangle
from hectara.operators import spatial as S

BOX = ("x0", "y0", "x1", "y1")
NAN = float("nan")


def ring(*points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


SHAPES = [
    (1, [ring((0, 0), (4, 0), (4, 3), (0, 3))], True),
    (2, [ring((0, 3), (4, 3), (4, 0), (0, 0))], True),
    (3, [ring((4, 3), (4, 0), (0, 0), (0, 3))], True),
    (4, [ring((0, 0), (4, 0), (4, 3), (1, 3))], False),
    (5, [ring((0, 0), (4, 0), (4, 3), (0, 3)), ring((1, 1), (2, 1), (2, 2), (1, 2))], False),
    (6, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 1.0)]], False),
    (7, [ring((0, 0), (4, 3), (4, 0), (0, 3))], False),
    (8, [ring((0, 0), (0, 0), (0, 3), (0, 3))], True),
    (9, [ring((0, 0), (4, 0), (4, 3))], False),
    (10, [ring((0, 0), (NAN, 0), (NAN, 3), (0, 3))], False),
    (11, [[(0.0, 0.0), (4.0, 0.0), None, (0.0, 3.0), (0.0, 0.0)]], False),
    (12, [], False),
]


def shapes(spark):
    return spark.createDataFrame([s[:2] for s in SHAPES], "sid int, rings array<array<struct<x:double,y:double>>>")


def points(spark):
    return spark.createDataFrame([(i * 20 + j, i / 2 - 1, j / 2 - 1) for i in range(13) for j in range(11)], "pid int, x double, y double")


def test_rectangles_are_known(spark):
    rows = S.with_envelope(shapes(spark), "rings", BOX).select("sid", is_rectangle(F.col("rings"), BOX).alias("box")).collect()
    assert {r.sid: r.box for r in rows} == {s[0]: s[2] for s in SHAPES}


def test_points_and_discs_as_by_vertices(spark):
    sound = shapes(spark).filter("sid <= 9 and sid <> 6")  # an open ring may reach past its envelope
    cross = points(spark).crossJoin(sound)
    want = {(r.pid, r.sid) for r in cross.filter(contains_point(F.col("rings"), F.col("x"), F.col("y"))).collect()}
    got = S.points_in_polygons(points(spark), "x", "y", S.with_envelope(sound, "rings", BOX), BOX).select("pid", "sid").collect()
    assert len(got) == len(want) and {(r.pid, r.sid) for r in got} == want
    near = cross.filter(distance_to_polygon(F.col("rings"), F.col("x"), F.col("y")) <= 1.0).groupBy("pid").count()
    want = {r.pid: r["count"] for r in near.collect()}
    assert {r.pid: r.n for r in S.count_touching(points(spark), "pid", sound, 1.0).collect()} == {r.pid: want.get(r.pid, 0) for r in points(spark).collect()}


def test_rectangles_travel_without_vertices(spark):
    """The join of points to rectangles neither carries rings nor walks vertices, and does not broadcast them uncounted."""
    boxes = S.with_envelope(shapes(spark).filter("sid <= 3"), "rings", BOX)
    hits = S.points_in_polygons(points(spark), "x", "y", boxes, BOX)
    plan = hits._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0] and "rings" not in joins[0]
