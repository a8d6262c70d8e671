"""The first polygon around a point without meeting all that lie on top of each other."""
import random

from pyspark.sql import functions as F

from hectara.functions.geometry import contains_point
from hectara.operators import spatial as S

BOX = ("x0", "y0", "x1", "y1")
RINGS = "array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [[(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


def framed(spark, shapes):
    return S.with_envelope(spark.createDataFrame(shapes, f"zid long, rings {RINGS}"), "rings", BOX)


def test_first_polygon_is_the_smallest_that_contains_the_point(spark):
    draw = random.Random(7)
    shapes = []
    for i in range(120):
        x, y, w, h = draw.randint(-40, 60), draw.randint(-40, 60), draw.randint(0, 50), draw.choice([1, 7, 40, 300])
        outline = box(x, y, x + w, y + h)
        if i % 3 == 0:
            outline = [[(float(x), float(y)), (x + w + 1.0, y + 0.5), (x + w / 2, y + h + 1.0), (float(x), float(y))]]
        if i % 10 == 0:
            outline.append([(x + 1.0, y + 1.0), (x + 3.0, y + 1.0), (x + 3.0, y + 3.0), (x + 1.0, y + 1.0)])
        shapes.append(((i * 37) % 120, outline))
    zones = framed(spark, shapes)
    points = spark.createDataFrame([(i, float(draw.randint(-50, 120)) + draw.choice([0, 0.5]), float(draw.randint(-50, 200))) for i in range(400)], "pid int, x double, y double")
    cross = points.crossJoin(zones).filter(contains_point(F.col("rings"), F.col("x"), F.col("y")) & F.expr("x >= x0 and x <= x1 and y >= y0 and y <= y1"))
    want = {r.pid: r.zid for r in cross.groupBy("pid").agg(F.min("zid").alias("zid")).collect()}
    got = S.first_polygon(points, "pid", "x", "y", zones, "zid", BOX).collect()
    assert len(got) == len(want) > 50 and {r.pid: r.zid for r in got} == want
    assert S.first_polygon(points, "pid", "x", "y", zones.limit(0), "zid", BOX).isEmpty()


def test_polygons_below_the_first_are_not_met(spark, monkeypatch):
    """Five hundred zones on top of each other: all but a few are gone before points are met."""
    rows = []
    cut = S.cut_lineage

    def counted(df):
        out = cut(df)
        rows.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(S, "cut_lineage", counted)
    zones = framed(spark, [(i, box((i * 7) % 20, (i * 11) % 20, 100 + (i * 13) % 20, 100 + (i * 17) % 20)) for i in range(500)])
    points = spark.createDataFrame([(i, 30.0 + i % 60, 30.0 + i // 10) for i in range(600)], "pid int, x double, y double")
    got = S.first_polygon(points, "pid", "x", "y", zones, "zid", BOX).collect()
    assert len(got) == 600 and {r.zid for r in got} == {0}
    all_rows, kept = max(n for _, n in rows), rows[-1][1]
    assert all_rows > 20_000 and kept < 5_000
