"""Polygons of several parts: nesting, joins and GeoJSON."""
import json

import pytest
from pyspark.sql import functions as F

from hectara.functions import parts as P
from hectara.functions.geometry import to_grid
from hectara.operators import spatial as S
from hectara.sources import writers as W

RINGS = "array<array<struct<x:double,y:double>>>"


def square(x, y, r, back=False):
    ring = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    return [{"x": float(a), "y": float(b)} for a, b in (ring[::-1] if back else ring)]


def corner(ring):
    return ring[0]["x"], ring[0]["y"], max(v["x"] for v in ring) - min(v["x"] for v in ring)


def test_rings_nest_by_depth_and_order_does_not_matter(spark):
    sea, lake, isle, pond, other = square(0, 0, 100), square(10, 0, 50, True), square(10, 0, 20), square(10, 5, 5), square(500, 0, 10, True)
    touching = [{"x": a, "y": b} for a, b in ((-100.0, -100.0), (-80.0, -100.0 + 5), (-100.0 + 5, -80.0), (-100.0, -100.0))]  # meets the outline at its corner
    rows = [(1, [lake, pond, other, isle, sea]), (2, [sea, touching]), (3, []), (4, None), (5, [other])]
    df = spark.createDataFrame(rows, f"id int, rings {RINGS}").withColumn("parts", P.nested_parts(F.col("rings")))
    got = {r.id: r.parts for r in df.collect()}
    shape = {i: None if p is None else sorted([[v[0]["x"] for v in part] for part in p]) for i, p in got.items()}
    assert shape[1] == sorted([[sea[0]["x"], lake[0]["x"]], [isle[0]["x"], pond[0]["x"]], [other[0]["x"]]])
    assert shape[2] == [[-100.0, -100.0]] and len(got[2][0]) == 2
    assert got[3] == [] and got[4] is None and len(got[5]) == 1
    areas = {r.id: r.a for r in df.select("id", P.parts_area(F.col("parts")).alias("a")).collect()}
    assert areas[1] == pytest.approx(200**2 - 100**2 + 40**2 - 10**2 + 20**2) and areas[3] == 0 and areas[4] is None
    assert {(r.id, r.part) for r in P.one_row_a_part(df.drop("rings")).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (5, 0)}


def test_parts_through_joins(spark):
    zones = spark.createDataFrame([(1, [[square(0, 0, 10), square(0, 0, 4)], [square(100, 0, 10)]]), (2, [[square(0, 0, 4)]])], f"zone_id int, parts array<{RINGS}>")
    box = ("x0", "y0", "x1", "y1")
    flat = S.with_envelope(zones.select("zone_id", P.all_rings(F.col("parts")).alias("rings")), "rings", box)
    spots = spark.createDataFrame([(1, 8.0, 0.0), (2, 0.0, 0.0), (3, 95.0, 1.0), (4, 50.0, 0.0)], "pid int, x double, y double")
    assert sorted((r.pid, r.zone_id) for r in S.points_in_polygons(spots, "x", "y", flat, box).collect()) == [(1, 1), (2, 2), (3, 1)]
    # A plot over both parts of zone 1 has more in common with it than with a zone that beats each part alone.
    plots = spark.createDataFrame([(7, "t", [square(0, 0, 200)])], f"plot int, town string, rings {RINGS}")
    more = zones.unionByName(spark.createDataFrame([(3, [[square(0, 60, 10.5)]])], zones.schema))
    areas = P.one_row_a_part(more).withColumn("town", F.lit("t"))
    best = S.largest_overlap(plots, "plot", areas, "zone_id", ["town"]).collect()
    assert [(r.plot, r.area_id) for r in best] == [(7, 1)] and best[0].overlap == pytest.approx(400 - 64 + 400)


def test_geojson_of_one_and_several_parts(spark):
    names = "id_dzialki string, gmina string, miejscowosc string, area_m2 int, quietness_score int, nature_score int, accessibility_score int, has_pog boolean, pog_symbol string, centroid_lat double, centroid_lon double"
    rows = [(i, "a \"b\"", None, 5, 1, 2, 3, True, None, 54.35, 18.65) for i in ("one", "two", "none", "left")]
    table = spark.createDataFrame(rows, names)
    lat, lon = F.col("centroid_lat"), F.col("centroid_lon")

    def ring(*offsets):
        return F.array(*[F.struct(*[c.alias(n) for c, n in zip(to_grid(lat + b, lon + a), "xy")]) for a, b in offsets])

    outline = ring((0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0), (0, 0))  # clockwise
    hole = ring((0.002, 0.002), (0.004, 0.002), (0.004, 0.004), (0.002, 0.002))  # counterclockwise
    island = ring((0.02, 0), (0.03, 0), (0.03, 0.01), (0.02, 0))
    table = table.withColumn("rings", F.when(F.col("id_dzialki") == "one", F.array(hole, outline)).when(F.col("id_dzialki") == "two", F.array(hole, island, outline)))
    ids = spark.createDataFrame([("one",), ("two",), ("none",)], "id_dzialki string")
    found = {r.id_dzialki: json.loads(r.feature) for r in W.geojson_features(table, ids, rings="rings").collect()}
    assert set(found) == {"one", "two", "none"} and found["none"]["geometry"] is None
    assert found["one"]["properties"]["gmina"] == 'a "b"' and found["one"]["properties"]["miejscowosc"] is None
    one = found["one"]["geometry"]
    assert one["type"] == "Polygon" and len(one["coordinates"]) == 2
    want = [(18.65, 54.35), (18.66, 54.35), (18.66, 54.36), (18.65, 54.36), (18.65, 54.35)]
    assert [tuple(round(v, 8) for v in p) for p in one["coordinates"][0]] == want
    assert [tuple(round(v, 8) for v in p) for p in one["coordinates"][1]] == [(18.652, 54.352), (18.654, 54.354), (18.654, 54.352), (18.652, 54.352)]
    assert found["two"]["geometry"]["type"] == "MultiPolygon" and sorted(len(p) for p in found["two"]["geometry"]["coordinates"]) == [1, 2]
    points = {r.id_dzialki: json.loads(r.feature) for r in W.geojson_features(table, ids).collect()}
    assert points["one"]["geometry"] == {"type": "Point", "coordinates": [18.65, 54.35]}
    assert json.loads(W.geojson_features(table, ids, geometry=False).first().feature)["geometry"] is None
