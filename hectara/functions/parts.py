"""Polygons of several parts: parts is an array of polygons, a polygon an array of rings, the outline first and then its holes.

For joins by points the rings of all parts go together (`all_rings`), since the even-odd rule needs no outline. For common surfaces
each part is a row of its own (`one_row_a_part`), and sums by id put them together again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hectara.functions.geometry import area, contains_point, from_grid, ring_signed_area, segments


def all_rings(parts: Column) -> Column:
    return F.flatten(parts)


def one_row_a_part(df: DataFrame, parts: str = "parts") -> DataFrame:
    """parts becomes rings, with `part` (from 0); rows without a part are left out."""
    rest = [c for c in df.columns if c != parts]
    return df.select(*rest, F.posexplode(parts).alias("part", "rings"))


def nested_parts(rings: Column) -> Column:
    """Parts of a flat list of rings, in the order of their outlines; null for null.

    A ring at an even depth is an outline, at an odd depth a hole of the ring right around it. Rings may touch but not cross: one lies in
    another where more than half of its edges have their middle there.
    """

    def lies_in(ring: Column, other: Column) -> Column:
        middles = F.transform(segments(ring), lambda e: F.struct(((e["ax"] + e["bx"]) / 2).alias("x"), ((e["ay"] + e["by"]) / 2).alias("y")))
        return F.size(F.filter(middles, lambda m: contains_point(F.array(other), m["x"], m["y"]))) * 2 > F.size(middles)

    def described(ring: Column, place: Column) -> Column:
        around = F.filter(F.transform(rings, lambda other, i: F.when((i != place) & lies_in(ring, other), i)), lambda i: i.isNotNull())
        return F.struct(ring.alias("ring"), place.alias("place"), around.alias("around"))

    known = F.transform(rings, described)

    def part(outline: Column) -> Column:
        holes = F.filter(known, lambda h: (F.size(h["around"]) == F.size(outline["around"]) + 1) & F.array_contains(h["around"], outline["place"]))
        return F.concat(F.array(outline["ring"]), F.transform(holes, lambda h: h["ring"]))

    return F.transform(F.filter(known, lambda r: F.size(r["around"]) % 2 == 0), part)


def parts_area(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, rings: total + area(rings))


def geojson_geometry(parts: Column, srid: int = 2180, digits: int = 9) -> Column:
    """JSON text of a Polygon or MultiPolygon in WGS84: outlines run counterclockwise, holes clockwise. Null without parts."""

    def wound(ring: Column, place: Column) -> Column:
        return F.when((ring_signed_area(ring) < 0) == (place == 0), F.reverse(ring)).otherwise(ring)

    def position(v: Column) -> Column:
        lat, lon = from_grid(v["x"], v["y"], srid)
        return F.array(F.round(lon, digits), F.round(lat, digits))

    coordinates = F.transform(parts, lambda rings: F.transform(F.transform(rings, wound), lambda ring: F.transform(ring, position)))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.element_at(coordinates, 1).alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))
    return F.when(F.size(parts) == 1, single).when(F.size(parts) > 1, several)
