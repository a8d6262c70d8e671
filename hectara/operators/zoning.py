"""Joins of parcels with zones, districts and points of interest."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hectara.functions.scores import half_even
from hectara.functions import constants as C
from hectara.functions.geometry import centroid, distance_to_polygon, intersects_box
from hectara.operators.spatial import first_polygon, largest_overlap, nearest, unmatched_secondary, within_radius
from hectara.session import cut_lineage

ZONE_ATTRIBUTES = [
    "oznaczenie", "symbol", "nazwa", "profil_podstawowy", "profil_podstawowy_nazwy", "profil_dodatkowy",
    "maks_intensywnosc", "maks_zabudowa_pct", "maks_wysokosc_m", "min_bio_pct",
]


def first_zone(parcels: DataFrame, pid: str, zones: DataFrame, zone_id: str, box: tuple[str, ...]) -> DataFrame:
    """Smallest id of the zones around each centroid; parcels outside all zones are left out."""
    return first_polygon(parcels, pid, "centroid_x", "centroid_y", zones, zone_id, box)


def attach_zone(parcels: DataFrame, pid: str, zones: DataFrame, box: tuple[str, ...]) -> DataFrame:
    """Left join with the zone attributes. Only ids travel through the geometry join."""
    match = first_zone(parcels, pid, zones, "zone_id", box)
    attributes = zones.select("zone_id", *[F.col(c).alias(f"pog_{c}") for c in ZONE_ATTRIBUTES])
    return parcels.select(pid).join(match, pid, "left").join(attributes, "zone_id", "left").withColumnRenamed("zone_id", "pog_id")


def district_or_nearest(parcels: DataFrame, pid: str, districts: DataFrame, did: str, box: tuple[str, ...]) -> DataFrame:
    """District around the centroid, else the district with the nearest centroid."""
    inside = cut_lineage(first_zone(parcels, pid, districts, did, box))
    rest = parcels.join(inside, pid, "left_anti").select(pid, F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    c = districts.select(did, centroid(F.col("rings")).alias("c"), F.lit("all").alias("kind")).select(did, "kind", "c.x", "c.y")
    near = nearest(rest, pid, c, did, ["all"], "kind")
    return inside.select(pid, did, F.lit("within").alias("how")).unionByName(near.select(pid, F.col("fid").alias(did), F.lit("nearest").alias("how")))


def district_by_overlap(plots: DataFrame, districts: DataFrame) -> DataFrame:
    """Largest common surface within the city; '<city> (inne)' without one; the city itself when it has no districts."""
    best = largest_overlap(plots, "plot_id", districts, "zone_id", ["gmina"])
    cities = districts.select("gmina").distinct().withColumn("has_districts", F.lit(True))
    named = plots.select("plot_id", "gmina").join(best, "plot_id", "left").join(cities, "gmina", "left")
    return named.select(
        "plot_id",
        F.when(F.col("has_districts").isNull(), F.col("gmina"))
        .otherwise(F.coalesce(F.concat(F.lit("Z"), F.col("area_id")), F.concat("gmina", F.lit(" (inne)"))))
        .alias("dzielnica"),
        F.round(F.coalesce("overlap", F.lit(0.0)), 3).alias("overlap"),
    )


def near_edges(places: DataFrame, pid: str, poi: DataFrame) -> DataFrame:
    """Typed neighbourhood edges: the nearest few per type strictly inside the type's threshold."""
    kinds = list(C.NEAR_RELATIONS)
    near = nearest(
        places, pid, poi, "poi_id", kinds, "type",
        k={c: C.NEAR_RELATIONS[c][2] for c in kinds},
        max_distance={c: float(C.NEAR_RELATIONS[c][1]) for c in kinds},
        strict=True,
    )
    relation = F.create_map([F.lit(v) for c in kinds for v in (c, C.NEAR_RELATIONS[c][0])])
    return near.select(F.col(pid).alias("src"), F.col("fid").alias("dst"), relation[F.col("cat")].alias("rel"), half_even(F.col("distance"), 1).alias("distance_m"))


def merge_sources(poi: DataFrame, radius: float) -> DataFrame:
    """Primary rows, secondary rows of special subtypes, and secondary rows with no primary row nearby."""
    primary = poi.filter(F.col("source") == "bdot10k")
    special = poi.filter((F.col("source") == "osm") & F.col("subtype").isNotNull())
    plain = poi.filter((F.col("source") == "osm") & F.col("subtype").isNull())
    return primary.unionByName(special).unionByName(unmatched_secondary(primary, plain, "poi_id", radius))


def backfill_from_secondary(poi: DataFrame, radius: float, columns: list[str]) -> DataFrame:
    """Null attributes of primary rows from the first secondary row within radius."""
    primary = poi.filter(F.col("source") == "bdot10k")
    secondary = poi.filter(F.col("source") == "osm")
    match = within_radius(primary, "poi_id", secondary, radius, first=F.col("poi_id"), inclusive=False)
    donor = secondary.select(F.col("poi_id").alias("first"), *[F.col(c).alias(f"{c}_2") for c in columns])
    filled = primary.join(match.select("poi_id", "first"), "poi_id", "left").join(donor, "first", "left")
    return filled.select("poi_id", *[F.coalesce(c, f"{c}_2").alias(c) for c in columns])


def radius_search(plots: DataFrame, pid: str, box: tuple[str, ...], x: float, y: float, radius: float) -> DataFrame:
    """Plots at most radius away; the envelope test reaches the scan, the exact distance runs on its survivors."""
    minx, miny, maxx, maxy = (F.col(c) for c in box)
    near = plots.filter((maxx >= x - radius) & (minx <= x + radius) & (maxy >= y - radius) & (miny <= y + radius))
    return near.withColumn("distance_m", distance_to_polygon(F.col("rings"), F.lit(x), F.lit(y))).filter(F.col("distance_m") <= radius)


def window_search(plots: DataFrame, box: tuple[str, ...], x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    minx, miny, maxx, maxy = (F.col(c) for c in box)
    near = plots.filter((maxx >= x0) & (minx <= x1) & (maxy >= y0) & (miny <= y1))
    return near.filter(intersects_box(F.col("rings"), x0, y0, x1, y1))
