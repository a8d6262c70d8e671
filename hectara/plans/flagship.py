"""The flagship query: nearest services, accessibility score, band, filter and ranking."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hectara.functions import labels, scores
from hectara.operators.spatial import nearest
from hectara.plans.testbed import table

SERVICES = {"bus_stop": "dist_to_bus_stop", "school": "dist_to_school", "shop": "dist_to_supermarket", "pharmacy": "dist_to_pharmacy"}


def service_distances(parcels: DataFrame, poi: DataFrame, names: dict[str, str]) -> DataFrame:
    """One whole-metre distance column per service type; a type nobody offers stays null."""
    places = parcels.select("id_dzialki", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    found = nearest(places, "id_dzialki", poi, "poi_id", list(names), "type")
    wide = found.groupBy("id_dzialki").pivot("cat", list(names)).agg(F.min("distance"))
    return wide.select("id_dzialki", *[scores.half_even(F.col(t)).cast("int").alias(c) for t, c in names.items()])


def quiet_and_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = table(spark, sf_dir, "parcels").select("id_dzialki", "gmina", "centroid_x", "centroid_y", "area_m2", "quietness_score")
    poi = table(spark, sf_dir, "poi").select("poi_id", "x", "y", "type")
    wide = parcels.filter(F.col("area_m2") >= 500).join(service_distances(parcels, poi, SERVICES), "id_dzialki", "left")
    score = scores.accessibility(*[F.col(c) for c in ("dist_to_bus_stop", "dist_to_school", "dist_to_supermarket", "dist_to_pharmacy")])
    return (
        wide.withColumn("accessibility_score", score)
        .withColumn("kategoria_dostepu", labels.band(F.col("accessibility_score"), "accessibility"))
        .orderBy(F.col("accessibility_score").desc(), F.col("quietness_score").desc_nulls_last(), "id_dzialki")
        .limit(100)
        .select("id_dzialki", "gmina", "area_m2", *SERVICES.values(), "accessibility_score", "kategoria_dostepu")
    )
