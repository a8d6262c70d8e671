"""Elevation statistics over ordered samples."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface_statistics(points: DataFrame) -> DataFrame:
    """points: surface, seq (consecutive whole numbers), x, y, z.

    Consecutive samples meet by an equi-join on (surface, seq), so one very large surface is
    spread over all partitions instead of being sorted inside a single window.
    """
    after = points.select("surface", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    dist = F.sqrt(dx * dx + dy * dy)
    slope = F.when(dist > 0, F.abs(F.degrees(F.atan((F.col("z2") - F.col("z")) / dist))))
    stats = points.join(after, ["surface", "seq"], "left").groupBy("surface").agg(
        F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.round(F.avg("z"), 4).alias("avg_z"),
        F.coalesce(F.avg(slope), F.lit(0.0)).alias("sa"), F.coalesce(F.max(slope), F.lit(0.0)).alias("sm"),
        (F.max_by("z", "seq") - F.min_by("z", "seq")).alias("dz"), F.count(F.lit(1)).alias("n"),
    )
    sa = F.col("sa")
    return stats.select(
        "surface", "min_z", "max_z", "avg_z", F.round(sa, 4).alias("slope_avg_deg"), F.round("sm", 4).alias("slope_max_deg"),
        F.when((F.col("n") > 1) & (F.abs("dz") > 0.5), F.when(F.col("dz") > 0, "N").otherwise("S")).otherwise("flat").alias("aspect"),
        (sa < 15).alias("flat_enough"), (sa < 2).alias("drainage_concern"), (sa > 5).alias("view_potential"),
        F.when(sa < 5, "minimal").when(sa < 15, "moderate").otherwise("significant").alias("earthwork"),
    )
