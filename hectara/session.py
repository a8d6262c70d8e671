"""Session defaults and lineage cutting shared by all operators."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hectara") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without one a fresh local folder, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to reliable checkpoint files, so later stages restart from them after an executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that must not be broadcast uncounted.

    Spark estimates a side from compressed files and counts neither exploded rows nor the lengths of arrays, so a large one can pass
    for a small one and be built whole on the driver.
    """
    return df.hint("merge")


def sized_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting the side; above max_rows the join stays a shuffle join.

    The side is checkpointed first so that counting it does not compute it twice.
    """
    small = cut_lineage(df)
    if small.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(small)
    return shuffled(small)
