"""Feedback events as Structured Streaming jobs. State lives in the checkpoint, results go to files."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hectara.session import shared_dir, shuffled

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ACTIONS = {"purchase": "favorite", "error": "reject", "signup": "clear", "click": "compare"}


def event_stream(spark: SparkSession, folder: str, pattern: str = "*", files: int | None = None) -> DataFrame:
    """Feedback events arriving as files, at most the given number of them in a batch."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    action = F.create_map([F.lit(v) for pair in ACTIONS.items() for v in pair])[F.col("event_type")]
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.coalesce(action, F.col("event_type")).alias("action"), F.concat(F.lit("D"), F.regexp_extract("props", "([0-9]+)", 1)).alias("parcel_id"))


def run_to_end(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there and stop. The same checkpoint resumes after a failure."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def collect_stream(stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """Drive a stream to its end into Parquet and read the rows back with their batch number.

    Each batch replaces its own folder, so a batch that runs again after a failure leaves no copies.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/hectara-stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run_to_end(stream, mode, sink, f"{base}/checkpoint")
    return spark.read.schema(schema + ", batch bigint").parquet(f"{base}/out")


END, END_TS = "end of stream", "2200-01-01"


def with_end(events: DataFrame, folder: str) -> DataFrame:
    """events and the closing row that end_stream puts into the folder; it has no user and only moves the watermark."""
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def end_stream(events: DataFrame, folder: str) -> None:
    """Let the next run close all windows, sessions and timers. It is the last one: rows that come after it are late."""
    given = {"ts": F.lit(END_TS).cast("timestamp"), "action": F.lit(END)}
    rows = events.sparkSession.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    rows.write.mode("overwrite").parquet(folder)


def collect_to_end(build: Callable[[DataFrame], DataFrame], events: DataFrame, schema: str) -> DataFrame:
    """Drive build(events) through all events and then to its end, in append mode; nothing stays open.

    The second run resumes from the checkpoint of the first. Each batch replaces its own folder.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/hectara-stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream = build(with_end(events, f"{base}/end"))
    run_to_end(stream, "append", sink, f"{base}/checkpoint")
    end_stream(events, f"{base}/end")
    run_to_end(stream, "append", sink, f"{base}/checkpoint")
    return spark.read.schema(schema + ", batch bigint").parquet(f"{base}/out").drop("batch")


RATING_SCHEMA = "user_id bigint, parcel_id string, rating string"


def rating_stream(events: DataFrame) -> DataFrame:
    """Favourite and rejected parcels per user; the newest action by event time wins and takes the parcel
    off the other list, whatever order events arrive in. View and compare only stay in the log.

    A built-in streaming aggregate: state is one value per (user, parcel), so a busy user is spread
    over many keys, and partial results are combined before the shuffle.
    """
    return ratings_batch(events)


def current_ratings(updates: DataFrame) -> DataFrame:
    """Newest value per key out of the update log."""
    return updates.groupBy("user_id", "parcel_id").agg(F.max_by("rating", "batch").alias("rating"))


def ratings_batch(events: DataFrame) -> DataFrame:
    """Newest favourite or reject per user and parcel; the same expression serves batch and stream."""
    rated = events.filter(F.col("action").isin("favorite", "reject"))
    return rated.groupBy("user_id", "parcel_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("rating"))


def history(events: DataFrame) -> DataFrame:
    """Ratings after the user's last clear event; clear is a tombstone for everything before it."""
    cleared = events.filter(F.col("action") == "clear").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("c"))
    kept = events.join(cleared, "user_id", "left").filter(F.col("c").isNull() | (F.struct("ts", "event_id") > F.col("c")))
    return ratings_batch(kept)


ACTIVE_SCHEMA = "start timestamp, end timestamp, users bigint, events bigint"


def active_users(events: DataFrame, hours: int = 24, slide_hours: int = 1, late: str = "1 hour") -> DataFrame:
    """Exact number of users per sliding window; windows close when the watermark passes them.

    Chained windows: rows become one per user and step, then one per user and window, then the count. A busy user
    is combined before each shuffle, and the windows repeat steps, not events.
    """
    step = events.withWatermark("ts", late).groupBy(F.window("ts", f"{slide_hours} hours").alias("step"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    spans = step.groupBy(F.window("step", f"{hours} hours", f"{slide_hours} hours").alias("w"), "user_id").agg(F.sum("n").alias("n"))
    out = spans.groupBy("w").agg(F.count("user_id").alias("users"), F.sum(F.when(F.col("user_id").isNotNull(), F.col("n"))).alias("events"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "users", "events")


SESSION_SCHEMA = "user_id bigint, first_ts timestamp, last_ts timestamp, messages bigint, liked bigint, rejected bigint, first_parcel string"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions closed by a pause: length, messages, reactions and the first parcel per user."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
             F.sum(F.when(F.col("action") == "favorite", 1).otherwise(0)).alias("liked"), F.sum(F.when(F.col("action") == "reject", 1).otherwise(0)).alias("rejected"),
             F.min_by("parcel_id", F.struct("ts", "event_id")).alias("first_parcel"))
        .select("user_id", "first_ts", "last_ts", "messages", "liked", "rejected", "first_parcel")
    )


PART_SCHEMA = "user_id bigint, location string, n bigint, last_seen timestamp, liked bigint"


def pattern_sink(parcels: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """Adds the sessions that a batch has closed to the pattern table: a part per batch with sums per user and location.

    A part replaces that of the same batch, so a batch that runs again after a failure is not counted twice.
    parcels gives the location (gmina) of a session's first parcel.
    """
    places = parcels.select(F.col("id_dzialki").alias("first_parcel"), F.col("gmina").alias("location"))

    def sink(batch: DataFrame, number: int) -> None:
        # The closed sessions pass for a small side by their estimate; broadcast, all of them would be summed by the one task that reads the parcels.
        part = shuffled(batch).join(shuffled(places), "first_parcel").groupBy("user_id", "location").agg(F.count(F.lit(1)).alias("n"), F.max("last_ts").alias("last_seen"), F.sum("liked").alias("liked"))
        part.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink


def learned_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern table: its parts added up, confidence and importance from the sums."""
    parts = spark.read.schema(PART_SCHEMA + ", batch bigint").parquet(folder)
    sums = parts.groupBy("user_id", "location").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"), F.sum("liked").alias("liked"))
    confidence = F.least(F.lit(0.9), F.lit(0.3) + F.lit(0.1) * F.greatest(F.col("n") - 2, F.lit(0)))
    return sums.select("user_id", "location", "n", "last_seen", F.round(confidence, 4).alias("confidence"), F.round(F.lit(0.5) + F.lit(0.05) * F.col("liked"), 4).alias("importance"))


def learn_to_end(events: DataFrame, parcels: DataFrame, folder: str) -> DataFrame:
    """Sessions of all events, the open ones closed at the end, into the pattern table below folder."""
    stream = sessions(with_end(events, f"{folder}/end"))
    for last in (False, True):
        if last:
            end_stream(events, f"{folder}/end")
        run_to_end(stream, "append", pattern_sink(parcels, f"{folder}/patterns"), f"{folder}/checkpoint")
    return learned_patterns(events.sparkSession, f"{folder}/patterns")


PHASE_SCHEMA = (
    "user_id bigint, searches bigint, favorites bigint, rejections bigint, "
    "first_search struct<ts:timestamp,event_id:bigint>, last_favorite struct<ts:timestamp,event_id:bigint>"
)


def phase_stream(events: DataFrame) -> DataFrame:
    """Per-user counters and the two moments that decide the phase. All parts combine in any order,
    so the state of a busy user stays one small row."""
    a, at = F.col("action"), F.struct("ts", "event_id")
    return events.filter(a.isin("view", "favorite", "reject")).groupBy("user_id").agg(
        F.count_if(a == "view").alias("searches"), F.count_if(a == "favorite").alias("favorites"), F.count_if(a == "reject").alias("rejections"),
        F.min(F.when(a == "view", at)).alias("first_search"), F.max(F.when(a == "favorite", at)).alias("last_favorite"),
    )


def phases(updates: DataFrame) -> DataFrame:
    """Newest counters per user and the phase: DISCOVERY, SEARCH after a search, EVALUATION after a later favourite."""
    parts = ["searches", "favorites", "rejections", "first_search", "last_favorite"]
    last = updates.groupBy("user_id").agg(F.max_by(F.struct(*parts), "batch").alias("s")).select("user_id", "s.*")
    phase = F.when(F.col("last_favorite") > F.col("first_search"), "EVALUATION").when(F.col("first_search").isNotNull(), "SEARCH").otherwise("DISCOVERY")
    return last.withColumn("phase", phase)


def refused_transitions(events: DataFrame, state: DataFrame) -> DataFrame:
    """Side output: favourites given before the user's first search, which do not move the phase."""
    favorites = events.filter(F.col("action") == "favorite")
    early = favorites.join(state.select("user_id", "first_search"), "user_id").filter(F.col("first_search").isNull() | (F.struct("ts", "event_id") < F.col("first_search")))
    return early.select("user_id", "event_id", "parcel_id")


def users_per_day(events: DataFrame) -> DataFrame:
    """start and users: the distinct users of each 24 hours that begin at a full hour.

    An hour of a user counts in the windows that the user's hour before is not in. So hours are added up before windows repeat them, and no
    row is made per user and window. Users without an id are one user; events without a time have a null start.
    """
    hours = events.select("user_id", F.date_trunc("hour", "ts").alias("hr")).distinct()
    gap = F.col("hr") - F.lag("hr").over(Window.partitionBy("user_id").orderBy("hr"))
    fresh = F.when(F.col("hr").isNull(), 1).otherwise(F.least(F.coalesce(gap.cast("interval hour").cast("bigint"), F.lit(24)), F.lit(24))).cast("int")
    counted = hours.withColumn("fresh", fresh).groupBy("hr", "fresh").agg(F.count(F.lit(1)).alias("n"))
    starts = F.transform(F.sequence(F.lit(0), F.col("fresh") - 1), lambda i: F.col("hr") - F.make_dt_interval(hours=i))
    return counted.select(F.explode(starts).alias("start"), "n").groupBy("start").agg(F.sum("n").alias("users"))
