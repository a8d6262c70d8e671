import datetime
import random
import tempfile

from pyspark.sql import functions as F

from hectara.plans.testbed import table
from hectara.streaming import feedback as B
from hectara.streaming import phase_machine as M

SF = "/root/testdata/sf0.001"


def test_replay_after_restart_equals_batch(spark):
    """Two runs with one checkpoint over files that arrive in two portions give the batch result."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw = spark.read.parquet(f"{SF}/events.parquet")
    halves = [raw.filter("event_id % 2 = 1"), raw.filter("event_id % 2 = 0")]

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for part in halves:
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        B.run_to_end(B.rating_stream(B.event_stream(spark, f"{base}/in")), "update", sink, f"{base}/cp")
    log = spark.read.schema(B.RATING_SCHEMA + ", batch bigint").parquet(f"{base}/out")
    assert log.select("batch").distinct().count() >= 2
    want = {tuple(r) for r in B.ratings_batch(table(spark, SF, "feedback")).collect()}
    assert {tuple(r) for r in B.current_ratings(log).collect()} == want and want


def test_clear_is_a_tombstone(spark):
    rows = [(1, 1, "favorite", "a"), (2, 1, "clear", "a"), (3, 1, "reject", "b"), (4, 1, "favorite", "b"), (5, 2, "favorite", "a")]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, action string, parcel_id string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {tuple(r) for r in B.history(e).collect()} == {(1, "b", "favorite"), (2, "a", "favorite")}


def arrivals(spark, base, seed=5, days=12):
    """Files of events that arrive out of order by up to an hour, and the events of all of them."""
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    kinds = ["view", "purchase", "error", "click", "purchase"]
    rows = [(i, start + datetime.timedelta(seconds=rng.randrange(days * 86400)), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(kinds), 1.0, f'{{"k": {rng.randrange(9)}}}') for i in range(400)]
    # Users 4 and 5: an early view that comes last, and no view at all.
    rows += [(900, start + datetime.timedelta(hours=2, minutes=30), 4, "purchase", 1.0, "1"), (901, start + datetime.timedelta(hours=2, minutes=50), 4, "view", 1.0, "1"),
             (902, start + datetime.timedelta(hours=2, minutes=10), 4, "view", 1.0, "1"), (903, start + datetime.timedelta(hours=9), 5, "purchase", 1.0, "1"), (904, start + datetime.timedelta(days=days), 5, "purchase", 1.0, "1")]
    late = {r[0]: datetime.timedelta(minutes=rng.randrange(55)) for r in rows} | {902: datetime.timedelta(minutes=55), 900: datetime.timedelta(0), 901: datetime.timedelta(0)}
    rows.sort(key=lambda r: r[1] + late[r[0]])
    schema = B.EVENT_SCHEMA
    parts = [rows[i:i + 60] for i in range(0, len(rows), 60)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.createDataFrame(rows, schema)


def batch_events(raw):
    action = F.create_map([F.lit(v) for pair in B.ACTIONS.items() for v in pair])[F.col("event_type")]
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.coalesce(action, "event_type").alias("action"), F.concat(F.lit("D"), F.regexp_extract("props", "([0-9]+)", 1)).alias("parcel_id"))


def test_phase_steps_over_batches_and_restart(spark):
    """Out-of-order events in several batches, a restart and the end give the steps of the whole log, each once."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw = arrivals(spark, base)

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    events = B.event_stream(spark, f"{base}/in", files=1)
    with M.keyed_state(spark):
        stream = M.phase_steps(B.with_end(events, f"{base}/end"))
        B.run_to_end(stream, "append", sink, f"{base}/cp")
        early = spark.read.schema(M.STEP_SCHEMA + ", batch bigint").parquet(f"{base}/out").count()
        B.end_stream(events, f"{base}/end")
        B.run_to_end(stream, "append", sink, f"{base}/cp")
    got = sorted(tuple(r) for r in spark.read.schema(M.STEP_SCHEMA + ", batch bigint").parquet(f"{base}/out").drop("batch").collect())
    want = sorted(tuple(r) for r in M.steps_batch(batch_events(raw)).collect())
    assert got == want and 0 < early < len(want)
    steps = {(r[0], r[1]): r[3] for r in got}
    assert steps[4, 902] == "SEARCH" and steps[4, 900] == "EVALUATION" and steps[5, 903] == steps[5, 904] == "refused"


def test_sessions_windows_and_patterns_to_the_end(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw = arrivals(spark, base)
    events, log = B.event_stream(spark, f"{base}/in", files=1), batch_events(raw)
    parcels = spark.createDataFrame([(f"D{i}", f"G{i % 2}") for i in range(10)], "id_dzialki string, gmina string")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(B.collect_to_end(B.active_users, events, B.ACTIVE_SCHEMA)) == rows(B.active_users(log))
    closed = B.sessions(log).filter("user_id is not null")
    want = closed.join(parcels, closed.first_parcel == parcels.id_dzialki).groupBy("user_id", "gmina").agg(F.count("*").alias("n"), F.max("last_ts").alias("l"))
    got = B.learn_to_end(events, parcels, f"{base}/learn").filter("user_id is not null")
    assert rows(got.select("user_id", F.col("location").alias("gmina"), "n", F.col("last_seen").alias("l"))) == rows(want)


def test_a_batch_that_runs_again_is_not_counted_twice(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parcels = spark.createDataFrame([("D1", "G")], "id_dzialki string, gmina string")
    batch = spark.createDataFrame([(7, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), 3, 1, 0, "D1")], B.SESSION_SCHEMA)
    sink = B.pattern_sink(parcels, base)
    for number in (0, 1, 1, 2):
        sink(batch, number)
    assert [(r.n, r.confidence, r.importance) for r in B.learned_patterns(spark, base).collect()] == [(3, 0.4, 0.65)]


def test_only_views_and_favorites_reach_the_phase_machine(spark, capsys):
    """Other rows move the watermark and end there: they are dropped behind it, before the shuffle."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    arrivals(spark, base)
    with M.keyed_state(spark):
        writer = M.phase_steps(B.event_stream(spark, f"{base}/in")).writeStream.outputMode("append").format("noop")
        query = writer.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    query.explain(True)
    lines = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0].splitlines()
    needed = [i for i, line in enumerate(lines) if "Filter" in line and "favorite" in line]
    watermark = [i for i, line in enumerate(lines) if "EventTimeWatermark" in line]
    assert needed and watermark and needed[-1] < watermark[0]
