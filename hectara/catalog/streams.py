"""STM: feedback streams, each driven to the end of the given events and compared with its batch meaning."""
import uuid

from pyspark.sql import functions as F

from hectara.catalog.registry import query
from hectara.session import shared_dir
from hectara.streaming import feedback as B
from hectara.streaming import phase_machine as M


def events(t):
    return B.event_stream(t.spark, t.sf_dir, "events.parquet")


@query("stm_01_rating_state", "SELECT user_id, parcel_id, arg_max(action, (ts, event_id)) AS rating FROM feedback WHERE action IN ('favorite','reject') GROUP BY 1, 2")
def rating_state(t):
    return B.current_ratings(B.collect_stream(B.rating_stream(events(t)), "update", B.RATING_SCHEMA))


@query(
    "stm_02_history_and_clear",
    """WITH c AS (SELECT user_id, max((ts, event_id)) AS c FROM feedback WHERE action = 'clear' GROUP BY 1)
       SELECT f.user_id, parcel_id, arg_max(action, (ts, event_id)) AS rating FROM feedback f LEFT JOIN c ON f.user_id = c.user_id WHERE action IN ('favorite','reject') AND (c.c IS NULL OR (ts, event_id) > c.c) GROUP BY 1, 2""",
)
def history_and_clear(t):
    return B.history(t("feedback"))


@query(
    "stm_03_active_users",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr, count(*) AS n FROM feedback WHERE user_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT hr - INTERVAL (i) HOUR AS start, user_id, n FROM h, range(24) r(i))
       SELECT start, start + INTERVAL 24 HOUR AS "end", count(DISTINCT user_id) AS users, CAST(sum(n) AS BIGINT) AS events FROM s GROUP BY start""",
)
def active_users(t):
    out = B.collect_to_end(B.active_users, events(t), B.ACTIVE_SCHEMA)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "users", "events")


@query(
    "stm_03_active_users_batch",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hr FROM feedback), s AS (SELECT DISTINCT user_id, hr - INTERVAL (i) HOUR AS start FROM h, range(24) r(i)) SELECT start, count(*) AS users FROM s GROUP BY start""",
)
def active_users_batch(t):
    """Exact users per sliding day."""
    return B.users_per_day(t("feedback"))


@query(
    "stm_04_phase_counters",
    """WITH f AS (SELECT user_id, min((ts, event_id)) FILTER (action = 'view') AS s FROM feedback GROUP BY 1)
       SELECT e.user_id, CASE WHEN bool_or(action = 'favorite' AND f.s IS NOT NULL AND (ts, event_id) > f.s) THEN 'EVALUATION' WHEN any_value(f.s) IS NOT NULL THEN 'SEARCH' ELSE 'DISCOVERY' END AS phase, count(*) FILTER (action='view') AS searches, count(*) FILTER (action='favorite') AS favorites,
       count(*) FILTER (action='reject') AS rejections, count(*) FILTER (action='favorite' AND (f.s IS NULL OR (ts, event_id) < f.s)) AS refused FROM feedback e JOIN f ON e.user_id = f.user_id WHERE action IN ('view','favorite','reject') GROUP BY 1""",
)
def phase_counters(t):
    state = B.phases(B.collect_stream(B.phase_stream(events(t)), "update", B.PHASE_SCHEMA))
    log = t("feedback").withColumn("ts", F.col("ts").cast("timestamp"))
    refused = B.refused_transitions(log, state).groupBy("user_id").agg(F.count(F.lit(1)).alias("refused"))
    return state.join(refused, "user_id", "left").na.fill(0, ["refused"]).select("user_id", "phase", "searches", "favorites", "rejections", "refused")


@query(
    "stm_04_phase_steps",
    """WITH k AS (SELECT user_id, event_id, (epoch_us(ts), event_id) AS m, action FROM feedback WHERE user_id IS NOT NULL AND action IN ('view','favorite')), f AS (SELECT user_id, min(m) AS s FROM k WHERE action = 'view' GROUP BY 1),
       v AS (SELECT k.user_id, k.event_id, k.m, f.s FROM k LEFT JOIN f ON k.user_id = f.user_id WHERE action = 'favorite'), e AS (SELECT user_id, min(m) AS m FROM v WHERE m > s GROUP BY 1),
       x AS (SELECT user_id, s AS m, 'SEARCH' AS step FROM f UNION ALL SELECT user_id, m, 'EVALUATION' FROM e UNION ALL SELECT user_id, m, 'refused' FROM v WHERE s IS NULL OR m < s)
       SELECT user_id, m[2] AS event_id, m[1] AS us, step FROM x""",
)
def phase_steps(t):
    with M.keyed_state(t.spark):
        return B.collect_to_end(M.phase_steps, events(t), M.STEP_SCHEMA)


SESSION_SQL = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_s FROM feedback WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
  ss AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS messages, count(*) FILTER (action='favorite') AS liked, count(*) FILTER (action='reject') AS rejected, arg_min(parcel_id, (ts, event_id)) AS first_parcel FROM s GROUP BY user_id, sid)"""


@query("stm_05_stream_sessions", f"WITH {SESSION_SQL} SELECT * FROM ss")
def stream_sessions(t):
    out = B.collect_to_end(B.sessions, events(t), B.SESSION_SCHEMA).filter(F.col("user_id").isNotNull())
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query(
    "stm_05_learned_patterns",
    f"""WITH {SESSION_SQL} SELECT user_id, gmina AS location, count(*) AS n, max(last_ts) AS last_seen, round(least(0.9e0, 0.3e0 + 0.1e0 * greatest(count(*) - 2, 0)), 4) AS confidence,
        round(0.5e0 + 0.05e0 * sum(liked), 4) AS importance FROM ss JOIN parcels ON id_dzialki = first_parcel GROUP BY 1, 2""",
)
def learned_patterns(t):
    """Closed sessions of the stream into the pattern table, batch by batch."""
    out = B.learn_to_end(events(t), t("parcels"), f"{shared_dir(t.spark)}/hectara-patterns-{uuid.uuid4().hex}")
    return out.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query(
    "stm_05_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_s FROM feedback WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
       SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS messages, count(*) FILTER (action='favorite') AS liked, count(*) FILTER (action='reject') AS rejected FROM s GROUP BY user_id, sid""",
)
def sessions(t):
    out = B.sessions(t("feedback").withColumn("ts", F.col("ts").cast("timestamp"))).drop("first_parcel")
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))
