"""WIN and TOP: ranking, fusion, history and top-k."""
from pyspark.sql import functions as F

from hectara.catalog.aggregates import narrow_searches
from hectara.catalog.key_joins import BRICK_STEPS, brick_pairs
from hectara.catalog.registry import query
from hectara.catalog.scoring import HARD_SQL, SCORE_SQL, score_sql
from hectara.operators import ranking as W
from hectara.operators import relations as R
from hectara.operators import search as S
from hectara.operators import statistics as A
from hectara.plans.testbed import ORACLE_TEXT

LISTS = {
    "graph": ("quietness_score DESC NULLS LAST", lambda: F.col("quietness_score").desc_nulls_last()),
    "spatial": ("pow(centroid_x-5000,2)+pow(centroid_y-5000,2)", lambda: F.pow(F.col("centroid_x") - 5000, F.lit(2)) + F.pow(F.col("centroid_y") - 5000, F.lit(2))),
    "semantic": ("nature_score DESC NULLS LAST", lambda: F.col("nature_score").desc_nulls_last()),
}


def ranked_sql(n):
    return " UNION ALL ".join(f"(SELECT '{s}' AS source, id_dzialki, row_number() OVER (ORDER BY {o}, id_dzialki) AS rank FROM parcels ORDER BY rank LIMIT {n})" for s, (o, _) in LISTS.items())


def ranked(t, n):
    p = t("parcels").select("id_dzialki", "gmina", "area_m2", "quietness_score", "nature_score", "centroid_x", "centroid_y")
    return {s: W.top_ranked(p, [o(), F.col("id_dzialki")], n) for s, (_, o) in LISTS.items()}


@query("win_01_source_ranks", ranked_sql(200))
def source_ranks(t):
    parts = [df.select(F.lit(s).alias("source"), "id_dzialki", "rank") for s, df in ranked(t, 200).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "win_02_rank_fusion",
    f"""WITH l AS ({ranked_sql(400)}), s AS (SELECT id_dzialki, sum(CASE source WHEN 'graph' THEN 0.45e0 WHEN 'spatial' THEN 0.2e0 ELSE 0.35e0 END/(60+rank)) AS b, count(DISTINCT source) AS k,
        string_agg(source, '|' ORDER BY source) AS sources, bool_or(source <> 'semantic') AS has_area FROM l GROUP BY 1)
        SELECT s.id_dzialki, sources, round(b * CASE WHEN k >= 3 THEN 1.3e0 WHEN k = 2 THEN 1.1e0 ELSE 1 END, 9) AS score, CASE WHEN has_area THEN p.area_m2 END AS area_m2 FROM s JOIN parcels p ON s.id_dzialki = p.id_dzialki""",
)
def rank_fusion(t):
    fused = W.fuse(ranked(t, 400), ["id_dzialki"], {"graph": ["area_m2"], "spatial": ["area_m2"], "semantic": []})
    return fused.select("id_dzialki", F.array_join("sources", "|").alias("sources"), F.round("score", 9).alias("score"), "area_m2")


@query(
    "win_03_source_shortcuts",
    """WITH g AS (SELECT gmina AS search_id, id_dzialki, row_number() OVER (PARTITION BY gmina ORDER BY quietness_score DESC NULLS LAST, id_dzialki) AS rank FROM parcels WHERE substr(gmina, 8) NOT IN ('1','4','7')),
       m AS (SELECT gmina AS search_id, id_dzialki, nature_score / 1e2 AS sim, row_number() OVER (PARTITION BY gmina ORDER BY nature_score DESC NULLS LAST, id_dzialki) AS rank FROM parcels WHERE substr(gmina, 8) NOT IN ('2','4','5')),
       a AS (SELECT search_id, id_dzialki, 'graph' AS source, rank, NULL AS sim FROM g WHERE rank <= 20 UNION ALL SELECT search_id, id_dzialki, 'semantic', rank, sim FROM m WHERE rank <= 20),
       k AS (SELECT search_id, count(DISTINCT source) AS k, min(source) AS only_source FROM a GROUP BY 1),
       f AS (SELECT search_id, id_dzialki, sum(CASE source WHEN 'graph' THEN 0.45e0 ELSE 0.35e0 END/(60+rank)) * CASE WHEN count(DISTINCT source) = 2 THEN 1.1e0 ELSE 1 END AS s, min(rank) AS rank, max(sim) AS sim FROM a GROUP BY 1, 2)
       SELECT f.search_id, id_dzialki, round(CASE WHEN k = 1 AND only_source = 'graph' THEN 1 / f.rank WHEN k = 1 THEN coalesce(sim, 1 / f.rank) ELSE s END, 9) AS score FROM f JOIN k ON f.search_id = k.search_id""",
)
def source_shortcuts(t):
    p = t("parcels").select(F.col("gmina").alias("search_id"), "id_dzialki", "quietness_score", "nature_score")
    no = F.substring("search_id", 8, 10)
    graph = W.top_ranked(p.filter(~no.isin("1", "4", "7")), [F.col("quietness_score").desc_nulls_last(), F.col("id_dzialki")], 20, ["search_id"])
    semantic = W.top_ranked(p.filter(~no.isin("2", "4", "5")), [F.col("nature_score").desc_nulls_last(), F.col("id_dzialki")], 20, ["search_id"])
    out = W.combine({"graph": graph, "semantic": semantic.withColumn("similarity", F.col("nature_score") / 100)}, "id_dzialki")
    return out.withColumn("score", F.round("score", 9))


_STAGE = """SELECT search_id, {n} AS stage, id_dzialki, total_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY total_score DESC, quietness_score DESC NULLS LAST, id_dzialki) AS rank FROM
  (SELECT s.search_id, p.id_dzialki, p.quietness_score, {score} AS total_score FROM parcels p JOIN {s} s ON (s.gmina IS NULL OR p.gmina = s.gmina) WHERE {hard})) WHERE rank <= 12"""
_SOFT = ["quiet_cats", "nature_cats", "access_cats", "density_cats", "forest_m", "water_m", "water_type", "school_m", "shop_m", "bus_m", "hospital_m", "min_forest_pct", "industrial_m"]
RELAXED_SQL = "(SELECT * REPLACE (" + ", ".join(f"{c}*2 AS {c}" for c in W.DISTANCE_LIMITS) + ", w_quietness*0.7e0 AS w_quietness, w_school*0.7e0 AS w_school) FROM hard_searches)"
HARD_ONLY_SQL = "(SELECT * REPLACE (" + ", ".join(f"NULL AS {c}" for c in _SOFT) + ", 0e0 AS w_quietness, 0e0 AS w_school, false AS buildable) FROM hard_searches)"


@query(
    "win_04_progressive_relaxation",
    "WITH hard_searches AS (SELECT *, search_id % 2 = 0 AS buildable FROM searches), f AS ("
    + " UNION ALL ".join(_STAGE.format(n=i, s=s, score=SCORE_SQL, hard=HARD_SQL + " AND (NOT s.buildable OR p.is_residential_zone)") for i, s in ((1, "hard_searches"), (2, RELAXED_SQL), (3, HARD_ONLY_SQL)))
    + "), c AS (SELECT search_id, min(stage) AS stage FROM (SELECT search_id, stage, count(*) AS n FROM f GROUP BY 1, 2) WHERE n >= 5 OR stage >= 3 GROUP BY 1) SELECT f.* FROM f JOIN c ON f.search_id = c.search_id AND f.stage = c.stage",
)
def progressive_relaxation(t):
    searches = S.split_lists(t("searches")).withColumn("buildable", F.col("search_id") % 2 == 0)
    return W.search_with_relaxation(t("parcels"), searches, 12)


@query(
    "win_04_semantic_fallback",
    "WITH hard_searches AS (SELECT * REPLACE (CASE WHEN search_id % 3 = 0 THEN 10000000 ELSE min_area END AS min_area), search_id % 2 = 0 AS buildable FROM searches), f AS ("
    + " UNION ALL ".join(_STAGE.format(n=i, s=s, score=SCORE_SQL, hard=HARD_SQL + " AND (NOT s.buildable OR p.is_residential_zone)") for i, s in ((1, "hard_searches"), (2, RELAXED_SQL), (3, HARD_ONLY_SQL)))
    + """), c AS (SELECT search_id, min(stage) AS stage FROM (SELECT search_id, stage, count(*) AS n FROM f GROUP BY 1, 2) WHERE n >= 5 OR stage >= 3 GROUP BY 1),
       v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT search_id, id_dzialki, round(list_cosine_similarity(q.v, v.v), 9) AS total_score FROM hard_searches s JOIN v q ON q.vec_id = s.search_id, v JOIN parcels p ON p.pk = v.vec_id WHERE search_id NOT IN (SELECT search_id FROM c))
       SELECT f.search_id, f.stage, f.id_dzialki, f.total_score, f.rank FROM f JOIN c ON f.search_id = c.search_id AND f.stage = c.stage
       UNION ALL SELECT search_id, 4, id_dzialki, total_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY total_score DESC, id_dzialki) AS rank FROM m) WHERE rank <= 12""",
)
def semantic_fallback(t):
    """Every third search asks for more land than there is, so only its vector is left; the vectors of parcels and searches are the given ones of their numbers."""
    searches = S.split_lists(t("searches")).withColumn("buildable", F.col("search_id") % 2 == 0)
    searches = searches.withColumn("min_area", F.when(F.col("search_id") % 3 == 0, 10_000_000).otherwise(F.col("min_area")))
    e = t.raw("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    vectors = t("parcels").select("id_dzialki", "pk").join(e, F.col("pk") == F.col("vec_id"))
    asked = searches.select("search_id").join(e, F.col("search_id") == F.col("vec_id"))
    return W.search_with_fallback(t("parcels"), searches, 12, vectors, asked)


@query(
    "win_05_auto_fallback",
    f"""WITH dg AS ({ORACLE_TEXT['agg_15_diagnosis']}), n AS (SELECT s.* REPLACE (CASE WHEN search_id % 2 = 0 THEN min_area * 30 ELSE min_area END AS min_area, CASE WHEN search_id % 3 = 0 THEN 'brak' ELSE quiet_cats END AS quiet_cats, CASE WHEN search_id % 5 = 3 THEN 1 ELSE forest_m END AS forest_m) FROM searches s),
        r AS (SELECT n.* REPLACE ({", ".join(f"CASE WHEN b = '{c}' THEN v ELSE {c} END AS {c}" for c in ("quiet_cats", "nature_cats", "density_cats", "access_cats"))},
          {", ".join(f"CASE WHEN b = '{c}' THEN {c}*2 ELSE {c} END AS {c}" for c in ("forest_m", "water_m", "school_m", "shop_m"))},
          CASE WHEN b = 'area' THEN CAST(floor(coalesce(min_area,0)*0.5e0) AS BIGINT) ELSE min_area END AS min_area, CASE WHEN b = 'area' THEN CAST(floor(coalesce(max_area,999999)*1.5e0) AS BIGINT) ELSE max_area END AS max_area)
          FROM (SELECT n.*, dg.blocking_filter AS b, dg.relaxation AS v FROM n JOIN dg ON n.search_id = dg.search_id WHERE dg.blocking_filter <> 'combination') n)
        SELECT search_id, id_dzialki, total_score, rank FROM ({_STAGE.format(n=1, s="r", score=SCORE_SQL, hard=HARD_SQL)})""",
)
def auto_fallback(t):
    searches = S.split_lists(narrow_searches(t))
    changed = W.apply_diagnosis(searches, A.diagnose(t("parcels"), searches))
    return S.scored_search_many(t("parcels"), changed, 12).select("search_id", "id_dzialki", "total_score", "rank")


@query(
    "win_06_first_per_key",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def first_per_key(t):
    rows = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return W.first_per_key(rows, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_shipdate")


CAND = """cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gmina ORDER BY quietness_score DESC NULLS LAST, id_dzialki) AS rank FROM parcels) WHERE rank <= 20),
  prof AS (SELECT *, CASE greatest(coalesce(quietness_score,0), coalesce(nature_score,0), coalesce(accessibility_score,0), least(1e2, coalesce(area_m2,0)/2e1)) WHEN coalesce(quietness_score,0) THEN 'quiet' WHEN coalesce(nature_score,0) THEN 'green' WHEN coalesce(accessibility_score,0) THEN 'accessible' ELSE 'spacious' END AS profile,
    coalesce(CASE WHEN dist_to_forest > 0 AND dist_to_forest < 200 THEN 'las tuż obok' END, CASE WHEN pog_maks_wysokosc_m > 12 THEN format('można wybudować {} piętra', CAST(floor(pog_maks_wysokosc_m/3) AS INT)) END,
     CASE WHEN dist_to_school > 0 AND dist_to_school < 500 THEN format('szkoła w {}m', dist_to_school) END, CASE WHEN under_construction > 0 THEN 'okolica się rozwija' END, CASE WHEN dist_to_water > 0 AND dist_to_water < 300 THEN format('woda w {}m', dist_to_water) END) AS surprise FROM cand),
  b AS (SELECT gmina AS g, dzielnica AS bd, profile AS bp, area_m2 AS ba FROM prof WHERE rank = 1),
  a AS (SELECT p.gmina AS g, min(p.rank) AS alt FROM prof p JOIN b ON p.gmina = b.g WHERE p.rank > 1 AND (p.dzielnica IS DISTINCT FROM bd OR p.profile <> bp) GROUP BY 1),
  s AS (SELECT p.gmina AS g, min(p.rank) AS sur FROM prof p LEFT JOIN a ON p.gmina = a.g WHERE p.rank > 1 AND p.rank IS DISTINCT FROM a.alt AND p.surprise IS NOT NULL GROUP BY 1),
  st AS (SELECT p.*, bd, bp, ba, CASE WHEN p.rank = 1 THEN 1 WHEN p.rank = a.alt THEN 2 WHEN p.rank = s.sur THEN 3 ELSE 4 END AS step FROM prof p JOIN b ON p.gmina = b.g LEFT JOIN a ON p.gmina = a.g LEFT JOIN s ON p.gmina = s.g),
  pos AS (SELECT *, row_number() OVER (PARTITION BY gmina ORDER BY step, rank) AS position FROM st)"""
LABEL = "CASE step WHEN 1 THEN 'Najlepsze dopasowanie' WHEN 2 THEN CASE WHEN dzielnica IS DISTINCT FROM bd THEN 'Inna okolica' ELSE 'Inny charakter' END WHEN 3 THEN 'Może Cię zainteresuje' ELSE 'Dodatkowa opcja' END"


def candidates(t):
    p = t("parcels").withColumn("search_id", F.col("gmina"))
    return W.top_ranked(p, [F.col("quietness_score").desc_nulls_last(), F.col("id_dzialki")], 20, ["search_id"])


@query("win_07_diverse_choice", f"WITH {CAND} SELECT gmina AS search_id, id_dzialki, position, {LABEL} AS label FROM pos WHERE position <= 3")
def diverse_choice(t):
    return W.diverse_proposals(candidates(t), ["quiet", "cicha"]).select("search_id", "id_dzialki", "position", "label")


@query(
    "win_08_dominant_profile",
    """SELECT id_dzialki, CASE greatest(coalesce(quietness_score,0), coalesce(nature_score,0), coalesce(accessibility_score,0), least(1e2, coalesce(area_m2,0)/2e1)) WHEN coalesce(quietness_score,0) THEN 'quiet' WHEN coalesce(nature_score,0) THEN 'green'
       WHEN coalesce(accessibility_score,0) THEN 'accessible' ELSE 'spacious' END AS profile FROM parcels""",
)
def dominant_profile(t):
    p = W.dominant_profile(F.col("quietness_score"), F.col("nature_score"), F.col("accessibility_score"), F.col("area_m2"))
    return t("parcels").select("id_dzialki", p.alias("profile"))


BAND = "CASE WHEN dist_to_water < 200 THEN 'very_close' WHEN dist_to_water < 500 THEN 'close' WHEN dist_to_water < 1000 THEN 'moderate' WHEN dist_to_water >= 1000 THEN 'far' END"
SIM = (
    "(" + "+".join(f"CASE WHEN a.{c} = b.{c} THEN {w} ELSE 0 END" for c, w in W.FEATURE_WEIGHTS.items()) + "+CASE WHEN a.has_pog = b.has_pog THEN 0.5e0 ELSE 0 END+CASE WHEN a.is_residential_zone = b.is_residential_zone THEN 0.5e0 ELSE 0 END)/(1e0+"
    + "+".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in W.FEATURE_WEIGHTS.items()) + ")"
)
STATE = """st AS (SELECT user_id, parcel_id, arg_max(action, (ts, event_id)) AS kind FROM feedback WHERE action IN ('favorite','reject') GROUP BY 1, 2)"""


@query(
    "win_09_feedback_rerank",
    f"""WITH f AS (SELECT *, {BAND} AS water_band FROM parcels), r AS (SELECT DISTINCT user_id, parcel_id AS id FROM feedback WHERE action IN ('view','favorite','reject')), {STATE},
        x AS (SELECT r.user_id, r.id, st.kind, 1 + f.pk % 10 / 1e1 AS score, f.* FROM r JOIN f ON r.id = f.id_dzialki LEFT JOIN st ON st.user_id = r.user_id AND st.parcel_id = r.id),
        m AS (SELECT a.user_id, a.id, avg(CASE WHEN b.kind = 'favorite' THEN {SIM} END) AS fav, avg(CASE WHEN b.kind = 'reject' THEN {SIM} END) AS rej FROM x a JOIN x b ON a.user_id = b.user_id AND a.kind IS NULL AND b.kind IS NOT NULL GROUP BY 1, 2)
        SELECT x.user_id, x.id, coalesce(x.kind = 'favorite', false) AS is_favorite, round(CASE WHEN x.kind IS NULL THEN score * coalesce(1 + 0.5e0 * fav, 1) * coalesce(1 - 0.4e0 * rej, 1) ELSE score END, 6) AS adjusted
        FROM x LEFT JOIN m ON x.user_id = m.user_id AND x.id = m.id WHERE x.kind IS NULL OR x.kind = 'favorite'""",
)
def feedback_rerank(t):
    fb = t("feedback")
    seen = fb.filter(F.col("action").isin("view", "favorite", "reject")).select("user_id", F.col("parcel_id").alias("id")).distinct()
    rated = fb.filter(F.col("action").isin("favorite", "reject")).groupBy("user_id", F.col("parcel_id").alias("id")).agg(F.max_by("action", F.struct("ts", "event_id")).alias("kind"))
    feats = W.features(t("parcels").withColumn("score", F.col("pk") % 10 / 10 + 1), "id_dzialki", "score").withColumnRenamed("id_dzialki", "id")
    return W.rerank(seen.join(feats, "id"), rated).withColumn("adjusted", F.round("adjusted", 6))


@query("win_10_similarity", f"WITH f AS (SELECT *, {BAND} AS water_band FROM parcels) SELECT a.id_dzialki, round({SIM}, 6) AS sim FROM f a JOIN f b ON b.pk = a.pk + 7")
def similarity(t):
    f = W.features(t("parcels"), "pk", "id_dzialki")
    other = f.select((F.col("pk") - 7).alias("pk"), *[F.col(c).alias("b_" + c) for c in W.FEATURES])
    return f.join(other, "pk").select("id_dzialki", F.round(W.similarity("", "b_"), 6).alias("sim"))


@query("win_11_running_id", "SELECT building_id, typ, row_number() OVER (ORDER BY typ, building_id) AS id FROM buildings")
def running_id(t):
    return W.with_sequence(t("buildings").select("building_id", "typ"), ["typ", "building_id"])


@query(
    "win_12_latest_searches",
    "SELECT o_custkey AS user_id, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 8",
)
def latest_searches(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    return W.latest(o, "user_id", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 8).select("user_id", "o_orderkey", "rank")


SESS = """ev AS (SELECT *, concat(user_id, '-', strftime(ts, '%Y%m%d')) AS session_id FROM feedback),
  it AS (SELECT session_id, parcel_id, arg_max(action, (ts, event_id)) AS a FROM ev WHERE action IN ('favorite','reject') GROUP BY 1, 2),
  rx AS (SELECT session_id, count(*) FILTER (a='favorite') AS liked, count(*) FILTER (a='reject') AS rejected, string_agg(parcel_id || '=' || CASE a WHEN 'favorite' THEN 'liked' ELSE 'rejected' END, ',' ORDER BY parcel_id) AS reactions FROM it GROUP BY 1),
  se AS (SELECT ev.session_id, user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS messages, arg_min(parcel_id, (ts, event_id)) AS first_parcel FROM ev GROUP BY 1, 2),
  ss AS (SELECT se.*, coalesce(liked, 0) AS liked, coalesce(rejected, 0) AS rejected, coalesce(reactions, '') AS reactions, p.gmina AS location, concat(p.area_m2 // 100, '-', p.area_m2 // 50) AS area_range FROM se LEFT JOIN rx ON se.session_id = rx.session_id JOIN parcels p ON p.id_dzialki = first_parcel)"""


def sessions(t):
    ev = t("feedback").withColumn("session_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")))
    p = t("parcels").select(F.col("id_dzialki").alias("first_parcel"), F.col("gmina").alias("location"), "area_m2")
    low, high = F.expr("area_m2 div 100").cast("string"), F.expr("area_m2 div 50").cast("string")
    return W.session_rollup(ev).join(p, "first_parcel").withColumn("area_range", F.concat(F.coalesce(low, F.lit("")), F.lit("-"), F.coalesce(high, F.lit(""))))


@query("win_13_session_rollup", f"WITH {SESS} SELECT session_id, user_id, messages, CAST(floor(date_diff('microsecond', first_ts, last_ts) / 6e7) AS INT) AS duration_minutes, reactions FROM ss")
def session_rollup(t):
    pairs = F.transform(F.map_entries("reactions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return sessions(t).select("session_id", "user_id", "messages", "duration_minutes", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("reactions"))


@query(
    "win_14_location_patterns",
    f"WITH {SESS} SELECT user_id, location, count(*) AS n, max(last_ts) AS last_seen, round(least(0.9e0, 0.3e0 + 0.1e0 * greatest(count(*) - 2, 0)), 4) AS confidence, round(0.5e0 + 0.05e0 * sum(liked), 4) AS importance FROM ss GROUP BY 1, 2",
)
def location_patterns(t):
    return W.location_patterns(sessions(t), "location")


_ORDERS = """(SELECT o_custkey AS user_id, o_orderkey AS seq, o_orderstatus = 'O' AS validated, o_orderpriority AS location, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS budget_max, CASE WHEN o_orderkey % 7 = 0 THEN concat('u', o_orderkey, '@x.pl') END AS email FROM orders)"""


def order_sessions(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(
        F.col("o_custkey").alias("user_id"), k.alias("seq"), (F.col("o_orderstatus") == "O").alias("validated"), F.col("o_orderpriority").alias("location"),
        F.when(k % 3 == 0, F.floor("o_totalprice")).alias("budget_max"), F.when(k % 7 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@x.pl"))).alias("email"),
    )


@query(
    "win_15_profile_merge",
    f"""SELECT user_id, count(*) FILTER (validated OR budget_max IS NOT NULL OR email IS NOT NULL) AS session_count, arg_max(location, seq) FILTER (validated) AS last_location,
        arg_max(budget_max, seq) FILTER (budget_max > 0) AS budget_max, arg_max(email, seq) FILTER (email IS NOT NULL) AS email FROM {_ORDERS} GROUP BY user_id""",
)
def profile_merge(t):
    return W.merge_profile(order_sessions(t))


@query(
    "win_15_first_seen_locations",
    f"WITH f AS (SELECT user_id, location, min(seq) AS s FROM {_ORDERS} WHERE validated GROUP BY 1, 2) SELECT user_id, location, row_number() OVER (PARTITION BY user_id ORDER BY s, location) AS position FROM f",
)
def first_seen_locations(t):
    return W.first_seen_positions(order_sessions(t).filter("validated"), "user_id", "location", "seq")


@query(
    "win_16_recent_sessions",
    f"WITH {SESS}, m AS (SELECT user_id, first_parcel AS moment, max(last_ts) AS ts FROM ss GROUP BY 1, 2) SELECT 'session' AS kind, user_id, session_id AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC) AS rank FROM ss) WHERE rank <= 20 UNION ALL SELECT 'moment', user_id, moment, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, moment) AS rank FROM m) WHERE rank <= 50",
)
def recent_sessions(t):
    s = sessions(t)
    a = W.latest(s, "user_id", [F.col("last_ts").desc()], 20).select(F.lit("session").alias("kind"), "user_id", F.col("session_id").alias("value"), "rank")
    m = s.groupBy("user_id", F.col("first_parcel").alias("moment")).agg(F.max("last_ts").alias("ts"))
    b = W.latest(m, "user_id", [F.col("ts").desc(), F.col("moment")], 50).select(F.lit("moment").alias("kind"), "user_id", F.col("moment").alias("value"), "rank")
    return a.unionByName(b)


@query(
    "win_17_repeat_patterns",
    f"WITH {SESS} SELECT user_id, location, count(*) AS n, round(least(0.9e0, 0.5e0 + 0.1e0 * (count(*) - 1)), 4) AS confidence, round(0.5e0 + 0.05e0 * (sum(liked) - sum(rejected)), 4) AS importance, arg_max(area_range, (last_ts, session_id)) AS area_range FROM ss GROUP BY 1, 2",
)
def repeat_patterns(t):
    return W.repeat_patterns(sessions(t), "location")


@query("top_01_nulls_last", "SELECT id_dzialki, accessibility_score FROM parcels ORDER BY accessibility_score ASC NULLS LAST, id_dzialki LIMIT 100")
def nulls_last(t):
    return S.search_by_criteria(t("parcels"), order_by="accessibility_score", descending=False, limit=100).select("id_dzialki", "accessibility_score")


@query("top_02_score_order", f"WITH x AS (SELECT DISTINCT p.id_dzialki, p.quietness_score, {SCORE_SQL} AS total_score FROM parcels p JOIN searches s ON (s.gmina IS NULL OR p.gmina = s.gmina) WHERE {HARD_SQL}) SELECT * FROM x ORDER BY total_score DESC, quietness_score DESC NULLS LAST, id_dzialki LIMIT 50")
def score_order(t):
    found = S.scored_search_many(t("parcels"), S.split_lists(t("searches")), 50).select("id_dzialki", "quietness_score", "total_score").distinct()
    return found.orderBy(F.col("total_score").desc(), F.col("quietness_score").desc_nulls_last(), "id_dzialki").limit(50)


@query(
    "top_03_random_choice",
    "SELECT id_dzialki, md5(concat(id_dzialki, '42')) AS draw FROM parcels WHERE is_residential_zone AND id_dzialki NOT IN (SELECT parcel_id FROM feedback WHERE action='view') ORDER BY draw LIMIT 25",
)
def random_choice(t):
    """A seeded draw: hashing id and seed gives the same order on every run and partitioning."""
    shown = t("feedback").filter(F.col("action") == "view").select(F.col("parcel_id").alias("id_dzialki")).distinct()
    left = t("parcels").filter("is_residential_zone").select("id_dzialki").join(shown, "id_dzialki", "left_anti")
    return left.withColumn("draw", F.md5(F.concat("id_dzialki", F.lit("42")))).orderBy("draw").limit(25)


@query(
    "top_04_nearby_three",
    "SELECT src, rel, dst, distance_m, rank FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY distance_m, dst, edge_id) AS rank FROM edges WHERE rel IN ('NEAR_SCHOOL','NEAR_BUS_STOP','NEAR_SHOP')) WHERE rank <= 3",
)
def nearby_three(t):
    e = t("edges").filter(F.col("rel").isin("NEAR_SCHOOL", "NEAR_BUS_STOP", "NEAR_SHOP"))
    return W.top_ranked(e, [F.col("distance_m"), F.col("dst"), F.col("edge_id")], 3, ["src", "rel"]).select("src", "rel", "dst", "distance_m", "rank")


@query("top_05_longest_borders", f"WITH s AS {BRICK_STEPS} SELECT id, neighbor, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY border DESC, neighbor) AS rank FROM s) WHERE rank <= 10")
def longest_borders(t):
    return R.neighbours(brick_pairs(t), 10).select("id", "neighbor", "rank")
