"""Ranking, fusion, relaxation, diverse choice, feedback re-ranking and per-user history."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.functions import texts as T
from hectara.functions.labels import dominant_profile, water_band
from hectara.operators.search import SLICES, scored_search_many
from hectara.session import cut_lineage

# Fixed values of the fusion: source weights in precedence order, rank constant, bonuses.
SOURCE_WEIGHTS = {"graph": 0.45, "spatial": 0.20, "semantic": 0.35}
RANK_CONSTANT = 60
TWO_SOURCE_BONUS, THREE_SOURCE_BONUS = 1.1, 1.3
MIN_RESULTS = 5


def top_ranked(df: DataFrame, order: list[Column], limit: int, by: list[str] | None = None) -> DataFrame:
    """The best rows with their 1-based rank. Without groups only `limit` rows reach the ranking task;
    with groups Spark trims every partition to `limit` rows per group before the shuffle."""
    if not by:
        return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


def fuse(lists: dict[str, DataFrame], keys: list[str], attributes: dict[str, list[str]]) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists; attributes come from the first source that knows them."""
    stacked = None
    for source in SOURCE_WEIGHTS:
        if source not in lists:
            continue
        df = lists[source]
        known = [F.col(a) if a in df.columns and a in attributes[source] else F.lit(None).alias(a) for a in sorted({x for v in attributes.values() for x in v})]
        part = df.select(*keys, F.lit(source).alias("source"), "rank", *known)
        stacked = part if stacked is None else stacked.unionByName(part)
    weight = F.create_map([F.lit(v) for pair in SOURCE_WEIGHTS.items() for v in pair])[F.col("source")]
    place = F.create_map([F.lit(v) for i, s in enumerate(SOURCE_WEIGHTS) for v in (s, i)])[F.col("source")]
    names = sorted({x for v in attributes.values() for x in v})
    fused = stacked.groupBy(*keys).agg(
        F.sum(weight / (F.col("rank") + RANK_CONSTANT)).alias("base"), F.array_sort(F.collect_set("source")).alias("sources"),
        *[F.min_by(a, F.when(F.col(a).isNotNull(), place)).alias(a) for a in names],
    )
    bonus = F.when(F.size("sources") >= 3, THREE_SOURCE_BONUS).when(F.size("sources") == 2, TWO_SOURCE_BONUS).otherwise(1.0)
    return fused.withColumn("score", F.col("base") * bonus).drop("base")


def combine(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """Per search: one graph source alone scores 1/rank, a semantic source alone keeps its similarity, else fusion.

    lists hold search_id, key, rank and, for semantic, similarity.
    """
    stacked = None
    for source, df in lists.items():
        part = df.select("search_id", key, F.lit(source).alias("source"), "rank", (F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double")).alias("similarity"))
        stacked = part if stacked is None else stacked.unionByName(part)
    active = stacked.groupBy("search_id").agg(F.array_sort(F.collect_set("source")).alias("active"))
    fused = fuse({s: df for s, df in lists.items()}, ["search_id", key], {s: [] for s in lists})
    alone = stacked.groupBy("search_id", key).agg(F.min("rank").alias("rank"), F.max("similarity").alias("similarity"))
    score = (
        F.when(F.col("active") == F.array(F.lit("graph")), 1.0 / F.col("rank"))
        .when(F.col("active") == F.array(F.lit("semantic")), F.coalesce("similarity", 1.0 / F.col("rank")))
        .otherwise(F.col("score"))
    )
    return fused.join(alone, ["search_id", key]).join(active, "search_id").select("search_id", key, score.alias("score"))


def enforce_limits(results: DataFrame, min_area: float | None, max_area: float | None) -> DataFrame:
    """Hard limits on combined rows; unknown values pass."""
    df = results
    if min_area:
        df = df.filter(F.col("area_m2").isNull() | (F.col("area_m2") >= min_area))
    if max_area:
        df = df.filter(F.col("area_m2").isNull() | (F.col("area_m2") <= max_area))
    ratio, index = F.col("aspect_ratio"), F.col("shape_index")
    return df.filter((ratio.isNull() | (ratio <= 6.0)) & (index.isNull() | (index >= 0.15)))


DISTANCE_LIMITS = ["forest_m", "water_m", "school_m", "shop_m", "bus_m", "hospital_m"]
HARD_FIELDS = ["search_id", "gmina", "miejscowosc", "powiat", "min_area", "max_area", "ownership_type", "build_status", "size_cats", "pog_residential"]


def relaxed(searches: DataFrame) -> DataFrame:
    changed = {c: F.col(c) * 2 for c in DISTANCE_LIMITS if c in searches.columns}
    changed |= {c: F.col(c) * 0.7 for c in searches.columns if c.startswith("w_")}
    return searches.withColumns(changed)


def hard_only(searches: DataFrame) -> DataFrame:
    return searches.select(*[c for c in HARD_FIELDS if c in searches.columns])


def search_with_relaxation(parcels: DataFrame, searches: DataFrame, per_search: int) -> DataFrame:
    """Three stages of all searches in one job (full, distances doubled, hard filters only); each search keeps the first stage that is rich enough."""
    stages = [searches, relaxed(searches), hard_only(searches)]
    found = None
    for number, criteria in enumerate(stages, start=1):
        part = scored_search_many(parcels, criteria, per_search).select("search_id", F.lit(number).alias("stage"), "id_dzialki", "rank", "total_score")
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found)
    counts = found.groupBy("search_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    enough = (F.col("n") >= MIN_RESULTS) | (F.col("stage") >= 3)
    chosen = counts.filter(enough).groupBy("search_id").agg(F.min("stage").alias("stage"))
    return found.join(chosen, ["search_id", "stage"])


def semantic_list(vectors: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """search_id, id_dzialki, similarity and rank: the parcels whose vector (id_dzialki, vector) is nearest to that of each search (search_id, vector).

    A search goes to every slice of the parcels, and only the best of each partition are shuffled. Rows without a vector are not found.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    unit = lambda df, key: df.filter(F.col("vector").isNotNull()).select(key, F.col("vector").alias("v_" + key), F.sqrt(dot("vector", "vector")).alias("n_" + key))
    there = unit(vectors, "id_dzialki").withColumn("_slice", F.pmod(F.xxhash64("id_dzialki"), F.lit(SLICES)).cast("int"))
    wanted = unit(asked, "search_id").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    similarity = F.round(F.try_divide(dot("v_id_dzialki", "v_search_id"), F.col("n_id_dzialki") * F.col("n_search_id")), 9)
    met = there.join(wanted, "_slice").select("search_id", "id_dzialki", similarity.alias("similarity")).filter("similarity is not null")
    order = Window.partitionBy("search_id").orderBy(F.col("similarity").desc(), "id_dzialki")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def search_with_fallback(parcels: DataFrame, searches: DataFrame, per_search: int, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """search_with_relaxation, and as stage 4 the semantic list for the searches that hard filters alone leave without any row; asked has the vector of each search."""
    found = cut_lineage(search_with_relaxation(parcels, searches, per_search))
    without = asked.join(found.select("search_id").distinct(), "search_id", "left_anti")
    last = semantic_list(vectors, without, per_search).select("search_id", F.lit(4).alias("stage"), "id_dzialki", "rank", F.col("similarity").alias("total_score"))
    return found.unionByName(last)


def apply_diagnosis(searches: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Criteria with their blocking filter relaxed as the diagnosis proposes."""
    d = diagnosis.select("search_id", "blocking_filter", "relaxation")
    j = searches.join(d, "search_id")
    lists = ["quiet_cats", "nature_cats", "density_cats", "access_cats"]
    changed = {c: F.when(F.col("blocking_filter") == c, F.array(F.col("relaxation"))).otherwise(F.col(c)) for c in lists}
    changed |= {c: F.when(F.col("blocking_filter") == c, F.col(c) * 2).otherwise(F.col(c)) for c in ("forest_m", "water_m", "school_m", "shop_m")}
    area = F.col("blocking_filter") == "area"
    changed["min_area"] = F.when(area, F.floor(F.coalesce("min_area", F.lit(0)) * 0.5)).otherwise(F.col("min_area"))
    changed["max_area"] = F.when(area, F.floor(F.coalesce("max_area", F.lit(999999)) * 1.5)).otherwise(F.col("max_area"))
    return j.filter(F.col("blocking_filter") != "combination").withColumns(changed).drop("blocking_filter", "relaxation")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key. An aggregate, not a window: copies are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*keys, "r.*")


def diverse_proposals(ranked: DataFrame, priorities: list[str]) -> DataFrame:
    """Best match, an alternative in another district or of another profile, a surprise, then fill to three.

    ranked: search_id, rank and parcel columns of a bounded result list per search.
    """
    w = Window.partitionBy("search_id")
    df = ranked.withColumn("profile", dominant_profile(F.col("quietness_score"), F.col("nature_score"), F.col("accessibility_score"), F.col("area_m2")))
    best = ("id_dzialki", "dzielnica", "miejscowosc", "profile", "area_m2")
    for c in best:
        df = df.withColumn("best_" + c, F.first(c).over(w.orderBy("rank")))
    df = df.withColumn("found", F.count(F.lit(1)).over(w)).withColumn("surprise", T.surprise(priorities))
    differs = ~F.col("dzielnica").eqNullSafe(F.col("best_dzielnica")) | (F.col("profile") != F.col("best_profile"))
    df = df.withColumn("alt", F.min(F.when((F.col("rank") > 1) & differs, F.col("rank"))).over(w))
    free = (F.col("rank") > 1) & (F.col("alt").isNull() | (F.col("rank") != F.col("alt"))) & (F.col("found") > 2)
    df = df.withColumn("sur", F.min(F.when(free & F.col("surprise").isNotNull(), F.col("rank"))).over(w))
    step = (
        F.when(F.col("rank") == 1, 1).when(F.col("rank") == F.col("alt"), 2).when(F.col("rank") == F.col("sur"), 3).when(free, 4)
    )
    df = df.withColumn("step", step).filter(F.col("step").isNotNull())
    df = df.withColumn("position", F.row_number().over(w.orderBy("step", "rank"))).filter(F.col("position") <= 3)
    label = (
        F.when(F.col("step") == 1, "Najlepsze dopasowanie")
        .when(F.col("step") == 2, F.when(~F.col("dzielnica").eqNullSafe(F.col("best_dzielnica")), "Inna okolica").otherwise("Inny charakter"))
        .when(F.col("step") == 3, "Może Cię zainteresuje")
        .otherwise("Dodatkowa opcja")
    )
    reason = F.when(F.col("step") == 2, T.difference("", "best_")).when(F.col("step") == 3, F.col("surprise")).otherwise(T.match_reason(priorities))
    return df.withColumn("label", label).withColumn("reason", reason)


FEATURES = ["dzielnica", "size_category", "kategoria_ciszy", "kategoria_natury", "typ_wlasnosci", "has_pog", "is_residential_zone", "water_band"]
# Weight of each categorical feature; both flags share one unit.
FEATURE_WEIGHTS = {"dzielnica": 3.0, "size_category": 2.0, "kategoria_ciszy": 2.0, "kategoria_natury": 2.0, "typ_wlasnosci": 1.0, "water_band": 1.0}


def features(parcels: DataFrame, *keep: str) -> DataFrame:
    cols = [F.col(f) for f in FEATURES[:-1]]
    return parcels.select(*keep, *cols, water_band(F.col("dist_to_water")).alias("water_band"))


def similarity(a: str, b: str) -> Column:
    """Weighted share of equal features among those known on both sides."""
    score, most = F.lit(0.0), F.lit(1.0)
    for name, weight in FEATURE_WEIGHTS.items():
        x, y = F.col(a + name), F.col(b + name)
        known = x.isNotNull() & y.isNotNull()
        most = most + F.when(known, weight).otherwise(0.0)
        score = score + F.when(known & (x == y), weight).otherwise(0.0)
    for name in ("has_pog", "is_residential_zone"):
        x, y = F.coalesce(F.col(a + name), F.lit(False)), F.coalesce(F.col(b + name), F.lit(False))
        score = score + F.when(x == y, 0.5).otherwise(0.0)
    return score / most


BOOST, PENALTY = 1.5, 0.6


def rerank(results: DataFrame, ratings: DataFrame) -> DataFrame:
    """results: user_id, id, score, feature columns; ratings: user_id, id, kind (favorite/reject).

    Rated rows teach only where they are among the user's results. Similarity depends on the
    feature values alone, so rows with equal values are counted once per user before the pairing:
    the pairs are bounded by the vocabulary, not by the number of rows.
    """
    r = results.join(ratings, ["user_id", "id"], "left")
    rated = r.filter(F.col("kind").isNotNull()).groupBy("user_id", "kind", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    rated = rated.select("user_id", "kind", "n", *[F.col(f).alias("r_" + f) for f in FEATURES])
    shapes = r.filter(F.col("kind").isNull()).select("user_id", *FEATURES).distinct()
    sim = similarity("", "r_") * F.col("n")
    means = shapes.join(rated, "user_id").groupBy("user_id", *FEATURES).agg(
        *[(F.sum(F.when(F.col("kind") == k, sim)) / F.sum(F.when(F.col("kind") == k, F.col("n")))).alias(a) for k, a in (("favorite", "fav"), ("reject", "rej"))]
    )
    means = means.select(F.col("user_id").alias("m_user"), *[F.col(f).alias("m_" + f) for f in FEATURES], "fav", "rej")
    same = F.col("user_id") == F.col("m_user")
    for f in FEATURES:
        same = same & F.col(f).eqNullSafe(F.col("m_" + f))
    base = r.join(means, same, "left")
    adjusted = F.col("score") * F.coalesce(1 + (BOOST - 1) * F.col("fav"), F.lit(1.0)) * F.coalesce(1 - (1 - PENALTY) * F.col("rej"), F.lit(1.0))
    out = base.filter(F.col("kind").isNull() | (F.col("kind") == "favorite"))
    return out.select("user_id", "id", (F.col("kind") == "favorite").alias("is_favorite"), F.when(F.col("kind").isNull(), adjusted).otherwise(F.col("score")).alias("adjusted")).na.fill(False, ["is_favorite"])


def with_sequence(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """1-based running number in a given order, without a single-task window.

    The rows are range-sorted and checkpointed with their position inside the partition; one
    count per partition gives the offsets.
    """
    keyed = df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())
    keyed = cut_lineage(keyed).withColumn("_part", F.shiftright("_pos", 33)).withColumn("_row", F.col("_pos").bitwiseAND((1 << 33) - 1))
    sizes = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return keyed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_row") + 1).drop("_pos", "_part", "_row", "_off")


def latest(df: DataFrame, by: str, order: list[Column], keep: int) -> DataFrame:
    return top_ranked(df, order, keep, [by])


def session_rollup(events: DataFrame) -> DataFrame:
    """events: session_id, user_id, ts, action, parcel_id. The last action on a parcel decides its reaction."""
    per_item = events.filter(F.col("action").isin("favorite", "reject")).groupBy("session_id", "parcel_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("a"))
    reaction = F.when(F.col("a") == "favorite", "liked").otherwise("rejected")
    reactions = per_item.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parcel_id", reaction)))).alias("reactions"))
    base = events.groupBy("session_id", "user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("messages"), F.min_by("parcel_id", F.struct("ts", "event_id")).alias("first_parcel")
    )
    minutes = F.floor(F.expr("timestampdiff(SECOND, first_ts, last_ts)") / 60).cast("int")
    return base.join(reactions, "session_id", "left").withColumn("duration_minutes", minutes)


def location_patterns(sessions: DataFrame, location: str) -> DataFrame:
    """Confidence 0.3, plus 0.1 per session from the third on, at most 0.9; importance 0.5 plus 0.05 per liked parcel."""
    n = F.count(F.lit(1))
    return sessions.groupBy("user_id", location).agg(
        n.alias("n"), F.max("last_ts").alias("last_seen"), F.round(F.least(F.lit(0.9), F.lit(0.3) + F.lit(0.1) * F.greatest(n - 2, F.lit(0))), 4).alias("confidence"),
        F.round(F.lit(0.5) + F.lit(0.05) * F.sum(F.when(F.col("reactions").isNotNull(), F.size(F.map_filter("reactions", lambda k, v: v == "liked"))).otherwise(0)), 4).alias("importance"),
    )


def repeat_patterns(sessions: DataFrame, location: str) -> DataFrame:
    """Second learner: 0.5 plus 0.1 per repeat, at most 0.9; importance moves 0.05 per liked or rejected parcel; last area range."""
    n = F.count(F.lit(1))

    def how_many(kind: str) -> Column:
        return F.sum(F.when(F.col("reactions").isNotNull(), F.size(F.map_filter("reactions", lambda k, v: v == kind))).otherwise(0))

    return sessions.groupBy("user_id", location).agg(
        n.alias("n"), F.round(F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.1) * (n - 1)), 4).alias("confidence"),
        F.round(F.lit(0.5) + F.lit(0.05) * (how_many("liked") - how_many("rejected")), 4).alias("importance"),
        F.max_by("area_range", F.struct("last_ts", "session_id")).alias("area_range"),
    )


def merge_profile(sessions: DataFrame) -> DataFrame:
    """sessions: user_id, seq, validated, location, budget_max, email. Counts active sessions; the last known facts win."""
    active = F.col("validated") | F.col("budget_max").isNotNull() | F.col("email").isNotNull()

    def last(c: str, test: Column) -> Column:
        return F.max_by(c, F.when(test, F.col("seq")))

    return sessions.groupBy("user_id").agg(
        F.count_if(active).alias("session_count"), last("location", F.col("validated") & F.col("location").isNotNull()).alias("last_location"),
        last("budget_max", F.col("budget_max") > 0).alias("budget_max"), last("email", F.col("email").isNotNull()).alias("email"),
    )


def first_seen_positions(rows: DataFrame, user: str, value: str, seq: str) -> DataFrame:
    """Distinct values per user in first-seen order, one row each with its position."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(user, value).agg(F.min(seq).alias("first_seq"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(user).orderBy("first_seq", value))).drop("first_seq")
