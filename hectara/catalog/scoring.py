"""SCR: scores and math."""
from pyspark.sql import functions as F

from hectara.catalog.key_joins import case
from hectara.catalog.registry import query
from hectara.functions import constants as C
from hectara.functions import scores as X
from hectara.operators import search as S
from hectara.operators.relations import price_lookup


def _has(cats, col):
    return f"coalesce(contains('|' || {cats} || '|', '|' || {col} || '|'), false)"


def _decay(col, ideal, scale):
    return f"(CASE WHEN {col} IS NULL THEN 0 WHEN {col} <= {ideal} THEN 1 ELSE exp(-({col} - {ideal}) / CAST({scale} AS DOUBLE)) END)"


def weight_sql(dim, s="s."):
    parts = {
        "quietness": f"CASE WHEN {s}quiet_cats IS NOT NULL THEN 0.25e0 ELSE 0.1e0 END",
        "nature": f"CASE WHEN {s}nature_cats IS NOT NULL THEN 0.2e0 ELSE 0.05e0 END",
        "forest": f"CASE WHEN {s}forest_m > 0 THEN 0.2e0 ELSE 0e0 END",
        "water": f"CASE WHEN {s}water_type IS NOT NULL OR {s}water_m > 0 THEN 0.2e0 ELSE 0e0 END",
        "school": f"CASE WHEN {s}school_m > 0 THEN 0.15e0 ELSE 0e0 END",
        "shop": f"CASE WHEN {s}shop_m > 0 THEN 0.1e0 ELSE 0e0 END",
        "transport": f"CASE WHEN {s}bus_m > 0 OR {s}access_cats IS NOT NULL THEN 0.1e0 ELSE 0e0 END",
        "accessibility": f"CASE WHEN {s}access_cats IS NOT NULL THEN 0.15e0 ELSE 0.05e0 END",
    }
    total = "+".join(f"({v})" for v in parts.values())
    given = f"{s}w_{dim}" if dim in ("quietness", "school") else "0e0"
    return f"(CASE WHEN greatest({s}w_quietness, {s}w_school) > 0 THEN {given} ELSE round_even(({parts[dim]})/({total}), 3) END)"


def score_sql(s="s.", p="p."):
    def banded(score, band, cats):
        v = f"coalesce({p}{score},0)/1e2"
        return f"(CASE WHEN {_has(s + cats, p + band)} THEN 0.5e0*{v}+0.5e0 ELSE {v} END)"

    def near(col, lim, ideal, scale):
        return _decay(p + col, f"(CASE WHEN {s}{lim} > 0 THEN floor({s}{lim}*0.5e0) ELSE {ideal} END)", f"(CASE WHEN {s}{lim} > 0 THEN {s}{lim} ELSE {scale} END)")

    water = f"(CASE WHEN {s}water_type = 'jezioro' THEN {_decay(p + 'dist_to_lake', '150', '500')} ELSE {near('dist_to_water', 'water_m', 200, 500)} END)"
    shape = f"0.08e0*(0.5e0*CASE WHEN {p}shape_index IS NULL THEN 0.3e0 WHEN {p}shape_index>=0.7e0 THEN 1 WHEN {p}shape_index>=0.4e0 THEN 0.6e0 ELSE 0.2e0 END+0.5e0*CASE WHEN {p}aspect_ratio IS NULL THEN 0.3e0 WHEN {p}aspect_ratio<=2 THEN 1 WHEN {p}aspect_ratio<=4 THEN 0.6e0 ELSE 0.2e0 END)"
    return "round(" + "+".join([
        f"{weight_sql('quietness', s)}*{banded('quietness_score', 'kategoria_ciszy', 'quiet_cats')}",
        f"{weight_sql('nature', s)}*{banded('nature_score', 'kategoria_natury', 'nature_cats')}",
        f"{weight_sql('accessibility', s)}*{banded('accessibility_score', 'kategoria_dostepu', 'access_cats')}",
        f"CASE WHEN {_has(s + 'density_cats', p + 'gestosc_zabudowy')} THEN 0.1e0 ELSE 0 END",
        f"CASE WHEN {_has(s + 'size_cats', p + 'size_category')} THEN 0.1e0 ELSE 0 END",
        f"{weight_sql('forest', s)}*{near('dist_to_forest', 'forest_m', 200, 500)}",
        f"{weight_sql('water', s)}*{water}",
        f"{weight_sql('school', s)}*{near('dist_to_school', 'school_m', 400, 1000)}",
        f"{weight_sql('shop', s)}*{near('dist_to_supermarket', 'shop_m', 300, 800)}",
        f"{weight_sql('transport', s)}*{near('dist_to_bus_stop', 'bus_m', 250, 600)}",
        f"CASE WHEN {s}hospital_m > 0 THEN 0.1e0*{near('dist_to_doctors', 'hospital_m', 1, 1)} ELSE 0 END",
        f"CASE WHEN {s}min_forest_pct > 0 THEN 0.1e0*CASE WHEN {p}pct_forest_500m >= {s}min_forest_pct THEN 1 WHEN {p}pct_forest_500m >= {s}min_forest_pct*0.5e0 THEN 0.5e0 ELSE coalesce({p}pct_forest_500m,0)/{s}min_forest_pct END ELSE 0 END",
        f"CASE WHEN {s}industrial_m > 0 THEN 0.1e0*CASE WHEN {p}dist_to_industrial IS NULL THEN 0.5e0 WHEN {p}dist_to_industrial >= {s}industrial_m THEN 1 WHEN {p}dist_to_industrial >= {s}industrial_m//2 THEN 0.5e0 ELSE 0 END ELSE 0 END",
        shape,
    ]) + ", 6)"


SCORE_SQL = score_sql()
HARD_SQL = (
    "(s.miejscowosc IS NULL OR p.dzielnica = s.miejscowosc OR starts_with(p.dzielnica, s.miejscowosc || ' ')) AND (coalesce(s.min_area,0) <= 0 OR p.area_m2 >= s.min_area) AND (coalesce(s.max_area,0) <= 0 OR p.area_m2 <= s.max_area)"
    " AND (s.ownership_type IS NULL OR p.typ_wlasnosci = s.ownership_type) AND (s.build_status IS NULL OR (CASE WHEN p.is_built THEN 'zabudowana' ELSE 'niezabudowana' END) = s.build_status)"
    " AND (p.aspect_ratio IS NULL OR p.aspect_ratio <= 6) AND (p.shape_index IS NULL OR p.shape_index >= 0.15e0) AND (p.pog_symbol IS NULL OR p.pog_symbol NOT IN ('SK','SI'))"
)


@query(
    "scr_01_scored_search",
    f"""SELECT search_id, id_dzialki, total_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY total_score DESC, quietness_score DESC NULLS LAST, id_dzialki) AS rank FROM
        (SELECT s.search_id, p.id_dzialki, p.quietness_score, {SCORE_SQL} AS total_score FROM parcels p JOIN searches s ON (s.gmina IS NULL OR p.gmina = s.gmina) WHERE {HARD_SQL})) WHERE rank <= 20""",
)
def scored_search(t):
    return S.scored_search_many(t("parcels"), S.split_lists(t("searches")), 20).select("search_id", "id_dzialki", "total_score", "rank")


@query(
    "scr_02_distance_decay",
    f"SELECT id_dzialki, round({_decay('dist_to_forest', 200, 500)}, 6) AS forest, round({_decay('dist_to_school', 400, 1000)}, 6) AS school, round({_decay('dist_to_lake', 150, 500)}, 6) AS lake FROM parcels",
)
def distance_decay(t):
    d = {"forest": ("dist_to_forest", 200, 500), "school": ("dist_to_school", 400, 1000), "lake": ("dist_to_lake", 150, 500)}
    return t("parcels").select("id_dzialki", *[F.round(X.decay(F.col(c), i, k), 6).alias(n) for n, (c, i, k) in d.items()])


@query("scr_03_weights", "SELECT search_id, " + ", ".join(f"{weight_sql(d, '')} AS {d}" for d in S.DIMENSIONS) + " FROM searches")
def weights(t):
    w = S.weights(S.criteria_columns(S.split_lists(t("searches")), ""))
    return S.split_lists(t("searches")).select("search_id", *[c.alias(d) for d, c in w.items()])


def _cap(c, cap, missing=None):
    return f"CAST(least(greatest(coalesce({c}, {cap if missing is None else missing}), 0), {cap}) AS DOUBLE)"


@query("scr_04_quietness", f"SELECT id_dzialki, CAST(round_even({_cap('dist_to_industrial', 5000)}/5000*50 + {_cap('dist_to_main_road', 3000)}/3000*50, 0) AS INT) AS score FROM parcels")
def quietness(t):
    return t("parcels").select("id_dzialki", X.quietness(F.col("dist_to_industrial"), F.col("dist_to_main_road")).alias("score"))


@query(
    "scr_05_nature",
    f"SELECT id_dzialki, CAST(round_even((1-{_cap('dist_to_forest', 5000)}/5000)*40 + (1-{_cap('dist_to_water', 5000)}/5000)*30 + {_cap('pct_forest_500m', 50, 0)}/50*30, 0) AS INT) AS score FROM parcels",
)
def nature(t):
    return t("parcels").select("id_dzialki", X.nature(F.col("dist_to_forest"), F.col("dist_to_water"), F.col("pct_forest_500m")).alias("score"))


@query(
    "scr_06_accessibility",
    f"""SELECT id_dzialki, CAST(round_even((1-{_cap('dist_to_bus_stop', 3000)}/3000)*30 + (1-{_cap('dist_to_school', 3000)}/3000)*25 + (1-{_cap('dist_to_supermarket', 2000)}/2000)*25 + (1-{_cap('dist_to_pharmacy', 3000)}/3000)*20, 0) AS INT) AS score FROM parcels""",
)
def accessibility(t):
    return t("parcels").select("id_dzialki", X.accessibility(*[F.col(c) for c in ("dist_to_bus_stop", "dist_to_school", "dist_to_supermarket", "dist_to_pharmacy")]).alias("score"))


def _ud(c, cap):
    return f"(CASE WHEN {c} IS NULL OR {c} < 0 THEN 0e0 ELSE greatest(0e0, 1-least({c},{cap})/CAST({cap} AS DOUBLE)) END)"


def _us(c):
    return f"(CASE WHEN {c} IS NULL THEN 0.5e0 ELSE greatest(0e0, least(1e0, {c}/1e2)) END)"


def _up(c):
    return f"(CASE WHEN {c} IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, {c}/1e2)) END)"


UA = "(CASE WHEN area_m2 IS NULL OR area_m2 <= 0 THEN 0.5e0 ELSE (log10(greatest(100, least(area_m2, 10000)))-2)/2 END)"
UC = "(CASE WHEN count_buildings_500m IS NULL THEN 0e0 ELSE least(1e0, count_buildings_500m/5e2) END)"


@query("scr_07_normalisers", f"SELECT id_dzialki, round({_ud('dist_to_school', 3000)},6) AS d, round({_us('quietness_score')},6) AS s, round({_up('pct_forest_500m')},6) AS p, round({UA},6) AS a, round({UC},6) AS c FROM parcels")
def normalisers(t):
    c = F.col
    return t("parcels").select(
        "id_dzialki", F.round(X.unit_distance(c("dist_to_school"), 3000), 6).alias("d"), F.round(X.unit_score(c("quietness_score")), 6).alias("s"),
        F.round(X.unit_percent(c("pct_forest_500m")), 6).alias("p"), F.round(X.unit_area(c("area_m2")), 6).alias("a"), F.round(X.unit_count(c("count_buildings_500m")), 6).alias("c"),
    )


def _f(test):
    return f"(CASE WHEN {test} THEN 1e0 ELSE 0e0 END)"


VECTOR_SQL = (
    [_us(c) for c in ("quietness_score", "nature_score", "accessibility_score")]
    + [_ud(f"dist_to_{n}", k) for n, k in (("school", 3000), ("bus_stop", 1000), ("forest", 2000), ("water", 2000), ("sea", 10000), ("river", 3000), ("lake", 5000), ("main_road", 2000))]
    + [_up("pct_forest_500m"), _up("pct_water_500m"), UC, UA, "least(1e0, coalesce(nullif(shape_index, 0), 1e0)/3)", _f("is_residential_zone"), _f("has_pog"), _f("is_built"), _up("building_coverage_pct")]
    + [_f(f"coalesce(nearest_water_type,'') = '{w}'") for w in ("morze", "jezioro", "rzeka", "kanal", "staw", "zatoka")]
    + [_ud(f"dist_to_{n}", k) for n, k in (("supermarket", 2000), ("pharmacy", 3000), ("kindergarten", 2000), ("restaurant", 2000), ("industrial", 1000))]
    + [f"({_ud('dist_to_sea', 1000)}+{_up('pct_forest_500m')}+{_us('quietness_score')})/3"]
)


@query("scr_08_feature_vector", "SELECT id_dzialki, " + ", ".join(f"round({e}, 6) AS v{i:02d}" for i, e in enumerate(VECTOR_SQL)) + " FROM parcels")
def feature_vector(t):
    v = t("parcels").select("id_dzialki", X.feature_vector().alias("v"))
    return v.select("id_dzialki", *[F.round(F.col("v")[i], 6).alias(f"v{i:02d}") for i in range(32)])


_W4 = ["w_quietness", "0.3e0", "search_id/5e1", "0.5e0"]
_RAW = [f"({w})*({(1 if i % 2 == 0 else -1)})*({1.0 - 0.1 * (i % 4)}e0)" for w in _W4 for i in range(8)]


@query("scr_09_preference_vector", "WITH r AS (SELECT search_id, [" + ", ".join(_RAW) + "] AS v FROM searches) SELECT search_id, unnest(range(32)) AS dim, round(unnest(v)/sqrt(list_dot_product(v, v)), 6) AS x FROM r")
def preference_vector(t):
    v = t("searches").select("search_id", X.preference_vector(F.col("w_quietness"), F.lit(0.3), F.col("search_id") / 50, F.lit(0.5)).alias("v"))
    return v.select("search_id", F.posexplode("v").alias("dim", "x")).select("search_id", "dim", F.round("x", 6).alias("x"))


TRANSPORT = "CASE WHEN {d} < 200 THEN 95 WHEN {d} < 500 THEN 80 WHEN {d} < 800 THEN 60 WHEN {d} < 1200 THEN 40 ELSE 20 END"
NEAREST = "n AS (SELECT src, min(CASE WHEN rel='NEAR_BUS_STOP' THEN distance_m END) AS stop, min(CASE WHEN rel='NEAR_SHOP' THEN distance_m END) AS shop, min(CASE WHEN rel='NEAR_SCHOOL' THEN distance_m END) AS school FROM edges GROUP BY src)"
AMENITIES = "least(50 + CASE WHEN shop < 500 THEN 20 WHEN shop < 1000 THEN 10 ELSE 0 END + CASE WHEN school < 1000 THEN 20 WHEN school < 2000 THEN 10 ELSE 0 END, 100)"


def nearest_edges(t):
    """Shortest edge per parcel and kind, one row per parcel."""
    kinds = {"NEAR_BUS_STOP": "stop", "NEAR_SHOP": "shop", "NEAR_SCHOOL": "school"}
    return t("edges").groupBy(F.col("src").alias("id_dzialki")).agg(*[F.min(F.when(F.col("rel") == r, F.col("distance_m"))).alias(n) for r, n in kinds.items()])


@query(
    "scr_10_neighbourhood_scores",
    f"""WITH {NEAREST}, s AS (SELECT id_dzialki, {TRANSPORT.format(d='coalesce(stop, dist_to_bus_stop, 1000)')} AS transport, {AMENITIES} AS amenities, coalesce(quietness_score, 50) AS q FROM parcels LEFT JOIN n ON id_dzialki = src)
        SELECT id_dzialki, transport, amenities, round((transport + amenities + q) / 3, 4) AS livability FROM s""",
)
def neighbourhood_scores(t):
    j = t("parcels").select("id_dzialki", "dist_to_bus_stop", "quietness_score").join(nearest_edges(t), "id_dzialki", "left")
    s = j.withColumn("transport", X.transport_score(F.col("stop"), F.col("dist_to_bus_stop"))).withColumn("amenities", X.amenities_score(F.col("shop"), F.col("school")))
    return s.select("id_dzialki", "transport", "amenities", F.round((F.col("transport") + F.col("amenities") + F.coalesce("quietness_score", F.lit(50))) / 3, 4).alias("livability"))


FLAGS = {
    "discovery_started": "n > 0", "location_collected": "views > 10", "budget_collected": "n % 2 = 0", "results_shown": "views > 0", "many_shown": "views > 5",
    "has_favorites": "favs > 12", "details_requested": "n % 3 = 0", "map_viewed": "n % 5 = 0", "property_selected": "favs > 15", "price_discussed": "n % 7 = 0",
}
PER_USER = "SELECT user_id, count(*) AS n, count(*) FILTER (action='view') AS views, count(*) FILTER (action='favorite') AS favs, count(*) FILTER (action='compare') AS compares FROM feedback GROUP BY user_id"


def per_user(t):
    a = F.col("action")
    return t("feedback").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(a == k).alias(n) for k, n in (("view", "views"), ("favorite", "favs"), ("compare", "compares"))])


@query(
    "scr_11_engagement",
    f"""WITH u AS ({PER_USER}), f AS (SELECT *, least({" + ".join(f"CASE WHEN {FLAGS[n]} THEN {int(round(w * 100))} ELSE 0 END" for n, w in X.FUNNEL_SIGNALS)}, 100) / 1e2 AS funnel FROM u)
        SELECT user_id, round(least(least(n*0.1e0,0.3e0)+least(views*0.05e0,0.2e0)+least(compares*0.1e0,0.5e0),1), 6) AS engagement, funnel, CASE WHEN funnel >= 0.7e0 THEN 'hot' WHEN funnel >= 0.5e0 THEN 'high' WHEN funnel >= 0.3e0 THEN 'medium' ELSE 'low' END AS level FROM f""",
)
def engagement(t):
    u = per_user(t)
    funnel = X.funnel_score({n: F.expr(e) for n, e in FLAGS.items()})
    return u.select("user_id", F.round(X.engagement(F.col("n"), F.col("views"), F.col("compares")), 6).alias("engagement"), funnel.alias("funnel"), X.engagement_level(funnel).alias("level"))


@query(
    "scr_12_price_text",
    """WITH v AS (SELECT id_dzialki, CAST(area_m2 AS BIGINT) * coalesce(d.price_min, c.price_min) AS v FROM parcels p LEFT JOIN prices d ON p.gmina = d.city AND p.dzielnica = d.district LEFT JOIN city_prices c ON p.gmina = c.city)
       SELECT id_dzialki, CASE WHEN v >= 1000000 THEN format('{:.2f} mln zł', v / 1e6) ELSE format('{}k zł', v // 1000) END AS price FROM v WHERE v IS NOT NULL""",
)
def price_text(t):
    rows = price_lookup(t("parcels").select("id_dzialki", "gmina", "dzielnica", "area_m2"), "gmina", "dzielnica", t("prices"), t("city_prices"))
    v = (F.col("area_m2").cast("bigint") * F.col("p.price_min")).alias("v")
    return rows.select("id_dzialki", v).filter(F.col("v").isNotNull()).select("id_dzialki", X.price_text(F.col("v")).alias("price"))
