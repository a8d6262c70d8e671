"""CLS: classification rules."""
from pyspark.sql import functions as F

from hectara.catalog.key_joins import case
from hectara.catalog.registry import query
from hectara.catalog.scoring import NEAREST, PER_USER, nearest_edges, per_user
from hectara.functions import constants as C
from hectara.functions import labels as L
from hectara.operators.ranking import top_ranked


@query(
    "cls_01_size_class",
    """SELECT id_dzialki, CASE WHEN area_m2 < 500 THEN 'mala' WHEN area_m2 < 1500 THEN 'pod_dom' WHEN area_m2 < 5000 THEN 'duza' WHEN area_m2 >= 5000 THEN 'bardzo_duza' END AS size_class,
       CASE WHEN area_m2 < 500 THEN 'mala' WHEN area_m2 < 2000 THEN 'pod_dom' WHEN area_m2 < 5000 THEN 'duza' WHEN area_m2 >= 5000 THEN 'bardzo_duza' END AS dimension_class FROM parcels""",
)
def size_class(t):
    return t("parcels").select("id_dzialki", L.size_class(F.col("area_m2")).alias("size_class"), L.size_class(F.col("area_m2"), "dimension").alias("dimension_class"))


@query("cls_02_score_bands", "SELECT id_dzialki, kategoria_ciszy AS quiet, kategoria_natury AS nature, kategoria_dostepu AS access, gestosc_zabudowy AS density FROM parcels")
def score_bands(t):
    c = F.col
    bands = {"quiet": ("quietness_score", "quietness"), "nature": ("nature_score", "nature"), "access": ("accessibility_score", "accessibility"), "density": ("count_buildings_500m", "density")}
    return t("parcels").select("id_dzialki", *[L.band(c(col), kind).alias(n) for n, (col, kind) in bands.items()])


@query("cls_03_zoning_flags", "SELECT id_dzialki, coalesce(pog_symbol IN ('SW','SJ','SN','SU','SM'), false) AS residential, pog_symbol IS NOT NULL AS zoned FROM parcels")
def zoning_flags(t):
    return t("parcels").select("id_dzialki", L.residential(F.col("pog_symbol")).alias("residential"), F.col("pog_symbol").isNotNull().alias("zoned"))


WATER_BODIES = ["Zatoka Gdańska", "Bałtyk", "Radunia", "Kanał Raduni", "Jezioro Jasień", "Staw Młyński", None, "Jezioro Wysockie", "Zbiornik Nowy", "Rów A", None, "Czarna Łacha"]
WATER_KINDS = ["woda morska", "woda płynąca", "woda stojąca", None, "woda morska"]
NAME_SQL = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(WATER_BODIES) if n) + " END"
KIND_SQL = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(WATER_KINDS) if n) + " END"
NAMED_SQL = " ".join("WHEN " + " OR ".join(f"contains(lower(n), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in C.WATER_NAMES)


@query(
    "cls_04_water_class",
    f"""WITH w AS (SELECT p_partkey, {NAME_SQL} AS n, {KIND_SQL} AS k, p_retailprice * 11 AS area FROM part),
        c AS (SELECT p_partkey, CASE WHEN k = 'woda morska' AND contains(n, 'Zatoka') THEN 'zatoka' WHEN k = 'woda morska' THEN 'morze' {NAMED_SQL}
          WHEN k = 'woda płynąca' THEN 'rzeka' WHEN k = 'woda stojąca' AND area >= 10000 THEN 'jezioro' ELSE 'staw' END AS water_type FROM w)
        SELECT p_partkey, water_type, {case({k: v[0] for k, v in C.WATER_TYPES.items()}, 'water_type').replace("THEN '", "THEN ").replace("' WHEN", " WHEN").replace("' END", " END")} AS priority,
          CASE water_type {" ".join(f"WHEN '{k}' THEN {v[1]}e0" for k, v in C.WATER_TYPES.items())} END AS premium FROM c""".replace("CASE water_type WHEN", "CASE water_type WHEN"),
)
def water_class(t):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in WATER_BODIES]), (k % 12 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(n) for n in WATER_KINDS]), (k % 5 + 1).cast("int"))
    w = t.raw("part").select("p_partkey", L.water_class(name, kind, F.col("p_retailprice") * 11).alias("water_type"))
    return w.select("p_partkey", "water_type", L.water_priority(F.col("water_type")).alias("priority"), L.water_premium(F.col("water_type")).alias("premium"))


@query("cls_05_water_flags", "SELECT id_dzialki, " + ", ".join(f"{C.WATER_DISTANCE_COLUMNS[w]} <= {v[2]} AS near_{w}" for w, v in C.WATER_TYPES.items()) + " FROM parcels")
def water_flags(t):
    """The bay has no distance of its own and uses the sea's."""
    return t("parcels").select("id_dzialki", *[(F.col(C.WATER_DISTANCE_COLUMNS[w]) <= v[2]).alias(f"near_{w}") for w, v in C.WATER_TYPES.items()])


@query("cls_06_near_counts", "SELECT gmina, " + ", ".join(f"count(*) FILTER ({c} <= {m}) AS {r.lower()}" for r, (c, m) in C.SINGLE_NEAR_THRESHOLDS.items()) + " FROM parcels GROUP BY gmina")
def near_counts(t):
    return t("parcels").groupBy("gmina").agg(*[F.count_if(F.col(c) <= m).alias(r.lower()) for r, (c, m) in C.SINGLE_NEAR_THRESHOLDS.items()])


@query("cls_07_buildable_type", f"SELECT id_dzialki, coalesce({case(C.BUILDABLE_TYPES, 'pog_symbol')}, 'brak') AS kind FROM parcels")
def buildable_type(t):
    return t("parcels").select("id_dzialki", L.buildable_type(F.col("pog_symbol")).alias("kind"))


@query(
    "cls_08_ownership",
    f"""WITH g AS (SELECT id_dzialki, CASE WHEN grupa_rej = '' THEN NULL WHEN regexp_matches(trim(grupa_rej), '^[0-9]') THEN string_split(string_split(trim(grupa_rej), ' ')[1], '-')[1] ELSE trim(grupa_rej) END AS code FROM parcels)
        SELECT id_dzialki, code, {case(C.OWNER_GROUP_NAMES, 'code')} AS name, {case(C.OWNERSHIP_TYPES, 'code')} AS kind FROM g""",
)
def ownership(t):
    g = t("parcels").select("id_dzialki", L.owner_group_code(F.col("grupa_rej")).alias("code"))
    return g.select("id_dzialki", "code", L.lookup(C.OWNER_GROUP_NAMES, F.col("code")).alias("name"), L.ownership_type(F.col("code")).alias("kind"))


def _tag(values, key="s_suppkey"):
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END)"


def _tags(values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("s_suppkey") % len(values) + 1).cast("int"))


AMENITY = ["school", "kindergarten", "language_school", "music_school", "college", None]
TRAIN, RAIL, TRAM, BUS, PT = ["yes", None, None], ["station", None, "tram_stop", "halt", None], [None, "yes", None, None], ["yes", None], ["station", "platform", "platform"]


@query(
    "cls_09_poi_types",
    f"""WITH a AS (SELECT s_suppkey, {_tag(AMENITY)} AS am, {_tag(TRAIN)} AS train, {_tag(RAIL)} AS rail, {_tag(TRAM)} AS tram, {_tag(BUS)} AS bus, {_tag(PT)} AS pt FROM supplier),
        m AS (SELECT *, CASE WHEN train='yes' OR rail IN ('station','halt') THEN 'train' WHEN tram='yes' THEN 'tram' WHEN bus='yes' THEN 'bus' WHEN rail='tram_stop' THEN 'tram' ELSE 'bus' END AS mode FROM a)
        SELECT s_suppkey, CASE WHEN am='kindergarten' THEN 'kindergarten' ELSE 'school' END AS type, CASE WHEN am NOT IN ('school','kindergarten') THEN am END AS subtype, mode,
        CASE WHEN pt='station' THEN 'train_station' WHEN mode='tram' THEN 'tram_stop' ELSE 'bus_stop' END AS stop_type FROM m""",
)
def poi_types(t):
    kind, subtype = L.education_type(_tags(AMENITY))
    mode = L.transport_mode(_tags(TRAIN), _tags(RAIL), _tags(TRAM), _tags(BUS))
    return t.raw("supplier").select("s_suppkey", kind.alias("type"), subtype.alias("subtype"), mode.alias("mode"), L.transport_type(_tags(PT), mode).alias("stop_type"))


@query(
    "cls_10_poi_schema",
    """SELECT 'osm' AS source, concat('n', s_suppkey) AS source_id, c AS category, CASE c WHEN 'health' THEN 'pharmacy' WHEN 'shop' THEN 'bakery' ELSE 'cafe' END AS type, CASE WHEN c = 'gastro' THEN 'pizza' END AS subtype, s_name AS name, CAST(NULL AS VARCHAR) AS network
       FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'health' WHEN 1 THEN 'shop' ELSE 'gastro' END AS c FROM supplier)""",
)
def poi_schema(t):
    from hectara.sources.poi import single_source

    k = F.col("s_suppkey")
    tagged = t.raw("supplier").select(
        F.concat(F.lit("n"), k.cast("string")).alias("osm_id"), F.col("s_name").alias("name"), (k % 3).alias("g"),
        F.when(k % 3 == 0, "pharmacy").when(k % 3 == 2, "cafe").alias("amenity"), F.when(k % 3 == 1, "bakery").alias("shop"), F.when(k % 3 == 2, "pizza").alias("cuisine"),
    )
    parts = [single_source(tagged.filter(F.col("g") == i), c) for i, c in enumerate(("health", "shop", "gastro"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("source", "source_id", "category", "type", "subtype", "name", "network")


@query(
    "cls_11_building_function",
    f"SELECT building_id, coalesce({case(C.BUILDING_FUNCTIONS, 'funkcja')}, funkcja) AS fn, coalesce(funkcja = 'budynki mieszkalne', false) AS residential, kategoria = 'w budowie' AS unfinished FROM buildings",
)
def building_function(t):
    f = F.col("funkcja")
    return t("buildings").select("building_id", L.building_function(f).alias("fn"), F.coalesce(f == "budynki mieszkalne", F.lit(False)).alias("residential"), (F.col("kategoria") == "w budowie").alias("unfinished"))


CHARACTER = "CASE WHEN coverage > 0.6e0 OR n > 200 THEN 'urban' WHEN coverage > 0.35e0 OR n > 80 THEN 'suburban' WHEN coverage > 0.15e0 OR n > 20 THEN 'transitional' ELSE 'peripheral' END"
BASE = f"""WITH {NEAREST}, b AS (SELECT id_dzialki, building_coverage_pct / 1e2 AS coverage, coalesce(count_buildings_500m, 0) AS n, coalesce(quietness_score, 50) AS q, coalesce(nature_score, 50) AS na, stop, shop, school FROM parcels LEFT JOIN n ON id_dzialki = n.src)"""


@query("cls_12_character", BASE.replace("AS n,", "AS nb,") .replace("n.src", "n.src") + " SELECT id_dzialki, " + CHARACTER.replace("n >", "nb >") + " AS kind FROM b")
def character(t):
    return t("parcels").select("id_dzialki", L.character(F.col("building_coverage_pct") / 100, F.col("count_buildings_500m")).alias("kind"))


STRONG = "list_filter([CASE WHEN q > 80 THEN 'Bardzo cicha okolica' END, CASE WHEN na > 70 THEN 'Blisko natury (las, woda)' END, CASE WHEN school < 1000 THEN 'Szkoła w pobliżu' END, CASE WHEN stop < 500 THEN 'Dobra komunikacja publiczna' END, CASE WHEN shop < 500 THEN 'Sklepy na miejscu' END], lambda x: x IS NOT NULL)"
WEAK = "list_filter([CASE WHEN q < 40 THEN 'Głośna okolica' END, CASE WHEN na < 30 THEN 'Brak terenów zielonych w okolicy' END, CASE WHEN school IS NULL OR school > 2000 THEN 'Daleko do szkoły' END, CASE WHEN stop IS NULL OR stop > 1000 THEN 'Słaba komunikacja publiczna' END, CASE WHEN shop IS NULL OR shop > 1500 THEN 'Brak sklepów w okolicy' END], lambda x: x IS NOT NULL)"
IDEAL = "list_filter([CASE kind WHEN 'peripheral' THEN 'Miłośnicy ciszy i spokoju' WHEN 'suburban' THEN 'Rodziny z dziećmi' END, CASE WHEN list_contains(strong, 'Szkoła w pobliżu') THEN 'Rodziny z dziećmi w wieku szkolnym' END, CASE WHEN list_contains(strong, 'Dobra komunikacja publiczna') THEN 'Osoby dojeżdżające do pracy' END, CASE WHEN list_contains(strong, 'Bardzo cicha okolica') THEN 'Osoby pracujące zdalnie' END], lambda x: x IS NOT NULL)"


@query(
    "cls_13_strengths",
    BASE.replace("AS n,", "AS nb,") + f", s AS (SELECT id_dzialki, {CHARACTER.replace('n >', 'nb >')} AS kind, {STRONG} AS strong, {WEAK} AS weak FROM b) SELECT id_dzialki, array_to_string(strong, '|') AS strengths, array_to_string(weak, '|') AS weaknesses, coalesce(nullif(array_to_string({IDEAL}, '|'), ''), 'Wszyscy szukający działki w tej okolicy') AS ideal_for FROM s",
)
def strengths(t):
    j = t("parcels").join(nearest_edges(t), "id_dzialki", "left")
    args = [F.col(c) for c in ("quietness_score", "nature_score", "school", "stop", "shop")]
    s = j.select("id_dzialki", L.character(F.col("building_coverage_pct") / 100, F.col("count_buildings_500m")).alias("kind"), L.strengths(*args).alias("strong"), L.weaknesses(*args).alias("weak"))
    return s.select("id_dzialki", F.array_join("strong", "|").alias("strengths"), F.array_join("weak", "|").alias("weaknesses"), F.array_join(L.ideal_for(F.col("kind"), F.col("strong")), "|").alias("ideal_for"))


@query("cls_14_water_band", "SELECT id_dzialki, CASE WHEN dist_to_water < 200 THEN 'very_close' WHEN dist_to_water < 500 THEN 'close' WHEN dist_to_water < 1000 THEN 'moderate' WHEN dist_to_water >= 1000 THEN 'far' END AS band FROM parcels")
def water_band(t):
    return t("parcels").select("id_dzialki", L.water_band(F.col("dist_to_water")).alias("band"))


@query(
    "cls_15_funnel_stage",
    f"WITH u AS ({PER_USER}) SELECT user_id, CASE WHEN n % 11 = 0 THEN 'CONVERTED' WHEN n % 5 = 0 THEN 'NEGOTIATION' WHEN favs > 12 THEN 'EVALUATION' WHEN views > 12 THEN 'SEARCH' WHEN n % 2 = 0 THEN 'DISCOVERY' ELSE 'NEW' END AS stage FROM u",
)
def funnel_stage(t):
    n = F.col("n")
    return per_user(t).select("user_id", L.funnel_stage(n % 11 == 0, n % 5 == 0, F.greatest(F.col("favs") - 12, F.lit(0)), F.col("views") > 12, n % 2 == 0).alias("stage"))


@query("cls_16_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 5e1 AS s, CASE WHEN l_quantity / 5e1 > 0.9e0 THEN 'HIGH' WHEN l_quantity / 5e1 > 0.8e0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM lineitem")
def confidence(t):
    s = F.col("l_quantity") / 50
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s"), L.confidence_band(s).alias("confidence"))


@query(
    "cls_17_key_moments",
    f"""WITH u AS (SELECT user_id, count(*) AS n, string_agg(DISTINCT parcel_id, ',' ORDER BY parcel_id) FILTER (action='favorite') AS favs FROM feedback GROUP BY user_id),
        x AS (SELECT user_id, n, string_split(favs, ',')[1:3] AS f FROM u)
        SELECT user_id, array_to_string(list_filter([CASE WHEN n > 0 THEN format('Budżet: {{}}k zł', n * 7500 // 1000) END, CASE WHEN n % 2 = 0 THEN 'Preferowana lokalizacja: Oliwa' END, CASE WHEN n % 3 = 0 THEN 'Ma dzieci - ważne szkoły' END,
          CASE WHEN n > 65 THEN 'Priorytet: cisza' END, CASE WHEN n > 70 THEN 'Priorytet: bliskość natury' END, CASE WHEN len(f) > 0 THEN 'Polubione działki: ' || array_to_string(f, ', ') END, CASE WHEN n % 5 = 0 THEN 'Kontakt zostawiony' END], lambda x: x IS NOT NULL), '|') AS moments FROM x""",
)
def key_moments(t):
    n = F.col("n")
    liked = t("feedback").filter(F.col("action") == "favorite").select("user_id", "parcel_id").distinct()
    three = top_ranked(liked, [F.col("parcel_id")], 3, ["user_id"]).groupBy("user_id").agg(F.array_sort(F.collect_list("parcel_id")).alias("favs"))
    u = t("feedback").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(three, "user_id", "left")
    moments = L.key_moments(n * 7500, F.when(n % 2 == 0, "Oliwa"), n % 3 == 0, F.when(n > 65, 0.8).otherwise(0.5), F.when(n > 70, 0.8).otherwise(0.5), F.col("favs"), n % 5 == 0)
    return u.select("user_id", F.array_join(moments, "|").alias("moments"))
