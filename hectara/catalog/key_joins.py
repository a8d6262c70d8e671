"""JOIN-16..JOIN-27 and SET: joins on keys, lookups and set operations."""
from pyspark.sql import functions as F

from hectara.catalog.registry import query
from hectara.functions import constants as C
from hectara.functions.texts import slug
from hectara.operators import relations as R
from hectara.operators.edges import adjacent_pairs
from hectara.session import cut_lineage, shuffled


def case(values: dict, key: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END)"


EDGE_SQL = " UNION ALL ".join(
    f"SELECT id_dzialki AS src, {dst} AS dst, '{rel}' AS rel FROM parcels WHERE {dst} IS NOT NULL"
    for rel, dst in {
        "HAS_OWNERSHIP": case(C.OWNERSHIP_IDS, "typ_wlasnosci"),
        "HAS_OWNER_GROUP": case(C.OWNER_GROUP_IDS, "grupa_rej_nazwa"),
        "HAS_BUILD_STATUS": "(CASE WHEN is_built THEN 'zabudowana' ELSE 'niezabudowana' END)",
        "HAS_BUILDING_FUNCTION": "(CASE WHEN is_built THEN " + case(C.FUNCTION_IDS, "building_main_function") + " END)",
        "HAS_BUILDING_TYPE": "(CASE WHEN is_built THEN replace(replace(lower(building_type), ' ', '_'), '-', '_') END)",
        "HAS_SIZE": "size_category",
        "HAS_QUIETNESS": "kategoria_ciszy",
        "HAS_NATURE": "kategoria_natury",
        "HAS_ACCESS": "kategoria_dostepu",
        "HAS_DENSITY": "gestosc_zabudowy",
        "NEAREST_WATER_TYPE": "nearest_water_type",
    }.items()
)
ZONE_EDGE = "SELECT p.id_dzialki AS src, z.zone_id AS dst FROM parcels p JOIN zones z ON p.pog_oznaczenie = z.oznaczenie AND lower(p.gmina) = lower(z.gmina)"
PROFILES = """SELECT DISTINCT zone_id, profile, secondary FROM (SELECT zone_id, unnest(string_split(profil_podstawowy, '|')) AS profile, false AS secondary FROM zones
   UNION ALL SELECT zone_id, unnest(string_split(profil_dodatkowy, '|')), true FROM zones)"""
DOMINANT = """SELECT dzielnica AS district, gmina AS city, n, coalesce(s, 0) AS second_n, coalesce(s <= 5, false) AS border_case FROM (
   SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS s FROM (SELECT dzielnica, gmina, count(*) AS n FROM parcels WHERE dzielnica IS NOT NULL GROUP BY 1, 2)
   WINDOW w AS (PARTITION BY dzielnica ORDER BY n DESC, gmina)) WHERE rn = 1"""


@query("join_16_category_edges", EDGE_SQL)
def category_edges(t):
    return R.category_edges(t("parcels"))


@query("join_17_zone_edges", f"SELECT *, 'HAS_POG' AS rel FROM ({ZONE_EDGE})")
def zone_edges(t):
    return R.zone_edges(t("parcels"), t("zones"))


@query("join_18_hierarchy", f"SELECT id_dzialki AS src, dzielnica AS dst, 'LOCATED_IN' AS rel FROM parcels WHERE dzielnica IS NOT NULL UNION ALL SELECT district, city, 'BELONGS_TO' FROM ({DOMINANT})")
def hierarchy(t):
    return R.hierarchy_edges(t("parcels"))


@query("join_19_profile_edges", PROFILES)
def profile_edges(t):
    return R.profile_edges(t("zones"))


@query(
    "join_20_zoning_card",
    f"""WITH e AS ({ZONE_EDGE}), q AS (SELECT zone_id, string_agg(DISTINCT profile, '|' ORDER BY profile) AS profiles FROM ({PROFILES}) GROUP BY zone_id)
        SELECT p.id_dzialki, e.dst AS zone_id, z.symbol, z.nazwa, q.profiles FROM parcels p LEFT JOIN e ON p.id_dzialki = e.src LEFT JOIN zones z ON e.dst = z.zone_id LEFT JOIN q ON q.zone_id = e.dst""",
)
def zoning_card(t):
    return R.zoning_card(t("parcels"), t("zones")).withColumn("profiles", F.array_join("profiles", "|"))


@query(
    "join_21_price_lookup",
    """SELECT id_dzialki, coalesce(d.price_min, c.price_min) AS price_min, coalesce(d.price_max, c.price_max) AS price_max, coalesce(d.segment, c.segment) AS segment,
       CASE WHEN d.city IS NOT NULL THEN 'HIGH' WHEN c.city IS NOT NULL THEN 'LOW' END AS confidence,
       CAST(area_m2 AS BIGINT) * coalesce(d.price_min, c.price_min) AS value_min, CAST(area_m2 AS BIGINT) * coalesce(d.price_max, c.price_max) AS value_max
       FROM parcels p LEFT JOIN prices d ON lower(p.gmina) = lower(d.city) AND lower(p.dzielnica) = lower(d.district) LEFT JOIN city_prices c ON lower(p.gmina) = lower(c.city)""",
)
def price_lookup(t):
    rows = R.price_lookup(t("parcels").select("id_dzialki", "gmina", "dzielnica", "area_m2"), "gmina", "dzielnica", t("prices"), t("city_prices"))
    area = F.col("area_m2").cast("bigint")
    return rows.select("id_dzialki", "p.price_min", "p.price_max", "p.segment", "confidence", (area * F.col("p.price_min")).alias("value_min"), (area * F.col("p.price_max")).alias("value_max"))


@query(
    "join_22_market_lookup",
    """WITH n AS (SELECT DISTINCT dzielnica AS location FROM parcels WHERE dzielnica IS NOT NULL UNION SELECT DISTINCT substr(dzielnica, 2, 4) FROM parcels WHERE dzielnica IS NOT NULL),
       x AS (SELECT n.location, p.*, row_number() OVER (PARTITION BY n.location ORDER BY CASE p.city WHEN 'NATION_1' THEN 1 WHEN 'NATION_0' THEN 2 ELSE 3 END) AS rn FROM n JOIN prices p ON p.district = n.location AND p.city IN ('NATION_1','NATION_0','NATION_2')),
       f AS (SELECT n.location, p.*, row_number() OVER (PARTITION BY n.location ORDER BY p.city, p.district) AS rn FROM n JOIN prices p ON contains(lower(p.district), lower(n.location)))
       SELECT n.location, coalesce(x.city || ', ' || x.district, f.city || ', ' || f.district, '') AS matched, coalesce(x.price_min, f.price_min) AS price_min, coalesce(x.price_max, f.price_max) AS price_max
       FROM n LEFT JOIN x ON n.location = x.location AND x.rn = 1 LEFT JOIN f ON n.location = f.location AND f.rn = 1""",
)
def market_lookup(t):
    d = t("parcels").filter(F.col("dzielnica").isNotNull())
    names = d.select(F.col("dzielnica").alias("location")).union(d.select(F.substring("dzielnica", 2, 4))).distinct()
    return R.market_lookup(names, "location", t("prices"), ["NATION_1", "NATION_0", "NATION_2"])


@query(
    "join_23_enrich",
    """WITH r AS (SELECT id_dzialki, CASE WHEN pk % 2 = 0 THEN gmina END AS gmina, CASE WHEN pk % 3 = 0 THEN -1 END AS area_m2 FROM parcels WHERE quietness_score >= 50)
       SELECT r.id_dzialki, coalesce(r.gmina, p.gmina) AS gmina, coalesce(r.area_m2, p.area_m2) AS area_m2 FROM r JOIN parcels p ON r.id_dzialki = p.id_dzialki""",
)
def enrich(t):
    p = t("parcels")
    ranked = p.filter(F.col("quietness_score") >= 50).select("id_dzialki", F.when(F.col("pk") % 2 == 0, F.col("gmina")).alias("gmina"), F.when(F.col("pk") % 3 == 0, F.lit(-1)).alias("area_m2"))
    return R.enrich(ranked, p, "id_dzialki", ["gmina", "area_m2"])


BRICK_PAIRS = """SELECT p.plot_id AS id1, q.plot_id AS id2, greatest(least(p.x1,q.x1)-greatest(p.x0,q.x0), least(p.y1,q.y1)-greatest(p.y0,q.y0)) AS border
   FROM bricks p JOIN bricks q ON p.plot_id < q.plot_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1
   WHERE greatest(least(p.x1,q.x1)-greatest(p.x0,q.x0), least(p.y1,q.y1)-greatest(p.y0,q.y0)) > 0.1"""
BRICK_STEPS = f"(SELECT id1 AS id, id2 AS neighbor, border FROM ({BRICK_PAIRS}) UNION ALL SELECT id2, id1, border FROM ({BRICK_PAIRS}))"


def brick_pairs(t):
    return adjacent_pairs(t("bricks"), "plot_id")


@query(
    "join_24_neighbours",
    f"""WITH s AS {BRICK_STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY border DESC, neighbor) AS rank, sum(border) OVER (PARTITION BY id) AS total FROM s)
        SELECT id, neighbor, rank, round(border, 2) AS shared_border_m, round(total, 2) AS total_border_m FROM r WHERE rank <= 4""",
)
def neighbours(t):
    pairs = cut_lineage(brick_pairs(t))
    return R.neighbours(pairs, 4).join(shuffled(R.border_totals(pairs).drop("neighbours")), "id").select("id", "neighbor", "rank", "shared_border_m", "total_border_m")


@query(
    "join_25_paths",
    f"""WITH s AS {BRICK_STEPS}, w2 AS (SELECT a.id AS st, a.neighbor AS prev, b.neighbor AS cur FROM s a JOIN s b ON a.neighbor = b.id AND b.neighbor <> a.id),
        w3 AS (SELECT w2.st, b.neighbor AS cur FROM w2 JOIN s b ON w2.cur = b.id AND b.neighbor <> w2.prev),
        al AS (SELECT id AS st, neighbor AS cur, 1 AS hops FROM s UNION ALL SELECT st, cur, 2 FROM w2 UNION ALL SELECT st, cur, 3 FROM w3)
        SELECT st AS id1, cur AS id2, hops, count(*) AS paths FROM al JOIN bricks a ON st = a.plot_id JOIN bricks b ON cur = b.plot_id WHERE a.district = b.district GROUP BY 1, 2, 3""",
)
def paths(t):
    return R.same_district_paths(brick_pairs(t), t("bricks").select("plot_id", "district"))


def _slug(e):
    return f"replace(replace(lower({e}), ' ', '_'), '-', '_')"


@query(
    "join_26_location_dictionary",
    f"""WITH n AS (SELECT {_slug('district')} AS id, district AS canonical_name, 'egib' AS source, 'district' AS type, district AS maps_to_district, city AS maps_to_gmina, 1 AS pr FROM ({DOMINANT})
          UNION ALL SELECT DISTINCT {_slug('gmina')}, gmina, 'egib', 'city', NULL, gmina, 2 FROM parcels
          UNION ALL SELECT {_slug('district')}, district, 'price_data', 'district', NULL, city, 3 FROM prices
          UNION ALL SELECT * FROM (VALUES """
    + ", ".join(f"('{i}', '{n}', 'alias', '{'area' if g is None else 'district'}', {'NULL' if to is None else repr(to)}, {'NULL' if g is None else repr(g)}, 4)" for i, (n, to, g, _) in C.LOCATION_ALIASES.items())
    + """)), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr, maps_to_gmina NULLS FIRST, canonical_name) AS rn FROM n),
        s AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{i}', '{'|'.join(search)}')" for i, (_, _, _, search) in C.LOCATION_ALIASES.items())
    + """) v(id, search_in))
        SELECT f.id, f.canonical_name, f.source, f.type, f.maps_to_district, f.maps_to_gmina, coalesce(s.search_in, '') AS search_in, p.price_min, p.price_max, p.segment FROM f LEFT JOIN s ON f.id = s.id
        LEFT JOIN prices p ON p.city = f.maps_to_gmina AND p.district = f.canonical_name WHERE rn = 1""",
)
def location_dictionary(t):
    return R.location_dictionary(t.spark, t("parcels"), t("prices")).withColumn("search_in", F.array_join("search_in", "|"))


@query(
    "join_27_price_segment",
    "WITH s AS (SELECT district, arg_min(segment, city) AS seg FROM prices GROUP BY district) SELECT id_dzialki, dzielnica, coalesce(seg, 'UNKNOWN') AS price_segment FROM parcels LEFT JOIN s ON dzielnica = district",
)
def price_segment(t):
    return R.with_price_segment(t("parcels").select("id_dzialki", "dzielnica"), t("prices"))


@query(
    "set_01_union_sources",
    "SELECT 'poi' AS src, poi_id AS id, x, y, name FROM poi UNION ALL SELECT 'building', building_id, x, y, NULL FROM buildings",
)
def union_sources(t):
    a = t("poi").select(F.lit("poi").alias("src"), F.col("poi_id").alias("id"), "x", "y", "name")
    b = t("buildings").select(F.lit("building").alias("src"), F.col("building_id").alias("id"), "x", "y")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_02_unordered_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def unordered_pairs(t):
    return t.raw("lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query(
    "set_03_residential_profile",
    "SELECT zone_id, coalesce(len(list_intersect(string_split(profil_podstawowy, '|'), ['MN','MW'])) > 0, false) AS is_residential FROM zones",
)
def residential_profile(t):
    hit = F.arrays_overlap(F.split("profil_podstawowy", "[|]"), F.array(*[F.lit(p) for p in C.RESIDENTIAL_PROFILES]))
    return t("zones").select("zone_id", F.coalesce(hit, F.lit(False)).alias("is_residential"))


@query(
    "set_04_vocabulary",
    f"SELECT DISTINCT unnest([dzielnica, lower(dzielnica), {_slug('dzielnica')}, gmina]) AS word FROM parcels WHERE dzielnica IS NOT NULL",
)
def vocabulary(t):
    names = t("parcels").filter(F.col("dzielnica").isNotNull()).select("dzielnica", "gmina").distinct()
    return names.select(F.explode(F.array_union(F.array("dzielnica", F.lower("dzielnica")), F.array(slug(F.col("dzielnica")), "gmina"))).alias("word")).distinct()
