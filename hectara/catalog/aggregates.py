"""AGG: aggregations."""
from pyspark.sql import functions as F

from hectara.catalog.geometry import FAULT_SQL, faulty_shapes
from hectara.catalog.key_joins import BRICK_PAIRS, brick_pairs, case
from hectara.catalog.registry import query
from hectara.catalog.spatial_joins import BOX
from hectara.functions import constants as C
from hectara.functions.texts import slug
from hectara.operators import relations as R
from hectara.operators import search as S
from hectara.operators import statistics as A
from hectara.operators.spatial import points_in_polygons


def pct(test):
    return f"avg(CASE WHEN {test} THEN 1e0 ELSE 0e0 END)*100"


@query(
    "agg_01_city_statistics",
    f"""SELECT gmina, count(*) AS parcels, round(avg(area_m2),4) AS avg_area, round({pct('has_pog')},4) AS pct_pog, count(DISTINCT dzielnica) AS districts,
        round(avg(quietness_score),4) AS avg_quietness, round(avg(nature_score),4) AS avg_nature, round({pct('is_residential_zone')},4) AS pct_buildable FROM parcels GROUP BY gmina""",
)
def city_statistics(t):
    return A.city_statistics(t("parcels"))


RESIDENT = "coalesce(len(list_intersect(string_split(profil_podstawowy, '|'), ['MN','MW'])) > 0, false)"


@query("agg_02_symbol_statistics", f"SELECT symbol, min(nazwa) AS nazwa, bool_or({RESIDENT}) AS is_residential, count(*) AS n FROM zones GROUP BY symbol")
def symbol_statistics(t):
    return A.symbol_statistics(t("zones"))


@query(
    "agg_03_district_counts",
    "SELECT d.district, count(p.id_dzialki) AS n FROM (SELECT DISTINCT district FROM prices UNION SELECT DISTINCT 'PUSTA ' || district FROM prices) d LEFT JOIN parcels p ON p.dzielnica = d.district GROUP BY 1",
)
def district_counts(t):
    names = t("prices").select("district").distinct()
    names = names.union(names.select(F.concat(F.lit("PUSTA "), "district")))
    return A.children_with_counts(names, "district", t("parcels"), "dzielnica")


@query("agg_04_administrative_tree", "SELECT wojewodztwo, gmina, dzielnica, count(*) AS n, grouping(wojewodztwo, gmina, dzielnica) AS level FROM parcels WHERE dzielnica IS NOT NULL GROUP BY ROLLUP (wojewodztwo, gmina, dzielnica)")
def administrative_tree(t):
    return A.administrative_tree(t("parcels"))


@query(
    "agg_04_tree_children",
    """WITH p AS (SELECT gmina, dzielnica, count(*) AS n FROM parcels WHERE dzielnica IS NOT NULL GROUP BY 1, 2)
       SELECT gmina, CAST(sum(n) AS BIGINT) AS n, string_agg(dzielnica || ':' || n, ',' ORDER BY dzielnica) AS children FROM p GROUP BY gmina""",
)
def tree_children(t):
    kids = F.array_join(F.transform("children", lambda c: F.concat(c["dzielnica"], F.lit(":"), c["n"].cast("string"))), ",")
    return A.tree_children(t("parcels")).withColumn("children", kids)


@query(
    "agg_05_entity_counts",
    "SELECT 'parcels' AS entity, count(*) AS n FROM parcels UNION ALL SELECT 'zones', count(*) FROM zones UNION ALL SELECT 'poi', count(*) FROM poi UNION ALL SELECT rel, count(*) FROM edges GROUP BY rel",
)
def entity_counts(t):
    by_rel = t("edges").groupBy(F.col("rel").alias("entity")).agg(A.count().alias("n"))
    return A.entity_counts({n: t(n) for n in ("parcels", "zones", "poi")}).unionByName(by_rel)


@query(
    "agg_06_data_summary",
    " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n FROM parcels GROUP BY {d}" for d in ("kategoria_ciszy", "kategoria_natury", "gestosc_zabudowy", "gmina"))
    + " UNION ALL SELECT 'total', 'all', count(*) FROM parcels UNION ALL SELECT 'total', 'with_pog', count(*) FROM parcels WHERE has_pog UNION ALL SELECT 'total', 'residential', count(*) FROM parcels WHERE is_residential_zone",
)
def data_summary(t):
    return A.data_summary(t("parcels"))


FUNCTION = "coalesce(" + case(C.BUILDING_FUNCTIONS, "funkcja") + ", funkcja)"


@query(
    "agg_07_building_aggregates",
    f"""WITH h AS (SELECT p.plot_id, b.*, {FUNCTION} AS fn FROM plots p JOIN buildings b ON b.x >= p.x0 AND b.x < p.x1 AND b.y >= p.y0 AND b.y < p.y1),
        m AS (SELECT plot_id, count(*) AS building_count, sum(bld_area) AS building_area_m2, max(kondygnacje) AS building_max_floors, bool_or(coalesce(funkcja = 'budynki mieszkalne', false)) AS has_residential,
              bool_or(coalesce(funkcja = 'budynki przemysłowe', false)) AS has_industrial, count(*) FILTER (kategoria = 'w budowie') AS under_construction FROM h GROUP BY plot_id),
        f AS (SELECT plot_id, fn, row_number() OVER (PARTITION BY plot_id ORDER BY count(*) DESC, fn) AS rn FROM h WHERE fn IS NOT NULL GROUP BY plot_id, fn),
        y AS (SELECT plot_id, typ, row_number() OVER (PARTITION BY plot_id ORDER BY count(*) DESC, typ) AS rn FROM h WHERE typ IS NOT NULL GROUP BY plot_id, typ)
        SELECT p.plot_id, coalesce(building_count, 0) AS building_count, coalesce(building_area_m2, 0) AS building_area_m2, building_max_floors, coalesce(has_residential, false) AS has_residential,
          coalesce(has_industrial, false) AS has_industrial, coalesce(under_construction, 0) AS under_construction, f.fn AS building_main_function, y.typ AS building_type,
          round(CASE WHEN building_area_m2 IS NULL THEN 0 ELSE least(building_area_m2 / 9600 * 100, 100) END, 4) AS building_coverage_pct, coalesce(building_count, 0) > 0 AS is_built
        FROM plots p LEFT JOIN m ON p.plot_id = m.plot_id LEFT JOIN f ON p.plot_id = f.plot_id AND f.rn = 1 LEFT JOIN y ON p.plot_id = y.plot_id AND y.rn = 1""",
)
def building_aggregates(t):
    hits = points_in_polygons(t("buildings").drop("building_id"), "x", "y", t("plots").select("plot_id", "rings", *BOX), BOX)
    return A.building_aggregates(hits, t("plots").select("plot_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area_m2"))).drop("area_m2")


@query(
    "agg_08_area_statistics",
    """WITH c AS (SELECT count(*) AS total, count(*) FILTER (has_pog) AS with_pog, count(*) FILTER (is_residential_zone) AS residential, count(*) FILTER (dist_to_main_road < 50) AS road_access, count(*) FILTER (is_built) AS built
         FROM parcels WHERE dzielnica = 'MACHINERY' OR dzielnica LIKE 'MACHINERY %')
       SELECT *, round_even(with_pog*100/total,1) AS pct_with_pog, round_even(residential*100/total,1) AS pct_residential, round_even(road_access*100/total,1) AS pct_road_access, round_even(built*100/total,1) AS pct_built FROM c""",
)
def area_statistics(t):
    return A.area_statistics(t("parcels"), None, "MACHINERY")


@query(
    "agg_08_area_distributions",
    "SELECT 'kategoria_ciszy' AS dim, kategoria_ciszy AS value, count(*) AS n FROM parcels WHERE gmina = 'NATION_4' GROUP BY 2 UNION ALL SELECT 'kategoria_natury', kategoria_natury, count(*) FROM parcels WHERE gmina = 'NATION_4' GROUP BY 2",
)
def area_distributions(t):
    return A.distributions(t("parcels").filter(F.col("gmina") == "NATION_4"), ["kategoria_ciszy", "kategoria_natury"])


@query(
    "agg_09_water_statistics",
    "SELECT gmina, count(*) AS total, "
    + ", ".join(f"count(*) FILTER ({c} <= {m}) AS {n}" for n, c, m in A.WATER_COUNTS)
    + ", "
    + ", ".join(f"count(*) FILTER (nearest_water_type = '{w}') AS nearest_{w}" for w in ("morze", "jezioro", "rzeka", "kanal", "staw"))
    + " FROM parcels GROUP BY gmina",
)
def water_statistics(t):
    return A.water_statistics(t("parcels"))


@query(
    "agg_10_top_districts",
    "SELECT dzielnica, gmina, count(*) AS n FROM parcels WHERE kategoria_ciszy IN ('bardzo_cicha','cicha') AND dzielnica IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, dzielnica, gmina LIMIT 10",
)
def top_districts(t):
    return A.top_districts(t("parcels"), "kategoria_ciszy", ["bardzo_cicha", "cicha"], 10)


@query(
    "agg_11_neighbourhood_context",
    """WITH o AS (SELECT p.id_dzialki, p.quietness_score AS own, count(n.id_dzialki) AS c, avg(n.area_m2) AS a, avg(n.quietness_score) AS q, count(*) FILTER (n.is_built) AS b, count(*) FILTER (n.has_residential) AS r
         FROM parcels p LEFT JOIN parcels n ON p.dzielnica = n.dzielnica AND n.id_dzialki <> p.id_dzialki GROUP BY 1, 2)
       SELECT id_dzialki, c AS parcel_count_in_district, round(coalesce(a, 0), 4) AS avg_area_m2, round(coalesce(q, own, 0), 4) AS avg_quietness,
         round(CASE WHEN c > 0 THEN b / c ELSE 0 END, 6) AS pct_built, round(CASE WHEN c > 0 THEN r / c ELSE 0 END, 6) AS pct_residential FROM o""",
)
def neighbourhood_context(t):
    return A.neighbourhood_context(t("parcels"))


@query("agg_12_value_lists", "SELECT DISTINCT 'gmina' AS kind, gmina AS value FROM parcels UNION SELECT DISTINCT 'powiat', powiat FROM parcels UNION SELECT DISTINCT 'miejscowosc', miejscowosc FROM parcels ORDER BY 1, 2")
def value_lists(t):
    return A.distributions(t("parcels"), ["gmina", "powiat", "miejscowosc"]).select(F.col("dim").alias("kind"), "value").orderBy("kind", "value")


@query("agg_13_match_counts", "SELECT count(*) AS n FROM parcels WHERE area_m2 >= 500 AND area_m2 <= 3000 AND is_residential_zone AND quietness_score >= 40")
def match_counts(t):
    df = t("parcels").filter((F.col("area_m2") >= 500) & (F.col("area_m2") <= 3000) & F.col("is_residential_zone") & (F.col("quietness_score") >= 40))
    return df.agg(A.count().alias("n"))


@query("agg_14_locations_with_total", "SELECT n_name AS gmina, count(p.id_dzialki) AS n, CAST(sum(count(p.id_dzialki)) OVER () AS BIGINT) AS total FROM nation LEFT JOIN parcels p ON n_name = p.gmina GROUP BY n_name")
def locations_with_total(t):
    per = A.children_with_counts(t.raw("nation").select(F.col("n_name").alias("gmina")), "gmina", t("parcels"), "gmina")
    return per.join(F.broadcast(per.agg(F.sum("n").alias("total"))))


def _in(cats, col):
    return f"contains('|' || {cats} || '|', '|' || {col} || '|')"


_CATS = [("quiet_cats", "kategoria_ciszy"), ("nature_cats", "kategoria_natury"), ("density_cats", "gestosc_zabudowy"), ("access_cats", "kategoria_dostepu")]
_DISTS = [("forest_m", "dist_to_forest"), ("water_m", "dist_to_water"), ("school_m", "dist_to_school"), ("shop_m", "dist_to_supermarket")]
_ORDER = [c for c, _ in _CATS] + ["area"] + [c for c, _ in _DISTS]
_NARROW = "(SELECT search_id, gmina, CASE WHEN search_id % 2 = 0 THEN min_area * 30 ELSE min_area END AS min_area, max_area, CASE WHEN search_id % 3 = 0 THEN 'brak' ELSE quiet_cats END AS quiet_cats, nature_cats, density_cats, access_cats, CASE WHEN search_id % 5 = 3 THEN 1 ELSE forest_m END AS forest_m, water_m, school_m, shop_m FROM searches)"


@query(
    "agg_15_diagnosis",
    f"""WITH s AS {_NARROW}, j AS (SELECT s.search_id, s.min_area, s.max_area, s.quiet_cats, s.nature_cats, s.density_cats, s.access_cats, s.forest_m, s.water_m, s.school_m, s.shop_m, p.* FROM s JOIN parcels p ON s.gmina IS NULL OR s.gmina = p.gmina),
        c AS (SELECT search_id, any_value(min_area) AS min_area, any_value(max_area) AS max_area, {", ".join(f"any_value({c}) AS {c}" for c, _ in _DISTS)}, count(*) AS total,
          {", ".join(f"CASE WHEN any_value({c}) IS NOT NULL THEN count(*) FILTER ({_in(c, k)}) END AS n_{c}" for c, k in _CATS)},
          CASE WHEN any_value(coalesce(min_area,0)) > 0 OR any_value(coalesce(max_area,0)) > 0 THEN count(*) FILTER (area_m2 >= coalesce(min_area,0) AND area_m2 <= coalesce(max_area,999999)) END AS n_area,
          {", ".join(f"CASE WHEN any_value({c}) > 0 THEN count(*) FILTER ({k} <= {c}) END AS n_{c}" for c, k in _DISTS)} FROM j GROUP BY search_id),
        b AS (SELECT *, coalesce({", ".join(f"CASE WHEN n_{c} = 0 THEN '{c}' END" for c in _ORDER)}, 'combination') AS blocking_filter FROM c),
        d AS ({" UNION ALL ".join(f"SELECT search_id, '{c}' AS f, {k} AS v, row_number() OVER (PARTITION BY search_id ORDER BY count(*) DESC, {k}) AS rn FROM j GROUP BY search_id, {k}" for c, k in _CATS)})
        SELECT b.search_id, total, {", ".join("n_" + c for c in _ORDER)}, blocking_filter, coalesce(d.v, CASE WHEN blocking_filter = 'area' THEN CAST(CAST(floor(coalesce(min_area,0)*0.5e0) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(coalesce(max_area,999999)*1.5e0) AS BIGINT) AS VARCHAR) END,
          {", ".join(f"CASE WHEN blocking_filter = '{c}' THEN CAST({c}*2 AS VARCHAR) END" for c, _ in _DISTS)}) AS relaxation
        FROM b LEFT JOIN d ON b.search_id = d.search_id AND d.f = blocking_filter AND d.rn = 1""",
)
def diagnosis(t):
    return A.diagnose(t("parcels"), S.split_lists(narrow_searches(t)))


def narrow_searches(t):
    """The derived searches, some made so strict that nothing can match."""
    k = F.col("search_id")
    return (
        t("searches").withColumn("min_area", F.when(k % 2 == 0, F.col("min_area") * 30).otherwise(F.col("min_area")))
        .withColumn("quiet_cats", F.when(k % 3 == 0, "brak").otherwise(F.col("quiet_cats")))
        .withColumn("forest_m", F.when(k % 5 == 3, 1).otherwise(F.col("forest_m")))
    )


@query(
    "agg_16_dominant_city",
    """SELECT dzielnica AS district, gmina AS city, n, coalesce(s, 0) AS second_n, coalesce(s <= 5, false) AS border_case FROM (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS s FROM
       (SELECT dzielnica, gmina, count(*) AS n FROM parcels WHERE dzielnica IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY dzielnica ORDER BY n DESC, gmina)) WHERE rn = 1""",
)
def dominant_city(t):
    return R.dominant_city(t("parcels"))


NUMERIC = ["area_m2", "shape_index", "quietness_score", "dist_to_forest"]


@query(
    "agg_17_numeric_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}),4) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5),4) AS median, count({c}) AS n FROM parcels" for c in NUMERIC),
)
def numeric_profile(t):
    return A.numeric_profile(t("parcels"), NUMERIC)


@query(
    "agg_18_area_bins",
    """WITH b AS (SELECT CASE WHEN area_m2 <= 0 THEN NULL WHEN area_m2 <= 500 THEN '(0,500]' WHEN area_m2 <= 1000 THEN '(500,1000]' WHEN area_m2 <= 1500 THEN '(1000,1500]' WHEN area_m2 <= 2000 THEN '(1500,2000]'
       WHEN area_m2 <= 5000 THEN '(2000,5000]' WHEN area_m2 <= 10000 THEN '(5000,10000]' WHEN area_m2 > 10000 THEN '(10000,inf]' END AS bin FROM parcels)
       SELECT bin, count(*) AS n, round(count(*)*100/sum(count(*)) OVER (), 4) AS pct FROM b WHERE bin IS NOT NULL GROUP BY bin""",
)
def area_bins(t):
    return A.area_bins(t("parcels"))


@query(
    "agg_19_medians",
    "SELECT gmina, round(quantile_cont(aspect_ratio, 0.5), 4) AS median_ratio, round(quantile_cont(CAST(dist_to_forest AS DOUBLE), 0.5), 4) AS median_forest FROM parcels GROUP BY gmina",
)
def medians(t):
    p = t("parcels").select("gmina", "aspect_ratio", "dist_to_forest")
    ratio, forest = A.exact_median(p, ["gmina"], "aspect_ratio", "a"), A.exact_median(p, ["gmina"], "dist_to_forest", "f")
    return p.select("gmina").distinct().join(ratio, "gmina", "left").join(forest, "gmina", "left").select("gmina", F.round("a", 4).alias("median_ratio"), F.round("f", 4).alias("median_forest"))


@query(
    "agg_20_degrees",
    f"""WITH e AS (SELECT id1 AS id FROM ({BRICK_PAIRS}) UNION ALL SELECT id2 FROM ({BRICK_PAIRS})), d AS (SELECT id, count(*) AS n FROM e GROUP BY id),
        x AS (SELECT plot_id, coalesce(n, 0) AS n FROM bricks LEFT JOIN d ON plot_id = id) SELECT min(n) AS min_degree, max(n) AS max_degree, round(avg(n), 6) AS avg_degree, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_degree FROM x""",
)
def degrees(t):
    return A.degree_statistics(t("bricks").select(F.col("plot_id").alias("id")), brick_pairs(t))


@query("agg_21_edge_distances", "SELECT rel, count(*) AS n, round(avg(distance_m),4) AS avg_m, min(distance_m) AS min_m, max(distance_m) AS max_m FROM edges GROUP BY rel")
def edge_distances(t):
    return A.edge_statistics(t("edges"))


FILLED = ["grupa_rej", "pog_symbol", "building_main_function", "nearest_water_type", "dist_to_pond"]


@query(
    "agg_22_fill_rates",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS distinct_values, round(count({c})*100/count(*), 4) AS pct FROM parcels HAVING count({c})*100/count(*) >= 10" for c in FILLED),
)
def fill_rates(t):
    return A.fill_rates(t("parcels"), FILLED)


REPORTED = ["shape_id", "gmina_no", "name"]


@query(
    "agg_23_quality_report",
    f"""WITH d AS (SELECT *, (x1-x0)*(y1-y0) AS v, CASE WHEN shape_id % 5 = 0 THEN NULL ELSE name END AS nm, {FAULT_SQL} AS fault FROM shapes),
       e AS (SELECT shape_id, fault, CASE shape_id % 12 WHEN 5 THEN x1+7 WHEN 6 THEN x1+4 WHEN 8 THEN x1+2 ELSE x1 END AS mx, CASE shape_id % 12 WHEN 1 THEN y1+2 WHEN 3 THEN y0 WHEN 5 THEN y1+7 ELSE y1 END AS my FROM d),
       r AS (SELECT count(*) AS rows, true AS crs_valid, count(*) FILTER (fault IS NULL) AS valid, count(*) FILTER (fault IS NOT NULL) AS invalid, 0 AS empty,
         min(v) AS min_v, max(v) AS max_v, round(avg(v),4) AS mean_v, round(quantile_cont(v,0.5),4) AS median_v, round(stddev_samp(v),4) AS std_v,
         count(*) - count(shape_id) AS null_shape_id, count(*) - count(gmina_no) AS null_gmina_no, count(*) - count(nm) AS null_name,
         round(1 - count(shape_id)/count(*),6) AS null_ratio_shape_id, round(1 - count(gmina_no)/count(*),6) AS null_ratio_gmina_no, round(1 - count(nm)/count(*),6) AS null_ratio_name,
         min(x0) AS minx, min(y0) AS miny, round(count(*) FILTER (fault IS NULL)/count(*), 6) AS valid_ratio,
         concat_ws('|', CASE WHEN count(DISTINCT gmina_no) = count(*) THEN 'gmina_no' END, CASE WHEN count(DISTINCT nm) = count(*) THEN 'name' END, CASE WHEN count(DISTINCT shape_id) = count(*) THEN 'shape_id' END) AS candidate_ids FROM d),
       h AS (SELECT string_agg(k || '=' || n, '|' ORDER BY k || '=' || n) AS types FROM (SELECT CASE WHEN shape_id % 12 IN (4, 5, 8, 9, 10, 11) THEN 'Polygon with holes' ELSE 'Polygon' END AS k, count(*) AS n FROM shapes GROUP BY 1)),
       b AS (SELECT max(mx) AS maxx, max(my) AS maxy FROM e)
       SELECT r.*, h.types, b.maxx, b.maxy, valid_ratio >= 0.99 AND contains('|' || candidate_ids || '|', '|shape_id|') AS passed FROM r, h, b""",
)
def quality_report(t):
    v = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    df = faulty_shapes(t).withColumn("v", v).withColumn("name", F.when(F.col("shape_id") % 5 != 0, F.col("name")))
    kind = F.when(F.size("rings") > 1, "Polygon with holes").otherwise("Polygon")
    return A.quality_report(df, "shape_id", "v", REPORTED, F.lit("EPSG:2180"), "EPSG:2180", kind)


@query("agg_24_source_summary", "SELECT category, count(*) AS total, count(*) FILTER (source='bdot10k') AS from_primary, count(*) FILTER (source='osm') AS from_secondary FROM poi GROUP BY category")
def source_summary(t):
    src = F.col("source")
    return t("poi").groupBy("category").agg(A.count().alias("total"), F.count_if(src == "bdot10k").alias("from_primary"), F.count_if(src == "osm").alias("from_secondary"))


@query("agg_25_profile_frequency", "SELECT profile, count(*) AS n FROM (SELECT unnest(string_split(profil_podstawowy, '|')) AS profile FROM zones) GROUP BY profile ORDER BY n DESC, profile LIMIT 10")
def profile_frequency(t):
    p = t("zones").select(F.explode(F.split("profil_podstawowy", "[|]")).alias("profile"))
    return p.groupBy("profile").agg(A.count().alias("n")).orderBy(F.col("n").desc(), "profile").limit(10)


@query(
    "agg_26_building_types",
    """SELECT building_type, replace(replace(lower(building_type),' ','_'),'-','_') AS id, count(*) AS n, building_type IN ('budynek jednorodzinny','dom-letniskowy') AS is_residential FROM parcels WHERE building_type IS NOT NULL GROUP BY building_type""",
)
def building_types(t):
    g = t("parcels").filter(F.col("building_type").isNotNull()).groupBy("building_type").agg(A.count().alias("n"))
    return g.select("building_type", slug(F.col("building_type")).alias("id"), "n", F.col("building_type").isin("budynek jednorodzinny", "dom-letniskowy").alias("is_residential"))


@query(
    "agg_27_private_districts",
    """WITH g AS (SELECT gmina, dzielnica, count(*) AS n FROM parcels WHERE typ_wlasnosci='prywatna' AND area_m2 BETWEEN 500 AND 3000 GROUP BY 1, 2)
       SELECT gmina, dzielnica, n, round(n*100/sum(n) OVER (), 4) AS pct FROM g ORDER BY n DESC, gmina, dzielnica NULLS FIRST LIMIT 15""",
)
def private_districts(t):
    g = t("parcels").filter((F.col("typ_wlasnosci") == "prywatna") & F.col("area_m2").between(500, 3000)).groupBy("gmina", "dzielnica").agg(A.count().alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("total")))
    out = g.join(total).select("gmina", "dzielnica", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("pct"))
    return out.orderBy(F.col("n").desc(), "gmina", "dzielnica").limit(15)


@query(
    "agg_28_price_rollup",
    """WITH s AS (SELECT city, segment, count(*) AS k FROM prices GROUP BY 1, 2), c AS (SELECT city, string_agg(segment || ':' || k, ',' ORDER BY segment) AS segments FROM s GROUP BY city)
       SELECT p.city, count(*) AS districts, min(price_min) AS price_min, max(price_max) AS price_max, CAST(sum((price_min + price_max) // 2) AS BIGINT) AS sum_avg, any_value(segments) AS segments FROM prices p JOIN c ON p.city = c.city GROUP BY p.city""",
)
def price_rollup(t):
    mid = F.expr("(price_min + price_max) div 2")
    seg = t("prices").groupBy("city", "segment").agg(A.count().alias("k"), F.min("price_min").alias("lo"), F.max("price_max").alias("hi"), F.sum(mid).alias("mids"))
    label = F.array_join(F.array_sort(F.collect_list(F.concat("segment", F.lit(":"), F.col("k").cast("string")))), ",")
    return seg.groupBy("city").agg(F.sum("k").alias("districts"), F.min("lo").alias("price_min"), F.max("hi").alias("price_max"), F.sum("mids").alias("sum_avg"), label.alias("segments"))


EXPECTED = {"kategoria_ciszy": 4, "kategoria_natury": 4, "size_category": 5, "typ_wlasnosci": 5}


@query(
    "agg_29_category_coverage",
    " UNION ALL ".join(f"SELECT '{d}' AS dim, count(DISTINCT {d}) AS n, {m} AS expected, CASE WHEN count(DISTINCT {d}) < {m} THEN 'MISSING' ELSE 'OK' END AS status FROM parcels" for d, m in EXPECTED.items()),
)
def category_coverage(t):
    n = A.distributions(t("parcels"), list(EXPECTED)).filter(F.col("value").isNotNull()).groupBy("dim").agg(A.count().alias("n"))
    expected = F.create_map([F.lit(v) for pair in EXPECTED.items() for v in pair])[F.col("dim")]
    return n.select("dim", "n", expected.alias("expected"), F.when(F.col("n") < expected, "MISSING").otherwise("OK").alias("status"))


@query(
    "agg_30_favourites_profile",
    """SELECT round(avg(area_m2),4) AS avg_area, round(avg(quietness_score),4) AS avg_quietness, round(avg(nature_score),4) AS avg_nature, string_agg(DISTINCT dzielnica, ',' ORDER BY dzielnica) AS districts
       FROM parcels WHERE id_dzialki IN (SELECT parcel_id FROM feedback WHERE action='favorite')""",
)
def favourites_profile(t):
    ids = t("feedback").filter(F.col("action") == "favorite").select(F.col("parcel_id").alias("id_dzialki"))
    mine = t("parcels").join(ids, "id_dzialki", "left_semi")
    return mine.agg(
        F.round(F.avg("area_m2"), 4).alias("avg_area"), F.round(F.avg("quietness_score"), 4).alias("avg_quietness"), F.round(F.avg("nature_score"), 4).alias("avg_nature"),
        F.array_join(F.array_sort(F.collect_set("dzielnica")), ",").alias("districts"),
    )


PATTERN_FEATURES = ["dzielnica", "size_category", "kategoria_ciszy", "kategoria_natury"]


@query(
    "agg_31_preference_patterns",
    """WITH f AS (SELECT DISTINCT user_id, p.* FROM feedback JOIN parcels p ON parcel_id = id_dzialki WHERE action='favorite'), t AS (SELECT user_id, count(*) AS total FROM f GROUP BY 1),
       c AS ("""
    + " UNION ALL ".join(f"SELECT user_id, '{c}' AS feature, {c} AS value, count(*) AS n FROM f WHERE {c} IS NOT NULL GROUP BY user_id, {c}" for c in PATTERN_FEATURES)
    + ") SELECT c.user_id, feature, value, n, total AS total_favorites, least(total / 5, 1) AS confidence FROM c JOIN t ON c.user_id = t.user_id WHERE n >= greatest(1, total // 2)",
)
def preference_patterns(t):
    fav = t("feedback").filter(F.col("action") == "favorite").select("user_id", F.col("parcel_id").alias("id_dzialki")).distinct()
    return A.preference_patterns(fav.join(t("parcels").select("id_dzialki", *PATTERN_FEATURES), "id_dzialki"), PATTERN_FEATURES)


@query(
    "agg_32_frequent_locations",
    """WITH s AS (SELECT o_custkey AS user_id, p.gmina, p.dzielnica FROM orders JOIN parcels p ON o_custkey = pk),
       l AS (SELECT user_id, unnest([gmina, dzielnica, CASE WHEN user_id % 2 = 0 THEN gmina END]) AS location FROM s) SELECT user_id, location, count(*) AS n FROM l WHERE location IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def frequent_locations(t):
    s = t.raw("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("pk")).join(t("parcels").select("pk", "gmina", "dzielnica"), "pk")
    keys = F.array("gmina", "dzielnica", F.when(F.col("user_id") % 2 == 0, F.col("gmina")))
    long = s.select("user_id", F.explode(keys).alias("location")).filter(F.col("location").isNotNull())
    return long.groupBy("user_id", "location").agg(A.count().alias("n")).filter(F.col("n") >= 2)


@query("agg_33_funnel_counts", "SELECT json_extract_string(state, '$.working.current_phase') AS phase, count(*) AS n FROM states GROUP BY 1")
def funnel_counts(t):
    return A.funnel_counts(t("states"))


@query(
    "agg_33_active_users",
    "SELECT count(DISTINCT user_id) AS active FROM states WHERE updated_at > (SELECT max(updated_at) FROM states) - INTERVAL 2400 HOUR",
)
def active_users(t):
    s = t("states").select("user_id", "updated_at")
    last = F.broadcast(s.agg(F.max("updated_at").alias("last")))
    recent = s.join(last).filter(F.col("updated_at") > F.col("last") - F.expr("INTERVAL 2400 HOURS"))
    return recent.agg(F.countDistinct("user_id").alias("active"))
