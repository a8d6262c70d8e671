"""FLT and TOP-01: searches, filters and predicates."""
from pyspark.sql import functions as F

from hectara.catalog.registry import query
from hectara.operators import search as S
from hectara.operators.relations import category_edges

CLEAN = "(aspect_ratio IS NULL OR aspect_ratio <= 6) AND (shape_index IS NULL OR shape_index >= 0.15e0) AND (pog_symbol IS NULL OR pog_symbol NOT IN ('SK','SI'))"


@query(
    "flt_01_criteria_search",
    """SELECT id_dzialki, gmina, area_m2, nature_score FROM parcels WHERE area_m2 >= 400 AND area_m2 <= 9000 AND has_pog AND quietness_score >= 20 AND accessibility_score >= 10
       ORDER BY nature_score DESC NULLS LAST, id_dzialki LIMIT 80""",
)
def criteria_search(t):
    df = S.search_by_criteria(t("parcels"), min_area=400, max_area=9000, has_pog=True, min_quietness=20, min_nature=0, min_accessibility=10, order_by="nature_score", limit=80)
    return df.select("id_dzialki", "gmina", "area_m2", "nature_score")


@query("flt_02_district_match", "SELECT gmina, count(*) AS n FROM parcels WHERE dzielnica = 'MACHINERY' OR dzielnica LIKE 'MACHINERY %' GROUP BY gmina")
def district_match(t):
    return t("parcels").filter(S.in_district(F.col("dzielnica"), "MACHINERY")).groupBy("gmina").agg(F.count(F.lit(1)).alias("n"))


@query("flt_03_shape_quality", f"SELECT id_dzialki, aspect_ratio, shape_index, pog_symbol FROM parcels WHERE {CLEAN}")
def shape_quality(t):
    return t("parcels").filter(S.clean_shape()).select("id_dzialki", "aspect_ratio", "shape_index", "pog_symbol")


@query("flt_04_relation_exists", "SELECT gmina, count(*) AS n FROM parcels WHERE kategoria_ciszy IN ('cicha','bardzo_cicha') AND typ_wlasnosci = 'prywatna' AND size_category = 'duza' GROUP BY gmina")
def relation_exists(t):
    edges = category_edges(t("parcels"))
    df = t("parcels").select("id_dzialki", "gmina")
    for rel, values in (("HAS_QUIETNESS", ["cicha", "bardzo_cicha"]), ("HAS_OWNERSHIP", ["prywatna"]), ("HAS_SIZE", ["duza"])):
        hit = edges.filter((F.col("rel") == rel) & F.col("dst").isin(values)).select(F.col("src").alias("id_dzialki"))
        df = df.join(hit, "id_dzialki", "left_semi")
    return df.groupBy("gmina").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_05_hard_filters",
    f"""SELECT id_dzialki FROM parcels WHERE typ_wlasnosci = 'prywatna' AND NOT is_built AND is_residential_zone AND pog_symbol IN ('SJ','SN') AND {CLEAN}""",
)
def hard_filters(t):
    c = S.Criteria(ownership_type="prywatna", build_status="niezabudowana", pog_residential=True, has_pog=True, symbols=["SJ", "SN"])
    return t("parcels").filter(S.hard_filter(c.columns())).select("id_dzialki")


@query(
    "flt_06_road_access",
    "SELECT id_dzialki, dist_to_main_road < 50 AS has_road_access FROM parcels WHERE dist_to_main_road IS NOT NULL",
)
def road_access(t):
    return t("parcels").filter(F.col("dist_to_main_road").isNotNull()).select("id_dzialki", (F.col("dist_to_main_road") < 50).alias("has_road_access"))


@query("flt_07_rows_for_ids", "SELECT id_dzialki, gmina, area_m2 FROM parcels WHERE id_dzialki IN (SELECT parcel_id FROM feedback WHERE action = 'favorite')")
def rows_for_ids(t):
    ids = t("feedback").filter(F.col("action") == "favorite").select(F.col("parcel_id").alias("id_dzialki"))
    return t("parcels").select("id_dzialki", "gmina", "area_m2").join(ids, "id_dzialki", "left_semi")


@query("flt_08_exclude_shown", "SELECT id_dzialki, gmina FROM parcels WHERE id_dzialki NOT IN (SELECT parcel_id FROM feedback WHERE action = 'view')")
def exclude_shown(t):
    shown = t("feedback").filter(F.col("action") == "view").select(F.col("parcel_id").alias("id_dzialki")).distinct()
    return t("parcels").select("id_dzialki", "gmina").join(shown, "id_dzialki", "left_anti")


@query(
    "flt_09_post_filter",
    """SELECT id_dzialki FROM parcels WHERE (area_m2 IS NULL OR (area_m2 >= 700 AND area_m2 <= 4000)) AND NOT coalesce(aspect_ratio > 6, false) AND NOT coalesce(shape_index < 0.15e0, false)""",
)
def post_filter(t):
    from hectara.operators.ranking import enforce_limits

    return enforce_limits(t("parcels"), 700, 4000).select("id_dzialki")


@query(
    "flt_10_by_water_type",
    "SELECT id_dzialki, dist_to_lake AS water_distance FROM parcels WHERE dist_to_lake <= 2500 AND area_m2 BETWEEN 300 AND 9000 AND NOT is_built ORDER BY dist_to_lake, id_dzialki LIMIT 60",
)
def by_water_type(t):
    return S.by_water(t("parcels"), "jezioro", 2500, 60, (300, 9000), built=False).select("id_dzialki", "water_distance")


@query("flt_11_by_symbol", "SELECT id_dzialki, quietness_score FROM parcels WHERE pog_symbol = 'SJ' AND gmina = 'NATION_3' ORDER BY quietness_score DESC NULLS LAST, id_dzialki LIMIT 20")
def by_symbol(t):
    df = t("parcels").filter((F.col("pog_symbol") == "SJ") & (F.col("gmina") == "NATION_3"))
    return df.orderBy(F.col("quietness_score").desc_nulls_last(), "id_dzialki").limit(20).select("id_dzialki", "quietness_score")


@query("flt_12_buildable", "SELECT id_dzialki, area_m2 FROM parcels WHERE is_residential_zone AND area_m2 BETWEEN 600 AND 3000 ORDER BY quietness_score DESC NULLS LAST, id_dzialki LIMIT 100")
def buildable(t):
    return S.search_by_criteria(t("parcels"), min_area=600, max_area=3000, residential=True, limit=100).select("id_dzialki", "area_m2")


@query(
    "flt_13_tool_criteria",
    """SELECT id_dzialki, size_category, dzielnica FROM parcels WHERE typ_wlasnosci = 'prywatna' AND NOT is_built AND size_category IN ('pod_dom','duza') AND dzielnica LIKE '%CHINER%'
       ORDER BY quietness_score DESC NULLS LAST, id_dzialki LIMIT 30""",
)
def tool_criteria(t):
    df = t("parcels").filter(
        (F.col("typ_wlasnosci") == "prywatna") & ~F.col("is_built") & F.col("size_category").isin("pod_dom", "duza") & F.col("dzielnica").contains("CHINER")
    )
    return df.orderBy(F.col("quietness_score").desc_nulls_last(), "id_dzialki").limit(30).select("id_dzialki", "size_category", "dzielnica")


@query(
    "flt_14_near_poi",
    """SELECT e.edge_id, p.id_dzialki, o.name, e.distance_m FROM edges e JOIN parcels p ON e.src = p.id_dzialki JOIN poi o ON e.dst = o.poi_id
       WHERE e.rel = 'NEAR_SCHOOL' AND lower(o.name) LIKE '%000000007%' AND e.distance_m <= 900""",
)
def near_poi(t):
    from hectara.operators.relations import near_named_poi

    return near_named_poi(t("edges"), t("parcels"), t("poi"), "NEAR_SCHOOL", "000000007", 900)


@query(
    "flt_15_simple_wishes",
    f"""SELECT id_dzialki, round(
        round_even(0.25e0/0.7e0,3)*(CASE WHEN kategoria_ciszy IN ('bardzo_cicha','cicha') THEN coalesce(quietness_score,0)/1e2*0.5e0+0.5e0 ELSE coalesce(quietness_score,0)/1e2 END)
        + round_even(0.2e0/0.7e0,3)*(CASE WHEN kategoria_natury IN ('bardzo_zielona','zielona') THEN coalesce(nature_score,0)/1e2*0.5e0+0.5e0 ELSE coalesce(nature_score,0)/1e2 END)
        + round_even(0.2e0/0.7e0,3)*(CASE WHEN dist_to_forest IS NULL THEN 0 WHEN dist_to_forest <= 150 THEN 1 ELSE exp(-(dist_to_forest-150)/3e2) END)
        + round_even(0.05e0/0.7e0,3)*coalesce(accessibility_score,0)/1e2
        + 0.08e0*(0.5e0*CASE WHEN shape_index IS NULL THEN 0.3e0 WHEN shape_index>=0.7e0 THEN 1 WHEN shape_index>=0.4e0 THEN 0.6e0 ELSE 0.2e0 END + 0.5e0*CASE WHEN aspect_ratio IS NULL THEN 0.3e0 WHEN aspect_ratio<=2 THEN 1 WHEN aspect_ratio<=4 THEN 0.6e0 ELSE 0.2e0 END), 6) AS total_score
        FROM parcels WHERE {CLEAN}""",
)
def simple_wishes(t):
    c = S.Criteria.simple(quiet=True, green=True, near_forest=True).columns()
    return t("parcels").filter(S.hard_filter(c)).select("id_dzialki", F.round(S.total_score(c), 6).alias("total_score"))


@query(
    "flt_16_request_guards",
    """WITH r AS (SELECT event_id, 45 + value / 4 AS lat, 10 + value / 3 AS lon, value * 900 AS radius FROM events)
       SELECT event_id, CASE WHEN NOT lat BETWEEN 49 AND 55 THEN 'lat' WHEN NOT lon BETWEEN 14 AND 24 THEN 'lon' END AS error, round(least(radius, 20000), 4) AS radius_m, radius > 20000 AS radius_held,
         CASE WHEN value / 40 > 0.5 OR value / 30 > 0.7 THEN 'window too large' END AS window_error FROM r JOIN events USING (event_id)""",
)
def request_guards(t):
    v = F.col("value")
    lat, lon = v / 4 + 45, v / 3 + 10
    error, radius, held = S.request_guard(lat, lon, v * 900)
    return t.raw("events").select("event_id", error.alias("error"), F.round(radius, 4).alias("radius_m"), held.alias("radius_held"), S.window_guard(F.lit(0.0), F.lit(0.0), v / 40, v / 30).alias("window_error"))


@query(
    "flt_17_parcel_card",
    """SELECT id_dzialki AS id, gmina, dzielnica, area_m2, centroid_lat AS lat, centroid_lon AS lon, quietness_score, nature_score, accessibility_score, dist_to_school,
       dist_to_supermarket AS dist_to_shop, dist_to_doctors AS dist_to_hospital, dist_to_bus_stop, dist_to_forest, dist_to_water, pct_forest_500m, count_buildings_500m, has_pog AS has_mpzp,
       pog_symbol AS mpzp_symbol, is_residential_zone, kategoria_ciszy, kategoria_natury, nearest_water_type FROM parcels""",
)
def parcel_card(t):
    return S.parcel_card(t("parcels"))


NEAREST_SQL = """CASE WHEN nearest_water_type IS NOT NULL AND (CASE WHEN nearest_water_type = 'morze' THEN dist_to_sea ELSE dist_to_water END) <> 0 THEN concat(
  CASE nearest_water_type WHEN 'morze' THEN 'Morze' WHEN 'jezioro' THEN 'Jezioro' WHEN 'rzeka' THEN 'Rzeka' WHEN 'kanal' THEN 'Kanał' WHEN 'staw' THEN 'Staw' ELSE nearest_water_type END,
  ' (', CAST(floor(CASE WHEN nearest_water_type = 'morze' THEN dist_to_sea ELSE dist_to_water END) AS BIGINT), 'm)') END"""
WATER_SQL = "dist_to_sea, dist_to_river, dist_to_lake, dist_to_canal, dist_to_pond, dist_to_water, nearest_water_type"
SCORES_SQL = """area_m2, centroid_lat AS lat, centroid_lon AS lon, kategoria_ciszy, kategoria_natury, kategoria_dostepu, gestosc_zabudowy, quietness_score, nature_score, accessibility_score,
  is_built, building_count, building_coverage_pct, building_max_floors"""


@query(
    "flt_17_context_card",
    """SELECT id_dzialki AS id, area_m2, quietness_score AS quietness, nature_score AS nature, accessibility_score AS accessibility, pog_symbol IS NOT NULL AS has_mpzp, gmina, dzielnica AS miejscowosc, powiat,
       pog_symbol AS mpzp_symbol, pog_nazwa AS mpzp_nazwa, is_residential_zone AS mpzp_budowlany FROM parcels""",
)
def context_card(t):
    return S.context_card(t("parcels"))


@query(
    "flt_17_neighborhood_card",
    f"""SELECT id_dzialki AS id, gmina, dzielnica AS miejscowosc, powiat, {SCORES_SQL}, has_pog AS has_mpzp, pog_symbol AS mpzp_symbol, pog_nazwa AS mpzp_nazwa, is_residential_zone AS mpzp_budowlany,
        pog_maks_wysokosc_m AS pog_max_wysokosc, dist_to_school, dist_to_supermarket AS dist_to_shop, dist_to_doctors AS dist_to_hospital, dist_to_bus_stop, dist_to_industrial, dist_to_forest, {WATER_SQL},
        pct_forest_500m, pct_water_500m, count_buildings_500m, concat_ws('|', CASE WHEN dzielnica IS NOT NULL THEN 'Lokalizacja: ' || dzielnica || ', ' || coalesce(gmina, '') ELSE 'Lokalizacja: ' || gmina END,
        CASE WHEN area_m2 <> 0 THEN 'Powierzchnia: ' || format('{{:,}}', area_m2) || ' m²' END, CASE WHEN NOT is_built THEN 'Niezabudowana' WHEN building_count > 0 THEN 'Zabudowana (' || building_count || ' bud.)' ELSE 'Zabudowana' END,
        'Cisza: ' || quietness_score || '/100 (' || coalesce(kategoria_ciszy, '') || ')', 'Natura: ' || nature_score || '/100 (' || coalesce(kategoria_natury, '') || ')',
        'Dostępność: ' || accessibility_score || '/100 (' || coalesce(kategoria_dostepu, '') || ')', 'Woda: ' || {NEAREST_SQL}) AS summary FROM parcels""",
)
def neighborhood_card(t):
    return S.neighborhood_card(t("parcels")).withColumn("summary", F.array_join("summary", "|"))


@query(
    "flt_17_full_context_card",
    f"""SELECT id_dzialki, gmina, dzielnica, {SCORES_SQL}, pog_symbol, pog_nazwa, pog_maks_wysokosc_m AS pog_max_wysokosc, is_residential_zone, {WATER_SQL}, dist_to_school, dist_to_bus_stop, dist_to_forest,
        dist_to_supermarket, dist_to_main_road, pct_forest_500m, count_buildings_500m, coalesce(dzielnica, '') || ', ' || coalesce(gmina, '') AS lokalizacja, format('{{:,}}', coalesce(area_m2, 0)) || ' m²' AS powierzchnia,
        CASE WHEN is_built THEN 'Tak' ELSE 'Nie' END AS zabudowana, CASE WHEN is_residential_zone THEN 'Tak' ELSE 'Nie' END AS strefa_mieszkaniowa,
        coalesce(quietness_score, 0) || '/100 (' || coalesce(kategoria_ciszy, '') || ')' AS cisza, coalesce(nature_score, 0) || '/100 (' || coalesce(kategoria_natury, '') || ')' AS natura,
        coalesce(accessibility_score, 0) || '/100 (' || coalesce(kategoria_dostepu, '') || ')' AS dostepnosc, {NEAREST_SQL} AS najblizsa_woda FROM parcels""",
)
def full_context_card(t):
    out = S.full_context_card(t("parcels"))
    return out.select(*[c for c in out.columns if c != "summary"], "summary.*")


@query(
    "flt_17_water_card",
    f"""WITH w AS (SELECT id_dzialki, dzielnica, {WATER_SQL}, concat_ws('|', CASE WHEN dist_to_sea <> 0 AND dist_to_sea <= 5000 THEN 'Morze: ' || dist_to_sea || 'm' END, CASE WHEN dist_to_lake <> 0 AND dist_to_lake <= 3000 THEN 'Jezioro: ' || dist_to_lake || 'm' END,
        CASE WHEN dist_to_river <> 0 AND dist_to_river <= 2000 THEN 'Rzeka: ' || dist_to_river || 'm' END, CASE WHEN dist_to_canal <> 0 AND dist_to_canal <= 1000 THEN 'Kanał: ' || dist_to_canal || 'm' END) AS near FROM parcels)
        SELECT * EXCLUDE (near), CASE WHEN near = '' THEN 'Brak wody w pobliżu' ELSE near END AS water_summary, near <> '' AS has_water_nearby FROM w""",
)
def water_card(t):
    return S.water_card(t("parcels")).withColumn("water_summary", F.array_join("water_summary", "|"))


@query(
    "flt_18_compare",
    """WITH u AS (SELECT id_dzialki, unnest(['gmina','area_m2','quietness_score','pog_symbol']) AS attribute, unnest([gmina, CAST(area_m2 AS VARCHAR), CAST(quietness_score AS VARCHAR), pog_symbol]) AS value FROM parcels WHERE id_dzialki IN ('D12','D77','D140'))
       SELECT attribute, max(CASE WHEN id_dzialki='D12' THEN value END) AS "D12", max(CASE WHEN id_dzialki='D77' THEN value END) AS "D77", max(CASE WHEN id_dzialki='D140' THEN value END) AS "D140" FROM u GROUP BY attribute""",
)
def compare(t):
    return S.compare(t("parcels"), ["D12", "D77", "D140"], ["gmina", "area_m2", "quietness_score", "pog_symbol"])
