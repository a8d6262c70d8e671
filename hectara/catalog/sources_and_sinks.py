"""SRC, SNK and UDF: readers, writers and the raw-query entry."""
import uuid

from pyspark.sql import functions as F

from hectara.catalog.registry import query
from hectara.functions.geometry import to_grid
from hectara.operators.spatial import spread
from hectara.session import shared_dir
from hectara.sources import readers as R
from hectara.sources import writers as W

FEED_ROWS = 20_000  # zones a file, about 26 MB


def scratch(t, name):
    """A fresh folder for files a query writes and reads back."""
    return f"{shared_dir(t.spark)}/hectara-{name}-{uuid.uuid4().hex}"


@query("src_01_layer_clip", "SELECT shape_id, name FROM shapes WHERE x1 >= 3000 - 1000 AND x0 <= 5000 + 1000 AND y1 >= 2000 - 1000 AND y0 <= 6000 + 1000")
def layer_clip(t):
    path = scratch(t, "layer")
    t("shapes").select("shape_id", "name", F.col("x0").alias("minx"), F.col("y0").alias("miny"), F.col("x1").alias("maxx"), F.col("y1").alias("maxy")).write.parquet(path)
    return R.layer(t.spark.read.parquet(path), (3000.0, 2000.0, 5000.0, 6000.0), R.CLIP_MARGIN).select("shape_id", "name")


ROAD_CLASSES = ["AUTOMOBILE", "MACHINERY", "BUILDING", "FURNITURE"]


@query("src_01_layer_values", "SELECT pk, dzielnica FROM parcels WHERE centroid_x + bbox_width >= 1000 - 2000 AND centroid_x <= 9000 + 2000 AND centroid_y + bbox_height >= 1000 - 2000 AND centroid_y <= 9000 + 2000 AND dzielnica IN ('AUTOMOBILE','MACHINERY','BUILDING','FURNITURE')")
def layer_values(t):
    """A layer clipped and filtered by four values of one column, both in the Parquet scan."""
    path = scratch(t, "layer")
    x, y = F.col("centroid_x"), F.col("centroid_y")
    t("parcels").select("pk", "dzielnica", x.alias("minx"), y.alias("miny"), (x + F.col("bbox_width")).alias("maxx"), (y + F.col("bbox_height")).alias("maxy")).write.parquet(path)
    return R.layer(t.spark.read.parquet(path), (1000.0, 1000.0, 9000.0, 9000.0), R.FEATURE_MARGIN, "dzielnica", ROAD_CLASSES).select("pk", "dzielnica")


@query(
    "src_02_parcel_files",
    """SELECT id_dzialki, CASE WHEN pk % 3 = 2 THEN NULL ELSE grupa_rej END AS grupa_rej, CASE pk % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS gmina, CASE WHEN pk % 3 = 1 THEN area_m2 END AS area_m2 FROM parcels""",
)
def parcel_files(t):
    p = t("parcels").select("pk", "id_dzialki", "grupa_rej", "area_m2")
    shapes = {
        "A": lambda d: d.select(F.col("id_dzialki").alias("ID_DZIALKI"), F.col("grupa_rej").alias("kieg_grupa_rej")),
        "B": lambda d: d.select("id_dzialki", F.col("grupa_rej").alias("GRUPA_REJ"), "area_m2"),
        "C": lambda d: d.select(F.col("id_dzialki").alias("id")),
    }
    paths = {}
    for i, (city, shape) in enumerate(shapes.items()):
        paths[city] = scratch(t, "parcels-" + city)
        shape(p.filter(F.col("pk") % 3 == i)).write.parquet(paths[city])
    return R.parcel_files(t.spark, paths).select("id_dzialki", "grupa_rej", "gmina", "area_m2")


def zone_elements(shapes):
    """Feed elements as nested columns: a polygon with a hole, or two parts."""

    def ring(x0, y0, x1, y1):
        text = F.format_string("%.1f %.1f %.1f %.1f %.1f %.1f %.1f %.1f %.1f %.1f", y0, x0, y0, x1, y1, x1, y1, x0, y0, x0)
        return F.struct(F.struct(text.alias("gml:posList")).alias("gml:LinearRing"))

    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    outer, hole, far = ring(x0, y0, x1, y1), ring(x0 + 1, y0 + 1, x0 + 3, y0 + 3), ring(x0 + 1000, y0, x1 + 1000, y1)
    multi = F.col("shape_id") % 4 == 0
    single = F.struct(outer.alias("gml:exterior"), F.array(hole).alias("gml:interior"))
    part = lambda r: F.struct(F.struct(r.alias("gml:exterior")).alias("gml:Polygon"))
    geometry = F.struct(
        F.when(~multi, single).alias("gml:Polygon"), F.when(multi, F.struct(F.array(part(outer), part(far)).alias("gml:surfaceMember"))).alias("gml:MultiSurface")
    )
    link = lambda code, title: F.struct(F.lit("http://k/KPT-MPZP-" + code).alias("_xlink:href"), F.lit(title).alias("_xlink:title"))
    return shapes.select(
        F.struct(F.struct(F.col("shape_id").cast("string").alias("app:lokalnyId")).alias("app:Identyfikator")).alias("app:idIIP"),
        F.concat((F.col("shape_id") % 50).cast("string"), F.lit("SW")).alias("app:oznaczenie"), F.lit("SW").alias("app:symbol"),
        F.struct(F.lit("strefa").alias("_xlink:title")).alias("app:nazwa"),
        F.array(link("MN", "mieszkaniowa"), link("U", "usługi")).alias("app:profilPodstawowy"),
        F.when(F.col("shape_id") % 5 != 0, F.format_string("%d.5", F.col("shape_id") % 30)).alias("app:maksWysokoscZabudowy"),
        geometry.alias("app:geometria"),
    )


@query(
    "src_03_zone_feed",
    """SELECT CAST(shape_id AS VARCHAR) AS id, concat(shape_id % 50, 'SW') AS oznaczenie, 'SW' AS symbol, 'strefa' AS nazwa, 'MN|U' AS codes, 'mieszkaniowa|usługi' AS names, CASE WHEN shape_id % 5 <> 0 THEN shape_id % 30 + 0.5e0 END AS maks_wysokosc_m,
       CASE WHEN shape_id % 4 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN shape_id % 4 = 0 THEN 2*(x1-x0)*(y1-y0) ELSE (x1-x0)*(y1-y0)-4 END AS area, x0 AS first_x, y0 AS first_y FROM shapes""",
)
def zone_feed(t):
    from hectara.functions.geometry import area

    path = scratch(t, "zones")
    root = 'app:Feed xmlns:app="urn:a" xmlns:gml="urn:g" xmlns:xlink="urn:x"'
    # A file is read whole by one task, so files are bounded by rows, whatever number of files the table came in.
    elements = zone_elements(spread(t("shapes"), "shape_id"))
    elements.write.format("xml").option("maxRecordsPerFile", FEED_ROWS).option("rootTag", root).option("rowTag", "app:StrefaPlanistyczna").option("validateName", False).save(path)
    z = R.zone_feed(t.spark, path, "NATION_0")
    first = F.element_at(F.element_at(F.element_at("parts", 1), 1), 1)
    return z.select(
        "id", "oznaczenie", "symbol", "nazwa", F.array_join("profil_podstawowy", "|").alias("codes"), F.array_join("profil_podstawowy_nazwy", "|").alias("names"), "maks_wysokosc_m",
        F.size("parts").alias("parts"), F.aggregate(F.transform("parts", area), F.lit(0.0), lambda a, b: a + b).alias("area"), first["x"].alias("first_x"), first["y"].alias("first_y"),
    )


@query(
    "src_04_map_elements",
    """WITH k AS (SELECT p_partkey AS id, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS lon, CAST((p_partkey * 104729) % 9973 AS DOUBLE) AS lat, p_brand FROM part), mx AS (SELECT max(id) AS m FROM k),
       nodes AS (SELECT * FROM k WHERE id % 7 <> 3),
       w AS (SELECT id, p_brand, CASE id % 4 WHEN 0 THEN [id, id+1, id+2, id] WHEN 1 THEN [id, id+1] WHEN 2 THEN [id, id+4, id+8] ELSE [id] END AS ns FROM k), s AS (SELECT id, p_brand, unnest(range(len(ns))) AS pos, unnest(ns) AS node FROM w),
       l AS (SELECT s.id, s.p_brand, count(*) AS n, arg_min(s.node, pos) AS f, arg_max(s.node, pos) AS e, sum(n.lon * (pos + 1)) AS chk FROM s JOIN nodes n ON s.node = n.id GROUP BY 1, 2)
       SELECT 'way/' || id AS osm_id, CASE WHEN f = e AND n >= 3 THEN 'Polygon' ELSE 'LineString' END AS gtype, n, p_brand AS brand FROM l WHERE n >= 2
       UNION ALL SELECT 'node/' || id, 'Point', 1, p_brand FROM nodes WHERE id % 3 = 0""",
)
def map_elements(t):
    """Elements written as documents of one element each, with missing nodes, open and closed ways and one-node ways."""
    k = F.col("p_partkey")
    base = t.raw("part").select(k.alias("id"), ((k * 7919) % 10007).cast("double").alias("lon"), ((k * 104729) % 9973).cast("double").alias("lat"), "p_brand")
    none_long, none_d = F.lit(None).cast("array<bigint>"), F.lit(None).cast("double")
    tags = F.create_map(F.lit("brand"), F.col("p_brand"))
    empty = F.create_map().cast("map<string,string>")
    node = base.filter(F.col("id") % 7 != 3).select(F.struct(F.lit("node").alias("type"), "id", "lat", "lon", none_long.alias("nodes"), F.when(F.col("id") % 3 == 0, tags).otherwise(empty).alias("tags")).alias("e"))
    i = F.col("id")
    refs = F.when(i % 4 == 0, F.array(i, i + 1, i + 2, i)).when(i % 4 == 1, F.array(i, i + 1)).when(i % 4 == 2, F.array(i, i + 4, i + 8)).otherwise(F.array(i))
    way = base.select(F.struct(F.lit("way").alias("type"), "id", none_d.alias("lat"), none_d.alias("lon"), refs.alias("nodes"), tags.alias("tags")).alias("e"))
    path = scratch(t, "elements")
    node.unionByName(way).select(F.to_json(F.struct(F.array("e").alias("elements"))).alias("value")).write.text(path)
    f = R.map_features(R.map_elements(t.spark, path))
    return f.select("osm_id", "gtype", F.size("line").alias("n"), F.col("tags")["brand"].alias("brand"))


CSV_SCHEMA = "id_dzialki string, area_m2 int, shape_index double, is_built boolean, pog_symbol string"


@query("src_05_typed_csv", "SELECT id_dzialki, area_m2, round_even(shape_index, 2) AS shape_index, is_built, CASE WHEN pk % 9 = 0 THEN NULL ELSE pog_symbol END AS pog_symbol FROM parcels")
def typed_csv(t):
    path = scratch(t, "csv")
    p = t("parcels").select("id_dzialki", "area_m2", "shape_index", "is_built", F.when(F.col("pk") % 9 == 0, "None").otherwise(F.col("pog_symbol")).alias("pog_symbol"))
    W.write_csv(p, path)
    return R.typed_csv(t.spark, path, CSV_SCHEMA)


@query("src_06_coordinate_csv", "SELECT CAST(poi_id AS VARCHAR) AS id, x, y FROM poi WHERE poi_id % 5 <> 0")
def coordinate_csv(t):
    path = scratch(t, "coordinates")
    bad = F.when(F.col("poi_id") % 5 == 0, "brak").otherwise(F.col("x").cast("string"))
    t("poi").select(F.col("poi_id").alias("id"), bad.alias("x"), "y").write.option("header", True).csv(path)
    return R.coordinate_csv(t.spark, path)


@query(
    "snk_01_flat_export",
    """SELECT id_dzialki, coalesce(CAST(area_m2 AS VARCHAR), '') AS area_m2, CASE WHEN is_built THEN 'true' ELSE 'false' END AS is_built, coalesce(pog_symbol, '') AS pog_symbol, coalesce(CAST(round_even(shape_index, 2) AS VARCHAR), '') AS shape_index FROM parcels""",
)
def flat_export(t):
    return W.flat(t("parcels").select("id_dzialki", "area_m2", "is_built", "pog_symbol", "shape_index"))


CITYKEY = "translate(lower(gmina), 'ńó', 'no')"


@query(
    "snk_02_node_tables",
    f"""SELECT DISTINCT 'gmina' AS kind, {CITYKEY} AS key, gmina AS name FROM parcels UNION ALL SELECT DISTINCT 'dzielnica', dzielnica || '_' || {CITYKEY}, dzielnica FROM parcels WHERE dzielnica IS NOT NULL UNION ALL SELECT 'strefa', {CITYKEY} || '_' || oznaczenie, symbol FROM zones
        UNION ALL SELECT 'profil', k, min(n) FROM (SELECT unnest(string_split(profil_podstawowy, '|')) AS k, unnest(string_split(profil_podstawowy_nazwy, '|')) AS n FROM zones) GROUP BY k
        UNION ALL SELECT DISTINCT 'kategoria', k, k FROM (SELECT unnest([kategoria_ciszy, kategoria_natury, kategoria_dostepu, gestosc_zabudowy]) AS k FROM parcels) UNION ALL SELECT 'dzialka', id_dzialki, gmina FROM parcels""",
)
def node_tables(t):
    path = scratch(t, "nodes")
    W.stacked(W.node_tables(t("parcels"), t("zones"))).write.partitionBy("kind").parquet(path)
    return t.spark.read.parquet(path).select("kind", "key", "name")


def _edge_oracle():
    from hectara.catalog.graphs import ALL_EDGES

    return ALL_EDGES


@query("snk_03_edge_tables", _edge_oracle())
def edge_tables(t):
    path = scratch(t, "edges")
    W.write_edges(t("parcels"), t("zones"), path)
    return t.spark.read.parquet(path).select("src", "dst", "rel")


@query(
    "snk_04_poi_export",
    "SELECT CASE WHEN poi_id % 4 = 0 THEN concat('school_', row) ELSE concat('school_', '2261_', substr(concat('LOC', poi_id, 'ABCDEFGH'), 1, 8)) END AS id, coalesce(name, '') AS name, x, y, round_even(x / 8, 0) AS size FROM (SELECT *, row_number() OVER (ORDER BY poi_id) AS row FROM poi)",
)
def poi_export(t):
    from hectara.operators.ranking import with_sequence

    numbered = with_sequence(t("poi").select("poi_id", "name", "x", "y"), ["poi_id"], "row")
    local = F.when(F.col("poi_id") % 4 == 0, None).otherwise(F.concat(F.lit("LOC"), F.col("poi_id").cast("string"), F.lit("ABCDEFGH")))
    return W.poi_export(numbered.withColumn("teryt", F.lit("2261")).withColumn("local_id", local), "school", F.col("x") / 8)


FAV = "(SELECT parcel_id FROM feedback WHERE action='favorite')"


def favourites(t):
    return t("feedback").filter(F.col("action") == "favorite").select(F.col("parcel_id").alias("id_dzialki")).distinct()


@query(
    "snk_05_geojson",
    f"""SELECT id_dzialki, 'Feature' AS type, id_dzialki AS prop_id, gmina, area_m2, 'Point' AS geometry_type, round(centroid_lon, 6) AS lon FROM parcels WHERE id_dzialki IN {FAV}""",
)
def geojson(t):
    f = W.geojson_features(t("parcels"), favourites(t))
    back = F.from_json("feature", "type string, properties struct<id_dzialki:string,gmina:string,area_m2:int>, geometry struct<type:string,coordinates:array<double>>")
    return f.select("id_dzialki", back.alias("f")).select(
        "id_dzialki", "f.type", F.col("f.properties.id_dzialki").alias("prop_id"), "f.properties.gmina", "f.properties.area_m2", F.col("f.geometry.type").alias("geometry_type"), F.round(F.col("f.geometry.coordinates")[0], 6).alias("lon")
    )


# Corners around a centroid in degrees: an island, a hole and its outline, as flat rings in no order. Output turns outlines counterclockwise, holes clockwise.
ISLAND = [(0.003, -0.0005), (0.004, -0.0005), (0.004, 0.0005), (0.003, 0.0005), (0.003, -0.0005)]
HOLE = [(-0.0004, -0.0004), (0.0004, -0.0004), (0.0004, 0.0004), (-0.0004, 0.0004), (-0.0004, -0.0004)]
OUTLINE = [(-0.001, -0.001), (-0.001, 0.001), (0.001, 0.001), (0.001, -0.001), (-0.001, -0.001)]
CORNERS = ", ".join(
    f"({part}, {ring}, {i}, {lon}, {lat})"
    for part, ring, corners in ((0, 0, ISLAND), (1, 0, OUTLINE[::-1]), (1, 1, HOLE[::-1]))
    for i, (lon, lat) in enumerate(corners)
)


@query(
    "snk_05_polygon_geojson",
    f"""SELECT id_dzialki, 'MultiPolygon' AS geometry_type, part, ring, place, round(centroid_lon + dlon, 7) AS lon, round(centroid_lat + dlat, 7) AS lat
        FROM parcels, (VALUES {CORNERS}) AS c(part, ring, place, dlon, dlat) WHERE id_dzialki IN {FAV} AND centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL""",
)
def polygon_geojson(t):
    def corner(lon, lat):
        return F.struct(*[c.alias(n) for c, n in zip(to_grid(F.col("centroid_lat") + lat, F.col("centroid_lon") + lon), "xy")])

    rings = F.array(*[F.array(*[corner(*c) for c in ring]) for ring in (HOLE, ISLAND, OUTLINE)])
    f = W.geojson_features(t("parcels").withColumn("outline", rings), favourites(t), rings="outline").filter(F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull())
    g = F.from_json("feature", "geometry struct<type:string,coordinates:array<array<array<array<double>>>>>")["geometry"]
    out = f.select("id_dzialki", g["type"].alias("geometry_type"), F.posexplode(g["coordinates"]).alias("part", "c"))
    out = out.select("id_dzialki", "geometry_type", "part", F.posexplode("c").alias("ring", "c")).select("id_dzialki", "geometry_type", "part", "ring", F.posexplode("c").alias("place", "c"))
    return out.select("id_dzialki", "geometry_type", "part", "ring", "place", F.round(F.col("c")[0], 7).alias("lon"), F.round(F.col("c")[1], 7).alias("lat"))


@query(
    "snk_05_geojson_header",
    f"""SELECT round(min(centroid_lat),6) AS min_lat, round(max(centroid_lon),6) AS max_lon, round(avg(centroid_lat),6) AS mean_lat, round((min(centroid_lat)+max(centroid_lat))/2,6) AS mid_lat, count(*) AS features FROM parcels WHERE id_dzialki IN {FAV}""",
)
def geojson_header(t):
    h = W.geojson_header(W.geojson_features(t("parcels"), favourites(t)))
    return h.select(*[F.round(c, 6).alias(c) for c in ("min_lat", "max_lon", "mean_lat", "mid_lat")], "features")


@query(
    "snk_06_result_pages",
    """WITH r AS (SELECT id_dzialki, quietness_score, row_number() OVER (ORDER BY quietness_score DESC NULLS LAST, id_dzialki) AS rank FROM parcels ORDER BY rank LIMIT 230) SELECT id_dzialki, quietness_score, rank, 230 AS total, 5 AS page, 10 AS pages, true AS has_next, true AS has_prev FROM r WHERE rank > 100 AND rank <= 125""",
)
def result_pages(t):
    from hectara.operators.ranking import top_ranked

    path = scratch(t, "results")
    W.write_results(top_ranked(t("parcels").select("id_dzialki", "quietness_score"), [F.col("quietness_score").desc_nulls_last(), F.col("id_dzialki")], 230), path)
    rows, info = W.read_page(t.spark, path, "id_dzialki string, quietness_score int, rank int", 5, 25)
    return rows.join(F.broadcast(info))


@query("snk_07_table_load", "SELECT gmina, count(*) AS n, round(avg(area_m2),4) AS avg_area FROM parcels GROUP BY gmina")
def table_load(t):
    path = scratch(t, "table")
    W.load_table(t("parcels").select("id_dzialki", "gmina", "area_m2"), path, "gmina")
    return t.spark.read.parquet(path).groupBy("gmina").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area_m2"), 4).alias("avg_area"))


@query(
    "snk_08_upsert",
    """WITH a AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN concat('NEW', s_suppkey) ELSE concat('D', s_suppkey * 2) END AS id_dzialki, CAST(s_suppkey AS INT) AS area_m2 FROM supplier),
       u AS (SELECT id_dzialki, max(area_m2) AS area_m2 FROM (SELECT * FROM a UNION ALL SELECT id_dzialki, area_m2 * 2 FROM a WHERE area_m2 % 2 = 0) GROUP BY 1)
       SELECT coalesce(b.id_dzialki, u.id_dzialki) AS id_dzialki, CASE WHEN u.id_dzialki IS NOT NULL THEN u.area_m2 ELSE b.area_m2 END AS area_m2, coalesce(b.gmina, 'new') AS gmina
       FROM parcels b FULL JOIN u ON b.id_dzialki = u.id_dzialki""",
)
def upsert(t):
    """Updates that repeat keys, written into a partitioned table and read back."""
    k = F.col("s_suppkey")
    updates = t.raw("supplier").select(F.when(k % 3 == 0, F.concat(F.lit("NEW"), k.cast("string"))).otherwise(F.concat(F.lit("D"), (k * 2).cast("string"))).alias("id_dzialki"), k.cast("int").alias("area_m2"))
    updates = updates.unionByName(updates.filter("area_m2 % 2 = 0").withColumn("area_m2", F.col("area_m2") * 2))
    base = t("parcels").select("id_dzialki", "area_m2", "gmina")
    path = scratch(t, "upserted")
    W.load_table(base, path, "gmina")
    known = updates.join(base.select("id_dzialki"), "id_dzialki", "left_semi")
    fresh = updates.join(base.select("id_dzialki"), "id_dzialki", "left_anti").withColumn("gmina", F.lit("new"))
    W.upsert_table(t.spark, path, known, "id_dzialki", "gmina", ["area_m2"])
    W.upsert_table(t.spark, path, fresh, "id_dzialki", "gmina", ["area_m2"])
    return t.spark.read.parquet(path).select("id_dzialki", F.col("area_m2").cast(base.schema["area_m2"].dataType).alias("area_m2"), "gmina")


@query("snk_09_pattern_log", "SELECT user_id, action AS feature, parcel_id AS value, 2 * count(*) AS n FROM feedback WHERE action IN ('favorite','reject') GROUP BY 1, 2, 3")
def pattern_log(t):
    path = scratch(t, "patterns")
    p = t("feedback").filter(F.col("action").isin("favorite", "reject")).groupBy("user_id", F.col("action").alias("feature"), F.col("parcel_id").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    W.append_patterns(p, path)
    W.append_patterns(p, path)
    return W.historical_preferences(t.spark, path)


MAIL = "CASE o_orderkey % 3 WHEN 0 THEN concat('User', o_orderkey, '@Mail.PL') WHEN 1 THEN concat('bad', o_orderkey, '@x') ELSE NULL END"


@query(
    "snk_10_leads",
    f"SELECT o_orderkey, lower({MAIL}) AS email, 'new' AS status, 'web' AS source FROM orders WHERE regexp_matches({MAIL}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') UNION ALL SELECT o_orderkey, {MAIL}, 'rejected', NULL FROM orders WHERE NOT coalesce(regexp_matches({MAIL}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$'), false)",
)
def leads(t):
    k = F.col("o_orderkey")
    mail = F.when(k % 3 == 0, F.concat(F.lit("User"), k.cast("string"), F.lit("@Mail.PL"))).when(k % 3 == 1, F.concat(F.lit("bad"), k.cast("string"), F.lit("@x")))
    accepted, rejected = W.leads(t.raw("orders").select("o_orderkey", mail.alias("email")))
    path = scratch(t, "leads")
    accepted.write.mode("append").parquet(path)
    stored = t.spark.read.parquet(path).select("o_orderkey", "email", "status", "source")
    return stored.unionByName(rejected.select("o_orderkey", "email", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("source")))


@query("udf_01_row_rules", "SELECT id_dzialki, coalesce(building_main_function, 'brak') AS fn, CASE WHEN area_m2 < 500 THEN 'mala' WHEN area_m2 < 1500 THEN 'pod_dom' WHEN area_m2 < 5000 THEN 'duza' WHEN area_m2 >= 5000 THEN 'bardzo_duza' END AS size_class FROM parcels")
def row_rules(t):
    """Row-wise rules are Column expressions; nothing runs per row in Python."""
    from hectara.functions.labels import size_class

    return t("parcels").select("id_dzialki", F.coalesce("building_main_function", F.lit("brak")).alias("fn"), size_class(F.col("area_m2")).alias("size_class"))


@query("udf_02_raw_query", "SELECT gmina, count(*) AS n FROM parcels WHERE area_m2 >= 700 AND kategoria_ciszy = 'cicha' GROUP BY gmina")
def raw_query(t):
    return t.spark.sql("SELECT gmina, count(*) AS n FROM {parcels} WHERE area_m2 >= :low AND kategoria_ciszy = :band GROUP BY gmina", args={"low": 700, "band": "cicha"}, parcels=t("parcels"))


@query("udf_03_criteria_table", "SELECT search_id, gmina, quiet_cats IS NOT NULL AS wants_quiet, coalesce(forest_m, 0) AS forest_m, coalesce(w_school, 0) AS w_school, 0e0 AS w_forest FROM searches")
def criteria_table(t):
    """One search per row; fields a table lacks take the defaults of the criteria record."""
    from hectara.operators.search import criteria_columns, split_lists

    s = split_lists(t("searches"))
    c = criteria_columns(s, "")
    return s.select("search_id", c["gmina"].alias("gmina"), c["quiet_cats"].isNotNull().alias("wants_quiet"), F.coalesce(c["forest_m"], F.lit(0)).alias("forest_m"), F.coalesce(c["w_school"], F.lit(0.0)).alias("w_school"), c["w_forest"].alias("w_forest"))
