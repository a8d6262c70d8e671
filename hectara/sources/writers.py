"""Exports and loads: flat CSV, nodes, edges, GeoJSON features, result pages, upsert, logs and leads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hectara.functions.parts import geojson_geometry, nested_parts
from hectara.functions.scores import half_even
from hectara.functions.labels import lookup
from hectara.functions.texts import fold_city
from hectara.operators.graph import edges as graph_edges
from hectara.operators.spatial import spread
from hectara.session import cut_lineage


def flat(df: DataFrame) -> DataFrame:
    """Text form of every column: no geometry, 'true'/'false', '' for null, two decimals."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith(("array", "struct", "map")):
            continue
        c = F.col(name)
        text = half_even(c, 2).cast("string") if kind in ("double", "float") else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


# Node export keys.
CITY_CODES = {"Gdańsk": "2261", "Gdynia": "2262", "Sopot": "2264"}


def node_tables(parcels: DataFrame, zones: DataFrame) -> dict[str, DataFrame]:
    """Cities, districts, zones, profiles, categories and slim parcels; composite keys are joined by '_'."""
    code = F.coalesce(lookup(CITY_CODES, F.col("gmina")), fold_city(F.col("gmina")))
    profiles = zones.select(F.explode(F.arrays_zip(F.split("profil_podstawowy", "[|]").alias("kod"), F.split("profil_podstawowy_nazwy", "[|]").alias("nazwa"))).alias("p")).select("p.kod", "p.nazwa")
    return {
        "gmina": parcels.select("gmina").distinct().select(code.alias("key"), F.col("gmina").alias("name")),
        "dzielnica": parcels.filter(F.col("dzielnica").isNotNull()).select("gmina", "dzielnica").distinct().select(F.concat_ws("_", F.col("dzielnica"), code).alias("key"), F.col("dzielnica").alias("name")),
        "strefa": zones.select(F.concat_ws("_", code, F.col("oznaczenie")).alias("key"), F.col("symbol").alias("name")),
        "profil": profiles.filter(F.col("kod").isNotNull()).groupBy(F.col("kod").alias("key")).agg(F.min("nazwa").alias("name")),
        "kategoria": parcels.select(F.explode(F.array("kategoria_ciszy", "kategoria_natury", "kategoria_dostepu", "gestosc_zabudowy")).alias("key")).distinct().select("key", F.col("key").alias("name")),
        "dzialka": parcels.select(F.col("id_dzialki").alias("key"), F.col("gmina").alias("name")),
    }


def stacked(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in tables.items():
        part = df.select(F.lit(kind).alias("kind"), *df.columns)
        out = part if out is None else out.unionByName(part)
    return out


def write_edges(parcels: DataFrame, zones: DataFrame, path: str) -> None:
    """One folder per relation. Rows are dealt out by their start first, since each task sorts its rows by relation before it writes them."""
    spread(graph_edges(parcels, zones), "src").write.mode("overwrite").partitionBy("rel").parquet(path)


def poi_export(df: DataFrame, kind: str, area: Column | None = None) -> DataFrame:
    """Id from type, register code and the first 8 characters of the local id; the row number where it is missing."""
    key = F.when(F.col("local_id").isNotNull(), F.concat_ws("_", F.lit(kind), "teryt", F.substring("local_id", 1, 8))).otherwise(F.concat_ws("_", F.lit(kind), F.col("row").cast("string")))
    extra = [half_even(area).alias("size")] if area is not None else []
    return df.select(key.alias("id"), F.coalesce("name", F.lit("")).alias("name"), "x", "y", *extra)


def geojson_features(parcels: DataFrame, ids: DataFrame, geometry: bool = True, rings: str | None = None) -> DataFrame:
    """One Feature per row; a line-per-feature file is valid input for map tools and never gathers in one task.

    The geometry is the centroid, or with rings (a column of flat rings in grid coordinates) the Polygon or MultiPolygon they form.
    """
    found = parcels.join(ids, "id_dzialki", "left_semi")
    props = F.struct("id_dzialki", "gmina", "miejscowosc", "area_m2", "quietness_score", "nature_score", "accessibility_score", F.col("has_pog").alias("has_mpzp"), F.col("pog_symbol").alias("mpzp_symbol"))
    if rings:
        shape = geojson_geometry(nested_parts(F.col(rings)))
    else:
        shape = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("centroid_lon", "centroid_lat").alias("coordinates")), {"ignoreNullFields": "false"})
    shape = F.coalesce(F.when(F.lit(geometry), shape), F.lit("null"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(props, {"ignoreNullFields": "false"}), F.lit(',"geometry":'), shape, F.lit("}"))
    return found.select("id_dzialki", "centroid_lat", "centroid_lon", feature.alias("feature"))


def geojson_header(features: DataFrame) -> DataFrame:
    """Bounds, centre as the middle of the bounds, centre as the mean of centroids, and the number of features."""
    lat, lon = "centroid_lat", "centroid_lon"
    b = features.agg(F.min(lat).alias("min_lat"), F.min(lon).alias("min_lon"), F.max(lat).alias("max_lat"), F.max(lon).alias("max_lon"), F.avg(lat).alias("mean_lat"), F.avg(lon).alias("mean_lon"), F.count(F.lit(1)).alias("features"))
    return b.select("*", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("mid_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("mid_lon"))


def write_results(ranked: DataFrame, path: str) -> None:
    """Ranked rows as JSON lines; the stored rank serves the pages."""
    ranked.write.mode("overwrite").json(path)


def read_page(spark: SparkSession, path: str, schema: str, page: int, page_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of one page and its one-row summary."""
    rows = spark.read.schema(schema).json(path)
    first = (page - 1) * page_size
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / page_size).cast("int")
    info = total.select("total", F.lit(page).alias("page"), pages.alias("pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))
    return rows.filter((F.col("rank") > first) & (F.col("rank") <= first + page_size)), info


def load_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Replace a table's files; partitioned by a low-cardinality column when given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def latest(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the one that comes last in the given order, ties by all its values. Rows without a key are left out."""
    rest = [c for c in updates.columns if c not in order and c != key]
    last = F.max(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_last")
    return updates.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(*[F.col(key) if c == key else F.col(f"_last.`{c}`").alias(c) for c in updates.columns])


def upsert(base: DataFrame, updates: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of updates replace the listed columns of base rows with the same key; new keys are added.

    Of updates with one key the last in `order` counts; a column that only orders them is not written.
    """
    updates = latest(updates, key, order or [])
    updates = updates.select(*[c for c in updates.columns if c in base.columns])
    changed = [c for c in updates.columns if c != key]
    u = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias("_u_" + c) for c in changed])
    j = base.join(u, key, "full")
    hit = F.coalesce("_hit", F.lit(False))
    return j.select(*[F.when(hit, F.col("_u_" + c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns])


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, key: str, part: str, order: list[str] | None = None) -> None:
    """Upsert into the Parquet table at path, partitioned by `part`; only partitions that hold a touched row are rewritten.

    A key that is updated keeps its partition if updates do not name `part`; new keys that do not name it get null. The names of touched
    partitions come to the driver: they are folders, not rows.
    """
    updates = latest(updates, key, order or [])
    table = spark.read.parquet(path)
    held = table.join(updates.select(key), key, "left_semi").select(F.col(part).cast("string").alias(part))
    if part in updates.columns:
        held = held.unionByName(updates.select(F.col(part).cast("string").alias(part)))
    else:  # new keys lie in the null partition
        held = held.unionByName(updates.join(table.select(key), key, "left_anti").select(F.lit(None).cast("string").alias(part)))
    touched = [r[0] for r in held.distinct().collect()]
    name = F.col(part).cast("string")
    within = F.when(name.isNull(), F.lit(None in touched)).otherwise(name.isin([x for x in touched if x is not None]))
    rows = cut_lineage(upsert(table.filter(within), updates, key))
    left = rows.select(name.alias("_left")).distinct()
    emptied = spark.createDataFrame([(x,) for x in touched], f"{part} string").join(left, F.col(part).eqNullSafe(F.col("_left")), "left_anti")
    if not emptied.isEmpty():
        raise ValueError("an update moves the last row out of a partition; rewrite the table instead")
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def append_patterns(patterns: DataFrame, path: str) -> None:
    """One JSON line per session with its preference patterns."""
    rows = patterns.groupBy("user_id").agg(F.collect_list(F.struct("feature", "value", "n")).alias("patterns"))
    rows.write.mode("append").json(path)


def historical_preferences(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema("user_id bigint, patterns array<struct<feature:string,value:string,n:bigint>>").json(path)
    return log.select("user_id", F.inline("patterns")).groupBy("user_id", "feature", "value").agg(F.sum("n").alias("n"))


EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def leads(submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted leads with lower-case address, source and status, and the rejected ones."""
    good = F.coalesce(F.col("email").rlike(EMAIL), F.lit(False))
    accepted = submitted.filter(good).withColumn("email", F.lower("email")).withColumn("source", F.lit("web")).withColumn("status", F.lit("new")).withColumn("created_at", F.current_timestamp())
    return accepted, submitted.filter(~good)
