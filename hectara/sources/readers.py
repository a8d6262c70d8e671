"""Table readers: layers, parcel files, zoning feed, map elements, typed CSV."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hectara.functions.geometry import vertex
from hectara.functions.texts import profile_code

# Margins around the data, in metres.
FEATURE_MARGIN, CLIP_MARGIN = 2000.0, 1000.0


def layer(df: DataFrame, bounds: tuple[float, float, float, float], margin: float, column: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Rows whose envelope (minx, miny, maxx, maxy) meets the bounds plus a margin; the comparison reaches the Parquet scan."""
    x0, y0, x1, y1 = bounds
    df = df.filter((F.col("maxx") >= x0 - margin) & (F.col("minx") <= x1 + margin) & (F.col("maxy") >= y0 - margin) & (F.col("miny") <= y1 + margin))
    return df.filter(F.col(column).isin(values)) if column and values else df


# Names under which the id and the owner group appear, in order of preference.
ID_NAMES = ["ID_DZIALKI", "id_dzialki", "id", "ID"]
GROUP_NAMES = ["kieg_grupa_rej", "grupa_rej", "GRUPA_REJ"]


def parcel_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """city -> path. Renames the first known id and owner-group column, tags the city, unites the files."""
    spark_case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        out = None
        for city, path in paths.items():
            df = spark.read.parquet(path)
            key = next((c for c in ID_NAMES if c in df.columns), None)
            group = next((c for c in GROUP_NAMES if c in df.columns), None)
            if key and key != "id_dzialki":
                df = df.withColumnRenamed(key, "id_dzialki")
            if group and group != "grupa_rej":
                df = df.withColumnRenamed(group, "grupa_rej")
            elif not group:
                df = df.withColumn("grupa_rej", F.lit(None).cast("string"))
            df = df.withColumn("gmina", F.lit(city))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out
    finally:
        spark.conf.set("spark.sql.caseSensitive", spark_case)


_RING = "struct<LinearRing:struct<posList:string>>"
_POLYGON = f"struct<exterior:{_RING},interior:array<{_RING}>>"
_LINK = "struct<_href:string,_title:string>"
ZONE_SCHEMA = (
    "idIIP struct<Identyfikator:struct<lokalnyId:string>>, oznaczenie string, symbol string, "
    f"nazwa {_LINK}, profilPodstawowy array<{_LINK}>, profilDodatkowy array<{_LINK}>, "
    "maksNadziemnaIntensywnoscZabudowy string, maksUdzialPowierzchniZabudowy string, maksWysokoscZabudowy string, "
    "minUdzialPowierzchniBiologicznieCzynnej string, "
    f"geometria struct<Polygon:{_POLYGON},MultiSurface:struct<surfaceMember:array<struct<Polygon:{_POLYGON}>>>>"
)


def position_list(text: Column) -> Column:
    """'y x y x …' to a ring of vertices."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.cast("double"))
    return F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda i: vertex(F.element_at(parts, i * 2), F.element_at(parts, i * 2 - 1)))


def zone_feed(spark: SparkSession, path: str, city: str, first_part_only: bool = False) -> DataFrame:
    """Zoning XML feed, one row per zone; polygon parts follow each other as rings per part."""
    raw = spark.read.format("xml").option("rowTag", "StrefaPlanistyczna").option("ignoreNamespace", True).schema(ZONE_SCHEMA).load(path)

    def polygon(p: Column) -> Column:
        holes = F.coalesce(p["interior"], F.array().cast(f"array<{_RING}>"))
        return F.concat(F.array(position_list(p["exterior"]["LinearRing"]["posList"])), F.transform(holes, lambda h: position_list(h["LinearRing"]["posList"])))

    def codes(links: Column) -> Column:
        return F.array_compact(F.transform(F.coalesce(links, F.array().cast(f"array<{_LINK}>")), lambda x: profile_code(x["_href"])))

    def titles(links: Column) -> Column:
        return F.array_compact(F.transform(F.coalesce(links, F.array().cast(f"array<{_LINK}>")), lambda x: x["_title"]))

    single = F.col("geometria.Polygon")
    many = F.transform("geometria.MultiSurface.surfaceMember", lambda m: polygon(m["Polygon"]))
    parts = F.when(single.isNotNull(), F.array(polygon(single))).otherwise(many)
    if first_part_only:
        parts = F.slice(parts, 1, 1)
    return raw.select(
        F.col("idIIP.Identyfikator.lokalnyId").alias("id"), F.lit(city).alias("gmina"), "oznaczenie", "symbol", F.col("nazwa._title").alias("nazwa"),
        codes(F.col("profilPodstawowy")).alias("profil_podstawowy"), titles(F.col("profilPodstawowy")).alias("profil_podstawowy_nazwy"),
        codes(F.col("profilDodatkowy")).alias("profil_dodatkowy"), titles(F.col("profilDodatkowy")).alias("profil_dodatkowy_nazwy"),
        F.col("maksNadziemnaIntensywnoscZabudowy").try_cast("double").alias("maks_intensywnosc"), F.col("maksUdzialPowierzchniZabudowy").try_cast("double").alias("maks_zabudowa_pct"),
        F.col("maksWysokoscZabudowy").try_cast("double").alias("maks_wysokosc_m"), F.col("minUdzialPowierzchniBiologicznieCzynnej").try_cast("double").alias("min_bio_pct"),
        parts.alias("parts"),
    ).filter(F.col("parts").isNotNull())


ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>"


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Raw map elements, one row each, from documents with an `elements` array."""
    return spark.read.schema(f"elements array<{ELEMENT}>").json(path).select(F.inline("elements"))


def map_features(elements: DataFrame) -> DataFrame:
    """Tagged nodes become points; tagged ways take their nodes' coordinates in order.

    A closed way of three or more found nodes is a polygon, two or more make a line, fewer drop
    out. Nodes without coordinates are left out.
    """
    tagged = elements.filter(F.size("tags") > 0)
    points = tagged.filter(F.col("type") == "node").select(F.concat(F.lit("node/"), F.col("id").cast("string")).alias("osm_id"), F.lit("Point").alias("gtype"), F.array(vertex(F.col("lon"), F.col("lat"))).alias("line"), "tags")
    nodes = elements.filter((F.col("type") == "node") & F.col("lat").isNotNull()).select(F.col("id").alias("node"), "lon", "lat")
    ways = tagged.filter(F.col("type") == "way")
    steps = ways.select("id", F.posexplode("nodes").alias("pos", "node")).join(nodes, "node")
    lines = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("s"))
    line = F.transform("s", lambda p: vertex(p["lon"], p["lat"]))
    shaped = lines.select("id", line.alias("line")).join(ways.select("id", "tags"), "id")
    closed = (F.element_at("line", 1) == F.element_at("line", -1)) & (F.size("line") >= 3)
    gtype = F.when(closed, "Polygon").when(F.size("line") >= 2, "LineString")
    shapes = shaped.select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("osm_id"), gtype.alias("gtype"), "line", "tags").filter(F.col("gtype").isNotNull())
    return points.unionByName(shapes)


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with '' and 'None' as null. Numbers and booleans that do not parse become null instead of failing the read."""
    fields = T.StructType.fromDDL(schema).fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    df = spark.read.option("header", True).schema(text).csv(path)

    def cell(f: T.StructField) -> Column:
        v = F.when(F.col(f.name).isin("", "None"), None).otherwise(F.col(f.name))
        return (v if isinstance(f.dataType, T.StringType) else v.try_cast(f.dataType)).alias(f.name)

    return df.select(*[cell(f) for f in fields])


def coordinate_csv(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Id and coordinates; rows whose x or y is no number are left out."""
    df = spark.read.option("header", True).csv(path)
    out = df.select(F.col(key), F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"))
    return out.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
