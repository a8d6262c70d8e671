"""Key joins: category edges, hierarchies, prices, enrichment, dictionaries, adjacency walks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hectara.functions import constants as C
from hectara.functions.labels import lookup
from hectara.functions.texts import fold_city, slug
from hectara.session import cut_lineage, shuffled


def category_edges(parcels: DataFrame) -> DataFrame:
    """Typed edges from parcels to category nodes in a single pass over the table."""
    c = F.col
    targets = {
        "HAS_OWNERSHIP": lookup(C.OWNERSHIP_IDS, c("typ_wlasnosci")),
        "HAS_OWNER_GROUP": lookup(C.OWNER_GROUP_IDS, c("grupa_rej_nazwa")),
        "HAS_BUILD_STATUS": F.when(c("is_built"), "zabudowana").otherwise("niezabudowana"),
        "HAS_BUILDING_FUNCTION": F.when(c("is_built"), lookup(C.FUNCTION_IDS, c("building_main_function"))),
        "HAS_BUILDING_TYPE": F.when(c("is_built"), slug(c("building_type"))),
        "HAS_SIZE": c("size_category"),
        "HAS_QUIETNESS": c("kategoria_ciszy"),
        "HAS_NATURE": c("kategoria_natury"),
        "HAS_ACCESS": c("kategoria_dostepu"),
        "HAS_DENSITY": c("gestosc_zabudowy"),
        "NEAREST_WATER_TYPE": c("nearest_water_type"),
    }
    pairs = F.array(*[F.struct(F.lit(rel).alias("rel"), value.alias("dst")) for rel, value in targets.items()])
    return parcels.select(c("id_dzialki").alias("src"), F.inline(pairs)).filter(c("dst").isNotNull()).select("src", "dst", "rel")


def zone_edges(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    left = parcels.filter(F.col("pog_oznaczenie").isNotNull()).select(F.col("id_dzialki").alias("src"), F.col("pog_oznaczenie").alias("oznaczenie"), fold_city(F.col("gmina")).alias("city"))
    right = zones.select(F.col("zone_id").alias("dst"), "oznaczenie", fold_city(F.col("gmina")).alias("city"))
    return left.join(right, ["oznaczenie", "city"]).select("src", "dst", F.lit("HAS_POG").alias("rel"))


def dominant_city(parcels: DataFrame) -> DataFrame:
    """Per district name the city with most parcels, the count of the next one and a border-case flag."""
    counts = parcels.filter(F.col("dzielnica").isNotNull()).groupBy("dzielnica", "gmina").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dzielnica").orderBy(F.col("n").desc(), "gmina")
    ranked = counts.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("n").over(w))
    return ranked.filter(F.col("rank") == 1).select(
        F.col("dzielnica").alias("district"), F.col("gmina").alias("city"), "n", F.coalesce("second", F.lit(0)).alias("second_n"), F.coalesce(F.col("second") <= 5, F.lit(False)).alias("border_case")
    )


def hierarchy_edges(parcels: DataFrame) -> DataFrame:
    located = parcels.filter(F.col("dzielnica").isNotNull()).select(F.col("id_dzialki").alias("src"), F.col("dzielnica").alias("dst"), F.lit("LOCATED_IN").alias("rel"))
    belongs = dominant_city(parcels).select(F.col("district").alias("src"), F.col("city").alias("dst"), F.lit("BELONGS_TO").alias("rel"))
    return located.unionByName(belongs)


def profile_edges(zones: DataFrame) -> DataFrame:
    """Zone to profile edges of both lists, secondary ones flagged."""
    both = F.array(
        F.struct(F.col("profil_podstawowy").alias("codes"), F.lit(False).alias("secondary")),
        F.struct(F.col("profil_dodatkowy").alias("codes"), F.lit(True).alias("secondary")),
    )
    return zones.select("zone_id", F.inline(both)).select("zone_id", F.explode(F.split("codes", "[|]")).alias("profile"), "secondary").filter(F.col("profile") != "").distinct()


def zoning_card(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    profiles = profile_edges(zones).groupBy("zone_id").agg(F.array_sort(F.collect_set("profile")).alias("profiles"))
    card = zones.select("zone_id", "symbol", "nazwa").join(profiles, "zone_id", "left")
    edges = zone_edges(parcels, zones)
    return (
        parcels.select("id_dzialki").join(edges.select(F.col("src").alias("id_dzialki"), F.col("dst").alias("zone_id")), "id_dzialki", "left").join(card, "zone_id", "left")
    )


def price_lookup(rows: DataFrame, city: str, district: str, prices: DataFrame, city_prices: DataFrame) -> DataFrame:
    """District price, else the city's, else nothing. Names compare without case."""
    exact = prices.select(F.lower("city").alias("k1"), F.lower("district").alias("k2"), F.struct("price_min", "price_max", "segment").alias("exact"))
    broad = city_prices.select(F.lower("city").alias("k1"), F.struct("price_min", "price_max", "segment").alias("broad"))
    keyed = rows.withColumn("k1", F.lower(city)).withColumn("k2", F.lower(district))
    found = keyed.join(exact, ["k1", "k2"], "left").join(broad, "k1", "left").drop("k1", "k2")
    return found.withColumn("p", F.coalesce("exact", "broad")).withColumn("confidence", F.when(F.col("exact").isNotNull(), "HIGH").when(F.col("broad").isNotNull(), "LOW")).drop("exact", "broad")


def market_lookup(names: DataFrame, name: str, prices: DataFrame, cities: list[str]) -> DataFrame:
    """Exact district in the listed cities in their order, else the first price entry whose name contains the text."""
    from hectara.operators.matching import contains_pairs

    listed = prices.withColumn("position", F.struct("city", "district"))
    order = F.array_position(F.array(*[F.lit(c) for c in cities]), F.col("city"))
    exact = listed.filter(F.col("city").isin(cities)).groupBy(F.col("district").alias(name)).agg(F.min_by(F.struct("city", "district", "price_min", "price_max"), order).alias("exact"))
    pairs = contains_pairs(names.select(F.lower(name).alias("needle")).distinct(), listed.select(F.lower("district").alias("hay"), "city", "district", "price_min", "price_max", "position"))
    fuzzy = pairs.groupBy("needle").agg(F.min_by(F.struct("city", "district", "price_min", "price_max"), "position").alias("fuzzy"))
    out = names.join(exact, name, "left").join(fuzzy, F.lower(name) == F.col("needle"), "left")
    return out.withColumn("hit", F.coalesce("exact", "fuzzy")).select(name, F.concat_ws(", ", "hit.city", "hit.district").alias("matched"), "hit.price_min", "hit.price_max")


def enrich(ranked: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill null attributes of ranked rows from the detail table; the ranked side wins."""
    extra = details.select(key, *[F.col(c).alias(f"{c}__d") for c in columns])
    joined = ranked.join(extra, key, "left")
    return joined.select(*[F.coalesce(c, f"{c}__d").alias(c) if c in columns else F.col(c) for c in ranked.columns])


def mirrored(pairs: DataFrame) -> DataFrame:
    """Undirected pairs seen from both ends, in one pass."""
    ends = F.array(F.struct(F.col("id1").alias("id"), F.col("id2").alias("neighbor")), F.struct(F.col("id2").alias("id"), F.col("id1").alias("neighbor")))
    return pairs.select("shared_border_m", F.inline(ends))


def neighbours(pairs: DataFrame, limit: int) -> DataFrame:
    """Per parcel the neighbours with the longest common border."""
    w = Window.partitionBy("id").orderBy(F.col("shared_border_m").desc(), "neighbor")
    return mirrored(pairs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def border_totals(pairs: DataFrame) -> DataFrame:
    return mirrored(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.sum("shared_border_m"), 2).alias("total_border_m"))


def same_district_paths(pairs: DataFrame, districts: DataFrame) -> DataFrame:
    """Paths of 1 to 3 adjacency hops with both ends in one district: id1, id2, hops and number of paths.

    In a graph without parallel edges no edge repeats within three hops unless a step turns
    straight back. Paths with the same ends are counted together before every shuffle.
    """
    step = cut_lineage(mirrored(pairs).select("id", "neighbor"))
    walk = step.select(F.col("id").alias("start"), F.col("id").alias("prev"), F.col("neighbor").alias("cur"), F.lit(1).cast("bigint").alias("n"))
    found = walk.select("start", "cur", F.lit(1).alias("hops"), "n")
    for hop in (2, 3):
        ahead = step.select(F.col("id").alias("cur"), F.col("neighbor").alias("nxt"))
        walk = walk.join(shuffled(ahead), "cur").filter(F.col("nxt") != F.col("prev")).groupBy("start", F.col("cur").alias("prev"), F.col("nxt").alias("cur")).agg(F.sum("n").alias("n"))
        found = found.unionByName(walk.select("start", "cur", F.lit(hop).alias("hops"), "n"))
    a = districts.select(F.col("plot_id").alias("start"), F.col("district").alias("d1"))
    b = districts.select(F.col("plot_id").alias("cur"), F.col("district").alias("d2"))
    both = found.join(shuffled(a), "start").join(shuffled(b), "cur").filter(F.col("d1") == F.col("d2"))
    return both.groupBy(F.col("start").alias("id1"), F.col("cur").alias("id2"), "hops").agg(F.sum("n").alias("paths"))


def location_dictionary(spark: SparkSession, parcels: DataFrame, prices: DataFrame, aliases: dict = C.LOCATION_ALIASES) -> DataFrame:
    """Names users may say: districts, cities, priced districts without parcels, aliases. The first source of an id wins."""
    districts = dominant_city(parcels).select(slug(F.col("district")).alias("id"), F.col("district").alias("canonical_name"), F.lit("egib").alias("source"), F.lit("district").alias("type"), F.col("district").alias("maps_to_district"), F.col("city").alias("maps_to_gmina"), F.lit(1).alias("priority"))
    cities = parcels.select("gmina").distinct().select(slug(F.col("gmina")).alias("id"), F.col("gmina").alias("canonical_name"), F.lit("egib").alias("source"), F.lit("city").alias("type"), F.lit(None).cast("string").alias("maps_to_district"), F.col("gmina").alias("maps_to_gmina"), F.lit(2).alias("priority"))
    priced = prices.select(slug(F.col("district")).alias("id"), F.col("district").alias("canonical_name"), F.lit("price_data").alias("source"), F.lit("district").alias("type"), F.lit(None).cast("string").alias("maps_to_district"), F.col("city").alias("maps_to_gmina"), F.lit(3).alias("priority"))
    alias_rows = spark.createDataFrame(
        [(i, n, "alias", "area" if city is None else "district", to, city, 4, search) for i, (n, to, city, search) in aliases.items()],
        "id string, canonical_name string, source string, type string, maps_to_district string, maps_to_gmina string, priority int, search_in array<string>",
    )
    names = districts.unionByName(cities).unionByName(priced).unionByName(alias_rows.drop("search_in"))
    w = Window.partitionBy("id").orderBy("priority", "maps_to_gmina", "canonical_name")
    first = names.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") == 1).drop("nth", "priority")
    update = F.broadcast(alias_rows.select("id", F.col("maps_to_district").alias("alias_to"), F.col("search_in")))
    first = first.join(update, "id", "left").withColumn("maps_to_district", F.coalesce("alias_to", "maps_to_district")).drop("alias_to")
    price = prices.select(F.col("city").alias("maps_to_gmina"), F.col("district").alias("canonical_name"), "price_min", "price_max", "segment")
    return first.join(price, ["maps_to_gmina", "canonical_name"], "left").withColumn("search_in", F.coalesce("search_in", F.array().cast("array<string>")))


def with_price_segment(parcels: DataFrame, prices: DataFrame) -> DataFrame:
    """Segment of the district; the first listed one where several cities share the name."""
    segments = prices.groupBy(F.col("district").alias("dzielnica")).agg(F.min_by("segment", "city").alias("price_segment"))
    return parcels.join(segments, "dzielnica", "left").withColumn("price_segment", F.coalesce("price_segment", F.lit("UNKNOWN")))


def near_named_poi(edges: DataFrame, parcels: DataFrame, poi: DataFrame, rel: str, text: str, max_distance: float) -> DataFrame:
    """Edges of one kind to points whose name contains the text, at most max_distance long."""
    named = poi.filter(F.lower("name").contains(text.lower())).select(F.col("poi_id").alias("dst"), "name")
    hits = edges.filter((F.col("rel") == rel) & (F.col("distance_m") <= max_distance))
    return hits.join(named, "dst").join(parcels.select(F.col("id_dzialki").alias("src")), "src").select("edge_id", F.col("src").alias("id_dzialki"), "name", "distance_m")
