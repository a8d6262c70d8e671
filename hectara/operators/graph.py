"""The property graph as vertices and edges tables, and its node embedding."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hectara.operators.relations import category_edges, dominant_city, profile_edges, zone_edges
from hectara.session import cut_lineage, shuffled, sized_broadcast

CATEGORY_TYPES = {
    "HAS_OWNERSHIP": "OwnershipType", "HAS_OWNER_GROUP": "OwnershipGroup", "HAS_BUILD_STATUS": "BuildStatus", "HAS_BUILDING_FUNCTION": "BuildingFunction",
    "HAS_BUILDING_TYPE": "BuildingType", "HAS_SIZE": "SizeCategory", "HAS_QUIETNESS": "QuietnessCategory", "HAS_NATURE": "NatureCategory",
    "HAS_ACCESS": "AccessCategory", "HAS_DENSITY": "DensityCategory", "NEAREST_WATER_TYPE": "WaterType",
}


def vertices(parcels: DataFrame, zones: DataFrame, poi: DataFrame) -> DataFrame:
    """id and type of every node."""
    kind = F.create_map([F.lit(v) for pair in CATEGORY_TYPES.items() for v in pair])[F.col("rel")]
    parts = [
        parcels.select(F.col("id_dzialki").alias("id"), F.lit("Parcel").alias("type")),
        parcels.select("gmina").distinct().select(F.col("gmina").alias("id"), F.lit("City").alias("type")),
        dominant_city(parcels).select(F.col("district").alias("id"), F.lit("District").alias("type")),
        zones.select(F.col("zone_id").cast("string").alias("id"), F.lit("Zone").alias("type")),
        profile_edges(zones).select("profile").distinct().select(F.col("profile").alias("id"), F.lit("Profile").alias("type")),
        poi.select(F.col("poi_id").cast("string").alias("id"), F.concat(F.lit("Poi:"), "type").alias("type")),
        category_edges(parcels).select("dst", kind.alias("type")).distinct().select(F.col("dst").alias("id"), "type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    """src, dst, rel of the relations that follow from the tables alone; spatial edges are added by their own joins."""
    located = parcels.filter(F.col("dzielnica").isNotNull()).select(F.col("id_dzialki").alias("src"), F.col("dzielnica").alias("dst"), F.lit("LOCATED_IN").alias("rel"))
    belongs = dominant_city(parcels).select(F.col("district").alias("src"), F.col("city").alias("dst"), F.lit("BELONGS_TO").alias("rel"))
    zone = zone_edges(parcels, zones).withColumn("dst", F.col("dst").cast("string"))
    profile = profile_edges(zones).select(F.col("zone_id").cast("string").alias("src"), F.col("profile").alias("dst"), F.when(F.col("secondary"), "ALLOWS_SECONDARY").otherwise("ALLOWS").alias("rel"))
    return category_edges(parcels).unionByName(located).unionByName(belongs).unionByName(zone).unionByName(profile)


def measured_edges(near: DataFrame, pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """src, dst, rel and meters of the relations that joins have measured: NEAR_* (src, dst, rel, distance_m), ADJACENT_TO with the common border
    (id1, id2, shared_border_m), once a pair, and the price segment of each district, without meters."""
    none = F.lit(None).cast("double")
    close = near.select("src", F.col("dst").cast("string").alias("dst"), "rel", F.col("distance_m").cast("double").alias("meters"))
    touching = pairs.select(F.col("id1").cast("string").alias("src"), F.col("id2").cast("string").alias("dst"), F.lit("ADJACENT_TO").alias("rel"), F.col("shared_border_m").alias("meters"))
    priced = prices.filter(F.col("segment").isNotNull()).select(F.col("district").alias("src"), F.col("segment").alias("dst"), F.lit("IN_PRICE_SEGMENT").alias("rel"), none.alias("meters")).distinct()
    return close.unionByName(touching).unionByName(priced)


def name_edges(names: DataFrame) -> DataFrame:
    """MAPS_TO from the names of a location dictionary (id, maps_to_district, maps_to_gmina) to their district and city."""
    targets = F.array_compact(F.array("maps_to_district", "maps_to_gmina"))
    return names.select(F.col("id").alias("src"), F.explode(targets).alias("dst"), F.lit("MAPS_TO").alias("rel")).distinct()


def name_vertices(names: DataFrame, prices: DataFrame) -> DataFrame:
    """id and type of location names and price segments."""
    segments = prices.filter(F.col("segment").isNotNull()).select(F.col("segment").alias("id"), F.lit("PriceSegment").alias("type")).distinct()
    return names.select("id", F.lit("LocationName").alias("type")).distinct().unionByName(segments)


# Relations of the embedding graph, iteration weights, seed and size.
EMBEDDING_RELATIONS = ["LOCATED_IN", "HAS_QUIETNESS", "HAS_NATURE", "HAS_SIZE", "HAS_OWNERSHIP", "HAS_BUILD_STATUS"]
ITERATION_WEIGHTS = [0.0, 1.0, 1.0, 0.5, 0.25]
SEED, DIMENSION = 42, 256
BROADCAST_BYTES = 32 << 20  # of node vectors


def node_embedding(graph: DataFrame, dimension: int = DIMENSION, weights: list[float] = ITERATION_WEIGHTS, seed: int = SEED) -> DataFrame:
    """id and embedding of every item of `kind_embedding`."""
    kinds, vectors = kind_embedding(graph, dimension, weights, seed)
    return kinds.join(shuffled(vectors), "kind").select("id", "embedding")


def kind_embedding(graph: DataFrame, dimension: int = DIMENSION, weights: list[float] = ITERATION_WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """id and kind of every item, and kind and embedding of every kind: fast random projection over an undirected graph whose edges run from many items to few shared nodes.

    Every node starts from a seeded sparse random vector; each round averages the neighbours' unit
    vectors, and the result is the weighted sum of the rounds. Edges carry src (item), dst (node).
    Items linked to the same nodes get the same vectors in every round, so the rounds run on one row for each such kind,
    weighted by its items; only the start of the items and the result are per item.
    Averages run as JVM vector summaries with partial sums, so a node linked to a third of all
    items is not gathered; the shared nodes' vectors are broadcast when counted to be at most BROADCAST_BYTES.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    links = cut_lineage(graph.select(F.col("src").alias("item"), F.concat_ws(":", "rel", "dst").alias("node")))
    root = 3.0**0.5

    def start(df: DataFrame, key: str, *beside: str) -> DataFrame:
        # Eight draws of 16 bits from each md5, which other engines can repeat.
        blocks = F.transform(F.sequence(F.lit(0), F.lit((dimension - 1) // 8)), lambda b: F.md5(F.concat_ws("|", F.col(key), b, F.lit(seed))))
        bits = F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(h, i * 4 + 1, F.lit(4)))))
        draw = F.transform(F.slice(bits, 1, dimension), lambda v: F.conv(v, 16, 10).cast("int") % 6)
        return df.select(key, *beside, F.transform(draw, lambda d: F.when(d == 0, root).when(d == 1, -root).otherwise(0.0)).alias("vec"))

    def unit(df: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
        df = df.withColumn("_n", norm)
        return df.select(*[c for c in df.columns if c not in ("vec", "_n")], F.when(F.col("_n") > 0, F.transform("vec", lambda v: v / F.col("_n"))).otherwise(F.col("vec")).alias("vec"))

    def mean(met: DataFrame, key: str) -> DataFrame:
        return met.groupBy(key).agg(Summarizer.mean(array_to_vector("vec"), F.col("n").cast("double")).alias("m")).select(key, vector_to_array("m").alias("vec"))

    kinds = cut_lineage(links.groupBy("item").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("node"))), 256).alias("kind")))
    sizes = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item"))
    steps = cut_lineage(links.join(shuffled(sizes), "item").select("kind", "node", "n"))

    def average(sources: DataFrame, from_key: str, to_key: str) -> DataFrame:
        return mean(steps.join(sized_broadcast(sources, BROADCAST_BYTES // (8 * dimension)), from_key), to_key)

    nodes = unit(start(links.select("node").distinct(), "node"))
    # Members differ in their start only: their mean stands for all of a kind.
    members = mean(unit(start(kinds, "item", "kind")).withColumn("n", F.lit(1)), "kind")
    total = None
    for weight in weights:
        new_members = cut_lineage(unit(average(nodes, "node", "kind")))
        nodes = unit(average(members, "kind", "node"))
        members = new_members
        if weight:
            part = members.select("kind", F.transform("vec", lambda v: v * F.lit(weight)).alias("part"))
            total = part if total is None else cut_lineage(total.join(shuffled(part.withColumnRenamed("part", "more")), "kind").select("kind", F.zip_with("part", "more", lambda a, b: a + b).alias("part")))
    return kinds.select(F.col("item").alias("id"), "kind"), total.withColumnRenamed("part", "embedding")


def integrity(parcels: DataFrame, zones: DataFrame, poi: DataFrame) -> DataFrame:
    """Nodes per type, edges per relation, and parcels without any relation."""
    count = F.count(F.lit(1)).alias("n")
    e = edges(parcels, zones)
    v = vertices(parcels, zones, poi).groupBy(F.col("type").alias("name")).agg(count).withColumn("what", F.lit("nodes"))
    r = e.groupBy(F.col("rel").alias("name")).agg(count).withColumn("what", F.lit("edges"))
    zoned = e.filter(F.col("rel") == "HAS_POG").select(F.col("src").alias("id_dzialki"))
    lonely = parcels.select("id_dzialki").join(zoned, "id_dzialki", "left_anti").agg(count).select(F.lit("without zone").alias("name"), "n", F.lit("isolated").alias("what"))
    return v.unionByName(r).unionByName(lonely)
