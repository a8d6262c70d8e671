"""GRF: graph assembly, embedding and checks."""
from pyspark.sql import functions as F

from hectara.catalog.key_joins import BRICK_PAIRS, DOMINANT, EDGE_SQL, PROFILES, ZONE_EDGE, brick_pairs
from hectara.catalog.registry import query
from hectara.operators import graph as G
from hectara.operators.relations import location_dictionary
from hectara.operators.similarity import nearest_for_each
from hectara.plans.testbed import ORACLE_TEXT

ALL_EDGES = f"""{EDGE_SQL} UNION ALL SELECT id_dzialki, dzielnica, 'LOCATED_IN' FROM parcels WHERE dzielnica IS NOT NULL UNION ALL SELECT district, city, 'BELONGS_TO' FROM ({DOMINANT})
  UNION ALL SELECT src, CAST(dst AS VARCHAR), 'HAS_POG' FROM ({ZONE_EDGE}) UNION ALL SELECT CAST(zone_id AS VARCHAR), profile, CASE WHEN secondary THEN 'ALLOWS_SECONDARY' ELSE 'ALLOWS' END FROM ({PROFILES})"""
KIND = "CASE rel " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in G.CATEGORY_TYPES.items()) + " END"
ALL_NODES = f"""SELECT id_dzialki AS id, 'Parcel' AS type FROM parcels UNION ALL SELECT DISTINCT gmina, 'City' FROM parcels UNION ALL SELECT DISTINCT dzielnica, 'District' FROM parcels WHERE dzielnica IS NOT NULL
  UNION ALL SELECT CAST(zone_id AS VARCHAR), 'Zone' FROM zones UNION ALL SELECT DISTINCT profile, 'Profile' FROM ({PROFILES}) UNION ALL SELECT CAST(poi_id AS VARCHAR), 'Poi:' || type FROM poi
  UNION ALL SELECT DISTINCT dst, {KIND} FROM ({EDGE_SQL})"""


@query("grf_01_vertices", ALL_NODES)
def vertices(t):
    return G.vertices(t("parcels"), t("zones"), t("poi"))


@query("grf_01_edges", ALL_EDGES)
def edges(t):
    return G.edges(t("parcels"), t("zones"))


@query(
    "grf_01_measured_edges",
    f"""SELECT src, CAST(dst AS VARCHAR) AS dst, rel, round(CAST(distance_m AS DOUBLE), 2) AS meters FROM edges UNION ALL SELECT CAST(id1 AS VARCHAR), CAST(id2 AS VARCHAR), 'ADJACENT_TO', round(border, 2) FROM ({BRICK_PAIRS})
        UNION ALL SELECT DISTINCT district, segment, 'IN_PRICE_SEGMENT', NULL FROM prices WHERE segment IS NOT NULL""",
)
def measured_edges(t):
    return G.measured_edges(t("edges"), brick_pairs(t), t("prices")).withColumn("meters", F.round("meters", 2))


NAMES_SQL = f"({ORACLE_TEXT['join_26_location_dictionary']})"


@query("grf_01_name_edges", f"SELECT id AS src, maps_to_district AS dst, 'MAPS_TO' AS rel FROM {NAMES_SQL} WHERE maps_to_district IS NOT NULL UNION SELECT id, maps_to_gmina, 'MAPS_TO' FROM {NAMES_SQL} WHERE maps_to_gmina IS NOT NULL")
def name_edges(t):
    return G.name_edges(location_dictionary(t.spark, t("parcels"), t("prices")))


@query("grf_01_name_vertices", f"SELECT DISTINCT id, 'LocationName' AS type FROM {NAMES_SQL} UNION ALL SELECT DISTINCT segment, 'PriceSegment' FROM prices WHERE segment IS NOT NULL")
def name_vertices(t):
    return G.name_vertices(location_dictionary(t.spark, t("parcels"), t("prices")), t("prices"))


def embedding_sql(dimension=G.DIMENSION, weights=G.ITERATION_WEIGHTS, seed=G.SEED):
    """Common tables that end in total(id, d, v): the node embedding one number a row."""
    rels = ", ".join(f"'{r}'" for r in G.EMBEDDING_RELATIONS)
    out = [f"l AS MATERIALIZED (SELECT src AS item, rel || ':' || dst AS node FROM ({ALL_EDGES}) WHERE rel IN ({rels}))"]

    def unit(name, key, rows):
        return f"{name} AS MATERIALIZED (SELECT {key}, d, CASE WHEN q > 0 THEN v / q ELSE v END AS v FROM (SELECT {key}, d, v, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS q FROM ({rows})))"

    for name, key in (("i0", "item"), ("n0", "node")):
        draw = f"CAST('0x' || substr(md5({key} || '|' || (d // 8) || '|{seed}'), (d % 8) * 4 + 1, 4) AS INT) % 6"
        out.append(unit(name, key, f"SELECT {key}, d, CASE {draw} WHEN 0 THEN sqrt(3.0::DOUBLE) WHEN 1 THEN -sqrt(3.0::DOUBLE) ELSE 0.0::DOUBLE END AS v FROM (SELECT DISTINCT {key} FROM l), (SELECT unnest(range({dimension})) AS d)"))
    for n in range(len(weights)):
        out.append(unit(f"i{n + 1}", "item", f"SELECT item, d, avg(v) AS v FROM l JOIN n{n} USING (node) GROUP BY item, d"))
        out.append(unit(f"n{n + 1}", "node", f"SELECT node, d, avg(v) AS v FROM l JOIN i{n} USING (item) GROUP BY node, d"))
    parts = " UNION ALL ".join(f"SELECT item, d, v * {w} AS v FROM i{n}" for n, w in enumerate(weights, 1) if w)
    out.append(f"total AS MATERIALIZED (SELECT item AS id, d, sum(v) AS v FROM ({parts}) GROUP BY item, d)")
    return ", ".join(out)


def linked(t):
    return G.edges(t("parcels"), t("zones")).filter(F.col("rel").isin(G.EMBEDDING_RELATIONS))


def embedded(t):
    return G.node_embedding(linked(t))


@query(
    "grf_02_node_embedding",
    f"""WITH {embedding_sql()} SELECT id, count(*) AS dims, round(sum(v * v), 6) AS norm2, string_agg(CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY d) AS millionths FROM total GROUP BY id""",
)
def node_embedding(t):
    numbers = F.transform("embedding", lambda v: F.round(v * 1_000_000).cast("bigint").cast("string"))
    norm2 = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6)
    return embedded(t).select("id", F.size("embedding").cast("bigint").alias("dims"), norm2.alias("norm2"), F.concat_ws(",", numbers).alias("millionths"))


@query(
    "vec_03_by_node_embedding",
    f"""WITH {embedding_sql()}, e AS MATERIALIZED (SELECT id, list(v ORDER BY d) AS v FROM total GROUP BY id), q AS (SELECT * FROM e WHERE id IN (SELECT parcel_id FROM feedback WHERE action = 'favorite')),
        s AS (SELECT q.id, e.id AS neighbour, round(list_cosine_similarity(q.v, e.v), 9) AS similarity FROM q JOIN e ON q.id <> e.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM s) SELECT id, rank, neighbour, similarity FROM r WHERE rank <= 10""",
)
def by_node_embedding(t):
    """Ten parcels most like each favourite by the node embedding, all favourites in one job."""
    favourites = t("feedback").filter(F.col("action") == "favorite").select(F.col("parcel_id").alias("id"))
    kinds, vectors = G.kind_embedding(linked(t))
    return nearest_for_each(vectors, "id", "embedding", favourites, 10, members=kinds)


@query(
    "grf_03_pattern",
    "SELECT id_dzialki, dzielnica, quietness_score FROM parcels WHERE gmina = 'NATION_5' AND kategoria_ciszy IN ('cicha','bardzo_cicha') AND is_residential_zone AND size_category IN ('pod_dom','duza') ORDER BY quietness_score DESC, id_dzialki LIMIT 20",
)
def pattern(t):
    """A star pattern over the edge table: each branch keeps the parcels that have the relation."""
    e = G.edges(t("parcels"), t("zones"))
    df = t("parcels").filter((F.col("gmina") == "NATION_5") & F.col("is_residential_zone")).select("id_dzialki", "dzielnica", "quietness_score")
    for rel, values in (("HAS_QUIETNESS", ["cicha", "bardzo_cicha"]), ("HAS_SIZE", ["pod_dom", "duza"])):
        df = df.join(e.filter((F.col("rel") == rel) & F.col("dst").isin(values)).select(F.col("src").alias("id_dzialki")), "id_dzialki", "left_semi")
    return df.orderBy(F.col("quietness_score").desc(), "id_dzialki").limit(20)


@query(
    "grf_04_integrity",
    f"""SELECT 'nodes' AS what, type AS name, count(*) AS n FROM ({ALL_NODES}) GROUP BY type UNION ALL SELECT 'edges', rel, count(*) FROM ({ALL_EDGES}) GROUP BY rel
        UNION ALL SELECT 'isolated', 'without zone', count(*) FROM parcels WHERE id_dzialki NOT IN (SELECT src FROM ({ZONE_EDGE}))""",
)
def integrity(t):
    return G.integrity(t("parcels"), t("zones"), t("poi"))
