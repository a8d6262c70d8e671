"""VEC: vector similarity and entity resolution."""
from pyspark.sql import functions as F

from hectara.catalog.key_joins import DOMINANT, _slug
from hectara.catalog.registry import query
from hectara.catalog.scoring import VECTOR_SQL
from hectara.catalog.texts import RAWLOC, _chain_sql, raw_locations
from hectara.functions import constants as C
from hectara.functions import scores as X
from hectara.functions import texts as T
from hectara.operators import similarity as V
from hectara.operators.relations import location_dictionary

DV = "CAST(embedding AS DOUBLE[])"


@query(
    "vec_01_similar_then_filter",
    f"""WITH q AS (SELECT {DV} AS v FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id, label, round(list_cosine_similarity({DV}, (SELECT v FROM q)), 9) AS similarity FROM embeddings)
        SELECT vec_id, label, similarity FROM n WHERE vec_id <> 0 AND label IN (1, 3, 5) ORDER BY similarity DESC, vec_id LIMIT 60""",
)
def similar_then_filter(t):
    e = t.raw("embeddings")
    return V.most_similar(e, "vec_id", "embedding", V.vector_of(e, "vec_id", 0, "embedding"), 120, 60, exclude=0, condition=F.col("label").isin(1, 3, 5)).select("vec_id", "label", "similarity")


@query(
    "vec_01_filter_then_rank",
    f"""WITH q AS (SELECT {DV} AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_cosine_similarity({DV}, (SELECT v FROM q)), 9) AS similarity FROM embeddings WHERE vec_id <> 0 AND label IN (1, 3, 5) ORDER BY similarity DESC, vec_id LIMIT 60""",
)
def filter_then_rank(t):
    e = t.raw("embeddings")
    return V.most_similar(e, "vec_id", "embedding", V.vector_of(e, "vec_id", 0, "embedding"), 61, 60, exclude=0, condition=F.col("label").isin(1, 3, 5), filter_first=True).select("vec_id", "label", "similarity")


_PREF = [0.9, 0.4, 0.2, 0.6]
_PV = [w * (1 if i % 2 == 0 else -1) * (1.0 - 0.1 * (i % 4)) for w in _PREF for i in range(8)]


@query(
    "vec_02_by_preferences",
    f"""WITH n AS (SELECT id_dzialki, gmina, area_m2, round(list_cosine_similarity([{", ".join(VECTOR_SQL)}], [{", ".join(f"{v:.17g}::DOUBLE" for v in _PV)}]), 9) AS similarity FROM parcels)
        SELECT id_dzialki, similarity FROM n WHERE area_m2 >= 500 AND area_m2 <= 6000 ORDER BY similarity DESC, id_dzialki LIMIT 50""",
)
def by_preferences(t):
    p = t("parcels").select("id_dzialki", "area_m2", X.feature_vector().alias("v"))
    return V.most_similar(p, "id_dzialki", "v", _PV, 100, 50, condition=F.col("area_m2").between(500, 6000)).select("id_dzialki", "similarity")


@query(
    "vec_03_by_graph_embedding",
    f"""WITH q AS (SELECT {DV} AS v FROM embeddings WHERE vec_id = 7), n AS (SELECT vec_id, round(list_cosine_similarity({DV}, (SELECT v FROM q)), 9) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 21) SELECT * FROM n WHERE vec_id <> 7""",
)
def by_graph_embedding(t):
    e = t.raw("embeddings")
    return V.most_similar(e, "vec_id", "embedding", V.vector_of(e, "vec_id", 7, "embedding"), 21, 20, exclude=7).select("vec_id", "similarity")


@query(
    "vec_04_vector_with_constraints",
    f"""WITH q AS (SELECT {DV} AS v FROM embeddings WHERE vec_id = 3), n AS (SELECT vec_id, round(list_cosine_similarity({DV}, (SELECT v FROM q)), 9) AS similarity FROM embeddings),
        c AS (SELECT p.id_dzialki, p.gmina, n.similarity FROM n JOIN parcels p ON p.pk = n.vec_id WHERE p.typ_wlasnosci = 'prywatna' AND NOT p.is_built AND p.dzielnica IS NOT NULL AND size_category IN ('pod_dom','duza')),
        s AS (SELECT src, count(DISTINCT dst) AS k, min(distance_m) AS d FROM edges WHERE rel = 'NEAR_SCHOOL' GROUP BY src)
        SELECT c.id_dzialki, c.gmina, c.similarity, coalesce(s.k, 0) AS schools_nearby, s.d AS nearest_school_m FROM c LEFT JOIN s ON s.src = c.id_dzialki ORDER BY similarity DESC, id_dzialki LIMIT 100""",
)
def vector_with_constraints(t):
    e = t.raw("embeddings")
    near = e.select(F.col("vec_id").alias("pk"), F.round(V.cosine(F.col("embedding"), V.vector_of(e, "vec_id", 3, "embedding")), 9).alias("similarity"))
    ok = (F.col("typ_wlasnosci") == "prywatna") & ~F.col("is_built") & F.col("dzielnica").isNotNull() & F.col("size_category").isin("pod_dom", "duza")
    found = t("parcels").filter(ok).select("pk", "id_dzialki", "gmina").join(near, "pk")
    schools = t("edges").filter(F.col("rel") == "NEAR_SCHOOL").groupBy(F.col("src").alias("id_dzialki")).agg(F.countDistinct("dst").alias("schools_nearby"), F.min("distance_m").alias("nearest_school_m"))
    out = found.join(schools, "id_dzialki", "left").na.fill(0, ["schools_nearby"])
    return out.orderBy(F.col("similarity").desc(), "id_dzialki").limit(100).drop("pk")


WORDS = "SELECT {k}, token, count(*) AS n FROM (SELECT {k}, unnest(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+')) AS token FROM {f}) WHERE token <> '' GROUP BY ALL"
QTEXT = "concat_ws(' ', 'działka w', gmina, quiet_cats, 'las i cisza', nature_cats, CASE WHEN search_id % 2 = 0 THEN 'budżet i szkoła' ELSE 'dane i sklep' END)"


@query(
    "vec_06_text_encoding",
    f"""WITH c AS ({WORDS.format(k='conv_id, turn', t='text', f='messages')}), n AS (SELECT conv_id, turn, sqrt(sum(n*n)) AS norm FROM c GROUP BY 1, 2) SELECT c.conv_id, c.turn, token, round(n / norm, 6) AS weight FROM c JOIN n ON c.conv_id = n.conv_id AND c.turn = n.turn""",
)
def text_encoding(t):
    return V.word_vectors(t("messages"), ["conv_id", "turn"], "text").withColumn("weight", F.round("weight", 6))


@query(
    "vec_06_text_similarity",
    f"""WITH c AS ({WORDS.format(k='conv_id, turn', t='text', f='messages')}), cn AS (SELECT conv_id, turn, sqrt(sum(n*n)) AS norm FROM c GROUP BY 1, 2),
        s AS (SELECT search_id, {QTEXT} AS q FROM searches), d AS ({WORDS.format(k='search_id', t='q', f='s')}), dn AS (SELECT search_id, sqrt(sum(n*n)) AS norm FROM d GROUP BY 1),
        p AS (SELECT c.conv_id, c.turn, d.search_id, round(sum(c.n*d.n)/any_value(cn.norm*dn.norm), 9) AS similarity FROM c JOIN d ON c.token = d.token JOIN cn ON c.conv_id = cn.conv_id AND c.turn = cn.turn JOIN dn ON d.search_id = dn.search_id GROUP BY 1, 2, 3)
        SELECT conv_id, turn, search_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, search_id) AS rn FROM p) WHERE rn = 1""",
)
def text_similarity(t):
    c = F.col
    q = F.concat_ws(" ", F.lit("działka w"), "gmina", "quiet_cats", F.lit("las i cisza"), "nature_cats", F.when(c("search_id") % 2 == 0, "budżet i szkoła").otherwise("dane i sklep"))
    right = V.word_vectors(t("searches").select("search_id", q.alias("q")), ["search_id"], "q")
    pairs = V.cosine_pairs(V.word_vectors(t("messages"), ["conv_id", "turn"], "text"), ["conv_id", "turn"], right, ["search_id"], "token")
    return V.best_matches(pairs, ["conv_id", "turn"], "search_id", 0.0, 1).select("conv_id", "turn", "search_id", F.round("similarity", 6).alias("similarity"))


@query(
    "vec_06_hashed_encoding",
    """WITH c AS (SELECT doc_id, CAST(('0x' || md5(word)[1:8])::BIGINT % 512 AS INT) AS place, count(*) AS n FROM
          (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2),
        r AS (SELECT place, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS rarity FROM c GROUP BY 1),
        w AS (SELECT doc_id, place, n * rarity AS w FROM c JOIN r USING (place))
        SELECT doc_id, place, round(coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), 0), 6) AS weight FROM w""",
)
def hashed_encoding(t):
    """Dense 512-number vectors of whole documents by the offline encoder, as rows."""
    return V.hashed_vectors(t.raw("documents").select("doc_id", "text"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def grams(source, key, text):
    padded = f"' ' || trim(lower({text})) || ' '"
    return f"""(SELECT k, gram, n / norm AS w FROM (SELECT k, gram, n, sqrt(sum(n*n) OVER (PARTITION BY k)) AS norm FROM (SELECT k, gram, count(*) AS n FROM
      (SELECT k, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))) AS gram FROM (SELECT DISTINCT {key} AS k, {padded} AS p FROM {source})) GROUP BY 1, 2)))"""


NAMES = f"(SELECT DISTINCT district AS name FROM ({DOMINANT}) UNION SELECT DISTINCT gmina FROM parcels UNION SELECT DISTINCT district FROM prices UNION SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in dict.fromkeys(v[0] for v in C.LOCATION_ALIASES.values())) + "))"


@query(
    "vec_07_resolve_location",
    f"""WITH r AS (SELECT id_dzialki, {RAWLOC} AS raw FROM parcels), c AS ({_chain_sql()}), m AS (SELECT DISTINCT c AS mention FROM c), g AS {grams('m', 'mention', 'mention')}, h AS {grams(NAMES, 'name', 'name')},
        p AS (SELECT g.k AS mention, h.k AS name, round(sum(g.w*h.w), 9) AS similarity FROM g JOIN h ON g.gram = h.gram GROUP BY 1, 2),
        t AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY similarity DESC, name) AS rn FROM p WHERE similarity >= 0.7e0)
        SELECT mention, max(name) FILTER (rn = 1) AS best, round(max(similarity), 6) AS similarity, coalesce(string_agg(name, '|' ORDER BY rn) FILTER (rn > 1), '') AS alternatives,
          CASE WHEN max(similarity) > 0.9e0 THEN 'HIGH' WHEN max(similarity) > 0.8e0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM t WHERE rn <= 3 GROUP BY mention""",
)
def resolve_location(t):
    from hectara.functions.labels import confidence_band

    mentions = raw_locations(t).select(T.clean_location(F.col("raw")).alias("mention"))
    names = location_dictionary(t.spark, t("parcels"), t("prices"))
    r = V.resolve_names(mentions, "mention", names, "canonical_name")
    return r.select("mention", "best", F.round("similarity", 6).alias("similarity"), F.array_join("alternatives", "|").alias("alternatives"), confidence_band(F.col("similarity")).alias("confidence"))


CATS = "(SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{k}', '{n}', '{'|'.join(m)}')" for i, k, n, _, m in C.CATEGORY_NAMES) + ") v(id, kind, name, maps_to))"


@query(
    "vec_08_resolve_category",
    f"""WITH m AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS mention FROM messages), mm AS (SELECT mention FROM m WHERE mention <> ''), g AS {grams('mm', 'mention', 'mention')}, v AS {CATS},
        h AS {grams("v", "id || '#' || kind", 'name')},
        p AS (SELECT g.k AS mention, split_part(h.k, '#', 1) AS id, split_part(h.k, '#', 2) AS kind, round(sum(g.w*h.w), 9) AS similarity FROM g JOIN h ON g.gram = h.gram GROUP BY 1, 2, 3),
        a AS (SELECT *, row_number() OVER (PARTITION BY mention, kind ORDER BY similarity DESC, id) AS rn FROM p),
        f AS (SELECT *, row_number() OVER (PARTITION BY mention, kind ORDER BY rn) AS pos FROM a WHERE rn <= 3 AND ((kind = 'nature' AND similarity >= 0.6e0) OR (kind IN ('water','poi') AND similarity >= 0.5e0)))
        SELECT f.mention, f.kind, f.id, round(similarity, 6) AS similarity, v.maps_to FROM f JOIN v ON f.id = v.id AND f.kind = v.kind WHERE pos = 1""",
)
def resolve_category(t):
    words = t("messages").select(F.explode(F.split(F.lower("text"), V.TOKEN_SPLIT)).alias("mention")).filter("mention <> ''")
    out = None
    for kind in ("nature", "water", "poi"):
        r = V.resolve_categories(words, "mention", t.spark, kind).select("mention", F.lit(kind).alias("kind"), "id", F.round("similarity", 6).alias("similarity"), F.array_join("maps_to", "|").alias("maps_to"))
        out = r if out is None else out.unionByName(r)
    return out


@query(
    "vec_09_variant_mentions",
    "WITH m AS (SELECT lower(text) AS c FROM messages), v AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{k}', '{w}')" for i, k, _, ws, _ in C.CATEGORY_NAMES for w in ws) + ") v(id, kind, variant)) SELECT id, kind, variant, count(*) AS n FROM m JOIN v ON contains(c, lower(variant)) GROUP BY ALL",
)
def variant_mentions(t):
    return V.variant_mentions(t("messages"), "text")
