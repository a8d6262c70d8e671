"""MAT: name matching cascade."""
from pyspark.sql import functions as F

from hectara.catalog.key_joins import DOMINANT
from hectara.catalog.registry import query
from hectara.catalog.texts import RAWLOC, _chain_sql, raw_locations
from hectara.catalog.vectors import grams
from hectara.functions import constants as C
from hectara.operators import matching as M
from hectara.operators import search as S

TYPED = "CASE pk % 4 WHEN 0 THEN lower(gmina) WHEN 1 THEN substr(dzielnica, 2, 5) WHEN 2 THEN concat(substr(dzielnica, 1, 3), substr(dzielnica, 5)) ELSE concat(substr(gmina, 1, 3), substr(gmina, 5)) END"
PLACES_SQL = """(SELECT level, name, parent, count(*) AS n, lower(name) AS k FROM (SELECT 'dzielnica' AS level, dzielnica AS name, gmina AS parent FROM parcels WHERE dzielnica IS NOT NULL UNION ALL SELECT 'gmina', gmina, powiat FROM parcels
   UNION ALL SELECT 'powiat', powiat, wojewodztwo FROM parcels UNION ALL SELECT 'wojewodztwo', wojewodztwo, NULL FROM parcels) GROUP BY 1, 2, 3)"""


def typed(t):
    k, d, g = F.col("pk"), F.col("dzielnica"), F.col("gmina")
    text = (
        F.when(k % 4 == 0, F.lower(g)).when(k % 4 == 1, F.substring(d, 2, 5)).when(k % 4 == 2, F.concat(F.substring(d, 1, 3), F.substring(d, 5, 100)))
        .otherwise(F.concat(F.substring(g, 1, 3), F.substring(g, 5, 100)))
    )
    return t("parcels").select(text.alias("typed")).filter(F.col("typed").isNotNull()).distinct()


@query(
    "mat_01_search_places",
    f"""WITH q AS (SELECT DISTINCT lower(trim(x)) AS q FROM (SELECT {TYPED} AS x FROM parcels) WHERE trim(x) <> ''), pl AS {PLACES_SQL}, d AS (SELECT * FROM pl WHERE level = 'dzielnica'), dk AS (SELECT DISTINCT k FROM d),
        s1 AS (SELECT q, 1 AS stage, pl.*, 1e0 AS score FROM q JOIN pl ON q = k), o2 AS (SELECT q FROM q WHERE q NOT IN (SELECT q FROM s1)),
        s2 AS (SELECT q, 2 AS stage, d.*, 1e0 AS score FROM o2 JOIN d ON contains(k, q) OR contains(q, k)), o3 AS (SELECT q FROM o2 WHERE q NOT IN (SELECT q FROM s2)),
        s3 AS (SELECT * FROM (SELECT q, 3 AS stage, d.*, round(1 - levenshtein(q, k) / greatest(length(q), length(k)), 9) AS score FROM o3 CROSS JOIN d) WHERE score > 0.5e0), o4 AS (SELECT q FROM o3 WHERE q NOT IN (SELECT q FROM s3)),
        ga AS {grams('o4', 'q', 'q')}, gb AS {grams('pl', 'k', 'k')}, sm AS (SELECT ga.k AS q, gb.k AS key, round(sum(ga.w*gb.w), 9) AS score FROM ga JOIN gb ON ga.gram = gb.gram GROUP BY 1, 2),
        s4 AS (SELECT sm.q, 4 AS stage, pl.*, sm.score FROM sm JOIN pl ON sm.key = pl.k WHERE sm.score >= 0.7e0),
        al AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)
        SELECT q, stage, level, name, parent, n, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n DESC, level, name, parent NULLS FIRST) AS rank FROM al) WHERE rank <= 20""",
)
def search_places(t):
    return M.search_places(typed(t), "typed", M.place_names(t("parcels"))).withColumn("score", F.round("score", 6))


@query(
    "mat_02_resolve_place",
    f"""WITH r AS (SELECT id_dzialki, {RAWLOC} AS raw FROM parcels WHERE pk % 2 = 0 UNION ALL SELECT id_dzialki, 'okolice ' || {TYPED} FROM parcels WHERE pk % 2 = 1), c AS (SELECT r.raw, c.c AS cleaned FROM ({_chain_sql()}) c JOIN r ON r.id_dzialki = c.id_dzialki WHERE r.raw IS NOT NULL),
        v0 AS (SELECT DISTINCT raw, list_filter([cleaned, CASE WHEN ends_with(cleaned,'a') THEN cleaned[:-2] END, CASE WHEN ends_with(cleaned,'i') THEN cleaned[:-2] || 'a' END, CASE WHEN ends_with(cleaned,'u') THEN cleaned[:-2] END, CASE WHEN ends_with(cleaned,'ej') THEN cleaned[:-3] || 'a' END], lambda x: x IS NOT NULL) AS vs FROM c),
        v AS (SELECT raw, unnest(range(len(vs))) AS vi, unnest(vs) AS term FROM v0), h AS (SELECT lower(district) AS k, district, city FROM ({DOMINANT})),
        a AS (SELECT raw, 1 AS step, city AS gmina, district AS dzielnica, row_number() OVER (PARTITION BY raw ORDER BY vi, round(1 - levenshtein(term, k) / greatest(length(term), length(k)), 9) DESC, district) AS rn FROM v CROSS JOIN h WHERE 1 - levenshtein(term, k) / greatest(length(term), length(k)) > 0.5e0),
        ct AS (SELECT DISTINCT gmina FROM parcels), b AS (SELECT raw, 2 AS step, gmina, NULL AS dzielnica, row_number() OVER (PARTITION BY raw ORDER BY vi, gmina) AS rn FROM v JOIN ct ON contains(lower(gmina), term) OR contains(term, lower(gmina))),
        ar AS (SELECT dzielnica, gmina, count(*) AS n FROM parcels WHERE dzielnica IS NOT NULL GROUP BY 1, 2),
        cc AS (SELECT raw, 3 AS step, gmina, dzielnica, row_number() OVER (PARTITION BY raw ORDER BY vi, n DESC, dzielnica, gmina) AS rn FROM v JOIN ar ON contains(lower(dzielnica), term)),
        al AS (SELECT * FROM a WHERE rn = 1 UNION ALL SELECT * FROM b WHERE rn = 1 UNION ALL SELECT * FROM cc WHERE rn = 1), f AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY step) AS k FROM al)
        SELECT q.raw, f.step, f.gmina, f.dzielnica FROM (SELECT DISTINCT raw FROM v) q LEFT JOIN f ON q.raw = f.raw AND f.k = 1""",
)
def resolve_place(t):
    even = raw_locations(t).join(t("parcels").filter("pk % 2 = 0").select("id_dzialki"), "id_dzialki", "left_semi").select("raw")
    odd = t("parcels").filter("pk % 2 = 1").selectExpr(f"concat('okolice ', {TYPED}) AS raw").filter("raw IS NOT NULL")
    return M.resolve_place(even.unionByName(odd), "raw", t("parcels"))


@query(
    "mat_03_validate",
    f"""WITH p AS (SELECT DISTINCT gmina AS miejscowosc, CASE WHEN pk % 3 = 0 THEN concat(substr(dzielnica, 1, 4), 'X') ELSE dzielnica END AS dzielnica FROM parcels WHERE dzielnica IS NOT NULL), h AS (SELECT lower(district) AS k, district, city FROM ({DOMINANT})),
        s AS (SELECT pre, string_agg(district, '|' ORDER BY district) AS suggestions FROM (SELECT pre, district, row_number() OVER (PARTITION BY pre ORDER BY district) AS rn FROM (SELECT DISTINCT lower(substr(dzielnica,1,3)) AS pre FROM p) JOIN h ON contains(k, pre)) WHERE rn <= 3 GROUP BY pre)
        SELECT p.miejscowosc, p.dzielnica, CASE WHEN h.k IS NULL THEN 'unknown' WHEN lower(miejscowosc) <> lower(city) THEN 'mismatch' ELSE 'valid' END AS verdict, city AS actual, CASE WHEN h.k IS NULL THEN coalesce(suggestions, '') ELSE '' END AS suggestions
        FROM p LEFT JOIN h ON lower(p.dzielnica) = h.k LEFT JOIN s ON s.pre = lower(substr(p.dzielnica,1,3))""",
)
def validate(t):
    d = F.when(F.col("pk") % 3 == 0, F.concat(F.substring("dzielnica", 1, 4), F.lit("X"))).otherwise(F.col("dzielnica"))
    pairs = t("parcels").filter(F.col("dzielnica").isNotNull()).select(F.col("gmina").alias("miejscowosc"), d.alias("dzielnica"))
    return M.validate_places(pairs, t("parcels"))


@query(
    "mat_04_confirm",
    "SELECT gmina, dzielnica, count(*) AS parcels, round(avg(centroid_lat),6) AS lat, round(avg(centroid_lon),6) AS lon FROM parcels WHERE dzielnica IS NOT NULL GROUP BY 1, 2",
)
def confirm(t):
    return S.location_centres(t("parcels").filter(F.col("dzielnica").isNotNull()), ["gmina", "dzielnica"], True).drop("radius_m")


@query(
    "mat_05_city_of",
    f"""WITH n AS (SELECT DISTINCT CASE pk % 3 WHEN 0 THEN lower(gmina) WHEN 1 THEN dzielnica ELSE concat('Obce ', gmina) END AS name FROM parcels), h AS (SELECT lower(district) AS k, min(city) AS city FROM ({DOMINANT}) GROUP BY 1), m AS (SELECT lower(miejscowosc) AS k, min(gmina) AS g FROM parcels GROUP BY 1)
        SELECT name, coalesce(m.g, h.city, name) AS gmina FROM n LEFT JOIN m ON m.k = lower(name) LEFT JOIN h ON h.k = lower(name)""",
)
def city_of(t):
    k = F.col("pk") % 3
    names = t("parcels").select(F.when(k == 0, F.lower("gmina")).when(k == 1, F.col("dzielnica")).otherwise(F.concat(F.lit("Obce "), "gmina")).alias("name"))
    return M.city_of(names, "name", t("parcels"))


ALIASES = list(C.DISTRICT_ALIASES)


@query(
    "mat_06_aliases",
    "WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{g}', '{'|'.join(s or [])}', '{note}')" for n, (g, s, note) in C.DISTRICT_ALIASES.items())
    + ") v(name, city, search_in, note)), m AS (SELECT conv_id, turn, lower(text) || ' ' || CASE (conv_id + turn) % 14 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ALIASES)) + " ELSE '' END AS c FROM messages) "
    "SELECT conv_id, turn, name, city, note, CASE WHEN search_in = '' THEN NULL ELSE unnest(string_split(search_in, '|')) END AS district FROM m JOIN a ON contains(c, name)",
)
def aliases(t):
    """Unofficial names in messages and the districts to search instead."""
    extra = F.element_at(F.array(*[F.lit(n) for n in ALIASES], F.lit(""), F.lit(""), F.lit("")), ((F.col("conv_id") + F.col("turn")) % 14 + 1).cast("int"))
    text = F.concat(F.lower("text"), F.lit(" "), extra)
    return M.alias_mentions(t("messages").withColumn("c", text), "c").select("conv_id", "turn", "name", "city", "note", "district")
