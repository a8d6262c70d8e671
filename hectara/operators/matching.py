"""Name matching: containment by leading characters, likeness by the joins of text_joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hectara.operators.text_joins import cosine_at_least, similar_pairs
from hectara.session import cut_lineage


def contains_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Rows of `needles` (column needle) with the rows of `hays` (column hay) that contain the needle.

    Both meet on the first up to three characters of the needle, then the full test runs.
    """
    keyed = needles.filter(F.length("needle") > 0).withColumn("gram", F.substring("needle", 1, 3))
    n = F.length("hay")
    grams = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(F.col("hay"), i, size))).otherwise(F.array().cast("array<string>"))))
    spread = hays.withColumn("gram", F.explode(F.array_distinct(grams)))
    return keyed.join(spread, "gram").filter(F.col("hay").contains(F.col("needle"))).drop("gram")


def place_names(parcels: DataFrame) -> DataFrame:
    """Every administrative name with its level, parent and number of parcels."""
    levels = F.array(
        *[F.struct(F.lit(lv).alias("level"), F.col(c).alias("name"), F.col(p).alias("parent")) for lv, c, p in (("dzielnica", "dzielnica", "gmina"), ("gmina", "gmina", "powiat"), ("powiat", "powiat", "wojewodztwo"))],
        F.struct(F.lit("wojewodztwo").alias("level"), F.col("wojewodztwo").alias("name"), F.lit(None).cast("string").alias("parent")),
    )
    return parcels.select(F.inline(levels)).filter(F.col("name").isNotNull()).groupBy("level", "name", "parent").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.lower("name"))


MAX_RESULTS = 20


def search_places(queries: DataFrame, query: str, names: DataFrame, keep: int = MAX_RESULTS) -> DataFrame:
    """Exact name on any level, else a district containing the text or contained in it, else a similarly
    spelt district, else the nearest names by letter groups. A query moves on only while it has no hit."""
    from hectara.operators.similarity import name_grams

    names = cut_lineage(names)
    q = cut_lineage(queries.select(F.lower(F.trim(query)).alias("q")).filter("q <> ''").distinct())
    districts = names.filter(F.col("level") == "dzielnica")
    keys = districts.select("key").distinct()
    exact = q.join(names, q["q"] == names["key"]).select("q", F.lit(1).alias("stage"), "level", "name", "parent", "n", F.lit(1.0).alias("score"))

    def with_rows(pairs: DataFrame, stage: int, rows: DataFrame) -> DataFrame:
        return pairs.join(rows, "key").select("q", F.lit(stage).alias("stage"), "level", "name", "parent", "n", F.round("score", 9).alias("score"))

    open_q = cut_lineage(q.join(exact.select("q"), "q", "left_anti"))
    inside = contains_pairs(open_q.select(F.col("q").alias("needle")), keys.select(F.col("key").alias("hay"))).select(F.col("needle").alias("q"), F.col("hay").alias("key"))
    around = contains_pairs(keys.select(F.col("key").alias("needle")), open_q.select(F.col("q").alias("hay"))).select(F.col("hay").alias("q"), F.col("needle").alias("key"))
    partial = with_rows(inside.unionByName(around).distinct().withColumn("score", F.lit(1.0)), 2, districts)
    open_q = cut_lineage(open_q.join(partial.select("q"), "q", "left_anti"))
    fuzzy = with_rows(similar_pairs(open_q, "q", keys, "key", 0.5), 3, districts)
    open_q = cut_lineage(open_q.join(fuzzy.select("q"), "q", "left_anti"))
    near = cosine_at_least(name_grams(open_q, "q"), ["q"], name_grams(names.select("key").distinct(), "key"), ["key"], "gram", 0.7)
    vector = with_rows(near.filter(F.round("similarity", 9) >= 0.7).withColumnRenamed("similarity", "score"), 4, names)
    found = exact.unionByName(partial).unionByName(fuzzy).unionByName(vector)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("n").desc(), "level", "name", "parent")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def resolve_place(queries: DataFrame, raw: str, parcels: DataFrame) -> DataFrame:
    """District by similar spelling, else city containing the text or contained in it, else parcel district
    containing it; inflected variants are tried in order within each step."""
    from hectara.functions.texts import clean_location, declension_variants
    from hectara.operators.relations import dominant_city

    q = queries.select(raw).distinct()
    variants = cut_lineage(q.select(raw, F.posexplode(declension_variants(clean_location(F.col(raw)))).alias("vi", "term")).filter("term <> ''"))
    home = cut_lineage(dominant_city(parcels).select(F.lower("district").alias("key"), "district", "city"))
    close = similar_pairs(variants, "term", home, "key", 0.5).join(variants, "term").join(home, "key")
    a = close.groupBy(raw).agg(F.min_by(F.struct(F.col("city").alias("gmina"), F.col("district").alias("dzielnica")), F.struct("vi", (-F.round("score", 9)).alias("s"), "district")).alias("hit")).select(raw, F.lit(1).alias("step"), "hit.*")
    cities = parcels.select("gmina").distinct().select(F.lower("gmina").alias("key"), "gmina")
    terms = variants.select("term").distinct()
    one = contains_pairs(terms.select(F.col("term").alias("needle")), cities.select(F.col("key").alias("hay"), "gmina")).select(F.col("needle").alias("term"), "gmina")
    two = contains_pairs(cities.select(F.col("key").alias("needle"), "gmina"), terms.select(F.col("term").alias("hay"))).select(F.col("hay").alias("term"), "gmina")
    b = one.unionByName(two).distinct().join(variants, "term").groupBy(raw).agg(F.min_by("gmina", F.struct("vi", "gmina")).alias("gmina")).select(raw, F.lit(2).alias("step"), "gmina", F.lit(None).cast("string").alias("dzielnica"))
    areas = parcels.filter(F.col("dzielnica").isNotNull()).groupBy("dzielnica", "gmina").agg(F.count(F.lit(1)).alias("n")).withColumn("hay", F.lower("dzielnica"))
    c = contains_pairs(terms.select(F.col("term").alias("needle")), areas).withColumnRenamed("needle", "term").join(variants, "term")
    c = c.groupBy(raw).agg(F.min_by(F.struct("gmina", "dzielnica"), F.struct("vi", (-F.col("n")).alias("m"), "dzielnica", "gmina")).alias("hit")).select(raw, F.lit(3).alias("step"), "hit.*")
    best = a.unionByName(b).unionByName(c).groupBy(raw).agg(F.min_by(F.struct("step", "gmina", "dzielnica"), "step").alias("m"))
    return q.join(best, raw, "left").select(raw, "m.step", "m.gmina", "m.dzielnica")


def validate_places(pairs: DataFrame, parcels: DataFrame, suggestions: int = 3) -> DataFrame:
    """pairs: miejscowosc, dzielnica. Unknown district: up to `suggestions` names by its first three letters; wrong city: the right one."""
    from hectara.operators.relations import dominant_city

    home = cut_lineage(dominant_city(parcels).select(F.lower("district").alias("key"), "district", F.col("city").alias("actual")))
    j = pairs.distinct().withColumn("key", F.lower("dzielnica")).join(home, "key", "left")
    prefix = F.lower(F.substring("dzielnica", 1, 3))
    unknown = j.filter(F.col("district").isNull()).select(prefix.alias("needle")).distinct()
    w = Window.partitionBy("needle").orderBy("district")
    near = contains_pairs(unknown, home.select(F.col("key").alias("hay"), "district")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= suggestions)
    near = near.groupBy("needle").agg(F.array_join(F.array_sort(F.collect_list("district")), "|").alias("suggestions"))
    verdict = F.when(F.col("district").isNull(), "unknown").when(F.lower("miejscowosc") != F.lower("actual"), "mismatch").otherwise("valid")
    return j.withColumn("verdict", verdict).join(near, (F.col("verdict") == "unknown") & (prefix == F.col("needle")), "left").select("miejscowosc", "dzielnica", "verdict", "actual", F.coalesce("suggestions", F.lit("")).alias("suggestions"))


def city_of(names: DataFrame, name: str, parcels: DataFrame) -> DataFrame:
    """City of a locality, else of a district, else the name itself."""
    from hectara.operators.relations import dominant_city

    local = parcels.groupBy(F.lower("miejscowosc").alias("k")).agg(F.min("gmina").alias("by_place"))
    home = dominant_city(parcels).groupBy(F.lower("district").alias("k")).agg(F.min("city").alias("by_district"))
    keyed = names.select(name).distinct().withColumn("k", F.lower(name))
    return keyed.join(local, "k", "left").join(home, "k", "left").select(name, F.coalesce("by_place", "by_district", name).alias("gmina"))


def alias_mentions(messages: DataFrame, text: str) -> DataFrame:
    """Rows for every unofficial district name in a text, one per district to search (null: the whole city)."""
    from hectara.functions.constants import DISTRICT_ALIASES

    hits = F.array_compact(
        F.array(*[
            F.when(F.col(text).contains(name), F.struct(F.lit(name).alias("name"), F.lit(city).alias("city"), F.array(*[F.lit(s) for s in search or []]).cast("array<string>").alias("search_in"), F.lit(note).alias("note")))
            for name, (city, search, note) in DISTRICT_ALIASES.items()
        ])
    )
    return messages.select("*", F.inline(hits)).select("*", F.explode_outer("search_in").alias("district")).drop("search_in")
