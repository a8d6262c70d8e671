"""Vector search and text similarity. Cosine is exact; text meets on shared tokens, never all with all."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hectara.functions import constants as C
from hectara.operators.text_joins import cosine_at_least
from hectara.session import cut_lineage, shuffled, sized_broadcast


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of an array column with one fixed vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    norm_q = sum(v * v for v in query) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.try_divide(dot, norm * norm_q)


def vector_of(df: DataFrame, key: str, value, column: str) -> list[float]:
    """The reference vector, a single row."""
    return [float(v) for v in df.filter(F.col(key) == value).select(column).first()[0]]


def most_similar(
    df: DataFrame, key: str, vector: str, query: list[float], cut: int, keep: int, exclude=None, condition: Column | None = None, filter_first: bool = True
) -> DataFrame:
    """The `keep` nearest rows that meet the condition, without `exclude`.

    With filter_first=False the condition is tested only among the `cut` nearest, so fewer may stay.
    """
    scored = df.withColumn("similarity", F.round(cosine(F.col(vector), query), 9))
    best = [F.col("similarity").desc(), F.col(key)]
    if filter_first:
        scored = scored if condition is None else scored.filter(condition)
        cut = max(cut, keep + 1)
    near = scored.orderBy(*best).limit(cut)
    if exclude is not None:
        near = near.filter(F.col(key) != exclude)
    if condition is not None and not filter_first:
        near = near.filter(condition)
    return near.orderBy(*best).limit(keep)


PIVOTS, RING = 32, 0.05
SLACK = 1e-4  # radians; covers the rounding of similarities and of angles near zero


def _meetings(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, pivots: int, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by class, the keys asked for by class, and the pairs of classes that the bounds leave, with their similarity."""
    label = key if members is None else next(c for c in members.columns if c != key)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("key"), F.col(vector).cast("array<double>").alias(vector)).withColumn("norm", norm).filter("norm > 0 AND norm < double('inf')")
    rows = rows.select("key", F.transform(vector, lambda v: v / F.col("norm")).alias("unit"))
    rows = cut_lineage(rows.withColumn("class", F.md5(F.concat_ws(",", F.transform("unit", lambda v: F.round(v * 1e9).cast("bigint").cast("string"))))))
    if members is None:
        classes = rows.withColumn("first", F.col("key"))
    else:
        held = members.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(key).alias("key"))
        kinds = rows.withColumnRenamed("key", "label")
        classes = kinds.join(shuffled(held.groupBy("label").agg(F.min("key").alias("first"))), "label")
        rows = cut_lineage(held.join(shuffled(kinds.select("label", "class")), "label").select("key", "class"))
    classes = cut_lineage(classes.groupBy("class").agg(F.min("first").alias("first"), F.min_by("unit", "first").alias("unit")))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    chosen = classes.orderBy("class").limit(pivots).agg(F.collect_list("unit").alias("pivots"))
    angles = F.transform("pivots", lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("unit"), p)))))
    seen = classes.join(F.broadcast(chosen)).withColumn("angles", angles).drop("pivots")
    seen = seen.withColumn("r", F.array_min("angles")).withColumn("cell", F.array_position("angles", F.col("r")).cast("int"))
    seen = cut_lineage(seen.withColumn("ring", F.floor(F.col("r") / RING).cast("int")))
    cells = seen.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"))
    cells = cells.agg(F.collect_list(F.struct("cell", "low", "high", "n")).alias("cells"))

    asked = rows.join(queries.select(F.col(key).alias("key")).distinct(), "key", "left_semi").select("key", "class")
    q = seen.join(asked.select("class").distinct(), "class", "left_semi").join(F.broadcast(cells))
    theta = F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), c["low"].alias("low"), c["high"].alias("high"), c["n"].alias("n"), F.element_at("angles", c["cell"]).alias("at")))
    q = q.select(F.col("class").alias("asked"), F.col("unit").alias("q"), F.col("angles").alias("qa"), F.col("cell").alias("own"), F.col("ring").alias("own_ring"), theta.alias("cells"))
    # Cells by their farthest possible member: the first that complete k + 1 classes bound the k-th neighbour.
    far = F.array_sort(F.transform("cells", lambda c: F.struct((c["at"] + c["high"]).alias("far"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(math.pi).alias("bound"))
    bound = F.aggregate(far, start, lambda s, c: F.struct((s["n"] + c["n"]).alias("n"), F.when((s["n"] <= k) & (s["n"] + c["n"] > k), c["far"]).otherwise(s["bound"]).alias("bound")))
    q = cut_lineage(q.withColumn("wide", bound["bound"]))
    # The k + 1 best of the own ring bound it as well, and mostly closer.
    place = seen.select("unit", F.col("cell").alias("own"), F.col("ring").alias("own_ring"))
    near = q.select("asked", "q", "own", "own_ring").join(place, ["own", "own_ring"]).select("asked", dot(F.col("q"), F.col("unit")).alias("s"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.col("s").desc()))).filter(F.col("place") == k + 1)
    close = near.select("asked", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s")))).alias("close"))
    q = q.join(close, "asked", "left").withColumn("bound", F.least("wide", "close") + SLACK).select("asked", "q", "qa", "bound", F.inline("cells"))
    low, high = F.greatest(F.col("at") - F.col("bound"), F.col("low")), F.least(F.col("at") + F.col("bound"), F.col("high"))
    q = q.filter(low <= high).withColumn("ring", F.explode(F.sequence(F.floor(low / RING).cast("int"), F.floor(high / RING).cast("int"))))
    met = q.select("asked", "q", "qa", "bound", "cell", "ring").join(seen.select("class", "first", "unit", "angles", "cell", "ring"), ["cell", "ring"])
    apart = F.array_max(F.zip_with("qa", "angles", lambda a, b: F.abs(a - b)))
    met = met.filter(apart <= F.col("bound")).select("asked", "class", "first", F.round(dot(F.col("q"), F.col("unit")), 9).alias("similarity"))
    return rows, asked, met


def nearest_for_each(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, pivots: int = PIVOTS, members: DataFrame | None = None) -> DataFrame:
    """key, rank, neighbour and similarity: for every row of queries (column key) the k rows of df with the largest cosine but itself, ties to the smaller key.

    All queries run in one job. Rows of one vector (rounded to nine digits, of unit length) are one class, so copies are compared once.
    Classes stand in cells of their nearest pivot, in rings by their angle to it. The cells' radii and counts, and the best of the query's own
    ring, bound the angle of the k-th neighbour; by the triangle inequality only rings within that bound of the query's own angle can hold an
    answer. Only those are met, the angles to the other pivots are tested before vectors are multiplied, and no answer is left out. Keys are unique; rows with a null key, without a vector, or of length zero have no direction: they are
    neither found nor answered. With `members` (key and a label) df has one row a label instead of one a key, and the vectors of a label are read once.
    """
    rows, asked, met = _meetings(df, key, vector, queries, k, pivots, members)
    order = [F.col("similarity").desc(), F.col("first")]
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).filter(F.col("place") <= k + 1)
    members = rows.select("key", "class").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("key"))).filter(F.col("place") <= k + 1)
    found = best.drop("place", "first").join(members.select("class", F.col("key").alias("neighbour")), "class")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.col("similarity").desc(), "neighbour"))).filter(F.col("place") <= k + 1)
    pairs = asked.withColumnRenamed("class", "asked").join(found.select("asked", "neighbour", "similarity"), "asked").filter("neighbour <> key")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("similarity").desc(), "neighbour"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), "rank", "neighbour", "similarity")


def name_grams(df: DataFrame, text: str) -> DataFrame:
    """Rows (…, gram, weight): unit-length character-trigram vector of a short name, built inside the row."""
    padded = F.concat(F.lit(" "), F.trim(F.lower(text)), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))
    with_grams = df.withColumn("_g", grams)
    counted = F.transform(F.array_distinct("_g"), lambda g: F.struct(g.alias("gram"), F.size(F.filter("_g", lambda x: x == g)).cast("double").alias("n")))
    with_grams = with_grams.withColumn("_c", counted).drop("_g")
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["n"] * c["n"]))
    rows = F.transform("_c", lambda c: F.struct(c["gram"].alias("gram"), (c["n"] / norm).alias("weight")))
    return with_grams.select(*df.columns, F.inline(rows))


TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def word_vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Default text encoder: unit-length word counts of the whole lower-cased text, as (keys, token, weight) rows."""
    words = df.select(*keys, F.explode(F.split(F.lower(text), TOKEN_SPLIT)).alias("token")).filter(F.col("token") != "")
    counts = words.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, keys).select(*keys, "token", (F.col("n") / F.col("norm")).alias("weight"))


def place_counts(df: DataFrame, key: str, text: str, dimension: int) -> DataFrame:
    """key, places and counts: the places of the words of each row, ascending, and how often each occurs. Rows are counted on their own, without a shuffle."""
    words = F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: w != "")
    place = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dimension).cast("int")
    rows = df.select(key, F.array_sort(F.transform(words, place)).alias("all"))
    ends = F.filter(F.transform("all", lambda x, i: F.when(~F.get("all", i + 1).eqNullSafe(x), i + 1)), lambda e: e.isNotNull())
    rows = rows.withColumn("ends", ends)
    return rows.select(
        key, F.transform("ends", lambda e: F.get("all", e - 1)).alias("places"),
        F.transform("ends", lambda e, i: (e - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("long")).alias("counts"),
    )


def hashed_vectors(df: DataFrame, key: str, text: str, dimension: int = 512) -> DataFrame:
    """Offline encoder of `dimension` numbers, as (key, place, weight) rows of unit length per text.

    Words are hashed to places by the first 32 bits of their md5; a place weighs its count times its rarity,
    ln((texts + 1) / (texts with the place + 1)). A text stays one row until its weights are known; only the rows
    that repeat a key are dealt out and added up.
    """
    repeated = sized_broadcast(df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col(key).alias("again"), F.lit(True).alias("many")))
    counted = place_counts(df, key, text, dimension).join(repeated, F.col(key).eqNullSafe(F.col("again")), "left").drop("again")
    counted = cut_lineage(counted)
    entry = F.explode(F.arrays_zip("places", "counts")).alias("e")
    added = counted.filter("many").select(key, entry).groupBy(key, F.col("e.places").alias("place")).agg(F.sum("e.counts").alias("n"))
    merged = added.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("e")).select(key, F.col("e.place").alias("places"), F.col("e.n").alias("counts"))
    texts = counted.filter("many is null").select(key, "places", "counts").unionByName(merged)
    held = texts.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("texts"))
    rarity = held.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("all")))).select("place", F.ln((F.col("all") + 1) / (F.col("texts") + 1)).alias("rarity"))
    known = rarity.agg(F.map_from_entries(F.collect_list(F.struct("place", "rarity"))).alias("known"))  # at most `dimension` entries
    by_place = known.select(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda p: F.try_element_at("known", p)).alias("rarity"))
    weighed = texts.join(F.broadcast(by_place)).withColumn("w", F.zip_with("places", "counts", lambda p, n: n * F.get("rarity", p)))
    weighed = weighed.withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda total, w: total + w * w)))
    rows = weighed.select(key, "norm", F.explode(F.arrays_zip("places", "w")).alias("e"))
    return rows.select(key, F.col("e.places").alias("place"), F.coalesce(F.try_divide("e.w", "norm"), F.lit(0.0)).alias("weight"))


def cosine_pairs(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], on: str) -> DataFrame:
    """Cosine of every pair that shares a token, from unit-length sparse rows. Sums combine before the shuffle."""
    other = right.withColumnRenamed("weight", "weight_2")
    pairs = left.join(other, on)
    return pairs.groupBy(*left_keys, *right_keys).agg(F.sum(F.col("weight") * F.col("weight_2")).alias("similarity"))


def best_matches(pairs: DataFrame, by: list[str], tie: str, threshold: float, keep: int) -> DataFrame:
    scored = pairs.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)
    w = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def resolve_names(mentions: DataFrame, text: str, dictionary: DataFrame, name: str, threshold: float = 0.7, keep: int = 3) -> DataFrame:
    """Best dictionary name per distinct mention with its alternatives."""
    left = name_grams(mentions.select(text).filter(F.length(F.trim(text)) > 0).distinct(), text)
    right = name_grams(dictionary.select(name).filter(F.length(F.trim(name)) > 0).distinct(), name)
    top = best_matches(cosine_at_least(left, [text], right, [name], "gram", threshold), [text], name, threshold, keep)
    return top.groupBy(text).agg(
        F.max(F.when(F.col("rank") == 1, F.col(name))).alias("best"), F.max("similarity").alias("similarity"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", name)))), lambda s: s[name]).alias("alternatives"),
    )


def category_table(spark: SparkSession) -> DataFrame:
    """The fixed dictionary of category, water and service names with their variants."""
    return F.broadcast(spark.createDataFrame(C.CATEGORY_NAMES, "id string, kind string, canonical_name string, variants array<string>, maps_to array<string>"))


def resolve_categories(mentions: DataFrame, text: str, spark: SparkSession, kind: str, filter_after_cut: bool = False) -> DataFrame:
    """Category of a mention among the names of the kind; with filter_after_cut the kind is tested only among the three nearest names."""
    names = category_table(spark)
    group = names.filter(F.col("kind") == kind) if kind in ("water", "poi") or not filter_after_cut else names.filter(~F.col("kind").isin("water", "poi"))
    left = name_grams(mentions.select(text).filter(F.length(F.trim(text)) > 0).distinct(), text)
    right = name_grams(group.select("id", "kind", "canonical_name"), "canonical_name")
    top = best_matches(cosine_pairs(left, [text], right, ["id", "kind", "canonical_name"], "gram"), [text], "id", -1.0, 3)
    hits = top.filter((F.col("kind") == kind) & (F.col("similarity") >= C.RESOLVE_THRESHOLDS[kind]))
    first = hits.groupBy(text).agg(F.min_by(F.struct("id", "canonical_name", "similarity"), F.col("rank")).alias("m"))
    return first.select(text, "m.id", "m.canonical_name", "m.similarity").join(names.select("id", "maps_to"), "id")


def variant_mentions(messages: DataFrame, text: str) -> DataFrame:
    """How many messages use each variant of the dictionary."""
    lowered = F.lower(text)
    hits = F.array_compact(
        F.array(*[F.when(lowered.contains(v.lower()), F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind"), F.lit(v).alias("variant"))) for i, k, _, variants, _ in C.CATEGORY_NAMES for v in variants])
    )
    return messages.select(F.inline(hits)).groupBy("id", "kind", "variant").agg(F.count(F.lit(1)).alias("n"))
