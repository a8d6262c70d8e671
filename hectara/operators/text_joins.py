"""Exact joins of short texts by edit similarity and by cosine, with keys that leave most pairs unmet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.session import cut_lineage, sized_broadcast


def _edits(longer: Column, above: float) -> Column:
    """The most edits with which the similarity, as it is computed, is above the limit."""
    most = F.floor(longer * (1 - above) + 1e-9).cast("int")
    return most - F.when(1 - most / longer > above, 0).otherwise(1)


def _partner_lengths(texts: DataFrame, length: str, other: str, above: float) -> DataFrame:
    """texts once for each length that a partner may have, with edits (most edits of such a pair)."""
    n = F.col(length)
    rows = texts.withColumn(other, F.explode(F.sequence(F.greatest(F.lit(1), n - _edits(n, above)), F.ceil(n / above).cast("int"))))
    rows = rows.withColumn("edits", _edits(F.greatest(n, F.col(other)), above))
    return rows.filter((F.col("edits") >= 0) & (F.abs(n - F.col(other)) <= F.col("edits")))


def _segments(rows: DataFrame) -> DataFrame:
    """rows (l, m, edits) once for each of the edits + 1 segments of a text of length l: seg (its number), start and size; the last ones take what is left over."""
    many = F.col("edits") + 1
    short, rest = F.expr("l div (edits + 1)").cast("int"), (F.col("l") % many).cast("int")
    numbered = rows.withColumn("seg", F.explode(F.sequence(F.lit(1), many)))
    late = F.greatest(F.lit(0), F.col("seg") - 1 - (many - rest))  # longer segments before this one
    return numbered.withColumn("start", 1 + (F.col("seg") - 1) * short + late).withColumn("size", short + F.when(F.col("seg") > many - rest, 1).otherwise(0)).filter("size > 0")


def segment_keys(texts: DataFrame, text: str, above: float) -> DataFrame:
    """text, l, m, seg and key: the segments by which texts of length m may meet this one of length l."""
    rows = _segments(_partner_lengths(texts.withColumn("l", F.length(text)), "l", "m", above))
    return rows.select(text, "l", "m", "seg", F.substr(F.col(text), F.col("start"), F.col("size")).alias("key"))


def substring_keys(texts: DataFrame, text: str, above: float) -> DataFrame:
    """text, l, m, seg and key: the substrings of a text of length m that can be an untouched segment of a text of length l.

    Left of a segment lie at most seg - 1 edits, right of it at most edits + 1 - seg, which bounds how far it may have moved.
    """
    rows = _segments(_partner_lengths(texts.withColumn("m", F.length(text)), "m", "l", above))
    before, after, grown = F.col("seg") - 1, F.col("edits") + 1 - F.col("seg"), F.col("m") - F.col("l")
    first = F.greatest(F.lit(1), F.col("start") - before, F.col("start") + grown - after)
    last = F.least(F.col("m") - F.col("size") + 1, F.col("start") + before, F.col("start") + grown + after)
    placed = rows.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    return placed.select(text, "l", "m", "seg", F.substr(F.col(text), F.col("at"), F.col("size")).alias("key")).distinct()


def edit_candidates(left: DataFrame, lcol: str, right: DataFrame, rcol: str, above: float) -> DataFrame:
    """Pairs _a, _b of distinct texts that hold every pair above the limit.

    Texts within k edits of each other share one of k + 1 segments of the first, unmoved but for the edits around it. The number
    of edits follows from the longer text's length, so both lengths are part of the key.
    """
    a = left.select(F.col(lcol).alias("_a")).filter(F.length("_a") > 0).distinct()
    b = right.select(F.col(rcol).alias("_b")).filter(F.length("_b") > 0).distinct()
    keys = segment_keys(a, "_a", above).join(b.select(F.length("_b").alias("m")).distinct(), "m", "left_semi")
    probes = substring_keys(b, "_b", above).join(a.select(F.length("_a").alias("l")).distinct(), "l", "left_semi")
    return keys.join(probes, ["l", "m", "seg", "key"]).select("_a", "_b").distinct()


def similar_pairs(left: DataFrame, lcol: str, right: DataFrame, rcol: str, above: float) -> DataFrame:
    """Pairs of distinct texts whose edit similarity 1 - levenshtein/longer is above the limit (0.5 or more, below 1), with their score.

    Below 0.5 a text could have fewer characters than segments.
    """
    if not 0.5 <= above < 1:
        raise ValueError("above must be 0.5 or more and below 1")
    longer = F.greatest(F.length("_a"), F.length("_b"))
    met = edit_candidates(left, lcol, right, rcol, above).withColumn("most", _edits(longer, above))
    met = met.withColumn("edits", F.expr("levenshtein(_a, _b, most)")).filter("edits >= 0")
    score = 1 - F.col("edits") / longer
    return met.select(F.col("_a").alias(lcol), F.col("_b").alias(rcol), score.alias("score")).filter(F.col("score") > above)


def cosine_prefixes(vectors: DataFrame, keys: list[str], on: str, order: DataFrame, threshold: float) -> DataFrame:
    """The rows of each unit-length vector, rarest first, up to where the weight that is left is below the threshold.

    Two vectors of at least that cosine share a token among these rows: with none there, what they share is in the rest of one.
    """
    ranked = vectors.join(order, on)
    so_far = Window.partitionBy(*keys).orderBy("often", on).rowsBetween(Window.unboundedPreceding, -1)
    left_over = 1 - F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(so_far), F.lit(0.0))
    return ranked.withColumn("_left", left_over).filter(F.col("_left") >= threshold * threshold - 1e-9).select(*keys, on)


def cosine_candidates(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], on: str, threshold: float) -> DataFrame:
    """Distinct pairs of keys that hold every pair of at least the threshold; tokens are ordered by how many vectors of both sides have them."""
    every = left.select(on).unionByName(right.select(on))
    order = sized_broadcast(every.groupBy(on).agg(F.count(F.lit(1)).alias("often")))
    a = cosine_prefixes(left, left_keys, on, order, threshold)
    b = cosine_prefixes(right, right_keys, on, order, threshold)
    return a.join(b, on).select(*left_keys, *right_keys).distinct()


def cosine_at_least(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], on: str, threshold: float) -> DataFrame:
    """Pairs of unit-length sparse vectors (keys, token `on`, weight) with a cosine of at least the threshold (above 0), as similarity.

    Frequent tokens are read for pairs that already met on a rare one, so they are no keys of the search.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    slack = threshold - 1e-8
    pairs = cosine_candidates(left, left_keys, right, right_keys, on, slack)
    both = pairs.join(left, left_keys).join(right.withColumnRenamed("weight", "weight_2"), [*right_keys, on])
    sums = both.groupBy(*left_keys, *right_keys).agg(F.sum(F.col("weight") * F.col("weight_2")).alias("similarity"))
    return sums.filter(F.col("similarity") >= slack)
