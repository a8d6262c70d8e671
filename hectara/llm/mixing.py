"""Mixing sources to target weights.

Every document gets a hash-random key. The key space of each source is cut into equal ranges; the word
totals of the ranges give distributed prefix sums, which name the one range that holds the cut of the
source. Only that range is sorted. The cut then applies to all documents by comparing keys, so neither
texts nor whole sources are ever moved or sorted in one place. DataFrame functions only.

Defined results: a null text has no words; null is a source of its own and comes last; a source without
words takes none; an empty table gives an empty mix; rows that repeat a doc_id and text share the words at
the cut equally. Columns of the input that clash with those added are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.llm.common import hash_key, packed, unpacked, word_count
from hectara.session import cut_lineage, sized_broadcast

KEY_BITS = 60
RANGE_BITS = 12  # 4096 key ranges a source: 30 billion documents leave some millions of short rows in the range of a cut


def source_key(source: Column) -> Column:
    """A source as a text that is never null: equal sources are equal, null is apart from the empty text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        source_key(F.col("source")).alias("_source"),
        word_count(F.col("text")).alias("size"),
        hash_key(F.col("doc_id"), F.col("text")).alias("_key"),
    )


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Target words per source: shares of the total by weight, none above `cap` times its source.

    Resharing the excess until no source is above its limit fills all sources to one common level per weight,
    except those below it. Sorted by limit per weight, that level follows from running sums. One row per source.
    """
    order = Window.orderBy((F.col("_source") == "").cast("int"), "_source")
    ranked = sizes.withColumn("_n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("_limit") / F.col("_weight"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_below", F.coalesce(F.sum("_limit").over(by_level), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_level), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_open"))
        .withColumn("_full", F.col("_limit") <= F.col("_level") * F.col("_weight"))
    )
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)  # the first open source has the highest
    return filled.select(
        "_source", "source_size",
        F.when(F.col("_full"), F.col("_limit")).otherwise(level * F.col("_weight")).alias("target"),
    )


def cuts(rows: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: whole epochs, then the key and tie-break at which the last epoch ends and what the rows there get each."""
    ranged = rows.withColumn("_range", F.shiftright("_key", KEY_BITS - RANGE_BITS))
    totals = cut_lineage(ranged.groupBy("_source", "_range").agg(F.sum("size").alias("_sum")))
    plan = targets(totals.groupBy("_source").agg(F.sum("_sum").alias("source_size")), share, cap, weights)
    plan = (
        plan.withColumn("_budget", F.floor("target").cast("long"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    )
    plan = sized_broadcast(plan)
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    holding = (
        totals.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(plan.select("_source", "_rest"), "_source")
        .filter((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_sum")))
    )
    tie = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_tie")
    inside = (
        ranged.join(sized_broadcast(holding.select("_source", "_range", "_start", "_rest")), ["_source", "_range"])
        .groupBy("_source", "_start", "_rest", "_key", tie).agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows"))
    )
    sorted_rows = Window.partitionBy("_source").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        inside.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_sum").over(sorted_rows), F.lit(0)))
        .filter((F.col("_from") <= F.col("_rest")) & (F.col("_rest") < F.col("_from") + F.col("_sum")))
        .select("_source", F.col("_key").alias("_cut_key"), F.col("_tie").alias("_cut_tie"), F.expr("(_rest - _from) div _rows").alias("_cut_words"))
    )
    return plan.join(at, "_source", "left").drop("_budget", "_rest")


def taken_words() -> Column:
    """Words of a row that the mix takes, from its key and the cut of its source."""
    tie = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    at = (F.col("_key") == F.col("_cut_key")) & (tie == F.col("_cut_tie"))
    before = (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (tie < F.col("_cut_tie")))
    last = F.when(at, F.least("size", "_cut_words")).when(before, F.col("size")).otherwise(F.lit(0))
    return (F.col("_epochs") * F.col("size") + last).cast("long")


def mix_counts(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes with repeats."""
    rows = cut_lineage(sized(docs))
    plan = sized_broadcast(cuts(rows, share, cap, weights))
    return rows.join(plan, "_source").select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each epoch of a document; the document at a cut keeps its first words only.

    n_chars, where docs have it, follows the text. Texts stay where they are: only sizes and keys are shuffled.
    """
    plan = sized_broadcast(cuts(cut_lineage(sized(docs)), share, cap, weights))
    text = F.col("text")
    row = packed(docs, "doc_id", source_key(F.col("source")).alias("_source"), word_count(text).alias("size"), hash_key(F.col("doc_id"), text).alias("_key"))
    taken = row.join(plan, "_source").withColumn("_taken", taken_words())
    copies = F.ceil(F.col("_taken") / F.col("size")).cast("int")
    each = taken.filter("_taken > 0").select("_row", "size", "_taken", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    left = F.least(F.col("size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("size"))
    text = F.when(left < F.col("size"), first_words(F.col("_row.text"), left)).otherwise(F.col("_row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(left < F.col("size"), F.char_length(text)).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return each.select(*unpacked(docs, **changed))
