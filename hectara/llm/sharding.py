"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a document's hash. A bucket splits on its next bit only while
it is over the byte limit and holds more than one hash. Since the bytes under a prefix shrink with its length,
the shard of a document is the shortest prefix of its hash that fits. So one aggregation by a long prefix and
its roll-up to all shorter ones give the whole directory; only this directory is joined to the documents.

Defined results: bytes are those of the UTF-8 text, 0 for null; a document over the limit is a shard of its own
and is marked oversized; rows with equal doc_id and text cannot be told apart by bits, so if they alone are over
the limit they are dealt over numbered overflow pages; an empty table has no shards. The columns shard, depth,
shard_bytes and oversized replace columns of those names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.llm.common import hash_key, packed
from hectara.session import cut_lineage, sized_broadcast

BITS = 60
SALTS = 1024


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bits_of(prefix: Column, depth: Column) -> Column:
    """The first `depth` bits as a text of 0 and 1; empty for depth 0."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def directory(rows: DataFrame, limit_bytes: int) -> tuple[DataFrame, int]:
    """Directory entries (_prefix of so many bits, shard, depth, shard_bytes, shard_rows) and that number of bits.

    rows: _hash and n_bytes of each document.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit_bytes)))) + 6)
    while True:
        fine = cut_lineage(
            rows.groupBy(F.shiftright("_hash", BITS - depth).alias("_prefix"))
            .agg(F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        )
        if depth == BITS or fine.filter((F.col("_bytes") > limit_bytes) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
        depth = min(BITS, depth + 8)
    each = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    at = F.expr(f"shiftright(_prefix, {depth} - depth)")
    buckets = (
        each.groupBy("depth", at.alias("_at"))
        .agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        .filter((F.col("shard_bytes") <= limit_bytes) | (F.col("_low") == F.col("_high")))
    )
    fitting = each.select("_prefix", "depth", at.alias("_at")).join(buckets, ["depth", "_at"])
    shards = fitting.groupBy("_prefix").agg(F.min(F.struct("depth", "_at", "shard_bytes", "shard_rows")).alias("_s"))
    return shards.select("_prefix", bits_of(F.col("_s._at"), F.col("_s.depth")).alias("shard"), "_s.depth", "_s.shard_bytes", "_s.shard_rows"), depth


def assign_shards(docs: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """The columns of docs with n_bytes, shard (hash bits, with a page number for overflow), depth, shard_bytes and oversized."""
    key = hash_key(F.col("doc_id"), F.col("text"))
    added = ["n_bytes", "shard", "depth", "shard_bytes", "oversized"]
    rows = cut_lineage(docs.select(key.alias("_hash"), text_bytes(F.col("text")).alias("n_bytes")))
    entries, depth = directory(rows, limit_bytes)
    entries = sized_broadcast(entries)
    placed = (
        packed(docs, key.alias("_hash"), text_bytes(F.col("text")).alias("n_bytes"))
        .withColumn("_prefix", F.shiftright("_hash", BITS - depth)).join(entries, "_prefix")
    )
    overflow = (F.col("shard_bytes") > limit_bytes) & (F.col("shard_rows") > 1)
    shown = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in added]
    fits = placed.filter(~overflow).withColumn("oversized", F.col("shard_bytes") > limit_bytes).select(*shown, *added)
    if entries.filter(overflow).isEmpty():
        return fits
    return fits.unionByName(overflow_pages(placed.filter(overflow), limit_bytes).select(*shown, *added))


def overflow_pages(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows that repeat one document, dealt over pages of as many rows as fit; numbered by salted running counts, not by one sort."""
    salted = cut_lineage(rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    totals = salted.groupBy("_hash", "_salt").agg(F.count("*").alias("_many"))
    before = Window.partitionBy("_hash").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_hash", "_salt", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_hash", "_salt").orderBy(F.lit(1)))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.col("n_bytes")))
    numbered = salted.join(starts, ["_hash", "_salt"]).withColumn("_number", F.col("_start") + number - 1)
    page = F.floor(F.col("_number") / per_page)
    on_page = F.least(per_page, F.col("shard_rows") - page * per_page)
    return (
        numbered.withColumn("_page", page).withColumn("_page_bytes", on_page * F.col("n_bytes"))
        .withColumn("shard", F.concat("shard", F.lit("p"), F.col("_page").cast("string")))
        .withColumn("shard_bytes", F.col("_page_bytes").cast("long")).withColumn("oversized", F.col("n_bytes") > limit_bytes)
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = 64 << 20) -> None:
    """One folder per shard below path; the shards are dealt to tasks by name, each written by one task."""
    sharded = assign_shards(docs, limit_bytes)
    sharded.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
