"""Embeddings as rows of whole numbers, and sums over all partitions that never meet in one place."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hectara.session import cut_lineage

FAN = 16  # partial results that one task merges


def finite_vectors(vectors: DataFrame, *columns: str) -> DataFrame:
    """The named columns and embedding (array<double>) of the rows whose vector is neither null nor holds a null or non-finite component."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(whole).select(*columns, F.col("embedding").cast("array<double>").alias("embedding"))


def dimensions(kept: DataFrame) -> int:
    """The length of the longest vector; shorter ones count as filled up with zeros."""
    return kept.agg(F.max(F.size("embedding"))).first()[0] or 0


def floors(lists: pa.ListArray, dims: int, scale: int, limit: int) -> np.ndarray:
    """floor(scale * component) as rows of int64, held within +-limit."""
    out = np.zeros((len(lists), dims), np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    out[np.arange(dims) < lengths[:, None]] = np.clip(np.floor(flat * scale), -limit, limit)
    return out


def chunks(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def merged(parts: DataFrame, merge: Callable) -> DataFrame:
    """One row from one row a partition: FAN rows at a time meet in a task, level by level. parts has a column part; merge gets and gives a pandas frame."""
    parts = cut_lineage(parts)
    while parts.limit(2).count() > 1:
        grouped = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part")
        parts = cut_lineage(grouped.applyInPandas(merge, parts.schema))
    return parts
