"""Vectors as short codes: one index a part into a codebook learned by ball k-means, in whole numbers throughout.

Each component x becomes floor(scale * x); vectors are cut into equal consecutive parts. The codebook of a part position starts as
that part of the vectors with the smallest vec_ids. The first round compares every part with every entry. Later rounds keep the
assignment of the round before and look only where it can change: the parts of an entry form a ball around it; an entry is a
neighbour of the ball if half its distance lies within the ball's radius. A part nearer to its entry than half the way to the
nearest neighbour lies in the stable core and is not compared; further out, the half distances to the neighbours cut the ball into rings, and
a part meets exactly the neighbours whose half distance it has passed. A ball whose entry and neighbours did not move is
skipped whole. All tests are on squared whole numbers, so the result is that of comparing everything, ties included
(to the lower index).

Balls are formed over the rows that a task holds at a time: a smaller ball has fewer neighbours and the bounds stay exact.
The vectors never move between tasks; a round's assignment is a checkpoint, and what a round sends is one row of counts and sums
an entry and partition, added up by Spark. The driver holds the codebooks (entries x dimensions numbers).

Defined results: rows whose vector is null or holds a null or non-finite component are left out; a vector shorter than the longest counts as
filled up with zeros, dimensions that the parts do not divide likewise; components beyond +-2^24 after scaling count as that limit;
rows without vec_id are coded and never start an entry; rows that repeat a vec_id are coded each, and ties for a start go to the
smaller vector; fewer vectors than entries give fewer entries; an empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from hectara.llm.common import ship_package
from hectara.llm.vectors import chunks, dimensions, finite_vectors, floors
from hectara.session import cut_lineage, sized_broadcast

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
ROWS = 8192


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    off = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", off, off)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row, the lower index on ties."""
    index, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), 1024):
        d = squared(x[at:at + 1024], book)
        index[at:at + 1024] = d.argmin(axis=1)
        best[at:at + 1024] = d.min(axis=1)
    return index, best


def nearest_by_balls(x: np.ndarray, own: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As nearest_entries, from the entries `own` that were nearest before the entries `moved`; also the number of distances taken."""
    off = x - book[own]
    best = (off * off).sum(axis=1)
    index, taken = own.copy(), len(x)
    gaps = squared(book, book)
    by_entry = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[by_entry], np.arange(len(book) + 1))
    for i in range(len(book)):
        ball = by_entry[starts[i]:starts[i + 1]]
        if not len(ball):
            continue
        inner = best[ball]
        near = np.flatnonzero(gaps[i] <= 4 * inner.max())
        near = near[near != i]
        if not len(near) or not (moved[i] or moved[near].any()):
            continue
        near = near[np.argsort(gaps[i][near], kind="stable")]
        ring = np.searchsorted(gaps[i][near], 4 * inner, side="right")
        outer = ring > 0
        ball, inner, ring = ball[outer], inner[outer], ring[outer]
        d = squared(x[ball], book[near[:ring.max()]])
        d[np.arange(d.shape[1]) >= ring[:, None]] = np.iinfo(np.int64).max
        least = np.minimum(d.min(axis=1), inner)
        chosen = np.where(d == least[:, None], near[:d.shape[1]], len(book)).min(axis=1)
        index[ball] = np.where(inner == least, np.minimum(chosen, i), chosen)
        best[ball] = least
        taken += int(ring.sum())
    return index, best, taken


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """rows (vec_id, label, x, codes) with new codes (one byte a part) and error; moved is None in the first round."""
    parts, _, width = books.shape
    schema = StructType([f for f in rows.schema if f.name not in ("codes", "error")] + [StructField("codes", BinaryType()), StructField("error", LongType())])
    kinds = to_arrow_schema(schema)

    def run(batches):
        for batch in chunks(batches, ROWS):
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).astype(np.int64).reshape(batch.num_rows, parts, width)
            codes, error = np.empty((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            if moved is not None:
                before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            for p in range(parts):
                if moved is None:
                    index, best = nearest_entries(x[:, p], books[p])
                else:
                    index, best, _ = nearest_by_balls(x[:, p], before[:, p], books[p], moved[p])
                codes[:, p] = index
                error += best
            made = {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays([made.get(f.name, batch.column(f.name) if f.name not in made else None) for f in kinds], schema=kinds)

    return rows.mapInArrow(run, schema)


def entry_sums(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """slot (part * entries + entry), count and sums of the parts assigned to it, one row a slot and partition added up."""
    schema = StructType([StructField("slot", IntegerType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))])
    kinds = to_arrow_schema(schema)

    def run(batches):
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in chunks(batches, ROWS):
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(-1, width)
            slots = (np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * entries).ravel()
            counts += np.bincount(slots, minlength=len(counts))
            for j in range(width):  # below 2^53, so exact
                sums[:, j] += np.bincount(slots, x[:, j], len(counts)).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], schema=kinds)

    found = rows.select("x", "codes").mapInArrow(run, schema)
    return found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("sums", j + 1)).alias(f"s{j}") for j in range(width)])


def moved_books(books: np.ndarray, sums: list) -> np.ndarray:
    """Each entry as the componentwise floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.shape
    after = books.copy()
    for row in sums:
        after[row["slot"] // entries, row["slot"] % entries] = [row[f"s{j}"] // row["n"] for j in range(width)]
    return after


def learned(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[DataFrame, np.ndarray]:
    """The rows (vec_id, label, codes, error) after all rounds and the final codebooks (part, entry, position)."""
    ship_package(vectors.sparkSession)
    kept = finite_vectors(vectors, "vec_id", "label")
    width = max(1, -(-dimensions(kept) // parts))
    dims = parts * width
    schema = StructType([kept.schema["vec_id"], kept.schema["label"], StructField("x", BinaryType())])
    kinds = to_arrow_schema(schema)

    def run(batches):
        for batch in chunks(batches, ROWS):
            x = floors(batch.column("embedding"), dims, scale, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], schema=kinds)

    first = kept.filter("vec_id is not null").select("vec_id", "embedding").orderBy("vec_id", "embedding").limit(entries)
    seeds = pa.array([r["embedding"] for r in first.collect()], pa.list_(pa.float64()))
    books = floors(seeds, dims, scale, LIMIT).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    rows = kept.mapInArrow(run, schema)
    if not len(seeds):  # no vector has a vec_id, or there is none: one entry of zeros
        books = np.zeros((parts, 1, width), np.int64)
    moved = None
    for _ in range(rounds):
        rows = cut_lineage(assigned(rows, books, moved))
        after = moved_books(books, entry_sums(rows, parts, books.shape[1], width).collect())
        moved, books = (after != books).any(axis=2), after
    return cut_lineage(assigned(rows, books, moved).drop("x")), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of the vectors (vec_id, embedding, label); at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: entries must be 1 to 256")
    rows, books = learned(vectors, parts, entries, rounds, scale)
    totals = sized_broadcast(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).cast(StringType()).alias("codebooks_sha256"))
