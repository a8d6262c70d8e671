"""Whitening of embeddings by incremental eigendecompositions.

Each component c becomes x = floor(scale * c) + shift. A partition builds the spectrum of its scatter by rank-one updates: a block of rows
is centred and turned into the triangular factor with the same scatter, each row of it is one update, and the distance of the
block's mean from the mean so far is one more. An update of eigenvalues d by a vector z solves the secular equation
1 + sum z_j^2 / (d_j - w) = 0, one root between neighbouring poles, by bisection measured from the nearer pole; entries of z that
are nothing and poles that coincide are deflated first, and the eigenvectors come from the z for which the computed roots are exact, so they stay
orthogonal. Spectra of partitions are combined the same way: every eigenpair of one is an update of the other. A last pass
over all rows projects them, centred by the exact mean, on that basis and adds up the small covariance there (Rayleigh-Ritz); its
eigenvectors turn the basis into the final components, which no longer depend on errors of the updates.

Each level merges at most FAN spectra in a task. The driver holds one spectrum (dimensions squared numbers); sums of x are exact integers.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; a vector shorter than the longest counts as filled up with
zeros; entries beyond +-2^31 after scaling count as that limit; rows without or with repeated vec_id count each; a component without variance
(not above dims * 2^-52 times the largest) has a null whitened value and takes no part in identity_error; deviation is exact, and null where it
exceeds a long; the sign of a component makes its largest entry positive; an empty table, or one of empty vectors, gives no rows. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from hectara.llm.common import ship_package
from hectara.llm.vectors import chunks, dimensions, finite_vectors, floors, merged
from hectara.session import cut_lineage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT = 1 << 31
ROWS = 4096
EPS = float(np.finfo(float).eps)


def deflated(d: np.ndarray, z: np.ndarray, u: np.ndarray, tiny: float) -> np.ndarray:
    """The places that stay in the secular equation; rotates the columns of coinciding poles so that one of them leaves it. Changes d, z and u."""
    norm, active, last = np.sqrt(z @ z), [], -1
    for j in range(len(d)):
        if abs(z[j]) * norm <= tiny:
            continue
        if last >= 0:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if (d[j] - d[last]) * abs(c * s) <= tiny:
                z[last], z[j] = 0.0, r
                d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
                u[:, last], u[:, j] = c * u[:, last] - s * u[:, j], s * u[:, last] + c * u[:, j]
            else:
                active.append(last)
        last = j
    return np.array(active + ([last] if last >= 0 else []), int)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots w_i and the exact differences w_i - d_j (row i) of 1 + sum z2_j / (d_j - w) for rising d."""
    gap = np.append(np.diff(d), z2.sum())
    middle = 1 + (z2 / ((d[None, :] - d[:, None]) - gap[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (np.arange(len(d)) < len(d) - 1)
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    poles = d[None, :] - origin[:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(np.arange(len(d)) < len(d) - 1, gap / 2, gap))
    for _ in range(110):
        mid = (low + high) / 2
        with np.errstate(divide="ignore"):
            above = 1 + (z2 / (poles - mid[:, None])).sum(axis=1) > 0
        low, high = np.where(above, low, mid), np.where(above, mid, high)
        if (high - low <= EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    mid = (low + high) / 2
    return origin + mid, mid[:, None] - poles


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of u diag(d) u' + v v'."""
    d, z, u = d.copy(), u.T @ v, u.copy()
    size = max(d[-1], float(z @ z)) if len(d) else 0.0
    if not size:
        return d, u
    at = deflated(d, z, u, 8 * EPS * size)
    if len(at):
        order = np.argsort(d[at], kind="stable")
        at = at[order]
        da, za = d[at], z[at]
        roots, off = secular_roots(da, za * za)
        # z for which the roots are exact: products of differences, all positive.
        k = len(at)
        beneath = da[:, None] - da[None, :]
        ratio = np.ones((k, k))
        i, j = np.tril_indices(k, -1)  # root j below pole i
        ratio[i, j] = -off[j, i] / beneath[i, j]
        i, j = np.triu_indices(k)
        i, j = i[j < k - 1], j[j < k - 1]  # root j from pole i on
        ratio[i, j] = off[j, i] / (da[j + 1] - da[i])
        exact = np.sqrt(np.maximum(ratio.prod(axis=1) * off[k - 1], 0.0)) * np.where(za < 0, -1.0, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = -exact[:, None] / off.T
        w = np.where(np.isfinite(w), w, 0.0)
        d[at], u[:, at] = roots, u[:, at] @ (w / np.sqrt((w * w).sum(axis=0)))
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


def with_block(spectrum: tuple | None, rows: np.ndarray) -> tuple:
    """(n, sums, eigenvalues, eigenvectors) of the scatter after more rows of whole numbers."""
    m, dims = rows.shape
    n, sums, d, u = spectrum or (0, np.zeros(dims, np.int64), np.zeros(dims), np.eye(dims))
    added = rows.sum(axis=0)
    centre = added / m
    for r in np.linalg.qr(rows - centre, mode="r"):
        d, u = rank_one(d, u, r)
    if n:
        d, u = rank_one(d, u, np.sqrt(n / (n + m) * m) * (centre - sums / n))
    return n + m, sums + added, d, u


def combined(a: tuple, b: tuple) -> tuple:
    """The spectrum of both scatters together, by one update for each eigenpair of b and one for the means."""
    (n, sums, d, u), (m, added, e, w) = a, b
    for value, vector in zip(e, w.T):
        if value > 0:
            d, u = rank_one(d, u, np.sqrt(value) * vector)
    d, u = rank_one(d, u, np.sqrt(n / (n + m) * m) * (added / m - sums / n))
    return n + m, sums + added, d, u


SPECTRUM = StructType([
    StructField("part", LongType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType())), StructField("d", ArrayType(DoubleType())), StructField("u", BinaryType()),
])
SUMS = StructType([StructField("part", LongType()), StructField("values", ArrayType(DoubleType()))])


def whole(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    return floors(batch.column("embedding"), dims, scale, LIMIT)


def spectrum_of(kept: DataFrame, dims: int, scale: int) -> tuple:
    """n, sums, eigenvalues and eigenvectors of the scatter of all rows of whole numbers, not yet refined."""
    kinds = to_arrow_schema(SPECTRUM)

    def run(batches):
        found = None
        for batch in chunks(batches, ROWS):
            found = with_block(found, whole(batch, dims, scale))
        if found:
            n, sums, d, u = found
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": n, "sums": sums.tolist(), "d": d.tolist(), "u": u.tobytes()}], schema=kinds)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for row in frame.itertuples():
            one = (row.n, np.array(row.sums, np.int64), np.array(row.d), np.frombuffer(row.u).reshape(dims, dims))
            total = one if total is None else combined(total, one)
        n, sums, d, u = total
        return pd.DataFrame([{"part": frame["part"].iloc[0], "n": n, "sums": sums, "d": d, "u": u.tobytes()}])

    row = merged(kept.select("embedding").mapInArrow(run, SPECTRUM), merge).first()
    return row["n"], np.array(row["sums"], np.int64), np.array(row["d"]), np.frombuffer(row["u"]).reshape(dims, dims)


def second_moments(rows: DataFrame, values_of, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the columns that values_of makes of each batch."""
    kinds = to_arrow_schema(SUMS)

    def run(batches):
        total, some = np.zeros(size * (size + 1)), False
        for batch in chunks(batches, ROWS):
            y, some = values_of(batch), True
            total += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        if some:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "values": total.tolist()}], schema=kinds)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"part": frame["part"].iloc[0], "values": np.sum(np.stack(frame["values"].tolist()), axis=0)}])

    total = np.array(merged(rows.mapInArrow(run, SUMS), merge).first()["values"])
    return total[:size], total[size:].reshape(size, size)


def refined(kept: DataFrame, spectrum: tuple, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and components: Rayleigh-Ritz over all rows in the basis of the spectrum."""
    n, sums, _, u = spectrum
    centre = sums / n
    total, products = second_moments(kept.select("embedding"), lambda batch: (whole(batch, dims, scale) - centre) @ u, dims)
    values, turn = np.linalg.eigh(products / n - np.outer(total / n, total / n))
    values, vectors = values[::-1], (u @ turn)[:, ::-1]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)])
    return values, vectors * sign


WHITE = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector (vec_id, embedding) and component up to `components`."""
    spark = vectors.sparkSession
    ship_package(spark)
    kept = finite_vectors(vectors, "vec_id")
    dims = dimensions(kept)
    names = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, {WHITE}"
    if not dims:
        return spark.createDataFrame([], names)
    spectrum = spectrum_of(kept, dims, scale)
    n, sums = spectrum[:2]
    values, basis = refined(kept, spectrum, dims, scale)
    top = min(components, dims)
    varied = values[:top] > dims * EPS * max(values[0], 0.0)
    trace = float(np.maximum(values, 0.0).sum())
    explained = np.where(varied, values[:top] / trace, 0.0) if trace else np.zeros(top)
    weights = basis[:, :top] / np.sqrt(np.where(varied, values[:top], np.inf))
    centre = sums / n
    schema = StructType([kept.schema["vec_id"], StructField("deviation", LongType()), StructField("values", ArrayType(DoubleType()))])
    kinds = to_arrow_schema(schema)

    def run(batches):
        for batch in chunks(batches, ROWS):
            x = whole(batch, dims, scale)  # the shift cancels in n*x - S
            z = x * n - sums if n * int(np.abs(x).max(initial=1)) < 1 << 62 else x.astype(object) * n - sums.astype(object)
            if dims * int(np.abs(z).max(initial=0)) ** 2 < 1 << 63:
                far = pa.array((z * z).sum(axis=1).astype(np.int64))
            else:
                far = pa.array([s if s < 1 << 63 else None for s in (z.astype(object) ** 2).sum(axis=1)], pa.int64())
            white = (x - centre) @ weights
            listed = pa.ListArray.from_arrays(np.arange(0, white.size + 1, top, dtype=np.int32), white.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), far, listed.cast(kinds.field("values").type)], schema=kinds)

    white = cut_lineage(kept.mapInArrow(run, schema))
    total, products = second_moments(white.select("values"), lambda batch: np.asarray(batch.column("values").flatten()).reshape(-1, top), top)
    apart = (products / n - np.outer(total / n, total / n) - np.eye(top))[np.ix_(varied, varied)]
    error = float(np.abs(apart).max()) if varied.any() else 0.0
    shares, have = (F.array(*[F.lit(v) for v in column]) for column in (explained.tolist(), varied.tolist()))
    rows = white.select("vec_id", "deviation", F.posexplode("values").alias("at", "value"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(have, F.col("at")), F.col("value")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
