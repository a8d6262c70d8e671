"""Discs of one radius against very many points or upright boxes, in blocks of bounded size.

Discs and shapes are dealt out by square regions and, where a region holds more than a block, by parts of each side; results of blocks add up. Within a
block the discs are halved by place. For each half most shapes are settled at once: those out of reach of all its discs go, those that count the same
for all of them are added to all, and only the rest is passed on and meets single discs. Nothing is estimated or left out.

The functions that run on executors are made inside of others, so they are sent with the job.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hectara.session import sized_broadcast

BLOCK_DISCS, BLOCK_SHAPES = 1 << 15, 1 << 18
FEW = 16  # discs that meet shapes one by one
PAIRS = 1 << 18  # pairs held at a time


def largest_square(radius: float, strict: bool) -> float:
    """The largest squared distance whose root is at most (strict: below) the radius."""
    square = radius * radius
    fits = (lambda v: math.sqrt(v) < radius) if strict else (lambda v: math.sqrt(v) <= radius)
    while not fits(square):
        square = math.nextafter(square, -math.inf)
    while fits(math.nextafter(square, math.inf)):
        square = math.nextafter(square, math.inf)
    return square


def in_blocks(discs: DataFrame, pid: str, shapes: DataFrame, radius: float, made, schema: str) -> DataFrame:
    """Rows of made(discs, shapes) over all blocks. discs: pid, x, y; shapes: x0, y0, x1, y1 (finite, at most a few dozen radii wide) and w, not computed twice at a cost."""
    block = ["bx", "by", "disc_part", "shape_part"]
    reach = radius * (1 + 1e-9)

    def region(c):
        return F.floor(c / radius).cast("bigint")

    here = (F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf"))
    discs = discs.select(pid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(here).withColumns({"bx": region(F.col("x")), "by": region(F.col("y"))})
    shapes = shapes.withColumn("bx", F.explode(F.sequence(region(F.col("x0") - reach), region(F.col("x1") + reach))))
    shapes = shapes.withColumn("by", F.explode(F.sequence(region(F.col("y0") - reach), region(F.col("y1") + reach))))

    def parts(df, most, name):
        return df.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    held = sized_broadcast(parts(discs, BLOCK_DISCS, "discs").join(parts(shapes, BLOCK_SHAPES, "shapes"), ["bx", "by"]))

    def dealt(df, own, other, own_part, other_part):
        part = F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")
        return df.join(held, ["bx", "by"]).withColumns({own_part: part, other_part: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop(own, other)

    # Small sides make very many pairs here: with a number of partitions Spark does not merge them by their size.
    many = int(discs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = dealt(discs, "discs", "shapes", "disc_part", "shape_part").repartition(many, *block)
    right = dealt(shapes, "shapes", "discs", "shape_part", "disc_part").repartition(many, *block)
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(made, schema)


def halves():
    """walk(x, y, shapes, settle, meet): calls settle(discs, shapes, cx, cy, e) for groups of discs within e of a centre, which returns the shapes still open, and meet(discs, shapes) for few discs."""

    def walk(x, y, shapes, settle, meet):
        stack = [(np.arange(len(x)), shapes)]
        while stack:
            at, some = stack.pop()
            gx, gy = x[at], y[at]
            lx, hx, ly, hy = gx.min(), gx.max(), gy.min(), gy.max()
            wide, high = hx - lx, hy - ly
            some = settle(at, some, (lx + hx) / 2, (ly + hy) / 2, math.hypot(wide, high) / 2)
            if not len(some[0]):
                continue
            if len(at) <= FEW or max(wide, high) <= 0:
                step = max(1, PAIRS // len(some[0]))
                for first in range(0, len(at), step):
                    meet(at[first:first + step], some)
                continue
            half = len(at) // 2
            order = np.argpartition(gx if wide >= high else gy, half)
            stack += [(at[order[:half]], some), (at[order[half:]], some)]

    return walk


def counted(discs: DataFrame, pid: str, shapes: DataFrame, radius: float, most: float, under: float) -> DataFrame:
    """pid, n and n_strict: the weights w of the shapes whose squared distance is at most `most` and at most `under`; a disc may have several rows, one without shapes none."""
    kind = discs.schema[pid].dataType.simpleString()
    walk = halves()

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (left.column(c).to_numpy() for c in ("x", "y"))
        n, strict = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if len(x) and len(right):
            x0, y0, x1, y1, w = (right.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1", "w"))
            spots = bool((x0 == x1).all() and (y0 == y1).all())
            slack = 1e-9 * max(radius, *(float(np.abs(v).max()) for v in (x, y, x0, y0, x1, y1)))

            def squares(px, py, some):
                if spots:
                    dx, dy = px - some[0], py - some[1]
                else:
                    dx = np.maximum(np.maximum(some[0] - px, px - some[2]), 0.0)
                    dy = np.maximum(np.maximum(some[1] - py, py - some[3]), 0.0)
                return dx * dx + dy * dy

            def settle(at, some, cx, cy, e):
                d = np.sqrt(squares(cx, cy, some))
                sure = d < radius - e - slack
                whole = some[-1][sure].sum()
                n[at] += whole
                strict[at] += whole
                open_ = ~sure & (d <= radius + e + slack)
                return tuple(v[open_] for v in some)

            def meet(at, some):
                d = squares(x[at, None], y[at, None], some)
                weights = some[-1]
                if (weights == 1).all():
                    n[at] += np.count_nonzero(d <= most, axis=1)
                    strict[at] += np.count_nonzero(d <= under, axis=1)
                else:
                    n[at] += np.where(d <= most, weights, 0).sum(axis=1)
                    strict[at] += np.where(d <= under, weights, 0).sum(axis=1)

            walk(x, y, (x0, y0, w) if spots else (x0, y0, x1, y1, w), settle, meet)
        some = np.flatnonzero(n)
        return pa.table({pid: left.column(pid).take(pa.array(some)), "n": n[some], "n_strict": strict[some]})

    return in_blocks(discs, pid, shapes, radius, made, f"`{pid}` {kind}, n bigint, n_strict bigint")


def covered(discs: DataFrame, pid: str, boxes: DataFrame, radius: float) -> DataFrame:
    """pid and area: the surface that each disc shares with the boxes, summed box by box; a disc may have several rows, one without boxes none."""
    kind = discs.schema[pid].dataType.simpleString()
    walk = halves()

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (left.column(c).to_numpy() for c in ("x", "y"))
        area, full, r2 = np.zeros(len(x)), math.pi * radius * radius, radius * radius

        def below(v):
            """The surface of the disc on one side of a line at v, and v, cut to the disc."""
            v = np.clip(v, -radius, radius)
            return v, full / 2 + v * np.sqrt(np.maximum(r2 - v * v, 0.0)) + r2 * np.arcsin(v / radius)

        def corner(a, ca, b, cb):
            """The surface of the disc below a and below b."""
            inner = a * b + (ca + cb) / 2 - full / 4
            outer = np.where(a >= 0, np.where(b >= 0, ca + cb - full, cb), np.where(b >= 0, ca, 0.0))
            return np.where(a * a + b * b <= r2, inner, outer)

        if len(x) and len(right):
            shapes = tuple(right.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
            slack = 1e-9 * max(radius, *(float(np.abs(v).max()) for v in (x, y, *shapes)))

            def settle(at, some, cx, cy, e):
                x0, y0, x1, y1 = some
                dx, dy = np.maximum(np.maximum(x0 - cx, cx - x1), 0.0), np.maximum(np.maximum(y0 - cy, cy - y1), 0.0)
                met = np.sqrt(dx * dx + dy * dy) <= radius + e + slack
                x0, y0, x1, y1 = (v[met] for v in some)
                out = radius + e + slack
                around = (x0 <= cx - out) & (x1 >= cx + out) & (y0 <= cy - out) & (y1 >= cy + out)
                gx, gy = np.maximum(np.abs(x0 - cx), np.abs(x1 - cx)), np.maximum(np.abs(y0 - cy), np.abs(y1 - cy))
                inside = np.sqrt(gx * gx + gy * gy) <= radius - e - slack
                area[at] += full * np.count_nonzero(around) + ((x1 - x0) * (y1 - y0))[inside].sum()
                rest = ~around & ~inside
                return x0[rest], y0[rest], x1[rest], y1[rest]

            def meet(at, some):
                x0, y0, x1, y1 = some
                px, py = x[at, None], y[at, None]
                (a0, c0), (a1, c1), (b0, d0), (b1, d1) = below(x0 - px), below(x1 - px), below(y0 - py), below(y1 - py)
                shares = corner(a1, c1, b1, d1) - corner(a0, c0, b1, d1) - corner(a1, c1, b0, d0) + corner(a0, c0, b0, d0)
                area[at] += shares.sum(axis=1)

            walk(x, y, shapes, settle, meet)
        return pa.table({pid: left.column(pid), "area": area})

    return in_blocks(discs, pid, boxes, radius, made, f"`{pid}` {kind}, area double")
