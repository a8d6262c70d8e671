"""Polygons with many vertices as quadtree cells: whole cells inside, and border cells that carry only their own edges.

A point lies in a polygon when a ray to the right meets an odd number of its edges. Within a cell that number has three parts: the edges
that enter the cell, tested one by one; a constant, for the edges further right; and the heights at which that constant flips,
because an edge further right ends there and the next one belongs to the cell or lies left of it. Heights at which two edges end cancel out, so a
cell keeps few of them, and one without edges keeps none if the rings are closed. All parts are comparisons of given coordinates; the
margin around an edge only decides in which cells it is tested. So the result is that of testing all edges, open or crossing rings included.

Cells with more than `leaf_edges` edges are divided, sixteen at a time, all polygons in one job a round. Edges are rows meanwhile, so
one outline of very many vertices is spread over many keys from the second round on.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hectara.functions.geometry import segments
from hectara.session import cut_lineage

LEAF_EDGES = 32
ROUNDS = 8  # of two halvings each; a cell that is still full then keeps all its edges
CELL = ("_pid", "level", "cx", "cy")
ENDS = ("ax", "ay", "bx", "by")


def ring_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, segments))


def edge_count(rings: Column) -> Column:
    """Edges of all rings, 0 without rings."""
    return F.coalesce(F.aggregate(rings, F.lit(0), lambda n, ring: n + F.greatest(F.size(ring) - 1, F.lit(0))), F.lit(0))


def _side() -> Column:
    return F.pow(F.lit(2.0), F.col("level"))


def _index(value: Column) -> Column:
    return F.floor(value / _side()).cast("bigint")


def _range(first: Column, last: Column) -> Column:
    """first to last, empty where last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _divided(parents: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges by child cell, and the odd marks of child cells: v is a height at which the count flips, null stands for the constant.

    parents: _pid, level (of the children), x0, x1, y0, y1 (child cells), base, breaks; edges: _pid, level, x0, x1, y0, y1 and their ends.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.withColumn("cy", F.explode(_range(F.greatest(_index(low), F.col("y0")), F.least(_index(high), F.col("y1")))))
    bottom, top = F.col("cy") * _side(), (F.col("cy") + 1) * _side()

    def at(y: Column) -> Column:
        within = F.least(F.greatest(y, low), high)
        return F.col("ax") + (F.col("bx") - F.col("ax")) * ((within - F.col("ay")) / (F.col("by") - F.col("ay")))

    margin = (F.abs("ax") + F.abs("bx")) * 1e-12
    rows = rows.withColumn("first", _index(F.least(at(bottom), at(top)) - margin)).withColumn("last", _index(F.greatest(at(bottom), at(top)) + margin))
    placed = rows.withColumn("cx", F.explode(_range(F.greatest("first", "x0"), F.least("last", "x1")))).select(*CELL, *ENDS)

    def height(c: str) -> Column:
        return F.when((F.col(c) > bottom) & (F.col(c) < top), F.array(F.struct(F.col(c).alias("v")))).otherwise(none)

    none = F.array().cast("array<struct<v:double>>")
    constant = F.array(F.struct(F.lit(None).cast("double").alias("v")))
    crosses = F.when((F.col("ay") <= bottom) != (F.col("by") <= bottom), constant).otherwise(none)
    right = rows.withColumn("mark", F.explode(F.concat(crosses, height("ay"), height("by"))))
    right = right.withColumn("cx", F.explode(_range(F.col("x0"), F.least(F.col("first") - 1, F.col("x1"))))).select(*CELL, "mark.v")
    own = parents.withColumn("cx", F.explode(_range(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(_range(F.col("y0"), F.col("y1"))))
    below = F.size(F.filter("breaks", lambda v: v <= bottom))
    kept = F.transform(F.filter("breaks", lambda v: (v > bottom) & (v < top)), lambda v: F.struct(v.alias("v")))
    own = own.withColumn("mark", F.explode(F.concat(F.when((F.col("base") + below) % 2 == 1, constant).otherwise(none), kept))).select(*CELL, "mark.v")
    odd = right.unionByName(own).groupBy(*CELL, "v").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1").drop("odd")
    return placed, odd


def _cells(placed: DataFrame, odd: DataFrame) -> DataFrame:
    """_pid, level, cx, cy, base, breaks and n, the number of edges; cells outside the polygon have no row."""
    nothing = F.lit(None).cast("double")
    counted = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).select(*CELL, nothing.alias("v"), F.lit(0).alias("base"), "n")
    marked = odd.select(*CELL, "v", F.col("v").isNull().cast("int").alias("base"), F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(marked).groupBy(*CELL).agg(F.max("base").alias("base"), F.collect_list("v").alias("breaks"), F.sum("n").alias("n"))


def tessellate(polygons: DataFrame, level: Column, envelope: tuple[str, str, str, str], leaf_edges: int = LEAF_EDGES) -> DataFrame:
    """The columns of polygons but rings, with level, cx, cy, _base, _breaks and _edges of each cell; the cells of a polygon are disjoint.

    level: exponent of a cell side at least as long as the envelope. Edges without height or with a null end never meet a ray and are left out.
    """
    minx, miny, maxx, maxy = (F.col(c) for c in envelope)
    shapes = cut_lineage(polygons.withColumn("_pid", F.monotonically_increasing_id()))
    roots = shapes.select("_pid", "rings", (level - 2).cast("int").alias("level"), *[F.col(c) for c in envelope])
    roots = roots.select("_pid", "level", "rings", _index(minx).alias("x0"), _index(maxx).alias("x1"), _index(miny).alias("y0"), _index(maxy).alias("y1"))
    box = ["x0", "x1", "y0", "y1"]
    edges = roots.select("_pid", "level", *box, F.explode(ring_edges(F.col("rings"))).alias("e")).select("_pid", "level", *box, "e.*").dropna().filter("ay != by")
    parents = roots.select("_pid", "level", *box, F.lit(0).alias("base"), F.array().cast("array<double>").alias("breaks"))
    leaves = []
    for number in range(ROUNDS):
        placed, odd = _divided(parents, edges)
        placed = cut_lineage(placed)
        cells = cut_lineage(_cells(placed, odd))
        full = F.col("n") > leaf_edges if number < ROUNDS - 1 else F.lit(False)
        done = cells.filter(~full)
        own = placed.join(done.filter("n > 0").select(*CELL), [*CELL]).groupBy(*CELL).agg(F.collect_list(F.struct(*ENDS)).alias("edges"))
        leaves.append(done.drop("n").join(own, [*CELL], "left"))
        dense = cells.filter(full)
        if dense.isEmpty():
            break
        inner = [(F.col(c) * 4 + d).alias(f"{c[1]}{i}") for c in ("cx", "cy") for i, d in ((0, 0), (1, 3))]
        finer = (F.col("level") - 2).alias("level")
        edges = placed.join(dense.select(*CELL), [*CELL]).select("_pid", finer, *inner, *ENDS)
        parents = dense.select("_pid", finer, *inner, "base", "breaks")
    cells = reduce(DataFrame.unionByName, leaves).withColumnsRenamed({c: f"_{c}" for c in ("base", "breaks", "edges")})
    return cells.join(shapes.drop("rings"), "_pid").drop("_pid")


def in_cell(x: Column, y: Column) -> Column:
    """Whether a point of the cell lies in the polygon; borders as in contains_point."""
    hits = F.aggregate(
        F.coalesce("_edges", F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")),
        F.col("_base") + F.size(F.filter("_breaks", lambda v: v <= y)),
        lambda n, e: n
        + F.when(
            ((e["ay"] <= y) != (e["by"] <= y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]), 1
        ).otherwise(0),
    )
    return hits % 2 == 1
