"""Distributed nearest-neighbour, within-radius and point-in-polygon joins on grid cells.

Points are bucketed into square cells. The finest ("leaf") cell of a category is the first
halving of its extent at which no cell holds more than a few distinct points, so a dense
spot gets small cells instead of one overfull bucket. Cell counts of all coarser levels form a
pyramid: searches walk it from coarse to fine and carry only the cells that can still matter,
so neither a hot cell nor a far-away query makes all pairs of a group. Results are exact.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.operators.discs import counted, covered, largest_square
from hectara.operators.tessellation import LEAF_EDGES, edge_count, in_cell, tessellate
from hectara.session import cut_lineage, shuffled

LEAF_POINTS = 16
EXTRA_LEVELS = 8  # halvings allowed below what evenly spread points would need
START_CELLS_LEVEL = 3  # unbounded searches start from at most 64 cells per category
BROADCAST_CELLS = 200_000
BROADCAST_POINTS = 1_000_000


@dataclass
class Pyramid:
    """Cell counts per level plus the points keyed by leaf cell, both checkpointed."""

    points: DataFrame  # cat, cx, cy (leaf), fx, fy, n, payload columns
    cells: DataFrame  # cat, level, cx, cy, cnt, payload columns
    minx: float
    miny: float
    span: float
    leaf: dict[str, int]  # leaf level per category
    sizes: dict[int, int]  # number of cells per level
    spots: int  # number of distinct locations over all categories

    def side(self, level: int) -> float:
        return self.span / 2**level

    def level_for(self, length: float) -> int:
        """The finest level whose cells are at least as long as length."""
        if length >= self.span:
            return 0
        return int(math.floor(math.log2(self.span / length)))

    def leaf_column(self, cat: Column) -> Column:
        return F.create_map([F.lit(v) for pair in self.leaf.items() for v in pair])[cat]

    def at_level(self, level: int) -> DataFrame:
        cells = self.cells.filter(F.col("level") == level).drop("level")
        return F.broadcast(cells) if self.sizes.get(level, 0) <= BROADCAST_CELLS else cells


def build_pyramid(features: DataFrame, x: str, y: str, payload: dict[str, Column], by: str | None = None, leaf_points: int = LEAF_POINTS) -> Pyramid | None:
    """payload columns are aggregates (count, min, ...) that also combine across cells by the same min/sum."""
    cat = F.col(by) if by else F.lit("all")
    # Copies of one location become a single row before anything is joined.
    places = features.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & cat.isNotNull()).groupBy(
        cat.cast("string").alias("cat"), F.col(x).cast("double").alias("fx"), F.col(y).cast("double").alias("fy")
    ).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in payload.items()])
    places = cut_lineage(places)
    extent = places.agg(
        F.min("fx").alias("x0"), F.max("fx").alias("x1"), F.min("fy").alias("y0"), F.max("fy").alias("y1"), F.count(F.lit(1)).alias("n")
    ).first()
    if not extent["n"]:
        return None
    span = max(extent["x1"] - extent["x0"], extent["y1"] - extent["y0"], 1e-6) * (1 + 1e-9)
    deepest = min(24, max(0, math.ceil(math.log(max(extent["n"] / leaf_points, 1), 4)) + EXTRA_LEVELS))
    fine = span / 2**deepest
    indexed = places.withColumn("ix", F.floor((F.col("fx") - extent["x0"]) / fine)).withColumn("iy", F.floor((F.col("fy") - extent["y0"]) / fine))
    combine = [F.min(k).alias(k) for k in payload]
    cells = (
        indexed.groupBy("cat", "ix", "iy")
        .agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("spots"), *combine)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
        .groupBy(
            "cat",
            "level",
            F.expr(f"shiftright(ix, {deepest} - level)").alias("cx"),
            F.expr(f"shiftright(iy, {deepest} - level)").alias("cy"),
        )
        .agg(F.sum("cnt").alias("cnt"), F.sum("spots").alias("spots"), *combine)
    )
    cells = cut_lineage(cells)
    # One small row per category and level; the only figures that come to the driver.
    stats = cells.groupBy("cat", "level").agg(F.max("spots").alias("most"), F.count(F.lit(1)).alias("cells")).collect()
    leaf: dict[str, int] = {}
    sizes: dict[int, int] = {}
    for row in stats:
        sizes[row["level"]] = sizes.get(row["level"], 0) + row["cells"]
        if row["most"] <= leaf_points or row["level"] == deepest:
            leaf[row["cat"]] = min(leaf.get(row["cat"], deepest), row["level"])
    pyramid = Pyramid(indexed, cells.drop("spots"), extent["x0"], extent["y0"], span, leaf, sizes, extent["n"])
    shift = F.lit(deepest) - pyramid.leaf_column(F.col("cat"))
    pyramid.points = (
        indexed.withColumn("shift", shift)
        .withColumn("cx", F.expr("shiftright(ix, shift)"))
        .withColumn("cy", F.expr("shiftright(iy, shift)"))
        .drop("ix", "iy", "shift")
    )
    return pyramid


def _cell(p: Pyramid, level, x: str = "qx", y: str = "qy"):
    side = F.lit(p.span) / F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(p.side(level))
    return F.floor((F.col(x) - p.minx) / side).cast("bigint"), F.floor((F.col(y) - p.miny) / side).cast("bigint")


def _box_distances(p: Pyramid, level: int) -> tuple[Column, Column]:
    """Nearest and farthest distance from the query point to the cell box, widened by a rounding margin."""
    side, eps = p.side(level), p.span * 1e-9
    lx, ly = F.col("cx") * side + p.minx, F.col("cy") * side + p.miny
    dx = F.greatest(lx - F.col("qx"), F.col("qx") - lx - side, F.lit(0.0))
    dy = F.greatest(ly - F.col("qy"), F.col("qy") - ly - side, F.lit(0.0))
    gx = F.greatest(F.abs(F.col("qx") - lx), F.abs(F.col("qx") - lx - side))
    gy = F.greatest(F.abs(F.col("qy") - ly), F.abs(F.col("qy") - ly - side))
    return F.sqrt(dx * dx + dy * dy) - eps, F.sqrt(gx * gx + gy * gy) + eps


def _neighbourhood(df: DataFrame) -> DataFrame:
    """Repeat each cell under its nine surrounding keys."""
    steps = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    return (
        df.withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
        .withColumn("kx", F.col("cx") + F.col("sx")).withColumn("ky", F.col("cy") + F.col("sy")).drop("sx", "sy")
    )


def _dist() -> Column:
    dx, dy = F.col("fx") - F.col("qx"), F.col("fy") - F.col("qy")
    return F.sqrt(dx * dx + dy * dy)


def _search_start(p: Pyramid, queries: DataFrame, radius: float | None) -> tuple[int, DataFrame]:
    """Candidate cells to start from: the cells around the query when bounded, else the few coarsest ones."""
    level = min(START_CELLS_LEVEL if radius is None else p.level_for(radius), min(p.leaf.values()))
    if radius is None or p.side(level) < radius:
        level = min(level, START_CELLS_LEVEL)
        return level, queries.join(p.at_level(level), "cat")
    cx, cy = _cell(p, level)
    around = _neighbourhood(p.at_level(level))
    if p.sizes.get(level, 0) * 9 <= BROADCAST_CELLS:
        around = F.broadcast(around)
    keyed = queries.withColumn("kx", cx).withColumn("ky", cy)
    return level, keyed.join(around, ["cat", "kx", "ky"]).drop("kx", "ky")


def _children(p: Pyramid, cands: DataFrame, level: int, drop: list[str]) -> DataFrame:
    finer = p.at_level(level + 1).withColumn("px", F.shiftright("cx", 1)).withColumn("py", F.shiftright("cy", 1))
    if p.sizes.get(level + 1, 0) <= BROADCAST_CELLS:
        finer = F.broadcast(finer)
    up = cands.drop(*drop).withColumnRenamed("cx", "px").withColumnRenamed("cy", "py")
    return up.join(finer, ["cat", "px", "py"]).drop("px", "py")


def nearest(
    queries: DataFrame,
    qid: str,
    features: DataFrame,
    fid: str,
    categories: list[str],
    by: str,
    k: int | dict[str, int] = 1,
    max_distance: float | dict[str, float] | None = None,
    strict: bool = False,
) -> DataFrame:
    """The k nearest features of each category per query: qid, cat, rank, fid, distance.

    Ties go to the smaller fid. max_distance bounds the search (strictly below it when strict).
    Queries carry x, y; features carry x, y. A feature standing on one spot with others keeps its id.
    """
    ks = k if isinstance(k, dict) else {c: k for c in categories}
    caps = max_distance if isinstance(max_distance, dict) else {c: max_distance for c in categories}
    wanted = features.filter(F.col(by).isin(categories))
    p = build_pyramid(wanted, "x", "y", {"first_id": F.min(fid)}, by, leaf_points=8 + 4 * max(ks.values()))
    if p is None:
        empty = queries.select(F.col(qid), F.lit("").alias("cat"), F.lit(0).alias("rank"), F.lit(None).cast(features.schema[fid].dataType).alias("fid"), F.lit(0.0).alias("distance"))
        return empty.filter(F.lit(False))
    present = [c for c in categories if c in p.leaf]
    kcol = F.create_map([F.lit(v) for c in present for v in (c, int(ks[c]))])[F.col("cat")]
    cap_items = [(c, float(caps[c])) for c in present if caps[c] is not None]
    capcol = F.create_map([F.lit(v) for pair in cap_items for v in pair])[F.col("cat")] if cap_items else F.lit(None).cast("double")
    seeds = queries.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        F.col(qid).alias("qid"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"),
        F.explode(F.array(*[F.lit(c) for c in present])).alias("cat"),
    )
    if extent_small(p):
        seeds = spread(seeds, "qid")
    need_ids = any(v > 1 for v in ks.values())
    # Spots keep every id they hold when more than one neighbour is asked for.
    if need_ids:
        spots = wanted.select(F.col(by).cast("string").alias("cat"), F.col("x").cast("double").alias("fx"), F.col("y").cast("double").alias("fy"), F.col(fid).alias("first_id"))
        spot_rank = Window.partitionBy("cat", "fx", "fy").orderBy("first_id")
        spots = spots.withColumn("nth", F.row_number().over(spot_rank)).filter(F.col("nth") <= max(ks.values())).drop("nth")
        points = p.points.drop("first_id", "n").join(spots, ["cat", "fx", "fy"])
    else:
        points = p.points.drop("n")

    def best(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("d", _dist())
        if cap_items:
            limit = capcol
            pairs = pairs.filter(limit.isNull() | ((F.col("d") < limit) if strict else (F.col("d") <= limit)))
        if not need_ids:
            return (
                pairs.groupBy("qid", "cat").agg(F.min(F.struct("d", "first_id")).alias("m"), F.first("qx").alias("qx"), F.first("qy").alias("qy"))
                .select("qid", "cat", "qx", "qy", F.lit(1).alias("rank"), "m.d", "m.first_id")
            )
        w = Window.partitionBy("qid", "cat").orderBy("d", "first_id")
        return pairs.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= max(ks.values())) & (F.col("rank") <= kcol)).select("qid", "cat", "qx", "qy", "rank", "d", "first_id")

    leafcol = p.leaf_column(F.col("cat"))
    # Pass 1: the nine leaf cells around each query. Only the feature side is repeated.
    cx, cy = _cell(p, leafcol)
    keyed = seeds.withColumn("kx", cx).withColumn("ky", cy)
    around = _neighbourhood(points)
    if extent_small(p):
        around = F.broadcast(around)
    first = best(keyed.join(around, ["cat", "kx", "ky"]))
    first = cut_lineage(first)
    side = F.lit(p.span) / F.pow(F.lit(2.0), leafcol)
    gx, gy = F.pmod(F.col("qx") - p.minx, side), F.pmod(F.col("qy") - p.miny, side)
    reach = side + F.least(gx, side - gx, gy, side - gy) - p.span * 1e-9
    done = first.filter(F.col("rank") == kcol).filter(F.col("d") < reach).select("qid", "cat")
    open_queries = seeds.filter(capcol.isNull() | (capcol >= reach)).join(done, ["qid", "cat"], "left_anti")
    parts = [first]
    if cap_items and len(cap_items) == len(present) and all(cap < p.side(p.leaf[c]) for c, cap in cap_items):
        open_queries = None  # every bound lies inside the nine cells
    if open_queries is not None:
        open_queries = cut_lineage(open_queries)
        if not open_queries.isEmpty():
            bound = max(c for _, c in cap_items) if len(cap_items) == len(present) else None
            parts = [first.join(open_queries.select("qid", "cat"), ["qid", "cat"], "left_anti"), best(_descend(p, open_queries, points, bound, kcol, capcol))]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result.select(F.col("qid").alias(qid), "cat", "rank", F.col("first_id").alias("fid"), F.col("d").alias("distance"))


def spread(queries: DataFrame, key: str) -> DataFrame:
    """Hash the narrow query rows by id before a broadcast search. The search then runs on all cores
    and the aggregation by id that follows needs no second exchange."""
    return queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def extent_small(p: Pyramid) -> bool:
    """The counted distinct locations bound the points even when each is repeated under nine cells."""
    return p.spots * 9 <= BROADCAST_POINTS


def _descend(p: Pyramid, queries: DataFrame, points: DataFrame, bound: float | None, kcol: Column, capcol: Column) -> DataFrame:
    """Walk the pyramid keeping the cells that can hold one of the k nearest; pair the last ones with points."""
    level, cands = _search_start(p, queries, bound)
    per_query = Window.partitionBy("qid", "cat")
    finished = []
    deepest = max(p.leaf.values())
    while True:
        near, far = _box_distances(p, level)
        cands = cands.withColumn("near", near).withColumn("far", far)
        seen = F.sum("cnt").over(per_query.orderBy("far", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0))
        cands = cands.withColumn("sure", F.when(seen >= kcol, F.col("far")))
        cands = cands.withColumn("within", F.min("sure").over(per_query))
        limit = F.least(F.col("within"), capcol)  # null-skipping
        cands = cands.filter(limit.isNull() | (F.col("near") <= limit)).drop("sure", "within", "near", "far")
        at_leaf = p.leaf_column(F.col("cat")) == level
        finished.append(cands.filter(at_leaf).select("qid", "cat", "qx", "qy", "cx", "cy"))
        if level == deepest:
            break
        cands = _children(p, cands.filter(~at_leaf).select("qid", "cat", "qx", "qy", "cx", "cy"), level, [])
        level += 1
        if level % 4 == 0:
            cands = cut_lineage(cands)
    last = finished[0]
    for more in finished[1:]:
        last = last.unionByName(more)
    return last.join(F.broadcast(points) if extent_small(p) else points, ["cat", "cx", "cy"])


def within_radius(
    queries: DataFrame,
    qid: str,
    features: DataFrame,
    radius: float,
    first: Column | None = None,
    inclusive: bool = True,
    with_strict: bool = False,
) -> DataFrame:
    """Per query the number of features within radius and, when given, the smallest `first` among them.

    with_strict adds n_strict, the number strictly inside, from the same pass.

    Cells wholly inside the circle contribute their totals; only cells on its rim go down to points.
    Queries without a hit have no row.
    """
    payload = {"pickup": F.min(first)} if first is not None else {}
    p = build_pyramid(features, "x", "y", payload)
    if p is None:
        none = [F.lit(0).cast("bigint").alias(c) for c in (["n", "n_strict"] if with_strict else ["n"])]
        if first is not None:
            none.append(F.lit(None).cast(features.select(first.alias("v")).schema["v"].dataType).alias("first"))
        return queries.select(qid, *none).filter(F.lit(False))
    seeds = queries.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        F.col(qid).alias("qid"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"), F.lit("all").alias("cat")
    )
    extra = list(payload)
    leaf = p.leaf["all"]
    points = F.broadcast(p.points) if extent_small(p) else p.points
    seeds = spread(seeds, "qid")  # the descent is joined with broadcast cells, so queries of one small file would stay in one task
    level, cands = _search_start(p, seeds, radius)
    sums = []
    while level < leaf:
        near, far = _box_distances(p, level)
        cands = cands.withColumn("near", near).withColumn("far", far).filter(F.col("near") <= radius)
        inside = F.col("far") < radius
        sums.append(cands.filter(inside).select("qid", F.col("cnt").alias("n"), F.col("cnt").alias("strict"), *extra))
        cands = _children(p, cands.filter(~inside), level, ["near", "far", "cnt", *extra])
        level += 1
        if level % 4 == 0:
            cands = cut_lineage(cands)
    near, far = _box_distances(p, level)
    rim = cands.filter(near <= radius).select("qid", "cat", "qx", "qy", "cx", "cy")
    pairs = rim.join(points, ["cat", "cx", "cy"]).withColumn("d", _dist())
    pairs = pairs.filter(F.col("d") <= radius if inclusive else F.col("d") < radius)
    sums.append(pairs.select("qid", "n", F.when(F.col("d") < radius, F.col("n")).otherwise(0).alias("strict"), *extra))
    out = sums[0]
    for more in sums[1:]:
        out = out.unionByName(more)
    return out.groupBy(F.col("qid").alias(qid)).agg(
        F.sum("n").alias("n"), *([F.sum("strict").alias("n_strict")] if with_strict else []), *[F.min(k).alias("first") for k in extra]
    )


def counts_in_discs(queries: DataFrame, qid: str, features: DataFrame, radius: float) -> DataFrame:
    """qid, n and n_strict of `within_radius`, for very many queries: discs meet points in blocks (`discs`), so no row is made for a query and a cell or point."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    located = features.filter((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    places = cut_lineage(located.groupBy(x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1")).agg(F.count(F.lit(1)).alias("w")))
    hits = counted(queries, qid, places, radius, largest_square(radius, False), largest_square(radius, True))
    return hits.groupBy(qid).agg(F.sum("n").alias("n"), F.sum("n_strict").alias("n_strict"))


def polygon_cells(polygons: DataFrame, minx: str, miny: str, maxx: str, maxy: str) -> DataFrame:
    """Each polygon (with its level) in the at most four cells of the level whose cells are no smaller than its envelope."""
    side = F.pow(F.lit(2.0), F.col("level"))

    def index(c):
        return F.floor(F.col(c) / side).cast("bigint")

    return polygons.withColumn("cx", F.explode(F.sequence(index(minx), index(maxx)))).withColumn("cy", F.explode(F.sequence(index(miny), index(maxy))))


def point_cells(points: DataFrame, x: str, y: str, levels: list[int]) -> DataFrame:
    """Repeat each point once per polygon size class."""
    side = F.pow(F.lit(2.0), F.col("level"))
    return (
        points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumn("cx", F.floor(F.col(x) / side).cast("bigint"))
        .withColumn("cy", F.floor(F.col(y) / side).cast("bigint"))
    )


def points_in_polygons(
    points: DataFrame, x: str, y: str, polygons: DataFrame, envelope: tuple[str, str, str, str], on: list[str] | None = None, leaf_edges: int = LEAF_EDGES
) -> DataFrame:
    """Inner join of points to the polygons (column rings, not returned) that contain them.

    Polygons of at most leaf_edges edges meet points whole, on at most four cells; upright rectangles go without their rings, since the
    envelope decides. Larger polygons are tessellated: a point meets the one cell that holds it, and tests only the edges there. All give the same rows.
    """
    from hectara.functions.geometry import contains_point, is_rectangle

    minx, miny, maxx, maxy = (F.col(c) for c in envelope)
    bounded = F.coalesce((maxx - minx < float("inf")) & (maxy - miny < float("inf")), F.lit(False))
    sized = polygons.withColumns({"level": _size_level(envelope), "_box": bounded & is_rectangle(F.col("rings"), envelope)})
    sized = sized.withColumn("_large", (edge_count(F.col("rings")) > leaf_edges) & bounded & ~F.col("_box"))
    kinds = [(r["level"], r["_large"], r["_box"]) for r in sized.select("level", "_large", "_box").distinct().collect() if r["level"] is not None]  # at most a few dozen sizes
    inside = (F.col(x) >= minx) & (F.col(x) <= maxx) & (F.col(y) >= miny) & (F.col(y) <= maxy)
    keys = ["level", "cx", "cy", *(on or [])]
    whole = polygon_cells(sized.filter(~F.col("_large")).drop("_large"), *envelope)
    boxes, small = whole.filter("_box").drop("_box", "rings"), whole.filter(~F.col("_box")).drop("_box")
    parts = []
    box_levels, small_levels = ({level for level, large, box in kinds if not large and box == b} for b in (True, False))
    if box_levels:
        held = (F.col(x) >= minx) & (F.col(x) < maxx) & (F.col(y) >= miny) & (F.col(y) < maxy)
        parts.append(point_cells(points, x, y, sorted(box_levels)).join(shuffled(boxes), keys).filter(held).drop("level", "cx", "cy"))
    if small_levels or not parts:
        pairs = point_cells(points, x, y, sorted(small_levels) or [0]).join(shuffled(small), keys)
        parts.append(pairs.filter(inside).filter(contains_point(F.col("rings"), F.col(x), F.col(y))).drop("level", "cx", "cy", "rings"))
    hits = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    if not any(large for _, large, _ in kinds):
        return hits
    cells = cut_lineage(tessellate(sized.filter("_large").drop("_large", "_box", "level"), _size_level(envelope), envelope, leaf_edges))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    met = point_cells(points, x, y, levels).join(shuffled(cells), keys).filter(inside & in_cell(F.col(x), F.col(y)))
    return hits.unionByName(met.select(hits.columns))


BOX_HALVINGS = 3  # a rectangle stands in at most nine by nine cells


def polygon_parts(polygons: DataFrame, key: str, envelope: tuple[str, str, str, str], leaf_edges: int = LEAF_EDGES) -> DataFrame | None:
    """The cells of polygons (key, rings) with finite envelopes: key, level, cx, cy, the envelope, whole, _base, _breaks, _edges; None without any.

    whole: every point of the cell lies in the polygon. Upright rectangles have at most 81 cells of an eighth of their size, other polygons
    those of `tessellate`. So the rows grow with the polygons and their edges, not with what is looked for in them.
    """
    from hectara.functions.geometry import is_rectangle

    minx, miny, maxx, maxy = (F.col(c) for c in envelope)
    bounded = F.coalesce((maxx - minx < float("inf")) & (maxy - miny < float("inf")), F.lit(False))
    sized = polygons.select(key, "rings", *envelope).filter(bounded).withColumn("_box", is_rectangle(F.col("rings"), envelope))
    kinds = {r["_box"] for r in sized.select("_box").distinct().collect()}
    marks = {"_base": F.lit(0), "_breaks": F.array().cast("array<double>"), "_edges": F.lit(None).cast("array<struct<ax:double,ay:double,bx:double,by:double>>")}
    columns = [key, "level", "cx", "cy", *envelope, "whole", "_box", *marks]
    parts = []
    if True in kinds:
        boxes = sized.filter("_box").drop("rings").withColumn("level", _size_level(envelope) - BOX_HALVINGS)
        side = F.pow(F.lit(2.0), F.col("level"))
        left, low = F.col("cx") * side, F.col("cy") * side
        whole = (minx <= left) & (left + side <= maxx) & (miny <= low) & (low + side <= maxy)
        parts.append(polygon_cells(boxes, *envelope).withColumns({"whole": whole, **marks}).select(columns))
    if False in kinds:
        cells = tessellate(sized.filter(~F.col("_box")), _size_level(envelope), envelope, leaf_edges)
        whole = F.col("_edges").isNull() & (F.size("_breaks") == 0) & (F.col("_base") % 2 == 1)
        parts.append(cells.withColumn("whole", whole).select(columns))
    if not parts:
        return None
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def first_polygon(points: DataFrame, pid: str, x: str, y: str, polygons: DataFrame, key: str, envelope: tuple[str, str, str, str]) -> DataFrame:
    """pid and the smallest key of the polygons (key, rings) that contain the point; points in no polygon have no row.

    Where a polygon covers a cell whole, no polygon with a larger key can be the first of a point there. Such rows go before points are met, so a
    point meets few polygons however many lie on top of each other.
    """
    located = points.select(pid, x, y)
    parts = polygon_parts(polygons, key, envelope)
    minx, miny, maxx, maxy = (F.col(c) for c in envelope)
    unbounded = polygons.select(key, "rings", *envelope).filter(~F.coalesce((maxx - minx < float("inf")) & (maxy - miny < float("inf")), F.lit(False)))
    hits = points_in_polygons(located, x, y, unbounded, envelope).select(pid, key)
    if parts is not None:
        cell = ["level", "cx", "cy"]
        parts = cut_lineage(parts)
        covered = cut_lineage(parts.groupBy(*cell).agg(F.min(F.when(F.col("whole"), F.col(key))).alias("_first")))
        levels = sorted(r["level"] for r in covered.select("level").distinct().collect())  # at most a few dozen sizes
        above = F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v >= F.col("level"))
        up = covered.select(*cell, F.explode(above).alias("_up"))
        up = up.select(*cell, "_up", *[F.expr(f"shiftright({c}, _up - level)").alias(f"_{c}") for c in ("cx", "cy")])
        over = covered.filter("_first is not null").toDF("_up", "_cx", "_cy", "_first")
        best = up.join(shuffled(over), ["_up", "_cx", "_cy"]).groupBy(*cell).agg(F.min("_first").alias("_first"))
        candidate = F.col("_first").isNull() | (F.col(key) < F.col("_first")) | (F.col("whole") & (F.col(key) == F.col("_first")))
        kept = cut_lineage(parts.join(shuffled(best), cell, "left").filter(candidate).drop("_first", "whole"))
        held = F.when(F.col("_box"), (F.col(x) < maxx) & (F.col(y) < maxy)).otherwise(in_cell(F.col(x), F.col(y)))
        inside = (F.col(x) >= minx) & (F.col(x) <= maxx) & (F.col(y) >= miny) & (F.col(y) <= maxy)
        met = point_cells(located, x, y, levels).join(shuffled(kept), cell).filter(inside & held)
        hits = hits.unionByName(met.select(pid, key))
    return hits.groupBy(pid).agg(F.min(key).alias(key))


def _covered(df: DataFrame, env: tuple[str, str, str, str], level: str) -> DataFrame:
    side = F.pow(F.lit(2.0), F.col(level))

    def index(c):
        return F.floor(F.col(c) / side).cast("bigint")

    minx, miny, maxx, maxy = env
    return df.withColumn("cx", F.explode(F.sequence(index(minx), index(maxx)))).withColumn("cy", F.explode(F.sequence(index(miny), index(maxy))))


def _size_level(env: tuple[str, str, str, str]) -> Column:
    minx, miny, maxx, maxy = (F.col(c) for c in env)
    return F.greatest(F.lit(-10), F.ceil(F.log2(F.greatest(maxx - minx, maxy - miny, F.lit(1e-3))))).cast("int")


ENV_A, ENV_B = ("aminx", "aminy", "amaxx", "amaxy"), ("bminx", "bminy", "bmaxx", "bmaxy")


BROADCAST_SHAPES = 20_000


def envelope_pairs(a: DataFrame, b: DataFrame, on: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Pairs whose envelopes meet, once each. a carries aminx.. and b carries bminx.. columns.

    When b is counted to be small it is broadcast, and a is hashed by `key` first, so that the
    refinement runs on all cores and a later aggregation by key needs no exchange.

    Both sides meet at the coarser of their two size levels, where each covers at most four
    cells: a rises to the levels that b has and meets b at its own, then b rises to the higher
    levels of a. So one huge shape meets each small one once and small ones meet only neighbours.
    A pair counts only in the cell that holds the lower left corner of the common box.
    """
    b = cut_lineage(b.withColumn("blevel", _size_level(ENV_B)))
    small = b.limit(BROADCAST_SHAPES + 1).count() <= BROADCAST_SHAPES
    if small and key:
        a = spread(a, key)
    a = a.withColumn("alevel", _size_level(ENV_A))
    levels = {n: sorted(r[0] for r in df.select(n).distinct().collect() if r[0] is not None) for df, n in ((a, "alevel"), (b, "blevel"))}
    hint = F.broadcast if small else shuffled

    def risen(df: DataFrame, own: str, to: list[int], among) -> DataFrame:
        return df.withColumn("level", F.explode(F.filter(F.array(*[F.lit(v) for v in to]).cast("array<int>"), lambda v: among(v, F.col(own)))))

    keys = ["level", "cx", "cy", *(on or [])]
    up = _covered(risen(a, "alevel", levels["blevel"], lambda v, own: v >= own), ENV_A, "level")
    down = _covered(risen(b, "blevel", levels["alevel"], lambda v, own: v > own), ENV_B, "level")
    pairs = up.join(hint(_covered(b.withColumn("level", F.col("blevel")), ENV_B, "level")), keys)
    pairs = pairs.unionByName(_covered(a.withColumn("level", F.col("alevel")), ENV_A, "level").join(hint(down), keys))
    side = F.pow(F.lit(2.0), F.col("level"))
    owner = (F.floor(F.greatest("aminx", "bminx") / side) == F.col("cx")) & (F.floor(F.greatest("aminy", "bminy") / side) == F.col("cy"))
    meet = (F.col("aminx") <= F.col("bmaxx")) & (F.col("bminx") <= F.col("amaxx")) & (F.col("aminy") <= F.col("bmaxy")) & (F.col("bminy") <= F.col("amaxy"))
    return pairs.filter(meet & owner).drop("level", "cx", "cy", "alevel", "blevel")


def with_envelope(df: DataFrame, rings: str, names: tuple[str, str, str, str]) -> DataFrame:
    from hectara.functions.geometry import envelope

    box = envelope(F.col(rings))
    return df.select("*", *[box[k].alias(n) for k, n in zip(("minx", "miny", "maxx", "maxy"), names)])


def disc_envelope(df: DataFrame, x: str, y: str, radius: float, names: tuple[str, str, str, str] = ENV_A) -> DataFrame:
    return df.select(
        "*",
        (F.col(x) - radius).alias(names[0]), (F.col(y) - radius).alias(names[1]),
        (F.col(x) + radius).alias(names[2]), (F.col(y) + radius).alias(names[3]),
    )


def largest_overlap(items: DataFrame, item_id: str, areas: DataFrame, area_id: str, on: list[str]) -> DataFrame:
    """Per item the area with the largest common surface above zero; ties to the smaller area id.

    An area of several parts has a row for each (`parts.one_row_a_part`); their surfaces are added up.
    """
    from hectara.functions.geometry import overlap_area, signed_edges

    a = with_envelope(items.select(item_id, *on, "rings"), "rings", ENV_A).withColumn("aedges", signed_edges(F.col("rings"))).drop("rings")
    b = with_envelope(areas.select(F.col(area_id).alias("area_id"), *on, "rings"), "rings", ENV_B).withColumn("bedges", signed_edges(F.col("rings"))).drop("rings")
    common = envelope_pairs(a, b, on, key=item_id).select(
        item_id, "area_id", overlap_area(F.col("aedges"), F.col("bedges"), F.least("aminy", "bminy")).alias("overlap")
    )
    common = common.groupBy(item_id, "area_id").agg(F.sum("overlap").alias("overlap"))
    best = F.max(F.struct(F.col("overlap"), (-F.col("area_id")).alias("neg")))
    return common.filter(F.col("overlap") > 1e-9).groupBy(item_id).agg(best.alias("m")).select(item_id, (-F.col("m.neg")).alias("area_id"), "m.overlap")


WIDE_POLYGON = 32  # radii


def boxes_apart(polygons: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Upright rectangles of at most WIDE_POLYGON radii as x0, y0, x1, y1 and w, written, and the other polygons: envelope (ENV_B) and rings, null for the wide rectangles."""
    from hectara.functions.geometry import is_rectangle

    shapes = with_envelope(polygons, "rings", ENV_B)
    minx, miny, maxx, maxy = (F.col(c) for c in ENV_B)
    box = is_rectangle(F.col("rings"), ENV_B)
    near = box & (F.greatest(maxx - minx, maxy - miny) <= WIDE_POLYGON * radius)
    shapes = cut_lineage(shapes.withColumns({"rings": F.when(~box, F.col("rings")), "_near": near}))
    boxes = shapes.filter("_near").select(minx.alias("x0"), miny.alias("y0"), maxx.alias("x1"), maxy.alias("y1"), F.lit(1).cast("bigint").alias("w"))
    return boxes, shapes.filter(~F.coalesce("_near", F.lit(False))).drop("_near")


def coverage_percent(points: DataFrame, pid: str, polygons: DataFrame, radius: float) -> DataFrame:
    """Percent of the disc around each point covered, summed per polygon (overlaps count twice).

    edges.union_coverage_percent counts what several polygons cover once. Upright rectangles meet discs in blocks (`discs`), other polygons edge by edge.
    """
    spots = points.select(pid, "x", "y")
    boxes, shapes = boxes_apart(polygons.select("rings"), radius)
    areas = covered(spots, pid, boxes, radius)
    if not shapes.isEmpty():
        areas = areas.unionByName(covered_by_edges(spots, pid, shapes, radius))
    sums = areas.groupBy(pid).agg((F.sum("area") / (math.pi * radius * radius) * 100).alias("pct"))
    return points.select(pid).join(sums, pid, "left").select(pid, F.coalesce("pct", F.lit(0.0)).alias("pct"))


def covered_by_edges(spots: DataFrame, pid: str, shapes: DataFrame, radius: float) -> DataFrame:
    """pid and area, a row for each edge of a polygon that meets the disc: its signed share. shapes: the second of `boxes_apart`."""
    from hectara.functions.geometry import disc_pieces, oriented_edges, vertex

    minx, miny, maxx, maxy = (F.col(c) for c in ENV_B)
    common = F.coalesce(F.greatest(maxx - minx, maxy - miny) <= WIDE_POLYGON * radius, F.lit(False))
    # Discs stand in one cell of half a radius each and polygons in all cells that a disc may reach them from, so pairs spread over many keys
    # even where all polygons are of one size. Only much larger polygons meet discs by size levels.
    side = radius / 2

    def index(c: Column) -> Column:
        return F.floor(c / side).cast("bigint")

    placed = shapes.filter(common).withColumn("cx", F.explode(F.sequence(index(minx - radius), index(maxx + radius)))).withColumn("cy", F.explode(F.sequence(index(miny - radius), index(maxy + radius))))
    # Small sides make very many pairs here: with a number of partitions Spark does not merge them by their size.
    many = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = spots.withColumns({"cx": index(F.col("x")), "cy": index(F.col("y"))}).repartition(many, "cx", "cy")
    near = keyed.join(shuffled(placed.repartition(many, "cx", "cy")), ["cx", "cy"]).drop("cx", "cy")
    far = envelope_pairs(disc_envelope(spots, "x", "y", radius), shapes.filter(~common), key=pid).select(near.columns)
    dx = F.greatest(minx - F.col("x"), F.col("x") - maxx, F.lit(0.0))
    dy = F.greatest(miny - F.col("y"), F.col("y") - maxy, F.lit(0.0))
    met = near.unionByName(far).filter(dx * dx + dy * dy < radius * radius)
    corners = [vertex(a, b) for a, b in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy))]
    around = F.array(*[F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.lit(1.0).alias("w")) for a, b in zip(corners, [*corners[1:], corners[0]])])
    edges = F.when(F.col("rings").isNull(), around).otherwise(oriented_edges(F.col("rings")))
    pairs = met.select(pid, "x", "y", edges.alias("edges"))
    # Signed shares of all edges of all polygons simply add up to the covered area.
    return disc_pieces(pairs, "x", "y", "edges", radius, "area").select(pid, "area")


def count_touching(points: DataFrame, pid: str, polygons: DataFrame, radius: float) -> DataFrame:
    """Number of polygons that meet the disc around each point. Upright rectangles meet discs in blocks (`discs`), other polygons pair by pair."""
    from hectara.functions.geometry import distance_to_polygon

    spots = points.select(pid, "x", "y")
    boxes, others = boxes_apart(polygons.select("rings"), radius)
    found = counted(spots, pid, boxes, radius, radius * radius, radius * radius).select(pid, "n")
    if not others.isEmpty():
        # An upright rectangle is as far away as its envelope and travels without its rings.
        dx = F.greatest(F.col("bminx") - F.col("x"), F.col("x") - F.col("bmaxx"), F.lit(0.0))
        dy = F.greatest(F.col("bminy") - F.col("y"), F.col("y") - F.col("bmaxy"), F.lit(0.0))
        near = envelope_pairs(disc_envelope(spots, "x", "y", radius), others, key=pid).filter(dx * dx + dy * dy <= radius * radius)
        hits = near.filter(F.col("rings").isNull() | (distance_to_polygon(F.col("rings"), F.col("x"), F.col("y")) <= radius))
        found = found.unionByName(hits.select(pid, F.lit(1).cast("bigint").alias("n")))
    return points.select(pid).join(found.groupBy(pid).agg(F.sum("n").alias("n")), pid, "left").select(pid, F.coalesce("n", F.lit(0)).alias("n"))


def unmatched_secondary(primary: DataFrame, secondary: DataFrame, sid: str, radius: float) -> DataFrame:
    """Secondary points with no primary point within radius."""
    near = within_radius(secondary, sid, primary, radius, inclusive=False)
    return secondary.join(near.select(sid), sid, "left_anti")
