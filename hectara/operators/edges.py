"""Joins of polygon edges: what crosses, what touches, what runs along something else.

An edge is cut into pieces no longer than a cell, and each piece stands in the at most four cells that its box meets. Edges meet by an equi-join on
cells, so a polygon with very many vertices or a very long edge is spread over many keys. Signs of turns are exact for coordinates
rounded to a nanometre: a floating-point bound settles nearly all, decimals the rest.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.functions.geometry import is_rectangle, oriented_edges, ring_signed_area, segments
from hectara.functions.scores import half_even
from hectara.operators.spatial import disc_envelope, envelope_pairs, first_polygon, points_in_polygons, polygon_parts, with_envelope
from hectara.session import cut_lineage, shuffled

ENDS = ("ax", "ay", "bx", "by")


def edge_length() -> Column:
    return F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))


def edge_cells(edges: DataFrame, cell: Column | float, margin: float = 0.0) -> DataFrame:
    """Each edge (ax, ay, bx, by) once for every cell (cx, cy) near it; cell is the side length, of each row where it is a column.

    An edge of several pieces may stand in a cell more than once.
    """
    side = cell if isinstance(cell, Column) else F.lit(float(cell))
    cut = edges.withColumn("_side", side).withColumn("_n", F.greatest(F.lit(1), F.ceil(edge_length() / F.col("_side"))).cast("int"))
    cut = cut.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str, step: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * (step / F.col("_n"))

    def cells(a: str, b: str) -> Column:
        one, two = at(a, b, F.col("_i")), at(a, b, F.col("_i") + 1)
        index = [F.floor(v / F.col("_side")).cast("long") for v in (F.least(one, two) - margin, F.greatest(one, two) + margin)]
        return F.sequence(*index)

    placed = cut.withColumns({"_x": cells("ax", "bx"), "_y": cells("ay", "by")})
    placed = placed.select(*edges.columns, F.explode("_x").alias("cx"), "_y").select(*edges.columns, "cx", F.explode("_y").alias("cy"))
    return placed


def numbered_edges(shapes: DataFrame, key: str, edges: Column) -> DataFrame:
    """key, no (place of the edge in its shape) and the fields of the edges; edges without length are left out."""
    rows = shapes.select(F.col(key), F.posexplode(edges).alias("no", "_e")).select(key, "no", "_e.*")
    return rows.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))


def turn(a: tuple[Column, Column], b: tuple[Column, Column], p: tuple[Column, Column]) -> Column:
    """1 where p lies left of the line from a to b, -1 right of it, 0 on it."""
    left, right = (a[0] - p[0]) * (b[1] - p[1]), (a[1] - p[1]) * (b[0] - p[0])
    sure = F.abs(left - right) > 4e-16 * 4 * (F.abs(left) + F.abs(right)) + 1e-300
    exact = [[c.cast("decimal(17,9)") for c in v] for v in (a, b, p)]
    (ax, ay), (bx, by), (px, py) = exact
    total = ax * (by - py) + bx * (py - ay) + px * (ay - by)
    return F.when(sure, F.signum(left - right)).otherwise(F.signum(total.cast("decimal(38,18)"))).cast("int")


# Borders of neighbouring plots


def shared_spans(edges: DataFrame, key: str, cell: float, tolerance: float) -> DataFrame:
    """key, no, key2 and lo, hi: the stretch of an edge that an edge of a shape with a larger key follows within the tolerance.

    Directions are compared modulo half a turn in buckets that wrap around, the neighbours of a bucket included; edges so short that the
    tolerance frees their direction meet every direction. Distances are taken from differences, so the place on the map costs no accuracy.
    """
    buckets, short = 64, 100 * tolerance
    half = F.pmod(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.lit(math.pi))
    known = edges.withColumns({"len": edge_length(), "way": F.pmod(F.floor(half / (math.pi / buckets)).cast("int"), F.lit(buckets))})
    known = known.withColumn("way", F.when(F.col("len") >= short, F.col("way")).otherwise(-1))
    placed = edge_cells(known, cell, tolerance)
    other = shuffled(placed.select(*[F.col(c).alias(f"{c}2") for c in (key, "no", *ENDS, "len")], "cx", "cy", F.col("way").alias("way2")))
    around = F.array(*[F.pmod(F.col("way2") + d, F.lit(buckets)) for d in (-1, 0, 1)])
    long = placed.filter("way >= 0").join(other.filter("way2 >= 0").withColumn("way", F.explode(around)), ["cx", "cy", "way"])
    loose = placed.join(other.filter("way2 < 0"), ["cx", "cy"]).unionByName(placed.filter("way < 0").join(other.filter("way2 >= 0"), ["cx", "cy"]))
    near = [F.greatest(f"a{v}", f"b{v}") + tolerance >= F.least(f"a{v}2", f"b{v}2") for v in "xy"] + [F.greatest(f"a{v}2", f"b{v}2") + tolerance >= F.least(f"a{v}", f"b{v}") for v in "xy"]
    pairs = long.select(loose.columns).unionByName(loose).filter((F.col(key) < F.col(f"{key}2")) & near[0] & near[1] & near[2] & near[3])
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("len"), (F.col("by") - F.col("ay")) / F.col("len")
    pairs = pairs.withColumns({"ux": ux, "uy": uy})
    for end in ("a", "b"):
        dx, dy = F.col(f"{end}x2") - F.col("ax"), F.col(f"{end}y2") - F.col("ay")
        pairs = pairs.withColumns({f"t{end}": dx * F.col("ux") + dy * F.col("uy"), f"d{end}": dy * F.col("ux") - dx * F.col("uy")})
    lean = F.abs(F.col("db") - F.col("da")) / F.col("len2")
    pairs = pairs.filter(lean <= F.greatest(F.lit(0.05), 2 * tolerance / F.least("len", "len2")))
    # The part of the other edge within the tolerance of this one's line, projected on it.
    rise = F.col("db") - F.col("da")
    f0, f1 = F.try_divide(-tolerance - F.col("da"), rise), F.try_divide(tolerance - F.col("da"), rise)
    flat = F.abs(rise) < 1e-15
    enter = F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(f0, f1)))
    leave = F.when(flat, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(f0, f1)))
    pairs = pairs.withColumns({"f0": enter, "f1": leave}).filter((F.col("f0") < F.col("f1")) & ((F.abs(F.col("da")) <= tolerance) | ~flat))
    t0, t1 = (F.col("ta") + (F.col("tb") - F.col("ta")) * F.col(f) for f in ("f0", "f1"))
    spans = pairs.select(key, "no", f"{key}2", F.greatest(F.lit(0.0), F.least(t0, t1)).alias("lo"), F.least(F.col("len"), F.greatest(t0, t1)).alias("hi"))
    return spans.filter("lo < hi")


def border_lengths(spans: DataFrame, key: str) -> DataFrame:
    """key, key2 and border: the length of the union of the spans of each pair, edge by edge, so that what is met twice counts once."""
    before = Window.partitionBy(key, f"{key}2", "no").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("hi").over(before), F.lit(0.0))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), reached)))
    return fresh.groupBy(key, f"{key}2").agg(F.sum("fresh").alias("border"))


def adjacent_pairs(plots: DataFrame, plot_id: str, cell: float | None = None, min_border: float = 0.1, tolerance: float = 1e-3) -> DataFrame:
    """Unordered pairs that share a border line longer than min_border and do not overlap.

    Borders are matched edge by edge within the tolerance, so a border counts whole however each plot cuts it into edges. Without a
    cell length 1.7 times the mean length of an edge is taken, so that a cell holds few edges.
    """
    from hectara.functions.geometry import overlap_area, signed_edges

    edges = numbered_edges(plots, plot_id, F.flatten(F.transform("rings", segments)))
    if cell is None:
        cell = 1.7 * (edges.agg(F.avg(edge_length())).first()[0] or 1.0)
    shared = border_lengths(shared_spans(edges, plot_id, cell, tolerance), plot_id).filter(F.col("border") > min_border)
    box = with_envelope(plots.select(plot_id, "rings"), "rings", ("x0", "y0", "x1", "y1"))
    shape = box.select(plot_id, signed_edges(F.col("rings")).alias("edges"), F.col("y0").alias("miny"))
    both = shared.join(shuffled(shape), plot_id).join(shuffled(shape.toDF(*[f"{c}2" for c in shape.columns])), f"{plot_id}2")
    # A border that is followed within the tolerance may overlap by its length times the tolerance.
    allowed = 1e-6 + F.col("border") * tolerance
    apart = overlap_area(F.col("edges"), F.col("edges2"), F.least("miny", "miny2")) <= allowed
    return both.filter(apart).select(F.col(plot_id).alias("id1"), F.col(f"{plot_id}2").alias("id2"), half_even(F.col("border"), 2).alias("shared_border_m"))


# Union of polygons


def directed_edges(shapes: DataFrame, key: str) -> DataFrame:
    """key, no, ax, ay, bx, by with the inside of the shape on the left of each edge."""
    rows = numbered_edges(shapes, key, oriented_edges(F.col("rings"))).filter("w != 0")
    back = F.col("w") < 0
    ends = dict(zip(ENDS, ("bx", "by", "ax", "ay")))
    return rows.select(key, "no", *[F.when(back, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in ends.items()])


def covered_cells(shapes: DataFrame, key: str, cell: float) -> tuple[DataFrame | None, float]:
    """The cells (cx, cy) that a shape covers whole, on a grid of an eighth of the side of the mean shape, and the side of the grid.

    None and the side as given where no shape has an area.
    """
    box = ("ex0", "ey0", "ex1", "ey1")
    sized = with_envelope(shapes, "rings", box)
    wide, high = F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0")
    mean = sized.filter((wide < float("inf")) & (high < float("inf"))).agg(F.avg(wide * high)).first()[0]
    parts = polygon_parts(sized, key, box) if mean else None
    if parts is None:
        return None, cell
    grid = math.floor(math.log2(math.sqrt(mean) / 8))
    whole = parts.filter(F.col("whole") & ~F.col("_box") & (F.col("level") >= grid))
    span = [F.expr(f"sequence(shiftleft({c}, level - ({grid})), shiftleft({c} + 1, level - ({grid})) - 1)") for c in ("cx", "cy")]
    inner = whole.select(F.explode(span[0]).alias("cx"), span[1].alias("_y")).select("cx", F.explode("_y").alias("cy"))
    first, last = ([f(F.col(c) / 2.0**grid).cast("long") + d for c in cs] for f, cs, d in ((F.ceil, box[:2], 0), (F.floor, box[2:], -1)))
    ranges = [F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")) for a, b in zip(first, last)]
    upright = sized.filter(is_rectangle(F.col("rings"), box)).select(F.explode(ranges[0]).alias("cx"), ranges[1].alias("_y")).select("cx", F.explode("_y").alias("cy"))
    return cut_lineage(inner.unionByName(upright).distinct()), 2.0**grid


def _open_ends(placed: DataFrame, key: str, cell: float) -> DataFrame:
    """key, no, len, t: where an edge passes between cells that are placed and others. What ends in one cell and begins in the next cancels out."""
    spans = []
    for v in "xy":
        a, d, low = F.col(f"a{v}"), F.col(f"b{v}") - F.col(f"a{v}"), F.col(f"c{v}") * F.lit(cell)
        one, two = (F.try_divide(line - a, d) * F.col("len") for line in (low, (F.col(f"c{v}") + 1) * F.lit(cell)))
        beside = (a < low) | (a > (F.col(f"c{v}") + 1) * F.lit(cell))
        spans.append((F.when(d != 0, F.least(one, two)).when(beside, float("inf")), F.when(d != 0, F.greatest(one, two)).when(beside, float("-inf"))))
    enter = F.greatest(F.lit(0.0), *[s[0] for s in spans])  # null-skipping: an edge without width passes no upright line
    leave = F.least(F.col("len"), *[s[1] for s in spans])
    cut = placed.dropDuplicates([key, "no", "cx", "cy"]).select(key, "no", "len", enter.alias("_in"), leave.alias("_out")).filter("_in < _out")
    ends = cut.select(key, "no", "len", F.inline(F.array(F.struct(F.col("_in").alias("t"), F.lit(1).alias("n")), F.struct(F.col("_out").alias("t"), F.lit(-1).alias("n")))))
    return ends.groupBy(key, "no", "len", "t").agg(F.sum("n").alias("n")).filter("n != 0").drop("n")


def union_edges(shapes: DataFrame, key: str, cell: float, tolerance: float = 1e-6) -> DataFrame:
    """The boundary of the union of all shapes (key, rings) as directed edges ax, ay, bx, by with the union on the left.

    Edges are split where edges of other shapes cross or touch them. A part stays unless another shape covers the ground on its
    right. Parts that run along another shape's edge are settled by direction: the same way, the smaller key keeps it; the
    other way, the ground on the right is covered. A row that repeats a key counts as one more part of that shape.

    No boundary runs within a cell that one shape covers whole. Edges are cut where they leave and enter such cells and meet other edges
    only outside of them, so the pairs grow with what is near the boundary, not with how many shapes lie on top of each other.
    """
    edges = cut_lineage(directed_edges(shapes, key).withColumn("len", edge_length()))
    full = None
    if shapes.groupBy(key).count().filter("count > 1").isEmpty():
        full, cell = covered_cells(shapes, key, cell)
    placed = edge_cells(edges, cell, tolerance)
    if full is not None:
        placed = cut_lineage(placed.join(shuffled(full), ["cx", "cy"], "left_anti"))
    other = placed.select(*[F.col(c).alias(f"{c}2") for c in (key, "no", *ENDS, "len")], "cx", "cy")
    pairs = placed.join(other, ["cx", "cy"]).filter(F.col(key) != F.col(f"{key}2")).drop("cx", "cy").distinct()
    dx, dy, ex, ey = (F.col(b) - F.col(a) for a, b in (("ax", "bx"), ("ay", "by"), ("ax2", "bx2"), ("ay2", "by2")))
    sx, sy = F.col("ax2") - F.col("ax"), F.col("ay2") - F.col("ay")
    pairs = pairs.withColumns({"dx": dx, "dy": dy, "ex": ex, "ey": ey, "sx": sx, "sy": sy})
    # Distances of the other edge's ends from this edge's line, and their places along it.
    pairs = pairs.withColumns({
        "da": (F.col("sy") * F.col("dx") - F.col("sx") * F.col("dy")) / F.col("len"),
        "ta": (F.col("sx") * F.col("dx") + F.col("sy") * F.col("dy")) / F.col("len"),
    }).withColumns({
        "db": F.col("da") + (F.col("ey") * F.col("dx") - F.col("ex") * F.col("dy")) / F.col("len"),
        "tb": F.col("ta") + (F.col("ex") * F.col("dx") + F.col("ey") * F.col("dy")) / F.col("len"),
    })
    along = (F.abs(F.col("da")) <= tolerance) & (F.abs(F.col("db")) <= tolerance) & (F.abs(F.col("tb") - F.col("ta")) > tolerance)
    pairs = cut_lineage(pairs.withColumn("along", along))
    # Where the other edge reaches this one's line: a crossing, or an end that touches it.
    u = F.try_divide(-F.col("da"), F.col("db") - F.col("da"))
    slack = tolerance / F.col("len2")
    crossing = pairs.filter(~F.col("along")).withColumn("u", u).filter((F.col("u") >= -slack) & (F.col("u") <= 1 + slack))
    cuts = [crossing.select(key, "no", "len", (F.col("ta") + (F.col("tb") - F.col("ta")) * F.col("u")).alias("t"))]
    cuts += [pairs.filter("along").select(key, "no", "len", F.col(t).alias("t")) for t in ("ta", "tb")]
    if full is not None:
        cuts.append(_open_ends(placed, key, cell))
    inner = reduce(DataFrame.unionByName, cuts).filter((F.col("t") > tolerance) & (F.col("t") < F.col("len") - tolerance))
    ends = edges if full is None else edges.join(shuffled(placed.select(key, "no").distinct()), [key, "no"], "left_semi")
    marks = inner.select(key, "no", "t").unionByName(ends.select(key, "no", F.explode(F.array(F.lit(0.0), F.col("len"))).alias("t"))).distinct()
    following = Window.partitionBy(key, "no").orderBy("t")
    parts = marks.withColumn("t1", F.lead("t").over(following)).filter("t1 is not null").withColumnRenamed("t", "t0")
    parts = parts.join(edges, [key, "no"])
    share = lambda t: F.when(F.col(t) >= F.col("len"), 1.0).otherwise(F.col(t) / F.col("len"))
    spots = {f"{v}{n}": F.col(f"a{v}") + (F.col(f"b{v}") - F.col(f"a{v}")) * share(t) for v in "xy" for n, t in ((0, "t0"), (1, "t1"))}
    parts = parts.withColumns(spots).withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    parts = parts.select(key, "no", "t0", "t1", "x0", "y0", "x1", "y1", "mx", "my")
    if full is not None:
        around = [F.array_distinct(F.array(*[F.floor((F.col(m) + d) / cell).cast("long") for d in (-tolerance, tolerance)])) for m in ("mx", "my")]
        touched = parts.select(key, "no", "t0", F.explode(around[0]).alias("cx"), "my").withColumn("cy", F.explode(around[1])).drop("my")
        outside = touched.join(shuffled(full), ["cx", "cy"], "left_anti").select(key, "no", "t0").distinct()
        parts = parts.join(shuffled(outside), [key, "no", "t0"], "left_semi")
    parts = cut_lineage(parts)
    beside = pairs.filter("along").select(key, "no", f"{key}2", F.least("ta", "tb").alias("from"), F.greatest("ta", "tb").alias("to"), (F.col("tb") > F.col("ta")).alias("same_way"))
    middle = (F.col("t0") + F.col("t1")) / 2
    beside = cut_lineage(parts.join(beside, [key, "no"]).filter((middle > F.col("from")) & (middle < F.col("to"))).select(key, "no", "t0", f"{key}2", "same_way").distinct())
    covers = with_envelope(shapes.select(F.col(key).alias(f"{key}2"), "rings"), "rings", ("ex0", "ey0", "ex1", "ey1"))
    inside = points_in_polygons(parts.select(key, "no", "t0", "mx", "my"), "mx", "my", covers, ("ex0", "ey0", "ex1", "ey1")).filter(F.col(key) != F.col(f"{key}2"))
    covered = inside.select(key, "no", "t0", f"{key}2").join(beside, [key, "no", "t0", f"{key}2"], "left_anti").select(key, "no", "t0")
    ceded = beside.filter(~F.col("same_way") | (F.col(f"{key}2") < F.col(key))).select(key, "no", "t0")
    kept = parts.join(covered.unionByName(ceded).distinct(), [key, "no", "t0"], "left_anti")
    return kept.select(F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))


def disc_differences(rows: DataFrame, cx: str, cy: str, radius: float, keep: list[str]) -> DataFrame:
    """keep and piece: what each edge takes from or adds to a disc that is full or empty according to its centre.

    An edge that does not enter the disc gives nothing. Summed over the edges that bound an area, and with the whole disc added where
    the centre lies inside, it is the common area of both: an edge's share by triangle and sectors, less the sector of the whole edge, and
    all those sectors together are the turns of the boundary around the centre. A centre on the boundary counts as moved right, then up, as
    contains_point sees it.
    """
    r2 = radius * radius
    moved = {v: F.col(v) - F.col(c) for v, c in (("ax", cx), ("ay", cy), ("bx", cx), ("by", cy))}
    rows = rows.select(*keep, *[c.alias(v) for v, c in moved.items()])
    rows = rows.withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay"))
    b = F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")
    rows = rows.withColumn("qa", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).withColumn("qb", b).filter("qa > 0")
    rows = rows.withColumn("disc", F.col("qb") * F.col("qb") - F.col("qa") * (F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") - r2)).filter("disc > 0")
    held = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"t0": held((-F.col("qb") - F.sqrt("disc")) / F.col("qa")), "t1": held((-F.col("qb") + F.sqrt("disc")) / F.col("qa"))}).filter("t0 < t1")
    rows = rows.withColumns({f"{n}{v}": F.col(f"a{v}") + F.col(f"d{v}") * F.col(t) for n, t in (("p", "t0"), ("q", "t1")) for v in "xy"})

    def sector(px, py, qx, qy) -> Column:
        return F.lit(r2 / 2) * F.atan2(px * qy - qx * py, px * qx + py * qy)

    def ends(*names: str) -> list[Column]:
        return [F.col(n + v) for n in names for v in "xy"]

    # The ends as seen from the moved centre, where it stands on one of them.
    on = {n: (F.col(f"{n}x") == 0) & (F.col(f"{n}y") == 0) for n in "ab"}
    seen = [F.when(on[n], F.lit(v)).otherwise(F.col(n + w)) for n in "ab" for w, v in (("x", -1.0), ("y", -1e-30))]
    cross, dot = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")
    side = F.when(F.col("ay") != F.col("by"), F.signum(F.col("ay") - F.col("by"))).otherwise(F.signum(F.col("bx") - F.col("ax")))
    whole = F.when((cross == 0) & (dot < 0), side * (r2 / 2 * math.pi)).otherwise(sector(*seen))
    share = sector(*ends("a", "p")) + (F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2 + sector(*ends("q", "b"))
    return rows.select(*keep, (share - whole).alias("piece"))


def union_coverage_percent(points: DataFrame, pid: str, polygons: DataFrame, key: str, radius: float) -> DataFrame:
    """Percent of the disc around each point (pid, x, y) that the union of the polygons (key, rings) covers; overlaps count once.

    The union's boundary is made once for all discs. A disc then needs only the boundary edges that enter it and whether its centre is covered.
    """
    shapes = polygons.select(key, "rings")
    boundary = union_edges(shapes, key, radius).select(
        *ENDS, F.least("ax", "bx").alias("bminx"), F.least("ay", "by").alias("bminy"), F.greatest("ax", "bx").alias("bmaxx"), F.greatest("ay", "by").alias("bmaxy")
    )
    spots = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(pid, "x", "y")
    near = envelope_pairs(disc_envelope(spots, "x", "y", radius), boundary, key=pid).select(pid, "x", "y", *ENDS)
    pieces = disc_differences(near, "x", "y", radius, [pid])
    box = ("ex0", "ey0", "ex1", "ey1")
    centred = first_polygon(spots, pid, "x", "y", with_envelope(shapes, "rings", box), key, box).select(pid)
    full = centred.select(pid, F.lit(math.pi * radius * radius).alias("piece"))
    sums = pieces.unionByName(full).groupBy(pid).agg((F.sum("piece") / (math.pi * radius * radius) * 100).alias("pct"))
    return points.select(pid).join(sums, pid, "left").select(pid, F.greatest(F.coalesce("pct", F.lit(0.0)), F.lit(0.0)).alias("pct"))


# Validity

FAULTS = ("empty", "bad number", "open ring", "few vertices", "no area", "crossing", "touch", "hole outside", "hole in hole", "split inside")


def _plain_ring(ring: Column) -> Column:
    """A ring without vertices that repeat the one before."""
    return F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, F.greatest(i - 1, F.lit(0)))))


def with_faults(shapes: DataFrame, rings: str = "rings") -> DataFrame:
    """All columns, valid, and fault: the first of FAULTS that holds, null for a valid polygon.

    empty: null or no ring; crossing: two edges cross or run along each other (a spike too); touch: a ring meets itself in a point; hole outside and hole in hole:
    a hole is not inside the outline, or is inside another hole; split inside: rings touch in so many points that the inside
    falls apart. Rings may touch each other in single points. Rows are judged each, whatever else they repeat.
    """
    keyed = cut_lineage(shapes.withColumn("_row", F.monotonically_increasing_id()))
    body = keyed.select("_row", F.col(rings).alias("_rings"))
    bad = lambda v: v["x"].isNull() | v["y"].isNull() | F.isnan(v["x"]) | F.isnan(v["y"]) | (F.abs(v["x"]) == float("inf")) | (F.abs(v["y"]) == float("inf"))
    first = (
        F.when(F.col("_rings").isNull() | (F.size("_rings") == 0) | F.exists("_rings", lambda r: r.isNull() | (F.size(r) == 0)), "empty")
        .when(F.exists("_rings", lambda r: F.exists(r, lambda v: v.isNull() | bad(v))), "bad number")
        .when(F.exists("_rings", lambda r: F.element_at(r, 1) != F.element_at(r, -1)), "open ring")
        .when(F.exists("_rings", lambda r: F.size(_plain_ring(r)) < 4), "few vertices")
        .when(F.exists("_rings", lambda r: ring_signed_area(r) == 0), "no area")
    )
    formed = cut_lineage(body.select("_row", "_rings", first.alias("_first")))
    sound = formed.filter("_first is null").select("_row", F.transform("_rings", _plain_ring).alias("_rings"))
    listed = F.flatten(F.transform("_rings", lambda r, i: F.transform(segments(r), lambda e, j: F.struct(i.alias("ring"), j.alias("at"), (F.size(r) - 1).alias("many"), *[e[c].alias(c) for c in ENDS]))))
    sized = sound.select("_row", listed.alias("_e"))
    xs, ys = F.transform("_e", lambda e: e["ax"]), F.transform("_e", lambda e: e["ay"])
    span = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    edges = cut_lineage(sized.withColumn("_cell", span / F.sqrt(F.size("_e").cast("double"))).select("_row", "_cell", F.inline("_e")))
    placed = edge_cells(edges, F.col("_cell"), 1e-9)
    other = placed.select("_row", "cx", "cy", *[F.col(c).alias(f"{c}2") for c in ("ring", "at", *ENDS)])
    later = (F.col("ring") < F.col("ring2")) | ((F.col("ring") == F.col("ring2")) & (F.col("at") < F.col("at2")))
    pairs = placed.join(shuffled(other), ["_row", "cx", "cy"]).filter(later).drop("cx", "cy", "_cell").distinct()
    a, b, c, d = ((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.col("ax2"), F.col("ay2")), (F.col("bx2"), F.col("by2")))
    pairs = pairs.withColumns({"o1": turn(a, b, c), "o2": turn(a, b, d), "o3": turn(c, d, a), "o4": turn(c, d, b)})

    def on(o: str, p, q, r) -> Column:
        """r lies on the line through p and q and within their box."""
        return (F.col(o) == 0) & r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))

    meets = F.array_compact(F.array(*[F.when(on(o, p, q, r), F.struct(r[0].alias("x"), r[1].alias("y"))) for o, p, q, r in (("o1", a, b, c), ("o2", a, b, d), ("o3", c, d, a), ("o4", c, d, b))]))
    pairs = pairs.withColumn("meets", F.array_distinct(meets))
    across = (F.col("o1") * F.col("o2") < 0) & (F.col("o3") * F.col("o4") < 0)
    following = (F.col("at2") == F.col("at") + 1) | ((F.col("at") == 0) & (F.col("at2") == F.col("many") - 1))
    joint = F.when(F.col("at2") == F.col("at") + 1, F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))).otherwise(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")))
    own = (F.col("ring") == F.col("ring2")) & following
    strange = F.filter("meets", lambda v: ~(own & (v == joint)))
    met = cut_lineage(pairs.filter(across | (F.size("meets") > 0)).select(
        "_row", "ring", "ring2", (across | (F.size("meets") > 1)).alias("crossing"), ((F.col("ring") == F.col("ring2")) & (F.size(strange) > 0)).alias("touch"), "meets",
    ))
    crossed = met.groupBy("_row").agg(F.max("crossing").alias("crossing"), F.max("touch").alias("touch"))
    touching = met.filter("ring != ring2 and not crossing").select("_row", "ring", "ring2", F.explode("meets").alias("spot"))
    faults = [crossed.select("_row", F.when(F.col("crossing"), 5).when(F.col("touch"), 6).alias("code")), _hole_faults(edges, touching), _split_faults(touching)]
    least = faults[0].unionByName(faults[1]).unionByName(faults[2]).groupBy("_row").agg(F.min("code").alias("code"))
    names = F.array(*[F.lit(f) for f in FAULTS])
    judged = formed.select("_row", "_first").join(shuffled(least), "_row", "left").select("_row", F.coalesce("_first", F.get(names, F.col("code"))).alias("fault"))
    kept = [x for x in shapes.columns if x not in ("valid", "fault")]
    return keyed.join(shuffled(judged), "_row").select(*kept, F.col("fault").isNull().alias("valid"), "fault")


def _hole_faults(edges: DataFrame, touching: DataFrame) -> DataFrame:
    """_row and code of rows with a hole outside the outline or inside another hole, by one vertex of each hole that touches no ring."""
    free = edges.filter("ring > 0").select("_row", "_cell", "ring", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("spot"))
    touched = touching.select("_row", F.explode(F.array("ring", "ring2")).alias("ring"), "spot").distinct()
    probes = free.join(shuffled(touched), ["_row", "ring", "spot"], "left_anti").groupBy("_row", "ring").agg(F.min("spot").alias("p"), F.first("_cell").alias("_cell"))
    probes = probes.withColumn("band", F.floor(F.col("p.y") / F.col("_cell")).cast("long"))
    low, high = (F.floor(f("ay", "by") / F.col("_cell")).cast("long") for f in (F.least, F.greatest))
    bands = edges.withColumn("band", F.explode(F.sequence(low, high))).select("_row", "band", F.col("ring").alias("around"), *ENDS)
    met = probes.join(shuffled(bands), ["_row", "band"]).filter("ring != around").filter((F.col("ay") <= F.col("p.y")) != (F.col("by") <= F.col("p.y")))
    side = turn((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.col("p.x"), F.col("p.y")))
    right = F.when(F.col("by") > F.col("ay"), side > 0).otherwise(side < 0)  # the edge lies right of the probe
    odd = met.filter(right).groupBy("_row", "ring", "around").agg((F.count("*") % 2 == 1).alias("inside")).filter("inside")
    held = odd.groupBy("_row", "ring").agg(F.max(F.col("around") == 0).alias("in_outline"), F.max(F.col("around") > 0).alias("in_hole"))
    judged = probes.select("_row", "ring").join(shuffled(held), ["_row", "ring"], "left")
    outside = ~F.coalesce("in_outline", F.lit(False))
    return judged.select("_row", F.when(outside, 7).when(F.coalesce("in_hole", F.lit(False)), 8).alias("code"))


def _split_faults(touching: DataFrame) -> DataFrame:
    """_row and code of rows whose rings and the points they touch in form a cycle: that cuts a part of the inside off."""
    at = touching.groupBy("_row", "spot").agg(F.array_sort(F.array_union(F.collect_set("ring"), F.collect_set("ring2"))).alias("met"))
    steps = at.select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.size("met") - 1), lambda i: F.struct(F.get("met", i - 1).alias("a"), F.get("met", i).alias("b")))).alias("s"))
    walked = steps.groupBy("_row").agg(F.collect_list("s").alias("steps"))  # one step a touching point and ring, of one polygon
    rings = F.array_distinct(F.flatten(F.transform("steps", lambda s: F.array(s["a"], s["b"]))))
    start = F.struct(F.map_from_arrays(rings, rings).alias("group"), F.lit(False).alias("cycle"))

    def join(state: Column, s: Column) -> Column:
        a, b = F.element_at(state["group"], s["a"]), F.element_at(state["group"], s["b"])
        merged = F.transform_values(state["group"], lambda _, v: F.when(v == b, a).otherwise(v))
        return F.struct(merged.alias("group"), (state["cycle"] | (a == b)).alias("cycle"))

    return walked.select("_row", F.when(F.aggregate("steps", start, join)["cycle"], 9).alias("code"))
