"""Geometry as Column expressions over vertex rings.

A polygon is array<ring>, a ring is array<struct<x,y>> closed by repeating its first vertex;
the first ring is the outline and the others are holes. A line or a point is one open ring.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1), vertex(x0, y0)))


def segments(ring: Column) -> Column:
    """array<struct<ax,ay,bx,by>> of a ring."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )


def _total(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def ring_signed_area(ring: Column) -> Column:
    first = F.element_at(ring, 1)
    return _total(
        segments(ring),
        lambda e: ((e["ax"] - first["x"]) * (e["by"] - first["y"]) - (e["bx"] - first["x"]) * (e["ay"] - first["y"])) / 2,
    )


def area(rings: Column) -> Column:
    """Outline area minus hole areas."""
    parts = F.transform(rings, lambda r: F.abs(ring_signed_area(r)))
    return F.coalesce(F.element_at(parts, 1), F.lit(0.0)) * 2 - _total(parts, lambda a: a)


def _ring_moments(ring: Column) -> Column:
    """struct(a, mx, my): absolute area and first moments of one ring, taken from its first vertex for accuracy."""
    first = F.element_at(ring, 1)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, e):
        ax, ay = e["ax"] - first["x"], e["ay"] - first["y"]
        bx, by = e["bx"] - first["x"], e["by"] - first["y"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross / 2).alias("a"),
            (acc["mx"] + (ax + bx) * cross / 6).alias("mx"),
            (acc["my"] + (ay + by) * cross / 6).alias("my"),
        )

    def finish(acc):
        sign = F.when(acc["a"] < 0, -1.0).otherwise(1.0)
        a = acc["a"] * sign
        return F.struct(
            a.alias("a"), (acc["mx"] * sign + first["x"] * a).alias("mx"), (acc["my"] * sign + first["y"] * a).alias("my")
        )

    return F.aggregate(segments(ring), zero, step, finish)


def centroid(rings: Column) -> Column:
    """struct(x, y) of the area centroid; holes are taken out."""
    parts = F.transform(rings, _ring_moments)

    def net(name):
        return F.element_at(parts, 1)[name] * 2 - _total(parts, lambda m: m[name])

    return vertex(F.try_divide(net("mx"), net("a")), F.try_divide(net("my"), net("a")))


def perimeter(rings: Column) -> Column:
    return _total(
        F.flatten(F.transform(rings, segments)),
        lambda e: F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"])),
    )


def envelope(rings: Column) -> dict[str, Column]:
    xs = F.transform(F.flatten(rings), lambda v: v["x"])
    ys = F.transform(F.flatten(rings), lambda v: v["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def is_rectangle(rings: Column, envelope: tuple[str, str, str, str]) -> Column:
    """One ring that walks the four corners of the envelope (columns minx, miny, maxx, maxy), either way round; false where a coordinate is missing or not finite."""
    minx, miny, maxx, maxy = (F.col(c) for c in envelope)
    a, b, c, d, e = (F.get(F.get(rings, F.lit(0)), F.lit(i)) for i in range(5))

    def upright(p, q, axis):
        return p[axis] == q[axis]

    first = upright(a, b, "x") & upright(b, c, "y") & upright(c, d, "x") & upright(d, a, "y")
    second = upright(a, b, "y") & upright(b, c, "x") & upright(c, d, "y") & upright(d, a, "x")
    corners = (F.least(a["x"], c["x"]) == minx) & (F.greatest(a["x"], c["x"]) == maxx) & (F.least(a["y"], c["y"]) == miny) & (F.greatest(a["y"], c["y"]) == maxy)
    finite = (F.abs(minx) < float("inf")) & (F.abs(maxx) < float("inf")) & (F.abs(miny) < float("inf")) & (F.abs(maxy) < float("inf"))
    known = a["x"].isNotNull() & a["y"].isNotNull() & c["x"].isNotNull() & c["y"].isNotNull()
    shape = (F.size(rings) == 1) & (F.size(F.get(rings, F.lit(0))) == 5) & known & (a == e)
    return F.coalesce(shape & finite & corners & (first | second), F.lit(False))


def compactness(area_m2: Column, length: Column) -> Column:
    """4*pi*A/P^2 held within 0..1."""
    return F.least(F.greatest(F.try_divide(F.lit(4 * math.pi) * area_m2, length * length), F.lit(0.0)), F.lit(1.0))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(F.least(width, height) > 0, F.greatest(width, height) / F.least(width, height))


def as_point(gtype: Column, rings: Column) -> Column:
    """Polygon to centroid, line to first vertex, point to itself."""
    return F.when(gtype.isin("Polygon", "MultiPolygon"), centroid(rings)).otherwise(F.element_at(F.element_at(rings, 1), 1))


def contains_point(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting with half-open edges, so a shared vertex counts once.

    Points on the left and lower border count as inside, on the right and upper border as
    outside: neighbouring polygons never both claim a border point.
    """
    crossings = F.aggregate(
        F.flatten(F.transform(rings, segments)),
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["ay"] <= y) != (e["by"] <= y))
            & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def distance_to_boundary(rings: Column, x: Column, y: Column) -> Column:
    """Smallest distance from a point to any segment. Each step binds its values once per segment."""
    placed = F.transform(
        F.flatten(F.transform(rings, segments)),
        lambda e: F.struct((e["ax"] - x).alias("ax"), (e["ay"] - y).alias("ay"), (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy")),
    )
    along = F.transform(
        placed,
        lambda e: F.struct(
            e["ax"].alias("ax"), e["ay"].alias("ay"), e["dx"].alias("dx"), e["dy"].alias("dy"),
            F.least(F.greatest(F.coalesce(F.try_divide(-(e["ax"] * e["dx"] + e["ay"] * e["dy"]), e["dx"] * e["dx"] + e["dy"] * e["dy"]), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("t"),
        ),
    )
    off = F.transform(along, lambda e: F.hypot(e["ax"] + e["t"] * e["dx"], e["ay"] + e["t"] * e["dy"]))
    return F.array_min(off)


def distance_to_polygon(rings: Column, x: Column, y: Column) -> Column:
    return F.when(contains_point(rings, x, y), 0.0).otherwise(distance_to_boundary(rings, x, y))


def intersects_box(rings: Column, minx, miny, maxx, maxy) -> Column:
    """A polygon meets a box when an edge passes through it or the box lies inside the polygon."""
    minx, miny, maxx, maxy = (F.lit(float(v)) if not isinstance(v, Column) else v for v in (minx, miny, maxx, maxy))

    def through(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        lows, highs = [], []
        outside = F.lit(False)
        for d, a, lo, hi in ((dx, e["ax"], minx, maxx), (dy, e["ay"], miny, maxy)):
            t0, t1 = (lo - a) / d, (hi - a) / d
            lows.append(F.when(d != 0, F.least(t0, t1)).otherwise(0.0))
            highs.append(F.when(d != 0, F.greatest(t0, t1)).otherwise(1.0))
            outside = outside | ((d == 0) & ((a < lo) | (a > hi)))
        enter = F.greatest(*lows, F.lit(0.0))
        leave = F.least(*highs, F.lit(1.0))
        return ~outside & (enter <= leave)

    box = envelope(rings)
    near = (box["maxx"] >= minx) & (box["minx"] <= maxx) & (box["maxy"] >= miny) & (box["miny"] <= maxy)
    return near & (
        F.exists(F.flatten(F.transform(rings, segments)), through) | contains_point(rings, (minx + maxx) / 2, (miny + maxy) / 2)
    )


def signed_edges(rings: Column) -> Column:
    """Edges with weight +1 or -1, so that a sum of weighted areas under edges is the polygon's area."""
    return F.flatten(
        F.transform(
            rings,
            lambda ring, i: F.transform(
                segments(ring),
                lambda e: F.struct(
                    F.least(e["ax"], e["bx"]).alias("lo"),
                    F.greatest(e["ax"], e["bx"]).alias("hi"),
                    F.when(e["ax"] <= e["bx"], e["ay"]).otherwise(e["by"]).alias("ylo"),
                    F.when(e["ax"] <= e["bx"], e["by"]).otherwise(e["ay"]).alias("yhi"),
                    (F.when(i == 0, 1.0).otherwise(-1.0) * -F.signum(ring_signed_area(ring)) * F.signum(e["bx"] - e["ax"])).alias("w"),
                ),
            ),
        )
    )


def overlap_area(edges_a: Column, edges_b: Column, base: Column) -> Column:
    """Area of the intersection of two polygons given as signed edges.

    Each polygon is the weighted sum of the strips between its edges and a common base line,
    so the intersection is the weighted sum of strip intersections, and a strip intersection
    is the integral of the lower of two straight lines.
    """

    def strip(e, f):
        lo, hi = F.greatest(e["lo"], f["lo"]), F.least(e["hi"], f["hi"])

        def at(g, x):
            return g["ylo"] + (g["yhi"] - g["ylo"]) * (x - g["lo"]) / (g["hi"] - g["lo"]) - base

        e0, e1, f0, f1 = at(e, lo), at(e, hi), at(f, lo), at(f, hi)
        d0, d1 = e0 - f0, e1 - f1
        straight = (F.least(e0, f0) + F.least(e1, f1)) / 2
        # Where the lines cross at fraction t, the lower line changes over.
        t = d0 / (d0 - d1)
        mid = e0 + (e1 - e0) * t
        crossed = (F.least(e0, f0) + mid) / 2 * t + (mid + F.least(e1, f1)) / 2 * (1 - t)
        return F.when(
            (lo < hi) & (e["w"] != 0) & (f["w"] != 0),
            e["w"] * f["w"] * (hi - lo) * F.when(d0 * d1 < 0, crossed).otherwise(straight),
        ).otherwise(0.0)

    return F.aggregate(edges_a, F.lit(0.0), lambda acc, e: F.aggregate(edges_b, acc, lambda inner, f: inner + strip(e, f)))


def oriented_edges(rings: Column) -> Column:
    """Edges with weight +1 or -1 that makes outlines count positive and holes negative, whatever their direction."""
    return F.flatten(
        F.transform(
            F.transform(rings, lambda r, i: F.struct(segments(r).alias("edges"), (F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(ring_signed_area(r))).alias("w"))),
            lambda r: F.transform(r["edges"], lambda e: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"), r["w"].alias("w"))),
        )
    )


def disc_pieces(df: DataFrame, cx: str, cy: str, edges: str, radius: float, name: str = "piece") -> DataFrame:
    """One row per edge with its signed share of the common area of polygon and disc.

    Per directed edge: the triangle over its part inside the disc and the sectors over the parts
    outside. Plain columns on exploded edges, so the arithmetic is compiled.
    """
    r2 = radius * radius
    keep = [c for c in df.columns if c not in (edges,)]
    rows = df.select(*keep, F.inline(edges))
    rows = rows.select(*keep, "w", *[(F.col(v) - F.col(c)).alias(v) for v, c in (("ax", cx), ("ay", cy), ("bx", cx), ("by", cy))])
    rows = rows.withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay"))
    a = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    b = F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")
    c = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") - r2
    rows = rows.withColumn("qa", a).withColumn("qb", b).withColumn("disc", b * b - a * c).filter(F.col("qa") > 0)
    root = F.sqrt(F.greatest("disc", F.lit(0.0)))
    held = lambda t: F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("t0", held((-F.col("qb") - root) / F.col("qa"))).withColumn("t1", held((-F.col("qb") + root) / F.col("qa")))
    rows = rows.withColumns({
        "px": F.col("ax") + F.col("dx") * F.col("t0"), "py": F.col("ay") + F.col("dy") * F.col("t0"),
        "qx": F.col("ax") + F.col("dx") * F.col("t1"), "qy": F.col("ay") + F.col("dy") * F.col("t1"),
    })

    def sector(p: str, q: str) -> Column:
        px, py, qx, qy = F.col(p + "x"), F.col(p + "y"), F.col(q + "x"), F.col(q + "y")
        return F.lit(r2 / 2) * F.atan2(px * qy - qx * py, px * qx + py * qy)

    through = (F.col("disc") > 0) & (F.col("t0") < F.col("t1"))
    cut = sector("a", "p") + (F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2 + sector("q", "b")
    return rows.select(*keep, (F.col("w") * F.when(through, cut).otherwise(sector("a", "b"))).alias(name))


# Grid origin and tile side of the national elevation grid, and the linear approximation.
GRID_MIN_X, GRID_MIN_Y, TILE_SIDE = 140000, 120000, 1000
LINEAR_ORIGIN_LON, LINEAR_ORIGIN_LAT, METRES_PER_DEGREE = 19.0, 52.0, 111320
LINEAR_FALSE_EASTING, LINEAR_FALSE_NORTHING = 500000, 312000


def to_grid_linear(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Cheap approximate projection."""
    x = (lon - LINEAR_ORIGIN_LON) * METRES_PER_DEGREE * F.cos(F.radians(lat)) + LINEAR_FALSE_EASTING
    y = (lat - LINEAR_ORIGIN_LAT) * METRES_PER_DEGREE + LINEAR_FALSE_NORTHING
    return x, y


# Published transverse Mercator parameters per grid: central meridian, scale, false easting, false northing.
GRIDS = {2180: (19.0, 0.9993, 500000.0, -5300000.0), 2177: (18.0, 0.999923, 6500000.0, 0.0)}
_A, _FLAT = 6378137.0, 1 / 298.257222101
_N = _FLAT / (2 - _FLAT)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def to_grid(lat: Column, lon: Column, srid: int = 2180) -> tuple[Column, Column]:
    """WGS84 degrees to easting, northing by the Krueger series."""
    meridian, scale, fe, fn = GRIDS[srid]
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(_ALPHA, start=1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return fe + scale * _RECT * x, fn + scale * _RECT * y


def from_grid(x: Column, y: Column, srid: int = 2180) -> tuple[Column, Column]:
    """Easting, northing to latitude and longitude in degrees."""
    meridian, scale, fe, fn = GRIDS[srid]
    xi, eta = (y - fn) / (scale * _RECT), (x - fe) / (scale * _RECT)
    xi1, eta1 = xi, eta
    for j, c in enumerate(_BETA, start=1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, c in enumerate(_DELTA, start=1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(lat), meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def tile_index(x: Column, y: Column) -> tuple[Column, Column]:
    return (
        F.floor((x - GRID_MIN_X) / TILE_SIDE).cast("int"),
        F.floor((y - GRID_MIN_Y) / TILE_SIDE).cast("int"),
    )


def tile_id(gx: Column, gy: Column) -> Column:
    return F.format_string("tile_%04d_%04d", gx, gy)


def tiles_of_box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """All tile ids meeting a box; a flat array to explode."""
    gx0, gy0 = tile_index(minx, miny)
    gx1, gy1 = tile_index(maxx, maxy)
    return F.flatten(F.transform(F.sequence(gx0, gx1), lambda gx: F.transform(F.sequence(gy0, gy1), lambda gy: tile_id(gx, gy))))


def sample_points(df: DataFrame, gtype: str, rings: str, step: float, normalised: bool = True, name: str = "p") -> DataFrame:
    """Representative points, one row each: centroid and outline samples of polygons, samples along lines, points as they are.

    normalised=True spreads max(least, int(length/step)) samples evenly; False walks at the exact step from 0.
    Built step by step so that every value is computed once per shape.
    """
    kind = F.col(gtype)
    work = df.withColumn("_seg", segments(F.element_at(rings, 1)))
    work = work.withColumn("_len", F.transform("_seg", lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])))
    work = work.withColumn("_total", F.aggregate("_len", F.lit(0.0), lambda s, v: s + v))
    least = F.when(kind == "Polygon", 1).otherwise(2)
    work = work.withColumn("_n", F.greatest(least, F.floor(F.col("_total") / step).cast("int")) if normalised else F.greatest(F.ceil(F.col("_total") / step).cast("int"), F.lit(1)))
    start = F.array(F.lit(0.0))
    work = work.withColumn("_from", F.aggregate("_len", start, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))))
    shaped = kind.isin("Polygon", "LineString") & (F.col("_total") > 0)
    whole = F.array_compact(F.array(F.when(kind == "Polygon", centroid(F.col(rings)))))
    points = work.select(*df.columns, F.explode(F.when(kind.isin("Polygon", "LineString"), whole).otherwise(F.flatten(rings))).alias(name))
    walk = work.filter(shaped).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    offset = F.col("_i") * F.col("_total") / F.col("_n") if normalised else F.col("_i") * F.lit(float(step))
    walk = walk.withColumn("_d", offset).withColumn("_k", F.greatest(F.lit(1), F.size(F.filter("_from", lambda v: v <= F.col("_d")))))
    walk = walk.withColumn("_k", F.least("_k", F.size("_seg"))).withColumn("_e", F.element_at("_seg", F.col("_k")))
    t = (F.col("_d") - F.element_at("_from", F.col("_k"))) / F.element_at("_len", F.col("_k"))
    walk = walk.withColumn("_t", t)
    along = vertex(F.col("_e.ax") + (F.col("_e.bx") - F.col("_e.ax")) * F.col("_t"), F.col("_e.ay") + (F.col("_e.by") - F.col("_e.ay")) * F.col("_t"))
    return points.unionByName(walk.select(*df.columns, along.alias(name)))
