"""Borders, unions and validity against plain versions and hand-made cases."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hectara.operators import edges as E

RINGS = "rings array<array<struct<x:double,y:double>>>"


def ring(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def box(x0, y0, x1, y1):
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def frame(spark, shapes):
    return spark.createDataFrame([(i, r) for i, r in shapes], f"sid bigint, {RINGS}")


def borders(spark, shapes, **kw):
    return {(r.id1, r.id2): r.shared_border_m for r in E.adjacent_pairs(frame(spark, shapes), "sid", **({"cell": 7.0} | kw)).collect()}


@pytest.mark.parametrize("bend", [1e-8, -1e-8, 4e-4, -4e-4, 0.0])
@pytest.mark.parametrize("at", [(0.0, 0.0), (512_345.5, 6_001_234.25)])
def test_bent_border_counts_whole(spark, bend, at):
    """One plot has a vertex in the middle of the common border, moved sideways by less than the tolerance."""
    x, y = at
    plain = [box(x, y, x + 10, y + 10)]
    bent = [ring([(x + 10, y), (x + 20, y), (x + 20, y + 10), (x + 10, y + 10), (x + 10 + bend, y + 5)])]
    assert borders(spark, [(1, plain), (2, bent)]) == {(1, 2): 10.0}


def test_borders_of_a_turned_brick_wall(spark):
    """Every border keeps its length whatever the direction of the wall; corners and overlapping plots do not count."""
    shapes, want = {}, {}
    for row in range(4):
        for col in range(4):
            x = col * 10 + (row % 2) * 5
            shapes[row * 4 + col] = (x, row * 10, x + 10, row * 10 + 10)
    for i, (ax, ay, bx, by) in shapes.items():
        for j, (cx, cy, dx, dy) in shapes.items():
            w, h = min(bx, dx) - max(ax, cx), min(by, dy) - max(ay, cy)
            if i < j and min(w, h) == 0 and max(w, h) > 0.1:
                want[(i, j)] = float(max(w, h))
    for angle in (0, 17, 90, 90.0000001, 133, 180):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        turned = [(i, [[(1000 + c * x - s * y, 2000 + s * x + c * y) for x, y in box(*b)]]) for i, b in shapes.items()]
        assert borders(spark, turned) == want
    assert borders(spark, [(1, [box(0, 0, 10, 10)]), (2, [box(8, 0, 18, 10)])]) == {}
    assert borders(spark, [(1, [box(0, 0, 10, 10)]), (2, [box(10, 10, 20, 20)])]) == {}


def test_border_of_many_short_edges(spark):
    """A curve of 4 cm edges along a curve that the other plot cuts elsewhere."""
    def arc(n):
        return [(20 * math.cos(t), 20 * math.sin(t)) for t in np.linspace(0, math.pi / 2, n)]

    inner = [ring([(0, 0), *arc(800)])]
    outer = [ring([(30, 0), (30, 30), (0, 30), *arc(800)[::-1]])]
    got = borders(spark, [(1, inner), (2, outer)], cell=2.0)
    assert got[(1, 2)] == pytest.approx(10 * math.pi, abs=0.02)


def sections(rings, x):
    """The stretches of the line at x inside a polygon, by even-odd crossings."""
    ys = []
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ax <= x) != (bx <= x):
                ys.append(ay + (by - ay) * (x - ax) / (bx - ax))
    ys.sort()
    return list(zip(ys[::2], ys[1::2]))


def plain_union_share(shapes, cx, cy, radius, lines=6000):
    total = 0.0
    for x in cx - radius + (np.arange(lines) + 0.5) * (2 * radius / lines):
        half = math.sqrt(radius * radius - (x - cx) ** 2)
        spans = sorted((max(a, cy - half), min(b, cy + half)) for _, rings in shapes for a, b in sections(rings, x))
        reach = cy - half
        for a, b in spans:
            if b > max(a, reach):
                total += b - max(a, reach)
                reach = b
    return 100 * total * (2 * radius / lines) / (math.pi * radius * radius)


def star(rng, n, cx, cy, r):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return ring([(cx + rng.uniform(0.4, 1) * r * math.cos(t), cy + rng.uniform(0.4, 1) * r * math.sin(t)) for t in turns])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_union_of_random_polygons(spark, seed):
    rng = random.Random(seed)
    shapes = []
    for i in range(14):
        cx, cy = rng.uniform(-60, 60), rng.uniform(-60, 60)
        r = rng.choice([15, 40, 90])
        outline = star(rng, rng.randint(4, 15), cx, cy, r)
        if rng.random() < 0.5:
            outline = outline[::-1]
        holes = [ring([(cx - 1, cy - 1), (cx + 1, cy - 1), (cx, cy + 1)])] if len(sections([outline], cx - 1)) and i % 3 == 0 and all(any(a < y < b for a, b in sections([outline], x)) for x, y in ((cx - 1, cy - 1), (cx + 1, cy - 1), (cx, cy + 1))) else []
        shapes.append((i, [outline, *holes]))
    shapes += [(20, shapes[0][1]), (21, [shapes[1][1][0][::-1], *shapes[1][1][1:]])]  # copies, one turned round
    spots = [(k, rng.uniform(-70, 70), rng.uniform(-70, 70)) for k in range(25)] + [(100, *shapes[0][1][0][0]), (101, *shapes[2][1][0][1])]
    points = spark.createDataFrame(spots, "pid int, x double, y double")
    got = {r.pid: r.pct for r in E.union_coverage_percent(points, "pid", frame(spark, shapes), "sid", 25.0).collect()}
    for k, x, y in spots:
        assert got[k] == pytest.approx(plain_union_share(shapes, x, y, 25.0), abs=0.05), k


def test_union_of_boxes_that_share_borders(spark):
    """Boxes side by side, on top of each other, and centres on borders and corners."""
    shapes = [(1, [box(0, 0, 10, 10)]), (2, [box(10, 0, 20, 10)]), (3, [box(5, 5, 15, 15)]), (4, [box(0, 0, 10, 10)]), (5, [box(0, 0, 10, 5)]), (6, [box(-5, -5, 25, 25), box(-1, -1, 21, 16)])]
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in (-5, -1, 0, 5, 10, 20) for y in (-5, 0, 5, 10, 16, 25))]
    points = spark.createDataFrame(spots, "pid int, x double, y double")
    for radius in (3.0, 9.0):
        got = {r.pid: r.pct for r in E.union_coverage_percent(points, "pid", frame(spark, shapes), "sid", radius).collect()}
        for k, x, y in spots:
            assert got[k] == pytest.approx(plain_union_share(shapes, x + 1e-7, y, radius), abs=0.05), (x, y, radius)


def test_union_without_polygons_or_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, None)], "pid int, x double, y double")
    empty = frame(spark, [])
    assert {r.pid: r.pct for r in E.union_coverage_percent(points, "pid", empty, "sid", 5.0).collect()} == {1: 0.0, 2: 0.0}
    whole = frame(spark, [(1, [box(-9, -9, 9, 9)])])
    assert {r.pid: round(r.pct, 9) for r in E.union_coverage_percent(points, "pid", whole, "sid", 5.0).collect()} == {1: 100.0, 2: 0.0}


SQUARE = box(0, 0, 10, 10)
CASES = [
    ([SQUARE], None),
    ([SQUARE[::-1]], None),
    ([SQUARE, box(2, 2, 4, 4), box(5, 5, 8, 8)], None),
    ([SQUARE, ring([(0, 5), (3, 4), (3, 6)])], None),  # touches the outline in one point
    ([SQUARE, box(2, 2, 5, 5), box(5, 5, 8, 8)], None),  # holes touch in one point
    ([ring([(0, 0), (0, 0), (10, 0), (10, 10), (10, 10), (0, 10)])], None),  # repeated vertices
    ([ring([(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)])], None),  # vertex on a straight line
    (None, "empty"),
    ([], "empty"),
    ([[(0.0, 0.0), (float("nan"), 0.0), (1.0, 1.0), (0.0, 0.0)]], "bad number"),
    ([[(0.0, 0.0), (None, 0.0), (1.0, 1.0), (0.0, 0.0)]], "bad number"),
    ([SQUARE[:-1]], "open ring"),
    ([ring([(0, 0), (5, 5)])], "few vertices"),
    ([ring([(0, 0), (5, 5), (5, 5)])], "few vertices"),
    ([ring([(0, 0), (5, 5), (10, 10)])], "no area"),
    ([ring([(0, 0), (10, 10), (10, 0), (0, 12)])], "crossing"),
    ([ring([(0, 0), (10, 0), (10, 5), (15, 5), (10, 5), (10, 10), (0, 10)])], "crossing"),  # spike
    ([ring([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)])], "touch"),  # vertex on an edge of its ring
    ([ring([(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)])], "touch"),  # vertex met twice
    ([SQUARE, box(8, 2, 12, 4)], "crossing"),
    ([SQUARE, box(2, 2, 6, 6), box(4, 4, 8, 8)], "crossing"),  # holes cross
    ([SQUARE, box(0, 2, 4, 4)], "crossing"),  # hole runs along the outline
    ([SQUARE, SQUARE], "crossing"),
    ([SQUARE, box(20, 20, 22, 22)], "hole outside"),
    ([SQUARE, box(-5, -5, 15, 15)], "hole outside"),
    ([SQUARE, box(1, 1, 9, 9), box(3, 3, 4, 4)], "hole in hole"),
    ([SQUARE, ring([(0, 5), (5, 4), (10, 5), (5, 6)])], "split inside"),  # touches the outline twice
    ([SQUARE, ring([(0, 5), (2, 4), (4, 5), (2, 6)]), ring([(4, 5), (7, 4), (10, 5), (7, 6)])], "split inside"),  # a chain of holes
    ([ring([(0, 0), (10, 0), (10, 10), (5, 1e-9), (0, 10)])], None),  # a nanometre apart
]


def test_faults(spark):
    df = spark.createDataFrame([(i, r, "x") for i, (r, _) in enumerate(CASES)], f"sid bigint, {RINGS}, valid string")
    got = {r.sid: (r.valid, r.fault) for r in E.with_faults(df).collect()}
    assert got == {i: (fault is None, fault) for i, (_, fault) in enumerate(CASES)}


def test_faults_far_from_the_origin_and_turned(spark):
    """The same verdicts for shapes moved and scaled; turned ones keep the verdicts that rounding cannot change."""
    moved = [(i, None if r is None else [[(None if x is None else 700_000 + 4 * x, 5_900_000 + 4 * y) for x, y in one] for one in r]) for i, (r, _) in enumerate(CASES[:-1])]
    got = {r.sid: r.fault for r in E.with_faults(frame(spark, moved)).collect()}
    assert got == {i: f for i, (_, f) in enumerate(CASES[:-1])}


def test_a_ring_of_many_vertices_meets_neighbours_only(spark):
    n = 4000
    circle = ring([(1000 * math.cos(2 * math.pi * i / n), 1000 * math.sin(2 * math.pi * i / n)) for i in range(n)])
    knot = circle[:2000] + [(circle[100][0] * 1.001, circle[100][1] * 1.001)] + circle[2001:]
    df = frame(spark, [(1, [circle]), (2, [knot])])
    assert {r.sid: r.fault for r in E.with_faults(df).collect()} == {1: None, 2: "crossing"}
    edges = E.numbered_edges(df.filter("sid = 1"), "sid", E.segments(F.col("rings")[0]))
    placed = E.edge_cells(edges, 100.0)
    assert placed.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < n / 20 and placed.select("no").distinct().count() == n


def test_edges_below_a_whole_cover_are_not_paired(spark, monkeypatch):
    """Boxes on top of each other: the edges of those deep inside meet no others."""
    tables = []
    cut = E.cut_lineage

    def kept(df):
        tables.append(cut(df))
        return tables[-1]

    monkeypatch.setattr(E, "cut_lineage", kept)
    shapes = [(i, [box(i % 8, (i * 3) % 8, 600 + (i * 5) % 8, 600 + (i * 7) % 8)]) for i in range(40)] + [(40, [box(100, 300, 500, 310)])]
    shapes += [(41 + i, [box(150 + 5 * i, 150 + 5 * i, 400 + 5 * i, 400 + 5 * i)]) for i in range(20)]
    got = {tuple(r) for r in E.union_edges(frame(spark, shapes), "sid", 50.0).collect()}
    assert sum((bx - ax) * (ay + by) / -2 for ax, ay, bx, by in got) == pytest.approx(607.0 * 607.0, abs=200)
    pairs = next(t for t in tables if "along" in t.columns)
    assert not pairs.isEmpty() and pairs.filter("sid >= 40 or sid2 >= 40").isEmpty()
