"""Discs in blocks against all pairs."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hectara.operators import discs as D
from hectara.operators import spatial as S
from hectara.plans.testbed import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the discs on one spot, a third in a tight cluster, some without a place; points on a grid around them, some often and some exactly on a rim."""
    rng = np.random.default_rng(5)
    q = np.vstack([np.tile([[700.0, 700.0]], (90, 1)), rng.normal(2000, 3, (90, 2)), rng.uniform(-3000, 6000, (90, 2))])
    f = np.vstack([np.tile([[1200.0, 700.0], [1000.0, 1100.0]], (20, 1)), rng.integers(1990, 2010, (300, 2)).astype(float), rng.integers(-40, 80, (900, 2)) * 75.0])
    discs = spark.createDataFrame([(f"q{i}", float(x), float(y)) for i, (x, y) in enumerate(q)] + [("null", None, 1.0), ("nan", float("nan"), 1.0)], "qid string, x double, y double")
    points = spark.createDataFrame([(float(x), float(y)) for x, y in f] + [(None, 1.0), (float("inf"), 1.0)], "x double, y double")
    return discs, points, q, f


@pytest.mark.parametrize("most", [None, 16])
def test_counts_are_those_of_all_pairs(crowd, monkeypatch, most):
    if most:
        monkeypatch.setattr(D, "BLOCK_DISCS", most)
        monkeypatch.setattr(D, "BLOCK_SHAPES", most)
    discs, points, q, f = crowd
    d = np.sqrt(((q[:, None] - f[None]) ** 2).sum(-1))
    for radius in (5.0, 500.0):
        got = {r.qid: (r.n, r.n_strict) for r in S.counts_in_discs(discs, "qid", points, radius).collect()}
        assert got == {f"q{i}": (int((v <= radius).sum()), int((v < radius).sum())) for i, v in enumerate(d) if (v <= radius).any()}
    assert S.counts_in_discs(discs, "qid", points.limit(0), 9.0).collect() == [] == S.counts_in_discs(discs.limit(0), "qid", points, 9.0).collect()


def test_the_largest_square_keeps_the_root():
    for radius in (0.1, 1 / 3, 5.0, 499.99, 500.0, 1e7 + 0.1):
        square, under = D.largest_square(radius, False), D.largest_square(radius, True)
        assert math.sqrt(square) <= radius < math.sqrt(math.nextafter(square, math.inf))
        assert math.sqrt(under) < radius <= math.sqrt(math.nextafter(under, math.inf))


def test_touching_boxes_make_no_row_a_pair(spark, crowd):
    """Upright boxes, wide ones, and shapes that are neither; no join of discs and boxes is left in the plan when all shapes are boxes."""
    discs, _, q, _ = crowd
    rng = np.random.default_rng(6)
    low = rng.integers(-20, 40, (120, 2)) * 100.0
    high = low + rng.integers(0, 12, (120, 2)) * 90.0
    low, high = np.vstack([low, [[-9e4, 0.0]]]), np.vstack([high, [[9e4, 50.0]]])
    ring = lambda a, b: [[(float(x), float(y)) for x, y in ((a[0], a[1]), (b[0], a[1]), (b[0], b[1]), (a[0], b[1]), (a[0], a[1]))]]
    corner = [[(0.0, 0.0), (900.0, 0.0), (0.0, 900.0), (0.0, 0.0)]]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "rings array<array<struct<x:double,y:double>>>")
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0.0)
    want = ((gap**2).sum(-1) <= 250000).sum(1)
    boxes = frame([ring(a, b) for a, b in zip(low, high)])
    got = {r.qid: r.n for r in S.count_touching(discs, "qid", boxes, 500.0).collect()}
    assert got == {f"q{i}": int(n) for i, n in enumerate(want)} | {"null": 0, "nan": 0}
    more = {r.qid: r.n for r in S.count_touching(discs, "qid", boxes.unionByName(frame([corner, None])), 500.0).collect()}
    assert more["q0"] == got["q0"] + 1 and more["null"] == 0
    plan = S.count_touching(discs, "qid", table(spark, SF, "zones"), 500.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "blevel" not in plan


def test_covered_boxes_make_no_row_a_pair(spark, crowd):
    """Shares of boxes in blocks are those of their edges, also for boxes of no width, boxes around a disc and discs around a box."""
    discs, _, q, _ = crowd
    rng = np.random.default_rng(7)
    low = rng.integers(-20, 40, (150, 2)) * 100.0
    high = low + rng.integers(0, 25, (150, 2)) * 90.0
    ring = lambda a, b, split: [[(float(x), float(y)) for x, y in ((a[0], a[1]), *(((a[0] + b[0]) / 2, a[1]),) * split, (b[0], a[1]), (b[0], b[1]), (a[0], b[1]), (a[0], a[1]))]]
    shapes = lambda split: spark.createDataFrame([(ring(a, b, split),) for a, b in zip(low, high)], "rings array<array<struct<x:double,y:double>>>")
    for radius in (30.0, 500.0):
        whole = {r.qid: r.pct for r in S.coverage_percent(discs, "qid", shapes(0), radius).collect()}
        edged = {r.qid: r.pct for r in S.coverage_percent(discs, "qid", shapes(1), radius).collect()}  # a vertex more: no upright rectangle, so edge by edge
        assert whole.keys() == edged.keys() and len(whole) == len(q) + 2 and max(whole.values()) > 100
        assert all(whole[i] == pytest.approx(edged[i], abs=1e-7) for i in whole)
    plan = S.coverage_percent(discs, "qid", shapes(0), 500.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "cx#" not in plan
