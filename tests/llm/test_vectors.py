"""Codes and whitening against plain versions over whole small tables."""
import hashlib

import numpy as np
import pytest

from hectara.llm import vector_codes, whitening
from hectara.llm.queries import CODE_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, n int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 2) for i, v, label in rows], SCHEMA)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry in every round."""
    rows = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    dims = max((len(r[1]) for r in rows), default=0)
    width = -(-dims // parts)
    x = np.array([[int(np.floor(256.0 * float(np.float32(c)))) for c in r[1]] + [0] * (parts * width - len(r[1])) for r in rows], object).reshape(len(rows), parts, width)
    first = sorted((r[0], [float(np.float32(c)) for c in r[1]], i) for i, r in enumerate(rows) if r[0] is not None)[:entries]
    books = [[list(x[i, p]) for *_, i in first] or [[0] * width] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p] for v, f in zip(x, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {r[2]: sum(e for e, q in zip(errors, rows) if q[2] == r[2]) for r in rows}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, labels[r[2]], digest) for r, f, e in zip(rows, found, errors)), key=repr)


EDGES = [(1, None, 3), (2, [None] * 8, 3), (3, [float("nan")] + [0.0] * 7, 1), (4, [float("inf")] * 8, 1), (5, [], None), (6, [0.5], None), (None, [0.25] * 8, 2), (7, [0.5] * 8, 2), (7, [0.5] * 8, 2), (7, [-0.5] * 8, None)]


def spread_rows(n, dims, seed, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (7, dims))
    v = centres[rng.integers(0, 7, n)] + rng.normal(0, 0.05, (n, dims))
    if ties:
        v = np.round(v * 8) / 8
    v[: n // 3] = v[0]
    return [(int(i), [float(c) for c in r], None if i % 9 == 0 else int(i % 4)) for i, r in zip(rng.permutation(n), v)]


@pytest.mark.parametrize("dims,ties,edges", [(32, False, False), (16, True, True), (40, True, True)])
def test_codes_by_brute_force(spark, dims, ties, edges):
    rows = spread_rows(260, dims, dims, ties) + (EDGES if edges else [])
    got = vector_codes.encode(frame(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)


def test_codes_edges_and_empty(spark):
    got = vector_codes.encode(frame(spark, EDGES)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_codes(EDGES)
    assert vector_codes.encode(frame(spark, [])).count() == 0 and vector_codes.encode(frame(spark, [(1, None, 1)])).count() == 0
    assert vector_codes.encode(frame(spark, [(None, [1.0] * 16, 1)])).first().code == "00" * 16
    huge = vector_codes.encode(frame(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])).collect()
    assert all(r.error == 0 for r in huge) and {r.code for r in huge} == {"00" * 16, "01" * 16}


def test_codes_against_sql(spark, run_sql, same):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    same(vector_codes.encode(vectors), run_sql(CODE_SQL, embeddings=vectors))


def test_balls_skip_work_and_stay_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 20_000)] + rng.integers(-60, 61, (20_000, 4))
    before = centres + rng.integers(-40, 41, (64, 4))
    own, _ = vector_codes.nearest_entries(x, before)
    after = before + np.where(rng.random((64, 1)) < 0.5, 7, 0)
    moved = (after != before).any(axis=1)
    index, best, taken = vector_codes.nearest_by_balls(x, own, after, moved)
    want = vector_codes.nearest_entries(x, after)
    assert (index == want[0]).all() and (best == want[1]).all()
    assert taken < 64 * len(x) / 10
    assert vector_codes.nearest_by_balls(x, index, after, np.zeros(64, bool))[2] == len(x)


def plain_white(rows, dims):
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.array([[int(np.floor(1024.0 * float(np.float32(c)))) + 100_000 for c in r[1]] + [100_000] * (dims - len(r[1])) for r in kept], object)
    n, s = len(kept), x.sum(axis=0)
    z = x * n - s
    v = np.array((z.T @ z) / n, float) / n / n
    e, u = np.linalg.eigh(v)
    return kept, n, [int(sum(c * c for c in row)) for row in z], np.array(z, float) / n, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("n,dims", [(700, 12), (90, 20)])
def test_whitening_by_brute_force(spark, n, dims):
    rng = np.random.default_rng(n)
    mix = rng.normal(0, 1, (dims, dims)) * np.logspace(0, -1.2, dims)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.3, dims) @ mix + 5], 1) for i in range(n)] + [e for e in EDGES if e[1] is None or len(e[1]) == 8][:4]
    got = whitening.whiten(frame(spark, rows).repartition(7))
    kept, many, far, centred, e, u = plain_white(rows, dims)
    byid = {r[0]: i for i, r in enumerate(kept)}
    out = got.collect()
    assert len(out) == 8 * many and {r.n for r in out} == {many}
    signs = {}
    for r in out:
        i, c = byid[r.vec_id], r.component - 1
        want = centred[i] @ u[:, c] / np.sqrt(e[c])
        sign = signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
        assert r.deviation == far[i] and r.whitened == pytest.approx(sign * want, abs=1e-8)
        assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_whitening_edges(spark):
    out = whitening.whiten(frame(spark, EDGES)).collect()
    kept, n, far, _, e, _ = plain_white(EDGES, 8)
    assert len(out) == 8 * n and {r.component for r in out} == set(range(1, 9))
    assert sorted(r.deviation for r in out if r.component == 1) == sorted(far)
    flat = [c + 1 for c in range(8) if e[c] <= 1e-9 * e[0]]
    assert all((r.whitened is None) == (r.component in flat) for r in out) and out[0].identity_error < 1e-8
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)] * 3)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, [], 1)])).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = [(i, [1e6 * (-1) ** i, float(i)], 1) for i in range(40)]
    out = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()}
    _, _, far, *_ = plain_white(rows, 2)
    assert out == {i: f if f < 1 << 63 else None for i, f in enumerate(far)} and None in out.values()


def test_updates_and_spectra(spark, monkeypatch):
    """Rank-one updates reproduce the scatter, also with equal and vanishing poles, and merging keeps it."""
    rng = np.random.default_rng(2)
    for x in (rng.integers(-50, 50, (300, 9)), rng.integers(-50, 50, (300, 2)) @ rng.integers(-2, 3, (2, 9)), np.repeat(rng.integers(-9, 9, (4, 9)), 5, axis=0)):
        scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
        parts = [whitening.with_block(None, p) for p in np.array_split(x, 3)]
        n, sums, d, u = whitening.combined(whitening.combined(parts[0], parts[1]), parts[2])
        assert n == len(x) and (sums == x.sum(axis=0)).all()
        assert np.abs(u.T @ u - np.eye(9)).max() < 1e-13 and np.abs(u * d @ u.T - scatter).max() <= 1e-12 * max(1, np.abs(scatter).max())
    monkeypatch.setattr(whitening, "ROWS", 16)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 6)], 1) for i in range(400)]
    kept = whitening.finite_vectors(frame(spark, rows).repartition(40), "vec_id")
    n, sums, d, u = whitening.spectrum_of(kept, 6, 1024)
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(float))
    c = x - x.mean(axis=0)
    assert n == 400 and np.abs(u * d @ u.T - c.T @ c).max() < 1e-11 * np.abs(c.T @ c).max()
