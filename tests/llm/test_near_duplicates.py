import random

import numpy as np
import pytest

from hectara.llm import near_duplicates as nd
from hectara.llm.components import components
from hectara.llm.queries import NEAR_SQL


def near_copies(seed, groups=12, loose=60):
    rng = random.Random(seed)
    rows, at = [], 0
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
            rows.append((at, " ".join(words)))
            at += 1
    rows += [(at + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 80)))) for i in range(loose)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(at + 200 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(25)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], t) for i, (_, t) in enumerate(rows)]


EDGES = [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a B"), (5005, "a b c"), (5006, "one"), (5007, "One"), (5008, "x " * 900), (5009, "x " * 700)]


@pytest.mark.parametrize("paired_below", [1 << 14, 0])
def test_against_sql(make_docs, run_sql, same, monkeypatch, paired_below):
    monkeypatch.setattr(nd, "PAIRED_BELOW", paired_below)
    monkeypatch.setattr(nd, "BLOCK", 4)
    docs = make_docs(near_copies(paired_below) + EDGES)
    got = nd.duplicate_groups(docs.selectExpr("*", "1 as kept", "2 as cls"), 4, 80).drop("text_key")
    same(got, run_sql(NEAR_SQL, documents=docs))


def test_rows_without_id_and_repeated_ids(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "other words here now")])
    got = sorted(map(tuple, nd.duplicate_groups(docs, 4, 80).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 1, False)], key=repr)
    clash = docs.selectExpr("*", "'t' as text_key", "1 as _id")
    kept = nd.keep_first(clash, 4, 80)
    assert kept.columns == clash.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 1]


def test_very_long_texts(make_docs):
    words = [f"w{i}" for i in range(60_000)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:40_200]))])
    assert sorted(map(tuple, nd.duplicate_groups(docs).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (3, 1)]


def test_empty(make_docs):
    assert nd.duplicate_groups(make_docs([])).count() == 0
    assert nd.keep_first(make_docs([(1, None), (2, "")])).count() == 2


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.8, 0.95):
        n, m = 900, 860
        both = int(share * (n + m) / (1 + share))
        errors = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n + m - both, np.int64).astype(np.uint64)
            a, b = nd.registers(x[:n]), nd.registers(x[n - both:])
            assert (np.maximum(a, b) == nd.registers(x)).all()
            errors.append(nd.likely_similarity(a[None], b[None], np.array([n * 1.0]), np.array([m * 1.0]))[0] - both / (n + m - both))
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < nd.MARGIN


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_candidates_of_copies_stay_linear(spark, make_docs, monkeypatch):
    """A group of near copies meets its leaders, not itself pairwise."""
    seen = []
    confirm = nd.confirmed
    monkeypatch.setattr(nd, "confirmed", lambda pairs, *rest: seen.append(pairs.count()) or confirm(pairs, *rest))
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i % 397] + [f"n{i}"] + base[i % 397 + 1:])) for i in range(400)]
    groups = nd.duplicate_groups(make_docs(rows), 5, 80)
    assert groups.filter("component_id = 0").count() == 400
    assert sum(seen) < 12 * 400
