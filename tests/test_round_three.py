"""Steps whose memory, time or input of one task must not grow with a whole table."""
import datetime
import hashlib
import math
import os
import random
import re

from hectara.catalog import load, sources_and_sinks
from hectara.operators import similarity as V
from hectara.operators import spatial as S
from hectara.plans.testbed import table
from hectara.sources import writers as W
from hectara.streaming import feedback as B

SF = "/root/testdata/sf0.001"
QUERIES = load().QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_users_per_day(spark):
    draw, start = random.Random(3), datetime.datetime(2024, 3, 1)
    rows = [(draw.choice([1, 2, 3, None]), start + datetime.timedelta(minutes=draw.randint(0, 6000)) if i % 9 else None) for i in range(80)]
    want = {}
    for user, ts in rows:
        hours = [None] if ts is None else [ts.replace(minute=0) - datetime.timedelta(hours=i) for i in range(24)]
        for hour in hours:
            want.setdefault(hour, set()).add(user)
    out = B.users_per_day(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz"))
    assert {r.start: r.users for r in out.collect()} == {k: len(v) for k, v in want.items()}
    exchanges = [line for line in plan(QUERIES["stm_03_active_users_batch"](spark, SF)).splitlines() if "hashpartitioning" in line]
    assert not any("user_id" in line and "start" in line for line in exchanges)


def test_feed_files_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sources_and_sinks, "FEED_ROWS", 7)
    feed = QUERIES["src_03_zone_feed"](spark, SF)
    counts = [open(f.removeprefix("file:").replace("///", "/")).read().count("</app:StrefaPlanistyczna>") for f in feed.inputFiles()]
    assert sum(counts) == feed.count() == table(spark, SF, "shapes").count() and max(counts) <= 7


def test_edge_tables_are_sorted_in_shares(spark, tmp_path):
    W.write_edges(table(spark, SF, "parcels"), table(spark, SF, "zones"), str(tmp_path / "edges"))
    folders = [sum(name.endswith(".parquet") for name in names) for _, _, names in os.walk(tmp_path)]
    assert max(folders) > 4  # the tables come in one file each


def test_diagnosis_does_not_sort_the_rows_of_a_search(spark):
    lines = plan(QUERIES["agg_15_diagnosis"](spark, SF)).splitlines()
    assert not any("SortAggregate" in line and "first(" in line for line in lines)


def test_samples_are_made_in_many_tasks(spark):
    assert QUERIES["geo_09_sample_points"](spark, SF).rdd.getNumPartitions() >= 8  # two before


def test_coverage_of_small_and_huge_polygons(spark):
    """Polygons within and beyond the width of a cell join, upright and not; shares add up, and no side is broadcast."""
    box = lambda a, b, c, d: [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]
    shapes = [([box(-500, -500, 500, 500)],), ([box(0, -50, 50, 50)],), ([[(0.0, -50.0), (50.0, -50.0), (50.0, 50.0), (0.0, 50.0), (0.0, 0.0), (0.0, -50.0)]],), ([box(-9, -9, 9, 9), box(-8, -8, 8, 8)],)]
    polygons = spark.createDataFrame(shapes, "rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0), (3, None, 1.0), (4, 25.0, 0.0)], "pid int, x double, y double")
    cover = S.coverage_percent(points, "pid", polygons, 2.0)
    assert {r.pid: round(r.pct, 6) for r in cover.collect()} == {1: 200.0, 2: 0.0, 3: 0.0, 4: 300.0}
    near = [line for line in plan(cover).splitlines() if "Join" in line and "cx#" in line and "level#" not in line]
    assert near and all("SortMergeJoin" in line for line in near)


def test_closed_sessions_are_not_broadcast(spark, tmp_path, monkeypatch):
    """The sessions of a batch meet the parcels by shuffle, else the task that reads the parcels sums them all."""
    at = datetime.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(7, at, at, 3, i % 2, 0, f"D{i % 3}") for i in range(9)], B.SESSION_SCHEMA)
    parcels = spark.createDataFrame([(f"D{i}", "A" if i else "B") for i in range(3)], "id_dzialki string, gmina string")
    batch.write.parquet(f"{tmp_path}/sessions")  # files have a small estimate, local rows have none
    parcels.write.parquet(f"{tmp_path}/parcels")
    batch, parcels = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("sessions", "parcels"))
    plans, kept = [], type(batch).join
    monkeypatch.setattr(type(batch), "join", lambda self, *a: plans.append(kept(self, *a)) or plans[-1])
    B.pattern_sink(parcels, f"{tmp_path}/out")(batch, 0)
    assert plans and not any("Broadcast" in plan(p) for p in plans)
    rows = spark.read.parquet(f"{tmp_path}/out/batch=0").collect()
    assert sorted((r.user_id, r.location, r.n, r.liked) for r in rows) == [(7, "A", 6, 3), (7, "B", 3, 1)]


def test_hashed_vectors_count_words_within_a_row(spark):
    """Only texts that repeat a key, or have none, meet in a shuffle; all others stay one row."""
    rows = [(1, "Ala ma kota, kota!"), (1, "kota i psa"), (2, None), (3, ""), (4, "..."), (5, "x2 X2 x2 x3"), (6, "ala"), (None, "ala psa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 512
    want = {}
    for key, text in rows:
        for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
            of = want.setdefault(key, {})
            of[place(w)] = of.get(place(w), 0) + 1
    held = {p: sum(p in of for of in want.values()) for of in want.values() for p in of}
    for of in want.values():
        of.update({p: n * math.log((len(rows) + 1) / (held[p] + 1)) for p, n in of.items()})
    expected = {(key, p): round(w / math.sqrt(sum(v * v for v in of.values())), 6) for key, of in want.items() for p, w in of.items()}
    got = [((r.doc_id, r.place), round(r.weight, 6)) for r in V.hashed_vectors(docs, "doc_id", "text").collect()]
    assert dict(got) == expected and len(got) == len(expected)
    counts = plan(V.place_counts(docs, "doc_id", "text", 512))
    assert "Exchange" not in counts and "Aggregate" not in counts
