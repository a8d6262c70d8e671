import numpy as np
import pytest

from hectara.llm import set_join as sj
from hectara.llm.near_duplicates import shingle_set
from hectara.llm.queries import JOIN_SQL
from tests.llm.test_near_duplicates import EDGES, near_copies

EDGE_ROWS = EDGES + [(5010, "a b c d e f g"), (5011, "A B C D E F G"), (5012, "a b c d e f h")]


@pytest.mark.parametrize("paired_below,heavy,block", [(1 << 9, 1 << 14, 512), (0, 1, 4)])
def test_against_sql(make_docs, run_sql, same, monkeypatch, paired_below, heavy, block):
    monkeypatch.setattr(sj, "PAIRED_BELOW", paired_below)
    monkeypatch.setattr(sj, "HEAVY", heavy)
    monkeypatch.setattr(sj, "BLOCK", block)
    docs = make_docs(near_copies(7 + paired_below) + EDGE_ROWS)
    assert "85 *" in JOIN_SQL
    got = sj.joined_sets(docs.selectExpr("*", "1 as key", "2 as cls", "3 as place"), 4, 85)
    same(got, run_sql(JOIN_SQL, documents=docs))


def test_rows_without_id_and_repeated_ids(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here now"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "other words here now"), (4, None), (None, None)])
    got = sorted(map(tuple, sj.joined_sets(docs, 4, 85).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (1, 1, 1), (2, 3, 1), (None, 3, None), (3, 1, 1), (4, 0, 4), (None, 0, None)], key=repr)


def test_very_long_texts(make_docs):
    words = [f"w{i}" for i in range(60_000)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words[:51_100])), (3, " ".join(words[:50_000])), (4, " ".join(words[:40_000]))])
    assert sorted((r.doc_id, r.component_id) for r in sj.joined_sets(docs, 4, 85).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_empty(make_docs):
    assert sj.joined_sets(make_docs([])).count() == 0
    assert [tuple(r) for r in sj.joined_sets(make_docs([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_prefixes_meet_at_the_threshold_under_any_order():
    rng = np.random.default_rng(4)
    table = rng.integers(1, 9, (2, sj.SLOTS)).astype(np.uint8)
    for n in list(range(1, 60)) + [200, 1000]:
        for percent in (50, 80, 85, 100):
            for m in range(max(1, -(-percent * n // 100)), n + 1, max(1, n // 20)):
                common = -(-percent * (n + m) // (100 + percent))
                if common > m:
                    continue
                x = np.unique(rng.integers(0, 1 << 63, n + m - common, np.int64).astype(np.uint64))
                rng.shuffle(x)
                a, b = np.sort(x[:n]), np.sort(x[n - common:])
                p, q = sj.prefix_size(n, percent), sj.prefix_size(m, percent)
                assert set(a[:p]) & set(b[:q]) and set(a[-p:]) & set(b[-q:])
                assert set(sj.rare_prefix(a, table, percent)[0]) & set(sj.rare_prefix(b, table, percent)[0])


def test_frequencies_are_sums_over_all_documents(make_docs):
    texts = [f"a b c d w{i % 7} x{i}" for i in range(390)] + [None, ""]
    docs = make_docs(list(enumerate(texts))).repartition(9)
    table = sj.frequencies(sj.profiles(docs, 4))
    want = np.zeros((sj.TABLES, sj.SLOTS), np.int64)
    for t in texts:
        for r in range(sj.TABLES):
            np.add.at(want[r], sj.slots(shingle_set(t, 4), r), 1)
    assert (table == np.minimum(want, sj.MOST)).all() and table.max() == sj.MOST


def test_a_common_passage_is_no_key(make_docs):
    """Texts that share a passage but have words of their own meet in no bucket, and near copies meet leaders, not each other."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs([(i, passage + " " + " ".join(f"q{i}x{j}" for j in range(60))) for i in range(300)])
    found = sj.profiles(docs, 4)
    assert sj.shared_entries(sj.prefix_entries(docs, sj.frequencies(found), 4, 85)).count() == 0


def test_compared_pairs_of_near_copies_stay_linear(make_docs, monkeypatch):
    seen = []
    kept = sj.verified
    monkeypatch.setattr(sj, "verified", lambda pairs, *rest: seen.append(pairs.count()) or kept(pairs, *rest))
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i % 397] + [f"n{i}"] + base[i % 397 + 1:])) for i in range(400)]
    assert sj.joined_sets(make_docs(rows), 5, 85).filter("component_id = 0").count() == 400
    assert sum(seen) < 12 * 400


def test_brief_forms_lose_no_link():
    rng = np.random.default_rng(8)
    refused = 0
    for n in (1, 2, 5, 30, 31, 32, 33, 100, 900, 5000):
        for m in (n, max(1, n - 1), max(1, int(0.9 * n))):
            for share in (0.2, 0.7, 0.86, 0.9, 1.0):
                both = min(n, m, int(share * (n + m) / (1 + share)) + 1)
                x = np.unique(rng.integers(0, 1 << 63, n + m - both, np.int64).astype(np.uint64))
                rng.shuffle(x)
                a, b = np.sort(x[:n]), np.sort(x[len(x) - m:])
                common = len(np.intersect1d(a, b))
                links = 100 * common >= 85 * (n + m - common)
                possible = sj.may_link(sj.brief(a, 85), sj.brief(b, 85), 85)
                assert possible or not links
                refused += not possible
    assert refused > 30


def test_only_sets_that_enter_a_block_are_shuffled(spark, tmp_path, monkeypatch):
    """Few rows of large buckets must not send the sets of all classes through a shuffle."""
    monkeypatch.setattr(sj, "BLOCK", 4)
    sets = {c: np.sort(np.arange(60 + c % 7, dtype=np.uint64) + np.uint64(1000 * c if c >= 20 else 0)) for c in range(400)}
    path = str(tmp_path / "sets")
    spark.createDataFrame([(c, bytearray(m.tobytes())) for c, m in sets.items()], "cls long, members binary").write.parquet(path)
    rows = [(1, c, len(sets[c]), c, 0, 24, 23) for c in range(24)]
    members = spark.createDataFrame(rows, "key long, cls long, n long, comp long, largest long, many long, outside long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sets are larger than a guessed broadcast
    try:
        links = sj.sized_blocks(members, spark.read.parquet(path), 85)
        assert "hashpartitioning(cls" not in links._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = {(a, b) for a in range(20) for b in range(20) if a < b}
    assert {(min(r), max(r)) for r in map(tuple, links.collect())} == want


def test_brief_forms_are_a_small_share_of_the_sets():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 63, 1300, np.int64).astype(np.uint64))
    rng.shuffle(x)
    a, b = np.sort(x[:1100]), np.sort(x[200:])  # 900 of 1,300
    assert 12 * len(sj.brief(a, 85)) < a.nbytes
    assert not sj.may_link(sj.brief(a, 85), sj.brief(b, 85), 85)
    assert sj.may_link(sj.brief(a, 85), sj.brief(a[:1000], 85), 85)


def test_full_sets_enter_only_blocks_in_which_they_may_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 200, np.int64).astype(np.uint64)
    sets = {c: np.sort(base[c % 5:] if c < 10 else rng.integers(0, 1 << 63, 200, np.int64).astype(np.uint64)) for c in range(60)}
    path = str(tmp_path / "sets")
    spark.createDataFrame([(c, bytearray(m.tobytes())) for c, m in sets.items()], "cls long, members binary").write.parquet(path)
    rows = [(1, c, len(sets[c]), c, 0, 60, 59) for c in range(60)]
    members = spark.createDataFrame(rows, "key long, cls long, n long, comp long, largest long, many long, outside long")
    seen, kept = [], sj.cut_lineage
    monkeypatch.setattr(sj, "cut_lineage", lambda df: seen.append(kept(df)) or seen[-1])
    links = {(min(r), max(r)) for r in map(tuple, sj.sized_blocks(members, spark.read.parquet(path), 85).collect())}
    assert links == {(a, b) for a in range(10) for b in range(10) if a < b}
    entered = [df for df in seen if "side" in df.columns]
    assert entered and {r.cls for df in entered for r in df.collect()} == set(range(10))


def test_full_counters_still_tell_common_shingles(make_docs):
    """Tables so small that rare shingles alone put several hundred into every counter, as a large corpus does."""
    size, common = 512, " ".join(f"p{i}" for i in range(10))
    texts = [f"{common} " + " ".join(f"q{i}x{j}" for j in range(180)) for i in range(1200)]
    docs = make_docs(list(enumerate(texts))).repartition(5)
    found = sj.profiles(docs, 4, size)
    table = sj.frequencies(found, size)
    assert found.agg({"n_shingles": "sum"}).first()[0] > 1.5 * sj.MOST * size
    assert np.quantile(table, 0.01) > 0 and np.quantile(table, 0.9) <= sj.MOST // 2 + 1
    shared = set(shingle_set(common, 4).view(np.int64).tolist())
    entries = sj.prefix_entries(docs, table, 4, 85)
    assert entries.filter("heavy").count() < 0.02 * entries.count()
    assert not shared & {r.key for r in entries.select("key").distinct().collect()}
    assert sj.shared_entries(entries).count() == 0


def test_steps_of_counters_follow_the_noise_of_any_corpus():
    assert sj.scale(0.0) == sj.scale(15.0) == (0, 1)
    for mean in (300.0, 30_000.0, 3e7):
        base, step = sj.scale(mean)
        assert (mean + 4 * mean**0.5 - base) / step <= sj.MOST // 2 + 2 and (mean - base) / step > 30
    piece = np.array([0, 1, 255, 256, sj.PART_MOST], np.uint16)
    assert sj.unpacked_counts(sj.packed_counts(piece)).tolist() == piece.tolist()
