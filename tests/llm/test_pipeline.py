"""The pipeline against plain versions of its stages, each on what the stage before kept."""
import re

import corpus_pipeline
import __spark_entry__ as entry
from hectara.llm import quality_rules

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        seen[name] = (before, docs.collect())
        assert docs.columns[:5] == columns
    before, after = seen["quality rules"]
    measures = {r.doc_id: quality_rules.measure(r.text) for r in before}
    base = {i for i, m in measures.items() if m[0] < 50 or 100 * m[4] > 50 * m[0]}
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not kept & base and all(i in kept for i in measures if i not in base and labels.get(i) == 1)
    before, after = seen["near-duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert {r.doc_id for r in after} == {i for i in sets if find(i) == i} and len(after) < len(before)
    before, after = seen["decontamination"]

    def words(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    leaks = {r.doc_id for r in before for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - leaks
    before, after = seen["mixing"]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before)
    mixed = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after)
    assert abs(mixed - 1.5 * total) <= 2 * len({r.source for r in before})
    before, after = seen["sharding"]
    assert sorted((r.doc_id, r.text) for r in before) == sorted((r.doc_id, r.text) for r in after)
    assert all(r.shard_bytes <= corpus_pipeline.SHARD_BYTES for r in after)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-4:] == ["shard", "depth", "shard_bytes", "oversized"] and out.count() > 0
