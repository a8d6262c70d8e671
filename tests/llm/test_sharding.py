import hashlib

import pytest

from hectara.llm import sharding
from hectara.llm.queries import SHARD_BYTES, SHARD_SQL


@pytest.mark.parametrize("limit", [300, 2000, 50_000])
def test_against_sql(make_docs, run_sql, same, limit):
    docs = make_docs([(i, "x" * (i * 37 % 211)) for i in range(300)] + [(300, None), (301, ""), (None, "null id"), (302, "é" * 5000)])
    got = sharding.assign_shards(docs.select("doc_id", "text"), limit).drop("text")
    same(got, run_sql(SHARD_SQL.replace(str(SHARD_BYTES), str(limit)), documents=docs))


def test_buckets(make_docs):
    """Every shard fits, none could be joined with its sibling, and a split is made only where it is needed."""
    docs = make_docs([(i, "x" * (20 + i * 37 % 211)) for i in range(500)])
    rows = sharding.assign_shards(docs, 2500).collect()
    sizes = {}
    for r in rows:
        bits = f"{int(hashlib.md5(f'{r.doc_id}|{r.text}'.encode()).hexdigest()[:15], 16):060b}"
        assert bits.startswith(r.shard) and r.depth == len(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
    assert all(n <= 2500 for n in sizes.values()) and len(sizes) > 20
    assert all(r.shard_bytes == sizes[r.shard] and not r.oversized for r in rows)
    for s in sizes:
        around = sum(n for t, n in sizes.items() if t.startswith(s[:-1]))
        assert not s or around > 2500


def test_repeated_rows_overflow(make_docs):
    docs = make_docs([(1, "y" * 100)] * 57 + [(2, "z")] + [(3, "w" * 900)] * 3).selectExpr("*", "'a' as shard", "0 as shard_rows", "1 as _prefix")
    out = sharding.assign_shards(docs, 450)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["n_bytes", "shard", "depth", "shard_bytes", "oversized"]
    pages = {}
    for r in out.collect():
        pages.setdefault(r.shard, []).append(r)
    for rows in pages.values():
        assert all(r.shard_bytes == sum(x.n_bytes for x in rows) for r in rows)
        assert sum(r.n_bytes for r in rows) <= 450 or len(rows) == 1 and rows[0].oversized
    assert sum(map(len, pages.values())) == 61 and sum(r.doc_id == 1 for rows in pages.values() for r in rows) == 57


def test_written_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i, "x" * 50) for i in range(40)])
    sharding.write_shards(docs, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.select("shard").distinct().count() == sharding.assign_shards(docs, 500).select("shard").distinct().count()


def test_empty(make_docs):
    assert sharding.assign_shards(make_docs([]), 100).count() == 0
    assert [r.shard for r in sharding.assign_shards(make_docs([(1, None)]), 100).collect()] == [""]
