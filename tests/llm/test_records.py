import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hectara.llm import records
from hectara.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def slow_crc(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(5)
    buffers = [b"123456789", *[rng.randbytes(rng.randint(4, 2000)) for _ in range(40)]]
    assert records.crc32c(buffers).tolist() == [slow_crc(b) for b in buffers]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283 and len(records.crc32c([])) == 0


ODD = ["", " ", "a  b \n c", " x", "x ", "we're <|endoftext|> x<|endoftext|>", "日本語 テスト 😀", "a" * 4000, "tab\tend \n\n next", "  a  b", "word " * 20_000]


def check(spark, rows, library, path, end_id):
    got = records.digest_records(spark, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for doc, text in order:
        ids = library.encode(text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[2])) == sorted(want, key=lambda r: (r[1], r[2]))


@pytest.mark.parametrize("end_id, file_bytes", [(2, 20_000), (None, 1 << 30)])
def test_round_trip(spark, make_docs, library, tmp_path, end_id, file_bytes):
    rng = random.Random(2)
    noise = ["".join(rng.choices("abé '.,!0\n\t 日😀<|>", k=rng.randint(1, 60))) for _ in range(120)]
    rows = [(i * 3 - 40, t) for i, t in enumerate(ODD + noise)] + [(None, "null id"), (5, None), (5, "again"), (5, "again")]
    docs = make_docs(rows).selectExpr("*", "1 as part", "'x' as file")
    records.write_records(docs, f"file://{tmp_path}/out", PATH, end_id, file_bytes)
    check(spark, rows, library, f"file://{tmp_path}/out", end_id)
    wanted = spark.createDataFrame([(-40,), (-37,), (8,), (12345,)], "doc_id long")
    some = {r.doc_id: r.ids for r in records.fetch(spark, f"file://{tmp_path}/out", wanted).collect()}
    tail = [] if end_id is None else [end_id]
    assert some == {d: library.encode(t or "", add_special_tokens=False).ids + tail for d, t in rows if d in (-40, -37, 8)}


def test_damage_is_found(spark, make_docs, tmp_path):
    records.write_records(make_docs([(1, "some text"), (2, "more text")]), f"{tmp_path}/out", PATH, 2)
    (file,) = (tmp_path / "out/records").iterdir()
    data = bytearray(file.read_bytes())
    data[30] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="wrong checksum"):
        records.digest_records(spark, f"{tmp_path}/out").collect()


def test_unlisted_files_do_not_count(spark, make_docs, tmp_path):
    records.write_records(make_docs([(1, "some text")]), f"{tmp_path}/out", PATH, 2)
    (tmp_path / "out/records/part-000000-99.rec").write_bytes(b"left by a task that died")
    assert records.digest_records(spark, f"{tmp_path}/out").count() == 1


def test_empty(spark, make_docs, tmp_path):
    records.write_records(make_docs([]), f"{tmp_path}/out", PATH, 2)
    assert records.digest_records(spark, f"{tmp_path}/out").count() == 0


def test_query(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    at = 0
    for got, (doc, text) in zip(sorted(QUERIES["op4_binary_records"](spark, SF).collect()), sorted(rows)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(got) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
