"""Token ids as length-delimited binary records with a separate offset index.

A record is framed as: length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of the payload (4), all
little-endian. The payload is one flag byte (1: there is a doc_id, 2: ids of four bytes instead of two), the
doc_id (8 bytes) and the ids. Documents are range-partitioned by doc_id, every task writes one file, and Spark writes the
index (file, part, doc_id, offset, n_bytes, n_ids). A file's name holds its task attempt; only files that the index
names count, so a task that runs twice or dies leaves nothing that is read.

Files go to the file system of the given path, which driver and executors must share.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first and is read back as null; rows that
repeat a doc_id are ordered by their texts; an empty table gives an empty index and no records.
"""
from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from hectara.llm.common import ship_package

UNITS_KEPT = 700_000
HEAD, HEAD_BYTES = "<Bq", 9
BLOCK = 256  # two-byte steps of a checksum block
#: Fixed values of the record format: reflected polynomial of CRC-32C and the added mask.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
INDEX = StructType([
    StructField("part", IntegerType()), StructField("file", StringType()), StructField("doc_id", LongType()),
    StructField("offset", LongType()), StructField("n_bytes", LongType()), StructField("n_ids", LongType()),
])
READ = StructType([
    StructField("doc_id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()),
])


def _step_table() -> np.ndarray:
    """What two zero bytes make of each 16-bit state."""
    state = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        state = (state >> np.uint32(1)) ^ np.where(state & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return state


STEP = _step_table()


def advance(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    return STEP[(state ^ words) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))


def _block_tables() -> np.ndarray:
    """What a block of zeros makes of each byte of a state, a table for each of the four bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]).ravel()
    for _ in range(BLOCK):
        state = advance(state, np.uint32(0))
    return state.reshape(4, 256)


SKIP = _block_tables()


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer (of four bytes or more), all at once.

    A buffer is padded in front with zeros, which leave an empty state as it is, to whole blocks; the starting value is
    put in by inverting its first four bytes. Blocks are worked in parallel and joined in order.
    """
    if not buffers:
        return np.zeros(0, np.uint32)
    width = 2 * BLOCK
    sizes = np.fromiter(map(len, buffers), np.int64, len(buffers))
    many = -(-sizes // width)
    ends = np.cumsum(many)
    laid = np.frombuffer(b"".join(bytes(m * width - s) + b for b, s, m in zip(buffers, sizes.tolist(), many.tolist())), np.uint8).copy()
    firsts = (ends * width - sizes)[:, None] + np.arange(4)
    laid[firsts] ^= 0xFF
    columns = np.ascontiguousarray(laid.view("<u2").reshape(-1, BLOCK).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for words in columns:
        state = advance(state, words)
    total = np.zeros(len(buffers), np.uint32)
    starts = ends - many
    order = np.argsort(-many, kind="stable")
    for k in range(int(many.max())):
        rows = order[:np.searchsorted(-many[order], -k, "left")]  # buffers with more than k blocks
        t = total[rows]
        total[rows] = SKIP[0, t & 255] ^ SKIP[1, (t >> 8) & 255] ^ SKIP[2, (t >> 16) & 255] ^ SKIP[3, t >> 24] ^ state[starts[rows] + k]
    return ~total


def masked(crcs: np.ndarray) -> np.ndarray:
    crcs = crcs.astype(np.uint32)
    return ((crcs >> np.uint32(15)) | (crcs << np.uint32(17))) + np.uint32(MASK)


class Encoder:
    """Token ids of whole texts by a tokenizer file, given as its JSON text.

    A word after a single space is encoded alike wherever it stands, so each distinct one is encoded once and kept in
    two generations of a bounded table. Texts with longer runs of white space are cut only at their single spaces.
    """

    def __init__(self, description: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(description)
        parsed = json.loads(description)
        # Words are kept only where this is known to hold: byte-level pieces that take the space before them.
        self.by_words = parsed.get("normalizer") is None and (parsed.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        special = [re.escape(t["content"]) for t in parsed.get("added_tokens", ())]
        self.apart = re.compile("|".join([r"\s", *special]))  # not to be encoded together with other words
        self.single = re.compile(r"(?<=\S) (?=\S)")
        self.recent: dict[str, bytes | None] = {}  # ids of a word and the space before it; None if white space is at an end
        self.earlier: dict[str, bytes | None] = {}
        self.first: dict[str, bytes] = {}  # ids of a word at the start of a text
        self.inner: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def solve(self, units: list[str]) -> None:
        inside = self.apart.search
        plain = [u for u in units if u and not inside(u)]
        rest = list(set(units).difference(plain))
        even = [u for u in rest if u and not u[0].isspace() and not u[-1].isspace()]
        self.recent.update(dict.fromkeys(rest) | dict(zip(even, self.whole([" " + u for u in even]))))
        ids = np.array(self.library.encode(" " + " ".join(plain), add_special_tokens=False).ids, self.kind) if plain else np.zeros(0, self.kind)
        starts = np.nonzero(self.opens[ids])[0]
        if len(starts) != len(plain):
            self.recent.update(zip(plain, self.whole([" " + u for u in plain])))
            return
        data, places = ids.tobytes(), (np.append(starts, len(ids)) * self.kind.itemsize).tolist()
        self.recent.update(zip(plain, map(data.__getitem__, map(slice, places, places[1:]))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian numbers of `kind`."""
        if not self.by_words:
            filled = iter(self.whole([t for t in texts if t]))
            return [next(filled) if t else b"" for t in texts]
        split = [t.split(" ") if t else [""] for t in texts]
        self.learn({u for s in split for u in s[1:]})
        out, odd = [], []
        for i, s in enumerate(split):
            try:
                out.append(b"".join(map(self.recent.__getitem__, s[1:])))
            except TypeError:  # None: a word with white space at an end, so its space is one of several
                out.append(b"")
                odd.append(i)
        for i in odd:
            split[i] = self.single.split(texts[i])
        self.learn({u for i in odd for u in split[i][1:]}, any_end=True)
        for i in odd:
            out[i] = b"".join([self.inner.get(u) or self.recent[u] for u in split[i][1:]])
        self.inner.clear()
        firsts = {s[0] for s in split}.difference(self.first)
        if firsts:
            if len(self.first) > UNITS_KEPT:
                self.first, firsts = {}, {s[0] for s in split}
            firsts = list(firsts)
            self.first.update(zip(firsts, self.whole(firsts)))
        return [self.first[s[0]] + rest for s, rest in zip(split, out)]

    def learn(self, units: set[str], any_end: bool = False) -> None:
        missing = units.difference(self.recent)
        if missing and len(self.recent) > UNITS_KEPT and not any_end:
            self.earlier, self.recent = self.recent, {}
            missing = units
        new = []
        for u in missing:
            if u in self.earlier:
                self.recent[u] = self.earlier[u]
            else:
                new.append(u)
        if new:
            self.solve(new)
        if any_end:  # here a word may begin or end with white space other than its one space
            loose = [u for u in units if self.recent[u] is None]
            self.inner.update(zip(loose, self.whole([" " + u for u in loose])))


_encoders: dict[int, Encoder] = {}


def encoder(description: str) -> Encoder:
    key = hash(description)
    if key not in _encoders:
        _encoders[key] = Encoder(description)
    return _encoders[key]


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [n + struct.pack("<I", h) + p + struct.pack("<I", t) for n, h, p, t in zip(lengths, heads, payloads, tails)]


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, file_bytes: int = 64 << 20) -> None:
    """Encode docs (doc_id, text) into path/records, in ascending doc_id order over the files, and write path/index."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    kinds = to_arrow_schema(INDEX)
    folder = path.rstrip("/") + "/records"

    def write(batches):
        context = TaskContext.get()
        part, name = context.partitionId(), f"part-{context.partitionId():06d}-{context.taskAttemptId()}.rec"
        code = encoder(shared.value)
        tail = b"" if end_id is None else np.array([end_id], code.kind).tobytes()
        wide = 2 if code.kind.itemsize == 4 else 0
        store, root = fs.FileSystem.from_uri(folder)
        out, offset = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids, encoded = piece.column(0).to_pylist(), code.encode(piece.column(1).to_pylist())
                payloads = [struct.pack(HEAD, (i is not None) | wide, i or 0) + e + tail for i, e in zip(ids, encoded)]
                records = framed(payloads)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(b"".join(records))
                sizes = [len(r) for r in records]
                offsets = (np.cumsum([offset, *sizes[:-1]])).tolist()
                offset += sum(sizes)
                n_ids = [(len(p) - HEAD_BYTES) // code.kind.itemsize for p in payloads]
                columns = [[part] * len(ids), [name] * len(ids), ids, offsets, sizes, n_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, kinds)], schema=kinds)
        if out is not None:
            out.close()

    ordered.mapInArrow(write, INDEX).write.mode("overwrite").parquet(path.rstrip("/") + "/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path.rstrip("/") + "/index")


def unframe(data: memoryview, name: str, offset: int) -> list[memoryview]:
    """The payloads of whole records that stand one after the other; both checksums of each are verified."""
    payloads, lengths, heads, tails, at = [], [], [], [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"{name}: a record after byte {offset} is cut short")
        lengths.append(bytes(data[at:at + 8]))
        heads.append(struct.unpack_from("<I", data, at + 8)[0])
        payloads.append(data[at + 12:at + 12 + n])
        tails.append(struct.unpack_from("<I", data, at + 12 + n)[0])
        at += 16 + n
    if heads != masked(crc32c(lengths)).tolist() or tails != masked(crc32c([bytes(p) for p in payloads])).tolist():
        raise ValueError(f"{name}: a record after byte {offset} has a wrong checksum")
    return payloads


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(HEAD, payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=HEAD_BYTES)


def digest_records(spark: SparkSession, path: str) -> DataFrame:
    """Read all files back in order: doc_id, start (ids before it), n_tokens and ids_crc32 (of the ids as 32-bit numbers) per record.

    Files are read in windows of whole records, as the index lists them. The running number of ids before a file comes from
    the totals of the files, a small table.
    """
    ship_package(spark)
    files = read_index(spark, path).groupBy("part", "file").agg(F.sum("n_ids").alias("n_ids"), F.max(F.col("offset") + F.col("n_bytes")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", "size", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    kinds, folder = to_arrow_schema(READ), path.rstrip("/") + "/records"

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, rest, at = row["base"], b"", 0
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    while at < row["size"]:
                        rest += f.read(8 << 20)
                        whole = complete(rest)
                        if not whole and f.tell() >= row["size"]:
                            raise ValueError(f"{row['file']}: the file ends inside a record")
                        out = [[], [], [], []]
                        for payload in unframe(memoryview(rest)[:whole], row["file"], at):
                            doc_id, ids = ids_of(payload)
                            for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                                column.append(value)
                            start += len(ids)
                        at, rest = at + whole, rest[whole:]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(out, kinds)], schema=kinds)

    return placed.repartition(max(1, placed.count())).mapInArrow(read, READ)


def complete(data: bytes) -> int:
    """Bytes of the whole records at the start of data."""
    at = 0
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            break
        at += 16 + n
    return at


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted doc_ids, each read at its offset: a shuffled read that touches only these records."""
    ship_package(spark)
    places = read_index(spark, path).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").repartition("file").sortWithinPartitions("file", "offset")
    folder = path.rstrip("/") + "/records"

    def read(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = [[], []]
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    (payload,) = unframe(memoryview(f.read_at(row["n_bytes"], row["offset"])), row["file"], row["offset"])
                doc_id, ids = ids_of(payload)
                found[0].append(doc_id)
                found[1].append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return places.mapInArrow(read, "doc_id long, ids array<long>")
