"""Benchmark decontamination.

The windows of n words of all benchmark items (a shorter item is one window) form a hash set that is broadcast in blocks
of bounded bytes, each a further pass over the rows as they stream by. The bound holds for a block only: all blocks come
through the driver and are held at once, so the whole benchmark must fit the memory of the driver and of each worker.
Documents are scanned whole: words become numbers of the block's vocabulary, window hashes are
computed for all places at once and looked up, and every hit is verified on its full word sequence.

Defined results: a null or wordless text has no hits and an item without words no windows; an item with a null id
marks words but is written as an empty name; repeated items count once per id; an empty benchmark leaves all
documents clean. Added columns replace columns of the same name.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from hectara.llm.common import map_chunks, packed, unpacked, with_fields

#: Every byte that is not of a word becomes a space, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD_PLACES = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK_BYTES = 16 << 20
FOUND = StructType([
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()),
    StructField("contaminated", BooleanType()), StructField("items", ArrayType(StringType())), StructField("hit_places", ArrayType(LongType())),
])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WindowBlock:
    """Windows of some items: a vocabulary, and for each window length the windows with the items that have them."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            codes = np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in words), np.int32, len(words))
            size = min(n, len(codes))
            found = self.windows.setdefault(size, {})
            for at in range(len(codes) - size + 1):
                owners = found.setdefault(codes[at:at + size].tobytes(), [])
                if not owners or owners[-1] != len(self.names):
                    owners.append(len(self.names))
            self.names.append("" if name is None else str(name))
        self.hashes = {
            size: np.unique(rolling(np.frombuffer(b"".join(found), np.int32).reshape(-1, size).T)) for size, found in self.windows.items()
        }

    def hits(self, codes: np.ndarray):
        """(place, length, items) of every window in a sequence of word codes; 0 is a word of no window."""
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        for size, found in self.windows.items():
            if len(codes) < size:
                continue
            places = np.nonzero(known[size:] - known[:-size] == size)[0]
            if not len(places):
                continue
            hashed = rolling([codes[places + k] for k in range(size)])
            table = self.hashes[size]
            near = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
            for at in places[table[near] == hashed]:
                items = found.get(codes[at:at + size].tobytes())
                if items:
                    yield int(at), size, items


def rolling(columns) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = total * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64)
    return total


def blocks(benchmark: DataFrame, n: int, block_bytes: int = BLOCK_BYTES):
    """The items of the benchmark as blocks of about block_bytes of text; each block is fetched by its own bounded query."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-total // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)))
    for k in range(many):
        yield WindowBlock([(r[0], r[1]) for r in dealt.filter(F.col("block") == k).select("item_id", "text").toLocalIterator()], n)


def find_items(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs with those of FOUND: items (names in text order) and hit_places (numbers of hit words) among them."""
    context = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c.lower() not in FOUND.names]
    rows = docs.select(*[f"`{c}`" for c in kept])
    shared = [context.broadcast(b) for b in blocks(benchmark, n, block_bytes)]
    for number, block in enumerate(shared):
        last = number == len(shared) - 1
        schema = with_fields(rows.schema, FOUND)
        if last and not keep_text:
            schema = StructType([f for f in schema if f.name != "text"])
        rows = map_chunks(rows, lambda chunk, block=block: scan(chunk, block.value), schema)
    return rows


def scan(chunk: dict[str, list], block: WindowBlock) -> dict[str, list]:
    """One chunk of documents against one block; adds to what earlier blocks have found."""
    number = block.ids.get
    docs = [words_of(t) for t in chunk["text"]]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a word of no window parts the documents
    codes = np.zeros(starts[-1], np.int32)
    for words, at in zip(docs, starts):
        codes[at:at + len(words)] = [number(w, 0) for w in words]
    places = [set(p) for p in chunk.get("hit_places", [()] * len(docs))]
    items = [set(i) for i in chunk.get("items", [()] * len(docs))]
    for at, size, owners in block.hits(codes):
        doc = int(np.searchsorted(starts, at, "right")) - 1
        places[doc].update(range(at - int(starts[doc]), at - int(starts[doc]) + size))
        items[doc].update(block.names[o] for o in owners)
    names = [sorted(i) for i in items]
    return {
        "n_words": sizes.tolist(), "n_hit": [len(p) for p in places], "n_items": [len(i) for i in items],
        "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in names],
        "contaminated": [bool(p) for p in places], "items": names, "hit_places": [sorted(p) for p in places],
    }


def without_words(text: str | None, places: list[int]) -> str | None:
    """The text without the words at the given places; what stands between two removed words goes too."""
    if not places:
        return text
    gone, out, at, last = set(places), [], 0, None
    for k, m in enumerate(WORD_PLACES.finditer(text)):
        if k in gone:
            if last != k - 1:
                out.append(text[at:m.start()])
            at, last = m.end(), k
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """The columns of docs, without contaminated documents, or with remove="spans" without the hit words of their texts.

    n_chars, where docs have it, follows a changed text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    row = packed(docs, "text")
    if remove == "documents":
        clean = find_items(row, benchmark, n, keep_text=False).filter("not contaminated")
        return clean.select(*unpacked(docs))
    found = find_items(row, benchmark, n)
    found = found.select("_row", "text", "hit_places")
    cleaned = map_chunks(found, lambda c: {"text": [without_words(t, p) for t, p in zip(c["text"], c["hit_places"])]}, found.schema)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("hit_places") > 0, F.char_length("text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*unpacked(docs, **changed))
