"""Near-duplicates by SetSketch registers.

A document's set is its distinct shingles of k words (a shorter text is one shingle). Its sketch has M registers: for
each register the smallest of exponential values drawn by hash for the shingles, kept as the exponent of its power of B,
cut to a range. Registers of a union are the larger ones of both, so sketches merge; B is near 1, so that two registers
agree with about the Jaccard similarity. Bands of registers give candidates; the similarity of a candidate is estimated by
maximum likelihood from the registers that are larger, smaller and equal and from both set sizes; what may reach the threshold
is confirmed on the full sets.

Documents of one set are one class, so copies never meet in pairs. In a bucket all classes are first compared with one
leader, that with the most neighbours. What is linked then is one component; only pairs between different components are compared further, those in
the largest component of a bucket never with each other. Where a bucket leaves many such pairs, its full sets meet in
blocks of bounded size that give out only links. No cap is set on candidates. A pair at the threshold shares no band with
a chance of 1.3e-7.

Defined results: a null or wordless text has an empty set, is linked with nothing and stays; a row without doc_id is linked
with nothing and stays; rows that repeat a doc_id belong to the component of their own text each; ties go to the smallest doc_id.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from hectara.llm.common import map_chunks, packed, unpacked
from hectara.llm.components import components
from hectara.session import cut_lineage, sized_broadcast

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BANDS, BAND_ROWS = 40, 5
M = BANDS * BAND_ROWS
B, A, Q = 1.001, 20.0, (1 << 16) - 2
PAIRED_BELOW = 1 << 9  # possible pairs in a bucket from which its sets meet in blocks
BLOCK = 512
SALTS = 32
MARGIN = 0.17  # six standard errors of the estimate at the threshold: sqrt(0.8 * 0.2 / M) is 0.028

_draw = np.random.default_rng(20)
FACTORS = _draw.integers(0, 1 << 32, M, np.uint32) | np.uint32(1)
SHIFTS = _draw.integers(0, 1 << 32, M, np.uint32)
BAND_FACTORS = _draw.integers(0, 1 << 63, BAND_ROWS, np.int64).astype(np.uint64) | np.uint64(1)
SHINGLE_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    size = min(k, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        total += codes[j:len(codes) - size + 1 + j]
        total *= SHINGLE_FACTOR
        total ^= total >> np.uint64(29)
    total = scramble(total)
    total.sort()
    first = np.ones(len(total), bool)
    np.not_equal(total[1:], total[:-1], out=first[1:])
    return total if first.all() else total[first]


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at:at + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=low)
    drawn = -np.log1p(-(low + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1.0 - np.log(drawn) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = (sketch.reshape(BANDS, BAND_ROWS).astype(np.uint64) * BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return scramble(rows + np.arange(BANDS, dtype=np.uint64) * SHINGLE_FACTOR).view(np.int64)


SKETCH = StructType([
    StructField("doc_id", LongType()), StructField("text_key", LongType()), StructField("n_shingles", LongType()), StructField("cls", LongType()),
    StructField("sketch", BinaryType()),
])


def class_of(hashes: np.ndarray) -> int | None:
    """64 bits that name a set."""
    if not len(hashes):
        return None
    return int(scramble(np.array([scramble(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, cls (the set) and sketch of each document."""

    def run(chunk):
        sets = [shingle_set(t, k) for t in chunk["text"]]
        drawn = [registers(s) if len(s) else None for s in sets]
        return {
            "n_shingles": [len(s) for s in sets], "cls": [class_of(s) for s in sets],
            "sketch": [None if r is None else r.tobytes() for r in drawn],
        }

    return map_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")), run, SKETCH)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) of sets of known sizes.

    For a share v of b in both sizes, a register of a is the larger one with chance p(1 - v - v J), where p is the
    register's exponent law p(x) = -log_B(1 - x (B - 1) / B); the likelihood is concave in J and is searched by thirds.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = M - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def law(x):
        return -np.log1p(-np.clip(x, 1e-12, 1.0) * (B - 1) / B) / np.log(B)

    def likelihood(j):
        over, under = law(u - v * j), law(v - u * j)
        return more * np.log(over) + less * np.log(under) + equal * np.log(np.clip(1 - over - under, 1e-12, 1.0))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate leaves the threshold possible; copies of a sketch travel once per pair."""
    sides = pairs
    for side in ("a", "b"):
        sides = sides.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    out = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("estimate", DoubleType())])

    def run(chunk):
        if not chunk["a"]:
            return {"estimate": []}
        left, right = (np.frombuffer(b"".join(chunk[c]), np.uint16).reshape(-1, M) for c in ("s_a", "s_b"))
        return {"estimate": likely_similarity(left, right, np.array(chunk["n_a"], float), np.array(chunk["n_b"], float)).tolist()}

    return map_chunks(sides, run, out).filter(F.col("estimate") >= threshold - MARGIN).select("a", "b")


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """cls and members, the sorted shingle hashes, of the wanted classes, from the whole text of one document of each."""
    chosen = sized_broadcast(classes.join(wanted, "cls", "left_semi").select(F.col("first_doc").alias("doc_id"), F.col("cls").alias("wanted")))
    full = StructType([StructField("wanted", LongType()), StructField("cls", LongType()), StructField("members", BinaryType())])

    def sets(chunk):
        found = [shingle_set(t, k) for t in chunk["text"]]
        return {"cls": [class_of(s) for s in found], "members": [s.tobytes() for s in found]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("wanted", "text")
    return cut_lineage(map_chunks(texts, sets, full, 128).filter("cls = wanted").drop("wanted").dropDuplicates(["cls"]))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of classes whose full sets have 100 * intersection >= percent * union."""
    likely = cut_lineage(estimated(pairs, classes, percent / 100))
    members = full_sets(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, docs, k)
    sides = likely
    for side in ("a", "b"):
        sides = sides.join(members.select(F.col("cls").alias(side), F.col("members").alias(f"m_{side}")), side)
    out = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("common", LongType()), StructField("united", LongType())])

    def compare(chunk):
        common, united = [], []
        for x, y in zip(chunk["m_a"], chunk["m_b"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
            united.append(len(x) + len(y) - common[-1])
        return {"common": common, "united": united}

    return map_chunks(sides, compare, out, 128).filter(100 * F.col("common") >= percent * F.col("united")).select("a", "b")


def common_counts(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: a product of 0/1 matrices, some shingles at a time."""
    sides = [[np.frombuffer(m, np.uint64) for m in side] for side in (left, right)]
    shared = np.intersect1d(*[np.unique(np.concatenate(side)) for side in sides], assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    cells = []
    for side in sides:
        flat, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(m) for m in side])
        place = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        held = shared[place] == flat if len(shared) else np.zeros(len(flat), bool)
        cells.append((owner[held], place[held]))
    for at in range(0, len(shared), 4096):
        parts = []
        for (owner, place), side in zip(cells, sides):
            here = (place >= at) & (place < at + 4096)
            part = np.zeros((len(side), min(4096, len(shared) - at)), np.float32)
            part[owner[here], place[here] - at] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def merged_buckets(members: DataFrame) -> DataFrame:
    """The large buckets around one component as one bucket, where that makes fewer comparisons than each on its own.

    A group of near copies fills a bucket in many bands; merged, each of its sets is sent and compared once. Most rows may
    lie around one component, so its totals meet them by salt.
    """
    buckets = members.select("key", "largest", "many", "outside").distinct()
    apart = buckets.groupBy("largest").agg(F.sum(F.col("many") * F.col("outside")).alias("apart"))
    distinct = members.select("largest", "cls", "comp").distinct().groupBy("largest").agg(
        F.count("*").alias("all_many"), F.count_if(F.col("comp") != F.col("largest")).alias("all_outside")
    )
    fewer = F.col("all_many") * F.col("all_outside") <= F.col("apart")
    totals = apart.join(distinct, "largest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = members.withColumn("salt", F.pmod(F.xxhash64("key", "cls"), F.lit(SALTS)).cast("int")).join(totals, ["largest", "salt"])
    return rows.select(
        F.when(fewer, F.col("largest")).otherwise(F.col("key")).alias("key"), "cls", "comp", "largest",
        F.when(fewer, F.col("all_many")).otherwise(F.col("many")).alias("many"),
        F.when(fewer, F.col("all_outside")).otherwise(F.col("outside")).alias("outside"),
    ).distinct()


def block_links(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links in large mixed buckets: sets meet in blocks of bounded size, and only links leave a block.

    members: key, cls, comp, largest, many and outside. The classes of the largest component are on one side only.
    """
    sets = full_sets(members.select("cls").distinct(), classes, docs, k)
    rows = merged_buckets(members).join(sets, "cls").withColumns({
        "lefts": F.ceil(F.col("outside") / BLOCK).cast("int"), "rights": F.ceil(F.col("many") / BLOCK).cast("int"),
    })
    columns = ["key", "left", "right", "cls", "comp", "members"]
    one = rows.filter("comp != largest").withColumn("left", F.pmod(F.xxhash64("cls"), "lefts").cast("int"))
    one = one.withColumn("right", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).select(columns)
    other = rows.withColumn("right", F.pmod(F.xxhash64("cls"), "rights").cast("int"))
    other = other.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).select(columns).toDF(*[f"{c}_y" for c in columns])

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        common = common_counts(x["members"].tolist(), y["members_y"].tolist())
        united = x["members"].map(len).to_numpy()[:, None] // 8 + y["members_y"].map(len).to_numpy()[None, :] // 8 - common
        linked = (100 * common >= percent * united) & (x["comp"].to_numpy()[:, None] != y["comp_y"].to_numpy()[None, :])
        i, j = np.nonzero(linked)
        return pd.DataFrame({"a": x["cls"].to_numpy()[i], "b": y["cls_y"].to_numpy()[j]})

    block = ["key", "left", "right"]
    return one.groupBy(block).cogroup(other.groupBy([f"{c}_y" for c in block])).applyInPandas(meet, "a long, b long")


def band_entries(classes: DataFrame) -> DataFrame:
    """cls, n and key of every band of every class."""
    out = StructType([StructField("cls", LongType()), StructField("n", LongType()), StructField("keys", ArrayType(LongType()))])

    def run(chunk):
        return {"keys": [band_keys(np.frombuffer(s, np.uint16)).tolist() for s in chunk["sketch"]]}

    return map_chunks(classes.select("cls", "n", "sketch"), run, out).select("cls", "n", F.explode("keys").alias("key"))


def buckets_of(entries: DataFrame) -> DataFrame:
    """key, cls, n and the key's number of classes, for keys that hold more than one class."""
    shared = entries.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    return entries.join(shared, "key")


def with_leaders(members: DataFrame) -> DataFrame:
    """Adds weight, the sizes of all buckets of a class, and of each key its leader: the heaviest class and its weight.

    The text that a group of near copies was made from shares the most bands with the others, so it leads and most link to it.
    """
    weighed = members.join(members.groupBy("cls").agg(F.sum("many").alias("weight")), "cls")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("lead"))
    return weighed.join(leaders, "key")


def with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds comp: the component of cls so far, itself where it has no link yet."""
    return rows.join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in one bucket but in different components, whose sizes allow the threshold.

    members: key, cls, n, comp and largest. The classes of a bucket's largest component are not paired with each other.
    """
    left = members.filter("comp != largest").select("key", F.col("cls").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"))
    right = members.select("key", F.col("cls").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), "largest")
    fits = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (F.col("cx") != F.col("cy"))
    met = left.join(right, "key").filter(fits & ((F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_classes(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of classes as (node, component), for nodes with a link."""
    members = cut_lineage(with_leaders(cut_lineage(buckets_of(band_entries(classes)))))
    followers = members.filter("cls != lead.cls").select("cls", "lead")
    # One leader for each class first: this joins most of a group of near copies with one comparison a class.
    first = followers.groupBy("cls").agg(F.max("lead").alias("lead")).select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"))
    labels = components(cut_lineage(confirmed(first, classes, docs, k, percent)))
    met = with_component(followers.select(F.col("lead.cls").alias("leader"), "cls").distinct(), labels)
    led = met.join(labels.select(F.col("node").alias("leader"), F.col("component").alias("led")), "leader", "left")
    second = led.filter(F.coalesce("led", "leader") != F.col("comp")).select(F.col("leader").alias("a"), F.col("cls").alias("b"))
    labels = joined(labels, confirmed(second, classes, docs, k, percent))
    placed = cut_lineage(with_component(members.select("key", "cls", "n", "many"), labels))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg((F.sum("size") - F.max("size")).alias("outside"), F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    mixed = cut_lineage(placed.join(mixed.filter("outside > 0"), "key"))
    met_once = F.col("outside") * F.col("many") <= PAIRED_BELOW
    links = confirmed(cross_pairs(mixed.filter(met_once), percent), classes, docs, k, percent)
    large = mixed.filter(~met_once)
    if not large.isEmpty():
        links = links.unionByName(block_links(large, classes, docs, k, percent))
    return joined(labels, links)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links; the earlier components enter as stars."""
    stars = labels.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return components(cut_lineage(stars.unionByName(links)))


def duplicate_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept and text_key (a hash) of each row of docs (doc_id, text)."""
    rows = cut_lineage(sketches(docs, k))
    classes = cut_lineage(
        rows.filter("cls is not null and doc_id is not null").groupBy("cls")
        .agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    )
    labels = link_classes(classes, docs.filter("doc_id is not null"), k, percent)
    placed = cut_lineage(with_component(classes.select("cls", "first_doc"), labels))
    smallest = placed.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    named = placed.join(smallest, "comp").select("cls", "component_id")
    found = rows.drop("sketch", "bands").join(named, "cls", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long")
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_key")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The columns of docs without the documents of a group that have not its smallest doc_id.

    Rows that repeat both doc_id and text are one document and stay or go together.
    """
    found = duplicate_groups(docs, k, percent)
    gone = sized_broadcast(found.filter("not kept").select("doc_id", "text_key").distinct())
    keyed = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return keyed.join(gone, ["doc_id", "text_key"], "left_anti").select(*unpacked(docs))
