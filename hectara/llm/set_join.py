"""Jaccard join of shingle sets by prefixes under several global orders of the shingles.

Two sets of n and m shingles with a Jaccard similarity of at least t share a shingle among the first n - ceil(t n) + 1 and
m - ceil(t m) + 1 of them, whatever global order the shingles are put in. Three orders are used: by estimated frequency, rarest first
and ties by hash, by rising hash and by falling hash. The rare-first order makes candidates: passages that many documents share come last in it and
are hardly ever a key. A candidate is compared only if its sizes fit and its maps of parities do not differ in more places than the sets may; then
its prefixes must meet under the other two orders as well, and both full sets decide.

Frequencies are sums over all documents in TABLES tables of SLOTS counters each, with independent hashes; a shingle's estimate is the smaller one.
What rare shingles alone put into a counter grows with the corpus, so it is taken off before the sums become steps from 0 to MOST. A coarse estimate
costs candidates, never a link, so the tables are bounded by parameters and are all that is broadcast of the corpus.

Documents of one set are one class. In a bucket of one key all classes are first compared with one leader, that with the most
neighbours; what is linked is one component, and only pairs across components are compared further, those in the largest component of a
bucket never with each other. Where a bucket leaves many such pairs, sets meet in blocks of bounded size, between size classes that can
reach the threshold only: first by their maps, then by full sets those that may link with another of the block, and only links leave a block. No cap
is set on candidates.

Defined results: a null or wordless text has an empty set and is linked with nothing; a text of fewer than k words is one shingle; a row without
doc_id is linked with nothing and its component is null; rows that repeat a doc_id belong to the component of their own text each; ties go
to the smallest doc_id; an empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from hectara.llm.common import map_chunks, ship_package
from hectara.llm.components import components
from hectara.llm.near_duplicates import class_of, common_counts, cross_pairs, joined, merged_buckets, scramble, shingle_set, with_component, with_leaders
from hectara.session import cut_lineage, shared_dir, sized_broadcast

TABLES, SLOTS = 2, 1 << 22
MOST = 255  # steps end here: shingles above it come last in the order, by hash
PART_MOST = (1 << 16) - 1  # the counters of one partition end here
PIECE = 1 << 16  # counters in a row of partial sums
HEAVY = MOST  # steps from which the rows of a key are split over tasks
WIDE = 1 << 14  # classes of a bucket up to which a task looks at their sizes in order
PAIRED_BELOW = 1 << 9  # possible pairs in a bucket from which its sets meet in blocks
BLOCK = 512
SALTS = 64
ROWS = 256
SEEN = 1 << 20


def slots(hashes: np.ndarray, table: int, size: int = SLOTS) -> np.ndarray:
    return (scramble(hashes + np.uint64(table + 1)) >> np.uint64(40)).astype(np.int64) % size


def packed_counts(piece: np.ndarray) -> bytes:
    """Counters of 16 bits, all low bytes before all high ones."""
    return zlib.compress(piece.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpacked_counts(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1).astype(np.int64)
    return low + 256 * high


def scale(mean: float) -> tuple[int, int]:
    """What is taken off a sum, and the size of a step, in tables whose counters hold `mean` shingles each.

    Rare shingles alone fill a counter to the mean, give or take four times its root. All of that is at most the lower half of the steps, however
    large the corpus; in a table with few shingles a step is one and nothing is taken off.
    """
    spread = math.sqrt(mean)
    return max(0, math.floor(mean - 4 * spread)), max(1, math.ceil(8 * spread / (MOST // 2 + 1)))


def prefix_size(n: int, percent: int) -> int:
    """Shingles among which a set of n must share one with any set it reaches the threshold with."""
    return n - (percent * n + 99) // 100 + 1


def profiles(docs: DataFrame, k: int, size: int = SLOTS) -> DataFrame:
    """One pass over the texts: doc_id, n_shingles and cls of each row, and as rows with a place the counters of each partition."""
    schema = StructType([
        StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("cls", LongType()),
        StructField("place", IntegerType()), StructField("counts", BinaryType()),
    ])
    kinds = to_arrow_schema(schema)

    def run(batches):
        counts = [np.zeros(size, np.uint16) for _ in range(TABLES)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingle_set(t, k) for t in part.column("text").to_pylist()]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                for t in range(TABLES):
                    place, many = np.unique(slots(flat, t, size), return_counts=True)
                    counts[t][place] = np.minimum(counts[t][place] + many, PART_MOST)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()),
                ], schema=kinds)
        for t in range(TABLES):
            for at in range(0, size, PIECE):
                piece = counts[t][at:at + PIECE]
                if piece.any():
                    yield pa.RecordBatch.from_pylist([{"place": t * size + at, "counts": packed_counts(piece)}], schema=kinds)

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def frequencies(found: DataFrame, size: int = SLOTS) -> np.ndarray:
    """The counters of all partitions added up, in steps (`scale`), TABLES rows of `size`: places are dealt out, a task holds one sum a place."""
    schema = StructType([StructField("place", IntegerType()), StructField("counts", BinaryType())])
    kinds = to_arrow_schema(schema)
    base, step = scale((found.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) / size)

    def run(batches):
        sums = {}
        for batch in batches:
            for place, packed in zip(batch.column("place").to_pylist(), batch.column("counts").to_pylist()):
                sums[place] = sums.get(place, 0) + unpacked_counts(packed)
        for place, total in sums.items():
            steps = np.clip((total - base) // step, 0, MOST).astype(np.uint8)
            yield pa.RecordBatch.from_pylist([{"place": place, "counts": zlib.compress(steps.tobytes(), 1)}], schema=kinds)

    pieces = found.filter("place is not null").select("place", "counts").repartition("place").mapInArrow(run, schema)
    total = np.zeros(TABLES * size, np.uint8)
    for row in pieces.collect():  # at most TABLES * size / PIECE rows
        piece = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
        total[row["place"]:row["place"] + len(piece)] = piece
    return total.reshape(TABLES, size)


def rare_prefix(hashes: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set (sorted hashes) in the rare-first order, and the steps of the estimated frequencies."""
    often = np.min([table[t][slots(hashes, t, table.shape[1])] for t in range(len(table))], axis=0)
    first = np.argsort(often, kind="stable")[:prefix_size(len(hashes), percent)]
    return hashes[first], often[first]


def prefix_entries(docs: DataFrame, table: np.ndarray, k: int, percent: int) -> DataFrame:
    """key (a shingle of the rare-first prefix), cls and heavy of the documents; copies of a set that a task meets count once."""
    schema = StructType([StructField("cls", LongType()), StructField("keys", ArrayType(LongType())), StructField("heavy", ArrayType(BooleanType()))])
    kinds = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                classes, keys, heavy = [], [], []
                for text in batch.column("text").slice(at, ROWS).to_pylist():
                    found = shingle_set(text, k)
                    cls = class_of(found)
                    if cls is None or cls in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                    first, often = rare_prefix(found, shared.value, percent)
                    classes.append(cls)
                    keys.append(first.view(np.int64))
                    heavy.append(often >= HEAVY)
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(heavy, pa.list_(pa.bool_()))], schema=kinds)

    ship_package(docs.sparkSession)
    listed = docs.filter("doc_id is not null").select("text").mapInArrow(run, schema)
    return listed.select("cls", F.explode(F.arrays_zip("keys", "heavy")).alias("e")).select(F.col("e.keys").alias("key"), "cls", F.col("e.heavy").alias("heavy"))


def shared_entries(entries: DataFrame) -> DataFrame:
    """key, cls and many, the number of classes, of each bucket of classes that share a key; keys of the same classes are one bucket.

    The rows of a heavy key are dealt out by salt and meet as totals only.
    """
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(0)
    once = entries.select("key", "cls", "heavy", salt.alias("salt")).repartition("key", "salt").dropDuplicates(["key", "salt", "cls"])
    held = Window.partitionBy("key", "salt")  # below HEAVY rows, or a share of a heavy key
    counted = once.withColumns({"many": F.count("*").over(held), "mark": F.bit_xor(F.xxhash64("cls")).over(held)}).filter("many > 1 or heavy")
    slices = cut_lineage(counted.select("key", "cls", "heavy", "many", "mark", "salt").withColumn("key", F.when(F.col("heavy"), F.col("key")).otherwise(F.xxhash64("mark", "many"))).distinct())
    totals = slices.filter("heavy").select("key", "salt", "many", "mark").distinct().groupBy("key").agg(F.sum("many").alias("many"), F.bit_xor("mark").alias("mark"))
    named = totals.filter("many > 1").withColumn("bucket", F.xxhash64("mark", "many"))
    heavy = slices.filter("heavy").select("key", "cls").join(named, "key").select(F.col("bucket").alias("key"), "cls", "many").distinct()
    return slices.filter("not heavy").select("key", "cls", "many").unionByName(heavy).distinct()


def with_fitting(members: DataFrame, percent: int) -> DataFrame:
    """members (key, cls, n, many) without the rows that have no other of a fitting size in their bucket; buckets above WIDE stay as they are."""
    by_size = Window.partitionBy("key").orderBy("n", "cls")
    small = members.filter(F.col("many") <= WIDE).withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
    fits = (100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above"))
    return small.filter(fits).select(members.columns).unionByName(members.filter(F.col("many") > WIDE))


def brief(hashes: np.ndarray, percent: int) -> bytes:
    """A set in a small share of its bytes: its size and a map of parities, twelve bits or more for each shingle by which it may differ from a linked set of its size."""
    n = len(hashes)
    bits = 64
    while bits * (100 + percent) < 24 * n * (100 - percent):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.uint32(n).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_differ(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which linked sets of n and m differ at most; below 0 for sizes that cannot link."""
    most = n + m + 2 * (-percent * (n + m) // (100 + percent))
    return np.where(100 * np.minimum(n, m) < percent * np.maximum(n, m), -1, most)


def folded(parities: np.ndarray, length: int) -> np.ndarray:
    """A map in fewer words: a place in the shorter map is the longer map's place modulo its length."""
    return np.bitwise_xor.reduce(parities.reshape(-1, length), axis=0)


def may_link(x: bytes, y: bytes, percent: int) -> bool:
    """False only for sets that cannot link: by sizes, or by more differing parities than a link has differing shingles."""
    return bool(may_link_all([x], [y], percent)[0, 0])


def may_link_all(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """may_link of each left with each right set."""
    n, m = (np.array([int(np.frombuffer(v, np.uint32, 1)[0]) for v in side], np.int64) for side in (left, right))
    most = may_differ(n[:, None], m[None, :], percent)
    maps = [[np.frombuffer(v[4:], np.uint64) for v in side] for side in (left, right)]
    length = min(len(v) for side in maps for v in side)
    x, y = (np.stack([folded(v, length) for v in side]) for side in maps)
    return np.stack([np.bitwise_count(y ^ row).sum(axis=1, dtype=np.int64) for row in x]) <= most


def ends_meet(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the prefixes of two sorted sets share a shingle in the rising and in the falling order of hashes, as those of linked sets do."""
    p, q = prefix_size(len(x), percent), prefix_size(len(y), percent)
    return bool(np.isin(x[:p], y[:q]).any() and np.isin(x[-p:], y[-q:]).any())


def whole_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """cls, members (the sorted shingle hashes) and brief of the wanted classes, from the whole text of one document of each, as a written table.

    A document whose row is repeated may give its set once a task.
    """
    chosen = sized_broadcast(classes.join(wanted, "cls", "left_semi").select(F.col("first_doc").alias("doc_id"), F.col("cls").alias("wanted")))
    schema = StructType([StructField("cls", LongType()), StructField("members", BinaryType()), StructField("brief", BinaryType())])
    kinds = to_arrow_schema(schema)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for cls, text in zip(part.column("wanted").to_pylist(), part.column("text").to_pylist()):
                    if cls in seen:
                        continue
                    found = shingle_set(text, k)
                    if class_of(found) == cls:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(cls)
                        rows.append({"cls": cls, "members": found.tobytes(), "brief": brief(found, percent)})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("wanted", "text")
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/sets-{uuid.uuid4().hex}"
    texts.mapInArrow(run, schema).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def both_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, b and the column of both as x and y; the sets of b are sent once to each a, those of a once."""
    right = sets.select(F.col("cls").alias("b"), F.col(column).alias("y")).join(sized_broadcast(pairs), "b")
    left = sets.select(F.col("cls").alias("a"), F.col(column).alias("x")).join(sized_broadcast(pairs.select("a").distinct()), "a")
    return right.join(left, "a").select("a", "b", "x", "y")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: those whose brief forms may link, confirmed on the full sets."""
    out = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("held", BooleanType())])

    def possible(chunk):
        return {"held": [may_link(x, y, percent) for x, y in zip(chunk["x"], chunk["y"])]}

    def confirmed(chunk):
        held = []
        for x, y in zip(chunk["x"], chunk["y"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if not ends_meet(x, y, percent):
                held.append(False)
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            held.append(100 * common >= percent * (len(x) + len(y) - common))
        return {"held": held}

    likely = cut_lineage(map_chunks(both_sides(cut_lineage(pairs), sets, "brief"), possible, out).filter("held").select("a", "b"))
    return map_chunks(both_sides(likely, sets, "members"), confirmed, out, 128).filter("held").select("a", "b")


def sized_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links in large mixed buckets; sets meet in blocks of one size class each, only neighbouring classes meet, and only links leave a block.

    Maps of parities meet first, so that full sets enter only the blocks in which they may link.
    members: key, cls, comp, largest, many and outside. The classes of the largest component are on one side only.
    """
    rows = merged_buckets(members).select("key", "cls", "comp", "largest").join(members.select("cls", "n").distinct(), "cls")
    # Sets that reach the threshold differ in size by at most its inverse: they lie in the same or in neighbouring classes.
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    rows = cut_lineage(rows.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")).drop("n"))
    totals = rows.groupBy("key", "size").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("rights"), F.ceil(F.count_if(F.col("comp") != F.col("largest")) / BLOCK).cast("int").alias("lefts")
    )
    own = totals.select("key", "size", F.col("rights").alias("own_rights"), F.col("lefts").alias("own_lefts"))
    beside = totals.withColumnRenamed("size", "beside").withColumn("size", F.explode(F.array(*[F.col("beside") + d for d in (-1, 0, 1)])))
    placed = rows.join(sized_broadcast(beside.join(own, ["key", "size"])), ["key", "size"])
    block = ["key", "left_size", "left", "right_size", "right"]
    one = placed.filter("comp != largest").select(
        "key", F.col("size").alias("left_size"), F.pmod(F.xxhash64("cls"), "own_lefts").cast("int").alias("left"), F.col("beside").alias("right_size"),
        "rights", "cls", "comp",
    )
    right = placed.filter("lefts > 0").select(
        "key", F.col("beside").alias("left_size"), "lefts", F.col("size").alias("right_size"),
        F.pmod(F.xxhash64("cls"), "own_rights").cast("int").alias("right"), "cls", "comp",
    )
    one = one.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda i: F.struct("key", "left_size", "left", "right_size", i.alias("right"))))
    right = right.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct("key", "left_size", i.alias("left"), "right_size", "right")))
    short = StructType([StructField("cls", LongType()), StructField("brief", BinaryType())])
    maps = map_chunks(sets.select("cls", "members"), lambda chunk: {"brief": [brief(np.frombuffer(m, np.uint64), percent) for m in chunk["members"]]}, short, 128)

    def in_blocks(full: DataFrame, rows: DataFrame) -> DataFrame:
        # The sets come last and meet the rows counted, so that of few rows only the sets that enter a block travel.
        return full.join(sized_broadcast(rows.select("cls", "comp", "blocks")), "cls").withColumn("block", F.explode("blocks")).select("block.*", *full.columns, "comp")

    def met(x: DataFrame, y: DataFrame, fn, schema: str) -> DataFrame:
        y = y.toDF(*[f"{c}_y" for c in y.columns])
        return x.groupBy(block).cogroup(y.groupBy([f"{c}_y" for c in block])).applyInPandas(fn, schema)

    def partnered(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        columns = [*block, "cls", "comp"]
        if x.empty or y.empty:
            return pd.DataFrame({c: [] for c in [*columns, "side"]}, dtype=np.int64)
        held = may_link_all(x["brief"].tolist(), y["brief_y"].tolist(), percent) & (x["comp"].to_numpy()[:, None] != y["comp_y"].to_numpy()[None, :])
        y = y.rename(columns={f"{c}_y": c for c in columns})
        return pd.concat([x.loc[held.any(axis=1), columns].assign(side=0), y.loc[held.any(axis=0), columns].assign(side=1)])

    found = cut_lineage(met(in_blocks(maps, one), in_blocks(maps, right), partnered, "key long, left_size int, left int, right_size int, right int, cls long, comp long, side int"))
    entered = found.groupBy("side", "cls", "comp").agg(F.collect_set(F.struct(*block)).alias("blocks"))
    full = sets.select("cls", "members")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        common = common_counts(x["members"].tolist(), y["members_y"].tolist())
        united = x["members"].map(len).to_numpy()[:, None] // 8 + y["members_y"].map(len).to_numpy()[None, :] // 8 - common
        linked = (100 * common >= percent * united) & (x["comp"].to_numpy()[:, None] != y["comp_y"].to_numpy()[None, :])
        i, j = np.nonzero(linked)
        return pd.DataFrame({"a": x["cls"].to_numpy()[i], "b": y["cls_y"].to_numpy()[j]})

    return met(in_blocks(full, entered.filter("side = 0")), in_blocks(full, entered.filter("side = 1")), meet, "a long, b long")


def link_classes(entries: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of classes as (node, component), for nodes with a link, from the shared keys of their prefixes."""
    sized = with_fitting(cut_lineage(entries).join(classes.select("cls", "n"), "cls"), percent)
    members = cut_lineage(with_leaders(cut_lineage(sized)))
    sets = whole_sets(members.select("cls").distinct(), classes, docs, k, percent)

    def fitting(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}")), side)
        return pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")

    followers = members.filter("cls != lead.cls").select("cls", "lead")
    # One leader for each class first: this joins most of a group of near copies with one comparison a class.
    first = followers.groupBy("cls").agg(F.max("lead").alias("lead")).select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"))
    labels = components(cut_lineage(verified(fitting(first), sets, percent)))
    met = with_component(followers.select(F.col("lead.cls").alias("leader"), "cls").distinct(), labels)
    led = met.join(labels.select(F.col("node").alias("leader"), F.col("component").alias("led")), "leader", "left")
    second = led.filter(F.coalesce("led", "leader") != F.col("comp")).select(F.col("leader").alias("a"), F.col("cls").alias("b"))
    labels = joined(labels, verified(fitting(second), sets, percent))
    placed = cut_lineage(with_component(members.select("key", "cls", "n", "many"), labels))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg((F.sum("size") - F.max("size")).alias("outside"), F.max_by("comp", F.struct("size", "comp")).alias("largest"))
    mixed = cut_lineage(placed.join(mixed.filter("outside > 0"), "key"))
    met_once = F.col("outside") * F.col("many") <= PAIRED_BELOW
    links = verified(cross_pairs(mixed.filter(met_once), percent), sets, percent)
    large = mixed.filter(~met_once)
    if not large.isEmpty():
        links = links.unionByName(sized_blocks(large, sets, percent))
    return joined(labels, links)


def joined_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of docs (doc_id, text)."""
    found = cut_lineage(profiles(docs, k))
    rows = found.filter("place is null").select("doc_id", "n_shingles", "cls")
    classes = cut_lineage(
        rows.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"))
    )
    entries = shared_entries(prefix_entries(docs, frequencies(found), k, percent))
    labels = link_classes(entries, classes, docs.filter("doc_id is not null"), k, percent)
    placed = cut_lineage(with_component(classes.select("cls", "first_doc"), labels))
    smallest = placed.groupBy("comp").agg(F.min("first_doc").alias("component_id"))
    named = placed.join(smallest, "comp").select("cls", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(named, "cls", "left").select("doc_id", "n_shingles", own.alias("component_id"))
