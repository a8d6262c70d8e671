"""Quality classifier on random-indexing word vectors.

Every word is two tokens, its letters and its shape (case and marks); tokens are hashed to a fixed number of places. Each place
has a fixed sparse random index vector, and the context vector of a token is the sum of the index vectors of its neighbours over
the whole corpus: sums of fixed size, made by every task and added up in Spark. A document is pooled from the vectors of
its tokens (weighted mean, spread, and likeness of neighbours). A network of two layers, in numpy, is fitted to
a bounded sample of labelled documents, and its probabilities are calibrated by a temperature on a part kept back.

Sample bound: SAMPLE labelled documents, those of the smallest hashes of doc_id; with fewer all are used. Everything
else covers all rows. Only the text enters a score.

Defined results: a null or empty text is pooled to zeros and scored like any other; a doc_id with several labels is good
only if all say 1; null labels are left out; without labels of both kinds the score is their share, or 0.5 without any.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from hectara.llm.common import map_chunks, ship_package, with_fields
from hectara.session import cut_lineage

PLACES, WIDTH, WINDOW = 1 << 15, 32, 2
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.003, 1e-4
COMMON = 1e-3  # tokens more frequent than this share count for less in a mean
WORDS_KEPT = 700_000
POOLED = 4 * WIDTH + 3
SHAPE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_draw = np.random.default_rng(9)
INDEX_DIMS = _draw.integers(0, WIDTH, (PLACES, 2))
INDEX_SIGNS = _draw.choice(np.array([-1, 1]), (PLACES, 2))
_codes: dict[bytes, int] = {}


def code_of(word: bytes) -> int:
    """Places of a word's letters and of its shape, in one number."""
    letters = b"".join(SHAPE.findall(word))
    case = b"X" if letters.isupper() and len(letters) > 1 else b"Xx" if letters[:1].isupper() else b"x" if letters else b""
    marks = SHAPE.sub(b"w", word)
    return zlib.crc32(letters.lower()) % PLACES | zlib.crc32(case + b" " + marks) % PLACES << 16


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts one after the other (letters, shape, letters, ...) and the end of each text."""
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    if len(_codes) > WORDS_KEPT:
        _codes.clear()
    for w in {w for each in words for w in each}.difference(_codes):
        _codes[w] = code_of(w)
    ends = np.cumsum([len(each) for each in words])
    codes = np.fromiter((_codes[w] for each in words for w in each), np.int64, int(ends[-1]) if len(ends) else 0)
    laid = np.empty(2 * len(codes), np.int64)
    laid[0::2], laid[1::2] = codes & 0xFFFF, codes >> 16
    return laid, 2 * ends


def add_contexts(totals: np.ndarray, laid: np.ndarray, ends: np.ndarray) -> None:
    """Adds the index vectors of each token's neighbours within WINDOW, inside one text, to the token's row."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    cells = []
    signs = []
    for gap in range(1, WINDOW + 1):
        near = owner[gap:] == owner[:-gap]
        a, b = laid[:-gap][near], laid[gap:][near]
        for x, y in ((a, b), (b, a)):
            for k in range(INDEX_DIMS.shape[1]):
                cells.append(x * WIDTH + INDEX_DIMS[y, k])
                signs.append(INDEX_SIGNS[y, k])
    totals += np.bincount(np.concatenate(cells), weights=np.concatenate(signs), minlength=totals.size).astype(np.int64).reshape(totals.shape)


def context_sums(docs: DataFrame) -> DataFrame:
    """place, n (tokens) and v0, v1, ...: the context vectors of the corpus, one row a place. Each task sends its sums once."""
    ship_package(docs.sparkSession)
    names = ["place", "n", *[f"v{i}" for i in range(WIDTH)]]

    def run(batches):
        totals, counts = np.zeros((PLACES, WIDTH), np.int64), np.zeros(PLACES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                laid, ends = tokens(batch.slice(at, 512).column(0).to_pylist())
                if len(laid):
                    add_contexts(totals, laid, ends)
                    counts += np.bincount(laid, minlength=PLACES)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *[pa.array(totals[used, i]) for i in range(WIDTH)]], names=names)

    sums = docs.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return sums.groupBy("place").agg(*[F.sum(n).alias(n) for n in names[1:]])


def word_vectors(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and weights of all places; at most PLACES rows come to the driver, whatever the corpus."""
    vectors, counts = np.zeros((PLACES, WIDTH)), np.zeros(PLACES)
    for row in sums.toLocalIterator():
        vectors[row["place"]] = row[2:]
        counts[row["place"]] = row["n"]
    share = counts / max(1.0, counts.sum())
    vectors -= share @ vectors * np.ones((PLACES, 1)) * (counts[:, None] / max(1.0, counts.sum()))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32), (COMMON / (COMMON + share)).astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of POOLED numbers per text."""
    laid, ends = tokens(texts)
    out = np.zeros((len(texts), POOLED), np.float32)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    full = np.nonzero(ends > starts)[0]
    if not len(full):
        return out
    column = 0
    for part in (0, 1):
        place = laid[part::2]
        at, size = starts[full] // 2, ((ends - starts)[full] // 2).astype(np.float32)[:, None]
        v, w = vectors[place], weights[place][:, None]
        total = np.maximum(np.add.reduceat(w, at), 1e-9)
        mean = np.add.reduceat(v * w, at) / total
        flat = np.add.reduceat(v, at) / size
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / size - flat**2, 0))
        out[full, column:column + WIDTH], out[full, column + WIDTH:column + 2 * WIDTH] = mean, spread
        column += 2 * WIDTH
        same = np.zeros(len(place), np.float32)
        same[1:] = place[1:] == place[:-1]
        same[at] = 0  # the first word of a text has none before it
        out[full, 4 * WIDTH + part] = np.add.reduceat(same, at) / size[:, 0]
    out[full, 4 * WIDTH + 2] = np.log1p(size[:, 0])
    return out


class Network:
    """Two layers, fitted by Adam on standardised inputs; a temperature divides the output."""

    def __init__(self, inputs: int, base: float = 0.5):
        draw = np.random.default_rng(7)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [draw.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature, self.base, self.fitted = 1.0, base, False

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        hidden = np.tanh(x @ a + b)
        return hidden @ c + d[0], hidden

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        kept_back = np.arange(len(x)) % 5 == 0
        fit_x, fit_y = x[~kept_back], y[~kept_back]
        draw = np.random.default_rng(8)
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(fit_x))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                z, hidden = self.logits(fit_x[rows])
                error = (sigmoid(z) - fit_y[rows]) / len(rows)
                back = np.outer(error, self.weights[2]) * (1 - hidden**2)
                slopes = [fit_x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(self.weights, slopes, first, second):
                    g = g + DECAY * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.fitted = True
        self.temperature = best_temperature(self.logits(x[kept_back])[0], y[kept_back])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.base)
        return sigmoid(self.logits((x - self.mean) / self.scale)[0] / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on outputs that were not fitted."""
    if not len(z):
        return 1.0

    def loss(t: float) -> float:
        p = np.clip(sigmoid(z / t), 1e-7, 1 - 1e-7)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    return float(min(np.geomspace(0.5, 8, 57), key=loss))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_of(labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled doc_ids outside the held-out part, by hash; doc_id and good (0 or 1)."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    each = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    return each.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)


def fit(pooled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network fitted on the driver to the bounded sample."""
    chosen = F.broadcast(sample_of(labels, sample))
    rows = pooled.select("doc_id", "pooled").join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "pooled", "good").toArrow().sort_by("doc_id")
    y = np.array(rows.column("good").to_pylist(), float)
    network = Network(POOLED, float(y.mean()) if len(y) else 0.5)
    if 0 < y.sum() < len(y):
        network.fit(np.array(rows.column("pooled").to_pylist(), float).reshape(-1, POOLED), y)
    return network


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (the chance of label 1) and predicted (1 from 0.7 on) of every document."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(word_vectors(context_sums(docs)))
    rows = docs.select("doc_id", "text")
    schema = StructType([f for f in with_fields(rows.schema, StructType([StructField("pooled", ArrayType(FloatType()))])) if f.name != "text"])
    pooled = cut_lineage(map_chunks(rows, lambda c: {"pooled": pool(c["text"], *model.value).tolist()}, schema))
    network = context.broadcast(fit(pooled, labels, sample))
    out = pooled.mapInArrow(scorer(network), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def scorer(network):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, POOLED)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(network.value.score(x))], names=["doc_id", "score"])

    return run
