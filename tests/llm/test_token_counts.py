import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hectara.llm import token_counts
from hectara.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a  b \n c", "we're we'r can't 'S", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ ﬁ é é",
    "\x1c!\x1c! a b", "日本語 テスト 😀👍🏽", "a" * 3000, "12345 3.14 ½ ²", "́ a",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def noise(n, size):
    rng = random.Random(n)
    return ["".join(rng.choices("abcdeéß '.,!01\n\tİſ日😀<|>*&́", k=rng.randint(1, size))) for _ in range(n)]


def test_counts_as_the_library(spark, make_docs, library):
    texts = ODD + noise(300, 80) + ["word " * 30_000]
    docs = make_docs(list(enumerate(texts)) + [(0, None), (None, "x y")]).selectExpr("*", "1 as n_tokens")
    got = token_counts.with_token_counts(docs, PATH, limit=50)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "x y" if r.doc_id is None else texts[r.doc_id] or ""
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(text.encode()), want > 50)


def test_every_prefix(spark, make_docs, library):
    texts = [t for t in ODD if t is None or len(t) < 100] + noise(40, 30)
    rows = token_counts.with_prefix_counts(make_docs(list(enumerate(texts))), PATH).select(
        "text", "prefix_tokens", token_counts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(4)).alias("four"), token_counts.prefix_within(F.col("prefix_tokens"), 3).alias("fits")
    ).collect()
    for r in rows:
        text = r.text or ""
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert r.prefix_tokens == want
        assert r.four == want[min(4, len(text))] and r.fits == max(i for i, n in enumerate(want) if n <= 3)


def test_caches_turn_over(monkeypatch, library):
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 5)
    monkeypatch.setattr(token_counts, "PAIRS_KEPT", 5)
    with open(PATH, encoding="utf-8") as f:
        counter = token_counts.Counter(f.read())
    for text in noise(30, 60):
        assert counter.counts([text, None, text]) == [n := len(library.encode(text, add_special_tokens=False).ids), 0, n]


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)


def test_empty(make_docs):
    assert token_counts.with_token_counts(make_docs([]), PATH).count() == 0
