"""Exact token counts at every prefix by dynamic programming.

A byte-pair encoding ends, at every place of a word, with exactly one token: the one that follows the last token of the
shorter prefix without merging into it. So one pass over a word finds the last token and the count of each of its prefixes
from those of shorter ones; whether two tokens may stand side by side is learned once per pair of tokens. With these
tables the count of any prefix, also one that ends inside a word, is read off instead of encoded anew.

Texts are normalised and cut into words by the tokenizer's own rules. Words between spaces are independent, so each
distinct one is solved once and kept in a bounded table of the worker.

Defined results: a null or empty text has no tokens and the prefix counts [0]; special strings inside a text count as the
tokenizer's default does, one token each; rows are never merged, so repeated rows give repeated results.
"""
from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from hectara.llm.common import map_chunks, with_fields

PAIRS_KEPT, WORDS_KEPT = 1_000_000, 700_000


class PrefixTable:
    """Byte-pair merges of a vocabulary, with an end-of-word mark on the last symbol of a word where it has one."""

    def __init__(self, model: dict):
        self.mark = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = set(model["vocab"])
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocab)
        self.pairs: dict[tuple[str, str], bool] = {}

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols, lowest rank first, leftmost first."""
        while len(symbols) > 1:
            ranked = [(self.rank.get(p), i) for i, p in enumerate(zip(symbols, symbols[1:]))]
            rank = min((r for r, _ in ranked if r is not None), default=None)
            if rank is None:
                break
            merged, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and ranked[i][0] == rank:
                    merged.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    merged.append(symbols[i])
                    i += 1
            symbols = merged
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.mark and token.endswith(self.mark):
            body = token[:-len(self.mark)]
            return [*body[:-1], body[-1] + self.mark]
        return list(token)

    def beside(self, left: str, right: str) -> bool:
        """Whether the encoding of both tokens' text is just these two; left is empty at the start of a word."""
        known = self.pairs.get((left, right))
        if known is None:
            want = [left, right] if left else [right]
            known = (left, right) not in self.rank and self.encode(self.symbols(left) + self.symbols(right)) == want
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def inner(self, word: str) -> tuple[list[str], list[int]]:
        """The last token and the number of tokens of every prefix that goes on, from 0 to all symbols."""
        vocab, known_pair, longest = self.vocab, self.pairs.get, self.longest
        last, count = [""], [0]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                token = word[start:end]
                if token in vocab:
                    fits = known_pair((last[start], token))
                    if fits or fits is None and self.beside(last[start], token):
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")
            last.append(token)
            count.append(count[start] + 1)
        return last, count

    def ended(self, word: str, last: list[str], count: list[int], end: int) -> int:
        """Tokens of word[:end] as a whole word, from the tables of inner()."""
        if not self.mark or end == 0:
            return count[end]
        for start in range(max(0, end - self.longest), end):
            token = word[start:end] + self.mark
            if token in self.vocab and self.beside(last[start], token):
                return count[start] + 1
        raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")


class Counter:
    """Token counts by the rules of a tokenizer file, given as its JSON text."""

    def __init__(self, description: str):
        from tokenizers import Tokenizer

        parsed = json.loads(description)
        self.rules = Tokenizer.from_str(description)
        self.table = PrefixTable(parsed["model"])
        self.special = [t["content"] for t in parsed.get("added_tokens", ())]
        self.apart = re.compile("|".join([r"\s", *map(re.escape, self.special)]))  # not to be cut together with other words
        self.recent: dict[str, int] = {}
        self.earlier: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def cut(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """The words of a text in the symbols of the vocabulary, with their places in the normalised text."""
        return self.rules.pre_tokenizer.pre_tokenize_str(text)

    def normal(self, text: str) -> str:
        return self.rules.normalizer.normalize_str(text) if self.rules.normalizer else text

    def parts(self, text: str) -> list[str | None]:
        """The text between special strings, None for each of those."""
        parts: list[str | None] = [text]
        for mark in self.special:
            parts = [x for p in parts for x in ([p] if p is None or mark not in p else [y for s in p.split(mark) for y in (None, s)][1:])]
        return parts

    def of_piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = self.table.ended(piece, *self.table.inner(piece), len(piece))
            if len(self.pieces) >= WORDS_KEPT:
                self.pieces.clear()
            self.pieces[piece] = n
        return n

    def of_text(self, text: str) -> int:
        return sum(1 if p is None else sum(self.of_piece(x) for x, _ in self.cut(self.normal(p))) for p in self.parts(text))

    def solve(self, units: list[str]) -> None:
        """Counts of new words between spaces; plain ones are cut together."""
        inside = self.apart.search
        plain = [u for u in units if u and not inside(u)]
        for u in set(units).difference(plain):
            self.recent[u] = self.of_text(u)
        text = self.normal(" ".join(plain))
        widths = np.fromiter(map(len, text.split(" ")), np.int64)
        if len(widths) != len(plain):
            for u in plain:
                self.recent[u] = self.of_text(u)
            return
        ends = np.cumsum(widths + 1)
        found = self.cut(text)
        owners = np.searchsorted(ends, np.fromiter((p[1][0] for p in found), np.int64, len(found)), "right").tolist()
        counts = [0] * len(plain)
        for (piece, _), owner in zip(found, owners):
            counts[owner] += self.of_piece(piece)
        self.recent.update(zip(plain, counts))

    def known(self, units: list[str]) -> list[int]:
        """Counts of words between spaces, in two generations of remembered words."""
        missing = set(units).difference(self.recent)
        if missing:
            if len(self.recent) > WORDS_KEPT:
                self.earlier, self.recent = self.recent, {}
                missing = set(units)
            new = []
            for u in missing:
                n = self.earlier.get(u)
                if n is None:
                    new.append(u)
                else:
                    self.recent[u] = n
            if new:
                self.solve(new)
        return list(map(self.recent.__getitem__, units))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        split = [t.split(" ") if t else [] for t in texts]
        each = self.known([u for s in split for u in s])
        ends = np.concatenate(([0], np.cumsum([len(s) for s in split])))
        sums = np.concatenate(([0], np.cumsum(np.array(each, np.int64))))
        return (sums[ends[1:]] - sums[ends[:-1]]).tolist()

    def unit_prefixes(self, unit: str) -> list[int]:
        """Tokens of unit[:i] for i from 1 on."""
        text = self.normal(unit)
        if len(text) != len(unit) or "'" in unit or any(m[:1] in unit for m in self.special) or text != unit.lower() or any(len(c.lower()) > 1 for c in unit):
            return [self.of_text(unit[:i]) for i in range(1, len(unit) + 1)]  # a cut would change how the rest is read
        out, before, at = [], 0, 0
        for piece, (start, end) in self.cut(text):
            out += [before] * (start - at)
            last, count = self.table.inner(piece)
            place = 0
            for c in text[start:end]:
                place += len(c.encode("utf-8", "surrogatepass"))
                out.append(before + self.table.ended(piece, last, count, place))
            before, at = out[-1], end
        return out + [before] * (len(unit) - at)

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of text[:i] for every i from 0 to the length."""
        out, before = [0], 0
        for k, unit in enumerate((text or "").split(" ")):
            if k:
                out.append(before)
            if unit:
                out += [before + n for n in self.unit_prefixes(unit)]
                before = out[-1]
        return out


_loaded: dict[int, Counter] = {}


def counter(description: str) -> Counter:
    """The worker's counter for a tokenizer; its tables serve all tasks of the worker."""
    key = hash(description)
    if key not in _loaded:
        _loaded[key] = Counter(description)
    return _loaded[key]


def with_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all but text when not given) with n_bytes, n_tokens and over_limit of each whole text.

    The tokenizer file is read once by the driver and broadcast (its size does not depend on the data).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = StructType([StructField("n_tokens", LongType(), False)])
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*[f"`{c}`" for c in names], "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = StructType([f for f in with_fields(rows.schema, new) if f.name != "text"])
    counted = map_chunks(rows, lambda chunk: {"n_tokens": counter(shared.value).counts(chunk["text"])}, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def with_prefix_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of docs and prefix_tokens: tokens of the first i code points of the text, for i from 0 to its length."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = StructType([StructField("prefix_tokens", ArrayType(IntegerType()))])
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c != "prefix_tokens"])
    return map_chunks(kept, lambda chunk: {"prefix_tokens": [counter(shared.value).prefixes(t) for t in chunk["text"]]}, with_fields(docs.schema, new), 64)


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column) -> Column:
    """Tokens of the first n_chars code points, without encoding."""
    return F.element_at(prefix_tokens, F.least(n_chars, F.size(prefix_tokens) - 1).cast("int") + 1)


def prefix_within(prefix_tokens: Column, budget: int) -> Column:
    """The most code points whose tokens stay within the budget, without encoding."""
    return F.array_max(F.filter(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull()))
