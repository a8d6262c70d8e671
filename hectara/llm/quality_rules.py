"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. Labelled documents are the holdout. For every language the steps
(a rule at a cutoff) are tried one after the other in a sequence that bad documents alone decide, so it is fixed as far as
good ones go. A step passes while the exact binomial test rejects that more than `risk` of the good documents would fall
by any step so far (the Clopper-Pearson bound of the union lies below it); the first that does not ends the sequence. Only
the languages share the test level, so with probability 1 - level no language loses more than `risk` of its good documents.
Of the cutoffs of a rule that passed (but those that cost good documents and reject no further bad one) the one that parts
bad from good best is used. A language with fewer than `least_labels` good documents gets no cutoffs and keeps its documents.

Defined results: a null text has no words; null is a language of its own; a document with several label rows
counts as good only if all say 1; labels of unknown documents and null labels are left out; without labels
only the fixed base rules reject; an empty table gives an empty result. Columns of the input that clash are replaced.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hectara.llm.common import map_chunks, packed, unpacked, with_fields
from hectara.session import cut_lineage, sized_broadcast

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
SHARES = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]
LENGTHS = [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0]
#: Rule: (numerator, denominator, cutoffs from mild to strict); a document falls if the ratio is above the cutoff.
RULES = {
    "symbol_share": ("n_symbols", "word_chars", SHARES),
    "dup_line_share": ("n_dup_lines", "n_lines", SHARES),
    "repeat_share": ("n_repeat_words", "n_words", SHARES),
    "upper_share": ("n_upper", "word_chars", SHARES),
    "mark_share": ("n_marks", "word_chars", SHARES),
    "word_length": ("word_chars", "n_words", LENGTHS),
}

#: Number of cutoffs of each rule that ordinary texts of no language reach; stricter ones are tried after all of these.
MILD = {"symbol_share": 14, "dup_line_share": 10, "repeat_share": 10, "upper_share": 9, "mark_share": 13, "word_length": 8}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 1_500_000:  # three codes would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of a whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = repeats = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), lines,
        sum(map(str.isupper, text)) if not text.islower() else 0, text.count("!") + text.count("?"),
    )


def with_measures(docs: DataFrame) -> DataFrame:
    """The columns of docs (with text) and those of MEASURES."""
    new = StructType([StructField(m, LongType(), False) for m in MEASURES])
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in MEASURES]

    def run(chunk):
        rows = list(map(measure, chunk["text"]))
        return {m: [r[i] for r in rows] for i, m in enumerate(MEASURES)}

    return map_chunks(docs.select(*kept), run, with_fields(docs.schema, new))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X of n trials with chance p, summed exactly in logarithms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def least_labels(languages: int, risk: float = 0.02, level: float = 0.05) -> int:
    """Good documents that a language needs before a cutoff can pass, if none of them falls."""
    return math.ceil(math.log(level / languages) / math.log1p(-risk))


def passes(k: int, n_good: int, risk: float, level: float) -> bool:
    return k <= risk * n_good and at_most(k, n_good, risk) <= level


def best_cutoff(good: list[int], bad: list[int], n_good: int, n_bad: int, cutoffs: list[float]) -> float | None:
    """The cutoff that parts bad from good best, the mildest of equal ones; good, bad: documents above each cutoff."""
    best, chosen = 0.0, None
    for cutoff, k, b in zip(cutoffs, good, bad):
        gain = b / max(1, n_bad) - k / max(1, n_good)
        if gain > best:
            best, chosen = gain, cutoff
    return chosen


def certified(good: list[int], bad: list[int], n_good: int, n_bad: int, cutoffs: list[float], risk: float, level: float) -> float | None:
    """The best cutoff of those of a single rule that pass one after the other; good, bad: documents above each cutoff."""
    passed = next((i for i, k in enumerate(good) if not passes(k, n_good, risk, level)), len(cutoffs))
    return best_cutoff(good, bad, n_good, n_bad, cutoffs[:passed])


def sequence(places: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Steps (rule, place of its cutoff) in the order of the tests. places: the first cutoff of each rule (column) that rejects n bad documents.

    Mild cutoffs come before strict ones, rules with more bad documents above their mild cutoffs before others, and steps that reject
    further bad documents before those that reject only bad documents which have fallen already. Steps that reject none are not tried.
    """
    mild, ends = list(MILD.values()), [len(cutoffs) for *_, cutoffs in RULES.values()]
    by_catch = sorted(range(len(RULES)), key=lambda r: -int(n[places[:, r] < mild[r]].sum()))
    steps = [(r, int(i)) for strict in (False, True) for r in by_catch for i in np.unique(places[:, r]) if i < ends[r] and (i >= mild[r]) == strict]
    stands = np.ones(len(n), bool)
    lead: list[tuple[int, int]] = []
    for r, i in steps:
        falls = places[:, r] <= i
        if (stands & falls).any():
            lead.append((r, i))
            stands &= ~falls
    return lead + [s for s in steps if s not in lead]


def certified_union(good: np.ndarray, n_good: np.ndarray, bad: np.ndarray, n_bad: np.ndarray, risk: float, level: float) -> dict[str, float]:
    """Cutoffs by rule, so that the documents above any of them pass the test; places and numbers as in sequence().

    A step that passed is left out if it costs further good documents and rejects no further bad one.
    """
    tried, lost, rejected = np.zeros(len(n_good), bool), np.zeros(len(n_good), bool), np.zeros(len(n_bad), bool)
    passed: dict[int, int] = {}
    for r, i in sequence(bad, n_bad):
        tried |= good[:, r] <= i
        if not passes(int(n_good[tried].sum()), int(n_good.sum()), risk, level):
            break
        if (~rejected & (bad[:, r] <= i)).any() or not (~lost & (good[:, r] <= i)).any():
            passed[r] = max(i, passed.get(r, 0))
            lost |= good[:, r] <= i
            rejected |= bad[:, r] <= i
    out = {}
    for r, (rule, (*_, cutoffs)) in enumerate(RULES.items()):
        above = [[int(n[places[:, r] <= i].sum()) for i in range(passed.get(r, -1) + 1)] for places, n in ((good, n_good), (bad, n_bad))]
        out[rule] = best_cutoff(*above, int(n_good.sum()), int(n_bad.sum()), cutoffs)
    return {rule: cutoff for rule, cutoff in out.items() if cutoff is not None}


def learn_cutoffs(labelled: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """Rows (lang, rule, cutoff) of the certified rules. labelled: lang, good (boolean) and the measures of each labelled document."""
    # cutoffs fall, so being above any of them means being above all stricter ones
    places = F.array(*[F.lit(len(cutoffs)) - sum((ratio(rule) > c).cast("int") for c in cutoffs) for rule, (*_, cutoffs) in RULES.items()])
    counts = cut_lineage(labelled.select("lang", "good", places.alias("places")).groupBy("lang", "good", "places").agg(F.count("*").alias("n")))
    strata = max(1, counts.select("lang").distinct().count())

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for flag in (True, False):
            rows = group[group["good"] == flag]
            parts += [np.array(rows["places"].tolist(), np.int64).reshape(-1, len(RULES)), rows["n"].to_numpy(np.int64)]
        found = certified_union(*parts, risk, level / strata)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "rule": list(RULES), "cutoff": [found.get(rule) for rule in RULES]}).dropna(subset=["cutoff"])

    return counts.groupBy("lang").applyInPandas(choose, "lang string, rule string, cutoff double")


def labelled_measures(measured: DataFrame, labels: DataFrame) -> DataFrame:
    quality = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return measured.filter(~base_failed()).join(quality, "doc_id")


def decide(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed, failed_rules (array of rule names) and kept to measured documents, by cutoffs of learn_cutoffs."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    per_lang = cutoffs.groupBy(lang.alias("_lang")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    per_lang = sized_broadcast(per_lang.select("_lang", *[F.col(r).alias(f"_{r}") for r in RULES]))  # one row per language
    fell = F.filter(F.array(*[F.when(ratio(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return (
        measured.withColumn("_lang", lang).join(per_lang, "_lang", "left")
        .withColumn("base_failed", base_failed()).withColumn("failed_rules", fell)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lang", *[f"_{r}" for r in RULES])
    )


def judge_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """doc_id, lang, the measures, base_failed, failed_rules and kept of every document."""
    measured = cut_lineage(with_measures(docs.select("doc_id", "lang", "text")).drop("text"))
    return decide(measured, learn_cutoffs(labelled_measures(measured, labels), risk, level))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with their own columns; the verdict is taken beside the text, which is never shuffled."""
    measured = cut_lineage(with_measures(docs.select("doc_id", "lang", "text")).drop("text"))
    cutoffs = learn_cutoffs(labelled_measures(measured, labels), risk, level)
    row = with_measures(packed(docs, "lang", "text")).drop("text")
    return decide(row, cutoffs).filter("kept").select(*unpacked(docs))
