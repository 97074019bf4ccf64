"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer maps words to symbols: insults (words and stems with weights learned from labelled rows),
threats, targets, negations and reporting verbs.  Small transducers for polarity, address, speech and threat are
composed into one machine, which walks the clauses of a text; a clause's score is the sum of its matches' weights,
raised by a target, lowered under negation or reported speech.  A logistic link over the clause scores, fitted on the
same labelled rows, turns them into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, saved, small_batches

#: Bounds of the fit: labelled rows per class, lexicon entries kept.
MAX_TOXIC, MAX_CLEAN, MAX_LEXICON = 4_000, 12_000, 20_000
MIN_SUPPORT, MIN_LOG_ODDS = 4, 2.5
STEMS = (4, 5, 6)
SPANS = 3  # words a negation reaches

# Closed-class words of English, French, German and Spanish.
TARGETS = "you your he she they them him her tu vous toi il elle ils du sie er ihr euch tú usted él ella ellos ustedes".split()
NEGATIONS = "not no never isn aren don ne pas jamais non nicht kein keine nie nunca tampoco sin".split()
REPORTS = "said says told wrote quoted called dit disait écrit selon sagte schrieb laut dijo dice escribió según".split()
MODALS = "will shall going gonna vais va werde wird voy vas".split()
THREATS = "kill hurt destroy burn beat tuer frapper töten schlagen matar golpear".split()

_CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """Weighted transitions (state, symbol) -> (state, factor); other symbols take ``other[state]``."""

    def __init__(self, arcs: dict, other: dict) -> None:
        self.arcs, self.other = arcs, other

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or self.other.get(state, (state, 1.0))


def _factor(states, symbols, factor, stay=None):
    return {(s, x): (s if stay is None else stay, factor) for s in states for x in symbols}


HITS = ("insult", "threat")
POLARITY = Transducer(
    {(s, "negation"): (SPANS, 1.0) for s in range(SPANS + 1)}
    | {(s, x): (s - 1, 0.4) for s in range(1, SPANS + 1) for x in HITS},
    {s: (max(0, s - 1), 1.0) for s in range(SPANS + 1)},
)
SPEECH = Transducer({(s, "report"): (1, 1.0) for s in (0, 1)} | _factor((1,), HITS, 0.6), {})
ADDRESS = Transducer({(s, "target"): (1, 1.0) for s in (0, 1)} | _factor((1,), HITS, 1.3), {})
MODALITY = Transducer({(s, "modal"): (1, 1.0) for s in (0, 1)} | {(0, "threat"): (0, 0.3), (1, "threat"): (0, 1.5)}, {})


class Composed:
    """Product of transducers: states are tuples, factors multiply; arcs are built when first met."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts, self.arcs = parts, {}
        self.start = (0,) * len(parts)

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            each = [p.step(s, symbol) for p, s in zip(self.parts, state, strict=True)]
            found = self.arcs[state, symbol] = tuple(e[0] for e in each), math.prod(e[1] for e in each)
        return found

    def weigh(self, symbols: list[tuple[str, float]]) -> float:
        state, total = self.start, 0.0
        for symbol, weight in symbols:
            state, factor = self.step(state, symbol)
            total += factor * weight
        return total


GRAMMAR = Composed(POLARITY, SPEECH, ADDRESS, MODALITY)
_CLOSED = {
    w.encode(): symbol
    for words, symbol in ((TARGETS, "target"), (NEGATIONS, "negation"), (REPORTS, "report"), (MODALS, "modal"))
    for w in words
}


class Lexicon:
    """Words and stems to (symbol, weight)."""

    def __init__(self, entries: dict[str, float]) -> None:
        self.words = {k.encode(): v for k, v in entries.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in entries.items() if k.endswith("*")}
        self.cache: dict[bytes, tuple[str, float]] = {}
        self.threats = {w.encode() for w in THREATS}

    def look_up(self, word: bytes) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        text = word.decode("utf-8", "replace")
        for n in STEMS:
            weight = max(weight, self.stems.get(text[:n], 0.0) if len(text) > n else 0.0)
        if word in self.threats:
            return "threat", max(weight, 1.0)
        return ("insult", weight) if weight > 0 else (_CLOSED.get(word, "other"), 0.0)

    def symbol(self, word: bytes) -> tuple[str, float]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= 500_000:
                self.cache.clear()
            found = self.cache[word] = self.look_up(word)
        return found

    def evidence(self, text: str | None) -> tuple[float, float, int, int]:
        """Strongest clause, sum of the positive ones, their number, and the number of words."""
        words = alnum_words(text)
        if not any(self.symbol(w)[1] for w in set(words)):
            return 0.0, 0.0, 0, len(words)
        best = total = 0.0
        clauses = 0
        for clause in _CLAUSE.split(text):
            symbols = [self.symbol(w) for w in alnum_words(clause)]
            if any(s[1] for s in symbols):
                score = GRAMMAR.weigh(symbols)
                best, total, clauses = max(best, score), total + max(score, 0.0), clauses + (score > 0)
        return best, total, clauses, len(words)


def design(rows: list[tuple[float, float, int, int]]) -> np.ndarray:
    best, total, clauses, words = np.array(rows, float).reshape(-1, 4).T
    return np.stack([np.ones_like(best), np.minimum(best, 20), np.log1p(total), np.log1p(clauses), total / (words + 10)], 1)


def fit_link(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; one class only gives its smoothed rate."""
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if len(y) == 0 or y.min() == y.max():
        return w
    penal = np.full(x.shape[1], ridge)
    penal[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penal)
        move = np.linalg.solve(h, x.T @ (y - p) - penal * w)
        w += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-8:
            break
    return w


def candidates(text: str | None) -> set[str]:
    found: set[str] = set()
    for w in {w.decode("utf-8", "replace") for w in alnum_words(text)}:
        found.add(w)
        found.update(f"{w[:n]}*" for n in STEMS if len(w) > n)
    return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def flush() -> pd.DataFrame:
        keys = list(toxic.keys() | clean.keys())
        out = pd.DataFrame({"item": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})
        toxic.clear(), clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            (toxic if label else clean).update(candidates(text))
        if len(toxic) + len(clean) > 500_000:
            yield flush()
    if toxic or clean:
        yield flush()


def bounded_labels(labels: DataFrame, limits: dict[int, int], column: str) -> DataFrame:
    """At most about ``limits`` rows of each class, chosen by a hash of doc_id; (doc_id, column).

    Of several labels of a doc_id the greatest counts; null ones do not.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column)).dropna()
    rows = saved(rows.groupBy("doc_id").agg(F.max(column).alias(column)), "labels")
    have = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}
    share = F.coalesce(*[F.when(F.col(column) == k, F.lit(min(1.0, limits.get(k, 0) / n))) for k, n in have.items()], F.lit(0.0))
    return rows.filter(F.pmod(F.xxhash64(F.col("doc_id") * 7 + 1), F.lit(1_000_000)) < share * 1_000_000)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Lexicon weights and link coefficients from at most MAX_TOXIC + MAX_CLEAN rows of ``labels(doc_id, toxic)``."""
    sample = bounded_labels(labels, {1: MAX_TOXIC, 0: MAX_CLEAN}, "toxic")
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    kept = (
        rows.mapInPandas(_counts, "item string, toxic long, clean long")
        .groupBy("item")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("weight", odds)
        .filter((F.col("toxic") >= MIN_SUPPORT) & (F.col("weight") >= MIN_LOG_ODDS))
        .orderBy(F.desc("weight"), "item")
        .limit(MAX_LEXICON)
    )
    entries = {r["item"]: float(r["weight"]) for r in kept.collect()}
    lexicon = Lexicon(entries)

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [lexicon.evidence(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["best", "total", "clauses", "words"])
            yield out.assign(toxic=batch["toxic"].to_numpy())

    seen = rows.mapInPandas(shown, "best double, total double, clauses long, words long, toxic int").toPandas()
    link = fit_link(design(list(seen[["best", "total", "clauses", "words"]].itertuples(index=False))), seen["toxic"].to_numpy(float))
    return entries, link.tolist()


@lru_cache(maxsize=4)
def _lexicon(key: tuple) -> Lexicon:
    return Lexicon(dict(key))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, score (0 to 1), predicted, n_clauses, strongest.

    Learns from ``labels(doc_id, toxic)``, whose nulls and repeats are ignored; lang, source and doc_id are no
    inputs.  Null, empty and clean texts get the link's value for no evidence; without labels that is 0.5.
    Rows with equal doc_id are scored one by one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries, link = fit(docs, labels)
    shared = spark.sparkContext.broadcast((tuple(entries.items()), link))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = shared.value
        lexicon = _lexicon(items)
        for batch in batches:
            if not len(batch):
                continue
            rows = [lexicon.evidence(t) for t in batch["text"]]
            p = 1 / (1 + np.exp(-np.clip(design(rows) @ np.array(weights), -30, 30)))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "score": p, "n_clauses": [r[2] for r in rows], "strongest": [r[0] for r in rows]}
            )

    out = docs.mapInPandas(score, "doc_id long, score double, n_clauses long, strongest double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
