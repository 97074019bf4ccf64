"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one vector of hashed-text weights; ordered thresholds cut its score, P(grade <= k) =
sigmoid(threshold_k - score).  Features are hashed words, word shapes and bucketed whole-text ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .toxicity import bounded_labels

#: Bounds of the fit: hashed weights, labelled rows per grade.
BITS, MAX_PER_GRADE = 16, 4_000
EPOCHS = 60


def _shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:12])


class Hasher:
    """Text to (indices, values): values of the word part and the shape part each have norm at most one."""

    def __init__(self) -> None:
        self.cache: dict[str, tuple[int, int]] = {}

    @staticmethod
    def slot(item: str) -> int:
        return xxhash.xxh3_64_intdigest(item.encode("utf-8", "replace")) & ((1 << BITS) - 1)

    def word(self, w: str) -> tuple[int, int]:
        found = self.cache.get(w)
        if found is None:
            if len(self.cache) >= 500_000:
                self.cache.clear()
            found = self.cache[w] = self.slot("w" + w.lower()), self.slot("s" + _shape(w))
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        n = len(words)
        extra = [f"n{n.bit_length()}"]
        idx, val = np.empty(0, np.int64), np.empty(0)
        if n:
            pairs = np.fromiter((x for w in words for x in self.word(w)), np.int64, 2 * n)
            parts = []
            for col, weight in ((pairs[::2], 1.0), (pairs[1::2], 3.0)):
                i, c = np.unique(col, return_counts=True)
                parts.append((i, weight * c / n))
            idx, val = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            lines = [x for x in text.split("\n") if x.strip()]
            extra.append(f"distinct{int(10 * len(set(words)) / n)}")
            extra.append(f"bigrams{int(10 * len(set(zip(words, words[1:], strict=False))) / n)}")
            extra.append(f"lines{int(10 * len(set(lines)) / max(1, len(lines)))}")
            letters = sum(map(str.isalpha, text))
            extra.append(f"letters{int(20 * letters / len(text))}")
        at = np.array([self.slot("e" + e) for e in extra], np.int64)
        return np.concatenate([idx, at]), np.concatenate([val, np.full(len(at), 0.5)])


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the mean log-likelihood."""
    w, cuts = np.zeros(1 << BITS), np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(1)
    if not rows:
        return w, cuts
    begin = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    own = np.repeat(np.arange(len(rows)), np.diff(begin))
    share = np.bincount(grades, minlength=n_grades) / len(grades)
    cum = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(cum / (1 - cum)) + 1e-3 * np.arange(n_grades - 1))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    state = [np.zeros_like(w), np.zeros_like(w)]
    for t in range(1, EPOCHS + 1):
        s = np.bincount(own, val * w[idx], len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = sig(edges[grades + 1] - s), sig(edges[grades] - s)
        p = np.maximum(hi - lo, 1e-9)
        down = (hi * (1 - hi) - lo * (1 - lo)) / p  # d(-log p)/ds
        g = np.bincount(idx, val * down[own], len(w)) / len(rows) + ridge * w
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        w -= 0.3 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8) * (1 - t / (EPOCHS + 1))
        up = np.array([(((grades == k) * hi * (1 - hi) - (grades == k + 1) * lo * (1 - lo)) / p).mean() for k in range(n_grades - 1)])
        cuts = np.maximum.accumulate(cuts + 0.5 * up)
    return w, cuts


def ordinal_quality(docs: DataFrame, ratings: DataFrame, grade: str = "quality", n_grades: int = 2, tail: int = 1, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, expected_grade, tail_probability, kept.

    Learns from ``ratings(doc_id, grade)`` with grades 0..n_grades-1, at most MAX_PER_GRADE rows of each; nulls,
    repeats and other grades are ignored.  tail_probability is P(grade >= tail); kept where it reaches ``least``.
    Null and empty texts are scored as texts without words; without ratings every tail probability is that of
    score 0.  Rows with equal doc_id are scored one by one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = bounded_labels(ratings, dict.fromkeys(range(n_grades), MAX_PER_GRADE), grade).filter(F.col(grade).between(0, n_grades - 1))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows = [hasher(t) for t in batch["text"]]
            yield pd.DataFrame({"grade": batch[grade], "idx": [r[0].astype(np.int32).tobytes() for r in rows], "val": [r[1].astype(np.float32).tobytes() for r in rows]})

    seen = docs.join(F.broadcast(sample), "doc_id").mapInPandas(hashed, "grade int, idx binary, val binary").toPandas()
    rows = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for i, v in zip(seen["idx"], seen["val"], strict=True)]
    w, cuts = fit_ordinal(rows, seen["grade"].to_numpy(np.int64), n_grades)
    shared = spark.sparkContext.broadcast((w, cuts))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, cuts = shared.value
        hasher = Hasher()
        for batch in batches:
            if not len(batch):
                continue
            s = np.array([float(v @ w[i]) for i, v in (hasher(t) for t in batch["text"])])
            above = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts[None, :], -30, 30)))  # P(grade > k)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "expected_grade": above.sum(1), "tail_probability": above[:, tail - 1]})

    out = docs.mapInPandas(score, "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= least)
