"""Mixing sources to target weights by soft domain membership, JVM expressions only.

A classifier held as a table (naive Bayes over a fixed, short list of letters and frequent function words) learns
from a labelled table and predicts every document's domain posterior.  Nonnegative document rates then minimise
the distance between expected domain token totals and their targets by projected gradient steps, preconditioned by
document length so that a rate depends on the posterior alone: each iteration is one aggregation to as many sums as
there are domains.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# Letters that tell the corpus languages apart.
LETTERS = ("é", "è", "ê", "ç", "ñ", "ó", "í", "á", "ä", "ö", "ü", "ß", "q", "w", "z", "k", "j", "y", "h", "v")
STEPS = 24
RAREST = 0.005  # of the largest domain: rarer ones take small steps, so that one without texts cannot drive the rates up


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (blank-separated words), and ``f``: counts of LETTERS and of all other characters."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    only = F.regexp_replace("low", f"[^{''.join(LETTERS)}]", "")
    size = lambda x: F.length(x).cast("double")
    base = docs.select("doc_id", text.alias("low"))
    base = base.select("doc_id", "low", only.alias("marked"), F.btrim("low", F.lit(" \t\n\x0b\x0c\r")).alias("trim"))
    words = F.when(F.col("trim") == "", F.lit(0)).otherwise(F.size(F.split("trim", r"[\x20\x09-\x0D]+"))).cast("long")
    each = [size(F.col("marked")) - size(F.translate("marked", c, "")) for c in LETTERS]
    return base.select("doc_id", words.alias("n_tokens"), F.array(*each, size(F.col("low")) - size(F.col("marked"))).alias("f"))


def _dot(weights: list[float]) -> Column:
    return sum((F.get("f", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def posteriors(feats: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """``feats`` with ``p``, the posterior over ``domains``, learned from ``labelled(doc_id, domain)``.

    Naive Bayes with counts damped to an effective length of 200 characters, so that long texts keep soft
    posteriors.  Without labelled rows the posterior is uniform; of several domains of a doc_id the first name counts.
    """
    width = len(LETTERS) + 1
    known = labelled.filter("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    joined = feats.join(known, "doc_id")
    sums = joined.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("f", F.lit(i))).alias(f"f{i}") for i in range(width)])
    found = {r["domain"]: r for r in sums.filter(F.col("domain").isin(domains)).collect()}
    total = sum(r["n"] for r in found.values()) or 1
    logits = []
    damp = F.lit(200.0) / F.greatest(F.lit(200.0), F.aggregate("f", F.lit(0.0), lambda a, x: a + x))
    for d in domains:
        row = found.get(d)
        counts = np.array([(row[f"f{i}"] or 0.0) if row else 0.0 for i in range(width)]) + 1.0
        prior = np.log(((row["n"] if row else 0) + 1.0) / (total + len(domains)))
        logits.append(F.lit(float(prior)) + _dot(np.log(counts / counts.sum()).tolist()) * damp)
    out = feats.withColumn("l", F.array(*logits))
    out = out.withColumn("l", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    return out.withColumn("p", F.transform("l", lambda x: x / F.aggregate("l", F.lit(0.0), lambda a, y: a + y))).drop("l")


def _rates(steps: list[list[float]], domains: int) -> Column:
    """The rate after all ``steps`` (one gradient weight per domain each), projected on [0, inf) every time."""
    if not steps:
        return F.lit(1.0)
    given = F.from_json(F.lit(str(steps)), "array<array<double>>")
    move = lambda r, g: F.greatest(F.lit(0.0), r - sum((F.get(g, F.lit(d)) * F.get("p", F.lit(d)) for d in range(domains)), F.lit(0.0)))
    return F.aggregate(given, F.lit(1.0), move)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], steps: int = STEPS, keep_all: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_tokens, posterior (array in the order of sorted
    ``targets``), domain (most likely), rate, copies.

    ``rate`` is nonnegative; the expected domain totals sum(rate * n_tokens * posterior) approach the target
    shares of the corpus' tokens, or with ``keep_all`` of the least total at which no domain shrinks.  ``copies``
    is the rate rounded down or up by a hash of doc_id so that it is right on average.  Texts without words count
    nothing and keep rate 1.  Targets that no nonnegative rates reach, such as those of a domain without texts, are
    approached in least squares and leave the rates of a moderate size.  Nulls in ``labelled`` are ignored; ties in domain go to the first name.
    """
    domains = sorted(targets)
    if not domains or any(targets[d] < 0 for d in domains) or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative with a positive sum")
    want = np.array([targets[d] for d in domains], float) / sum(targets.values())
    k = len(domains)
    known = saved(posteriors(saved(features(docs), "features"), labelled, domains).select("doc_id", "n_tokens", "p"), "posteriors")
    own = [F.sum(F.col("n_tokens") * F.get("p", F.lit(d))).alias(f"t{d}") for d in range(k)]
    square = [
        F.sum(F.col("n_tokens") * F.get("p", F.lit(d)) * F.get("p", F.lit(e))).alias(f"m{d}_{e}")
        for d in range(k)
        for e in range(d, k)
    ]
    row = known.agg(F.sum("n_tokens").alias("n"), *own, *square).first()
    have = np.array([row[f"t{d}"] or 0.0 for d in range(k)])
    gradient: list[list[float]] = []
    scale = max(float(row["n"] or 0), 1.0)
    scaled = known.withColumn("a", F.transform("p", lambda x: x * F.col("n_tokens") / F.lit(scale)))
    if have.sum() > 0:
        m = np.array([[row[f"m{min(d, e)}_{max(d, e)}"] or 0.0 for e in range(k)] for d in range(k)]) / scale
        at_least = max((have[d] / scale / want[d] for d in range(k) if want[d] > 0 and have[d] > 0), default=1.0)
        goal = want * (at_least if keep_all else 1.0)
        size, axes = np.linalg.eigh(m)
        metric = axes / np.maximum(size, RAREST * size.max()) @ axes.T  # residuals weighed by it: near-Newton steps, k x k
        for _ in range(steps):
            sums = [F.sum(F.col("r") * F.get("a", F.lit(d))).alias(f"s{d}") for d in range(k)]
            got = scaled.select("a", _rates(gradient, k).alias("r")).agg(*sums).first()
            miss = np.array([got[f"s{d}"] or 0.0 for d in range(k)]) - goal
            if np.abs(miss).max() < 1e-6:
                break
            gradient.append((metric @ miss).tolist())
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 16, 12), 16, 10).cast("double") / F.lit(float(16**12))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return (
        scaled.withColumn("rate", F.when(F.col("n_tokens") > 0, _rates(gradient, k)).otherwise(1.0))
        .select(
            "doc_id",
            "n_tokens",
            F.col("p").alias("posterior"),
            F.element_at(F.array(*[F.lit(d) for d in domains]), best).alias("domain"),
            "rate",
            F.floor(F.col("rate") + u).cast("int").alias("copies"),
        )
    )
