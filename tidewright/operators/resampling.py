"""Resampled ranking metrics: classes drawn apart, weights shared between tasks and scorers.

Weights are hashed from a row's key, class and replicate, so every task and scorer sees the same draw.  Rows collapse to
scores by replicate where they are read; running totals go by replicate and range of scores, so no task holds a replicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import staged
from . import sampling

METRICS = ("recall", "auc", "ap", "lift")


def drawn(df: DataFrame, key: str, label: str, reps: int, *by: str) -> DataFrame:
    """(rep, *by, p, z): positives' and negatives' weights, scaled in each replicate to the classes' own sizes."""
    x = df.filter(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("int"))
    x = sampling.weighted(x, F.concat_ws("-", F.col(key).cast("string"), F.col("_y").cast("string")), reps)
    x = x.groupBy("rep", *by).agg(F.sum(F.col("_y") * F.col("w")).alias("p"), F.sum((1 - F.col("_y")) * F.col("w")).alias("z"), F.sum(F.when(F.col("rep") == 0, F.col("_y"))).alias("_p"), F.sum(F.when(F.col("rep") == 0, 1 - F.col("_y"))).alias("_z"))
    x = staged(x, "drawn")  # read for the sizes, for range edges and for totals: the hashes are taken once
    size = x.groupBy("rep").agg(F.sum("p").alias("sp"), F.sum("z").alias("sz"))
    own = x.agg(F.sum("_p").alias("np"), F.sum("_z").alias("nz"))
    x = x.drop("_p", "_z").join(F.broadcast(size.crossJoin(own)), "rep")  # a row a replicate
    return x.select("rep", *by, F.try_divide(F.col("p") * F.col("np"), F.col("sp")).alias("p"), F.try_divide(F.col("z") * F.col("nz"), F.col("sz")).alias("z"))


def measured(by: DataFrame, keys: tuple[str, ...], score: str, share: float) -> DataFrame:
    """``by(*keys, score, p, z)`` to (*keys, pos, neg, recall, auc, ap, lift); ties at the edge of the top ``share`` count in
    proportion, and a metric without both classes is null."""
    by = by.withColumn("c", F.col("p") + F.col("z"))
    up = stats.running(by, score, {"zc": "z", "cc": "c", "pc": "p"}, keys)
    total = by.groupBy(*keys).agg(F.sum("p").alias("pos"), F.sum("z").alias("neg"))
    x = up.join(total, list(keys))
    n = F.col("pos") + F.col("neg")
    tp, seen = F.col("pos") - F.col("pc") + F.col("p"), n - F.col("cc") + F.col("c")
    inside = F.least(F.greatest(share * n - (seen - F.col("c")), F.lit(0.0)), F.col("c"))
    both = (F.first("pos") > 0) & (F.first("neg") > 0)
    out = x.groupBy(*keys).agg(
        F.first("pos").alias("pos"), F.first("neg").alias("neg"),
        F.when(both, F.sum(F.try_divide(F.col("p") * inside, F.col("c"))) / F.first("pos")).alias("recall"),
        F.when(both, F.sum(F.col("p") * (F.col("zc") - F.col("z") / 2)) / (F.first("pos") * F.first("neg"))).alias("auc"),
        F.when(both, F.sum(F.try_divide(F.col("p") * tp, seen)) / F.first("pos")).alias("ap"),
    )
    return out.withColumn("lift", F.col("recall") / (F.col("pos") / (F.col("pos") + F.col("neg"))))


def replicates(df: DataFrame, key: str, label: str, score: str, group: str, reps: int, share: float = 0.1) -> DataFrame:
    """(rep, recall, auc, ap, lift, strat_recall, strat_auc) of every replicate: overall, and within groups, pooled by
    positives.  Rows without a score rank below all others."""
    x = df.withColumn("_s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    by = drawn(x, key, label, reps, group, "_s").withColumnRenamed(group, "_g")
    whole = measured(by.groupBy("rep", "_s").agg(F.sum("p").alias("p"), F.sum("z").alias("z")), ("rep",), "_s", share)
    named = by.withColumn("_g", F.coalesce(F.col("_g").cast("string"), F.lit("")))
    part = measured(named, ("rep", "_g"), "_s", share)
    rank = F.when(F.col("auc").isNotNull(), F.col("pos"))
    part = part.groupBy("rep").agg(F.try_divide(F.sum(F.coalesce("recall", F.lit(0.0)) * F.col("pos")), F.sum("pos")).alias("strat_recall"), F.try_divide(F.sum(F.col("auc") * F.col("pos")), F.sum(rank)).alias("strat_auc"))
    return whole.drop("pos", "neg").join(part, "rep", "left")


def intervals(reps: DataFrame, names: list[str]) -> DataFrame:
    """(metric, low, high): the middle 95 % of replicates that have the metric."""
    each = reps.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("m")).select("m.*")
    each = each.filter("v is not null")
    return each.groupBy("metric").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))  # a value a replicate


def keep_rule(first: dict[str, DataFrame], second: dict[str, DataFrame], least: float = 0.9, loss: float = 0.01) -> DataFrame:
    """Two scorers' ``replicates`` by task, from the same draws: delta, low, high, p_better of the mean recall over the
    tasks, the mean difference of the stratified one, and whether the first stays: better in ``least`` of the replicates
    and not ``loss`` worse within groups."""
    parts = None
    for task in first:
        a = first[task].select("rep", F.col("recall").alias("a"), F.col("strat_recall").alias("sa"))
        x = a.join(second[task].select("rep", F.col("recall").alias("b"), F.col("strat_recall").alias("sb")), "rep")
        parts = x if parts is None else parts.unionByName(x)
    mean = parts.groupBy("rep").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("sa").alias("sa"), F.avg("sb").alias("sb"))
    gap = F.col("a") - F.col("b")
    out = mean.agg(F.avg(gap).alias("delta"), F.percentile(gap, 0.025).alias("low"), F.percentile(gap, 0.975).alias("high"), F.avg((gap > 0).cast("int")).alias("p_better"), F.avg(F.col("sa") - F.col("sb")).alias("head_delta"))
    return out.withColumn("keep", (F.col("p_better") >= least) & (F.col("head_delta") >= -loss))


def rounded(df: DataFrame, *keep: str) -> list[Column]:
    return [F.col(c) if c in keep else F.round(c, 6).alias(c) for c in df.columns]
