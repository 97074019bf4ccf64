"""Trigger candidates on years left out, the index of a candidate chosen inside each fold, and the one that is best."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import pooled, triggers

KNOTS = 200
CANDIDATES = ("logit_design", "logit_log", "isotonic", "percentile")


@dataclass
class Folds:
    """Held-out rows (candidate, year, label, score), and the index that each fold's isotonic fit uses."""

    scores: DataFrame
    index: dict


def _log(c: str):
    return F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))


def _between(v: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through (xs, ys), clamped; of a repeated knot the last counts."""
    k = F.size(F.filter(xs, lambda p: p <= v))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k == F.size(xs), y0).otherwise(y0 + (v - x0) * (y1 - y0) / (x1 - x0))


def index_of_fold(df: DataFrame, features: list[str], label: str, year: str, fits: pooled.Pooled) -> dict:
    """The feature of the highest AUC on each fold's training years, the last name of equal ones; a feature counts in the
    direction of its own fit.  Rows collapse to distinct values, and all folds and features are measured at once."""
    folds = [y for k, y in fits.found if k == 0 and y is not None]
    cells = None
    for k, f in enumerate(features):
        part = df.groupBy(F.col(year).alias("_y"), F.lit(f).alias("f"), F.lit(k).alias("k"), F.col(f).cast("double").alias("x"), F.col(label).cast("long").alias("l")).agg(F.count(F.lit(1)).alias("n"))
        cells = part if cells is None else cells.unionByName(part)
    if not folds:
        return {}
    sign = [(y, k, 1.0 if b[k] >= 0 else -1.0) for (k, y), b in fits.found.items() if y in folds and k < len(features)]
    kind = dict(df.dtypes)[year]
    table = F.broadcast(df.sparkSession.createDataFrame(sign, f"fold {kind}, k int, sign double"))  # years x features
    x = cells.join(table, "k").filter(F.col("_y") != F.col("fold"))
    x = x.groupBy("fold", "f", (F.col("x") * F.col("sign")).alias("s")).agg(F.sum(F.col("n") * F.col("l")).alias("p"), F.sum("n").alias("c"))
    x = x.withColumn("z", F.col("c") - F.col("p"))
    up = stats.running(x, "s", {"zc": "z"}, ("fold", "f"))
    auc = up.groupBy("fold", "f").agg((F.sum(F.col("p") * (F.col("zc") - F.col("z") / F.lit(2.0))) / (F.sum("p") * F.sum("z")).cast("double")).alias("auc"))
    best = auc.groupBy("fold").agg(F.max_by("f", F.struct(F.round("auc", 12), "f")).alias("f"))
    return {r["fold"]: r["f"] for r in best.collect()}  # a row a year


def left_out(df: DataFrame, features: list[str], label: str, year: str) -> Folds:
    """Candidates over ``features`` (four, the first the main one), every row scored by fits of the other years.

    Logistic fits of all years go together; an isotonic fit and the percentile knots are one small job a year each.  Rows
    with a missing feature, label or year go, and so do years whose training rows lack a class.
    """
    from pyspark.ml.regression import IsotonicRegression

    a, b, c, d = features
    x = df.dropna(subset=[*features, label, year]).select(year, F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    x = x.withColumns({f"log_{f}": _log(f) for f in (a, b, d)}).withColumn("_one", F.lit(""))
    names = [*features[:3], d, f"log_{a}", f"log_{b}", f"log_{d}"]
    sets = [[a], [b], [c], [a, c], [f"log_{a}", f"log_{b}", f"log_{d}"]]
    fits = pooled.fit(x, names, sets, "label", year, "_one", 1.0, None, scaled=True)
    held = pooled.held_out(x, fits, year)
    name = F.when(F.col("set") == 3, "logit_design").when(F.col("set") == 4, "logit_log")
    out = held.filter("set >= 3").select(name.alias("candidate"), F.col(year).alias("year"), "label", "score")
    index = index_of_fold(x, features[:3], "label", year, fits)
    told = []
    for y, column in sorted(index.items()):
        train = x.filter(F.col(year) != F.lit(y))
        by = train.groupBy(F.col(column).alias("v")).agg(F.avg("label").alias("share"), F.count(F.lit(1)).cast("double").alias("w"))
        iso = IsotonicRegression(featuresCol="v", labelCol="share", weightCol="w").fit(by)
        knots = [r["q"] for r in triggers.quantile_grid(train, a, KNOTS).orderBy("i").collect()]
        told.append((y, column, [float(v) for v in iso.boundaries], [float(v) for v in iso.predictions], knots))
    kind = dict(x.dtypes)[year]
    table = df.sparkSession.createDataFrame(told, f"_y {kind}, _c string, _xs array<double>, _ys array<double>, _q array<double>")
    each = x.join(F.broadcast(table), F.col(year) == F.col("_y"))  # a row a year
    value = F.when(F.col("_c") == a, F.col(a)).when(F.col("_c") == b, F.col(b)).otherwise(F.col(c))
    even = F.transform(F.sequence(F.lit(0), F.lit(KNOTS)), lambda i: i / F.lit(float(KNOTS)))
    share = F.when(F.col(a) < F.get("_q", F.lit(0)), F.lit(0.0)).otherwise(_between(F.col(a), F.col("_q"), even))
    scores = {"isotonic": _between(value, F.col("_xs"), F.col("_ys")), "percentile": triggers.expit((share - 0.95) / 0.02)}
    for candidate, score in scores.items():
        out = out.unionByName(each.select(F.lit(candidate).alias("candidate"), F.col(year).alias("year"), "label", score.alias("score")))
    return Folds(out, index)


def compared(folds: Folds) -> DataFrame:
    """(candidate, auc, ap, n) over all held-out rows together."""
    x = folds.scores.withColumn("label", F.col("label").cast("long"))
    return stats.group_metrics(x, "candidate", "score", "label").select("candidate", "auc", "ap", "n")


def best(table: DataFrame) -> str:
    """The candidate of the highest AUC, then AP, then the first; ``percentile`` where none has one."""
    order = {n: i for i, n in enumerate(CANDIDATES)}
    rows = [r for r in table.collect() if r["auc"] is not None]
    return max(rows, key=lambda r: (r["auc"], r["ap"], -order[r["candidate"]]))["candidate"] if rows else "percentile"
