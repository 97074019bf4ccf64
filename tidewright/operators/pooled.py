"""Day triggers fitted on all places together, for every left-out year and feature set at once.

Days collapse to distinct values, and each Newton step is one aggregate over them and the models (left-out year, feature
set), which are as many as the years times the sets.  The driver solves systems as wide as the features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..sources.shared import staged


@dataclass
class Pooled:
    """Coefficients (the intercept last) by (feature set, left-out year); None is the fit on all years."""

    features: list[str]
    sets: list[list[str]]
    found: dict[tuple[int, object], list[float]] = field(default_factory=dict)

    def margin(self, beta: list[float]) -> Column:
        return sum((F.col(c).cast("double") * b for c, b in zip(self.features, beta, strict=False) if b), F.lit(float(beta[-1])))

    def score(self, df: DataFrame, which: int, out: str) -> DataFrame:
        """``df`` with the probability of the fit on all years."""
        return df.withColumn(out, 1 / (1 + F.exp(-self.margin(self.found[which, None]))))


def _weights(counts: list, year, group_share: float | None) -> dict[tuple[object, int], float]:
    """Weight of a row of (group, label) in the model without ``year``: balanced classes times ``group_share`` over the
    group's rows, or 1 without a share; empty where a class is missing."""
    by: dict[tuple[object, int], int] = {}
    for r in counts:
        if year is None or r["year"] != year:
            by[r["grp"], r["y"]] = by.get((r["grp"], r["y"]), 0) + r["n"]
    n, groups = sum(by.values()), {}
    classes = {y: sum(v for (_, k), v in by.items() if k == y) for y in (0, 1)}
    if not all(classes.values()):
        return {}
    if group_share is None:
        return dict.fromkeys(by, 1.0)
    for (g, _), v in by.items():
        groups[g] = groups.get(g, 0) + v
    return {(g, y): n / (2 * classes[y]) * group_share / groups[g] for g, y in by}


def _scales(moments: list, wide: int, year) -> tuple[list[float], list[float]]:
    """Mean and deviation of each feature over the rows of other years; a feature without any has deviation 1."""
    use = [r for r in moments if year is None or r["year"] != year]
    n = sum(r["n"] for r in use) or 1
    mean = [math.fsum(r[f"s{i}"] for r in use) / n for i in range(wide)]
    square = [math.fsum(r[f"q{i}"] for r in use) / n for i in range(wide)]
    return mean, [math.sqrt(max(q - m * m, 0.0)) or 1.0 for m, q in zip(mean, square, strict=True)]


def fit(df: DataFrame, features: list[str], sets: list[list[str]], label: str, year: str, group: str, c: float = 0.1, share: float | None = 0.5, steps: int = 60, scaled: bool = False) -> Pooled:
    """Ridge-penalised logistic fits, the intercept penalised like the rest: least of |beta|^2 / 2 + ``c`` times the weighted
    loss.  Classes are balanced, and a group's rows share the weight ``share``.  Without a share all rows weigh 1.
    ``scaled``: features are brought to mean 0 and deviation 1 of the model's own rows first, and the intercept is free.
    Rows with a missing feature, label or year go; a model whose training years lack a class is not fitted."""
    x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.select(F.col(year).alias("year"), F.col(group).alias("grp"), F.col(label).cast("int").alias("y"), *x)
    rows = rows.dropna(subset=[c for c in rows.columns if c != "grp"]).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    rows = staged(rows, "days")
    counts = rows.groupBy("year", "grp", "y").agg(F.sum("n").alias("n")).collect()  # years x groups x 2
    out, wide = Pooled(features, sets), len(features) + 1
    masks = [np.array([f in s for f in features] + [True]) for s in sets]
    rule = np.array([1.0] * len(features) + [0.0 if scaled else 1.0])  # what is penalised
    if scaled:
        each = [f(F.col(f"x{i}") * F.col("n") * (F.col(f"x{i}") if k == "q" else 1)).alias(f"{k}{i}") for f in (F.sum,) for k in "sq" for i in range(len(features))]
        moments = rows.groupBy("year").agg(F.sum("n").alias("n"), *each).collect()  # a row a year
    plain = ([0.0] * len(features), [1.0] * len(features))
    scale = {y: _scales(moments, len(features), y) if scaled else plain for y in [None, *{r["year"] for r in counts}]}
    weights = {y: _weights(counts, y, share) for y in [None, *sorted({r["year"] for r in counts})]}
    beta = {(k, y): np.zeros(wide) for k in range(len(sets)) for y, w in weights.items() if w}
    open_, last = dict(beta), {}
    for _ in range(steps):
        if not open_:
            break
        models = [(i, y, k, g, label_, w, b.tolist(), *scale[y]) for i, ((k, y), b) in enumerate(open_.items()) for (g, label_), w in weights[y].items()]
        kinds = dict(rows.dtypes)
        table = F.broadcast(df.sparkSession.createDataFrame(models, f"m int, out {kinds['year']}, s int, grp {kinds['grp']}, y int, w double, b array<double>, mu array<double>, sd array<double>"))
        met = rows.join(table, (rows["grp"].eqNullSafe(table["grp"])) & (rows["y"] == table["y"]) & (table["out"].isNull() | (rows["year"] != table["out"])))
        one = [(F.col(f"x{i}") - F.get("mu", F.lit(i))) / F.get("sd", F.lit(i)) for i in range(len(features))] + [F.lit(1.0)]
        met = met.select("m", rows["y"], (F.col("n") * F.col("w") * c).alias("w"), *[v.alias(f"v{i}") for i, v in enumerate(one)], sum((F.get("b", F.lit(i)) * v for i, v in enumerate(one)), F.lit(0.0)).alias("z"))
        met = met.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        gap, bend = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1 - F.col("p"))
        loss = F.col("w") * (F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z"))))
        sums = [F.sum(loss).alias("loss")] + [F.sum(gap * F.col(f"v{i}")).alias(f"g{i}") for i in range(wide)]
        sums += [F.sum(bend * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"h{i}_{j}") for i in range(wide) for j in range(i, wide)]
        names = list(open_)
        for r in met.groupBy("m").agg(*sums).collect():  # a row a model
            key = names[r["m"]]
            mask, b = masks[key[0]], beta[key]
            value = r["loss"] + float((rule * b) @ b) / 2
            if key in last and value > last[key][0] + 1e-12 * abs(last[key][0]):
                beta[key] = (b + last[key][1]) / 2  # too far: half the way back
                open_[key] = beta[key]
                continue
            g = np.array([r[f"g{i}"] for i in range(wide)]) + rule * b
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(wide)] for i in range(wide)]) + np.diag(rule)
            step = np.zeros(wide)
            step[mask] = np.linalg.solve(h[np.ix_(mask, mask)], g[mask])
            last[key] = (value, b)
            beta[key] = b - step
            open_[key] = beta[key]
            if np.abs(step).max() < 1e-10:
                del open_[key]
    for (k, y), b in beta.items():
        mean, sd = (np.array(v) for v in scale[y])
        raw = b[:-1] / sd
        out.found[k, y] = [*raw.tolist(), float(b[-1] - raw @ mean)]
    return out


def held_out(df: DataFrame, model: Pooled, year: str) -> DataFrame:
    """``df`` once a feature set, with ``set`` and the ``score`` of the model that left the row's year out."""
    rows = [(k, y, b) for (k, y), b in model.found.items() if y is not None]
    kind = dict(df.dtypes)[year]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, f"set int, _y {kind}, _b array<double>"))  # years x sets
    x = df.join(table, F.col(year) == F.col("_y"))
    z = sum((F.col(f).cast("double") * F.get("_b", F.lit(i)) for i, f in enumerate(model.features)), F.get("_b", F.lit(len(model.features))))
    return x.withColumn("score", 1 / (1 + F.exp(-z))).drop("_y", "_b")


def yearly(df: DataFrame, model: Pooled, label: str, year: str) -> DataFrame:
    """(set, year, pos, n, auc, ap) of years left out in turn; years of one class have no row."""
    x = held_out(df.dropna(subset=[label, year, *model.features]), model, year)
    x = x.withColumn("_k", F.concat_ws(":", "set", F.col(year).cast("string"))).withColumn("_l", F.col(label).cast("long"))
    m = stats.group_metrics(x.select("_k", "score", "_l"), "_k", "score", "_l").filter("auc is not null")
    return m.select(F.split("_k", ":")[0].cast("int").alias("set"), F.split("_k", ":")[1].alias("year"), "pos", "n", "auc", "ap")


def chosen(folds: DataFrame) -> int:
    """The feature set of the highest mean AUC, the first of equal ones."""
    best = folds.groupBy("set").agg(F.avg("auc").alias("auc")).orderBy(F.desc("auc"), "set").first()
    return best["set"] if best else 0


def log_odds_of_rank(df: DataFrame, features: list[str]) -> DataFrame:
    """``features`` replaced by the log odds of their percentile, kept between 0.001 and 0.999; null stays null."""
    from .triggers import logit

    for f in features:
        df = stats.ecdf(df, f, "_q").withColumn(f, logit(F.col("_q"))).drop("_q")
    return df


def margin_of(beta: list[float], x: list[float]) -> float:
    return math.fsum([b * v for b, v in zip(beta, x, strict=False)]) + beta[-1]
