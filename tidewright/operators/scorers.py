"""Scorers behind one protocol: ``fit(train)`` gives a fitted scorer, whose ``score(df)`` adds a column.

A scorer of a user's own needs these two methods only; ``REGISTRY`` finds it by name.  The training table loses the
columns that no model may see before it reaches a scorer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .checks import assert_allowed


class Fitted(Protocol):
    def score(self, df: DataFrame, out: str) -> DataFrame: ...


class Scorer(Protocol):
    def fit(self, train: DataFrame) -> Fitted: ...


REGISTRY: dict[str, Callable[..., Scorer]] = {}


def register(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def score(scorer: Scorer, train: DataFrame, df: DataFrame, out: str = "score") -> DataFrame:
    """Fit on ``train`` and score ``df``; forbidden columns raise."""
    assert_allowed(train.columns)
    return scorer.fit(train).score(df, out)


@register("rule")
@dataclass
class Rule:
    """A column times a sign; missing values by the training median or zero."""

    column: str
    sign: int = 1
    fill: str = "median"

    def fit(self, train: DataFrame) -> _FittedRule:
        value = train.agg(F.percentile(self.column, 0.5)).first()[0] if self.fill == "median" else 0.0
        return _FittedRule(self.column, self.sign, float(value or 0.0))


@dataclass
class _FittedRule:
    column: str
    sign: int
    value: float

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.sign * F.coalesce(F.col(self.column).cast("double"), F.lit(self.value)))


def neutral(train: DataFrame, df: DataFrame, numbers: list[str], words: list[str]) -> DataFrame:
    """``df`` with columns replaced by the training rows' median or most frequent value."""
    one = train.agg(*[F.percentile(c, 0.5).alias(f"_{c}") for c in numbers])
    for c in words:
        top = train.groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias(f"_{c}"))
        one = one.crossJoin(F.broadcast(top))
    x = df.crossJoin(F.broadcast(one))  # a single row
    return x.withColumns({c: F.col(f"_{c}") for c in [*numbers, *words]}).select(df.columns)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*features)))


@register("logistic")
@dataclass
class Logistic:
    """Median for missing values, unit scale, ridge logistic regression with balanced classes."""

    features: list[str]
    reg: float = 0.01

    def fit(self, train: DataFrame) -> _FittedLogistic:
        from pyspark.ml.classification import LogisticRegression

        row = train.agg(*[F.percentile(c, 0.5).alias(c) for c in self.features], *[F.stddev(c).alias(f"{c}_s") for c in self.features], F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_n")).first()
        middle = {c: float(row[c] or 0.0) for c in self.features}
        scale = {c: float(row[f"{c}_s"] or 0.0) or 1.0 for c in self.features}
        if not row["_p"] or row["_p"] == row["_n"]:
            return _FittedLogistic(self.features, middle, scale, [0.0] * len(self.features), 9.0 if row["_p"] else -9.0)
        share = row["_p"] / row["_n"]
        x = train.withColumns({c: (F.coalesce(c, F.lit(middle[c])) - middle[c]) / scale[c] for c in self.features})
        x = _assembled(x, self.features).withColumn("w", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        m = LogisticRegression(regParam=self.reg, maxIter=100, weightCol="w").fit(x.select("features", "label", "w"))
        return _FittedLogistic(self.features, middle, scale, [float(c) for c in m.coefficients], float(m.intercept))


@dataclass
class _FittedLogistic:
    features: list[str]
    middle: dict[str, float]
    scale: dict[str, float]
    coef: list[float]
    intercept: float

    def score(self, df: DataFrame, out: str) -> DataFrame:
        z = F.lit(self.intercept)
        for c, k in zip(self.features, self.coef, strict=True):
            z = z + (F.coalesce(c, F.lit(self.middle[c])) - self.middle[c]) / self.scale[c] * k
        return df.withColumn(out, 1 / (1 + F.exp(-z)))


def cross_fitted(df: DataFrame, key: str, features: list[str], folds: int) -> DataFrame:
    """Every row scored by the model of the folds it is not in."""
    x = df.withColumn("_f", F.pmod(F.xxhash64(key), F.lit(folds)))
    parts = [Logistic(features).fit(x.filter(F.col("_f") != f)).score(x.filter(F.col("_f") == f), "score") for f in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_f")


def left_out(df: DataFrame, features: list[str]) -> DataFrame:
    """(candidate, auc, n): logistic, isotonic and percentile candidates on ``df(label, group, ...)``, each group scored
    by models of the other groups.  Groups are few; candidates of one class in training say its share."""
    from pyspark.ml.regression import IsotonicRegression

    groups = [r[0] for r in df.select("group").distinct().orderBy("group").collect()]
    column, parts = features[0], []
    for g in groups:
        train, test = df.filter(F.col("group") != g), df.filter(F.col("group") == g)
        parts.append(Logistic(features).fit(train).score(test, "score").withColumn("candidate", F.lit("logistic")))
        by = train.groupBy(F.col(column).alias("x")).agg(F.avg("label").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        iso = IsotonicRegression(featuresCol=column, labelCol="y", weightCol="w").fit(by.withColumnRenamed("x", column))
        parts.append(iso.transform(test).withColumnRenamed("prediction", "score").withColumn("candidate", F.lit("isotonic")))
        n = train.agg(F.count(F.lit(1)).cast("double").alias("_n"))
        le = stats.foreign_le(train.select(column), test.select(column), column)
        rank = test.join(le, column).crossJoin(F.broadcast(n)).withColumn("score", F.col("le") / F.col("_n")).drop("le", "_n")
        parts.append(rank.withColumn("candidate", F.lit("percentile")))
    out = parts[0].select("candidate", "score", "label")
    for p in parts[1:]:
        out = out.unionByName(p.select("candidate", "score", "label"))
    m = stats.group_metrics(out.withColumn("label", F.col("label").cast("long")), "candidate", "score", "label")
    return m.select("candidate", F.round("auc", 6).alias("auc"), "n")


def spline(df: DataFrame, features: list[str], bins: int) -> DataFrame:
    """Indicators of quantile bins, then a logistic model; all rows are scored."""
    cuts = df.agg(*[F.percentile(c, [i / bins for i in range(1, bins)]).alias(c) for c in features]).first()
    names = [f"{c}_{i}" for c in features for i in range(1, bins)]
    x = df.withColumns({f"{c}_{i}": (F.col(c) >= float(cuts[c][i - 1])).cast("double") for c in features for i in range(1, bins)})
    return Logistic(names).fit(x).score(x, "score").drop(*names)


def forest(df: DataFrame, features: list[str], trees: int = 40) -> DataFrame:
    """A random forest; the model's feature weights are in ``importances``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    x = _assembled(df, features)
    m = RandomForestClassifier(numTrees=trees, maxDepth=5, seed=1).fit(x.select("features", "label"))
    weights = F.array(*[F.lit(float(v)) for v in m.featureImportances.toArray()])
    return m.transform(x).select(*df.columns, vector_to_array("probability")[1].alias("score"), weights.alias("importances"))
