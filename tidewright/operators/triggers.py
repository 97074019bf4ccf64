"""Day triggers: stored kinds as columns, quantile grids from ranks, and the search for their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(q: Column) -> Column:
    """Log odds of a share kept between 0.001 and 0.999."""
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), q))
    return F.log(p / (1 - p))


def apply(params: dict, values: list[Column]) -> Column:
    """The probability that a stored trigger tells for its feature columns.

    Kinds: constant, zero, logistic (mean, scale, coef, intercept; ``log``: of log(1 + x); a missing value is the
    mean), isotonic (x, y), percentile (knots: evenly spaced quantiles).
    """
    kind = params["kind"]
    if kind == "constant":
        return F.lit(float(params["value"]))
    if kind == "zero":
        return F.lit(0.0)
    if kind == "logistic":
        z = F.lit(float(params["intercept"]))
        for v, mean, scale, coef in zip(values, params["mean"], params["scale"], params["coef"], strict=True):
            missing = v.isNull() | F.isnan(v)
            v = F.log1p(F.greatest(v, F.lit(0.0))) if params.get("log") else v
            z = z + (F.when(missing, F.lit(float(mean))).otherwise(v) - mean) / scale * coef
        return expit(z)
    if kind == "isotonic":
        return stats.interpolate(values[0], params["x"], params["y"])
    if kind == "percentile":
        knots = params["knots"]
        at = stats.interpolate(values[0], knots, [i / (len(knots) - 1) for i in range(len(knots))])
        at = F.when(values[0] < knots[0], F.lit(0.0)).otherwise(at)
        return expit((at - 0.95) / 0.02)
    raise ValueError(kind)


def trailing_windows(city: DataFrame, at: str, horizons: int) -> DataFrame:
    """(horizon_h, valid_time, max_3h, total_24h) of ``city(hour, mm)``: the highest three hours of the last six, and a
    day's sum.  Fewer than six hours with rain known fail the job."""
    start = F.lit(at).cast("timestamp_ntz")
    rows = city.filter((F.col("hour") > start - F.expr("interval 24 hours")) & (F.col("hour") <= start + F.expr(f"interval {horizons} hours")) & F.col("mm").isNotNull())
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizons - 1))))
    rows = rows.withColumn("valid_time", start + F.make_dt_interval(F.lit(0), F.col("h")))
    rows = rows.filter((F.col("hour") <= F.col("valid_time")) & (F.col("hour") > F.col("valid_time") - F.expr("interval 24 hours")))
    late = F.col("hour") > F.col("valid_time") - F.expr("interval 6 hours")
    w = Window.partitionBy("h", "_late").orderBy("hour").rowsBetween(-2, 0)  # at most 24 rows
    rows = rows.withColumn("_late", late).withColumn("_s", F.when(F.count("mm").over(w) == 3, F.sum("mm").over(w)))
    out = rows.groupBy(F.col("h").alias("horizon_h"), "valid_time").agg(F.count_if(F.col("_late")).alias("n"), F.round(F.max(F.when(F.col("_late"), F.col("_s"))), 9).alias("max_3h"), F.round(F.sum("mm"), 9).alias("total_24h"))
    return out.filter(F.assert_true(F.col("n") >= 6, F.lit("fewer than six hours of rain")).isNull()).drop("n")


def quantile_grid(df: DataFrame, value: str, parts: int) -> DataFrame:
    """(i, q) for i = 0 .. parts: linearly interpolated quantiles.  Ranks of the distinct values meet the few wanted
    places, so no task sorts or holds all values."""
    ranks = stats.value_ranks(df, value).select(F.col(value).alias("v"), (F.col("le") - F.col("c")).alias("lo"), (F.col("le") - 1).alias("hi"), "n")
    at = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.struct(i.alias("i"), (i * (F.col("n") - 1) / F.lit(float(parts))).alias("pos")))
    inside = lambda p: (F.floor(p["pos"]) <= F.col("hi")) & (F.least(F.floor(p["pos"]) + 1, F.col("n") - 1) >= F.col("lo"))
    x = ranks.withColumn("p", F.explode(F.filter(at, inside))).select("v", "lo", "hi", "n", F.col("p.i").alias("i"), F.col("p.pos").alias("pos"))
    low = F.max(F.when((F.floor("pos") >= F.col("lo")) & (F.floor("pos") <= F.col("hi")), F.col("v")))
    next_ = F.least(F.floor("pos") + 1, F.col("n") - 1)
    high = F.max(F.when((next_ >= F.col("lo")) & (next_ <= F.col("hi")), F.col("v")))
    x = x.groupBy("i", "pos").agg(low.alias("a"), high.alias("b"))
    return x.select("i", (F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))).alias("q"))


def _curve(df: DataFrame, parts: int, gap: bool) -> DataFrame:
    """(hi, sens, quiet) for every distinct quantile limit of ``df(t, pos, neg)``; scores collapse to distinct values."""
    by = df.filter("t is not null").groupBy("t").agg(F.count_if("pos").alias("p"), F.count_if("neg").alias("z"))
    limits = quantile_grid(df, "t", parts).select(F.col("q").alias("hi")).distinct()
    width = F.greatest(F.lit(1e-6), 0.01 * (F.max("t") - F.min("t"))) if gap else F.lit(0.0)
    limits = limits.crossJoin(F.broadcast(by.agg(width.alias("gap"), F.sum("p").alias("n_pos"), F.sum("z").alias("n_neg"))))
    x = by.crossJoin(F.broadcast(limits))  # parts + 1 limits at most
    sens = F.sum(F.when(F.col("t") >= F.col("hi"), F.col("p")).otherwise(0)) / F.first("n_pos").cast("double")
    quiet = F.sum(F.when(F.col("t") < F.col("hi") - F.col("gap"), F.col("z")).otherwise(0)) / F.first("n_neg").cast("double")
    return x.groupBy("hi").agg(sens.alias("sens"), quiet.alias("quiet"))


def _best(curve: DataFrame, sens: float, quiet: float, ties: tuple[str, ...]) -> DataFrame:
    x = curve.withColumn("ok", (F.col("sens") >= sens) & (F.col("quiet") >= quiet))
    worst = F.least(F.col("sens") / sens, F.col("quiet") / quiet)
    rank = F.struct(F.col("ok"), F.when(F.col("ok"), F.col("hi")).alias("a"), *[F.when(F.col("ok"), F.col(c)).alias(f"t_{c}") for c in ties], F.when(~F.col("ok"), worst).alias("b"), F.when(~F.col("ok"), F.col("sens") + F.col("quiet")).alias("c"), F.col("hi").alias("d"))
    return x.agg(F.max_by(F.struct("hi", "sens", "quiet", "ok"), rank).alias("m")).select("m.*")


def choose_limits(df: DataFrame, parts: int, sens: float, quiet: float) -> DataFrame:
    """One row hi, sens, quiet, ok: the highest limit with both targets met (quiet counted a gap below it), else the best
    of the worse ratio, of the sum, of the limit."""
    return _best(_curve(df, parts, True), sens, quiet, ("quiet", "sens"))


def watch_and_alert(df: DataFrame, parts: int, sens: float, quiet: float, watch: float) -> DataFrame:
    """One row alert, watch, sens, quiet, ok: the alert limit, and the highest limit up to it that finds ``watch``."""
    curve = _curve(df, parts, False)
    best = _best(curve, sens, quiet, ())
    low = curve.crossJoin(F.broadcast(best.select(F.col("hi").alias("alert")))).filter((F.col("sens") >= watch) & (F.col("hi") <= F.col("alert"))).agg(F.max("hi").alias("watch"))
    x = best.crossJoin(F.broadcast(low))
    return x.select(F.col("hi").alias("alert"), F.coalesce("watch", F.least(F.lit(0.0), F.col("hi"))).alias("watch"), "sens", "quiet", "ok")
