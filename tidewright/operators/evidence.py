"""Report handling: status, greedy dedup, odds update, displayed level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Factors on the odds and the half-life in minutes.
FLOODED, OFFICIAL, HALF_LIFE = 3.0, 10.0, 30.0


def deduplicate(df: DataFrame, minutes: int = 30) -> DataFrame:
    """(user_id, route_id, ts) of kept reports: a report stays if the last kept one is at least ``minutes`` older.

    A report that far after the one before it always stays, so only the chains between such reports are folded."""
    w = Window.partitionBy("user_id", "route_id").orderBy("ts")
    far = F.coalesce(F.col("ts") >= F.lag("ts").over(w) + F.expr(f"interval {minutes} minutes"), F.lit(True))
    rows = df.select("user_id", "route_id", "ts").filter("ts is not null").distinct().withColumn("_far", far.cast("long"))
    rows = rows.withColumn("_chain", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("user_id", "route_id", "_chain").agg(F.sort_array(F.collect_list("ts")).alias("all"))
    step = F.expr(f"aggregate(all, cast(array() as array<timestamp_ntz>), (k, t) -> case when size(k) = 0 or t >= element_at(k, -1) + interval {minutes} minutes then array_append(k, t) else k end)")
    return rows.select("user_id", "route_id", F.explode(step).alias("ts"))


def kept(df: DataFrame, tie: str, minutes: int = 30) -> DataFrame:
    """The whole rows that ``deduplicate`` keeps; of equal times the one with the least ``tie``."""
    first = df.groupBy("user_id", "route_id", "ts").agg(F.min(tie).alias(tie))
    return df.join(deduplicate(df, minutes), ["user_id", "route_id", "ts"], "left_semi").join(first, ["user_id", "route_id", "ts", tie], "left_semi")


def log_odds(df: DataFrame, at: str) -> DataFrame:
    """Per route: decayed sum of log factors of reports not after ``at`` (flooded x3, official x10, dry /3)."""
    age = (F.unix_micros(F.lit(at).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(6e7)
    factor = F.when(F.col("status") == "dry", F.lit(1 / FLOODED)).when(F.col("official"), F.lit(OFFICIAL)).otherwise(F.lit(FLOODED))
    use = df.filter(F.col("status").isNotNull() & (F.col("ts") <= F.lit(at).cast("timestamp_ntz")))
    return use.groupBy("route_id").agg(F.sum(F.log(factor) * F.pow(F.lit(0.5), age / HALF_LIFE)).alias("shift"), F.count(F.lit(1)).alias("n"))


def updated(p: Column, shift: Column) -> Column:
    x = F.log(p / (1 - p)) + F.coalesce(shift, F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))))


def modal_level(df: DataFrame, key: str, severity: Column) -> DataFrame:
    """Most frequent severity of a key; ties go to the higher."""
    counts = df.withColumn("severity", severity).groupBy(key, "severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", "severity")).alias("m")).select(key, F.col("m.severity").alias("severity"), F.col("m.n").alias("n"))
