"""Ordered operators over hourly and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def full_window(agg, value: str, window, rows: int) -> Column:
    """An aggregate over a window, null unless it holds ``rows`` non-null values."""
    return F.when(F.count(value).over(window) == rows, agg(value).over(window))


def day_confined(df: DataFrame, hours: int, out: str) -> DataFrame:
    """Rolling sum over ``hours`` rows of (cell, hour, mm) that never crosses midnight."""
    w = Window.partitionBy("cell", F.to_date("hour")).orderBy("hour").rowsBetween(1 - hours, 0)
    return df.withColumn(out, F.when(F.hour("hour") >= hours - 1, full_window(F.sum, "mm", w, hours)))


def spine(df: DataFrame, key: str, date: str) -> DataFrame:
    """Every day from a key's first to its last."""
    ends = df.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return ends.select(key, F.explode(F.sequence("_a", "_b")).alias(date))


def antecedent(df: DataFrame, days: int, out: str) -> DataFrame:
    """Sum over the ``days`` days before each (cell, date, mm)."""
    w = Window.partitionBy("cell").orderBy("date").rowsBetween(-days, -1)
    return df.withColumn(out, full_window(F.sum, "mm", w, days))


def islands(df: DataFrame, key: str, order: str, gap: Column) -> DataFrame:
    """``island`` numbers runs of rows; ``gap`` is true where a new run begins."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("island", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
