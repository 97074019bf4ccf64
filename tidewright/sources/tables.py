"""Scans.  The star-schema tables stand in for the domain's: parts are routes, filtered line items are reports,
events are hourly measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("p_type") != "ECONOMY") & (F.col("p_size") >= 5)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("route_id"), F.col("p_brand").alias("ward"), F.col("p_type").alias("class"),
        F.col("p_size").alias("length"), F.col("p_retailprice").alias("raw"), inside.alias("in_universe"),
    )


def cause_of(flag: Column) -> Column:
    return F.when(flag == "A", "rain").when(flag == "N", "tide").when(flag == "R", "combined").otherwise("unknown")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.085))
    return rows.select(
        F.col("l_partkey").alias("route_id"), F.col("l_shipdate").cast("date").alias("date"),
        cause_of(F.col("l_returnflag")).alias("cause"), F.col("l_quantity").alias("depth_cm"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of values by cell (event type) and hour."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("cell"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("mm"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view", "purchase"), "flooded").when(kind == "error", "dry")
    return table(spark, sf_dir, "events").select(
        "user_id", (F.col("event_id") % 50).alias("route_id"), "ts", "value", status.alias("status"), (kind == "purchase").alias("official"),
    )


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items before the cut-off: the only rows that fitting may see."""
    return table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(CUTOFF).cast("timestamp_ntz"))
