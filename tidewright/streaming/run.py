"""Run a streaming job over a table to its end, into files of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import staged_path


def drained(spark: SparkSession, sf_dir: str, job, mode: str, late: str) -> DataFrame:
    """All final rows of ``job`` over the events; one far later marker row, dropped again, closes the last windows."""
    path = staged_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    marker = events.limit(1).withColumn("ts", F.lit("2200-01-01").cast("timestamp_ntz")).withColumn("event_type", F.lit("\x00"))
    events.write.parquet(f"{path}/in/0")
    marker.write.parquet(f"{path}/in/1")
    source = spark.readStream.schema(events.schema).parquet(f"{path}/in/*")
    started = job(source, late).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state")
    started.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").filter(F.col("cell") != "\x00")


def latest(spark: SparkSession, rows: DataFrame, job, key: str) -> DataFrame:
    """The last row by ``key`` that ``job`` emits in update mode over ``rows``; a repeated batch overwrites its own folder."""
    path = staged_path(spark, "stream")
    rows.write.parquet(f"{path}/in")
    out = job(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    spark.createDataFrame([], out.schema).withColumn("batch", F.lit(-1).cast("long")).write.parquet(f"{path}/out/none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/{number}")

    started = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep)
    started.trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{path}/out/*")
    last = F.max_by(F.struct(*[c for c in out.columns if c != key]), "batch").alias("last")
    return seen.groupBy(key).agg(last).select(key, "last.*")
