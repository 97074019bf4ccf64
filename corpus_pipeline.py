"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import saved
from tidewright.llm.decontam import decontaminate
from tidewright.llm.mixing import mixing_rates
from tidewright.llm.near_dedup import near_duplicates
from tidewright.llm.quality_rules import quality_rules
from tidewright.llm.queries import SHARDS, TARGETS, language_labels
from tidewright.llm.sharding import assign_shards

#: Links of the stage, in percent; the contract of op3 has its own.
SIMILAR = 80


def _rows(docs: DataFrame) -> DataFrame:
    """(id, row) of every row of ``docs``: doc_id where it names one row each, else a staged number in its order."""
    its = F.col("doc_id").try_cast("long")
    row = F.struct(*docs.columns).alias("row")
    if docs.groupBy(its.alias("id")).count().filter("count > 1 or id is null").isEmpty():
        return docs.select(its.alias("id"), row)
    order = F.col("row.doc_id").asc_nulls_last(), F.col("id")
    spread = docs.select(F.monotonically_increasing_id().alias("id"), row).repartitionByRange(*order)
    return saved(spread.sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "row"), "rows")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), "row.text")


def _without(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The ``rows`` whose id is not a doc_id of ``found``."""
    return rows.join(found.select(F.col("doc_id").alias("id")), "id", "left_anti").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; each row is judged by its own text, and one without words goes."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    judged = quality_rules(row, carry="row")
    # Always true; not deterministic, so the filter stays above the projections that compute each metric once.
    return judged.withColumn("kept", F.col("kept") & (F.spark_partition_id() >= 0)).filter("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least doc_id, none being last, the first of equal ones.

    Rows that repeat a doc_id, or have none, are judged by their own texts; rows without words are in no group and stay.
    """
    rows = _rows(docs)
    return _without(rows, near_duplicates(_texts(rows), SIMILAR).filter("not kept"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark; each is judged by its own text, also where a doc_id repeats."""
    rows = _rows(docs)
    found = decontaminate(_texts(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.filter("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as their rate says; the total is such that no language shrinks, so rows stay.

    Rows that repeat a doc_id, or have none, have rates of their own; rows without words stay as they are.
    """
    rows = _rows(docs)
    known = rows.select(F.col("id"), "row.doc_id", "row.lang")
    labelled = language_labels(known, spark.read.parquet(f"{sf_dir}/labels.parquet"), "id")
    rates = mixing_rates(_texts(rows), labelled, TARGETS, keep_all=True)
    copies = rates.select(F.col("doc_id").alias("id"), F.greatest(F.lit(1), "copies").alias("copies"))
    return rows.join(copies, "id").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard; rows without a doc_id share one."""
    return assign_shards(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Near duplicates are no SQL query; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
