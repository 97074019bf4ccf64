"""Staged tables that later runs find again: named by the input files as they are and by what is done with them."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import delete, shared_dir


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file that ``df`` reads."""
    out = []
    for path in sorted(df.inputFiles()):
        fs, where = _fs(df.sparkSession, path)
        status = fs.getFileStatus(where)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def plan_text(df: DataFrame) -> str:
    """The analysed plan without the numbers that differ from run to run; all its fields are told."""
    spark, key = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(1 << 20))
    try:
        text = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return re.sub(r"#\d+L?|plan_id=\d+|lambda_?\d+|@[0-9a-f]+", "", text)


def signature(df: DataFrame, *parts) -> str:
    """A key of the input files, the plan and ``parts``; parts tell what a plan does not: the version of Python functions,
    or rows that come from no file, which need at least one."""
    read = files(df)
    if not parts and (not read or "LocalRelation" in plan_text(df) or "LogicalRDD" in plan_text(df)):
        raise ValueError("rows that come from no file need a part that names them")
    told = json.dumps([read, plan_text(df), df.schema.json(), [str(p) for p in parts]])
    return hashlib.sha256(told.encode()).hexdigest()


def staged_once(df: DataFrame, name: str, *parts, keep: int = 8, idle: float = 86_400.0) -> DataFrame:
    """``df`` from the shared folder, written there by the first run that asks for this signature.

    A table is written beside and renamed, so no reader finds half of it and of two writers one wins.  Of each name the
    ``keep`` tables used last stay, and others until nobody has asked for them for ``idle`` seconds.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/reuse/{name}"
    path = f"{top}/{signature(df, *parts)}"
    fs, where = _fs(spark, path)
    if not fs.exists(_fs(spark, f"{path}/_SUCCESS")[1]):
        beside = f"{top}/.{uuid.uuid4().hex}"
        df.write.parquet(beside)
        if fs.exists(where) or not fs.rename(_fs(spark, beside)[1], where):
            delete(spark, beside)
    fs.setTimes(_fs(spark, f"{path}/_SUCCESS")[1], int(time.time() * 1000), -1)
    evict(spark, name, keep, idle)
    return spark.read.schema(df.schema).parquet(path)


def evict(spark: SparkSession, name: str, keep: int, idle: float) -> list[str]:
    """Delete the tables of a name beyond the ``keep`` used last that nobody asked for in ``idle`` seconds."""
    fs, top = _fs(spark, f"{shared_dir(spark).rstrip('/')}/reuse/{name}")
    used = []
    for s in fs.listStatus(top) if fs.exists(top) else []:
        mark = _fs(spark, f"{s.getPath().toString()}/_SUCCESS")[1]
        if not s.getPath().getName().startswith(".") and fs.exists(mark):
            used.append((fs.getFileStatus(mark).getModificationTime(), s.getPath().toString()))
    gone = [p for at, p in sorted(used, reverse=True)[keep:] if at < (time.time() - idle) * 1000]
    for p in gone:
        delete(spark, p)
    return gone
