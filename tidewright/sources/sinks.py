"""Sinks: Parquet, tab-separated metrics, JSON and GeoJSON; what is large is written by the tasks, single small documents
by the driver through Hadoop's file system, so any store that Spark knows can hold them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def feature_lines(df: DataFrame, geometry: str) -> DataFrame:
    """One GeoJSON feature a line; ``geometry`` is a struct column in GeoJSON's shape."""
    rest = [c for c in df.columns if c != geometry]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_features(df: DataFrame, geometry: str, path: str) -> None:
    """GeoJSON feature lines, gzipped, one file a task."""
    feature_lines(df, geometry).write.mode("overwrite").option("compression", "gzip").text(path)


def wkb(line) -> F.Column:
    """Little-endian well-known binary of an array of (x, y) as a line string."""
    reverse = lambda h: F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    number = lambda v: reverse(F.lpad(F.hex(_bits(v)), 16, "0"))
    count = F.lpad(F.hex(F.size(line).cast("long")), 8, "0")
    size = F.concat(*[F.substring(count, i, 2) for i in (7, 5, 3, 1)])
    points = F.array_join(F.transform(line, lambda p: F.concat(number(p["x"]), number(p["y"]))), "")
    return F.unhex(F.concat(F.lit("0102000000"), size, points))


def _bits(v) -> F.Column:
    """The 64 bits of a double as a long, by its exponent and fraction."""
    size = F.abs(v)
    power = F.when(size == 0, F.lit(0.0)).otherwise(F.floor(F.log2(size)))
    power = F.when(size / F.pow(F.lit(2.0), power) >= 2, power + 1).when(size / F.pow(F.lit(2.0), power) < 1, power - 1).otherwise(power)
    part = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(1 << 52))).cast("long")
    body = F.when(size == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(part))
    return F.when(v < 0, body.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), 63))).otherwise(body)


def write_geometry(df: DataFrame, path: str, *lines: str) -> None:
    """Parquet with line columns as well-known binary."""
    write_parquet(df.withColumns({c: wkb(F.col(c)) for c in lines}), path)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small document at once: written beside and renamed, so a reader never sees half of it."""
    fs, where = _file(spark, path)
    if not overwrite and fs.exists(where):
        raise FileExistsError(path)
    beside = where.suffix(".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"could not rename {beside} to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _file(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(where) else None


def write_status(spark: SparkSession, path: str, status: dict) -> None:
    write_text(spark, path, json.dumps(status, sort_keys=True))


def mark_once(spark: SparkSession, path: str, note: dict) -> None:
    """An exclusive marker, set before what may be read once only; a second time, or the later of two writers, raises."""
    fs, where = _file(spark, path)
    jvm = spark.sparkContext._jvm
    try:
        if fs.getUri().getScheme() == "file":
            none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(where.toUri().getPath()).toPath(), none)  # fails where it exists
            out = fs.create(where, True)
        else:
            out = fs.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
    out.close()


def freeze(spark: SparkSession, path: str, config: dict) -> dict:
    """A configuration kept from its first use on: an existing file wins over ``config``."""
    found = read_text(spark, path)
    if found is not None:
        return json.loads(found)
    write_text(spark, path, json.dumps(config, sort_keys=True))
    return config


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """A ledger as text columns; none where there is none.  One that a writer had set aside when it broke off comes back."""
    fs, where = _file(spark, path)
    aside = where.suffix(".before")
    if not fs.exists(where) and fs.exists(aside):
        fs.rename(aside, where)
    return spark.read.option("sep", "\t").option("header", True).csv(path) if fs.exists(where) else None


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows to a tab-separated ledger; a column that either side lacks is empty there.  The rewritten ledger takes
    the old one's place when it is whole; until then the old one is there, set aside for a moment at most."""
    spark = df.sparkSession
    fs, where = _file(spark, path)
    new = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    old = read_ledger(spark, path)
    beside, aside = where.suffix(".next"), where.suffix(".before")
    (new if old is None else old.unionByName(new, allowMissingColumns=True)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(beside.toString())
    delete(spark, aside.toString())
    if old is not None and not fs.rename(where, aside):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(beside, where):
        raise OSError(f"could not rename {beside} to {path}")
    delete(spark, aside.toString())


def markdown(title: str, df: DataFrame, most: int = 200) -> str:
    """A report table of a small aggregate; ``most`` rows are shown and the rest is counted."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"... of {df.count()} rows"] if len(rows) > most else [])) + "\n"
