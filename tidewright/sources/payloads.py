"""Nested payloads and raw lines to flat tables, by built-in parsers; what does not parse is null or goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REPORTS = "struct<data:array<struct<_id:string,location:struct<coordinates:array<double>,address:string>,flood_time:struct<start_time:bigint>,water_level:string,flood_unit:string,flood_type:string,floodStatus:string,flood_location_details:string>>>"
_FORECAST = "array<struct<hourly:struct<time:array<string>,precipitation:array<double>>>>"
_ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"


def portal_reports(df: DataFrame, column: str) -> DataFrame:
    """Reports id, lat, lon, at (UTC+7), depth_cm, road, status, kind of a portal's payloads."""
    e = df.select(F.explode(F.from_json(column, _REPORTS)["data"]).alias("e")).select("e.*")
    deep = F.expr("try_cast(water_level as double)") * F.when(F.col("flood_unit") == "m", 100).otherwise(1)
    local = F.timestamp_seconds(F.col("flood_time.start_time")).cast("timestamp_ntz") + F.expr("interval 7 hours")
    where = F.col("location.coordinates")
    return e.select(
        F.col("_id").alias("id"), F.get(where, F.lit(1)).alias("lat"), F.get(where, F.lit(0)).alias("lon"), local.alias("at"), deep.alias("depth_cm"),
        F.coalesce("location.address", "flood_location_details").alias("road"), F.col("floodStatus").alias("status"), F.col("flood_type").alias("kind"),
    )


def gauge_readings(df: DataFrame, column: str, end: str) -> DataFrame:
    """(at, level in metres) of ``time,millimetres`` lines before ``end``; header, unit row and broken lines go."""
    part = F.split(column, ",")
    at = F.try_to_timestamp(F.get(part, F.lit(0)), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).cast("timestamp_ntz")
    level = F.get(part, F.lit(1)).try_cast("double") / 1000
    x = df.select(at.alias("at"), level.alias("level"))
    return x.filter(F.col("at").isNotNull() & F.col("level").isNotNull() & ~F.isnan("level") & (F.col("at") < F.lit(end).cast("timestamp_ntz"))).dropDuplicates(["at"])


def forecast(df: DataFrame, column: str) -> DataFrame:
    """(at, mm): the highest value over a forecast's points by hour."""
    h = df.select(F.explode(F.from_json(column, _FORECAST)).alias("p")).select(F.explode(F.arrays_zip(F.col("p.hourly.time").alias("t"), F.col("p.hourly.precipitation").alias("mm"))).alias("h"))
    at = F.to_timestamp_ntz(F.col("h.t"), F.lit("yyyy-MM-dd'T'HH:mm"))
    return h.groupBy(at.alias("at")).agg(F.max("h.mm").alias("mm"))


def ways(df: DataFrame, column: str) -> DataFrame:
    """(id, tags, line, closed) of the ways of a map extract."""
    e = df.select(F.explode(F.from_json(column, _ELEMENTS)["elements"]).alias("e")).select("e.*").filter("type = 'way'")
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return e.select("id", "tags", line.alias("line"), (F.element_at("geometry", 1) == F.element_at("geometry", -1)).alias("closed"))


def grid_points(boxes: DataFrame, step: float) -> DataFrame:
    """(model, lat, lon): the centres of a regular grid whose cells touch ``boxes(model, w, s, e, n)``."""
    first = lambda c: F.ceil((F.col(c) - step / 2) / step - 1e-10)
    last = lambda c: F.floor((F.col(c) + step / 2) / step + 1e-9)
    y = boxes.withColumn("_y", F.explode(F.sequence(first("s"), last("n")))).withColumn("_x", F.explode(F.sequence(first("w"), last("e"))))
    return y.select("model", F.round(F.col("_y") * step, 4).alias("lat"), F.round(F.col("_x") * step, 4).alias("lon"))


def hourly_files(spark, path: str, first: int, last: int, end: str) -> DataFrame:
    """(at, mm, lat, lon) of hourly tables partitioned by ``year``: other years are never opened; one row a cell and hour."""
    x = spark.read.parquet(path).filter(F.col("year").between(first, last)).filter(F.col("time") <= F.lit(end).cast("timestamp_ntz") + F.expr("interval 23 hours"))
    return x.select(F.col("time").alias("at"), F.col("precipitation").alias("mm"), F.col("latitude_returned").alias("lat"), F.col("longitude_returned").alias("lon")).dropDuplicates(["at", "lat", "lon"])
