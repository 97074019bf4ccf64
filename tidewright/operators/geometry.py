"""Lines and areas on plane coordinates as arrays of (x, y): lengths, sampling, clipping, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(line: Column) -> Column:
    """Consecutive point pairs with each one's length and the length before it."""
    n = F.size(line)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(line, i).alias("a"), F.element_at(line, i + 1).alias("b"))))
    size = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    return F.transform(pairs, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), size(s).alias("length")))


def length(line: Column) -> Column:
    return F.aggregate(F.coalesce(segments(line), F.array()), F.lit(0.0), lambda t, s: t + s["length"])


def area(ring: Column) -> Column:
    """Area inside a closed ring (shoelace)."""
    cross = F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v)) / 2


def point_at(line: Column, at: Column) -> Column:
    """The point ``at`` along a line; clamped to its ends."""
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(line, 1)["x"].alias("x"), F.element_at(line, 1)["y"].alias("y"))

    def step(t, s):
        share = F.when(s["length"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - t["done"]) / s["length"]))).otherwise(F.lit(0.0))
        inside = at > t["done"]
        x = F.when(inside, s["a"]["x"] + share * (s["b"]["x"] - s["a"]["x"])).otherwise(t["x"])
        y = F.when(inside, s["a"]["y"] + share * (s["b"]["y"] - s["a"]["y"])).otherwise(t["y"])
        return F.struct((t["done"] + s["length"]).alias("done"), x.alias("x"), y.alias("y"))

    return F.aggregate(segments(line), start, step)


def sample_line(df: DataFrame, line: str, step: float) -> DataFrame:
    """``df`` with a row for a point (at, x, y) every ``step`` along the line, and its end; lines without length have none."""
    x = df.withColumn("_n", length(F.col(line))).filter("_n > 0")
    places = F.concat(F.transform(F.sequence(F.lit(0), (F.ceil(F.col("_n") / step) - 1).cast("int")), lambda i: i * F.lit(step)), F.array("_n"))
    x = x.withColumn("at", F.explode(places)).withColumn("_p", point_at(F.col(line), F.col("at")))
    return x.withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_n", "_p")


def clip_to_cells(df: DataFrame, size: float, *ends: str) -> DataFrame:
    """Segments (ax, ay, bx, by) cut at the grid's lines: a row a piece with its cell (gx, gy), length, and where ``ends``
    names two columns, the shares of the segment's way at which it begins and ends."""

    def crossings(a: str, b: str) -> Column:
        lo, hi = F.ceil(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)
        at = F.transform(F.sequence(lo, hi), lambda k: (k * F.lit(size) - F.col(a)) / (F.col(b) - F.col(a)))
        return F.when((F.col(a) != F.col(b)) & (lo <= hi), F.filter(at, lambda u: (u > 0) & (u < 1))).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("ax", "bx"), crossings("ay", "by"))))
    x = df.withColumn("_u", cuts)
    x = x.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size("_u") - 1), lambda i: F.struct(F.element_at("_u", i).alias("u"), F.element_at("_u", i + 1).alias("v")))))
    mid, share = (F.col("_p.u") + F.col("_p.v")) / 2, F.col("_p.v") - F.col("_p.u")
    cell = lambda a, b: F.floor((F.col(a) + mid * (F.col(b) - F.col(a))) / size)
    full = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    x = x.withColumn("gx", cell("ax", "bx")).withColumn("gy", cell("ay", "by")).withColumn("length", share * full)
    return x.withColumns(dict(zip(ends, (F.col("_p.u"), F.col("_p.v")), strict=bool(ends)))).drop("_u", "_p")


def water_classes(waterway: Column, natural: Column, is_area: Column, size: Column) -> list[Column]:
    """any_water, major_water and coast of a map feature."""
    w, n = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (waterway, natural))
    filled = is_area & ((n == "water") | w.isin("riverbank", "water"))
    line = ~is_area & (w != "")
    major = (filled & (size > 10000)) | (line & w.isin("river", "canal"))
    return [(filled | line).alias("any_water"), major.alias("major_water"), ((n == "coastline") & ~is_area).alias("coast")]
