"""Checks inside the plan: a violated one fails the job, so no second pass over the data is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that no model may see.
FORBIDDEN = frozenset({"route_id", "geometry", "name", "name_norm", "ward_id", "district_id", "lat", "lon", "x", "y", "block_id", "fold", "city", "highway_class"})


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` one row a key; a repeated key raises."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    ok = F.assert_true(F.col("_n") == 1, F.lit(f"repeated key {', '.join(keys)}"))
    return one.filter(ok.isNull()).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose right side has one row a key at most."""
    return left.join(unique(right, *keys), keys, how)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return unique(left, *keys).join(unique(right, *keys), keys, how)


def is_subset(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """One row: how many distinct keys of ``part`` are missing in ``whole``, and whether none is."""
    missing = part.select(*keys).distinct().join(whole.select(*keys).distinct(), list(keys), "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("is_subset", F.col("missing") == 0)


def model_columns(columns: list[str], hidden: tuple[str, ...] = ()) -> list[str]:
    """``columns`` without those a model must not see."""
    return [c for c in columns if c not in FORBIDDEN and c not in hidden]


def assert_allowed(columns: list[str]) -> None:
    bad = sorted(FORBIDDEN.intersection(columns))
    if bad:
        raise ValueError(f"forbidden columns: {bad}")


def within(lon, lat, west: float, south: float, east: float, north: float):
    return lon.between(west, east) & lat.between(south, north)
