"""Samples, folds and resampling weights from hashes: the same rows whatever the partitions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

#: Cumulative Poisson(1) probabilities.
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)


def _hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def hashed(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """At most ``most`` rows of least hash: a sample without replacement that needs no order of the whole table."""
    return df.withColumn("_h", _hash(key, seed)).orderBy("_h", key).limit(most).drop("_h")


def matched(df: DataFrame, id: str, key: str, rare: str, seed: int) -> DataFrame:
    """(id, key): for every key with rare rows, as many of its other rows by least hash, one at least."""
    want = df.groupBy(key).agg(F.count_if(F.col(rare)).alias("_n")).filter("_n > 0").withColumn("_n", F.greatest(F.lit(1), "_n"))
    rest = df.filter(~F.col(rare)).select(id, key, _hash(id, seed).alias("_h"), F.lit(1).alias("_one"))
    rest = stats.running(rest, "_h", {"_at": "_one"}, (key,))  # no key is ordered by one task
    return rest.join(want, key).filter("_at <= _n").select(id, key)


def blocks(df: DataFrame, size: float) -> DataFrame:
    return df.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by_", F.floor(F.col("y") / size))


def folds(df: DataFrame, size: float, k: int) -> DataFrame:
    """``df(x, y, ...)`` with a fold of whole blocks: the largest block first, to the fold with the fewest rows so far;
    equal blocks by their hash.  The blocks of a city are few hundreds and are dealt on the driver."""
    cut = blocks(df, size)
    counts = [(r["bx"], r["by_"], r["n"]) for r in cut.groupBy("bx", "by_").agg(F.count(F.lit(1)).alias("n")).collect()]
    load, dealt = [0] * k, []
    for x, y, n in sorted(counts, key=lambda b: (-b[2], int(hashlib.sha1(f"{b[0]}:{b[1]}".encode()).hexdigest()[:8], 16))):
        fold = min(range(k), key=lambda f: load[f])
        load[fold] += n
        dealt.append((x, y, fold))
    table = df.sparkSession.createDataFrame(dealt, "bx long, by_ long, fold int")
    return cut.join(F.broadcast(table), ["bx", "by_"])


def weighted(df: DataFrame, key: Column, reps: int) -> DataFrame:
    """``df`` once a replicate, with a Poisson weight ``w`` hashed from key and replicate."""
    x = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", key, F.col("rep").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return x.withColumn("w", sum((F.when(u >= int(p * 2**32), 1).otherwise(0) for p in POISSON), F.lit(0)))


def resampled(df: DataFrame, key: Column, reps: int, means: dict[str, str]) -> DataFrame:
    """(rep, ...) weighted means of columns (new name: column) with weights shared between them."""
    x = weighted(df, key, reps)
    return x.groupBy("rep").agg(*[F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(n) for n, c in means.items()])
