"""Ranks, distributions and ranking metrics without single-partition windows.

Values are aggregated first; running totals over them go in two levels: inside ranges of about equal size, and over
the few range totals.  So no task holds more than a range of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import staged



def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in as many ranges of ``order`` as the session has shuffle partitions, numbered in ``_b``: range edges come
    from a sample, so no outlier and no dense stretch fills one range alone.  Staged, as a range must not move when its
    rows are read twice."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id()), "ranged")


def running(df: DataFrame, by: str, sums: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with inclusive running totals ``sums`` (new name: column) in the order of the distinct values ``by``."""
    rows = ranged(df, F.col(by))
    total = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*keys, "_b", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_o{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    joined = rows.join(F.broadcast(offset), [*keys, "_b"])  # a row for each range of a key
    return joined.select(*df.columns, *[(F.col(f"_o{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, c, le, n): count of a distinct non-null value, rows at most it, and all rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    n = counts.agg(F.sum("c").alias("n"))
    return running(counts, value, {"le": "c"}).crossJoin(F.broadcast(n))


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact quantiles (new name: share) of the non-null values, between the two rows around as ``percentile``
    tells; from running counts of distinct values, so no task holds them all.  Without values all are null."""
    r = value_ranks(df.select(F.col(value).cast("double").alias("_v")), "_v")
    out = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("n") - 1)  # the place among the rows, from 0
        holds = lambda k: (F.col("le") > k) & (F.col("le") - F.col("c") <= k)
        low, high = (F.max(F.when(holds(f(at)), F.col("_v"))) for f in (F.floor, F.ceil))
        at = F.lit(q) * (F.max("n") - 1)
        between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        out.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise(between).alias(name))
    return r.agg(*out)


def percent_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-rank percentile over non-null rows; null stays null."""
    r = value_ranks(df, value).withColumn(out, (F.col("le") - (F.col("c") - 1) / F.lit(2.0)) / F.col("n"))
    return df.join(r.select(value, out), value, "left")


def ecdf(df: DataFrame, value: str, out: str) -> DataFrame:
    r = value_ranks(df, value).withColumn(out, F.col("le") / F.col("n").cast("double"))
    return df.join(r.select(value, out), value, "left")


def foreign_le(ref: DataFrame, probe: DataFrame, value: str) -> DataFrame:
    """(value, le) for every distinct probe value: reference rows at most it, by one merged running total."""
    marks = ref.select(value, F.lit(1).alias("k")).union(probe.select(value, F.lit(0)))
    marks = marks.filter(F.col(value).isNotNull()).groupBy(value).agg(F.sum("k").alias("k"), F.bool_or(F.col("k") == 0).alias("_asked"))
    return running(marks, value, {"le": "k"}).filter("_asked").select(value, "le")


def row_ranks(df: DataFrame, score: str, *ties: Column, out: str = "rn", keys: tuple[str, ...] = ()) -> DataFrame:
    """Row number by ``score`` descending, then ``ties``, within ``keys``; rows without a score go.  Ranges are cut by score
    and ties, so neither equal scores nor the rows of a key need be in one task."""
    order = [F.desc(score), *ties]
    rows = ranged(df.filter(F.col(score).isNotNull()), *order)
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of a key
    start = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = start.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    same = F.col("_b") == F.col("_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    joined = rows.withColumn("_in", inside).join(F.broadcast(start), same)
    return joined.withColumn(out, F.col("_above") + F.col("_in")).select(*df.columns, out)


def rank_bins(rn: Column, n: Column, q: int) -> Column:
    """Equal-count bin 0..q-1 of a row number: the least k with rn * q <= q + (n - 1) * (k + 1)."""
    return F.greatest(F.lit(0), F.ceil((rn - 1) * q / (n - 1).cast("double")) - 1)


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear, clamped; a repeated knot takes its last value."""
    out = F.when(x < xs[0], F.lit(ys[0]))
    for k in range(len(xs) - 1):
        if xs[k + 1] > xs[k]:
            line = ys[k] + (x - xs[k]) * ((ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]))
            out = out.when((x >= xs[k]) & (x < xs[k + 1]), line)
    return F.when(x.isNotNull(), out.otherwise(F.lit(ys[-1])))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the curve by mid-ranks."""
    by = df.groupBy(score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("c"))
    r = running(by, score, {"le": "c"}).withColumn("mid", F.col("le") - (F.col("c") - 1) / F.lit(2.0))
    pos, n, ranks = F.sum("p"), F.sum("c"), F.sum(F.col("mid") * F.col("p"))
    return r.agg(((ranks - pos * (pos + 1) / F.lit(2.0)) / (pos * (n - pos))).alias("auc"), pos.alias("n_pos"), n.alias("n"))


def descending(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores from the highest: tp and seen running counts, with their own p and c."""
    by = df.groupBy((-F.col(score)).alias("neg")).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("c"))
    return running(by, "neg", {"tp": "p", "seen": "c"})


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    r = descending(df, score, label)
    return r.agg((F.sum(F.col("p") * F.col("tp") / F.col("seen").cast("double")) / F.sum("p")).alias("ap"))


def recall_at(df: DataFrame, score: str, label: str, share: float) -> DataFrame:
    """Share of positives in the top ``share`` of rows; ties at the edge count in proportion."""
    r = descending(df, score, label)
    n = r.agg(F.sum("c").alias("n"), F.sum("p").alias("pos"))
    take = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)))
    inside = F.least(F.greatest(take - (F.col("seen") - F.col("c")), F.lit(0)), F.col("c"))
    return r.crossJoin(F.broadcast(n)).agg((F.sum(F.col("p") * inside / F.col("c").cast("double")) / F.first("pos")).alias("recall"))


def group_metrics(df: DataFrame, group: str, score: str, label: str, share: float = 0.1) -> DataFrame:
    """By group: pos, n, auc, ap, recall at the top ``share`` with ties in proportion, lift.  Rows collapse to distinct
    scores first; running totals go over buckets of them."""
    by = df.groupBy(group, score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("c"))
    by = by.withColumn("z", F.col("c") - F.col("p"))
    up = running(by, score, {"zc": "z", "cc": "c", "pc": "p"}, (group,))
    total = by.groupBy(group).agg(F.sum("p").alias("pos"), F.sum("z").alias("neg"), F.sum("c").alias("n"))
    x = up.join(F.broadcast(total), group)
    tp, seen = F.col("pos") - F.col("pc") + F.col("p"), F.col("n") - F.col("cc") + F.col("c")
    below = F.col("zc") - F.col("z") / F.lit(2.0)
    inside = F.least(F.greatest(share * F.col("n") - (seen - F.col("c")), F.lit(0.0)), F.col("c").cast("double"))
    out = x.groupBy(group).agg(
        F.first("pos").alias("pos"), F.first("n").alias("n"),
        F.try_divide(F.sum(F.col("p") * below), (F.first("pos") * F.first("neg")).cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("p") * tp / seen.cast("double")), F.first("pos").cast("double")).alias("ap"),
        F.try_divide(F.sum(F.col("p") * inside / F.col("c")), F.first("pos").cast("double")).alias("recall"),
    )
    return out.withColumn("lift", F.try_divide(F.col("recall"), F.col("pos") / F.col("n").cast("double")))


def feature_audit(df: DataFrame) -> DataFrame:
    """``df(dim, v, y)``, long: dim, auc in its better direction, direction, recall in the top tenth (ties in proportion)."""
    by = df.filter("v is not null").groupBy("dim", "v").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    by = by.withColumn("z", F.col("c") - F.col("p"))
    up = running(by, "v", {"zc": "z", "cc": "c"}, ("dim",))
    x = up.join(F.broadcast(by.groupBy("dim").agg(F.sum("c").alias("n"))), "dim")
    take = F.ceil(0.1 * F.col("n"))
    share = lambda before: F.sum(F.col("p") * F.least(F.greatest(take - before, F.lit(0)), F.col("c")) / F.col("c").cast("double")) / F.sum("p")
    m = x.groupBy("dim").agg(
        (F.sum(F.col("p") * (F.col("zc") - F.col("z") / F.lit(2.0))) / (F.sum("p") * F.sum("z"))).alias("a"),
        share(F.col("n") - F.col("cc")).alias("hi"), share(F.col("cc") - F.col("c")).alias("lo"),
    )
    high = F.col("a") >= 0.5
    return m.select("dim", F.greatest("a", 1 - F.col("a")).alias("auc"), F.when(high, "high").otherwise("low").alias("direction"), F.when(high, F.col("hi")).otherwise(F.col("lo")).alias("recall"))
