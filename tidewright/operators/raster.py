"""Grids: box sums as long tables, and the sequential kernels for one grid in a grouped task."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .geometry import clip_to_cells


def box_mean(grid: DataFrame, reach: int) -> DataFrame:
    """Mean and count of (r, c, v) over the square of side 2 * reach + 1 around every cell: a sum down, then across."""
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    down = grid.withColumn("_d", step).groupBy((F.col("r") + F.col("_d")).alias("r"), "c").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    box = down.withColumn("_d", step).groupBy("r", (F.col("c") + F.col("_d")).alias("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return grid.join(box, ["r", "c"]).select("r", "c", (F.col("s") / F.col("n")).alias("mean"), F.col("n").cast("long").alias("n"))


def local_share(grids: DataFrame, reach: int, bins: int) -> DataFrame:
    """``grids(grid, r, c, v)`` with ``share``: of the cells in the square around each, how many lie at most at the upper
    limit of its value's bin; bins are even parts of a grid's range, and a grid of one value has 0.5.

    Values become levels, levels are counted down the columns and then across, so no task holds a grid.
    """
    range_ = grids.groupBy("grid").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = grids.join(range_, "grid")
    wide = F.col("hi") - F.col("lo")
    own = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("lo"), wide) * bins))
    limit = lambda k: F.col("lo") + (k + 1) * wide / bins
    x = x.withColumn("own", F.coalesce(own, F.lit(0)))
    level = F.when(F.col("v") <= limit(F.col("own") - 1), F.col("own") - 1).when(F.col("v") <= limit(F.col("own")), F.col("own")).otherwise(F.col("own") + 1)
    x = x.withColumn("level", level)
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    down = x.withColumn("_d", step).groupBy("grid", (F.col("r") + F.col("_d")).alias("r"), "c", "level").agg(F.count(F.lit(1)).alias("n"))
    across = down.withColumn("_d", step).select("grid", "r", (F.col("c") + F.col("_d")).alias("c"), "level", "n")
    met = across.join(x.select("grid", "r", "c", "v", "own", (wide > 0).alias("_wide")), ["grid", "r", "c"])
    below = F.sum(F.when(F.col("level") <= F.col("own"), F.col("n")).otherwise(0))
    share = F.when(F.first("_wide"), below / F.sum("n").cast("double")).otherwise(0.5)
    return met.groupBy("grid", "r", "c").agg(F.first("v").alias("v"), share.alias("share"))


NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def fill_depressions(z: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Each valid cell rises to the lowest level from which water reaches the border or a missing cell."""
    out = np.where(valid, np.inf, np.nan)
    rows, cols = z.shape
    heap: list[tuple[float, int, int]] = []
    inside = lambda r, c: 0 <= r < rows and 0 <= c < cols
    for r, c in zip(*np.nonzero(valid), strict=True):
        if any(not inside(r + i, c + j) or not valid[r + i, c + j] for i, j in NEIGHBOURS):
            out[r, c] = z[r, c]
            heapq.heappush(heap, (float(z[r, c]), int(r), int(c)))
    while heap:
        level, r, c = heapq.heappop(heap)
        if level > out[r, c]:
            continue
        for i, j in NEIGHBOURS:
            y, x = r + i, c + j
            if inside(y, x) and valid[y, x]:
                new = max(level, float(z[y, x]))
                if new < out[y, x]:
                    out[y, x] = new
                    heapq.heappush(heap, (new, y, x))
    return out


def flow_accumulation(z: np.ndarray) -> np.ndarray:
    """Cells that drain through each cell, itself included, by steepest descent; highest cells first."""
    acc = np.ones(z.shape)
    for at in np.argsort(-z, axis=None, kind="stable"):
        r, c = divmod(int(at), z.shape[1])
        best, to = 0.0, None
        for i, j in NEIGHBOURS:
            y, x = r + i, c + j
            if 0 <= y < z.shape[0] and 0 <= x < z.shape[1]:
                slope = (z[r, c] - z[y, x]) / np.hypot(i, j)
                if slope > best:
                    best, to = slope, (y, x)
        if to:
            acc[to] += acc[r, c]
    return acc


def focal(grids: DataFrame, reach: int) -> DataFrame:
    """``grids(grid, r, c, v)`` with mean and least value over the square around every cell."""
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    down = grids.withColumn("_d", step).groupBy("grid", (F.col("r") + F.col("_d")).alias("r"), "c").agg(F.sum("v").alias("s"), F.count("v").alias("n"), F.min("v").alias("m"))
    box = down.withColumn("_d", step).groupBy("grid", "r", (F.col("c") + F.col("_d")).alias("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("m").alias("least"))
    return grids.join(box, ["grid", "r", "c"]).select("grid", "r", "c", "v", (F.col("s") / F.col("n")).alias("mean"), "least")


def neighbour_slope(grids: DataFrame, size: float) -> DataFrame:
    """Slope of ``grids(grid, r, c, v)`` by central differences, one-sided at the border."""
    rows, cols = Window.partitionBy("grid", "c").orderBy("r"), Window.partitionBy("grid", "r").orderBy("c")

    def change(w):
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        return (F.coalesce(after, "v") - F.coalesce(before, "v")) / (size * steps)

    x = grids.withColumn("_x", change(cols)).withColumn("_y", change(rows))
    return x.select("grid", "r", "c", "v", F.hypot("_x", "_y").alias("slope"))


def integral(cells: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """(r, c, total): sums of ``cells(r, c, value)`` over all cells before r and c, for 0..rows and 0..cols."""
    spine = cells.sparkSession.range(rows).select(F.col("id").alias("r")).crossJoin(F.broadcast(cells.sparkSession.range(cols).select(F.col("id").alias("c"))))
    full = spine.join(cells.select("r", "c", value), ["r", "c"], "left").select("r", "c", F.coalesce(value, F.lit(0)).alias("v"))
    across = full.withColumn("v", F.sum("v").over(Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))
    both = across.withColumn("v", F.sum("v").over(Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    return both.select((F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), F.col("v").alias("total"))


def window_share(points: DataFrame, table: DataFrame, reach: int, rows: int, cols: int) -> DataFrame:
    """``points(r, c, ...)`` with ``share``: the integral's sum over the clipped square around, over its cells."""
    lo = lambda x: F.greatest(F.col(x) - reach, F.lit(0))
    hi = lambda x, n: F.least(F.col(x) + reach + 1, F.lit(n))
    corners = F.array(*[F.struct(r.cast("long").alias("r"), c.cast("long").alias("c"), F.lit(k).alias("k")) for r, c, k in ((hi("r", rows), hi("c", cols), 1), (lo("r"), hi("c", cols), -1), (hi("r", rows), lo("c"), -1), (lo("r"), lo("c"), 1))])
    cells = ((hi("r", rows) - lo("r")) * (hi("c", cols) - lo("c"))).cast("double")
    x = points.withColumn("_cells", cells).withColumn("_k", F.explode(corners)).withColumn("_r", F.col("_k.r")).withColumn("_c", F.col("_k.c"))
    x = x.join(table.toDF("_r", "_c", "total"), ["_r", "_c"], "left")
    total = F.sum(F.col("_k.k") * F.coalesce("total", F.lit(0)))
    return x.groupBy(*points.columns, "_cells").agg((total / F.col("_cells")).alias("share")).drop("_cells")


def sample(points: DataFrame, cells: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """``points(x, y, ...)`` with the value of the cell below them; null outside the grid and on missing cells."""
    x = points.withColumn("c", F.floor((F.col("x") - left) / size)).withColumn("r", F.floor((F.lit(top) - F.col("y")) / size))
    return x.join(cells.select("r", "c", "v"), ["r", "c"], "left")


def burn(lines: DataFrame, size: float) -> DataFrame:
    """Cells (r, c) that segments (ax, ay, bx, by) run through, from their crossings of the grid's lines; a segment without
    length has the cell it lies in."""
    return clip_to_cells(lines, size).withColumnsRenamed({"gy": "r", "gx": "c"}).drop("length")
