"""Boosted trees for a binary label: leaf-wise growth, L1 and L2 penalties, row weights, missing values, monotone features.

Rows are binned once and staged.  A pass over them sums gradients by (node, feature, bin) in every task and adds the sums
up in Spark; the driver sees sums only, as many as nodes of one level, features and bins.  A node's best split follows from
its own sums, so one pass a level finds all splits that best-first growth can ask for.  Gradients are summed as whole
numbers, so a model does not depend on how the rows are partitioned.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Gradients are counted in these parts of one, and margins staged again after as many trees.
UNIT, RESTAGE = 1 << 24, 5
MISSING = 255


@dataclass(frozen=True)
class Growth:
    """How trees grow.  ``monotone`` has 1, 0 or -1 for each feature; none: no limits."""

    rounds: int = 160
    leaves: int = 7
    depth: int = 4
    rate: float = 0.035
    l2: float = 8.0
    l1: float = 1.5
    least_rows: int = 30
    least_hessian: float = 1e-3
    rows: float = 0.85
    columns: float = 0.8
    bins: int = 63
    seed: int = 41073
    monotone: tuple[int, ...] = ()


@dataclass
class Tree:
    """A tree in heap order: node i has children 2i + 1 and 2i + 2; a leaf has feature -1."""

    feature: list[int]
    bin: list[int]
    threshold: list[float]
    missing_left: list[bool]
    value: list[float]

    @staticmethod
    def blank(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0] * n, [0.0] * n, [False] * n, [0.0] * n)

    def places(self, binned: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after at most ``depth`` splits."""
        at = np.zeros(len(binned), np.int64)
        feature, edge, left = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        rows = np.arange(len(binned))
        for _ in range(depth):
            f = feature[at]
            x = binned[rows, np.maximum(f, 0)]
            go_left = np.where(x == MISSING, left[at], x <= edge[at])
            at = np.where(f < 0, at, 2 * at + 2 - go_left)
        return at


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _outcome(g, h, low: float, high: float, p: Growth):
    """Output of a leaf within its bounds, and the gain of having it."""
    s = _soft(np.asarray(g, float), p.l1)
    all_ = np.maximum(np.asarray(h, float) + p.l2, 1e-12)
    w = np.clip(-s / all_, low, high)
    return w, -(2 * s * w + all_ * w * w)


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, float, float]  # output and its bounds
    right: tuple[float, float, float]


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, features: list[int], low: float, high: float, p: Growth) -> Split | None:
    """The split that gains most of a node's sums ``[feature, bin]``, missing values in the last bin; equal gains: missing
    values right first, then the first feature, then the lowest bin."""
    total = [a.sum(axis=1, keepdims=True) for a in (g, h, n)]
    below = [np.cumsum(a[:, :-1], axis=1)[:, :-1] for a in (g, h, n)]
    gone = [a[:, -1:] for a in (g, h, n)]
    sign = np.array([p.monotone[f] if p.monotone else 0 for f in features])[:, None]
    best = None
    for missing_left in (False, True):
        lg, lh, ln = (b + m if missing_left else b for b, m in zip(below, gone, strict=True))
        rg, rh, rn = (t - x for t, x in zip(total, (lg, lh, ln), strict=True))
        lw, lgain = _outcome(lg, lh, low, high, p)
        rw, rgain = _outcome(rg, rh, low, high, p)
        _, whole = _outcome(total[0], total[1], low, high, p)
        gain = lgain + rgain - whole
        bad = (ln < p.least_rows) | (rn < p.least_rows) | (lh < p.least_hessian) | (rh < p.least_hessian) | (sign * (rw - lw) < 0)
        gain = np.where(bad, -np.inf, gain)
        if not gain.size:
            continue
        i, k = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, k] > (best.gain if best else 1e-12):
            mid, s = (lw[i, k] + rw[i, k]) / 2, sign[i, 0]
            left = (low, mid) if s > 0 else (mid, high) if s < 0 else (low, high)
            right = (mid, high) if s > 0 else (low, mid) if s < 0 else (low, high)
            best = Split(float(gain[i, k]), features[i], int(k), missing_left, (float(lw[i, k]), *map(float, left)), (float(rw[i, k]), *map(float, right)))
    return best


def _passed(kind: str, trees: list[Tree], now: Tree | None, level: int, nodes: list[int], features: list[int], turn: int, p: Growth):
    """A pass over (hash, y, w, margin, bins): the sums of ``nodes`` at ``level`` of the tree under way, or new margins."""
    bins = p.bins + 1
    slot = np.full(2 ** (p.depth + 1), -1)
    slot[nodes] = np.arange(len(nodes))
    names = ["cell", "g", "h", "n"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(nodes) * len(features) * bins), np.int64)
        for b in batches:
            column = {name: b.column(i) for i, name in enumerate(("hash", "y", "w", "margin", "bins"))}
            binned = np.frombuffer(b"".join(column["bins"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
            margin = column["margin"].to_numpy(zero_copy_only=False).copy()
            for t in trees:
                margin += np.array(t.value)[t.places(binned, p.depth)]
            if kind == "margins":
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(margin), b.column(4)], ["hash", "y", "w", "margin", "bins"])
                continue
            y, w = (column[c].to_numpy(zero_copy_only=False) for c in "yw")
            chance = 1 / (1 + np.exp(-margin))
            mixed = column["hash"].to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 0xBF58476D1CE4E5B9 + p.seed) % 2**64)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            place = slot[now.places(binned, level)]
            use = (place >= 0) & ((mixed >> np.uint64(11)) < np.uint64(int(p.rows * 2**53)))
            g, h = np.rint(w * (chance - y) * UNIT)[use], np.rint(w * chance * (1 - chance) * UNIT)[use]
            for k, f in enumerate(features):
                x = binned[use, f].astype(np.int64)
                cell = place[use] * bins + np.where(x == MISSING, bins - 1, x)
                at = np.arange(len(nodes) * bins)
                at = ((at // bins) * len(features) + k) * bins + at % bins
                for i, v in enumerate((g, h, None)):
                    sums[i, at] += np.bincount(cell, v, len(nodes) * bins).astype(np.int64)
        if kind != "margins":
            some = np.flatnonzero(sums[2])
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(s[some]) for s in sums)], names)

    return go


ROWS = "hash long, y double, w double, margin double, bins binary"


def _sums(rows: DataFrame, *of) -> np.ndarray:
    """[sum, node, feature, bin] over all rows."""
    *_, nodes, features, _, p = of
    found = rows.mapInArrow(_passed("sums", *of), "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((3, len(nodes) * len(features) * (p.bins + 1)))
    for i, c in enumerate("ghn"):
        out[i, found["cell"].to_numpy()] = found[c].to_numpy()
    out[:2] /= UNIT
    return out.reshape(3, len(nodes), len(features), p.bins + 1)


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def edges_of(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 limits a feature, from a bounded sketch of its quantiles; a value up to a limit is below it."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(_number(c), shares, 20 * bins).alias(f"e{i}") for i, c in enumerate(features)], *[F.max(_number(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [sorted({v for v in (row[f"e{i}"] or []) if v < row[f"m{i}"]}) for i in range(len(features))]


def _binned(edges: list[list[float]]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((b.num_rows, len(edges)), np.uint8)
            for k, e in enumerate(edges):
                v = b.column(4 + k).to_numpy(zero_copy_only=False).astype(float)
                out[:, k] = np.where(np.isnan(v), MISSING, np.searchsorted(np.array(e), v, side="left"))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([r.tobytes() for r in out], pa.binary())], ["hash", "y", "w", "margin", "bins"])

    return go


@dataclass
class Model:
    """Trees over named features; ``about`` is what was told of the fit."""

    features: list[str]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)
    about: dict = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a tree: (tree, feature, threshold, missing_left, value), nodes in heap order."""
        rows = [(i, t.feature, t.threshold, t.missing_left, t.value) for i, t in enumerate(self.trees)]
        return spark.createDataFrame(rows, "tree int, feature array<int>, threshold array<double>, missing_left array<boolean>, value array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables below a new ``path``: the trees, and one row that tells the rest as JSON."""
        told = {"features": self.features, "base": self.base, "depth": self.depth, "about": self.about}
        self.table(spark).coalesce(1).write.parquet(f"{path}/trees")
        spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "told string").coalesce(1).write.parquet(f"{path}/model")

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, splits)."""
        used = [self.features[f] for t in self.trees for f in t.feature if f >= 0]
        return spark.createDataFrame([(f, used.count(f)) for f in self.features], "feature string, splits long")

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return score(self.table(df.sparkSession), self.features, self.base, self.depth, df, out)


def load(spark: SparkSession, path: str) -> Model:
    told = json.loads(spark.read.parquet(f"{path}/model").first()["told"])
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()  # as many as rounds
    trees = [Tree(r["feature"], [0] * len(r["feature"]), r["threshold"], r["missing_left"], r["value"]) for r in rows]
    return Model(told["features"], told["base"], told["depth"], trees, told["about"])


def score(table: DataFrame, features: list[str], base: float, depth: int, df: DataFrame, out: str) -> DataFrame:
    """``df`` with the probability that a table of trees tells; column functions only, the trees are one broadcast row."""
    trees = table.agg(F.array_sort(F.collect_list(F.struct("tree", "feature", "threshold", "missing_left", "value"))).alias("_trees"))
    x = df.withColumn("_x", F.array(*[_number(c) for c in features])).crossJoin(F.broadcast(trees))  # rounds x nodes

    def step(t: Column, i: Column) -> Column:
        v = F.get(F.col("_x"), F.get(t["feature"], i))
        left = F.when(v.isNull(), F.get(t["missing_left"], i)).otherwise(v <= F.get(t["threshold"], i))
        return F.when(F.get(t["feature"], i) < 0, i).otherwise(2 * i + F.when(left, 1).otherwise(2))

    def leaf(t: Column) -> Column:
        return F.get(t["value"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda i, _: step(t, i)))

    z = F.aggregate("_trees", F.lit(float(base)), lambda z, t: z + leaf(t)) if depth else F.lit(float(base))
    return x.withColumn(out, 1 / (1 + F.exp(-z))).drop("_x", "_trees")


def _columns(n: int, turn: int, p: Growth) -> list[int]:
    if p.columns >= 1:
        return list(range(n))
    drawn = np.random.default_rng([p.seed, turn]).permutation(n)[: max(1, round(n * p.columns))]
    return sorted(drawn.tolist())


def grown(splits: dict[int, Split], p: Growth) -> list[int]:
    """Nodes split by best-first growth: the open node that gains most, the first of equal ones, up to the leaves wanted."""
    open_, taken = [(-splits[0].gain, 0)] if 0 in splits else [], []
    while open_ and len(taken) + 1 < p.leaves:
        _, i = heapq.heappop(open_)
        taken.append(i)
        for c in (2 * i + 1, 2 * i + 2):
            if c in splits:
                heapq.heappush(open_, (-splits[c].gain, c))
    return taken


def _tree(rows: DataFrame, recent: list[Tree], edges: list[list[float]], turn: int, p: Growth) -> Tree:
    features = [f for f in _columns(len(edges), turn, p)]
    trial, splits = Tree.blank(p.depth), {}
    bounds, root = {0: (-math.inf, math.inf)}, None
    nodes = [0]
    for level in range(p.depth):
        g, h, n = _sums(rows, recent, trial, level, nodes, features, turn, p)
        if level == 0:
            root = float(_outcome(g[0, 0].sum(), h[0, 0].sum(), *bounds[0], p)[0]) if features else 0.0
        below = []
        for k, i in enumerate(nodes):
            s = best_split(g[k], h[k], n[k], features, *bounds[i], p)
            if s is None or s.bin >= len(edges[s.feature]):
                continue
            splits[i] = s
            trial.feature[i], trial.bin[i], trial.missing_left[i] = s.feature, s.bin, s.missing_left
            for c, side in ((2 * i + 1, s.left), (2 * i + 2, s.right)):
                bounds[c] = side[1:]
                below.append(c)
        nodes = below
        if not nodes:
            break
    tree = Tree.blank(p.depth)
    tree.value[0] = p.rate * (root or 0.0)
    for i in grown(splits, p):
        s = splits[i]
        tree.feature[i], tree.bin[i], tree.threshold[i], tree.missing_left[i] = s.feature, s.bin, edges[s.feature][s.bin], s.missing_left
        tree.value[2 * i + 1], tree.value[2 * i + 2] = p.rate * s.left[0], p.rate * s.right[0]
    return tree


def fit(df: DataFrame, features: list[str], label: str, key: str, weight: str | None = None, growth: Growth | None = None) -> Model:
    """Fit on ``df``: ``label`` 0 or 1, rows without one go; ``weight`` 1 unless named; ``key`` tells which rows a tree
    sees.  Missing numbers are null or NaN.  One class or no row gives a model without splits."""
    p = growth or Growth()
    if p.bins >= MISSING:
        raise ValueError("too many bins for a byte")
    if p.monotone and len(p.monotone) != len(features):
        raise ValueError("monotone needs a sign for each feature")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    known = df.filter(F.col(label).isNotNull()).select(F.xxhash64(key).alias("hash"), F.col(label).cast("double").alias("y"), w.alias("w"), F.lit(0.0).alias("margin"), *[_number(c).alias(f"x{i}") for i, c in enumerate(features)])
    all_, hits, rows_ = known.agg(F.sum("w"), F.sum(F.col("y") * F.col("w")), F.count(F.lit(1))).first()
    about = {"rows": rows_, "growth": asdict(p)}
    if not all_ or not hits or hits == all_:
        return Model(features, 20.0 if hits else -20.0, p.depth, [], about)
    base = math.log(hits / (all_ - hits))
    edges = edges_of(known, [f"x{i}" for i in range(len(features))], p.bins)
    rows = staged(known.withColumn("margin", F.lit(base)).mapInArrow(_binned(edges), ROWS), "binned")
    model, recent = Model(features, base, p.depth, [], about), []
    for turn in range(p.rounds):
        if len(recent) == RESTAGE:
            rows = staged(rows.mapInArrow(_passed("margins", recent, None, 0, [], [], 0, p), ROWS), "binned")
            recent = []
        tree = _tree(rows, recent, edges, turn, p)
        recent.append(tree)
        model.trees.append(tree)
    return model


def fit_before(df: DataFrame, date: str, cutoff: str, features: list[str], label: str, key: str, weight: str | None = None, growth: Growth | None = None) -> Model:
    """A model of the rows before ``cutoff`` and of those without a date; ``about`` tells the cutoff and the last date."""
    seen = df.filter(F.col(date).isNull() | (F.col(date) < F.lit(cutoff).cast("date")))
    last, hits = seen.agg(F.max(date).cast("date").cast("string"), F.sum(F.col(label).cast("double"))).first()
    model = fit(seen, features, label, key, weight, growth)
    return replace(model, about=model.about | {"fit_cutoff": cutoff, "max_training_date": last, "positive_rows": hits or 0.0})


def balanced(df: DataFrame, group: str, weight: str) -> DataFrame:
    """``df`` with weights scaled so that each group's sum is half its number of rows."""
    total = df.groupBy(group).agg(F.greatest(F.sum(weight), F.lit(1.0)).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return df.join(total, group).withColumn(weight, F.col(weight) / F.col("_t") * 0.5 * F.col("_n")).drop("_t", "_n")


def first_gains(df: DataFrame, feature: str, bin: str, label: str, growth: Growth | None = None) -> DataFrame:
    """(feature, gain) of long rows: the most that one split of all rows by a feature gains, from running sums of bins.
    Features without a split that leaves enough rows on both sides have no row."""
    from ..functions.stats import running

    p = growth or Growth()
    share = df.groupBy(feature).agg(F.avg(label).alias("_share"))
    by = df.groupBy(feature, bin).agg(F.sum(label).alias("_y"), F.count(F.lit(1)).alias("_n"))
    by = by.join(share, feature).withColumn("_g", F.col("_n") * F.col("_share") - F.col("_y")).withColumn("_h", F.col("_n") * F.col("_share") * (1 - F.col("_share")))
    up = running(by, bin, {"g": "_g", "h": "_h", "n": "_n"}, (feature,))
    total = by.groupBy(feature).agg(F.sum("_g").alias("tg"), F.sum("_h").alias("th"), F.sum("_n").alias("tn"))
    x = up.join(total, feature)
    worth = lambda g, h: F.pow(F.greatest(F.abs(g) - p.l1, F.lit(0.0)), F.lit(2.0)) / (h + p.l2)
    gain = worth(F.col("g"), F.col("h")) + worth(F.col("tg") - F.col("g"), F.col("th") - F.col("h")) - worth(F.col("tg"), F.col("th"))
    x = x.withColumn("gain", gain).filter((F.col("n") >= p.least_rows) & (F.col("tn") - F.col("n") >= p.least_rows))
    return x.groupBy(feature).agg(F.max("gain").alias("gain"))
