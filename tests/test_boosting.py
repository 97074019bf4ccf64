"""Boosted trees against a scalar grower, with missing values, weights, penalties and monotone features."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import boosting as bo

SMALL = bo.Growth(rounds=3, leaves=5, depth=3, rate=0.3, l2=2.0, l1=0.3, least_rows=4, rows=1.0, columns=1.0, bins=200)


def table(seed=1, n=160, missing=0.1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = (round(rng.gauss(0, 1), 2) for _ in range(3))
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * a - b * b + 0.5))))
        hide = lambda v: None if rng.random() < missing else v
        rows.append((i, hide(a), hide(b), float("nan") if rng.random() < missing else c, y, rng.choice([0.2, 1.0, 2.5])))
    return rows


COLUMNS = "id long, a double, b double, c double, y int, w double"


def scalar_tree(x, y, w, margin, p):
    """Best-first growth straight from the rows; nested (feature, threshold, missing_left, left, right) or an output."""
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0), g)

    def sums(rows):
        chance = [1 / (1 + math.exp(-margin[i])) for i in rows]
        return sum(w[i] * (c - y[i]) for i, c in zip(rows, chance)), sum(w[i] * c * (1 - c) for i, c in zip(rows, chance))

    def out(rows, low, high):
        g, h = sums(rows)
        v = min(max(-soft(g) / (h + p.l2), low), high)
        return v, -(2 * soft(g) * v + (h + p.l2) * v * v)

    def best(rows, low, high):
        found = None
        for left_missing in (False, True):
            for f in range(len(x[0])):
                for cut in sorted({x[i][f] for i in rows if x[i][f] is not None}):
                    left = [i for i in rows if (left_missing if x[i][f] is None else x[i][f] <= cut)]
                    right = [i for i in rows if i not in set(left)]
                    if len(left) < p.least_rows or len(right) < p.least_rows:
                        continue
                    (a, ga), (b, gb) = out(left, low, high), out(right, low, high)
                    sign = p.monotone[f] if p.monotone else 0
                    if sign * (b - a) < 0 or min(sums(left)[1], sums(right)[1]) < p.least_hessian:
                        continue
                    gain = ga + gb - out(rows, low, high)[1]
                    if gain > (found[0] + 1e-7 if found else 1e-7):
                        mid = (a + b) / 2
                        lb = (low, mid) if sign > 0 else (mid, high) if sign < 0 else (low, high)
                        rb = (mid, high) if sign > 0 else (low, mid) if sign < 0 else (low, high)
                        found = (gain, f, cut, left_missing, left, right, lb, rb)
        return found

    inf = math.inf
    leaves = [(list(range(len(x))), (-inf, inf), 0)]
    value = {}
    open_ = {0: (best(leaves[0][0], -inf, inf), leaves[0][0], (-inf, inf), 0)}
    n = 1
    while n < p.leaves:
        able = {k: v for k, v in open_.items() if v[0] and v[3] < p.depth}
        if not able:
            break
        k = max(able, key=lambda k: (able[k][0][0], -k))
        (_, f, cut, ml, left, right, lb, rb), rows, bound, d = open_.pop(k)
        for c, r, b in ((2 * k + 1, left, lb), (2 * k + 2, right, rb)):
            open_[c] = (best(r, *b) if d + 1 < p.depth else None, r, b, d + 1)
        n += 1
    for _, rows, bound, _ in open_.values():
        v = out(rows, *bound)[0]
        for i in rows:
            value[i] = v
    return [value[i] for i in range(len(x))]


def scalar_fit(rows, p, weighted=True):
    x = [[None if v is None or math.isnan(v) else v for v in r[1:4]] for r in rows]
    y, w = [r[4] for r in rows], [r[5] if weighted else 1.0 for r in rows]
    hits = sum(a * b for a, b in zip(y, w))
    margin = [math.log(hits / (sum(w) - hits))] * len(rows)
    for _ in range(p.rounds):
        margin = [m + p.rate * v for m, v in zip(margin, scalar_tree(x, y, w, margin, p))]
    return [1 / (1 + math.exp(-m)) for m in margin]


@pytest.mark.parametrize("monotone", [(), (1, 0, -1)])
def test_against_scalar_growth(spark, monotone):
    rows, p = table(), bo.replace(SMALL, monotone=monotone)
    df = spark.createDataFrame(rows, COLUMNS)
    model = bo.fit(df.repartition(3), ["a", "b", "c"], "y", "id", "w", p)
    got = {r["id"]: r["s"] for r in model.score(df, "s").collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(scalar_fit(rows, p), abs=2e-6)
    assert all(sum(f >= 0 for f in t.feature) == p.leaves - 1 for t in model.trees)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(table(3, 300), COLUMNS)
    p = bo.Growth(rounds=4, least_rows=5, bins=16)
    one, many = (bo.fit(df.repartition(n), ["a", "b", "c"], "y", "id", "w", p) for n in (1, 7))
    assert one.trees == many.trees
    seen = [bo._columns(10, t, p) for t in range(4)]
    assert all(len(c) == 8 for c in seen) and len({tuple(c) for c in seen}) > 1


def test_margins_are_staged_without_a_change(spark, monkeypatch):
    df = spark.createDataFrame(table(4, 200), COLUMNS)
    p = bo.replace(SMALL, rounds=5, bins=20)
    a = bo.fit(df, ["a", "b", "c"], "y", "id", "w", p)
    monkeypatch.setattr(bo, "RESTAGE", 2)
    assert bo.fit(df, ["a", "b", "c"], "y", "id", "w", p).trees == a.trees


def test_monotone_features_never_fall(spark):
    df = spark.createDataFrame(table(5, 400), COLUMNS)
    p = bo.Growth(rounds=12, rate=0.3, least_rows=5, bins=32, monotone=(1, -1, 0))
    model = bo.fit(df, ["a", "b", "c"], "y", "id", growth=p)
    free = bo.fit(df, ["a", "b", "c"], "y", "id", growth=bo.replace(p, monotone=()))
    rng = np.random.default_rng(1)
    lines = [(float(b), float(c), k, float(a)) for k, (b, c) in enumerate(rng.normal(size=(20, 2))) for a in np.linspace(-3, 3, 61)]
    x = spark.createDataFrame(lines, "u double, c double, k int, v double")

    def falls(m, feature, sign):
        z = x.select("k", "v", "c", F.col("v" if feature == "a" else "u").alias("a"), F.col("v" if feature == "b" else "u").alias("b"))
        by = {}
        for r in m.score(z, "s").collect():
            by.setdefault(r["k"], []).append((r["v"], r["s"]))
        return sum(sign * (t - s) < -1e-12 for v in by.values() for (_, s), (_, t) in zip(sorted(v), sorted(v)[1:]))

    assert falls(model, "a", 1) == 0 and falls(model, "b", -1) == 0
    assert falls(free, "b", -1) > 0


def test_stored_model_tells_the_same(spark, tmp_path):
    rows = table(6, 200)
    df = spark.createDataFrame(rows, COLUMNS)
    live = bo.fit(df, ["a", "b", "c"], "y", "id", "w", SMALL)
    live.save(spark, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exist"):
        live.save(spark, str(tmp_path / "m"))
    again = bo.load(spark, str(tmp_path / "m"))
    assert again.about["rows"] == 200 and again.features == live.features
    both = again.score(live.score(df, "one"), "two")
    assert both.filter("one <> two or one is null").count() == 0 and both.columns == [*df.columns, "one", "two"]
    assert {r["feature"]: r["splits"] for r in again.importances(spark).collect()} == {r["feature"]: r["splits"] for r in live.importances(spark).collect()}


def test_cutoff_hides_later_rows(spark):
    rows = [(*r, f"20{10 + r[0] % 14}-03-01" if r[0] % 11 else None) for r in table(7, 220)]
    df = spark.createDataFrame(rows, COLUMNS + ", day string").withColumn("day", F.col("day").cast("date"))
    p = bo.replace(SMALL, rounds=2, bins=20)
    m = bo.fit_before(df, "day", "2020-01-01", ["a", "b", "c"], "y", "id", "w", p)
    seen = df.filter("day is null or day < '2020-01-01'")
    assert m.trees == bo.fit(seen, ["a", "b", "c"], "y", "id", "w", p).trees
    assert (m.about["fit_cutoff"], m.about["max_training_date"], m.about["rows"]) == ("2020-01-01", "2019-03-01", seen.count())


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.1), ("b", 0.1)], "city string, w double")
    got = sorted(tuple(r) for r in bo.balanced(df, "city", "w").collect())
    assert [g[1] for g in got] == pytest.approx([0.25, 0.75, 0.1, 0.1])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert bo.fit(empty, ["a"], "y", "id", growth=SMALL).trees == []
    one = spark.createDataFrame([(1, 1.0, None, None, 1, 1.0)] * 9, COLUMNS)
    m = bo.fit(one, ["a", "b"], "y", "id", growth=SMALL)
    assert m.trees == [] and m.score(one, "s").filter("s > 0.99").count() == 9
    flat = spark.createDataFrame([(i, None, 1.0, float("nan"), i % 2, 1.0) for i in range(40)], COLUMNS)
    m = bo.fit(flat, ["a", "b", "c"], "y", "id", growth=SMALL)
    assert all(f < 0 for t in m.trees for f in t.feature)
    assert [r["s"] for r in m.score(flat, "s").collect()] == pytest.approx([0.5] * 40, abs=1e-6)
