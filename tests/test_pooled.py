"""Pooled trigger fits against a scalar fit, year by year."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import pooled

SETS = [["a"], ["a", "b"], ["a", "b", "c"]]
COLUMNS = "day int, year int, city string, a double, b double, c double, y int"


def days(seed=1, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = (round(rng.gauss(0, 1), 1) for _ in range(3))
        rows.append((i, 2010 + i % 5, "north" if rng.random() < 0.7 else "south", a, b, c, int(rng.random() < 1 / (1 + math.exp(2 - 1.5 * a - b)))))
    return rows


def scalar(rows, columns, c=0.1):
    """Plain gradient steps to the same optimum."""
    y = np.array([r[6] for r in rows])
    x = np.array([[r[3 + "abc".index(f)] for f in columns] + [1.0] for r in rows])
    city = np.array([r[2] for r in rows])
    size = {g: (city == g).sum() for g in set(city)}
    w = np.array([0.5 / size[g] * len(y) / (2 * (y == k).sum()) for g, k in zip(city, y)]) * c
    b = np.zeros(x.shape[1])
    rate = 1 / (1 + 0.25 * np.linalg.norm(x.T * w @ x, 2))
    for _ in range(4000):
        b -= rate * (b + x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)))
    return b


def test_every_fold_and_set_against_a_scalar_fit(spark):
    rows = days()
    df = spark.createDataFrame(rows, COLUMNS)
    odd = spark.createDataFrame([(900, 2010, "north", None, 1.0, 1.0, 1), (901, None, "north", 1.0, 1.0, 1.0, 1), (902, 2010, "north", 1.0, 1.0, 1.0, None)], COLUMNS)
    # A strong weight as well, where full Newton steps matter.
    for c in (0.1, 300.0):
        m = pooled.fit(df.union(odd), ["a", "b", "c"], SETS, "y", "year", "city", c)
        assert set(m.found) == {(k, y) for k in range(3) for y in (None, *range(2010, 2015))}
        for (k, y), beta in m.found.items():
            if c == 0.1 or y in (None, 2011):
                want = scalar([r for r in rows if r[1] != y], SETS[k], c)
                got = [b for b, f in zip(beta, "abc") if f in SETS[k]] + [beta[-1]]
                assert got == pytest.approx(list(want), abs=1e-6)
                assert all(b == 0 for b, f in zip(beta, "abc") if f not in SETS[k])


def test_folds_choice_and_scores(spark):
    rows = days(2)
    df = spark.createDataFrame(rows, COLUMNS)
    m = pooled.fit(df, ["a", "b", "c"], SETS, "y", "year", "city")
    folds = pooled.yearly(df, m, "y", "year")
    got = {(r["set"], int(r["year"])): r["auc"] for r in folds.collect()}
    for k, cols in enumerate(SETS):
        for y in range(2010, 2015):
            b = scalar([r for r in rows if r[1] != y], cols)
            s = [(sum(v * r[3 + "abc".index(f)] for v, f in zip(b, cols)) + b[-1], r[6]) for r in rows if r[1] == y]
            pairs = [(p > q) + (abs(p - q) < 1e-9) / 2 for p, i in s for q, j in s if i and not j]
            assert got[k, y] == pytest.approx(sum(pairs) / len(pairs), abs=2e-3)
    mean = {k: np.mean([v for (i, _), v in got.items() if i == k]) for k in range(3)}
    best = pooled.chosen(folds)
    assert mean[best] == max(mean.values()) and best == pooled.chosen(folds.filter(F.col("set") >= 0))
    p = {r["day"]: r["p"] for r in m.score(df, best, "p").collect()}
    b = m.found[best, None]
    assert p[0] == pytest.approx(1 / (1 + math.exp(-pooled.margin_of(b, rows[0][3:6]))))


def test_years_of_one_class_and_no_rows(spark):
    rows = [r if r[1] != 2012 else (*r[:6], 0) for r in days(3, 60)]
    df = spark.createDataFrame(rows, COLUMNS)
    m = pooled.fit(df, ["a", "b", "c"], SETS[:1], "y", "year", "city")
    assert {r["year"] for r in pooled.yearly(df, m, "y", "year").collect()} <= {"2010", "2011", "2013", "2014"}
    none = df.filter("y = 0")
    m = pooled.fit(none, ["a", "b", "c"], SETS, "y", "year", "city")
    assert m.found == {} and pooled.chosen(pooled.yearly(none, m, "y", "year")) == 0
    assert pooled.fit(df.limit(0), ["a"], [["a"]], "y", "year", "city").found == {}


def test_groups_without_a_name_count(spark):
    rows = [(*r[:2], None if r[2] == "south" else r[2], *r[3:]) for r in days(4, 80)]
    m = pooled.fit(spark.createDataFrame(rows, COLUMNS), ["a", "b", "c"], SETS[1:2], "y", "year", "city")
    named = pooled.fit(spark.createDataFrame(days(4, 80), COLUMNS), ["a", "b", "c"], SETS[1:2], "y", "year", "city")
    assert m.found[0, None] == pytest.approx(named.found[0, None])
