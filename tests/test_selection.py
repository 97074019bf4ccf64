"""Trigger candidates on left-out years against scalar fits."""

import math
import random

import numpy as np
import pytest

from tidewright.operators import selection as se

COLUMNS = "year int, label int, a double, b double, c double, d double"


def days(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c, d = (round(abs(rng.gauss(4, 3)), 1) for _ in range(4))
        rows.append((2010 + i % 4, int(rng.random() < 1 / (1 + math.exp(4 - 0.5 * a - 0.6 * c))), a, b, c, d))
    return rows


def logistic(x, y):
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w, pen = np.zeros(z.shape[1]), np.array([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T * (p * (1 - p)) @ z + np.diag(pen), z.T @ (p - y) + pen * w)
    return lambda v: 1 / (1 + np.exp(-(np.column_stack(((v - mean) / sd, np.ones(len(v)))) @ w)))


def auc(y, s):
    return np.mean([(p > q) + (p == q) / 2 for p, i in zip(s, y) for q, j in zip(s, y) if i and not j])


def pav(x, y):
    blocks = [[v, v, float(np.mean(y[x == v])), int((x == v).sum())] for v in sorted(set(x))]
    i = 0
    while i + 1 < len(blocks):
        if blocks[i][2] > blocks[i + 1][2]:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]]
            i = max(0, i - 1)
        else:
            i += 1
    xs = [v for b in blocks for v in ((b[0], b[1]) if b[0] != b[1] else (b[0],))]
    ys = [b[2] for b in blocks for _ in ((0, 1) if b[0] != b[1] else (0,))]
    return lambda v: np.interp(v, xs, ys)


def test_candidates_against_scalar_fits(spark):
    rows = days()
    x, y, year = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    odd = [(2010, 1, None, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0, 1.0)]
    folds = se.left_out(spark.createDataFrame(rows + odd, COLUMNS), ["a", "b", "c", "d"], "label", "year")
    want, index = {c: np.zeros(len(rows)) for c in se.CANDIDATES}, {}
    for k in sorted(set(year)):
        tr, te = year != k, year == k
        want["logit_design"][te] = logistic(x[tr][:, [0, 2]], y[tr])(x[te][:, [0, 2]])
        logs = np.log1p(x[:, [0, 1, 3]])
        want["logit_log"][te] = logistic(logs[tr], y[tr])(logs[te])
        own = [(round(auc(y[tr], logistic(x[tr][:, [j]], y[tr])(x[tr][:, [j]])), 12), "abc"[j]) for j in range(3)]
        index[k] = max(own)[1]
        j = "abc".index(index[k])
        want["isotonic"][te] = pav(x[tr][:, j], y[tr])(x[te][:, j])
        q = np.quantile(x[tr][:, 0], np.linspace(0, 1, 201))
        want["percentile"][te] = 1 / (1 + np.exp(-(np.interp(x[te][:, 0], q, np.linspace(0, 1, 201), left=0, right=1) - 0.95) / 0.02))
    assert folds.index == index
    got = {}
    for r in folds.scores.collect():
        got.setdefault((r["candidate"], r["year"]), []).append((r["label"], r["score"]))
    for c in ("logit_design", "logit_log", "isotonic"):
        for k in set(year):
            te = year == k
            assert np.allclose(sorted(got[c, k]), sorted(zip(y[te].astype(float), want[c][te])), atol=1e-6)
    for k in set(year):  # repeated knots may tell another share of the same value
        assert len(got["percentile", k]) == (year == k).sum()
    table = {r["candidate"]: r for r in se.compared(folds).collect()}
    for c in ("logit_design", "logit_log", "isotonic"):
        assert table[c]["auc"] == pytest.approx(auc(y, np.round(want[c], 9)), abs=2e-3)
    assert table["percentile"]["auc"] == pytest.approx(auc(y, want["percentile"]), abs=0.02)
    assert se.best(se.compared(folds)) == max(table.values(), key=lambda r: (r["auc"], r["ap"]))["candidate"]


def test_one_class_falls_back(spark):
    folds = se.left_out(spark.createDataFrame([(2010 + i % 2, 0, 1.0, 1.0, 1.0, float(i)) for i in range(8)], COLUMNS), ["a", "b", "c", "d"], "label", "year")
    assert folds.index == {} and se.best(se.compared(folds)) == "percentile"
