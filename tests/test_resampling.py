"""Resampled metrics against scalar sums, and the rule that keeps a scorer."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import resampling as rs


def scalar(rows, share=0.1):
    """Metrics of weighted (score, p, z) rows."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    seen = tp = hits = ap = auc = 0.0
    for s in sorted({r[0] for r in rows}, reverse=True):
        p, z = sum(r[1] for r in rows if r[0] == s), sum(r[2] for r in rows if r[0] == s)
        if p + z:
            hits += p * min(max(share * (pos + neg) - seen, 0), p + z) / (p + z)
            seen, tp = seen + p + z, tp + p
            ap += p / pos * tp / seen
            auc += p * (sum(r[2] for r in rows if r[0] < s) + z / 2)
    return hits / pos, auc / (pos * neg), ap, hits / pos / (pos / (pos + neg))


def test_replicates_against_scalar_sums(spark):
    rows = [(i, i % 3 == 0, (i * 7) % 10 / 1.0 if i % 11 else None, "ab"[i % 2] if i % 5 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y boolean, s double, g string")
    weights = {}
    for r in rs.drawn(df, "id", "y", 6, "id").collect():
        weights[r["rep"], r["id"]] = (r["p"], r["z"])
    got = {r["rep"]: r for r in rs.replicates(df, "id", "y", "s", "g", 6).collect()}
    assert set(got) == set(range(6))
    for rep, r in got.items():
        w = {i: weights[rep, i] for i in range(90)}
        assert sum(p for p, _ in w.values()) == pytest.approx(30) and sum(z for _, z in w.values()) == pytest.approx(60)
        low = float("-inf")
        all_ = [(low if s is None else s, *w[i]) for i, _, s, _ in rows]
        assert (r["recall"], r["auc"], r["ap"], r["lift"]) == pytest.approx(scalar(all_))
        parts = [[(low if s is None else s, *w[i]) for i, _, s, k in rows if k == g] for g in ("a", "b", None)]
        size = [sum(x[1] for x in part) for part in parts]
        each = [scalar(part) for part in parts]
        assert r["strat_recall"] == pytest.approx(sum(m[0] * n for m, n in zip(each, size)) / sum(size))
        assert r["strat_auc"] == pytest.approx(sum(m[1] * n for m, n in zip(each, size)) / sum(size))
    assert len({r["auc"] for r in got.values()}) == 6


def test_intervals_hold_the_point(spark):
    rows = [(i, i % 2, i % 2 * 3.0 + i % 7, "g") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, s double, g string")
    x = {r["metric"]: (r["low"], r["high"]) for r in rs.intervals(rs.replicates(df, "id", "y", "s", "g", 40), ["auc", "ap"]).collect()}
    point = scalar([(r[2], r[1], 1 - r[1]) for r in rows])
    assert x["auc"][0] < point[1] < x["auc"][1] and x["ap"][0] < point[2] < x["ap"][1]


def test_keep_rule(spark):
    rows = [(i, int(i % 4 == 0), (i % 4 == 0) * 2.0 + i % 5, float(i % 13), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int, good double, bad double, g string")
    of = lambda c: {"t": rs.replicates(df, "id", "y", c, "g", 20)}
    better, worse, same = (rs.keep_rule(of(a), of(b)).first() for a, b in (("good", "bad"), ("bad", "good"), ("good", "good")))
    assert better["keep"] and better["delta"] > 0 and better["low"] <= better["delta"] <= better["high"]
    assert not worse["keep"] and worse["delta"] == pytest.approx(-better["delta"])
    assert (same["delta"], same["p_better"], same["keep"]) == (0.0, 0.0, False)  # the same draws: no difference at all


def test_one_class_has_no_metrics(spark):
    df = spark.createDataFrame([(i, 1, 1.0, "g") for i in range(9)], "id long, y int, s double, g string")
    r = rs.replicates(df, "id", "y", "s", "g", 3)
    assert r.filter("auc is not null or recall is not null").count() == 0
    assert rs.replicates(df.limit(0), "id", "y", "s", "g", 3).count() == 0
    assert rs.intervals(r, ["auc"]).count() == 0
    assert rs.drawn(df.withColumn("y", F.lit(None).cast("int")), "id", "y", 3).count() == 0
