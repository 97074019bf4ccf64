"""Tides against a scalar model, published nodal factors and plain least squares."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import tides

EPOCH = dt.datetime(1899, 12, 31, 12)


def scalar(c, t):
    """(f, argument in radians) of a constituent at a UTC time."""
    d = (t - EPOCH).total_seconds() / 86400
    e = d / 10000
    s, h, p, n, q = ((a + b * d + k * e * e + g * e**3) / 360 for a, b, k, g in tides.LONGITUDES.values())
    tau = (t - t.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds() / 86400 + h - s
    f, v = 1.0, c.phase + sum(k * a for k, a in zip(c.numbers, (tau, s, h, p, n, q)))
    node = -2 * math.pi * n
    for name, power in c.nodal:
        fc, us = tides.NODAL[name]
        f *= (fc[0] + sum(w * math.cos((i + 1) * node) for i, w in enumerate(fc[1:]))) ** power
        v += power * sum(w * math.sin((i + 1) * node) for i, w in enumerate(us)) / 360
    return f, 2 * math.pi * v


BY = {c.name: c for c in tides.CONSTITUENTS}


def series(spark, start, hours, waves, step=1):
    times = [start + dt.timedelta(hours=step * i) for i in range(hours // step)]
    rows = []
    for t in times:
        z = 1.5
        for name, (amp, lag) in waves.items():
            f, v = scalar(BY[name], t)
            z += amp * f * math.cos(v - math.radians(lag))
        rows.append((t, z))
    return spark.createDataFrame(rows, "time timestamp_ntz, level double")


def test_speeds_are_the_published_ones():
    speeds = {"M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K1": 15.0410686, "O1": 13.9430356, "K2": 30.0821373, "P1": 14.9589314, "Q1": 13.3986609, "Mf": 1.0980331, "Mm": 0.5443747, "Ssa": 0.0821373, "M4": 57.9682084, "MS4": 58.9841042, "L2": 29.5284789, "T2": 29.9589333, "2N2": 27.8953548, "J1": 15.5854433, "OO1": 16.1391017}
    for name, degrees in speeds.items():
        assert BY[name].frequency * 360 == pytest.approx(degrees, abs=2e-6), name
    assert len(BY) == len(tides.CONSTITUENTS)


def test_nodal_factors_of_known_years(spark):
    df = spark.createDataFrame([(dt.datetime(2006, 6, 19),), (dt.datetime(2015, 10, 8),)], "time timestamp_ntz")
    a, b = tides.arguments(df, "time", [BY[n] for n in ("M2", "O1", "K1", "K2", "M4", "S2")]).orderBy("time").collect()
    # The node was at 0 degrees in June 2006 and at 180 in October 2015.
    assert (a["f_M2"], a["f_O1"], a["f_K1"], a["f_K2"]) == pytest.approx((0.9633, 1.1827, 1.1128, 1.3172), abs=2e-3)
    assert (b["f_M2"], b["f_O1"], b["f_K1"], b["f_K2"]) == pytest.approx((1.0379, 0.8057, 0.8816, 0.7476), abs=2e-3)
    assert a["f_M4"] == pytest.approx(a["f_M2"] ** 2) and a["f_S2"] == 1.0


def test_arguments_are_those_of_the_scalar_model(spark):
    times = [dt.datetime(1969, 7, 20, 20, 17), dt.datetime(2000, 1, 1), dt.datetime(2024, 2, 29, 23, 59, 59)]
    got = tides.arguments(spark.createDataFrame([(t,) for t in times], "time timestamp_ntz"), "time", tides.CONSTITUENTS).collect()
    for r in got:
        for c in tides.CONSTITUENTS:
            f, v = scalar(c, r["time"])
            assert r[f"f_{c.name}"] == pytest.approx(f, abs=1e-12)
            assert math.cos(r[f"v_{c.name}"] - v) == pytest.approx(1, abs=1e-9)


def test_choice_by_length_of_record():
    names = lambda hours: [c.name for c in tides.chosen(hours)]
    assert names(0) == []
    assert "S2" not in names(24 * 13) and "S2" in names(24 * 16)  # 14.77 days tell S2 from M2
    assert "K2" not in names(24 * 180) and "K2" in names(24 * 183)  # 182.6 days tell K2 from S2
    assert len(names(24 * 400)) > 35
    for hours in (100, 1000, 9000):
        f = sorted([0.0] + [c.frequency for c in tides.chosen(hours)])
        assert min((b - a) * hours for a, b in zip(f, f[1:])) >= 1


def test_known_tide_is_found_with_its_nodal_factor(spark):
    waves = {"M2": (1.0, 40.0), "S2": (0.4, 75.0), "K1": (0.6, 300.0), "O1": (0.5, 10.0), "M4": (0.1, 200.0)}
    df = series(spark, dt.datetime(2006, 1, 1), 24 * 200, waves, 2)
    fit = tides.fit(df, "time", "level")
    found = {r["name"]: (r["amplitude"], r["phase"]) for r in fit.table(spark).collect()}
    assert fit.mean == pytest.approx(1.5, abs=1e-6)
    for name, want in waves.items():
        assert found[name] == pytest.approx(want, abs=1e-5)
    assert all(a < 1e-5 for n, (a, _) in found.items() if n not in waves)
    # Ten years later the node stands elsewhere; the same constants still tell the level.
    later = series(spark, dt.datetime(2016, 5, 1), 24 * 5, waves)
    gap = fit.heights(later, "time", "astro").agg(F.max(F.abs(F.col("astro") - F.col("level")))).first()[0]
    assert gap < 1e-4


def test_fit_is_plain_least_squares(spark):
    rng = np.random.default_rng(4)
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)) for h in sorted(rng.choice(24 * 40, 500, replace=False))]
    rows = [(t, float(rng.normal())) for t in times]
    df = spark.createDataFrame(rows + [(None, 1.0), (times[0], None), (times[0], float("nan"))], "time timestamp_ntz, level double")
    fit = tides.fit(df, "time", "level")
    x = [[1.0] + [w for c in fit.which for f, v in [scalar(c, t)] for w in (f * math.cos(v), f * math.sin(v))] for t, _ in rows]
    want = np.linalg.lstsq(np.array(x), np.array([y for _, y in rows]), rcond=None)[0]
    assert [fit.mean, *[w for p in zip(fit.cos, fit.sin) for w in p]] == pytest.approx(list(want), abs=1e-7)


def test_days_of_a_zone(spark):
    hours = tides.hours_of(spark, "2024-01-01", "2024-01-04", "Asia/Ho_Chi_Minh")
    rows = sorted((r["time"], r["date"]) for r in hours.collect())
    assert len(rows) == 96 and rows[0] == (dt.datetime(2023, 12, 31, 17), dt.date(2024, 1, 1))
    level = hours.withColumn("astro_m", F.dayofmonth("date") * 10.0 + F.hour("time"))
    seen = spark.createDataFrame([(dt.date(2024, 1, 2), 7.0), (dt.date(2024, 1, 2), 9.0), (dt.date(2024, 1, 3), None)], "date date, level double")
    got = {r["date"].day: tuple(r)[1:] for r in tides.daily(level, seen).collect()}
    assert got == {1: (33.0, 10.0, None, None, None), 2: (43.0, 20.0, None, 9.0, 34.0), 3: (53.0, 30.0, 53.0, None, None), 4: (63.0, 40.0, 63.0, None, None)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "time timestamp_ntz, level double")
    fit = tides.fit(empty, "time", "level")
    assert (fit.which, fit.mean) == ([], 0.0)
