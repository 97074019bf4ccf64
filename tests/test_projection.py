"""Map projection against published places and its own inverse; resampling against scalar interpolation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import projection as pr


def test_known_places(spark):
    # The Equator at a middle meridian and at three degrees from it, and the far ends of a meridian arc.
    rows = [(105.0, 0.0), (108.0, 0.0), (105.0, 90.0), (105.0, 45.0)]
    got = pr.to_utm(spark.createDataFrame(rows, "lon double, lat double"), "lon", "lat", 32648).collect()
    assert (got[0]["x"], got[0]["y"]) == pytest.approx((500_000, 0), abs=1e-6)
    assert (got[1]["x"], got[1]["y"]) == pytest.approx((833_978.557, 0), abs=2e-3)
    assert got[2]["y"] == pytest.approx(0.9996 * 10_001_965.7293, abs=2e-3)  # a quarter of the meridian
    assert got[3]["y"] == pytest.approx(0.9996 * 4_984_944.3780, abs=2e-3)
    south = pr.to_utm(spark.createDataFrame(rows[:1], "lon double, lat double"), "lon", "lat", 32748).first()
    assert south["y"] == pytest.approx(10_000_000)


@pytest.mark.parametrize("epsg", [32648, 32733])
def test_there_and_back_under_a_millimetre(spark, epsg):
    rng = random.Random(epsg)
    middle = (epsg % 100) * 6 - 183
    rows = [(middle + rng.uniform(-4, 4), rng.uniform(-83, 83)) for _ in range(400)] + [(None, 1.0), (float(middle), 0.0)]
    df = pr.to_utm(spark.createDataFrame(rows, "lon double, lat double"), "lon", "lat", epsg)
    back = pr.from_utm(df, "x", "y", epsg, "lon2", "lat2")
    assert back.filter("x is null").count() == 1
    off = back.agg(F.max(F.abs(F.col("lon") - F.col("lon2"))), F.max(F.abs(F.col("lat") - F.col("lat2")))).first()
    assert max(off) < 1e-11  # degrees: about a thousandth of a millimetre
    again = pr.to_utm(pr.from_utm(df.drop("lon", "lat"), "x", "y", epsg), "lon", "lat", epsg, "x2", "y2")
    assert again.agg(F.max(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))).first()[0] < 1e-6


def test_distances_hold_the_scale(spark):
    rows = [(105.0, 10.0), (105.0, 10.001)]
    a, b = pr.to_utm(spark.createDataFrame(rows, "lon double, lat double"), "lon", "lat", 32648).orderBy("lat").collect()
    m = pr.AXIS * (1 - pr._E**2) / (1 - pr._E**2 * math.sin(math.radians(10.0005)) ** 2) ** 1.5
    assert b["y"] - a["y"] == pytest.approx(0.9996 * m * math.radians(0.001), abs=1e-5)


def test_zones():
    assert (pr.zone_of(106.7, 10.8), pr.zone_of(108.2, 16.0), pr.zone_of(18.4, -33.9)) == (32648, 32649, 32734)
    assert pr._zone(32648) == (105.0, 0.0)
    for bad in (4326, 32661, 32700, 32900):
        with pytest.raises(ValueError, match="no UTM"):
            pr._zone(bad)


def grid(seed=1, rows=8, cols=9):
    rng = random.Random(seed)
    return {(r, c): round(rng.uniform(0, 50), 2) for r in range(rows) for c in range(cols) if rng.random() > 0.15}


def test_resampling_against_scalar_interpolation(spark):
    cells, rng = grid(), random.Random(2)
    source = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(20, 20, None)], "r long, c long, v double")
    left, top, width, height = 100.0, 20.0, 0.5, 0.25
    places = [(i, rng.uniform(99.5, 105), rng.uniform(17.5, 20.4)) for i in range(120)] + [(900, 100.25, 19.875), (901, 101.0, 19.5), (901, 101.0, 19.5), (902, 0.0, 0.0)]
    df = spark.createDataFrame(places, "id long, lon double, lat double").withColumn("v", F.lit("old")).withColumn("r", F.lit(1)).withColumn("c", F.lit(1))
    near = sorted((r["id"], r["v"]) for r in pr.resample(source, df, left, top, width, height, "nearest").collect() if r["v"] is not None)
    assert near == sorted((i, cells[k]) for i, x, y in places for k in [(math.floor((top - y) / height), math.floor((x - left) / width))] if k in cells)
    got = pr.resample(source, df, left, top, width, height, "bilinear")
    assert got.count() == len(places) and set(got.columns) == {"id", "lon", "lat", "r", "c", "v"}
    found = {}
    for r in got.collect():
        found[r["id"]] = r["v"]
    for i, x, y in places:
        rr, cc = (top - y) / height - 0.5, (x - left) / width - 0.5
        r0, c0 = math.floor(rr), math.floor(cc)
        around = [(cells[r0 + a, c0 + b], (rr - r0 if a else 1 - rr + r0) * (cc - c0 if b else 1 - cc + c0)) for a in (0, 1) for b in (0, 1) if (r0 + a, c0 + b) in cells]
        total = sum(w for _, w in around)
        assert found[i] == (pytest.approx(sum(v * w for v, w in around) / total, abs=1e-9) if total else None)
    with pytest.raises(ValueError, match="cubic"):
        pr.resample(source, df, left, top, width, height, "cubic")
    assert pr.resample(source.limit(0), df, left, top, width, height, "bilinear").filter("v is not null").count() == 0


def test_a_plane_stays_a_plane(spark):
    """A slope over longitude and latitude, resampled to a metric grid, tells the slope at each middle."""
    source = spark.createDataFrame([(r, c, 3.0 * (106.0 + (c + 0.5) * 0.001) - 2.0 * (11.0 - (r + 0.5) * 0.001)) for r in range(60) for c in range(60)], "r long, c long, v double")
    x0, y0 = (pr.to_utm(spark.createDataFrame([(106.02, 10.98)], "lon double, lat double"), "lon", "lat", 32648).first()[k] for k in ("x", "y"))
    cells = pr.grid_cells(spark.range(40).selectExpr("id div 8 as r", "id % 8 as c"), round(x0), round(y0), 30.0)
    got = pr.resample(source, pr.from_utm(cells, "x", "y", 32648), 106.0, 11.0, 0.001, 0.001, "bilinear")
    assert got.agg(F.max(F.abs(F.col("v") - (3 * F.col("lon") - 2 * F.col("lat"))))).first()[0] < 1e-9
    assert {(r["r"], r["c"]) for r in got.collect()} == {(i // 8, i % 8) for i in range(40)}
