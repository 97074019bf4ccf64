"""Sources, sinks, checks, matching, terrain kernels, triggers, scorers and the command line."""

import itertools
import json
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import cli
from tidewright.functions import stats, text
from tidewright.operators import checks, evidence, geometry, kernels, raster, sampling, scorers, spatial, triggers
from tidewright.sources import payloads, rasters, shared, sinks

SF = "/root/testdata/sf0.001"


def test_repeated_keys_fail_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert checks.unique(df.filter("k = 1"), "k").collect()[0]["v"] == "a"
    with pytest.raises(Exception, match="repeated key"):
        checks.to_one(df, df, ["k"]).collect()


def test_forbidden_columns():
    assert checks.model_columns(["route_id", "x", "slope"]) == ["slope"]
    with pytest.raises(ValueError, match="city"):
        checks.assert_allowed(["city", "slope"])


def test_empty_names_are_not_alike(spark):
    df = spark.createDataFrame([("", ""), (None, "a"), ("le loi", "le loi"), ("le loi", "le lai")], "a string, b string")
    got = [r[0] for r in df.select(text.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.0, 0.0, 1.0] and got[3] == pytest.approx(10 / 12)


def test_named_report_meets_its_road(spark):
    line = [(0.0, 0.0), (110.0, 0.0)]
    routes = spark.createDataFrame([("r1", "nguyen hue", True, line)], "route_id string, name_norm string, named boolean, line array<struct<x:double,y:double>>")
    records = spark.createDataFrame([("a", "Nguyen Hue", "street", 55.0, 5.0), ("b", None, "point", 9e6, 0.0)], "record_id string, raw string, location_precision string, x double, y double")
    got = {r["record_id"]: (r["route_id"], r["match_type"]) for r in spatial.match_records(records, routes).collect()}
    assert got == {"a": ("r1", "name+distance"), "b": (None, "unmatched")}


def test_lines(spark):
    line = [(0.0, 0.0), (3.0, 4.0), (3.0, 14.0)]
    df = spark.createDataFrame([(line,)], "line array<struct<x:double,y:double>>")
    p = geometry.point_at(F.col("line"), F.lit(10.0))
    row = df.select(geometry.length(F.col("line")).alias("n"), p["x"].alias("x"), p["y"].alias("y")).first()
    assert (row["n"], row["x"], row["y"]) == (15.0, 3.0, 9.0)
    at = [r["at"] for r in geometry.sample_line(df, "line", 4.0).collect()]
    assert at == [0.0, 4.0, 8.0, 12.0, 15.0]
    ring = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)],)], "r array<struct<x:double,y:double>>")
    assert ring.select(geometry.area(F.col("r"))).first()[0] == 6.0


def brute_fill(z, valid):
    f = np.where(valid, np.inf, np.nan)
    rows, cols = z.shape
    near = lambda r, c: [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    inside = lambda y, x: 0 <= y < rows and 0 <= x < cols and valid[y, x]
    while True:
        old = f.copy()
        for r, c in itertools.product(range(rows), range(cols)):
            if valid[r, c]:
                out = z[r, c] if any(not inside(y, x) for y, x in near(r, c)) else min(max(z[r, c], f[y, x]) for y, x in near(r, c))
                f[r, c] = min(f[r, c], out)
        if np.array_equal(old, f, equal_nan=True):
            return f


def test_terrain_kernels_against_brute_force():
    rng = np.random.default_rng(2)
    z = rng.integers(0, 9, (9, 11)).astype(float)
    valid = rng.random(z.shape) > 0.1
    assert np.allclose(kernels.fill_depressions(z, valid), brute_fill(z, valid), equal_nan=True)
    dist, row, col = kernels.nearest(~valid)
    for r, c in itertools.product(*map(range, z.shape)):
        want = min((math.hypot(r - y, c - x), y * 11 + x) for y, x in zip(*np.nonzero(~valid), strict=True))
        assert (dist[r, c], row[r, c] * 11 + col[r, c]) == pytest.approx(want)


def test_local_share_against_brute_force(spark):
    rng = np.random.default_rng(2)
    z = rng.integers(0, 9, (9, 11)).astype(float)
    valid = rng.random(z.shape) > 0.1
    rows = [(g, int(r), int(c), float(z[r, c]) if g else 4.0) for g in (0, 1) for r, c in zip(*np.nonzero(valid), strict=True)]
    got = {tuple(r)[:3]: r["share"] for r in raster.local_share(spark.createDataFrame(rows, "grid long, r long, c long, v double"), 2, 9).collect()}
    assert len(got) == len(rows)
    lo, hi = z[valid].min(), z[valid].max()
    for r, c in zip(*np.nonzero(valid), strict=True):
        box = np.s_[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3]
        cut = lo + (min(8, int((z[r, c] - lo) / (hi - lo) * 9)) + 1) * (hi - lo) / 9
        assert got[1, r, c] == pytest.approx((z[box][valid[box]] <= cut).mean()) and got[0, r, c] == 0.5


def test_flow_crosses_a_flat_and_counts_every_cell():
    z = np.array([[9.0, 8, 7], [8, 7, 6], [7, 6, 5]])
    acc = kernels.flow(z, np.ones_like(z, bool))
    assert acc[2, 2] == 9 and acc[0, 0] == 1
    flat, valid = np.full((7, 7), 3.0), np.ones((7, 7), bool)
    valid[0, :] = False
    acc = kernels.flow(flat, valid)
    assert np.isnan(acc[0, 0]) and acc[1].sum() == valid.sum()
    assert kernels.slope(z, np.ones_like(z, bool), 1.0)[1, 1] == pytest.approx(math.sqrt(2))


def test_reports_repeat_before_the_update(spark):
    rows = [("2024-01-01 11:20:00", 5.0, 1), ("2024-01-01 11:40:00", 35.0, 2), ("2024-01-01 12:00:00", 5.0, 3), ("2024-01-01 12:00:00", 99.0, 4)]
    df = spark.createDataFrame(rows, "ts string, depth double, id int").select(F.lit(1).alias("user_id"), F.lit(1).alias("route_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "depth", "id")
    assert sorted(r["id"] for r in evidence.kept(df, "id").collect()) == [1, 3]


def test_few_hours_of_rain_fail(spark):
    hours = spark.sql("select explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 09:00:00', interval 1 hour)) as hour").withColumn("mm", F.lit(1.0))
    row = triggers.trailing_windows(hours, "2024-01-01 09:00:00", 1).first()
    assert (row["max_3h"], row["total_24h"]) == (3.0, 10.0)
    with pytest.raises(Exception, match="six hours"):
        triggers.trailing_windows(hours, "2024-01-01 04:00:00", 1).collect()


def test_quantile_grid_against_numpy(spark):
    v = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 9.0, 1000.0]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "v double")
    got = [r["q"] for r in triggers.quantile_grid(df, "v", 20).orderBy("i").collect()]
    assert got == pytest.approx(np.quantile(v, np.linspace(0, 1, 21)).tolist())


def test_group_metrics_of_a_perfect_and_a_constant_score(spark):
    rows = [("a", i, int(i > 5)) for i in range(10)] + [("b", 0, i % 2) for i in range(10)]
    got = {r["g"]: r for r in stats.group_metrics(spark.createDataFrame(rows, "g string, s int, y int"), "g", "s", "y").collect()}
    assert (got["a"]["auc"], got["a"]["ap"], got["a"]["recall"]) == (1.0, 1.0, 0.25)
    assert (got["b"]["auc"], got["b"]["recall"]) == (0.5, pytest.approx(0.1))


def test_resampling_the_same_rule_differs_by_nothing(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 3 == 0).cast("double").alias("a"))
    z = sampling.resampled(df, F.col("id").cast("string"), 50, {"x": "a", "y": "a"})
    assert z.filter("x <> y").isEmpty() and z.count() == 50


def test_folds_keep_blocks_whole(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((300, 2)) * 9)], "id int, x double, y double")
    got = sampling.folds(df, 1.0, 5)
    assert got.groupBy("bx", "by_").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 12


def test_a_scorer_of_ones_own(spark):
    @scorers.register("own")
    class Own:
        def fit(self, train):
            self.mean = train.agg(F.avg("v")).first()[0]
            return self

        def score(self, df, out):
            return df.withColumn(out, F.col("v") - self.mean)

    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert [r["s"] for r in scorers.score(scorers.REGISTRY["own"](), df, df, "s").collect()] == [-1.0, 1.0]


def test_logistic_scorer_ranks_and_fills(spark):
    df = spark.createDataFrame([(float(i) if i % 7 else None, float(i > 20)) for i in range(40)], "v double, label double")
    got = scorers.Logistic(["v"]).fit(df).score(df, "s")
    assert stats.auc(got.filter("v is not null").withColumn("y", F.col("label").cast("int")), "s", "y").first()["auc"] == 1.0
    one = scorers.Logistic(["v"]).fit(df.filter("label = 0")).score(df, "s")
    assert one.agg(F.max("s")).first()[0] < 0.01


def test_sinks_round_trip(spark, tmp_path):
    out = f"file://{tmp_path}"
    sinks.write_status(spark, f"{out}/status.json", {"city": "x"})
    assert json.loads(sinks.read_text(spark, f"{out}/status.json")) == {"city": "x"}
    sinks.mark_once(spark, f"{out}/used", {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.mark_once(spark, f"{out}/used", {"a": 2})
    assert sinks.freeze(spark, f"{out}/c.json", {"k": 1}) == sinks.freeze(spark, f"{out}/c.json", {"k": 2}) == {"k": 1}
    sinks.append_ledger(spark.createDataFrame([(1, "a")], "n int, s string"), f"{out}/ledger")
    sinks.append_ledger(spark.createDataFrame([(2, 0.5)], "n int, f double"), f"{out}/ledger")
    rows = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/ledger").orderBy("n").collect()
    assert [(r["n"], r["s"], r["f"]) for r in rows] == [("1", "a", None), ("2", None, "0.5")]
    assert "| 1 | a |" in sinks.markdown("T", spark.createDataFrame([(1, "a")], "n int, s string"))
    df = spark.createDataFrame([(1, {"type": "Point", "x": 1.5})], "id int, g struct<type:string,x:double>")
    sinks.write_features(df, "g", f"{out}/features")
    assert json.loads(spark.read.text(f"{out}/features").first()[0])["properties"] == {"id": 1}
    line = [(0.0, -1.5), (106.7001, 10.0), (1e-3, 3.0)]
    sinks.write_geometry(spark.createDataFrame([(1, line)], "id int, line array<struct<x:double,y:double>>"), f"{out}/geo", "line")
    assert rasters.decode_wkb(bytes(spark.read.parquet(f"{out}/geo").first()["line"]))[:2] == ("LineString", [line])


def test_grid_files_round_trip(spark, tmp_path):
    z = np.arange(12.0).reshape(3, 4)
    z[1, 2] = np.nan
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(z, 100.0, 50.0, 30.0))
    rows = {(r["r"], r["c"]): r for r in rasters.read_grids(spark, f"file://{tmp_path}/a.tif").collect()}
    assert len(rows) == 12 and rows[1, 2]["v"] is None and rows[2, 3]["v"] == 11.0
    assert (rows[2, 3]["x"], rows[2, 3]["y"]) == (205.0, -25.0)


def test_layers_of_a_package(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("insert into gpkg_geometry_columns values ('roads', 'geom')")
    con.execute("create table roads (geom blob, name text, lanes integer)")
    shape = b"GP\0\x01" + struct.pack("<i", 4326) + struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    con.executemany("insert into roads values (?, ?, ?)", [(shape, "A", 2), (None, None, None)])
    con.commit()
    con.close()
    rows = rasters.read_layer(spark, f"file://{tmp_path}/a.gpkg", "roads", ["name", "lanes"]).collect()
    assert [(r["kind"], r["name"], r["lanes"]) for r in rows] == [("LineString", "A", "2"), (None, None, None)]
    assert [(p["x"], p["y"]) for p in rows[0]["parts"][0]] == [(0.0, 1.0), (2.0, 3.0)]


def test_other_years_are_not_opened(spark, tmp_path):
    x = spark.createDataFrame([("2023-05-01 00:00:00", 1.0, 10.0, 106.0, 2023), ("2024-05-01 00:00:00", 2.0, 10.0, 106.0, 2024), ("2024-05-01 00:00:00", 2.0, 10.0, 106.0, 2024)], "time string, precipitation double, latitude_returned double, longitude_returned double, year int")
    x.withColumn("time", F.col("time").cast("timestamp_ntz")).write.partitionBy("year").parquet(f"file://{tmp_path}/h")
    got = payloads.hourly_files(spark, f"file://{tmp_path}/h", 2024, 2024, "2024-12-31")
    assert [r["mm"] for r in got.collect()] == [2.0]


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "q_risk_levels" in capsys.readouterr().out
    assert cli.main(["run", "q_route_id", "--tables", SF, "--out", f"file://{tmp_path}"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/q_route_id").count() == 200
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--tables", SF, "--out", str(tmp_path)])


def test_running_totals_with_an_outlier_and_one_score(spark):
    rows = [(float(i % 500) / 1e6, 1) for i in range(3000)] + [(1e18, 1), (-1e18, 1)]
    df = spark.createDataFrame(rows, "v double, n long")
    by = df.groupBy("v").agg(F.sum("n").alias("c"))
    got = {r["v"]: r["t"] for r in stats.running(by, "v", {"t": "c"}).collect()}
    assert got == {v: sum(x <= v for x, _ in rows) for v in {v for v, _ in rows}}
    sizes = [r["n"] for r in stats.ranged(by, F.col("v")).groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * by.count()
    same = spark.range(2000).select("id", F.lit(7).alias("s"))
    assert [r["id"] for r in stats.row_ranks(same, "s", F.col("id")).orderBy("rn").collect()] == list(range(2000))
    sizes = [r["n"] for r in stats.ranged(same, F.desc("s"), F.col("id")).groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 0.6 * 2000
