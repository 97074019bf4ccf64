"""Golden cases and a sweep of the catalogue against DuckDB."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import stats, text
from tidewright.operators import evidence, graph, raster, series, spatial
from tidewright.plans import decisions, evaluation, intake, models, scoring, terrain  # noqa: F401  all add to the catalogue
from tidewright.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_names(spark):
    df = spark.createDataFrame([("Đường Nguyễn Huệ",), (" PHỐ   Trần Hưng Đạo ",), (None,)], "n string")
    assert [r[0] for r in df.select(text.normalize_name("n")).collect()] == ["nguyen hue", "tran hung dao", None]


def test_depth_classes(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (30.0,), (30.01,), (None,)], "d double")
    assert [r[0] for r in df.select(text.depth_class(F.col("d"))).collect()] == ["<10", "10-30", "10-30", ">30", "unknown"]


def test_split_by_year(spark):
    df = spark.createDataFrame([(2025,), (2024,), (None,)], "y int")
    got = df.select(text.temporal_split(F.lit(None).cast("date"), F.col("y"), "2025-01-01")).collect()
    assert [r[0] for r in got] == ["test_locked_undated", "train_undated", "train_undated"]


def test_percent_rank_with_ties_and_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 2.0), (4, None)], "id int, v double")
    got = {r["id"]: r["p"] for r in stats.percent_rank(df, "v", "p").collect()}
    assert got == {1: 2.5 / 3, 3: 2.5 / 3, 2: 1 / 3, 4: None}


def test_interpolation_takes_the_last_repeated_knot(spark):
    xs, ys = [0.0, 0.0, 0.0, 1.0, 2.0], [0.0, 0.25, 0.5, 0.75, 1.0]
    assert [one(spark, stats.interpolate(F.lit(v), xs, ys)) for v in (-1.0, 0.0, 1.5, 3.0)] == [0.0, 0.5, 0.875, 1.0]


def test_day_confined_rolling(spark):
    mm = [1.0] * 54
    mm[22] = mm[23] = 20.0
    mm[24] = mm[25] = 100.0
    rows = [("c", h, v) for h, v in enumerate(mm)]
    df = spark.createDataFrame(rows, "cell string, h int, mm double").select("cell", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,h)").alias("hour"), "mm")
    day2 = series.day_confined(df, 3, "m3").filter(F.to_date("hour") == "2024-01-02").agg(F.max("m3")).first()[0]
    assert day2 == 201.0
    days = df.groupBy("cell", F.to_date("hour").alias("date")).agg(F.sum("mm").alias("mm"))
    assert series.antecedent(days, 1, "p").filter("date = '2024-01-02'").first()["p"] == 62.0


def test_odds(spark):
    def p(rows):
        df = spark.createDataFrame(rows, "route_id int, ts string, status string, official boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        return evidence.log_odds(df, "2024-01-01 12:00:00").select(evidence.updated(F.lit(0.5), F.col("shift"))).first()[0]

    now, old = "2024-01-01 12:00:00", "2024-01-01 11:30:00"
    assert p([(1, now, "flooded", False)]) == pytest.approx(0.75)
    assert p([(1, now, "dry", False)]) == pytest.approx(0.25)
    assert p([(1, now, "flooded", True)]) == pytest.approx(10 / 11)
    assert p([(1, old, "flooded", False)]) == pytest.approx(math.sqrt(3) / (1 + math.sqrt(3)))


def test_dedup_keeps_from_the_last_kept(spark):
    df = spark.createDataFrame([("2024-01-01 11:20:00",), ("2024-01-01 11:40:00",), ("2024-01-01 12:00:00",)], "ts string")
    df = df.select(F.lit(1).alias("user_id"), F.lit(1).alias("route_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    assert sorted(str(r["ts"])[11:16] for r in evidence.deduplicate(df).collect()) == ["11:20", "12:00"]


def test_modal_level_prefers_severity(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (1, 0)], "k int, s int")
    assert evidence.modal_level(df, "k", F.col("s")).first()["severity"] == 2


def test_distance_join_is_whole(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r["id"], r["rid"]) for r in spatial.distance_join(df, df.toDF("rid", "rx", "ry"), 0.3).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.3}


def test_point_segment(spark):
    args = [F.lit(float(v)) for v in (5, 3, 0, 0, 10, 0)]
    assert one(spark, spatial.point_segment(*args)) == 3.0


def test_bowl_fills_and_ramp_drains():
    z = np.full((5, 5), 10.0)
    z[2, 2] = 0
    assert raster.fill_depressions(z, np.ones_like(z, bool))[2, 2] == 10
    acc = raster.flow_accumulation(np.array([[9.0, 8, 7], [8, 7, 6], [7, 6, 5]]))
    assert acc[2, 2] > acc[0, 0]


def test_auc_of_a_perfect_score(spark):
    df = spark.createDataFrame([(i, int(i > 5)) for i in range(10)], "s int, y int")
    assert stats.auc(df, "s", "y").first()["auc"] == 1.0
    assert stats.recall_at(df, "s", "y", 0.1).first()["recall"] == 0.25


@pytest.mark.parametrize("name", sorted(SQL))
def test_catalogue_row_counts(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    numeric = [c for c, k in got.dtypes if k in ("double", "bigint", "int")]
    row = got.agg(F.count(F.lit(1)), *[F.sum(c) for c in numeric]).first()
    sums = con.sql(f"select count(*), {', '.join(f'sum({c})' for c in numeric) or '0'} from ({SQL[name]})").fetchall()[0]
    assert row[0] == sums[0]
    for a, b in zip(row[1:], sums[1 : 1 + len(numeric)], strict=True):
        assert (a is None and b is None) or float(a) == pytest.approx(float(b), rel=1e-6, abs=1e-4)


def test_harmonic_fit_recovers_a_tide(spark):
    angle = F.col("h") * math.radians(scoring.SPEEDS[0])
    df = spark.range(500).select(F.col("id").cast("double").alias("h")).withColumn("y", 2.0 + 3 * F.cos(angle) - F.sin(angle))
    coef, fitted = scoring.harmonic_fit(df, "h", "y")
    assert [round(c, 4) for c in coef[:3]] == [2.0, 3.0, -1.0]
    assert df.select(F.max(F.abs(fitted - F.col("y")))).first()[0] < 1e-6


def test_harmonic_fit_of_nothing(spark):
    coef, _ = scoring.harmonic_fit(spark.createDataFrame([], "h double, y double"), "h", "y")
    assert not coef.any()


def test_isotonic_fit_does_not_decrease(spark):
    rows = sorted(QUERIES["q_isotonic"](spark, SF).collect())
    assert rows and all(a["fitted"] <= b["fitted"] for a, b in zip(rows, rows[1:], strict=False))


def test_logistic_scores_are_whole_and_in_range(spark):
    rows = QUERIES["q_lr_scores"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_components_of_a_chain_a_loop_and_a_lone_vertex(spark):
    rows = [(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61), (61, 60), (70, None), (80, 1)]
    v = spark.createDataFrame([(i,) for i in [*range(1, 41), 50, 60, 61, 61, 70]], "id long")
    got = {r["id"]: r["comp"] for r in graph.components(v, spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 41), 1) | {50: 50, 60: 60, 61: 60, 70: 70}
    assert graph.components(v.limit(0), v.limit(0).selectExpr("id as a", "id as b")).count() == 0


@pytest.mark.parametrize("name", ["q_gbt_scores", "q_pu_bagging"])
def test_model_scores_are_whole_and_rank_the_fitted_rows(spark, name):
    x = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = QUERIES[name](spark, SF).join(x, "vec_id").select("score", "label").collect()
    assert len(rows) == x.count() and all(0 <= r["score"] <= 1 for r in rows)
    wanted = (lambda y: y >= 5) if name == "q_gbt_scores" else (lambda y: y == 0)
    pos, neg = [[r["score"] for r in rows if wanted(r["label"]) == k] for k in (True, False)]
    assert sum(a > b for a in pos for b in neg) > 0.7 * len(pos) * len(neg)


def test_nearest_of_a_kind_with_copies_and_odd_rows(spark):
    """Against all pairs: copies, repeated ids, a dense spot, missing and infinite coordinates, points on the limit."""
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for i in range(150)]
    rows += [(200 + i, 0.25, 0.25) for i in range(30)] + [(300 + i, 0.3 + rng.gauss(0, 1e-5), -0.3) for i in range(30)]
    rows += [(7, 0.5, 0.5), (9, 5.0, 5.0), (12, 5.05, 5.0), (400, None, 0.0), (401, float("nan"), 0.0), (402, float("inf"), 0.0), (None, 0.25, 0.25), (403, 9.0, 9.0)]
    df = spark.createDataFrame([(*r, None if r[0] is None else r[0] % 3) for r in rows], "id long, x double, y double, kind long")
    want = {}
    for i, x, y in rows:
        for j, rx, ry in rows:
            if None in (i, j, x, rx) or i == j:
                continue
            d = math.sqrt((x - rx) ** 2 + (y - ry) ** 2)
            r = 0 if i % 3 == j % 3 and d <= 0.05 else 1 if i % 3 != j % 3 and d <= 0.02 else None
            if r is not None:
                want[i] = min(want.get(i, (9,)), (r, d, j))
    got = spatial.match_kinds(df, "kind", 0.05, 0.02).collect()
    assert len(got) == len(rows)
    for r in got:
        kind, dist, rid = want.get(r["id"], (None, None, None))
        assert (r["match_type"], r["rid"], r["dist"]) == ({0: "name+distance", 1: "distance", None: "unmatched"}[kind], rid, dist), r


def test_nearest_cell_makes_no_row_a_pair(spark, tmp_path, capsys):
    spark.createDataFrame([(i,) for i in range(25)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(5,), (5,), (None,), (17,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    from tidewright.plans.catalog import q_nearest_cell

    x = q_nearest_cell(spark, str(tmp_path))
    at = lambda k: min(range(25), key=lambda n: (round((k % 25 - n * 3.7 % 25) ** 2 + (k % 11 - n * 1.3 % 11) ** 2, 9), n))
    assert {r["c_custkey"]: r["cell"] for r in x.collect()} == {5: at(5), 17: at(17), None: 0} and x.count() == 3
    x.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_quantiles_between_rows(spark):
    """Against numpy: repeated values, a place on a row and between two, nulls, one value, none."""
    for v in ([3.5, 1.0, 1.0, 1.0, 2.25, 9.0, None], [4.0], [1.0, 2.0], list(map(float, range(11)))):
        got = stats.quantiles(spark.createDataFrame([(x,) for x in v], "v double"), "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
        assert tuple(got) == pytest.approx(tuple(np.quantile([x for x in v if x is not None], [0.1, 0.5, 0.9])))
    assert tuple(stats.quantiles(spark.createDataFrame([(None,)], "v double"), "v", {"a": 0.1}).first()) == (None,)


def test_groups_within_equal_all_pairs(spark):
    """Dense and thin spots, copies, repeated ids, points on the limit and odd rows, against a search over all pairs."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 0.12), rng.gauss(0, 0.12)) for i in range(260)] + [(300 + i, 0.5 + rng.gauss(0, 0.008), 0.5 + rng.gauss(0, 0.008)) for i in range(60)]
    rows += [(400 + i, 2.0, 2.0) for i in range(5)] + [(500 + i, 3 + i / 64, 0.0) for i in range(9)] + [(3, 2.0, 2.0), (600, float("nan"), 0.0), (601, None, 0.0), (602, float("inf"), 0.0)]
    least = {i: i for i, _, _ in rows}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, x, y in rows:
        for j, rx, ry in rows:
            if x is not None and rx is not None and math.sqrt((x - rx) ** 2 + (y - ry) ** 2) <= 1 / 64:
                a, b = sorted((top(i), top(j)))
                least[b] = a
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert dict(spatial.groups_within(df, 1 / 64).collect()) == {i: top(i) for i in least}
