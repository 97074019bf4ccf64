"""Matched roads, kept reports and ranks within keys against plain versions."""

import datetime as dt
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from tidewright.functions import stats
from tidewright.operators import evidence, sampling
from tidewright.plans import reporting

SF = "/root/testdata/sf0.001"


def similar(a, b):
    x, y = set(a.split()), set(b.split())
    return max(len(x & y) / len(x | y), SequenceMatcher(None, a, b).ratio())


def test_roads_are_matched_by_name_and_segment_distance(spark):
    roads = reporting.roads(spark, SF).collect()
    ends = np.array([[(a["x"], a["y"], b["x"], b["y"]) for a, b in zip(r["line"], r["line"][1:], strict=False)] for r in roads])
    want, kinds = {}, set()
    for r in reporting.road_reports(spark, SF).collect():
        name = r["raw"].split(",")[0].split(" ", 1)[1].lower()
        a, b = ends[..., :2], ends[..., 2:]
        p = np.array([r["x"], r["y"]])
        u = np.clip(((p - a) * (b - a)).sum(-1) / ((b - a) ** 2).sum(-1), 0, 1)
        dist = np.linalg.norm(p - a - u[..., None] * (b - a), axis=-1).min(1)
        reach = 500 if r["location_precision"] in ("street", "area") else 150
        near = [(d, road) for d, road in zip(dist, roads, strict=True) if d <= reach]
        named = [(d, x["route_id"]) for d, x in near if x["named"] and similar(name, x["name_norm"]) >= 0.55]
        close = [(d, x["route_id"]) for d, x in near if d <= 40]
        kind = "name+distance" if named else "distance" if close else "unmatched"
        d, road = min(named or close or [(None, None)])
        want[r["record_id"]] = (road, kind, None if d is None else round(d, 4))
        kinds.add(kind)
    got = {r["record_id"]: (r["route_id"], r["match_type"], None if r["dist"] is None else round(r["dist"], 4)) for r in reporting.q_road_match_names(spark, SF).collect()}
    assert got == want
    assert len(kinds) == 3


def test_kept_reports_equal_a_greedy_walk(spark):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(u, r, start + dt.timedelta(minutes=rng.choice([1, 5, 10, 30]) * k)) for u in range(3) for r in range(3) for k in range(rng.randrange(0, 40))]
    rows += [(0, 0, start), (0, 0, None)]
    want = set()
    for key in {x[:2] for x in rows}:
        last = None
        for ts in sorted(x[2] for x in rows if x[:2] == key and x[2]):
            if last is None or ts >= last + dt.timedelta(minutes=30):
                last = ts
                want.add((*key, ts))
    got = evidence.deduplicate(spark.createDataFrame(rows, "user_id long, route_id long, ts timestamp_ntz")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_ranks_within_keys_with_ties_and_a_missing_key(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(4)) for i in range(300)]
    got = {r["i"]: r["rn"] for r in stats.row_ranks(spark.createDataFrame(rows, "i long, k string, s long"), "s", F.col("i"), keys=("k",)).collect()}
    for key in ("a", "b", None):
        order = sorted((x for x in rows if x[1] == key), key=lambda x: (-x[2], x[0]))
        assert [got[x[0]] for x in order] == list(range(1, len(order) + 1))


def test_matched_rows_are_as_many_as_the_rare_ones(spark):
    rows = [(i, "ab"[i % 2], i % 20 < 3) for i in range(200)] + [(900, "c", False), (901, "d", True)]
    got = sampling.matched(spark.createDataFrame(rows, "id long, key string, rare boolean"), "id", "key", "rare", 1).collect()
    count = {k: sum(1 for r in got if r["key"] == k) for k in "abcd"}
    assert count == {k: sum(1 for r in rows if r[1] == k and r[2]) for k in "ab"} | {"c": 0, "d": 0}


def test_foreign_counts_keep_only_the_probes(spark):
    ref = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 5)], "v double")
    probe = spark.createDataFrame([(0.0,), (2.0,), (2.0,), (9.0,), (None,)], "v double")
    assert sorted(map(tuple, stats.foreign_le(ref, probe, "v").collect())) == [(0.0, 0), (2.0, 3), (9.0, 4)]
