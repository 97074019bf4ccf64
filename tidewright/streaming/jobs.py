"""Structured Streaming jobs: windowed rain and decayed evidence with keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import FLOODED, HALF_LIFE, OFFICIAL


def windowed_rain(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sum and count by cell and hour, final once the watermark has passed."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("cell"))
        .agg(F.sum("value").alias("mm"), F.count(F.lit(1)).alias("n"))
        .select("cell", F.col("w.start").alias("hour"), "mm", "n")
    )


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: log-odds at the time of the latest report; a later report decays it, an earlier one decays itself."""
    odds, last = state.get if state.exists else (0.0, -math.inf)
    for part in parts:
        for at, status, official in zip(part["at"], part["status"], part["official"], strict=True):
            now = at.timestamp()
            add = math.log(1 / FLOODED if status == "dry" else OFFICIAL if official else FLOODED)
            decay = 0.5 ** (abs(now - last) / 60 / HALF_LIFE) if last > -math.inf else 0.0
            odds = odds * decay + add if now >= last else odds + add * decay
            last = max(last, now)
    state.update((odds, last))
    yield pd.DataFrame({"route_id": [key[0]], "log_odds": [odds], "last": [last]})


def evidence(reports: DataFrame) -> DataFrame:
    """Running log-odds by route from reports(route_id, ts, status, official)."""
    rows = reports.filter("status is not null").select("route_id", F.col("ts").cast("timestamp").alias("at"), "status", "official")
    return rows.groupBy("route_id").applyInPandasWithState(_fold, "route_id long, log_odds double, last double", "odds double, last double", "update", GroupStateTimeout.NoTimeout)
