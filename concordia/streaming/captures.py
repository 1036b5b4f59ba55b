"""Captures as a stream: duplicates, counts by window, the latest of each key, impossible journeys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concordia.functions.transforms import EARTH_KM
from concordia.operators.cleansing import MAX_KMH


def without_duplicates(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """One capture per plate, place and time; the memory of what was seen ends with the watermark."""
    return captures.withWatermark("at", late).dropDuplicatesWithinWatermark(["plate_id", "location", "at"])


def per_window(captures: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Captures and different plates per place and tumbling window; later ones than the watermark are left out."""
    return captures.withWatermark("at", late).groupBy(F.window("at", width), "location").agg(F.count("*").alias("n"), F.approx_count_distinct("plate_id").alias("plates")).select("window.start", "window.end", "location", "n", "plates")


def latest(captures: DataFrame) -> DataFrame:
    """The latest capture of each plate, updated as they come (update mode)."""
    return captures.groupBy("plate_id").agg(F.max(F.struct("at", "capture_id", "location")).alias("last")).select("plate_id", "last.at", "last.capture_id", "last.location")


def _km(a: float, b: float, c: float, d: float) -> float:
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * EARTH_KM * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def impossible_journeys(captures: DataFrame, tolerance_min: float = 10.0, forget: str = "1 day") -> DataFrame:
    """(plate_id, from_at, at, km, kmh) of journeys faster than a car; the state is one place and time per plate, dropped after a while."""
    hours = pd.Timedelta(forget)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get if state.exists else None), []
        for at, lat, lon in sorted((r.at, r.lat, r.lon) for b in batches for r in b.itertuples()):
            if last is not None and at.value >= last[0]:
                minutes = (at.value - last[0]) / 60e9 + tolerance_min
                km = _km(last[1], last[2], lat, lon)
                if minutes > 0 and km / (minutes / 60) > MAX_KMH:
                    out.append((key[0], pd.Timestamp(last[0]), at, km, km / (minutes / 60)))
            if last is None or at.value >= last[0]:
                last = (at.value, float(lat), float(lon))
        state.update(last)
        state.setTimeoutTimestamp(int(last[0] // 1_000_000) + int(hours.total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["plate_id", "from_at", "at", "km", "kmh"])

    schema = "plate_id string, from_at timestamp, at timestamp, km double, kmh double"
    return captures.withWatermark("at", "1 hour").groupBy("plate_id").applyInPandasWithState(step, schema, "at_ns long, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)
