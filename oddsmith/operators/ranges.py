"""Interval joins on time buckets.

Each interval is copied to the buckets it touches and each point lies in one bucket,
so (key, bucket) is an equi-join key: a hot key is spread over its buckets and the
range predicate only filters inside one of them.  A point meets an interval at most
once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _slot(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def range_join(
    intervals: DataFrame,
    points: DataFrame,
    by: Sequence[str],
    start: str,
    end: str,
    at: str,
    width: int,
    closed: str = "left",
) -> DataFrame:
    """Inner join of points into intervals: ``left`` = [start, end), ``right`` = (start, end], ``both``."""
    spread = intervals.withColumn(
        "_slot", F.explode(F.sequence(_slot(F.col(start), width), _slot(F.col(end), width)))
    )
    placed = points.withColumn("_slot", _slot(F.col(at), width))
    low = F.col(at) >= F.col(start) if closed in ("left", "both") else F.col(at) > F.col(start)
    high = F.col(at) <= F.col(end) if closed in ("right", "both") else F.col(at) < F.col(end)
    return spread.join(placed, [*by, "_slot"], "inner").where(low & high).drop("_slot")
