"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from oddsmith.catalog.views import with_views
from oddsmith.sources.bindings import Tables

DIGITS = 6


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int


ENTRIES: dict[str, Entry] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> None:
    """Register a query; ``doubles`` names its double columns (rounded on both sides)."""
    if name in ENTRIES:
        raise ValueError(f"duplicate query {name}")
    ENTRIES[name] = Entry(build, sql, tuple(doubles.split()), digits)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of places, with -0.0 made 0.0: sums differ in the last bits by order."""
    doubles = {f.name: _round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, DoubleType)}
    return df.withColumns(doubles) if doubles else df


def _round(x: Column, digits: int) -> Column:
    """``F.round``, which goes through decimals, only for what may be a tie, is large or not finite: elsewhere the nearest whole number of steps is sure."""
    scale = F.lit(10.0 ** digits)
    steps = x * scale
    whole = F.rint(steps)
    sure = (F.abs(steps) < 2.0 ** 40) & (F.abs(F.abs(steps - whole) - 0.5) > 1e-3)
    return F.when(sure, whole / scale).otherwise(F.round(x, digits))


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    entry = ENTRIES[name]
    return rounded(entry.build(Tables(spark, folder)), entry.digits)


def oracle(name: str) -> str | None:
    entry = ENTRIES[name]
    if entry.sql is None:
        return None
    sql = with_views(entry.sql)
    if entry.doubles:
        parts = ", ".join(f"round(CAST({c} AS DOUBLE), {entry.digits}) + 0e0 AS {c}" for c in entry.doubles)
        sql = f"SELECT * REPLACE ({parts}) FROM ({sql}) AS result"
    return sql
