"""Versioned tables: newest row per key, newest n per key, open-set difference."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType


def latest_version(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keep the row of greatest version per key.

    ``max_by`` is combined before the shuffle, so a key with many versions sends one
    row per input partition.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def limit_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First n rows per key; Spark filters each partition to n per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_snapshot(df: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """All rows at the newest time of their key (ties stay, as with a join to max(at))."""
    newest = df.groupBy(*key).agg(F.max(at).alias("_at"))
    return df.join(newest, list(key)).where(F.col(at) == F.col("_at")).drop("_at")


def order_key(df: DataFrame, at: str, tie: str) -> Column:
    """(time, id) as one number, so that ``max_by`` and ``min_by`` run as hash aggregates.

    A struct as the order makes every task sort its input.  Ids that are not integers
    keep the struct; integer ids must not be negative.
    """
    if not isinstance(df.schema[tie].dataType, (IntegerType, LongType)):
        return F.struct(at, tie)
    return F.unix_micros(at).cast("decimal(18,0)") * F.lit(Decimal(10**19)).cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")


def latest_price(prices: DataFrame, key: Sequence[str], at: str = "ts", tie: str = "trade_id") -> DataFrame:
    return prices.groupBy(*key).agg(
        F.max_by("price", order_key(prices, at, tie)).alias("price"), F.max(at).alias("price_time")
    )


def closed_since(opened: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that were open before and are not in the current result."""
    return opened.join(current, list(key), "left_anti")
