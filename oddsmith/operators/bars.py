"""Price bars, their roll-up, resampling and alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.operators.ordered import DAY, time_chunk, with_row_number
from oddsmith.operators.versions import order_key


def bucket(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed bucket that holds ``ts`` (epoch aligned)."""
    size = seconds * 1_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / F.lit(size)) * F.lit(size)).cast("long"))


def ohlcv_bars(trades: DataFrame, seconds: int, key: Sequence[str] = ("condition_id", "outcome"), tie: str = "trade_id") -> DataFrame:
    """Bars that can be merged later: the open and close keep the time they were seen.

    All aggregates combine before the shuffle, so a hot market costs one row per
    (input partition, bar).
    """
    when = order_key(trades, "ts", tie)
    return trades.groupBy(*key, bucket("ts", seconds).alias("bar_time")).agg(
        F.min_by("price", when).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", when).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("trade_count"),
        F.sum(F.when(F.col("side") == "buy", F.col("size")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(F.col("side") == "sell", F.col("size")).otherwise(0.0)).alias("sell_volume"),
        F.min("ts").alias("open_ts"),
        F.max("ts").alias("close_ts"),
    )


def partial_bars(trades: DataFrame, seconds: int, key: Sequence[str] = ("condition_id", "outcome"), tie: str = "trade_id") -> DataFrame:
    """Bars of some of the trades, with the tie-break of open and close, so that any split of the trades merges to the same bars."""
    when = order_key(trades, "ts", tie)
    ids = trades.groupBy(*key, bucket("ts", seconds).alias("bar_time")).agg(F.min_by(tie, when).alias("open_id"), F.max_by(tie, when).alias("close_id"))
    return ohlcv_bars(trades, seconds, key, tie).join(ids, [*key, "bar_time"])


def merge_bars(bars: DataFrame, key: Sequence[str] = ("condition_id", "outcome")) -> DataFrame:
    """One bar a key and time from partial ones."""
    first, last = F.struct("open_ts", "open_id"), F.struct("close_ts", "close_id")
    return bars.groupBy(*key, "bar_time").agg(
        F.min_by("open", first).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", last).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("buy_volume").alias("buy_volume"),
        F.sum("sell_volume").alias("sell_volume"),
        F.min("open_ts").alias("open_ts"),
        F.max("close_ts").alias("close_ts"),
        F.min_by("open_id", first).alias("open_id"),
        F.max_by("close_id", last).alias("close_id"),
    )


def rollup_bars(bars: DataFrame, seconds: int, key: Sequence[str] = ("condition_id", "outcome")) -> DataFrame:
    """Merge stored bars into longer ones without going back to the trades."""
    return bars.groupBy(*key, bucket("bar_time", seconds).alias("bar_time")).agg(
        F.min_by("open", "open_ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("buy_volume").alias("buy_volume"),
        F.sum("sell_volume").alias("sell_volume"),
        F.min("open_ts").alias("open_ts"),
        F.max("close_ts").alias("close_ts"),
    )


def volume_daily(trades: DataFrame, key: Sequence[str] = ("condition_id",)) -> DataFrame:
    """Daily totals; the vwap numerator is stored so that days merge by addition."""
    def side(name):
        return F.sum(F.when(F.col("side") == name, F.col("size")).otherwise(0.0))

    return trades.groupBy(*key, F.to_date("ts").alias("day")).agg(
        F.sum("size").alias("volume"),
        side("buy").alias("buy_volume"),
        side("sell").alias("sell_volume"),
        F.count("*").alias("trade_count"),
        F.sum(F.col("price") * F.col("size")).alias("notional"),
    )


def with_vwap(daily: DataFrame) -> DataFrame:
    return daily.withColumn("vwap", F.col("notional") / F.nullif("volume", F.lit(0.0)))


def resample(df: DataFrame, key: Sequence[str], seconds: int, aggs: Sequence[Column], at: str = "ts") -> DataFrame:
    return df.groupBy(*key, bucket(at, seconds).alias("bucket")).agg(*aggs)


def align_ffill(series: DataFrame, key: Sequence[str], value: str, at: str = "bucket") -> DataFrame:
    """Put every series on the union of all buckets; fill forward, the head backward.

    Each observed point is copied over its own gap, so the dense result is produced
    where it is needed: no cross product of axis and series and no window over the
    dense rows.  The axis has one row per time bucket.
    """
    axis = with_row_number(series.select(at).distinct(), [], [at], time_chunk(at, DAY), "_pos")
    points = series.where(F.col(value).isNotNull()).join(axis, at)
    last = axis.agg(F.max("_pos").alias("_len"))
    w = Window.partitionBy(*key).orderBy("_pos")
    spans = (
        points.crossJoin(F.broadcast(last))  # one row
        .withColumn("_from", F.when(F.lag("_pos").over(w).isNull(), F.lit(1)).otherwise(F.col("_pos")))
        .withColumn("_to", F.coalesce(F.lead("_pos").over(w) - 1, F.col("_len")))
    )
    dense = spans.select(*key, value, F.explode(F.sequence("_from", "_to")).alias("_pos"))
    return dense.join(axis, "_pos").select(*key, at, value)


def bars_or_trades(primary: DataFrame, fallback: DataFrame, key: Sequence[str]) -> DataFrame:
    """Primary bars, and for keys that have none the fallback bars."""
    missing = fallback.join(primary.select(*key).distinct(), list(key), "left_anti")
    return primary.unionByName(missing)
