"""Joins in time: impact measures, event windows, cut-offs, and the resolved-market set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago
from oddsmith.operators.asof import asof_join, asof_nearest
from oddsmith.operators.ranges import range_join
from oddsmith.operators.versions import limit_by

HOUR = 3600
DAY = 86400


def _shift(ts: str, seconds: int) -> Column:
    return F.col(ts) + F.make_dt_interval(secs=F.lit(seconds))


def price_impact(trades: DataFrame, prices: DataFrame, as_of: Column, seconds: int = 1800, delay: int = 60, min_usd: float = 500.0) -> DataFrame:
    """Mean |first price at or after the trade + delay - trade price| per market."""
    big = trades.where((F.col("ts") >= ago(as_of, seconds)) & (F.col("usdc_size") >= min_usd)).select(
        "condition_id", F.col("price").alias("trade_price"), _shift("ts", delay).alias("due"))
    quotes = prices.where(F.col("ts") >= ago(as_of, seconds)).select("condition_id", "ts", "trade_id", "price")
    hit = asof_join(big, quotes, ["condition_id"], "due", {"later": "price"}, "forward", right_on="ts", tie=["trade_id"])
    return hit.where("later is not null").groupBy("condition_id").agg(
        F.avg(F.abs(F.col("later") - F.col("trade_price"))).alias("impact"), F.count("*").alias("trades"))


def minute_impact(trades: DataFrame, as_of: Column, seconds: int = 900, within: int = 60, min_usd: float = 500.0) -> DataFrame:
    """Mean |p2 - p1| over later trades of the same market within a minute of a large trade.

    Trades of one market, time and price are counted first, so a burst of equal fills
    is one row on each side of the range join.
    """
    recent = trades.where(F.col("ts") >= ago(as_of, seconds))
    big = recent.where(F.col("usdc_size") >= min_usd).groupBy("condition_id", F.col("ts").alias("t1"), F.col("price").alias("p1")).agg(F.count("*").alias("n1"))
    later = recent.groupBy("condition_id", "ts", F.col("price").alias("p2")).agg(F.count("*").alias("n2"))
    hits = range_join(big.withColumn("until", _shift("t1", within)), later, ["condition_id"], "t1", "until", "ts", within, closed="right")
    n = F.col("n1") * F.col("n2")
    return hits.groupBy("condition_id").agg(
        (F.sum(F.abs(F.col("p2") - F.col("p1")) * n) / F.sum(n)).alias("impact"), F.sum(n).alias("pairs"))


def count_in_windows(events: DataFrame, signals: DataFrame, by: Sequence[str], event_id: Sequence[str], score: float = 30.0, width: int = HOUR) -> DataFrame:
    """Every event with its number of signals in [window_start, window_end) of at least ``score``."""
    hits = range_join(
        events.select(*by, *event_id, "window_start", "window_end") if not set(by) <= set(event_id) else events.select(*event_id, "window_start", "window_end"),
        signals.where(F.col("score") >= score).select(*by, "ts"), by, "window_start", "window_end", "ts", width,
    ).groupBy(*event_id).agg(F.count("*").alias("signals"))
    return events.join(hits, list(event_id), "left").withColumn("signals", F.coalesce("signals", F.lit(0)))


def lookback_join(events: DataFrame, trades: DataFrame, by: Sequence[str], event_id: Sequence[str], newest: Sequence[str], seconds: int = DAY, n: int = 200) -> DataFrame:
    """The newest n trades of the ``seconds`` before each event's ``window_start``.

    Only the newest n trades of an hour can be among the newest n of a window that
    covers the whole hour, so each hour is cut to n rows first.  Hours that a window
    covers in part (its first and last) are joined in full.
    """
    hour_us = HOUR * 1_000_000
    order = [F.col(c).desc() for c in newest]
    slot = F.floor(F.unix_micros("ts") / F.lit(hour_us))
    rows = trades.withColumn("_slot", slot)
    start, end = F.unix_micros("window_start") - seconds * 1_000_000, F.unix_micros("window_start")
    slots = F.sequence(F.floor(start / F.lit(hour_us)), F.floor((end - 1) / F.lit(hour_us)))
    spread = events.withColumn("_slot", F.explode(slots)).withColumn(
        "_whole", (F.col("_slot") * hour_us >= start) & ((F.col("_slot") + 1) * hour_us <= end))
    trimmed = limit_by(rows, [*by, "_slot"], order, n)
    whole = spread.where("_whole").join(trimmed, [*by, "_slot"])
    part = spread.where("NOT _whole").join(rows, [*by, "_slot"]).where(
        (F.unix_micros("ts") >= start) & (F.unix_micros("ts") < end))
    return limit_by(whole.unionByName(part).drop("_slot", "_whole"), event_id, order, n)


def to_usd(amounts: DataFrame, rates: DataFrame, amount: str, currency: str, at: str) -> DataFrame:
    """Amount in USD at the rate of the nearest date of its currency.

    USD passes through, rows without a date use the currency's last rate, amounts of
    zero or less give null.  The last rates are one row per currency.
    """
    last = rates.groupBy("currency").agg(F.max_by("rate", "rate_date").alias("_last"))
    near = asof_nearest(
        amounts.withColumnRenamed(currency, "currency"), rates, ["currency"], at, {"_near": "rate"}, right_on="rate_date", chunk_seconds=30 * DAY)
    rate = F.when(F.col("currency") == "USD", 1.0).when(F.col(at).isNull(), F.col("_last")).otherwise(F.col("_near"))
    usd = F.when(F.col(amount) > 0, F.col(amount) * rate)
    return near.join(last, "currency", "left").withColumn("usd", usd).drop("_last", "_near").withColumnRenamed("currency", currency)


def traded_markets(markets: DataFrame, trades: DataFrame) -> DataFrame:
    return markets.join(trades.select("condition_id").distinct(), "condition_id", "left_semi")


def unseen_wallets(activity: DataFrame, profiles: DataFrame) -> DataFrame:
    return activity.select("wallet").distinct().join(profiles, "wallet", "left_anti")


def resolved_markets(markets: DataFrame, trades: DataFrame, min_trades: int = 10, binary_outcomes: Sequence[str] | None = None) -> DataFrame:
    """Resolved two-outcome markets with a winner and at least ``min_trades`` trades."""
    counts = trades.groupBy("condition_id").agg(F.count("*").alias("trade_count")).where(F.col("trade_count") >= min_trades)
    done = markets.where((F.col("resolved") == 1) & (F.col("winning_outcome") != "") & (F.size("outcomes") == 2))
    if binary_outcomes is not None:
        done = done.where(F.exists("outcomes", lambda x: F.lower(x).isin([o.lower() for o in binary_outcomes])))
    return done.join(counts, "condition_id")


def star_union(houses: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Sold lots of every house with sale, auction and extraction columns; houses stacked.

    Each house gives ``lots`` (auction, part_id, price), ``sales`` (auction, sold, ...),
    and optionally ``auctions`` (house_id) and ``extractions`` (part_id).
    """
    out = None
    for name, h in houses.items():
        rows = h["lots"].where("price > 0").join(h["sales"].where("sold = 1").drop("sold"), "auction")
        rows = rows.join(h["auctions"], "house_id", "left") if "auctions" in h else rows
        rows = rows.join(h["extractions"], "part_id", "left") if "extractions" in h else rows
        rows = rows.withColumn("house", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def vital_status(born: str, died: str, sold_year: Column) -> Column:
    return F.when(F.col(born).isNull(), "unknown").when(F.col(died).isNotNull() & (F.col(died) < sold_year), "deceased").otherwise("living")
