"""Wash trading, spoofing and the combined manipulation risk, for all tokens at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago, array_sum, clamp, sum_if
from oddsmith.operators.asof import asof_join
from oddsmith.operators.bars import bucket

DAY = 86400


def wash_trading(activity: DataFrame, trades: DataFrame, as_of: Column, seconds: int = DAY) -> DataFrame:
    """Self-trading wallets, round sizes, and volume that does not move the price, per token."""
    recent = activity.where((F.col("activity_type") == "TRADE") & (F.col("ts") >= ago(as_of, seconds)))
    per_wallet = recent.groupBy(F.col("asset").alias("token_id"), "wallet").agg(
        sum_if(F.col("side") == "BUY", "usdc_size").alias("buy"), sum_if(F.col("side") == "SELL", "usdc_size").alias("sell"))
    matched = (F.least("buy", "sell") > 0) & (F.least("buy", "sell") > 0.7 * F.greatest("buy", "sell"))
    selfs = per_wallet.where(matched).groupBy("token_id").agg(F.count("*").alias("self_trade_count"))
    when = F.struct("ts", "trade_id")
    flow = trades.where(F.col("ts") >= ago(as_of, seconds)).groupBy("token_id").agg(
        F.count("*").alias("total_trades"), F.avg(F.when((F.col("size") > 0) & (F.col("size") % 10 == 0), 1.0).otherwise(0.0)).alias("round_ratio"),
        F.sum(F.col("size") * F.col("price")).alias("volume"), F.abs(F.max_by("price", when) - F.min_by("price", when)).alias("price_change"))
    rows = flow.join(selfs, "token_id", "left").na.fill(0, ["self_trade_count"])
    score = (
        0.4 * F.least(F.col("self_trade_count") / 5, F.lit(1.0))
        + F.when(F.col("round_ratio") > 0.3, 0.2 * F.least((F.col("round_ratio") - 0.3) / 0.4, F.lit(1.0))).otherwise(0.0)
        + F.when((F.col("volume") > 0) & (F.col("price_change") < 0.01), 0.4 * F.least(F.col("volume") / 50000, F.lit(1.0))).otherwise(0.0))
    return rows.withColumns({
        "volume_impact_ratio": F.col("volume") / F.greatest("price_change", F.lit(0.001)), "wash_score": F.least(score, F.lit(1.0))})


def spoofing(books: DataFrame, prices: DataFrame, key: Sequence[str], as_of: Column, seconds: int = 6 * 3600, step: int = 60) -> DataFrame:
    """Depth volatility and heavy book sides that are followed by an opposite move.

    A snapshot meets the price change of the bucket it falls in (or the last one
    before), where the source pairs them by position.
    """
    recent = books.where(F.col("snapshot_time") >= ago(as_of, seconds)).select(*key, "snapshot_id", "snapshot_time", array_sum("bid_sizes").alias("bid"), array_sum("ask_sizes").alias("ask"))
    both = F.col("bid") + F.col("ask")
    recent = recent.withColumn("ratio", F.when(both > 0, F.col("bid") / F.nullif(both, F.lit(0.0))).otherwise(0.5))
    series = prices.where(F.col("ts") >= ago(as_of, seconds)).groupBy(*key, bucket("ts", step).alias("bucket")).agg(F.avg("price").alias("p"))
    moves = series.withColumn("change", F.lead("p").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("p")).where("change is not null")
    seen = asof_join(recent, moves, key, "snapshot_time", {"change": "change"}, "backward", right_on="bucket")
    opposite = ((F.col("ratio") > 0.7) & (F.col("change") < -0.005)) | ((F.col("ratio") < 0.3) & (F.col("change") > 0.005))

    def cv(c):
        return F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(1e-6))

    stats = seen.groupBy(*key).agg(F.count("*").alias("snapshots"), cv("bid").alias("bid_cv"), cv("ask").alias("ask_cv"), F.count_if(opposite).alias("asymmetry_events"))
    enough = F.col("snapshots") >= 3
    worst = F.greatest("bid_cv", "ask_cv")
    score = F.when(worst > 0.5, 0.4 * F.least(worst - 0.5, F.lit(1.0))).otherwise(0.0) + 0.6 * F.least(F.col("asymmetry_events") / 5, F.lit(1.0))
    return stats.select(
        *key, "snapshots", F.when(enough, F.col("bid_cv")).otherwise(0.0).alias("bid_cv"), F.when(enough, F.col("ask_cv")).otherwise(0.0).alias("ask_cv"),
        F.when(enough, F.col("asymmetry_events")).otherwise(0).alias("asymmetry_events"), F.when(enough, F.least(score, F.lit(1.0))).otherwise(0.0).alias("spoof_score"))


def manipulation_risk(wash: DataFrame, spoof: DataFrame, key: str, anomalies: DataFrame | None = None) -> DataFrame:
    """.4 wash + .4 spoofing + .2 causal anomalies, or half and half without a causal model."""
    rows = wash.select(key, "wash_score").join(spoof.select(key, "spoof_score"), key, "full_outer")
    wash_s, spoof_s = F.coalesce("wash_score", F.lit(0.0)), F.coalesce("spoof_score", F.lit(0.0))
    if anomalies is None:
        return rows.select(key, wash_s.alias("wash_score"), spoof_s.alias("spoof_score"), F.least(0.5 * wash_s + 0.5 * spoof_s, F.lit(1.0)).alias("risk_score"))
    rows = rows.join(anomalies.select(key, "anomaly_count"), key, "left")
    causal = clamp(F.coalesce("anomaly_count", F.lit(0)) / 5, 0.0, 1.0)
    return rows.select(key, wash_s.alias("wash_score"), spoof_s.alias("spoof_score"), F.least(0.4 * wash_s + 0.4 * spoof_s + 0.2 * causal, F.lit(1.0)).alias("risk_score"))
