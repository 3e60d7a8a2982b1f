"""Group aggregates over wallets, markets and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago, ratio_or_null, sum_if
from oddsmith.operators.ordered import with_running
from oddsmith.operators.quantiles import exact_quantiles

DAY = 86400


def category_median(markets: DataFrame, approximate: bool = False) -> DataFrame:
    done = markets.where("resolved = 1")
    if approximate:
        return done.groupBy("category").agg(F.percentile_approx("volume_total", 0.5, 10000).alias("median_volume"))
    return exact_quantiles(done, ["category"], "volume_total", {"median_volume": 0.5})


def distinct_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("condition_id").agg(F.count_distinct("wallet").alias("wallets"), F.count_distinct("outcome", "side").alias("outcome_sides"))


def approximate_distinct(trades: DataFrame, error: float = 0.02) -> DataFrame:
    return trades.groupBy("condition_id").agg(F.approx_count_distinct("wallet", error).alias("wallets"))


def wallet_market_features(activity: DataFrame, scores: DataFrame) -> DataFrame:
    """Wallets, buy share, largest wallet's share and mean insider score per market.

    Two-level aggregate: per (market, wallet) first, so a hot market is spread over its
    wallets before anything is gathered by market.
    """
    per_wallet = activity.where("activity_type = 'TRADE'").groupBy("condition_id", "wallet").agg(
        F.sum("usdc_size").alias("usd"), sum_if(F.col("side") == "BUY", "usdc_size").alias("buy_usd"))
    joined = per_wallet.join(scores.select("wallet", "score"), "wallet", "left")
    return joined.groupBy("condition_id").agg(
        F.count("*").alias("unique_wallets"), ratio_or_null(F.sum("buy_usd"), F.sum("usd")).alias("whale_buy_ratio"),
        ratio_or_null(F.max("usd"), F.sum("usd")).alias("top_wallet_share"), F.avg("score").alias("avg_insider_score"))


def wallet_trade_profile(activity: DataFrame, as_of: Column, days: int = 30, min_trades: int = 5) -> DataFrame:
    recent = activity.where((F.col("activity_type") == "TRADE") & (F.col("ts") >= ago(as_of, days * DAY)))
    per_market = recent.groupBy("wallet", "condition_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "BUY").alias("buys"), F.sum("usdc_size").alias("s"),
        F.sum(F.col("usdc_size") * F.col("usdc_size")).alias("ss"))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    return per_market.groupBy("wallet").agg(
        n.alias("trade_count"), (F.sum("buys") / n).alias("buy_ratio"), mean.alias("avg_size"),
        F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))).alias("std_size"), F.count("*").alias("unique_markets"),
    ).where(F.col("trade_count") >= min_trades)


def wallet_win_rate(positions: DataFrame, markets: DataFrame, min_resolved: int = 3) -> DataFrame:
    done = markets.where("resolved = 1").select("condition_id", "winning_outcome")
    return positions.where("size > 0").join(done, "condition_id").groupBy("wallet").agg(
        F.count_if(F.col("winning_outcome") == F.col("outcome")).alias("wins"), F.count("*").alias("resolved_count"),
    ).where(F.col("resolved_count") >= min_resolved).withColumn("win_rate", F.col("wins") / F.col("resolved_count"))


def wallet_roi(positions: DataFrame) -> DataFrame:
    return positions.groupBy("wallet").agg(F.sum("cash_pnl").alias("pnl"), F.sum("initial_value").alias("invested")).where(
        "invested > 0").withColumn("roi", F.col("pnl") / F.col("invested"))


def wallet_category_pnl(positions: DataFrame, markets: DataFrame) -> DataFrame:
    return positions.where("size > 0").join(markets.select("condition_id", "category"), "condition_id").groupBy("wallet", "category").agg(
        F.sum("cash_pnl").alias("pnl"), F.count("*").alias("positions"), F.count_if(F.col("cash_pnl") > 0).alias("wins"))


def category_focus(by_category: DataFrame, focus: str) -> DataFrame:
    """Share, wins and pnl of one category in each wallet's positions."""
    here = F.col("category") == focus
    return by_category.groupBy("wallet").agg(
        F.sum("positions").alias("positions"), F.sum(F.when(here, F.col("positions")).otherwise(0)).alias("focus_positions"),
        F.sum(F.when(here, F.col("wins")).otherwise(0)).alias("focus_wins"), sum_if(here, "pnl").alias("focus_pnl"),
    ).withColumn("focus_share", F.col("focus_positions") / F.col("positions"))


def size_vs_liquidity(positions: DataFrame, markets: DataFrame) -> DataFrame:
    live = markets.where("active = 1").select("condition_id", "liquidity")
    return positions.where("size > 0").join(live, "condition_id").groupBy("wallet").agg(
        F.avg(F.col("current_value") / F.greatest("liquidity", F.lit(1.0))).alias("size_ratio"))


def value_chunk(x: str | Column) -> Column:
    """Slices of a non-negative measure that widen with it: never decreasing, a few hundred at most."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(F.log2(x + 1) * 16)


def gini(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of a non-negative value per group; 0 when the values sum to 0.

    Equal values are counted first; ranks are running counts over value slices, so no
    task orders a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    ranked = with_running(counts, by, ["_x"], value_chunk("_x"), sums={"_upto": F.col("_n")})
    # sum of the ranks (upto - n + 1 .. upto) of equal values
    ranks = F.col("_n") * F.col("_upto") - F.col("_n") * (F.col("_n") - 1) / 2
    n, total = F.sum("_n"), F.sum(F.col("_x") * F.col("_n"))
    g = (2 * F.sum(ranks * F.col("_x")) - (n + 1) * total) / F.nullif(n * total, F.lit(0.0))
    return ranked.groupBy(*by).agg(F.coalesce(g, F.lit(0.0)).alias("gini"), n.alias("n"))


def listing_stats(listings: DataFrame) -> DataFrame:
    """Per district: count, mean price (positive sum / all), upper-middle positive price, sources.

    The upper-middle of n sorted values is the one at index n div 2 from 0.
    """
    counts = listings.where("price > 0").groupBy("district", "price").agg(F.count("*").alias("n"))
    upto = with_running(counts, ["district"], ["price"], value_chunk("price"), sums={"upto": F.col("n")})
    total = counts.groupBy("district").agg(F.sum("n").alias("total"))
    middle = upto.join(total, "district").where("upto > floor(total / 2) AND upto - n <= floor(total / 2)").select(
        "district", F.col("price").alias("median_price"))
    base = listings.groupBy("district").agg(
        F.count("*").alias("listings"), (sum_if(F.col("price") > 0, "price") / F.count("*")).alias("avg_price"), F.count_distinct("source").alias("sources"))
    return base.join(middle, "district", "left")


def risk_overview(districts: DataFrame) -> DataFrame:
    """Counts by grade, mean score, total population and coastal count in one pass."""
    grade = [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    return districts.agg(
        F.count("*").alias("districts"), *grade, F.avg("score").alias("avg_score"), F.sum("population").alias("population"),
        F.count_if(F.col("coastal") == 1).alias("coastal"))


def indicator_overview(indicators: DataFrame, margin: float = 3.0) -> DataFrame:
    """Category means, their trend by a margin on the change, and whether it is the top one."""
    per = indicators.groupBy("category").agg(
        F.count("*").alias("indicators"), F.avg("score").alias("avg_score"), F.avg(F.col("score") - F.col("previous")).alias("change"),
        F.count_if(F.col("score") >= 70).alias("severe"))
    top = per.agg(F.max_by("category", "avg_score").alias("top"))
    trend = F.when(F.col("change") > margin, "worsening").when(F.col("change") < -margin, "improving").otherwise("stable")
    return per.crossJoin(F.broadcast(top)).withColumns({"trend": trend, "is_top": F.when(F.col("category") == F.col("top"), 1).otherwise(0)}).drop("top")
