"""Serving queries: filters, top-k, small joins and overviews.

Every query takes ``as_of`` where the stored data is read relative to now.  Facts are
aggregated before they meet dimension tables; top-k reports use orderBy + limit, which
Spark runs as a per-partition top-k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago, array_sum, safe_ratio
from oddsmith.operators.versions import latest_snapshot, limit_by

HOUR = 3600
DAY = 86400


def is_open() -> Column:
    return (F.col("active") == 1) & (F.col("closed") == 0)


def top_markets(markets: DataFrame, n: int = 20) -> DataFrame:
    return markets.where(is_open()).orderBy(F.desc("volume_24h"), "condition_id").limit(n)


def top_movers(markets: DataFrame, n: int = 20) -> DataFrame:
    now = F.get("outcome_prices", F.lit(0))
    moved = markets.where(is_open()).select(
        "condition_id", "question", now.alias("price"), F.col("one_day_price_change").alias("change"), "volume_24h"
    ).withColumn("previous", F.col("price") - F.col("change"))
    pct = F.when(F.abs("previous") > 0.001, F.col("change") / F.col("previous") * 100).otherwise(0.0)
    kept = moved.where((F.abs("change") > 0.001) & (F.col("price") > 0.05) & (F.col("previous") > 0.05))
    return kept.withColumn("pct_change", pct).orderBy(F.desc(F.abs("pct_change")), "condition_id").limit(n)


def trending_markets(markets: DataFrame, n: int = 20) -> DataFrame:
    daily = F.col("volume_1wk") / 7
    rising = markets.where(is_open() & (F.col("volume_1wk") > 0)).where(F.col("volume_24h") > 1.5 * daily)
    return (
        rising.select("condition_id", "question", "volume_24h", safe_ratio("volume_24h", daily, 0.01).alias("ratio"))
        .orderBy(F.desc("ratio"), "condition_id").limit(n)
    )


def market_detail(markets: DataFrame, condition_id) -> DataFrame:
    return markets.where(F.col("condition_id") == condition_id)


def market_trades(trades: DataFrame, condition_id, n: int = 50) -> DataFrame:
    return trades.where(F.col("condition_id") == condition_id).orderBy(F.desc("ts"), F.desc("trade_id")).limit(n)


def recently_resolved(markets: DataFrame, n: int = 20) -> DataFrame:
    return markets.where("resolved = 1").orderBy(F.desc("end_date"), "condition_id").limit(n)


def leaderboard(rankings: DataFrame, category: str, period: str, order_by: str, n: int = 50) -> DataFrame:
    picked = (F.col("category") == category) & (F.col("period") == period) & (F.col("order_by") == order_by)
    return rankings.where(picked).orderBy("rank").limit(n)


def top_holders(holders: DataFrame, condition_id, n: int = 20) -> DataFrame:
    return holders.where(F.col("condition_id") == condition_id).orderBy(F.desc("amount"), "wallet").limit(n)


def trader_profile(profiles: DataFrame, wallet) -> DataFrame:
    return profiles.where(F.col("wallet") == wallet)


def keyword_search(markets: DataFrame, patterns: list[str], tags: list[str] = (), categories: list[str] = (), text: str = "question") -> DataFrame:
    """Markets whose text is LIKE any pattern, that carry any tag, or whose category is LIKE any."""
    tests = [F.lower(text).like(p) for p in patterns] + [F.lower("category").like(c) for c in categories]
    if tags:
        tests.append(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    return markets.where(reduce(Column.__or__, tests))


def best_match_per_topic(markets: DataFrame, topics: list[tuple[str, str]], text: str = "question") -> DataFrame:
    """For each topic the matching market of greatest volume; ``topics`` are (topic, keyword) pairs.

    The short keyword list becomes an array literal, so matching is a projection.
    """
    table = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(k).alias("keyword")) for t, k in topics])
    hit = F.array_distinct(F.transform(F.filter(table, lambda x: F.contains(F.lower(text), x["keyword"])), lambda x: x["topic"]))
    best = F.struct(F.col("volume_total").alias("v"), (-F.col("condition_id")).alias("tie"))
    return markets.withColumn("topic", F.explode(hit)).groupBy("topic").agg(
        F.max_by(F.struct("condition_id", text, "volume_total"), best).alias("m"), F.count("*").alias("matches")
    ).select("topic", "matches", "m.*")


def resolve_slugs(markets: DataFrame, slugs: DataFrame) -> DataFrame:
    return markets.where("active = 1").join(slugs, "event_slug").select("event_slug", "condition_id", "token_ids")


def ranked_rows(df: DataFrame, by: Column, n: int, where: Column | None = None, tie: str = "id") -> DataFrame:
    """List views over stored results: an optional filter, the n best rows."""
    return (df if where is None else df.where(where)).orderBy(by.desc(), tie).limit(n)


# ---- joins -----------------------------------------------------------------


def volume_leaders(trades: DataFrame, markets: DataFrame, as_of: Column, seconds: int = DAY, n: int = 20) -> DataFrame:
    total = trades.where(F.col("ts") >= ago(as_of, seconds)).groupBy("condition_id").agg(
        F.sum("size").alias("volume"), F.count("*").alias("trade_count"))
    return total.join(markets.select("condition_id", "question"), "condition_id", "left").orderBy(F.desc("volume"), "condition_id").limit(n)


def large_trades(trades: DataFrame, markets: DataFrame, as_of: Column, min_usd: float = 1000.0, seconds: int = DAY, n: int = 50) -> DataFrame:
    usd = F.col("price") * F.col("size")
    big = trades.where((F.col("ts") >= ago(as_of, seconds)) & (usd >= min_usd)).select(
        "trade_id", "condition_id", "outcome", "side", "price", "size", usd.alias("usd"), "ts")
    return big.join(markets.select("condition_id", "question"), "condition_id").orderBy(F.desc("ts"), F.desc("trade_id")).limit(n)


def whale_activity(activity: DataFrame, profiles: DataFrame, as_of: Column, min_usd: float = 500.0, seconds: int = DAY, n: int = 50) -> DataFrame:
    big = activity.where((F.col("ts") >= ago(as_of, seconds)) & (F.col("usdc_size") >= min_usd))
    named = big.join(profiles.select("wallet", "pseudonym"), "wallet", "left")
    return named.withColumn("pseudonym", F.coalesce("pseudonym", F.lit(""))).orderBy(F.desc("ts"), F.desc("transaction_hash")).limit(n)


def smart_money_positions(positions: DataFrame, rankings: DataFrame, profiles: DataFrame, n: int = 50) -> DataFrame:
    best = rankings.where("category = 'OVERALL' AND period = 'ALL' AND order_by = 'PNL'").groupBy("wallet").agg(F.min("rank").alias("rank"))
    held = positions.where("size > 0 AND current_value > 100")
    return (
        held.join(best, "wallet").join(profiles.select("wallet", "pseudonym"), "wallet", "left")
        .orderBy("rank", F.desc("current_value"), "condition_id", "outcome").limit(n)
    )


def latest_book_imbalance(books: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """obi = bid / (bid + ask) over the newest book of each market inside the look-back."""
    recent = latest_snapshot(books.where(F.col("snapshot_time") >= ago(as_of, seconds)), ["condition_id"], "snapshot_time")
    both = recent.select("condition_id", "snapshot_id", "snapshot_time", array_sum("bid_sizes").alias("bid_depth"), array_sum("ask_sizes").alias("ask_depth"))
    return both.where("bid_depth + ask_depth > 0").withColumn("obi", safe_ratio("bid_depth", F.col("bid_depth") + F.col("ask_depth"), 0.001))


def order_book_imbalance(books: DataFrame, as_of: Column, seconds: int = 300, n: int = 20) -> DataFrame:
    return latest_book_imbalance(books, as_of, seconds).orderBy(F.desc(F.abs(F.col("obi") - 0.5)), "condition_id", "snapshot_id").limit(n)


# ---- aggregates ------------------------------------------------------------


def category_breakdown(markets: DataFrame) -> DataFrame:
    return markets.where(is_open()).groupBy("category").agg(
        F.count("*").alias("market_count"), F.sum("volume_total").alias("total_volume"), F.avg("liquidity").alias("avg_liquidity"))


def overview_stats(markets: DataFrame) -> DataFrame:
    return markets.agg(
        F.count("*").alias("total_markets"), F.count_if(is_open()).alias("active_markets"), F.count_if(F.col("resolved") == 1).alias("resolved_markets"),
        F.sum("volume_24h").alias("volume_24h"), F.sum("liquidity").alias("liquidity"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Independent scalar subqueries side by side (each frame has exactly one row)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def whales_overview(rankings: DataFrame, activity: DataFrame, positions: DataFrame, as_of: Column) -> DataFrame:
    held = positions.where("size > 0")
    return one_row(
        rankings.agg(F.count_distinct("wallet").alias("tracked_wallets")),
        activity.where((F.col("ts") >= ago(as_of, DAY)) & (F.col("usdc_size") >= 500)).agg(F.count("*").alias("whale_trades_24h")),
        held.agg(F.count("*").alias("total_whale_positions")),
        held.agg(F.count_distinct("condition_id").alias("unique_markets_held")),
    )


def signals_overview(books: DataFrame, trades: DataFrame, markets: DataFrame, as_of: Column, book_seconds: int = 300) -> DataFrame:
    bid, both = array_sum("bid_sizes"), array_sum("bid_sizes") + array_sum("ask_sizes")
    skewed = (both > 0) & (F.abs(bid / F.nullif(both, F.lit(0.0)) - 0.5) > 0.15)
    return one_row(
        books.where((F.col("snapshot_time") >= ago(as_of, book_seconds)) & skewed).agg(F.count_distinct("condition_id").alias("obi_signals")),
        trades.where(F.col("ts") >= ago(as_of, 4 * HOUR)).agg(F.count_distinct("condition_id").alias("volume_active_markets")),
        trades.where((F.col("ts") >= ago(as_of, DAY)) & (F.col("price") * F.col("size") >= 1000)).agg(F.count("*").alias("large_trades_24h")),
        markets.agg(F.count_if(is_open()).alias("active_markets")),
    )


def volume_anomalies(trades: DataFrame, markets: DataFrame, as_of: Column, seconds: int = 4 * HOUR) -> DataFrame:
    """Recent volume against the weekly average scaled to the same time."""
    recent = trades.where(F.col("ts") >= ago(as_of, seconds)).groupBy("condition_id").agg(F.sum("size").alias("volume_4h"))
    live = markets.where(is_open() & (F.col("volume_1wk") > 0)).select("condition_id", "question", (F.col("volume_1wk") * (seconds / (7 * DAY))).alias("average_4h"))
    joined = recent.join(live, "condition_id").withColumn("ratio", safe_ratio("volume_4h", "average_4h", 0.01))
    return joined.where("ratio > 2 AND volume_4h > 100")


def holder_top5(holders: DataFrame) -> DataFrame:
    """Holders, total, five largest and the largest holder per market.

    Totals combine before the shuffle; the five largest come from a per-partition
    top five, so a market held by everyone is not gathered anywhere.
    """
    by_size = F.struct("amount", (-F.col("wallet")).alias("tie"))
    totals = holders.groupBy("condition_id").agg(
        F.count("*").alias("total_holders"), F.sum("amount").alias("total_amount"),
        F.max_by("wallet", by_size).alias("top_holder"), F.max("amount").alias("top_holder_amount"))
    top = limit_by(holders.select("condition_id", "wallet", "amount"), ["condition_id"], [F.desc("amount"), F.asc("wallet")], 5)
    return totals.join(top.groupBy("condition_id").agg(F.sum("amount").alias("top5_amount")), "condition_id")


def position_concentration(holders: DataFrame, markets: DataFrame, n: int = 20) -> DataFrame:
    stats = holder_top5(holders).where("total_holders >= 3").withColumn("top5_share", safe_ratio("top5_amount", "total_amount", 0.01))
    return stats.join(markets.select("condition_id", "question"), "condition_id").orderBy(F.desc("top5_share"), "condition_id").limit(n)


def technical_indicators(bars: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """RSI(14), intraday VWAP and 24-bar momentum on hourly bars of each (market, outcome).

    The windows run over bars, at most 24 x days of them per series.
    """
    hourly = bars.where(F.col("bar_time") >= ago(as_of, days * DAY))
    series = Window.partitionBy("condition_id", "outcome").orderBy("bar_time")
    last14 = series.rowsBetween(-13, 0)
    today = Window.partitionBy("condition_id", "outcome", F.to_date("bar_time")).orderBy("bar_time")
    delta = F.col("close") - F.lag("close", 1).over(series)
    steps = hourly.withColumn("delta", F.coalesce(delta, F.lit(0.0)))
    gain = F.avg(F.greatest("delta", F.lit(0.0))).over(last14)
    loss = F.avg(F.greatest(-F.col("delta"), F.lit(0.0))).over(last14)
    ago24 = F.coalesce(F.lag("close", 24).over(series), F.lit(0.0))
    return steps.select(
        "condition_id", "outcome", "bar_time", "close", "volume",
        (100 - 100 / (1 + gain / F.greatest(loss, F.lit(0.0001)))).alias("rsi"),
        (F.sum(F.col("close") * F.col("volume")).over(today) / F.greatest(F.sum("volume").over(today), F.lit(0.0001))).alias("vwap"),
        F.when(ago24 > 0, (F.col("close") - ago24) / F.nullif(ago24, F.lit(0.0)) * 100).otherwise(0.0).alias("momentum"),
    )


def sentiment_hourly(articles: DataFrame, key: str, at: str) -> DataFrame:
    """News mood per key and hour; velocity is the number of articles of the hour."""
    weighted = F.sum(F.col("sentiment") * F.col("confidence")) / F.greatest(F.sum("confidence"), F.lit(1e-9))
    return articles.groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(
        F.count("*").alias("article_count"), F.avg("sentiment").alias("avg_sentiment"), F.max("urgency").alias("max_urgency"),
        F.count_distinct("source").alias("source_diversity"), weighted.alias("weighted_sentiment"),
        F.count("*").cast("double").alias("news_velocity"))


def sentiment_rollup(hourly: DataFrame, key: str, hours: int, as_of: Column) -> DataFrame:
    recent = hourly.where(F.col("hour") >= ago(as_of, hours * HOUR))
    return recent.groupBy(key).agg(
        F.sum("article_count").alias("total_articles"), F.avg("avg_sentiment").alias("mean_sentiment"), F.max("max_urgency").alias("peak_urgency"),
        F.avg("weighted_sentiment").alias("weighted_sentiment"), F.avg("news_velocity").alias("avg_velocity"))
