"""Market signals: composite score, arbitrage, microstructure, sizing, risk and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago, array_sum, clamp, clamp100, first_or, key_id, safe_ratio, sum_if
from oddsmith.operators.ordered import HOUR, time_chunk, with_neighbor, with_running
from oddsmith.operators.versions import limit_by
from oddsmith.plans.serving import holder_top5, is_open, latest_book_imbalance
from oddsmith.plans.time_joins import minute_impact

DAY = 86400
WEIGHTS = {"obi": 0.20, "volume": 0.10, "trade_bias": 0.15, "momentum": 0.15, "smart_money": 0.25, "concentration": 0.10}


def net_share(df: DataFrame, usd: Column, buy: Column, name: str) -> DataFrame:
    """100 * (buy - sell) / (buy + sell) per market, 0 without volume."""
    sums = df.groupBy("condition_id").agg(F.sum(F.when(buy, usd).otherwise(0.0)).alias("b"), F.sum(F.when(buy, 0.0).otherwise(usd)).alias("s"))
    both = F.col("b") + F.col("s")
    return sums.select("condition_id", clamp100(F.when(both > 0, (F.col("b") - F.col("s")) / F.nullif(both, F.lit(0.0)) * 100).otherwise(0.0)).alias(name))


def composite_signals(
    markets: DataFrame, books: DataFrame, trades: DataFrame, activity: DataFrame, rankings: DataFrame, holders: DataFrame,
    arbitrage: DataFrame, insiders: DataFrame, as_of: Column, seconds: int = DAY, volume_seconds: int = 4 * HOUR, book_seconds: int = 300,
    top: int | None = None,
) -> DataFrame:
    """Eight components per active market, their weighted score in [-100, 100] and its confidence.

    Each component is one combined aggregate keyed by market; the market list is the
    left side of equi-joins on that key, so the plan has one exchange per component.
    """
    live = markets.where(is_open())
    base = live if top is None else live.orderBy(F.desc("volume_24h"), "condition_id").limit(top)
    base = base.select("condition_id", "volume_1wk", clamp100(F.col("one_day_price_change") * 200).alias("momentum"))
    obi = latest_book_imbalance(books, as_of, book_seconds).groupBy("condition_id").agg(F.max(clamp100((F.col("obi") - 0.5) * 200)).alias("obi"))
    volume = trades.where(F.col("ts") >= ago(as_of, volume_seconds)).groupBy("condition_id").agg(F.sum("size").alias("v4h"))
    usd = F.col("price") * F.col("size")
    recent = trades.where((F.col("ts") >= ago(as_of, seconds)) & (usd >= 1000))
    bias = net_share(recent, usd, F.col("side") == "buy", "trade_bias")
    day = activity.where((F.col("ts") >= ago(as_of, seconds)) & (F.col("activity_type") == "TRADE"))
    best = rankings.where("category = 'OVERALL' AND period = 'ALL' AND order_by = 'PNL' AND rank <= 50").select("wallet")
    # at most 50 wallets
    smart = net_share(day.join(F.broadcast(best), "wallet", "left_semi"), F.col("usdc_size"), F.col("side") == "BUY", "smart_money")
    shares = holder_top5(holders).where("total_amount > 0")
    conc = shares.select("condition_id", clamp100(-(F.col("top5_amount") / F.col("total_amount") - 0.5) * 200).alias("concentration"))
    arb = arbitrage.select("condition_id").distinct().withColumn("arbitrage", F.lit(1))
    suspects = insiders.where("score > 20").select("wallet", "score")
    per_wallet = day.groupBy("condition_id", "wallet").agg(F.count("*").alias("n")).join(suspects, "wallet")
    insider = per_wallet.groupBy("condition_id").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("insider"))
    rows = base
    for part in (obi, volume, bias, smart, conc, arb, insider):
        rows = rows.join(part, "condition_id", "left")
    # the week's volume scaled to the window
    usual = F.col("volume_1wk") * (volume_seconds / (7 * DAY))
    anomaly = F.when((usual > 0) & F.col("v4h").isNotNull(), clamp100((F.col("v4h") / F.nullif(usual, F.lit(0.0)) - 1) * 50)).otherwise(0.0)
    rows = rows.select(
        "condition_id", "momentum", anomaly.alias("volume"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("obi", "trade_bias", "smart_money", "concentration", "insider")],
        F.coalesce("arbitrage", F.lit(0)).alias("arbitrage"))
    score = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)) + 0.05 * (F.col("insider") - 50)
    active = sum((F.when(F.abs(F.col(c)) > 1.0, 1).otherwise(0) for c in WEIGHTS), F.lit(0))
    return rows.withColumn("score", clamp100(score)).withColumn("confidence", active / F.lit(len(WEIGHTS)))


def components_json(signals: DataFrame) -> DataFrame:
    parts = [*WEIGHTS, "insider"]
    return signals.withColumn("components", F.to_json(F.struct(*[F.round(c, 2).alias(c) for c in parts], "arbitrage")))


def sum_to_one_arbitrage(markets: DataFrame, threshold: float = 0.02) -> DataFrame:
    total = array_sum("outcome_prices")
    hit = markets.where(is_open() & (F.size("outcome_prices") == 2) & (F.abs(total - 1) > threshold))
    return hit.select("condition_id", "event_slug", F.lit("sum_to_one").alias("arb_type"), total.alias("actual_sum"), F.abs(total - 1).alias("spread"))


def related_market_arbitrage(markets: DataFrame, threshold: float = 0.05, min_markets: int = 3) -> DataFrame:
    """Events whose yes prices should sum to one and do not; the first market is the primary."""
    yes = F.get("outcome_prices", F.lit(0))
    events = markets.where(is_open() & (F.col("event_slug") != "") & (F.size("outcome_prices") >= 1)).groupBy("event_slug").agg(
        F.min("condition_id").alias("condition_id"), F.count("*").alias("n"), F.sum(F.when(yes > 0, yes).otherwise(0.0)).alias("actual_sum"))
    limit = F.least(1.5 + 0.02 * F.col("n"), F.lit(2.5))
    spread = F.abs(F.col("actual_sum") - 1)
    hit = events.where((F.col("n") >= min_markets) & (F.col("actual_sum") > 0) & (F.col("actual_sum") < limit) & (spread > threshold))
    return hit.select("condition_id", "event_slug", F.lit("related_market").alias("arb_type"), "actual_sum", spread.alias("spread"), (F.col("n") - 1).alias("related"))


def related_markets(opportunities: DataFrame, markets: DataFrame) -> DataFrame:
    """The related markets of each opportunity as rows, so that a large event is not one array."""
    others = markets.where(is_open()).select("event_slug", F.col("condition_id").alias("related_id"))
    return opportunities.select("event_slug", "condition_id").join(others, "event_slug").where("related_id <> condition_id")


def arbitrage_opportunities(markets: DataFrame) -> DataFrame:
    return sum_to_one_arbitrage(markets).unionByName(related_market_arbitrage(markets).drop("related"))


def kyle_lambda_ratio(trades: DataFrame, as_of: Column, seconds: int = 1800) -> DataFrame:
    """Mean |price step| per dollar, steps inside one market only."""
    recent = trades.where(F.col("ts") >= ago(as_of, seconds)).select("condition_id", "ts", "trade_id", "price", (F.col("price") * F.col("size")).alias("usd"))
    steps = with_neighbor(recent, ["condition_id"], ["ts", "trade_id"], {"prev": "price"}, time_chunk("ts"))
    step = F.abs(F.col("price") - F.col("prev"))
    return steps.where((F.col("usd") > 0) & (step > 0)).groupBy("condition_id").agg(F.avg(step / F.greatest("usd", F.lit(1e-9))).alias("kyle_lambda"))


def trade_steps(trades: DataFrame) -> DataFrame:
    """Each trade with the price of the next trade of its market."""
    rows = trades.select("condition_id", "ts", "trade_id", "price", "size", "side")
    return with_neighbor(rows, ["condition_id"], ["ts", "trade_id"], {"next_price": "price"}, time_chunk("ts"), ahead=True)


def kyle_lambda_regression(trades: DataFrame) -> DataFrame:
    """Slope of the price step on the signed dollar flow (five trades or more)."""
    dp = F.col("next_price") - F.col("price")
    flow = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * F.col("price") * F.col("size")
    stats = trade_steps(trades).groupBy("condition_id").agg(
        F.count("*").alias("n"), F.covar_pop(dp, F.when(dp.isNotNull(), flow)).alias("cov"), F.var_pop(F.when(dp.isNotNull(), flow)).alias("var"))
    slope = F.when((F.col("n") >= 5) & (F.col("var") > 1e-10), F.col("cov") / F.nullif("var", F.lit(0.0))).otherwise(0.0)
    return stats.select("condition_id", slope.alias("kyle_lambda"))


def toxic_flow(trades: DataFrame) -> DataFrame:
    """Share of trades followed by a move in their own direction (three trades or more)."""
    dp = F.col("next_price") - F.col("price")
    toxic = ((F.col("side") == "buy") & (dp > 0)) | ((F.col("side") == "sell") & (dp < 0))
    stats = trade_steps(trades).groupBy("condition_id").agg(F.count("*").alias("n"), F.count_if(toxic).alias("k"))
    return stats.select("condition_id", F.when(F.col("n") >= 3, F.col("k") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(0.0).alias("toxic_flow"))


def latest_quotes(books: DataFrame) -> DataFrame:
    """Newest book of each market: best prices, spread, mid, depth at 1 and 5 levels, obi."""
    last = books.groupBy("condition_id").agg(F.max_by(F.struct("bid_prices", "bid_sizes", "ask_prices", "ask_sizes"), F.struct("snapshot_time", "snapshot_id")).alias("b"))
    last = last.select("condition_id", "b.*")
    bid, ask = first_or("bid_prices", 0.0), first_or("ask_prices", 0.0)
    total_bid, total_ask = array_sum("bid_sizes"), array_sum("ask_sizes")
    rows = last.select(
        "condition_id", (ask - bid).alias("spread"), ((bid + ask) / 2).alias("mid"), first_or("bid_sizes", 0.0).alias("bid_depth_1"),
        first_or("ask_sizes", 0.0).alias("ask_depth_1"), array_sum(F.slice("bid_sizes", 1, 5)).alias("bid_depth_5"),
        array_sum(F.slice("ask_sizes", 1, 5)).alias("ask_depth_5"), safe_ratio(total_bid, total_bid + total_ask, 1e-9).alias("obi"))
    return rows.withColumn("depth_ratio", safe_ratio(F.col("bid_depth_5") + F.col("ask_depth_5"), F.col("bid_depth_1") + F.col("ask_depth_1"), 1e-9))


def effective_spread(trades: DataFrame, books: DataFrame) -> DataFrame:
    quotes = latest_quotes(books).select("condition_id", "mid")
    return trades.join(quotes, "condition_id").groupBy("condition_id").agg(F.avg(2 * F.abs(F.col("price") - F.col("mid"))).alias("effective_spread"))


def trade_flow(trades: DataFrame) -> DataFrame:
    usd = F.col("price") * F.col("size")
    return trades.groupBy("condition_id").agg(
        sum_if(F.col("side") == "buy", "size").alias("buy_volume"), sum_if(F.col("side") == "sell", "size").alias("sell_volume"),
        F.count("*").alias("trade_count"), F.count_if(usd >= 1000).alias("large_count"), (F.sum(usd) / F.greatest(F.sum("size"), F.lit(1e-9))).alias("vwap"))


def microstructure_snapshot(
    markets: DataFrame, books: DataFrame, trades: DataFrame, as_of: Column, flow_seconds: int = 300, kyle_seconds: int = 1800,
    impact_seconds: int = 900, within: int = 60, top: int | None = None,
) -> DataFrame:
    """Quotes, five-minute flow, Kyle's lambda and impact of the most traded markets in one row each."""
    live = markets.where(is_open())
    base = (live if top is None else live.orderBy(F.desc("volume_24h"), "condition_id").limit(top)).select("condition_id")
    recent = trades.where(F.col("ts") >= ago(as_of, flow_seconds))
    rows = (
        base.join(latest_quotes(books), "condition_id", "left").join(trade_flow(recent), "condition_id", "left")
        .join(kyle_lambda_ratio(trades, as_of, kyle_seconds), "condition_id", "left")
        .join(minute_impact(trades, as_of, impact_seconds, within).select("condition_id", "impact"), "condition_id", "left")
    )
    doubles = ["spread", "mid", "bid_depth_1", "ask_depth_1", "bid_depth_5", "ask_depth_5", "obi", "depth_ratio", "buy_volume", "sell_volume", "vwap", "kyle_lambda", "impact"]
    rows = rows.na.fill(0.0, doubles).na.fill(0, ["trade_count", "large_count"])
    total = F.col("buy_volume") + F.col("sell_volume")
    return rows.withColumns({
        "effective_spread": F.when(F.col("mid") > 0, F.abs(F.col("vwap") - F.col("mid")) * 2).otherwise(0.0),
        "realized_spread": F.greatest(F.col("spread") - F.col("impact"), F.lit(0.0)),
        "toxic_flow_ratio": F.when(total > 0, F.abs(F.col("buy_volume") - F.col("sell_volume")) / F.greatest(total, F.lit(1e-9))).otherwise(0.0),
        "snapshot_time": as_of,
    })


# ---- sizing, risk, portfolio ------------------------------------------------


def composite_probability(score: Column, price: Column) -> Column:
    """Shift the price by up to 15 % of the room left in the direction of the score."""
    room = F.when(score > 0, 1.0 - price).otherwise(price)
    shifted = clamp(price + score / 100 * 0.15 * room, 0.01, 0.99)
    return F.when((price <= 0.01) | (price >= 0.99), price).otherwise(shifted)


def kelly_fraction(p: Column, price: Column, fraction: float = 0.25) -> Column:
    """Kelly stake f = (p b - q) / b of the better side, times ``fraction``; 0 at extreme prices."""
    yes = p > price
    mine, paid = F.when(yes, p).otherwise(1 - p), F.when(yes, price).otherwise(1 - price)
    b = 1 / F.nullif(paid, F.lit(0.0)) - 1
    f = (mine * b - (1 - mine)) / F.nullif(b, F.lit(0.0))
    return F.when((price <= 0.01) | (price >= 0.99), 0.0).otherwise(F.greatest(F.coalesce(f, F.lit(0.0)), F.lit(0.0)) * fraction)


def impact_hurdle(stake: Column, liquidity: Column, base: float = 0.02, impact: float = 0.1) -> Column:
    """Minimum edge to trade: base plus square-root impact; 1 without liquidity."""
    return F.when(liquidity <= 0, 1.0).otherwise(base + impact * F.sqrt(F.greatest(stake / F.nullif(liquidity, F.lit(0.0)), F.lit(0.0))))


def kelly_and_edge(signals: DataFrame, markets: DataFrame, capital: float = 10000.0) -> DataFrame:
    rows = signals.select("condition_id", "score").join(markets.select("condition_id", F.get("outcome_prices", F.lit(0)).alias("price"), "liquidity"), "condition_id")
    rows = rows.withColumn("probability", composite_probability(F.col("score"), F.col("price"))).withColumn("edge", F.col("probability") - F.col("price"))
    rows = rows.withColumn("kelly", kelly_fraction(F.col("probability"), F.col("price")))
    rows = rows.withColumn("hurdle", impact_hurdle(F.col("kelly") * capital, F.col("liquidity")))
    return rows.withColumn("tradable", F.when(F.abs("edge") > F.col("hurdle"), 1).otherwise(0))


def risk_limits(orders: DataFrame, held: DataFrame, portfolio: DataFrame, min_edge: float = 0.03, min_liquidity: float = 5000.0) -> DataFrame:
    """First violated limit of each candidate order and its allowed size.

    ``orders``: order_id, condition_id, price, size, edge, liquidity; ``held``:
    condition_id, exposure; ``portfolio``: one row of total_value, capital,
    initial_capital, drawdown, daily_pnl.
    """
    book = held.agg(F.count("*").alias("n_positions"), F.coalesce(F.sum("exposure"), F.lit(0.0)).alias("total_exposure"))
    rows = orders.join(held, "condition_id", "left").crossJoin(F.broadcast(book)).crossJoin(F.broadcast(portfolio))
    room_market = 0.10 * F.col("total_value") - F.coalesce("exposure", F.lit(0.0))
    room_all = 0.60 * F.col("total_value") - F.col("total_exposure")
    violation = (
        F.when(F.col("drawdown") >= 0.15, "drawdown_limit").when(F.col("daily_pnl") < -0.05 * F.col("initial_capital"), "daily_loss")
        .when(F.col("exposure").isNull() & (F.col("n_positions") >= 20), "max_positions").when(room_market <= 0, "position_limit")
        .when(room_all <= 0, "portfolio_limit").when(F.abs("edge") < min_edge, "min_edge").when(F.col("liquidity") < min_liquidity, "min_liquidity"))
    allowed = F.least(room_market, room_all, F.col("capital")) / F.nullif("price", F.lit(0.0))
    size = F.when(allowed > 0, F.least("size", allowed)).otherwise(0.0)
    rows = rows.select("order_id", "condition_id", F.coalesce(violation, F.lit("")).alias("violation"), size.alias("_size"))
    return rows.withColumn("violation", F.when((F.col("violation") == "") & (F.col("_size") <= 0), "portfolio_limit").otherwise(F.col("violation"))).select(
        "order_id", "condition_id", "violation", F.when(F.col("violation") == "", F.col("_size")).otherwise(0.0).alias("adjusted_size"),
        F.when(F.col("violation") == "", 1).otherwise(0).alias("approved"))


def portfolio_snapshots(holdings: DataFrame, capital: float) -> DataFrame:
    """Value, cost, largest position, high-water mark and drawdown at each time of ``holdings(ts, initial_value, current_value)``."""
    at = holdings.groupBy("ts").agg(
        (F.sum("current_value") - F.sum("initial_value")).alias("unrealized_pnl"), F.sum("initial_value").alias("cost_basis"),
        F.max("current_value").alias("max_position"), F.count("*").alias("positions"))
    at = at.withColumn("total_value", F.lit(capital) + F.col("unrealized_pnl"))
    marked = with_running(at, [], ["ts"], time_chunk("ts", 30 * DAY), maxima={"high_water": F.col("total_value")})
    drop = (F.col("high_water") - F.col("total_value")) / F.nullif("high_water", F.lit(0.0))
    return marked.withColumn("drawdown", F.when(F.col("high_water") > 0, drop).otherwise(0.0))


def trade_candidates(
    composites: DataFrame, markets: DataFrame, posteriors: DataFrame, models: DataFrame, as_of: Column, seconds: int = 600, top: int | None = None,
) -> DataFrame:
    """Best markets to trade with the side, price and probability of the most trusted source.

    The newest composite of a market (confidence 0.3 or more) brings it in; a posterior
    (confidence > 0.1) decides before a model (> 0.3), and a strong composite alone
    (|score| >= 15, confidence >= 0.5, price in [0.1, 0.9]) comes last.  ``top`` cuts what is left.
    """
    recent = composites.where((F.col("computed_at") >= ago(as_of, seconds)) & (F.col("confidence") >= 0.3))
    newest = limit_by(recent, ["condition_id"], [F.desc("computed_at"), F.desc("score")])
    live = markets.where(is_open()).select("condition_id", "token_ids", F.get("outcome_prices", F.lit(0)).alias("market_price"), "liquidity")
    rows = newest.join(live, "condition_id")
    for df, name in ((posteriors, "posterior"), (models, "model")):
        rows = rows.join(df.select("condition_id", F.col("probability").alias(f"{name}_p"), F.col("edge").alias(f"{name}_edge"), F.col("confidence").alias(f"{name}_conf")), "condition_id", "left")
    price = F.col("market_price")
    direct = (F.abs("score") >= 15) & (F.col("confidence") >= 0.5) & price.between(0.1, 0.9)
    source = F.when(F.col("posterior_conf") > 0.1, "posterior").when(F.col("model_conf") > 0.3, "model").when(direct, "composite_direct")
    rows = rows.withColumn("source", source).where("source is not null")
    if top is not None:
        rows = rows.orderBy(F.desc(F.abs("score")), "condition_id").limit(top)
    edge = F.when(F.col("source") == "posterior", F.col("posterior_edge")).when(F.col("source") == "model", F.col("model_edge")).otherwise(F.col("score") / 100)
    prob = F.when(F.col("source") == "posterior", F.col("posterior_p")).when(F.col("source") == "model", F.col("model_p")).otherwise(composite_probability(F.col("score"), price))
    yes = F.col("edge") > 0
    return rows.withColumn("edge", edge).withColumn("_p", prob).select(
        "condition_id", "source", "score", "edge", F.when(yes, F.get("token_ids", F.lit(0))).otherwise(F.get("token_ids", F.lit(1))).alias("token_id"),
        F.when(yes, price).otherwise(1 - price).alias("price"), F.when(yes, F.col("_p")).otherwise(1 - F.col("_p")).alias("probability"))


def opportunity_ids(opportunities: DataFrame) -> DataFrame:
    return opportunities.withColumn("opportunity_id", key_id("condition_id", "arb_type"))
