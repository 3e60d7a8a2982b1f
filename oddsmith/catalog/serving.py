"""Serving queries, joins and aggregates."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.operators.bars import ohlcv_bars
from oddsmith.plans import aggregates as A
from oddsmith.plans import serving as V
from oddsmith.plans import time_joins as J

DAY = 86400
OPEN = "active = 1 AND closed = 0"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

add("top_markets", lambda t: V.top_markets(t.markets).select("condition_id", "question", "volume_24h"),
    f"SELECT condition_id, question, volume_24h FROM markets WHERE {OPEN} ORDER BY volume_24h DESC, condition_id LIMIT 20", "volume_24h")
add("top_movers", lambda t: V.top_movers(t.markets), f"""
SELECT condition_id, question, outcome_prices[1] AS price, one_day_price_change AS change, volume_24h, outcome_prices[1] - one_day_price_change AS previous,
  CASE WHEN abs(outcome_prices[1] - one_day_price_change) > 1e-3 THEN one_day_price_change / (outcome_prices[1] - one_day_price_change) * 100 ELSE 0 END AS pct_change
FROM markets WHERE {OPEN} AND abs(one_day_price_change) > 1e-3 AND outcome_prices[1] > 5e-2 AND outcome_prices[1] - one_day_price_change > 5e-2
ORDER BY abs(pct_change) DESC, condition_id LIMIT 20""", "price change volume_24h previous pct_change")
add("trending_markets", lambda t: V.trending_markets(t.markets), f"""
SELECT condition_id, question, volume_24h, volume_24h / greatest(volume_1wk / 7, 1e-2) AS ratio FROM markets
WHERE {OPEN} AND volume_1wk > 0 AND volume_24h > 15e-1 * (volume_1wk / 7) ORDER BY ratio DESC, condition_id LIMIT 20""", "volume_24h ratio")
add("market_detail", lambda t: V.market_detail(t.markets, 42).select("condition_id", "question", "category", "end_date", "liquidity"),
    "SELECT condition_id, question, category, end_date, liquidity FROM markets WHERE condition_id = 42", "liquidity")
add("market_trades", lambda t: V.market_trades(t.trades, 42).select("trade_id", "ts", "price", "size", "side"),
    "SELECT trade_id, ts, price, size, side FROM trades WHERE condition_id = 42 ORDER BY ts DESC, trade_id DESC LIMIT 50", "price size")
add("recently_resolved", lambda t: V.recently_resolved(t.markets).select("condition_id", "winning_outcome", "end_date"),
    "SELECT condition_id, winning_outcome, end_date FROM markets WHERE resolved = 1 ORDER BY end_date DESC, condition_id LIMIT 20")
add("leaderboard", lambda t: V.leaderboard(t.rankings, "OVERALL", "ALL", "PNL").select("wallet", "rank", "pnl"),
    "SELECT wallet, rank, pnl FROM rankings ORDER BY rank LIMIT 50", "pnl")
add("top_holders", lambda t: V.top_holders(t.holders, 7), "SELECT * FROM holders WHERE condition_id = 7 ORDER BY amount DESC, wallet LIMIT 20", "amount")
add("trader_profile", lambda t: V.trader_profile(t.profiles, 17), "SELECT * FROM profiles WHERE wallet = 17")
add("keyword_search", lambda t: V.keyword_search(t.markets, ["%red%ring%", "%blue%"], ["Brand#3"], ["prom%"], text="description").select(
    "condition_id", "description", "volume_total"), """
SELECT condition_id, description, volume_total FROM markets WHERE lower(description) LIKE '%red%ring%' OR lower(description) LIKE '%blue%'
  OR list_contains(tags, 'Brand#3') OR lower(category) LIKE 'prom%'""", "volume_total")
TOPICS = [("metal", "ring"), ("metal", "bolt"), ("colour", "red"), ("colour", "blue"), ("size", "small"), ("size", "large")]
add("best_match_per_topic", lambda t: V.best_match_per_topic(t.markets, TOPICS, "description"), """
WITH k(topic, keyword) AS (VALUES ('metal', 'ring'), ('metal', 'bolt'), ('colour', 'red'), ('colour', 'blue'), ('size', 'small'), ('size', 'large')),
m AS (SELECT DISTINCT topic, condition_id, description, volume_total FROM markets JOIN k ON contains(lower(description), keyword))
SELECT topic, count(*) OVER (PARTITION BY topic) AS matches, condition_id, description, volume_total FROM m
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY volume_total DESC, condition_id) = 1""", "volume_total")
add("resolve_slugs", lambda t: V.resolve_slugs(t.markets, t.markets.where("category = 'PROMO'").select("event_slug").distinct()).select(
    "event_slug", "condition_id", F.concat_ws(",", "token_ids").alias("token_ids")), """
SELECT event_slug, condition_id, (2 * condition_id) || ',' || (2 * condition_id + 1) AS token_ids FROM markets
WHERE active = 1 AND event_slug IN (SELECT event_slug FROM markets WHERE category = 'PROMO')""")

# ---- joins

add("volume_leaders", lambda t: V.volume_leaders(t.trades, t.markets, t.as_of), f"""
SELECT condition_id, volume, trade_count, question FROM (SELECT condition_id, sum(size) AS volume, count(*) AS trade_count FROM trades
  WHERE ts >= {NOW} - INTERVAL 1 DAY GROUP BY 1) LEFT JOIN (SELECT condition_id, question FROM markets) USING (condition_id)
ORDER BY volume DESC, condition_id LIMIT 20""", "volume")
add("large_trades", lambda t: V.large_trades(t.trades, t.markets, t.as_of), f"""
SELECT trade_id, condition_id, outcome, side, price, size, price * size AS usd, ts, question FROM trades
JOIN (SELECT condition_id, question FROM markets) USING (condition_id) WHERE ts >= {NOW} - INTERVAL 1 DAY AND price * size >= 1000
ORDER BY ts DESC, trade_id DESC LIMIT 50""", "price size usd")
add("whale_activity", lambda t: V.whale_activity(t.activity, t.profiles, t.as_of), f"""
SELECT wallet, condition_id, outcome, price, size, usdc_size, ts, side, activity_type, asset, transaction_hash, coalesce(pseudonym, '') AS pseudonym
FROM activity LEFT JOIN (SELECT wallet, pseudonym FROM profiles) USING (wallet) WHERE ts >= {NOW} - INTERVAL 1 DAY AND usdc_size >= 500
ORDER BY ts DESC, transaction_hash DESC LIMIT 50""", "price size usdc_size")
add("smart_money_positions", lambda t: V.smart_money_positions(t.positions, t.rankings, t.profiles).drop("version", "position_id"), """
SELECT wallet, condition_id, outcome, size, initial_value, cash_pnl, current_value, rank, pseudonym FROM positions
JOIN (SELECT wallet, min(rank) AS rank FROM rankings GROUP BY 1) USING (wallet) LEFT JOIN (SELECT wallet, pseudonym FROM profiles) USING (wallet)
WHERE size > 0 AND current_value > 100 ORDER BY rank, current_value DESC, condition_id, outcome LIMIT 50""", "size initial_value cash_pnl current_value")
OBI_SQL = """SELECT condition_id, snapshot_id, snapshot_time, list_sum(bid_sizes) AS bid_depth, list_sum(ask_sizes) AS ask_depth,
  list_sum(bid_sizes) / greatest(list_sum(bid_sizes) + list_sum(ask_sizes), 1e-3) AS obi FROM books
  QUALIFY rank() OVER (PARTITION BY condition_id ORDER BY snapshot_time DESC) = 1"""
add("order_book_imbalance", lambda t: V.order_book_imbalance(t.books, t.as_of, 2 * DAY),
    f"{OBI_SQL} ORDER BY abs(obi - 5e-1) DESC, condition_id, snapshot_id LIMIT 20", "bid_depth ask_depth obi")
add("price_impact", lambda t: J.price_impact(t.trades, t.prices, t.as_of, 31 * DAY), """
SELECT condition_id, avg(abs(q.price - b.price)) AS impact, count(*) AS trades FROM
  (SELECT condition_id, price, ts + INTERVAL 1 MINUTE AS due FROM trades WHERE usdc_size >= 500) b
  ASOF JOIN (SELECT condition_id, ts, price FROM prices) q USING (condition_id) 
GROUP BY condition_id""".replace("USING (condition_id) \nGROUP", "ON b.condition_id = q.condition_id AND b.due <= q.ts\nGROUP").replace("SELECT condition_id, avg", "SELECT b.condition_id, avg").replace("GROUP BY condition_id", "GROUP BY b.condition_id"), "impact")
add("minute_impact", lambda t: J.minute_impact(t.trades, t.as_of, 31 * DAY, within=3600), """
SELECT a.condition_id, avg(abs(b.price - a.price)) AS impact, count(*) AS pairs FROM trades a JOIN trades b
  ON a.condition_id = b.condition_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.usdc_size >= 500 GROUP BY 1""", "impact")
WINDOWS_SQL = """SELECT condition_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 6 HOUR AS window_end,
  count(*) AS n FROM trades GROUP BY ALL"""


def day_windows(t):
    day = F.date_trunc("day", "ts")
    return t.trades.groupBy("condition_id", day.alias("window_start")).agg(F.count("*").alias("n")).withColumn(
        "window_end", F.col("window_start") + F.make_dt_interval(hours=F.lit(6)))


add("count_in_windows", lambda t: J.count_in_windows(
    day_windows(t), t.trades.select("condition_id", "ts", (F.col("price") * 100).alias("score")), ["condition_id"], ["condition_id", "window_start"]), f"""
SELECT w.condition_id, window_start, window_end, n, count(s.trade_id) AS signals FROM ({WINDOWS_SQL}) w LEFT JOIN trades s
  ON s.condition_id = w.condition_id AND s.ts >= window_start AND s.ts < window_end AND s.price * 100 >= 30 GROUP BY ALL""")


def lookback(t):
    events = day_windows(t).select("condition_id", (F.col("window_start") + F.make_dt_interval(mins=F.col("n").cast("int"))).alias("window_start"))
    hits = J.lookback_join(events, t.activity.select("condition_id", "ts", "transaction_hash", "usdc_size"), ["condition_id"],
                           ["condition_id", "window_start"], ["ts", "transaction_hash"], n=3)
    return hits.select("condition_id", "window_start", "transaction_hash", "usdc_size")


add("lookback_join", lookback, f"""
SELECT e.condition_id, e.window_start, transaction_hash, usdc_size FROM
  (SELECT condition_id, window_start + to_minutes(n) AS window_start FROM ({WINDOWS_SQL})) e JOIN activity a
  ON a.condition_id = e.condition_id AND a.ts < e.window_start AND a.ts >= e.window_start - INTERVAL 24 HOUR
QUALIFY row_number() OVER (PARTITION BY e.condition_id, e.window_start ORDER BY a.ts DESC, transaction_hash DESC) <= 3""", "usdc_size")
NAMES = "CASE o_orderkey % 9 WHEN 0 THEN 'USD' ELSE o_orderpriority END"


def fx_amounts(t):
    o = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.when(o % 9 == 0, "USD").otherwise(F.col("o_orderpriority")).alias("money"),
        F.when(o % 11 != 0, F.col("o_orderdate") + F.make_dt_interval((o % 400).cast("int"))).alias("sold"),
        (F.col("o_totalprice") - 50000).alias("amount"))


# rates of every seventh order day only, so that nearest has gaps to bridge
add("fx_nearest", lambda t: J.to_usd(fx_amounts(t), t.fx.where("day(rate_date) % 7 = 0"), "amount", "money", "sold"), f"""
WITH a AS (SELECT o_orderkey, {NAMES} AS money,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) END AS sold, o_totalprice - 50000 AS amount FROM orders),
r AS (SELECT * FROM fx WHERE day(rate_date) % 7 = 0), l AS (SELECT currency, arg_max(rate, rate_date) AS last_rate FROM r GROUP BY 1),
b AS (SELECT a.o_orderkey, r.rate AS br, r.rate_date AS bd FROM a ASOF JOIN r ON a.money = r.currency AND a.sold >= r.rate_date),
f AS (SELECT a.o_orderkey, r.rate AS fr, r.rate_date AS fd FROM a ASOF JOIN r ON a.money = r.currency AND a.sold <= r.rate_date)
SELECT a.o_orderkey, money, sold, amount, CASE WHEN amount > 0 THEN amount * CASE WHEN money = 'USD' THEN 1 WHEN sold IS NULL THEN last_rate
  WHEN bd IS NOT NULL AND (fd IS NULL OR sold - bd <= fd - sold) THEN br ELSE fr END END AS usd
FROM a LEFT JOIN b USING (o_orderkey) LEFT JOIN f USING (o_orderkey) LEFT JOIN l ON l.currency = money""", "amount usd")
add("semi_join", lambda t: J.traded_markets(t.markets, t.trades).select("condition_id", "question"),
    "SELECT condition_id, question FROM markets WHERE condition_id IN (SELECT condition_id FROM trades)")
add("anti_join", lambda t: J.unseen_wallets(t.activity, t.profiles.where("wallet % 3 = 0")),
    "SELECT DISTINCT wallet FROM activity WHERE wallet NOT IN (SELECT wallet FROM profiles WHERE wallet % 3 = 0)")
RESOLVED_SQL = """SELECT condition_id, category, winning_outcome, end_date, trade_count FROM markets
JOIN (SELECT condition_id, count(*) AS trade_count FROM trades GROUP BY 1 HAVING count(*) >= 3) USING (condition_id)
WHERE resolved = 1 AND winning_outcome <> ''"""
add("resolved_markets", lambda t: J.resolved_markets(t.markets, t.trades, 3).select(
    "condition_id", "category", "winning_outcome", "end_date", "trade_count"), RESOLVED_SQL)


def houses(t):
    lots = t.lots.select("auction", F.col("l_partkey").alias("part_id"), "price", "lot_number", "l_suppkey", "l_returnflag")
    sales = t.orders.select(F.col("o_orderkey").alias("auction"), F.col("o_custkey").alias("house_id"), "o_orderdate",
                            F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("sold"))
    people = t.part.select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") % 5 != 0, 1900 + F.col("p_size")).alias("born"),
                           F.when(F.col("p_size") % 3 == 0, 1960 + F.col("p_size")).alias("died"))
    first = {"lots": lots.where("l_returnflag = 'A'").drop("l_returnflag"), "sales": sales, "extractions": people,
             "auctions": t.customer.select(F.col("c_custkey").alias("house_id"), F.col("c_mktsegment").alias("segment"))}
    second = {"lots": lots.where("l_returnflag <> 'A'").drop("l_returnflag"), "sales": sales, "extractions": people}
    rows = J.star_union({"first": first, "second": second})
    return rows.withColumn("vital", J.vital_status("born", "died", F.year("o_orderdate")))


add("star_union", lambda t: houses(t).groupBy("house", "segment", "vital").agg(F.count("*").alias("lots"), F.sum("price").alias("total")), """
SELECT CASE WHEN l_returnflag = 'A' THEN 'first' ELSE 'second' END AS house, CASE WHEN l_returnflag = 'A' THEN c_mktsegment END AS segment,
  CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 3 = 0 AND 1960 + p_size < year(o_orderdate) THEN 'deceased' ELSE 'living' END AS vital,
  count(*) AS lots, sum(price) AS total FROM lots JOIN orders ON auction = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE price > 0 AND o_orderstatus <> 'P' GROUP BY ALL""", "total")

# ---- aggregates

add("category_breakdown", lambda t: V.category_breakdown(t.markets), f"""
SELECT category, count(*) AS market_count, sum(volume_total) AS total_volume, avg(liquidity) AS avg_liquidity FROM markets WHERE {OPEN} GROUP BY 1""",
    "total_volume avg_liquidity")
add("overview_stats", lambda t: V.overview_stats(t.markets), f"""
SELECT count(*) AS total_markets, count_if({OPEN}) AS active_markets, count_if(resolved = 1) AS resolved_markets, sum(volume_24h) AS volume_24h,
  sum(liquidity) AS liquidity FROM markets""", "volume_24h liquidity")
add("whales_overview", lambda t: V.whales_overview(t.rankings, t.activity, t.positions, t.as_of), f"""
SELECT (SELECT count(DISTINCT wallet) FROM rankings) AS tracked_wallets,
  (SELECT count(*) FROM activity WHERE ts >= {NOW} - INTERVAL 1 DAY AND usdc_size >= 500) AS whale_trades_24h,
  (SELECT count(*) FROM positions WHERE size > 0) AS total_whale_positions,
  (SELECT count(DISTINCT condition_id) FROM positions WHERE size > 0) AS unique_markets_held""")
add("signals_overview", lambda t: V.signals_overview(t.books, t.trades, t.markets, t.as_of, 2 * DAY), f"""
SELECT (SELECT count(DISTINCT condition_id) FROM books WHERE abs(list_sum(bid_sizes) / (list_sum(bid_sizes) + list_sum(ask_sizes)) - 5e-1) > 15e-2) AS obi_signals,
  (SELECT count(DISTINCT condition_id) FROM trades WHERE ts >= {NOW} - INTERVAL 4 HOUR) AS volume_active_markets,
  (SELECT count(*) FROM trades WHERE ts >= {NOW} - INTERVAL 1 DAY AND price * size >= 1000) AS large_trades_24h,
  (SELECT count_if({OPEN}) FROM markets) AS active_markets""")
add("volume_anomalies", lambda t: V.volume_anomalies(t.trades, t.markets, t.as_of, 7 * DAY), f"""
SELECT condition_id, sum(size) AS volume_4h, any_value(question) AS question, any_value(volume_1wk * 1e0) AS average_4h,
  sum(size) / greatest(any_value(volume_1wk * 1e0), 1e-2) AS ratio FROM trades
JOIN (SELECT condition_id, question, volume_1wk FROM markets WHERE {OPEN} AND volume_1wk > 0) USING (condition_id)
WHERE ts >= {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING ratio > 2 AND volume_4h > 100""", "volume_4h average_4h ratio")
TOP5_SQL = """SELECT condition_id, count(*) AS total_holders, sum(amount) AS total_amount, sum(CASE WHEN rn <= 5 THEN amount END) AS top5_amount,
  any_value(CASE WHEN rn = 1 THEN wallet END) AS top_holder, max(amount) AS top_holder_amount FROM
  (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY amount DESC, wallet) AS rn FROM holders) GROUP BY 1"""
add("position_concentration", lambda t: V.position_concentration(t.holders, t.markets), f"""
SELECT t5.*, top5_amount / greatest(total_amount, 1e-2) AS top5_share, question FROM ({TOP5_SQL}) t5
JOIN (SELECT condition_id, question FROM markets) USING (condition_id) WHERE total_holders >= 3 ORDER BY top5_share DESC, condition_id LIMIT 20""",
    "total_amount top5_amount top_holder_amount top5_share")
add("distinct_counts", lambda t: A.distinct_counts(t.trades), """
SELECT condition_id, count(DISTINCT wallet) AS wallets, count(DISTINCT (outcome, side)) AS outcome_sides FROM trades GROUP BY 1""")
# an estimate is compared by its bound: five standard errors of the sketch; ranks within 1 / 10,000
add("approximate_distinct", lambda t: A.distinct_counts(t.trades).join(A.approximate_distinct(t.trades).withColumnRenamed("wallets", "estimate"), "condition_id").select(
    "condition_id", "wallets", (F.abs(F.col("estimate") - F.col("wallets")) <= F.greatest(F.lit(1.0), 0.1 * F.col("wallets"))).alias("within")), """
SELECT condition_id, count(DISTINCT wallet) AS wallets, true AS within FROM trades GROUP BY 1""")
add("category_median", lambda t: A.category_median(t.markets),
    "SELECT category, quantile_cont(volume_total, 5e-1) AS median_volume FROM markets WHERE resolved = 1 GROUP BY 1", "median_volume")
add("category_median_approx", lambda t: t.markets.where("resolved = 1").join(A.category_median(t.markets, approximate=True), "category").groupBy("category").agg(
    F.count("*").alias("markets"), (F.abs(F.avg(F.when(F.col("volume_total") <= F.col("median_volume"), 1.0).otherwise(0.0)) - 0.5) <= 1e-4 + 1 / F.count("*")).alias("within")), """
SELECT category, count(*) AS markets, true AS within FROM markets WHERE resolved = 1 GROUP BY 1""")
add("wallet_trade_profile", lambda t: A.wallet_trade_profile(t.activity, t.as_of), f"""
SELECT wallet, count(*) AS trade_count, CAST(count_if(side = 'BUY') AS DOUBLE) / count(*) AS buy_ratio, avg(usdc_size) AS avg_size,
  stddev_pop(usdc_size) AS std_size, count(DISTINCT condition_id) AS unique_markets FROM activity WHERE ts >= {NOW} - INTERVAL 30 DAY
GROUP BY 1 HAVING count(*) >= 5""", "buy_ratio avg_size std_size")
WIN_SQL = """SELECT wallet, count_if(winning_outcome = outcome) AS wins, count(*) AS resolved_count,
  CAST(count_if(winning_outcome = outcome) AS DOUBLE) / count(*) AS win_rate FROM positions
  JOIN (SELECT condition_id, winning_outcome FROM markets WHERE resolved = 1) USING (condition_id) WHERE size > 0 GROUP BY 1 HAVING count(*) >= 3"""
add("wallet_win_rate", lambda t: A.wallet_win_rate(t.positions, t.markets), WIN_SQL, "win_rate")
ROI_SQL = """SELECT wallet, sum(cash_pnl) AS pnl, sum(initial_value) AS invested, sum(cash_pnl) / sum(initial_value) AS roi
  FROM positions GROUP BY 1 HAVING sum(initial_value) > 0"""
add("wallet_roi", lambda t: A.wallet_roi(t.positions), ROI_SQL, "pnl invested roi")
FOCUS_SQL = """SELECT wallet, CAST(sum(positions) AS BIGINT) AS positions, CAST(sum(CASE WHEN category = 'PROMO' THEN positions ELSE 0 END) AS BIGINT) AS focus_positions,
  CAST(sum(CASE WHEN category = 'PROMO' THEN wins ELSE 0 END) AS BIGINT) AS focus_wins, sum(CASE WHEN category = 'PROMO' THEN pnl ELSE 0 END) AS focus_pnl,
  CAST(sum(CASE WHEN category = 'PROMO' THEN positions ELSE 0 END) AS DOUBLE) / sum(positions) AS focus_share FROM
  (SELECT wallet, category, sum(cash_pnl) AS pnl, count(*) AS positions, count_if(cash_pnl > 0) AS wins FROM positions
   JOIN (SELECT condition_id, category FROM markets) USING (condition_id) WHERE size > 0 GROUP BY ALL) GROUP BY 1"""
add("wallet_category_pnl", lambda t: A.category_focus(A.wallet_category_pnl(t.positions, t.markets), "PROMO"), FOCUS_SQL, "focus_pnl focus_share")
RATIO_SQL = """SELECT wallet, avg(current_value / greatest(liquidity, 1)) AS size_ratio FROM positions
  JOIN (SELECT condition_id, liquidity FROM markets WHERE active = 1) USING (condition_id) WHERE size > 0 GROUP BY 1"""
add("size_vs_liquidity", lambda t: A.size_vs_liquidity(t.positions, t.markets), RATIO_SQL, "size_ratio")
add("gini", lambda t: A.gini(t.trades, ["condition_id"], "usdc_size"), """
SELECT condition_id, (2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)) AS gini, count(*) AS n FROM
  (SELECT condition_id, usdc_size AS x, row_number() OVER (PARTITION BY condition_id ORDER BY usdc_size) AS i FROM trades) GROUP BY 1""", "gini")


def listings(t):
    return t.part.select(F.col("p_brand").alias("district"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice") / 7).otherwise(0.0).alias("price"),
                         F.col("p_type").alias("source"))


add("listing_stats", lambda t: A.listing_stats(listings(t)), """
WITH l AS (SELECT p_brand AS district, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 7 ELSE 0 END AS price, p_type AS source FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY price) AS rn, count(*) OVER (PARTITION BY district) AS n FROM l WHERE price > 0)
SELECT district, count(*) AS listings, sum(price) / count(*) AS avg_price, count(DISTINCT source) AS sources,
  (SELECT r.price FROM r WHERE r.district = l.district AND r.rn = r.n // 2 + 1) AS median_price FROM l GROUP BY 1""", "avg_price median_price")


def districts(t):
    s = F.col("s_suppkey")
    score = (s * 13 % 101).cast("double")
    return t.supplier.select(
        s.alias("district"), score.alias("score"), F.col("s_acctbal").alias("population"), F.when(s % 3 == 0, 1).otherwise(0).alias("coastal"),
        F.when(score < 25, "A").when(score < 40, "B").when(score < 55, "C").when(score < 70, "D").otherwise("F").alias("grade"),
        F.col("s_nationkey").alias("category"), (s * 17 % 101).cast("double").alias("previous"))


DISTRICT_SQL = """SELECT s_suppkey AS district, CAST(s_suppkey * 13 % 101 AS DOUBLE) AS score, s_acctbal AS population,
  CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS coastal, s_nationkey AS category, CAST(s_suppkey * 17 % 101 AS DOUBLE) AS previous FROM supplier"""
add("risk_overview", lambda t: A.risk_overview(districts(t)), f"""
SELECT count(*) AS districts, count_if(score < 25) AS grade_a, count_if(score >= 25 AND score < 40) AS grade_b, count_if(score >= 40 AND score < 55) AS grade_c,
  count_if(score >= 55 AND score < 70) AS grade_d, count_if(score >= 70) AS grade_f, avg(score) AS avg_score, sum(population) AS population,
  count_if(coastal = 1) AS coastal FROM ({DISTRICT_SQL})""", "avg_score population")
add("indicator_overview", lambda t: A.indicator_overview(districts(t)), f"""
WITH c AS (SELECT category, count(*) AS indicators, avg(score) AS avg_score, avg(score - previous) AS change, count_if(score >= 70) AS severe
  FROM ({DISTRICT_SQL}) GROUP BY 1)
SELECT *, CASE WHEN change > 3 THEN 'worsening' WHEN change < -3 THEN 'improving' ELSE 'stable' END AS trend,
  CASE WHEN avg_score = (SELECT max(avg_score) FROM c) THEN 1 ELSE 0 END AS is_top FROM c""", "avg_score change")
BARS = "SELECT condition_id, outcome, date_trunc('hour', ts) AS bar_time, arg_max(price, ROW(ts, trade_id)) AS close, sum(size) AS volume FROM trades GROUP BY ALL"
add("technical_indicators", lambda t: V.technical_indicators(ohlcv_bars(t.trades, 3600), t.as_of, 31), f"""
WITH b AS ({BARS}), d AS (SELECT *, close - lag(close, 1, close) OVER s AS delta, coalesce(lag(close, 24) OVER s, 0) AS p24 FROM b
  WINDOW s AS (PARTITION BY condition_id, outcome ORDER BY bar_time))
SELECT condition_id, outcome, bar_time, close, volume,
  100 - 100 / (1 + avg(CASE WHEN delta > 0 THEN delta ELSE 0 END) OVER w / greatest(avg(CASE WHEN delta < 0 THEN -delta ELSE 0 END) OVER w, 1e-4)) AS rsi,
  sum(close * volume) OVER v / greatest(sum(volume) OVER v, 1e-4) AS vwap, CASE WHEN p24 > 0 THEN (close - p24) / p24 * 100 ELSE 0 END AS momentum
FROM d WINDOW w AS (PARTITION BY condition_id, outcome ORDER BY bar_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY condition_id, outcome, CAST(bar_time AS DATE) ORDER BY bar_time)""", "close volume rsi vwap momentum")
