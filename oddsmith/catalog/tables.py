"""Sources, versioned tables, bars, set operations and scalar functions."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.functions import scalars as S
from oddsmith.operators import bars as B
from oddsmith.operators import pairs, versions
from oddsmith.operators.ordered import DAY
from oddsmith.sources import parse, tables

# ---- sources ---------------------------------------------------------------


def raw_events(t):
    """Event JSON with its markets inside, lists double encoded; some fields are left out or bad."""
    m = t.markets
    text = lambda c: F.to_json(F.transform(c, lambda x: x.cast("string")))
    done = F.col("closed") == 1
    won = F.when(F.col("winning_outcome") == "Yes", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    market = F.struct(
        F.when(F.col("condition_id") % 50 != 7, F.col("condition_id").cast("string")).alias("conditionId"),
        F.concat(F.lit("m-"), F.col("condition_id")).alias("slug"), "question",
        text(F.col("outcomes")).alias("outcomes"), text(F.when(done, won).otherwise(F.array(F.lit(0.25), F.lit(0.75)))).alias("outcomePrices"),
        text(F.col("token_ids")).alias("clobTokenIds"), (F.col("active") == 1).alias("active"), done.alias("closed"),
        F.when(F.col("condition_id") % 2 == 0, "resolved").otherwise("proposed").alias("umaResolutionStatus"),
        F.col("volume_24h").alias("volume24hr"), F.col("volume_total").alias("volume"), F.col("liquidity").alias("liquidityNum"),
        F.when(F.col("condition_id") % 5 == 0, "soon").otherwise(F.date_format("end_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("endDate"),
    )
    event = F.struct(
        F.concat(F.col("event_slug"), F.lit("-"), F.col("condition_id")).alias("id"), F.col("event_slug").alias("slug"),
        F.when(F.col("condition_id") % 4 != 0, F.transform("tags", lambda x: F.struct(x.alias("label")))).alias("tags"),
        F.array(market).alias("markets"),
    )
    return m.select(F.to_json(event).alias("value"))


def flat(t):
    return parse.flatten_markets(raw_events(t)).select(
        "condition_id", "event_id", "event_slug", "category", F.size("tags").alias("n_tags"), F.concat_ws(",", "outcomes").alias("outcomes"),
        S.array_sum("outcome_prices").alias("price_sum"), F.concat_ws(",", "token_ids").alias("token_ids"), "active", "closed", "resolved",
        "winning_outcome", "volume_total", "volume_24h", "liquidity", "end_date",
    )


add("flatten_markets", flat, """
SELECT CAST(condition_id AS VARCHAR) AS condition_id, event_slug || '-' || condition_id AS event_id, event_slug,
  CASE WHEN condition_id % 4 <> 0 THEN category ELSE '' END AS category,
  CASE WHEN condition_id % 4 <> 0 THEN 2 ELSE 0 END AS n_tags, 'Yes,No' AS outcomes, 1.0 AS price_sum,
  (2 * condition_id) || ',' || (2 * condition_id + 1) AS token_ids, active, closed,
  CASE WHEN closed = 1 AND condition_id % 2 = 0 THEN 1 ELSE 0 END AS resolved, winning_outcome, volume_total, volume_24h, liquidity,
  CASE WHEN condition_id % 5 = 0 THEN TIMESTAMP '2099-01-01' ELSE end_date END AS end_date
FROM markets WHERE condition_id % 50 <> 7""", "price_sum volume_total volume_24h liquidity")


def raw_trades(t):
    e = F.col("trade_id")
    return t.trades.select(F.to_json(F.struct(
        F.when(e % 17 != 0, F.col("condition_id").cast("string")).alias("conditionId"), F.col("token_id").cast("string").alias("asset"),
        F.when(e % 13 != 0, F.col("size")).alias("size"), "price", F.upper("side").alias("side"), "outcome",
        F.when(e % 11 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        F.concat(F.lit("0x"), e).alias("transactionHash"))).alias("value"))


add("parse_trades", lambda t: parse.parse_trades(raw_trades(t))[0], """
SELECT CAST(condition_id AS VARCHAR) AS condition_id, CAST(token_id AS VARCHAR) AS token_id, outcome, price,
  CASE WHEN trade_id % 13 <> 0 THEN size ELSE 0 END AS size, side, '0x' || trade_id AS trade_id, ts
FROM trades WHERE trade_id % 17 <> 0 AND trade_id % 11 <> 0""", "price size")
add("parse_trades_quarantine", lambda t: parse.parse_trades(raw_trades(t))[1].select("trade_id", "raw_time"), """
SELECT '0x' || trade_id AS trade_id, 'yesterday' AS raw_time FROM trades WHERE trade_id % 17 <> 0 AND trade_id % 11 = 0""")


def raw_positions(t):
    return t.position_versions.select(F.to_json(F.struct(
        F.col("wallet").cast("string").alias("proxyWallet"), F.col("condition_id").cast("string").alias("conditionId"), "outcome",
        (F.col("position_id") % 300 - 20).alias("outcomeIndex"), F.col("size"), F.col("initial_value").alias("initialValue"),
        F.when(F.col("position_id") % 3 != 0, F.col("cash_pnl")).alias("cashPnl"),
        F.when(F.col("position_id") % 7 == 0, "n/a").otherwise(F.date_format("version", "yyyy-MM-dd")).alias("endDate"))).alias("value"))


add("parse_positions", lambda t: parse.parse_positions(raw_positions(t)).select(
    "proxy_wallet", "condition_id", "outcome", "outcome_index", "size", "initial_value", "cash_pnl", "avg_price", "end_date"), """
SELECT CAST(wallet AS VARCHAR) AS proxy_wallet, CAST(condition_id AS VARCHAR) AS condition_id, outcome,
  greatest(0, position_id % 300 - 20) AS outcome_index, size, initial_value,
  CASE WHEN position_id % 3 <> 0 THEN cash_pnl ELSE 0 END AS cash_pnl, 0.0 AS avg_price,
  CASE WHEN position_id % 7 = 0 THEN TIMESTAMP '2099-01-01' ELSE version END AS end_date FROM position_versions""",
    "size initial_value cash_pnl avg_price")
add("parse_leaderboard", lambda t: parse.parse_leaderboard(
    t.rankings.select(F.to_json(F.struct(F.col("wallet").cast("string").alias("proxyWallet"), "rank", "pnl",
                                          (F.col("wallet") % 2 == 0).alias("verifiedBadge"))).alias("value")), "OVERALL", "ALL", "PNL"), """
SELECT CAST(wallet AS VARCHAR) AS proxy_wallet, '' AS user_name, rank, category, period AS time_period, order_by, pnl, 0.0 AS volume,
  CASE WHEN wallet % 2 = 0 THEN 1 ELSE 0 END AS verified_badge, '' AS x_username FROM rankings""", "pnl volume")
add("parse_profiles", lambda t: parse.parse_profiles(
    t.profiles.select(F.to_json(F.struct(F.col("wallet").cast("string").alias("proxyWallet"), "pseudonym",
                                          F.when(F.col("wallet") % 9 != 0, F.date_format("profile_created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("createdAt"))).alias("value"))
).select("proxy_wallet", "pseudonym", "verified_badge", "profile_created_at", "discovered_via"), """
SELECT CAST(wallet AS VARCHAR) AS proxy_wallet, pseudonym, 0 AS verified_badge,
  CASE WHEN wallet % 9 <> 0 THEN profile_created_at ELSE TIMESTAMP '1970-01-01' END AS profile_created_at, 'leaderboard' AS discovered_via
FROM profiles""")
add("parse_holders", lambda t: parse.parse_holders(t.holders.select("condition_id", F.to_json(F.struct(
    F.concat(F.lit("t"), F.col("condition_id")).alias("token"),
    F.array(F.struct(F.col("wallet").cast("string").alias("proxyWallet"), (F.col("wallet") * 5).alias("outcomeIndex"), "amount")).alias("holders"),
)).alias("value"))), """
SELECT condition_id, 't' || condition_id AS token_id, CAST(wallet AS VARCHAR) AS proxy_wallet, '' AS pseudonym,
  wallet * 5 AS outcome_index, amount FROM holders""", "amount")
add("parse_activity", lambda t: parse.parse_activity(t.activity.select(F.to_json(F.struct(
    F.col("wallet").cast("string").alias("proxyWallet"), F.col("condition_id").cast("string").alias("conditionId"), F.lower("side").alias("side"),
    F.col("usdc_size").alias("usdcSize"), "price", F.col("transaction_hash").cast("string").alias("transactionHash"),
    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))).alias("value")))[0].select(
    "proxy_wallet", "condition_id", "activity_type", "side", "usdc_size", "price", "size", "transaction_hash", "ts"), """
SELECT CAST(wallet AS VARCHAR) AS proxy_wallet, CAST(condition_id AS VARCHAR) AS condition_id, activity_type, side, usdc_size, price,
  0.0 AS size, CAST(transaction_hash AS VARCHAR) AS transaction_hash, ts FROM activity""", "usdc_size price size")


def raw_books(t):
    level = lambda p, s: F.transform(F.arrays_zip(p, s), lambda z: F.struct(
        F.when(z[p] != 0.47, z[p].cast("string")).alias("price"), F.when(z[s] > 20, z[s].cast("string")).alias("size")))
    return t.books.select(F.to_json(F.struct(
        F.col("condition_id").cast("string").alias("market"), F.col("snapshot_id").cast("string").alias("asset_id"),
        F.unix_millis("snapshot_time").cast("string").alias("timestamp"),
        level("bid_prices", "bid_sizes").alias("bids"), level("ask_prices", "ask_sizes").alias("asks"))).alias("value"))


add("parse_orderbooks", lambda t: parse.parse_orderbooks(raw_books(t)).select(
    "condition_id", "token_id", F.size("bid_prices").alias("n_bid_prices"), F.size("bid_sizes").alias("n_bid_sizes"),
    S.array_sum("ask_prices").alias("ask_prices"), S.array_sum("ask_sizes").alias("ask_sizes"), "snapshot_time"), """
SELECT CAST(condition_id AS VARCHAR) AS condition_id, CAST(snapshot_id AS VARCHAR) AS token_id, 7 AS n_bid_prices,
  len(list_filter(bid_sizes, lambda x: x > 20)) AS n_bid_sizes, list_sum(ask_prices) AS ask_prices,
  coalesce(list_sum(list_filter(ask_sizes, lambda x: x > 20)), 0) AS ask_sizes, snapshot_time FROM books""", "ask_prices ask_sizes")
add("derive_mid_price", lambda t: tables.derive_mid_price(
    t.prices.select("token_id", "ts", F.when(F.col("trade_id") % 6 == 0, 0.0).otherwise(F.col("bid")).alias("bid"), "ask"),
    tables.token_map(t.markets.where("condition_id % 10 <> 3"))), """
SELECT token_id, ts, CASE WHEN trade_id % 6 = 0 THEN 0 ELSE bid END AS bid, ask,
  CASE WHEN k % 10 = 3 THEN '' ELSE CAST(k AS VARCHAR) END AS condition_id, CASE WHEN k % 10 = 3 THEN '' ELSE o END AS outcome,
  CASE WHEN trade_id % 6 <> 0 AND bid > 0 THEN (bid + ask) / 2 ELSE greatest(ask, CASE WHEN trade_id % 6 = 0 THEN 0 ELSE bid END) END AS price
FROM (SELECT *, condition_id AS k, outcome AS o FROM prices)""", "bid ask price")
add("book_derived_columns", lambda t: tables.with_book_columns(t.books).select(
    "snapshot_id", "best_bid", "best_ask", "spread", "mid", "bid_depth", "ask_depth", "ts_date"), """
SELECT snapshot_id, bid_prices[1] AS best_bid, ask_prices[1] AS best_ask, ask_prices[1] - bid_prices[1] AS spread,
  (bid_prices[1] + ask_prices[1]) / 2 AS mid, list_sum(bid_sizes) AS bid_depth, list_sum(ask_sizes) AS ask_depth,
  CAST(snapshot_time AS DATE) AS ts_date FROM books""", "best_bid best_ask spread mid bid_depth ask_depth")
add("retention", lambda t: tables.retain(t.trades, "ts", 7, t.as_of).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("kept")), """
SELECT CAST(ts AS DATE) AS day, count(*) AS kept FROM trades WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL""")
add("data_coverage", lambda t: tables.data_coverage({
    "trades": (t.trades, ["condition_id", "outcome"], "ts"), "books": (t.books, ["condition_id"], "snapshot_time")}), """
SELECT 'trades' AS table_name, condition_id || '/' || outcome AS key, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts
FROM trades GROUP BY condition_id, outcome UNION ALL
SELECT 'books', CAST(condition_id AS VARCHAR), count(*), min(snapshot_time), max(snapshot_time) FROM books GROUP BY condition_id""")

# ---- versions and bars -----------------------------------------------------

add("latest_version", lambda t: versions.latest_version(t.market_versions, ["user_id", "event_type"], ["ts", "event_id"]), """
SELECT user_id, event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""", "value")
add("latest_position", lambda t: t.positions.drop("version"), "SELECT * EXCLUDE (version) FROM positions",
    "size initial_value cash_pnl current_value")
add("latest_price", lambda t: versions.latest_price(t.trades, ["condition_id", "outcome"]), """
SELECT condition_id, outcome, arg_max(price, ROW(ts, trade_id)) AS price, max(ts) AS price_time FROM trades GROUP BY ALL""", "price")
add("limit_by", lambda t: versions.limit_by(
    t.trades.select("condition_id", "trade_id", "ts", "price"), ["condition_id"], [F.desc("ts"), F.desc("trade_id")])
    .orderBy(F.desc("ts"), F.desc("trade_id")).limit(20), """
SELECT condition_id, trade_id, ts, price FROM (SELECT * FROM trades
  QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY ts DESC, trade_id DESC) = 1) ORDER BY ts DESC, trade_id DESC LIMIT 20""", "price")

BAR_DOUBLES = "open high low close volume buy_volume sell_volume"
BAR_SQL = """SELECT condition_id, outcome, {bucket} AS bar_time, arg_min(price, ROW(ts, trade_id)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ROW(ts, trade_id)) AS close, sum(size) AS volume, count(*) AS trade_count,
  sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS sell_volume,
  min(ts) AS open_ts, max(ts) AS close_ts FROM {source} GROUP BY ALL"""


def bar_sql(unit, source="trades"):
    return BAR_SQL.format(bucket=f"date_trunc('{unit}', ts)", source=source)


add("ohlcv_1m", lambda t: B.ohlcv_bars(t.trades, 60), bar_sql("minute"), BAR_DOUBLES)
add("ohlcv_1h", lambda t: B.ohlcv_bars(t.trades, 3600), bar_sql("hour"), BAR_DOUBLES)
add("ohlcv_1d_with_ties", lambda t: B.ohlcv_bars(t.trades_big, DAY), bar_sql("day", "trades_big"), BAR_DOUBLES)
add("rollup_bars", lambda t: B.rollup_bars(B.ohlcv_bars(t.trades, 60), DAY), bar_sql("day"), BAR_DOUBLES)
add("volume_daily", lambda t: B.with_vwap(B.volume_daily(t.trades)), """
SELECT condition_id, CAST(ts AS DATE) AS day, sum(size) AS volume, sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS buy_volume,
  sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS sell_volume, count(*) AS trade_count, sum(price * size) AS notional,
  sum(price * size) / sum(size) AS vwap FROM trades GROUP BY ALL""", "volume buy_volume sell_volume notional vwap")
add("resample", lambda t: B.resample(t.prices, ["token_id"], 900, [F.avg("price").alias("price"), F.avg("bid").alias("bid"), F.avg("ask").alias("ask")]), """
SELECT token_id, time_bucket(INTERVAL '15 minutes', ts) AS bucket, avg(price) AS price, avg(bid) AS bid, avg(ask) AS ask
FROM prices GROUP BY ALL""", "price bid ask")
SIX_HOURS = """SELECT token_id, time_bucket(INTERVAL '6 hours', ts) AS bucket, avg(price) AS price FROM prices GROUP BY ALL"""
ALIGNED_SQL = f"""WITH s AS ({SIX_HOURS}), grid AS (SELECT token_id, bucket FROM (SELECT DISTINCT token_id FROM s), (SELECT DISTINCT bucket FROM s)),
j AS (SELECT token_id, bucket, s.price FROM grid LEFT JOIN s USING (token_id, bucket)),
f AS (SELECT token_id, bucket, last_value(price IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY bucket) AS fwd,
  first_value(price IGNORE NULLS) OVER (PARTITION BY token_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head FROM j)"""


def aligned(t, seconds=6 * 3600):
    series = B.resample(t.prices, ["token_id"], seconds, [F.avg("price").alias("price")])
    return B.align_ffill(series, ["token_id"], "price")


add("align_ffill", aligned, f"{ALIGNED_SQL} SELECT token_id, bucket, coalesce(fwd, head) AS price FROM f", "price")


def with_fallback(t):
    stored = B.resample(t.prices.where("condition_id % 3 <> 0"), ["condition_id"], 3600, [F.avg("price").alias("price")])
    derived = B.resample(t.trades, ["condition_id"], 3600, [F.max("price").alias("price")])
    return B.bars_or_trades(stored, derived, ["condition_id"])


add("fallback_bars", with_fallback, """
SELECT condition_id, date_trunc('hour', ts) AS bucket, avg(price) AS price FROM trades WHERE condition_id % 3 <> 0 GROUP BY ALL
UNION ALL SELECT condition_id, date_trunc('hour', ts), max(price) FROM trades WHERE condition_id % 3 = 0 GROUP BY ALL""", "price")

# ---- set operations --------------------------------------------------------


def union_horizons(t):
    part = lambda h: t.trades.where(F.col("ts") <= S.ago(t.as_of, h * 3600)).groupBy("condition_id").agg(
        F.count("*").alias("n")).withColumn("hours", F.lit(h))
    return part(0).unionByName(part(24)).unionByName(part(168))


add("union_all", union_horizons, """
SELECT condition_id, count(*) AS n, hours FROM trades, (VALUES (0), (24), (168)) h(hours)
WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' - to_hours(hours) GROUP BY condition_id, hours""")
add("distinct_pairs", lambda t: t.trades.select("wallet", "condition_id").distinct(), "SELECT DISTINCT wallet, condition_id FROM trades")


def jaccard(t):
    return pairs.shared_key_pairs(t.trades, "wallet", "condition_id", 3).select(
        "a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))


add("jaccard_pairs", jaccard, """
WITH h AS (SELECT DISTINCT wallet, condition_id FROM trades), n AS (SELECT wallet, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT a.wallet AS a, b.wallet AS b, count(*) AS common FROM h a JOIN h b ON a.condition_id = b.condition_id AND a.wallet < b.wallet
  GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, common, CAST(common AS DOUBLE) / (x.n + y.n - common) AS jaccard FROM p JOIN n x ON x.wallet = a JOIN n y ON y.wallet = b""", "jaccard")
add("state_difference", lambda t: versions.closed_since(
    t.markets.where("active = 1").select("condition_id", F.lit("yes_no").alias("kind")),
    t.trades.where(F.col("ts") >= S.ago(t.as_of, 3 * DAY)).select("condition_id", F.lit("yes_no").alias("kind")), ["condition_id", "kind"]), """
SELECT condition_id, 'yes_no' AS kind FROM markets WHERE active = 1 AND condition_id NOT IN
  (SELECT condition_id FROM trades WHERE ts >= TIMESTAMP '2024-01-28 00:00:00')""")

# ---- scalar functions ------------------------------------------------------

add("array_functions", lambda t: t.books.select(
    "snapshot_id", S.array_sum("bid_sizes").alias("total"), S.array_sum(F.slice("bid_sizes", 1, 5)).alias("top5"),
    F.size("bid_sizes").alias("n_levels"), F.element_at("ask_sizes", 1).alias("first_ask"),
    F.when(F.array_contains("bid_prices", 0.5), 1).otherwise(0).alias("has_half"), F.array_max("bid_sizes").alias("largest")), """
SELECT snapshot_id, list_sum(bid_sizes) AS total, list_sum(bid_sizes[1:5]) AS top5, len(bid_sizes) AS n_levels, ask_sizes[1] AS first_ask,
  CASE WHEN list_contains(bid_prices, 5e-1) THEN 1 ELSE 0 END AS has_half, list_max(bid_sizes) AS largest FROM books""", "total top5 first_ask largest")
add("safe_math", lambda t: t.markets.select(
    "condition_id", S.ratio_or_null("volume_24h", "liquidity").alias("or_null"), S.safe_ratio("volume_24h", F.col("liquidity") - 2500, 0.01).alias("floored"),
    S.clamp100(F.col("one_day_price_change") * 1000).alias("clamped"), F.coalesce(F.nullif("winning_outcome", F.lit("")), F.lit("open")).alias("winner")), """
SELECT condition_id, volume_24h / nullif(liquidity, 0) AS or_null, volume_24h / greatest(liquidity - 2500, 1e-2) AS floored,
  least(100, greatest(-100, one_day_price_change * 1000)) AS clamped, coalesce(nullif(winning_outcome, ''), 'open') AS winner FROM markets""",
    "or_null floored clamped")
add("date_functions", lambda t: t.trades.select(
    "trade_id", F.date_trunc("minute", "ts").alias("minute"), F.date_trunc("hour", "ts").alias("hour"), B.bucket("ts", 300).alias("five"),
    F.date_format("ts", "yyyy-MM").alias("month"), S.ago(F.col("ts"), 4 * 3600).alias("earlier"), F.to_date("ts").alias("day")), """
SELECT trade_id, date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL '5 minutes', ts) AS five,
  strftime(ts, '%Y-%m') AS month, ts - INTERVAL 4 HOUR AS earlier, CAST(ts AS DATE) AS day FROM trades""")
add("json_build_extract", lambda t: t.events.select(
    "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
    F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("evidence")), """
SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
  '{"type":"' || event_type || '","user":' || user_id || '}' AS evidence FROM events""")
add("hash_ids", lambda t: t.articles.select("article_id", S.key_id("source", "title", length=16).alias("short_id"), S.key_id("source", "body").alias("long_id")), """
SELECT article_id, sha256(source || ':' || title)[1:16] AS short_id, sha256(source || ':' || body)[1:32] AS long_id FROM articles""")
add("threshold_parse", lambda t: t.markets.select(
    "condition_id", S.ou_threshold("question").alias("threshold"), S.ladder_template("question").alias("template"),
    S.ou_threshold("description").alias("none")), """
SELECT condition_id, strike AS threshold, lower(category) || ' o/u {threshold}' AS template, CAST(NULL AS DOUBLE) AS none FROM markets""", "threshold none")


def with_lot_texts(lots):
    q, d = F.col("l_quantity").cast("int"), F.col("p_size")
    return lots.withColumns({
        "dims": F.when(d % 4 == 0, F.concat(q, F.lit(" x "), d, F.lit(" cm")))
        .when(d % 4 == 1, F.concat(q, F.lit(" w x "), d, F.lit(" h x 7 d cm")))
        .when(d % 4 == 2, F.concat(q, F.lit(",5 x "), d, F.lit(" in"))).otherwise("n/a"),
        "made": F.when(d % 5 == 0, F.concat(F.lit("circa "), 1900 + q)).when(d % 5 == 1, F.lit("19TH CENTURY"))
        .when(d % 5 == 2, F.concat(1900 + q, F.lit("-"), 1910 + d)).when(d % 5 == 3, (1900 + q).cast("string")).otherwise("undated")})


def lot_texts(t):
    return with_lot_texts(t.lots).select(F.col("lot_id.*"), "dims", "made")


add("dimension_year_parse", lambda t: lot_texts(t).select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.parse_dimensions("dims").alias("s"), S.parse_creation_year("made").alias("y")
).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "s.*", F.col("y.year").cast("double").alias("year"), F.col("y.approx").alias("approx")), """
SELECT auction AS l_orderkey, lot_number AS l_linenumber, l_partkey, l_suppkey, price AS l_extendedprice,
  CASE p_size % 4 WHEN 0 THEN l_quantity WHEN 1 THEN p_size WHEN 2 THEN (l_quantity + 5e-1) * 254e-2 END AS h,
  CASE p_size % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN l_quantity WHEN 2 THEN p_size * 254e-2 END AS w,
  CASE WHEN p_size % 4 = 1 THEN 7e0 END AS d,
  CASE p_size % 5 WHEN 0 THEN 1900 + l_quantity WHEN 1 THEN 1850 WHEN 2 THEN floor((1900 + l_quantity + 1910 + p_size) / 2)
    WHEN 3 THEN 1900 + l_quantity END AS year,
  CASE WHEN p_size % 5 IN (0, 1, 2) THEN 1 ELSE 0 END AS approx FROM lots""", "l_extendedprice h w d year")

PLACES = [("ring", "harbour"), ("small", "hills"), ("red", "coast"), ("blue", "lake")]


def listing_texts(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("listing_id"), "p_name", "p_brand",
        F.when(k % 3 == 0, F.concat(F.lit("Rp "), k % 90, F.lit(",5 Miliar"))).when(k % 3 == 1, F.concat(F.lit("Rp "), k % 900, F.lit(" Juta")))
        .otherwise(F.concat(F.lit("Rp 1."), 100 + k % 800, F.lit(".000"))).alias("price_text"),
        F.when(k % 3 == 0, F.concat(k % 500, F.lit(" m²"))).when(k % 3 == 1, F.concat(k % 40, F.lit(",5 are"))).otherwise(F.concat(k % 9, F.lit(" ha"))).alias("area_text"),
        F.when(k % 2 == 0, F.concat(k % 11, F.lit(".35 LS"))).otherwise(F.concat(F.lit("11"), k % 10, F.lit(".50 BT"))).alias("coord"))


add("listing_parse", lambda t: listing_texts(t).select(
    "listing_id", S.parse_price_idr("price_text").alias("price"), S.parse_area_m2("area_text").alias("area"),
    S.first_keyword("p_name", PLACES, "other").alias("district"), S.parse_coordinate("coord").alias("c")).select("listing_id", "price", "area", "district", "c.*"), """
SELECT p_partkey AS listing_id,
  CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 90 + 5e-1) * 1e9 WHEN 1 THEN (p_partkey % 900) * 1e6 ELSE 1000000 + (100 + p_partkey % 800) * 1000 END AS price,
  CASE p_partkey % 3 WHEN 0 THEN p_partkey % 500 WHEN 1 THEN (p_partkey % 40 + 5e-1) * 100 ELSE (p_partkey % 9) * 10000 END AS area,
  CASE WHEN contains(p_name, 'ring') THEN 'harbour' WHEN contains(p_name, 'small') THEN 'hills' WHEN contains(p_name, 'red') THEN 'coast'
    WHEN contains(p_name, 'blue') THEN 'lake' ELSE 'other' END AS district,
  CASE WHEN p_partkey % 2 = 0 THEN -(p_partkey % 11 + 35e-2) ELSE 0 END AS lat,
  CASE WHEN p_partkey % 2 = 1 THEN 110 + p_partkey % 10 + 5e-1 ELSE 0 END AS lng FROM part""", "price area lat lng")
add("search_terms", lambda t: t.benchmark.select("item_id", S.search_terms(F.concat(F.lit("Will "), F.col("text"), F.lit("??"))).alias("terms")), """
SELECT item_id, CASE WHEN length(trim(text)) > 60 THEN regexp_replace(trim(text)[1:60], ' [^ ]*$', '') ELSE trim(text) END AS terms FROM benchmark""")
