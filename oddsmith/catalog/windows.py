"""Window computations over aligned series, trades and lots."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.catalog.tables import ALIGNED_SQL, aligned
from oddsmith.plans import windows as W
from oddsmith.plans.time_joins import resolved_markets

SERIES = f"series AS ({ALIGNED_SQL} SELECT token_id, bucket, coalesce(fwd, head) AS price FROM f)"
LOT_KEYS = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice"

add("log_returns", lambda t: W.returns(aligned(t), ["token_id"]), f"""
WITH {SERIES}, l AS (SELECT *, lag(price) OVER (PARTITION BY token_id ORDER BY bucket) AS p FROM series)
SELECT token_id, bucket, CASE WHEN price > 0 AND p > 0 THEN ln(price / p) END AS log_return, price - p AS diff,
  ln(greatest(price, 1e-10)) - ln(greatest(p, 1e-10)) AS floored_return FROM l WHERE p IS NOT NULL""", "log_return diff floored_return")
add("sibling_market", lambda t: W.sibling_market(t.markets), """
SELECT a.condition_id, a.event_slug, min(b.condition_id) AS sibling FROM markets a JOIN markets b
  ON a.event_slug = b.event_slug AND a.condition_id <> b.condition_id GROUP BY ALL""")
add("peak_volume_day", lambda t: W.peak_volume_day(t.trades), """
SELECT condition_id, day AS peak_day, volume AS peak_volume FROM (SELECT condition_id, CAST(ts AS DATE) AS day, sum(size) AS volume FROM trades GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY volume DESC, day) = 1""", "peak_volume")
HISTORY_SQL = """WITH l AS (SELECT *, CAST(sale_date AS DATE) - DATE '1970-01-01' AS d, ln(price) AS p FROM lots),
s AS (SELECT *, count(*) OVER h AS k, avg(p) OVER h AS m, stddev_pop(p) OVER h AS sd, covar_pop(p, d) OVER h AS cv, stddev_pop(d) OVER h AS st, median(p) OVER h AS md,
  count(*) OVER (PARTITION BY artist) AS total FROM l WINDOW h AS (PARTITION BY artist ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT auction AS l_orderkey, lot_number AS l_linenumber, l_partkey, l_suppkey, price AS l_extendedprice, total AS artist_lot_count,
  CASE WHEN total < 5 THEN 1 ELSE 0 END AS is_rare_artist, CASE WHEN k >= 5 THEN m END AS avg_log_price, CASE WHEN k >= 5 THEN md END AS median_log_price, CASE WHEN k >= 5 THEN sd END AS price_std,
  CASE WHEN k > 0 THEN ln(1 + k) END AS prior_lots, CASE WHEN k >= 5 AND st > 1e-4 THEN cv / st END AS price_trend FROM s"""
add("artist_history", lambda t: W.artist_history(t.lots).select(
    "lot_id.*", "artist_lot_count", "is_rare_artist", "avg_log_price", "median_log_price", "price_std", "prior_lots", "price_trend"), HISTORY_SQL,
    "l_extendedprice avg_log_price median_log_price price_std prior_lots price_trend")


def positions(t):
    lots = t.lots.withColumn("lot_number", F.when(F.col("l_partkey") % 3 != 0, F.col("lot_number").cast("string")).otherwise(
        F.when(F.col("l_partkey") % 2 == 0, "n/a")))
    return W.lot_positions(lots, ["l_partkey", "l_suppkey", "price", "l_quantity"], F.floor(F.col("l_partkey") / 1000)).select(
        "lot_id.*", "lot_position")


add("lot_positions", positions, """
SELECT auction AS l_orderkey, lot_number AS l_linenumber, l_partkey, l_suppkey, price AS l_extendedprice,
  CASE WHEN l_partkey % 3 <> 0 THEN lot_number ELSE row_number() OVER (PARTITION BY auction ORDER BY l_partkey, l_suppkey, price, l_quantity) END AS lot_position
FROM lots""", "l_extendedprice")
LIFE_SQL = """SELECT condition_id, max(CASE WHEN i = CASE WHEN n > 1 THEN n * 3 // 4 ELSE 0 END THEN price END) AS price_at_75pct,
  CASE WHEN max(n) >= 2 THEN max(CASE WHEN i = n - 1 THEN price END) - max(CASE WHEN i = greatest(n - greatest(n // 10, 2), 0) THEN price END) ELSE 0 END AS final_velocity,
  sum(CASE WHEN epoch_us(ts) >= epoch_us(start_date) + (epoch_us(end_date) - epoch_us(start_date)) * 75e-2 THEN price * size ELSE 0 END) / sum(price * size) AS late_volume_ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY ts, trade_id) - 1 AS i, count(*) OVER (PARTITION BY condition_id) AS n FROM trades)
  JOIN (SELECT condition_id, start_date, end_date FROM markets) USING (condition_id) GROUP BY 1"""
add("life_features", lambda t: W.life_features(t.trades, t.markets), LIFE_SQL, "price_at_75pct final_velocity late_volume_ratio")
BREAKS_SQL = f"""WITH {SERIES}, w AS (SELECT *, avg(price) OVER a AS pre_mean, avg(price) OVER b AS post_mean, var_pop(price) OVER a AS v1, var_pop(price) OVER b AS v2,
  row_number() OVER o AS i, count(*) OVER (PARTITION BY token_id) AS n FROM series
  WINDOW o AS (PARTITION BY token_id ORDER BY bucket), a AS (PARTITION BY token_id ORDER BY bucket ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY token_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
s AS (SELECT *, sqrt((v1 + v2) / 2) AS sd, abs(post_mean - pre_mean) AS gap FROM w WHERE i > 8 AND i <= n - 8),
h AS (SELECT token_id, bucket, pre_mean, post_mean, gap AS magnitude, round(gap / sd, 4) AS sigma_score,
  CASE WHEN post_mean > pre_mean THEN 'up' ELSE 'down' END AS direction FROM s WHERE sd >= 1e-10 AND gap >= 2 * sd)
SELECT * FROM h QUALIFY coalesce(lead(sigma_score) OVER (PARTITION BY token_id ORDER BY bucket) <= sigma_score, true)"""
add("structural_breaks", lambda t: W.structural_breaks(aligned(t), ["token_id"], 8, 2.0), BREAKS_SQL, "pre_mean post_mean magnitude sigma_score", digits=9)
add("temporal_split", lambda t: W.temporal_split(t.markets.where("resolved = 1"), "end_date", "condition_id").select("condition_id", "end_date", "split"), """
WITH r AS (SELECT condition_id, end_date, row_number() OVER (ORDER BY end_date, condition_id) AS rn, count(*) OVER () AS n FROM markets WHERE resolved = 1)
SELECT condition_id, end_date, CASE WHEN rn <= floor(n * 70e-2) THEN 'train' WHEN rn <= floor(n * (70e-2 + 15e-2)) THEN 'val' ELSE 'test' END AS split FROM r""")
BUCKETS_SQL = """WITH q AS (SELECT quantile_cont(volume_total, 25e-2) AS q1, quantile_cont(volume_total, 5e-1) AS q2, quantile_cont(volume_total, 75e-2) AS q3,
  quantile_cont(volume_total, 33e-2) AS t1, quantile_cont(volume_total, 67e-2) AS t2, quantile_cont(liquidity, 5e-1) AS mid FROM markets)
SELECT condition_id, CASE WHEN volume_total <= q1 THEN 'Q1' WHEN volume_total <= q2 THEN 'Q2' WHEN volume_total <= q3 THEN 'Q3' ELSE 'Q4' END AS volume_quartile,
  CASE WHEN volume_total < t1 THEN 'low' WHEN volume_total < t2 THEN 'medium' ELSE 'high' END AS volume_bucket,
  CASE WHEN date_diff('second', start_date, end_date) < 7 * 86400 THEN 'short' WHEN date_diff('second', start_date, end_date) < 30 * 86400 THEN 'medium' ELSE 'long' END AS duration_bucket,
  CASE WHEN liquidity > mid THEN 'high' ELSE 'low' END AS liquidity_regime FROM markets, q"""
add("market_buckets", lambda t: W.market_buckets(t.markets), BUCKETS_SQL)


def steps(t):
    r = W.returns(aligned(t), ["token_id"])
    return r.select("token_id", "bucket", "log_return", F.col("diff").alias("volume_delta"))


SHAPES_SQL = f"""WITH {SERIES}, r AS (SELECT *, lag(price) OVER (PARTITION BY token_id ORDER BY bucket) AS p FROM series),
x AS (SELECT token_id, bucket, ln(price / p) AS r, price - p AS v FROM r WHERE p IS NOT NULL),
y AS (SELECT *, round(sum(r) OVER (PARTITION BY token_id ORDER BY bucket), 9) AS cum, row_number() OVER (PARTITION BY token_id ORDER BY bucket) AS i,
  count(*) OVER (PARTITION BY token_id) AS n FROM x),
a AS (SELECT token_id, max(n) AS n, arg_max(cum, i) AS final, min(cum) AS low, max(cum) AS high, arg_min(i, ROW(cum, i)) AS low_at,
  avg(abs(r)) FILTER (i <= n // 2) AS e1, avg(abs(r)) FILTER (i > n // 2) AS e2, avg(abs(v)) FILTER (i <= n // 3) AS v1,
  avg(abs(v)) FILTER (i > n - n // 3) AS v2 FROM y GROUP BY 1)
SELECT token_id, CASE WHEN n < 8 THEN -1 WHEN high > low AND abs(final) / (high - low) < 2e-1 THEN 3
    WHEN low_at - 1 < n * 6e-1 AND final > 0 AND low < -3e-1 * (high - low) THEN 2 WHEN final > 0 THEN 0 ELSE 1 END AS trajectory,
  CASE WHEN n < 8 THEN -1 WHEN e1 + e2 < 1e-8 THEN 2 WHEN e2 / greatest(e1, 1e-8) > 15e-1 THEN 0 WHEN e2 / greatest(e1, 1e-8) < 67e-2 THEN 1 ELSE 2 END AS momentum,
  CASE WHEN n < 6 THEN -1 WHEN v1 + v2 < 1e-8 THEN 2 WHEN v1 / greatest(v2, 1e-8) > 15e-1 THEN 0 WHEN v1 / greatest(v2, 1e-8) < 67e-2 THEN 1 ELSE 2 END AS volume_pattern
FROM a"""
add("shape_labels", lambda t: W.shape_labels(steps(t), ["token_id"]), SHAPES_SQL)


def labels(t):
    targets = t.trades.groupBy("condition_id", F.date_trunc("day", "ts").alias("at")).agg(F.count("*").alias("n")).drop("n")
    yes = t.prices.where("outcome = 'Yes'")
    return W.next_price_label(targets, yes.where("condition_id % 3 <> 0"), t.trades.where("outcome = 'Yes' AND condition_id % 5 <> 0"), 6 * 3600)


add("next_price_label", labels, """
WITH g AS (SELECT DISTINCT condition_id, date_trunc('day', ts) AS "at" FROM trades), y AS (SELECT * FROM trades WHERE outcome = 'Yes')
SELECT condition_id, "at", coalesce(
  (SELECT arg_min(price, ROW(ts, trade_id)) FROM y WHERE y.condition_id = g.condition_id AND y.condition_id % 3 <> 0 AND ts >= "at" AND ts < "at" + INTERVAL 12 HOUR),
  (SELECT arg_min(price, ROW(ts, trade_id)) FROM y WHERE y.condition_id = g.condition_id AND y.condition_id % 5 <> 0 AND ts >= "at" AND ts < "at" + INTERVAL 12 HOUR),
  5e-1) AS next_price FROM g""", "next_price")


def news(t):
    hour = F.date_trunc("hour", "published_at")
    return t.articles.groupBy((F.col("article_id") % 100).alias("condition_id"), hour.alias("hour")).agg(
        F.avg(F.length("title") / 100).alias("weighted_sentiment"), F.count("*").alias("article_count"))


def features(t, normalize=True):
    start = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return W.bar_features(t.markets.join(t.trades.select("condition_id").distinct(), "condition_id", "left_semi"), t.prices, t.books, t.trades, news(t),
                          start, t.as_of, 6 * 3600, 500.0, normalize)


FEATURE_SQL = """WITH m AS (SELECT * FROM markets WHERE condition_id IN (SELECT condition_id FROM trades)),
grid AS (SELECT condition_id, event_slug, end_date, g AS bucket FROM m, generate_series(TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-30 18:00:00', INTERVAL 6 HOUR) x(g)),
inside AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS bucket FROM trades WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-31'),
b0 AS (SELECT condition_id, bucket, max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, trade_id)) AS close, avg(price - 1e-2) AS bid, avg(price + 1e-2) AS ask
  FROM inside WHERE outcome = 'Yes' GROUP BY ALL),
b AS (SELECT condition_id, bucket, close, ln(close / lag(close) OVER w) AS log_return, high - low AS high_low,
  CASE WHEN row_number() OVER w >= 12 THEN close - avg(close) OVER (PARTITION BY condition_id ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS ma_distance,
  CASE WHEN bid > 0 AND ask > 0 THEN ask - bid END AS spread FROM b0 WINDOW w AS (PARTITION BY condition_id ORDER BY bucket)),
d AS (SELECT condition_id, time_bucket(INTERVAL '6 hours', snapshot_time) AS bucket, arg_max(bid_sizes, snapshot_id) AS bs, arg_max(ask_sizes, snapshot_id) AS s FROM books
  WHERE snapshot_time < TIMESTAMP '2024-01-31' GROUP BY ALL),
v0 AS (SELECT condition_id, bucket, sum(size) AS v, count_if(price * size >= 500) AS large FROM inside GROUP BY ALL),
v AS (SELECT condition_id, bucket, large, CASE WHEN row_number() OVER w > 2 THEN v / avg(v) OVER (PARTITION BY condition_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - 1 END AS volume_delta
  FROM v0 WINDOW w AS (PARTITION BY condition_id ORDER BY bucket)),
nh AS (SELECT article_id % 100 AS condition_id, date_trunc('hour', published_at) AS hour, avg(length(title) / 100) AS ws, count(*) AS c FROM articles GROUP BY ALL),
nw AS (SELECT condition_id, time_bucket(INTERVAL '6 hours', hour) AS bucket, avg(ws) AS sentiment, sum(c) AS articles FROM nh GROUP BY ALL),
sb AS (SELECT a.condition_id, min(o.condition_id) AS sibling FROM m a JOIN m o ON a.event_slug = o.event_slug AND a.condition_id <> o.condition_id GROUP BY 1),
j AS (SELECT grid.*, b.* EXCLUDE (condition_id, bucket), d.bs, d.s, v.large, v.volume_delta, nw.sentiment, nw.articles, sc.close AS sib_close FROM grid
  LEFT JOIN b USING (condition_id, bucket) LEFT JOIN d USING (condition_id, bucket) LEFT JOIN v USING (condition_id, bucket) LEFT JOIN nw USING (condition_id, bucket)
  LEFT JOIN sb USING (condition_id) LEFT JOIN b sc ON sc.condition_id = sb.sibling AND sc.bucket = grid.bucket),
raw AS (SELECT condition_id, bucket, coalesce(log_return, 0) AS log_return, coalesce(high_low, 0) AS high_low, coalesce(ma_distance, 0) AS ma_distance, coalesce(spread, 0) AS spread,
  coalesce((list_sum(bs) - list_sum(s)) / (list_sum(bs) + list_sum(s)), 0) AS obi, coalesce(list_sum(bs[1:5]) / bs[1], 0) AS depth_ratio, coalesce(volume_delta, 0) AS volume_delta,
  0e0 AS open_interest_change, coalesce(sentiment, 0) AS sentiment, CAST(coalesce(articles, large, 0) AS DOUBLE) AS news_velocity,
  1 / greatest(date_diff('second', bucket, end_date) / 86400e0, 1) AS inverse_days_left,
  coalesce(ln(sib_close / lag(sib_close) OVER (PARTITION BY condition_id ORDER BY bucket)), 0) AS sibling_return FROM j)
"""


def z_sql(c):
    return f"CASE WHEN stddev_pop({c}) OVER z > 1e-8 THEN ({c} - avg({c}) OVER z) / stddev_pop({c}) OVER z ELSE {c} END AS {c}"


add("bar_features_raw", lambda t: features(t, False), FEATURE_SQL + "SELECT * FROM raw", " ".join(W.FEATURES))
add("bar_features", features, FEATURE_SQL + f"SELECT condition_id, bucket, {', '.join(z_sql(c) for c in W.FEATURES)} FROM raw WINDOW z AS (PARTITION BY condition_id)",
    " ".join(W.FEATURES))
add("trade_count_bins", lambda t: resolved_markets(t.markets, t.trades, 3).groupBy(W.trade_bin("trade_count").alias("trade_bin")).agg(F.count("*").alias("n")), """
SELECT CASE WHEN c < 10 THEN '<10' WHEN c < 50 THEN '10-49' WHEN c < 100 THEN '50-99' WHEN c < 500 THEN '100-499' ELSE '500+' END AS trade_bin, count(*) AS n FROM
  (SELECT condition_id, count(*) AS c FROM trades JOIN (SELECT condition_id FROM markets WHERE resolved = 1) USING (condition_id) GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1""")
