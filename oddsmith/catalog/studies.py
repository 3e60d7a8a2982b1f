"""Feature tables, model checks and trading metrics."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.catalog.serving import TOP5_SQL
from oddsmith.catalog.signals import INSIDER_SQL, insiders
from oddsmith.catalog.tables import with_lot_texts
from oddsmith.catalog.windows import HISTORY_SQL, LIFE_SQL
from oddsmith.functions import scalars as S
from oddsmith.plans import features as X
from oddsmith.plans import studies as D
from oddsmith.plans import windows as W

MARKET_DOUBLES = ("volume_total liquidity duration_days num_outcomes one_day_price_change volume_24h volume_1wk volume_acceleration volume_vs_category_median last_price price_range "
                  "trade_count avg_trade_size max_trade_size buy_sell_ratio buy_volume_ratio trades_per_day trade_size_gini price_at_75pct final_velocity late_volume_ratio "
                  "whale_buy_ratio top_wallet_share avg_insider_score")
GINI = "SELECT condition_id, (2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)) AS {name} FROM (SELECT condition_id, {x} AS x, row_number() OVER (PARTITION BY condition_id ORDER BY {x}) AS i FROM {src}) GROUP BY 1"
MARKET_SQL = f"""WITH ins AS ({INSIDER_SQL}), med AS (SELECT category, quantile_cont(volume_total, 5e-1) AS m FROM markets WHERE resolved = 1 GROUP BY 1),
fl AS (SELECT condition_id, arg_max(price, ROW(ts, trade_id)) AS last_price, max(price) - min(price) AS price_range, ln(1 + count(*)) AS trade_count, avg(price * size) AS avg_trade_size, max(price * size) AS max_trade_size,
  avg(CASE WHEN side = 'buy' THEN 1e0 ELSE 0e0 END) AS buy_sell_ratio, sum(CASE WHEN side = 'buy' THEN price * size ELSE 0 END) / sum(price * size) AS buy_volume_ratio,
  count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 1e-6) AS trades_per_day FROM trades GROUP BY 1),
w AS (SELECT condition_id, wallet, sum(usdc_size) AS usd, sum(CASE WHEN side = 'BUY' THEN usdc_size ELSE 0 END) AS buy FROM activity GROUP BY ALL),
wf AS (SELECT condition_id, count(*) AS unique_wallets, sum(buy) / sum(usd) AS whale_buy_ratio, max(usd) / sum(usd) AS top_wallet_share, avg(score) AS avg_insider_score FROM w LEFT JOIN ins USING (wallet) GROUP BY 1)
SELECT condition_id, ln(1 + volume_total) AS volume_total, ln(1 + liquidity) AS liquidity, date_diff('second', start_date, end_date) / 86400e0 AS duration_days, 2e0 AS num_outcomes, one_day_price_change,
  ln(1 + volume_24h) AS volume_24h, ln(1 + volume_1wk) AS volume_1wk, coalesce(volume_24h / nullif(volume_1wk / 7, 0), 0) AS volume_acceleration, volume_total / nullif(m, 0) AS volume_vs_category_median,
  price_range, trade_count, avg_trade_size, max_trade_size, buy_sell_ratio, buy_volume_ratio, trades_per_day, trade_size_gini, price_at_75pct, final_velocity, late_volume_ratio,
  unique_wallets, whale_buy_ratio, top_wallet_share, avg_insider_score, coalesce(last_price, outcome_prices[1]) AS last_price
FROM (SELECT * FROM markets WHERE resolved = 1) LEFT JOIN med USING (category) LEFT JOIN fl USING (condition_id) LEFT JOIN ({GINI.format(name='trade_size_gini', x='size', src='trades')}) USING (condition_id)
  LEFT JOIN ({LIFE_SQL}) USING (condition_id) LEFT JOIN wf USING (condition_id)"""


def market_table(t):
    return X.market_features(t.markets, t.trades, t.activity, insiders(t))


add("market_features", market_table, MARKET_SQL, MARKET_DOUBLES)
LIFE_COLS = ("num_outcomes start_price cutoff_price min_price max_price price_std total_volume avg_daily_volume max_daily_volume volume_slope volume_gini avg_spread spread_std avg_obi avg_depth top5_share "
             "holder_gini max_holder_share price_range price_velocity duration_days peak_position")
LIFECYCLE_SQL = f"""WITH m AS (SELECT condition_id, category, start_date, end_date, make_timestamp(CAST(epoch_us(start_date) + (epoch_us(end_date) - epoch_us(start_date)) * 8e-1 AS BIGINT)) AS cut FROM markets),
sn AS (SELECT t.*, start_date, cut FROM trades t JOIN m USING (condition_id) WHERE ts <= cut),
pc AS (SELECT condition_id, arg_min(price, ROW(ts, trade_id)) AS start_price, arg_max(price, ROW(ts, trade_id)) AS cutoff_price, min(price) AS min_price, max(price) AS max_price, stddev_pop(price) AS price_std, count(*) AS trades FROM sn GROUP BY 1),
dy AS (SELECT condition_id, date_diff('day', start_date, ts) AS d, sum(price * size) AS v FROM sn GROUP BY ALL),
vo AS (SELECT condition_id, sum(v) AS total_volume, avg(v) AS avg_daily_volume, max(v) AS max_daily_volume, count(*) AS active_days, coalesce((count(*) * sum(d * round(v * 1e4)) - sum(d) * sum(round(v * 1e4))) / nullif(count(*) * sum(CAST(d AS DOUBLE) * d) - sum(CAST(d AS DOUBLE)) * sum(CAST(d AS DOUBLE)), 0) / 1e4, 0) AS volume_slope, arg_max(d, ROW(v, -d)) AS peak_day FROM dy GROUP BY 1),
bk AS (SELECT condition_id, avg(ask_prices[1] - bid_prices[1]) AS avg_spread, stddev_pop(ask_prices[1] - bid_prices[1]) AS spread_std, avg((list_sum(bid_sizes) - list_sum(ask_sizes)) / (list_sum(bid_sizes) + list_sum(ask_sizes))) AS avg_obi,
  avg(list_sum(bid_sizes) + list_sum(ask_sizes)) AS avg_depth FROM books JOIN m USING (condition_id) WHERE snapshot_time <= cut GROUP BY 1),
hd AS (SELECT condition_id, total_holders, CASE WHEN total_holders >= 5 THEN top5_amount / total_amount ELSE 1 END AS top5_share, top_holder_amount / total_amount AS max_holder_share FROM ({TOP5_SQL})),
cd AS (SELECT category, row_number() OVER (ORDER BY category) AS category_code FROM (SELECT DISTINCT category FROM markets))
SELECT condition_id, 2e0 AS num_outcomes, start_price, cutoff_price, min_price, max_price, price_std, trades, total_volume, avg_daily_volume, max_daily_volume, active_days, volume_slope, peak_day, volume_gini,
  coalesce(avg_spread, 0) AS avg_spread, coalesce(spread_std, 0) AS spread_std, coalesce(avg_obi, 0) AS avg_obi, coalesce(avg_depth, 0) AS avg_depth, coalesce(total_holders, 0) AS total_holders, coalesce(top5_share, 0) AS top5_share,
  coalesce(holder_gini, 0) AS holder_gini, coalesce(max_holder_share, 0) AS max_holder_share, category_code, max_price - min_price AS price_range,
  (cutoff_price - start_price) / greatest((epoch_us(cut) - epoch_us(start_date)) / 86400e6, 1e-2) AS price_velocity, (epoch_us(end_date) - epoch_us(start_date)) / 86400e6 AS duration_days,
  peak_day / greatest((epoch_us(cut) - epoch_us(start_date)) / 86400e6, 1e-2) AS peak_position
FROM m JOIN pc USING (condition_id) LEFT JOIN vo USING (condition_id) LEFT JOIN ({GINI.format(name='volume_gini', x='v', src='dy')}) USING (condition_id) LEFT JOIN bk USING (condition_id) LEFT JOIN hd USING (condition_id)
  LEFT JOIN ({GINI.format(name='holder_gini', x='amount', src='holders')}) USING (condition_id) LEFT JOIN cd USING (category)"""
add("lifecycle_features", lambda t: X.lifecycle_features(t.markets, t.trades, t.books, t.holders), LIFECYCLE_SQL, LIFE_COLS)


CATEGORIES = ["painting", "sculpture", "print", "ceramic", "wine", "jewelry", "book", "asian_art", ""]
CREATORS = ["artist", "maker", "unknown"]


def lots_with_history(t):
    """Lots with artist history; the catalogue fields that the tables lack are derived from their keys."""
    k, q = F.col("l_partkey"), F.col("l_quantity")
    # the parsed texts travel with the lots: no join brings them back
    rows = W.artist_history(with_lot_texts(t.lots).withColumns({"s": S.parse_dimensions("dims"), "y": S.parse_creation_year("made")}))
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    words = F.split("p_name", " ")
    return rows.withColumns({
        "vital_status": pick(["alive", "dead", "unknown"], k), "birth_year": F.when(k % 4 != 0, 1850 + k % 80), "death_year": F.when(k % 3 == 1, 1930 + k % 60), "nationality": F.when(k % 2 == 0, F.col("artist")),
        "height_cm": F.col("s.h"), "width_cm": F.col("s.w"), "depth_cm": F.col("s.d"), "creation_year": F.col("y.year"), "creation_approx": F.col("y.approx"), "category": pick(CATEGORIES, k),
        "estimate_low": F.when(k % 7 != 0, F.col("p_retailprice") * 10), "estimate_high": F.col("p_retailprice") * 20 + q / 7.3, "estimate_low_usd": F.col("p_retailprice") * 8, "estimate_high_usd": F.col("p_retailprice") * 15 + q,
        "sale_size": 7 + k % 5, "lot_position": F.col("lot_number"), "hammer_price": F.col("price"), "final_price": F.col("price") * (1 + F.col("l_tax")), "starting_bid": F.when(k % 6 != 0, F.col("price") * (1 - F.col("l_discount"))),
        "num_bids": k % 9, "bidding_method": F.when(k % 2 == 0, "Online ").otherwise("room"), "reserve_met": F.when(k % 5 != 0, F.when(k % 5 > 2, 1).otherwise(0)), "creator_type": F.when(k % 4 != 3, pick(CREATORS, k)),
        "artist_name_confidence": F.col("l_discount"), "dimensions_confidence": F.col("l_tax"), "medium_confidence": F.when(k % 3 == 0, 0.5), "creation_confidence": F.lit(None).cast("double"),
        "provenance": words, "literature": F.when(k % 2 == 1, words), "exhibitions": F.array().cast("array<string>"), "title": F.col("p_name"), "description": F.col("p_name"), "signed": F.when(k % 3 == 0, "yes"),
        "condition": F.lit(" "), "style": F.col("p_type"), "origin": F.when(k % 2 == 0, F.col("artist")), "accepts_crypto": F.when(F.col("l_returnflag") == "A", 1).otherwise(0), "guaranteed": F.when(k % 11 == 0, 1)})


BASE_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LOT_EXPR = {
    "log_price": "ln(l_extendedprice)", "is_living": "CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END", "artist_birth_year": "born", "artist_career_length": "CASE WHEN coalesce(died, 2025) - born > 0 THEN coalesce(died, 2025) - born END",
    "is_rare_artist": "is_rare_artist", "artist_market_depth": "coalesce(ln(1 + prior_lots), 0)", "nationality_known": "(k % 2 = 0)::INT", "height_cm": "hc", "width_cm": "wc", "log_surface_area": "ln(hc * wc)", "aspect_ratio": "wc / hc",
    "has_depth": "(p_size % 4 = 1)::INT", "creation_year": "made", "creation_is_approximate": "(p_size % 5 IN (0, 1, 2))::INT", "is_painting": "(k % 9 = 0)::INT", "is_sculpture": "(k % 9 = 1)::INT", "is_work_on_paper": "(k % 9 = 2)::INT",
    "is_decorative": "(k % 9 = 3)::INT", "medium_known": "(k % 9 <> 8)::INT", "log_estimate_low": "ln(1 + el)", "log_estimate_high": "ln(1 + eh)", "log_estimate_mid": "ln(1 + (el + eh) / 2)", "estimate_spread": "(eh - el) / el",
    "sale_month": "month(sale_date)", "sale_year_numeric": "year(sale_date)", "sale_day_of_week": "isodow(sale_date) - 1", "sale_size": "7 + k % 5", "lot_position_pct": "l_linenumber::DOUBLE / (7 + k % 5)", "artist_avg_log_price": "avg_log_price", "artist_median_log_price": "median_log_price",
    "artist_price_std": "price_std", "artist_prior_lots": "prior_lots", "artist_price_trend": "price_trend", "log_depth_cm": "CASE WHEN p_size % 4 = 1 THEN ln(8e0) ELSE 0 END", "age_at_creation": "CASE WHEN made - born >= 0 THEN made - born END",
    "years_since_creation": "2025 - made", "artist_name_confidence": "l_discount", "dimensions_confidence": "l_tax", "medium_confidence": "CASE WHEN k % 3 = 0 THEN 5e-1 ELSE 0 END", "creation_confidence": "0",
    "num_bids": "nullif(k % 9, 0)", "log_starting_bid": "ln(1 + sb)", "is_online_sale": "(k % 2 = 0)::INT", "reserve_met": "CASE WHEN k % 5 <> 0 THEN (k % 5 > 2)::INT END", "hammer_start_ratio": "l_extendedprice / sb",
    "is_attributed_artist": "CASE WHEN k % 4 <> 3 THEN (k % 3 = 0)::INT END", "is_maker_not_artist": "CASE WHEN k % 4 <> 3 THEN (k % 3 = 1)::INT END", "provenance_count": "nw", "literature_count": "CASE WHEN k % 2 = 1 THEN nw ELSE 0 END",
    "exhibition_count": "0", "title_length": "length(p_name)", "has_description": "(length(trim(p_name)) > 10)::INT", "has_signed_inscribed": "(k % 3 = 0)::INT", "has_condition_report": "0", "has_style_period": "1", "has_origin": "(k % 2 = 0)::INT",
    "is_wine": "(k % 9 = 4)::INT", "is_jewelry": "(k % 9 = 5)::INT", "is_book": "(k % 9 = 6)::INT", "is_asian_art": "(k % 9 = 7)::INT", "has_crypto": "(l_returnflag = 'A')::INT", "is_guaranteed": "(k % 11 = 0)::INT",
    "final_hammer_ratio": "1 + l_tax", "estimate_mid_usd": "ln(1 + (ul + uh) / 2)", "log_estimate_range_usd": "ln(1 + uh - ul)", "estimate_relative_level": "ln(1 + (ul + uh) / 2) - avg_log_price"}
LOT_SQL = f"""WITH h AS ({HISTORY_SQL}), x AS (SELECT h.*, h.l_partkey AS k, sale_date, p_size, p_name, l_discount, l_tax, l_returnflag, len(string_split(p_name, ' ')) AS nw,
  CASE WHEN h.l_partkey % 4 <> 0 THEN 1850 + h.l_partkey % 80 END AS born, CASE WHEN h.l_partkey % 3 = 1 THEN 1930 + h.l_partkey % 60 END AS died,
  CASE p_size % 4 WHEN 0 THEN l_quantity WHEN 1 THEN p_size WHEN 2 THEN (l_quantity + 5e-1) * 254e-2 END AS hc, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN l_quantity WHEN 2 THEN p_size * 254e-2 END AS wc,
  CASE p_size % 5 WHEN 0 THEN 1900 + l_quantity WHEN 1 THEN 1850 WHEN 2 THEN floor((1900 + l_quantity + 1910 + p_size) / 2) WHEN 3 THEN 1900 + l_quantity END AS made,
  CASE WHEN h.l_partkey % 7 <> 0 THEN p_retailprice * 10 END AS el, p_retailprice * 20 + l_quantity / 73e-1 AS eh, p_retailprice * 8 AS ul, p_retailprice * 15 + l_quantity AS uh,
  CASE WHEN h.l_partkey % 6 <> 0 THEN h.l_extendedprice * (1 - l_discount) END AS sb
  FROM h JOIN lots ON auction = h.l_orderkey AND lot_number = h.l_linenumber AND lots.l_partkey = h.l_partkey AND lots.l_suppkey = h.l_suppkey AND price = h.l_extendedprice)
SELECT {BASE_COLS}, {', '.join(f'{e} AS {n}' for n, e in LOT_EXPR.items())} FROM x"""
add("lot_features", lambda t: X.lot_features(lots_with_history(t)).select("lot_id.*", "*").drop("lot_id"), LOT_SQL, "l_extendedprice " + " ".join(LOT_EXPR))


#: coordinates of an embedding
DIMENSIONS = 64


def vectors(t):
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(DIMENSIONS)]
    return t.embeddings.select("vec_id", (F.col("label") % 2).cast("double").alias("y"), "label", *cols)


COLS = [f"x{i}" for i in range(DIMENSIONS)]
VEC_SQL = f"""SELECT vec_id, CAST(label % 2 AS DOUBLE) AS y, label, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}' for i in range(DIMENSIONS))} FROM embeddings"""
CELL_SQL = f"SELECT vec_id, CAST(label % 2 AS DOUBLE) AS y, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({DIMENSIONS}) r(i)"


def holed(t):
    rows = vectors(t).withColumn("x0", F.when(F.col("vec_id") % 9 != 0, F.col("x0"))).withColumn("x5", F.lit(1.0))
    return rows.withColumn("split", F.when(F.col("vec_id") % 10 < 7, "train").otherwise("test")).drop("label", "y")


def z_sql(c):
    return f"({c} - avg({c}) FILTER (split = 'train') OVER ()) / stddev_pop({c}) FILTER (split = 'train') OVER () AS {c}"


SCALED = [c for c in COLS if c != "x5"]


add("impute_scale", lambda t: X.impute_scale(holed(t), COLS), f"""
WITH v AS ({VEC_SQL}), s AS (SELECT * REPLACE (CASE WHEN vec_id % 9 <> 0 THEN x0 END AS x0), CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM v),
f AS (SELECT * REPLACE (coalesce(x0, (SELECT median(x0) FROM s WHERE split = 'train')) AS x0) FROM s) SELECT vec_id, split, {', '.join(z_sql(c) for c in SCALED)} FROM f""", " ".join(SCALED))
add("correlation_matrix", lambda t: D.correlation_matrix(vectors(t), COLS), f"""
WITH v AS ({CELL_SQL}) SELECT 'x' || a.i AS a, 'x' || b.i AS b, corr(a.x, b.x) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""", "r")
add("feature_diagnostics", lambda t: D.feature_diagnostics(vectors(t), COLS))
add("mutual_information", lambda t: D.mutual_information(vectors(t), COLS, "y"), f"""
WITH v AS ({CELL_SQL}), l AS (SELECT i, min(x) AS lo, max(x) AS hi FROM v GROUP BY i),
c AS (SELECT i, y, least(floor((x - lo) / (hi - lo) * 20), 19) AS b, count(*) AS c FROM v JOIN l USING (i) GROUP BY ALL),
p AS (SELECT i, c::DOUBLE AS c, sum(c) OVER (PARTITION BY i)::DOUBLE AS n, sum(c) OVER (PARTITION BY i, b)::DOUBLE AS cb, sum(c) OVER (PARTITION BY i, y)::DOUBLE AS cy FROM c)
SELECT 'x' || i AS feature, sum(c / n * log2(c * n / (cb * cy))) AS bits FROM p GROUP BY i""", "bits")
add("logistic_wald", lambda t: D.logistic_wald(vectors(t), COLS, "y"))
add("walk_forward_pca", lambda t: D.walk_forward(vectors(t), COLS, "y", ["vec_id"], F.floor(F.col("vec_id") / 10000), components=3))
add("temporal_stability", lambda t: D.temporal_stability(vectors(t), COLS, "y", "vec_id"))
add("classification_metrics", lambda t: D.classification_metrics(t.forecasts), """
WITH c AS (SELECT count_if(p >= 5e-1 AND y = 1) AS tp, count_if(p >= 5e-1 AND y = 0) AS fp, count_if(p < 5e-1 AND y = 1) AS fn, count_if(p < 5e-1 AND y = 0) AS tn FROM forecasts)
SELECT *, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 AS balanced_accuracy, 2e0 * tp / (2 * tp + fp + fn) AS f1,
  (SELECT sum(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 5e-1 ELSE 0 END) / count(*) FROM forecasts a JOIN forecasts b ON a.y = 1 AND b.y = 0) AS auc FROM c""", "accuracy balanced_accuracy f1 auc")
add("regression_metrics", lambda t: D.regression_metrics(t.orders.withColumn("hat", F.col("o_totalprice") * (0.9 + (F.col("o_orderkey") % 21) / 100)), "o_totalprice", "hat"), """
WITH o AS (SELECT o_totalprice AS y, o_totalprice * (9e-1 + (o_orderkey % 21) / 100e0) AS h FROM orders)
SELECT 1 - sum((y - h) ** 2) / sum((y - (SELECT avg(y) FROM o)) ** 2) AS r2, sqrt(avg((y - h) ** 2)) AS rmse, avg(abs(y - h)) AS mae, quantile_cont(abs((y - h) / y), 5e-1) AS mdape FROM o""", "r2 rmse mae mdape")
add("flat_bet_pnl", lambda t: D.flat_bet_pnl(t.forecasts, ["doc_id"], F.floor(F.col("doc_id") / 10000)).select("doc_id", "pnl", "cumulative", "lowest"), """
WITH b AS (SELECT doc_id, CASE WHEN (p > 7e-1 AND y = 1) OR (p < 3e-1 AND y = 0) THEN 100 * (1 / CASE WHEN p > 7e-1 THEN p ELSE 1 - p END - 1) ELSE -100 END AS pnl FROM forecasts WHERE p > 7e-1 OR p < 3e-1),
c AS (SELECT *, sum(pnl) OVER (ORDER BY doc_id) AS cumulative FROM b) SELECT *, min(cumulative) OVER (ORDER BY doc_id) AS lowest FROM c""", "pnl cumulative lowest")


def dated(t):
    """A signal per market, open or not, so that resolved markets have one too."""
    k = F.col("condition_id")
    return t.markets.select("condition_id", ((k * 17 % 201) - 100).cast("double").alias("score"), t.as_of.alias("computed_at"))


add("signal_pnl", lambda t: D.signal_pnl(dated(t), t.trades, t.markets), """
SELECT condition_id, score, vwap, trades, winning_outcome, paid, won, CASE WHEN won = 1 THEN 100 * (1 / paid - 1) ELSE -100 END AS pnl FROM (
  SELECT condition_id, score, vwap, trades, winning_outcome, least(99e-2, CASE WHEN score > 0 THEN vwap ELSE 1 - vwap END + 1e-2) AS paid,
    CASE WHEN (score > 0 AND winning_outcome = 'Yes') OR (score <= 0 AND winning_outcome = 'No') THEN 1 ELSE 0 END AS won
  FROM (SELECT condition_id, CAST(condition_id * 17 % 201 - 100 AS DOUBLE) AS score, winning_outcome FROM markets WHERE resolved = 1)
  JOIN (SELECT condition_id, avg(price) AS vwap, count(*) AS trades FROM trades WHERE outcome = 'Yes' GROUP BY 1 HAVING count(*) >= 3) USING (condition_id) WHERE abs(score) >= 15)""", "score vwap paid pnl")


def ledger(t):
    return t.trades.select((F.col("condition_id") % 10).alias("run_id"), "ts", F.col("trade_id").alias("trade_no"), ((F.col("price") - 0.4) * F.col("size") / 10).alias("pnl"))


add("equity_metrics", lambda t: D.equity_metrics(ledger(t), 10000.0), """
WITH l AS (SELECT condition_id % 10 AS run_id, ts, trade_id, (price - 4e-1) * size / 10 AS pnl FROM trades), e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY run_id ORDER BY ts, trade_id) AS equity FROM l),
k AS (SELECT *, max(greatest(equity, 10000)) OVER (PARTITION BY run_id ORDER BY ts, trade_id) AS peak FROM e),
a AS (SELECT run_id, count(*) AS trades, sum(pnl) / 10000 AS total_return, avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, sum(greatest(pnl, 0)) / sum(greatest(-pnl, 0)) AS profit_factor,
  max((peak - equity) / peak) AS max_drawdown, avg(pnl / 10000) / stddev_pop(pnl / 10000) * sqrt(252) AS sharpe FROM k GROUP BY 1)
SELECT *, total_return / max_drawdown AS calmar FROM a""", "total_return win_rate profit_factor max_drawdown sharpe calmar")
add("direction_accuracy", lambda t: D.direction_accuracy(t.forecasts.select(F.col("p").alias("predicted"), ((F.col("doc_id") * 53 % 97 + 1) / 99).alias("price"), "y", ((F.col("doc_id") % 13) / 50).alias("kelly"))), """
WITH f AS (SELECT p, (doc_id * 53 % 97 + 1) / 99e0 AS price, y, (doc_id % 13) / 50e0 AS kelly FROM forecasts),
g AS (SELECT *, (p > price AND y = 1) OR (p <= price AND y = 0) AS ok, CASE WHEN p > price THEN price ELSE 1 - price END AS paid FROM f),
h AS (SELECT *, kelly * CASE WHEN ok THEN 1 / paid - 1 ELSE -1 END AS pnl FROM g)
SELECT count(*) AS n, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS accuracy, sum(pnl) AS pnl, sum(pnl) / sum(kelly) AS pnl_per_kelly FROM h""", "accuracy pnl pnl_per_kelly")
add("platt_calibration", lambda t: D.platt_calibration(t.forecasts.where("p > 0 AND p < 1").withColumn("logit", F.ln(F.col("p") / (1 - F.col("p")))).withColumn("label", F.col("y").cast("double")), "logit", "label")[0].select("doc_id", "calibrated"))


def spaced(t):
    return t.embeddings.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"), F.col("label").cast("int").alias("label"))


add("label_separation", lambda t: t.spark.createDataFrame([(D.label_silhouette(spaced(t), "v", "label"),)], "silhouette double"))
add("neighbour_label_accuracy", lambda t: D.neighbour_label_accuracy(t.embeddings, "vec_id", "embedding", "label"), """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT a.vec_id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.vec_id) AS place FROM u a JOIN u b ON a.vec_id <> b.vec_id),
s AS (SELECT vec_id, avg(CASE WHEN same THEN 1e0 ELSE 0e0 END) AS same FROM p WHERE place <= 5 GROUP BY 1)
SELECT count(*) AS n, avg(same) AS same_label, avg(CASE WHEN same > 5e-1 THEN 1e0 ELSE 0e0 END) AS accuracy FROM s""", "same_label accuracy")
