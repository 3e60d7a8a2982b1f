"""Signals, wallet scores and manipulation checks."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.catalog.serving import FOCUS_SQL, OBI_SQL, RATIO_SQL, ROI_SQL, TOP5_SQL, WIN_SQL
from oddsmith.operators.versions import closed_since
from oddsmith.plans import aggregates as A
from oddsmith.plans import manipulation as M
from oddsmith.plans import serving as V
from oddsmith.plans import signals as G
from oddsmith.plans import wallets as P
from oddsmith.session import stored

DAY = 86400
MONTH = 31 * DAY
OPEN = "active = 1 AND closed = 0"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# ---- wallets ----------------------------------------------------------------


def insiders(t):
    return P.insider_scores(t.profiles, t.positions, t.markets, t.activity, t.as_of)


INSIDER_SQL = f"""SELECT wallet, freshness, win_rate_score, niche, size_score, 0e0 AS timing,
  2e-1 * freshness + 3e-1 * win_rate_score + 15e-2 * niche + 25e-2 * size_score AS score FROM (
  SELECT wallet, CASE WHEN age <= 30 THEN 100 * (1 - CAST(age AS DOUBLE) / 30) ELSE 0 END AS freshness,
    CASE WHEN win_rate >= 75e-2 THEN least(100, (win_rate - 5e-1) * 200) ELSE 0 END AS win_rate_score,
    CASE WHEN d > 0 AND d <= 3 THEN 80 WHEN coalesce(d, 0) <= 5 THEN 40 ELSE 0 END AS niche,
    CASE WHEN size_ratio > 1e-1 THEN least(100, size_ratio * 500) ELSE 0 END AS size_score
  FROM (SELECT wallet, date_diff('day', profile_created_at, {NOW}) AS age FROM profiles) FULL JOIN ({WIN_SQL}) USING (wallet)
  LEFT JOIN ({RATIO_SQL}) USING (wallet) LEFT JOIN (SELECT wallet, count(DISTINCT condition_id) AS d FROM activity WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1) USING (wallet))"""
INSIDER_DOUBLES = "freshness win_rate_score niche size_score timing score"
add("insider_scores", insiders, INSIDER_SQL, INSIDER_DOUBLES)
add("wallet_market_features", lambda t: A.wallet_market_features(t.activity, insiders(t)), f"""
WITH ins AS ({INSIDER_SQL}), w AS (SELECT condition_id, wallet, sum(usdc_size) AS usd, sum(CASE WHEN side = 'BUY' THEN usdc_size ELSE 0 END) AS buy FROM activity GROUP BY ALL)
SELECT condition_id, count(*) AS unique_wallets, sum(buy) / sum(usd) AS whale_buy_ratio, max(usd) / sum(usd) AS top_wallet_share, avg(score) AS avg_insider_score
FROM w LEFT JOIN ins USING (wallet) GROUP BY 1""", "whale_buy_ratio top_wallet_share avg_insider_score")


def resolutions(t):
    return t.markets.where("resolved = 1").select("condition_id", "winning_outcome", F.col("end_date").alias("resolved_at"))


def events(t):
    return P.pre_news_events(t.prices, t.markets, resolutions(t), t.as_of, MONTH, DAY)


EVENTS_SQL = f"""SELECT m.*, category, event_slug, question FROM (
  SELECT condition_id, 'price_move' AS event_type, abs(pct) AS magnitude, CASE WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction, price_before, price_after,
    volume_during, window_start, window_end, sha256(condition_id || ':price_move:' || epoch_us(window_start))[1:32] AS event_id FROM (
    SELECT condition_id, CAST(ts AS DATE) AS d, arg_min(price, ROW(ts, trade_id)) AS price_before, arg_max(price, ROW(ts, trade_id)) AS price_after,
      min(ts) AS window_start, max(ts) AS window_end, sum(volume * price) AS volume_during, (price_after - price_before) / greatest(price_before, 1e-2) AS pct
    FROM prices GROUP BY ALL) WHERE abs(pct) > 2e-1
  UNION ALL SELECT condition_id, 'resolution', 1e0, CASE WHEN winning_outcome = 'Yes' THEN 'up' ELSE 'down' END, 0e0, CASE WHEN winning_outcome = 'Yes' THEN 1e0 ELSE 0e0 END,
    0e0, end_date, end_date, sha256(condition_id || ':resolution:' || epoch_us(end_date))[1:32] FROM markets WHERE resolved = 1 AND end_date >= {NOW} - INTERVAL 31 DAY) m
  LEFT JOIN (SELECT condition_id, category, event_slug, question FROM markets) USING (condition_id)"""
add("pre_news_events", events, EVENTS_SQL, "magnitude price_before price_after volume_during")


def scored(t):
    return P.pre_news_trades(events(t), t.activity)


SCORED_SQL = f"""SELECT event_id, transaction_hash, wallet, hours_before, correct, least(100, greatest(0, 100 * pow(2e0, -hours_before / 4) * CASE WHEN correct = 1 THEN 15e-1 ELSE 3e-1 END
    + CASE WHEN correct = 1 THEN least(30, usdc_size / 500) ELSE 0 END + magnitude * 50)) AS pre_news_score FROM (
  SELECT event_id, transaction_hash, wallet, usdc_size, magnitude, (epoch_us(window_start) - epoch_us(ts)) / 3600e6 AS hours_before,
    CASE WHEN (direction = 'up' AND side = 'BUY') OR (direction = 'down' AND side = 'SELL') THEN 1 ELSE 0 END AS correct
  FROM ({EVENTS_SQL}) e JOIN activity a ON a.condition_id = e.condition_id AND a.ts < e.window_start AND a.ts >= e.window_start - INTERVAL 24 HOUR
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, transaction_hash DESC) <= 200)"""
add("pre_news_trade_score", lambda t: scored(t).select("event_id", "transaction_hash", "wallet", "correct", "pre_news_score"), f"SELECT * EXCLUDE (hours_before) FROM ({SCORED_SQL})",
    "pre_news_score", digits=9)


def stats(t):
    return A.wallet_trade_profile(t.activity, t.as_of)


def micro(t):
    return G.microstructure_snapshot(t.markets, t.books, t.trades, t.as_of, MONTH, MONTH, MONTH, 3600)


def toxic(t):
    return P.wallet_toxic_flow(t.activity, micro(t), t.as_of, 30)


def anomalies(t):
    return P.wallet_anomalies(stats(t), A.wallet_win_rate(t.positions, t.markets), A.wallet_roi(t.positions), toxic(t))


FLOW_SQL = """SELECT condition_id, sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS sell_volume,
  count(*) AS trade_count, count_if(price * size >= 1000) AS large_count, sum(price * size) / greatest(sum(size), 1e-9) AS vwap FROM trades GROUP BY 1"""
KYLE_SQL = """SELECT condition_id, avg(step / greatest(usd, 1e-9)) AS kyle_lambda FROM (SELECT condition_id, price * size AS usd,
  abs(price - lag(price) OVER (PARTITION BY condition_id ORDER BY ts, trade_id)) AS step FROM trades) WHERE usd > 0 AND step > 0 GROUP BY 1"""
IMPACT_SQL = """SELECT a.condition_id, avg(abs(b.price - a.price)) AS impact FROM trades a JOIN trades b ON a.condition_id = b.condition_id AND b.ts > a.ts
  AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.usdc_size >= 500 GROUP BY 1"""
QUOTES_SQL = """SELECT condition_id, ask_prices[1] - bid_prices[1] AS spread, (ask_prices[1] + bid_prices[1]) / 2 AS mid, bid_sizes[1] AS bid_depth_1, ask_sizes[1] AS ask_depth_1,
  list_sum(bid_sizes[1:5]) AS bid_depth_5, list_sum(ask_sizes[1:5]) AS ask_depth_5, list_sum(bid_sizes) / greatest(list_sum(bid_sizes) + list_sum(ask_sizes), 1e-9) AS obi,
  (list_sum(bid_sizes[1:5]) + list_sum(ask_sizes[1:5])) / greatest(bid_sizes[1] + ask_sizes[1], 1e-9) AS depth_ratio
  FROM books QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY snapshot_time DESC, snapshot_id DESC) = 1"""
MICRO_COLS = "spread mid bid_depth_1 ask_depth_1 bid_depth_5 ask_depth_5 obi depth_ratio buy_volume sell_volume vwap kyle_lambda impact"
MICRO_SQL = f"""SELECT *, CASE WHEN mid > 0 THEN abs(vwap - mid) * 2 ELSE 0 END AS effective_spread, greatest(spread - impact, 0) AS realized_spread,
  CASE WHEN buy_volume + sell_volume > 0 THEN abs(buy_volume - sell_volume) / greatest(buy_volume + sell_volume, 1e-9) ELSE 0 END AS toxic_flow_ratio, {NOW} AS snapshot_time
  FROM (SELECT condition_id, coalesce(trade_count, 0) AS trade_count, coalesce(large_count, 0) AS large_count, {', '.join(f'coalesce({c}, 0) AS {c}' for c in MICRO_COLS.split())}
    FROM (SELECT condition_id FROM markets WHERE {OPEN}) LEFT JOIN ({QUOTES_SQL}) USING (condition_id) LEFT JOIN ({FLOW_SQL}) USING (condition_id)
    LEFT JOIN ({KYLE_SQL}) USING (condition_id) LEFT JOIN ({IMPACT_SQL}) USING (condition_id))"""
TOXIC_SQL = f"""SELECT wallet, avg(toxic_flow_ratio) AS toxic_flow FROM activity JOIN (SELECT condition_id, toxic_flow_ratio FROM ({MICRO_SQL})) USING (condition_id)
  WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 3"""
STATS_SQL = f"""SELECT wallet, count(*) AS trade_count, avg(usdc_size) AS avg_size, count(DISTINCT condition_id) AS unique_markets FROM activity
  WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 5"""


def pop_sql(c):
    return f"avg({c}), CASE WHEN count({c}) < 2 THEN 1 ELSE greatest(stddev_pop({c}), 1e-3) END"


ANOMALY_SQL = f"""WITH st AS ({STATS_SQL}), wr AS ({WIN_SQL}), ro AS ({ROI_SQL}),
pc(m, s) AS (SELECT {pop_sql('trade_count')} FROM st), ps(m, s) AS (SELECT {pop_sql('avg_size')} FROM st), pd(m, s) AS (SELECT {pop_sql('unique_markets')} FROM st),
pw(m, s) AS (SELECT {pop_sql('win_rate')} FROM wr), pr(m, s) AS (SELECT {pop_sql('roi')} FROM ro),
z AS (SELECT wallet, abs(trade_count - pc.m) / pc.s AS z_count, abs(avg_size - ps.m) / ps.s AS z_size, abs(unique_markets - pd.m) / pd.s AS z_diversity,
  (coalesce(win_rate, 0) - pw.m) / pw.s AS z_win_rate, (coalesce(roi, 0) - pr.m) / pr.s AS z_roi, coalesce(toxic_flow, 0) AS toxic_flow
  FROM st LEFT JOIN wr USING (wallet) LEFT JOIN ro USING (wallet) LEFT JOIN ({TOXIC_SQL}) USING (wallet), pc, ps, pd, pw, pr),
e AS (SELECT *, (z_count > 2)::INT + (z_size > 2)::INT + (z_diversity > 2)::INT + (abs(z_win_rate) > 2)::INT + (abs(z_roi) > 2)::INT AS exceeded FROM z)
SELECT *, least(100, exceeded * 20 + greatest(z_win_rate - 2, 0) * 10 + greatest(z_roi - 2, 0) * 10
  + CASE WHEN toxic_flow > 3e-1 THEN least(15, toxic_flow * 30) ELSE 0 END) AS statistical_score FROM e"""
Z_DOUBLES = "z_count z_size z_diversity z_win_rate z_roi toxic_flow statistical_score"
add("microstructure_snapshot", micro, MICRO_SQL, MICRO_COLS + " effective_spread realized_spread toxic_flow_ratio", digits=8)
add("wallet_toxic_flow", toxic, TOXIC_SQL, "toxic_flow")
add("wallet_anomalies", anomalies, ANOMALY_SQL, Z_DOUBLES)


def profits(t):
    return P.profitability_scores(A.category_focus(A.wallet_category_pnl(t.positions, t.markets), "PROMO"), A.wallet_roi(t.positions))


PROFIT_SQL = f"""SELECT wallet, focus_share, least(100, CASE WHEN coalesce(roi, 0) > 5e-1 THEN least(40, roi * 20) ELSE 0 END + CASE WHEN focus_share > 3e-1 THEN focus_share * 30 ELSE 0 END
  + CASE WHEN focus_positions >= 3 AND CAST(focus_wins AS DOUBLE) / focus_positions > 7e-1 THEN (CAST(focus_wins AS DOUBLE) / focus_positions - 5e-1) * 60 ELSE 0 END) AS profitability_score
  FROM ({FOCUS_SQL}) LEFT JOIN (SELECT wallet, roi FROM ({ROI_SQL})) USING (wallet)"""
add("profitability_scores", profits, PROFIT_SQL, "focus_share profitability_score")
PAIRS_SQL = """SELECT a, b, common, CAST(common AS DOUBLE) / (x.n + y.n - common) AS overlap, CAST(agree AS DOUBLE) / common AS direction,
    CAST(coalesce(matches, 0) AS DOUBLE) / crossed AS timing, size_similarity, x.v + y.v AS total_volume FROM
  (SELECT i.wallet AS a, j.wallet AS b, count(*) AS common, count_if(i.side = j.side) AS agree, CAST(sum(i.n * j.n) AS BIGINT) AS crossed,
     avg(least(i.usd, j.usd) / greatest(i.usd, j.usd)) AS size_similarity FROM w i JOIN w j ON i.condition_id = j.condition_id AND i.wallet < j.wallet GROUP BY ALL HAVING count(*) >= 3)
  LEFT JOIN (SELECT p.wallet AS a, q.wallet AS b, count(*) AS matches FROM activity p JOIN activity q ON p.condition_id = q.condition_id AND p.wallet < q.wallet
     AND q.ts BETWEEN p.ts - INTERVAL {within} SECOND AND p.ts + INTERVAL {within} SECOND GROUP BY ALL) USING (a, b)
  JOIN n x ON x.wallet = a JOIN n y ON y.wallet = b"""
PAIRS_WITH = """WITH w AS (SELECT wallet, condition_id, count(*) AS n, arg_max(side, ROW(ts, transaction_hash)) AS side, arg_max(usdc_size, ROW(ts, transaction_hash)) AS usd,
  sum(usdc_size) AS v FROM activity GROUP BY ALL), n AS (SELECT wallet, count(*) AS n, sum(v) AS v FROM w GROUP BY 1)"""
PAIR_ID = "sha256(a || ':' || b)[1:32]"


def clusters(t):
    return P.wallet_clusters(P.wallet_pairs(t.activity, t.as_of, MONTH, 3600, weights=P.CLUSTER_WEIGHTS, least=0.35), 0.35)


def groups(t):
    return P.coordinated_groups(P.wallet_pairs(t.activity, t.as_of, MONTH, 7200, min_trades=3, weights=P.GROUP_WEIGHTS, least=0.35), 0.35)


CLUSTER_SQL = f"""{PAIRS_WITH}, p AS ({PAIRS_SQL.format(within=3600)})
SELECT a, b, common, overlap, direction, timing, total_volume, 3e-1 * overlap + 4e-1 * direction + 3e-1 * timing AS similarity, {PAIR_ID} AS cluster_id FROM p
WHERE 3e-1 * overlap + 4e-1 * direction + 3e-1 * timing >= 35e-2"""
GROUP_BODY = f"""SELECT *, 25e-2 * overlap + 3e-1 * direction + 3e-1 * timing + 15e-2 * size_similarity AS coordination, {PAIR_ID} AS group_id FROM ({PAIRS_SQL.format(within=7200)})
WHERE 25e-2 * overlap + 3e-1 * direction + 3e-1 * timing + 15e-2 * size_similarity >= 35e-2"""
add("wallet_clusters", clusters, CLUSTER_SQL, "overlap direction timing total_volume similarity")
add("coordinated_groups", groups, f"{PAIRS_WITH} {GROUP_BODY}", "overlap direction timing size_similarity total_volume coordination")


def profiles(t, found=None):
    return P.suspicion_profiles(stats(t), scored(t), anomalies(t), profits(t), P.coordination_scores(groups(t) if found is None else found))


def group_suspicion(t):
    found = stored(groups(t).select("a", "b", "coordination"), "groups")  # read twice, searched once; ids, which do not compress, come from a and b
    return P.flag_groups(P.group_ids(found), profiles(t, found)).select("group_id", "avg_suspicion")


def insider_overview(t):
    found = stored(groups(t).select("a", "b", "coordination"), "groups")
    return V.one_row(
        profiles(t, found).agg(F.count("*").alias("profiles"), F.count_if(F.col("tier") == "high").alias("high"), F.coalesce(F.avg("suspicion"), F.lit(0.0)).alias("avg_suspicion")),
        events(t).agg(F.count("*").alias("events")), found.agg(F.count("*").alias("groups")))


PARTS = ["pre_news", "statistical", "profitability", "coordination", "focus"]
PROFILE_SQL = f"""{PAIRS_WITH}, g AS ({GROUP_BODY}), k AS (SELECT wallet, least(100, max(coordination) * 100) AS coordination FROM
  (SELECT a AS wallet, coordination FROM g UNION ALL SELECT b, coordination FROM g) GROUP BY 1),
pn AS (SELECT wallet, count(*) AS flagged_trades, least(100, avg(pre_news_score) * (1 + avg(correct))) AS pre_news FROM ({SCORED_SQL}) GROUP BY 1),
j AS (SELECT wallet, trade_count, coalesce(flagged_trades, 0) AS flagged_trades, coalesce(pre_news, 0) AS pre_news, coalesce(statistical_score, 0) AS statistical,
  coalesce(profitability_score, 0) AS profitability, coalesce(least(100, focus_share * 100), 0) AS focus, coalesce(coordination, 0) AS coordination
  FROM ({STATS_SQL}) LEFT JOIN pn USING (wallet) LEFT JOIN (SELECT wallet, statistical_score FROM ({ANOMALY_SQL})) USING (wallet) LEFT JOIN ({PROFIT_SQL}) USING (wallet) LEFT JOIN k USING (wallet)),
s AS (SELECT *, 3e-1 * pre_news + 25e-2 * statistical + 2e-1 * profitability + 15e-2 * coordination + 1e-1 * focus AS suspicion FROM j)
SELECT *, CASE WHEN suspicion >= 75 THEN 'critical' WHEN suspicion >= 50 THEN 'high' WHEN suspicion >= 25 THEN 'medium' ELSE 'low' END AS tier FROM s"""
add("suspicion_profiles", profiles, PROFILE_SQL, "pre_news statistical profitability coordination focus suspicion")
add("flagged_trades", lambda t: P.flag_trades(scored(t), profiles(t)).groupBy("event_id").agg(F.count("*").alias("trades"), F.max("suspicion").alias("suspicion")), f"""
SELECT event_id, count(*) AS trades, max(coalesce(suspicion, 0)) AS suspicion FROM ({SCORED_SQL}) LEFT JOIN (SELECT wallet, suspicion FROM ({PROFILE_SQL})) USING (wallet) GROUP BY 1""", "suspicion")
add("group_suspicion", group_suspicion, f"""
WITH pr AS ({PROFILE_SQL}), gg AS ({PAIRS_WITH} {GROUP_BODY})
SELECT group_id, (coalesce(x.suspicion, 0) + coalesce(y.suspicion, 0)) / 2 AS avg_suspicion FROM gg LEFT JOIN pr x ON x.wallet = a LEFT JOIN pr y ON y.wallet = b""", "avg_suspicion")
add("cluster_list", lambda t: V.ranked_rows(clusters(t), F.col("similarity"), 30, tie="cluster_id").select("cluster_id", "similarity"),
    f"SELECT cluster_id, similarity FROM ({CLUSTER_SQL}) ORDER BY similarity DESC, cluster_id LIMIT 30", "similarity")
add("suspect_list", lambda t: V.ranked_rows(profiles(t), F.col("suspicion"), 30, F.col("suspicion") >= 20, "wallet").select("wallet", "suspicion", "tier"),
    f"SELECT wallet, suspicion, tier FROM ({PROFILE_SQL}) WHERE suspicion >= 20 ORDER BY suspicion DESC, wallet LIMIT 30", "suspicion")
add("insider_alerts", lambda t: V.ranked_rows(insiders(t), F.col("score"), 30, F.col("score") >= 15, "wallet").join(
    t.profiles.select("wallet", "pseudonym"), "wallet", "left").select("wallet", "score", "pseudonym"), f"""
SELECT wallet, score, pseudonym FROM ({INSIDER_SQL}) LEFT JOIN (SELECT wallet, pseudonym FROM profiles) USING (wallet) WHERE score >= 15 ORDER BY score DESC, wallet LIMIT 30""", "score")

# ---- market signals ---------------------------------------------------------

SUM_SQL = f"""SELECT condition_id, event_slug, 'sum_to_one' AS arb_type, list_sum(outcome_prices) AS actual_sum, abs(list_sum(outcome_prices) - 1) AS spread
  FROM markets WHERE {OPEN} AND abs(list_sum(outcome_prices) - 1) > 2e-2"""
RELATED_SQL = f"""SELECT condition_id, event_slug, 'related_market' AS arb_type, actual_sum, abs(actual_sum - 1) AS spread, n - 1 AS related FROM
  (SELECT event_slug, min(condition_id) AS condition_id, count(*) AS n, sum(outcome_prices[1]) AS actual_sum FROM small_events GROUP BY 1)
  WHERE n >= 3 AND actual_sum > 0 AND actual_sum < least(15e-1 + 2e-2 * n, 25e-1) AND abs(actual_sum - 1) > 5e-2"""
SMALL = f"small_events AS (SELECT * REPLACE (event_slug || '-' || (condition_id // 300) AS event_slug) FROM markets WHERE {OPEN})"


def small_events(t):
    """Events of a few markets each: with the plain brands every event sums far above the plausible range."""
    return t.markets.withColumn("event_slug", F.concat_ws("-", "event_slug", F.floor(F.col("condition_id") / 300)))


add("sum_to_one_arbitrage", lambda t: G.sum_to_one_arbitrage(t.markets), SUM_SQL, "actual_sum spread")
add("related_market_arbitrage", lambda t: G.related_market_arbitrage(small_events(t)), f"WITH {SMALL} {RELATED_SQL}", "actual_sum spread")
add("related_markets", lambda t: G.related_markets(G.related_market_arbitrage(small_events(t)), small_events(t)).select("event_slug", "condition_id", "related_id"), f"""
WITH {SMALL}, r AS ({RELATED_SQL}) SELECT r.event_slug, r.condition_id, s.condition_id AS related_id FROM r JOIN small_events s ON s.event_slug = r.event_slug AND s.condition_id <> r.condition_id""")


def opportunities(t):
    return G.sum_to_one_arbitrage(t.markets).unionByName(G.related_market_arbitrage(small_events(t)).drop("related"))


OPPS_SQL = f"{SUM_SQL} UNION ALL SELECT * EXCLUDE (related) FROM ({RELATED_SQL})"
add("arbitrage_closed", lambda t: closed_since(
    opportunities(t).select("condition_id", "arb_type"), opportunities(t).where("spread > 0.025").select("condition_id", "arb_type"), ["condition_id", "arb_type"]), f"""
WITH {SMALL} SELECT condition_id, arb_type FROM ({OPPS_SQL}) WHERE NOT spread > 25e-3""")
add("arbitrage_list", lambda t: V.ranked_rows(G.opportunity_ids(opportunities(t)).withColumn("spread", F.round("spread", 9)), F.col("spread"), 30, tie="opportunity_id").select(
    "condition_id", "arb_type", "spread", "opportunity_id"), f"""
WITH {SMALL} SELECT condition_id, arb_type, round(spread, 9) AS spread, sha256(condition_id || ':' || arb_type)[1:32] AS opportunity_id FROM ({OPPS_SQL})
ORDER BY spread DESC, opportunity_id LIMIT 30""", "spread")


def composite(t):
    return G.composite_signals(t.markets, t.books, t.trades, t.activity, t.rankings, t.holders, opportunities(t), insiders(t), t.as_of,
                               7 * DAY, 4 * DAY, 2 * DAY)


WEEK = f"ts >= {NOW} - INTERVAL 7 DAY"
NET = "least(100, greatest(-100, CASE WHEN sum({u}) > 0 THEN (sum(CASE WHEN {b} THEN {u} ELSE -{u} END)) / sum({u}) * 100 ELSE 0 END))"
SCORE_PARTS = ["obi", "volume", "trade_bias", "momentum", "smart_money", "concentration"]
COMPOSITE_SQL = f"""WITH {SMALL}, ins AS ({INSIDER_SQL}),
c_obi AS (SELECT condition_id, max(least(100, greatest(-100, (obi - 5e-1) * 200))) AS obi FROM ({OBI_SQL}) GROUP BY 1),
c_vol AS (SELECT condition_id, sum(size) AS v4h FROM trades WHERE ts >= {NOW} - INTERVAL 4 DAY GROUP BY 1),
c_bias AS (SELECT condition_id, {NET.format(u='price * size', b="side = 'buy'")} AS trade_bias FROM trades WHERE {WEEK} AND price * size >= 1000 GROUP BY 1),
c_smart AS (SELECT condition_id, {NET.format(u='usdc_size', b="side = 'BUY'")} AS smart_money FROM activity WHERE {WEEK} AND wallet IN (SELECT wallet FROM rankings WHERE rank <= 50) GROUP BY 1),
c_conc AS (SELECT condition_id, least(100, greatest(-100, -(top5_amount / total_amount - 5e-1) * 200)) AS concentration FROM ({TOP5_SQL}) WHERE total_amount > 0),
c_arb AS (SELECT DISTINCT condition_id, 1 AS arbitrage FROM ({OPPS_SQL})),
c_ins AS (SELECT condition_id, avg(score) AS insider FROM activity JOIN ins USING (wallet) WHERE {WEEK} AND score > 20 GROUP BY 1),
j AS (SELECT condition_id, least(100, greatest(-100, one_day_price_change * 200)) AS momentum,
  CASE WHEN volume_1wk > 0 AND v4h IS NOT NULL THEN least(100, greatest(-100, (v4h / (volume_1wk * (4e0 / 7)) - 1) * 50)) ELSE 0 END AS volume,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['obi', 'trade_bias', 'smart_money', 'concentration', 'insider', 'arbitrage'])}
  FROM (SELECT * FROM markets WHERE {OPEN}) LEFT JOIN c_obi USING (condition_id) LEFT JOIN c_vol USING (condition_id) LEFT JOIN c_bias USING (condition_id)
  LEFT JOIN c_smart USING (condition_id) LEFT JOIN c_conc USING (condition_id) LEFT JOIN c_arb USING (condition_id) LEFT JOIN c_ins USING (condition_id))
SELECT *, least(100, greatest(-100, 2e-1 * obi + 1e-1 * volume + 15e-2 * trade_bias + 15e-2 * momentum + 25e-2 * smart_money + 1e-1 * concentration + 5e-2 * (insider - 50))) AS score,
  CAST({' + '.join(f'(abs({c}) > 1)::INT' for c in SCORE_PARTS)} AS DOUBLE) / 6 AS confidence FROM j"""
COMPOSITE_DOUBLES = "momentum volume obi trade_bias smart_money concentration insider score confidence"
add("composite_signals", composite, COMPOSITE_SQL, COMPOSITE_DOUBLES)
add("composite_json", lambda t: G.components_json(composite(t)).select(
    "condition_id", F.get_json_object("components", "$.obi").cast("double").alias("obi"), F.get_json_object("components", "$.arbitrage").cast("int").alias("arbitrage")),
    f"SELECT condition_id, round(obi, 2) AS obi, arbitrage FROM ({COMPOSITE_SQL})", "obi")
add("signal_list", lambda t: V.ranked_rows(composite(t).withColumn("score", F.round("score", 6)), F.abs("score"), 50, tie="condition_id").select("condition_id", "score", "confidence"),
    f"SELECT condition_id, round(score, 6) AS score, confidence FROM ({COMPOSITE_SQL}) ORDER BY abs(round(score, 6)) DESC, condition_id LIMIT 50", "score confidence")
add("kyle_lambda_ratio", lambda t: G.kyle_lambda_ratio(t.trades, t.as_of, MONTH), KYLE_SQL, "kyle_lambda", digits=9)
STEPS_SQL = """SELECT *, lead(price) OVER (PARTITION BY condition_id ORDER BY ts, trade_id) - price AS dp FROM trades"""
add("kyle_lambda_regression", lambda t: G.kyle_lambda_regression(t.trades), f"""
SELECT condition_id, CASE WHEN count(*) >= 5 AND var_pop(CASE WHEN dp IS NOT NULL THEN f END) > 1e-10 THEN covar_pop(dp, f) / var_pop(CASE WHEN dp IS NOT NULL THEN f END) ELSE 0 END AS kyle_lambda
FROM (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * price * size AS f FROM ({STEPS_SQL})) GROUP BY 1""", "kyle_lambda", digits=9)
add("toxic_flow", lambda t: G.toxic_flow(t.trades), f"""
SELECT condition_id, CASE WHEN count(*) >= 3 THEN CAST(count_if((side = 'buy' AND dp > 0) OR (side = 'sell' AND dp < 0)) AS DOUBLE) / (count(*) - 1) ELSE 0 END AS toxic_flow
FROM ({STEPS_SQL}) GROUP BY 1""", "toxic_flow")
add("effective_spread", lambda t: G.effective_spread(t.trades, t.books), f"""
SELECT condition_id, avg(2 * abs(price - mid)) AS effective_spread FROM trades JOIN (SELECT condition_id, mid FROM ({QUOTES_SQL})) USING (condition_id) GROUP BY 1""", "effective_spread")
KELLY_SQL = f"""SELECT *, CASE WHEN abs(edge) > hurdle THEN 1 ELSE 0 END AS tradable FROM (
  SELECT *, CASE WHEN liquidity <= 0 THEN 1 ELSE 2e-2 + 1e-1 * sqrt(kelly * 10000 / nullif(liquidity, 0)) END AS hurdle FROM (
  SELECT *, probability - price AS edge, CASE WHEN price <= 1e-2 OR price >= 99e-2 THEN 0 WHEN probability > price
      THEN greatest(coalesce((probability * (1 / price - 1) - (1 - probability)) / (1 / price - 1), 0), 0) * 25e-2
      ELSE greatest(coalesce(((1 - probability) * (1 / (1 - price) - 1) - probability) / (1 / (1 - price) - 1), 0), 0) * 25e-2 END AS kelly FROM (
  SELECT condition_id, score, price, liquidity, CASE WHEN price <= 1e-2 OR price >= 99e-2 THEN price
      ELSE greatest(1e-2, least(99e-2, price + score / 100 * 15e-2 * CASE WHEN score > 0 THEN 1 - price ELSE price END)) END AS probability
  FROM (SELECT condition_id, score FROM ({COMPOSITE_SQL})) JOIN (SELECT condition_id, outcome_prices[1] AS price, liquidity FROM markets) USING (condition_id))))"""
add("kelly_and_edge", lambda t: G.kelly_and_edge(composite(t), t.markets), KELLY_SQL, "score price liquidity probability edge kelly hurdle", digits=8)


def orders(t):
    return t.markets.where("active = 1").select(
        F.col("condition_id").alias("order_id"), "condition_id", F.get("outcome_prices", F.lit(0)).alias("price"), (F.col("volume_24h") * 10).alias("size"),
        (F.col("one_day_price_change") / 2).alias("edge"), (F.col("liquidity") * 3).alias("liquidity"))


def held(t):
    return t.positions.groupBy("condition_id").agg(F.sum("initial_value").alias("exposure"))


def portfolio(t):
    return t.positions.agg((F.sum("initial_value") * 1.8).alias("total_value"), F.lit(50000.0).alias("capital"), F.lit(100000.0).alias("initial_capital"),
                           F.lit(0.05).alias("drawdown"), F.lit(-1000.0).alias("daily_pnl"))


add("risk_limits", lambda t: G.risk_limits(orders(t), held(t), portfolio(t)), """
WITH h AS (SELECT condition_id, sum(initial_value) AS exposure FROM positions GROUP BY 1),
b AS (SELECT count(*) AS n, sum(exposure) AS total FROM h), p AS (SELECT sum(initial_value) * 18e-1 AS total_value FROM positions),
o AS (SELECT condition_id AS order_id, condition_id, outcome_prices[1] AS price, volume_24h * 10 AS size, one_day_price_change / 2 AS edge, liquidity * 3 AS liquidity FROM markets WHERE active = 1),
r AS (SELECT o.*, exposure, n, 1e-1 * total_value - coalesce(exposure, 0) AS rm, 6e-1 * total_value - total AS ra FROM o LEFT JOIN h USING (condition_id), b, p),
v AS (SELECT *, CASE WHEN exposure IS NULL AND n >= 20 THEN 'max_positions' WHEN rm <= 0 THEN 'position_limit' WHEN ra <= 0 THEN 'portfolio_limit' WHEN abs(edge) < 3e-2 THEN 'min_edge'
  WHEN liquidity < 5000 THEN 'min_liquidity' ELSE '' END AS violation, least(size, least(rm, ra, 50000) / price) AS s FROM r)
SELECT order_id, condition_id, CASE WHEN violation = '' AND s <= 0 THEN 'portfolio_limit' ELSE violation END AS violation,
  CASE WHEN violation = '' AND s > 0 THEN s ELSE 0 END AS adjusted_size, CASE WHEN violation = '' AND s > 0 THEN 1 ELSE 0 END AS approved FROM v""", "adjusted_size")
add("portfolio_snapshots", lambda t: G.portfolio_snapshots(t.position_versions.withColumnRenamed("version", "ts"), 1e8), """
WITH a AS (SELECT version AS ts, sum(current_value) - sum(initial_value) AS unrealized_pnl, sum(initial_value) AS cost_basis, max(current_value) AS max_position, count(*) AS positions,
  1e8 + sum(current_value) - sum(initial_value) AS total_value FROM position_versions GROUP BY 1), h AS (SELECT *, max(total_value) OVER (ORDER BY ts) AS high_water FROM a)
SELECT *, (high_water - total_value) / high_water AS drawdown FROM h""", "unrealized_pnl cost_basis max_position total_value high_water drawdown")


def candidates(t):
    c = composite(t).select("condition_id", "score", "confidence").withColumn("computed_at", t.as_of)
    k = F.col("condition_id")
    price = F.get("outcome_prices", F.lit(0))
    posts = t.markets.where(k % 4 == 0).select("condition_id", (price * 0.9).alias("probability"), (price * -0.1).alias("edge"), ((k % 10) / 20).alias("confidence"))
    models = t.markets.where(k % 4 == 1).select("condition_id", (price * 0.5 + 0.5).alias("probability"), (0.5 - price * 0.5).alias("edge"), ((k % 10) / 10).alias("confidence"))
    return G.trade_candidates(c, t.markets, posts, models, t.as_of)


add("trade_candidates", candidates, f"""
WITH c AS (SELECT condition_id, score, confidence, price, token_ids FROM ({COMPOSITE_SQL}) JOIN (SELECT condition_id, outcome_prices[1] AS price, token_ids FROM markets) USING (condition_id)
  WHERE confidence >= 3e-1),
s AS (SELECT *, CASE WHEN condition_id % 4 = 0 AND CAST(condition_id % 10 AS DOUBLE) / 20 > 1e-1 THEN 'posterior' WHEN condition_id % 4 = 1 AND CAST(condition_id % 10 AS DOUBLE) / 10 > 3e-1 THEN 'model'
  WHEN abs(score) >= 15 AND confidence >= 5e-1 AND price BETWEEN 1e-1 AND 9e-1 THEN 'composite_direct' END AS source FROM c),
e AS (SELECT *, CASE source WHEN 'posterior' THEN price * -1e-1 WHEN 'model' THEN 5e-1 - price * 5e-1 ELSE score / 100 END AS edge,
  CASE source WHEN 'posterior' THEN price * 9e-1 WHEN 'model' THEN price * 5e-1 + 5e-1
    ELSE CASE WHEN price <= 1e-2 OR price >= 99e-2 THEN price ELSE greatest(1e-2, least(99e-2, price + score / 100 * 15e-2 * CASE WHEN score > 0 THEN 1 - price ELSE price END)) END END AS p
  FROM s WHERE source IS NOT NULL)
SELECT condition_id, source, score, edge, CASE WHEN edge > 0 THEN token_ids[1] ELSE token_ids[2] END AS token_id, CASE WHEN edge > 0 THEN price ELSE 1 - price END AS price,
  CASE WHEN edge > 0 THEN p ELSE 1 - p END AS probability FROM e""", "score edge price probability")

# ---- manipulation -----------------------------------------------------------


def wash(t):
    return M.wash_trading(t.activity, t.trades, t.as_of, MONTH)


def spoof(t):
    return M.spoofing(t.books, t.prices, ["condition_id"], t.as_of, 10 * DAY, 3600)


WASH_SQL = """SELECT token_id, total_trades, round_ratio, volume, price_change, coalesce(k, 0) AS self_trade_count, volume / greatest(price_change, 1e-3) AS volume_impact_ratio,
  least(4e-1 * least(coalesce(k, 0) / 5e0, 1) + CASE WHEN round_ratio > 3e-1 THEN 2e-1 * least((round_ratio - 3e-1) / 4e-1, 1) ELSE 0 END
    + CASE WHEN volume > 0 AND price_change < 1e-2 THEN 4e-1 * least(volume / 50000, 1) ELSE 0 END, 1) AS wash_score FROM
  (SELECT token_id, count(*) AS total_trades, avg(CASE WHEN size > 0 AND size % 10 = 0 THEN 1e0 ELSE 0e0 END) AS round_ratio, sum(size * price) AS volume,
     abs(arg_max(price, ROW(ts, trade_id)) - arg_min(price, ROW(ts, trade_id))) AS price_change FROM trades GROUP BY 1)
  LEFT JOIN (SELECT token_id, count(*) AS k FROM (SELECT asset AS token_id, wallet, sum(CASE WHEN side = 'BUY' THEN usdc_size ELSE 0 END) AS b, sum(CASE WHEN side = 'SELL' THEN usdc_size ELSE 0 END) AS s
     FROM activity GROUP BY ALL) WHERE least(b, s) > 0 AND least(b, s) > 7e-1 * greatest(b, s) GROUP BY 1) USING (token_id)"""
add("wash_trading", wash, WASH_SQL, "round_ratio volume price_change volume_impact_ratio wash_score")
SPOOF_SQL = f"""SELECT condition_id, count(*) AS snapshots, bid_cv, ask_cv, asymmetry_events, spoof_score FROM (
  SELECT condition_id, n, bid_cv, ask_cv, asymmetry_events, CASE WHEN n < 3 THEN 0 ELSE least(CASE WHEN greatest(bid_cv, ask_cv) > 5e-1 THEN 4e-1 * least(greatest(bid_cv, ask_cv) - 5e-1, 1) ELSE 0 END
    + 6e-1 * least(asymmetry_events / 5e0, 1), 1) END AS spoof_score FROM (
  SELECT condition_id, count(*) AS n, stddev_pop(bid) / greatest(avg(bid), 1e-6) AS bid_cv, stddev_pop(ask) / greatest(avg(ask), 1e-6) AS ask_cv,
    count_if((r > 7e-1 AND change < -5e-3) OR (r < 3e-1 AND change > 5e-3)) AS asymmetry_events FROM (
  SELECT b.*, m.change FROM (SELECT condition_id, snapshot_time, list_sum(bid_sizes) AS bid, list_sum(ask_sizes) AS ask, list_sum(bid_sizes) / (list_sum(bid_sizes) + list_sum(ask_sizes)) AS r FROM books) b
  ASOF LEFT JOIN (SELECT * FROM (SELECT condition_id, bucket, lead(p) OVER (PARTITION BY condition_id ORDER BY bucket) - p AS change FROM
     (SELECT condition_id, date_trunc('hour', ts) AS bucket, avg(price) AS p FROM prices WHERE ts >= {NOW} - INTERVAL 10 DAY GROUP BY ALL)) WHERE change IS NOT NULL) m
  ON b.condition_id = m.condition_id AND b.snapshot_time >= m.bucket) GROUP BY 1)) GROUP BY ALL"""
SPOOF_SQL = SPOOF_SQL.replace("SELECT condition_id, count(*) AS snapshots,", "SELECT condition_id, n AS snapshots,", 1).replace(")) GROUP BY ALL", "))")
add("spoofing", spoof, SPOOF_SQL, "bid_cv ask_cv spoof_score")


def wash_by_market(t):
    return wash(t).groupBy(F.floor(F.col("token_id") / 2).alias("condition_id")).agg(F.max("wash_score").alias("wash_score"))


add("manipulation_risk", lambda t: M.manipulation_risk(wash_by_market(t), spoof(t), "condition_id"), f"""
SELECT condition_id, coalesce(wash_score, 0) AS wash_score, coalesce(spoof_score, 0) AS spoof_score, least(5e-1 * coalesce(wash_score, 0) + 5e-1 * coalesce(spoof_score, 0), 1) AS risk_score FROM
  (SELECT token_id // 2 AS condition_id, max(wash_score) AS wash_score FROM ({WASH_SQL}) GROUP BY 1) FULL JOIN (SELECT condition_id, spoof_score FROM ({SPOOF_SQL})) USING (condition_id)""",
    "wash_score spoof_score risk_score")
add("analytics_overview", lambda t: V.one_row(
    clusters(t).agg(F.count("*").alias("clusters"), F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("avg_similarity")),
    insiders(t).agg(F.count_if(F.col("score") >= 15).alias("alerts")), opportunities(t).agg(F.count("*").alias("open_arbitrage")),
    composite(t).agg(F.count("*").alias("signals"), F.coalesce(F.avg(F.abs("score")), F.lit(0.0)).alias("avg_strength"))), f"""
WITH {SMALL} SELECT (SELECT count(*) FROM ({CLUSTER_SQL})) AS clusters, (SELECT avg(similarity) FROM ({CLUSTER_SQL})) AS avg_similarity,
  (SELECT count_if(score >= 15) FROM ({INSIDER_SQL})) AS alerts, (SELECT count(*) FROM ({OPPS_SQL})) AS open_arbitrage,
  (SELECT count(*) FROM ({COMPOSITE_SQL})) AS signals, (SELECT avg(abs(score)) FROM ({COMPOSITE_SQL})) AS avg_strength""", "avg_similarity avg_strength")
add("insider_overview", insider_overview, f"""
SELECT (SELECT count(*) FROM ({PROFILE_SQL})) AS profiles, (SELECT count_if(tier = 'high') FROM ({PROFILE_SQL})) AS high, (SELECT avg(suspicion) FROM ({PROFILE_SQL})) AS avg_suspicion,
  (SELECT count(*) FROM ({EVENTS_SQL})) AS events, (SELECT count(*) FROM ({PAIRS_WITH} {GROUP_BODY})) AS groups""", "avg_suspicion")
