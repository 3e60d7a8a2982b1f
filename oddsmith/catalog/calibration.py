"""Calibration studies, ladders and the posterior update."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.plans import bayes as Y
from oddsmith.plans import calibration as C
from oddsmith.plans import ladders as L
from oddsmith.plans.time_joins import resolved_markets
from oddsmith.plans.windows import trade_bin, with_thresholds

METRICS = "positive_rate mean_pred brier log_loss ece_10"


def panel(t):
    return C.implied_probability_panel(resolved_markets(t.markets, t.trades, 3), t.trades)


def at_sql(hours):
    return f"arg_max(p, ROW(ts, trade_id)) FILTER (ts <= end_date - INTERVAL {hours} HOUR)"


PANEL_SQL = f"""SELECT condition_id, category, volume_total, end_date, max(CASE WHEN winning_outcome = 'Yes' THEN 1e0 ELSE 0e0 END) AS y, count(*) AS n_trades,
  {at_sql(0)} AS p_final, {at_sql(6)} AS p_6h, {at_sql(24)} AS p_24h, {at_sql(168)} AS p_168h FROM
  (SELECT t.*, CASE WHEN outcome = 'Yes' THEN price ELSE 1 - price END AS p, category, volume_total, end_date, winning_outcome FROM trades t
   JOIN (SELECT condition_id, category, volume_total, end_date, winning_outcome FROM markets WHERE resolved = 1) USING (condition_id))
  GROUP BY ALL HAVING count(*) >= 3""".replace("GROUP BY ALL", "GROUP BY condition_id, category, volume_total, end_date")
LONG_SQL = f"""SELECT condition_id, category, volume_total, end_date, y, n_trades, replace(h, 'p_', '') AS horizon, p FROM (UNPIVOT ({PANEL_SQL}) ON p_final, p_6h, p_24h, p_168h INTO NAME h VALUE p)"""
add("implied_probability_panel", panel, PANEL_SQL, "volume_total y p_final p_6h p_24h p_168h")


def metrics_sql(source, by="", bins=10):
    """Metrics straight from the rows; only the calibration error goes through bins."""
    group, lead = (f"GROUP BY {by}", f"{by},") if by else ("", "")
    using = f"USING ({by})" if by else "ON true"
    q = "least(greatest(p, 1e-6), 1 - 1e-6)"
    return f"""SELECT * FROM (SELECT {lead} count(*) AS n, avg(y) AS positive_rate, avg(p) AS mean_pred, avg((p - y) ** 2) AS brier, -avg(y * ln({q}) + (1 - y) * ln(1 - {q})) AS log_loss FROM {source} {group})
      JOIN (SELECT {lead} sum(c * abs(a - f)) / sum(c) AS ece_10 FROM (SELECT {lead} least(floor(p * {bins}), {bins} - 1) AS bin, count(*) AS c, avg(y) AS a, avg(p) AS f FROM {source}
        GROUP BY {lead} least(floor(p * {bins}), {bins} - 1)) {group}) {using}"""


add("forecast_metrics", lambda t: C.forecast_metrics(t.forecasts, ["lang"]), metrics_sql("forecasts", "lang"), METRICS)
add("forecast_metrics_all", lambda t: C.forecast_metrics(t.forecasts), metrics_sql("forecasts"), METRICS)
add("horizon_metrics", lambda t: C.forecast_metrics(C.long_panel(panel(t)), ["horizon"]), f"WITH l AS ({LONG_SQL}) {metrics_sql('l', 'horizon')}", METRICS)
add("reliability_bins", lambda t: C.reliability_bins(t.forecasts), """
SELECT CAST(b AS DOUBLE) / 10 AS bin_start, CAST(b + 1 AS DOUBLE) / 10 AS bin_end, count(p) AS count, avg(p) AS mean_pred, avg(y) AS observed_rate
FROM range(10) r(b) LEFT JOIN forecasts ON least(floor(p * 10), 9) = b GROUP BY b""", "bin_start bin_end mean_pred observed_rate")
add("reliability_by_horizon", lambda t: C.reliability_bins(C.long_panel(panel(t)), ["horizon"]), f"""
WITH l AS ({LONG_SQL}) SELECT horizon, CAST(b AS DOUBLE) / 10 AS bin_start, CAST(b + 1 AS DOUBLE) / 10 AS bin_end, count(p) AS count, avg(p) AS mean_pred, avg(y) AS observed_rate
FROM (SELECT DISTINCT horizon FROM l) CROSS JOIN range(10) r(b) LEFT JOIN l USING (horizon) WHERE l.p IS NULL OR true GROUP BY horizon, b""".replace(
    "LEFT JOIN l USING (horizon) WHERE l.p IS NULL OR true", "LEFT JOIN (SELECT *, least(floor(p * 10), 9) AS b FROM l) USING (horizon, b)"), "bin_start bin_end mean_pred observed_rate")


def sliced(t):
    rows = with_thresholds(t.forecasts, "n_chars", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    n = F.col("n_chars")
    quartile = F.when(n <= F.col("_q1"), "Q1").when(n <= F.col("_q2"), "Q2").when(n <= F.col("_q3"), "Q3").otherwise("Q4")
    rows = rows.withColumns({"quartile": quartile, "horizon": F.concat(F.lit("h"), F.col("toxic").cast("string")), "size_bin": trade_bin("n_chars")})
    return C.slice_metrics(rows, "horizon", ["lang", "size_bin", "quartile"], 5)


SLICE_ROWS = """WITH q AS (SELECT quantile_cont(n_chars, 25e-2) AS q1, quantile_cont(n_chars, 5e-1) AS q2, quantile_cont(n_chars, 75e-2) AS q3 FROM forecasts),
f AS (SELECT p, y, 'h' || toxic AS horizon, lang, CASE WHEN n_chars < 10 THEN '<10' WHEN n_chars < 50 THEN '10-49' WHEN n_chars < 100 THEN '50-99' WHEN n_chars < 500 THEN '100-499' ELSE '500+' END AS size_bin,
  CASE WHEN n_chars <= q1 THEN 'Q1' WHEN n_chars <= q2 THEN 'Q2' WHEN n_chars <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile FROM forecasts, q),
s AS (SELECT p, y, horizon, 'all' AS slice_col, 'all' AS slice_value FROM f UNION ALL SELECT p, y, horizon, 'lang', lang FROM f
  UNION ALL SELECT p, y, horizon, 'size_bin', size_bin FROM f UNION ALL SELECT p, y, horizon, 'quartile', quartile FROM f)"""
add("slice_metrics", sliced, f"{SLICE_ROWS} SELECT * FROM ({metrics_sql('s', 'horizon, slice_col, slice_value')}) WHERE n >= 5", METRICS)
VIEW_SQL = """SELECT *, 1 - greatest(p, 1 - p) AS lp, greatest(p, 1 - p) AS fp, CASE WHEN p >= 5e-1 THEN y ELSE 1 - y END AS fw, 1 - CASE WHEN p >= 5e-1 THEN y ELSE 1 - y END AS lw FROM {source}"""
BIAS_SQL = "count(*) AS n, avg(lp) AS mean_longshot_prob, avg(lw) AS observed_longshot_win, avg(lp) - avg(lw) AS longshot_bias, avg(lp) / nullif(avg(lw), 0) AS relative_overpricing"
BIAS = "mean_longshot_prob observed_longshot_win longshot_bias relative_overpricing"
add("longshot_bins", lambda t: C.longshot_bins(t.forecasts), f"""
WITH v AS ({VIEW_SQL.format(source='forecasts')}), b AS (SELECT *, CASE WHEN lp < 1e-2 THEN 0 WHEN lp < 2e-2 THEN 1 WHEN lp < 5e-2 THEN 2 WHEN lp < 1e-1 THEN 3 WHEN lp < 2e-1 THEN 4
  WHEN lp < 4e-1 THEN 5 WHEN lp < 5e-1 THEN 6 END AS longshot_bin FROM v)
SELECT *, mean_favourite_prob - observed_favourite_win AS favourite_bias, CASE WHEN relative_overpricing >= 125e-2 AND longshot_bias > 0 THEN 1 ELSE 0 END AS flag FROM
  (SELECT longshot_bin, {BIAS_SQL}, avg(fp) AS mean_favourite_prob, avg(fw) AS observed_favourite_win FROM b WHERE longshot_bin IS NOT NULL GROUP BY 1)""",
    BIAS + " mean_favourite_prob observed_favourite_win favourite_bias")
BANDS_SQL = "bands(band, lo, hi) AS (VALUES ('0-2%', 0e0, 2e-2), ('0-10%', 0e0, 1e-1), ('10-20%', 1e-1, 2e-1))"
add("longshot_monthly", lambda t: C.longshot_bands(
    C.long_panel(panel(t)).withColumn("month", F.date_format("end_date", "yyyy-MM")), "month", C.BANDS, 2), f"""
WITH {BANDS_SQL}, l AS ({LONG_SQL}), v AS ({VIEW_SQL.format(source='l')}) SELECT band, strftime(end_date, '%Y-%m') AS month, {BIAS_SQL} FROM v JOIN bands ON lp >= lo AND lp < hi
GROUP BY ALL HAVING count(*) >= 2""", BIAS)
add("longshot_by_category", lambda t: C.longshot_bands(t.forecasts, "source", {"1-10%": (0.01, 0.1)}, 1), f"""
WITH v AS ({VIEW_SQL.format(source='forecasts')}) SELECT '1-10%' AS band, source, {BIAS_SQL} FROM v WHERE lp >= 1e-2 AND lp < 1e-1 GROUP BY ALL""", BIAS)


def predictions(t):
    k = F.col("doc_id")
    return t.forecasts.select(
        F.concat(F.lit("model"), (k % 3).cast("string")).alias("source"), F.col("p").alias("predicted"), ((k * 53 % 97) / 97).alias("market_price"),
        F.when(k % 5 != 0, F.col("y").cast("double")).alias("outcome"), F.timestamp_seconds(k * 60).alias("ts"), k.alias("id"))


add("calibration_history", lambda t: C.calibration_history(predictions(t)), """
SELECT source, count(*) AS n_total, count(outcome) AS n_resolved, avg((p - outcome) ** 2) AS brier, avg((m - outcome) ** 2) AS market_brier,
  coalesce(least(15e-1, greatest(5e-1, 1 / nullif(avg((p - outcome) ** 2) / avg((m - outcome) ** 2), 0))), 1) AS adjustment FROM (
  SELECT 'model' || (doc_id % 3) AS source, p, CAST(doc_id * 53 % 97 AS DOUBLE) / 97 AS m, CASE WHEN doc_id % 5 <> 0 THEN y END AS outcome FROM forecasts) GROUP BY 1""", "brier market_brier adjustment")

# ---- ladders ----------------------------------------------------------------


def strikes(t):
    return L.ladder_strikes(t.markets, F.get("outcome_prices", F.lit(0)), F.when(F.col("condition_id") % 2 == 0, 1.0).otherwise(0.0))


STRIKES_SQL = """sk0 AS (SELECT event_slug, lower(category) || ' o/u {threshold}' AS ladder, strike, avg(outcome_prices[1]) AS p, avg(CASE WHEN condition_id % 2 = 0 THEN 1e0 ELSE 0e0 END) AS y,
  count(*) AS markets, min(category) AS category, sum(volume_total) AS volume FROM markets GROUP BY ALL),
sk AS (SELECT *, count(*) OVER (PARTITION BY event_slug, ladder) AS n_strikes, row_number() OVER (PARTITION BY event_slug, ladder ORDER BY strike) AS i FROM sk0 QUALIFY n_strikes >= 3)"""
STRIKES_SQL = STRIKES_SQL.replace("SELECT event_slug, lower(category) || ' o/u {threshold}' AS ladder, strike,", "SELECT event_slug, lower(category) || ' o/u {threshold}' AS ladder, strike,").replace(
    "GROUP BY ALL)", "GROUP BY event_slug, ladder, strike)")
ISO_SQL = """seg AS (SELECT a.event_slug, a.ladder, a.i AS a, b.i AS b, (SELECT avg(p) FROM sk c WHERE c.event_slug = a.event_slug AND c.ladder = a.ladder AND c.i BETWEEN a.i AND b.i) AS m
  FROM sk a JOIN sk b ON a.event_slug = b.event_slug AND a.ladder = b.ladder AND a.i <= b.i),
mx AS (SELECT x.event_slug, x.ladder, x.i, seg.a, max(m) AS m FROM sk x JOIN seg ON seg.event_slug = x.event_slug AND seg.ladder = x.ladder AND seg.a <= x.i AND seg.b >= x.i GROUP BY ALL),
iso AS (SELECT event_slug, ladder, i, min(m) AS fitted FROM mx GROUP BY ALL)"""
add("isotonic_fit", lambda t: L.isotonic_fit(strikes(t)), f"""
WITH {STRIKES_SQL}, {ISO_SQL} SELECT event_slug, ladder, strike, p, fitted FROM sk JOIN iso USING (event_slug, ladder, i)""", "strike p fitted")
LADDER_SQL = f"""{STRIKES_SQL}, {ISO_SQL}, nx AS (SELECT *, lead(strike) OVER w AS k2, lead(p) OVER w - p AS dp FROM sk WINDOW w AS (PARTITION BY event_slug, ladder ORDER BY strike)),
g AS (SELECT event_slug, ladder, min(category) AS category, CAST(sum(markets) AS BIGINT) AS n_markets, max(n_strikes) AS n_strikes, min(strike) AS min_strike, max(strike) AS max_strike,
  avg((p - y) ** 2) AS curve_brier, count_if(dp > 2e-2) AS violations, min(strike) + sum(p * (k2 - strike)) AS mean_proxy, min(strike) ** 2 + sum(p * (k2 ** 2 - strike ** 2)) AS second_moment,
  min(strike) + sum(y * (k2 - strike)) AS realized_mean, arg_min(strike, ROW(abs(p - 5e-1), strike)) AS atm_strike, arg_min(p, ROW(abs(p - 5e-1), strike)) AS atm_prob,
  arg_min((p - y) ** 2, ROW(abs(p - 5e-1), strike)) AS atm_brier, count_if(dp > 0) AS arbitrage_count, sum(greatest(dp, 0)) AS arbitrage_edge, max(greatest(dp, 0)) AS max_arbitrage_edge FROM nx GROUP BY ALL),
gi AS (SELECT event_slug, ladder, avg(abs(p - fitted)) AS isotonic_l1, sqrt(avg((p - fitted) ** 2)) AS isotonic_l2 FROM sk JOIN iso USING (event_slug, ladder, i) GROUP BY ALL),
t0 AS (SELECT event_slug, ladder, strike, ln(p) AS v, median(strike) OVER w AS mid, count(*) OVER w AS n FROM sk WHERE p > 1e-4 AND p < 35e-2 WINDOW w AS (PARTITION BY event_slug, ladder)),
t1 AS (SELECT *, count_if(strike >= mid) OVER (PARTITION BY event_slug, ladder) AS nu FROM t0 WHERE n >= 3),
t2 AS (SELECT event_slug, ladder, CASE WHEN var_pop(v) * count(v) > 1e-12 THEN regr_r2(v, strike) END AS exp_r2, CASE WHEN var_pop(v) * count(v) > 1e-12 THEN regr_r2(v, ln(strike)) END AS power_r2
  FROM t1 WHERE nu < 3 OR strike >= mid GROUP BY ALL),
lad AS (SELECT *, CAST(violations AS DOUBLE) / (n_strikes - 1) AS violation_rate, greatest(second_moment - mean_proxy ** 2, 0) AS variance_proxy, mean_proxy - realized_mean AS mean_error,
  CASE WHEN exp_r2 IS NULL AND power_r2 IS NULL THEN 'insufficient' WHEN exp_r2 > power_r2 + 2e-2 THEN 'exp' WHEN power_r2 > exp_r2 + 2e-2 THEN 'power' ELSE 'tie' END AS winner
  FROM g JOIN gi USING (event_slug, ladder) LEFT JOIN t2 USING (event_slug, ladder))"""
LADDER_DOUBLES = ("min_strike max_strike curve_brier mean_proxy second_moment realized_mean atm_strike atm_prob atm_brier arbitrage_edge max_arbitrage_edge isotonic_l1 isotonic_l2 "
                  "exp_r2 power_r2 violation_rate variance_proxy mean_error")
add("threshold_ladders", lambda t: L.threshold_ladders(strikes(t)), f"WITH {LADDER_SQL} SELECT * FROM lad", LADDER_DOUBLES)
add("ladder_categories", lambda t: L.ladder_categories(L.threshold_ladders(strikes(t))), f"""
WITH {LADDER_SQL} SELECT category, count(*) AS n_ladders, avg(curve_brier) AS mean_curve_brier, avg(atm_brier) AS mean_atm_brier, avg(abs(mean_error)) AS mean_abs_mean_error,
  avg(variance_proxy) AS mean_variance, avg(isotonic_l1) AS mean_isotonic_l1, avg(arbitrage_edge) AS mean_arbitrage_edge, avg(CASE WHEN violations > 0 THEN 1 ELSE 0 END) AS share_violated,
  avg(CASE WHEN arbitrage_count > 0 THEN 1 ELSE 0 END) AS share_arbitrage FROM lad GROUP BY 1""",
    "mean_curve_brier mean_atm_brier mean_abs_mean_error mean_variance mean_isotonic_l1 mean_arbitrage_edge share_violated share_arbitrage")
add("ladder_summary", lambda t: L.ladder_summary(L.threshold_ladders(strikes(t))), f"""
WITH {LADDER_SQL} SELECT count(*) AS ladders, CAST(sum(n_markets) AS BIGINT) AS markets, avg(curve_brier) AS mean_curve_brier, avg(CASE WHEN arbitrage_count > 0 THEN 1 ELSE 0 END) AS share_arbitrage,
  corr(atm_brier, curve_brier) AS corr_atm_curve, corr(atm_brier, abs(mean_error)) AS corr_atm_error, corr(curve_brier, arbitrage_edge) AS corr_curve_edge FROM lad""",
    "mean_curve_brier share_arbitrage corr_atm_curve corr_atm_error corr_curve_edge")
add("decoupled_ladders", lambda t: L.decoupled_ladders(L.threshold_ladders(strikes(t))).select("event_slug", "ladder", "atm_brier", "violations", "abs_error"), f"""
WITH {LADDER_SQL} SELECT event_slug, ladder, atm_brier, violations, abs(mean_error) AS abs_error FROM lad
WHERE atm_brier <= (SELECT quantile_cont(atm_brier, 25e-2) FROM lad) AND (violations > 0 OR abs(mean_error) >= (SELECT quantile_cont(abs(mean_error), 75e-2) FROM lad))""", "atm_brier abs_error")

# ---- posterior --------------------------------------------------------------


def evidence(t):
    k, price = F.col("condition_id"), F.get("outcome_prices", F.lit(0))
    m = t.markets
    models = m.where(k % 2 == 0).select("condition_id", ((k * 29 % 100) / 100).alias("probability"), ((k % 7) / 10).alias("uncertainty"), F.when(k % 10 == 0, 1).otherwise(0).alias("cold_start"))
    scores = m.where(k % 3 != 0).select("condition_id", ((k * 17 % 201) - 100).cast("double").alias("score"))
    leads = m.where(k % 4 == 1).select("condition_id", ((k % 21 - 10) / 2).alias("move"), ((k % 8) / 100).alias("p_value"), (k % 3 + 1).alias("lag"))
    flows = m.where(k % 5 == 2).select("condition_id", ((k % 13 - 6) / 2).alias("move"), ((k % 9) / 50).alias("transfer_entropy"))
    ev = Y.model_evidence(models).unionByName(Y.composite_evidence(scores)).unionByName(Y.causal_evidence(leads)).unionByName(Y.flow_evidence(flows))
    priors = m.where(k % 6 == 0).select("condition_id", (1.0 + k % 50).alias("alpha"), (2.0 + k % 31).alias("beta"), (t.as_of - F.make_dt_interval(hours=(k % 12).cast("int"))).alias("updated_at"))
    return m.select("condition_id", price.alias("price")), ev, priors


EVIDENCE_SQL = """SELECT condition_id, 'model' AS source, CASE WHEN condition_id % 10 = 0 THEN 1 ELSE (q / (1 - q)) ** 3e-1 END AS ratio,
    CASE WHEN condition_id % 10 = 0 THEN 0 ELSE 6e-1 * greatest(1e-1, 1 - (condition_id % 7) / 10e0) END AS weight
  FROM (SELECT condition_id, greatest(2e-2, least(98e-2, (condition_id * 29 % 100) / 100e0)) AS q FROM markets WHERE condition_id % 2 = 0)
UNION ALL SELECT condition_id, 'composite', CASE WHEN abs(s) < 5 THEN 1 ELSE exp(greatest(-2, least(2, s * 4e-1 / 50))) END, CASE WHEN abs(s) < 5 THEN 0 ELSE 4e-1 * least(1, abs(s) / 50) END
  FROM (SELECT condition_id, CAST(condition_id * 17 % 201 - 100 AS DOUBLE) AS s FROM markets WHERE condition_id % 3 <> 0)
UNION ALL SELECT condition_id, 'granger', CASE WHEN pv > 5e-2 THEN 1 ELSE exp(greatest(-15e-1, least(15e-1, mv * (1 - pv) * 3e-1))) END, CASE WHEN pv > 5e-2 THEN 0 ELSE 3e-1 * 8e-1 ** lg * (1 - pv) END
  FROM (SELECT condition_id, (condition_id % 21 - 10) / 2e0 AS mv, (condition_id % 8) / 100e0 AS pv, condition_id % 3 + 1 AS lg FROM markets WHERE condition_id % 4 = 1)
UNION ALL SELECT condition_id, 'info_flow', CASE WHEN te < 1e-2 THEN 1 ELSE exp(greatest(-1, least(1, mv * te * 25e-2 * 10))) END, CASE WHEN te < 1e-2 THEN 0 ELSE 25e-2 * least(1, te * 10) END
  FROM (SELECT condition_id, (condition_id % 13 - 6) / 2e0 AS mv, (condition_id % 9) / 50e0 AS te FROM markets WHERE condition_id % 5 = 2)"""
POSTERIOR_SQL = f"""WITH ev AS (SELECT condition_id, ratio, ln(greatest(2e-1, least(5, ratio))) * weight AS k FROM ({EVIDENCE_SQL}) WHERE ratio <> 1),
e AS (SELECT condition_id, sum(CASE WHEN k >= 0 THEN k ELSE 0 END) AS up, sum(CASE WHEN k < 0 THEN -k ELSE 0 END) AS down, count(*) AS sources, count_if(ratio > 1) AS yes FROM ev GROUP BY 1),
p0 AS (SELECT condition_id, outcome_prices[1] AS price, CASE WHEN condition_id % 6 = 0 THEN 1e0 + condition_id % 50 END AS al, CASE WHEN condition_id % 6 = 0 THEN 2e0 + condition_id % 31 END AS be,
  CASE WHEN condition_id % 6 = 0 THEN condition_id % 12 ELSE 0 END AS hrs FROM markets),
p1 AS (SELECT condition_id, price, hrs, coalesce(al + be, 20) AS c, coalesce(al / (al + be), price) AS m FROM p0),
p2 AS (SELECT condition_id, price, CASE WHEN hrs > 0 THEN greatest(1e-2, least(99e-2, price + (m - price) * 5e-1 ** (hrs / 4e0))) ELSE m END AS m,
  CASE WHEN hrs > 0 THEN greatest(2, 20 + (c - 20) * 5e-1 ** (hrs / 4e0)) ELSE c END AS c FROM p1),
p3 AS (SELECT condition_id, price, m * c * exp(coalesce(up, 0)) AS a, (1 - m) * c * exp(coalesce(down, 0)) AS b, coalesce(sources, 0) AS sources, coalesce(yes, 0) AS yes FROM p2 LEFT JOIN e USING (condition_id)),
p4 AS (SELECT condition_id, price, sources, yes, CASE WHEN abs(a / (a + b) - price) > 75e-3 THEN greatest(1e-2, least(99e-2, price + sign(a / (a + b) - price) * 75e-3)) ELSE a / (a + b) END AS posterior,
  least(a + b, 100) AS concentration FROM p3)
SELECT condition_id, price, posterior, concentration, posterior * concentration AS alpha, (1 - posterior) * concentration AS beta, posterior - price AS edge, sources,
  CASE WHEN sources > 0 THEN CAST(greatest(yes, sources - yes) AS DOUBLE) / sources ELSE 0 END AS agreement, least(1, concentration / 60) AS confidence,
  CASE WHEN abs(posterior - price) < 2e-2 THEN 0 WHEN posterior > price THEN greatest(0, (posterior * (1 / price - 1) - (1 - posterior)) / (1 / price - 1) * 25e-2)
    ELSE greatest(0, ((1 - posterior) * (1 / (1 - price) - 1) - posterior) / (1 / (1 - price) - 1) * 25e-2) END AS kelly,
  CASE WHEN posterior - price > 2e-2 AND sources >= 2 THEN 'BUY' WHEN posterior - price < -2e-2 AND sources >= 2 THEN 'SELL' ELSE 'HOLD' END AS direction FROM p4"""
POSTERIOR_DOUBLES = "price posterior concentration alpha beta edge agreement confidence kelly"
add("bayesian_update", lambda t: Y.bayesian_update(*evidence(t), t.as_of, interval=False), POSTERIOR_SQL, POSTERIOR_DOUBLES)
# the interval needs the inverse of the incomplete beta function, which SQL lacks; tests check it against tables
add("bayesian_interval", lambda t: Y.bayesian_update(*evidence(t), t.as_of).select("condition_id", "posterior", "ci_low", "ci_high"))
