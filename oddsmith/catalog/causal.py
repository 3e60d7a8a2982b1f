"""Causality queries on six-hour series of the tokens of traded markets."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.catalog.tables import aligned
from oddsmith.catalog.windows import BREAKS_SQL, SERIES
from oddsmith.operators.versions import latest_price, limit_by
from oddsmith.plans import causal as C
from oddsmith.plans import windows as W

EVENT_TIME = "2024-01-20 00:00:00"


def tokens(t):
    """Both tokens of traded markets with their event."""
    live = t.markets.join(t.trades.select("condition_id").distinct(), "condition_id", "left_semi")
    return live.select(F.explode("token_ids").alias("token_id"), "event_slug")


def event_series(t):
    return aligned(t).join(tokens(t), "token_id", "left_semi")


def pairs(t):
    k = tokens(t)
    return k.select(F.col("token_id").alias("src"), "event_slug").join(k.select(F.col("token_id").alias("dst"), "event_slug"), "event_slug").where("src <> dst").select("src", "dst")


TOKEN_SQL = "tk AS (SELECT unnest([2 * condition_id, 2 * condition_id + 1]) AS token_id, event_slug FROM markets WHERE condition_id IN (SELECT condition_id FROM trades))"
EVENT_SQL = f"""{SERIES}, {TOKEN_SQL}, ys AS (SELECT * FROM series WHERE token_id IN (SELECT token_id FROM tk)),
pr AS (SELECT a.token_id AS src, b.token_id AS dst FROM tk a JOIN tk b ON a.event_slug = b.event_slug AND a.token_id <> b.token_id)"""


def f_tail_sql(f, d1, d2):
    """P(F > f): the incomplete beta function by its power series, from the side on which it converges fast."""

    def side(x, a, b):
        terms = f"list_sum([exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({x})) for n in range(800)])"
        return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} * {terms}"

    a, b, x = f"({d2} / 2e0)", f"({d1} / 2e0)", f"({d2} / ({d2} + {d1} * {f}))"
    return f"CASE WHEN {f} <= 0 THEN 1 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - ({side(f'(1 - {x})', b, a)}) ELSE {side(x, a, b)} END"


def granger_sql(max_lag):
    """F and p of every pair and lag: each regressor in turn is taken out of all that follow it, own lags first."""
    parts = [f"""lg AS (SELECT token_id, row_number() OVER w - 1 AS step, price AS l0, {', '.join(f'lag(price, {k}) OVER w AS l{k}' for k in range(1, max_lag + 1))}
      FROM ys WINDOW w AS (PARTITION BY token_id ORDER BY bucket))"""]
    for p in range(1, max_lag + 1):
        own, other = [f"a{k}" for k in range(1, p + 1)], [f"b{k}" for k in range(1, p + 1)]
        raw = ["y.l0 AS y", *[f"y.l{k} AS a{k}" for k in range(1, p + 1)], *[f"x.l{k} AS b{k}" for k in range(1, p + 1)]]
        parts.append(f"j{p} AS (SELECT src, dst, {', '.join(raw)} FROM pr JOIN lg y ON y.token_id = dst JOIN lg x ON x.token_id = src AND x.step = y.step WHERE y.step >= {p})")
        left = ["y", *own, *other]
        parts.append(f"s{p}_0 AS (SELECT src, dst, {', '.join(f'{c} - avg({c}) OVER w AS {c}' for c in left)}, var_pop(y) OVER w * count(*) OVER w AS t FROM j{p} WINDOW w AS (PARTITION BY src, dst))")
        kept = ""
        for k, q in enumerate([*own, *other]):
            left = [c for c in left if c != q]
            cut = ", ".join(f"{c} - {q} * coalesce(sum({c} * {q}) OVER w / nullif(CASE WHEN sum({q} * {q}) OVER w > 1e-16 THEN sum({q} * {q}) OVER w ELSE 0 END, 0), 0) AS {c}" for c in left)
            # what the own lags leave of y stays as a column
            keep = f", {cut.split(', a')[0].split(', b')[0].rsplit(' AS ', 1)[0]} AS r" if k == p - 1 else kept
            parts.append(f"s{p}_{k + 1} AS (SELECT src, dst, t, {cut}{keep} FROM s{p}_{k} WINDOW w AS (PARTITION BY src, dst))")
            if k >= p - 1:
                kept = ", r"
        parts.append(f"f{p} AS (SELECT src, dst, {p} AS lag, count(*) - 2 * {p} - 1 AS free, sum(r * r) AS restricted, sum(y * y) AS whole, max(t) AS total FROM s{p}_{2 * p} GROUP BY src, dst)")
    union = " UNION ALL ".join(f"SELECT * FROM f{p}" for p in range(1, max_lag + 1))
    parts.append(f"gf AS (SELECT src, dst, lag, free, CASE WHEN whole > greatest(1e-15, 1e-10 * total) THEN (restricted - whole) / lag / (whole / free) END AS f0 FROM ({union}))")
    # a series that its lags explain fully has no F: p is 1
    parts.append("gz AS (SELECT src, dst, lag, free, CASE WHEN f0 < 1e-9 THEN 0 ELSE f0 END AS f_stat FROM gf)")
    parts.append(f"gp AS (SELECT *, CASE WHEN f_stat IS NULL THEN 1 ELSE {f_tail_sql('f_stat', 'lag', 'free')} END AS p_value FROM gz)")
    parts.append("""gm AS (SELECT src, dst, CAST(coalesce(arg_min(lag, ROW(p_value, lag)) FILTER (p_value < 1), 1) AS INTEGER) AS lag, coalesce(arg_min(f_stat, ROW(p_value, lag)) FILTER (p_value < 1), 0) AS f_stat,
      least(min(p_value), 1) AS p_value FROM gp GROUP BY src, dst)""")
    return ", ".join(parts)


GRANGER_SQL = f"{EVENT_SQL}, {granger_sql(3)}"
add("granger_matrix", lambda t: C.granger_matrix(event_series(t), pairs(t), 3), f"WITH {GRANGER_SQL} SELECT *, CASE WHEN p_value < 5e-2 THEN 1 ELSE 0 END AS significant FROM gm", "f_stat p_value")
LEADING_SQL = """SELECT token_id, (SELECT count(*) FROM h WHERE src = token_id) AS caused, (SELECT count(*) FROM h WHERE dst = token_id) AS caused_by,
  (SELECT count(*) FROM h WHERE src = token_id) - (SELECT count(*) FROM h WHERE dst = token_id) AS net_influence FROM k"""
add("leading_markets_granger", lambda t: C.leading_markets(C.granger_matrix(event_series(t), pairs(t), 3)), f"""
WITH {GRANGER_SQL}, h AS (SELECT src, dst FROM gm WHERE p_value < 5e-2), k AS (SELECT src AS token_id FROM gm UNION SELECT dst FROM gm) {LEADING_SQL}""")


def entropy(t):
    return C.transfer_entropy(event_series(t), pairs(t))


TE_SQL = f"""{EVENT_SQL}, f AS (SELECT * FROM (SELECT token_id, bucket, price AS past, lead(price) OVER (PARTITION BY token_id ORDER BY bucket) AS future FROM ys) WHERE future IS NOT NULL),
b AS (SELECT token_id, bucket, CASE WHEN max(past) OVER w - min(past) OVER w < 1e-12 THEN 0 ELSE least(floor((past - min(past) OVER w) / (max(past) OVER w - min(past) OVER w) * 10), 9) END AS past,
  CASE WHEN max(future) OVER w - min(future) OVER w < 1e-12 THEN 0 ELSE least(floor((future - min(future) OVER w) / (max(future) OVER w - min(future) OVER w) * 10), 9) END AS future
  FROM f WINDOW w AS (PARTITION BY token_id)),
jt AS (SELECT src, dst, y.future AS tf, y.past AS tp, x.past AS sp, count(*) AS c FROM pr JOIN b y ON y.token_id = dst JOIN b x ON x.token_id = src AND x.bucket = y.bucket GROUP BY ALL),
te AS (SELECT src, dst, greatest(sum(c / n * ln(c * ctp / (cts * cft))), 0) AS transfer_entropy, CAST(max(n) AS BIGINT) AS n FROM (SELECT src, dst, c::DOUBLE AS c, sum(c) OVER (PARTITION BY src, dst)::DOUBLE AS n,
  sum(c) OVER (PARTITION BY src, dst, tp)::DOUBLE AS ctp, sum(c) OVER (PARTITION BY src, dst, tf, tp)::DOUBLE AS cft, sum(c) OVER (PARTITION BY src, dst, tp, sp)::DOUBLE AS cts FROM jt) GROUP BY ALL)"""
add("transfer_entropy", entropy, f"WITH {TE_SQL} SELECT * FROM te", "transfer_entropy")
FLOW_COLS = "total_outflow avg_outflow max_outflow total_inflow avg_inflow max_inflow net_flow"
FLOW_SQL = f"""WITH {TE_SQL}, o AS (SELECT src AS token_id, sum(transfer_entropy) AS total_outflow, avg(transfer_entropy) AS avg_outflow, max(transfer_entropy) AS max_outflow FROM te GROUP BY 1),
i AS (SELECT dst AS token_id, sum(transfer_entropy) AS total_inflow, avg(transfer_entropy) AS avg_inflow, max(transfer_entropy) AS max_inflow FROM te GROUP BY 1)
SELECT *, total_outflow - total_inflow AS net_flow, CASE WHEN total_outflow - total_inflow > 0 THEN 'source' ELSE 'derivative' END AS role FROM o FULL JOIN i USING (token_id)"""
add("information_flow", lambda t: C.information_flow(entropy(t)), FLOW_SQL, FLOW_COLS)
add("top_information_sources", lambda t: C.top_sources(C.information_flow(entropy(t))).select("token_id", "total_outflow"),
    f"SELECT token_id, total_outflow FROM ({FLOW_SQL}) ORDER BY total_outflow DESC, token_id LIMIT 10", "total_outflow")
# an entropy edge stands for a p-value here, so that the roll-up itself can be compared
add("leading_markets", lambda t: C.leading_markets(entropy(t).select("src", "dst", F.exp(-10 * F.col("transfer_entropy")).alias("p_value")), 0.005), f"""
WITH {TE_SQL}, h AS (SELECT src, dst FROM te WHERE exp(-10 * transfer_entropy) < 5e-3), k AS (SELECT src AS token_id FROM te UNION SELECT dst FROM te)
{LEADING_SQL}""")


def correlations(t):
    changes = W.returns(event_series(t), ["token_id"])
    return C.pairwise_correlation(changes, pairs(t).where("src < dst"))


CORRELATION_SQL = f"""
WITH {EVENT_SQL}, d AS (SELECT * FROM (SELECT token_id, bucket, price - lag(price) OVER (PARTITION BY token_id ORDER BY bucket) AS v FROM ys) WHERE v IS NOT NULL)
SELECT src, dst, coalesce(covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0), 0) AS r, count(*) AS n FROM pr JOIN d x ON x.token_id = src JOIN d y ON y.token_id = dst AND y.bucket = x.bucket WHERE src < dst GROUP BY ALL"""
add("pairwise_correlation", correlations, CORRELATION_SQL, "r")
add("pc_dag", lambda t: C.pc_dag(correlations(t), 0.2))
add("merge_evidence", lambda t: C.merge_evidence(C.pc_dag(correlations(t), 0.2), C.granger_matrix(event_series(t), pairs(t), 3), 0.2))


def event_panel(t):
    """Per event the series of all its tokens; the treated one is the most traded."""
    k = tokens(t)
    traded = t.trades.groupBy("token_id").agg(F.sum("size").alias("traded"))
    first = k.join(traded, "token_id").groupBy("event_slug").agg(F.max_by("token_id", F.struct(F.round("traded", 3), -F.col("token_id"))).alias("event_id"))
    rows = k.join(first, "event_slug").join(event_series(t), "token_id")
    return rows.select("event_id", F.lit(EVENT_TIME).cast("timestamp").alias("event_time"), "token_id", F.when(F.col("token_id") == F.col("event_id"), 1).otherwise(0).alias("treated"), "bucket", "price")


add("event_impact", lambda t: C.event_impact(event_panel(t)))
add("synthetic_control", lambda t: C.synthetic_control(event_panel(t)))
add("causal_anomalies", lambda t: C.causal_anomalies(event_panel(t).withColumnRenamed("event_id", "target").drop("event_time"), 2.5))


def related(t):
    """The five tokens of the event whose changes are most correlated with a token's, either way."""
    r = correlations(t).select("src", "dst", F.round(F.abs("r"), 9).alias("strength"))
    both = r.select(F.col("src").alias("token_id"), F.col("dst").alias("related_id"), "strength").unionByName(r.select(F.col("dst").alias("token_id"), F.col("src").alias("related_id"), "strength"))
    return limit_by(both, ["token_id"], [F.desc("strength"), F.asc("related_id")], 5).drop("strength")


add("what_if", lambda t: C.what_if(
    W.structural_breaks(event_series(t), ["token_id"], 8, 2.0), related(t), latest_price(t.trades, ["token_id"]).select("token_id", "price")), f"""
WITH {TOKEN_SQL}, bk AS (SELECT token_id, CASE WHEN direction = 'up' THEN 1 ELSE -1 END * round(magnitude, 6) AS move FROM ({BREAKS_SQL}) WHERE token_id IN (SELECT token_id FROM tk)),
rr AS ({CORRELATION_SQL}), rb AS (SELECT src AS token_id, dst AS of_id, round(abs(r), 9) AS strength FROM rr UNION ALL SELECT dst, src, round(abs(r), 9) FROM rr),
lk AS (SELECT token_id, of_id FROM rb QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY strength DESC, of_id) <= 5 UNION ALL SELECT token_id, token_id FROM tk),
im AS (SELECT lk.token_id, avg(move) AS impact, stddev_pop(move) AS impact_std, count(*) AS analogies FROM lk JOIN bk ON bk.token_id = of_id GROUP BY 1),
px AS (SELECT token_id, arg_max(price, ROW(ts, trade_id)) AS current_price FROM trades GROUP BY 1)
SELECT token_id, current_price, coalesce(impact, 0) AS impact, coalesce(impact_std, 0) AS impact_std, coalesce(analogies, 0) AS analogies,
  least(1, greatest(0, current_price + coalesce(impact, 0))) AS projected_price FROM px LEFT JOIN im USING (token_id)""", "current_price impact impact_std projected_price", digits=12)


def signals(t):
    """Ten signals on every embedding: a few of its coordinates mixed with the outcome."""
    actual = (F.col("label") % 2).cast("double")
    cells = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(
        F.concat(F.lit("s"), i.cast("string")).alias("signal"),
        (F.element_at("embedding", i).cast("double") + (actual - 0.5) * (i % 4) * 0.08).alias("pred")))
    rows = t.embeddings.select(F.col("vec_id").alias("obs"), actual.alias("actual"), F.when(F.col("vec_id") % 10 < 7, 1).otherwise(0).alias("train"), F.explode(cells).alias("c"))
    return rows.select("obs", "actual", "train", "c.signal", "c.pred")


SIGNALS_SQL = """sg AS (SELECT vec_id AS obs, CAST(label % 2 AS DOUBLE) AS actual, CASE WHEN vec_id % 10 < 7 THEN 1 ELSE 0 END AS train, 's' || i AS signal,
  CAST(embedding[i] AS DOUBLE) + (label % 2 - 5e-1) * (i % 4) * 8e-2 AS pred FROM embeddings, range(1, 11) r(i))"""
ACCURACY = "SELECT signal, avg(h) FILTER (train = 1) AS in_sample, avg(h) FILTER (train = 0) AS out_of_sample FROM (SELECT *, CASE WHEN (pred > 0)::INT = actual THEN 1e0 ELSE 0e0 END AS h FROM {src}) GROUP BY 1"
add("signal_accuracy", lambda t: C.signal_accuracy(signals(t)), f"WITH {SIGNALS_SQL} {ACCURACY.format(src='sg')}", "in_sample out_of_sample")
NAMES = [f"s{i}" for i in range(1, 11)]
add("signal_ensemble", lambda t: t.spark.createDataFrame(
    C.signal_ensemble(signals(t), NAMES), "signal string, in_sample double, out_of_sample double, uniqueness double, marginal double, status string, weight double"))
add("ensemble_prediction", lambda t: C.ensemble_prediction(signals(t), {n: float(i) for i, n in enumerate(NAMES)}), f"""
WITH {SIGNALS_SQL} SELECT obs, least(100, greatest(-100, sum(pred * (substr(signal, 2)::INT - 1)) / 45)) AS prediction FROM sg GROUP BY 1""", "prediction")
add("signal_rebalance", lambda t: C.rebalance(C.signal_accuracy(signals(t)).select("signal", "out_of_sample", F.lit(1.0).alias("uniqueness")), signals(t).where("obs % 10 >= 8")), f"""
WITH {SIGNALS_SQL}, o AS ({ACCURACY.format(src='sg')}), n AS (SELECT signal, avg(CASE WHEN (pred > 0)::INT = actual THEN 1e0 ELSE 0e0 END) AS s FROM sg WHERE obs % 10 >= 8 GROUP BY 1)
SELECT signal, 3e-1 * s + 7e-1 * out_of_sample AS score, 1e0 AS uniqueness, CASE WHEN 3e-1 * s + 7e-1 * out_of_sample < 48e-2 THEN 'retired' ELSE 'active' END AS status FROM o JOIN n USING (signal)""", "score uniqueness")
