"""Threshold ladders: over/under markets of one event and question, ordered by strike.

Markets are first aggregated to (ladder, strike); windows and the isotonic fit then see
one row per distinct strike of a ladder, a number set by how many strikes a question
has and not by the number of markets or trades.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import correlation, ladder_template, ou_threshold
from oddsmith.operators.quantiles import exact_quantiles

KEY = ["event_slug", "ladder"]


def ladder_strikes(markets: DataFrame, p: Column, y: Column) -> DataFrame:
    """Mean probability and outcome per strike of each ladder with three strikes or more."""
    rows = markets.select("event_slug", ladder_template("question").alias("ladder"), ou_threshold("question").alias("strike"), "category", p.alias("p"), y.alias("y"), "volume_total")
    strikes = rows.where("strike is not null AND p is not null AND y is not null").groupBy(*KEY, "strike").agg(
        F.avg("p").alias("p"), F.avg("y").alias("y"), F.count("*").alias("markets"), F.min("category").alias("category"), F.sum("volume_total").alias("volume"))
    enough = strikes.groupBy(*KEY).agg(F.count("*").alias("n_strikes")).where("n_strikes >= 3")
    return strikes.join(enough, KEY)


def isotonic_fit(strikes: DataFrame) -> DataFrame:
    """Nearest non-increasing curve of each ladder by pooling adjacent violators."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("strike")
        blocks: list[list[float]] = []  # [mean, size]
        for p in pdf["p"]:
            blocks.append([p, 1])
            while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
        return pdf.assign(fitted=[m for m, n in blocks for _ in range(n)])[[*KEY, "strike", "p", "fitted"]]

    return strikes.select(*KEY, "strike", "p").groupBy(*KEY).applyInPandas(fit, "event_slug string, ladder string, strike double, p double, fitted double")


def ladder_metrics(strikes: DataFrame, tolerance: float = 0.02) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("strike")
    k, p, y = F.col("strike"), F.col("p"), F.col("y")
    k2, p2 = F.lead("strike").over(w), F.lead("p").over(w)
    rows = strikes.withColumns({"k2": k2, "dp": p2 - p}).withColumn("width", F.col("k2") - k)
    gap = F.greatest("dp", F.lit(0.0))
    atm = F.struct(F.abs(p - 0.5), k)
    return rows.groupBy(*KEY).agg(
        F.min("category").alias("category"), F.sum("markets").alias("n_markets"), F.max("n_strikes").alias("n_strikes"), F.min("strike").alias("min_strike"),
        F.max("strike").alias("max_strike"), F.avg((p - y) * (p - y)).alias("curve_brier"), F.count_if(F.col("dp") > tolerance).alias("violations"),
        (F.min("strike") + F.sum(p * F.col("width"))).alias("mean_proxy"),
        (F.min("strike") * F.min("strike") + F.sum(p * (F.col("k2") * F.col("k2") - k * k))).alias("second_moment"),
        (F.min("strike") + F.sum(y * F.col("width"))).alias("realized_mean"), F.min_by("strike", atm).alias("atm_strike"), F.min_by("p", atm).alias("atm_prob"),
        F.min_by((p - y) * (p - y), atm).alias("atm_brier"), F.count_if(F.col("dp") > 0).alias("arbitrage_count"), F.sum(gap).alias("arbitrage_edge"), F.max(gap).alias("max_arbitrage_edge"),
    ).withColumns({
        "violation_rate": F.col("violations") / (F.col("n_strikes") - 1), "variance_proxy": F.greatest(F.col("second_moment") - F.col("mean_proxy") * F.col("mean_proxy"), F.lit(0.0)),
        "mean_error": F.col("mean_proxy") - F.col("realized_mean")})


def tail_shape(strikes: DataFrame, margin: float = 0.02) -> DataFrame:
    """R2 of log p on strike (exponential) and on log strike (power) over the right tail."""
    tail = strikes.where((F.col("p") > 1e-4) & (F.col("p") < 0.35)).select(*KEY, "strike", F.ln("p").alias("v"))
    middle = tail.groupBy(*KEY).agg(F.percentile("strike", 0.5).alias("mid"), F.count("*").alias("n")).where("n >= 3")
    rows = tail.join(middle, KEY)
    upper = rows.groupBy(*KEY).agg(F.count_if(F.col("strike") >= F.col("mid")).alias("n_upper"))
    rows = rows.join(upper, KEY).where((F.col("n_upper") < 3) | (F.col("strike") >= F.col("mid")))
    lk = F.ln(F.greatest("strike", F.lit(1e-8)))
    flat = F.var_pop("v") * F.count("v") <= 1e-12
    fit = rows.groupBy(*KEY).agg(F.when(~flat, F.regr_r2("v", F.col("strike"))).alias("exp_r2"), F.when(~flat, F.regr_r2(F.col("v"), lk)).alias("power_r2"))
    e, q = F.col("exp_r2"), F.col("power_r2")
    winner = (
        F.when(e.isNull() & q.isNull(), "insufficient").when(e.isNull(), "power").when(q.isNull(), "exp")
        .when(e > q + margin, "exp").when(q > e + margin, "power").otherwise("tie"))
    return fit.withColumn("winner", winner)


def threshold_ladders(strikes: DataFrame) -> DataFrame:
    gaps = isotonic_fit(strikes).groupBy(*KEY).agg(
        F.avg(F.abs(F.col("p") - F.col("fitted"))).alias("isotonic_l1"), F.sqrt(F.avg(F.pow(F.col("p") - F.col("fitted"), 2))).alias("isotonic_l2"))
    out = ladder_metrics(strikes).join(gaps, KEY).join(tail_shape(strikes), KEY, "left")
    return out.withColumn("winner", F.coalesce("winner", F.lit("insufficient")))


def ladder_categories(ladders: DataFrame) -> DataFrame:
    return ladders.groupBy("category").agg(
        F.count("*").alias("n_ladders"), F.avg("curve_brier").alias("mean_curve_brier"), F.avg("atm_brier").alias("mean_atm_brier"),
        F.avg(F.abs("mean_error")).alias("mean_abs_mean_error"), F.avg("variance_proxy").alias("mean_variance"), F.avg("isotonic_l1").alias("mean_isotonic_l1"),
        F.avg("arbitrage_edge").alias("mean_arbitrage_edge"), F.avg(F.when(F.col("violations") > 0, 1.0).otherwise(0.0)).alias("share_violated"),
        F.avg(F.when(F.col("arbitrage_count") > 0, 1.0).otherwise(0.0)).alias("share_arbitrage"))


def ladder_summary(ladders: DataFrame) -> DataFrame:
    """One row: sizes, shares and the correlations of calibration with incoherence."""
    return ladders.agg(
        F.count("*").alias("ladders"), F.sum("n_markets").alias("markets"), F.avg("curve_brier").alias("mean_curve_brier"),
        F.avg(F.when(F.col("arbitrage_count") > 0, 1.0).otherwise(0.0)).alias("share_arbitrage"), correlation("atm_brier", "curve_brier").alias("corr_atm_curve"),
        correlation("atm_brier", F.abs("mean_error")).alias("corr_atm_error"), correlation("curve_brier", "arbitrage_edge").alias("corr_curve_edge"))


def decoupled_ladders(ladders: DataFrame) -> DataFrame:
    """Ladders that look calibrated at the money but violate order or miss the mean."""
    rows = ladders.withColumn("abs_error", F.abs("mean_error"))
    low, high = exact_quantiles(rows, [], "atm_brier", {"_low": 0.25}), exact_quantiles(rows, [], "abs_error", {"_high": 0.75})
    rows = rows.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(high))  # one row each
    return rows.where((F.col("atm_brier") <= F.col("_low")) & ((F.col("violations") > 0) | (F.col("abs_error") >= F.col("_high")))).drop("_low", "_high")
