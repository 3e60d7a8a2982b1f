"""Implied probabilities at horizons, calibration metrics, longshot tables and source adjustments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.scalars import clamp

HORIZONS = {"final": 0, "6h": 6, "24h": 24, "168h": 168}
EPS = 1e-6


def implied_probability_panel(markets: DataFrame, trades: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """Last probability of the first outcome at each horizon before the end, with the result.

    All horizons come from one join and one combined aggregate; no trade is copied per
    horizon and nothing is sorted per market.
    """
    known = markets.select(
        "condition_id", "category", "volume_total", "end_date", F.get("outcomes", F.lit(0)).alias("first"), "winning_outcome")
    rows = trades.join(known, "condition_id")
    p = F.when(F.col("outcome") == F.col("first"), F.col("price")).otherwise(1 - F.col("price"))
    last = [
        F.max_by(p, F.when(F.col("ts") <= F.col("end_date") - F.make_dt_interval(hours=F.lit(h)), F.struct("ts", "trade_id"))).alias(f"p_{name}")
        for name, h in horizons.items()
    ]
    return rows.groupBy("condition_id", "category", "volume_total", "end_date").agg(
        F.max(F.when(F.col("winning_outcome") == F.col("first"), 1.0).otherwise(0.0)).alias("y"), F.count("*").alias("n_trades"), *last)


def long_panel(panel: DataFrame, horizons: Sequence[str] = tuple(HORIZONS)) -> DataFrame:
    """One row per market and horizon that has a probability."""
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"p_{h}").alias("p")) for h in horizons])
    rest = [c for c in panel.columns if not c.startswith("p_")]
    return panel.select(*rest, F.explode(cells).alias("_c")).select(*rest, "_c.horizon", "_c.p").where("p is not null")


def probability_bin(p: str | Column, n: int = 10) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.least(F.floor(p * n), F.lit(n - 1))


def log_loss(y: Column, p: Column) -> Column:
    q = clamp(p, EPS, 1 - EPS)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def _bin_sums() -> list[Column]:
    y, p = F.col("y").cast("double"), F.col("p")
    return [F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("se"), F.sum(log_loss(y, p)).alias("sl")]


def _from_bins() -> list[Column]:
    n = F.sum("n")
    return [n.alias("n"), (F.sum("sy") / n).alias("positive_rate"), (F.sum("sp") / n).alias("mean_pred"), (F.sum("se") / n).alias("brier"),
            (F.sum("sl") / n).alias("log_loss"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / n).alias("ece_10")]


def forecast_metrics(forecasts: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Brier, log loss and calibration error: first per probability bin, then over the bins."""
    per_bin = forecasts.groupBy(*by, probability_bin("p", bins).alias("bin")).agg(*_bin_sums())
    return per_bin.groupBy(*by).agg(*_from_bins())


def reliability_bins(forecasts: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Count, mean forecast and observed rate of every bin; empty bins are there with nulls."""
    found = forecasts.groupBy(*by, probability_bin("p", bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg(F.col("y").cast("double")).alias("observed_rate"))
    every = F.explode(F.array(*[F.lit(i).cast("long") for i in range(bins)])).alias("bin")
    frame = found.select(*by).distinct().select(*by, every) if by else found.agg(F.count("*")).select(every)
    return frame.join(found, [*by, "bin"], "left").select(
        *by, (F.col("bin") / bins).alias("bin_start"), ((F.col("bin") + 1) / bins).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("count"), "mean_pred", "observed_rate")


def slice_metrics(forecasts: DataFrame, horizon: str, slices: Sequence[str], min_count: int, bins: int = 10) -> DataFrame:
    """Metrics of each slice value at each horizon: one grouping-sets aggregate down to bins."""
    rows = forecasts.withColumn("bin", probability_bin("p", bins))
    sets = [[F.col(horizon), F.col("bin")]] + [[F.col(horizon), F.col("bin"), F.col(s)] for s in slices]
    cells = rows.groupingSets(sets, horizon, "bin", *slices).agg(
        *_bin_sums(), *[F.grouping(s).alias(f"_g_{s}") for s in slices])
    name, value = F.lit("all"), F.lit("all")
    for s in slices:
        here = F.col(f"_g_{s}") == 0
        name, value = F.when(here, F.lit(s)).otherwise(name), F.when(here, F.col(s).cast("string")).otherwise(value)
    out = cells.groupBy(F.col(horizon).alias("horizon"), name.alias("slice_col"), value.alias("slice_value")).agg(*_from_bins())
    return out.where(F.col("n") >= min_count)


# ---- longshots --------------------------------------------------------------

LONGSHOT_EDGES = [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.5]


def longshot_view(forecasts: DataFrame) -> DataFrame:
    p, y = F.col("p"), F.col("y").cast("double")
    favourite = F.greatest(p, 1 - p)
    win = F.when(p >= 0.5, y).otherwise(1 - y)
    return forecasts.withColumns({"favourite_prob": favourite, "longshot_prob": 1 - favourite, "favourite_win": win, "longshot_win": 1 - win})


def longshot_bin(p: Column) -> Column:
    """Index of the right-open bin; exactly 0.5 has none."""
    out = None
    for i, high in enumerate(LONGSHOT_EDGES[1:]):
        out = F.when(p < high, i) if out is None else out.when(p < high, i)
    return out


def _bias(n_name: str = "n") -> list[Column]:
    observed = F.avg("longshot_win")
    return [F.count("*").alias(n_name), F.avg("longshot_prob").alias("mean_longshot_prob"), observed.alias("observed_longshot_win"),
            (F.avg("longshot_prob") - observed).alias("longshot_bias"), (F.avg("longshot_prob") / F.nullif(observed, F.lit(0.0))).alias("relative_overpricing")]


def longshot_bins(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = longshot_view(forecasts).withColumn("longshot_bin", longshot_bin(F.round("longshot_prob", 12))).where("longshot_bin is not null")
    out = rows.groupBy(*by, "longshot_bin").agg(*_bias(), F.avg("favourite_prob").alias("mean_favourite_prob"), F.avg("favourite_win").alias("observed_favourite_win"))
    flag = (F.col("relative_overpricing") >= 1.25) & (F.col("longshot_bias") > 0)
    return out.withColumns({"favourite_bias": F.col("mean_favourite_prob") - F.col("observed_favourite_win"), "flag": F.when(flag, 1).otherwise(0)})


BANDS = {"0-2%": (0.0, 0.02), "0-10%": (0.0, 0.10), "10-20%": (0.10, 0.20)}


def longshot_bands(forecasts: DataFrame, key: str, bands: dict[str, tuple[float, float]], min_count: int) -> DataFrame:
    """Longshot bias of each probability band by month or category (a row may lie in several bands)."""
    table = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in bands.items()])
    inside = F.filter(table, lambda b: (F.col("longshot_prob") >= b["lo"]) & (F.col("longshot_prob") < b["hi"]))
    rows = longshot_view(forecasts).withColumn("band", F.explode(F.transform(inside, lambda b: b["band"])))
    return rows.groupBy("band", key).agg(*_bias()).where(F.col("n") >= min_count)


def calibration_history(predictions: DataFrame, since: Column | None = None) -> DataFrame:
    """Brier per source and against the market price, and the adjustment factor; ``since`` leaves out older rows.

    ``predictions``: source, predicted, market_price, outcome (null when open), ts, id.
    """
    recent = predictions if since is None else predictions.where(F.col("ts") >= since)
    done = F.col("outcome").isNotNull()

    def brier(c):
        return F.avg(F.when(done, (F.col(c) - F.col("outcome")) * (F.col(c) - F.col("outcome"))))

    out = recent.groupBy("source").agg(F.count("*").alias("n_total"), F.count_if(done).alias("n_resolved"), brier("predicted").alias("brier"), brier("market_price").alias("market_brier"))
    ratio = F.col("brier") / F.nullif("market_brier", F.lit(0.0))
    return out.withColumn("adjustment", F.coalesce(clamp(1 / F.nullif(ratio, F.lit(0.0)), 0.5, 1.5), F.lit(1.0)))


