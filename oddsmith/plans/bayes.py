"""Posterior update of market probabilities from weighted likelihood ratios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from oddsmith.functions.scalars import clamp, seconds_between

PRIOR = 20.0
HALF_LIFE_HOURS = 4.0
EFFICIENCY = 0.85
MAX_RATIO = 5.0


def model_evidence(models: DataFrame, reliability: float = 0.6, shrinkage: float = 0.5) -> DataFrame:
    """(condition_id, probability, uncertainty, cold_start) to (condition_id, source, ratio, weight)."""
    p = clamp("probability", 0.02, 0.98)
    ratio = F.pow(p / (1 - p), F.lit(shrinkage * reliability))
    weight = reliability * F.greatest(F.lit(0.1), 1 - F.col("uncertainty"))
    cold = F.col("cold_start") == 1
    return models.select("condition_id", F.lit("model").alias("source"), F.when(cold, 1.0).otherwise(ratio).alias("ratio"), F.when(cold, 0.0).otherwise(weight).alias("weight"))


def composite_evidence(signals: DataFrame, reliability: float = 0.4, temperature: float = 50.0) -> DataFrame:
    s = F.col("score")
    weak = F.abs(s) < 5
    ratio = F.exp(clamp(s * reliability / temperature, -2.0, 2.0))
    weight = reliability * F.least(F.lit(1.0), F.abs(s) / 50)
    return signals.select("condition_id", F.lit("composite").alias("source"), F.when(weak, 1.0).otherwise(ratio).alias("ratio"), F.when(weak, 0.0).otherwise(weight).alias("weight"))


def causal_evidence(leads: DataFrame, reliability: float = 0.3) -> DataFrame:
    """From (condition_id, move, p_value, lag) of a leading market."""
    sure = 1 - F.col("p_value")
    weak = F.col("p_value") > 0.05
    ratio = F.exp(clamp(F.col("move") * sure * reliability, -1.5, 1.5))
    weight = reliability * F.pow(F.lit(0.8), F.col("lag")) * sure
    return leads.select("condition_id", F.lit("granger").alias("source"), F.when(weak, 1.0).otherwise(ratio).alias("ratio"), F.when(weak, 0.0).otherwise(weight).alias("weight"))


def flow_evidence(flows: DataFrame, reliability: float = 0.25, minimum: float = 0.01) -> DataFrame:
    """From (condition_id, move, transfer_entropy) of an informing market."""
    te = F.col("transfer_entropy")
    ratio = F.exp(clamp(F.col("move") * te * reliability * 10, -1.0, 1.0))
    weight = reliability * F.least(F.lit(1.0), te * 10)
    weak = te < minimum
    return flows.select("condition_id", F.lit("info_flow").alias("source"), F.when(weak, 1.0).otherwise(ratio).alias("ratio"), F.when(weak, 0.0).otherwise(weight).alias("weight"))


def combine_evidence(evidence: DataFrame) -> DataFrame:
    """Exponents on alpha and beta per market: the update is a product, so its order does not matter."""
    used = evidence.where("ratio <> 1")
    k = F.ln(clamp("ratio", 1 / MAX_RATIO, MAX_RATIO)) * F.col("weight")
    yes = F.col("ratio") > 1
    return used.groupBy("condition_id").agg(
        F.sum(F.when(k >= 0, k).otherwise(0.0)).alias("up"), F.sum(F.when(k < 0, -k).otherwise(0.0)).alias("down"), F.count("*").alias("sources"),
        F.count_if(yes).alias("yes"))


@F.pandas_udf(DoubleType())
def beta_ppf(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    from oddsmith.functions.tails import beta_quantile

    return pd.Series(beta_quantile(q.to_numpy(), a.to_numpy(), b.to_numpy()))


def decayed(mean: Column, concentration: Column, price: Column, hours: Column) -> tuple[Column, Column]:
    """Mean and concentration after relaxing to the market price for ``hours``."""
    keep = F.when(hours > 0, F.pow(F.lit(0.5), hours / HALF_LIFE_HOURS)).otherwise(1.0)
    moved = F.when(hours > 0, clamp(price + (mean - price) * keep, 0.01, 0.99)).otherwise(mean)
    conc = F.when(hours > 0, F.greatest(F.lit(2.0), PRIOR + (concentration - PRIOR) * keep)).otherwise(concentration)
    return moved, conc


def bayesian_update(prices: DataFrame, evidence: DataFrame, priors: DataFrame, as_of: Column, min_edge: float = 0.02, min_sources: int = 2, interval: bool = True) -> DataFrame:
    """Posterior, edge, agreement, direction and quarter-Kelly stake of every market.

    ``prices``: condition_id, price; ``priors``: condition_id, alpha, beta, updated_at.
    """
    rows = prices.select("condition_id", clamp("price", 0.01, 0.99).alias("price")).join(priors, "condition_id", "left").join(combine_evidence(evidence), "condition_id", "left")
    price = F.col("price")
    conc0 = F.coalesce(F.col("alpha") + F.col("beta"), F.lit(PRIOR))
    mean0 = F.coalesce(F.col("alpha") / F.nullif(F.col("alpha") + F.col("beta"), F.lit(0.0)), price)
    hours = F.coalesce(seconds_between(as_of, "updated_at") / 3600, F.lit(0.0))
    mean1, conc1 = decayed(mean0, conc0, price, hours)
    rows = rows.select(
        "condition_id", "price", mean1.alias("_m"), conc1.alias("_c"), F.coalesce("up", F.lit(0.0)).alias("up"), F.coalesce("down", F.lit(0.0)).alias("down"),
        F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("yes", F.lit(0)).alias("yes"))
    rows = rows.withColumns({"_a": F.col("_m") * F.col("_c") * F.exp("up"), "_b": (1 - F.col("_m")) * F.col("_c") * F.exp("down")})
    rows = rows.withColumns({"_m": F.col("_a") / (F.col("_a") + F.col("_b")), "_c": F.col("_a") + F.col("_b")})
    room = (1 - EFFICIENCY) * 0.5
    gap = F.col("_m") - price
    capped = F.when(F.abs(gap) > room, clamp(price + F.signum(gap) * room, 0.01, 0.99)).otherwise(F.col("_m"))
    rows = rows.withColumns({"posterior": capped, "concentration": F.least(F.col("_c"), F.lit(PRIOR * 5))})
    edge = F.col("posterior") - price
    majority = F.greatest(F.col("yes"), F.col("sources") - F.col("yes"))
    mine, paid = F.when(edge > 0, F.col("posterior")).otherwise(1 - F.col("posterior")), F.when(edge > 0, price).otherwise(1 - price)
    b = 1 / F.greatest(paid, F.lit(0.01)) - 1
    kelly = F.when(F.abs(edge) < min_edge, 0.0).otherwise(F.greatest((mine * b - (1 - mine)) / b * 0.25, F.lit(0.0)))
    enough = F.col("sources") >= min_sources
    out = rows.select(
        "condition_id", "price", "posterior", "concentration", (F.col("posterior") * F.col("concentration")).alias("alpha"),
        ((1 - F.col("posterior")) * F.col("concentration")).alias("beta"), edge.alias("edge"), "sources",
        F.when(F.col("sources") > 0, majority / F.nullif("sources", F.lit(0))).otherwise(0.0).alias("agreement"),
        F.least(F.lit(1.0), F.col("concentration") / (PRIOR * 3)).alias("confidence"), kelly.alias("kelly"),
        F.when((edge > min_edge) & enough, "BUY").when((edge < -min_edge) & enough, "SELL").otherwise("HOLD").alias("direction"))
    if not interval:
        return out
    return out.withColumns({"ci_low": beta_ppf(F.lit(0.025), F.col("alpha"), F.col("beta")), "ci_high": beta_ppf(F.lit(0.975), F.col("alpha"), F.col("beta"))})
