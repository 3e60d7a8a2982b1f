"""Market similarity over the most traded markets, graph metrics, place risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import clamp, correlation
from oddsmith.operators.graph import both_ways, spread_intensity, triangles_per_node
from oddsmith.operators.quantiles import exact_quantiles
from oddsmith.operators.versions import limit_by

SIGNALS = ["obi", "volume", "trade_bias", "momentum", "smart_money", "concentration", "arbitrage", "insider"]


def most_traded(markets: DataFrame, n: int = 500) -> DataFrame:
    """The markets that similarity is defined on, with their place 1..n (n bounds the pairs)."""
    top = markets.where("active = 1 AND closed = 0").orderBy(F.desc("volume_24h"), "condition_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("volume_24h"), "condition_id")))


def place_pairs(top: DataFrame) -> DataFrame:
    """Each pair once: every market is copied to the places before its own, an equi-join finds them."""
    ahead = top.where("place > 1").select(F.col("condition_id").alias("j"), F.explode(F.sequence(F.lit(1), F.col("place") - 1)).alias("place"))
    return ahead.join(top.select("place", F.col("condition_id").alias("i")), "place").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def market_similarity(top: DataFrame, holders: DataFrame, bars: DataFrame, signals: DataFrame, min_common: int = 25, threshold: float = 0.15) -> DataFrame:
    """Weighted similarity of market pairs: event, holders, returns, signals, category."""
    ids = top.select("condition_id")
    pairs = place_pairs(top)
    meta = top.select("condition_id", "event_slug", "category")
    for side in "ab":
        pairs = pairs.join(meta.select(F.col("condition_id").alias(side), F.col("event_slug").alias(f"e_{side}"), F.col("category").alias(f"c_{side}")), side)
    pairs = pairs.select("a", "b", F.when((F.col("e_a") == F.col("e_b")) & (F.col("e_a") != ""), 1.0).otherwise(0.0).alias("event"),
                         F.when((F.col("c_a") == F.col("c_b")) & (F.col("c_a") != ""), 1.0).otherwise(0.0).alias("same_category"))
    # twenty largest holders of at most n markets
    whales = limit_by(holders.join(ids, "condition_id", "left_semi"), ["condition_id"], [F.desc("amount"), F.asc("wallet")], 20).select("condition_id", "wallet")
    size = whales.groupBy("condition_id").agg(F.count("*").alias("n"))
    common = whales.select(F.col("condition_id").alias("a"), "wallet").join(whales.select(F.col("condition_id").alias("b"), "wallet"), "wallet").where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("common"))
    for side in "ab":
        common = common.join(size.select(F.col("condition_id").alias(side), F.col("n").alias(f"n_{side}")), side)
    whale = common.select("a", "b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("whale"))
    w = Window.partitionBy("condition_id").orderBy("bar_time")
    prev = F.lag("close").over(w)
    rets = bars.join(ids, "condition_id", "left_semi").withColumn("r", F.when((F.col("close") > 0) & (prev > 0), F.ln(F.col("close") / F.nullif(prev, F.lit(0.0))))).where("r is not null")
    both = rets.select(F.col("condition_id").alias("a"), "bar_time", F.col("r").alias("ra")).join(
        rets.select(F.col("condition_id").alias("b"), "bar_time", F.col("r").alias("rb")), "bar_time").where("a < b")
    corr = both.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb")).where(
        (F.col("n") >= min_common) & (F.col("sa") > 1e-10) & (F.col("sb") > 1e-10)).select("a", "b", F.abs("c").alias("correlation"))
    vec = signals.join(ids, "condition_id", "left_semi").select("condition_id", F.array(*[F.col(c).cast("double") for c in SIGNALS]).alias("v"))
    vec = vec.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("len > 1e-10")
    rows = pairs.join(whale, ["a", "b"], "left").join(corr, ["a", "b"], "left")
    for side in "ab":
        rows = rows.join(vec.select(F.col("condition_id").alias(side), F.col("v").alias(f"v_{side}"), F.col("len").alias(f"l_{side}")), side, "left")
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot / (F.col("l_a") * F.col("l_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.select("a", "b", "event", zero(F.col("whale")).alias("whale"), zero(F.col("correlation")).alias("correlation"), zero((cosine + 1) / 2).alias("signal"),
                       F.col("same_category").alias("category"))
    score = 0.30 * F.col("event") + 0.20 * F.col("whale") + 0.25 * F.col("correlation") + 0.15 * F.col("signal") + 0.10 * F.col("category")
    return rows.withColumn("similarity", score).where(F.col("similarity") >= threshold)


def graph_metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree, weight range and median, mean clustering."""
    degree = both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("d"))
    local = degree.where("d >= 2").join(triangles_per_node(edges), "node", "left").select(
        (2 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("c"))
    n, m = F.col("nodes"), F.col("edges")
    rows = degree.agg(F.count("*").alias("nodes"), F.avg("d").alias("avg_degree"))
    for part in (
        edges.agg(F.count("*").alias("edges"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")),
        exact_quantiles(edges, [], "weight", {"median_weight": 0.5}), local.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("clustering")),
    ):
        rows = rows.crossJoin(F.broadcast(part))  # one row each
    return rows.withColumn("density", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0))


# ---- places -----------------------------------------------------------------


def risk_propagation(edges: DataFrame, origins: DataFrame, risk: str, decay: float = 0.7) -> DataFrame:
    """edges(src, dst, type, risk_type): zones of the risk keep ``decay``, roads its square."""
    factor = F.when((F.col("type") == "zone") & (F.col("risk_type") == risk), decay).when(F.col("type") == "road", decay * decay)
    return spread_intensity(edges.withColumn("factor", factor).where("factor is not null"), origins)


def zone_hazard(districts: DataFrame, zones: DataFrame, how: str = "max", points: dict[str, float] | None = None) -> DataFrame:
    """Severity points of the zones a district lies in; ``zones``: zone_id, severity, members[]."""
    points = points or {"low": 20.0, "moderate": 40.0, "high": 70.0, "very_high": 90.0}
    value = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in points.items()])
    hits = zones.select("zone_id", value.alias("p"), F.explode("members").alias("district"))
    agg = {"max": F.max, "sum": F.sum}[how]
    found = hits.groupBy("district").agg(agg("p").alias("hazard"), F.count("*").alias("zones"))
    return districts.join(found, "district", "left").select(*districts.columns, F.coalesce("hazard", F.lit(0.0)).alias("hazard"), F.coalesce("zones", F.lit(0)).alias("zones"))


def weighted_score(df: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    return df.withColumn(name, sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def grade(score: Column) -> Column:
    return F.when(score < 25, "A").when(score < 40, "B").when(score < 55, "C").when(score < 70, "D").otherwise("F")


def risk_composite(df: DataFrame, parts: dict[str, dict[str, float]], weights: dict[str, float]) -> DataFrame:
    """Nested weighted scores, the grade, and value = .6 risk + .4 min(100, price / 70)."""
    for name, inner in parts.items():
        df = weighted_score(df, inner, name)
    df = weighted_score(df, weights, "composite")
    value = 0.6 * F.col("composite") + 0.4 * F.least(F.lit(100.0), F.col("price") / 70)
    return df.withColumns({"composite": clamp("composite", 0.0, 100.0), "grade": grade(F.col("composite")), "value_score": value})


def two_state_posterior(prior: Column, if_true: Column, if_false: Column) -> Column:
    top = prior * if_true
    return top / F.nullif(top + (1 - prior) * if_false, F.lit(0.0))


def hotspots(df: DataFrame, max_risk: float, min_price: float) -> DataFrame:
    return df.where((F.col("price") >= min_price) & (F.col("composite") <= max_risk))
