"""Feature tables of resolved markets and of auction lots, imputation and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import array_sum, first_or, ratio_or_null, seconds_between
from oddsmith.operators.quantiles import exact_quantiles
from oddsmith.plans.aggregates import category_median, gini, wallet_market_features
from oddsmith.plans.windows import life_features

DAY = 86400


def market_features(markets: DataFrame, trades: DataFrame, activity: DataFrame, scores: DataFrame) -> DataFrame:
    """Structure, price, trade, wallet and volume features per resolved market (nulls kept).

    Every part is an aggregate keyed by market; wide rows only come together at the end.
    """
    usd = F.col("price") * F.col("size")
    when = F.struct("ts", "trade_id")
    buy = F.col("side") == "buy"
    span = F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(DAY * 1e6), F.lit(1e-6))
    flow = trades.groupBy("condition_id").agg(
        F.max_by("price", when).alias("last_price"), (F.max("price") - F.min("price")).alias("price_range"), F.log1p(F.count("*")).alias("trade_count"),
        F.avg(usd).alias("avg_trade_size"), F.max(usd).alias("max_trade_size"), F.avg(F.when(buy, 1.0).otherwise(0.0)).alias("buy_sell_ratio"),
        F.coalesce(ratio_or_null(F.sum(F.when(buy, usd).otherwise(0.0)), F.sum(usd)), F.lit(0.5)).alias("buy_volume_ratio"),
        F.when(F.max("ts") > F.min("ts"), F.count("*") / span).otherwise(F.count("*").cast("double")).alias("trades_per_day"))
    days = seconds_between("end_date", "start_date") / DAY
    median = category_median(markets)
    base = markets.where("resolved = 1").join(median, "category", "left").select(
        "condition_id", F.log1p("volume_total").alias("volume_total"), F.log1p("liquidity").alias("liquidity"), F.when(days > 0, days).alias("duration_days"),
        F.size("outcomes").cast("double").alias("num_outcomes"), "one_day_price_change", F.log1p("volume_24h").alias("volume_24h"), F.log1p("volume_1wk").alias("volume_1wk"),
        F.coalesce(ratio_or_null("volume_24h", F.col("volume_1wk") / 7), F.lit(0.0)).alias("volume_acceleration"),
        ratio_or_null("volume_total", "median_volume").alias("volume_vs_category_median"), F.get("outcome_prices", F.lit(0)).alias("_first"))
    rows = base.join(flow, "condition_id", "left").join(gini(trades, ["condition_id"], "size").select("condition_id", F.col("gini").alias("trade_size_gini")), "condition_id", "left")
    rows = rows.join(life_features(trades, markets), "condition_id", "left").join(wallet_market_features(activity, scores), "condition_id", "left")
    return rows.withColumn("last_price", F.coalesce("last_price", "_first")).drop("_first")


def lifecycle_features(markets: DataFrame, trades: DataFrame, books: DataFrame, holders: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """Price, volume, liquidity, participation, time and structure features before a cut-off.

    The cut-off is a share of the market's life and applies to every trade and book, so
    nothing after it leaks into a feature.
    """
    life = F.unix_micros("end_date") - F.unix_micros("start_date")
    meta = markets.withColumn("cut", F.timestamp_micros((F.unix_micros("start_date") + life * cutoff).cast("long"))).select(
        "condition_id", "category", "start_date", "end_date", "cut", F.size("outcomes").cast("double").alias("num_outcomes"))
    seen = trades.join(meta.select("condition_id", "start_date", "cut"), "condition_id").where(F.col("ts") <= F.col("cut"))
    when = F.struct("ts", "trade_id")
    price = seen.groupBy("condition_id").agg(
        F.min_by("price", when).alias("start_price"), F.max_by("price", when).alias("cutoff_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.stddev_pop("price").alias("price_std"), F.count("*").alias("trades"))
    day = F.datediff("ts", "start_date")
    daily = seen.groupBy("condition_id", day.alias("d")).agg(F.sum(F.col("price") * F.col("size")).alias("v"))
    # volumes in whole units of 1e-4: sums of whole numbers don't depend on the order of the rows
    n, d, v = F.count("*"), F.col("d").cast("double"), F.round(F.col("v") * 1e4)
    slope = (n * F.sum(d * v) - F.sum(d) * F.sum(v)) / F.nullif(n * F.sum(d * d) - F.sum(d) * F.sum(d), F.lit(0.0)) / 1e4
    volume = daily.groupBy("condition_id").agg(
        F.sum("v").alias("total_volume"), F.avg("v").alias("avg_daily_volume"), F.max("v").alias("max_daily_volume"), F.count("*").alias("active_days"),
        F.coalesce(slope, F.lit(0.0)).alias("volume_slope"), F.max_by("d", F.struct("v", -F.col("d"))).alias("peak_day"))
    bid, ask, tot = array_sum("bid_sizes"), array_sum("ask_sizes"), array_sum("bid_sizes") + array_sum("ask_sizes")
    gap = first_or("ask_prices", 0.0) - first_or("bid_prices", 0.0)
    depth = books.join(meta.select("condition_id", "cut"), "condition_id").where(F.col("snapshot_time") <= F.col("cut")).groupBy("condition_id").agg(
        F.avg(gap).alias("avg_spread"), F.stddev_pop(gap).alias("spread_std"), F.avg(F.when(tot > 0, (bid - ask) / F.nullif(tot, F.lit(0.0)))).alias("avg_obi"), F.avg(tot).alias("avg_depth"))
    from oddsmith.plans.serving import holder_top5

    held = holder_top5(holders).join(gini(holders, ["condition_id"], "amount").select("condition_id", F.col("gini").alias("holder_gini")), "condition_id").select(
        "condition_id", "total_holders", F.when(F.col("total_holders") >= 5, ratio_or_null("top5_amount", "total_amount")).otherwise(1.0).alias("top5_share"), "holder_gini",
        ratio_or_null("top_holder_amount", "total_amount").alias("max_holder_share"))
    # categories are few; their order gives the code
    codes = markets.select("category").distinct().withColumn("category_code", F.dense_rank().over(Window.orderBy("category")))
    rows = meta.join(price, "condition_id")
    for part in (volume, gini(daily, ["condition_id"], "v").select("condition_id", F.col("gini").alias("volume_gini")), depth, held):
        rows = rows.join(part, "condition_id", "left")
    life_days = F.greatest(seconds_between("cut", "start_date") / DAY, F.lit(0.01))
    rows = rows.join(codes, "category", "left")
    zero = ["avg_spread", "spread_std", "avg_obi", "avg_depth", "top5_share", "holder_gini", "max_holder_share"]
    return rows.withColumns({
        "price_range": F.col("max_price") - F.col("min_price"), "price_velocity": (F.col("cutoff_price") - F.col("start_price")) / life_days,
        "duration_days": seconds_between("end_date", "start_date") / DAY, "peak_position": F.col("peak_day") / life_days,
    }).na.fill(0.0, zero).na.fill(0, ["total_holders"]).drop("start_date", "end_date", "cut", "category")


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c).cast("double"))


def _known(c: str, longer_than: int = 0) -> Column:
    return F.when(F.length(F.trim(F.col(c))) > longer_than, 1.0).otherwise(0.0)


def _is(c: str, *values: str) -> Column:
    return F.when(F.lower(F.trim(F.col(c))).isin(*values), 1.0).otherwise(0.0)


def lot_features(lots: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """Feature groups of sold lots as one projection over lots with artist history.

    artist, physical, medium, estimate, sale, history, derived sizes, extraction
    confidence, bidding, creator, documents, text, style, category flags, payment, ratios.
    """
    h, w, d = _positive("height_cm"), _positive("width_cm"), _positive("depth_cm")
    low, high = _positive("estimate_low"), _positive("estimate_high")
    born, died, made = _positive("birth_year"), _positive("death_year"), _positive("creation_year")
    hammer, start = _positive("hammer_price"), _positive("starting_bid")
    usd_low, usd_high = _positive("estimate_low_usd"), _positive("estimate_high_usd")
    career, age = F.coalesce(died, F.lit(float(as_of_year))) - born, made - born
    mid, usd_mid = (low + high) / 2, (usd_low + usd_high) / 2
    nothing = F.lit(0.0)
    features = {
        "is_living": F.when(F.col("vital_status") == "alive", 1.0).when(F.col("vital_status") == "dead", 0.0), "artist_birth_year": born,
        "artist_career_length": F.when(career > 0, career), "is_rare_artist": F.col("is_rare_artist").cast("double"),
        "artist_market_depth": F.coalesce(F.log1p(F.col("prior_lots")), nothing), "nationality_known": _known("nationality"),
        "height_cm": h, "width_cm": w, "log_surface_area": F.ln(h * w), "aspect_ratio": w / h, "has_depth": F.when(d.isNotNull(), 1.0).otherwise(0.0),
        "creation_year": made, "creation_is_approximate": F.col("creation_approx").cast("double"),
        "is_painting": _is("category", "painting"), "is_sculpture": _is("category", "sculpture"), "is_work_on_paper": _is("category", "works_on_paper", "print", "photograph"),
        "is_decorative": _is("category", "decorative", "ceramic"), "medium_known": _known("category"),
        "log_estimate_low": F.log1p(low), "log_estimate_high": F.log1p(high), "log_estimate_mid": F.log1p(mid), "estimate_spread": (high - low) / low,
        "sale_month": F.month("sale_date").cast("double"), "sale_year_numeric": F.year("sale_date").cast("double"), "sale_day_of_week": F.weekday("sale_date").cast("double"),
        "sale_size": F.coalesce(F.col("sale_size").cast("double"), nothing), "lot_position_pct": F.col("lot_position") / _positive("sale_size"),
        "artist_avg_log_price": F.col("avg_log_price"), "artist_median_log_price": F.col("median_log_price"), "artist_price_std": F.col("price_std"), "artist_prior_lots": F.col("prior_lots"), "artist_price_trend": F.col("price_trend"),
        "log_depth_cm": F.coalesce(F.log1p(d), nothing), "age_at_creation": F.when(age >= 0, age), "years_since_creation": as_of_year - made,
        **{c: F.coalesce(F.col(c).cast("double"), nothing) for c in ("artist_name_confidence", "dimensions_confidence", "medium_confidence", "creation_confidence")},
        "num_bids": _positive("num_bids"), "log_starting_bid": F.log1p(start), "is_online_sale": F.when(F.lower(F.trim(F.col("bidding_method"))) == "online", 1.0).otherwise(0.0),
        "reserve_met": F.col("reserve_met").cast("double"), "hammer_start_ratio": hammer / start,
        "is_attributed_artist": F.when(F.col("creator_type") == "artist", 1.0).when(F.col("creator_type").isNotNull(), 0.0),
        "is_maker_not_artist": F.when(F.col("creator_type").isin("maker", "producer", "artisan"), 1.0).when(F.col("creator_type").isNotNull(), 0.0),
        **{f"{n}_count": F.coalesce(F.array_size(c).cast("double"), nothing) for n, c in (("provenance", "provenance"), ("literature", "literature"), ("exhibition", "exhibitions"))},
        "title_length": F.coalesce(F.length("title").cast("double"), nothing), "has_description": _known("description", 10), "has_signed_inscribed": _known("signed"),
        "has_condition_report": _known("condition"), "has_style_period": _known("style"), "has_origin": _known("origin"),
        "is_wine": _is("category", "wine"), "is_jewelry": _is("category", "jewelry"), "is_book": _is("category", "book"), "is_asian_art": _is("category", "asian_art"),
        "has_crypto": F.coalesce(F.col("accepts_crypto").cast("double"), nothing), "is_guaranteed": F.coalesce(F.col("guaranteed").cast("double"), nothing),
        "final_hammer_ratio": _positive("final_price") / hammer, "estimate_mid_usd": F.log1p(usd_mid),
        "log_estimate_range_usd": F.log1p(F.greatest(usd_high - usd_low, nothing)), "estimate_relative_level": F.log1p(usd_mid) - F.col("avg_log_price"),
    }
    return lots.select("lot_id", F.ln(hammer).alias("log_price"), *[c.alias(n) for n, c in features.items()])


def impute_scale(df: DataFrame, cols: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """Median imputation, removal of constant columns and z-scores, all learnt on the train rows.

    One row of statistics per column reaches the plan as a broadcast; only the list of
    constant columns is decided on the driver.
    """
    base = df.where(F.col(split) == train)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols]))
    found = exact_quantiles(base.select(cells.alias("c")).select("c.*"), ["feature"], "x", {"median": 0.5})
    medians = found.groupBy().pivot("feature", list(cols)).agg(F.first("median")).select(*[F.col(c).alias(f"_med_{c}") for c in cols])  # one row
    filled = df.crossJoin(F.broadcast(medians)).select(*[c for c in df.columns if c not in cols], *[F.coalesce(F.col(c), F.col(f"_med_{c}"), F.lit(0.0)).alias(c) for c in cols])
    stats = filled.where(F.col(split) == train).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    spread = stats.first()
    keep = [c for c in cols if spread[f"_s_{c}"] is not None and spread[f"_s_{c}"] > 1e-12]
    return filled.select(*[c for c in df.columns if c not in cols], *[((F.col(c) - F.lit(spread[f"_m_{c}"])) / F.lit(spread[f"_s_{c}"])).alias(c) for c in keep])

