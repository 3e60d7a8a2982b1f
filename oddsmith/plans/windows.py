"""Ordered computations: returns, breaks, shapes, history without leakage, splits and buckets.

Windows partitioned by a series run over bars or buckets, whose number is bounded by
the calendar.  Anything ordered over trades or lots uses the chunked operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import array_sum, seconds_between
from oddsmith.operators.asof import asof_join
from oddsmith.operators.bars import bucket
from oddsmith.operators.order_statistics import earlier_medians
from oddsmith.operators.ordered import DAY, time_chunk, with_row_number, with_running
from oddsmith.operators.quantiles import exact_quantiles
from oddsmith.session import cut_lineage


def series_window(key: Sequence[str], at: str = "bucket"):
    return Window.partitionBy(*key).orderBy(at)


def returns(series: DataFrame, key: Sequence[str], value: str = "price", at: str = "bucket", floor: float = 1e-10) -> DataFrame:
    """Log return (both prices positive), first difference, and log return of floored prices."""
    prev = F.lag(value).over(series_window(key, at))
    x = F.col(value)
    return series.withColumn("_prev", prev).where("_prev is not null").select(
        *key, at,
        F.when((x > 0) & (F.col("_prev") > 0), F.ln(x / F.nullif("_prev", F.lit(0.0)))).alias("log_return"),
        (x - F.col("_prev")).alias("diff"),
        (F.ln(F.greatest(x, F.lit(floor))) - F.ln(F.greatest("_prev", F.lit(floor)))).alias("floored_return"),
    )


def sibling_market(markets: DataFrame) -> DataFrame:
    """First other market of the event: the smallest id, and for that one the second smallest.

    Two small aggregates per event instead of pairing all markets of an event.
    """
    first = markets.groupBy("event_slug").agg(F.min("condition_id").alias("first"))
    known = markets.select("condition_id", "event_slug").join(first, "event_slug")
    second = known.where("condition_id > first").groupBy("event_slug").agg(F.min("condition_id").alias("second"))
    pick = F.when(F.col("condition_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return known.join(second, "event_slug", "left").select("condition_id", "event_slug", pick.alias("sibling")).where("sibling is not null")


def peak_volume_day(trades: DataFrame) -> DataFrame:
    daily = trades.groupBy("condition_id", F.to_date("ts").alias("day")).agg(F.sum("size").alias("volume"))
    best = F.struct("volume", (-F.unix_date("day")).alias("tie"))
    return daily.groupBy("condition_id").agg(F.max_by("day", best).alias("peak_day"), F.max("volume").alias("peak_volume"))


def artist_history(lots: DataFrame, min_lots: int = 5) -> DataFrame:
    """Per lot, statistics of the artist's lots sold strictly earlier (same-day lots do not count).

    All lots of an (artist, day) share their history, so daily sums are accumulated: the
    running window has one row per artist and day.  The median of the earlier logarithms comes
    from cells of values (``earlier_medians``).  The trend is the regression slope on
    standardised time, cov(t, p) / std(t).
    """
    t, day = F.col("day"), F.unix_date(F.to_date("sale_date"))
    prices = lots.select("artist", day.alias("day"), F.ln("price").alias("p"))
    daily = cut_lineage(prices.groupBy("artist", "day").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp")))
    # days are counted from a fixed epoch near the data to keep the squares small
    base = F.col("day") - F.lit(10000)
    n = F.col("n")
    sums = {"k": n, "sp": F.col("p"), "spp": F.col("pp"), "st": n * base, "stt": n * base * base, "stp": base * F.col("p")}
    past = with_running(daily, ["artist"], ["day"], F.floor(t / 365), sums=sums, include_current=False)
    k = F.nullif("k", F.lit(0)).cast("double")
    mean = F.col("sp") / k
    var_t = F.col("stt") / k - (F.col("st") / k) * (F.col("st") / k)
    enough, three = F.col("k") >= min_lots, F.col("k") >= 3
    stats = past.select(
        "artist", "day",
        F.when(enough, mean).alias("avg_log_price"),
        F.when(enough & three, F.sqrt(F.greatest(F.col("spp") / k - mean * mean, F.lit(0.0)))).alias("price_std"),
        F.when(F.col("k") > 0, F.log1p("k")).alias("prior_lots"),
        F.when(enough & three & (var_t > 1e-9), (F.col("stp") / k - F.col("st") / k * mean) / F.sqrt(F.nullif(F.greatest(var_t, F.lit(0.0)), F.lit(0.0)))).alias("price_trend"),
    )
    totals = daily.groupBy("artist").agg(F.sum("n").alias("artist_lot_count"))
    medians = earlier_medians(prices, ["artist"], "day", "p", min_lots)
    stats = stats.join(medians.select("artist", "day", F.col("median").alias("median_log_price")), ["artist", "day"], "left").join(totals, "artist")
    # lots are wide: one join brings them everything of their artist and day; without a day there is only the number of lots
    past = ["avg_log_price", "price_std", "prior_lots", "price_trend", "median_log_price"]
    stats = stats.select(F.col("artist").alias("_artist"), F.col("day").alias("_day"), *[F.when(t.isNotNull(), F.col(c)).alias(c) for c in past], "artist_lot_count")
    return (
        lots.join(stats, (lots["artist"] == stats["_artist"]) & day.eqNullSafe(stats["_day"])).drop("_artist", "_day")
        .withColumn("is_rare_artist", F.when(F.col("artist_lot_count") < min_lots, 1).otherwise(0))
    )


def lot_positions(lots: DataFrame, order: Sequence[str], chunk: Column) -> DataFrame:
    """The given lot number, else the lot's place in its auction."""
    ranked = with_row_number(lots, ["auction"], order, chunk, "_place")
    given = F.col("lot_number").cast("string").try_cast("int")
    return ranked.withColumn("lot_position", F.coalesce(given.cast("long"), F.col("_place"))).drop("_place")


def life_features(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Price at 75 % of the trades, move over the last tenth, and late share of the volume."""
    ranked = with_row_number(trades, ["condition_id"], ["ts", "trade_id"], time_chunk("ts", DAY), "rn")
    totals = trades.groupBy("condition_id").agg(F.count("*").alias("n"))
    rows = ranked.join(totals, "condition_id").join(markets.select("condition_id", "start_date", "end_date"), "condition_id")
    i, n = F.col("rn") - 1, F.col("n")
    tail = F.greatest(F.floor(n * 0.1), F.lit(2))
    at75 = F.when(n > 1, F.floor(n * 0.75)).otherwise(F.lit(0))
    usd = F.col("price") * F.col("size")
    life = F.unix_micros("end_date") - F.unix_micros("start_date")
    late_time = F.unix_micros("ts") >= F.unix_micros("start_date") + life * 0.75
    late = F.when(life > 0, late_time).otherwise(i >= F.floor(n * 0.75))

    def price_at(pos):
        return F.max(F.when(i == pos, F.col("price")))

    total = F.sum(usd)
    velocity = price_at(n - 1) - price_at(F.greatest(n - tail, F.lit(0)))
    return rows.groupBy("condition_id").agg(
        price_at(at75).alias("price_at_75pct"), F.when(F.max("n") >= 2, velocity).otherwise(0.0).alias("final_velocity"),
        F.when(total > 0, F.sum(F.when(late, usd).otherwise(0.0)) / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias("late_volume_ratio"))


def structural_breaks(series: DataFrame, key: Sequence[str], window: int = 24, sigma: float = 3.0, value: str = "price", at: str = "bucket") -> DataFrame:
    """Points where the mean of the next ``window`` values leaves the mean of the previous ones.

    A break is dropped when the next break of the series scores higher.
    """
    w = series_window(key, at)
    pre, post, whole = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1), Window.partitionBy(*key)
    x = F.col(value)
    scored = series.select(
        *key, at, F.avg(x).over(pre).alias("pre_mean"), F.avg(x).over(post).alias("post_mean"),
        F.var_pop(x).over(pre).alias("_v1"), F.var_pop(x).over(post).alias("_v2"),
        F.count(x).over(pre).alias("_n1"), F.row_number().over(w).alias("_i"), F.count("*").over(whole).alias("_n"),
    ).where((F.col("_n1") == window) & (F.col("_i") <= F.col("_n") - window))
    pooled = F.sqrt((F.col("_v1") + F.col("_v2")) / 2)
    scored = scored.withColumn("_std", pooled).where("_std >= 1e-10").withColumn("_gap", F.abs(F.col("post_mean") - F.col("pre_mean")))
    found = scored.where(F.col("_gap") >= sigma * F.col("_std")).select(
        *key, at, "pre_mean", "post_mean", F.col("_gap").alias("magnitude"), F.round(F.col("_gap") / F.col("_std"), 4).alias("sigma_score"),
        F.when(F.col("post_mean") > F.col("pre_mean"), "up").otherwise("down").alias("direction"))
    following = F.lead("sigma_score").over(w)
    return found.withColumn("_next", following).where("_next is null OR _next <= sigma_score").drop("_next")


def temporal_split(df: DataFrame, at: str, tie: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Earliest 70 % train, next 15 % validation, rest test; ranks are running counts over time slices."""
    ranked = with_row_number(df, [], [at, tie], time_chunk(at, DAY), "_rn")
    n = df.agg(F.count("*").alias("_n"))
    label = F.when(F.col("_rn") <= F.floor(F.col("_n") * train), "train").when(
        F.col("_rn") <= F.floor(F.col("_n") * (train + val)), "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(n)).withColumn("split", label).drop("_rn", "_n")


def with_thresholds(df: DataFrame, value: str, cuts: dict[str, float]) -> DataFrame:
    """Add exact quantiles of a column to every row (one row, broadcast)."""
    return df.crossJoin(F.broadcast(exact_quantiles(df, [], value, cuts)))


def market_buckets(markets: DataFrame) -> DataFrame:
    """Volume quartile and tercile, trade-count bin, duration bucket and liquidity regime."""
    v, days = F.col("volume_total"), seconds_between("end_date", "start_date") / DAY
    rows = with_thresholds(markets, "volume_total", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75, "_t1": 0.33, "_t2": 0.67})
    rows = with_thresholds(rows, "liquidity", {"_mid": 0.5})
    return rows.select(
        "condition_id",
        F.when(v <= F.col("_q1"), "Q1").when(v <= F.col("_q2"), "Q2").when(v <= F.col("_q3"), "Q3").otherwise("Q4").alias("volume_quartile"),
        F.when(v < F.col("_t1"), "low").when(v < F.col("_t2"), "medium").otherwise("high").alias("volume_bucket"),
        F.when(days < 7, "short").when(days < 30, "medium").otherwise("long").alias("duration_bucket"),
        F.when(F.col("liquidity") > F.col("_mid"), "high").otherwise("low").alias("liquidity_regime"))


def trade_bin(n: str) -> Column:
    c = F.col(n)
    return F.when(c < 10, "<10").when(c < 50, "10-49").when(c < 100, "50-99").when(c < 500, "100-499").otherwise("500+")


def shape_labels(steps: DataFrame, key: Sequence[str], ret: str = "log_return", volume: str = "volume_delta", at: str = "bucket") -> DataFrame:
    """Trajectory, momentum and volume class of each sequence (-1 when too short).

    trajectory 0 up, 1 down, 2 V-recovery, 3 mean-reverting; momentum 0 accelerating,
    1 decelerating, 2 steady; volume 0 front-loaded, 1 back-loaded, 2 uniform.
    """
    w = series_window(key, at)
    # rounded so that a flat stretch is a tie and its first point is the minimum
    cum = F.round(F.sum(ret).over(w.rowsBetween(Window.unboundedPreceding, 0)), 9)
    rows = steps.select(
        *key, F.col(ret).alias("r"), F.col(volume).alias("v"), cum.alias("cum"),
        F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*key)).alias("n"))
    half, third = F.floor(F.col("n") / 2), F.floor(F.col("n") / 3)

    def mean_abs(c, cond):
        return F.coalesce(F.avg(F.when(cond, F.abs(c))), F.lit(0.0))

    agg = rows.groupBy(*key).agg(
        F.max("n").alias("n"), F.max_by("cum", "i").alias("final"), F.min("cum").alias("low"), F.max("cum").alias("high"),
        F.min_by("i", F.struct("cum", "i")).alias("low_at"),
        mean_abs(F.col("r"), F.col("i") <= half).alias("e1"), mean_abs(F.col("r"), F.col("i") > half).alias("e2"),
        mean_abs(F.col("v"), F.col("i") <= third).alias("v1"), mean_abs(F.col("v"), F.col("i") > F.col("n") - third).alias("v2"))
    span = F.col("high") - F.col("low")
    trajectory = (
        F.when(F.col("n") < 8, -1).when((span > 0) & (F.abs("final") / F.nullif(span, F.lit(0.0)) < 0.2), 3)
        .when(((F.col("low_at") - 1) < F.col("n") * 0.6) & (F.col("final") > 0) & (F.col("low") < -0.3 * span), 2)
        .when(F.col("final") > 0, 0).otherwise(1))
    energy = F.col("e2") / F.greatest("e1", F.lit(1e-8))
    momentum = F.when(F.col("n") < 8, -1).when(F.col("e1") + F.col("e2") < 1e-8, 2).when(energy > 1.5, 0).when(energy < 0.67, 1).otherwise(2)
    load = F.col("v1") / F.greatest("v2", F.lit(1e-8))
    loading = F.when(F.col("n") < 6, -1).when(F.col("v1") + F.col("v2") < 1e-8, 2).when(load > 1.5, 0).when(load < 0.67, 1).otherwise(2)
    return agg.select(*key, trajectory.alias("trajectory"), momentum.alias("momentum"), loading.alias("volume_pattern"))


def next_price_label(targets: DataFrame, prices: DataFrame, trades: DataFrame, step_seconds: int, default: float = 0.5) -> DataFrame:
    """First price in [at, at + 2 steps): from prices, else from trades, else the default."""
    span = 2 * step_seconds
    out = asof_join(targets, prices, ["condition_id"], "at", {"_p": "price"}, "forward", right_on="ts", tie=["trade_id"], matched_at="_pt")
    out = asof_join(out, trades, ["condition_id"], "at", {"_q": "price"}, "forward", right_on="ts", tie=["trade_id"], matched_at="_qt")

    def inside(value, at):
        return F.when(seconds_between(at, "at") < span, F.col(value))

    return out.select(*targets.columns, F.coalesce(inside("_p", "_pt"), inside("_q", "_qt"), F.lit(default)).alias("next_price"))


FEATURES = ["log_return", "high_low", "ma_distance", "spread", "obi", "depth_ratio", "volume_delta", "open_interest_change",
            "sentiment", "news_velocity", "inverse_days_left", "sibling_return"]


def bar_features(
    markets: DataFrame, prices: DataFrame, books: DataFrame, trades: DataFrame, news: DataFrame, start: Column, end: Column,
    step: int, large_usd: float = 5000.0, normalize: bool = True,
) -> DataFrame:
    """Twelve features per (market, bar) on the regular grid [start, end), z-scored per market and feature.

    The grid is exploded per market; bars, books, volumes and news are aggregated to
    the grid before they are joined to it.
    """
    size = F.lit(step * 1_000_000)
    first = (F.floor(F.unix_micros(start) / size) * size).cast("long")
    grid = markets.select("condition_id", "event_slug", "end_date", F.explode(F.sequence(first, F.unix_micros(end) - 1, size)).alias("_us")).withColumn(
        "bucket", F.timestamp_micros("_us")).drop("_us")
    inside = lambda df, at: df.where((F.col(at) >= start) & (F.col(at) < end))
    when = F.struct("ts", "trade_id")
    bars = inside(prices.where("outcome = 'Yes'"), "ts").groupBy("condition_id", bucket("ts", step).alias("bucket")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", when).alias("close"), F.avg("bid").alias("bid"), F.avg("ask").alias("ask"))
    w = series_window(["condition_id"])
    prev, last12 = F.lag("close").over(w), w.rowsBetween(-11, 0)
    bars = bars.select(
        "condition_id", "bucket", "close",
        F.when(prev > 0, F.ln(F.col("close") / F.nullif(prev, F.lit(0.0)))).alias("log_return"), (F.col("high") - F.col("low")).alias("high_low"),
        F.when(F.count("*").over(last12) >= 12, F.col("close") - F.avg("close").over(last12)).alias("ma_distance"),
        F.when((F.col("bid") > 0) & (F.col("ask") > 0), F.col("ask") - F.col("bid")).alias("spread"))
    snap = F.struct("snapshot_time", "snapshot_id")
    depth = inside(books, "snapshot_time").groupBy("condition_id", bucket("snapshot_time", step).alias("bucket")).agg(
        F.max_by("bid_sizes", snap).alias("b"), F.max_by("ask_sizes", snap).alias("a"))
    total = array_sum("b") + array_sum("a")
    top1 = F.coalesce(F.nullif(F.get("b", F.lit(0)), F.lit(0.0)), F.lit(1.0))
    depth = depth.select("condition_id", "bucket", F.when(total > 0, (array_sum("b") - array_sum("a")) / F.nullif(total, F.lit(0.0))).alias("obi"),
                         (array_sum(F.slice("b", 1, 5)) / top1).alias("depth_ratio"))
    flow = inside(trades, "ts").groupBy("condition_id", bucket("ts", step).alias("bucket")).agg(
        F.sum("size").alias("v"), F.count_if(F.col("price") * F.col("size") >= large_usd).alias("large"))
    two = w.rowsBetween(-2, -1)
    flow = flow.select("condition_id", "bucket", "large", F.when((F.count("*").over(two) == 2) & (F.avg("v").over(two) > 0),
                                                                F.col("v") / F.nullif(F.avg("v").over(two), F.lit(0.0)) - 1).alias("volume_delta"))
    mood = news.groupBy("condition_id", bucket("hour", step).alias("bucket")).agg(
        F.avg("weighted_sentiment").alias("sentiment"), F.sum("article_count").alias("articles"))
    siblings = sibling_market(markets).select("condition_id", "sibling")
    rows = grid
    for part in (bars, depth, flow, mood):
        rows = rows.join(part, ["condition_id", "bucket"], "left")
    sib = bars.select(F.col("condition_id").alias("sibling"), "bucket", F.col("close").alias("sib_close"))
    rows = rows.join(siblings, "condition_id", "left").join(sib, ["sibling", "bucket"], "left")
    sib_prev = F.lag("sib_close").over(w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    raw = rows.select(
        "condition_id", "bucket", zero(F.col("log_return")).alias("log_return"), zero(F.col("high_low")).alias("high_low"),
        zero(F.col("ma_distance")).alias("ma_distance"), zero(F.col("spread")).alias("spread"), zero(F.col("obi")).alias("obi"),
        zero(F.col("depth_ratio")).alias("depth_ratio"), zero(F.col("volume_delta")).alias("volume_delta"), F.lit(0.0).alias("open_interest_change"),
        zero(F.col("sentiment")).alias("sentiment"), zero(F.coalesce(F.col("articles"), F.col("large")).cast("double")).alias("news_velocity"),
        (1.0 / F.greatest(seconds_between("end_date", "bucket") / DAY, F.lit(1.0))).alias("inverse_days_left"),
        zero(F.when(sib_prev > 0, F.ln(F.col("sib_close") / F.nullif(sib_prev, F.lit(0.0))))).alias("sibling_return"))
    if not normalize:
        return raw
    market = Window.partitionBy("condition_id")

    def z(c):
        std = F.stddev_pop(c).over(market)
        return F.when(std > 1e-8, (F.col(c) - F.avg(c).over(market)) / F.nullif(std, F.lit(0.0))).otherwise(F.col(c))

    return raw.select("condition_id", "bucket", *[z(c).alias(c) for c in FEATURES])
