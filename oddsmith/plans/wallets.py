"""Wallet scores, anomalies, coordinated pairs and the suspicion profile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago, clamp, key_id, seconds_between
from oddsmith.operators.pairs import shared_key_pairs
from oddsmith.plans import aggregates as A
from oddsmith.plans.time_joins import lookback_join
from oddsmith.session import cut_lineage

HOUR = 3600
DAY = 86400


def insider_scores(profiles: DataFrame, positions: DataFrame, markets: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    """Freshness, win rate, niche focus and size scores of every known or rated wallet, 0 to 100 each."""
    ages = profiles.select("wallet", F.floor(seconds_between(as_of, "profile_created_at") / DAY).alias("age"))
    rates = A.wallet_win_rate(positions, markets).select("wallet", "win_rate")
    ratios = A.size_vs_liquidity(positions, markets)
    niche = activity.where((F.col("activity_type") == "TRADE") & (F.col("ts") >= ago(as_of, 30 * DAY))).groupBy("wallet").agg(
        F.count_distinct("condition_id").alias("diversity"))
    rows = ages.join(rates, "wallet", "full_outer").join(ratios, "wallet", "left").join(niche, "wallet", "left")
    age, wr, ratio = F.coalesce("age", F.lit(999)), F.coalesce("win_rate", F.lit(0.0)), F.coalesce("size_ratio", F.lit(0.0))
    d = F.coalesce("diversity", F.lit(0))
    parts = {
        "freshness": F.when(age <= 30, 100 * (1 - age / 30)).otherwise(0.0),
        "win_rate_score": F.when(wr >= 0.75, F.least(F.lit(100.0), (wr - 0.5) * 200)).otherwise(0.0),
        "niche": F.when((d > 0) & (d <= 3), 80.0).when(d <= 5, 40.0).otherwise(0.0),
        "size_score": F.when(ratio > 0.1, F.least(F.lit(100.0), ratio * 500)).otherwise(0.0),
        "timing": F.lit(0.0),
    }
    scored = rows.select("wallet", *[c.alias(n) for n, c in parts.items()])
    weights = {"freshness": 0.20, "win_rate_score": 0.30, "niche": 0.15, "size_score": 0.25, "timing": 0.10}
    return scored.withColumn("score", sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def pre_news_events(prices: DataFrame, markets: DataFrame, resolutions: DataFrame, as_of: Column, seconds: int = DAY, bucket_seconds: int = HOUR, move: float = 0.20) -> DataFrame:
    """Large moves inside a bucket plus resolutions, with market metadata."""
    slot = F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000))
    when = F.struct("ts", "trade_id")
    moved = prices.where(F.col("ts") >= ago(as_of, seconds)).groupBy("condition_id", slot.alias("slot")).agg(
        F.min_by("price", when).alias("price_before"), F.max_by("price", when).alias("price_after"), F.min("ts").alias("window_start"),
        F.max("ts").alias("window_end"), F.sum(F.col("volume") * F.col("price")).alias("volume_during"))
    pct = (F.col("price_after") - F.col("price_before")) / F.greatest("price_before", F.lit(0.01))
    moved = moved.withColumn("pct", pct).where(F.abs("pct") > move).select(
        "condition_id", F.lit("price_move").alias("event_type"), F.abs("pct").alias("magnitude"),
        F.when(F.col("pct") > 0, "up").otherwise("down").alias("direction"), "price_before", "price_after", "volume_during", "window_start", "window_end")
    yes = F.col("winning_outcome") == "Yes"
    done = resolutions.where((F.col("resolved_at") >= ago(as_of, seconds)) & (F.col("resolved_at") <= as_of)).select(
        "condition_id", F.lit("resolution").alias("event_type"), F.lit(1.0).alias("magnitude"), F.when(yes, "up").otherwise("down").alias("direction"),
        F.lit(0.0).alias("price_before"), F.when(yes, 1.0).otherwise(0.0).alias("price_after"), F.lit(0.0).alias("volume_during"),
        F.col("resolved_at").alias("window_start"), F.col("resolved_at").alias("window_end"))
    events = moved.unionByName(done).withColumn("event_id", key_id("condition_id", "event_type", F.unix_micros("window_start")))
    return events.join(markets.select("condition_id", "category", "event_slug", "question"), "condition_id", "left")


def pre_news_trades(events: DataFrame, activity: DataFrame, newest: int = 200) -> DataFrame:
    """Score the newest trades of the day before each event by timing, side and size."""
    keep = activity.where("activity_type = 'TRADE'").select("condition_id", "wallet", "side", "size", "usdc_size", "price", "transaction_hash", "ts")
    hits = lookback_join(events.select("event_id", "condition_id", "direction", "magnitude", "window_start"), keep, ["condition_id"], ["event_id"],
                         ["ts", "transaction_hash"], DAY, newest)
    hours = F.greatest(seconds_between("window_start", "ts") / 3600, F.lit(0.0))
    correct = ((F.col("direction") == "up") & (F.col("side") == "BUY")) | ((F.col("direction") == "down") & (F.col("side") == "SELL"))
    rows = hits.withColumns({"hours_before": hours, "correct": F.when(correct, 1).otherwise(0)})
    timing = 100.0 * F.pow(F.lit(2.0), -F.col("hours_before") / 4)
    bonus = F.when(F.col("usdc_size") > 0, F.least(F.lit(30.0), F.col("usdc_size") / 500)).otherwise(0.0)
    is_correct = F.col("correct") == 1
    score = timing * F.when(is_correct, 1.5).otherwise(0.3) + F.when(is_correct, bonus).otherwise(0.0) + F.col("magnitude") * 50
    return rows.withColumn("pre_news_score", clamp(score, 0.0, 100.0))


def wallet_toxic_flow(activity: DataFrame, micro: DataFrame, as_of: Column, days: int = 7, min_trades: int = 3) -> DataFrame:
    """Mean latest toxic ratio of the markets a wallet traded in, weighted by its trades."""
    latest = micro.groupBy("condition_id").agg(F.max_by("toxic_flow_ratio", "snapshot_time").alias("toxic"))
    per_market = activity.where((F.col("activity_type") == "TRADE") & (F.col("ts") >= ago(as_of, days * DAY))).groupBy("wallet", "condition_id").agg(
        F.count("*").alias("n"))
    return per_market.join(latest, "condition_id").groupBy("wallet").agg(
        (F.sum(F.col("toxic") * F.col("n")) / F.sum("n")).alias("toxic_flow"), F.sum("n").alias("n")).where(F.col("n") >= min_trades).drop("n")


def _population(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row of mean and population deviation (at least 0.001; 1 for fewer than two rows)."""
    out = []
    for name, c in cols.items():
        std = F.when(F.count(c) < 2, 1.0).otherwise(F.greatest(F.stddev_pop(c), F.lit(0.001)))
        out += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"pop_mean_{name}"), std.alias(f"pop_std_{name}")]
    return df.agg(*out)


def wallet_anomalies(stats: DataFrame, rates: DataFrame, rois: DataFrame, toxic: DataFrame, threshold: float = 2.0) -> DataFrame:
    """z-scores of each wallet against the population and the anomaly score built from them."""
    rows = stats.join(rates.select("wallet", "win_rate"), "wallet", "left").join(rois.select("wallet", "roi"), "wallet", "left").join(toxic, "wallet", "left")
    for pop in (
        _population(stats, {"count": "trade_count", "size": "avg_size", "diversity": "unique_markets"}),
        _population(rates, {"win": "win_rate"}), _population(rois, {"roi": "roi"}),
    ):
        rows = rows.crossJoin(F.broadcast(pop))  # one row each

    def z(c, name):
        return (F.coalesce(c, F.lit(0.0)) - F.col(f"pop_mean_{name}")) / F.col(f"pop_std_{name}")

    rows = rows.select(
        "wallet", F.abs(z("trade_count", "count")).alias("z_count"), F.abs(z("avg_size", "size")).alias("z_size"),
        F.abs(z("unique_markets", "diversity")).alias("z_diversity"), z("win_rate", "win").alias("z_win_rate"), z("roi", "roi").alias("z_roi"),
        F.coalesce("toxic_flow", F.lit(0.0)).alias("toxic_flow"))
    zs = ["z_count", "z_size", "z_diversity", "z_win_rate", "z_roi"]
    exceeded = sum((F.when(F.abs(F.col(c)) > threshold, 1).otherwise(0) for c in zs), F.lit(0))
    toxic_bonus = F.when(F.col("toxic_flow") > 0.3, F.least(F.lit(15.0), F.col("toxic_flow") * 30)).otherwise(0.0)
    extra = [F.greatest(F.col(c) - threshold, F.lit(0.0)) * 10 for c in ("z_win_rate", "z_roi")]
    return rows.withColumn("exceeded", exceeded).withColumn(
        "statistical_score", clamp(F.col("exceeded") * 20.0 + extra[0] + extra[1] + toxic_bonus, 0.0, 100.0))


def profitability_scores(focus: DataFrame, rois: DataFrame) -> DataFrame:
    roi, share = F.coalesce("roi", F.lit(0.0)), F.col("focus_share")
    rate = F.col("focus_wins") / F.nullif("focus_positions", F.lit(0))
    score = (
        F.when(roi > 0.5, F.least(F.lit(40.0), roi * 20)).otherwise(0.0) + F.when(share > 0.3, share * 30).otherwise(0.0)
        + F.when((F.col("focus_positions") >= 3) & (rate > 0.7), (rate - 0.5) * 60).otherwise(0.0))
    return focus.join(rois.select("wallet", "roi"), "wallet", "left").select("wallet", "focus_share", clamp(score, 0.0, 100.0).alias("profitability_score"))


def _pair_parts(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What two wallets of one market add to their pair; a null amount leaves the other one."""
    out = {"agree": a["side"] == b["side"], "cross": a["trades"] * b["trades"]}
    if "usd" in a:
        low, high = np.fmin(a["usd"], b["usd"]), np.fmax(a["usd"], b["usd"])
        rated = high > 0
        out |= {"ratios": np.divide(low, high, out=np.zeros(len(low)), where=rated), "rated": rated}
    return out


#: sides that are compared by a product of matrices each
SIDES = 16


def _pair_products(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The sums of ``_pair_parts`` over the markets of (wallet, market) matrices, for all pairs of their rows."""
    times = lambda x, y: x.astype(np.float32) @ y.astype(np.float32).T  # noqa: E731, counts below 2 ** 24
    held, other = a["held"], b["held"]
    sides = np.intersect1d(a["side"][held], b["side"][other])
    if len(sides) <= SIDES:
        agree = sum((times(held & (a["side"] == s), other & (b["side"] == s)) for s in sides), np.zeros((len(held), len(other))))
    else:
        agree = np.zeros((len(held), len(other)))
        for k in range(held.shape[1]):
            agree += held[:, k, None] & other[:, k] & (a["side"][:, k, None] == b["side"][:, k])
    out = {"agree": agree, "cross": a["trades"].astype(float) @ b["trades"].astype(float).T}
    if "usd" not in a:
        return out
    good = [x["usd"] > 0 for x in (a, b)]
    poor = [x["held"] & ~g for x, g in zip((a, b), good)]
    usd = [np.where(g, x["usd"], 0.0) for x, g in zip((a, b), good)]
    inverse = [np.divide(1.0, u, out=np.zeros(u.shape), where=g) for u, g in zip(usd, good)]
    ratios = np.empty(agree.shape)
    for i, (mine, turned) in enumerate(zip(usd[0], inverse[0])):
        k = np.flatnonzero(good[0][i])
        up, down = usd[1].T[k], inverse[1].T[k]
        up *= turned[k, None]
        down *= mine[k, None]
        # 0 where the other wallet has no such amount
        np.minimum(up, down, out=up).sum(axis=0, out=ratios[i])
    if poor[0].any() or poor[1].any():
        none = [x["held"] & np.isnan(x["usd"]) for x in (a, b)]
        owed = [np.where(p & ~n, x["usd"], 0.0) for x, p, n in zip((a, b), poor, none)]
        ratios += times(good[0], none[1]) + times(none[0], good[1]) + inverse[0] @ owed[1].T + owed[0] @ inverse[1].T
    return out | {"ratios": ratios, "rated": times(held, other) - times(*poor)}


CLUSTER_WEIGHTS = {"overlap": 0.3, "direction": 0.4, "timing": 0.3}
GROUP_WEIGHTS = {"overlap": 0.25, "direction": 0.30, "timing": 0.30, "size_similarity": 0.15}


def _score(weights: dict[str, float], parts) -> Column:
    return sum((w * parts[c] for c, w in list(weights.items())[1:]), next(iter(weights.values())) * parts[next(iter(weights))])


def _at_least(weights: dict[str, float], least: float):
    """Test of the numbers of pairs in their cell: scores that may reach ``least``, with room for rounding."""
    def keep(n: dict[str, np.ndarray]) -> np.ndarray:
        parts = {"overlap": n["common"] / (n["n_a"] + n["n_b"] - n["common"]), "direction": n["agree"] / n["common"], "timing": n["matches"] / n["cross"]}
        if "size_similarity" in weights:
            parts["size_similarity"] = np.divide(n["ratios"], n["rated"], out=np.zeros(len(n["rated"])), where=n["rated"] != 0)
        return ~(_score(weights, parts) < least - 1e-6)  # a NaN is left to the query
    return keep


def wallet_pairs(
    activity: DataFrame, as_of: Column, seconds: int = DAY, within: int = 60, min_shared: int = 3, min_trades: int = 1,
    weights: dict[str, float] | None = None, least: float | None = None,
) -> DataFrame:
    """Similarity parts of every wallet pair that shares ``min_shared`` markets.

    overlap (Jaccard), direction (same last side), size (ratio of last amounts) come from
    one row per (wallet, market).  Timing needs the pairs of trades within ``within``
    seconds: those are counted in the cells of the pairs, all others only through the
    product of the two trade counts.  Who asks for scores of ``least`` by ``weights`` gets
    no pairs far below and no parts without a weight.
    """
    recent = activity.where((F.col("activity_type") == "TRADE") & (F.col("ts") >= ago(as_of, seconds)) & (F.col("side") != ""))
    if min_trades > 1:
        busy = recent.groupBy("wallet").agg(F.count("*").alias("n")).where(F.col("n") >= min_trades)
        recent = recent.join(busy, "wallet", "left_semi")
    last = F.struct("ts", "transaction_hash")
    items = recent.groupBy("wallet", "condition_id").agg(
        F.count("*").alias("trades"), F.max_by("side", last).alias("side"), F.max_by("usdc_size", last).alias("usd"), F.sum("usdc_size").alias("volume"))
    items = items.withColumns({"volume": F.sum("volume").over(Window.partitionBy("wallet")), "side": F.xxhash64("side")})
    sizes = weights is None or "size_similarity" in weights
    rows = shared_key_pairs(
        items, "wallet", "condition_id", min_shared, ["trades", "side", "usd"] if sizes else ["trades", "side"],
        ["agree", "cross", "ratios", "rated"] if sizes else ["agree", "cross"], _pair_parts, ["volume"], products=_pair_products,
        events=recent.select(F.col("wallet").alias("m"), F.col("condition_id").alias("k"), F.unix_micros("ts").alias("at")), within=within * 1_000_000,
        keep=None if weights is None else _at_least(weights, least))
    parts = {
        "overlap": F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")), "direction": F.col("agree") / F.col("common"), "timing": F.col("matches") / F.col("cross"),
        "size_similarity": F.coalesce(F.col("ratios") / F.nullif("rated", F.lit(0.0)), F.lit(0.0)) if sizes else None}
    return rows.select("a", "b", "common", *[c.alias(n) for n, c in parts.items() if c is not None], (F.col("volume_a") + F.col("volume_b")).alias("total_volume"))


def wallet_clusters(pairs: DataFrame, min_similarity: float = 0.6) -> DataFrame:
    return pairs.withColumn("similarity", _score(CLUSTER_WEIGHTS, {c: F.col(c) for c in CLUSTER_WEIGHTS})).where(F.col("similarity") >= min_similarity).withColumn("cluster_id", key_id("a", "b")).drop("size_similarity")


def group_ids(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("group_id", key_id("a", "b"))


def coordinated_groups(pairs: DataFrame, min_score: float = 0.7) -> DataFrame:
    return pairs.withColumn("coordination", _score(GROUP_WEIGHTS, {c: F.col(c) for c in GROUP_WEIGHTS})).where(F.col("coordination") >= min_score).transform(group_ids)


#: wallets up to which their suspicion is sent to all executors
SENT_WALLETS = 1 << 20


def coordination_scores(groups: DataFrame) -> DataFrame:
    """Best group score per wallet, 0 to 100."""
    both = groups.select(F.explode(F.array("a", "b")).alias("wallet"), "coordination")
    return both.groupBy("wallet").agg(clamp(F.max("coordination") * 100, 0.0, 100.0).alias("coordination_score"))


def suspicion_profiles(stats: DataFrame, pre_news: DataFrame, anomalies: DataFrame, profits: DataFrame, coordination: DataFrame) -> DataFrame:
    """Five weighted parts and a tier for every wallet with enough trades."""
    news = pre_news.groupBy("wallet").agg(F.avg("pre_news_score").alias("s"), F.avg("correct").alias("c"), F.count("*").alias("flagged_trades")).select(
        "wallet", "flagged_trades", clamp(F.col("s") * (1 + F.col("c")), 0.0, 100.0).alias("pre_news"))
    rows = (
        stats.where("trade_count >= 5").select("wallet", "trade_count")
        .join(news, "wallet", "left").join(anomalies.select("wallet", F.col("statistical_score").alias("statistical")), "wallet", "left")
        .join(profits.select("wallet", F.col("profitability_score").alias("profitability"), clamp(F.col("focus_share") * 100, 0.0, 100.0).alias("focus")), "wallet", "left")
        .join(coordination.select("wallet", F.col("coordination_score").alias("coordination")), "wallet", "left")
        .na.fill(0.0, ["pre_news", "statistical", "profitability", "coordination", "focus"]).na.fill(0, ["flagged_trades"])
    )
    weights = {"pre_news": 0.30, "statistical": 0.25, "profitability": 0.20, "coordination": 0.15, "focus": 0.10}
    rows = rows.withColumn("suspicion", clamp(sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0)), 0.0, 100.0))
    s = F.col("suspicion")
    return rows.withColumn("tier", F.when(s >= 75, "critical").when(s >= 50, "high").when(s >= 25, "medium").otherwise("low"))


def flag_trades(pre_news: DataFrame, profiles: DataFrame) -> DataFrame:
    """Write the wallet scores back onto the scored trades."""
    cols = ["statistical", "profitability", "coordination", "suspicion"]
    return pre_news.join(profiles.select("wallet", *cols), "wallet", "left").na.fill(0.0, cols)


def flag_groups(groups: DataFrame, profiles: DataFrame) -> DataFrame:
    """Mean suspicion of the members of each group.

    Groups are far more than wallets: they are never shuffled by group, and not by wallet while those are few.
    """
    found = cut_lineage(profiles.groupBy("wallet").agg(F.sum(F.coalesce("suspicion", F.lit(0.0))).alias("_s"), F.count("*").alias("_n")))
    if found.count() <= SENT_WALLETS:
        found = F.broadcast(found)
    both = groups
    for x in "ab":
        both = both.join(found.select(F.col("wallet").alias(x), F.col("_s").alias(f"_s{x}"), F.col("_n").alias(f"_n{x}")), x, "left")
    total = F.coalesce("_sa", F.lit(0.0)) + F.coalesce("_sb", F.lit(0.0))
    return both.withColumn("avg_suspicion", total / (F.coalesce("_na", F.lit(1)) + F.coalesce("_nb", F.lit(1)))).select(*groups.columns, "avg_suspicion")
