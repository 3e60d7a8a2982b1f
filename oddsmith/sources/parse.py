"""Raw JSON records to typed rows.  Each takes a frame with the record text in ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith import schemas

FAR_FUTURE = "2099-01-01 00:00:00"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _num(*cols: str) -> Column:
    """First non-zero of the columns, else 0."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in cols], F.lit(0.0))


def _flag(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)


def _time(c: str, default: str | None) -> Column:
    parsed = F.try_to_timestamp(F.col(c))
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("timestamp"))


def _list(c: str) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _index(c: str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))


def _record(raw: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in raw.columns if c != "value"]
    return raw.select(*keep, F.from_json("value", schema).alias("r")).select(*keep, "r.*")


def flatten_markets(raw: DataFrame) -> DataFrame:
    """One row per market of each event; records without conditionId are dropped."""
    events = raw.select(F.from_json("value", schemas.RAW_EVENT).alias("e"))
    m = events.select(
        F.col("e.id").alias("_event_id"), F.col("e.title").alias("_event_title"), F.col("e.slug").alias("_event_slug"),
        F.filter(F.transform(F.coalesce("e.tags", F.array()), lambda t: t["label"]), lambda x: x.isNotNull()).alias("tags"),
        F.explode("e.markets").alias("m"),
    ).select("_event_id", "_event_title", "_event_slug", "tags", "m.*")
    m = m.where(F.coalesce("conditionId", F.lit("")) != "")
    m = m.withColumns({
        "outcome_list": _list("outcomes"),
        "price_list": F.transform(_list("outcomePrices"), lambda x: x.cast("double")),
        "token_ids": _list("clobTokenIds"),
    })
    closed = F.coalesce("closed", F.lit(False))
    # first position priced exactly 1, 0 when there is none
    winner = F.array_position("price_list", F.lit(1.0))
    return m.select(
        F.col("conditionId").alias("condition_id"), _text("slug").alias("market_slug"), _text("question").alias("question"),
        _text("description").alias("description"), _text("_event_id").alias("event_id"),
        _text("_event_title").alias("event_title"), _text("_event_slug").alias("event_slug"),
        _flag("negRisk").alias("neg_risk"), F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("")).alias("category"), "tags",
        F.col("outcome_list").alias("outcomes"), F.col("price_list").alias("outcome_prices"), "token_ids",
        _flag("active").alias("active"), _flag(closed).alias("closed"),
        _flag(closed & (F.col("umaResolutionStatus") == "resolved")).alias("resolved"),
        _text("resolutionSource").alias("resolution_source"),
        F.when(closed & (winner > 0), F.coalesce(F.try_element_at("outcome_list", winner.cast("int")), F.lit(""))).otherwise("").alias("winning_outcome"),
        _num("volume24hr").alias("volume_24h"), _num("volumeNum", "volume").alias("volume_total"),
        _num("liquidityNum", "liquidity").alias("liquidity"), _num("volume1wk").alias("volume_1wk"),
        _num("volume1mo").alias("volume_1mo"), _num("competitive").alias("competitive_score"),
        _num("oneDayPriceChange").alias("one_day_price_change"), _num("oneWeekPriceChange").alias("one_week_price_change"),
        _time("startDate", FAR_FUTURE).alias("start_date"), _time("endDate", FAR_FUTURE).alias("end_date"),
        _time("createdAt", FAR_FUTURE).alias("created_at"),
    )


def parse_trades(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, quarantine): a record whose time does not parse is set aside, not dated now."""
    r = _record(raw, schemas.RAW_TRADE).where(F.coalesce("conditionId", F.lit("")) != "")
    rows = r.select(
        F.col("conditionId").alias("condition_id"), _text("asset").alias("token_id"), _text("outcome").alias("outcome"),
        _num("price").alias("price"), _num("size").alias("size"),
        F.when(F.upper("side") == "BUY", "buy").otherwise("sell").alias("side"),
        _text("transactionHash").alias("trade_id"), _time("timestamp", None).alias("ts"), F.col("timestamp").alias("raw_time"),
    )
    return rows.where("ts is not null").drop("raw_time"), rows.where("ts is null").drop("ts")


def parse_leaderboard(raw: DataFrame, category: str, period: str, order_by: str) -> DataFrame:
    return _record(raw, schemas.RAW_LEADER).select(
        _text("proxyWallet").alias("proxy_wallet"), _text("userName").alias("user_name"), F.coalesce("rank", F.lit(0)).alias("rank"),
        F.lit(category).alias("category"), F.lit(period).alias("time_period"), F.lit(order_by).alias("order_by"),
        _num("pnl").alias("pnl"), _num("vol").alias("volume"), _flag("verifiedBadge").alias("verified_badge"),
        _text("xUsername").alias("x_username"),
    )


def parse_positions(raw: DataFrame) -> DataFrame:
    r = _record(raw, schemas.RAW_POSITION)
    return r.select(
        _text("proxyWallet").alias("proxy_wallet"), _text("conditionId").alias("condition_id"), _text("asset").alias("asset"),
        _text("outcome").alias("outcome"), _index("outcomeIndex").alias("outcome_index"), _num("size").alias("size"),
        _num("avgPrice").alias("avg_price"), _num("initialValue").alias("initial_value"), _num("currentValue").alias("current_value"),
        _num("curPrice").alias("cur_price"), _num("cashPnl").alias("cash_pnl"), _num("percentPnl").alias("percent_pnl"),
        _num("realizedPnl").alias("realized_pnl"), _text("title").alias("title"), _text("slug").alias("market_slug"),
        _time("endDate", FAR_FUTURE).alias("end_date"),
    )


def parse_activity(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = _record(raw, schemas.RAW_ACTIVITY).select(
        _text("proxyWallet").alias("proxy_wallet"), _text("conditionId").alias("condition_id"), _text("asset").alias("asset"),
        F.coalesce("type", F.lit("TRADE")).alias("activity_type"), F.upper(_text("side")).alias("side"), _text("outcome").alias("outcome"),
        _index("outcomeIndex").alias("outcome_index"), _num("size").alias("size"), _num("usdcSize").alias("usdc_size"),
        _num("price").alias("price"), _text("transactionHash").alias("transaction_hash"), _text("title").alias("title"),
        _text("slug").alias("market_slug"), _time("timestamp", None).alias("ts"),
    )
    return r.where("ts is not null"), r.where("ts is null").drop("ts")


def parse_holders(raw: DataFrame) -> DataFrame:
    """Holder groups (one per token of a market) to one row per holder; needs condition_id beside value."""
    return (
        _record(raw, schemas.RAW_HOLDERS)
        .select("condition_id", _text("token").alias("token_id"), F.explode("holders").alias("h"))
        .select("condition_id", "token_id", "h.*")
        .select(
            "condition_id", "token_id", _text("proxyWallet").alias("proxy_wallet"), _text("pseudonym").alias("pseudonym"),
            _index("outcomeIndex").alias("outcome_index"), _num("amount").alias("amount"),
        )
    )


def parse_profiles(raw: DataFrame, discovered_via: str = "leaderboard") -> DataFrame:
    return _record(raw, schemas.RAW_PROFILE).select(
        _text("proxyWallet").alias("proxy_wallet"), _text("pseudonym").alias("pseudonym"), _text("name").alias("name"),
        _text("bio").alias("bio"), _text("xUsername").alias("x_username"), _flag("verifiedBadge").alias("verified_badge"),
        _flag("displayUsernamePublic").alias("display_username_public"),
        _time("createdAt", "1970-01-01 00:00:00").alias("profile_created_at"), F.lit(discovered_via).alias("discovered_via"),
    )


def levels(c: str, field: str) -> Column:
    """One array of a book side; a level that lacks the field is left out of this array only."""
    present = F.filter(F.coalesce(F.col(c), F.array()), lambda x: x[field].isNotNull())
    return F.transform(present, lambda x: x[field].cast("double"))


def parse_orderbooks(raw: DataFrame) -> DataFrame:
    r = _record(raw, schemas.RAW_BOOK)
    return r.select(
        _text("market").alias("condition_id"), _text("asset_id").alias("token_id"),
        levels("bids", "price").alias("bid_prices"), levels("bids", "size").alias("bid_sizes"),
        levels("asks", "price").alias("ask_prices"), levels("asks", "size").alias("ask_sizes"),
        F.timestamp_millis(F.col("timestamp").cast("long")).alias("snapshot_time"),
    )
