"""Structured Streaming jobs.  Each takes streaming frames and is the counterpart of a batch plan.

Outputs are written as files per batch, so a repeated batch replaces its own files; all
folders live under the checkpoint folder of the session, which executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith import schemas
from oddsmith.operators.bars import merge_bars, partial_bars
from oddsmith.operators.ordered import time_chunk, with_neighbor
from oddsmith.operators.versions import latest_version, order_key
from oddsmith.plans.lifecycle import scan_transitions, status_kinds
from oddsmith.session import cut_lineage, ensure_checkpoint_dir
from oddsmith.sources.parse import levels
from oddsmith.streaming.runs import Runs


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint area."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


#: files of a table folder taken in one micro-batch, so a backlog does not become one batch
FILES_PER_TRIGGER = 256


def table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Stream one table of a data folder, whether it is a Parquet file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return file_stream(spark, f"{folder}/{name}.parquet", schema, files_per_trigger=files_per_trigger)
    return file_stream(spark, folder, schema, f"{name}.parquet")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode query over what is available and return what it wrote."""
    spark = stream.sparkSession
    root = scratch(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], Any], mode: str = "append", root: str | None = None) -> str:
    """Run ``write(batch, id, root)`` for every batch; returns the root folder."""
    root = root or scratch(stream.sparkSession, name)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
         .foreachBatch(lambda df, i: write(df, i, root)).start())
    q.awaitTermination()
    return root


# ---- router -----------------------------------------------------------------


def _number(c) -> Any:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("0")).cast("double")


def parse_messages(raw: DataFrame) -> DataFrame:
    m = raw.select(F.from_json("value", schemas.SOCKET_MESSAGE).alias("m")).select("m.*")
    return m.withColumn("ts", F.timestamp_millis(F.col("timestamp").cast("long")))


def message_trades(messages: DataFrame) -> DataFrame:
    side = F.when(F.coalesce(F.upper("side"), F.lit("BUY")) == "BUY", "buy").otherwise("sell")
    return messages.where("event_type = 'last_trade_price'").select(
        F.col("market").alias("condition_id"), F.col("asset_id").alias("token_id"), _number("price").alias("price"), _number("size").alias("size"), side.alias("side"),
        F.concat_ws("-", F.lit("ws"), "asset_id", F.unix_millis("ts")).alias("trade_id"), "ts")


def message_prices(messages: DataFrame) -> DataFrame:
    """Price rows of trades (one each) and of price changes (one per change), in one pass."""
    change = F.col("c")
    single = F.array(F.struct(F.col("asset_id").alias("asset_id"), F.col("price").alias("price"), F.lit("0").alias("best_bid"), F.lit("0").alias("best_ask")))
    rows = messages.where("event_type IN ('last_trade_price', 'price_change')").withColumn(
        "c", F.explode(F.when(F.col("event_type") == "price_change", F.col("price_changes")).otherwise(single)))
    return rows.select(
        F.col("market").alias("condition_id"), change["asset_id"].alias("token_id"), _number(change["price"]).alias("price"), _number(change["best_bid"]).alias("bid"),
        _number(change["best_ask"]).alias("ask"), "ts")


def message_books(messages: DataFrame) -> DataFrame:
    return messages.where("event_type = 'book'").select(
        F.col("market").alias("condition_id"), F.col("asset_id").alias("token_id"), levels("buys", "price").alias("bid_prices"), levels("buys", "size").alias("bid_sizes"),
        levels("sells", "price").alias("ask_prices"), levels("sells", "size").alias("ask_sizes"), F.col("ts").alias("snapshot_time"))


ROUTES = {"market_trades": message_trades, "market_prices": message_prices, "orderbook_snapshots": message_books}


def route_messages(raw: DataFrame, root: str | None = None) -> str:
    """Write the three tables from one stream of socket messages."""

    def write(batch: DataFrame, i: int, root: str) -> None:
        messages = parse_messages(batch).persist()
        try:
            for name, route in ROUTES.items():
                route(messages).write.mode("overwrite").parquet(f"{root}/{name}/batch={i}")
        finally:
            messages.unpersist()

    return run_batches(raw, "router", write, root=root)


# ---- aggregates -------------------------------------------------------------


def _side(name: str) -> Any:
    return F.sum(F.when(F.col("side") == name, F.col("size")).otherwise(0.0))


def streaming_bars(trades: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars of closed windows (append mode): emitted once the watermark passes their end; they merge in ``rollup_bars``."""
    when = order_key(trades, "ts", "trade_id")
    return (
        trades.withWatermark("ts", delay).groupBy("condition_id", "outcome", F.window("ts", width).alias("w")).agg(
            F.min_by("price", when).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", when).alias("close"),
            F.sum("size").alias("volume"), F.count("*").alias("trade_count"), _side("buy").alias("buy_volume"), _side("sell").alias("sell_volume"),
            F.min("ts").alias("open_ts"), F.max("ts").alias("close_ts"))
        .select("condition_id", "outcome", F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "volume", "trade_count", "buy_volume", "sell_volume", "open_ts", "close_ts"))


def rolling_flow(trades: DataFrame, width: str = "5 minutes", slide: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Buy and sell volume over sliding windows."""
    return (
        trades.withWatermark("ts", delay).groupBy("condition_id", F.window("ts", width, slide).alias("w")).agg(
            _side("buy").alias("buy_volume"), _side("sell").alias("sell_volume"), F.count("*").alias("trade_count"))
        .select("condition_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "buy_volume", "sell_volume", "trade_count"))


def streaming_latest_price(trades: DataFrame, root: str | None = None) -> DataFrame:
    """Latest price per market and outcome: updates are appended, the newest one wins at read."""
    latest = trades.groupBy("condition_id", "outcome").agg(F.max(F.struct("ts", "trade_id", "price")).alias("l")).select("condition_id", "outcome", "l.*")

    def write(batch: DataFrame, i: int, root: str) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/latest/batch={i}")

    root = run_batches(latest, "latest-price", write, mode="update", root=root)
    stored = trades.sparkSession.read.schema(latest.schema).parquet(f"{root}/latest/*")
    return latest_version(stored, ["condition_id", "outcome"], ["ts", "trade_id"])


def dedup_trades(trades: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of (trade_id, token_id); one transaction may hold fills of several tokens."""
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trade_id", "token_id"])


# ---- keyed state ------------------------------------------------------------


def run_keyed(stream: DataFrame, name: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], out: str, state: str, merge: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """Run ``step(batch, state before it) -> (rows out, state rows changed)`` for every batch and return all rows out.

    A batch is an ordinary frame: its work is joins and combined aggregates over many tasks, also
    for one key.  State is kept in ``Runs``; rows and state are named by the batch, so a repeated batch
    replaces its own, and a later run with the same root goes on where the last one ended.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, i: int, root: str) -> None:
        runs = Runs(batch.sparkSession, f"{root}/state", state, merge)
        batch = batch.persist()
        try:
            rows, changed = step(batch, runs.before(i))
            rows.write.mode("overwrite").parquet(f"{root}/out/batch={i}")
            runs.add(i, changed)
        finally:
            batch.unpersist()

    root = run_batches(stream, name, write, root=root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(f"{root}/out/batch=*")


def high_water_trades(trades: DataFrame, root: str | None = None) -> DataFrame:
    """The strict variant: a trade not newer than the newest one of its market before this batch is dropped.

    Late rows and fills of the same time are lost, as in the source; the first row of a tie (by trade_id)
    stays.  Ties are settled by (market, time), so a market with most of a batch runs over many tasks;
    only its newest time meets in one row.
    """
    first = F.struct("trade_id", "price", "size")

    def step(batch: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        kept = batch.groupBy("condition_id", "ts").agg(F.min(first).alias("f"))
        newest = batch.groupBy("condition_id").agg(F.max("ts").alias("seen"))
        fresh = kept.join(seen, "condition_id", "left").where(F.col("seen").isNull() | (F.col("ts") > F.col("seen")))
        return fresh.select("condition_id", "f.trade_id", "ts", "f.price", "f.size"), newest

    cols = trades.select("condition_id", "trade_id", "ts", "price", "size")
    return run_keyed(cols, "high-water", step, "condition_id long, trade_id long, ts timestamp, price double, size double", "condition_id long, seen timestamp", lambda df: df.groupBy("condition_id").agg(F.max("seen").alias("seen")), root)


def status_changes(snapshots: DataFrame, root: str | None = None) -> DataFrame:
    """created, resolved and closed events from snapshots(market, ts, snapshot_id, closed, resolved).

    The newest snapshot of each market is kept; it stands before the batch's rows, which are compared
    with their neighbours in time slices.  Snapshots come in order over batches, in any order within.
    """
    cols = ["market", "ts", "snapshot_id", "closed", "resolved"]

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy("market").agg(F.max(F.struct(*cols[1:])).alias("l")).select("market", "l.*")

    def step(batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
        batch = batch.select(*cols)
        known = last.join(batch.select("market").distinct(), "market", "left_semi")
        both = batch.withColumn("is_new", F.lit(1)).unionByName(known.withColumn("is_new", F.lit(0)))
        # what was stored comes first even if a late row is older
        rows = with_neighbor(both, ["market"], ["is_new", "ts", "snapshot_id"], {"was_closed": "closed", "was_resolved": "resolved"}, F.when(F.col("is_new") == 0, F.lit(-(1 << 40))).otherwise(time_chunk("ts")).cast("long"))
        events = status_kinds(rows).where("is_new = 1").select("market", "ts", "snapshot_id", "event_type")
        return events, newest(batch)

    return run_keyed(snapshots, "status", step, "market long, ts timestamp, snapshot_id long, event_type string", "market long, ts timestamp, snapshot_id long, closed int, resolved int", newest, root)


POSTERIOR = "condition_id long, alpha double, beta double, at double, updates long"


def posterior_state(evidence: DataFrame, prior: float = 20.0, half_life: float = 4.0, max_ratio: float = 5.0, ttl_seconds: int = 7 * 86400, root: str | None = None) -> DataFrame:
    """Beta posterior per market over a stream of evidence(condition_id, ts, seq, price, ratio, weight).

    Between updates the state relaxes to the market price; a market without news for
    ``ttl_seconds`` starts anew.  Each update follows from the one before, so a market is a sequence: its
    rows are sorted with the market's state in front and pass through the task as they come, a few
    thousand at a time; nothing holds a market's rows.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, a, b, at, n = None, None, None, None, 0
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.condition_id != market:
                    market, a, b, at, n = r.condition_id, None, None, None, 0
                if r.is_new == 0:
                    a, b, at, n = r.alpha, r.beta, r.at, int(r.updates)
                    continue
                p, now = min(0.99, max(0.01, r.price)), r.ts.value / 1e9
                if a is not None and now - at > ttl_seconds:
                    a, n = None, 0
                if a is None:
                    a, b = p * prior, (1 - p) * prior
                else:
                    hours = (now - at) / 3600
                    if hours > 0:
                        keep = 0.5 ** (hours / half_life)
                        conc = max(2.0, prior + (a + b - prior) * keep)
                        mean = min(0.99, max(0.01, p + (a / (a + b) - p) * keep))
                        a, b = mean * conc, (1 - mean) * conc
                k = min(max(r.ratio, 1 / max_ratio), max_ratio) ** r.weight
                a, b = (a * k, b) if k >= 1 else (a, b / k)
                scale = min(1.0, prior * 5 / (a + b))
                # a late row counts, and takes no time back
                a, b, at, n = a * scale, b * scale, now if at is None else max(at, now), n + 1
                out.append((market, r.ts, r.seq, a, b, at, n))
            yield pd.DataFrame(out, columns=["condition_id", "ts", "seq", "alpha", "beta", "at", "updates"])

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy("condition_id").agg(F.max(F.struct("at", "updates", "alpha", "beta")).alias("l")).select("condition_id", "l.alpha", "l.beta", "l.at", "l.updates")

    def step(batch: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = batch.select("condition_id", "ts", "seq", "price", "ratio", "weight", F.lit(1).alias("is_new"))
        known = last.join(batch.select("condition_id").distinct(), "condition_id", "left_semi").withColumn("is_new", F.lit(0))
        both = rows.unionByName(known, allowMissingColumns=True).repartition("condition_id").sortWithinPartitions("condition_id", "is_new", "ts", "seq")
        out = cut_lineage(both.mapInPandas(walk, "condition_id long, ts timestamp, seq long, alpha double, beta double, at double, updates long"))
        changed = out.groupBy("condition_id").agg(F.max(F.struct("at", "updates", "alpha", "beta")).alias("l"))
        return out.drop("at"), changed.select("condition_id", "l.alpha", "l.beta", "l.at", "l.updates")

    return run_keyed(evidence, "posterior", step, "condition_id long, ts timestamp, seq long, alpha double, beta double, updates long", POSTERIOR, newest, root)


def stored_bars(trades: DataFrame, seconds: int = 3600, root: str | None = None) -> DataFrame:
    """Bars of all trades so far, kept up by what is new: a batch adds its own partial bars, which merge with those of the same bar.

    The counterpart of a view that fires on insert: nothing is computed again from the trades, late
    rows count, and a repeated batch replaces its own run.
    """
    spark = trades.sparkSession
    bars = partial_bars(spark.createDataFrame([], trades.schema), seconds)

    def write(batch: DataFrame, i: int, root: str) -> None:
        Runs(batch.sparkSession, f"{root}/bars", bars.schema, merge_bars).add(i, partial_bars(batch, seconds))
        batch.sparkSession.createDataFrame([(str(i + 1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/known/batch={i}")

    root = run_batches(trades, "bars", write, root=root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/known")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return bars.drop("open_id", "close_id")
    batches = spark.read.text(f"{root}/known/batch=*").agg(F.max(F.col("value").cast("int"))).first()[0]
    return Runs(spark, f"{root}/bars", bars.schema, merge_bars).before(batches).drop("open_id", "close_id")


# ---- joins ------------------------------------------------------------------


def pre_news_join(events: DataFrame, trades: DataFrame, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Trades of the day before each event, scored; both sides are bounded by watermarks.

    A time slice of an eighth of the window is part of the key: an event meets the trades of its own nine
    slices, not all that the state holds of its market, and a market is spread over many tasks.
    """
    width = -(-hours * 3600 // 8)
    e = events.select(F.col("condition_id").alias("market"), "event_id", "direction", "magnitude", "event_ts").withWatermark("event_ts", delay)
    last = time_chunk("event_ts", width)
    e = e.withColumn("slice", F.explode(F.sequence(time_chunk(F.col("event_ts") - F.expr(f"INTERVAL {hours} HOURS"), width), last)))
    t = trades.select("condition_id", "transaction_hash", "wallet", "side", "usdc_size", "ts").withWatermark("ts", delay).withColumn("trade_slice", time_chunk("ts", width))
    inside = F.expr(f"market = condition_id AND slice = trade_slice AND ts < event_ts AND ts >= event_ts - INTERVAL {hours} HOURS")
    rows = t.join(e, inside, "inner")
    before = (F.unix_micros("event_ts") - F.unix_micros("ts")) / F.lit(3600e6)
    correct = ((F.col("direction") == "up") & (F.col("side") == "BUY")) | ((F.col("direction") == "down") & (F.col("side") == "SELL"))
    timing = 100.0 * F.pow(F.lit(2.0), -before / 4)
    score = timing * F.when(correct, 1.5).otherwise(0.3) + F.when(correct, F.least(F.lit(30.0), F.col("usdc_size") / 500)).otherwise(0.0) + F.col("magnitude") * 50
    return rows.select("event_id", "transaction_hash", "wallet", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("pre_news_score"))


def arbitrage_lifecycle(scans: DataFrame, key: list[str], root: str | None = None) -> str:
    """Keep the open set over scans: each batch of the stream is one complete scan result.

    A batch writes its transitions and the set that is open after it; the next one reads
    that set, so a restart continues from the last finished batch.
    """

    def write(batch: DataFrame, i: int, root: str) -> None:
        spark = batch.sparkSession
        now = batch.select(*key).distinct().persist()
        try:
            before = spark.read.schema(now.schema).parquet(f"{root}/open/batch={i - 1}") if i > 0 else now.limit(0)
            opened = now.join(before, key, "left_anti").withColumn("status", F.lit("open"))
            closed = before.join(now, key, "left_anti").withColumn("status", F.lit("closed"))
            opened.unionByName(closed).withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/transitions/batch_id={i}")
            now.write.mode("overwrite").parquet(f"{root}/open/batch={i}")
        finally:
            now.unpersist()

    return run_batches(scans, "arbitrage", write, root=root)


def arbitrage_scans(scans: DataFrame, key: list[str], root: str | None = None) -> DataFrame:
    """Transitions of numbered scans(scan_no, key...) that arrive in order, in any split over micro-batches.

    A scan is complete when a later one has begun.  A batch carries on the rows of the last complete
    scan (the open set) and of the one still coming in, and nothing older: its work is that of its
    own rows and the open set.  The scans still open at the end of the input follow at the end.  A
    repeated batch reads the state before it and writes the same files again.
    """
    spark = scans.sparkSession
    first = -(1 << 62)
    schema = scans.select("scan_no", *key).schema

    def carried(root: str, i: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/carried/batch={i}") if i >= 0 else spark.createDataFrame([], schema)

    def done(root: str, i: int) -> int:
        return int(spark.read.text(f"{root}/done/batch={i}").first()[0]) if i >= 0 else first

    def transitions(rows: DataFrame, after: int, upto: int) -> DataFrame:
        # the scan before the first new one is what its rows are compared with
        return scan_transitions(rows.where(F.col("scan_no").between(after, upto)), key).where(F.col("scan_no") > after)

    def write(batch: DataFrame, i: int, root: str) -> None:
        after = done(root, i - 1)
        rows = batch.select("scan_no", *key).unionByName(carried(root, i - 1)).where(F.col("scan_no") >= after).distinct().persist()
        try:
            newest = rows.agg(F.max("scan_no")).first()[0]
            upto = max(after, newest - 1) if newest is not None else after
            transitions(rows, after, upto).write.mode("overwrite").parquet(f"{root}/transitions/batch={i}")
            rows.where(F.col("scan_no") >= upto).write.mode("overwrite").parquet(f"{root}/carried/batch={i}")
            spark.createDataFrame([(str(upto),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/done/batch={i}")
        finally:
            rows.unpersist()
        state["last"] = i

    state = {"last": -1}
    root = run_batches(scans, "arbitrage-scans", write, root=root)
    last = state["last"]
    if last < 0:
        return scan_transitions(spark.createDataFrame([], schema), key)
    open_end = transitions(carried(root, last), done(root, last), 1 << 62)
    return spark.read.schema(open_end.schema).parquet(f"{root}/transitions/*").unionByName(open_end)
