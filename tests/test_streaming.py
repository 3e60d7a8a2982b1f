"""Streams over several files give the batch result, with late rows and a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import bars
from oddsmith.plans import lifecycle
from oddsmith.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "condition_id long, outcome string, ts timestamp, trade_id long, token_id long, price double, size double, side string"


def trade(i, minute, market=1, price=0.5):
    return (market, "Yes", T0 + timedelta(minutes=minute), i, 2 * market, price, 10.0, "buy" if i % 2 else "sell")


def write(spark, folder, n, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")


def stream(spark, folder, schema=SCHEMA):
    return jobs.file_stream(spark, f"{folder}/part=*", schema, files_per_trigger=1)


@pytest.fixture
def three(spark, tmp_path):
    for n in range(3):
        write(spark, tmp_path, n, [trade(100 * n + i, 60 * n + i, 1 + i % 3, 0.3 + i / 100) for i in range(50)])
    return str(tmp_path)


def test_bars_equal_batch(spark, three):
    got = {(r["condition_id"], r["bar_time"]): (r["open"], r["close"], r["volume"]) for r in jobs.run_append(jobs.streaming_bars(stream(spark, three)), "t").collect()}
    batch = bars.ohlcv_bars(spark.read.schema(SCHEMA).parquet(f"{three}/part=*"), 3600).where(F.col("bar_time") < F.lit(T0 + timedelta(hours=2)))
    assert got == {(r["condition_id"], r["bar_time"]): (r["open"], r["close"], r["volume"]) for r in batch.collect()}


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    write(spark, tmp_path, 0, [trade(1, 0), trade(2, 300)])
    write(spark, tmp_path, 1, [trade(5, 310)])  # rows are judged late by the watermark of the batch before
    write(spark, tmp_path, 2, [trade(3, 5), trade(4, 600)])
    got = jobs.run_append(jobs.streaming_bars(stream(spark, str(tmp_path))), "late").where(F.col("bar_time") == F.lit(T0)).collect()
    assert [r["trade_count"] for r in got] == [1]


def test_latest_price_over_batches(spark, three):
    got = {r["condition_id"]: r["trade_id"] for r in jobs.streaming_latest_price(stream(spark, three)).collect()}
    want = {}
    for r in spark.read.schema(SCHEMA).parquet(f"{three}/part=*").collect():
        want[r["condition_id"]] = max(want.get(r["condition_id"], (T0, -1)), (r["ts"], r["trade_id"]))
    assert got == {k: v[1] for k, v in want.items()}


def test_dedup_keeps_fills_of_other_tokens(spark, tmp_path):
    write(spark, tmp_path, 0, [trade(1, 0), trade(1, 1), trade(1, 1, market=2)])
    write(spark, tmp_path, 1, [trade(1, 2), trade(2, 3)])
    got = jobs.run_append(jobs.dedup_trades(stream(spark, str(tmp_path))), "dedup")
    assert sorted((r["trade_id"], r["token_id"]) for r in got.collect()) == [(1, 2), (1, 4), (2, 2)]


def test_high_water_drops_late_and_equal_times(spark, tmp_path):
    write(spark, tmp_path, 0, [trade(1, 10), trade(2, 10), trade(3, 20)])
    write(spark, tmp_path, 1, [trade(4, 15), trade(5, 20), trade(6, 30), trade(7, 1, market=2)])
    got = jobs.high_water_trades(stream(spark, str(tmp_path)))
    assert sorted(r["trade_id"] for r in got.collect()) == [1, 3, 6, 7]


def test_status_stream_equals_batch(spark, tmp_path):
    schema = "market long, ts timestamp, snapshot_id long, closed int, resolved int"
    rows = [(1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 1, 1), (2, 0, 1, 0), (2, 1, 1, 1), (3, 0, 0, 0), (3, 1, 1, 1), (3, 2, 0, 0), (3, 3, 1, 0)]
    rows = [(m, T0 + timedelta(days=d), i, c, r) for i, (m, d, c, r) in enumerate(rows)]
    for n in range(4):
        write(spark, tmp_path, n, [r for r in rows if (r[1] - T0).days == n], schema)
    key = lambda df: sorted((r["market"], r["snapshot_id"], r["event_type"]) for r in df.collect())
    got = key(jobs.status_changes(stream(spark, str(tmp_path), schema)))
    assert got == key(lifecycle.status_events(spark.createDataFrame(rows, schema)))
    assert [k for m, _, k in got if m == 1] == ["created", "closed", "resolved"] and [k for m, _, k in got if m == 3] == ["created", "resolved", "closed"]


def test_posterior_equals_a_plain_loop(spark, tmp_path):
    schema = "condition_id long, ts timestamp, seq long, price double, ratio double, weight double"
    rows = [(i % 2, T0 + timedelta(hours=i), i, 0.3 + i / 50, 3.0 if i % 3 else 0.1, 0.5) for i in range(12)]
    for n in range(3):
        write(spark, tmp_path, n, rows[4 * n : 4 * n + 4], schema)
    got = {r["seq"]: (r["alpha"], r["beta"], r["updates"]) for r in jobs.posterior_state(stream(spark, str(tmp_path), schema)).collect()}
    state = {}
    for m, ts, seq, p, ratio, w in rows:
        if m not in state:
            a, b, n = p * 20, (1 - p) * 20, 0
        else:
            a, b, at, n = state[m]
            keep = 0.5 ** ((ts - at).total_seconds() / 3600 / 4)
            conc, mean = max(2, 20 + (a + b - 20) * keep), min(0.99, max(0.01, p + (a / (a + b) - p) * keep))
            a, b = mean * conc, (1 - mean) * conc
        k = min(max(ratio, 0.2), 5) ** w
        a, b = (a * k, b) if k >= 1 else (a, b / k)
        s = min(1, 100 / (a + b))
        state[m] = (a * s, b * s, ts, n + 1)
        assert got[seq] == pytest.approx((a * s, b * s, n + 1))


def test_router_and_restart(spark, tmp_path):
    """A second run with the same root takes only the new file."""
    messages = ['{"event_type":"last_trade_price","market":"m","asset_id":"t","price":"0.4","size":"5","side":"SELL","timestamp":"1704067200000"}',
                '{"event_type":"price_change","market":"m","timestamp":"1704067200000","price_changes":[{"asset_id":"a","price":"0.1"},{"asset_id":"b","price":"0.2","best_bid":"0.1"}]}',
                '{"event_type":"book","market":"m","asset_id":"t","timestamp":"1704067200000","buys":[{"price":"0.4","size":"1"},{"price":"0.3"}]}', '{"event_type":"other"}']
    root = str(tmp_path / "out")
    write(spark, tmp_path / "in", 0, [(m,) for m in messages], "value string")
    jobs.route_messages(stream(spark, str(tmp_path / "in"), "value string"), root)
    write(spark, tmp_path / "in", 1, [(messages[0],)], "value string")
    jobs.route_messages(stream(spark, str(tmp_path / "in"), "value string"), root)
    read = lambda n: spark.read.parquet(f"{root}/{n}/*").collect()
    assert [(r["side"], r["trade_id"]) for r in read("market_trades")] == [("sell", "ws-t-1704067200000")] * 2
    assert sorted(r["token_id"] for r in read("market_prices")) == ["a", "b", "t", "t"]
    book = read("orderbook_snapshots")[0]
    assert (book["bid_prices"], book["bid_sizes"], book["ask_prices"]) == ([0.4, 0.3], [1.0], [])


def test_arbitrage_lifecycle(spark, tmp_path):
    schema = "condition_id long, arb_type string"
    scans = [[(1, "a"), (2, "a")], [(2, "a"), (3, "b")], [(1, "a")]]
    root = str(tmp_path / "out")
    for n, rows in enumerate(scans):
        write(spark, tmp_path / "in", n, rows, schema)
        jobs.arbitrage_lifecycle(stream(spark, str(tmp_path / "in"), schema), ["condition_id", "arb_type"], root)
    got = sorted((r["batch"], r["condition_id"], r["status"]) for r in spark.read.parquet(f"{root}/transitions/*").collect())
    assert got == [(0, 1, "open"), (0, 2, "open"), (1, 1, "closed"), (1, 3, "open"), (2, 1, "open"), (2, 2, "closed"), (2, 3, "closed")]
    numbered = spark.createDataFrame([(n, *r) for n, rows in enumerate(scans) for r in rows], "scan_no int, condition_id long, arb_type string")
    batch = sorted((r["scan_no"], r["condition_id"], r["status"]) for r in lifecycle.scan_transitions(numbered, ["condition_id", "arb_type"]).collect())
    assert batch == got


def test_a_table_folder_streams_like_one_file(spark, tmp_path):
    import os
    import shutil

    from oddsmith.catalog.all import load
    from oddsmith.catalog.registry import run

    load()

    folder = "/root/testdata/sf0.001"
    for name in os.listdir(folder):
        if name != "events.parquet":
            os.symlink(f"{folder}/{name}", tmp_path / name)
    spark.read.parquet(f"{folder}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for query in ("stream_ohlcv", "stream_latest_price"):
        want = sorted(map(tuple, run(query, spark, folder).collect()))
        assert want and sorted(map(tuple, run(query, spark, str(tmp_path)).collect())) == want
    shutil.rmtree(tmp_path / "events.parquet")


def test_python_functions_run_from_another_folder(tmp_path):
    """Executors get the package from the session, whatever the working folder and the path of the driver."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["stream_high_water"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-1500:]


def test_arbitrage_scans_that_span_batches(spark, tmp_path):
    from oddsmith.plans.lifecycle import scan_transitions

    schema = "scan_no long, condition_id long, arb_type string"
    rows = [(n, k, "x") for n in range(1, 7) for k in range(6) if (n * k) % 4 != 2]
    for i in range(0, len(rows), 5):  # a scan starts in one file and ends in the next
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    got = sorted(map(tuple, jobs.arbitrage_scans(frame, ["condition_id", "arb_type"], str(tmp_path / "root")).select("scan_no", "condition_id", "status").collect()))
    want = sorted(map(tuple, scan_transitions(spark.createDataFrame(rows, schema), ["condition_id", "arb_type"]).select("scan_no", "condition_id", "status").collect()))
    assert got == want and len(want) > 10


@pytest.fixture
def many(spark, tmp_path):
    """Nine files of a hot market and two others, taken three at a time by a session that ends in between."""
    rows = [trade(1000 * n + i, 10 * n + (7 * i) % 13, 1 if i % 4 else 2 + i % 3, 0.2 + (i % 9) / 20) for n in range(9) for i in range(24)]
    return [rows[k : k + 24] for k in range(0, len(rows), 24)], tmp_path


def over_restarts(spark, many, job, schema=SCHEMA, shape=lambda r: r):
    """What a job gives that is started three times on the same root, the input growing."""
    parts, folder = many
    root = str(folder / "root")
    for n, rows in enumerate(parts):
        write(spark, folder / "in", n, [shape(r) for r in rows], schema)
        if n % 3 == 2:
            out = job(stream(spark, str(folder / "in"), schema), root)
    return out.collect()


def test_runs_merge_and_repeat(spark, tmp_path, monkeypatch):
    """Any number of batches reads as all of them; a batch written twice counts once."""
    from oddsmith.streaming import runs

    monkeypatch.setattr(runs, "WIDTH", 3)
    made = runs.Runs(spark, str(tmp_path / "r"), "k long, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    want = {}
    for i in range(11):
        assert {r["k"]: r["n"] for r in made.before(i).collect()} == want
        rows = [(i % 4, 1), (7, i)]
        for _ in range(2 if i in (2, 5, 8) else 1):
            made.add(i, spark.createDataFrame(rows, "k long, n long"))
        for k, n in rows:
            want[k] = want.get(k, 0) + n
    assert len(made._covering(11)) <= 6 and len(made._covering(9)) == 1


def test_high_water_over_restarts(spark, many):
    got = sorted(r["trade_id"] for r in over_restarts(spark, many, jobs.high_water_trades))
    seen, want = {}, []
    for part in many[0]:
        best = {}
        for r in part:
            best[r[0], r[2]] = min(best.get((r[0], r[2]), r[3]), r[3])
        want += [i for (m, ts), i in best.items() if ts > seen.get(m, T0 - timedelta(days=1))]
        for m, ts in best:
            seen[m] = max(seen.get(m, ts), ts)
    assert got == sorted(want) and len(want) < sum(map(len, many[0]))


def test_a_hot_market_runs_over_several_tasks(spark, tmp_path):
    """Ties of one market are settled by time: no task gets all its rows."""
    batch = spark.createDataFrame([trade(i, i) for i in range(600)], SCHEMA).repartition(4)
    kept = batch.groupBy("condition_id", "ts").agg(F.min(F.struct("trade_id", "price", "size")).alias("f"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so small a table would be merged into one task
    try:
        sizes = [r["n"] for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 400


def test_stored_bars_over_restarts(spark, many):
    """Nine parts in three starts equal the bars of all rows, with ties in time across parts."""
    got = over_restarts(spark, many, lambda s, root: jobs.stored_bars(s, 600, root))
    want = bars.ohlcv_bars(spark.createDataFrame([r for p in many[0] for r in p], SCHEMA), 600).collect()
    key = lambda rows: sorted((r["condition_id"], r["bar_time"], r["open"], r["high"], r["low"], r["close"], round(r["volume"], 6), r["trade_count"], r["open_ts"], r["close_ts"]) for r in rows)
    assert key(got) == key(want)


def test_posterior_over_restarts_and_forgetting(spark, many):
    """The state of a market goes on over starts, with a hot market in small Arrow batches; after a week of silence it starts anew."""
    schema = "condition_id long, ts timestamp, seq long, price double, ratio double, weight double"
    shape = lambda r: (r[0], r[2] + timedelta(days=9 if r[3] >= 6000 else 0), r[3], r[5], 1.5, 0.5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = over_restarts(spark, many, lambda s, root: jobs.posterior_state(s, root=root), schema, shape)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    count, last, want = {}, {}, {}
    for part in many[0]:
        for r in sorted(map(shape, part), key=lambda r: (r[1], r[2])):
            m = r[0]
            if m in last and (r[1] - last[m]).total_seconds() > 7 * 86400:
                count[m] = 0
            last[m] = max(last.get(m, r[1]), r[1])
            count[m] = count.get(m, 0) + 1
            want[r[2]] = count[m]
    assert {r["seq"]: r["updates"] for r in got} == want and min(v for k, v in want.items() if k >= 6000) == 1


def test_arbitrage_carries_only_the_open_set(spark, tmp_path):
    """A batch keeps the last complete scan and the one still coming in; a second start goes on with them."""
    schema = "scan_no long, condition_id long, arb_type string"
    rows = [(n, k, "x") for n in range(1, 9) for k in range(5) if (n * k) % 3 != 2]
    key, root = ["condition_id", "arb_type"], str(tmp_path / "root")
    found = []
    for part, cut in enumerate((0, len(rows) // 2)):
        chosen = rows[: len(rows) // 2] if part == 0 else rows[cut:]
        for i in range(0, len(chosen), 6):
            write(spark, tmp_path / "in", 100 * part + i, chosen[i : i + 6], schema)
        found = jobs.arbitrage_scans(stream(spark, str(tmp_path / "in"), schema), key, root).select("scan_no", "condition_id", "status").collect()
    want = lifecycle.scan_transitions(spark.createDataFrame(rows, schema), key).select("scan_no", "condition_id", "status").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))
    import glob

    sizes = [spark.read.parquet(p).select("scan_no").distinct().count() for p in glob.glob(f"{root}/carried/batch=*")]
    assert max(sizes) <= 2


def test_pre_news_of_a_hot_market_runs_over_several_tasks(spark, tmp_path):
    """One market, events at slice borders and rows without a time: all trades of the day before, found by more than one task."""
    minutes = [(37 * i) % 4320 for i in range(300)] + [0, 180, 1440, 1440, 1620, 2880, 3060]
    rows = [trade(i, m) for i, m in enumerate(sorted(minutes))] + [(1, "Yes", None, 900, 2, 0.5, 10.0, "buy")]
    for n in range(3):
        write(spark, tmp_path, n, rows[n * 100 : n * 100 + 100] if n < 2 else rows[200:])
    source = stream(spark, str(tmp_path))
    events = source.where("trade_id % 5 = 0").select("condition_id", F.col("trade_id").alias("event_id"), F.lit("up").alias("direction"), F.col("price").alias("magnitude"), F.col("ts").alias("event_ts"))
    trades = source.select("condition_id", F.col("trade_id").alias("transaction_hash"), F.lit(7).alias("wallet"), F.upper("side").alias("side"), F.col("size").alias("usdc_size"), "ts")
    found = jobs.run_append(jobs.pre_news_join(events, trades).withColumn("task", F.spark_partition_id()), "pre-news").collect()
    when = {r[3]: r[2] for r in rows if r[2]}
    day = timedelta(hours=24)
    want = sorted((e, i) for e in when if e % 5 == 0 for i in when if when[e] - day <= when[i] < when[e])
    assert sorted((r["event_id"], r["transaction_hash"]) for r in found) == want
    assert len({r["task"] for r in found}) > 1
