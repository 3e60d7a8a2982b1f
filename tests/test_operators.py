"""Core operators against brute force: chunk borders, ties, shuffled input, hot keys."""

import statistics
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsmith.operators import asof, bars, graph, neighbours, ordered, pairs, quantiles, ranges, versions

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def events(spark):
    """600 events, a third of them of one key, with ties in time, in random order."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(6)}", at(rng.randrange(0, 40000) // 7 * 7), i, float(rng.randrange(100))) for i in range(600)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp, id long, v double").repartition(5).cache()


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    left, right = rows(a), rows(b)
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert all(p == q or (isinstance(p, float) and p == pytest.approx(q)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("width", [60, 3600, 86400])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbor_equals_window(events, width, ahead):
    got = ordered.with_neighbor(events, ["k"], ["ts", "id"], {"n": "v"}, ordered.time_chunk("ts", width), ahead)
    w = Window.partitionBy("k").orderBy("ts", "id")
    same(got, events.withColumn("n", (F.lead if ahead else F.lag)("v").over(w)))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_equals_window(events, by):
    got = ordered.with_running(events, by, ["ts", "id"], ordered.time_chunk("ts", 600), sums={"s": F.col("v")}, maxima={"m": F.col("v")})
    w = Window.partitionBy(*by).orderBy("ts", "id")
    same(got, events.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w)))


def test_running_with_peers_and_exclusive(events):
    sec = events.withColumn("t", F.unix_timestamp("ts"))
    chunk = F.floor(F.col("t") / 600)
    peers = ordered.with_running(sec, ["k"], ["t"], chunk, sums={"s": F.col("v")}, peers=True)
    same(peers, sec.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t"))))
    strict = ordered.with_running(sec, ["k"], ["t"], chunk, sums={"s": F.col("v")}, peers=True, include_current=False)
    same(strict, sec.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(Window.unboundedPreceding, -1))))


def brute_asof(left, right, direction, equal=True, tolerance=None):
    out = {}
    for k, t, i, _ in left:
        best = None
        for rk, rt, ri, rv in right:
            if rk != k or (rt == t and not equal) or (rt > t if direction == "backward" else rt < t):
                continue
            key = (rt, ri)
            if best is None or (key > best[0] if direction == "backward" else key < best[0]):
                best = (key, rv)
        if best and tolerance is not None and abs((best[0][0] - t).total_seconds()) > tolerance:
            best = None
        out[i] = best[1] if best else None
    return out


@pytest.mark.parametrize("direction,equal,tolerance", [("backward", True, None), ("backward", False, None), ("forward", True, None), ("forward", False, 500), ("backward", True, 300)])
def test_asof(events, direction, equal, tolerance):
    left, right = events.where("id % 2 = 0"), events.where("id % 2 = 1")
    got = asof.asof_join(left, right, ["k"], "ts", {"hit": "v"}, direction, tie=["id"], tolerance=tolerance, allow_equal=equal, chunk_seconds=900)
    want = brute_asof([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()], direction, equal, tolerance)
    assert {r["id"]: r["hit"] for r in got.collect()} == want


def test_asof_nearest_prefers_the_earlier_side(spark):
    left = spark.createDataFrame([("a", at(100)), ("a", at(0)), ("b", at(5)), ("c", at(1))], "k string, ts timestamp")
    right = spark.createDataFrame([("a", at(90), 1.0), ("a", at(110), 2.0), ("b", at(500), 3.0)], "k string, ts timestamp, v double")
    got = {(r["k"], r["ts"]): r["hit"] for r in asof.asof_nearest(left, right, ["k"], "ts", {"hit": "v"}).collect()}
    assert got == {("a", at(100)): 1.0, ("a", at(0)): 1.0, ("b", at(5)): 3.0, ("c", at(1)): None}


def test_asof_empty_right(spark, events):
    got = asof.asof_join(events, events.limit(0), ["k"], "ts", {"hit": "v"})
    assert got.count() == 600 and got.where("hit is not null").count() == 0


@pytest.mark.parametrize("closed", ["left", "right", "both"])
def test_range_join(events, closed):
    iv = events.where("id % 5 = 0").select("k", F.col("id").alias("e"), F.col("ts").alias("lo"), (F.col("ts") + F.make_dt_interval(secs=F.lit(700))).alias("hi"))
    got = {(r["e"], r["id"]) for r in ranges.range_join(iv, events.select("k", "id", "ts"), ["k"], "lo", "hi", "ts", 300, closed).collect()}
    pts = [(r["k"], r["id"], r["ts"]) for r in events.collect()]
    low = (lambda t, a: t > a) if closed == "right" else (lambda t, a: t >= a)
    high = (lambda t, b: t < b) if closed == "left" else (lambda t, b: t <= b)
    assert got == {(r["e"], i) for r in iv.collect() for k, i, t in pts if k == r["k"] and low(t, r["lo"]) and high(t, r["hi"])}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"many": rng.normal(size=3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("many", None)], "k string, x double").repartition(6)
    wanted = {"a": 0.0, "q": 0.25, "m": 0.5, "t": 0.67, "z": 1.0}
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "x", wanted).collect()}
    for k, v in groups.items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p)), (k, name)
    assert quantiles.exact_quantiles(df.limit(0), [], "x", {"m": 0.5}).collect()[0]["m"] is None


@pytest.mark.parametrize("min_shared", [1, 2, 3])
def test_pairs_with_a_key_everyone_holds(spark, min_shared):
    rng = random.Random(1)
    have = {(m, 0) for m in range(30)} | {(m, 1) for m in range(0, 30, 2)} | {(rng.randrange(30), 2 + rng.randrange(12)) for _ in range(120)}
    df = spark.createDataFrame(sorted(have), "m long, k long")
    got = {(r["a"], r["b"]): (r["common"], r["n_a"], r["n_b"]) for r in pairs.shared_key_pairs(df, "m", "k", min_shared).collect()}
    sets = defaultdict(set)
    for m, k in have:
        sets[m].add(k)
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= min_shared}
    assert got == want


def test_hot_key_generates_no_pairs(spark):
    """The key that all members share is in nobody's prefix when two common keys are needed."""
    df = spark.createDataFrame([(m, k) for m in range(50) for k in (0, 100 + m)], "m long, k long")
    assert pairs.shared_key_pairs(df, "m", "k", 2).count() == 0


def test_pairs_are_added_up_in_their_cells(spark, monkeypatch):
    """Sums, columns of a member and numbers beside, over several blocks; no join or exchange holds rows of common keys."""
    monkeypatch.setattr(pairs, "_blocks", lambda members: 3)
    rng = random.Random(5)
    rows = [(f"w{m:02d}", k, float(rng.randrange(9)) if rng.random() < 0.9 else None, m % 4) for m in range(30) for k in rng.sample(range(12), rng.randrange(1, 9))] + [(None, 1, 1.0, 0)]
    near = [("w01", "w02", 2), ("w01", "w02", 3), ("w03", "w29", 4), (None, "w02", 9), ("w00", "other", 5)]
    got = pairs.shared_key_pairs(
        spark.createDataFrame(rows, "m string, k long, v double, t long"), "m", "k", 3, ["v"], ["drop"], lambda a, b: {"drop": np.fmax(a["v"] - b["v"], 0)}, ["t"],
        spark.createDataFrame(near, "a string, b string, hits long"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().replace("FlatMapCoGroups", "")
    have = defaultdict(dict)
    for m, k, v, t in rows:
        if m is not None:
            have[m][k] = v
    want = {}
    for a in have:
        for b in have:
            common = have[a].keys() & have[b].keys()
            if a < b and len(common) >= 3:
                drop = sum(max(have[a][k] - have[b][k], 0.0) for k in common if have[a][k] is not None and have[b][k] is not None)
                want[a, b] = (len(common), len(have[a]), len(have[b]), int(a[1:]) % 4, int(b[1:]) % 4, drop, float(sum(n for x, y, n in near if (x, y) == (a, b))))
    assert want and {(r["a"], r["b"]): tuple(r[2:]) for r in got.collect()} == want


@pytest.mark.parametrize("hot, least", [(0.0, None), (2.0, None), (0.25, 0.35)])
def test_wallet_pairs_by_matrices_and_by_joins(spark, monkeypatch, hot, least):
    """Common markets as columns of matrices or joined row by row, trades close in time counted in the cells: the pairs of a plain loop."""
    from oddsmith.plans import wallets

    monkeypatch.setattr(pairs, "HOT", hot)
    monkeypatch.setattr(pairs, "BLOCK", 7)
    monkeypatch.setattr(pairs, "_blocks", lambda members: 3)
    rng = random.Random(8)
    rows = [(rng.randrange(25), rng.randrange(9) if rng.random() < 0.95 else None, rng.choice(["BUY", "SELL", "SELL", ""]), rng.choice([None, 0.0, -3.0, 1.0, 2.5, 40.0]),
             at(rng.randrange(4000)), "TRADE", i) for i in range(600)]
    rows += [(None, 1, "BUY", 1.0, at(5), "TRADE", 900), (3, 1, "BUY", 1.0, None, "TRADE", 901)]
    activity = spark.createDataFrame(rows, "wallet long, condition_id long, side string, usdc_size double, ts timestamp, activity_type string, transaction_hash long")
    weights = wallets.GROUP_WEIGHTS if least else None
    found = wallets.wallet_pairs(activity, F.lit(at(5000)), 86400, 90, weights=weights, least=least)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["a"], r["b"]): tuple(r[2:]) for r in found.collect()}
    trades = defaultdict(lambda: defaultdict(list))
    for w, k, side, usd, ts, _, tx in rows:
        if None not in (w, k, ts) and side:
            trades[w][k].append((ts, tx, side, usd))
    volume = defaultdict(float)
    for w, _, side, usd, ts, _, _ in rows:
        if ts and side:
            volume[w] += usd or 0.0
    want = {}
    for a in trades:
        for b in trades:
            common = trades[a].keys() & trades[b].keys()
            if not a < b or len(common) < 3:
                continue
            last = [(max(trades[a][k])[2:], max(trades[b][k])[2:]) for k in common]
            high = [(x[1], y[1]) for x, y in last if max([v for v in (x[1], y[1]) if v is not None], default=0) > 0]
            ratios = [1.0 if None in h else min(h) / max(h) for h in high]
            near = sum(abs((x[0] - y[0]).total_seconds()) <= 90 for k in common for x in trades[a][k] for y in trades[b][k])
            crossed = sum(len(trades[a][k]) * len(trades[b][k]) for k in common)
            parts = (len(common) / (len(trades[a]) + len(trades[b]) - len(common)), sum(x[0] == y[0] for x, y in last) / len(common), near / crossed, sum(ratios) / len(ratios) if ratios else 0.0)
            if not least or sum(v * w for v, w in zip(parts, weights.values())) >= least:
                want[a, b] = (len(common), *parts, volume[a] + volume[b])
    assert want.keys() == got.keys() and len(want) > 50
    for pair, numbers in want.items():
        assert got[pair] == pytest.approx(numbers), pair


def test_suspicion_of_groups_without_a_shuffle_of_groups(spark):
    from oddsmith.plans import wallets

    groups = spark.createDataFrame([(1, 2, "g"), (1, 3, "h"), (4, 5, "i"), (1, 2, "g")], "a long, b long, group_id string")
    profiles = spark.createDataFrame([(1, 10.0), (2, 30.0), (3, None), (None, 7.0)], "wallet long, suspicion double")
    got = wallets.flag_groups(groups, profiles)
    assert sorted(map(tuple, got.select("group_id", "avg_suspicion").collect())) == [("g", 20.0), ("g", 20.0), ("h", 5.0), ("i", 0.0)]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().sparkPlan().toString() and got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2


def test_latest_version_and_limit_by(events):
    got = {r["k"]: r["id"] for r in versions.latest_version(events, ["k"], ["ts", "id"]).collect()}
    want = {}
    for r in events.collect():
        want[r["k"]] = max(want.get(r["k"], (T0, -1)), (r["ts"], r["id"]))
    assert got == {k: v[1] for k, v in want.items()}
    assert versions.limit_by(events, ["k"], [F.desc("ts"), F.desc("id")], 3).groupBy("k").count().where("count <> 3").count() == 0


def test_align_fills_head_and_gaps(spark):
    df = spark.createDataFrame([("a", at(3600), 1.0), ("a", at(3 * 3600), 3.0), ("b", at(0), 5.0)], "token_id string, bucket timestamp, price double")
    got = {(r["token_id"], (r["bucket"] - T0).seconds // 3600): r["price"] for r in bars.align_ffill(df, ["token_id"], "price").collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 3): 3.0, ("b", 0): 5.0, ("b", 1): 5.0, ("b", 3): 5.0}


def test_bars_do_not_depend_on_row_order(spark, events):
    trades = events.select(F.col("k").alias("condition_id"), F.lit("Yes").alias("outcome"), "ts", F.col("id").alias("trade_id"), F.col("v").alias("price"), F.lit(1.0).alias("size"), F.lit("buy").alias("side"))
    same(bars.ohlcv_bars(trades, 600), bars.ohlcv_bars(trades.orderBy(F.rand(7)).repartition(3), 600))
    same(bars.rollup_bars(bars.ohlcv_bars(trades, 60), 3600), bars.ohlcv_bars(trades, 3600))


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(9)
    rows = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(45)) if a < b} | {(0, b) for b in range(1, 12)} | {(50 + i, 51 + i) for i in range(9)}
    return spark.createDataFrame([(a, b, float(1 + (a + b) % 4)) for a, b in sorted(rows)], "src long, dst long, weight double").cache()


def test_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in edges.collect():
        a, b = find(r["src"]), find(r["dst"])
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {n: find(n) for n in parent}


def test_shortest_paths_and_triangles(spark, edges):
    adj = defaultdict(dict)
    for r in edges.collect():
        adj[r["src"]][r["dst"]] = adj[r["dst"]][r["src"]] = r["weight"]
    dist = {0: 0.0}
    for _ in range(60):
        for u in list(dist):
            for v, w in adj[u].items():
                dist[v] = min(dist.get(v, 1e9), dist[u] + w)
    got = graph.shortest_paths(graph.both_ways(edges), spark.createDataFrame([(0,)], "origin long"))
    assert {r["node"]: r["cost"] for r in got.collect()} == dist
    tri = {n: sum(1 for x in adj[n] for y in adj[n] if x < y and y in adj[x]) for n in adj}
    got = {r["node"]: r["triangles"] for r in graph.triangles_per_node(edges).collect()}
    assert got == {n: c for n, c in tri.items() if c}


def test_forward_asof_reads_a_slice_once(spark, events):
    """A frame that ends at the last row of its slice is read again for every row."""
    got = asof.asof_join(events, events, ["k"], "ts", {"hit": "v"}, "forward", tie=["id"])
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_crowded_cells_are_dealt_over_tasks(spark):
    """All points in one cell: centres of the cell go to several partitions, and the edges of one zone too."""
    c = spark.range(64).select(F.col("id").alias("centre_id"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"))
    p = spark.range(50).select(F.col("id").alias("point_id"), F.lit(1.0).alias("p_lat"), F.lit(1.0).alias("p_lng"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = graph.radius_join(c, p, 5.0).withColumn("at", F.spark_partition_id())
        assert got.count() == 64 * 50 and got.select("at").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("edges_a_cell", [5, 1 << 21])
def test_triangles_in_cells_without_joins(spark, monkeypatch, edges_a_cell):
    monkeypatch.setattr(graph, "CELL_EDGES", edges_a_cell)
    rng = random.Random(8)
    links = {tuple(rng.sample(range(25), 2)) for _ in range(110)} | {(3, 3), (None, 4)}
    adj = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            adj[a].add(b), adj[b].add(a)
    want = {n: sum(1 for x in adj[n] for y in adj[n] if x < y and y in adj[x]) for n in adj}
    got = graph.triangles_per_node(spark.createDataFrame([*links], "src long, dst long"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["node"]: r["triangles"] for r in got.collect()} == {n: c for n, c in want.items() if c}


def test_radius_join_near_the_date_line_and_pole(spark):
    c = spark.createDataFrame([(1, 0.0, 179.99), (2, 89.99, 10.0), (3, -8.7230, 115.1750)], "centre_id long, lat double, lng double")
    p = spark.createDataFrame([(1, 0.0, -179.99), (2, 89.99, -170.0), (3, -8.5069, 115.2624), (4, 40.0, 40.0)], "point_id long, p_lat double, p_lng double")
    got = {(r["centre_id"], r["point_id"]): r["km"] for r in graph.radius_join(c, p, 35.0).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and 20 < got[(3, 3)] < 35


def test_last_value_at_cutoffs(spark, events):
    cuts = spark.createDataFrame([("hot", "early", at(5000)), ("hot", "late", at(30000)), ("k1", "early", at(5000))], "k string, tag string, cut timestamp")
    got = {(r["k"], r["tag"]): r["last"] for r in asof.last_at_cutoffs(events, cuts, ["k"], "ts", "cut", "v", ["ts", "id"], "last").collect()}
    rows = [tuple(r) for r in events.collect()]
    assert got == {(k, tag): max((t, i, v) for kk, t, i, v in rows if kk == k and t <= c)[2] for k, tag, c in map(tuple, cuts.collect())}


def test_paths_and_intensity_have_no_hop_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOPS", 3)
    chain = spark.createDataFrame([(i, i + 1, 1.0, 0.9) for i in range(40)], "src long, dst long, weight double, factor double")
    start = spark.createDataFrame([(0,)], "origin long")
    got = {r["node"]: r["cost"] for r in graph.shortest_paths(chain, start).collect()}
    assert got == {i: float(i) for i in range(41)}
    # 0.9 ** 28 is the last power above 0.05
    assert graph.spread_intensity(chain, start).count() == 29
    with pytest.raises(ValueError):
        graph.shortest_paths(chain.withColumn("weight", -F.col("weight")), start)


def best_products(links, origins, floor):
    """Relaxed one origin after the other."""
    found = {}
    for o in origins:
        best = front = {o: 1.0}
        while front:
            made = {}
            for n, v in front.items():
                for m, f in links.get(n, []):
                    if v * f >= floor and v * f > max(best.get(m, 0.0), made.get(m, 0.0)) * (1 + 1e-12):
                        made[m] = v * f
            best, front = best | made, made
        found |= {(o, n): v for n, v in best.items()}
    return found


def test_intensity_of_few_factors_keeps_a_bit_a_pair(spark, monkeypatch):
    """More origins than a block holds, several cells, shares and kinds, double edges and origins, a loop, nulls; no pair is relaxed on its own."""
    from oddsmith.operators import floods

    monkeypatch.setattr(floods, "CELL_EDGES", 1500)
    monkeypatch.setattr(floods, "NODES", 700)
    monkeypatch.setattr(floods, "BAND", 1)
    monkeypatch.setattr(graph, "_spread", None)
    rng = np.random.default_rng(4)
    ends = rng.integers(0, 2600, size=(3000, 2)).tolist()
    rows = [(f"n{a}", f"n{b}", (0.7, 0.7 * 0.7, 0.4)[i % 3]) for i, (a, b) in enumerate(ends)]
    rows += rows[:5] + [("n1", "n1", 0.7), ("n1", None, 0.7), (None, "n2", 0.7), ("n3", "n4", None), ("n3", "n5", 0.01)]
    links = {}
    for a, b, f in rows:
        if a and b and f:
            links.setdefault(a, []).append((b, f))
            links.setdefault(b, []).append((a, f))
    origins = [f"n{i}" for i in range(2300)] + ["n7", "alone"]
    got = graph.spread_intensity(spark.createDataFrame(rows, "src string, dst string, factor double"), spark.createDataFrame([(o,) for o in origins], "origin string"), floor=0.15).collect()
    want = best_products(links, set(origins), 0.15)
    assert len(got) == len(want) and {(r["origin"], r["node"]): r["intensity"] for r in got} == pytest.approx(want)


def test_components_raise_when_rounds_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, max_rounds=1)


def test_newest_price_and_bars_are_hash_aggregates(spark, events):
    trades = events.selectExpr("k AS condition_id", "'Yes' AS outcome", "timestamp_seconds(id) AS ts", "id AS trade_id", "CAST(id AS DOUBLE) AS price", "1.0D AS size", "'buy' AS side")
    for df in (bars.ohlcv_bars(trades, 3600), versions.latest_price(trades, ["condition_id"])):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_earlier_medians_of_a_hot_key(spark):
    """Two thirds of the rows in one key, repeated and negative values, several rows a day, a day without history, nulls left out."""
    from oddsmith.operators.order_statistics import earlier_medians

    rng = random.Random(5)
    rows = [(0 if i % 3 else 1 + i % 4, rng.randrange(-400, 900), rng.choice([rng.gauss(0, 50), float(rng.randrange(-5, 5))])) for i in range(1500)]
    rows += [(9, 1, 2.0), (9, 1, 4.0), (9, 2, 8.0), (9, 3, -1.0)]
    frame = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "k long, d int, v double")
    got = {(r["k"], r["d"]): (r["earlier"], r["median"]) for r in earlier_medians(frame, ["k"], "d", "v", 2).collect()}
    assert got[9, 1] == (0, None) and got[9, 2] == (2, 3.0) and got[9, 3] == (3, 4.0)
    assert set(got) == {(k, d) for k, d, _ in rows}
    for k, d in got:
        past = [v for j, e, v in rows if j == k and e < d]
        assert got[k, d][0] == len(past) and got[k, d][1] == (pytest.approx(statistics.median(past)) if len(past) >= 2 else None)
    none = earlier_medians(frame.where("k > 100"), ["k"], "d", "v").collect()
    assert none == []


def test_earlier_medians_in_cells(spark, monkeypatch):
    """Keys over several cells, several keys in a cell, many rows of one value; the number of exchanges doesn't grow with the values."""
    from oddsmith.operators import order_statistics

    rng = random.Random(6)
    rows = [(f"k{min(rng.randrange(12), 6)}", rng.randrange(-500, 700), rng.choice([rng.gauss(0, 50), 7.0])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "k string, d int, v double")
    cuts = []
    real = order_statistics.cut_lineage
    monkeypatch.setattr(order_statistics, "cut_lineage", lambda df: cuts.append(df) or real(df))
    for points, least in ((40, 1), (1000, 3)):
        monkeypatch.setattr(order_statistics, "POINTS", points)
        cuts.clear()
        got = {(r["k"], r["d"]): (r["earlier"], r["median"]) for r in order_statistics.earlier_medians(frame, ["k"], "d", "v", least).collect()}
        assert len(cuts) == 4 and set(got) == {(k, d) for k, d, _ in rows}
        for k, d in got:
            past = [v for j, e, v in rows if j == k and e < d]
            assert got[k, d][0] == len(past) and got[k, d][1] == (pytest.approx(statistics.median(past)) if len(past) >= least else None)


def nearest_by_hand(rows, k):
    found = {}
    units = {i: v / (np.linalg.norm(v) or 1.0) for i, v, _ in rows}
    for i, _, label in rows:
        others = sorted((-round(float(units[i] @ units[j]), 12) + 0.0, j, other) for j, _, other in rows if j != i)
        found[i] = (label, [(j, other) for _, j, other in others[:k]])
    return found


def vectors_in_groups(groups, d, n, seed=3):
    """Vectors round some centres, a third of all rows equal, some ties by scale, zeros."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[rng.integers(groups)] + rng.normal(size=d) * 0.05
        if i % 50 == 1:
            v = 2 * np.array(rows[rng.integers(len(rows))][1])
        if i % 97 == 2:
            v = np.zeros(d)
        rows.append((int(rng.integers(10)) * n + i, v, int(i % 4)))
    return rows


@pytest.mark.parametrize("k, block, pivots, visitors", [(5, 2048, 1024, 1 << 18), (5, 8, 12, 20), (1, 16, 1024, 7), (3, 8, 1, 1 << 18)])
def test_nearest_neighbours(spark, k, block, pivots, visitors):
    rows = vectors_in_groups(9, 6, 300)
    df = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in rows], "id long, v array<double>, label long").repartition(3)
    found = {r["id"]: (r["label"], [(e["id"], e["label"]) for e in r["neighbours"]]) for r in neighbours.nearest_neighbours(df, k, block, pivots, visitors).collect()}
    assert found == nearest_by_hand(rows, k)


def test_a_visitor_is_sent_once_a_rack(spark, monkeypatch):
    """Vectors without structure visit all blocks: rows sent grow with the racks, not with the blocks; floats stay floats."""
    sent = []
    search = neighbours._search
    monkeypatch.setattr(neighbours, "RACK", 4)
    monkeypatch.setattr(neighbours, "_search", lambda rows, take: sent.append(rows) or search(rows, take))
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(240, 12)).astype(np.float32))]
    df = spark.createDataFrame(rows, "id long, v array<float>, label long")
    found = {r["id"]: (r["label"], [(e["id"], e["label"]) for e in r["neighbours"]]) for r in neighbours.nearest_neighbours(df, 3, 16, 15).collect()}
    assert found == nearest_by_hand([(i, np.array(v), label) for i, v, label in rows], 3)
    blocks = sent[1].where("visitor = 0").select("block").distinct().count()
    racks = -(-blocks // 4)
    assert blocks > 8 and sent[1].where("visitor = 1").count() <= 240 * (racks + 1) and sent[1].schema["v"].dataType.elementType.simpleString() == "float"


def test_nearest_neighbours_defined_cases(spark):
    schema = "id long, v array<double>, label string"
    run = lambda rows: {r["id"]: [(e["score"], e["id"], e["label"]) for e in r["neighbours"]] for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, schema), 2).collect()}
    assert run([]) == {}
    assert run([(1, None, "a"), (2, [1.0, None], "a"), (3, [float("nan"), 1.0], "a")]) == {}
    assert run([(4, [1.0, 0.0], None)]) == {4: []}
    assert run([(4, [1.0, 0.0], None), (9, [0.0, 0.0], "z")]) == {4: [(0.0, 9, "z")], 9: [(0.0, 4, None)]}
    assert run([(1, None, "a"), (7, [3.0, 0.0], "b"), (5, [1.0, 0.0], "c"), (6, [0.0, 1.0], "d")]) == {7: [(1.0, 5, "c"), (0.0, 6, "d")], 5: [(1.0, 7, "b"), (0.0, 6, "d")], 6: [(0.0, 5, "c"), (0.0, 7, "b")]}


def test_cells_of_other_groups_are_not_visited():
    """Groups far apart: every row visits its own cell, few others, and none that holds a nearer row is left out."""
    rng = np.random.default_rng(8)
    centres = neighbours.units(pa.array(rng.normal(size=(40, 16)).tolist()))
    group = rng.integers(40, size=2000)
    rows = neighbours.units(pa.array((centres[group] + rng.normal(size=(2000, 16)) * 0.01).tolist()))
    d = neighbours.distances(rows, centres)
    own = d.argmin(axis=1)
    to_own = d[np.arange(2000), own]
    inner, outer = (np.array([f(to_own[own == c]) for c in range(40)]) for f in (np.min, np.max))
    products = np.round(rows @ rows.T, 12)
    least = np.sort(products, axis=1)[:, -6]
    visited = neighbours.cells_to_visit(rows, own, least, centres, inner, outer)
    row, near = np.nonzero(products >= least[:, None])
    assert visited[row, own[near]].all()
    assert visited.sum() < 2000 * 2
