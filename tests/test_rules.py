"""Exact rules on hand-made inputs, numeric fits against closed forms."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmith.functions import scalars as S
from oddsmith.functions import tails
from oddsmith.plans import calibration as C
from oddsmith.plans import causal as K
from oddsmith.plans import ladders as L
from oddsmith.plans import signals as G
from oddsmith.plans import studies as D
from oddsmith.plans import windows as W
from oddsmith.sources import tables

T0 = datetime(2024, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tails_against_tables():
    assert tails.f_tail(4.10, 2, 10) == pytest.approx(0.05, abs=2e-4)
    assert tails.f_tail(3.0, 1, 100) == pytest.approx(0.0863, abs=2e-4)
    assert tails.t_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_quantile(0.05, 10) == pytest.approx(2.2281, abs=1e-3)
    assert tails.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.beta_quantile(0.025, 10, 10) == pytest.approx(0.2886, abs=1e-4)
    assert tails.beta_cdf(0.5, 2, 2) == pytest.approx(0.5) and tails.beta_cdf(0.3, 1, 1) == pytest.approx(0.3)


def test_kelly(spark):
    kelly = lambda p, price: value(spark, G.kelly_fraction(F.lit(p), F.lit(price), 1.0))
    assert abs(kelly(0.5, 0.5)) < 0.01 and kelly(0.8, 0.3) > 0.3 and kelly(0.2, 0.7) > 0.3 and kelly(0.9, 0.995) == 0
    hurdle = lambda s, q: value(spark, G.impact_hurdle(F.lit(s), F.lit(q)))
    assert hurdle(100.0, 1000.0) < hurdle(400.0, 1000.0) and hurdle(1.0, 0.0) == 1.0


@pytest.mark.parametrize("text,want", [
    ("70.1 x 59.9 cm", (70.1, 59.9, None)), ("35 w x 25 h x 18 d cm", (25.0, 35.0, 18.0)), ("16.5 cm", (16.5, None, None)),
    ("10 x 20 in", (25.4, 50.8, None)), ("70,5 x 60 x 30 cm", (70.5, 60.0, 30.0)), ("n/a", (None, None, None)), (None, (None, None, None))])
def test_dimensions(spark, text, want):
    assert tuple(value(spark, S.parse_dimensions(F.lit(text).cast("string")))) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [
    ("2005", (2005, 0)), ("c.1920", (1920, 1)), ("circa 1890", (1890, 1)), ("20TH CENTURY", (1950, 1)), ("1920-1925", (1922, 1)), ("painted in 1999", (1999, 1)), ("9999 bc", (None, 0)), ("old", (None, 0))])
def test_years(spark, text, want):
    assert tuple(value(spark, S.parse_creation_year(F.lit(text)))) == want


@pytest.mark.parametrize("text,price", [("Rp 2,5 Miliar", 2.5e9), ("Rp 500 Juta", 5e8), ("Rp 1.250.000", 1250000.0), ("ask", None)])
def test_prices(spark, text, price):
    assert value(spark, S.parse_price_idr(F.lit(text))) == price


def test_small_text_rules(spark):
    assert value(spark, S.parse_area_m2(F.lit("2 are"))) == 200 and value(spark, S.parse_area_m2(F.lit("200 m²"))) == 200 and value(spark, S.parse_area_m2(F.lit("1,5 ha"))) == 15000
    assert tuple(value(spark, S.parse_coordinate(F.lit("8.35 LS")))) == (-8.35, 0.0) and tuple(value(spark, S.parse_coordinate(F.lit("115.50 BT")))) == (0.0, 115.5)
    assert value(spark, S.ou_threshold(F.lit("Total games o/u 22.5?"))) == 22.5 and value(spark, S.ou_threshold(F.lit("Who wins?"))) is None
    assert value(spark, S.ladder_template(F.lit("Set 1  O/U 9.5 "))) == "set 1 o/u {threshold}" and value(spark, S.ladder_template(F.lit("Who?"))) is None
    assert value(spark, S.search_terms(F.lit("Will it rain?"))) == "it rain"
    assert len(value(spark, S.search_terms(F.lit("Does " + "word " * 30)))) <= 60


def shape(spark, returns, volumes):
    rows = [(1, T0 + timedelta(hours=i), float(r), float(v)) for i, (r, v) in enumerate(zip(returns, volumes))]
    return W.shape_labels(spark.createDataFrame(rows, "k int, bucket timestamp, log_return double, volume_delta double"), ["k"]).first()


def test_shapes(spark):
    steady = shape(spark, [0.02] * 100, [1.0] * 100)
    assert (steady["trajectory"], steady["momentum"], steady["volume_pattern"]) == (0, 2, 2)
    assert shape(spark, [-0.02] * 90, [0.5] * 30 + [1.0] * 30 + [5.0] * 30)["volume_pattern"] == 1
    assert shape(spark, [-0.05] * 10 + [0.05] * 30, [1.0] * 40)["trajectory"] == 2
    assert shape(spark, [0.05, -0.05] * 10, [1.0] * 20)["trajectory"] == 3
    assert shape(spark, [0.1] * 5, [1.0] * 5)["trajectory"] == -1


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.0, 0)], "p double, y int")
    row = C.forecast_metrics(df).first()
    assert row["brier"] == 0 and row["ece_10"] == 0 and row["log_loss"] < 1e-5
    bins = C.reliability_bins(df).orderBy("bin_start").collect()
    assert [b["count"] for b in bins] == [2] + [0] * 8 + [1] and bins[4]["mean_pred"] is None
    half = C.longshot_bins(spark.createDataFrame([(0.5, 1), (0.97, 1), (0.015, 0)], "p double, y int"))
    assert {r["longshot_bin"]: r["n"] for r in half.collect()} == {2: 1, 1: 1}
    assert C.longshot_bins(spark.createDataFrame([(0.9, 1)], "p double, y int")).first()["relative_overpricing"] is None


def test_auc_and_empty_ledgers(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8) / 7, rng.randrange(2)) for _ in range(80)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "p double, y int")
    assert D.auc(df).first()["auc"] == pytest.approx(want)
    assert D.auc(df.where("y = 1")).first()["auc"] is None
    assert D.equity_metrics(spark.createDataFrame([], "run_id int, ts timestamp, trade_no long, pnl double"), 100.0).count() == 0


def test_isotonic_fit(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(size=12)
    rows = [("e", "l", float(i), float(v)) for i, v in enumerate(p)]
    got = [r["fitted"] for r in L.isotonic_fit(spark.createDataFrame(rows, "event_slug string, ladder string, strike double, p double")).orderBy("strike").collect()]
    want = [min(max(p[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert got == pytest.approx(want) and all(x >= y - 1e-12 for x, y in zip(got, got[1:]))


def test_simplex_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    w = K.simplex_weights(x, x @ np.array([0.7, 0.0, 0.3, 0.0]))
    assert w == pytest.approx([0.7, 0, 0.3, 0], abs=1e-4) and w.sum() == pytest.approx(1)


def series(spark, cols):
    rows = [(int(k), T0 + timedelta(hours=i), float(v)) for k, vs in cols.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "token_id long, bucket timestamp, price double")


def test_granger_finds_the_leader(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = np.concatenate([[0.0], 0.9 * x[:-1]]) + 0.1 * rng.normal(size=200)
    got = {(r["src"], r["dst"]): r for r in K.granger_matrix(series(spark, {1: x, 2: y, 3: np.ones(200)}), spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long"), 3).collect()}
    assert got[(1, 2)]["p_value"] < 1e-10 and got[(1, 2)]["lag"] == 1 and got[(1, 2)]["significant"] == 1
    assert got[(2, 1)]["p_value"] > 1e-3 and got[(3, 1)]["p_value"] > 0.05
    # lag 1 by hand
    t = np.arange(1, 200)
    small, full = np.column_stack([np.ones(199), y[t - 1]]), np.column_stack([np.ones(199), y[t - 1], x[t - 1]])
    ssr = [((y[t] - m @ np.linalg.lstsq(m, y[t], rcond=None)[0]) ** 2).sum() for m in (small, full)]
    one = K.granger_matrix(series(spark, {1: x, 2: y}), spark.createDataFrame([(1, 2)], "src long, dst long"), 1).first()
    assert one["f_stat"] == pytest.approx((ssr[0] - ssr[1]) / (ssr[1] / 196), rel=1e-6)


@pytest.mark.parametrize("n", [4, 9, 60])
def test_granger_against_least_squares(spark, n):
    """All lags by least squares on whole series: short ones, a constant one, a copy, and one that is shorter."""
    from oddsmith.functions.tails import f_tail

    rng = np.random.default_rng(n)
    cols = {1: rng.normal(size=n), 2: 0.4 + 0.01 * np.cumsum(rng.normal(size=n)), 3: np.full(n, 0.3), 5: rng.normal(size=n)[: n - 1]}
    cols[4] = cols[1] * 2 + 1
    pairs = [(a, b) for a in cols for b in cols if a != b]
    got = {(r["src"], r["dst"]): r for r in K.granger_matrix(series(spark, cols), spark.createDataFrame(pairs, "src long, dst long"), 3).collect()}
    for a, b in pairs:
        x, y = cols[a], cols[b]
        m = min(len(x), len(y))
        want = (1, 0.0, 1.0)
        for p in range(1, max(min(3, m // 3), 1) + 1):
            free = m - 3 * p - 1
            if m < 6 or free < 1:
                break
            own, other = ([v[p - k : m - k] for k in range(1, p + 1)] for v in (y, x))
            ssr = []
            for extra in ([], other):
                design = np.column_stack([np.ones(m - p), *own, *extra])
                ssr.append(float(((y[p:m] - design @ np.linalg.lstsq(design, y[p:m], rcond=1e-9)[0]) ** 2).sum()))
            f = (ssr[0] - ssr[1]) / p / (ssr[1] / free) if ssr[1] > 1e-15 else 0.0
            prob = float(f_tail(f, p, free))
            want = (p, f, prob) if prob < want[2] - 1e-9 else want
        r = got[a, b]
        if m < 6:
            assert (r["lag"], r["p_value"]) == (0, 1.0)
        else:
            assert r["p_value"] == pytest.approx(want[2], abs=1e-6)


def test_pc_finds_a_collider_and_cuts_a_chain(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=800), rng.normal(size=800)
    data = {1: a, 2: b, 3: a + b + 0.3 * rng.normal(size=800)}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")

    def dag(cols):
        changes = series(spark, cols).withColumnRenamed("price", "diff")
        return {(r["src"], r["dst"], r["type"]) for r in K.pc_dag(K.pairwise_correlation(changes, pairs), 0.01).collect()}

    assert dag(data) == {(1, 3, "directed"), (2, 3, "directed")}
    mid = a + 0.3 * rng.normal(size=800)
    assert dag({1: a, 2: mid, 3: mid + 0.3 * rng.normal(size=800)}) == {(1, 2, "undirected"), (2, 3, "undirected")}


def panel(spark, treated, controls, event_at=60):
    frames = [pd.DataFrame({"token_id": k, "treated": int(k == 1), "bucket": [T0 + timedelta(hours=i) for i in range(len(v))], "price": v}) for k, v in {1: treated, **controls}.items()]
    pdf = pd.concat(frames).assign(event_id=7, event_time=T0 + timedelta(hours=event_at))
    return spark.createDataFrame(pdf)


def test_event_impact_synthetic_control_and_anomalies(spark):
    rng = np.random.default_rng(3)
    c = {k: 0.5 + 0.1 * np.cumsum(rng.normal(size=90)) / 10 for k in (2, 3)}
    y = 0.6 * c[2] + 0.4 * c[3] + 0.001 * rng.normal(size=90)
    y[60:] += 0.2
    df = panel(spark, y, c)
    row = K.event_impact(df).first()
    assert row["point_effect"] == pytest.approx(0.2, abs=5e-3) and row["cumulative_effect"] == pytest.approx(6.0, abs=0.15) and row["p_value"] < 1e-6 and row["r2"] > 0.9
    assert row["ci_low"] < row["point_effect"] < row["ci_high"]
    sc = {r["donor"]: r for r in K.synthetic_control(df).collect()}
    assert sc[2]["weight"] == pytest.approx(0.6, abs=0.05) and sc[2]["average_effect"] == pytest.approx(0.2, abs=5e-3)
    odd = K.causal_anomalies(df.withColumnRenamed("event_id", "target").drop("event_time")).collect()
    assert [r["bucket"] for r in odd] == [T0 + timedelta(hours=60)]
    assert K.event_impact(df.where("bucket > event_time")).count() == 0


def wide_panel(spark, controls=150, steps=30, event_at=20):
    rng = np.random.default_rng(9)
    c = {k: 0.5 + 0.05 * np.cumsum(rng.normal(size=steps)) for k in range(2, 2 + controls)}
    c[40] = c[41] = c[42].copy()
    y = 0.5 * c[5] + 0.3 * c[80] + 0.2 * c[140] + 0.01 * rng.normal(size=steps)
    y[event_at:] += 0.3
    return panel(spark, y, c, event_at), y, np.column_stack([*c.values()]), list(c)


@pytest.mark.parametrize("controls", [12, 150])
def test_event_fits_take_every_control(spark, monkeypatch, controls):
    """Many controls as factors, in several rounds, against the fit on all of them; a series with a hole is left out."""
    from oddsmith.operators import factors

    monkeypatch.setattr(factors, "WIDTH", 8)
    df, y, x, _ = wide_panel(spark, controls) if controls > 100 else (*(lambda a: (panel(spark, a[1], dict(zip(range(2, 14), a[2].T[:12])), 20), a[1], a[2][:, :12]))(wide_panel(spark)), None)
    holed = panel(spark, y, {900: y}, 20).where("token_id = 900").limit(29)
    design = np.column_stack([np.ones(30), x])
    beta = np.linalg.lstsq(design[:20], y[:20], rcond=None)[0]
    gap = y - design @ beta
    row = K.event_impact(df.unionByName(holed)).first()
    assert row["point_effect"] == pytest.approx(gap[20:].mean(), abs=1e-8) and row["cumulative_effect"] == pytest.approx(gap[20:].sum(), abs=1e-7)
    dy, dx = np.diff(y), np.column_stack([np.ones(29), np.diff(x, axis=0)])
    rest = dy - dx @ np.linalg.lstsq(dx, dy, rcond=None)[0]
    odd = K.causal_anomalies(df.withColumnRenamed("event_id", "target").drop("event_time"), 1.5).collect()
    if np.std(rest) > 1e-10:
        want = {T0 + timedelta(hours=int(i) + 1) for i in np.flatnonzero(np.abs(rest) / rest.std() >= 1.5)}
        assert {r["bucket"] for r in odd} == want
    else:
        assert odd == []


def test_synthetic_control_over_many_donors(spark, monkeypatch):
    """Rounds of a small active set find the weights of the solver that sees all donors at once."""
    df, y, x, ids = wide_panel(spark)
    monkeypatch.setattr(K, "START", 4)
    monkeypatch.setattr(K, "ADDED", 3)
    got = K.synthetic_control(df).collect()
    w = K.simplex_weights(x[:20], y[:20], 200_000)
    best = float(((y[:20] - x[:20] @ w) ** 2).sum())
    assert got and sum(r["weight"] for r in got) == pytest.approx(1, abs=0.02)
    assert 20 * got[0]["pre_rmse"] ** 2 == pytest.approx(best, rel=1e-3, abs=1e-9)
    assert got[0]["average_effect"] == pytest.approx(float((y - x @ w)[20:].mean()), abs=2e-3)
    all_at_once = {r["donor"]: r["weight"] for r in (monkeypatch.setattr(K, "START", 1000), K.synthetic_control(df).collect())[1]}
    assert {k for k, v in all_at_once.items() if v > 0.05 and k not in (40, 41, 42)} == {r["donor"] for r in got if r["weight"] > 0.05 and r["donor"] not in (40, 41, 42)}


def newton(z, y):
    z = np.column_stack([np.ones(len(z)), z])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.pinv((z * (p * (1 - p))[:, None]).T @ z) @ z.T @ (y - p)
    return b


def test_walk_forward_windows_share_their_passes(spark):
    """Axes, fits and hits of each window against numpy on the rows of its blocks."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6))
    y = (x @ np.array([1, -0.5, 0.2, 0, 0, 0.3]) + rng.normal(size=500) > 0).astype(float)
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(y=y, k=np.arange(500))).repartition(4)
    for components in (2, None):
        got = [tuple(r) for r in D.walk_forward(df, cols, "y", ["k"], F.floor(F.col("k") / 50), 4, components).orderBy("window").collect()]
        for w in range(4):
            train, test = slice(0, 100 * (w + 1)), slice(100 * (w + 1), 100 * (w + 2))
            axes = np.linalg.eigh(np.cov(x[train].T, bias=True))[1][:, ::-1][:, :components] if components else np.eye(6)
            b = newton(x[train] @ axes, y[train])
            hit = ((b[0] + x[test] @ axes @ b[1:] > 0) == (y[test] == 1)).mean()
            assert got[w][:2] == (w + 1, 100) and got[w][2] == pytest.approx(hit)
    both = {r["direction"]: r["accuracy"] for r in D.temporal_stability(df, cols, "y", "k").collect()}
    b = newton(x[:250], y[:250])
    assert both["early_to_late"] == pytest.approx(((b[0] + x[250:] @ b[1:] > 0) == (y[250:] == 1)).mean(), abs=0.005)


def test_diagnostics_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    cols = list("abcde")
    got = {r["feature"]: r for r in D.feature_diagnostics(spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(3), cols).collect()}
    for i, c in enumerate(cols):
        others = np.column_stack([np.ones(300), np.delete(x, i, axis=1)])
        gap = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert got[c]["vif"] == pytest.approx(x[:, i].var() / gap.var(), rel=1e-6)
    assert got["a"]["condition_number"] == pytest.approx(np.sqrt(np.linalg.cond(np.corrcoef(x.T))), rel=1e-6)


def test_logistic_wald_matches_newton(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.7])))).astype(float)
    got = {r["term"]: r for r in D.logistic_wald(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})), ["a", "b"], "y").collect()}
    m, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ beta))
        info = m.T @ (m * (p * (1 - p))[:, None])
        beta += np.linalg.solve(info, m.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    for i, t in enumerate(["intercept", "a", "b"]):
        assert got[t]["coefficient"] == pytest.approx(beta[i], abs=1e-3) and got[t]["std_error"] == pytest.approx(se[i], rel=1e-2)


def test_ensemble_gates(spark):
    rng = random.Random(3)
    rows = []
    for obs in range(400):
        y = rng.randrange(2)
        good = (y - 0.5) + rng.gauss(0, 0.6)
        for name, pred in (("good", good), ("copy", good * 1.01), ("noise", -(y - 0.5) + rng.gauss(0, 3))):
            rows.append((name, obs, pred, float(y), int(obs % 4 != 0)))
    got = {e["signal"]: e for e in K.signal_ensemble(spark.createDataFrame(rows, "signal string, obs long, pred double, actual double, train int"), ["good", "copy", "noise"])}
    assert got["good"]["status"] == "validated" and got["good"]["weight"] == 1.0
    assert got["copy"]["status"] == "rejected" and got["copy"]["uniqueness"] < 0.01 and got["noise"]["status"] == "rejected"


def test_history_has_no_leak(spark):
    rows = [("x", T0 + timedelta(days=d), float(p), i) for i, (d, p) in enumerate([(0, 10), (1, 20), (2, 30), (3, 40), (4, 50), (5, 60), (5, 1000)])]
    got = {r["lot_id"]: r for r in W.artist_history(spark.createDataFrame(rows, "artist string, sale_date timestamp, price double, lot_id int")).collect()}
    want = np.log([10, 20, 30, 40, 50])
    for i in (5, 6):  # lots of one day do not see each other
        assert got[i]["avg_log_price"] == pytest.approx(want.mean()) and got[i]["price_std"] == pytest.approx(want.std()) and got[i]["median_log_price"] == pytest.approx(np.median(want))
    assert got[0]["prior_lots"] is None and got[1]["prior_lots"] == pytest.approx(math.log1p(1)) and got[4]["avg_log_price"] is None


def test_history_sends_the_lots_through_one_join(spark):
    """A lot without a day only has its artist's number of lots, one without an artist falls out; the wide rows meet one join."""
    rows = [("x", T0 + timedelta(days=d), 10.0 + d, d) for d in range(6)] + [("x", None, 5.0, 6), (None, T0, 5.0, 7), ("y", None, 5.0, 8)]
    found = W.artist_history(spark.createDataFrame(rows, "artist string, sale_date timestamp, price double, lot_id int"))
    got = {r["lot_id"]: r for r in found.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 8} and {i: got[i]["artist_lot_count"] for i in (0, 6, 8)} == {0: 7, 6: 7, 8: 1}
    assert got[6]["prior_lots"] is None and got[6]["avg_log_price"] is None and got[8]["is_rare_artist"] == 1 and got[5]["median_log_price"] == pytest.approx(math.log(12))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Join")]
    lots_side = [line for line in joins if "_artist" in line or "<=>" in line]
    assert joins[0] in lots_side and len(lots_side) == 1


def test_wide_projections_are_generated_in_short_methods(spark):
    """HotSpot leaves methods above 8,000 bytes interpreted."""
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c", "t", "Yes", 0.4, 10.0, "buy", str(i), T0 + timedelta(days=20 * i)) for i in range(6)],
                               "condition_id string, token_id string, outcome string, price double, size double, side string, trade_id string, timestamp timestamp")
    tables.write_table(df, str(tmp_path), "market_trades")
    read = tables.read_table(spark, str(tmp_path), "market_trades", since="2024-02-01 00:00:00", until="2024-03-15 00:00:00")
    assert sorted(r["trade_id"] for r in read.collect()) == ["2", "3"]
    assert "p_month" in read._jdf.queryExecution().executedPlan().toString()
    tables.write_report(df.groupBy("side").count(), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first()["count"] == "6"
    counts = df.groupBy("side").count()
    tables.write_report(counts, str(tmp_path / "lines"), "markdown")
    assert "| side | count |" in tables.markdown_head(counts) and spark.read.text(str(tmp_path / "lines")).first()["value"] == "| buy | 6 |"


def test_plans_push_down_and_prune(spark):
    """A two-column projection of one market reads two columns and pushes the filter to the scan."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_partkey = 3").select("l_partkey", "l_quantity")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,3)]" in plan and "l_shipdate" not in plan


def test_links_are_distinct_without_a_shuffle_of_links(spark):
    """Copies of an article, of a market, and several common entities give one link; the join is the last exchange."""
    from oddsmith.plans import news

    articles = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (2, ["d"]), (3, []), (None, ["a"])], "article_id long, entities array<string>")
    markets = spark.createDataFrame([("a", 10), ("b", 10), ("b", 10), ("c", 11), (None, 12), ("a", 13), ("d", 13)], "entity string, condition_id long")
    got = news.link_markets(articles, markets)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 10), (1, 11), (1, 13), (2, 13), (None, 10), (None, 13)], key=str)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join")]


def test_markets_of_an_entity_are_joined_in_packs(spark):
    """Ids are unpacked above the join, which sees a few rows a set of entities, and every link comes once."""
    from oddsmith.plans import news

    articles = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b"]) for i in range(5)], "article_id long, entities array<string>")
    markets = spark.createDataFrame([("b" if i % 3 else "a", i) for i in range(1500)] + [("b", None), ("a", 1)], "entity string, condition_id long")
    got = news.link_markets(articles, markets)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan[:plan.index("Join")].count("Generate") == 2
    has = [("b" if i % 3 else "a", i) for i in range(1500)] + [("b", None), ("a", 1)]
    want = {(i, m) for i in range(5) for e, m in has if e == "b" or i % 2}
    assert got.columns == ["article_id", "condition_id"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_rounding_is_that_of_decimals(spark):
    from oddsmith.catalog.registry import _round

    rng = np.random.default_rng(2)
    odd = [0.0, -0.0, 0.5e-6, 1.5e-6, -2.5e-6, 1.0000005, 2.0000015, 1e300, -1e12, 1234567.8912345, float("nan"), float("inf"), -float("inf"), None]
    values = odd + list(rng.normal(size=3000)) + list(rng.normal(size=1000) * 1e7) + list(np.arange(2000) / 2e6) + list(np.arange(500) * 0.0000005 + 17)
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")
    for digits in (6, 9):
        off = df.select(_round(F.col("x"), digits).alias("got"), F.round("x", digits).alias("want")).where("NOT (got <=> want)")
        assert off.count() == 0
