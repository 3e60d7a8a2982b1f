"""Time-series causality on aligned series (token, bucket, value).

Pairs to test are given by the caller (markets of one event, edges of the similarity
graph), so nothing here pairs all tokens.  A series has one value per time bucket, so its
length is bounded by the calendar; the number of series of an event is not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from oddsmith.functions.scalars import clamp, correlation
from oddsmith.operators.factors import factors, series_arrays
from oddsmith.operators.gram import product_sums, square, triangle, unexplained
from oddsmith.operators.versions import limit_by
from oddsmith.session import cut_lineage

SERIES_KEY = ["token_id"]


# ---- Granger ----------------------------------------------------------------


def granger_best(grams: list[np.ndarray], n: int, max_lag: int) -> tuple[int, float, float]:
    """Lag, F and p of the lag with the smallest p for "x helps to predict y".

    ``grams[p - 1]``: sums of products of (1, y, y one to p earlier, x one to p earlier) over the
    steps that have p earlier ones, as a stored triangle.
    """
    from oddsmith.functions.tails import f_tail

    best = (1, 0.0, 1.0)
    if n < max_lag + 3:
        return (0, 0.0, 1.0)
    for p in range(1, max(min(max_lag, n // 3), 1) + 1):
        free = n - 3 * p - 1
        if free < 1:
            break
        gram = square(grams[p - 1])
        own, both = range(2, 2 + p), range(2, 2 + 2 * p)
        restricted, full = unexplained(gram, 1, own), unexplained(gram, 1, both)
        # explained but for rounding: no F
        if full <= max(1e-15, 1e-10 * unexplained(gram, 1, [])):
            continue
        f = ((restricted - full) / p) / (full / free)
        f = f if f > 1e-9 else 0.0
        prob = float(f_tail(f, p, free))
        if prob < best[2]:
            best = (p, f, prob)
    return best


def lagged(series: DataFrame, lags: int, value: str = "price") -> DataFrame:
    """token_id, step from 0, l0 ... of each value less the token's mean; the window is as long as the time axis."""
    w = Window.partitionBy("token_id").orderBy("bucket")
    centred = F.col(value) - F.avg(value).over(Window.partitionBy("token_id"))
    rows = series.select("token_id", (F.row_number().over(w) - 1).alias("step"), "bucket", centred.alias("l0"))
    return rows.select("token_id", "step", "l0", *[F.lag("l0", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])


def granger_matrix(series: DataFrame, pairs: DataFrame, max_lag: int = 10, value: str = "price") -> DataFrame:
    """(src, dst, lag, f_stat, p_value) for every given pair: "src leads dst".

    The rows of a pair are summed where they are: products of the values of both tokens and their
    lags, one combined row for each of the first ``max_lag`` steps and one for all others, so that each
    lag's sums over the steps it can use are sums of those.  The solver sees these numbers only.
    """
    fields = StructType([StructField("lag", IntegerType()), StructField("f_stat", DoubleType()), StructField("p_value", DoubleType())])
    steps = lagged(series, max_lag, value)
    names = [f"l{k}" for k in range(max_lag + 1)]
    target = steps.select(F.col("token_id").alias("dst"), "step", *[F.col(c).alias(f"y{c[1:]}") for c in names])
    source = steps.select(F.col("token_id").alias("src"), "step", *[F.col(c).alias(f"x{c[1:]}") for c in names[1:]])
    rows = pairs.join(target, "dst").join(source, ["src", "step"]).withColumn("head", F.least("step", F.lit(max_lag)))
    columns = ["y0", *[f"y{k}" for k in range(1, max_lag + 1)], *[f"x{k}" for k in range(1, max_lag + 1)]]
    cells = triangle(len(columns) + 1)
    place = {c: i + 1 for i, c in enumerate(columns)}
    sums = rows.groupBy("src", "dst", "head").agg(*[c.alias(f"g{i}_{j}") for (i, j), c in zip(cells, product_sums([F.col(c) for c in columns]), strict=True)])

    def of_lag(p: int) -> Column:
        used = [0, 1, *[place[f"y{k}"] for k in range(1, p + 1)], *[place[f"x{k}"] for k in range(1, p + 1)]]
        return F.array(*[F.coalesce(F.sum(F.when(F.col("head") >= p, F.col(f"g{used[i]}_{used[j]}"))), F.lit(0.0)) for i, j in triangle(len(used))]).alias(f"p{p}")

    grams = sums.groupBy("src", "dst").agg(F.sum("g0_0").cast("int").alias("n"), *[of_lag(p) for p in range(1, max_lag + 1)])

    @F.pandas_udf(fields)
    def test(n: pd.Series, of: pd.DataFrame) -> pd.DataFrame:
        found = [granger_best([np.asarray(g, float) for g in gs], int(k), max_lag) for k, gs in zip(n, of.itertuples(index=False))]
        return pd.DataFrame(found, columns=["lag", "f_stat", "p_value"])

    found = grams.withColumn("g", test("n", F.struct(*[f"p{p}" for p in range(1, max_lag + 1)])))
    return found.select("src", "dst", "g.*").withColumn("significant", F.when(F.col("p_value") < 0.05, 1).otherwise(0))


def leading_markets(edges: DataFrame, threshold: float = 0.05) -> DataFrame:
    """How many markets each one leads and follows; ``edges``: src, dst, p_value."""
    hit = edges.where(F.col("p_value") < threshold)
    both = hit.select(F.col("src").alias("token_id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        hit.select(F.col("dst").alias("token_id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    tokens = edges.select(F.explode(F.array("src", "dst")).alias("token_id")).distinct()
    sums = both.groupBy("token_id").agg(F.sum("out").alias("caused"), F.sum("in").alias("caused_by"))
    return tokens.join(sums, "token_id", "left").na.fill(0, ["caused", "caused_by"]).withColumn("net_influence", F.col("caused") - F.col("caused_by"))


# ---- PC skeleton ------------------------------------------------------------


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    from oddsmith.functions.tails import t_tail

    df = n.to_numpy(float) - 2
    c = np.clip(r.to_numpy(float), -0.999999999999, 0.999999999999)
    return pd.Series(t_tail(c * np.sqrt(df / (1 - c * c)), df))


def pairwise_correlation(changes: DataFrame, pairs: DataFrame, value: str = "diff") -> DataFrame:
    """Pearson correlation of the given pairs over their common buckets: (src, dst, r, n)."""
    a = changes.select(F.col("token_id").alias("src"), "bucket", F.col(value).alias("x"))
    b = changes.select(F.col("token_id").alias("dst"), "bucket", F.col(value).alias("y"))
    out = pairs.join(a, "src").join(b, ["dst", "bucket"]).groupBy("src", "dst").agg(correlation("x", "y").alias("r"), F.count("*").alias("n"))
    return out.withColumn("r", F.coalesce("r", F.lit(0.0)))


def _partial(ab: Column, ac: Column, bc: Column) -> Column:
    room = (1 - ac * ac) * (1 - bc * bc)
    return F.when(room > 1e-18, (ab - ac * bc) / F.sqrt(F.nullif(room, F.lit(0.0)))).otherwise(0.0)


def pc_dag(correlations: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Directed and undirected edges of the PC algorithm with up to two conditioning tokens.

    ``correlations`` holds each pair of a group once (src < dst).  Partial correlations
    come in closed form from the pairwise ones.  Edges of one depth are removed
    together (PC-stable), so the result does not depend on an order of pairs; the
    p-value always uses n - 2 degrees of freedom.  Arrows that contradict each other
    leave the edge undirected.
    """
    # every depth reads the pair table several times: keep it, and each skeleton, as data
    once = cut_lineage(correlations.select(F.col("src").alias("i"), F.col("dst").alias("j"), "r", "n"))
    full = once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "r", "n"))

    def table(i, j, name):
        return full.select(F.col("i").alias(i), F.col("j").alias(j), F.col("r").alias(name))

    scored = cut_lineage(once.withColumn("p", correlation_p("r", "n")))
    cut0 = scored.where(F.col("p") > alpha).select("i", "j", F.array().cast("array<long>").alias("sep"))
    edge0 = scored.where(F.col("p") <= alpha).select("i", "j", "r", "n")

    def around(edges):
        return edges.select("i", F.col("j").alias("k")).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("k")))

    near = around(edge0)
    tried = edge0.join(near, "i").unionByName(edge0.join(near.select(F.col("i").alias("j"), "k"), "j").select("i", "j", "r", "n", "k"))
    tried = tried.where("k <> i AND k <> j").distinct().join(table("i", "k", "rik"), ["i", "k"]).join(table("j", "k", "rjk"), ["j", "k"])
    tried = tried.withColumn("p", correlation_p(_partial(F.col("r"), F.col("rik"), F.col("rjk")), F.col("n")))
    cut1 = tried.where(F.col("p") > alpha).groupBy("i", "j").agg(F.array(F.min("k")).alias("sep"))
    cut1 = cut_lineage(cut1)
    edge1 = cut_lineage(edge0.join(cut1, ["i", "j"], "left_anti"))
    near1 = around(edge1)
    two = edge1.join(near1, "i").where("k <> j").join(near1.select("i", F.col("k").alias("l")), "i").where("l <> j AND k < l")
    for a, b in (("i", "k"), ("j", "k"), ("i", "l"), ("j", "l"), ("k", "l")):
        two = two.join(table(a, b, f"r{a}{b}"), [a, b])
    c = F.col
    given_k = [_partial(c("r"), c("rik"), c("rjk")), _partial(c("ril"), c("rik"), c("rkl")), _partial(c("rjl"), c("rjk"), c("rkl"))]
    two = two.withColumns({"q0": given_k[0], "q1": given_k[1], "q2": given_k[2]}).withColumn("p", correlation_p(_partial(c("q0"), c("q1"), c("q2")), c("n")))
    cut2 = two.where(F.col("p") > alpha).groupBy("i", "j").agg(F.min(F.struct("k", "l")).alias("m")).select("i", "j", F.array("m.k", "m.l").alias("sep"))
    cut2 = cut_lineage(cut2)
    edge2 = cut_lineage(edge1.join(cut2, ["i", "j"], "left_anti"))
    seps = cut0.unionByName(cut1).unionByName(cut2)
    near2 = around(edge2)
    collider = (
        near2.select(F.col("i").alias("k"), F.col("k").alias("i")).join(near2.select(F.col("i").alias("k"), F.col("k").alias("j")), "k")
        .where("i < j").join(seps, ["i", "j"]).where(~F.array_contains("sep", F.col("k"))))
    arrows = collider.select("i", "k").unionByName(collider.select(F.col("j").alias("i"), "k")).distinct()
    both_ways = edge2.select("i", "j", "r")
    fwd = arrows.select("i", F.col("k").alias("j"), F.lit(1).alias("fwd"))
    back = arrows.select(F.col("k").alias("i"), F.col("i").alias("j"), F.lit(1).alias("back"))
    rows = both_ways.join(fwd, ["i", "j"], "left").join(back, ["i", "j"], "left").na.fill(0, ["fwd", "back"])
    flip = (F.col("back") == 1) & (F.col("fwd") == 0)
    directed = F.col("fwd") != F.col("back")
    return rows.select(
        F.when(flip, F.col("j")).otherwise(F.col("i")).alias("src"), F.when(flip, F.col("i")).otherwise(F.col("j")).alias("dst"),
        F.when(directed, "directed").otherwise("undirected").alias("type"), F.col("r").alias("correlation"))


def merge_evidence(pc_edges: DataFrame, granger: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Edges found by either method: methods, confidence = methods / 2, bidirectional flag."""
    pc = pc_edges.select("src", "dst").unionByName(pc_edges.where("type = 'undirected'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = pc.select("src", "dst", F.lit("pc").alias("m")).unionByName(granger.where(F.col("p_value") < threshold).select("src", "dst", F.lit("granger").alias("m")))
    edges = both.groupBy("src", "dst").agg(F.concat_ws(",", F.array_sort(F.collect_set("m"))).alias("methods"), (F.count_distinct("m") / 2).alias("confidence"))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("rev"))
    return edges.join(reverse, ["src", "dst"], "left").select(
        "src", "dst", "methods", "confidence", F.when(F.col("rev") == 1, "bidirectional").otherwise("directed").alias("type"))


# ---- transfer entropy -------------------------------------------------------


def transfer_entropy(series: DataFrame, pairs: DataFrame, lag: int = 1, bins: int = 10, value: str = "price") -> DataFrame:
    """Transfer entropy in nats from src to dst, from joint counts of binned values."""
    w = Window.partitionBy("token_id").orderBy("bucket")
    rows = series.select("token_id", "bucket", F.col(value).alias("past"), F.lead(value, lag).over(w).alias("future")).where("future is not null")
    limits = rows.groupBy("token_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("past", "future") for n, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.join(limits, "token_id")

    def binned(c):
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(span < 1e-12, 0).otherwise(F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif(span, F.lit(0.0)) * bins), F.lit(bins - 1))).cast("int")

    cells = rows.select("token_id", "bucket", binned("past").alias("past"), binned("future").alias("future"))
    joint = pairs.join(cells.select(F.col("token_id").alias("dst"), "bucket", F.col("past").alias("tp"), F.col("future").alias("tf")), "dst").join(
        cells.select(F.col("token_id").alias("src"), "bucket", F.col("past").alias("sp")), ["src", "bucket"]).groupBy("src", "dst", "tf", "tp", "sp").agg(F.count("*").alias("c"))

    def total(*by):
        return F.sum("c").over(Window.partitionBy("src", "dst", *by))

    parts = joint.select("src", "dst", "c", total().alias("n"), total("tp").alias("c_tp"), total("tf", "tp").alias("c_ft"), total("tp", "sp").alias("c_ts"))
    te = F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("c_tp") / (F.col("c_ts") * F.col("c_ft")))
    return parts.groupBy("src", "dst").agg(F.greatest(F.sum(te), F.lit(0.0)).alias("transfer_entropy"), F.max("n").alias("n"))


def information_flow(edges: DataFrame) -> DataFrame:
    """Out-, in- and net flow of each token; positive net flow marks an information source."""
    te = F.col("transfer_entropy")

    def side(c, name):
        return edges.groupBy(F.col(c).alias("token_id")).agg(F.sum(te).alias(f"total_{name}"), F.avg(te).alias(f"avg_{name}"), F.max(te).alias(f"max_{name}"))

    cols = [f"{k}_{s}" for s in ("outflow", "inflow") for k in ("total", "avg", "max")]
    rows = side("src", "outflow").join(side("dst", "inflow"), "token_id", "full_outer").na.fill(0.0, cols)
    net = F.col("total_outflow") - F.col("total_inflow")
    return rows.withColumns({"net_flow": net, "role": F.when(net > 0, "source").otherwise("derivative")})


def top_sources(flows: DataFrame, n: int = 10) -> DataFrame:
    return flows.orderBy(F.desc("total_outflow"), "token_id").limit(n)


# ---- events -----------------------------------------------------------------


def _events(panel: DataFrame, key: str, *others: str) -> tuple[DataFrame, DataFrame]:
    """The treated series of each event as an array ``y`` with its number of controls, and the arrays of the controls.

    Only series with a value at every step of their event count.
    """
    arrays = cut_lineage(series_arrays(panel, [key, *others, "treated"], "token_id", "bucket", "price").join(
        panel.groupBy(key).agg(F.count_distinct("bucket").alias("_steps")), key).where(F.size("x") == F.col("_steps")).drop("_steps"))
    controls = arrays.where("treated = 0").select(key, "token_id", "x")
    counts = controls.groupBy(key).agg(F.count("*").alias("controls"))
    return arrays.where("treated = 1").select(key, *others, F.col("x").alias("y")).join(counts, key), controls


def _fit_on_factors(treated: DataFrame, controls: DataFrame, key: str, fit, schema: str) -> DataFrame:
    """``fit`` of each treated series on the factors of its controls; a group is one block of factors."""
    few = factors(controls, [key]).groupBy(key).agg(F.collect_list("x").alias("xs"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            rows = [row for r in pdf.to_dict("records") for row in fit(r, np.asarray(r["y"], float), np.vstack(r["xs"]).T)]
            yield pd.DataFrame(rows, columns=names)

    return treated.join(few, key).mapInPandas(run, schema)


def event_impact(panel: DataFrame, min_pre: int = 10) -> DataFrame:
    """Effect of an event on a treated series against a counterfactual from all its controls.

    ``panel``: event_id, event_time, token_id, treated, bucket, price.  The split is at the event
    time, not at a number of steps.  The controls, however many, come as factors with the same
    fitted values; with more controls than steps the fit is the one of smallest norm.
    """
    treated, controls = _events(panel, "event_id")
    before = panel.select("event_id", "event_time", "bucket").distinct().groupBy("event_id").agg(F.count_if(F.col("bucket") < F.col("event_time")).alias("pre"))

    def fit(row, y, xs):
        from oddsmith.functions.tails import t_quantile, t_tail

        pre = np.arange(len(y)) < row["pre"]
        if pre.sum() < min_pre or (~pre).sum() < 1:
            return
        design = np.column_stack([np.ones(len(y)), xs])
        beta, *_ = np.linalg.lstsq(design[pre], y[pre], rcond=None)
        gap = y - design @ beta
        ss_res, ss_tot = float(gap[pre] @ gap[pre]), float(((y[pre] - y[pre].mean()) ** 2).sum())
        dof = max(int(pre.sum()) - int(row["controls"]) - 1, 1)
        se = np.sqrt(ss_res / dof) / np.sqrt((~pre).sum())
        point = float(gap[~pre].mean())
        margin = float(t_quantile(0.05, dof)) * se
        p = float(t_tail(point / se if se > 0 else 0.0, dof))
        base = float(y[pre].mean())
        yield [row["event_id"], point, float(gap[~pre].sum()), point / base if base else 0.0, point - margin, point + margin, p, 1 - ss_res / ss_tot if ss_tot > 0 else 0.0]

    names = ["point_effect", "cumulative_effect", "relative_effect", "ci_low", "ci_high", "p_value", "r2"]
    return _fit_on_factors(treated.join(before, "event_id"), controls, "event_id", fit, "event_id long, " + ", ".join(f"{n} double" for n in names))


def simplex_weights(x: np.ndarray, y: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Convex weights minimising |y - x w|^2 by accelerated projected gradient."""

    def project(v):
        u = np.sort(v)[::-1]
        cum = np.cumsum(u) - 1
        k = np.nonzero(u - cum / np.arange(1, len(v) + 1) > 0)[0][-1]
        return np.maximum(v - cum[k] / (k + 1), 0)

    gram, rhs = x.T @ x, x.T @ y
    rate = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    w = z = np.full(x.shape[1], 1.0 / x.shape[1])
    t = 1.0
    for _ in range(steps):
        new = project(z - rate * (gram @ z - rhs))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-12:
            w = new
            break
        w, t = new, t_new
    return w


#: donors of an event that a solution starts from, and those added in a round
START, ADDED = 64, 16
#: share of the gradient by which a donor must be better than those in use
BETTER = 1e-6


def synthetic_control(panel: DataFrame, min_pre: int = 5) -> DataFrame:
    """Donor weights and mean and total effect; one row per event and donor of weight > 0.001.

    The weights are convex and minimise the squared gap before the event over all donors, however
    many: an event's active set holds the donors in use, its weights are solved exactly, donors
    left without weight go, and those whose gradient is steepest among all others (one combined
    top-k an event and round) come in, until no donor would lower the gap.  An active set is never larger
    than the steps, ``START`` and ``ADDED`` together.
    """
    treated, donors = _events(panel, "event_id")
    before = panel.select("event_id", "event_time", "bucket").distinct().groupBy("event_id").agg(F.count_if(F.col("bucket") < F.col("event_time")).alias("pre"))
    treated = cut_lineage(treated.join(before, "event_id").where((F.col("pre") >= min_pre) & (F.size("y") > F.col("pre"))))
    donors = donors.join(treated.select("event_id", "pre"), "event_id")

    def dot(a, b):
        return F.aggregate(F.zip_with(F.slice(a, 1, F.col("pre")), F.slice(b, 1, F.col("pre")), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, k = np.vstack(pdf["x"].to_numpy()).T, np.asarray(pdf["y"].iloc[0], float), int(pdf["pre"].iloc[0])
        w = simplex_weights(x[:k], y[:k])
        gap = y - x @ w
        slope = -(x[:k].T @ gap[:k])
        return pd.DataFrame({"event_id": [pdf["event_id"].iloc[0]], "active": [pdf["token_id"].tolist()], "weights": [w.tolist()], "gap": [gap.tolist()], "level": [float(w @ slope)], "size": [float(np.abs(slope).max())]})

    closeness = F.aggregate(F.zip_with(F.slice("x", 1, F.col("pre")), F.slice("y", 1, F.col("pre")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = donors.join(treated.select("event_id", "y"), "event_id").withColumn("near", closeness)
    active = cut_lineage(limit_by(near, ["event_id"], [F.asc("near"), F.asc("token_id")], START).select("event_id", "token_id"))
    while True:
        rows = active.join(donors, ["event_id", "token_id"]).join(treated.select("event_id", "y"), "event_id")
        solved = cut_lineage(rows.groupBy("event_id").applyInPandas(solve, "event_id long, active array<long>, weights array<double>, gap array<double>, level double, size double"))
        # donors in use have the same slope, the level; a donor further down would lower the gap
        others = donors.join(solved, "event_id").where(~F.array_contains("active", F.col("token_id"))).withColumn("slope", -dot("x", "gap"))
        better = others.where(F.col("slope") < F.col("level") - BETTER * F.col("size")).select("event_id", "token_id", "slope")
        better = cut_lineage(limit_by(better, ["event_id"], [F.asc("slope"), F.asc("token_id")], ADDED).select("event_id", "token_id"))
        if better.isEmpty():
            break
        used = solved.select("event_id", F.explode(F.arrays_zip("active", "weights")).alias("u")).where("u.weights > 0").select("event_id", F.col("u.active").alias("token_id"))
        # events without a better donor keep their set
        active = cut_lineage(used.unionByName(better))
    each = solved.join(treated.select("event_id", "pre"), "event_id")
    gaps = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, v: s + f(v))
    after = F.slice("gap", F.col("pre") + 1, F.size("gap") - F.col("pre"))
    each = each.select(
        "event_id", F.explode(F.arrays_zip("active", "weights")).alias("u"), F.sqrt(gaps(F.slice("gap", F.lit(1), F.col("pre")), lambda v: v * v) / F.col("pre")).alias("pre_rmse"),
        (gaps(after, lambda v: v) / F.size(after)).alias("average_effect"), gaps(after, lambda v: v).alias("cumulative_effect"))
    return each.where("u.weights > 0.001").select("event_id", F.col("u.active").alias("donor"), F.col("u.weights").alias("weight"), "pre_rmse", "average_effect", "cumulative_effect")


def what_if(breaks: DataFrame, related: DataFrame, prices: DataFrame) -> DataFrame:
    """Projected price after an event like the past breaks of a token and of its related tokens.

    ``related``: token_id, related_id (a few per token); ``prices``: token_id, price.
    """
    signed = breaks.select("token_id", (F.when(F.col("direction") == "up", 1.0).otherwise(-1.0) * F.round("magnitude", 6)).alias("move"))
    own = prices.select("token_id", F.col("token_id").alias("of"))
    links = own.unionByName(related.select("token_id", F.col("related_id").alias("of")))
    found = links.join(signed.withColumnRenamed("token_id", "of"), "of").groupBy("token_id").agg(
        F.avg("move").alias("impact"), F.stddev_pop("move").alias("impact_std"), F.count("*").alias("analogies"))
    rows = prices.select("token_id", F.col("price").alias("current_price")).join(found, "token_id", "left").na.fill(0.0, ["impact", "impact_std"]).na.fill(0, ["analogies"])
    return rows.withColumn("projected_price", clamp(F.col("current_price") + F.col("impact"), 0.0, 1.0))


def causal_anomalies(panel: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Changes of a target that its parents, however many, do not explain.

    ``panel``: target, token_id, treated (1 for the target itself), bucket, price.  Changes of
    factors have the inner products of the changes of all parents.
    """
    treated, parents = _events(panel, "target")
    steps = panel.select("target", "bucket").distinct().groupBy("target").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))

    def fit(row, y, xs):
        if len(y) < 10:
            return
        dy, dx = np.diff(y), np.diff(xs, axis=0)
        design = np.column_stack([np.ones(len(dy)), dx])
        beta, *_ = np.linalg.lstsq(design, dy, rcond=None)
        gap = dy - design @ beta
        std = float(gap.std())
        if std <= 1e-10:
            return
        for i in np.flatnonzero(np.abs(gap) / std >= sigma):
            yield [row["target"], int(i) + 1, float(gap[i]), float(abs(gap[i]) / std)]

    found = _fit_on_factors(treated, parents, "target", fit, "target long, step int, residual double, sigma_score double")
    return found.join(steps, "target").select("target", F.get("buckets", F.col("step")).alias("bucket"), "residual", "sigma_score")


# ---- signal ensemble --------------------------------------------------------


def signal_accuracy(signals: DataFrame) -> DataFrame:
    """Share of correct signs per signal, in and out of sample; signals: signal, obs, pred, actual, train."""
    hit = F.when(F.when(F.col("pred") > 0, 1.0).otherwise(0.0) == F.col("actual"), 1.0).otherwise(0.0)
    train = F.col("train") == 1
    return signals.groupBy("signal").agg(F.avg(F.when(train, hit)).alias("in_sample"), F.avg(F.when(~train, hit)).alias("out_of_sample"))


def signal_ensemble(
    signals: DataFrame, names: list[str], min_in: float = 0.52, min_out: float = 0.51, min_unique: float = 0.3, min_gain: float = 0.0,
) -> list[dict]:
    """Admit signals in the order of ``names`` through the four gates and weight them.

    The list of signals is short and known to the caller; the observations stay in
    Spark.  They are turned to one row per observation with a column per signal, every
    correlation comes from one aggregate, and each admission is one more.
    """
    wide = signals.groupBy("obs", "actual", "train").pivot("signal", names).agg(F.first("pred")).persist()
    try:
        scores = {r["signal"]: r for r in signal_accuracy(signals.where(F.col("signal").isin(names))).collect()}
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        corr = wide.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
        active: list[str] = []
        out = []
        for name in names:
            row = scores.get(name)
            entry = {"signal": name, "in_sample": row["in_sample"] if row else None, "out_of_sample": row["out_of_sample"] if row else None,
                     "uniqueness": None, "marginal": None, "status": "rejected", "weight": 0.0}
            out.append(entry)
            if row is None or (row["in_sample"] or 0) < min_in or (row["out_of_sample"] or 0) < min_out:
                continue
            links = [corr[f"{a}|{name}"] for a in active]
            links = [abs(c) for c in links if c is not None]
            entry["uniqueness"] = 1.0 - sum(links) / len(links) if links else 1.0
            if entry["uniqueness"] < min_unique:
                continue
            entry["marginal"] = _gain(wide, active, name) if active else 0.01
            if entry["marginal"] < min_gain:
                continue
            entry["status"] = "validated"
            active.append(name)
        raw = {e["signal"]: max(0.001, (e["out_of_sample"] - 0.5) * e["uniqueness"]) for e in out if e["status"] == "validated"}
        for e in out:
            if e["status"] == "validated":
                e["weight"] = raw[e["signal"]] / sum(raw.values())
        return out
    finally:
        wide.unpersist()


def _gain(wide: DataFrame, active: list[str], name: str) -> float:
    mean = sum((F.col(a) for a in active), F.lit(0.0)) / len(active)
    with_new = (mean * len(active) + F.col(name)) / (len(active) + 1)

    def accuracy(p):
        return F.avg(F.when(F.when(p > 0, 1.0).otherwise(0.0) == F.col("actual"), 1.0).otherwise(0.0))

    row = wide.where("train = 0").agg(accuracy(mean).alias("old"), accuracy(with_new).alias("new")).first()
    return row["new"] - row["old"]


def ensemble_prediction(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    w = F.coalesce(*[F.when(F.col("signal") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    return signals.withColumn("_w", w).groupBy("obs").agg(
        clamp(F.coalesce(F.sum(F.col("pred") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0)), F.lit(0.0)), -100.0, 100.0).alias("prediction"))


def rebalance(previous: DataFrame, recent: DataFrame, alpha: float = 0.3, retire: float = 0.48) -> DataFrame:
    """Blend the newest accuracy into the running one and retire signals that fell below the limit."""
    now = signal_accuracy(recent.withColumn("train", F.lit(0))).select("signal", F.col("out_of_sample").alias("_now"))
    score = F.when(F.col("_now").isNull(), F.col("out_of_sample")).otherwise(alpha * F.col("_now") + (1 - alpha) * F.coalesce("out_of_sample", "_now"))
    rows = previous.join(now, "signal", "left").withColumn("score", score)
    return rows.select("signal", "score", "uniqueness", F.when(F.col("score") < retire, "retired").otherwise("active").alias("status"))
