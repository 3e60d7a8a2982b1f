"""Model checks and trading metrics: fits from sums of products, one combined aggregate a step, and plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from oddsmith.operators.gram import correlation, covariance, logistic_fits, logistic_hits, moments
from oddsmith.operators.neighbours import nearest_neighbours
from oddsmith.operators.ordered import DAY, time_chunk, with_row_number, with_running
from oddsmith.operators.versions import limit_by
from oddsmith.session import cut_lineage


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def _vectors(df: DataFrame, cols: Sequence[str], *others: Column | str) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), *others)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairs (a, b, r) of the features, from one pass of summed products; the matrix is features x features."""
    m = correlation(moments(_vectors(df, cols), len(cols))[0])
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def feature_diagnostics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """VIF per feature, condition number and mean and largest |cosine| of the centred features."""
    m = correlation(moments(_vectors(df, cols), len(cols))[0])
    inverse, values = np.linalg.pinv(m), np.linalg.eigvalsh(m)
    condition = float(np.sqrt(values[-1] / max(values[0], 1e-300)))
    off = np.abs(m[np.triu_indices(len(cols), 1)])
    rows = [(c, float(inverse[i, i]), condition, float(off.mean()), float(off.max()), int((off > 0.3).sum())) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, condition_number double, mean_cosine double, max_cosine double, pairs_over long")


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 20) -> DataFrame:
    """Bits that the binned feature tells about the label; all features in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    rows = df.select(F.col(label).alias("y"), F.explode(cells).alias("c")).select("y", "c.*").where("x is not null")
    limits = rows.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    # one row per feature
    binned = rows.join(F.broadcast(limits), "feature").withColumn("bin", F.when(span <= 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(span, F.lit(0.0)) * bins), F.lit(bins - 1))))
    joint = binned.groupBy("feature", "bin", "y").agg(F.count("*").alias("c"))
    by_bin, by_y, total = (joint.groupBy("feature", *k).agg(F.sum("c").alias(n)) for k, n in ((["bin"], "cb"), (["y"], "cy"), ([], "n")))
    parts = joint.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(total, "feature")
    p = F.col("c") / F.col("n")
    return parts.groupBy("feature").agg(F.sum(p * F.log2(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))).alias("bits"))


def logistic_wald(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Logistic coefficients with Wald z and p; each step of the fit, and the information matrix, is one combined aggregate."""
    from oddsmith.functions.tails import normal_tail

    rows = cut_lineage(_vectors(df, cols, F.col(label).alias("y"), F.lit(0).alias("block")))
    (beta,), (fisher,) = logistic_fits(rows, [[0]], [np.eye(len(cols))])
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(fisher)), 1e-300))
    p = normal_tail(beta / se)
    out = [(n, float(b), float(s), float(b / s), float(q)) for n, b, s, q in zip(["intercept", *cols], beta, se, p)]
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, std_error double, z double, p_value double")


def principal_axes(gram: np.ndarray, components: int) -> np.ndarray:
    """The first principal axes (d x components) of the rows behind a matrix of ``moments``."""
    _, vectors = np.linalg.eigh(covariance(gram))
    return vectors[:, ::-1][:, :components]


def walk_forward(df: DataFrame, cols: Sequence[str], label: str, order: Sequence[str], chunk: Column, windows: int = 4, components: int | None = None) -> DataFrame:
    """Accuracy of (PCA +) logistic on the next block, trained on all blocks before it.

    One pass sums the products of every block; the axes of a window come from the sum over its blocks.
    The fits of all windows share their passes.
    """
    n = df.agg(F.count("*").alias("_n"))
    ranked = with_row_number(df, [], order, chunk, "_rn").crossJoin(F.broadcast(n))
    block = F.least(F.floor((F.col("_rn") - 1) * (windows + 1) / F.col("_n")), F.lit(windows))
    rows = cut_lineage(_vectors(ranked, cols, F.col(label).alias("y"), block.cast("int").alias("block")))
    d = len(cols)
    upto, bases = np.zeros((d + 1, d + 1)), []
    sums = moments(rows, d, block="block")
    for w in range(windows):
        upto = upto + sums.get(w, 0)
        bases.append(principal_axes(upto, components) if components else np.eye(d))
    beta, _ = logistic_fits(rows, [list(range(w + 1)) for w in range(windows)], bases)
    hits = logistic_hits(rows, {w: w + 1 for w in range(windows)}, beta, bases)
    return df.sparkSession.createDataFrame([(w + 1, *hits.get(w, (0, None))) for w in range(windows)], "window int, n long, accuracy double")


def temporal_stability(df: DataFrame, cols: Sequence[str], label: str, order: str) -> DataFrame:
    """Train on one half in time, score the other, both ways."""
    from oddsmith.operators.quantiles import exact_quantiles

    half = exact_quantiles(df.withColumn("_o", F.col(order).cast("double")), [], "_o", {"_mid": 0.5})
    late = F.when(F.col(order) > F.col("_mid"), 1).otherwise(0)
    rows = cut_lineage(_vectors(df.crossJoin(F.broadcast(half)), cols, F.col(label).alias("y"), late.alias("block")))  # one row
    bases = [np.eye(len(cols))] * 2
    beta, _ = logistic_fits(rows, [[0], [1]], bases)
    hits = logistic_hits(rows, {0: 1, 1: 0}, beta, bases)
    names = ("early_to_late", "late_to_early")
    return df.sparkSession.createDataFrame([(names[w], hits[w][1] if w in hits else None) for w in (0, 1)], "direction string, accuracy double")


def auc(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores are counted first."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").alias("n"))
    ranked = with_running(counts, [], ["s"], F.floor(F.col("s") * 256), sums={"upto": F.col("n")})
    rank = F.col("upto") - (F.col("n") - 1) / 2
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(((F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))).alias("auc"))


def classification_metrics(df: DataFrame, score: str = "p", label: str = "y", cut: float = 0.5) -> DataFrame:
    hat = F.when(F.col(score) >= cut, 1).otherwise(0)
    y = F.col(label)
    cells = df.agg(*[F.count_if((hat == h) & (y == v)).alias(n) for n, h, v in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    rows = cells.withColumns({
        "accuracy": (tp + tn) / F.nullif(tp + tn + fp + fn, zero), "balanced_accuracy": (F.coalesce(tp / F.nullif(tp + fn, zero), zero) + F.coalesce(tn / F.nullif(tn + fp, zero), zero)) / 2,
        "f1": F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, zero), zero)})
    return rows.crossJoin(F.broadcast(auc(df, score, label)))  # one row each


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    from oddsmith.operators.quantiles import exact_quantiles

    y, gap = F.col(actual), F.col(actual) - F.col(predicted)
    rows = df.agg(
        (1 - F.sum(gap * gap) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))
    ape = df.where(y != 0).withColumn("_ape", F.abs(gap / F.nullif(y, F.lit(0.0))))
    return rows.crossJoin(F.broadcast(exact_quantiles(ape, [], "_ape", {"mdape": 0.5})))


def flat_bet_pnl(df: DataFrame, order: Sequence[str], chunk: Column, stake: float = 100.0, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Bet on outcomes above ``high`` or below ``low`` with a fixed stake; running and lowest result."""
    p, y = F.col("p"), F.col("y")
    yes, no = p > high, p < low
    win = F.when(yes, y == 1).otherwise(y == 0)
    paid = F.when(yes, p).otherwise(1 - p)
    bets = df.where(yes | no).withColumn("pnl", F.when(win, stake * (1 / F.nullif(paid, F.lit(0.0)) - 1)).otherwise(-stake))
    running = with_running(bets, [], order, chunk, sums={"cumulative": F.col("pnl")})
    return with_running(running.withColumn("_neg", -F.col("cumulative")), [], order, chunk, maxima={"_low": F.col("_neg")}).withColumn("lowest", -F.col("_low")).drop("_neg", "_low")


def signal_pnl(signals: DataFrame, trades: DataFrame, markets: DataFrame, min_score: float = 15.0, stake: float = 100.0, spread: float = 0.01) -> DataFrame:
    """Result of the newest signal of each resolved market at its mean trade price, net of spread."""
    newest = limit_by(signals, ["condition_id"], [F.desc("computed_at"), F.desc("score")]).select("condition_id", "score")
    vwap = trades.where("outcome = 'Yes'").groupBy("condition_id").agg(F.avg("price").alias("vwap"), F.count("*").alias("trades")).where("trades >= 3")
    done = markets.where("resolved = 1").select("condition_id", "winning_outcome")
    rows = newest.join(vwap, "condition_id").join(done, "condition_id").where(F.abs("score") >= min_score)
    yes = F.col("score") > 0
    paid = F.least(F.lit(0.99), F.when(yes, F.col("vwap")).otherwise(1 - F.col("vwap")) + spread)
    win = F.when(yes, F.col("winning_outcome") == "Yes").otherwise(F.col("winning_outcome") == "No")
    return rows.withColumns({"paid": paid, "won": F.when(win, 1).otherwise(0)}).withColumn("pnl", F.when(F.col("won") == 1, stake * (1 / F.col("paid") - 1)).otherwise(-stake))


def equity_metrics(ledger: DataFrame, capital: float, chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Return, win rate, profit factor, drawdown, Sharpe and Calmar of each run; ledger: run_id, ts, trade_no, pnl."""
    key, order, chunk = ["run_id"], ["ts", "trade_no"], time_chunk("ts", chunk_seconds)
    equity = with_running(ledger, key, order, chunk, sums={"sum_pnl": F.col("pnl")}).withColumn("equity", capital + F.col("sum_pnl"))
    marked = with_running(equity, key, order, chunk, maxima={"peak": F.greatest(F.col("equity"), F.lit(capital))})
    r = F.col("pnl") / capital
    rows = marked.groupBy("run_id").agg(
        F.count("*").alias("trades"), (F.sum("pnl") / capital).alias("total_return"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        (F.sum(F.greatest("pnl", F.lit(0.0))) / F.nullif(F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))), F.lit(0.0))).alias("profit_factor"),
        F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("max_drawdown"), F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"))
    return rows.withColumns({
        "sharpe": F.coalesce(F.col("_m") / F.nullif("_s", F.lit(0.0)) * F.sqrt(F.lit(252.0)), F.lit(0.0)), "calmar": F.coalesce(F.col("total_return") / F.nullif("max_drawdown", F.lit(0.0)), F.lit(0.0)),
    }).drop("_m", "_s")


def direction_accuracy(df: DataFrame) -> DataFrame:
    """Share of right directions and pnl per unit of Kelly stake; df: predicted, price, y, kelly."""
    up = F.col("predicted") > F.col("price")
    right = F.when(up, F.col("y") == 1).otherwise(F.col("y") == 0)
    paid = F.when(up, F.col("price")).otherwise(1 - F.col("price"))
    pnl = F.col("kelly") * F.when(right, 1 / F.nullif(paid, F.lit(0.0)) - 1).otherwise(-1.0)
    return df.agg(F.count("*").alias("n"), F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"), F.sum(pnl).alias("pnl"), (F.sum(pnl) / F.nullif(F.sum("kelly"), F.lit(0.0))).alias("pnl_per_kelly"))


def platt_calibration(df: DataFrame, logit: str, label: str) -> tuple[DataFrame, float, float]:
    """Calibrated probability sigmoid(a x + b) with a, b fitted by logistic regression."""
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=100, tol=1e-9).fit(assemble(df, [logit]))
    a, b = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(a) * F.col(logit) + F.lit(b))))), a, b


def label_silhouette(df: DataFrame, vector: str, label: str) -> float:
    rows = df.select(F.col(vector).alias("features"), F.col(label).cast("int").alias("prediction"))
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction", distanceMeasure="cosine").evaluate(rows)


def neighbour_label_accuracy(df: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """Share of labelled rows whose k nearest labelled rows (by cosine, itself left out) mostly share their label.

    Neighbours come from all labelled rows, exactly; ties go to the smaller key.  A row without any other
    has a share of 0.
    """
    # floats stay floats: half the bytes in every exchange, and the search computes in doubles either way
    single = df.schema[vector].dataType == ArrayType(FloatType())
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col(vector) if single else F.transform(vector, lambda x: x.cast("double"))).alias("v"), F.col(label).cast("long").alias("label"))
    near = F.col("neighbours")
    same = F.size(F.filter(near, lambda e: e["label"] == F.col("label"))) / F.nullif(F.size(near), F.lit(0))
    vote = nearest_neighbours(rows, k).select(F.coalesce(same, F.lit(0.0)).alias("same"))
    return vote.agg(F.count("*").alias("n"), F.avg("same").alias("same_label"), F.avg(F.when(F.col("same") > 0.5, 1.0).otherwise(0.0)).alias("accuracy"))
