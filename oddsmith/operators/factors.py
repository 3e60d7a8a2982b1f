"""Many series as few: factors with the same inner products between time steps.

Least squares on any number of control series needs only what the controls span over the time
steps.  A block of k series over T steps, k above T, is replaced by the T columns of a triangular
factor with the same sum of x x'; blocks of factors are replaced again, until a group is one block.
A task holds ``width`` series of one length at most; nothing holds a group.  The least-squares fit of
smallest norm on the factors has the fitted values of the one on all series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.session import cut_lineage

#: series that a task takes at once; at least four times the steps
WIDTH = 512


def series_arrays(panel: DataFrame, by: Sequence[str], series: str, at: str, value: str) -> DataFrame:
    """(by, series, values in the order of ``at``) of the series of a group that have a value at each of its steps; an array is as long as the time axis."""
    by = list(by)
    points = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    arrays = panel.where(F.col(value).isNotNull()).groupBy(*by, series).agg(F.transform(points, lambda p: p["v"]).alias("x"))
    steps = panel.select(*by, at).distinct().groupBy(*by).agg(F.count("*").alias("_steps"))
    return arrays.join(steps, by).where(F.size("x") == F.col("_steps")).select(*by, series, "x")


def triangular(rows: np.ndarray) -> np.ndarray:
    """At most T rows with the same sum of x x' as the given rows of length T."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def factors(arrays: DataFrame, by: Sequence[str], width: int | None = None) -> DataFrame:
    """(by, x): as many rows a group as fit in one task, with the inner products of all its ``x``."""
    by = list(by)
    rows = arrays.select(*by, "x")
    schema = rows.schema
    while True:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.max(F.size("x")).alias("_steps"))
        wide = F.greatest(F.lit(width or WIDTH), 4 * F.col("_steps"))
        most = sizes.agg(F.max(F.col("_n") / wide)).first()[0]  # one number
        if most is None or most <= 1:
            return rows
        # numbered once and kept, so that a repeated task deals its rows out as before, equal series apart
        numbered = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
        sized = numbered.join(sizes, by).withColumn("_blocks", F.ceil(F.col("_n") / wide))

        def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
            out = triangular(np.vstack(pdf["x"].to_numpy()))
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(out) for c in by}, "x": list(out)})

        blocks = sized.withColumn("_block", F.pmod(F.xxhash64("_at"), F.col("_blocks"))).drop("_n", "_steps", "_blocks", "_at")
        rows = cut_lineage(blocks.groupBy(*by, "_block").applyInPandas(shrink, schema))
