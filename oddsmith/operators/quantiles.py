"""Exact quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one buffer.  Here a bounded
sketch proposes cut points, exact counts per cut range locate the ranks wanted, and
only the ranges that contain them are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{name: p}`` (nulls ignored)."""
    by = list(by)
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    counts = base.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx("_x", steps, F.lit(1000)).alias("_cuts"), F.sum("_n").alias("_total")
    )
    placed = counts.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))))
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_pn"), F.first("_total").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_pn").over(before), F.lit(0)))
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(F.lit(p) * (F.col("_total") - 1)).cast("long").alias("rank"))
            for name, p in wanted.items()
            for side, f in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    targets = (
        parts.withColumn("_w", F.explode(ranks))
        .where((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_pn")))
        .groupBy(*keys, "_part", "_before", "_total")
        .agg(F.collect_list("_w").alias("_ws"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_x")
    hits = (
        placed.drop("_cuts", "_total")
        .join(targets, [*keys, "_part"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_w", F.explode("_ws"))
        .where((F.col("_w.rank") < F.col("_end")) & (F.col("_w.rank") >= F.col("_end") - F.col("_n")))
    )
    out = []
    for name, p in wanted.items():
        lo = F.max(F.when((F.col("_w.name") == name) & (F.col("_w.side") == "lo"), F.col("_x")))
        hi = F.max(F.when((F.col("_w.name") == name) & (F.col("_w.side") == "hi"), F.col("_x")))
        pos = F.lit(p) * (F.max("_total") - 1)
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    # without groups there is always one row, of nulls when there are no values
    return hits.groupBy(*keys).agg(*out).select(*by, *wanted) if by else hits.agg(*out)
