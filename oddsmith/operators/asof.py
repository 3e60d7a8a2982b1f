"""As-of joins: union both sides, carry the newest right row forward (or backward).

Hot keys are split in time like in ``ordered``: the frame covers one chunk, and the
value that enters a chunk comes from the per-chunk summary of the right side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.operators.ordered import HOUR, time_chunk


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    values: dict[str, str],
    direction: str = "backward",
    right_on: str | None = None,
    tie: Sequence[str] = (),
    tolerance: int | None = None,
    allow_equal: bool = True,
    chunk_seconds: int = HOUR,
    matched_at: str | None = None,
) -> DataFrame:
    """For each left row the last right row at or before it (``forward``: first at or after).

    ``values`` maps new columns to right columns, ``tie`` orders right rows of one
    time, ``tolerance`` is in seconds.  Unmatched rows get nulls.  ``matched_at`` adds
    the time of the match.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    right_on = right_on or on
    # where the left row stands among right rows of the same time
    left_rank = 1 if back == allow_equal else -1
    types = dict(right.dtypes)
    vtype = ", ".join(f"{new}: {types[src]}" for new, src in values.items())
    pack = f"struct<_at: timestamp, {vtype}>"
    tie_cols = [F.lit(None).cast(types[c]).alias(f"_tie{i}") for i, c in enumerate(tie)]
    ties = [f"_tie{i}" for i in range(len(tie))]
    lrows = left.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col(on).cast("timestamp").alias("_t"),
        F.lit(left_rank).alias("_s"),
        *tie_cols,
        F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(pack).alias("_v"),
    )
    rrows = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col(right_on).cast("timestamp").alias("_t"),
        F.lit(0).alias("_s"),
        *[F.col(c).alias(t) for c, t in zip(tie, ties)],
        F.lit(None).cast(lrows.schema["_l"].dataType).alias("_l"),
        F.struct(F.col(right_on).cast("timestamp").alias("_at"), *[F.col(s).alias(n) for n, s in values.items()])
        .cast(pack)
        .alias("_v"),
    )
    keys = [f"_by_{c}" for c in by]
    rows = lrows.unionByName(rrows).withColumn("_chunk", time_chunk("_t", chunk_seconds))
    place = F.when(F.col("_v").isNotNull(), F.struct("_t", *ties))
    edge = F.max_by if back else F.min_by
    edges = rows.groupBy(*keys, "_chunk").agg(edge("_v", place).alias("_edge"))
    # forward runs over the reverse order: a frame that ends at the last row would be read again for every row
    way = F.asc if back else F.desc
    outer = Window.partitionBy(*keys).orderBy(way("_chunk"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*[way(c) for c in ("_t", "_s", *ties)])
    carry = F.last("_edge", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1))
    near = F.last("_v", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.select(*keys, "_chunk", carry.alias("_carry"))
    hit = F.coalesce("_near", "_carry")
    out = (
        rows.withColumn("_near", near)
        .where(F.col("_l").isNotNull())
        .join(edges, [*keys, "_chunk"], "left")
        .withColumn("_hit", hit)
    )
    if tolerance is not None:
        gap = F.abs(F.unix_micros("_t") - F.unix_micros(F.col("_hit._at")))
        out = out.withColumn("_hit", F.when(gap <= tolerance * 1_000_000, F.col("_hit")))
    extra = [F.col("_hit._at").alias(matched_at)] if matched_at else []
    return out.select("_l.*", *[F.col(f"_hit.{n}").alias(n) for n in values], *extra)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    values: dict[str, str],
    right_on: str | None = None,
    tie: Sequence[str] = (),
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """The right row nearest in time; of two equally near the earlier one."""
    right_on = right_on or on
    back = asof_join(
        left, right, by, on, {f"_b_{n}": s for n, s in values.items()}, "backward", right_on, tie,
        chunk_seconds=chunk_seconds, matched_at="_b_at",
    )
    both = asof_join(
        back, right, by, on, {f"_f_{n}": s for n, s in values.items()}, "forward", right_on, tie,
        chunk_seconds=chunk_seconds, matched_at="_f_at",
    )
    here = F.unix_micros(F.col(on).cast("timestamp"))
    use_back = F.col("_f_at").isNull() | (here - F.unix_micros("_b_at") <= F.unix_micros("_f_at") - here)
    use_back = F.col("_b_at").isNotNull() & use_back
    return both.select(
        *left.columns,
        *[F.when(use_back, F.col(f"_b_{n}")).otherwise(F.col(f"_f_{n}")).alias(n) for n in values],
    )


def last_at_cutoffs(
    facts: DataFrame, cutoffs: DataFrame, by: Sequence[str], on: str, cutoff: str, value: str, order: Sequence[str], name: str
) -> DataFrame:
    """Last value at or before each cutoff when a key has a few cutoffs only.

    One equi-join and one combined aggregate: nothing is sorted per key, so a hot key
    costs no more than its rows.  ``cutoffs`` holds (by..., tag columns..., cutoff).
    """
    tags = [c for c in cutoffs.columns if c not in by]
    hits = facts.join(cutoffs, list(by), "inner").where(F.col(on) <= F.col(cutoff))
    return hits.groupBy(*by, *tags).agg(F.max_by(value, F.struct(*order)).alias(name))
