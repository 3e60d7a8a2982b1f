"""Order-sensitive operators that never put a whole group into one task.

``Window.partitionBy(market).orderBy(ts)`` sorts every row of a market in a single
task, which stops working when one market holds a third of the data.  The operators
here split each group into chunks (an expression that never decreases along the
order, usually a time slice).  The window runs inside a chunk; what crosses a chunk
border comes from a per-chunk summary, which is a map-side combined aggregate with
one row per (group, chunk).  Only that summary is ordered per group, and its size is
bounded by the number of time slices, not by the number of rows.

The window and the join that brings the summary back use the same keys, so the
large side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400


def time_chunk(ts: str | Column, seconds: int = HOUR) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def _windows(by: Sequence[str]):
    inner = Window.partitionBy(*by, "_chunk")
    outer = Window.partitionBy(*by).orderBy("_chunk")
    return inner, outer


def with_neighbor(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    chunk: Column,
    ahead: bool = False,
) -> DataFrame:
    """Add columns of the previous (or next) row of the group: ``{new: source}``."""
    inner, outer = _windows(by)
    keys = [*by, "_chunk"]
    shift, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    packed = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    rows = df.withColumn("_chunk", chunk)
    edges = rows.groupBy(*keys).agg(edge(packed, F.struct(*order)).alias("_edge"))
    edges = edges.select(*keys, shift("_edge").over(outer).alias("_carry"))
    rows = rows.withColumn("_near", shift(packed).over(inner.orderBy(*order)))
    near = F.coalesce("_near", "_carry")
    return rows.join(edges, keys, "left").select(*df.columns, *[near[new].alias(new) for new in values])


def with_running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    peers: bool = False,
    include_current: bool = True,
) -> DataFrame:
    """Running sums and maxima over the group in order.

    ``peers`` uses a RANGE frame (rows equal in order share a value) instead of ROWS.
    Without ``include_current`` the row itself is left out; with ``peers`` its whole
    tie is, which needs one integer order column.
    """
    sums, maxima = sums or {}, maxima or {}
    inner, outer = _windows(by)
    keys = [*by, "_chunk"]
    parts = {**{n: (F.sum, c) for n, c in sums.items()}, **{n: (F.max, c) for n, c in maxima.items()}}
    rows = df.withColumn("_chunk", chunk)
    for name, (_, expr) in parts.items():
        rows = rows.withColumn(f"_in_{name}", expr)
    totals = rows.groupBy(*keys).agg(*[f(f"_in_{n}").alias(f"_tot_{n}") for n, (f, _) in parts.items()])
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, *[f(f"_tot_{n}").over(before).alias(f"_pre_{n}") for n, (f, _) in parts.items()])
    ordered = inner.orderBy(*order)
    frame = ordered.rangeBetween if peers else ordered.rowsBetween
    upto = frame(Window.unboundedPreceding, Window.currentRow if include_current else -1)
    for name, (f, _) in parts.items():
        rows = rows.withColumn(f"_acc_{name}", f(f"_in_{name}").over(upto))
    joined = rows.join(totals, keys, "left")
    out = []
    for name, (f, _) in parts.items():
        acc, pre = F.col(f"_acc_{name}"), F.col(f"_pre_{name}")
        merged = F.coalesce(acc + pre, acc, pre) if f is F.sum else F.greatest(acc, pre)
        out.append(merged.alias(name))
    return joined.select(*df.columns, *out)


def with_row_number(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column, name: str = "rn") -> DataFrame:
    """row_number() within the group, ascending, from 1."""
    return with_running(df, by, order, chunk, sums={name: F.lit(1)})
