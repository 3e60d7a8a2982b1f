"""Order statistics of everything before a day, for all days at once, without gathering a key.

A window that keeps the values of a key to find their median holds a whole key in one task.
Here the distinct (key, day, value) points are range-partitioned by key and value, so a cell is
a run of values of a key, or several small keys.  Counts by (key, cell, day) tell each query
(key, day, rank) which cell holds its rank and how many earlier values lie below that cell; the
cell then answers all its queries at once.  Points are shuffled a fixed number of times, however
many values a key has.  What a task holds is a cell: about ``POINTS`` points, or the days of one
value; a key that lies in several cells adds its counts by cell and day.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oddsmith.operators.ordered import with_running
from oddsmith.session import cut_lineage

#: points of a cell, about; cells grow when there would be more than ``CELLS``
POINTS = 100_000
CELLS = 2048
#: days whose counts are summed in one window, and in one grid of days and cells
DAYS = 365


def ranks_in_cell(by: Sequence[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Answer (key, day, rank) queries among the cell's points of the key on earlier days.

    Points lie in order of key and day, so a query is a range of places.  Bit by bit of the
    values' numbers, from the highest, points with 0 move before points with 1 in stable order
    (a wavelet matrix); running weights tell a query its side, and its range moves along.
    """
    by = list(by)

    def ranked(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if points.empty or asked.empty:
            return asked[[*by, "_day"]].head(0).assign(_value=0.0)
        keys = pd.concat([points[by], asked[by]]).groupby(by, sort=False).ngroup().to_numpy()
        days = np.concatenate([points["_day"], asked["_day"]])
        days -= days.min()
        span = days.max() + 1
        place = keys * span + days
        here = place[: len(points)]
        order = np.argsort(here, kind="stable")
        here = here[order]
        low = np.searchsorted(here, keys[len(points):] * span)
        high = np.searchsorted(here, place[len(points):])
        values, number = np.unique(points["_value"].to_numpy()[order], return_inverse=True)
        weight = points["_n"].to_numpy()[order]
        rank, found = asked["_rank"].to_numpy(), np.zeros(len(asked), np.int64)
        for bit in reversed(range((len(values) - 1).bit_length())):
            zero = (number >> bit) & 1 == 0
            zeros = np.concatenate([[0], np.cumsum(zero)])
            weights = np.concatenate([[0], np.cumsum(np.where(zero, weight, 0))])
            below = weights[high] - weights[low]
            above = rank >= below
            rank = np.where(above, rank - below, rank)
            found |= above.astype(np.int64) << bit
            low, high = (np.where(above, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
            moved = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            number, weight = number[moved], weight[moved]
        return asked[[*by, "_day"]].assign(_value=values[found])

    return ranked


def cells_of_ranks(by: Sequence[str], least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From a key's counts by (cell, day), the cell of the middle ranks of each day and the ranks inside it."""
    by = list(by)

    def chosen(counts: pd.DataFrame) -> pd.DataFrame:
        cells, cell = np.unique(counts["_cell"], return_inverse=True)
        days, day = np.unique(counts["_day"], return_inverse=True)
        order = np.argsort(day, kind="stable")
        cell, day, n = cell[order], day[order], counts["_n"].to_numpy()[order]
        seen, parts = np.zeros(len(cells), np.int64), []
        for first in range(0, len(days), DAYS):
            here = slice(*np.searchsorted(day, [first, first + DAYS]))
            grid = np.zeros((min(DAYS, len(days) - first), len(cells)), np.int64)
            np.add.at(grid, (day[here] - first, cell[here]), n[here])
            upto = np.cumsum(seen + np.cumsum(grid, axis=0) - grid, axis=1)
            seen = seen + grid.sum(axis=0)
            at = np.flatnonzero(upto[:, -1] >= least)
            earlier, upto = upto[at, -1], upto[at]
            for rank in ((earlier - 1) // 2, earlier // 2):
                # as many cells as end at or before the rank lie below it
                below = (upto <= rank[:, None]).sum(axis=1)
                passed = np.where(below > 0, upto[np.arange(len(at)), below - 1], 0)
                parts.append(pd.DataFrame({"_day": days[first + at], "_cell": cells[below], "_rank": rank - passed}))
        return pd.concat(parts).assign(**{b: counts[b].iloc[0] for b in by})

    return chosen


def earlier_medians(df: DataFrame, by: Sequence[str], day: str, value: str, least: int = 1) -> DataFrame:
    """(by, day, earlier, median): for each day of a key, the number and the median of its values on earlier days.

    ``day`` is an integer.  Rows without a key, day or value are left out; a day with fewer than
    ``least`` earlier values has a null median.
    """
    by, least = list(by), max(least, 1)
    rows = df.select(*by, F.col(day).cast("long").alias("_day"), F.col(value).cast("double").alias("_value")).dropna()
    points = cut_lineage(rows.groupBy(*by, "_day", "_value").agg(F.count("*").alias("_n")))
    cells = min(max(-(-points.count() // POINTS), 1), CELLS)  # one number
    # equal values of a key lie in one range
    points = cut_lineage(points.repartitionByRange(cells, *by, "_value").withColumn("_cell", F.spark_partition_id().cast("long")))
    counts = cut_lineage(points.groupBy(*by, "_cell", "_day").agg(F.sum("_n").alias("_n")))
    days = counts.groupBy(*by, "_day").agg(F.sum("_n").alias("_n"))
    totals = cut_lineage(with_running(days, by, ["_day"], F.floor(F.col("_day") / DAYS), sums={"earlier": F.col("_n")}, include_current=False).na.fill(0, ["earlier"]).drop("_n"))
    spans = counts.groupBy(*by).agg(F.min("_cell").alias("_cell"), F.max("_cell").alias("_last"))
    # the two middle ranks of an even number of values, the same one twice of an odd number
    ranks = F.explode(F.array(F.floor((F.col("earlier") - 1) / 2).cast("long"), F.floor(F.col("earlier") / 2).cast("long")))
    asked = totals.where(F.col("earlier") >= least).join(spans.where("_cell = _last"), by).select(*by, "_day", "_cell", ranks.alias("_rank"))
    keys = [points.schema[b] for b in [*by, "_day"]]
    wide = counts.join(spans.where("_cell < _last").select(*by), by, "left_semi").groupBy(*by).applyInPandas(cells_of_ranks(by, least), StructType([*keys, StructField("_cell", LongType()), StructField("_rank", LongType())]))
    # columns of their own: both sides come from the same points
    held, queries = (side.select(*[F.col(c).alias(c) for c in side.columns]).groupBy("_cell") for side in (points, asked.unionByName(wide)))
    answers = held.cogroup(queries).applyInPandas(ranks_in_cell(by), StructType([*keys, points.schema["_value"]]))
    found = answers.groupBy(*by, "_day").agg(((F.min("_value") + F.max("_value")) / 2).alias("median"))
    return totals.join(found, [*by, "_day"], "left").select(*by, F.col("_day").cast("int").alias(day), "earlier", "median")
