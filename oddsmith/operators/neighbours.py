"""Exact nearest neighbours of every row among all rows, by pivots and the triangle inequality.

1. Equal vectors form one class.  Ties go to the smaller id, so of a class only its ``k + 1``
   smallest ids can be anybody's neighbour, and all its members share one list of ``k + 1``
   entries, from which each leaves out itself.
2. Every class goes to the cell of its nearest pivot, and large cells are dealt to blocks by hash.
   A search in the own block gives each class a first list, whose last entry bounds how far the
   rest of its neighbours can be.
3. A cell is visited only if it may hold something as near: the distance to its pivot must be within
   the bound of the cell's nearest and farthest member, and the border between the cells not farther than
   the bound.  Racks of ``RACK`` blocks are in memory together, so that a visitor is sent once a rack, however
   many of its blocks it visits; visitors stream past, and a rack with many is held by several tasks.
4. The best ``k + 1`` entries of all visited blocks remain, cut in each partition before the shuffle.

Only the pivots (at most ``PIVOTS`` vectors) and one row a cell pass through the driver.  Without
structure in the vectors no bound excludes anything, and the search compares all pairs of blocks, as any
exact search then must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from oddsmith.operators.versions import limit_by
from oddsmith.session import cut_lineage

#: most pivots, so also most cells
PIVOTS = 1024
#: classes a block holds, about
BLOCK = 2048
#: blocks held in memory together by a task of the second search
RACK = 32
#: visits of a block that make a task, about; a rack takes four times as many
VISITORS = 1 << 18
#: distances come from rounded products; a cell is left out only if it is farther by this much
SLACK = 1e-6
_CHUNK = 256
_SLOTS = ["rack", "slice", "visitor", "block", "head", "v", "members", "least", "wanted"]


def units(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, scaled to length 1; a zero vector stays."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1.0)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def cells_to_visit(rows: np.ndarray, own: np.ndarray, least: np.ndarray, pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Rows x cells: whether a cell (members between ``inner`` and ``outer`` from its pivot) may hold a product of ``least`` or more with the row, whose cell is ``own``."""
    reach = np.sqrt(np.maximum(2 - 2 * np.maximum(least, -1.0), 0))[:, None] + SLACK
    d = distances(rows, pivots)
    may = (d - outer <= reach) & (inner - d <= reach)
    apart = distances(pivots, pivots)[own]
    nearest = d[np.arange(len(rows)), own][:, None]
    border = np.divide(d**2 - nearest**2, 2 * apart, out=np.zeros_like(d), where=apart > SLACK)
    # squares of distances carry more of the rounding where pivots are close
    return may & (border <= reach + SLACK / np.maximum(apart, SLACK))


def _compare(fit: tuple, part: pa.RecordBatch, take: int) -> Iterator[pa.RecordBatch]:
    """Members of the fit classes that are among the ``take`` best of each visitor and not under its bound."""
    vectors, first, count, ids, labels = fit
    visitors, head, least = units(part.column("v")), part.column("head").to_numpy(), part.column("least").to_numpy()
    for at in range(0, len(visitors), _CHUNK):
        near = np.round(visitors[at : at + _CHUNK] @ vectors.T, 12)
        hit = near >= least[at : at + _CHUNK, None]
        many = np.flatnonzero(hit.sum(axis=1) > take)
        if len(many):
            last = np.partition(near[many], -take, axis=1)[:, -take]
            hit[many] &= near[many] >= last[:, None]
        row, column = np.nonzero(hit)
        if not len(row):
            continue
        times = count[column]
        member = np.repeat(first[column] - np.cumsum(times) + times, times) + np.arange(times.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(head[at + row], times)), pa.array(np.repeat(near[row, column], times)), ids.take(pa.array(member)), labels.take(pa.array(member))],
            names=["head", "score", "id", "label"],
        )


def _fit(parts: list[pa.RecordBatch]) -> tuple:
    members = pa.concat_arrays([p.column("members") for p in parts])
    count = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = members.flatten()
    return np.vstack([units(p.column("v")) for p in parts]), np.cumsum(count) - count, count, flat.field("id"), flat.field("label")


def _search(rows: DataFrame, take: int) -> DataFrame:
    """(head, score, id, label) of the visitors of each (rack, slice), whose fit rows come first; ``wanted`` names the blocks to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, fits = None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("rack", "slice", "visitor", "block")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                rack, visitor, block = tuple(key[:2, lo]), key[2, lo], key[3, lo]
                part = batch.slice(lo, hi - lo)
                if rack != held:
                    held, parts, fits = rack, {}, {}
                if not visitor:
                    parts.setdefault(block, []).append(part)
                    continue
                wanted = part.column("wanted")
                row = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                blocks = wanted.flatten().to_numpy()
                for block in np.unique(blocks):
                    if block not in fits:
                        fits[block] = _fit(parts.pop(block))
                    yield from _compare(fits[block], part.take(pa.array(row[blocks == block])), take)

    spread = rows.repartition("rack", "slice").sortWithinPartitions("rack", "slice", "visitor", "block")
    members = rows.schema["members"].dataType.elementType
    return spread.mapInArrow(run, f"head long, score double, id long, label {members['label'].dataType.simpleString()}")


def _of_cell(values: dict[int, int], cells: int) -> Column:
    return F.element_at(F.lit([int(values.get(c, 0)) for c in range(cells)]), F.col("cell") + 1)


def _trips(home: DataFrame, held: DataFrame, own: DataFrame, cells: dict, parts: dict[int, int], starts: dict[int, int], points: np.ndarray, take: int, visitors: int) -> DataFrame:
    """Rows of the second search: every class as a visitor of the blocks, but its own, that its first list does not rule out, and these blocks."""
    number = len(points)
    bounds = own.groupBy("head").agg(F.when(F.count("*") == take, F.min("score")).otherwise(float("-inf")).alias("least"))
    inner, outer = (np.array([cells[c][name] if c in cells else np.inf * sign for c in range(number)]) for name, sign in (("inner", 1), ("outer", -1)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                may = cells_to_visit(units(part.column("v")), part.column("cell").to_numpy(), part.column("least").to_numpy(), points, inner, outer)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(may.sum(axis=1))), pa.int32()), pa.array(np.nonzero(may)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("head", "v", "least", "block")), lists], names=["head", "v", "least", "home", "cells"])

    located = home.select("head", "v", "cell", "block").join(bounds, "head")
    trips = cut_lineage(located.select("head", "v", "least", "cell", "block").mapInArrow(visits, f"head long, v {held.schema['v'].dataType.simpleString()}, least double, home int, cells array<int>"))
    # the blocks a class visits, but its own, by rack
    first, last = (F.lit([int(f(c)) for c in range(number)]) for f in (lambda c: starts.get(c, 0), lambda c: starts.get(c, 0) + parts.get(c, 1) - 1))
    blocks = F.flatten(F.transform("cells", lambda c: F.sequence(F.element_at(first, c + 1), F.element_at(last, c + 1))))
    blocks = F.filter(blocks, lambda b: b != F.col("home"))
    calls = trips.select("head", "v", "least", blocks.alias("blocks"))
    calls = calls.withColumn("rack", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.floor(b / RACK).cast("int")))))
    calls = calls.withColumn("wanted", F.filter("blocks", lambda b: F.floor(b / RACK) == F.col("rack")))
    # a task takes four times the visits that one block gets, so that copies of a rack stay few
    asked = {r["rack"]: -(-r["visits"] // (4 * visitors)) for r in calls.groupBy("rack").agg(F.sum(F.size("wanted")).alias("visits")).collect()}
    slices = lambda rack: F.element_at(F.lit([int(asked.get(r, 0)) for r in range(sum(parts.values()) // RACK + 1)]), rack + 1)
    calls = calls.withColumn("slice", F.pmod(F.xxhash64("head"), slices(F.col("rack"))).cast("int")).withColumns({"visitor": F.lit(1), "block": F.lit(-1), "members": F.lit(None).cast(held.schema["members"].dataType)})
    shown = held.withColumn("rack", F.floor(F.col("block") / RACK).cast("int"))
    shown = shown.where(slices(F.col("rack")) > 0).withColumn("slice", F.explode(F.sequence(F.lit(0), slices(F.col("rack")) - 1)))
    return shown.select(*_SLOTS).union(calls.select(*_SLOTS))


def nearest_neighbours(rows: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS, visitors: int = VISITORS) -> DataFrame:
    """(id, label, neighbours) of ``rows`` (id long, v array of float or double, label): the k other rows of greatest cosine, exactly.

    ``neighbours`` is an array of (score, id, label), best first; scores are rounded to 12 places and ties
    go to the smaller id.  Ids are unique and vectors of one length.  Rows whose vector is null, or holds a
    null or NaN, neither get nor are neighbours; a zero vector has score 0 with everything.  With fewer than
    k other rows a list is shorter; an empty table gives an empty result.
    """
    take = k + 1
    whole = rows.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))").select("id", "label", "v")
    keyed = whole.withColumn("c1", F.xxhash64("v")).withColumn("c2", F.xxhash64(F.lit(1), "v"))
    grouped = limit_by(keyed, ["c1", "c2"], [F.col("id")], take).groupBy("c1", "c2")
    classes = cut_lineage(grouped.agg(F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list(F.struct("id", "label"))).alias("members")).withColumn("head", F.col("members")[0]["id"]))
    wanted = min(pivots, max(1, classes.count() // block))
    chosen = classes.orderBy(F.xxhash64("c1"), "c1", "c2").limit(wanted).select("v").toArrow().column("v").combine_chunks()
    if not len(chosen):
        lists = F.expr(f"CAST(NULL AS array<struct<score: double, id: bigint, label: {rows.schema['label'].dataType.simpleString()}>>)")
        return whole.select("id", "label", lists.alias("neighbours"))
    points = units(chosen)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(units(batch.column("v")), points)
                cell = d.argmin(axis=1)
                extra = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cell", "d"])

    placed = cut_lineage(classes.mapInArrow(place, StructType([*classes.schema, StructField("cell", IntegerType()), StructField("d", DoubleType())])))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("inner"), F.max("d").alias("outer")).collect()}
    parts = {c: -(-r["n"] // block) for c, r in cells.items()}
    starts = dict(zip(sorted(parts), np.cumsum([0, *[parts[c] for c in sorted(parts)]])))
    number = len(points)
    home = placed.withColumn("block", _of_cell(starts, number) + F.pmod(F.xxhash64("c1", "c2"), _of_cell(parts, number)).cast("int"))
    held = home.select("cell", "block", F.lit(0).alias("visitor"), "head", "v", "members", F.lit(0.0).alias("least"), F.lit(None).cast("array<int>").alias("wanted"))
    no_members = F.lit(None).cast(held.schema["members"].dataType)

    alone = {"rack": F.col("block"), "slice": F.lit(0)}
    guests = home.select("block", F.lit(1).alias("visitor"), "head", "v", no_members.alias("members"), F.lit(float("-inf")).alias("least"), F.array("block").alias("wanted"))
    best = [F.col("score").desc(), F.col("id")]
    own = cut_lineage(limit_by(_search(held.withColumns(alone).select(*_SLOTS).union(guests.withColumns(alone).select(*_SLOTS)), take), ["head"], best, take))

    if sum(parts.values()) > 1:
        own = own.unionByName(_search(_trips(home, held, own, cells, parts, starts, points, take, visitors), take))
    final = limit_by(own, ["head"], best, take).groupBy("head").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "label"))).alias("entries"))
    lists = final.join(classes.select("head", "c1", "c2"), "head").select("c1", "c2", F.transform("entries", lambda e: F.struct((-e["far"]).alias("score"), e["id"].alias("id"), e["label"].alias("label"))).alias("entries"))
    mine = F.filter("entries", lambda e: e["id"] != F.col("id"))
    return keyed.drop("v").join(lists, ["c1", "c2"]).select("id", "label", F.slice(mine, 1, k).alias("neighbours"))
