"""Graph operators on edge frames (src, dst, weight): joins and aggregates in rounds.

Loops keep one bounded frame per round and cut the lineage with reliable checkpoints,
so a lost executor costs one round.  The only values that reach the driver are counts
that decide when to stop.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from oddsmith.operators.floods import flood, levels_of
from oddsmith.session import cut_lineage

EARTH_KM = 6371.0
#: tasks that share a crowded key of a join
DEALT = 16


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def _edge_state(pairs: DataFrame) -> tuple:
    """Size and a full-width hash sum of an edge set."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component): alternating large-star and small-star, logarithmic in practice.

    Each step needs only the minimum of a node's neighbours (a combined aggregate) and
    a join back, so a hub is never gathered in one task.  The rounds end when the edges
    no longer change; ``max_rounds`` is a guard that raises.
    """
    # dealt before they are made distinct: edges rarely repeat, and the task that makes them would hold them all
    pairs = edges.select("src", "dst").where("src <> dst").repartition("src", "dst").distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    pairs = cut_lineage(pairs)
    before = _edge_state(pairs)
    for _ in range(max_rounds):
        # large star: every larger neighbour moves to the smallest node around
        near = both_ways(pairs)
        low = near.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        pairs = near.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        down = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        pairs = down.join(low, "src").select("dst", "m").unionByName(low.select(F.col("src").alias("dst"), "m")).where("dst <> m").select(
            F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        pairs = cut_lineage(pairs)
        # stars are stable when the edge set repeats
        state = _edge_state(pairs)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


HOPS = 6


def _spread(known: DataFrame, step: DataFrame, value: str, combine: Callable[[Column, Column], Column], best: Callable[[str], Column], better: Callable[[Column, Column], Column], keep: str) -> DataFrame:
    """Relax (origin, node, value) over (src, dst, by) until no value improves.

    A round follows a few hops from the nodes that changed in the round before, and
    checkpoints what it improved; nodes that are settled are not joined again.
    """
    known = changed = cut_lineage(known)
    while True:
        moved = front = changed
        for _ in range(HOPS):
            front = front.join(step, front["node"] == step["src"]).select("origin", F.col("dst").alias("node"), combine(F.col(value), F.col("by")).alias(value)).where(keep)
            front = front.groupBy("origin", "node").agg(best(value).alias(value))
            moved = moved.unionByName(front)
        moved = moved.groupBy("origin", "node").agg(best(value).alias(value))
        old = known.select(F.col("origin").alias("o"), F.col("node").alias("n"), F.col(value).alias("old"))
        moved = moved.join(old, (F.col("origin") == F.col("o")) & (F.col("node") == F.col("n")), "left")
        changed = cut_lineage(moved.where(F.col("old").isNull() | better(F.col(value), F.col("old"))).select("origin", "node", value))
        if changed.isEmpty():
            return known
        known = cut_lineage(known.unionByName(changed).groupBy("origin", "node").agg(best(value).alias(value)))


def shortest_paths(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, node, cost): least cost from each origin over directed edges, however many hops away."""
    step = edges.select("src", "dst", F.col("weight").alias("by"))
    if not step.where("by < 0").isEmpty():
        raise ValueError("edge weights must not be negative")
    start = origins.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"))
    return _spread(start, step, "cost", lambda a, b: a + b, F.min, lambda new, old: new < old, "true")


#: levels and kinds of factors up to which intensities spread level by level
LEVELS, KINDS = 24, 64


def spread_intensity(edges: DataFrame, origins: DataFrame, factor: str = "factor", floor: float = 0.05) -> DataFrame:
    """Best product of edge factors along any path, dropped below ``floor``; factors are at most 1.

    Factors of a few kinds, whose products have few values, spread level by level with a bit a pair
    (``floods``); all others are relaxed pair by pair.
    """
    links = cut_lineage(edges.select("src", "dst", F.col(factor).cast("double").alias("by")))
    if not links.where("by > 1").isEmpty():
        raise ValueError("edge factors must not pass 1")
    step = both_ways(links)
    kinds = [r["by"] for r in links.where("by IS NOT NULL").select("by").distinct().limit(KINDS + 1).collect()]
    levels = levels_of(kinds, floor, LEVELS) if len(kinds) <= KINDS and floor > 0 and all(0 < k < 1 for k in kinds) else None
    alike = len({links.schema["src"].dataType, links.schema["dst"].dataType, origins.schema["origin"].dataType}) == 1
    # each level leads to lower ones only
    if levels and alike and all(j is None or j > i for i, leads in enumerate(levels[1]) for j in leads):
        return flood(step, origins, kinds, *levels, "intensity")
    start = origins.select("origin", F.col("origin").alias("node"), F.lit(1.0).alias("intensity"))
    return _spread(start, step, "intensity", lambda a, b: a * b, F.max, lambda new, old: new > old, f"intensity >= {floor!r}")


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """Undirected weights with self loops of 1, divided by the root of both degrees."""
    around = both_ways(edges.select("src", "dst", "weight"))
    loops = around.select(F.col("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    full = around.unionByName(loops)
    degree = full.groupBy("src").agg(F.sum("weight").alias("d"))
    return full.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").select(
        "src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("d2"))).alias("weight"))


#: edges that a cell of the triangle count gets on average, wedges it holds at once
CELL_EDGES, WEDGES = 1 << 21, 1 << 22


def _cell_triangles(cell: pa.Table) -> pa.Table:
    """(node, triangles) of the edges of one cell; triangles of one colour count in the cell of that colour alone."""
    ids = pa.chunked_array([*cell["a"].chunks, *cell["b"].chunks]).unique()
    ends = [np.asarray(pa.compute.index_in(cell[c], ids).combine_chunks()).astype(np.int64) for c in "ab"]
    n = len(ids)
    colour = np.empty(n, dtype=np.int64)
    for end, c in zip(ends, "ab"):
        colour[end] = cell[f"c{c}"].to_numpy()
    # from the end of lower degree, so that no node has many outgoing edges
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(np.bincount(np.concatenate(ends), minlength=n), kind="stable")] = np.arange(n)
    shade = np.empty(n, dtype=np.int64)
    shade[place] = colour
    low, high = np.minimum(place[ends[0]], place[ends[1]]), np.maximum(place[ends[0]], place[ends[1]])
    code = np.sort(low * n + high)
    low, high = np.divmod(code, n)
    last = np.searchsorted(low, low, "right")
    after = last - np.arange(len(code)) - 1  # edges of the same node that follow
    total = np.zeros(n, dtype=np.int64)
    mixed = len(np.unique(colour)) > 1
    stop, begin = np.cumsum(after), 0
    while begin < len(code):
        before = stop[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(stop, before + WEDGES, "right")))
        some = after[begin:end]
        x = np.repeat(np.arange(begin, end), some)
        y = x + 1 + np.arange(len(x)) - np.repeat(stop[begin:end] - some - before, some)
        wanted = high[x] * n + high[y]
        if len(code):
            hit = code[np.minimum(np.searchsorted(code, wanted), len(code) - 1)] == wanted
            x, y = x[hit], y[hit]
        three = np.stack([low[x], high[x], high[y]])
        if mixed:
            three = three[:, (shade[three] != shade[three[0]]).any(axis=0)]
        total += np.bincount(three.ravel(), minlength=n)
        begin = end
    some = np.flatnonzero(total[place])
    return pa.table({"node": ids.take(some), "triangles": total[place][some]})


def triangles_per_node(edges: DataFrame) -> DataFrame:
    """(node, triangles), counted in cells of three colours.

    Nodes get colours by hash, and an edge goes to the cells of its two colours and any
    third, so that each triangle is found in one cell.  Only edges are shuffled, once a
    colour, never the far more wedges; the number of colours grows with the root of the
    edges, so that a cell holds about ``CELL_EDGES``.  Inside, an edge starts at its end
    of lower degree: a hub does not emit all pairs of its neighbours.
    """
    plain = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("src <> dst").repartition("a", "b").distinct()
    plain = cut_lineage(plain)
    colours = max(1, math.ceil(math.sqrt(6 * plain.count() / CELL_EDGES)))
    shade = lambda c: F.pmod(F.hash(c), F.lit(colours))
    third = F.explode(F.array(*[F.lit(i) for i in range(colours)]))
    dealt = plain.withColumns({"ca": shade("a"), "cb": shade("b"), "cc": third})
    cell = F.array_sort(F.array("ca", "cb", "cc"))
    cells = colours * (colours + 1) * (colours + 2) // 6
    number = cell[0] * colours * colours + cell[1] * colours + cell[2]
    dealt = dealt.select("a", "b", "ca", "cb", number.alias("cell")).repartition(cells, "cell")
    node = plain.select(F.col("a").alias("node")).withColumn("triangles", F.lit(0).cast("long")).schema
    fields = to_arrow_schema(node)

    def count(rows: pa.Table) -> pa.Table:
        return _cell_triangles(rows).cast(fields)

    return dealt.groupBy("cell").applyInArrow(count, node).groupBy("node").agg(F.sum("triangles").alias("triangles"))


def haversine_km(lat1, lng1, lat2, lng2):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def radius_join(centres: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Pairs within ``km``: centres(centre_id, lat, lng, ...), points(point_id, p_lat, p_lng, ...).

    Both sides are placed on a cubic grid around the sphere whose cells are as wide as
    the chord of the radius; a centre looks into its 27 neighbouring cells.  This is an
    equi-join that also works at the poles and the date line.
    """
    import math

    chord = 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2)) * 1.000001

    def cell(lat, lng):
        la, ln = F.radians(lat), F.radians(lng)
        axes = (F.cos(la) * F.cos(ln), F.cos(la) * F.sin(ln), F.sin(la))
        return [F.floor(a / chord).alias(n) for n, a in zip("xyz", axes)]

    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = centres.select("*", *cell(F.col("lat"), F.col("lng")))
    for axis in "xyz":
        left = left.withColumn("_o", F.explode(around)).withColumn(axis, F.col(axis) + F.col("_o")).drop("_o")
    left = left.withColumn("_d", F.pmod(F.hash("centre_id"), F.lit(DEALT)))
    right = points.select("*", *cell(F.col("p_lat"), F.col("p_lng"))).withColumn("_d", F.explode(F.array(*[F.lit(i) for i in range(DEALT)])))
    km_apart = haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    return left.join(right.hint("merge"), ["x", "y", "z", "_d"]).withColumn("km", km_apart).where(F.col("km") <= km).drop("x", "y", "z", "_d")
