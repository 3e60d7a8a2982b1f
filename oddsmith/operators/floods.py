"""Best products of edge factors from many origins, when factors are of a few kinds.

With few kinds there are few products above the floor: the levels.  They are settled from the best down:
an origin belongs to a node at the first level that reaches it, and every pair is passed on once.
Origins are numbered in blocks of 64 x ``WORDS``; a state row is a node, a block and a bit for each of its
origins, so neither state nor messages hold a row a pair.  Edges lie in cells of two parts of the nodes,
packed once; a round sends the new bits of a level to the cells of their nodes, where numpy ors them along
the edges, and a merge by shares of the nodes keeps the bits that no better level has.  A cell holds about
``CELL_EDGES`` edges and the bits of ``BAND`` blocks.  Rows of a pair appear only in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from oddsmith.session import cut_lineage

#: words of 64 origins in a block, blocks that meet a copy of a cell, edges of a cell on average
WORDS, BAND, CELL_EDGES = 32, 16, 1 << 20
#: edges whose bits are gathered at once, nodes of a block that one task merges or writes out on average
GATHERED, NODES = 1 << 15, 1 << 10


def levels_of(kinds: list[float], floor: float, most: int) -> tuple[list[float], list[list[int | None]]] | None:
    """Products of ``kinds`` from 1.0 down to ``floor``, best first, and the level each kind leads to; None if there are more than ``most``.

    Products that differ by rounding only are one level.
    """
    found, front = [1.0], [1.0]
    while front:
        made = sorted({v * k for v in front for k in kinds if v * k >= floor}, reverse=True)
        front = []
        for v in made:
            if not any(math.isclose(v, old, rel_tol=1e-12) for old in found):
                found.append(v)
                front.append(v)
        if len(found) > most:
            return None
    found.sort(reverse=True)
    leads = [[next((j for j, w in enumerate(found) if math.isclose(v * k, w, rel_tol=1e-12)), None) for k in kinds] for v in found]
    return found, leads


def _matrix(bits: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), "<i8").reshape(-1, WORDS)


def _bits(words: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(words, "<i8")
    ends = np.arange(len(data) + 1, dtype=np.int32) * (8 * WORDS)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _ored(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Distinct nodes and the words of all their rows."""
    nodes = rows["node"].combine_chunks().unique()
    words = np.zeros((len(nodes), WORDS), np.int64)
    if len(nodes):
        place = pa.compute.index_in(rows["node"], nodes).combine_chunks().to_numpy()
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
        words = np.bitwise_or.reduceat(_matrix(rows["bits"])[order], first, axis=0)
    return nodes, words


def _fresh(reached: pa.Table, known: pa.Table) -> pa.Table | None:
    """(node, block, bits) of one block: what is reached and not known."""
    if not reached.num_rows:
        return None
    nodes, words = _ored(reached)
    old, seen = _ored(known)
    if len(old):
        place = pa.compute.index_in(nodes, old)
        met = np.asarray(place.is_valid())
        words = words.copy()
        words[met] &= ~seen[place.drop_null().to_numpy()]
    some = np.flatnonzero(words.any(axis=1))
    return pa.table([nodes.take(pa.array(some)), pa.array(np.full(len(some), reached["block"][0].as_py(), np.int32)), _bits(words[some])], names=["node", "block", "bits"])


def _packed(cell: pa.Table) -> pa.Table:
    """One row of a cell: its ids, and its links (kind, place of dst, place of src) in order."""
    ids = [cell[c].combine_chunks().unique() for c in ("src", "dst")]
    src, dst = (pa.compute.index_in(cell[c], i).combine_chunks().to_numpy() for c, i in zip(("src", "dst"), ids))
    kind = cell["kind"].to_numpy()
    order = np.lexsort((src, dst, kind))
    links = np.stack([kind[order], dst[order], src[order]]).astype(np.int32).tobytes()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), i) for i in ids]
    return pa.table([cell["cell"].slice(0, 1), *lists, pa.array([links], pa.binary())], names=["cell", "src", "dst", "links"])


def _passed_on(sent: pa.Table, cells: pa.Table, kinds: int) -> pa.Table | None:
    """(node, block, kind, bits): the bits that reach the dst nodes of a cell from the bits ``sent`` to its src nodes."""
    if not (sent.num_rows and cells.num_rows):
        return None
    src, dst = (cells[c].combine_chunks().flatten() for c in ("src", "dst"))
    kind, to, at = np.frombuffer(cells["links"][0].as_py(), np.int32).reshape(3, -1)
    place = pa.compute.index_in(sent["node"], src).combine_chunks()
    sent = sent.filter(place.is_valid())
    place, block = place.drop_null().to_numpy(), sent["block"].to_numpy()
    words, out = _matrix(sent["bits"]), []
    for b in np.unique(block):
        mine = block == b
        held, full = np.zeros((len(src), WORDS), np.int64), np.zeros(len(src), bool)
        held[place[mine]], full[place[mine]] = words[mine], True
        for k in range(kinds):
            lo, hi = np.searchsorted(kind, [k, k + 1])
            some = lo + np.flatnonzero(full[at[lo:hi]])
            if not len(some):
                continue
            reached = np.zeros((len(dst), WORDS), np.int64)
            for begin in range(0, len(some), GATHERED):
                part = some[begin : begin + GATHERED]
                first = np.flatnonzero(np.r_[True, to[part][1:] != to[part][:-1]])
                reached[to[part][first]] |= np.bitwise_or.reduceat(held[at[part]], first, axis=0)
            hit = np.flatnonzero(reached.any(axis=1))
            out.append(pa.table([dst.take(pa.array(hit)), pa.array(np.full(len(hit), b, np.int32)), pa.array(np.full(len(hit), k, np.int32)), _bits(reached[hit])], names=["node", "block", "kind", "bits"]))
    return pa.concat_tables(out) if out else None


def _pairs(settled: pa.Table, names: pa.Table, levels: list[float], value: str) -> pa.Table | None:
    """(origin, node, value) of the bits of one block."""
    if not settled.num_rows:
        return None
    origins = pa.chunked_array(names["origin"].chunks).take(pa.array(np.argsort(names["bit"].to_numpy()))).combine_chunks()
    bits = np.unpackbits(_matrix(settled["bits"]).view(np.uint8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    best = np.array(levels)[settled["level"].to_numpy()[row]]
    return pa.table([origins.take(pa.array(bit)), settled["node"].combine_chunks().take(pa.array(row)), pa.array(best)], names=["origin", "node", value])


def _numbered(origins: DataFrame) -> DataFrame:
    """(origin, block, bit): distinct origins, at most 64 x WORDS in a block."""
    size = 64 * WORDS
    rows = cut_lineage(origins.select("origin").where("origin IS NOT NULL").distinct())
    spread = max(1, -(-rows.count() * 5 // (size * 4)))
    at = F.row_number().over(Window.partitionBy("_h").orderBy("origin")) - 1
    rows = rows.withColumn("_h", F.pmod(F.hash("origin"), F.lit(spread))).withColumn("_at", at)
    rows = rows.select("origin", (F.col("_h") + spread * F.floor(F.col("_at") / size)).cast("int").alias("block"), (F.col("_at") % size).cast("int").alias("bit"))
    return cut_lineage(rows)


def flood(step: DataFrame, origins: DataFrame, kinds: list[float], levels: list[float], leads: list[list[int | None]], value: str) -> DataFrame:
    """(origin, node, value) of the directed edges ``step`` (src, dst, by), ``by`` one of ``kinds``, each below 1."""
    kind = F.coalesce(*[F.when(F.col("by") == k, i) for i, k in enumerate(kinds)])
    step = step.select("src", "dst", kind.alias("kind")).where("src IS NOT NULL AND dst IS NOT NULL AND kind IS NOT NULL")
    parts = max(1, math.ceil(math.sqrt(step.count() / CELL_EDGES)))
    part = lambda c: F.pmod(F.hash(c), F.lit(parts))
    node = step.schema["src"].dataType
    ids = StructType([StructField("cell", IntegerType()), StructField("src", ArrayType(node)), StructField("dst", ArrayType(node)), StructField("links", BinaryType())])
    placed = step.withColumn("cell", part("src") * parts + part("dst"))
    cells = cut_lineage(placed.repartition(parts * parts, "cell").groupBy("cell").applyInArrow(_packed, ids))

    numbered = _numbered(origins)
    bands = F.floor(F.col("block") / BAND).cast("int")
    band_list = numbered.select(bands.alias("band")).distinct()
    cells = cells.crossJoin(F.broadcast(band_list))  # one row for each 32,768 origins
    state = StructType([StructField("node", node), StructField("block", IntegerType()), StructField("bits", BinaryType())])
    reached = StructType([*state[:2], StructField("kind", IntegerType()), state[2]])
    no_state, no_reached = to_arrow_schema(state).empty_table(), to_arrow_schema(reached).empty_table()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            words = np.zeros((len(bit), WORDS), np.int64)
            words[np.arange(len(bit)), bit // 64] = np.left_shift(np.int64(1), bit.astype(np.int64) % 64)
            yield pa.RecordBatch.from_arrays([batch.column("origin"), batch.column("block"), _bits(words)], names=["node", "block", "bits"])

    def pass_on(sent: pa.Table, held: pa.Table) -> pa.Table:
        found = _passed_on(sent, held, len(kinds))
        return no_reached if found is None else found.cast(no_reached.schema)

    def keep(sent: pa.Table, known: pa.Table) -> pa.Table:
        found = _fresh(sent, known)
        return no_state if found is None else found.cast(no_state.schema)

    shares = max(1, -(-step.select("src").distinct().count() // NODES))
    share = F.pmod(F.hash("node"), F.lit(shares))
    waiting: dict[int, list[DataFrame]] = {0: [numbered.mapInArrow(first, state)]}
    settled: list[DataFrame] = []
    for level in range(len(levels)):
        if level not in waiting:
            continue
        come = _union(waiting.pop(level)).withColumn("share", share)
        known = (_union(settled).drop("level") if settled else come.drop("share").limit(0)).withColumn("share", share)
        fresh = cut_lineage(come.groupBy("block", "share").cogroup(known.groupBy("block", "share")).applyInArrow(keep, state))
        settled.append(fresh.withColumn("level", F.lit(level)))
        to = {k: j for k, j in enumerate(leads[level]) if j is not None}
        if not to or fresh.isEmpty():
            continue
        around = F.explode(F.sequence(part("node") * parts, part("node") * parts + parts - 1))
        sent = fresh.withColumn("band", bands).withColumn("cell", around)
        returned = cut_lineage(sent.groupBy("cell", "band").cogroup(cells.groupBy("cell", "band")).applyInArrow(pass_on, reached))
        for j in set(to.values()):
            waiting.setdefault(j, []).append(returned.where(F.col("kind").isin([k for k, i in to.items() if i == j])).drop("kind"))

    result = StructType([origins.schema["origin"], StructField("node", node), StructField(value, DoubleType())])
    no_pairs = to_arrow_schema(result).empty_table()

    def pairs(rows: pa.Table, names: pa.Table) -> pa.Table:
        found = _pairs(rows, names, levels, value)
        return no_pairs if found is None else found.cast(no_pairs.schema)

    # a share of the nodes of a block is at most about 2 million pairs
    names = numbered.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return _union(settled).withColumn("share", share).groupBy("block", "share").cogroup(names.groupBy("block", "share")).applyInArrow(pairs, result)


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return whole
