"""Pairs of members that share keys (wallets by market, markets by holder)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from oddsmith.session import cut_lineage

#: bundles of members that are packed and sent as one; racks that a mid-sized set of members has at least, rows of a rack
BUNDLES, RACKS, RACK_ROWS = 1024, 12, 1 << 22
#: members of a block, joined rows held at once, keys of a matrix, a key that this share of the members holds is a column of it
BLOCK, ROWS, KEYS, HOT = 1024, 1 << 21, 256, 0.25
#: rows of a batch of results
BATCH = 1 << 16
#: rows sent to cells: keys of members, timed events, numbers beside
ITEMS, EVENTS, BESIDE = 0, 1, 2

Columns = dict[str, np.ndarray]
#: numbers to add up for joined rows, from the carried columns of both
Add = Callable[[Columns, Columns], Columns]


def _blocks(members: int) -> int:
    return max(1, min(math.ceil(members / 64), RACKS))


def _expanded(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 0..count-1) of rows that stand for ``counts`` rows each, about ``ROWS`` at a time."""
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + ROWS, "right")))
        some = counts[low:high]
        row = np.repeat(np.arange(low, high), some)
        yield row, np.arange(len(row)) - np.repeat(ends[low:high] - some - before, some)
        low = high


def _payload(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(payloads: list[bytes]) -> pa.Table | None:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads]).combine_chunks() if payloads else None


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Null numbers are NaN."""
    return column.to_numpy()


class _Side:
    """The rows of one rack in a cell, dealt into blocks of members."""

    def __init__(self, cell: _Cell, items: np.ndarray, events: np.ndarray):
        order = items[np.argsort(cell.m[items], kind="stable")]
        self.members, first = np.unique(cell.m[order], return_index=True)
        self.cell, self.count = cell, -(-len(self.members) // BLOCK)
        self.rows = np.split(order, first[BLOCK::BLOCK])
        self.events = [events[:0]] * self.count
        if cell.code is not None:
            at = np.searchsorted(self.members, cell.event_m[events])
            block = at // BLOCK
            order = np.lexsort((cell.code[events], block))
            self.events = np.split(events[order], np.searchsorted(block[order], np.arange(1, self.count)))

    def block(self, i: int) -> _Block:
        return _Block(self.cell, self.members[i * BLOCK:(i + 1) * BLOCK], self.rows[i], self.events[i])


class _Block:
    def __init__(self, cell: _Cell, members: np.ndarray, rows: np.ndarray, events: np.ndarray):
        self.cell, self.members, self.events = cell, members, events
        hot = cell.hot[cell.k[rows]] >= 0
        self.hot = rows[hot]
        rare = rows[~hot]
        self.rare = rare[np.argsort(cell.k[rare], kind="stable")]

    def place(self, m: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.members, m)

    def matrices(self, low: int) -> Columns:
        """Carried columns of the hot keys from ``low`` on as (member, key); 0 where a member does not hold a key."""
        cell = self.cell
        key = cell.hot[cell.k[self.hot]] - low
        some = (key >= 0) & (key < KEYS)
        rows, key = self.hot[some], key[some]
        at, wide = (self.place(cell.m[rows]), key), (len(self.members), min(KEYS, cell.n_hot - low))
        out = {"held": np.zeros(wide, bool)}
        out["held"][at] = True
        for c, v in cell.have.items():
            out[c] = np.zeros(wide, v.dtype)
            out[c][at] = v[rows]
        return out


class _Cell:
    """Pairs of the members of two racks, or of one with itself."""

    def __init__(self, items: list[pa.Table | None], events: list[pa.Table | None], within: int, carry: Sequence[str], dense: bool):
        self.one = items[1] is None
        self.items = pa.concat_tables([t for t in items if t is not None]).combine_chunks()
        part = np.repeat([0, 1], [t.num_rows if t is not None else 0 for t in items])
        timed = [t for t in events if t is not None]
        self.ids = self.items["m"].unique().sort()
        place = lambda c, of: np.asarray(pa.compute.fill_null(pa.compute.index_in(c, of), -1)).astype(np.int64)
        keys = pa.chunked_array([c for t in (self.items, *timed) for c in t["k"].chunks]).unique()
        self.m, self.k = place(self.items["m"], self.ids), place(self.items["k"], keys)
        self.have = {c: _numbers(self.items[c]) for c in carry}
        share = np.bincount(self.k, minlength=len(keys)) / len(self.ids)
        hot = (share >= HOT) & dense
        for v in self.have.values():
            # numbers whose products or inverses leave the range of doubles are met one by one
            odd = (np.abs(v) > 1e150) | ((v != 0) & (np.abs(v) < 1e-150)) if v.dtype.kind == "f" else np.zeros(len(v), bool)
            hot[self.k[odd]] = False
        self.n_hot = int(hot.sum())
        self.hot = np.where(hot, np.cumsum(hot) - 1, -1)
        self.code, of = None, np.array([], np.int64)
        if timed:
            table = pa.concat_tables(timed).combine_chunks()
            of = np.repeat([0, 1], [t.num_rows if t is not None else 0 for t in events])
            self.event_m, k, when, self.weight = place(table["m"], self.ids), place(table["k"], keys), table["at"].to_numpy(), table["n"].to_numpy()
            times = np.unique(when)
            self.code, self.low, self.high = (k * (len(times) + 1) + np.searchsorted(times, when + d, side) for d, side in ((0, "left"), (-within, "left"), (within, "right")))
            of = np.where(self.event_m >= 0, of, -1)
        self.sides = [_Side(self, np.flatnonzero(part == i), np.flatnonzero(of == i)) for i in ((0,) if self.one else (0, 1))]

    def blocks(self) -> Iterator[tuple[_Block, _Block | None]]:
        left, right = self.sides[0], self.sides[-1]
        for i in range(left.count):
            mine = left.block(i)
            for j in range(i if self.one else 0, right.count):
                yield mine, None if self.one and i == j else right.block(j)


def _sums(cell: _Cell, x: _Block, y: _Block | None, sums: Sequence[str], add: Add | None, products: Add | None, timed: str | None) -> Columns:
    """``common``, the sums and the matches in time of all pairs of two blocks, or of one with itself, as flat matrices."""
    one, y = y is None, y or x
    size = (len(x.members), len(y.members))
    total = {c: np.zeros(size) for c in ("common", *sums, *([timed] if timed else []))}
    flat = {c: v.reshape(-1) for c, v in total.items()}
    m, have = cell.m, cell.have

    for low in range(0, cell.n_hot, KEYS):
        a = x.matrices(low)
        b = a if one else y.matrices(low)
        total["common"] += a["held"].astype(np.float32) @ b["held"].astype(np.float32).T
        if products is not None:
            for c, v in products(a, b).items():
                total[c] += v

    begin = np.searchsorted(cell.k[y.rare], cell.k[x.rare])
    for row, nth in _expanded(np.searchsorted(cell.k[y.rare], cell.k[x.rare], "right") - begin):
        p, q = x.rare[row], y.rare[begin[row] + nth]
        if one:
            p, q = p[m[p] < m[q]], q[m[p] < m[q]]
        code = x.place(m[p]) * size[1] + y.place(m[q])
        flat["common"] += np.bincount(code, minlength=len(flat["common"]))
        if add is not None:
            turn = m[p] > m[q]
            p, q = np.where(turn, q, p), np.where(turn, p, q)
            for c, v in add({c: v[p] for c, v in have.items()}, {c: v[q] for c, v in have.items()}).items():
                flat[c] += np.bincount(code, v, len(flat[c]))

    if timed and len(x.events) and len(y.events):
        codes, mine, other = cell.code[y.events], x.place(cell.event_m[x.events]), y.place(cell.event_m[y.events])
        begin = np.searchsorted(codes, cell.low[x.events])
        for row, nth in _expanded(np.searchsorted(codes, cell.high[x.events]) - begin):
            near = begin[row] + nth
            code = mine[row] * size[1] + other[near]
            flat[timed] += np.bincount(code, cell.weight[x.events][row] * cell.weight[y.events][near], len(flat[timed]))
    if one:
        # members are in order: a pair counts above the diagonal
        for v in total.values():
            v[np.tril_indices(size[0])] = 0
    return flat


def _cell_pairs(
    sent: dict[int, list[list[bytes]]], min_shared: int, within: int, carry: Sequence[str], fixed: Sequence[str], sums: Sequence[str], add: Add | None, products: Add | None,
    extra: Sequence[str], timed: str | None, keep: Callable[[Columns], np.ndarray] | None, schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell, from what was sent by each of its racks."""
    items, events = ([_unpacked(p) for p in sent[kind]] for kind in (ITEMS, EVENTS))
    if items[0] is None:
        return
    cell = _Cell(items, events, within, carry, add is None or products is not None)
    of = np.empty(len(cell.ids), dtype=np.int64)
    of[cell.m] = np.arange(len(cell.m))  # any row of a member
    n = cell.items["n"].to_numpy()[of]
    beside = _unpacked(sent[BESIDE][0])
    if beside is not None:
        ends = np.sort([np.asarray(pa.compute.fill_null(pa.compute.index_in(beside[c], cell.ids).combine_chunks(), -1)) for c in "ab"], axis=0)
        more = {c: beside[c].to_numpy() for c in extra}
    for x, y in cell.blocks():
        total = _sums(cell, x, y, sums, add, products, timed)
        one, y = y is None, y or x
        total |= {c: np.zeros(len(total["common"])) for c in extra}
        if beside is not None:
            for left, right in (ends,) if one else (ends, ends[::-1]):
                known = np.isin(left, x.members) & np.isin(right, y.members)
                code = x.place(left[known]) * len(y.members) + y.place(right[known])
                for c in extra:
                    total[c] += np.bincount(code, more[c][known], len(total[c]))
        found = np.flatnonzero(total["common"] >= min_shared)
        total = {c: v[found] for c, v in total.items()}
        p, q = (b.members[i] for b, i in zip((x, y), np.divmod(found, len(y.members))))
        p, q = np.minimum(p, q), np.maximum(p, q)
        if keep is not None and len(p):
            some = np.flatnonzero(keep({**total, "n_a": n[p], "n_b": n[q]}))
            total, p, q = {c: v[some] for c, v in total.items()}, p[some], q[some]
        for low in range(0, len(p), BATCH):
            i, j = p[low:low + BATCH], q[low:low + BATCH]
            columns = {"a": cell.ids.take(pa.array(i)), "b": cell.ids.take(pa.array(j))}
            columns |= {f"{c}_{name}": cell.items[c].take(pa.array(of[e])) for c in fixed for name, e in (("a", i), ("b", j))}
            columns |= {c: pa.array(v[low:low + BATCH]) for c, v in total.items()}
            yield from pa.table({f.name: columns[f.name].cast(f.type) for f in schema}).combine_chunks().to_batches()


def shared_key_pairs(
    items: DataFrame,
    member: str,
    key: str,
    min_shared: int,
    carry: Sequence[str] = (),
    sums: Sequence[str] = (),
    add: Add | None = None,
    same: Sequence[str] = (),
    beside: DataFrame | None = None,
    products: Add | None = None,
    events: DataFrame | None = None,
    within: int = 0,
    timed: str = "matches",
    keep: Callable[[Columns], np.ndarray] | None = None,
) -> DataFrame:
    """All pairs a < b with at least ``min_shared`` common keys: (a, b, common, n_a, n_b).

    With ``carry`` (numbers) the items hold one row per (member, key), and what ``add``
    makes of the rows of a common key is summed up under the names ``sums``.  ``same``
    names columns of one value per member, returned for both.  ``beside`` has rows
    (a, b, numbers), whose sums per pair are added (0 without a row).  ``events`` has rows
    (m, k, at): ``timed`` counts the events of a and b with the same key whose times
    (microseconds) are at most ``within`` apart.  ``keep`` drops pairs in their cell, from
    the numbers, ``n_a`` and ``n_b``.

    Members are packed in bundles and dealt into racks, and a cell, the pairs of two racks,
    is one task: only packed rows are shuffled, once a rack, never the far more rows of
    common keys, matches in time or dropped pairs.  A task holds the rows of two racks and
    takes their members in pairs of blocks, with one number per pair and sum.

    Exact for keys of any kind: a key that many members hold is a column of a matrix, and
    its sums are products of matrices (``products``, the sums of ``add`` for (member, key)
    matrices, needed where ``add`` is given; sums must then not depend on the order of the
    two).  Rows of all other keys are joined.
    """
    have = items.select(F.col(member).alias("m"), F.col(key).alias("k"), *carry, *same).where("m IS NOT NULL AND k IS NOT NULL")
    if not (carry or same):
        have = have.distinct()
    kind = have.schema["m"].dataType
    bundle = lambda c: F.pmod(F.hash(c), F.lit(BUNDLES))
    packed = "bundle int, kind int, members long, n_rows long, payload binary"

    def one_row(bundle: pa.Table, kind: int, members: int, rows: pa.Table) -> pa.Table:
        return pa.table({"bundle": bundle["bundle"].slice(0, 1), "kind": pa.array([kind], pa.int32()), "members": [members], "n_rows": [rows.num_rows], "payload": pa.array([_payload(rows)], pa.binary())})

    def pack_items(rows: pa.Table) -> pa.Table:
        n = rows.group_by("m").aggregate([([], "count_all")])
        at = pa.compute.index_in(rows["m"], n["m"].combine_chunks())
        kept = rows.append_column("n", n["count_all"].take(at)).drop_columns(["bundle"])
        kept = kept.filter(pa.compute.greater_equal(kept["n"], min_shared)).sort_by([("m", "ascending"), ("k", "ascending")])
        return one_row(rows, ITEMS, int(np.sum(n["count_all"].to_numpy() >= min_shared)), kept)

    def pack_events(rows: pa.Table) -> pa.Table:
        kept = rows.group_by(["m", "k", "at"]).aggregate([([], "count_all")]).rename_columns({"count_all": "n"})
        return one_row(rows, EVENTS, 0, kept.sort_by([("m", "ascending"), ("k", "ascending"), ("at", "ascending")]))

    sent = have.withColumn("bundle", bundle("m")).groupBy("bundle").applyInArrow(pack_items, packed)
    if events is not None:
        rows = events.select("m", "k", F.col("at").cast("long").alias("at")).where("m IS NOT NULL AND k IS NOT NULL AND at IS NOT NULL")
        sent = sent.unionByName(rows.withColumn("bundle", bundle("m")).groupBy("bundle").applyInArrow(pack_events, packed))
    sent = cut_lineage(sent.where("n_rows > 0"))
    size = sent.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).first()
    racks = min(BUNDLES, max(_blocks(size["members"]), math.ceil(size["n_rows"] / RACK_ROWS)))
    rack = lambda c: F.pmod(c, F.lit(racks))

    def cell(x, y):
        """Number of a pair of racks, from 0 without gaps."""
        return F.least(x, y) * racks - F.floor(F.least(x, y) * (F.least(x, y) - 1) / 2) + F.greatest(x, y) - F.least(x, y)

    others = F.explode(F.sequence(F.lit(0), F.lit(racks - 1)))
    dealt = sent.withColumns({"own": rack(F.col("bundle")), "other": others})
    dealt = dealt.select(cell(F.col("own"), F.col("other")).cast("int").alias("cell"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("part"), "kind", "payload")
    extra = [c for c in beside.columns if c not in ("a", "b")] if beside is not None else []
    if beside is not None:
        def pack_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                for number in rows["cell"].unique():
                    some = rows.filter(pa.compute.equal(rows["cell"], number)).drop_columns(["cell"])
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([number.as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "kind": pa.array([BESIDE], pa.int32()), "payload": pa.array([_payload(some)], pa.binary())})

        near = beside.where("a IS NOT NULL AND b IS NOT NULL").withColumn("cell", cell(rack(bundle("a")), rack(bundle("b"))).cast("int"))
        dealt = dealt.unionByName(near.mapInArrow(pack_beside, "cell int, part int, kind int, payload binary"))

    fixed, sums = ["n", *same], list(sums)
    types = {"n": "long", **{c: have.schema[c].dataType for c in same}}
    out = StructType([StructField(c, kind) for c in "ab"]).add("common", "long")
    for c in fixed:
        for x in "ab":
            out = out.add(f"{c}_{x}", types[c])
    for c in (*sums, *extra, *([timed] if events is not None else [])):
        out = out.add(c, "double")
    fields, when = to_arrow_schema(out), timed if events is not None else None

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, dict[int, list[list[bytes]]]] = defaultdict(lambda: {kind: [[], []] for kind in (ITEMS, EVENTS, BESIDE)})
        for batch in batches:
            for number, part, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
                cells[number][kind][part].append(payload)
        for number in sorted(cells):
            yield from _cell_pairs(cells.pop(number), min_shared, within, carry, fixed, sums, add, products, extra, when, keep, fields)

    return dealt.repartitionById(racks * (racks + 1) // 2, "cell").mapInArrow(pairs_of, out)
