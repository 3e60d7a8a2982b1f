"""Remove repeated passages: every byte of a 100-byte string that also starts earlier.

Two equal 100-byte windows choose the same anchor in them, the leftmost 24-byte gram of
the least hash.  Consecutive windows with one anchor form a run, so the runs part all
windows of a document, about 40 to a run, and equal windows lie in runs of equal anchors.

1. Tasks cut texts into runs: hash of the anchor, hash of the bytes, document, first
   window, number.  Equal runs of a block are merged at once: all but the first are
   repeats.  So a passage that many documents share leaves a task once.
2. Runs meet by anchor.  Of equal runs the first stays as their representative, the others
   are repeats.  An anchor with one representative is done.
3. The bytes of the other representatives, 99 more than their windows, go to shards by anchor.
   A shard is sorted by its suffix array (induced sorting); common prefixes of 100 bytes
   or more part the array into classes of equal windows; all but the first window of a
   class are repeats.  An anchor with more than ``HOT`` representatives goes on as single
   windows, dealt by their bytes: equal ones merge in their block, those of all blocks meet in order of
   place, and all but the first, which stream by without being held, are repeats.
4. The repeated windows of a document, as a list of runs, meet its text and cover its bytes.

First and earlier mean the smaller (doc_id, position).  Everything is judged on the input.

Defined cases: a null or empty text, and one under 100 bytes, has nothing to remove; a document
row that repeats an id comes after the others of the id in the order of the texts (then,
or with null ids, which come first, the rows are numbered in that order before anything
else); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.store import stored
from oddsmith.llm.suffixes import Sums, common_prefixes, suffix_array
from oddsmith.llm.text import BYTE_CODES, U, blocks, mixed, spans_hash

LENGTH = 100
GRAM = 24
WINDOW = LENGTH - GRAM + 1
SHARD_BYTES = 1 << 20
HOT = 20_000
_PLACE_BITS = 28
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 5, dtype=np.uint64) * U(2) + U(1)
_RUN = "h long, g long, doc_id long, start int, n int, removed boolean"
_CLASSED = "h long, doc_id long, start int, n int, removed boolean, hot boolean"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each position, by doubling."""
    h = mixed(BYTE_CODES[data])
    width, eight = 1, h
    for k in range(4):
        h = h[: len(h) - width] * _FACTORS[k] + h[width:]
        h ^= h >> U(31)
        width *= 2
        if width == 8:
            eight = h
    h = h[: len(h) - 8] * _FACTORS[4] + eight[16:]
    return mixed(h)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, hash of the anchor, document) of the runs of a block."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = gram_hashes(data)
    mask = U((1 << _PLACE_BITS) - 1)
    least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    anchor = (least & mask).astype(np.int64)
    m = len(anchor)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[:m] == owner[LENGTH - 1 :]
    cut = np.ones(m + 1, bool)
    cut[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (owner[1:m] != owner[: m - 1])
    place = np.flatnonzero(cut)
    first, end = place[:-1], place[1:]
    keep = whole[first]
    first, end = first[keep], end[keep]
    return first, end - first, h[anchor[first]], owner[first]


def first_of(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows are the first of their keys by (doc, start)."""
    order = np.lexsort((start, doc, *keys))
    fresh = np.zeros(len(doc), bool)
    change = np.ones(len(doc), bool)
    if len(doc):
        change[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    fresh[order[change]] = True
    return fresh


def cut_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            first, n, h, owner = runs(block.data, block.offsets)
            if not len(first):
                continue
            g = spans_hash(block.data, first, first + n + LENGTH - 1)
            doc = block.column("doc_id").to_numpy()[owner]
            start = first - block.offsets[owner]
            removed = ~first_of((g, h), doc, start)
            # repeats are done: they only travel on, dealt by their own place
            h = np.where(removed, g + start.astype(np.uint64), h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(doc), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(removed)], names=["h", "g", "doc_id", "start", "n", "removed"])

    return docs.mapInArrow(run, _RUN)


def meet(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Runs by anchor: repeats, and the representatives of anchors that have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        hot_anchor = None

        def settled(x: dict[str, np.ndarray], force_hot: bool = False) -> Iterator[pa.RecordBatch]:
            removed = x["removed"].copy()
            live = np.flatnonzero(~removed)
            removed[live] = ~first_of((x["g"][live], x["h"][live]), x["doc_id"][live], x["start"][live])
            h, inverse = np.unique(x["h"], return_inverse=True)
            count = np.bincount(inverse, ~removed, len(h))[inverse]
            is_hot = (count > hot) | force_hot | (x["h"] == hot_anchor if hot_anchor is not None else False)
            out = removed | (count > 1) | is_hot
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x["h"][out]), pa.array(x["doc_id"][out]), pa.array(x["start"][out]), pa.array(x["n"][out]), pa.array(removed[out]), pa.array((is_hot & ~removed)[out])], names=["h", "doc_id", "start", "n", "removed", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "doc_id", "start", "n", "removed")}
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(x["h"], x["h"][-1], "left"))
            done, held = {c: v[:cut] for c, v in x.items()}, {c: v[cut:] for c, v in x.items()}
            yield from settled(done)
            if len(held["h"]) > 2 * hot:
                # an anchor of very many runs goes on window by window; equal ones meet there
                yield from settled(held, True)
                hot_anchor, held = held["h"][0], None
        if held is not None:
            yield from settled(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, _CLASSED)


def segments(waiting: DataFrame, docs: DataFrame) -> DataFrame:
    """(hot, shard, doc_id, start, n, bytes) of the representatives; hot ones window by window.

    Of equal hot windows of a block only the first goes to their shard.  The others are done: they have no bytes
    and travel on dealt by their own place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lists = block.column("parts")
            owner = np.repeat(np.arange(block.n), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            h, start, n, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "start", "n", "hot"))
            if hot.any():
                times = np.where(hot, n, 1)
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                owner, h, hot, n = (np.repeat(v, times) for v in (owner, h, hot, n))
                start, n = np.repeat(start, times) + step, np.where(hot, 1, n)
            doc = block.column("doc_id").to_numpy()[owner]
            first = block.offsets[owner] + start
            shard = h.copy()
            shard[hot] = spans_hash(block.data, first[hot], first[hot] + LENGTH).view(np.int64)
            later = np.zeros(len(shard), bool)
            where = np.flatnonzero(hot)
            later[where] = ~first_of((shard[where],), doc[where], start[where])
            shard = np.where(later, shard + doc + start, shard)
            raw = block.data.tobytes()
            pieces = [b"" if gone else raw[a : a + k + LENGTH - 1] for a, k, gone in zip(first.tolist(), n.tolist(), later.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hot & ~later), pa.array(shard), pa.array(doc), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(pieces, pa.binary())], names=["hot", "shard", "doc_id", "start", "n", "bytes"])

    grouped = waiting.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "hot")).alias("parts"))
    return docs.join(grouped, "doc_id").select("doc_id", "text", "parts").mapInArrow(run, "hot boolean, shard long, doc_id long, start int, n int, bytes binary")


def repeated_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows that occur earlier among the pieces, by the suffix array of their text."""
    length = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    text = np.append(data.astype(np.int16) + 1, 0).astype(np.int16)
    begin = np.cumsum(length) - length
    sums = Sums(text)
    array = suffix_array(text, 257, sums)
    # pieces have at most WINDOW - 1 bytes more than LENGTH, so their begins are near enough
    common = common_prefixes(text, array, begin, LENGTH, 511, sums)
    piece = np.repeat(np.arange(len(pieces)), length)
    inside = np.arange(len(data)) - begin[piece]
    is_window = np.append(inside < n[piece], False)
    label = np.cumsum(common[array] < LENGTH)
    kept = is_window[array]
    place, label = array[kept], label[kept]
    size = np.bincount(label)[label]
    place, label = place[size > 1], label[size > 1]
    p, w = piece[place], inside[place]
    later = ~first_of((label,), doc[p], start[p] + w)
    return p[later], w[later]


def shard_repeats(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n) runs of repeated windows, from shards of about ``SHARD_BYTES``; hot windows come after them, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        before: tuple[int, bytes] | None = None

        def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            doc, start, n = (table.column(c).to_numpy() for c in ("doc_id", "start", "n"))
            pieces = table.column("bytes").to_pylist()
            gone = np.array([not p for p in pieces])
            live = np.flatnonzero(~gone)
            out = [(doc[gone], start[gone], n[gone])]
            if len(live) > 1:
                p, w = repeated_windows([pieces[i] for i in live], doc[live], start[live].astype(np.int64), n[live])
                d, s = doc[live][p], start[live][p] + w
                order = np.lexsort((s, d))
                d, s = d[order], s[order]
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
                first = np.flatnonzero(fresh)
                out.append((d[first], s[first], np.diff(np.append(first, len(d)))))
            d, s, k = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(k, pa.int32())], names=["doc_id", "start", "n"])

        for batch in batches:
            cold = batch.num_rows - batch.column("hot").true_count
            windows, batch = batch.slice(cold), batch.slice(0, cold)
            if windows.num_rows:
                key, text = windows.column("shard").to_numpy(), windows.column("bytes")
                same = np.empty(len(key), bool)
                same[0] = before == (key[0], text[0].as_py())
                same[1:] = (key[1:] == key[:-1]) & pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
                before = int(key[-1]), text[-1].as_py()
                yield windows.select(["doc_id", "start", "n"]).filter(pa.array(same))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("bytes").nbytes
            if size < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("shard").to_numpy()
            # whole anchors only; the last may go on
            cut = int(np.searchsorted(key, key[-1], "left"))
            edges = [0]
            weight = np.cumsum([len(b) for b in table.column("bytes").to_pylist()[:cut]]) if cut else np.empty(0)
            while edges[-1] < cut:
                base = weight[edges[-1] - 1] if edges[-1] else 0
                at = int(np.searchsorted(weight, base + SHARD_BYTES, "right"))
                at = max(at, edges[-1] + 1)
                edges.append(cut if at >= cut else int(np.searchsorted(key, key[at], "left")) if np.searchsorted(key, key[at], "left") > edges[-1] else int(min(np.searchsorted(key, key[at], "right"), cut)))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from settled(table.slice(a, b - a))
            held = table.slice(cut).to_batches()
            size = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield from settled(pa.Table.from_batches(held))

    order = ["hot", "shard", F.when(F.col("hot"), F.col("bytes")), "doc_id", "start"]
    return parts.repartition("shard").sortWithinPartitions(*order).mapInArrow(run, "doc_id long, start int, n int")


def covered(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The digests of every document after its repeated windows (lists of runs) are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lists = block.column("gone")
            size = np.zeros(block.n, np.int64)
            n_removed, n_spans, digest = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64), []
            for i, gone in enumerate(lists):
                text = block.text(i)
                size[i] = len(text)
                if gone.is_valid and len(gone):
                    start, n = (np.asarray(gone.values.field(c)) for c in ("start", "n"))
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + LENGTH - 1, -1)
                    out = np.cumsum(change[:-1]) > 0
                    n_removed[i] = out.sum()
                    n_spans[i] = int(out[0]) + (out[1:] & ~out[:-1]).sum()
                    text = np.frombuffer(text, np.uint8)[~out].tobytes()
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(size), pa.array(n_removed), pa.array(n_spans), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    grouped = removed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return docs.join(grouped, "doc_id", "left").select("id", "text", "gone").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def numbered(docs: DataFrame) -> DataFrame:
    """id (the caller's), doc_id (unique, in document order), text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    unique = docs.groupBy("id").agg(F.count("*").alias("rows")).agg(F.coalesce(F.max("rows"), F.lit(0)), F.count_if(F.col("id").isNull())).first()
    if unique[0] <= 1 and unique[1] == 0:
        return docs.withColumn("doc_id", F.col("id"))
    ordered = docs.repartitionByRange("id", "text").sortWithinPartitions("id", "text")
    return stored(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "repeats-documents")


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = numbered(docs)
    met = stored(meet(cut_runs(docs.select("doc_id", "text")), hot), "repeats-runs")
    parts = segments(met.where("not removed").select("h", "doc_id", "start", "n", "hot"), docs)
    found = stored(shard_repeats(parts), "repeats-windows")
    removed = met.where("removed").select("doc_id", "start", "n").unionByName(found)
    return covered(docs, removed)
