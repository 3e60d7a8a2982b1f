"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by e edits (8 in 100 of its bytes).  It is cut into
e + 1 pieces; a passage within e edits holds at least one piece unchanged.  Tasks look up
every position of a text in a table of the pieces' first eight bytes (a bitmap first,
then exact), compare the piece, and take the item's place around it as a candidate.  A
candidate must share enough 5-grams with the item (each edit spoils at most five), then
Myers' bit-parallel distance decides: the least edit distance of the item to any
substring of the window.

Texts are compared as UTF-8 bytes with A-Z and U+00C0-U+00DE in lower case and each run of
ASCII white space as one blank.  The items are a stated query set: they are taken in
blocks of at most ``ITEMS`` items and ``ITEM_BYTES`` bytes (one larger item is a block of its
own), each block is broadcast and scanned against all documents.  Blocks follow each other:
the hits of one are stored and its broadcast is destroyed before the next goes out, so what
is broadcast has a fixed bound whatever the number of items.

Defined cases: null or empty texts and items match nothing; items under 16 bytes must
occur unchanged (no edits); rows that repeat an id give rows each; repeated items keep
their own item ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.store import stored
from oddsmith.llm.text import LOWER, SPACE, Block, U, blocks

EDIT_SHARE = 0.08
KEY = 8
GRAM = 5
ITEMS, ITEM_BYTES = 20_000, 16_000_000
_BITS = 20
_MULTIPLIER = U(0x9E3779B97F4A7C15)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case and single blanks; blanks at the ends of a document go."""
    low = LOWER[data]
    after = np.zeros(len(low), bool)
    after[1:] = low[:-1] == 0xC3
    low = np.where(after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low).astype(np.uint8)
    blank = SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    keep = ~blank
    # the first blank after a word stays; one at the end of a document goes below
    keep[1:] |= blank[1:] & ~blank[:-1] & ~first[1:-1]
    low = np.where(blank, np.uint8(32), low)
    count = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    low, bounds = low[keep], count[offsets]
    tail = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    drop = tail[low[tail] == 32]
    if len(drop):
        keep = np.ones(len(low), bool)
        keep[drop] = False
        count = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=count[1:])
        low, bounds = low[keep], count[bounds]
    return low, bounds


def windows8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number (positions that have eight)."""
    if len(data) < KEY:
        return np.empty(0, np.uint64)
    return np.ndarray((len(data) - KEY + 1,), "<u8", np.ascontiguousarray(data), 0, (1,))


def myers(pattern: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of ``pattern`` to a substring of ``text``, or None when above ``most``."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        x = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(x | up) & full
        minus = up & x
        if score < best:
            best = score
    return best if best <= most else None


class Items:
    """Pieces of a block of items and the tables to find them."""

    def __init__(self, items: list[tuple[int, bytes]], share: float = EDIT_SHARE):
        self.items, self.short = [], []
        keys, tails, owner, offset, length = [], [], [], [], []
        for item_id, text in items:
            data, _ = normalised(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            text, m = data.tobytes(), len(data)
            if m < 2 * KEY:
                if m:
                    self.short.append((item_id, text))
                continue
            edits = min(int(m * share), m // KEY - 1)
            grams = {text[i : i + GRAM] for i in range(m - GRAM + 1)}
            k = len(self.items)
            self.items.append((item_id, text, edits, grams))
            cuts = [m * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                keys.append(int.from_bytes(text[a : a + KEY], "little"))
                tails.append(int.from_bytes(text[b - KEY : b], "little"))
                owner.append(k)
                offset.append(a)
                length.append(b - a)
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.tails, self.owner, self.offset, self.length = (np.array(x, t)[order] for x, t in ((tails, np.uint64), (owner, np.int64), (offset, np.int64), (length, np.int64)))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys * _MULTIPLIER >> U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of the pieces whose first and last eight bytes lie there."""
        window = windows8(data)
        at = np.flatnonzero(self.bitmap[(window * _MULTIPLIER >> U(64 - _BITS)).astype(np.int32)])
        low, high = np.searchsorted(self.keys, window[at], "left"), np.searchsorted(self.keys, window[at], "right")
        count = high - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        position = np.repeat(at, count)
        piece = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        last = position + self.length[piece] - KEY
        fits = last < len(window)
        position, piece, last = position[fits], piece[fits], last[fits]
        same = window[last] == self.tails[piece]
        return position[same], piece[same]

    def matches(self, block: Block) -> Iterator[tuple[int, int, int]]:
        """(document, item id, distance)."""
        data, bounds = normalised(block.data, block.offsets)
        raw = data.tobytes()
        position, piece = self.hits(data) if len(self.items) else (np.empty(0, np.int64), np.empty(0, np.int64))
        doc = np.searchsorted(bounds, position, "right") - 1
        inside = position + self.length[piece] <= bounds[doc + 1] if len(piece) else np.empty(0, bool)
        position, piece, doc = position[inside], piece[inside], doc[inside]
        best: dict[tuple[int, int], int] = {}
        begin = position - self.offset[piece] if len(piece) else position
        # hits of one item on one diagonal are one candidate
        _, unique = np.unique(np.column_stack([self.owner[piece], begin]), axis=0, return_index=True) if len(piece) else (None, np.empty(0, np.int64))
        for i in unique.tolist():
            k, d = int(self.owner[piece[i]]), int(doc[i])
            item_id, text, edits, grams = self.items[k]
            known = best.get((d, k))
            if known == 0:
                continue
            a, b = max(int(begin[i]) - edits, int(bounds[d])), min(int(begin[i]) + len(text) + edits, int(bounds[d + 1]))
            window = raw[a:b]
            if text in window:
                best[d, k] = 0
                continue
            shared = len(grams & {window[j : j + GRAM] for j in range(len(window) - GRAM + 1)})
            if shared < len(grams) - GRAM * edits:
                continue
            distance = myers(text, window, edits)
            if distance is not None and (known is None or distance < known):
                best[d, k] = distance
        for (d, k), distance in best.items():
            yield d, self.items[k][0], distance
        for item_id, text in self.short:
            at = raw.find(text)
            seen = -1
            while at >= 0:
                d = int(np.searchsorted(bounds, at, "right")) - 1
                if d != seen and at + len(text) <= bounds[d + 1]:
                    yield d, item_id, 0
                    seen = d
                at = raw.find(text, at + 1)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; the driver holds two blocks at most."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null and text <> ''").toLocalIterator():
        text = row["text"].encode()
        if held and (len(held) >= ITEMS or size + len(text) > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def _found(texts: DataFrame, source: Iterator[list[tuple[int, bytes]]], share: float) -> DataFrame | None:
    """(key, item_id, distance) of the rows (key, text) and the items of all blocks.

    One block is a map-only pass.  With several, each pass is stored and its items leave
    the executors before the next block goes out, so one block is held at a time.
    """
    spark = texts.sparkSession
    kind = texts.schema["key"].dataType.simpleString()

    def scan(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = Items(sent.value, share)
            for block in blocks(batches):
                found = list(tables.matches(block))
                if found:
                    doc, item, distance = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([block.column("key").take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(distance, pa.int32())], names=["key", "item_id", "distance"])

        return texts.mapInArrow(run, f"key {kind}, item_id long, distance int")

    parts: list[DataFrame] = []
    items = next(source, None)
    while items is not None:
        following = next(source, None)
        sent = spark.sparkContext.broadcast(items)
        part = scan(sent)
        if parts or following is not None:
            part = stored(part, "decontamination")
            sent.destroy()
        parts.append(part)
        items = following
    return reduce(DataFrame.unionByName, parts) if parts else None


def contaminations(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, distance) of every document row and item within its edits."""
    found = _found(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), item_blocks(benchmark), share)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    return found.withColumnRenamed("key", "doc_id")


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` without any item, with all their columns.

    One block of items filters in a map-only pass; the hits of several are joined back by
    the text's digest, as a row is judged by its text alone.
    """
    source = item_blocks(benchmark)
    first = [*islice(source, 2)]
    if not first:
        return docs
    if len(first) > 1:
        found = _found(docs.select(F.sha2("text", 256).alias("key"), "text"), chain(first, source), share)
        # the texts hit have no bound: never broadcast
        hit = found.select("key").distinct().hint("merge")
        return docs.join(hit, F.sha2(docs["text"], 256) == hit["key"], "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(first[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Items(sent.value, share)
        for block in blocks(batches):
            keep = np.ones(block.n, bool)
            keep[[d for d, _, _ in tables.matches(block)]] = False
            yield block.rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
