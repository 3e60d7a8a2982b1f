"""Token ids of documents as bit-plane files: fixed-size id blocks, zstandard planes, chunk indexes.

Documents are range-partitioned by id and each task writes one file in ascending id
order.  A file is a sequence of compressed planes and a footer with its document and
chunk indexes.  A block of ``BLOCK_IDS`` ids becomes 32 bit planes (plane k holds bit k
of every id), of which those with any bit set are compressed and stored; ids below
2 ** 17 so need at most 17 planes.

A task writes a file under a new name and hands on one row: name, range of ids, counts.
These rows, stored through Spark's committer, are the dataset's manifest.  A retried or
duplicate attempt leaves a file that no row names, so lost executors do no harm.  The
position of a file among all ids is a running sum over the manifest, one row a file.

Encoding: text cut at ASCII white space, and between a letter and plain punctuation, can be
encoded piece by piece with the same ids, because no token of the vocabulary and no step
of its normaliser crosses such a border.  A task so encodes each distinct piece once
(with the tokenizers library) and expands the documents by array lookups.  Pieces of ASCII
alone are taken in lower case; in others the normaliser composes marks with letters first,
and some only with small ones, so their case is left alone.

Defined cases: a null or empty text is the end id alone; rows that repeat an id follow
each other, ordered by their text; null ids come first; an empty table gives no file
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmith.llm.store import shared_folder, stored
from oddsmith.llm.text import BLOCK_BYTES, LOWER, SPACE, Block, blocks, spans_hash

BLOCK_IDS = 1 << 16
PLANES = 32
LEVEL = 3
MAGIC = b"BPT1"
END_ID = 2
CACHE_PIECES = 1_000_000
MANIFEST = "part int, file string, first_id long, n_docs long, n_tokens long, n_bytes long"
DOCUMENT_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,!?*&%$#;:()")] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the pieces that can be encoded alone, and the first piece of each document (one more at the end).

    Borders: document ends, ASCII white space, and where a letter (ASCII or U+00C0-U+00FF)
    meets plain ASCII punctuation.
    """
    n = len(data)
    # a two-byte letter: lead 0xC3, any trail but the signs for times and divided-by
    trail = np.zeros(n, bool)
    trail[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    lead = np.zeros(n, bool)
    lead[:-1] = trail[1:]
    letter, plain, inside = _ASCII_LETTER[data], _PLAIN[data], ~SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[1:n] |= ((letter | trail)[:-1] & plain[1:]) | (plain[:-1] & (letter | lead)[1:]) | (inside[:-1] != inside[1:])
    where = np.flatnonzero(border)
    start, end = where[:-1], where[1:]
    keep = inside[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, offsets)


def lowered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lower case in the pieces where that changes no id: ASCII alone (the normaliser composes before it lowers) and without ``<|`` (special tokens are told apart by case)."""
    odd = data >= 128
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    before = np.concatenate([[0], np.cumsum(odd)])
    same = before[end] == before[start]
    step = np.zeros(len(data) + 1, np.int8)
    step[start[same]] += 1
    step[end[same]] -= 1
    return np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, LOWER[data], data)


class Encoder:
    """Ids of whole texts; remembers the ids of pieces it has met (an array store, cleared when full)."""

    def __init__(self, path: str, end_id: int = END_ID):
        # a task is one core's work: threads of the library's own would cost more than they bring
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.count = np.insert(self.known, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with their end ids, first id of each document and one more)."""
        start, end, bounds = piece_spans(block.data, block.offsets)
        data = lowered(block.data, start, end)
        hashes, sample, inverse = np.unique(spans_hash(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > CACHE_PIECES:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != hashes[~new]
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[start[i] : end[i]].decode() for i in sample[new]])
            at = np.searchsorted(self.known, hashes)
        at = at[inverse]
        # pieces and, after the last piece of each document, one end id
        n_pieces = np.diff(bounds)
        slot = np.arange(len(at)) + np.repeat(np.arange(block.n), n_pieces)
        count = np.ones(len(at) + block.n, np.int64)
        first = np.full(len(at) + block.n, -1, np.int64)
        count[slot], first[slot] = self.count[at], self.first[at]
        begin = np.cumsum(count) - count
        index = np.repeat(first - begin, count) + np.arange(int(count.sum()))
        ends = bounds[1:] + np.arange(block.n)
        out = np.append(self.ids, np.uint32(0))[np.maximum(index, -1)]
        out[begin[ends]] = self.end_id
        return out, np.concatenate([[0], begin[ends] + 1])


def to_planes(ids: np.ndarray) -> tuple[int, bytes]:
    """(which bit planes have a bit set, those planes one after the other), little-endian bits."""
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    used = np.flatnonzero(bits.any(axis=0))
    return int(sum(1 << int(k) for k in used)), [np.packbits(bits[:, k], bitorder="little").tobytes() for k in used]


def from_planes(mask: int, planes: list[bytes], n: int) -> np.ndarray:
    bits = np.zeros((n, PLANES), np.uint8)
    for plane, k in zip(planes, (k for k in range(PLANES) if mask >> k & 1), strict=True):
        bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """One file: blocks as they fill, then the footer."""

    def __init__(self, out):
        self.out, self.buffer, self.held, self.at = out, [], 0, 0
        self.chunks, self.doc_ids, self.doc_tokens = [], [], []
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.doc_tokens += counts.tolist()
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            part = ids[i : min(i + BLOCK_IDS, whole)]
            mask, planes = to_planes(part)
            planes = [self.press.compress(p) for p in planes]
            self.chunks.append([self.at, len(part), mask, [len(p) for p in planes]])
            self._put(b"".join(planes))
        self.buffer = [ids[whole:]]
        self.held = len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        footer = self.press.compress(json.dumps({"chunks": self.chunks, "doc_ids": self.doc_ids, "doc_tokens": self.doc_tokens}).encode())
        self._put(footer + struct.pack("<I", len(footer)) + MAGIC)
        return self.at


def read_footer(source) -> dict:
    size = source.size()
    source.seek(size - 8)
    length, magic = struct.unpack("<I4s", source.read(8))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(size - 8 - length)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(length)))


def read_chunks(source, footer: dict) -> Iterator[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    for at, n, mask, lengths in footer["chunks"]:
        source.seek(at)
        yield from_planes(mask, [press.decompress(source.read(x)) for x in lengths], n)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder a Python worker; workers serve many tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write token files below ``folder`` and return the stored manifest (``MANIFEST``, with ``start``: ids before the file).

    ``tokenizer`` is a file of the tokenizers library that every executor can open.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, name = _encoder(tokenizer, end_id), None, f"ids-{uuid.uuid4().hex}.bpt"
        n_docs = n_tokens = 0
        first = None
        store, root = fs.FileSystem.from_uri(folder)
        for block in blocks(batches, limit=2 * BLOCK_BYTES):
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                writer = Writer(out)
                first = block.column("doc_id")[0].as_py()
            ids, bounds = encoder.block(block)
            writer.add(ids, block.column("doc_id").to_pylist(), np.diff(bounds))
            n_docs, n_tokens = n_docs + block.n, n_tokens + len(ids)
        if writer is not None:
            n_bytes = writer.close()
            out.close()
            row = [TaskContext.get().partitionId(), name, first, n_docs, n_tokens, n_bytes]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["part", "file", "first_id", "n_docs", "n_tokens", "n_bytes"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    return stored(manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")), "token-index")


def dealt(files: DataFrame) -> DataFrame:
    """The rows of a manifest spread over as many tasks as there are files (or shuffle partitions, if those are fewer), in the order of the ids.

    A row is tiny, its file is a task's work: with a number of partitions given, adaptive execution leaves them apart.
    """
    most = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartitionByRange(max(1, min(files.count(), most)), "start")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    footer = read_footer(source)
                    counts = np.asarray(footer["doc_tokens"], np.int64)
                    ends = np.cumsum(counts)
                    crcs, doc, at, crc = [], 0, 0, 0
                    for ids in read_chunks(source, footer):
                        raw, base = memoryview(ids.tobytes()), at
                        while doc < len(ends) and ends[doc] <= base + len(ids):
                            crcs.append(zlib.crc32(raw[4 * (at - base) : 4 * (int(ends[doc]) - base)], crc))
                            at, crc, doc = int(ends[doc]), 0, doc + 1
                        crc = zlib.crc32(raw[4 * (at - base) :], crc)
                        at = base + len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(footer["doc_ids"], pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt(manifest.select("file", "start")).mapInArrow(read, DOCUMENT_ROWS)


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id and the array of its ids, for jobs that train on the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{root}/{name}") as source:
                    footer = read_footer(source)
                    counts, doc, held = footer["doc_tokens"], 0, np.empty(0, np.uint32)
                    for ids in read_chunks(source, footer):
                        held, at, rows = np.concatenate([held, ids]), 0, []
                        while doc < len(counts) and at + counts[doc] <= len(held):
                            rows.append((footer["doc_ids"][doc], held[at : at + counts[doc]]))
                            at, doc = at + counts[doc], doc + 1
                        held = held[at:]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype(np.int64) for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return dealt(manifest.select("file", "start")).select("file").mapInArrow(read, "doc_id long, ids array<long>")


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what is read back from them."""
    folder = shared_folder(spark, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id), folder)
