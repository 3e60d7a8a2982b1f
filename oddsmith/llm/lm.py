"""Cross-entropy difference: a target and a background bigram model over one vocabulary.

Both models count whole corpora and keep every word and every pair that was counted:

    p1(w)   = (c(w) + 1) / (N + V)
    p(w|v)  = (c(v, w) + MU * p1(w)) / (c(v) + MU)

with V one more than the words of both corpora: a word of neither counts as unknown.  A
document's score is its loss per token under the target model minus that under the background
model: low means like the target.

The counts grow with the corpora and are never gathered.  Texts are read once, in chunks of some
megabytes; a chunk becomes a file in the shared folder with its distinct words, its distinct pairs
as places among these, and the pairs of each document.  One exchange follows: a chunk sends its
sorted hashes with small counts of both corpora, a block for each range of hashes; a range adds up
what all chunks sent and answers each with the totals in the order it sent them.  With the answers
a chunk has the counts of all its words, contexts and pairs, and scores its documents.  A word or
pair that is a third of all tokens is one number in each block.

A task writes a chunk file under a new name; the manifest, stored through Spark's committer, names
those of committed attempts, so retried tasks do no harm.

Words are runs of non-space bytes, A-Z in lower case; the first word follows a border mark.  Words
and pairs are known by 64-bit hashes.

Defined cases: a null or empty text has no tokens and null losses and score; a document
counts as often as its row occurs; without target documents both models still have the
uniform part, so scores are defined; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.store import shared_folder, stored
from oddsmith.llm.text import LOWER, Block, U, blocks, mixed, spans_hash, word_spans

MU = 100.0
#: text of a chunk, and hashes that a range of the exchange receives, about
CHUNK_BYTES, RANGE_KEYS = 1 << 24, 1 << 20
#: key of the border mark among the words
BORDER = 0
WORDS, PAIRS = 0, 1
MANIFEST = "file string, doc_ids array<long>, n_keys long"
BLOCKS = "file string, scored boolean, kind int, bucket long, keys binary, counts binary"
REPLIES = "file string, kind int, bucket long, totals binary, words long, target long, background long"
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double"


def pack(values: np.ndarray) -> bytes:
    """An array as compressed byte planes: the high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[block.data]
    start, end, first = word_spans(data, block.offsets)
    return spans_hash(data, start, end), first


class Chunk:
    """Some documents: distinct words, distinct pairs as (place of the word before, 0 for the border, place of the word), and (document, pair, times)."""

    #: name and type of each array as it is stored
    PARTS = (("doc_ids", "<i8"), ("named", "u1"), ("tokens", "<i8"), ("words", "<u8"), ("before", "<u4"), ("word", "<u4"), ("cells", "<u8"), ("times", "<u4"))

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def of(cls, words: np.ndarray, tokens: np.ndarray, doc_ids: list[int | None]) -> Chunk:
        distinct, place = np.unique(words, return_inverse=True)
        before = np.zeros(len(words), np.uint64)
        before[1:] = place[:-1] + 1
        first = np.cumsum(tokens) - tokens
        before[first[tokens > 0]] = 0
        code, pair = np.unique(before << U(32) | place.astype(np.uint64), return_inverse=True)
        # documents by pairs in order, each once
        cells, times = np.unique(np.repeat(np.arange(len(tokens), dtype=np.uint64), tokens) << U(32) | pair.astype(np.uint64), return_counts=True)
        return cls(doc_ids=np.array([i or 0 for i in doc_ids], "<i8"), named=np.array([i is not None for i in doc_ids], "u1"), tokens=tokens.astype("<i8"), words=distinct, before=(code >> U(32)).astype("<u4"), word=(code & U(0xFFFFFFFF)).astype("<u4"), cells=cells, times=times.astype("<u4"))

    def write(self, store: fs.FileSystem, path: str) -> None:
        parts = [pack(_steps(getattr(self, n)) if n in ("words", "cells") else getattr(self, n)) for n, _ in self.PARTS]
        with store.open_output_stream(path) as out:
            out.write(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))

    @classmethod
    def read(cls, store: fs.FileSystem, path: str) -> Chunk:
        with store.open_input_file(path) as source:
            data = source.read()
        sizes = np.frombuffer(data, "<i8", len(cls.PARTS))
        ends = 8 * len(sizes) + np.cumsum(sizes)
        parts = {n: unpack(data[e - s : e], kind) for (n, kind), s, e in zip(cls.PARTS, sizes, ends, strict=True)}
        return cls(**parts | {n: np.cumsum(parts[n], dtype=np.uint64) for n in ("words", "cells")})

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of the pairs, their places)."""
        turned = np.concatenate([[U(BORDER)], self.words])[self.before]
        keys = mixed((turned << U(1) | turned >> U(63)) ^ self.words[self.word])
        order = np.argsort(keys)
        return keys[order], order

    def counts(self, rows: np.ndarray | None) -> np.ndarray:
        """How often each pair occurs in the documents marked in ``rows`` (None: in all)."""
        times, cells = self.times, self.cells
        if rows is not None:
            mine = rows[(cells >> U(32)).astype(np.int64)]
            times, cells = times[mine], cells[mine]
        return np.bincount((cells & U(0xFFFFFFFF)).astype(np.int64), times, len(self.word)).astype("<u4")


def write_chunks(docs: DataFrame, folder: str) -> DataFrame:
    """Chunk files of the rows of ``docs``, and the stored manifest (``MANIFEST``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        words: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        ids: list[int | None] = []
        held = 0

        def emit() -> pa.RecordBatch:
            chunk, name = Chunk.of(np.concatenate(words), np.concatenate(tokens), ids), f"chunk-{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            chunk.write(store, f"{root}/{name}")
            n = len(chunk.words) + len(chunk.word)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.int64())], names=["file", "doc_ids", "n_keys"])

        for block in blocks(batches):
            found, first = words_of(block)
            words.append(found)
            tokens.append(np.diff(first))
            ids += block.column("doc_id").to_pylist()
            held += len(block.data) + 64 * block.n
            if held >= CHUNK_BYTES:
                yield emit()
                words, tokens, ids, held = [], [], [], 0
        if ids:
            yield emit()

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, MANIFEST), "lm-manifest")


def corpora(docs: DataFrame, target: DataFrame, background: DataFrame, folder: str) -> DataFrame:
    """The manifest with, for each chunk, whether it is scored and background, and the places of its target documents (null: none; ``everything``: all)."""
    nothing = F.lit(None).cast("array<int>")

    def roles(manifest: DataFrame, scored: bool, counted: bool, everything: bool = False) -> DataFrame:
        return manifest.select("file", "n_keys", F.lit(scored).alias("scored"), F.lit(counted).alias("counted"), F.lit(everything).alias("everything"), nothing.alias("places") if "places" not in manifest.columns else "places")

    texts = write_chunks(background, folder)
    extra = []
    if "text" in target.columns:
        extra.append(roles(write_chunks(target, folder), False, False, True))
    else:
        # the target's rows are marked by their ids alone; no text moves.  Ids have no bound: never broadcast
        ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().hint("merge")
        marked = texts.select("file", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, "doc_id").groupBy("file").agg(F.collect_list("place").alias("places"))
        texts = texts.join(marked.hint("merge"), "file", "left")
    if docs is not background:
        extra.append(roles(write_chunks(docs, folder), True, False))
    out = roles(texts, docs is background, True)
    for e in extra:
        out = out.unionByName(e)
    return stored(out, "lm-corpora")


def _spread(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows dealt by their keys and sorted by them, then by ``order``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or []))


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """The rows of a sorted partition, key by key."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield list(group)


def send(manifest: DataFrame, folder: str) -> DataFrame:
    """The blocks (``BLOCKS``) that every chunk sends to every range of hashes."""
    size = manifest.agg(F.count("*").alias("files"), F.sum("n_keys").alias("keys")).first()  # two numbers
    ranges = max(1, -(-int(size["keys"] or 0) // RANGE_KEYS))
    files = max(1, min(int(size["files"]), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk.read(store, f"{root}/{r['file']}")
                rows = np.zeros(len(chunk.tokens), bool)
                rows[r["places"] or []] = True
                none = np.zeros(len(chunk.word), "<u4")
                target = chunk.counts(None if r["everything"] else rows) if r["everything"] or rows.any() else none
                background = chunk.counts(None) if r["counted"] else none
                n = len(chunk.words) + 1
                each = [np.bincount(at, c, n).astype("<u4") for at in (chunk.word.astype(np.int64) + 1, chunk.before.astype(np.int64)) for c in (target, background)]
                keys, order = chunk.pair_keys()
                for kind, keys_, columns in ((WORDS, np.concatenate([[U(BORDER)], chunk.words]), each), (PAIRS, keys, [target[order], background[order]])):
                    cuts = np.searchsorted(keys_ >> U(32), (np.arange(1, ranges, dtype=np.uint64) << U(32)) // U(ranges), "left")
                    bounds = np.concatenate([[0], cuts, [len(keys_)]])
                    for b in np.flatnonzero(np.diff(bounds) > 0):
                        part = slice(bounds[b], bounds[b + 1])
                        counts = pack(np.concatenate([c[part] for c in columns]))
                        yield pa.RecordBatch.from_pydict({"file": [r["file"]], "scored": [r["scored"]], "kind": pa.array([kind], pa.int32()), "bucket": pa.array([int(b)], pa.int64()), "keys": [pack(_steps(keys_[part]))], "counts": [counts]})

    return manifest.repartitionByRange(files, "file").mapInArrow(run, BLOCKS)


def answer(sent: DataFrame) -> DataFrame:
    """``REPLIES``: to every block of a scored chunk the totals over all chunks, in its order; and for every range of words their number and the tokens of both corpora."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "kind", "bucket"):
            kind, bucket = group[0]["kind"], group[0]["bucket"]
            keys = [np.cumsum(unpack(r["keys"], "<u8"), dtype=np.uint64) for r in group]
            width = 4 if kind == WORDS else 2
            counts = np.hstack([unpack(r["counts"], "<u4").reshape(width, -1) for r in group])
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.stack([np.bincount(place, c, len(distinct)).astype("<i8") for c in counts])
            at = 0
            for r, k in zip(group, keys, strict=True):
                if r["scored"]:
                    yield _reply(r["file"], kind, bucket, pack(totals[:, place[at : at + len(k)]].ravel()))
                at += len(k)
            if kind == WORDS:
                yield _reply("", kind, bucket, b"", int(((totals[0] + totals[1]) > 0).sum()), int(totals[0].sum()), int(totals[1].sum()))

    return stored(_spread(sent, ["kind", "bucket"], ["file"]).mapInArrow(run, REPLIES), "lm-replies")


def _reply(file: str, kind: int, bucket: int, totals: bytes, words: int = 0, target: int = 0, background: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [file], "kind": pa.array([kind], pa.int32()), "bucket": [bucket], "totals": [totals], "words": [words], "target": [target], "background": [background]})


def chunk_losses(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, tokens: list[int], vocabulary: int) -> list[np.ndarray]:
    """Loss of every document under the target and the background model.

    ``words``: counts of both corpora as words and as contexts, the border first; ``pairs``: counts of
    both, in the order of the pairs' hashes.
    """
    _, order = chunk.pair_keys()
    doc, pair = (chunk.cells >> U(32)).astype(np.int64), (chunk.cells & U(0xFFFFFFFF)).astype(np.int64)
    out = []
    for side in (0, 1):
        count = np.empty(len(order))
        count[order] = pairs[side]
        p1 = (words[side][1:][chunk.word] + 1) / float(tokens[side] + vocabulary)
        loss = -np.log((count + MU * p1) / (words[2 + side][chunk.before] + MU))
        out.append(np.bincount(doc, chunk.times * loss[pair], len(chunk.tokens)))
    return out


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every row of ``docs``.

    ``target`` has texts, or, without a column ``text``, the ids of rows of ``background``.
    """
    folder = shared_folder(docs.sparkSession, "lm-chunks")
    replies = answer(send(corpora(docs, target, background, folder), folder))
    total = replies.agg(*[F.sum(c).alias(c) for c in ("words", "target", "background")]).first()  # three numbers
    tokens, vocabulary = [int(total["target"] or 0), int(total["background"] or 0)], int(total["words"] or 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for group in _groups(batches, "file"):
            chunk = Chunk.read(store, f"{root}/{group[0]['file']}")
            words, pairs = (np.hstack([unpack(r["totals"], "<i8").reshape(width, -1) for r in group if r["kind"] == kind] or [np.zeros((width, 0), np.int64)]) for kind, width in ((WORDS, 4), (PAIRS, 2)))
            lost = chunk_losses(chunk, words, pairs, tokens, vocabulary)
            ids = pa.array(chunk.doc_ids, pa.int64(), mask=chunk.named == 0)
            empty = chunk.tokens == 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.tokens, pa.int64()), *(pa.array(v / np.maximum(chunk.tokens, 1), pa.float64(), mask=empty) for v in lost)], names=["doc_id", "n_tokens", "loss_target", "loss_background"])

    rows = replies.where("file <> ''").select("file", "kind", "bucket", "totals")
    return _spread(rows, ["file"], ["kind", "bucket"]).mapInArrow(run, SCORES).withColumn("score", F.col("loss_target") - F.col("loss_background"))
