"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the text turns each document into a short vector (logarithms of counts,
square roots of ratios).  The fit needs only the counts, sums and products of each
class: partial sums of a task, added up by a grouped aggregate; (classes x d x d)
numbers reach the driver.  Class covariances are shrunk towards the pooled one and
towards a multiple of the identity, factorised once (Cholesky), and the factors travel
with the scoring tasks.  A score is the posterior of label 1: the difference of the two
Mahalanobis log-densities plus the log prior.

Defined cases: null and empty texts have the vector of an empty document and are scored
like any other; a null label, or one that is neither 0 nor 1, is not learnt from; a
label row counts once for every document row of its id; without rows of both classes the
score is (n1 + 1) / (n0 + n1 + 2) for all; repeated ids are scored row by row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.store import crc_fold, stored
from oddsmith.llm.text import Block, blocks, spans_hash, sums_by_document, word_spans

THRESHOLD = 0.7
#: weight of the pooled covariance, and of the multiple of the identity
TO_POOLED, TO_IDENTITY = 0.1, 0.02

_B = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
_HIGH, _CONTINUED = _B >= 128, (_B >= 128) & (_B < 192)
_SYMBOL = np.isin(_B, list(b"*#$%&@^~+=<>{}[]_\\"))
_BAR, _BANG, _NEWLINE, _STOP = _B == ord("|"), _B == ord("!"), _B == 10, np.isin(_B, list(b".,;:?"))


def statistics(block: Block) -> np.ndarray:
    """One row of transformed statistics for each document of a block."""
    data, bounds = block.data, block.offsets
    count = lambda table: sums_by_document(table[data], bounds).astype(float)
    chars = np.diff(bounds) - count(_CONTINUED)
    upper, lower, digit, high = count(_UPPER), count(_LOWER), count(_DIGIT), count(_HIGH) - count(_CONTINUED)
    symbol, bar, bang, newline, stop = count(_SYMBOL), count(_BAR), count(_BANG), count(_NEWLINE), count(_STOP)
    start, end, first = word_spans(data, bounds)
    n = np.diff(first).astype(float)
    length = (end - start).astype(float)
    hashes = spans_hash(data, start, end)
    same = np.zeros(len(start), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(start)]] = False
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=capitals[1:])
    small = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LOWER[data], out=small[1:])
    shouted = (capitals[end] - capitals[start] >= 2) & (small[end] == small[start])
    marked = _SYMBOL[data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0, bool)
    per_word = lambda flags: sums_by_document(flags, first).astype(float)
    repeated, shout, mark, short = per_word(same), per_word(shouted), per_word(marked), per_word(length <= 3)
    # ratios lean towards ordinary prose by ten words, so a short text is not an extreme one
    words, size = n + 10, chars + 60
    return np.column_stack([
        np.log1p(n), np.log1p(repeated), np.log1p(shout), np.log1p(mark), np.log1p(bar), np.log1p(bang), np.log1p(symbol),
        np.sqrt(repeated / words), np.sqrt(shout / words), np.sqrt(mark / words), np.sqrt(bar / words),
        (sums_by_document(length, first) + 50) / words / 10, np.sqrt((short + 4) / words), np.sqrt(digit / size), np.sqrt((upper + 1) / size),
        (lower + upper + high + 48) / size, np.sqrt((stop + 1) / words), np.log1p(newline) - np.log1p(n) / 2,
    ])


@dataclass(frozen=True)
class Discriminant:
    """A fitted model: standardisation, class means, inverse Cholesky factors, log-determinants, log prior ratio; or a constant."""

    centre: np.ndarray | None
    scale: np.ndarray | None
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_prior: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_prior, -60, 60)))


def fit_moments(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray]) -> Discriminant:
    """The model from n, sum(x) and sum(x x') of classes 0 and 1."""
    if min(counts) < 2:
        return Discriminant(None, None, [], [], [], 0.0, (counts[1] + 1) / (sum(counts) + 2))
    total = sum(counts)
    centre = (sums[0] + sums[1]) / total
    scale = np.sqrt(np.maximum(np.diag(products[0] + products[1]) / total - centre**2, 1e-8))
    means, within = [], []
    for n, s, p in zip(counts, sums, products, strict=True):
        mean = s / n
        within.append((p / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = sum(n * w for n, w in zip(counts, within, strict=True)) / total
    factors, dets = [], []
    for w in within:
        s = (1 - TO_POOLED) * w + TO_POOLED * pooled
        s = (1 - TO_IDENTITY) * s + TO_IDENTITY * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, means, factors, dets, float(np.log(counts[1] / counts[0])))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics (an array), one row a document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(list(statistics(block)), pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from labelled rows outside the held-out fold."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(crc_fold() != 2)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.vstack(batch.column("stats").to_numpy(zero_copy_only=False))
            x = np.hstack([np.ones((len(x), 1)), x])
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = x[label == k]
                total[k] = total.get(k, 0) + (part.T @ part).ravel()
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["label", "cell", "value"])

    cells = stats.join(known, "doc_id").select("label", "stats").mapInArrow(partial, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    # sums of floats depend on the order of the tasks in the last bits
    size = 1 + max((r["cell"] for r in cells), default=-1)
    d = max(int(round(size**0.5)), 1)
    gram = np.zeros((2, d * d))
    for r in cells:
        gram[r["label"], r["cell"]] = r["value"]
    gram = gram.reshape(2, d, d)
    return fit_moments([g[0, 0] for g in gram], [g[0, 1:] for g in gram], [g[1:, 1:] for g in gram])


def scores(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(np.vstack(batch.column("stats").to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    stats = stored(document_statistics(docs), "quality-stats")
    found = scores(stats, fit(stats, labels), threshold)
    return found.select("doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = fit(stored(document_statistics(docs), "quality-stats"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.rows.filter(pa.array(model.score(statistics(block)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
