"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the mean of the embeddings of its byte n-grams (3 and 4 bytes of the text
in lower case, everything but letters as one kind of blank), hashed into a fixed table.
Embeddings and the softmax are trained together by stochastic gradient descent in numpy
on at most ``per_language`` documents of each language (the bound of the sample, chosen
by a hash of the id); every document is predicted.  A fifth of each language's sample is kept
from training and sets the temperature of the softmax and the score below which a
prediction should be rejected (``accepted``).

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and not
accepted; texts too short for an n-gram get the prior; rows with a null language
or in the held-out fold are never learnt from; with no language to learn, every text is
``und``; equal texts get equal predictions; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.store import crc_fold
from oddsmith.llm.text import Block, blocks

BITS = 15
DIM = 16
EPOCHS = 8
RATE = 0.5
BATCH = 32
PER_LANGUAGE = 600
REJECT_SHARE = 0.01

_RNG = np.random.default_rng(7)
_CODES = _RNG.integers(0, 1 << 32, (4, 256), dtype=np.uint64).astype(np.uint32)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, document of every n-gram); n-grams do not cross documents."""
    data = _FOLD[block.data]
    owner = np.repeat(np.arange(block.n), np.diff(block.offsets))
    found, where = [], []
    for size in (3, 4):
        m = len(data) - size + 1
        if m <= 0:
            continue
        h = np.full(m, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(size):
            h = (h ^ _CODES[k][data[k : k + m]]) * np.uint32(0x85EBCA6B)
        keep = (owner[:m] == owner[size - 1 :]) & ((data[:m] != 32) | (data[1 : m + 1] != 32))
        found.append((h[keep] >> np.uint32(32 - BITS)).astype(np.int32))
        where.append(owner[:m][keep])
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(where)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # (2 ** BITS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, score) of each document."""
        where, owner = buckets(block)
        count = np.bincount(owner, minlength=block.n)
        logits = np.empty((block.n, len(self.languages)))
        for k in range(len(self.languages)):
            logits[:, k] = np.bincount(owner, self.table[:, k][where], block.n) / np.maximum(count, 1) + self.bias[k]
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(block.n), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(block: Block) -> np.ndarray:
    total = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_LETTER[block.data], out=total[1:])
    found = total[block.offsets[1:]] > total[block.offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(block.offsets) > 0)):
        found[i] = any(c.isalpha() for c in block.text(i).decode())
    return found & block.present


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 11) -> Model | None:
    """Fit on (language, buckets, counts) of the sampled documents, in the order given."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[r[0]] for r in rows])
    embed = rng.normal(0, 0.1, (1 << BITS, DIM))
    weights, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    weights += rng.normal(0, 0.1, weights.shape)
    # every fifth document of each language, whatever the order of the languages
    seen, held = Counter(), np.zeros(len(rows), bool)
    for i, (language, *_) in enumerate(rows):
        held[i] = seen[language] % 5 == 4
        seen[language] += 1
    inner = np.flatnonzero(~held)
    share = [r[2] / max(r[2].sum(), 1) for r in rows]

    def gather(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        index, part = np.concatenate([rows[i][1] for i in batch]), np.concatenate([share[i] for i in batch])
        owner = np.repeat(np.arange(len(batch)), [len(rows[i][1]) for i in batch])
        mean = np.zeros((len(batch), DIM))
        weighted = embed[index] * part[:, None]
        for k in range(DIM):
            mean[:, k] = np.bincount(owner, weighted[:, k], len(batch))
        return index, part, owner, mean

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(inner)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            index, part, owner, mean = gather(batch)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = error @ weights.T
            # rare buckets move as fast as common ones: the step is scaled by the documents, not by the share
            np.add.at(embed, index, -rate * 4 * back[owner] * np.sqrt(part)[:, None])
            weights -= rate * mean.T @ error
            bias -= rate * 0.05 * error.mean(axis=0)
    check = np.flatnonzero(held) if held.any() else inner
    logits = np.vstack([gather(check[i : i + 256])[3] for i in range(0, len(check), 256)]) @ weights + bias
    # the temperature with the least loss on the documents kept from training
    grid = np.geomspace(0.05, 20, 61)
    picked = np.arange(len(check))
    loss = [-np.log(softmax(logits / t)[picked, y[check]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.argmax(axis=1) == y[check]
    reject_below = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE)) if right.any() else 0.0
    return Model(languages, (embed @ weights).astype(np.float32), bias, temperature, reject_below)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` learnable rows a language, those with the smallest hash of the id.

    Rows whose hash is above twice the share that is needed are left out where they are
    read, so about ``2 * per_language`` texts of a language are ranked, however large it is.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (crc_fold() != 2) & F.col("text").isNotNull())
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    # one number a language, which the model has to know anyway
    rows = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().collect()]
    most = F.create_map(*[F.lit(x) for lang, n in rows for x in (lang, 2.0 * per_language * (1 << 40) / n)]) if rows else F.lit(None).cast("map<string,double>")
    few = known.where(F.col("h") <= F.try_element_at(most, "lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "rank", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            where, owner = buckets(block)
            key, count = np.unique(owner.astype(np.int64) << BITS | where, return_counts=True)
            bounds = np.searchsorted(key, np.arange(block.n + 1) << BITS)
            mask = (1 << BITS) - 1
            yield pa.RecordBatch.from_arrays([
                block.column("lang"), block.column("rank"),
                pa.array([(key[a:b] & mask).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int32())),
                pa.array([count[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int32()))], names=["lang", "rank", "buckets", "counts"])

    rows = sample(docs, per_language).mapInArrow(run, "lang string, rank int, buckets array<int>, counts array<int>").toArrow()
    found = list(zip(rows.column("lang").to_pylist(), rows.column("rank").to_pylist(), rows.column("buckets").combine_chunks().to_numpy(zero_copy_only=False) if len(rows) else [], rows.column("counts").combine_chunks().to_numpy(zero_copy_only=False) if len(rows) else [], strict=True))
    return train([(lang, b, c) for lang, _, b, c in sorted(found, key=lambda r: (r[1], r[0]))])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document row."""
    model = fit(docs, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            letters = has_letter(block)
            if model is None:
                names, score, keep = ["und"] * block.n, np.zeros(block.n), np.zeros(block.n, bool)
            else:
                best, score = model.predict(block)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, score, 0.0)
                keep = letters & (score >= model.reject_below)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(keep)], names=["doc_id", "lang_pred", "score", "accepted"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", F.coalesce(crc_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
