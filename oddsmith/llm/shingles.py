"""Sets of 5-word shingles of documents, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from oddsmith.llm.text import LOWER, Block, U, mixed, spans_hash, word_spans

WORDS = 5
_STEP = 0xD6E8FEB86659FD93


def shingle_sets(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i has the distinct shingles ``hashes[bounds[i]:bounds[i + 1]]``, ascending.

    Words are runs of non-space bytes with A-Z in lower case; a document with fewer words
    than a shingle has one, its whole sequence; one without words has none.
    """
    data = LOWER[block.data]
    start, end, first = word_spans(data, block.offsets)
    w = spans_hash(data, start, end)
    n_words = np.diff(first)
    total = np.zeros(len(w), np.uint64)
    steps = np.array([pow(_STEP, j, 1 << 64) for j in range(words)], np.uint64)
    for j in range(min(words, len(w))):
        # sums that reach past the document are left out below
        total[: len(w) - j] += w[j:] * steps[j]
    size = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(first[:-1] - bounds[:-1], size) + np.arange(bounds[-1])
    hashes = total[index]
    for i in np.flatnonzero((n_words > 0) & (n_words < words)):
        n = int(n_words[i])
        hashes[bounds[i]] = np.append(w[first[i] : first[i + 1]] * steps[:n], U(n)).sum(dtype=np.uint64)
    hashes = mixed(hashes)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    kept = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return hashes[fresh], kept[bounds]
