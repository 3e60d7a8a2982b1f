"""Suffix arrays of a shard of text by induced sorting, in whole arrays.

The linear-time construction sorts leftmost-smaller (LMS) substrings by induction, names
them, sorts the string of names, and induces all suffixes from that.  Induction scans
the array from left to right (larger-type suffixes) and back (smaller-type).  All
entries of one bucket are known when the scan reaches it, except those the bucket
induces in itself; so a bucket is taken as one array operation, followed by one for each
repetition of its symbol.  The work stays linear and runs in numpy.

The string of names is sorted by recursion, at every size.  It has many symbols, so buckets
would be tiny; there all buckets are induced at once (``induced_ranks``).  A larger-type suffix
is ordered by its symbol and the place of the suffix after it, and the places go back from the
LMS suffixes along falling runs, twice as far in each round; then smaller-type suffixes
likewise along rising runs.  A round takes only suffixes that are still tied.
"""

from __future__ import annotations

import numpy as np

from oddsmith.llm.text import U, mixed, powers


def smaller_type(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that follows; the last counts as smaller."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = 1
    # equal neighbours take the type of the next position that differs
    place = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes ``seeds`` in order (or any order, which sorts the LMS substrings)."""
    n = len(text)
    size = np.bincount(text, minlength=symbols)
    end = np.cumsum(size)
    start = end - size
    array = np.full(n, -1, np.int32)
    seed_count = np.bincount(text[seeds], minlength=symbols)
    first_seed = np.cumsum(seed_count) - seed_count
    sorted_seeds = seeds[np.argsort(text[seeds], kind="stable")]

    def before(entries: np.ndarray, wanted: bool) -> np.ndarray:
        q = entries[entries > 0] - 1
        return q[smaller[q] == wanted]

    head = start.copy()

    def put_left(q: np.ndarray) -> None:
        symbol = text[q]
        order = np.argsort(symbol, kind="stable")
        q, symbol = q[order], symbol[order]
        count = np.bincount(symbol, minlength=symbols)
        array[head[symbol] + np.arange(len(q)) - (np.cumsum(count) - count)[symbol]] = q
        head[:] += count

    for c in range(symbols):
        if not size[c]:
            continue
        done = start[c]
        while done < head[c]:
            upto = head[c]
            q = before(array[done:upto], False)
            done = upto
            if len(q):
                put_left(q)
        if seed_count[c]:
            q = before(sorted_seeds[first_seed[c] : first_seed[c] + seed_count[c]], False)
            if len(q):
                put_left(q)
    tail = end.copy()

    def put_right(q: np.ndarray) -> None:
        symbol = text[q]
        order = np.argsort(symbol, kind="stable")
        q, symbol = q[order], symbol[order]
        count = np.bincount(symbol, minlength=symbols)
        array[tail[symbol] - 1 - (np.arange(len(q)) - (np.cumsum(count) - count)[symbol])] = q
        tail[:] -= count

    # the end mark is a seed that nothing induces
    array[0] = n - 1
    for c in range(symbols - 1, -1, -1):
        if not size[c]:
            continue
        done = end[c]
        while done > tail[c]:
            downto = tail[c]
            q = before(array[downto:done][::-1], True)
            done = downto
            if len(q):
                put_right(q)
        if head[c] > start[c]:
            q = before(array[start[c] : head[c]][::-1], True)
            if len(q):
                put_right(q)
    return array


def refine(rank: np.ndarray, following: np.ndarray, tied: np.ndarray, known: np.ndarray) -> None:
    """Order the suffixes ``tied`` within their rank by the rank of the suffix that follows, in place.

    ``rank`` is the number of suffixes known to be smaller, so equal ranks are a group.  ``following`` leads
    along a run to its end, which is of the other type: its rank is final, or shared with equal ones (``known``).
    """
    n = len(rank)
    tied = tied[np.bincount(rank[tied], minlength=n)[rank[tied]] > 1]
    while len(tied):
        ahead = following[tied]
        key = rank[tied] * n + rank[ahead]
        order = np.argsort(key)
        key, moved = key[order], tied[order]
        group, at = key // n, np.arange(len(key))
        first, new_first = np.ones(len(key), bool), np.ones(len(key), bool)
        first[1:] = group[1:] != group[:-1]
        new_first[1:] = key[1:] != key[:-1]
        rank[moved] = group + np.maximum.accumulate(np.where(new_first, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        alone = new_first.copy()
        alone[:-1] &= new_first[1:]
        still = np.zeros(n, bool)
        still[moved[~alone]] = True
        following[tied] = following[ahead]
        tied = tied[still[tied] & ~known[ahead]]


def induced_ranks(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sorted_lms: bool) -> np.ndarray:
    """Rank of every suffix from the LMS suffixes in order; from unsorted ones equal LMS substrings share their rank."""
    n, symbols = len(text), int(text.max()) + 1
    larger, rest = np.flatnonzero(~smaller), np.flatnonzero(smaller)
    size_larger, size_lms, size = (np.bincount(text[p], minlength=symbols) for p in (larger, lms, slice(None)))
    # in a bucket, suffixes of the larger type come first
    start = np.cumsum(size_larger + size_lms) - size_larger - size_lms
    rank = np.zeros(n, np.int64)
    rank[larger] = start[text[larger]]
    rank[lms] = (start + size_larger)[text[lms]]
    if sorted_lms:
        rank[lms] += np.arange(len(lms)) - (np.cumsum(size_lms) - size_lms)[text[lms]]
    following = np.arange(n)
    following[larger] += 1
    refine(rank, following, larger, smaller)
    whole = np.cumsum(size) - size
    rank[larger] += (whole - start)[text[larger]]
    rank[rest] = (whole + size_larger)[text[rest]]
    following = np.arange(n)
    following[rest[:-1]] += 1  # the end mark follows itself
    refine(rank, following, rest, ~smaller)
    return rank


def sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, whose last is 0 and occurs only there."""
    smaller = smaller_type(names)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        distinct, shorter = np.unique(induced_ranks(names, smaller, lms, False)[lms], return_inverse=True)
        lms = lms[np.argsort(shorter) if len(distinct) == len(lms) else sorted_names(shorter)]
    order = np.empty(len(names), np.int64)
    order[induced_ranks(names, smaller, lms, True)] = np.arange(len(names))
    return order


class Sums:
    """Hashes of any stretch of a text, from running sums."""

    def __init__(self, text: np.ndarray):
        self.up, _ = powers(len(text) + 1)
        self.total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mixed(text.astype(np.uint64) + U(1)) * self.up[:-1], out=self.total[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        t = self.total
        return (t[i + length] - t[i]) * self.up[j] == (t[j + length] - t[j]) * self.up[i]


def suffix_array(text: np.ndarray, symbols: int, sums: Sums | None = None) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol is 0 and occurs only there."""
    n = len(text)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    sums = sums or Sums(text)
    smaller = smaller_type(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return induce(text, smaller, lms.astype(np.int32), symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_array = induce(text, smaller, lms.astype(np.int32), symbols)
    ordered = sorted_array[is_lms[sorted_array]].astype(np.int64)
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, n - 1)) + 1
    length[-1] = 1
    a, b = ordered[1:], ordered[:-1]
    la, lb = length[index[a]], length[index[b]]
    differs = np.ones(len(ordered), bool)
    differs[1:] = (la != lb) | ~sums.equal(a, b, np.minimum(la, lb))
    value = np.cumsum(differs) - 1
    names = np.empty(len(lms), np.int64)
    names[index[ordered]] = value
    if value[-1] == len(lms) - 1:
        order = index[ordered]
    else:
        order = sorted_names(names)
    return induce(text, smaller, lms[order].astype(np.int32), symbols)


def common_prefixes(text: np.ndarray, array: np.ndarray, points: np.ndarray, least: int, most: int, sums: Sums | None = None) -> np.ndarray:
    """Permuted common prefixes: for each position, its common prefix with the suffix before it in the array.

    Values are compared only where the symbols to the left differ (irreducible) and at
    ``points``; elsewhere a value is one less than its left neighbour's.  Values under
    ``least`` may be given as less than they are, and values above ``most`` are cut to it:
    with points at most ``most - least`` apart, every value of ``least`` or more is
    given as that much or more.
    """
    n = len(text)
    sums = sums or Sums(text)
    previous = np.full(n, -1, np.int64)
    previous[array[1:]] = array[:-1]
    i = np.flatnonzero(previous >= 0)
    left = previous[i] - 1
    compared = np.zeros(n, bool)
    compared[i] = (i == 0) | (left < 0) | (text[i - 1] != text[left])
    compared[points] = True
    compared &= previous >= 0
    i = np.flatnonzero(compared)
    i = i[np.maximum(i, previous[i]) + least <= n]
    i = i[sums.equal(i, previous[i], least)]
    j = previous[i]
    value = np.full(len(i), least, np.int64)
    width = 1 << (most.bit_length() - 1)
    while width:
        reach = np.maximum(i, j) + value + width <= n
        fits = np.flatnonzero(reach)
        same = sums.equal(i[fits] + value[fits], j[fits] + value[fits], width)
        value[fits[same]] += width
        width >>= 1
    ends = np.zeros(n, np.int64)
    ends[i] = value + i
    return np.maximum(np.maximum.accumulate(ends) - np.arange(n), 0)
