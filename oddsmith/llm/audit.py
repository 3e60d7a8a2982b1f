"""Filter interaction audit: what each filter removes in every order, from decision diagrams of failure masks.

A document fails some of five filters; its failure mask has a bit for each.  Spark brings
the documents of a part down to counts by mask (32 at most, whatever the part holds).  The
counts of a part are a decision diagram: a node decides one filter, its two edges lead to
what passes and what fails, equal diagrams are one node, a node whose edges agree is left
out, and each node keeps the count below it.  Going through all orders one adjacent level
swap at a time rebuilds only the two levels that change places.  The path on which every
filter passes is then the course of that order: at each level the failing edge holds what
this step removes, the passing edge what it keeps.

Filters: A under 200 words; B fewer than half of the words distinct; C capitals A-Z above 2 %
of the code points; D holds one of ``#$%&*|``; E text identical to that of a smaller doc_id
of the whole table, removed or not.

Defined cases: a null text is empty; a null source is the part of the empty string; a row
with a null doc_id never fails E, nor makes others fail it; rows that repeat an id count
each, and neither makes the other fail E; several labels of an id count as one, good or
toxic if any is; null labels are neither; an empty table gives no parts; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Diagram:
    """Counts by failure mask as a decision diagram that can change its order.

    ``nodes[i]`` is (level, passing, failing, weight) or, at the last level, a vector of
    counts; ``weight`` is the sum over the masks below.  An edge that skips levels stands
    for both ways through each of them, so its weight counts twice for each level skipped.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], variables: int = len(FILTERS)):
        """``counts``: vector by mask, bit i set where variable i fails; the first order is 0, 1, 2 ..."""
        self.order = list(range(variables))
        self.nodes: list[tuple] = []
        self.known: dict[tuple, int] = {}
        zero = (0,) * len(next(iter(counts.values()), (0, 0, 0)))
        layer = {mask: self._terminal(counts.get(mask, zero)) for mask in range(1 << variables)}
        for level in reversed(range(variables)):
            bit = 1 << level
            layer = {mask: self._node(level, layer[mask], layer[mask | bit]) for mask in layer if not mask & bit and mask < bit << 1}
        self.root = layer[0]

    def _add(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def _terminal(self, counts: tuple[int, ...]) -> int:
        return self._add((len(self.order), None, None, tuple(counts)))

    def _node(self, level: int, passing: int, failing: int) -> int:
        if passing == failing:
            return passing
        weight = tuple(a + b for a, b in zip(self.weight(passing, level + 1), self.weight(failing, level + 1), strict=True))
        return self._add((level, passing, failing, weight))

    def weight(self, node: int, level: int) -> tuple[int, ...]:
        """The counts below an edge that arrives at ``level``."""
        at, _, _, total = self.nodes[node]
        return tuple(v << (at - level) for v in total)

    def edges(self, node: int, level: int) -> tuple[int, int]:
        """(passing, failing) of the variable at ``level``."""
        at, passing, failing, _ = self.nodes[node]
        return (passing, failing) if at == level else (node, node)

    def swap(self, level: int) -> None:
        """Exchange the variables at ``level`` and the next; nodes below stay as they are."""
        done: dict[int, int] = {}

        def rebuilt(node: int) -> int:
            at = self.nodes[node][0]
            if at > level + 1:
                return node
            if node not in done:
                passing, failing = self.nodes[node][1:3]
                if at < level:
                    done[node] = self._node(at, rebuilt(passing), rebuilt(failing))
                else:
                    passing, failing = self.edges(node, level)
                    (pp, pf), (fp, ff) = self.edges(passing, level + 1), self.edges(failing, level + 1)
                    done[node] = self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
            return done[node]

        self.root = rebuilt(self.root)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, counts kept, counts removed) along the path on which all pass."""
        found, node = [], self.root
        for level, variable in enumerate(self.order):
            passing, failing = self.edges(node, level)
            found.append((variable, self.weight(passing, level + 1), self.weight(failing, level + 1)))
            node = passing
        return found

    def only(self, variable: int) -> tuple[int, ...]:
        """The counts of the mask on which that variable alone fails."""
        node = self.root
        for level, v in enumerate(self.order):
            node = self.edges(node, level)[v == variable]
        return self.nodes[node][3]


def adjacent_orders(n: int) -> Iterator[int]:
    """The levels whose swaps with the next lead through all orders of ``n`` variables, each once."""
    order, moves = list(range(n)), [-1] * n
    while True:
        place = {v: i for i, v in enumerate(order)}
        mobile = [v for v in order if 0 <= place[v] + moves[v] < n and order[place[v] + moves[v]] < v]
        if not mobile:
            return
        v = max(mobile)
        i, j = place[v], place[v] + moves[v]
        order[i], order[j] = order[j], order[i]
        for w in order:
            if w > v:
                moves[w] = -moves[w]
        yield min(i, j)


def audit_rows(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of a part."""
    diagram = Diagram(counts, len(filters))
    fails, shapley, courses = {}, dict.fromkeys(range(len(filters)), 0), {}

    def note() -> None:
        course = diagram.steps()
        courses["".join(filters[v] for v, _, _ in course)] = course
        # what the first step of an order removes is all that fails its filter
        fails[course[0][0]] = course[0][2][0]
        for v, _, removed in course:
            shapley[v] += removed[0]

    note()
    for level in adjacent_orders(len(filters)):
        diagram.swap(level)
        note()
    unique = {v: diagram.only(v)[0] for v in shapley}
    return [(order, i + 1, kept[0], out[0], fails[v] - out[0], unique[v], out[1], out[2], shapley[v]) for order in sorted(courses) for i, (v, kept, out) in enumerate(courses[order])]


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 where a text fails A, B, C, D; native."""
    bare = F.trim(text, F.lit(_SPACES))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    chars = F.char_length(text)
    capitals = chars - F.char_length(F.translate(text, _CAPITALS, ""))
    tests = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * chars, text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for i, fails in enumerate(tests):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part and failure mask, 32 rows a part at most.

    Texts stay where they are read: what moves is a digest, the mask, the id and the part.
    Copies of a text have the same digest and the same first four bits, so they are counts by part
    before the smallest id of a digest is looked up, and no group of copies is gathered.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # labels have no bound: never broadcast, the same join at every size
    rows = rows.join(known.hint("merge"), "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(first.alias("first"), unnamed.alias("unnamed"), F.sum("n").alias("n"))
    smallest = copies.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    copies = copies.join(smallest, "digest")
    # the rows of the smallest id, and those without an id, have no smaller one
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    each = copies.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), fresh.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - fresh).alias("n")))))
    each = each.where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        found = pd.DataFrame(audit_rows(counts), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        found.insert(0, "part", key[0])
        return found.astype({"step": np.int32})

    return mask_counts(docs, labels).groupBy("part").applyInPandas(run, SCHEMA)
