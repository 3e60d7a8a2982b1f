"""Main text of pages: boosted trees over the nodes of the page, decoded from the top down.

Every node of the tree of blocks gets the log-odds that it holds main text, from its subtree's size
and density, the words in its attributes and in those above it, its depth, and its siblings.
Decoding takes the choice of nodes with the largest sum of log-odds among the choices without
contradictions: a chosen node's ancestors are chosen, and a chosen element has a chosen run of text.
That is a recursion over subtrees, from the last node to the first.  The text of the chosen runs, in page order, joined by line feeds, is the main text.

The model is fitted on random layouts (``layouts``) filled with pieces of the text of at most
``SAMPLE`` pages of the table, chosen by hash, ``PIECES`` pieces of ``PIECE_CHARS`` characters of
each; every page is extracted.

Defined cases: a null or empty page, one without text and one without any run that is chosen have the
empty text; a page cut off anywhere ends its open elements; rows of one page give equal texts;
a table without pages gives an empty result; a page of any length is taken whole, and its nodes are
held by its task one page at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.boost import Boosted, boost
from oddsmith.llm.dom import Tree, features, parse
from oddsmith.llm.layouts import MARK, STOCK, Layout, labels

#: pages and pieces of text that fill the layouts, and layouts to learn from
SAMPLE, PIECES, PIECE_CHARS, LAYOUTS = 200, 20, 300, 400
#: characters of html whose nodes are classified together
BLOCK = 1 << 20
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_dropped long"


def chosen(tree: Tree, log_odds: np.ndarray) -> list[int]:
    """The runs of text of the best choice without contradictions, in page order.

    A run of text is worth its log-odds; an element its own and that of the children chosen with it: all
    of positive worth, or else the best one.  An element without text can't be chosen.
    """
    n, never = len(tree.parent), -np.inf
    odds, parent = log_odds.tolist(), tree.parent
    gain, best, best_child, worth = [0.0] * n, [never] * n, [-1] * n, [never] * n
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            worth[i] = odds[i]
        elif best[i] > never:
            worth[i] = odds[i] + (gain[i] if best[i] > 0 else best[i])
        if i:
            p = parent[i]
            gain[p] += max(worth[i], 0.0)
            if worth[i] >= best[p] and worth[i] > never:
                best[p], best_child[p] = worth[i], i
    open_, found = [False] * n, []
    for i in range(n):
        if worth[i] > 0 if i == 0 else open_[parent[i]] and (worth[i] > 0 or best_child[parent[i]] == i):
            open_[i] = True
            if tree.text[i] is not None:
                found.append(i)
    return found


def sample_pieces(pages: DataFrame) -> list[str]:
    """Pieces of text of at most SAMPLE pages, those with the smallest hashes."""
    rows = pages.select("html", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 40)).alias("order"))
    n = rows.count()
    # twice the share that is needed, so that a few hundred pages are parsed, however many there are
    few = rows.where(F.col("order") <= 2.0 * SAMPLE * (1 << 40) / max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column("html"):
                texts = [t for t in parse(html.as_py() or "").text if t]
                step = max(1, len(texts) // PIECES)
                found.append([t[:PIECE_CHARS].replace(MARK, "") for t in texts[::step][:PIECES]])
            yield pa.RecordBatch.from_arrays([batch.column("order"), pa.array(found, pa.list_(pa.string()))], names=["order", "pieces"])

    got = few.mapInArrow(run, "order long, pieces array<string>").orderBy("order", "pieces").limit(SAMPLE).collect()
    return [p for r in got for p in r["pieces"] if p.split()]


def train(pieces: list[str], n: int = LAYOUTS, seed: int = 3) -> Boosted:
    """Fit on the nodes of ``n`` random layouts."""
    layout = Layout(seed, pieces or STOCK)
    trees = [parse(layout.page()) for _ in range(n)]
    y = np.concatenate([labels(t) for t in trees])
    return boost(features(trees), y)


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (runs of text kept), n_dropped (runs left out) of every page row."""
    model = model or train(sample_pieces(pages))

    def texts(block: list[str]) -> Iterator[tuple[str, int, int]]:
        trees = [parse(html) for html in block]
        odds = model.log_odds(features(trees))
        at = 0
        for tree in trees:
            kept = chosen(tree, odds[at : at + len(tree.parent)])
            at += len(tree.parent)
            yield "\n".join(tree.text[i] for i in kept), len(kept), sum(t is not None for t in tree.text) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            start = held = 0
            block: list[str] = []
            for i in range(batch.num_rows):
                block.append(column[i].as_py() or "")
                held += len(block[-1])
                if held >= BLOCK or i == batch.num_rows - 1:
                    found = list(texts(block))
                    rows = batch.slice(start, i + 1 - start)
                    out = pa.array([f[0] for f in found], pa.string())
                    numbers = [pa.array(c, pa.int64()) for c in ([len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), out, *numbers], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_dropped"])
                    start, held, block = i + 1, 0, []

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, SCHEMA)
