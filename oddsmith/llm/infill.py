"""Fill-in-the-middle transformation by one repeated-capture match.

A text is a run of units, each a word of ASCII letters or one other code point.  One
``fullmatch`` of ``(unit)*`` keeps every repetition of its group, so ``match.ends(1)`` gives
the number of units and the offset after each of them: both cuts are two look-ups.  The
cuts, and the form a document gets, come from a digest of its id.

    plain  the text
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

``restore`` rebuilds the text: a marker cannot begin inside a piece and end in the next
one's marker, and texts that hold a marker are plain, so the first of each is the cut.

Defined cases: a null text is empty; an empty text, and one that holds a marker, is plain
with no prefix and middle; with a single unit or equal cuts the middle may be empty; a
null id has the digest of ``1:`` alone; rows of one id and text give equal rows; an empty
table gives an empty result; other columns are ignored.  A text is matched whole; the
match holds some 60 bytes for each unit of the one text at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: per cent of documents left plain, and of the others in suffix-prefix-middle order
PLAIN, SPM = 10, 20
SEED = 1
#: characters of text handed on at once
BLOCK = 1 << 22

_UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
_COLUMNS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> list[int]:
    """The offset after each unit of ``text``."""
    return _UNITS.fullmatch(text).ends(1)


def digits(doc_id: int | None, seed: int = SEED) -> list[int]:
    """h1 to h4 of a document."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, ends: list[int], h1: int, h2: int) -> tuple[str, str, str]:
    """(prefix, middle, suffix)."""
    n = len(ends)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    return text[:a], text[a:b], text[b:]


def transform(text: str, doc_id: int | None, plain: int = PLAIN, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, length of the prefix, of the middle, output) of one document."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = digits(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return len(ends), "plain", None, None, text
    prefix, middle, suffix = cut(text, ends, h1, h2)
    if h4 % 100 < spm:
        return len(ends), "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from an output and its form alone."""
    if form == "plain":
        return output
    rest, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = rest[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = rest[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _COLUMNS.values(), strict=True)], names=list(_COLUMNS))

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                rows.append((doc_id, *transform(text, doc_id, plain, spm, seed)))
                held += len(text)
                if held >= BLOCK:
                    yield emit()
                    rows, held = [], 0
        if rows:
            yield emit()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def with_restored(outputs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the text rebuilt from output and form, as column ``restored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, f"{SCHEMA}, restored string")
