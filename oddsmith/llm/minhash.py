"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

1. Each document gets 192 MinHash samples.  48 bands of 4 samples propose pairs (a pair of
   similarity 0.75 shares none with probability (1 - 0.75 ** 4) ** 48, about 1e-8).  The
   samples are also folded into an odd sketch: a 512-bit parity bitmap in which sample i
   flips one bit.  The XOR of two sketches has as many bits as samples that differ flip,
   which gives the similarity: 1 + bits / (4 samples) * ln(1 - 2 z / bits).
2. Documents with equal shingle sets are one class, known by a hash of the set's digests (the
   smallest id names it at the end).  A block
   hands on the bands of one document of each class, a bucket keeps one of each.
3. Buckets of a band with two or more representatives are brought together; buckets with the
   same members count once.  A bucket past ``BUCKET`` members leaves its task member by
   member, in blocks that all start with the same few pivots, so what it makes is in
   proportion to its members and a task holds one block.
4. First pass: in each bucket or block every document proposes its nearest earlier one by the
   odd sketches, if the estimate reaches 0.5 (a pair of similarity 0.75 is 5.7 standard
   deviations above).  Each document keeps its best proposal; it is confirmed on the full
   sets.  Confirmed links join components, over all blocks by way of the pivots.
5. Second pass: only pairs of a bucket that still lie in different components and pass the
   sketch are left.  A bucket of one component is done.  Elsewhere the members outside the
   largest component meet all members in cells of bounded rows and shingles (row and column
   blocks by hash, made by ``explode`` and shuffled as groups of their own), so all pairs
   across components are looked at.  What passes is confirmed exactly, on bitmaps of the
   shingles shared.  So every pair that bands and sketches let through is either confirmed,
   refuted or already connected, and a group of copies is never expanded into all its pairs.

Defined cases: a null or empty text, or one of white space, has no shingles and is linked
with nothing; rows that repeat an id are judged each by its own text, and texts with one
smallest id share its component; a null id stands alone (component null, kept); ties
take the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.shingles import shingle_sets
from oddsmith.llm.store import stored
from oddsmith.llm.text import U, blocks, mixed
from oddsmith.operators.graph import connected_components

BANDS, ROWS = 48, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
LEAST_ESTIMATE = 0.5
NUMERATOR, DENOMINATOR = 75, 100
#: members of a block or of a side of a cell, and shingles of such a side
BUCKET, CELL_SHINGLES = 512, 4_000_000
#: kinds of rows of ``buckets``
SMALL, BLOCK, WHOLE = 0, 1, 2

_RNG = np.random.default_rng(1301)
_FACTORS = (_RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint64) * U(2) + U(1)).astype(np.uint32)
_SHIFTS = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_ROW_FACTORS = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * U(2) + U(1)


def flips_at(similarity: float) -> float:
    """Expected bits of the XOR of two sketches at a similarity."""
    return SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS))


MOST_FLIPS = int(flips_at(LEAST_ESTIMATE))


def samples(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(SAMPLES, documents) minima; documents without shingles get the largest value."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.full((SAMPLES, len(bounds) - 1), 0xFFFFFFFF, np.uint32)
    if len(full):
        x, starts = (hashes >> U(32)).astype(np.uint32), bounds[full]
        for i in range(SAMPLES):
            out[i, full] = np.minimum.reduceat((x ^ _SHIFTS[i]) * _FACTORS[i], starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit keys."""
    m = minima.astype(np.uint64).reshape(BANDS, ROWS, -1)
    return mixed((m * _ROW_FACTORS[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * U(0x9E3779B97F4A7C15)).T


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_BITS / 8) parity bitmaps."""
    n = minima.shape[1]
    bit = mixed(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << U(32))[:, None]) % U(SKETCH_BITS)
    flips = np.bincount((bit.astype(np.int64) + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n, two digests of the set, band keys and odd sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, bounds = shingle_sets(block)
            minima = samples(hashes, bounds)
            n, full = np.diff(bounds), np.flatnonzero(np.diff(bounds))
            digests = np.zeros((2, block.n), np.uint64)
            if len(full):
                digests[0, full] = np.add.reduceat(hashes, bounds[full])
                digests[1, full] = np.bitwise_xor.reduceat(mixed(hashes + U(0x5851F42D4C957F2D)), bounds[full])
            # bands of the smallest id of each class of the block; none without words or id
            doc = block.column("doc_id").fill_null(0).to_numpy()
            order = np.lexsort((doc, digests[1], digests[0]))
            fresh = np.ones(block.n, bool)
            fresh[1:] = (digests[:, order[1:]] != digests[:, order[:-1]]).any(axis=0) | ~np.asarray(block.column("doc_id").is_valid())[order[:-1]]
            chosen = np.zeros(block.n, bool)
            chosen[order] = fresh
            chosen &= (n > 0) & np.asarray(block.column("doc_id").is_valid())
            ends = np.concatenate([[0], np.cumsum(chosen * BANDS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(minima)[chosen].ravel().view(np.int64)))
            sketch = odd_sketches(minima)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_key"), pa.array(n, pa.int64()), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), keys, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["doc_id", "text_key", "n", "d1", "d2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n long, d1 long, d2 long, bands array<long>, sketch binary")


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` from sorted batches, also where a run crosses batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (a > 0 or held[0].column(key)[0].as_py() != k[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, kind, doc_id) of the buckets with several representatives, equal buckets once.

    ``SMALL`` rows are a bucket of at most ``BUCKET`` members, ``BLOCK`` rows a block of a
    larger one with its pivots in front, ``WHOLE`` rows its members.  Large buckets that
    begin with the same block share a name, so that their members are taken together.
    """
    most, lead = BUCKET, max(1, BUCKET // 16)

    def named(ids: np.ndarray, kind: int) -> np.int64:
        return mixed(mixed(ids.astype(np.uint64)).sum(dtype=np.uint64, keepdims=True) + U(len(ids) + (kind << 32))).view(np.int64)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        key = last = pivots = whole = None
        waiting: list[np.ndarray] = []

        def put(name: np.int64, kind: int, ids: np.ndarray) -> None:
            nonlocal held
            out.append((np.full(len(ids), name, np.int64), np.full(len(ids), kind, np.int32), ids))
            held += len(ids)

        def cut(end: bool) -> None:
            """Blocks that are full leave; at the end of the bucket its rest as well."""
            nonlocal waiting, pivots, whole
            ids = np.concatenate(waiting)
            if pivots is None and len(ids) <= most:
                if end and len(ids) > 1:
                    put(named(ids, SMALL), SMALL, ids)
            else:
                if pivots is None:
                    pivots, whole = ids[:lead], named(ids[:most], WHOLE)
                    put(named(ids[:most], BLOCK), BLOCK, ids[:most])
                    put(whole, WHOLE, ids[:most])
                    ids = ids[most:]
                while len(ids) >= most - lead or (end and len(ids)):
                    part, ids = ids[: most - lead], ids[most - lead :]
                    block = np.concatenate([pivots, part])
                    put(named(block, BLOCK), BLOCK, block)
                    put(whole, WHOLE, part)
            waiting = [] if end else [ids]
            if end:
                pivots = whole = None

        for batch in batches:
            if not batch.num_rows:
                continue
            k, d = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            fresh = np.ones(len(k), bool)
            fresh[0] = key is None or k[0] != key or d[0] != last
            fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            last, k, d = d[-1], k[fresh], d[fresh]
            if not len(k):
                continue
            if key is not None and k[0] != key:
                cut(True)
            key = k[-1]
            cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            waiting.append(d[: cuts[1]])
            if len(cuts) > 2:
                cut(True)
                # most keys have one row: only runs of two or more are looked at
                for i in np.flatnonzero(np.diff(cuts[1:-1]) > 1) + 1:
                    waiting = [d[cuts[i] : cuts[i + 1]]]
                    cut(True)
                waiting = [d[cuts[-2] :]]
            cut(False)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["bucket", "kind", "doc_id"])
                out.clear()
                held = 0
        if waiting:
            cut(True)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["bucket", "kind", "doc_id"])

    rows = sigs.select(F.explode("bands").alias("key"), "doc_id")
    return rows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "bucket long, kind int, doc_id long").distinct()


def _near(z: np.ndarray, n: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which of rows i.. and columns j.. pass the sketch and can reach the similarity by their sizes."""
    a, b = n[i : i + z.shape[0], None], n[None, j : j + z.shape[1]]
    return (z <= MOST_FLIPS) & (DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b))


def _tiles(sketch: np.ndarray, n: np.ndarray, tile: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For rows i.. : flips against all earlier rows, and which of them count."""
    m = len(n)
    for i in range(0, m, tile):
        end = min(i + tile, m)
        z = np.zeros((end - i, end), np.int32)
        for w in range(sketch.shape[1]):
            z += np.bitwise_count(sketch[i:end, w, None] ^ sketch[None, :end, w])
        near = _near(z, n, i, 0) & (np.arange(end)[None, :] < np.arange(i, end)[:, None])
        yield i, z, near


def _unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    group = group.combine_chunks()
    raw = b"".join(group.column("sketch").to_pylist())
    return group.column("doc_id").to_numpy(), group.column("n").to_numpy(), np.frombuffer(raw, np.uint64).reshape(group.num_rows, -1)


def proposals(members: DataFrame) -> DataFrame:
    """(b, a): for each document its nearest earlier one of all its buckets, by the sketches; a is null for one that is only near later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for group in by_group(batches, "bucket"):
            ids, n, sketch = _unpacked(group)
            near_later = np.zeros(len(ids), bool)
            for i, z, near in _tiles(sketch, n):
                near_later[: near.shape[1]] |= near.any(axis=0)
                z = np.where(near, z, SKETCH_BITS + 1)
                best = z.argmin(axis=1)
                flips = z[np.arange(len(z)), best]
                ok = flips <= MOST_FLIPS
                out.append((ids[i : i + len(z)][ok], ids[best[ok]], flips[ok].astype(np.int32)))
            out.append((ids[near_later], ids[near_later], np.full(int(near_later.sum()), SKETCH_BITS, np.int32)))
            held += len(ids)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["b", "a", "flips"])
                out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["b", "a", "flips"])

    found = members.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(run, "b long, a long, flips int")
    best = found.groupBy("b").agg(F.min(F.struct("flips", "a")).alias("best"))
    return best.select("b", F.when(F.col("best.a") != F.col("b"), F.col("best.a")).alias("a"))


def similar(common: int, a: int, b: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (a + b - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, bool)
            sides = []
            for name in ("text_a", "text_b"):
                parts = [shingle_sets(block) for block in blocks(iter([batch]), name)]
                sides.append([h[x:y] for h, bounds in parts for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                keep[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["src", "dst"]).filter(pa.array(keep))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "src long, dst long")


def cells(members: DataFrame) -> DataFrame:
    """The members (bucket, doc_id, n, sketch, component) of buckets with several components, dealt to cells that take the bucket's place.

    Members outside the bucket's largest component are rows, all members are columns; each
    pair of a row and a column meets in one cell.
    """
    most, shingles = BUCKET, CELL_SHINGLES
    by = members.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    per = by.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "component", "n")).alias("top")).where("top.m < m")
    blocks_of = lambda m, n: F.greatest(F.ceil(m / most), F.ceil(n / shingles), F.lit(1)).cast("int")
    per = per.select("bucket", F.col("top.component").alias("top"), blocks_of(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("rows"), blocks_of(F.col("m"), F.col("n")).alias("columns"))
    place = lambda count: F.pmod(F.xxhash64("doc_id"), F.col(count)).cast("int")
    # the buckets have no bound: never broadcast
    dealt = members.join(per.hint("merge"), "bucket").withColumn("row", place("rows")).withColumn("column", place("columns"))
    cell = lambda row, column: F.struct(row.alias("row"), column.alias("column"))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: cell(i, F.col("column")))
    across = F.transform(F.filter(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: (j != F.col("column")) & (F.col("component") != F.col("top"))), lambda j: cell(F.col("row"), j))
    dealt = dealt.withColumn("cell", F.explode(F.concat(down, across)))
    return dealt.select(F.xxhash64("bucket", "cell.row", "cell.column").alias("bucket"), "doc_id", "n", "sketch", "component")


def open_members(members: DataFrame) -> DataFrame:
    """(bucket, doc_id, n, sketch, component) of the documents that have a pair across components to be confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "bucket"):
            component = group.column("component").to_numpy()
            if (component == component[0]).all():
                continue
            _, n, sketch = _unpacked(group)
            wanted = np.zeros(len(n), bool)
            for i, z, near in _tiles(sketch, n):
                near &= component[i : i + len(z), None] != component[None, : z.shape[1]]
                wanted[i : i + len(z)] |= near.any(axis=1)
                wanted[: z.shape[1]] |= near.any(axis=0)
            if wanted.any():
                yield from group.filter(pa.array(wanted)).to_batches()

    return members.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(run, members.schema)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left[k]] and sets[right[k]], on bitmaps of the shared elements."""
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[inverse]
    words = max(1, -(-int(shared.sum()) // 64))
    bits = np.zeros((len(sets), words), np.uint64)
    slot = place[inverse[keep]]
    np.bitwise_or.at(bits, (owner[keep], slot // 64), U(1) << (slot % 64).astype(np.uint64))
    out = np.zeros(len(left), np.int64)
    step = max(1, 1_000_000 // words)
    for i in range(0, len(left), step):
        out[i : i + step] = np.bitwise_count(bits[left[i : i + step]] & bits[right[i : i + step]]).sum(axis=1, dtype=np.int64)
    return out


def links_across(members: DataFrame) -> DataFrame:
    """(src, dst) of similar documents of a bucket in different components; ``members`` carries the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "bucket"):
            ids, n, sketch = _unpacked(group)
            component = group.column("component").to_numpy()
            parts = [shingle_sets(block) for block in blocks(iter(group.combine_chunks().to_batches()))]
            sets = [h[x:y] for h, bounds in parts for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            left, right = [], []
            for i, z, near in _tiles(sketch, n):
                r, c = np.nonzero(near & (component[i : i + len(z), None] != component[None, : z.shape[1]]))
                left.append(r + i)
                right.append(c)
            left, right = np.concatenate(left), np.concatenate(right)
            common = intersections(sets, left, right)
            size = np.array([len(s) for s in sets])
            ok = DENOMINATOR * common >= NUMERATOR * (size[left] + size[right] - common)
            # one link for each two components is enough
            two = np.unique(np.column_stack([component[left[ok]], component[right[ok]]]), axis=0)
            if len(two):
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["src", "dst"])

    return members.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    # a class is known by a hash of its set's size and digests, so that texts of one id are told apart
    sigs = stored(signatures(docs).withColumn("node", F.xxhash64("n", "d1", "d2")), "minhash-signatures")
    classes = sigs.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    classes = stored(classes.select("node", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("text_key")), "minhash-classes")
    found = buckets(sigs.select(F.col("node").alias("doc_id"), "bands"))
    members = stored(found.join(sigs.select(F.col("node").alias("doc_id"), "n", "sketch").dropDuplicates(["doc_id"]), "doc_id"), "minhash-members")
    near = stored(proposals(members.where(F.col("kind") != WHOLE)), "minhash-proposals")
    pairs = near.where("a is not null")
    # the ids near another have no bound: never broadcast, the same join at every size
    wanted = classes.join(near.select(F.col("b").alias("node")).hint("merge"), "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").withColumn("text_key", F.xxhash64("text"))
    texts = stored(texts.join(wanted.hint("merge"), ["rep", "text_key"]).select(F.col("node").alias("doc_id"), "text"), "minhash-texts")
    # classes with one smallest id share its component
    several = classes.groupBy("rep").agg(F.min("node").alias("src"), F.count("*").alias("texts")).where("texts > 1")
    same = classes.join(several.hint("merge"), "rep").where("node <> src").select("src", F.col("node").alias("dst"))
    first = stored(confirmed(pairs, texts).unionByName(same).distinct(), "minhash-links")
    label = stored(connected_components(first), "minhash-labels")
    labelled = members.where(F.col("kind") != BLOCK).join(label, members["doc_id"] == label["node"], "left")
    labelled = stored(labelled.select("bucket", "doc_id", "n", "sketch", F.coalesce("component", "doc_id").alias("component")), "minhash-labelled")
    waiting = stored(open_members(cells(labelled)), "minhash-open")
    second = stored(links_across(waiting.join(texts, "doc_id")).distinct(), "minhash-across")
    merged = connected_components(second)
    merged = stored(merged, "minhash-merged")
    final = label.join(merged.withColumnRenamed("node", "old").withColumnRenamed("component", "new"), F.col("component") == F.col("old"), "left")
    final = final.select("node", F.coalesce("new", "component").alias("component"))
    alone = merged.join(label, "node", "left_anti")
    final = final.unionByName(alone.select("node", "component"))
    labels = classes.join(final, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("group"))
    # the component's name is its smallest id
    labels = labels.join(labels.groupBy("group").agg(F.min("rep").alias("component")), "group").select("node", "component")
    # copies by the thousand share a class: that join is dealt anew where it is skewed
    out = sigs.select("doc_id", "n", "node").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of one document of each group, with all their columns; of rows that repeat an id the first by text, then by the other columns, stays."""
    keep = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_near_keep")).distinct()
    numbered = docs.join(keep.hint("merge"), docs["doc_id"] == keep["_near_keep"], "left_semi")
    least = F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("least")
    numbered = numbered.groupBy("doc_id").agg(least).select(*(c if c == "doc_id" else F.col("least")[c].alias(c) for c in docs.columns))
    return numbered.unionByName(docs.where(F.col("doc_id").isNull()))
