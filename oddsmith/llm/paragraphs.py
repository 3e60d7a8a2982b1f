"""Document fingerprints as invertible Bloom lookup tables of paragraph digests, in DataFrame functions only.

A text is the set of its non-empty lines, each a 64-bit digest.  Its table has a number of
cells in three equal parts; a digest goes to one cell of each part, and a cell holds a
count, the XOR of its digests and the XOR of their check values.  The table of the base
size is the fingerprint.

Two versions are compared by subtracting tables cell by cell: what they share vanishes.
Peeling then takes every cell that holds exactly one digest (count 1 or -1, check value
right), notes the digest and removes it from its cells, round by round.  When cells
remain, peeling failed, and both sides are built again at twice the size.  The
recovered digests of either side give the likeness: the Jaccard similarity of the sets.

Tables are sorted arrays of their cells that are not empty.  Joining two tables is a
sort and one pass, so a document costs time in proportion to its paragraphs.

The order of the ids is found on ids alone: they are range-partitioned, the next id inside
a partition is a window over it, and one row a partition links the partitions.  Texts are
then shuffled once, by slices of about a thousand ids; the first documents of a slice also
go to the slice before, and the few documents whose next one is still elsewhere (a gap in
the ids, the last of all) get it by a join.

Defined cases: a null text is empty; an empty text has no cells and an empty fingerprint;
two empty sets are alike (1.0); of rows that repeat an id, the smallest text serves as
the next document, and each row has the next larger id as its next; a row with a null id
has no next document (an empty one) and is nobody's; a single document is its own next;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.store import stored

PARTS = 3
BASE_CELLS = 24
ROUNDS = 40
#: sizes tried past the one that holds four cells a digest
EXTRA = 8
_CELL = "struct<i:int,c:int,k:bigint,h:bigint>"
_FOUND = "array<struct<k:bigint,s:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """Distinct digests of the non-empty lines."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def entries(keys: Column, cells: Column, sign: Column | None = None) -> Column:
    """The contributions of digests to a table of ``cells`` cells, not yet joined."""
    width = (cells / PARTS).cast("int")
    count = F.lit(1) if sign is None else sign

    def of(key: Column) -> Column:
        return F.array(*[F.struct((F.pmod(F.xxhash64(key, F.lit(j)), width) + j * width).cast("int").alias("i"), count.cast("int").alias("c"), key.alias("k"), check(key).alias("h")) for j in range(PARTS)])

    return F.flatten(F.transform(keys, of))


def joined(cells: Column) -> Column:
    """Cells of equal index made one, empty ones dropped; sorted by index."""

    def run(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), size), lambda p: (p == 1) | (F.element_at(s, p)["i"] != F.element_at(s, F.greatest(p - 1, F.lit(1)))["i"]))

        def cell(a: Column, b: Column) -> Column:
            part = F.slice(s, a, b - a)
            return F.when(b - a == 1, F.element_at(s, a)).otherwise(
                let(part, lambda q: F.aggregate(F.slice(q, 2, F.size(q)), q[0], lambda x, y: F.struct(x["i"].alias("i"), (x["c"] + y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))))

        cells_ = let(starts, lambda st: F.zip_with(st, F.concat(F.slice(st, 2, F.size(st)), F.array(size + 1)), cell))
        return F.when(size == 0, s).otherwise(F.filter(cells_, lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0)))

    return let(F.sort_array(cells), run)


def table(keys: Column, cells: Column) -> Column:
    return joined(entries(keys, cells))


def minus(a: Column, b: Column) -> Column:
    """Table a without table b, cell by cell."""
    return joined(F.concat(a, F.transform(b, lambda x: F.struct(x["i"].alias("i"), (-x["c"]).alias("c"), x["k"].alias("k"), x["h"].alias("h")))))


def peeled(difference: Column, cells: Column) -> Column:
    """struct(cells, found): what peeling leaves, and the digests with the side (1 or -1) that has them."""

    def step(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == check(x["k"])))
        keys = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("s"))))

        def remove(found: Column) -> Column:
            taken = F.flatten(F.transform(found, lambda x: entries(F.array(x["k"]), cells, -x["s"])))
            return F.when(F.size(found) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(True).alias("stuck"))).otherwise(
                F.struct(joined(F.concat(state["cells"], taken)).alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(False).alias("stuck")))

        return let(keys, remove)

    start = F.struct(difference.alias("cells"), F.array().cast(_FOUND).alias("found"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: F.when(state["stuck"] | (F.size(state["cells"]) == 0), state).otherwise(step(state)))


def likeness(keys_a: Column, table_a: Column, keys_b: Column, table_b: Column) -> Column:
    """Jaccard similarity of two sets from their tables of the base size, or of larger ones when peeling fails."""
    sizes = F.size(keys_a) + F.size(keys_b)
    last = F.ceil(F.log2(F.greatest(sizes * 4 / BASE_CELLS, F.lit(1.0)))).cast("int") + EXTRA

    def attempt(level: Column) -> Column:
        cells = (F.lit(BASE_CELLS) * F.pow(F.lit(2.0), level)).cast("int")
        # level 0 has its tables already
        difference = F.when(level == 0, minus(table_a, table_b)).otherwise(minus(table(keys_a, cells), table(keys_b, cells)))
        return let(peeled(difference, cells), lambda p: F.struct((F.size(p["cells"]) == 0).alias("ok"), p["found"].alias("found")))

    start = F.struct(F.lit(False).alias("ok"), F.array().cast(_FOUND).alias("found"))
    result = F.aggregate(F.sequence(F.lit(0), last), start, lambda state, level: F.when(state["ok"], state).otherwise(attempt(level)))

    def ratio(r: Column) -> Column:
        only_a = F.size(F.filter(r["found"], lambda x: x["s"] > 0))
        common = F.size(keys_a) - only_a
        union = F.size(keys_a) + F.size(r["found"]) - only_a
        # after all sizes failed (not met in practice) the sets themselves are compared
        exact = F.size(F.array_intersect(keys_a, keys_b)) / F.greatest(F.size(F.array_union(keys_a, keys_b)), F.lit(1))
        return F.when(sizes == 0, 1.0).when(r["ok"], common / union).otherwise(exact)

    return let(result, ratio)


def as_text(cells: Column) -> Column:
    """Cells as ``index:count:digests:checks``, hexadecimal, by index."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(":", x["i"].cast("string"), x["c"].cast("string"), F.hex(x["k"]), F.hex(x["h"]))), ";")


def with_next(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next larger id, after the last the first; rows of an id have one next."""
    ordered = stored(ids.where("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()), "fingerprint-ids")
    edges = ordered.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    # one row a partition
    every = Window.partitionBy()
    edges = edges.select("part", F.coalesce(F.lead("first_id").over(Window.orderBy("part")), F.min("first_id").over(every)).alias("after"))
    near = ordered.withColumn("near", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return near.join(edges, "part").select("doc_id", F.coalesce("near", "after").alias("next_id"))


SLICE = 1000


def followed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text, keys, next_text, next_keys) of documents with unique ids; ``pairs`` as from ``with_next``."""
    gap = F.col("next_id") - F.col("doc_id")
    small, large = pairs.where("next_id > doc_id").select(F.percentile_approx(gap, [0.01, 0.99], 10_000).alias("q")).first()["q"] or (1, 1)
    width = SLICE * small

    def slice_of(c: str) -> Column:
        return F.col(c) - F.pmod(F.col(c), F.lit(width))

    own = F.struct(slice_of("doc_id").alias("slice"), F.lit(False).alias("guest"))
    before = F.struct((slice_of("doc_id") - width).alias("slice"), F.lit(True).alias("guest"))
    early = F.pmod(F.col("doc_id"), F.lit(width)) < large
    rows = docs.withColumn("at", F.explode(F.when(early, F.array(own, before)).otherwise(F.array(own)))).select("doc_id", "text", "keys", "at.slice", "at.guest", F.col("doc_id").alias("place"))
    there = (slice_of("next_id") == slice_of("doc_id")) | ((slice_of("next_id") == slice_of("doc_id") + width) & (F.pmod(F.col("next_id"), F.lit(width)) < large))
    elsewhere = pairs.where(~((F.col("next_id") > F.col("doc_id")) & there))
    # after the last comes the first
    place = F.when(F.col("next_id") > F.col("doc_id"), F.col("next_id")).otherwise(F.lit((1 << 63) - 1))
    elsewhere = stored(elsewhere.select(F.col("next_id").alias("guest_id"), slice_of("doc_id").alias("slice"), F.lit(True).alias("guest"), place.alias("place")), "fingerprint-gaps")
    guests = docs.join(elsewhere, docs["doc_id"] == elsewhere["guest_id"]).select("doc_id", "text", "keys", "slice", "guest", "place")
    ahead = Window.partitionBy("slice").orderBy("guest", "place")
    found = rows.unionByName(guests).withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_keys", F.lead("keys").over(ahead))
    return found.where("not guest").select("doc_id", "text", "keys", "next_text", "next_keys")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = stored(with_next(docs.select("doc_id")), "fingerprint-next")
    nothing = F.array().cast("array<bigint>")
    docs = docs.withColumn("keys", digests(F.col("text")))
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if pairs.count() == named.count():
        both = followed(named, pairs)
    else:
        # repeated ids: each row meets the smallest text of the next id
        heads = named.groupBy("doc_id").agg(F.min(F.struct("text", "keys")).alias("d")).join(pairs.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before")), "doc_id")
        both = named.join(heads.select("before", "d"), named["doc_id"] == F.col("before")).select("doc_id", "text", "keys", F.col("d.text").alias("next_text"), F.col("d.keys").alias("next_keys"))
    both = both.unionByName(unnamed.withColumn("next_text", F.lit("")).withColumn("next_keys", nothing))
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    base = F.lit(BASE_CELLS)
    rows = both.select("doc_id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), "keys", digests(edited).alias("edited_keys"), "next_keys")
    rows = rows.withColumns({f"{x}table": table(F.col(f"{x}keys"), base) for x in ("", "edited_", "next_")})
    near = {f"near_{x}": likeness(F.col("keys"), F.col("table"), F.col(f"{x}_keys"), F.col(f"{x}_table")) for x in ("edited", "next")}
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("table")).alias("fingerprint"), as_text(F.col("edited_table")).alias("edited_fingerprint"), *(v.alias(k) for k, v in near.items()))
