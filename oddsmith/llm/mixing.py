"""Mix sources to target weights by nested hash thresholds: no sort, no shuffle of documents.

Every document has a fixed 60-bit hash of its id.  A source takes all its documents
``whole`` times, and once more those whose hash is at most the source's threshold.
The threshold comes from histograms: words are summed by (source, leading hash bits),
a map-side combined aggregate; the running sum finds the bucket in which the budget
ends; only that bucket is split by the next bits, until it holds one hash.  What
leaves a level is one row for each source.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source
of its own, the last in order; a row without an id is hashed by its text; rows that
repeat an id have one hash and stand or fall together; a source without words has target 0; an
empty table gives an empty result.  Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.store import stored

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash() -> Column:
    """The first 60 bits of the md5 of the id as text; of the document's text where the id is null."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    digest = F.md5(named.cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat over the sources by code point, null last.  No target passes ``most``
    times its source; the excess goes to the others by weight, again and again.  The
    fixed point is min(cap, level * weight) with one common level: sources ordered by
    cap / weight are full up to the first whose share of what is left fits.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * total - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place"))
    common = F.coalesce(F.min_by("level", fits).over(everything), F.lit(float("inf")))
    return filled.withColumn("common", common).select("source", "source_size", F.when(F.col("cap") == 0, 0.0).otherwise(F.least("cap", F.col("common") * F.col("weight"))).alias("target"))


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, threshold) from a stored (source, size, h)."""
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", ratio).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    at = stored(goal.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "mix-goal")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        here = sizes.alias("s").join(at.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source")) & (F.shiftright("s.h", shift + LEVEL_BITS) == F.col("a.prefix")))
        counts = here.groupBy(F.col("a.source").alias("source"), F.shiftright("s.h", shift).alias("bucket")).agg(F.sum("s.size").alias("words"), F.min("s.h").alias("lowest"), F.max("s.h").alias("highest"))
        # one row a bucket and source, at most 4096 buckets
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        counts = counts.withColumn("run", run).alias("c").join(at.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source")))
        past = F.col("a.below") + F.col("c.run") > F.col("a.rest")
        edge = counts.where(past).groupBy(F.col("a.source").alias("source")).agg(F.min_by(F.struct("c.bucket", "c.words", "c.lowest", "c.highest", (F.col("a.below") + F.col("c.run") - F.col("c.words")).alias("below")), "c.bucket").alias("e"))
        at = stored(at.drop("prefix", "below", "words", "lowest", "highest").alias("a").join(edge.alias("e"), F.col("a.source").eqNullSafe(F.col("e.source")), "left").select(
            "a.source", "source_size", "target", "whole", "rest", F.col("e.e.bucket").alias("prefix"), F.col("e.e.below").alias("below"), F.col("e.e.words").alias("words"), F.col("e.e.lowest").alias("lowest"), F.col("e.e.highest").alias("highest")), "mix-level")
        if at.where("lowest < highest").isEmpty():
            break
    # the last hash goes in when that comes nearer to the budget; no edge: the rest takes all
    nearer = F.col("below") + F.col("words") - F.col("rest") < F.col("rest") - F.col("below")
    cut = F.when(F.col("lowest").isNull(), F.lit(-1)).when(nearer, F.col("lowest")).otherwise(F.col("lowest") - 1).cast("long")
    return stored(at.select("source", "source_size", "target", "whole", cut.alias("threshold")), "mix-plan")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """The stored sizes (doc_id, source, size, h) of all documents, and the plan of each source."""
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size"), row_hash().alias("h")), "mix-sizes")
    return sizes, thresholds(sizes, weights, total, most)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats for every row."""
    sizes, plan = plan_mix(docs, weights, total, most)
    repeats = (F.col("p.whole") + F.when(F.col("s.h") <= F.col("p.threshold"), 1).otherwise(0)).cast("long")
    joined = sizes.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).withColumn("repeats", repeats)
    return joined.select(F.col("s.doc_id").alias("doc_id"), F.col("s.size").alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), (F.col("s.size") * F.col("repeats")).alias("taken"), "repeats")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it takes it, with the columns of ``docs``."""
    _, plan = plan_mix(docs, weights, total, most)
    chosen = plan.select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("threshold").alias("_mix_threshold"))
    joined = docs.join(chosen, docs["source"].eqNullSafe(F.col("_mix_source")))
    repeats = (F.col("_mix_whole") + F.when(row_hash() <= F.col("_mix_threshold"), 1).otherwise(0)).cast("int")
    return joined.withColumn("_mix_copy", F.explode(F.when(repeats > 0, F.sequence(F.lit(1), repeats)))).select(*docs.columns)
