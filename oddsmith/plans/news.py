"""Article analysis with keyword tables, linking to markets, and the control state of places.

The keyword tables are parameters (short lists); matching is a projection over the whole
text, so articles are read once and never shuffled until something is grouped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.scalars import ago, clamp, key_id

# fixed values: the control a signal stands for
CONTROL_OF_SIGNAL = {"RU": "RU", "UA": "UA", "CONTESTED": "CONTESTED", "RU_ADVANCE": "CONTESTED", "UA_ADVANCE": "CONTESTED", "UA_LOST": "RU"}


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])
    return out if default is None else F.coalesce(out, F.lit(default))


def entities(text: Column, aliases: dict[str, str]) -> Column:
    """Sorted distinct entities whose alias occurs; of overlapping aliases the longest wins."""
    longest_first = sorted(aliases, key=lambda a: (-len(a), a))
    pattern = "(" + "|".join(re.escape(a) for a in longest_first) + ")"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    table = F.create_map(*[F.lit(x) for a in longest_first for x in (a, aliases[a])])
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: F.element_at(table, a))))


def occurrences(text: Column, word: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word))


def keyword_sentiment(text: Column, scores: dict[str, float], cap: int = 3) -> Column:
    """Weighted mean score of the keywords, each counted at most ``cap`` times."""
    counts = {w: F.least(occurrences(text, w), F.lit(cap)) for w in scores}
    total = sum((F.lit(s) * counts[w] for w, s in scores.items()), F.lit(0.0))
    return total / F.greatest(sum(counts.values(), F.lit(0)), F.lit(1))


def hits(text: Column, words: Sequence[str]) -> Column:
    return sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def best_category(text: Column, categories: dict[str, Sequence[str]], default: str = "general") -> Column:
    """Category with most keywords present; the first in the table wins a tie."""
    ranked = [F.struct(hits(text, ws).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(categories.items())]
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["c"]).otherwise(default)


def first_group(found: Column, groups: dict[str, Sequence[str]], default: str = "general") -> Column:
    out = None
    for name, members in groups.items():
        test = F.arrays_overlap(found, F.array(*[F.lit(m) for m in members]))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def max_score(text: Column, scores: dict[str, float]) -> Column:
    return F.greatest(F.lit(0.0), *[F.when(F.contains(text, F.lit(w)), F.lit(s)).otherwise(0.0) for w, s in scores.items()])


def present(text: Column, table: dict[str, Sequence[str]]) -> Column:
    """Names of the table of which any keyword occurs, in table order."""
    return F.array_compact(F.array(*[F.when(hits(text, ws) > 0, F.lit(n)) for n, ws in table.items()]))


def article_analysis(articles: DataFrame, config: dict) -> DataFrame:
    """Entities, sentiment, control signals, category, region, urgency and actors of each article."""
    rows = articles.withColumn("_t", F.lower(F.concat_ws(" ", "title", "body")))
    rows = rows.withColumn("entities", entities(F.col("_t"), config["aliases"]))
    t = F.col("_t")
    controls = F.array_compact(F.array(*[
        F.when(F.contains(t, F.lit(w)), F.struct(F.lit(w).alias("keyword"), F.lit(sig).alias("signal"), F.lit(float(c)).alias("confidence"))) for w, (sig, c) in config["controls"].items()]))
    return rows.select(
        *articles.columns, key_id("source", "title", F.unix_micros("published_at")).alias("key"), "entities", keyword_sentiment(t, config["sentiment"]).alias("sentiment"),
        best_category(t, config["categories"]).alias("category"), first_group(F.col("entities"), config["regions"]).alias("region"), max_score(t, config["urgency"]).alias("urgency"),
        present(t, config["actors"]).alias("actors"), controls.alias("controls"))


def word_set_sentiment(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """(pos - neg) / (pos + neg) over the distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1))
    pos = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in positive])))
    neg = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in negative])))
    return F.when(pos + neg > 0, (pos - neg) / F.nullif(pos + neg, F.lit(0))).otherwise(0.0)


def headline_urgency(text: Column, strong: Sequence[str] = ("breaking", "just in", "urgent", "alert"), mild: Sequence[str] = ("live", "now", "today", "minutes ago")) -> Column:
    t = F.lower(text)
    part = F.when(hits(t, strong) > 0, 0.5).otherwise(0.0) + F.when(hits(t, mild) > 0, 0.3).otherwise(0.0) + F.when(F.contains(text, F.lit("!")), 0.2).otherwise(0.0)
    return clamp(part, 0.0, 1.0)


def new_articles(batch: DataFrame, seen: DataFrame, key: str, as_of: Column, days: int = 2) -> DataFrame:
    """First article of each key that was not seen in the last days (ties: smallest id)."""
    recent = seen.where(F.col("published_at") >= ago(as_of, days * 86400)).select(key).distinct()
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("published_at", "article_id")).alias("_r")).select(key, "_r.*")
    return first.join(recent, key, "left_anti")


#: tasks that share the markets of one entity, rows that hold the articles, and the markets, of a set of entities
DEALT, ARTICLE_PACKS, MARKET_PACKS = 16, 16, 256


def _packs(rows: DataFrame, key: str, packs: int, sets: str, ids: str) -> DataFrame:
    """(sorted set of entities, pack, ids) of the keys of (key, entity) rows; a null key stays in its struct."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set("entity")).alias(sets))
    return found.groupBy(sets, F.pmod(F.hash(key), F.lit(packs)).alias("_p")).agg(F.collect_list(F.struct(key)).alias(ids))


def link_markets(analyzed: DataFrame, entity_markets: DataFrame) -> DataFrame:
    """(article, market) rows through the entities an article mentions.

    Articles, and markets, of the same entities are packed into a few rows, so neither copies for the
    tasks of an entity nor the rows that the join buffers grow with links.  A link comes from the smallest
    entity that both have and needs no shuffle to be distinct.  The articles of a pack follow each other
    for each market: where links are stored, the same run of ids comes again and again.
    """
    articles = _packs(analyzed.select("article_id", F.explode("entities").alias("entity")), "article_id", ARTICLE_PACKS, "_a", "_articles")
    markets = _packs(entity_markets, "condition_id", MARKET_PACKS, "_m", "_markets")
    left = articles.select("_a", "_articles", F.explode("_a").alias("entity")).withColumn("_d", F.explode(F.array(*[F.lit(i) for i in range(DEALT)])))
    right = markets.select("_m", "_markets", F.explode("_m").alias("entity"), F.pmod("_p", F.lit(DEALT)).alias("_d"))
    once = (F.size("_m") == 1) | (F.col("entity") == F.array_min(F.array_intersect("_a", "_m")))
    pairs = left.join(right.hint("merge"), ["entity", "_d"]).where(once)
    rows = pairs.select("_articles", F.explode("_markets.condition_id").alias("condition_id"))
    return rows.select(F.explode("_articles.article_id").alias("article_id"), "condition_id")


def control_updates(analyzed: DataFrame) -> DataFrame:
    """One state row per article, place and control keyword."""
    rows = analyzed.select("article_id", "source", "published_at", F.explode("entities").alias("place"), "controls").select(
        "article_id", "source", "published_at", "place", F.explode("controls").alias("c"))
    signal = F.col("c.signal")
    control = lookup(signal, CONTROL_OF_SIGNAL, "CONTESTED")
    return rows.select(
        "article_id", "place", "source", "published_at", F.col("c.keyword").alias("keyword"), control.alias("control"),
        F.when(signal.isin("RU_ADVANCE", "CONTESTED"), 0.5).otherwise(0.0).alias("intensity"), F.when(control.isin("CONTESTED", "RU"), 0.0).otherwise(50.0).alias("distance_km"),
        F.col("c.confidence").alias("confidence"))


def latest_control(updates: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    last = F.struct("published_at", "article_id", "keyword")
    recent = updates.where(F.col("published_at") >= ago(as_of, days * 86400))
    return recent.groupBy("place").agg(*[F.max_by(c, last).alias(c) for c in ("control", "intensity", "distance_km", "confidence")], F.max("published_at").alias("last_seen"))
