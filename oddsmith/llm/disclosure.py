"""Personal data by pattern, and terms that disclose it by corpus co-occurrence; DataFrame functions only.

1. Base spans: emails, ip addresses, payment cards (Luhn) and phone numbers, leftmost and
   without overlap inside each kind.  Positions come from the text between matches
   (split) and the matches (regexp_extract_all), in code points.
2. A protected entity is a kind and its value.  A term is a run of letters, in lower
   case.  Terms co-occur with the entities of their line, and with those of their document;
   each is scored over the whole corpus, with lines and with documents as units:

       IC(c)    = -log2(units(c) / units)
       PMI(t;c) = log2(units * together(t, c) / (units(t) * units(c)))

   and PMI / IC is the share of what the entity's name would tell that the term tells: 1
   when the term occurs only with the entity.  A term with at least ``SUPPORT`` different
   units together is generalised to the shape of its letters from ``GENERALISE`` on, and
   removed from ``REMOVE`` on, by the higher share of lines and documents, wherever it
   stands in a document that holds the entity.
3. ``sanitised`` puts tags for base spans, shapes for generalised and nothing for removed terms.

Counting terms is a map-side combined aggregate over all units; only entities of several
different units are paired with terms, terms and entities are joined by value, and a value
that many rows share is dealt anew (skewed join).

Defined cases: a null or empty text has no spans; an entity in every unit has IC 0
and discloses nothing there; rows that repeat an id are judged each by its own text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.store import stored

SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
#: fixed values: kinds in order, and their patterns with possessive repetition (the same matches without deep recursion;
#: a run that cannot start a match is tried once: at its begin, or where the last match ended)
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without this character has no match
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
LETTERS = r"\p{L}+"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


#: items that a scan appends to one array: appending copies what is there, so long scans go in pieces
SCAN = 128
#: a letter that stands for what is covered; no term holds it
FILLER = "\U00016FE0"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, step, emit, text: Column | None = None) -> Column:
    """``emit(at, item)`` of every item, where ``at`` is an int that starts at 0 and goes on by ``step(at, item)``.

    The array is walked in pieces of SCAN items: once for the states at their borders, once for what
    they give; a long array takes time in proportion to its length.  With ``text``, emit gets
    (at, item, part, base): the text from ``base``, where the piece begins, as far as its states reach.
    """

    def pieces(a: Column) -> Column:
        n = F.ceil(F.size(a) / SCAN).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(a, k * SCAN + 1, F.lit(SCAN)))).otherwise(F.slice(F.array(a), 1, 0))

    def borders(cut: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(cut, first, lambda s, piece: F.struct(F.aggregate(piece, s["at"], step).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: F.concat(s["all"], F.array(s["at"])))

    def walk(piece: Column, at: Column, out) -> Column:
        head, rest = F.get(piece, F.lit(0)), F.slice(piece, 2, F.lit(SCAN))
        first = F.struct(step(at, head).alias("at"), F.array(out(at, head)).alias("out"))
        return F.aggregate(rest, first, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(out(s["at"], x))).alias("out")), lambda s: s["out"])

    def each(cut: Column, states: Column) -> Column:
        def one(piece: Column, k: Column) -> Column:
            at = F.get(states, k)
            if text is None:
                return walk(piece, at, emit)
            return let(F.substring(text, at + 1, F.get(states, k + 1) - at), lambda part: walk(piece, at, lambda now, x: emit(now, x, part, at)))

        return F.flatten(F.transform(cut, one))

    return let(items, lambda a: let(pieces(a), lambda cut: let(borders(cut), lambda states: each(cut, states))))


def located(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, value) of all matches, in code points."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(between.alias("gap"), matches.alias("value")), lambda p: p["value"].isNotNull())
    sized = F.transform(pairs, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["value"]).alias("size"), p["value"].alias("value")))
    return scanned(
        sized, lambda at, p: at + p["gap"] + p["size"],
        lambda at, p: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value")))


def covered(text: Column, spans: Column, cover) -> Column:
    """The text with ``cover(span, its text)`` in place of each span, spans by start; one that begins inside another adds nothing."""

    def piece(at: Column, s: Column, part: Column, base: Column) -> Column:
        here = F.substring(part, s["start"] - base + 1, s["end"] - s["start"])
        return F.when(s["start"] >= at, F.concat(F.substring(part, at - base + 1, s["start"] - at), cover(s, here))).otherwise("")

    reach = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    pieces = scanned(spans, lambda at, s: F.greatest(at, s["end"]), piece, text)
    return F.concat(F.array_join(pieces, ""), F.substring(text, reach + 1, F.char_length(text)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits_of(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(figures, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(value)).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15)


def spans_of(text: Column, rank: int, kind: str) -> Column:
    def span(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))

    found = F.transform(F.filter(located(text, PATTERNS[kind]), lambda m: valid(kind, m["value"])), span)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """struct(start, rank, end, kind, value) of all kinds, by start, then kind as listed."""
    return F.sort_array(F.concat(*[spans_of(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(digits_of(span["value"])))


def blanked(text: Column, spans: Column) -> Column:
    """The text with a space for each span."""
    return covered(text, spans, lambda s, here: F.lit(" "))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != ""))


def lines_of(rows: DataFrame) -> DataFrame:
    """(text, spans) of each line with entities; no pattern matches across a line feed, so a line has the matches of the text in it."""
    lines = rows.select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    return lines.select("text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)


def entity_units(units: DataFrame) -> DataFrame:
    """(unit, key, entities, terms) of each (text, spans): ``unit`` numbers the rows, ``key`` is the same where texts are; the terms outside the spans."""
    entities = F.array_distinct(F.transform("spans", _entity))
    return units.select(F.monotonically_increasing_id().alias("unit"), F.xxhash64("text").alias("key"), entities.alias("entities"), terms_of(blanked(F.col("text"), F.col("spans"))).alias("terms"))


def unit_counts(units: DataFrame) -> DataFrame:
    """(term, units): in how many units (``text``) of the corpus a term occurs; the null term counts all units."""
    # a null marks the unit itself
    terms = F.concat(F.array(F.lit(None).cast("string")), terms_of(F.col("text")))
    return units.where("text <> ''").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("units"))


def disclosing(units: DataFrame, counts: DataFrame) -> DataFrame:
    """(entity, term, action) of the pairs whose share of the entity's information reaches a threshold."""
    each = units.select("unit", "key", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.count("*").alias("entity_units"), F.count_distinct("key").alias("keys")).where(F.col("keys") >= SUPPORT).drop("keys")
    # an entity of fewer different units has no term with enough
    pairs = each.join(entities.hint("merge"), "entity", "left_semi").join(units.select("unit", "terms").hint("merge"), "unit").select("entity", "key", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("together"), F.count_distinct("key").alias("different"))
    together = together.where(F.col("different") >= SUPPORT)
    total = counts.where("term is null").select(F.col("units").alias("all_units"))
    scored = together.join(counts.where("term is not null"), "term").join(entities, "entity").crossJoin(F.broadcast(total))
    information = F.log2(F.col("all_units") / F.col("entity_units"))
    shared = F.log2(F.col("all_units") * F.least("together", "units", "entity_units") / (F.col("units") * F.col("entity_units")))
    scored = scored.withColumn("share", F.when(information > 0, shared / information))
    return scored.where(F.col("share") >= GENERALISE).select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("general").alias("action"))


def term_spans(text: Column, base: Column, actions: Column) -> Column:
    """Spans of the words of ``actions`` (term to action) that touch no base span.

    Base spans are filled with a letter first, so a word that reaches into one is no term.
    """
    # overlapping base spans are filled as one: what is beyond the first is filled by the next
    filled = F.array_join(scanned(base, lambda at, s: F.greatest(at, s["end"]), lambda at, s, part, start: F.concat(
        F.when(s["start"] > at, F.substring(part, at - start + 1, s["start"] - at)).otherwise(""), F.repeat(F.lit(FILLER), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"])))), text), "")
    reach = F.aggregate(base, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    whole = F.concat(filled, F.substring(text, reach + 1, F.char_length(text)))
    named = F.filter(located(whole, LETTERS), lambda w: F.map_contains_key(actions, F.lower(w["value"])))
    return F.transform(named, lambda w: F.struct(
        w["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), w["end"].alias("end"), F.try_element_at(actions, F.lower(w["value"])).alias("kind"), F.lower(w["value"]).alias("value")))


def found_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, text (of rows with spans), base, spans: base spans and all spans of every row.

    ``row`` is the hash of id and text: rows that agree in both get the same spans.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), base_spans(F.col("text")).alias("spans"))
    rows = stored(rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "disclosure-base")
    hit = rows.where("text is not null").select("row", "text", "spans")
    named = None
    for name, units, corpus in (
        ("lines", lines_of(hit), docs.select(F.explode(F.split("text", "\n")).alias("text"))),
        ("documents", hit, docs),
    ):
        found = disclosing(stored(entity_units(units), f"disclosure-{name}"), unit_counts(corpus))
        named = found if named is None else named.unionByName(found)
    named = stored(named.groupBy("entity", "term").agg(F.max("action").alias("action")), "disclosure-terms")
    holds = hit.select("row", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct()
    more = holds.join(named.hint("merge"), "entity").groupBy("row", "term").agg(F.max("action").alias("action"))
    more = more.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    joined = rows.withColumnRenamed("spans", "base").join(more.hint("merge"), "row", "left")
    terms = F.when(F.col("actions").isNotNull(), term_spans(F.col("text"), F.col("base"), F.col("actions"))).otherwise(F.array().cast(_SPAN))
    return joined.select("row", "doc_id", "text", "base", F.sort_array(F.concat("base", terms)).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with tags for base spans, shapes for generalised terms and without removed terms; overlapping spans are covered once."""
    shape = lambda v: F.regexp_replace(F.regexp_replace(v, r"\p{Lu}", "X"), r"\p{L}(?<!X)", "x")
    cover = lambda s, here: F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "general", shape(here)).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return covered(text, spans, cover)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, number of terms, digest of the sanitised text where there are spans."""
    rows = found_spans(docs)
    counts = [count_of("base", k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
                       (F.size("spans") - F.size("base")).cast("long").alias("n_terms"), F.sha2(redacted(F.col("text"), F.col("spans")), 256).alias("sanitised_sha256"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of ``text``; all columns stay."""
    clean = found_spans(docs).where("text is not null").dropDuplicates(["row"]).select(F.col("row").alias("_pii_row"), redacted(F.col("text"), F.col("spans")).alias("_pii_text"))
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    joined = docs.withColumn("_pii_key", row).join(clean, F.col("_pii_key") == F.col("_pii_row"), "left")
    return joined.select(*[F.coalesce("_pii_text", "text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
