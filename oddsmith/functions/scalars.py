"""Column functions: arrays, safe arithmetic, dates, ids and small text rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(c: str | Column) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda acc, x: acc + x)


def first_or(c: str | Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(col(c), F.lit(1)), F.lit(default))


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(c)))


def clamp100(c: str | Column) -> Column:
    return clamp(c, -100.0, 100.0)


def safe_ratio(num: str | Column, den: str | Column, floor: float) -> Column:
    return col(num) / F.greatest(col(den), F.lit(floor))


def ratio_or_null(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is 0 (division by zero is an error under ANSI)."""
    return col(num) / F.nullif(col(den).cast("double"), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation, null when a side is constant (corr() fails on that under ANSI)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def sum_if(cond: Column, value: str | Column) -> Column:
    return F.sum(F.when(cond, col(value)).otherwise(0.0))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)


def ago(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(seconds))


def key_id(*cols: str | Column, length: int = 32) -> Column:
    """Stable id: the first hex digits of the SHA-256 of the key columns."""
    return F.substring(F.sha2(F.concat_ws(":", *[col(c).cast("string") for c in cols]), 256), 1, length)


def ou_threshold(question: str | Column) -> Column:
    """Strike of an over/under question, null when there is none."""
    found = F.regexp_extract(col(question), r"(?i)(?:O/U|Over/Under)\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.nullif(found, F.lit("")).cast("double")


def ladder_template(question: str | Column) -> Column:
    """The question with its strike replaced, spaces squeezed, lower case; null without strike."""
    marked = F.regexp_replace(col(question), r"(?i)((?:O/U|Over/Under)\s*)[0-9]+(?:\.[0-9]+)?", "$1{threshold}")
    text = F.lower(F.trim(F.regexp_replace(marked, r"\s+", " ")))
    return F.when(F.contains(text, F.lit("{threshold}")), text)


def parse_dimensions(text: str | Column) -> Column:
    """struct(h, w, d) in cm from "70 x 60 cm", labelled "35 w x 25 h x 18 d" or inches.

    The text becomes a list of numbers and a list of their labels, "" for none; the last number of a
    label stands.  Labels count when at least two numbers carry one, else numbers count in order.
    """
    s = F.regexp_replace(F.lower(F.trim(col(text))), ",", ".")
    scale = F.when(F.contains(s, F.lit("in")) & ~F.contains(s, F.lit("cm")), 2.54).otherwise(1.0)
    numbers, labels = (F.regexp_extract_all(s, F.lit(r"([0-9]+(?:\.[0-9]+)?)(?:\s*([whd]))?"), F.lit(group)) for group in (1, 2))
    labelled = F.size(F.array_remove(labels, "")) >= 2

    def last(label: str) -> Column:
        return F.get(F.reverse(numbers), (F.array_position(F.reverse(labels), label) - 1).cast("int"))

    return F.struct(*[(F.when(labelled, last(k)).otherwise(F.get(numbers, F.lit(i))).cast("double") * scale).alias(k) for i, k in enumerate("hwd")])


#: kinds of date mentions, most telling first: pattern, and the year from its first and second number
_YEAR_KINDS = (
    (r"(?:circa|c\.?)\s*[0-9]{4}", lambda a, b: a),
    (r"[0-9]{1,2}(?:st|nd|rd|th)\s+century", lambda a, b: a * 100 - 50),
    (r"[0-9]{4}\s*[-–]\s*[0-9]{4}", lambda a, b: F.floor((a + b) / 2).cast("int")),
    (r"[0-9]{4}", lambda a, b: F.when(a.between(1000, 2030), a)),
)


def parse_creation_year(text: str | Column) -> Column:
    """struct(year, approx) from a year, circa, century (its midpoint), range or any year inside.

    All mentions are taken in one pass; the most telling kind wins, then the first.
    """
    s = F.lower(F.trim(col(text)))
    mentions = F.regexp_extract_all(s, F.lit("|".join(pattern for pattern, _ in _YEAR_KINDS)), F.lit(0))

    def read(mention: Column, place: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(mention, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int"))
        a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        kind = year = None
        for i, (pattern, year_of) in enumerate(_YEAR_KINDS):
            is_kind = mention.rlike(f"^(?:{pattern})$")
            kind = F.when(is_kind, i) if kind is None else kind.when(is_kind, i)
            year = F.when(is_kind, year_of(a, b)) if year is None else year.when(is_kind, year_of(a, b))
        return F.struct(kind.alias("kind"), place.alias("place"), year.alias("year"))

    year = F.array_min(F.transform(mentions, read))["year"]
    plain = s.rlike("^[0-9]{4}$")
    year = F.when(plain, s.try_cast("int")).otherwise(year)
    return F.struct(year.alias("year"), (year.isNotNull() & ~plain).cast("int").alias("approx"))


def _amount(s: Column, units: Sequence[tuple[str, float]]) -> Column:
    """Value of the (number, word) whose word starts with the earliest listed unit, times the unit; ties go to the first."""
    found = F.regexp_extract_all(s, F.lit(r"[0-9.]+(?:\s*[a-z]+)?"), F.lit(0))

    def read(t: Column, place: Column) -> Column:
        word, rank, factor = F.coalesce(F.regexp_substr(t, F.lit("[a-z]+$")), F.lit("")), None, None
        for i, (unit, size) in enumerate(units):
            hit = F.startswith(word, F.lit(unit))
            rank, factor = (F.when(hit, i), F.when(hit, size)) if rank is None else (rank.when(hit, i), factor.when(hit, size))
        return F.struct(rank.alias("rank"), place.alias("place"), (F.regexp_substr(t, F.lit("^[0-9.]+")).try_cast("double") * factor).alias("value"))

    return F.array_min(F.filter(F.transform(found, read), lambda x: x["rank"].isNotNull()))["value"]


def parse_price_idr(text: str | Column) -> Column:
    """Rupiah amount: "Rp 2,5 Miliar" = 2.5e9, "Rp 500 Juta" = 5e8, else the plain number."""
    # thousands are set off by dots, decimals by a comma
    s = F.translate(F.regexp_replace(F.lower(col(text)), "rp", ""), ",.", ".")
    return _amount(s, [("miliar", 1e9), ("juta", 1e6), ("", 1.0)])


def parse_area_m2(text: str | Column) -> Column:
    """Square metres from m2, are (100 m2) or hectares."""
    return _amount(F.translate(F.lower(col(text)), ",", "."), [("m", 1.0), ("are", 100.0), ("ha", 10000.0), ("he", 10000.0)])


def parse_coordinate(text: str | Column) -> Column:
    """struct(lat, lng) of one signed coordinate such as "8.35 LS" or "115.50 BT"."""
    s = F.trim(col(text))
    value = F.abs(F.regexp_extract(s, r"^(-?[0-9.]+)\s+[A-Za-z]+$", 1).try_cast("double"))
    way = F.upper(F.regexp_extract(s, r"^-?[0-9.]+\s+([A-Za-z]+)$", 1))
    lat = F.when(way.isin("LS", "S"), -value).when(way.isin("LU", "N"), value)
    lng = F.when(way.isin("BB", "W"), -value).when(way.isin("BT", "E"), value)
    return F.struct(F.coalesce(lat, F.lit(0.0)).alias("lat"), F.coalesce(lng, F.lit(0.0)).alias("lng"))


def search_terms(question: str | Column, longest: int = 60) -> Column:
    """Question without its leading verb and question mark, cut at a word border."""
    q = F.regexp_replace(col(question), r"(?i)^(will|does|is|has|can|should|would)\s+", "")
    q = F.trim(F.regexp_replace(q, r"\?+$", ""))
    cut = F.regexp_replace(F.substring(q, 1, longest), r" [^ ]*$", "")
    return F.when(F.length(q) > longest, cut).otherwise(q)


def first_keyword(text: str | Column, keywords: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first keyword (in list order) that the text contains."""
    t = F.lower(col(text))
    out = None
    for word, value in keywords:
        hit = F.contains(t, F.lit(word))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))
