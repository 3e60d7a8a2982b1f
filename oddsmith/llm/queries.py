"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import audit, decontaminate, disclosure, extract, infill, langid, lm, minhash, mixing, paragraphs, quality, repeats, tokens
from oddsmith.session import prepare


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_odd_sketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op2_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Target: documents labelled good and not toxic; background: all documents."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    good = _table(spark, folder, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    scored = lm.cross_entropy_difference(docs, good, docs)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS good
  FROM documents),
t AS (SELECT doc_id, good, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
n AS (SELECT CAST(count(*) FILTER (good) AS DOUBLE) AS nt, CAST(count(*) AS DOUBLE) AS nb FROM t),
g AS (SELECT doc_id, pos, good, word AS w, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), ' border') AS b FROM t),
u AS (SELECT w, count(*) FILTER (good) AS ct, count(*) AS cb FROM g GROUP BY w),
size AS (SELECT (SELECT count(*) FROM u) + 1 AS words),
c AS (SELECT b, count(*) FILTER (good) AS ct, count(*) AS cb FROM g GROUP BY b),
p AS (SELECT b, w, count(*) FILTER (good) AS ct, count(*) AS cb FROM g GROUP BY b, w),
l AS (
  SELECT g.doc_id, g.pos,
    -ln((p.ct + 100 * ((u.ct + 1) / (n.nt + size.words))) / (c.ct + 100)) AS lt,
    -ln((p.cb + 100 * ((u.cb + 1) / (n.nb + size.words))) / (c.cb + 100)) AS lb
  FROM g JOIN u ON g.w = u.w JOIN c ON g.b = c.b JOIN p ON p.b = g.b AND p.w = g.w, n, size),
s AS (SELECT doc_id, count(*) AS n_tokens, sum(lt) / count(*) AS loss_target, sum(lb) / count(*) AS loss_background FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n_tokens, 0) AS BIGINT) AS n_tokens, round(loss_target, 6) AS loss_target, round(loss_background, 6) AS loss_background,
       round(loss_target - loss_background, 6) AS score
FROM d LEFT JOIN s USING (doc_id)
"""


def op3_disclosure_terms(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.personal_data(_table(spark, folder, "documents"))


def op4_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_lookup_table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.fingerprints(_table(spark, folder, "documents"))


def op6_edit_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_induced_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, folder, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS bytes FROM documents),
n AS (SELECT doc_id, bytes, length(bytes) // 2 AS size FROM d),
w AS (SELECT doc_id, pos, md5(substr(bytes, 2 * pos + 1, 200)) AS part FROM (SELECT doc_id, bytes, unnest(range(size - 99)) AS pos FROM n WHERE size >= 100)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY part ORDER BY doc_id, pos) AS place FROM w) WHERE place > 1),
g AS (SELECT doc_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), pos - 1000) AS gap FROM r),
s AS (SELECT doc_id, pos, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM g),
i AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS b FROM s GROUP BY doc_id, span),
e AS (SELECT i.doc_id, i.span, i.a, i.b, coalesce(lag(i.b) OVER (PARTITION BY i.doc_id ORDER BY i.a), 0) AS before FROM i),
k AS (
  SELECT e.doc_id, string_agg(substr(n.bytes, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM e JOIN n USING (doc_id) GROUP BY e.doc_id)
SELECT n.doc_id, CAST(n.size AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.head, '') || substr(n.bytes, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""


def op8_bit_plane_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.tokenize(spark, _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, source_size * 2e0 AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
c AS (SELECT coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1), CAST('inf' AS DOUBLE)) AS common),
t AS (
  SELECT source, source_size, CASE WHEN cap = 0 THEN 0e0 ELSE least(cap, common * weight) END AS target FROM l, c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (SELECT *, target - whole * source_size AS rest FROM r),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
k AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS run FROM g),
e AS (
  SELECT k.source, min(k.h) AS h, arg_min(k.run - k.words, k.h) AS below, arg_min(k.words, k.h) AS words
  FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source WHERE k.run > u.rest GROUP BY k.source),
f AS (
  SELECT u.*, CASE WHEN e.h IS NULL THEN -1 WHEN e.below + e.words - u.rest < u.rest - e.below THEN e.h ELSE e.h - 1 END AS threshold
  FROM u LEFT JOIN e ON u.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, f.source_size, round(f.target, 6) AS target,
       CAST(d.size * (f.whole + CASE WHEN d.h <= f.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""


def op11_capture_infill(spark: SparkSession, folder: str) -> DataFrame:
    found = infill.with_restored(infill.fill_in_middle(_table(spark, folder, "documents")))
    digests = (F.sha2(c, 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op12_diagram_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT t.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM t LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS v),
o AS (
  SELECT [a.v, b.v, c.v, d.v, e.v] AS vs FROM f a, f b, f c, f d, f e
  WHERE a.v NOT IN (b.v, c.v, d.v, e.v) AND b.v NOT IN (c.v, d.v, e.v) AND c.v NOT IN (d.v, e.v) AND d.v <> e.v),
s AS (SELECT vs, unnest(range(1, 6)) AS step FROM o),
e AS (SELECT c.*, s.*, fails[vs[step]] AND NOT ((step > 1 AND fails[vs[1]]) OR (step > 2 AND fails[vs[2]]) OR (step > 3 AND fails[vs[3]]) OR (step > 4 AND fails[vs[4]])) AS gone FROM c, s),
r AS (
  SELECT part, vs, step, vs[step] AS v,
         coalesce(sum(n) FILTER (NOT (fails[vs[1]] OR (step > 1 AND fails[vs[2]]) OR (step > 2 AND fails[vs[3]]) OR (step > 3 AND fails[vs[4]]) OR (step > 4 AND fails[vs[5]]))), 0) AS kept,
         coalesce(sum(n) FILTER (gone), 0) AS removed, coalesce(sum(good) FILTER (gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone), 0) AS toxic_lost,
         coalesce(sum(n) FILTER (fails[vs[step]] AND NOT gone), 0) AS redundant,
         coalesce(sum(n) FILTER (fails[vs[step]] AND list_sum([CAST(x AS INTEGER) for x in fails]) = 1), 0) AS unique_fails
  FROM e GROUP BY part, vs, step)
SELECT part, array_to_string([substr('ABCDE', CAST(x AS INTEGER), 1) for x in vs], '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley
FROM r
"""


def op13_boosted_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(_table(spark, folder, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_odd_sketch_dedup": op1_odd_sketch_dedup,
        "op2_cross_entropy_difference": op2_cross_entropy_difference,
        "op3_disclosure_terms": op3_disclosure_terms,
        "op4_quality_discriminant": op4_quality_discriminant,
        "op5_lookup_table_fingerprint": op5_lookup_table_fingerprint,
        "op6_edit_decontamination": op6_edit_decontamination,
        "op7_induced_suffix_dedup": op7_induced_suffix_dedup,
        "op8_bit_plane_tokens": op8_bit_plane_tokens,
        "op9_source_mix": op9_source_mix,
        "op10_language": op10_language,
        "op11_capture_infill": op11_capture_infill,
        "op12_diagram_audit": op12_diagram_audit,
        "op13_boosted_extraction": op13_boosted_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_odd_sketch_dedup": OP1_SQL,
        "op2_cross_entropy_difference": OP2_SQL,
        "op7_induced_suffix_dedup": OP7_SQL,
        "op9_source_mix": OP9_SQL,
        "op11_capture_infill": OP11_SQL,
        "op12_diagram_audit": OP12_SQL,
    }
