"""Text queries.  The prose of the fixtures is invented, so the keyword tables are made of its frequent words."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.plans import news as N
from oddsmith.plans import serving as V

CONFIG = {
    "aliases": {"the rest": "rest_hill", "rest": "rest_town", "her": "her_bay", "then": "then_port", "ation": "ation_city", "les ": "les_ville", "der": "der_stadt"},
    "sentiment": {"and": 0.4, "of": -0.3, "not": -0.8, "est": 0.6, "ment": -0.5},
    "controls": {"these": ("UA_LOST", 0.7), "was": ("RU_ADVANCE", 0.6), "une": ("UA", 0.9)},
    "categories": {"front": ["the", "is", "on"], "trade": ["and", "of", "in", "que"], "talks": ["eau", "aux", "ou"]},
    "regions": {"north": ["rest_hill", "der_stadt"], "south": ["her_bay", "then_port"], "west": ["ation_city"]},
    "urgency": {"breaking": 0.9, "there": 0.7, "ing ": 0.4},
    "actors": {"army": ["sh", "tion"], "press": ["wh"], "guard": ["ieren", "ung"]},
}
POSITIVE, NEGATIVE = ["the", "and", "les", "und"], ["of", "in", "un", "der"]


def analyzed(t):
    return N.article_analysis(t.articles, CONFIG)


def q(text):
    return "'" + text.replace("'", "''") + "'"


def count_sql(w):
    return f"least((length(x) - length(replace(x, {q(w)}, ''))) // {len(w)}, 3)"


def hits_sql(ws):
    return " + ".join(f"contains(x, {q(w)})::INT" for w in ws)


ALIASES = sorted(CONFIG["aliases"], key=lambda a: (-len(a), a))
ENTITY_CASE = "CASE a " + " ".join(f"WHEN {q(a)} THEN {q(e)}" for a, e in CONFIG["aliases"].items()) + " END"
CATEGORY_SQL = "list_max([" + ", ".join(f"ROW({hits_sql(ws)}, {-i}, {q(c)})" for i, (c, ws) in enumerate(CONFIG["categories"].items())) + "])"
REGION_SQL = "CASE " + " ".join(f"WHEN list_has_any(entities, [{', '.join(map(q, m))}]) THEN {q(r)}" for r, m in CONFIG["regions"].items()) + " ELSE 'general' END"
BASE_SQL = f"""xa AS (SELECT *, lower(title || ' ' || body) AS x FROM articles),
xe AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(x, '({'|'.join(ALIASES)})'), lambda a: {ENTITY_CASE}))) AS entities FROM xa)"""
ANALYSIS_SQL = f"""WITH {BASE_SQL} SELECT article_id, array_to_string(entities, ',') AS entities,
  ({' + '.join(f'{s} * {count_sql(w)}' for w, s in CONFIG['sentiment'].items())})::DOUBLE / greatest({' + '.join(count_sql(w) for w in CONFIG['sentiment'])}, 1) AS sentiment,
  CASE WHEN ({CATEGORY_SQL})[1] > 0 THEN ({CATEGORY_SQL})[3] ELSE 'general' END AS category, {REGION_SQL} AS region,
  greatest(0, {', '.join(f'CASE WHEN contains(x, {q(w)}) THEN {s} ELSE 0 END' for w, s in CONFIG['urgency'].items())}) AS urgency,
  concat_ws(',', {', '.join(f'CASE WHEN {hits_sql(ws)} > 0 THEN {q(a)} END' for a, ws in CONFIG['actors'].items())}) AS actors FROM xe"""
add("article_analysis", lambda t: analyzed(t).select(
    "article_id", F.concat_ws(",", "entities").alias("entities"), "sentiment", "category", "region", "urgency", F.concat_ws(",", "actors").alias("actors")), ANALYSIS_SQL, "sentiment urgency")
WORDS = "list_distinct(regexp_extract_all(lower(body), '[a-z]+'))"
P_SQL, N_SQL = (f"len(list_intersect(w, [{', '.join(map(q, ws))}]))" for ws in (POSITIVE, NEGATIVE))


def headline(t):
    return t.articles.select("article_id", "source", "published_at", "confidence", N.word_set_sentiment(F.col("body"), POSITIVE, NEGATIVE).alias("sentiment"),
                             N.headline_urgency(F.col("body"), ("there", "urgent"), ("now", "und")).alias("urgency"))


HEADLINE_SQL = f"""SELECT article_id, source, published_at, confidence, CASE WHEN {P_SQL} + {N_SQL} > 0 THEN ({P_SQL} - {N_SQL})::DOUBLE / ({P_SQL} + {N_SQL}) ELSE 0 END AS sentiment,
  least(1, CASE WHEN contains(x, 'there') OR contains(x, 'urgent') THEN 5e-1 ELSE 0 END + CASE WHEN contains(x, 'now') OR contains(x, 'und') THEN 3e-1 ELSE 0 END + CASE WHEN contains(body, '!') THEN 2e-1 ELSE 0 END) AS urgency
  FROM (SELECT *, lower(body) AS x, {WORDS} AS w FROM articles)"""
add("headline_sentiment", headline, HEADLINE_SQL, "confidence sentiment urgency")
add("sentiment_hourly", lambda t: V.sentiment_hourly(headline(t), "source", "published_at"), f"""
SELECT source, date_trunc('hour', published_at) AS hour, count(*) AS article_count, avg(sentiment) AS avg_sentiment, max(urgency) AS max_urgency, count(DISTINCT source) AS source_diversity,
  sum(sentiment * confidence) / greatest(sum(confidence), 1e-9) AS weighted_sentiment, count(*)::DOUBLE AS news_velocity FROM ({HEADLINE_SQL}) GROUP BY ALL""",
    "avg_sentiment max_urgency weighted_sentiment news_velocity")
add("sentiment_rollup", lambda t: V.sentiment_rollup(V.sentiment_hourly(headline(t), "source", "published_at"), "source", 24 * 31, t.as_of), f"""
WITH h AS (SELECT source, date_trunc('hour', published_at) AS hour, count(*) AS c, avg(sentiment) AS s, max(urgency) AS u, sum(sentiment * confidence) / sum(confidence) AS w FROM ({HEADLINE_SQL}) GROUP BY ALL)
SELECT source, CAST(sum(c) AS BIGINT) AS total_articles, avg(s) AS mean_sentiment, max(u) AS peak_urgency, avg(w) AS weighted_sentiment, avg(c) AS avg_velocity FROM h GROUP BY 1""",
    "mean_sentiment peak_urgency weighted_sentiment avg_velocity")
add("article_dedup", lambda t: N.new_articles(
    t.articles.where("article_id % 3 <> 0").select(F.sha2("body", 256).alias("key"), "article_id", "published_at"),
    t.articles.where("article_id % 3 = 0").select(F.sha2("body", 256).alias("key"), "published_at"), "key", F.lit("2024-01-02 00:00:00").cast("timestamp")), """
SELECT sha256(body) AS key, article_id, published_at FROM articles WHERE article_id % 3 <> 0 AND sha256(body) NOT IN (SELECT sha256(body) FROM articles WHERE article_id % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY sha256(body) ORDER BY published_at, article_id) = 1""")


def entity_markets(t):
    names = sorted(set(CONFIG["aliases"].values()))
    return t.markets.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("condition_id") % len(names) + 1).cast("int")).alias("entity"), "condition_id")


NAMES_SQL = "[" + ", ".join(map(q, sorted(set(CONFIG["aliases"].values())))) + "]"
add("article_market_links", lambda t: N.link_markets(analyzed(t), entity_markets(t)), f"""
WITH {BASE_SQL}, mm AS (SELECT DISTINCT article_id, unnest(entities) AS entity FROM xe) SELECT DISTINCT article_id, condition_id FROM mm
JOIN (SELECT condition_id, ({NAMES_SQL})[condition_id % {len(set(CONFIG['aliases'].values()))} + 1] AS entity FROM markets) USING (entity)""")
SIGNALS = {"these": ("RU", 0.0, 0.0, 0.7), "was": ("CONTESTED", 0.5, 0.0, 0.6), "une": ("UA", 0.0, 50.0, 0.9)}
UPDATES_SQL = f"""{BASE_SQL}, up AS (SELECT article_id, unnest(entities) AS place, source, published_at, keyword, control, intensity, distance_km, confidence FROM
  (SELECT article_id, entities, source, published_at, x FROM xe), (VALUES {', '.join(f"('{k}', '{c}', {i}::DOUBLE, {d}::DOUBLE, {f}::DOUBLE)" for k, (c, i, d, f) in SIGNALS.items())}) v(keyword, control, intensity, distance_km, confidence)
  WHERE contains(x, keyword))"""
add("control_updates", lambda t: N.control_updates(analyzed(t)), f"WITH {UPDATES_SQL} SELECT * FROM up", "intensity distance_km confidence")
add("latest_control", lambda t: N.latest_control(N.control_updates(analyzed(t)), t.as_of, 31), f"""
WITH {UPDATES_SQL} SELECT place, arg_max(control, ROW(published_at, article_id, keyword)) AS control, arg_max(intensity, ROW(published_at, article_id, keyword)) AS intensity,
  arg_max(distance_km, ROW(published_at, article_id, keyword)) AS distance_km, arg_max(confidence, ROW(published_at, article_id, keyword)) AS confidence, max(published_at) AS last_seen FROM up GROUP BY 1""",
    "intensity distance_km confidence")
