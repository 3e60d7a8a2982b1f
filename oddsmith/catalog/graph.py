"""Graph and place queries."""

from pyspark.sql import functions as F

from oddsmith.catalog.registry import add
from oddsmith.catalog.signals import COMPOSITE_SQL, composite
from oddsmith.operators import graph as G
from oddsmith.operators.bars import ohlcv_bars
from oddsmith.plans import similarity as M

DAY = 86400


def top(t):
    live = t.markets.join(t.trades.select("condition_id").distinct(), "condition_id", "left_semi")
    return M.most_traded(live, 500)


def similar(t):
    bars = ohlcv_bars(t.trades.where("outcome = 'Yes'"), DAY).select("condition_id", "bar_time", "close")
    return M.market_similarity(top(t), t.holders, bars, composite(t), min_common=10)


SIM_SQL = f"""WITH comp AS ({COMPOSITE_SQL}), tp AS (SELECT condition_id, event_slug, category FROM markets WHERE active = 1 AND closed = 0
  AND condition_id IN (SELECT condition_id FROM trades) ORDER BY volume_24h DESC, condition_id LIMIT 500),
pr AS (SELECT x.condition_id AS a, y.condition_id AS b, CASE WHEN x.event_slug = y.event_slug THEN 1e0 ELSE 0e0 END AS event, CASE WHEN x.category = y.category THEN 1e0 ELSE 0e0 END AS category
  FROM tp x JOIN tp y ON x.condition_id < y.condition_id),
wh AS (SELECT condition_id, wallet FROM holders WHERE condition_id IN (SELECT condition_id FROM tp) QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY amount DESC, wallet) <= 20),
wn AS (SELECT condition_id, count(*) AS n FROM wh GROUP BY 1),
wc AS (SELECT x.condition_id AS a, y.condition_id AS b, count(*) AS c FROM wh x JOIN wh y ON x.wallet = y.wallet AND x.condition_id < y.condition_id GROUP BY ALL),
br AS (SELECT condition_id, CAST(ts AS DATE) AS d, arg_max(price, ROW(ts, trade_id)) AS close FROM trades WHERE outcome = 'Yes' AND condition_id IN (SELECT condition_id FROM tp) GROUP BY ALL),
rt AS (SELECT * FROM (SELECT condition_id, d, ln(close / lag(close) OVER (PARTITION BY condition_id ORDER BY d)) AS r FROM br) WHERE r IS NOT NULL),
cr AS (SELECT x.condition_id AS a, y.condition_id AS b, abs(corr(x.r, y.r)) AS c FROM rt x JOIN rt y ON x.d = y.d AND x.condition_id < y.condition_id GROUP BY ALL
  HAVING count(*) >= 10 AND stddev_pop(x.r) > 1e-10 AND stddev_pop(y.r) > 1e-10),
vc AS (SELECT condition_id, [obi, volume, trade_bias, momentum, smart_money, concentration, arbitrage, insider]::DOUBLE[] AS v FROM comp),
sc AS (SELECT pr.a, pr.b, event, coalesce(wc.c::DOUBLE / (na.n + nb.n - wc.c), 0) AS whale, coalesce(cr.c, 0) AS correlation,
  coalesce((list_dot_product(va.v, vb.v) / (sqrt(list_dot_product(va.v, va.v)) * sqrt(list_dot_product(vb.v, vb.v))) + 1) / 2, 0) AS signal, category FROM pr
  LEFT JOIN wc USING (a, b) LEFT JOIN wn na ON na.condition_id = a LEFT JOIN wn nb ON nb.condition_id = b LEFT JOIN cr USING (a, b)
  LEFT JOIN vc va ON va.condition_id = a LEFT JOIN vc vb ON vb.condition_id = b)
SELECT *, 3e-1 * event + 2e-1 * whale + 25e-2 * correlation + 15e-2 * signal + 1e-1 * category AS similarity FROM sc
WHERE 3e-1 * event + 2e-1 * whale + 25e-2 * correlation + 15e-2 * signal + 1e-1 * category >= 15e-2"""
add("market_similarity", similar, SIM_SQL, "event whale correlation signal category similarity")
add("normalized_adjacency", lambda t: G.normalized_adjacency(t.edges), """
WITH f AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), g AS (SELECT * FROM f UNION ALL SELECT DISTINCT src, src, 1e0 FROM f),
d AS (SELECT src, sum(weight) AS d FROM g GROUP BY 1) SELECT g.src, g.dst, weight / sqrt(x.d * y.d) AS weight FROM g JOIN d x ON x.src = g.src JOIN d y ON y.src = g.dst""", "weight")


def near_edges(t):
    """Zone edges of close balances, so that the graph has open wedges."""
    return t.edges.where("weight > 0.35")


add("graph_metrics", lambda t: M.graph_metrics(near_edges(t)), """
WITH e AS (SELECT src, dst, weight FROM edges WHERE weight > 35e-2), f AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
d AS (SELECT src AS node, count(DISTINCT dst) AS d FROM f GROUP BY 1),
tr AS (SELECT x.src AS node, count(*) AS t FROM f x JOIN f y ON x.src = y.src AND x.dst < y.dst JOIN f z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1),
c AS (SELECT avg(2e0 * coalesce(t, 0) / (d * (d - 1))) AS clustering FROM d LEFT JOIN tr USING (node) WHERE d >= 2)
SELECT (SELECT count(*) FROM d) AS nodes, (SELECT avg(d) FROM d) AS avg_degree, (SELECT count(*) FROM e) AS edges, (SELECT min(weight) FROM e) AS min_weight, (SELECT max(weight) FROM e) AS max_weight,
  (SELECT median(weight) FROM e) AS median_weight, (SELECT coalesce(clustering, 0) FROM c) AS clustering, CASE WHEN (SELECT count(*) FROM d) > 1 THEN 2e0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM d) * ((SELECT count(*) FROM d) - 1)) ELSE 0 END AS density""",
    "avg_degree min_weight max_weight median_weight clustering density")


def centres(t):
    return t.points.where("point_id % 5 = 0").select(F.col("point_id").alias("centre_id"), "lat", "lng")


def spots(t):
    return t.points.select("point_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.concat(F.lit("type"), (F.col("point_id") % 3).cast("string")).alias("amenity"))


KM_SQL = "2 * 6371e0 * asin(least(1, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lng - a.lng) / 2) ** 2)))"
RADIUS_SQL = f"SELECT a.point_id AS centre_id, b.point_id, {KM_SQL} AS km FROM points a JOIN points b ON a.point_id % 5 = 0 AND {KM_SQL} <= 25"
add("radius_join", lambda t: G.radius_join(centres(t), spots(t), 25.0).select("centre_id", "point_id", "km"), RADIUS_SQL, "km")
add("amenity_density", lambda t: G.radius_join(centres(t), spots(t), 25.0).groupBy("centre_id").agg(
    *[F.count_if(F.col("amenity") == f"type{i}").alias(f"type{i}") for i in range(3)]), f"""
SELECT centre_id, count_if(point_id % 3 = 0) AS type0, count_if(point_id % 3 = 1) AS type1, count_if(point_id % 3 = 2) AS type2 FROM ({RADIUS_SQL}) GROUP BY 1""")


def typed_edges(t):
    zones = near_edges(t).withColumn("risk_type", F.when((F.col("src") + F.col("dst")) % 3 == 0, "quake").otherwise("flood"))
    return zones.unionByName(t.roads.withColumn("risk_type", F.lit("")))


add("risk_propagation", lambda t: M.risk_propagation(typed_edges(t), t.supplier.where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("origin")), "flood"), """
WITH RECURSIVE st AS (SELECT src, dst, 1 AS k FROM edges WHERE weight > 35e-2 AND (src + dst) % 3 <> 0 UNION ALL SELECT dst, src, 1 FROM edges WHERE weight > 35e-2 AND (src + dst) % 3 <> 0
  UNION ALL SELECT src, dst, 2 FROM roads UNION ALL SELECT dst, src, 2 FROM roads),
w AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS k FROM supplier WHERE s_suppkey % 10 = 3
  UNION SELECT origin, st.dst, w.k + st.k FROM w JOIN st ON st.src = w.node WHERE 7e-1 ** (w.k + st.k) >= 5e-2)
SELECT origin, node, 7e-1 ** min(k) AS intensity FROM w GROUP BY ALL""", "intensity")
add("connected_groups", lambda t: G.connected_components(near_edges(t)), """
WITH RECURSIVE f AS (SELECT src, dst FROM edges WHERE weight > 35e-2 UNION SELECT dst, src FROM edges WHERE weight > 35e-2),
r AS (SELECT src AS node, src AS other FROM f UNION SELECT r.node, f.dst FROM r JOIN f ON f.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1""")
add("shortest_path_cost", lambda t: G.shortest_paths(G.both_ways(t.roads), t.supplier.where("s_suppkey % 25 = 2").select(F.col("s_suppkey").alias("origin"))), """
WITH RECURSIVE f AS (SELECT src, dst, CAST(weight AS INTEGER) AS w FROM roads UNION ALL SELECT dst, src, CAST(weight AS INTEGER) FROM roads),
p AS (SELECT s_suppkey AS origin, s_suppkey AS node, 0 AS c FROM supplier WHERE s_suppkey % 25 = 2 UNION SELECT origin, f.dst, c + w FROM p JOIN f ON f.src = p.node WHERE c + w <= 120)
SELECT origin, node, CAST(min(c) AS DOUBLE) AS cost FROM p GROUP BY ALL""", "cost")


def hazard_zones(t):
    s = F.col("s_suppkey")
    return t.supplier.select(
        s.alias("zone_id"), F.element_at(F.array(*[F.lit(x) for x in ("low", "moderate", "high", "very_high")]), (s % 4 + 1).cast("int")).alias("severity"),
        F.array((s * 3) % 50, (s * 7) % 50 + 50).alias("members"))


def places(t):
    return t.supplier.select(F.col("s_suppkey").alias("district"))


HAZARD_SQL = """SELECT s_suppkey AS district, coalesce({agg}(p), 0) AS hazard, count(p) AS zones FROM supplier LEFT JOIN
  (SELECT CASE s_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 70 ELSE 90 END AS p, unnest([(s_suppkey * 3) % 50, (s_suppkey * 7) % 50 + 50]) AS m FROM supplier) ON m = s_suppkey GROUP BY 1"""
add("zone_hazard_max", lambda t: M.zone_hazard(places(t), hazard_zones(t)), HAZARD_SQL.format(agg="max"), "hazard")
add("zone_hazard_sum", lambda t: M.zone_hazard(places(t), hazard_zones(t), "sum"), HAZARD_SQL.format(agg="sum"), "hazard")


def factors(t):
    s = F.col("s_suppkey")
    return t.supplier.select(s.alias("district"), *[(s * k % 101).cast("double").alias(n) for n, k in (("flood", 13), ("quake", 29), ("permit", 37), ("office", 53))],
                             F.abs("s_acctbal").alias("price"))


RISK_PARTS = {"environmental": {"flood": 0.6, "quake": 0.4}, "legal": {"permit": 1.0}, "administrative": {"office": 0.7, "permit": 0.3}}
RISK_WEIGHTS = {"environmental": 0.45, "legal": 0.3, "administrative": 0.25}
add("risk_composite", lambda t: M.risk_composite(factors(t), RISK_PARTS, RISK_WEIGHTS), """
WITH f AS (SELECT s_suppkey AS district, CAST(s_suppkey * 13 % 101 AS DOUBLE) AS flood, CAST(s_suppkey * 29 % 101 AS DOUBLE) AS quake, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS permit,
  CAST(s_suppkey * 53 % 101 AS DOUBLE) AS office, abs(s_acctbal) AS price FROM supplier),
p AS (SELECT *, 6e-1 * flood + 4e-1 * quake AS environmental, permit AS legal, 7e-1 * office + 3e-1 * permit AS administrative FROM f),
c AS (SELECT *, 45e-2 * environmental + 3e-1 * legal + 25e-2 * administrative AS composite FROM p)
SELECT *, CASE WHEN composite < 25 THEN 'A' WHEN composite < 40 THEN 'B' WHEN composite < 55 THEN 'C' WHEN composite < 70 THEN 'D' ELSE 'F' END AS grade,
  6e-1 * composite + 4e-1 * least(100, price / 70) AS value_score FROM c""", "flood quake permit office price environmental legal administrative composite value_score")
add("investment_hotspots", lambda t: M.hotspots(M.risk_composite(factors(t), RISK_PARTS, RISK_WEIGHTS), 50.0, 2000.0).select("district", "composite"), """
SELECT district, composite FROM (SELECT s_suppkey AS district, abs(s_acctbal) AS price, 45e-2 * (6e-1 * (s_suppkey * 13 % 101) + 4e-1 * (s_suppkey * 29 % 101)) + 3e-1 * (s_suppkey * 37 % 101)
  + 25e-2 * (7e-1 * (s_suppkey * 53 % 101) + 3e-1 * (s_suppkey * 37 % 101)) AS composite FROM supplier) WHERE price >= 2000 AND composite <= 50""", "composite")
add("two_state_posterior", lambda t: factors(t).select("district", M.two_state_posterior(F.col("flood") / 101, F.col("quake") / 101, F.col("permit") / 101).alias("posterior")), """
SELECT s_suppkey AS district, p * a / nullif(p * a + (1 - p) * b, 0) AS posterior FROM (SELECT s_suppkey, (s_suppkey * 13 % 101) / 101e0 AS p, (s_suppkey * 29 % 101) / 101e0 AS a,
  (s_suppkey * 37 % 101) / 101e0 AS b FROM supplier)""", "posterior")
