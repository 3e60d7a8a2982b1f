"""SQL text of the logical tables for the DuckDB side of the comparison."""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "trades0": """SELECT event_id AS trade_id, ts, user_id AS wallet,
        CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS condition_id,
        CASE WHEN event_id % 4 = 0 THEN 'No' ELSE 'Yes' END AS outcome,
        least(99e-2, greatest(1e-2, value / 150)) AS price,
        CAST(10 * (1 + event_id % 200) AS DOUBLE) AS size,
        CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side
        FROM events""",
    "trades": """SELECT *, 2 * condition_id + CASE WHEN outcome = 'No' THEN 1 ELSE 0 END AS token_id,
        price * size AS usdc_size FROM trades0""",
    "trades_big": """SELECT ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS trade_id,
        l_shipdate AS ts, l_suppkey AS wallet, l_partkey AS condition_id,
        CASE WHEN l_linestatus = 'F' THEN 'No' ELSE 'Yes' END AS outcome,
        least(99e-2, greatest(1e-2, l_extendedprice / 106000)) AS price, l_quantity AS size,
        CASE WHEN l_returnflag = 'A' THEN 'buy' ELSE 'sell' END AS side FROM lineitem""",
    "prices": """SELECT token_id, condition_id, outcome, ts, trade_id, price, price - 1e-2 AS bid, price + 1e-2 AS ask,
        size AS volume FROM trades""",
    "markets0": """SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS done,
        least(99e-2, greatest(1e-2, (p_retailprice - 900) / 100)) AS yes FROM part""",
    "markets": """SELECT p_partkey AS condition_id, p_type || ' O/U ' || p_size AS question, p_name AS description,
        p_type AS category, p_brand AS event_slug, [p_type, p_brand] AS tags, ['Yes', 'No'] AS outcomes,
        [yes, 1 - yes + (p_partkey % 7 - 3) * 1e-2] AS outcome_prices, [2 * p_partkey, 2 * p_partkey + 1] AS token_ids,
        1 - done AS active, done AS closed, done AS resolved,
        CASE WHEN done = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS winning_outcome,
        CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS volume_24h,
        CAST((p_partkey * 104729) % 30011 AS DOUBLE) AS volume_1wk,
        CAST((p_partkey * 7919) % 10007 + (p_partkey * 104729) % 30011 AS DOUBLE) AS volume_total,
        CAST((p_partkey * 31) % 5003 AS DOUBLE) AS liquidity,
        CAST((p_partkey * 37) % 41 - 20 AS DOUBLE) / 100 AS one_day_price_change,
        TIMESTAMP '2024-01-01 00:00:00' AS start_date,
        TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(p_partkey % 10 AS INTEGER)) AS end_date,
        CAST(p_size AS DOUBLE) AS strike FROM markets0""",
    "books": """SELECT CAST(label AS BIGINT) AS condition_id, vec_id AS snapshot_id,
        TIMESTAMP '2024-01-30 00:00:00' + to_minutes(vec_id) AS snapshot_time,
        [50e-2, 49e-2, 48e-2, 47e-2, 46e-2, 45e-2, 44e-2, 43e-2] AS bid_prices,
        list_transform(embedding[1:8], lambda x: abs(CAST(x AS DOUBLE)) * 1000) AS bid_sizes,
        [52e-2, 53e-2, 54e-2, 55e-2, 56e-2, 57e-2, 58e-2, 59e-2] AS ask_prices,
        list_transform(embedding[9:16], lambda x: abs(CAST(x AS DOUBLE)) * 1000) AS ask_sizes FROM embeddings""",
    "activity": """SELECT wallet, condition_id, outcome, price, size, usdc_size, ts, upper(side) AS side,
        'TRADE' AS activity_type, token_id AS asset, trade_id AS transaction_hash FROM trades""",
    "position_versions": """SELECT o_custkey % 150 AS wallet, o_orderkey % 100 AS condition_id,
        CASE WHEN o_orderstatus = 'F' THEN 'No' ELSE 'Yes' END AS outcome, o_totalprice / 1000 AS size,
        o_totalprice AS initial_value, ((o_orderkey * 7919) % 2001 - 1000) * o_totalprice / 2000 AS cash_pnl,
        o_totalprice + ((o_orderkey * 7919) % 2001 - 1000) * o_totalprice / 2000 AS current_value,
        o_orderdate AS version, o_orderkey AS position_id FROM orders""",
    "positions": """SELECT * FROM position_versions QUALIFY row_number() OVER
        (PARTITION BY wallet, condition_id, outcome ORDER BY version DESC, position_id DESC) = 1""",
    "holders": """SELECT l_partkey % 100 AS condition_id, l_suppkey AS wallet, sum(l_quantity) AS amount
        FROM lineitem GROUP BY ALL""",
    "profiles": """SELECT c_custkey AS wallet, c_name AS pseudonym,
        TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(c_custkey % 60 AS INTEGER)) AS profile_created_at FROM customer""",
    "rankings": """SELECT c_custkey AS wallet, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank,
        c_acctbal AS pnl, 'OVERALL' AS category, 'ALL' AS period, 'PNL' AS order_by FROM customer""",
    "articles": """SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, text AS body, source, lang,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_at, 5e-1 AS confidence FROM documents""",
    "forecasts": """SELECT doc_id, CAST(doc_id * 37 % 101 AS DOUBLE) / 101 AS p, quality AS y, lang, source, n_chars, toxic
        FROM labels JOIN documents USING (doc_id)""",
    "lots": """SELECT p_brand AS artist, l_shipdate AS sale_date, l_extendedprice AS price, l_orderkey AS auction,
        l_linenumber AS lot_number, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lot_id,
        l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, p_type, p_size, p_name, p_retailprice
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx": """SELECT currency, rate_date, 1 + CAST(k % 100 AS DOUBLE) / 100 AS rate FROM (
        SELECT o_orderpriority AS currency, o_orderdate AS rate_date, min(o_orderkey) AS k FROM orders GROUP BY ALL)""",
    "edges": """SELECT a.s_suppkey AS src, b.s_suppkey AS dst, 1 / (1 + abs(a.s_acctbal - b.s_acctbal) / 1000) AS weight,
        'zone' AS type FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
    "roads": """SELECT s_suppkey AS src, (7 * s_suppkey + 3) % n AS dst, CAST(1 + s_suppkey % 5 AS DOUBLE) AS weight,
        'road' AS type FROM supplier, (SELECT count(*) AS n FROM supplier) WHERE s_suppkey <> (7 * s_suppkey + 3) % n""",
    "points": """SELECT s_suppkey AS point_id, -84e-1 + CAST(s_suppkey % 37 AS DOUBLE) / 50 AS lat,
        115 + CAST(s_suppkey % 53 AS DOUBLE) / 50 AS lng, s_nationkey AS zone, s_acctbal AS value FROM supplier""",
}

NEEDS = {
    "trades": ["trades0"],
    "prices": ["trades"],
    "activity": ["trades"],
    "markets": ["markets0"],
    "positions": ["position_versions"],
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it mentions, each after the ones it needs."""
    import re

    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in NEEDS.get(name, []):
            add(dep)
        done.append(name)

    words = set(re.findall(r"[a-z_0-9]+", sql))
    for name in VIEWS:
        if name in words:
            add(name)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in done]
    body = sql.strip()
    recursive = ""
    if body[:14].upper() == "WITH RECURSIVE":
        recursive, rest = "RECURSIVE ", body[14:]
    elif body[:4].upper() == "WITH":
        rest = body[4:]
    else:
        return f"WITH {', '.join(ctes)} {body}" if ctes else body
    return f"WITH {recursive}{', '.join([*ctes, rest.strip()])}"
