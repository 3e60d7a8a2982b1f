"""The logical tables, derived from the Parquet files of a data folder.

Each property is a lazy DataFrame; nothing is read until a query uses it, and column
pruning reaches the scan through the projection.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.session import prepare

AS_OF = "2024-01-31 00:00:00"
BUY_EVENTS = ["click", "purchase", "signup"]


def clip_price(x):
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), x))


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self.as_of = F.lit(AS_OF).cast("timestamp")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            return self.raw(name)
        raise AttributeError(name)

    @cached_property
    def trades(self) -> DataFrame:
        k = F.regexp_extract("props", r"[0-9]+", 0).cast("long")
        outcome = F.when(F.col("event_id") % 4 == 0, "No").otherwise("Yes")
        return (
            self.events.select(
                F.col("event_id").alias("trade_id"),
                "ts",
                F.col("user_id").alias("wallet"),
                k.alias("condition_id"),
                outcome.alias("outcome"),
                clip_price(F.col("value") / 150).alias("price"),
                (F.lit(10.0) * (1 + F.col("event_id") % 200)).alias("size"),
                F.when(F.col("event_type").isin(BUY_EVENTS), "buy").otherwise("sell").alias("side"),
            )
            .withColumn("token_id", 2 * F.col("condition_id") + F.when(F.col("outcome") == "No", 1).otherwise(0))
            .withColumn("usdc_size", F.col("price") * F.col("size"))
        )

    @cached_property
    def trades_big(self) -> DataFrame:
        return self.lineitem.select(
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("trade_id"),
            F.col("l_shipdate").alias("ts"),
            F.col("l_suppkey").alias("wallet"),
            F.col("l_partkey").alias("condition_id"),
            F.when(F.col("l_linestatus") == "F", "No").otherwise("Yes").alias("outcome"),
            clip_price(F.col("l_extendedprice") / 106000).alias("price"),
            F.col("l_quantity").alias("size"),
            F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell").alias("side"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        return self.trades.select(
            "token_id", "condition_id", "outcome", "ts", "trade_id", "price",
            (F.col("price") - 0.01).alias("bid"), (F.col("price") + 0.01).alias("ask"), F.col("size").alias("volume"),
        )

    @cached_property
    def markets(self) -> DataFrame:
        k = F.col("p_partkey")
        done = F.when(k % 3 == 0, 1).otherwise(0)
        yes = clip_price((F.col("p_retailprice") - 900) / 100)
        return self.part.select(
            k.alias("condition_id"),
            F.concat("p_type", F.lit(" O/U "), F.col("p_size").cast("string")).alias("question"),
            F.col("p_name").alias("description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("event_slug"),
            F.array("p_type", "p_brand").alias("tags"),
            F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
            F.array(yes, 1 - yes + (k % 7 - 3) * F.lit(0.01)).alias("outcome_prices"),
            F.array(2 * k, 2 * k + 1).alias("token_ids"),
            (1 - done).alias("active"),
            done.alias("closed"),
            done.alias("resolved"),
            F.when(done == 0, "").when(k % 2 == 0, "Yes").otherwise("No").alias("winning_outcome"),
            ((k * 7919) % 10007).cast("double").alias("volume_24h"),
            ((k * 104729) % 30011).cast("double").alias("volume_1wk"),
            ((k * 7919) % 10007 + (k * 104729) % 30011).cast("double").alias("volume_total"),
            ((k * 31) % 5003).cast("double").alias("liquidity"),
            (((k * 37) % 41 - 20) / 100).alias("one_day_price_change"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("start_date"),
            (self.as_of - F.make_dt_interval((k % 10).cast("int"))).alias("end_date"),
            F.col("p_size").cast("double").alias("strike"),
        )

    @cached_property
    def books(self) -> DataFrame:
        def depth(first):
            return F.transform(F.slice("embedding", first, 8), lambda x: F.abs(x.cast("double")) * 1000)

        def ladder(base, sign):
            return F.array(*[F.lit(round(base + sign * 0.01 * i, 2)) for i in range(8)])

        return self.embeddings.select(
            F.col("label").cast("long").alias("condition_id"),
            F.col("vec_id").alias("snapshot_id"),
            F.timestamp_micros(F.lit(1706572800000000) + F.col("vec_id") * 60000000).alias("snapshot_time"),
            ladder(0.50, -1).alias("bid_prices"),
            depth(1).alias("bid_sizes"),
            ladder(0.52, 1).alias("ask_prices"),
            depth(9).alias("ask_sizes"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        return self.trades.select(
            "wallet", "condition_id", "outcome", "price", "size", "usdc_size", "ts",
            F.upper("side").alias("side"), F.lit("TRADE").alias("activity_type"),
            F.col("token_id").alias("asset"), F.col("trade_id").alias("transaction_hash"),
        )

    @cached_property
    def position_versions(self) -> DataFrame:
        value = F.col("o_totalprice")
        pnl = ((F.col("o_orderkey") * 7919) % 2001 - 1000) * value / 2000
        return self.orders.select(
            (F.col("o_custkey") % 150).alias("wallet"),
            (F.col("o_orderkey") % 100).alias("condition_id"),
            F.when(F.col("o_orderstatus") == "F", "No").otherwise("Yes").alias("outcome"),
            (value / 1000).alias("size"),
            value.alias("initial_value"),
            pnl.alias("cash_pnl"),
            (value + pnl).alias("current_value"),
            F.col("o_orderdate").alias("version"),
            F.col("o_orderkey").alias("position_id"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        from oddsmith.operators.versions import latest_version

        return latest_version(self.position_versions, ["wallet", "condition_id", "outcome"], ["version", "position_id"])

    @cached_property
    def holders(self) -> DataFrame:
        return (
            self.lineitem.groupBy((F.col("l_partkey") % 100).alias("condition_id"), F.col("l_suppkey").alias("wallet"))
            .agg(F.sum("l_quantity").alias("amount"))
        )

    @cached_property
    def profiles(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("wallet"), F.col("c_name").alias("pseudonym"),
            (self.as_of - F.make_dt_interval((F.col("c_custkey") % 60).cast("int"))).alias("profile_created_at"),
        )

    @cached_property
    def rankings(self) -> DataFrame:
        from oddsmith.operators.ordered import with_row_number

        # rank over all wallets: split by balance so that no task orders the whole table
        ranked = with_row_number(
            self.customer.select(F.col("c_custkey").alias("wallet"), F.col("c_acctbal").alias("pnl"))
            .withColumn("down", -F.col("pnl")),
            [], ["down", "wallet"], F.floor(F.col("down") / 10), "rank",
        )
        return ranked.select(
            "wallet", "rank", "pnl", F.lit("OVERALL").alias("category"), F.lit("ALL").alias("period"), F.lit("PNL").alias("order_by"),
        )

    @cached_property
    def market_versions(self) -> DataFrame:
        return self.events.select("user_id", "event_type", "ts", "event_id", "value")

    @cached_property
    def articles(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("article_id"), F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("body"), "source", "lang",
            F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000).alias("published_at"),
            F.lit(0.5).alias("confidence"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        return self.labels.join(self.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
            "doc_id", ((F.col("doc_id") * 37 % 101) / 101).alias("p"), F.col("quality").alias("y"), "lang", "source", "n_chars", "toxic",
        )

    @cached_property
    def lots(self) -> DataFrame:
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("artist"), F.col("l_shipdate").alias("sale_date"), F.col("l_extendedprice").alias("price"),
            F.col("l_orderkey").alias("auction"), F.col("l_linenumber").alias("lot_number"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("lot_id"),
            "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_type", "p_size",
            "p_name", "p_retailprice",
        )

    @cached_property
    def fx(self) -> DataFrame:
        return (
            self.orders.groupBy(F.col("o_orderpriority").alias("currency"), F.col("o_orderdate").alias("rate_date"))
            .agg(F.min("o_orderkey").alias("k"))
            .select("currency", "rate_date", (1 + (F.col("k") % 100) / 100).alias("rate"))
        )

    @cached_property
    def edges(self) -> DataFrame:
        # a zone is dealt to 16 tasks: there are few zones, and far more edges than rows
        a = self.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("x"), F.pmod(F.hash("s_suppkey"), F.lit(16)).alias("d"))
        b = self.supplier.select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("y"), F.explode(F.array(*[F.lit(i) for i in range(16)])).alias("d"))
        return a.join(b.hint("merge"), ["n", "d"]).where("src < dst").select(
            "src", "dst", (F.lit(1.0) / (1 + F.abs(F.col("x") - F.col("y")) / 1000)).alias("weight"), F.lit("zone").alias("type"))

    @cached_property
    def roads(self) -> DataFrame:
        n = self.supplier.agg(F.count("*").alias("n"))
        s = F.col("s_suppkey")
        return (
            self.supplier.crossJoin(F.broadcast(n))
            .select(s.alias("src"), ((7 * s + 3) % F.col("n")).alias("dst"), (1.0 + s % 5).alias("weight"), F.lit("road").alias("type"))
            .where("src <> dst")
        )

    @cached_property
    def points(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.supplier.select(
            s.alias("point_id"), (F.lit(-8.4) + (s % 37) / 50).alias("lat"), (F.lit(115.0) + (s % 53) / 50).alias("lng"),
            F.col("s_nationkey").alias("zone"), F.col("s_acctbal").alias("value"),
        )
