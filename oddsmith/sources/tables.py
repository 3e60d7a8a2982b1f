"""Typed reads, partitioned writes with retention, reports and the coverage query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith import schemas
from oddsmith.functions.scalars import array_sum, first_or


def read_table(spark: SparkSession, root: str, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Read a stored table with its declared schema; a time range also prunes month folders."""
    schema = schemas.STORED[name]
    timed = schemas.RETENTION.get(name)
    if timed is None:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    at = timed[0]
    df = spark.read.schema(schema + ", p_month string").parquet(f"{root}/{name}")
    if since is not None:
        df = df.where((F.col("p_month") >= since[:7]) & (F.col(at) >= F.lit(since).cast("timestamp")))
    if until is not None:
        df = df.where((F.col("p_month") <= until[:7]) & (F.col(at) < F.lit(until).cast("timestamp")))
    return df.drop("p_month")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write into month folders.  Rows are not moved by month first, so a hot month is written by every task that has some of it."""
    timed = schemas.RETENTION.get(name)
    if timed is None:
        df.write.mode(mode).parquet(f"{root}/{name}")
        return
    out = df.withColumn("p_month", F.date_format(timed[0], "yyyy-MM"))
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("p_month").parquet(f"{root}/{name}")


def retain(df: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    """Rows still inside the retention time at ``as_of``."""
    return df.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def write_report(df: DataFrame, folder: str, kind: str = "csv") -> None:
    """Study output as csv, json or markdown; the number of files is left to Spark's own coalescing."""
    if kind == "markdown":
        markdown_rows(df).write.mode("overwrite").text(folder)
        return
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(folder) if kind == "csv" else writer.json(folder)


def markdown_head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)


def markdown_rows(df: DataFrame) -> DataFrame:
    """The rows of a report table as markdown lines, whatever their number."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    return df.select(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("value"))


def data_coverage(tables: Mapping[str, tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Rows, first and last time per table and key: ``{table: (frame, key columns, time column)}``."""
    out = None
    for name, (df, key, at) in tables.items():
        part = df.groupBy(F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key")).agg(
            F.count("*").alias("row_count"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts")
        ).select(F.lit(name).alias("table_name"), "key", "row_count", "first_ts", "last_ts")
        out = part if out is None else out.unionByName(part)
    return out


def with_book_columns(books: DataFrame) -> DataFrame:
    """Columns derived at write time from the level arrays."""
    return books.withColumns({
        "best_bid": first_or("bid_prices", 0.0),
        "best_ask": first_or("ask_prices", 0.0),
        "bid_depth": array_sum("bid_sizes"),
        "ask_depth": array_sum("ask_sizes"),
    }).withColumns({
        "spread": F.col("best_ask") - F.col("best_bid"),
        "mid": (F.col("best_bid") + F.col("best_ask")) / 2,
        "ts_date": F.to_date("snapshot_time"),
    })


def token_map(markets: DataFrame) -> DataFrame:
    """(token_id, condition_id, outcome): tokens and outcomes paired by position."""
    return markets.select("condition_id", "outcomes", F.posexplode("token_ids").alias("pos", "token_id")).select(
        "token_id", "condition_id", F.coalesce(F.try_element_at("outcomes", F.col("pos") + 1), F.lit("")).alias("outcome")
    )


def derive_mid_price(quotes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mid price of (token_id, bid, ask) quotes with market and outcome looked up ("" if unknown).

    The token map grows with the market list, so the choice between broadcast and
    shuffle is left to Spark's size estimates.
    """
    both = (F.col("bid") > 0) & (F.col("ask") > 0)
    price = F.when(both, (F.col("bid") + F.col("ask")) / 2).otherwise(F.greatest("bid", "ask"))
    found = tokens.select("token_id", F.col("condition_id").cast("string").alias("_c"), F.col("outcome").alias("_o"))
    rest = [c for c in quotes.columns if c not in ("condition_id", "outcome")]
    return quotes.select(*rest).join(found, "token_id", "left").select(
        *rest, F.coalesce("_c", F.lit("")).alias("condition_id"), F.coalesce("_o", F.lit("")).alias("outcome"), price.alias("price")
    )
