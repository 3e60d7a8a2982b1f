"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "ohlcv_1m", "ohlcv_1h", "ohlcv_1d_with_ties", "rollup_bars", "volume_daily", "align_ffill", "latest_version", "latest_position",
    "top_movers", "volume_leaders", "smart_money_positions", "position_concentration", "volume_anomalies", "technical_indicators", "category_breakdown",
    "price_impact", "minute_impact", "lookback_join", "fx_nearest", "star_union", "artist_history", "life_features", "structural_breaks", "bar_features",
    "composite_signals", "microstructure_snapshot", "kyle_lambda_ratio", "wash_trading", "wallet_trade_profile", "gini",
    "implied_probability_panel", "slice_metrics", "threshold_ladders", "bayesian_update", "transfer_entropy", "graph_metrics", "connected_groups",
    "article_analysis", "headline_sentiment", "lot_features", "equity_metrics",
    "wallet_clusters", "jaccard_pairs", "granger_matrix", "stream_ohlcv", "stream_latest_price",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from oddsmith.catalog import registry
    from oddsmith.catalog.all import load

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load()
    names = sys.argv[1:] or HEADLINES
    names = list(registry.ENTRIES) if names == ["all"] else names
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("oddsmith-bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("count(*)").collect()  # start up
    times = {}
    for name in names:
        start = time.time()
        registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if len(sys.argv) > 1:
            print(f"{name:34} {times[name]:8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
