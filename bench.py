"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and fully evaluated (``noop`` sink) once after a short warm-up of the
session. Staged inputs (bars, panels) are timed as their own entries.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "bars_weekly", "bars_hourly_rollup", "bars_cleaned", "features_price_action", "features_exponential_averages",
    "features_directional_movement", "features_moments", "features_volume", "feature_panel_all", "forward_targets",
    "cross_sectional_ranks", "daily_rank_correlation", "macro_features", "panel_with_macro_asof", "signal_asof_hourly_close",
    "walk_forward_roles", "prediction_metrics", "strategy_performance_by_symbol", "walk_forward_summary",
    "feature_store_materialized", "option_max_pain", "option_top_strikes", "news_sentiment", "article_extraction",
    "ledger_replay", "wallet_balances", "monthly_quota_decisions", "rate_limit_windows", "garch_grid",
    "stream_hourly_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    from barloom.operators.features import TECHNICAL, build_features
    from barloom.plans.fixtures import Inputs
    from barloom.plans.registry import all_queries

    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        t0 = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - t0, 3)

    spark.range(1000).selectExpr("sum(id)").collect()
    inputs = Inputs(spark, folder)
    timed("stage_bars", inputs.bars)
    timed("stage_panel", inputs.panel)
    timed("stage_daily_panel", inputs.daily_panel)
    timed(
        "feature_panel_daily",
        lambda: build_features(inputs.daily_panel(), TECHNICAL).write.format("noop").mode("overwrite").save(),
    )
    known = all_queries()
    for name in HEADLINE:
        timed(name, lambda: known[name].run(spark, folder).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": folder}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
