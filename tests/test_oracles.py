"""Spark results against SQL on the smallest tables. ``BARLOOM_ALL=1`` runs every query."""

import os

import pytest

from barloom.plans.registry import all_queries
from tools_check import canonical, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = """bars_weekly bars_hourly_rollup bars_row_numbers bars_cleaned request_validation time_normalised null_report symbol_encoding
bars_time_chunks features_price_action features_macd features_rsi features_average_true_range features_moments forward_targets macro_features
panel_with_macro_asof macro_asof_clipped_start market_regimes_smoothed cross_sectional_ranks daily_rank_correlation chronological_split
walk_forward_roles purged_folds_embargo prediction_metrics strategy_performance_by_symbol feature_store_materialized online_features_live
registry_latest_version manifest_resolution option_max_pain option_top_strikes news_sentiment article_extraction chart_payload_bars
wallet_balances ledger_replay transfer_checks effective_quota monthly_quota_decisions rate_limit_windows result_reuse_hits watchlists
stream_hourly_bars stream_login_lockout stream_result_reuse decision_outcomes residual_white_noise""".split()

CHOSEN = [n for n, q in all_queries().items() if q.sql and (os.environ.get("BARLOOM_ALL") or n in QUICK)]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    q = all_queries()[name]
    got = canonical(q.run(spark, FOLDER).toPandas())
    assert got == canonical(con.execute(q.oracle()).fetchdf())


def test_entry_has_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
