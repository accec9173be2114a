import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features as ft


def frame(df):
    return df.orderBy("symbol", "time").toPandas()


@pytest.fixture(scope="module")
def panel(bars):
    return ft.panel_with_history(bars).cache()


@pytest.fixture(scope="module")
def everything(panel):
    return frame(ft.build_features(panel, ft.TECHNICAL))


def test_small_blocks_give_the_same_values(panel, everything):
    fam = ["exponential_averages", "directional_movement", "moments", "moving_averages", "cumulative_volume", "lags"]
    small = frame(ft.build_features(panel, fam, block_rows=1024))
    for c in small.columns:
        if c not in ("symbol", "time"):
            np.testing.assert_allclose(small[c].astype(float), everything[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_no_feature_sees_the_future(bars, everything):
    cut = pd.Timestamp("2021-03-01")
    past = frame(ft.build_features(ft.panel_with_history(bars.where(F.col("time") < F.lit(cut))), ft.TECHNICAL))
    want = everything[everything["time"] < cut].reset_index(drop=True)
    for c in want.columns:
        if c not in ("symbol", "time"):
            np.testing.assert_allclose(past[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_matches_pandas(everything):
    g = everything[everything["symbol"] == "HOT"].reset_index(drop=True)
    c, lr = g["close"], np.log(g["close"] / g["close"].shift(1))
    want = {
        "ema_50": c.ewm(span=50, adjust=False, min_periods=50).mean(),
        "sma_200": c.rolling(200).mean(),
        "volatility_20d": lr.rolling(20).std() * np.sqrt(252),
        "realized_skew_60": lr.rolling(60).skew(),
        "kurtosis_20": lr.rolling(20).kurt(),
        "autocorr_5": lr.rolling(20).corr(lr.shift(1)),
        "zscore_50": (c - c.rolling(50).mean()) / (c.rolling(50).std() + 1e-10),
    }
    for name, w in want.items():
        np.testing.assert_allclose(g[name].astype(float), w, rtol=1e-8, atol=1e-9, err_msg=name)


def test_flat_prices_and_no_volume(spark):
    n = 260
    pdf = pd.DataFrame({"symbol": "FLAT", "time": pd.date_range("2020-01-01", periods=n), "volume": 0.0})
    for c in ("open", "high", "low", "close"):
        pdf[c] = 50.0
    out = frame(ft.build_features(ft.panel_with_history(spark.createDataFrame(pdf)), ft.TECHNICAL))
    assert len(out) == n
    last = out.iloc[-1]
    assert last["close_to_ema_200"] == pytest.approx(0, abs=1e-12)
    assert last["rsi_14"] == 100.0 and last["ad_line"] == 0.0
    assert pd.isna(last["skewness_20"]) and pd.isna(last["stoch_k"]) and pd.isna(last["autocorr_5"])
    numbers = out.drop(columns=["symbol", "time"]).astype(float).to_numpy()
    assert not np.isinf(numbers).any()


def test_short_history_keeps_the_schema(everything):
    one = everything[everything["symbol"] == "ONE"].iloc[0]
    assert pd.isna(one["sma_200"]) and pd.isna(one["return_1d"]) and one["high_low_range"] > 0


def test_feature_column_rules():
    cols = ["symbol", "close", "sma_7", "close_to_sma_7", "atr_14", "atr_pct", "close_lag_1", "close_return_lag_1", "target_5", "vix_level"]
    assert ft.feature_columns(cols) == ["close_to_sma_7", "atr_pct", "close_return_lag_1", "vix_level"]
    assert "vix_level" not in ft.feature_columns(cols, macro=["vix_level"], include_macro=False)


def test_one_exchange_for_all_windows(spark, panel):
    df = ft.build_features(panel, ft.TECHNICAL, keep=["symbol", "time"])
    # the plan above the cached panel
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert "SinglePartition" not in plan and "NestedLoop" not in plan
