import math

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from barloom.functions.numeric import magnitude_bucket
from barloom.operators import forecast as fc
from barloom.operators import metrics as mt
from barloom.operators import ranks, splits
from barloom.operators.layout import chunk_of, with_ordinal


def sample(n=600, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.8, "hot", "b"), "time": pd.date_range("2020-01-01", periods=n, freq="h"),
        "y_true": np.round(rng.normal(size=n), 2), "y_pred": np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(size=n), 1)),
    })
    return pdf


def test_bucket_is_monotone(spark):
    v = np.sort(np.concatenate([-np.logspace(-9, 9, 500), [0.0, 1 - 1e-16, 1.0, 2.0, 2 - 1e-15], np.logspace(-9, 9, 500)]))
    b = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", magnitude_bucket("v").alias("b")).orderBy("v").toPandas()
    assert (b["b"].diff().dropna() >= 0).all()


def test_ranks_and_quantiles(spark):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    got = ranks.rank_large_groups(df, ["g"], "y_pred", "r").toPandas().sort_values("time")
    want = pdf.groupby("g")["y_pred"].rank().to_numpy()
    np.testing.assert_allclose(got["r"], want)
    ic = ranks.rank_correlation(df, ["g"], "y_true", "y_pred").toPandas().set_index("g")["ic"]
    q = ranks.quantiles_large_groups(df, ["g"], "y_pred", {"a": 0.33, "b": 0.67}).toPandas().set_index("g")
    for g, p in pdf.groupby("g"):
        assert abs(ic[g] - p["y_true"].rank().corr(p["y_pred"].rank())) < 1e-12
        np.testing.assert_allclose(q.loc[g], np.percentile(p["y_pred"], [33, 67]))


def test_constant_forecast_has_no_correlation(spark):
    df = spark.createDataFrame(sample().assign(y_pred=0.0))
    assert ranks.rank_correlation(df, ["g"], "y_true", "y_pred").where("ic is not null").count() == 0


def test_equity_curve_with_total_losses(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.1, 300)
    r[[50, 180]] = [-1.4, -2.5]  # the curve turns negative and back
    pdf = pd.DataFrame({"k": "a", "time": pd.date_range("2020-01-01", periods=300), "r": r})
    out = mt.equity_scan(spark.createDataFrame(pdf), ["k"], ["time"], chunk_of("time", 20 * 86400), ["r"]).orderBy("time").toPandas()
    curve = np.cumprod(1 + r)
    np.testing.assert_allclose(out["curve_r"], curve, rtol=1e-9)
    np.testing.assert_allclose(out["peak_r"], np.maximum.accumulate(curve), rtol=1e-9)


def test_strategy_metrics(spark):
    pdf = sample()
    rows = mt.strategy_returns(spark.createDataFrame(pdf), ["g"], ["time"], chunk_of("time", 86400))
    got = mt.performance(rows, ["g"], ["time"], chunk_of("time", 86400), 5).toPandas().set_index("g")
    for g, p in pdf.groupby("g"):
        pos = (p["y_pred"] > 0).astype(float).to_numpy()
        turn = np.abs(np.diff(np.concatenate([[0], pos])))
        net = pos * p["y_true"].to_numpy() - turn * 0.001
        assert abs(got.loc[g, "sharpe"] - net.mean() / net.std() * np.sqrt(252 / 5)) < 1e-9
        assert abs(got.loc[g, "turnover"] - turn.mean()) < 1e-12
        down = net[net < 0]
        assert abs(got.loc[g, "sortino"] - net.mean() / down.std() * np.sqrt(252 / 5)) < 1e-9


def test_folds_keep_their_distance(spark):
    t = spark.createDataFrame(pd.DataFrame({"time": pd.date_range("2020-01-01", periods=400)}))
    axis = splits.time_axis(t)
    for folds, h in ((splits.walk_forward_folds(axis, 100, 40, horizon=7), 7), (splits.purged_folds(axis, 5, 7, 0.05, expanding=False), 7)):
        roles = splits.fold_roles(axis, folds).toPandas()
        for _, f in roles.groupby("fold"):
            test, train = f[f.role == "test"]["t"], f[f.role == "train"]["t"]
            assert not set(test) & set(train)
            before = train[train < test.min()]
            assert before.empty or test.min() - before.max() > h


def test_autoregression_order_and_coefficients(spark):
    rng = np.random.default_rng(11)
    x = np.zeros(3000)
    for i in range(2, len(x)):
        x[i] = 0.001 + 0.5 * x[i - 1] - 0.3 * x[i - 2] + rng.normal(0, 0.01)
    pdf = pd.DataFrame({"symbol": "A", "time": pd.date_range("2000-01-01", periods=len(x)), "close": 100 * np.exp(np.cumsum(x))})
    panel = with_ordinal(spark.createDataFrame(pdf))
    fit = fc.autoregression(panel, max_order=4, train_share=1.0).first()
    assert fit["p"] >= 2
    np.testing.assert_allclose(fit["coef"][:2], [0.5, -0.3], atol=0.06)
    lr = np.diff(np.log(pdf["close"]))
    p = fit["p"]
    design = np.column_stack([np.ones(len(lr) - 4)] + [lr[4 - k : len(lr) - k] for k in range(1, p + 1)])
    beta = np.linalg.lstsq(design, lr[4:], rcond=None)[0]
    np.testing.assert_allclose([fit["const"], *fit["coef"]], beta, rtol=1e-6, atol=1e-9)


def test_bootstrap_interval_covers_the_estimate(spark):
    pdf = sample(400).assign(row=range(400))
    pdf["y_pred"] = pdf["y_true"] + np.random.default_rng(1).normal(size=400)
    out = mt.bootstrap_rank_correlation(spark.createDataFrame(pdf), ["g"], "row", 30).toPandas().set_index("g")
    ic = pdf[pdf.g == "hot"]["y_true"].rank().corr(pdf[pdf.g == "hot"]["y_pred"].rank())
    assert out.loc["hot", "ic_low"] < ic < out.loc["hot", "ic_high"]
    assert out["n_replicas"].eq(30).all()


def test_bootstrap_keeps_replicas_in_vectors_and_equals_a_loop(spark):
    """Two groups with ties, a constant forecast and a row that comes twice; draws are those of the hash."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 60 + ["c"] * 50, "row": [f"r{i}" for i in range(609)] + ["r608"]})
    pdf["y_true"] = rng.normal(size=len(pdf)).round(1)
    pdf["y_pred"] = np.where(pdf.g == "c", 0.0, (pdf["y_true"] + rng.normal(size=len(pdf))).round(2))
    df = spark.createDataFrame(pdf)
    out = mt.bootstrap_rank_correlation(df, ["g"], "row", 25)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.toPandas().set_index("g")
    u = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("replica"))
    u = u.withColumn("u", F.shiftrightunsigned(F.xxhash64("g", "row", "replica"), 11) / float(1 << 53)).toPandas()
    steps = np.cumsum([np.exp(-1) / float(math.factorial(i)) for i in range(18)])
    u["k"] = np.searchsorted(steps, u["u"], side="right")
    copies = u.loc[u.index.repeat(u["k"])]
    for g, whole in copies.groupby("g"):
        ics = [d["y_true"].rank().corr(d["y_pred"].rank()) if d["y_pred"].nunique() > 1 else None for _, d in whole.groupby("replica")]
        ics = pd.Series(ics, dtype="float64").dropna()
        assert got.loc[g, "n_replicas"] == len(ics) == (0 if g == "c" else 25)
        if len(ics):
            want = [ics.mean(), ics.std(ddof=0), ics.quantile(0.05), ics.quantile(0.95)]
            np.testing.assert_allclose(got.loc[g, ["ic_mean", "ic_std", "ic_low", "ic_high"]].astype(float), want, rtol=1e-9)
