import numpy as np
import pandas as pd

from barloom.operators import folds, splits


def data(n_times=260, symbols=4, seed=2):
    rng = np.random.default_rng(seed)
    t = pd.date_range("2020-01-01", periods=n_times)
    pdf = pd.DataFrame([(s, x) for s in range(symbols) for x in t], columns=["symbol", "time"])
    f = rng.normal(size=(len(pdf), 3))
    pdf[["a", "b", "c"]] = f
    pdf["c"] = 5.0  # constant
    pdf["y"] = 0.1 + f[:, 0] * 0.5 - f[:, 1] * 0.2 + rng.normal(0, 0.1, len(pdf))
    pdf.loc[rng.random(len(pdf)) < 0.05, "y"] = None
    pdf.loc[rng.random(len(pdf)) < 0.02, "a"] = None
    return pdf


def separate(train, ridge):
    """Centred ridge on one fold's rows, features scaled by their spread."""
    d = train.dropna(subset=["y", "a", "b", "c"])
    x, y = d[["a", "b"]].to_numpy(), d["y"].to_numpy()
    mx, my, sd = x.mean(0), y.mean(), x.std(0)
    z = (x - mx) / sd
    w = np.linalg.solve(z.T @ z / len(z) + ridge * np.eye(2), z.T @ (y - my) / len(z)) / sd
    return len(d), my - mx @ w, w


def test_all_folds_equal_separate_fits(spark, monkeypatch):
    monkeypatch.setattr(folds, "CHUNK", 50)
    pdf = data()
    rows = spark.createDataFrame(pdf)
    axis = splits.time_axis(rows)
    number = {x: k for k, x in enumerate(sorted(pdf["time"].unique()))}
    pdf["t"] = pdf["time"].map(number)
    for plan in (splits.walk_forward_folds(axis, 100, 40, horizon=7), splits.purged_folds(axis, 5, 7, 0.05, expanding=False)):
        got = {r.fold: r for r in folds.fold_lines(rows, axis, plan, "y", ["a", "b", "c"], 0.05).collect()}
        forecasts = folds.fold_forecasts(rows, axis, plan, "y", ["a", "b", "c"], ["symbol", "time"], 0.05).toPandas().set_index(["fold", "symbol", "time"])["y_pred"]
        n = 0
        for f in plan.collect():
            train = pdf[pdf.t < f.train_end]
            if "resume" in f:
                train = pd.concat([train, pdf[(pdf.t >= f.resume) & (pdf.t < f.n)]])
            size, const, w = separate(train, 0.05)
            assert got[f.fold].n_train == size
            np.testing.assert_allclose(got[f.fold].slopes, [*w, 0], atol=1e-9)
            test = pdf[(pdf.t >= f.test_start) & (pdf.t < f.test_end)].dropna(subset=["a"])
            want = const + test[["a", "b"]].to_numpy() @ w
            np.testing.assert_allclose(forecasts.loc[[(f.fold, s, x) for s, x in zip(test["symbol"], test["time"], strict=True)]], want, atol=1e-9)
            n += len(test)
        assert n == len(forecasts) and len(got) > 2
