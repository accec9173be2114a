import math

import numpy as np
import pandas as pd

from barloom.operators import forecast, garch
from barloom.operators.layout import with_ordinal


def closes(n=900, seed=5):
    rng = np.random.default_rng(seed)
    h, x = 1.0, []
    e = 0.0
    for _ in range(n):
        h = 0.05 + 0.1 * e * e + 0.85 * h
        e = np.sqrt(h) * rng.standard_t(6) * np.sqrt(4 / 6)
        x.append(0.02 + 0.1 * (x[-1] if x else 0) + e)
    return 100 * np.exp(np.cumsum(x) / 100)


def errors_of(close, share=0.8):
    x = np.diff(np.log(close)) * 100
    x = x[: int(np.floor(len(close) * share)) - 1]
    phi, const = np.polyfit(x[:-1], x[1:], 1)
    return x[1:] - const - phi * x[:-1], x[1:], phi, const


def like_of(e, omega, alpha, beta, f):
    h, total, hs = (e * e).mean(), 0.0, []
    for t in range(len(e)):
        if t:
            h = omega + alpha * e[t - 1] ** 2 + beta * h
        total += math.lgamma((f + 1) / 2) - math.lgamma(f / 2) - 0.5 * math.log(math.pi * (f - 2) * h) - (f + 1) / 2 * math.log1p(e[t] ** 2 / ((f - 2) * h))
        hs.append(h)
    return total, np.array(hs)


def panel(spark, series):
    rows = [pd.DataFrame({"symbol": s, "time": pd.date_range("2000-01-01", periods=len(c)), "close": c}) for s, c in series.items()]
    return with_ordinal(spark.createDataFrame(pd.concat(rows)))


def test_likelihood_is_at_its_top_for_short_and_long_keys(spark):
    series = {"A": closes(), "B": closes(120, 9)}
    rows = panel(spark, series)
    one = garch.garch(rows, chunk_rows=4096).toPandas().set_index("symbol")
    many = garch.garch(rows, chunk_rows=61, fan=3).toPandas().set_index("symbol")
    for s, close in series.items():
        e, x, phi, const = errors_of(close)
        r = one.loc[s]
        assert r["n"] == len(e) and abs(r["phi"] - phi) < 1e-8 and abs(r["const"] - const) < 1e-8
        like, h = like_of(e, r["omega"], r["alpha"], r["beta"], r["freedom"])
        assert abs(like - r["loglik"]) < 1e-7 * abs(like)
        v = (e * e).mean()
        grid = max(like_of(e, v * (1 - a - b), a, b, f)[0] for a, b, f in garch.STARTS)
        assert r["loglik"] >= grid - 1e-9
        # no small step in any direction is better
        for k, name in enumerate(["omega", "alpha", "beta", "freedom"]):
            for step in (0.98, 1.02):
                p = [r["omega"], r["alpha"], r["beta"], r["freedom"]]
                p[k] *= step
                if p[1] + p[2] < garch.MOST and p[3] < 1e6:
                    assert like_of(e, *p)[0] <= like + 1e-3, name
        realised = pd.Series(np.diff(np.log(close)) * 100).rolling(5).std().to_numpy()[1 : len(e) + 1]
        ok = ~np.isnan(realised)
        if np.sqrt(h)[ok].std() > 1e-6:
            assert abs(np.corrcoef(np.sqrt(h)[ok], realised[ok])[0, 1] - r["vol_forecast_corr"]) < 1e-6
        assert abs(r["next_variance"] - (r["omega"] + r["alpha"] * e[-1] ** 2 + r["beta"] * h[-1])) < 1e-9
    # many chunks over several levels reach the same top
    assert abs(many.loc["A", "loglik"] - one.loc["A", "loglik"]) < 1e-3
    e = errors_of(series["A"])[0]
    m = many.loc["A"]
    assert abs(like_of(e, m["omega"], m["alpha"], m["beta"], m["freedom"])[0] - m["loglik"]) < 1e-7 * abs(m["loglik"])
    assert abs(m["vol_forecast_corr"] - one.loc["A", "vol_forecast_corr"]) < 1e-3


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, (1, 80))
    p = np.concatenate([[[0.0]], e[:, :-1] ** 2], 1)
    here, first, v = np.ones((1, 80), bool), np.ones(1, bool), np.array([(e * e).mean()])
    u = garch.free(np.array([0.1]), np.array([0.08]), np.array([0.8]), np.array([7.0]))

    def sums(u):
        nat, jac = garch.natural(u)
        return garch.scores(e, garch.variances(p, here, first, v, np.zeros((1, 4)), nat), here, nat, jac)[0]

    for k in range(4):
        step = np.zeros((1, 4))
        step[0, k] = 1e-5
        slope = (sums(u + step)[0] - sums(u - step)[0]) / 2e-5
        assert abs(sums(u)[1 + k] - slope) < 1e-5 * (1 + abs(slope))


def test_not_below_the_coarse_grid_of_the_gaussian_fit(spark):
    rows = panel(spark, {"A": closes(500, 3)})
    best = garch.garch(rows, train_share=1.0).first()
    grid = forecast.garch_grid(rows).first()
    assert best["aic"] < 2 * 6 - 2 * (grid["loglik"] - 499 * math.log(100)) + 1e-6
