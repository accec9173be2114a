import numpy as np
import pandas as pd

from barloom.operators import arma, forecast
from barloom.operators.layout import with_ordinal


def series(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, n)
    x = np.zeros(n)
    for t in range(2, n):
        x[t] = 0.0005 + 0.5 * x[t - 1] + e[t] + 0.4 * e[t - 1]
    return x


def panel(spark, x):
    close = 100 * np.exp(np.cumsum(x))
    return close, with_ordinal(spark.createDataFrame(pd.DataFrame({"symbol": "A", "time": pd.date_range("2000-01-01", periods=len(x)), "close": close})))


def plain(close, max_p, max_q, long_order, share):
    """The same two regressions by least squares on whole design matrices."""
    r = np.diff(np.log(close))
    cut = int(np.floor(len(close) * share))  # rows 1..cut are closes; returns belong to rows 2..cut
    train = r[: cut - 1]

    def fit(y, columns):
        d = np.column_stack([np.ones(len(y)), *columns]) if columns else np.ones((len(y), 1))
        beta = np.linalg.lstsq(d, y, rcond=None)[0]
        rss = ((y - d @ beta) ** 2).sum()
        return beta, len(y) * np.log(rss / len(y)) + 2 * (len(beta) + 1), rss

    fits = [fit(train[long_order:], [train[long_order - k : len(train) - k] for k in range(1, p + 1)]) for p in range(long_order + 1)]
    beta = min(fits, key=lambda f: f[1])[0]
    shock = np.full(len(r), np.nan)
    for t in range(long_order, len(r)):
        shock[t] = r[t] - beta[0] - sum(b * r[t - k] for k, b in enumerate(beta[1:], 1))
    at = long_order + max_q
    best = None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            cols = [train[at - k : len(train) - k] for k in range(1, p + 1)] + [shock[at - k : len(train) - k] for k in range(1, q + 1)]
            f = fit(train[at:], cols)
            if best is None or f[1] < best[1][1] - 1e-9:
                best = ((p, q), f)
    return r, cut, beta, shock, best


def test_two_stage_fit_path_and_residuals_equal_plain_regressions(spark, monkeypatch):
    monkeypatch.setattr(arma, "PIECE", 37)  # the path starts anew from a power of the companion matrix
    close, rows = panel(spark, series())
    max_p, max_q, long_order = 3, 2, 8
    fits = arma.two_stage(rows, max_p, max_q, long_order)
    got = fits.first()
    r, cut, long, shock, ((p, q), (beta, aic, rss)) = plain(close, max_p, max_q, long_order, 0.8)
    assert (got["p"], got["q"]) == (p, q) and p + q > 0
    np.testing.assert_allclose([got["const"], *got["ar"], *got["ma"]], beta, rtol=1e-5, atol=1e-8)
    np.testing.assert_allclose(got["long"], long[1:], rtol=1e-6, atol=1e-9)
    assert abs(got["aic"] - aic) < 1e-4
    path = arma.forecast_paths(rows, fits, max_p, max_q, long_order).toPandas().sort_values("step")
    xs, es, want, total = list(r[: cut - 1]), list(shock[: cut - 1]), [], 0.0
    prices = []
    for _ in range(len(close) - cut):
        y = beta[0] + sum(b * xs[-k] for k, b in enumerate(beta[1 : p + 1], 1)) + sum(b * es[-k] for k, b in enumerate(beta[p + 1 :], 1))
        xs.append(y)
        es.append(0.0)
        total += y
        want.append(y)
        prices.append(close[cut - 1] * np.exp(total))
    np.testing.assert_allclose(path["y_pred"], want, rtol=1e-6, atol=1e-10)
    np.testing.assert_allclose(path["price_pred"], prices, rtol=1e-8)
    np.testing.assert_allclose(path["price"], close[cut:])
    white = arma.residual_white_noise(rows, fits, max_p, max_q, long_order).first()
    at = long_order + max_q
    e = np.array([r[t] - beta[0] - sum(b * r[t - k] for k, b in enumerate(beta[1 : p + 1], 1)) - sum(b * shock[t - k] for k, b in enumerate(beta[p + 1 :], 1)) for t in range(at, cut - 1)])
    d = e - e.mean()
    stat = len(e) * (len(e) + 2) * sum(((d[k:] * d[:-k]).sum() / (d * d).sum()) ** 2 / (len(e) - k) for k in range(1, 11))
    assert white["n"] == len(e) and abs(white["q_stat"] - stat) < 1e-6


def test_residuals_are_white_where_returns_are_not(spark):
    _, rows = panel(spark, series(seed=8))
    raw = arma.as_arma(forecast.autoregression(rows, 0))
    fitted = arma.two_stage(rows, 3, 2, 10)
    assert arma.residual_white_noise(rows, raw, 0).first()["white"] == 0
    assert arma.residual_white_noise(rows, fitted, 3, 2, 10).first()["white"] == 1
