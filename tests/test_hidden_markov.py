import numpy as np
import pandas as pd
import pytest

from barloom.operators import hidden_markov as hm


def panel(seed=3, n=(300, 41), features=2):
    rng = np.random.default_rng(seed)
    frames = []
    for symbol, size in zip("AB", n, strict=True):
        state, x = 0, []
        for _ in range(size):
            state = state if rng.random() < 0.9 else int(rng.integers(0, 3))
            x.append(rng.normal([0.0, 2.0, -2.0][state], [0.3, 1.0, 1.0][state], features))
        x = np.array(x)
        frames.append(pd.DataFrame({"symbol": symbol, "rn": np.arange(1, size + 1), "ret5": x[:, 0], "vol20": x[:, 1]}))
    return pd.concat(frames, ignore_index=True)


def densities(x, mean, cov):
    d = x - mean
    return np.exp(-0.5 * np.einsum("ti,ij,tj->t", d, np.linalg.inv(cov), d)) / np.sqrt((2 * np.pi) ** len(mean) * np.linalg.det(cov))


def by_loop(x, theta, k):
    """Posteriors, best path, log likelihood and expected moves by the plain recursions over one sequence."""
    f = x.shape[1]
    start, move = theta[:k], theta[k : k + k * k].reshape(k, k)
    mean, cov = theta[k + k * k : k + k * k + k * f].reshape(k, f), theta[k + k * k + k * f :].reshape(k, f, f)
    b = np.stack([densities(x, mean[s], cov[s]) for s in range(k)], 1)
    n = len(x)
    alpha, beta, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
        c[t] = a.sum()
        alpha[t] = a / c[t]
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (b[t + 1] * beta[t + 1]) / c[t + 1]
    gamma = alpha * beta
    pairs = sum(np.outer(alpha[t - 1], b[t] * beta[t]) * move / c[t] for t in range(1, n))
    d, back = np.log(start) + np.log(b[0]), []
    for t in range(1, n):
        s = d[:, None] + np.log(move)
        back.append(s.argmax(0))
        d = s.max(0) + np.log(b[t])
    path = [int(d.argmax())]
    for p in back[::-1]:
        path.append(int(p[path[-1]]))
    return gamma, path[::-1], np.log(c).sum(), pairs


def em(x, k, rounds):
    f = x.shape[1]
    theta = hm.initial(k, f, 0, 1)
    for _ in range(rounds):
        gamma, _, like, pairs = by_loop(x, theta, k)
        n = gamma.sum(0)
        mean = gamma.T @ x / n[:, None]
        cov = np.stack([(gamma[:, s, None] * (x - mean[s])).T @ (x - mean[s]) / n[s] + hm.FLOOR * np.eye(f) for s in range(k)])
        theta = np.concatenate([gamma[0], (pairs / pairs.sum(1, keepdims=True)).ravel(), mean.ravel(), cov.ravel()])
    return theta, like


@pytest.mark.parametrize(("chunk", "fan"), [(512, 256), (7, 3)])
def test_fit_and_path_equal_plain_recursions(spark, chunk, fan):
    """One chunk a key, and many chunks over several levels of the scan."""
    pdf = panel()
    rounds = 5
    found, models = hm.market_states(spark.createDataFrame(pdf), ["ret5", "vol20"], states=3, least_rows=10, rounds=rounds, tol=-1e9, chunk_rows=chunk, fan=fan)
    models = models.toPandas().set_index("symbol")
    found = found.toPandas().sort_values(["symbol", "rn"])
    for symbol, g in pdf.groupby("symbol"):
        x = g[["ret5", "vol20"]].to_numpy()
        x = (x - x.mean(0)) / x.std(0)
        # the last round's tolerance never holds, so all rounds run
        theta, like = em(x, 3, models.loc[symbol, "rounds"])
        np.testing.assert_allclose(models.loc[symbol, "theta"], theta, rtol=1e-6, atol=1e-8)
        assert abs(models.loc[symbol, "loglik"] - like) < 1e-6 * abs(like)
        gamma, path, _, _ = by_loop(x, theta, 3)
        mine = found[found.symbol == symbol]
        np.testing.assert_allclose(np.stack(mine["probabilities"]), gamma, atol=1e-7)
        assert mine["state"].tolist() == path
        assert models.loc[symbol, "rounds"] == (1 if chunk == 512 and rounds == 1 else rounds)


def test_summary_of_the_present_state(spark):
    pdf = panel(9, (200, 30))
    found, models = hm.market_states(spark.createDataFrame(pdf), ["ret5", "vol20"], states=3, least_rows=60, rounds=30)
    rows = found.toPandas().sort_values("rn")
    assert set(rows["symbol"]) == {"A"}, "a key of 30 rows has no model"
    got = hm.current_states(found, models, states=3).first()
    assert got["regime"] == rows["regime"].iloc[-1] and got["rn"] == 200
    assert abs(sum(got["transition"].values()) - 1) < 1e-9 and abs(sum(got["probabilities"].values()) - 1) < 1e-9
    share = rows["regime"].value_counts(normalize=True)
    assert all(abs(got["distribution"][k] - share.get(k, 0)) < 1e-12 for k in got["distribution"])
    assert got["regime_changes"] == int((np.diff(rows["state"].tail(20)) != 0).sum())
    assert set(got["transition"]) == {"bull", "bear", "high_vol"}


def test_no_rows_give_no_states(spark):
    rows = spark.createDataFrame(panel()).where("rn < 0")
    found, models = hm.market_states(rows, ["ret5", "vol20"], states=3)
    assert found.count() == 0 and models.count() == 0
