"""ARMA models of log returns per key: two-stage fit, residuals, forecast paths.

Moving-average terms make the fit non-linear; two regressions avoid that. A long autoregression gives estimates of the
shocks; then returns are regressed on their own lags and on lagged shocks. Both regressions come from cross moments, one
aggregate each, combined before they move; what a task solves is a matrix of a few lags. All orders are compared by AIC on
the same rows.

A forecast is a linear recurrence of a small state (last returns, last shocks, cumulated return), so the state ``h``
steps ahead is a power of its companion matrix: a long hold-out part is cut into pieces that start from such powers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import sdiv
from barloom.operators.forecast import autoregression, value_over
from barloom.operators.layout import block_panel

#: Steps of a forecast path that one task computes from a power of the companion matrix.
PIECE = 4096
FIT = "n long, p int, q int, const double, ar array<double>, ma array<double>, sigma double, aic double, bic double"


def as_arma(fits: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Autoregressions (``const``, ``coef``) in the form of ARMA fits without moving average."""
    none = F.array().cast("array<double>")
    return fits.select(
        *keys, "n", "p", F.lit(0).alias("q"), "const", F.col("coef").alias("ar"), none.alias("ma"), "sigma", "aic",
        (F.col("aic") + (F.log("n") - 2) * (F.size("coef") + 2)).alias("bic"), F.lit(0.0).alias("long_const"), none.alias("long"),
    )


def _dot(coefficients: str, names: Sequence[str]) -> Column:
    if not names:
        return F.lit(0.0)
    used = F.slice(F.array(*names), 1, F.size(coefficients))
    return F.aggregate(F.zip_with(coefficients, used, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def _names(prefix: str, n: int) -> list[str]:
    return [f"__{prefix}{k}" for k in range(1, n + 1)]


def _shocks(panel: DataFrame, fits: DataFrame, long_order: int, lags: int, shocks: int, more: int, keys: Sequence[str], price: str):
    """Row blocks with returns ``__x``, their lags, estimated shocks ``__e`` of the long autoregression, and their lags."""
    joined = panel.select(*keys, "time", "rn", price).join(fits, list(keys))
    w = block_panel(joined, keys, back=max(lags, long_order) + shocks + more + 2)
    deep = max(lags, long_order)
    w = w.with_df(w.df.select("*", value_over(w, F.col(price)).alias("__x")))
    w = w.with_df(w.df.select("*", *[w.lag("__x", k).alias(n) for k, n in enumerate(_names("x", deep), 1)]))
    shock = F.col("__x") - F.col("long_const") - _dot("long", _names("x", long_order))
    if long_order:  # as in the long autoregression, a row counts only if all its orders could use it
        shock = F.when(F.size(F.array_compact(F.array(*_names("x", long_order)))) == long_order, shock)
    w = w.with_df(w.df.select("*", shock.alias("__e")))
    return w.with_df(w.df.select("*", *[w.lag("__e", k).alias(n) for k, n in enumerate(_names("e", shocks), 1)]))


def train_rows(panel: DataFrame, train_share: float, keys: Sequence[str]) -> DataFrame:
    return panel.groupBy(*keys).agg(F.floor(F.max("rn") * train_share).alias("cut"))


def two_stage(
    panel: DataFrame, max_p: int = 5, max_q: int = 5, long_order: int = 12, train_share: float = 0.8, keys: Sequence[str] = ("symbol",), price: str = "close"
) -> DataFrame:
    """ARMA(p, q) of log returns of each key's first ``train_share`` of rows, orders by AIC; with the long autoregression."""
    keys = list(keys)
    first = autoregression(panel, long_order, train_share, keys, price=price)
    long = first.select(*keys, F.col("const").alias("long_const"), F.col("coef").alias("long"))
    w = _shocks(panel, long, long_order, max_p, max_q, 0, keys, price)
    names = ["__x", *_names("x", max_p), *_names("e", max_q)]
    d = w.own_rows().join(train_rows(panel, train_share, keys), keys).where("rn <= cut").dropna(subset=names)
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(c) for c in names]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in cells]).alias("m"),
    )
    m = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_best(r.n, np.asarray(r.s), np.asarray(r.m), m, max_p, max_q) for r in pdf.itertuples()]
            out = pd.DataFrame(rows, columns=["n", "p", "q", "const", "ar", "ma", "sigma", "aic", "bic"])
            yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)

    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*keys).schema)
    return moments.mapInPandas(solve, f"{key_schema}, {FIT}").join(long, keys)


def _best(n: float, sums: np.ndarray, products: np.ndarray, m: int, max_p: int, max_q: int) -> tuple:
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = products
    full = full + np.triu(full, 1).T
    best = None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            cols = [*range(1, p + 1), *range(1 + max_p, 1 + max_p + q)]
            gram = np.block([[np.array([[n]]), sums[cols][None, :]], [sums[cols][:, None], full[np.ix_(cols, cols)]]])
            right = np.concatenate([[sums[0]], full[0, cols]])
            beta = np.linalg.lstsq(gram, right, rcond=None)[0]
            rss = max(full[0, 0] - beta @ right, 1e-300)
            k = len(beta) + 1
            aic = n * np.log(rss / n) + 2 * k
            if best is None or aic < best[7] - 1e-9:
                best = (int(n), p, q, float(beta[0]), beta[1 : p + 1].tolist(), beta[p + 1 :].tolist(), float(np.sqrt(rss / n)), float(aic), float(aic + (np.log(n) - 2) * k))
    return best


def residual_white_noise(
    panel: DataFrame, fits: DataFrame, max_p: int, max_q: int = 0, long_order: int = 0, lags: int = 10, train_share: float = 0.8,
    keys: Sequence[str] = ("symbol",), price: str = "close",
) -> DataFrame:
    """Ljung-Box statistic of the residuals of ``fits`` on the rows fitted: ``n, q_stat, p_value, white`` (p above 0.05).

    ``lags`` must be even: the chi-square tail is then a finite sum.
    """
    if lags % 2:
        raise ValueError("lags must be even")
    keys = list(keys)
    w = _shocks(panel, fits, long_order, max_p, max_q, lags, keys, price)
    d = w.df.join(train_rows(panel, train_share, keys), keys)
    # as in the fit, a row counts only if all orders could use it
    whole = F.lit(True)
    for c in ["__x", *_names("x", max(max_p, long_order)), *_names("e", max_q)]:
        whole = whole & F.col(c).isNotNull()
    residual = F.col("__x") - F.col("const") - _dot("ar", _names("x", max_p)) - _dot("ma", _names("e", max_q))
    w = w.with_df(d.where("rn <= cut").select("*", F.when(whole, residual).alias("__r")))
    d = w.with_df(w.df.select("*", *[w.lag("__r", k).alias(n) for k, n in enumerate(_names("r", lags), 1)])).own_rows().where("__r is not null")
    return ljung_box(d, "__r", _names("r", lags), keys)


def ljung_box(rows: DataFrame, value: str, lagged: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Q and its p-value per key from a value and its lags; both are taken from the key's mean."""
    d = rows.join(rows.groupBy(*keys).agg(F.avg(value).alias("__mu")), list(keys))
    e = F.col(value) - F.col("__mu")
    sums = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("__v"), *[F.sum(e * (F.col(c) - F.col("__mu"))).alias(f"__g{k}") for k, c in enumerate(lagged, 1)]
    )
    q = F.lit(0.0)
    for k in range(1, len(lagged) + 1):
        q = q + F.pow(sdiv(f"__g{k}", "__v"), 2) / (F.col("n") - k)
    q = F.col("n") * (F.col("n") + 2) * q
    half, term, tail = F.col("q_stat") / 2.0, F.lit(1.0), F.lit(1.0)
    for k in range(1, len(lagged) // 2):
        term = term * half / k
        tail = tail + term
    found = sums.select(*keys, "n", q.alias("q_stat"))
    return found.select("*", (F.exp(-half) * tail).alias("p_value")).withColumn("white", (F.col("p_value") > 0.05).cast("int"))


def forecast_paths(
    panel: DataFrame, fits: DataFrame, max_p: int, max_q: int = 0, long_order: int = 0, train_share: float = 0.8,
    keys: Sequence[str] = ("symbol",), price: str = "close",
) -> DataFrame:
    """``keys, time, rn, step, y_true, y_pred, price, price_pred``: the returns and prices after the train rows and their forecast,
    made at the last train row."""
    keys = list(keys)
    w = _shocks(panel, fits, long_order, max(max_p, 1), max_q, 0, keys, price)
    cut = train_rows(panel, train_share, keys)
    rows = w.own_rows().join(cut, keys)
    zero = F.lit(0.0)
    state = rows.where("rn = cut").select(
        *keys, F.col(price).alias("__p0"), "const", "ar", "ma",
        F.array(*[F.coalesce(c, zero) for c in ["__x", *_names("x", max(max_p, 1) - 1)]]).alias("__xs"),
        F.array(*[F.coalesce(c, zero) for c in ["__e", *_names("e", max_q - 1)][:max_q]]).cast("array<double>").alias("__es"),
    )
    test = rows.where("rn > cut").select(*keys, "time", "rn", (F.col("rn") - F.col("cut")).alias("step"), F.col("__x").alias("y_true"), F.col(price).alias("price"))
    test = test.join(state, keys).withColumn("__piece", F.floor((F.col("step") - 1) / PIECE))

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step").reset_index(drop=True)
        r = pdf.iloc[0]
        ar, ma, xs, es = (np.asarray(r[c], float) for c in ("ar", "ma", "__xs", "__es"))
        p, q = len(xs), len(es)
        move = np.zeros((2 + p + q, 2 + p + q))  # 1, cumulated return, returns, shocks
        move[0, 0] = move[1, 1] = 1
        ahead = np.concatenate([[r["const"], 0], np.pad(ar, (0, p - len(ar))), np.pad(ma, (0, q - len(ma)))])
        move[2] = ahead
        move[1] += ahead
        for i in range(1, p):
            move[2 + i, 1 + i] = 1
        for i in range(1, q):
            move[2 + p + i, 1 + p + i] = 1
        z = np.concatenate([[1, 0], xs, es])
        steps = pdf["step"].to_numpy()
        z, at, found = np.linalg.matrix_power(move, int(steps[0])) @ z, steps[0], []
        for s in steps:
            while at < s:
                z, at = move @ z, at + 1
            found.append((z[2], z[1]))
        y, total = np.array(found).T
        out = pdf[[*keys, "time", "rn", "step", "y_true", "price"]].assign(y_pred=y, price_pred=r["__p0"] * np.exp(total))
        return out[[*keys, "time", "rn", "step", "y_true", "y_pred", "price", "price_pred"]]

    types = dict(panel.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += f", time {types['time']}, rn long, step long, y_true double, y_pred double, price double, price_pred double"
    return test.groupBy(*keys, "__piece").applyInPandas(path, schema)


def path_errors(paths: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Error of the price path per key."""
    e = F.col("price_pred") - F.col("price")
    return paths.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("path_rmse"), F.count(F.lit(1)).alias("n"))
