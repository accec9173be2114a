"""Forecast paths and per-symbol time-series models from distributed moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import sdiv
from barloom.operators.layout import Blocks, block_panel
from barloom.operators.recurrence import Recurrence, reach_of, solve, sub_rows_for


def last_rows(panel: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last ``n`` rows per key, by row number: no window over whole keys."""
    size = panel.groupBy(*keys).agg(F.max("rn").alias("__n"))
    return panel.join(size, list(keys)).where(F.col("rn") > F.col("__n") - n).drop("__n")


def median_spacing(panel: DataFrame, bars: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Median seconds between the last ``bars`` bars, cut to an integer."""
    from pyspark.sql import Window

    tail = last_rows(panel, bars, keys)
    w = Window.partitionBy(*keys).orderBy("time")  # at most ``bars`` rows per key
    gap = F.unix_seconds("time") - F.unix_seconds(F.lag("time").over(w))
    return tail.select(*keys, gap.alias("gap")).groupBy(*keys).agg(
        F.floor(F.percentile("gap", F.lit(0.5))).cast("long").alias("spacing")
    )


def future_path(start: DataFrame, horizon: int) -> DataFrame:
    """Price path from (last_time, price, ensemble, step_return, spacing).

    Step 1 follows the ensemble forecast; later steps compound the one-step model return.
    """
    s = start.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    first = F.col("price") * (1 + F.col("ensemble"))
    value = first * F.pow(1 + F.col("step_return"), F.col("step") - 1)
    time = F.timestamp_seconds(F.unix_seconds("last_time") + F.col("step") * F.col("spacing"))
    return s.select(*[c for c in start.columns], "step", time.alias("time"), value.alias("value"))


def linear_path(start: DataFrame, horizon: int, spacing: int = 3600) -> DataFrame:
    """Fallback path without a one-step model: straight line in the ensemble forecast."""
    s = start.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    time = F.timestamp_seconds(F.unix_seconds("last_time") + F.col("step") * spacing)
    return s.select(*start.columns, "step", time.alias("time"), (F.col("price") * (1 + F.col("ensemble") * F.col("step"))).alias("value"))


def _with_lags(panel: DataFrame, value: Column, order: int, keys: Sequence[str]) -> DataFrame:
    w = block_panel(panel, keys, back=order + 1)
    df = w.df.select("*", value_over(w, value).alias("__x"))
    w = w.with_df(df)
    return w.with_df(df.select("*", *[w.lag("__x", k).alias(f"__x{k}") for k in range(1, order + 1)])).own_rows()


def value_over(w: Blocks, value: Column) -> Column:
    return F.log(sdiv(value, F.lag(value, 1).over(w.line)))


def autoregression(
    panel: DataFrame,
    max_order: int = 5,
    train_share: float = 0.8,
    keys: Sequence[str] = ("symbol",),
    extra: Sequence[str] = (),
    price: str = "close",
) -> DataFrame:
    """AR(p) of log returns per key, p chosen by AIC among 0..max_order, plus ``extra`` regressors.

    Normal equations come from one aggregate of cross moments per key (map-side combined, so a
    key of any length spreads over tasks); what is solved per key is a matrix of order p + 1.
    All orders are fitted on the same rows. Returns order, coefficients, sigma and AIC.
    """
    d = _with_lags(panel, F.col(price), max_order, keys)
    size = panel.groupBy(*keys).agg(F.floor(F.max("rn") * train_share).alias("__train"))
    d = d.join(size, list(keys)).where(F.col("rn") <= F.col("__train"))
    names = ["__x", *[f"__x{k}" for k in range(1, max_order + 1)], *extra]
    d = d.dropna(subset=names)
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(c) for c in names]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in cells]).alias("q"),
    )
    m, n_extra = len(names), len(extra)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*keys).schema)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_fit_one(r.n, r.s, r.q, m, max_order, n_extra) for r in pdf.itertuples()]
            out = pd.DataFrame(rows, columns=["n", "p", "const", "coef", "sigma", "aic"])
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), out], axis=1)

    return moments.mapInPandas(
        fit, f"{key_schema}, n long, p int, const double, coef array<double>, sigma double, aic double"
    )


def _fit_one(n, sums, products, m: int, max_order: int, n_extra: int):
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = products
    full = full + np.triu(full, 1).T
    best = None
    for p in range(max_order + 1):
        cols = [*range(1, p + 1), *range(1 + max_order, 1 + max_order + n_extra)]
        gram = np.block([[np.array([[n]]), sums[cols][None, :]], [sums[cols][:, None], full[np.ix_(cols, cols)]]])
        right = np.concatenate([[sums[0]], full[0, cols]])
        beta = np.linalg.lstsq(gram, right, rcond=None)[0]
        rss = max(full[0, 0] - beta @ right, 1e-300)
        aic = n * np.log(rss / n) + 2 * (len(beta) + 1)
        if best is None or aic < best[5]:
            best = (int(n), p, float(beta[0]), beta[1:].tolist(), float(np.sqrt(rss / n)), float(aic))
    return best


def garch_grid(
    panel: DataFrame,
    alphas: Sequence[float] = (0.03, 0.06, 0.1, 0.15, 0.2),
    betas: Sequence[float] = (0.6, 0.7, 0.8, 0.85, 0.9),
    keys: Sequence[str] = ("symbol",),
    price: str = "close",
) -> DataFrame:
    """GARCH(1,1) per key: AR(1) mean, variance targeting, best (alpha, beta) by likelihood.

    Every grid point is a linear recurrence in beta; the grid multiplies the rows and spreads over
    the cluster. Gaussian likelihood (the Student-t of the surveyed behaviour is not modelled).
    """
    d = _with_lags(panel, F.col(price), 1, keys).where("__x is not null")
    stats = d.groupBy(*keys).agg(
        F.regr_slope("__x", "__x1").alias("phi"), F.regr_intercept("__x", "__x1").alias("c")
    )
    resid = d.join(stats, list(keys)).select(
        *keys, "time", "rn", (F.col("__x") - F.col("c") - F.col("phi") * F.coalesce("__x1", F.lit(0.0))).alias("e")
    )
    var = resid.groupBy(*keys).agg(F.avg(F.col("e") * F.col("e")).alias("v"), F.min("rn").alias("__first"))
    pairs = [(a, b) for a in alphas for b in betas if a + b < 1]
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in pairs])
    rows = resid.join(var, list(keys)).select("*", F.inline(grid))
    rows = rows.withColumn("rn", F.col("rn") - F.col("__first") + 1)
    top = max(betas)
    sub = sub_rows_for(betas)
    back = reach_of([top], sub) + sub
    gk = [*keys, "alpha", "beta"]
    w = block_panel(rows, gk, back=back, block_rows=max(4 * back, 8 * sub), sub_rows=sub)
    omega = F.col("v") * (1 - F.col("alpha") - F.col("beta"))
    drive = F.when(F.col("rn") == 1, F.col("v")).otherwise(omega + F.col("alpha") * F.pow(F.col("__e1"), 2))
    w = w.with_df(w.df.select("*", F.coalesce(w.lag("e"), F.lit(0.0)).alias("__e1")))
    w = solve(w, [Recurrence("h", drive, F.col("beta"), slowest=top)])
    ll = -0.5 * (F.log(F.lit(2 * np.pi)) + F.log("h") + F.pow(F.col("e"), 2) / F.col("h"))
    fit = w.own_rows().groupBy(*gk).agg(
        F.sum(ll).alias("loglik"), F.count(F.lit(1)).alias("n"), F.max_by("h", "rn").alias("last_variance")
    )
    best = fit.groupBy(*keys).agg(F.max_by(F.struct("alpha", "beta", "loglik", "n", "last_variance"), F.struct("loglik", "alpha", "beta")).alias("b"))
    out = best.select(*keys, "b.*").join(stats, list(keys))
    k = 5
    return out.select(
        *keys, "alpha", "beta", (F.col("alpha") + F.col("beta")).alias("persistence"), "phi", "loglik",
        (2 * k - 2 * F.col("loglik")).alias("aic"), (k * F.log(F.col("n").cast("double")) - 2 * F.col("loglik")).alias("bic"),
        "last_variance", "n",
    )

