"""GARCH(1,1) with an AR(1) mean and Student-t errors per key, by maximum likelihood.

The variance and its derivatives by the parameters are one linear recurrence of a small vector. What a chunk of rows does to
that vector is a matrix, so the vector before each chunk comes from the same scan over chunk matrices as in hidden Markov models, and a
chunk adds its share of the likelihood, its gradient and the products of gradients. One round sums these over chunks for all keys
and moves every key's parameters by a damped scoring step; a step that lowers the likelihood is taken back and damped more.

Keys of a single chunk run all their rounds inside one task, from the best point of a coarse grid; longer keys start from
the fit of their first chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.forecast import value_over
from barloom.operators.hidden_markov import FAN, _key_schema, _stacked, _together, carried
from barloom.operators.layout import block_panel
from barloom.sources.staging import staged

CHUNK = 512
#: Coarse grid of starts: alpha, beta and degrees of freedom.
STARTS = [(a, b, v) for a in (0.03, 0.06, 0.1, 0.15, 0.2) for b in (0.6, 0.7, 0.8, 0.85, 0.9) for v in (5.0, 10.0, 40.0) if a + b < 1]
MOST, LEAST_FREEDOM = 0.9999, 2.05
#: Numbers that a round gathers for each key: likelihood, gradient, upper triangle of the products of gradients.
SUMS = 1 + 4 + 10
_UPPER = np.triu_indices(4)


def natural(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Omega, alpha, beta and degrees of freedom from free numbers, and the derivatives (natural by free)."""
    omega = np.exp(u[:, 0])
    p, s = 1 / (1 + np.exp(-u[:, 1])), 1 / (1 + np.exp(-u[:, 2]))
    far = np.exp(u[:, 3])
    out = np.stack([omega, MOST * p * s, MOST * p * (1 - s), LEAST_FREEDOM + far], 1)
    j = np.zeros((len(u), 4, 4))
    j[:, 0, 0] = omega
    j[:, 1, 1], j[:, 2, 1] = MOST * p * (1 - p) * s, MOST * p * (1 - p) * (1 - s)
    j[:, 1, 2], j[:, 2, 2] = MOST * p * s * (1 - s), -MOST * p * s * (1 - s)
    j[:, 3, 3] = far
    return out, j


def free(omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    p = (alpha + beta) / MOST
    return np.stack([np.log(omega), np.log(p / (1 - p)), np.log(alpha / beta), np.log(freedom - LEAST_FREEDOM)], -1)


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(6):
        out -= 1 / (x + k)
    y = x + 6
    return out + np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)


def variances(before_e: np.ndarray, here: np.ndarray, first: np.ndarray, v: np.ndarray, came: np.ndarray, nat: np.ndarray) -> np.ndarray:
    """The vector (variance, its derivatives by omega, alpha, beta) of each row; ``came`` is that before the chunk and
    ``before_e`` the squared error of the row before."""
    c, n = before_e.shape
    out, s = np.zeros((c, n, 4)), came
    omega, alpha, beta = nat[:, 0], nat[:, 1], nat[:, 2]
    start = np.stack([v, 0 * v, 0 * v, 0 * v], 1)
    for t in range(n):
        p = before_e[:, t]
        new = np.stack([omega + alpha * p + beta * s[:, 0], 1 + beta * s[:, 1], p + beta * s[:, 2], s[:, 0] + beta * s[:, 3]], 1)
        if t == 0:
            new = np.where(first[:, None], start, new)
        s = np.where(here[:, t, None], new, s)
        out[:, t] = s
    return out


def scores(e: np.ndarray, s: np.ndarray, here: np.ndarray, nat: np.ndarray, jac: np.ndarray) -> np.ndarray:
    """Sums over the rows of each chunk: likelihood, gradient by the free numbers, products of gradients."""
    h, f = np.maximum(s[:, :, 0], 1e-300), nat[:, 3][:, None]
    z = e**2 / ((f - 2) * h)
    const = np.array([math.lgamma((x + 1) / 2) - math.lgamma(x / 2) for x in nat[:, 3]])[:, None]
    like = const - 0.5 * np.log(np.pi * (f - 2) * h) - (f + 1) / 2 * np.log1p(z)
    by_h = -0.5 / h + (f + 1) / 2 * z / (1 + z) / h
    by_f = 0.5 * (digamma((f + 1) / 2) - digamma(f / 2)) - 0.5 / (f - 2) - 0.5 * np.log1p(z) + (f + 1) / 2 * z / ((1 + z) * (f - 2))
    g = np.concatenate([by_h[:, :, None] * s[:, :, 1:], by_f[:, :, None]], 2) * here[:, :, None]
    g = np.einsum("ctn,cnu->ctu", g, jac)
    products = np.einsum("ctu,ctw->cuw", g, g)
    return np.concatenate([(like * here).sum(1)[:, None], g.sum(1), products[:, _UPPER[0], _UPPER[1]]], 1)


def stepped(base: np.ndarray, kept: np.ndarray, tried: np.ndarray, sums: np.ndarray, damp: np.ndarray, tol: float) -> tuple[np.ndarray, ...]:
    """After the sums at ``tried``: the parameters kept, their sums, the next ones to try, the damping, and whether it is over."""
    better = sums[:, 0] > kept[:, 0]
    rise = np.where(better, sums[:, 0] - kept[:, 0], np.inf)
    base, kept = np.where(better[:, None], tried, base), np.where(better[:, None], sums, kept)
    damp = np.where(better, np.maximum(damp / 5, 1e-7), damp * 10)
    info = np.zeros((len(base), 4, 4))
    info[:, _UPPER[0], _UPPER[1]] = kept[:, 5:]
    info = info + np.triu(info, 1).transpose(0, 2, 1)
    diagonal = np.einsum("cii->ci", info)
    info = info + np.eye(4) * (damp[:, None] * diagonal + 1e-9 * (1 + diagonal))[:, :, None]
    move = np.linalg.solve(info, kept[:, 1:5, None])[:, :, 0]
    move *= np.minimum(1, 1.5 / np.maximum(np.abs(move).max(1), 1e-12))[:, None]
    return base, kept, np.clip(base + move, -30, 30), damp, (rise < tol) | (damp > 1e7)


def _padded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(map(len, pdf["e"]))
    e, p, here = np.zeros((len(pdf), n)), np.zeros((len(pdf), n)), np.zeros((len(pdf), n), bool)
    for i, (a, b) in enumerate(zip(pdf["e"], pdf["p"], strict=True)):
        e[i, : len(a)], p[i, : len(b)], here[i, : len(a)] = a, b, True
    return e, p, here


def alone(pdf: pd.DataFrame, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Free parameters, likelihood and rounds of keys (or first chunks) taken by themselves."""
    e, p, here = _padded(pdf)
    v, c = pdf["v"].to_numpy(float), len(pdf)
    first = np.ones(c, bool)

    def sums(u: np.ndarray, on: np.ndarray) -> np.ndarray:
        nat, jac = natural(u)
        s = variances(p[on], here[on], first[on], v[on], np.zeros((len(on), 4)), nat)
        return scores(e[on], s, here[on], nat, jac)

    every, best, start = np.arange(c), np.full(c, -np.inf), np.zeros((c, 4))
    for a, b, f in STARTS:
        u = free(v * (1 - a - b), np.full(c, a), np.full(c, b), np.full(c, f))
        like = sums(u, every)[:, 0]
        start, best = np.where((like > best)[:, None], u, start), np.maximum(like, best)
    base, kept, tried, damp = start.copy(), np.full((c, SUMS), -np.inf), start.copy(), np.full(c, 0.05)
    took, over = np.zeros(c, int), np.zeros(c, bool)
    for _ in range(rounds):
        on = np.flatnonzero(~over)
        if not len(on):
            break
        base[on], kept[on], tried[on], damp[on], over[on] = stepped(base[on], kept[on], tried[on], sums(tried[on], on), damp[on], tol)
        took[on] += 1
    return base, kept[:, 0], took


def errors(panel: DataFrame, keys: Sequence[str], price: str, train_share: float, realised: int = 5) -> DataFrame:
    """Errors ``e`` (percent) of the AR(1) mean of log returns on the train rows, with the mean's parameters and the realised volatility."""
    keys = list(keys)
    w = block_panel(panel.select(*keys, "time", "rn", price), keys, back=realised + 3)
    w = w.with_df(w.df.select("*", (value_over(w, F.col(price)) * 100).alias("__x")))
    d = w.with_df(w.df.select("*", w.lag("__x").alias("__x1"), w.std("__x", realised).alias("rv"))).own_rows()
    size = panel.groupBy(*keys).agg(F.floor(F.max("rn") * train_share).alias("__cut"))
    d = d.join(size, keys).where("rn <= __cut and __x is not null and __x1 is not null")
    # the volatility of rows whose window begins before the first error is that of returns and stays
    mean = d.groupBy(*keys).agg(F.regr_slope("__x", "__x1").alias("phi"), F.regr_intercept("__x", "__x1").alias("const"))
    return d.join(mean, keys).select(*keys, "rn", (F.col("__x") - F.col("const") - F.col("phi") * F.col("__x1")).alias("e"), "rv", "phi", "const")


def garch(
    panel: DataFrame, train_share: float = 0.8, keys: Sequence[str] = ("symbol",), price: str = "close", rounds: int = 200, tol: float = 1e-7,
    chunk_rows: int = CHUNK, fan: int = FAN, least_rows: int = 30,
) -> DataFrame:
    """``omega, alpha, beta, persistence, freedom, const, phi, loglik, aic, bic, last_variance, next_variance, vol_forecast_corr, n,
    rounds`` per key, for returns in percent. ``vol_forecast_corr`` is the correlation of the fitted with the realised volatility of five
    rows. Keys with fewer than ``least_rows`` errors, or with constant ones, are left out."""
    keys = list(keys)
    rows = staged(errors(panel, keys, price, train_share), "garch-errors")
    about = rows.groupBy(*keys).agg(
        F.avg(F.col("e") * F.col("e")).alias("v"), F.count("*").alias("n"), F.min("rn").alias("__first"), F.max("rn").alias("__last"),
        F.first("phi").alias("phi"), F.first("const").alias("const"),
    ).where((F.col("n") >= least_rows) & (F.col("v") > 0))
    at = F.floor((F.col("rn") - 1) / chunk_rows)
    lines = rows.groupBy(*keys, at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("rn", "e", "rv"))).alias("l"))
    # the squared error of the row before a chunk comes with the chunk: a row a chunk goes through the window
    ends = lines.select(*keys, "chunk", F.pow(F.element_at("l", -1)["e"], 2).alias("__p"))
    ends = ends.select(*keys, "chunk", F.lag("__p").over(Window.partitionBy(*keys).orderBy("chunk")).alias("p"))
    lines = lines.join(ends, [*keys, "chunk"])
    whole = lines.join(about, keys)
    e = F.transform("l", lambda r: r["e"])
    moved = F.concat(F.array(F.coalesce("p", F.lit(0.0))), F.transform(F.slice(e, 1, F.size("l") - 1), lambda x: x * x))
    chunks = whole.select(
        *keys, "chunk", (F.get("l", F.lit(0))["rn"] == F.col("__first")).alias("first"),
        (F.floor((F.col("__first") - 1) / chunk_rows) == F.floor((F.col("__last") - 1) / chunk_rows)).alias("single"),
        e.alias("e"), moved.alias("p"), F.transform("l", lambda r: r["rv"]).alias("rv"), "v",
    )
    chunks = staged(chunks, "garch-chunks")
    schema = _key_schema(chunks, keys)

    def fit_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            u, like, took = alone(pdf, rounds, tol)
            yield pdf[keys].assign(u=list(u), loglik=like, rounds=took)

    fitted = f"{schema}, u array<double>, loglik double, rounds int"
    done = chunks.where("first and single").mapInPandas(fit_alone, fitted)
    long = chunks.where("not single")
    now = long.where("first").mapInPandas(fit_alone, fitted)
    empty = F.array_repeat(F.lit(float("-inf")), SUMS)
    now = staged(now.select(*keys, F.col("u").alias("base"), empty.alias("kept"), F.col("u").alias("tried"), F.lit(0.05).alias("damp"), F.lit(False).alias("over"), F.lit(0).alias("rounds")), "garch-round")
    for _ in range(rounds):
        if now.where("not over").isEmpty():
            break
        now = staged(_round(long, now, keys, tol, fan), "garch-round")
    fits = staged(done.union(now.select(*keys, F.col("base").alias("u"), F.get("kept", F.lit(0)).alias("loglik"), "rounds")), "garch-fits")
    return _described(chunks, fits, about, keys, fan)


def _products(chunks: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            (e, p, here), nat, first = _padded(pdf), natural(_stacked(pdf["u"]))[0], pdf["first"].to_numpy(bool)
            last = variances(p, here, first, pdf["v"].to_numpy(float), np.zeros((len(pdf), 4)), nat)[:, -1]
            n, beta = here.sum(1), nat[:, 2]
            m = np.zeros((len(pdf), 5, 5))
            through = np.where(first, 0, beta**n)
            for i in range(4):
                m[:, i, i] = through
            m[:, 0, 3] = np.where(first, 0, n * beta ** (n - 1))
            m[:, 4, :4], m[:, 4, 4] = last, 1
            yield pdf[[*keys, "chunk"]].assign(p=list(m.reshape(len(m), -1)))

    return staged(chunks.join(params, keys).mapInPandas(run, f"{_key_schema(chunks, keys)}, chunk long, p array<double>"), "garch-products")


def _before(chunks: DataFrame, params: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """``keys, chunk, came``: the vector before each chunk, up to its last number."""
    ends = params.select(*keys, F.array(*[F.lit(float(i == 4)) for i in range(5)]).alias("before"), F.array_repeat(F.lit(1.0), 5).alias("after"))
    return carried(_products(chunks, params, keys), ends, keys, 5, False, fan).select(*keys, "chunk", F.col("before").alias("came"))


def _came(pdf: pd.DataFrame) -> np.ndarray:
    came = _stacked(pdf["came"])
    return came[:, :4] / came[:, 4:]


def _round(chunks: DataFrame, now: DataFrame, keys: list[str], tol: float, fan: int) -> DataFrame:
    schema = _key_schema(chunks, keys)
    params = now.where("not over").select(*keys, F.col("tried").alias("u"))
    rows = chunks.join(params, keys).join(_before(chunks, params, keys, fan), [*keys, "chunk"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            (e, p, here), (nat, jac) = _padded(pdf), natural(_stacked(pdf["u"]))
            s = variances(p, here, pdf["first"].to_numpy(bool), pdf["v"].to_numpy(float), _came(pdf), nat)
            sums = scores(e, s, here, nat, jac)
            group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            total = np.zeros((group.max() + 1, SUMS))
            np.add.at(total, group, sums)
            yield pdf[keys].drop_duplicates().assign(sums=list(total))

    each = rows.mapInPandas(run, f"{schema}, sums array<double>")
    at = each.select(*keys, F.posexplode("sums").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    sums = at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda r: r["v"]).alias("sums"))

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches, 1024):
            base, kept, tried, damp, over = stepped(
                _stacked(pdf["base"]), _stacked(pdf["kept"]), _stacked(pdf["tried"]), _stacked(pdf["sums"]), pdf["damp"].to_numpy(float), tol
            )
            yield pdf[keys].assign(base=list(base), kept=list(kept), tried=list(tried), damp=damp, over=over, rounds=pdf["rounds"] + 1)

    out = f"{schema}, base array<double>, kept array<double>, tried array<double>, damp double, over boolean, rounds int"
    return now.where("not over").join(sums, keys).mapInPandas(update, out).union(now.where("over"))


def _described(chunks: DataFrame, fits: DataFrame, about: DataFrame, keys: list[str], fan: int) -> DataFrame:
    params = fits.select(*keys, "u")
    rows = chunks.join(params, keys).join(_before(chunks, params, keys, fan), [*keys, "chunk"])
    schema = _key_schema(chunks, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            (e, p, here), nat = _padded(pdf), natural(_stacked(pdf["u"]))[0]
            h = variances(p, here, pdf["first"].to_numpy(bool), pdf["v"].to_numpy(float), _came(pdf), nat)[:, :, 0]
            for i in range(len(pdf)):
                n, rv = int(here[i].sum()), np.array([np.nan if x is None else x for x in pdf["rv"][i]], float)
                vol, ok = np.sqrt(h[i, :n]), ~np.isnan(rv)
                a, b = vol[ok], rv[ok]
                last, later = h[i, n - 1], nat[i, 0] + nat[i, 1] * e[i, n - 1] ** 2 + nat[i, 2] * h[i, n - 1]
                yield pdf.loc[[i], [*keys, "chunk"]].assign(s=[[len(a), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()]], last=last, later=later)

    part = rows.mapInPandas(run, f"{schema}, chunk long, s array<double>, last double, later double")
    total = part.groupBy(*keys).agg(
        *[F.sum(F.get("s", F.lit(k))).alias(f"__{k}") for k in range(6)], F.max_by("last", "chunk").alias("last_variance"), F.max_by("later", "chunk").alias("next_variance")
    )
    n, a, b, aa, bb, ab = (F.col(f"__{k}") for k in range(6))
    # a volatility that does not move has no correlation
    spread = F.sqrt(F.greatest((n * aa - a * a) * (n * bb - b * b), F.lit(0.0)))
    corr = F.when(n > 5, F.try_divide(n * ab - a * b, spread))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nat = natural(_stacked(pdf["u"]))[0] if len(pdf) else np.zeros((0, 4))
            yield pdf[[*keys, "loglik", "rounds"]].assign(omega=nat[:, 0], alpha=nat[:, 1], beta=nat[:, 2], freedom=nat[:, 3])

    found = fits.mapInPandas(named, f"{schema}, loglik double, rounds int, omega double, alpha double, beta double, freedom double")
    k = 6
    return found.join(total.select(*keys, corr.alias("vol_forecast_corr"), "last_variance", "next_variance"), keys).join(about.select(*keys, "n", "phi", "const"), keys).select(
        *keys, "omega", "alpha", "beta", (F.col("alpha") + F.col("beta")).alias("persistence"), "freedom", "const", "phi", "loglik",
        (2 * k - 2 * F.col("loglik")).alias("aic"), (k * F.log(F.col("n").cast("double")) - 2 * F.col("loglik")).alias("bic"),
        "last_variance", "next_variance", "vol_forecast_corr", "n", "rounds",
    )
