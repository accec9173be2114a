"""Hidden Markov models with Gaussian states: fitting, posteriors, most likely paths; a model for each key.

A key's rows are cut into chunks of ``CHUNK`` rows; a chunk is one row of arrays. What a chunk does to the
state before it is a matrix: the product over its rows of transition times emission, (sum, product) for probabilities and
(max, plus) for best paths. Such products are associative, so the state before each chunk, and what the
rows after it say, come from a scan over chunk matrices, done in groups of ``FAN`` level by level: no task
holds a whole key. Inside chunks the recursions run over all chunks of a batch at once.

Fitting is expectation maximisation: each round sums expected counts over chunks, combined before they move, and solves
every key's model in a task. Keys of a single chunk need no scan: their rounds all run inside one task, by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.staging import staged

CHUNK = 512
FAN = 256
#: Chunks that a task works on at once.
TOGETHER = 64
#: Added to variances, so that a state of few rows keeps a density.
FLOOR = 1e-3
LEAST = 1e-300


class Model:
    """Parameters of many models side by side, unpacked from rows of numbers."""

    def __init__(self, theta: np.ndarray, states: int, features: int):
        k, f, c = states, features, len(theta)
        cuts = np.cumsum([k, k * k, k * f])
        start, move, mean, cov = np.split(theta, cuts, axis=1)
        self.start, self.move = start, move.reshape(c, k, k)
        self.mean, self.cov = mean.reshape(c, k, f), cov.reshape(c, k, f, f)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log density of the rows ``x`` (chunk, row, feature) in each state."""
        low = np.linalg.cholesky(self.cov)
        apart = x[:, None] - self.mean[:, :, None]
        solved = np.linalg.solve(low, apart.transpose(0, 1, 3, 2))
        log_root = np.log(np.diagonal(low, axis1=2, axis2=3)).sum(2)
        return (-0.5 * ((solved**2).sum(2) + x.shape[2] * np.log(2 * np.pi)) - log_root[:, :, None]).transpose(0, 2, 1)


def initial(states: int, features: int, ret: int, vol: int) -> np.ndarray:
    """A start in standardised units: one volatile state, the others ordered by return; states tend to stay."""
    mean = np.zeros((states, features))
    mean[0, vol] = 1.5
    mean[1:, ret] = np.linspace(1, -1, states - 1) if states > 1 else 0
    mean[1:, vol] = -0.5
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    cov = np.tile(np.eye(features), (states, 1, 1))
    return np.concatenate([np.full(states, 1 / states), move.ravel(), mean.ravel(), cov.ravel()])


def scaled(log_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = log_b.max(2)
    return np.exp(log_b - top[:, :, None]), top


def forward(b: np.ndarray, move: np.ndarray, before: np.ndarray, first: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the states up to each row, and the log of what each row adds to the likelihood."""
    c, n, k = b.shape
    out, gain, v = np.zeros((c, n, k)), np.zeros((c, n)), before
    for t in range(n):
        ahead = np.einsum("ci,cij->cj", v, move)
        ahead = np.where(first[:, None], v, ahead) if t == 0 else ahead
        a = ahead * b[:, t]
        s = np.maximum(a.sum(1), LEAST)
        v = np.where(here[:, t, None], a / s[:, None], v)
        out[:, t], gain[:, t] = v, np.where(here[:, t], np.log(s), 0)
    return out, gain


def backward(b: np.ndarray, move: np.ndarray, after: np.ndarray, here: np.ndarray) -> np.ndarray:
    """What the rows after each row say about its state, up to a factor."""
    out, w = np.zeros_like(b), after
    for t in range(b.shape[1] - 1, -1, -1):
        out[:, t] = w
        back = np.einsum("cij,cj->ci", move, b[:, t] * w)
        w = np.where(here[:, t, None], back / np.maximum(back.max(1), LEAST)[:, None], w)
    return out


def posteriors(alpha: np.ndarray, beta: np.ndarray, here: np.ndarray) -> np.ndarray:
    g = alpha * beta
    return g / np.maximum(g.sum(2), LEAST)[:, :, None] * here[:, :, None]


def products(b: np.ndarray, move: np.ndarray, first: np.ndarray, here: np.ndarray) -> np.ndarray:
    """The matrix of each chunk, up to a factor."""
    c, n, k = b.shape
    m = np.tile(np.eye(k), (c, 1, 1))
    for t in range(n):
        step = m @ move
        step = np.where(first[:, None, None], m, step) if t == 0 else step
        step = step * b[:, t, None, :]
        m = np.where(here[:, t, None, None], step / np.maximum(step.max((1, 2)), LEAST)[:, None, None], m)
    return m


def best_products(log_b: np.ndarray, log_move: np.ndarray, first: np.ndarray, here: np.ndarray) -> np.ndarray:
    c, n, k = log_b.shape
    m = np.where(np.eye(k) > 0, 0.0, -np.inf) + np.zeros((c, 1, 1))
    for t in range(n):
        step = (m[:, :, :, None] + log_move[:, None]).max(2)
        step = np.where(first[:, None, None], m, step) if t == 0 else step
        m = np.where(here[:, t, None, None], step + log_b[:, t, None, :], m)
    return m


def best_steps(log_b: np.ndarray, log_move: np.ndarray, before: np.ndarray, first: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and state the best state before it, and the scores at the end. Ties go to the smaller state."""
    c, n, k = log_b.shape
    back, d = np.tile(np.arange(k), (c, n, 1)), before
    for t in range(n):
        options = d[:, :, None] + log_move
        came, score = options.argmax(1), options.max(1)
        if t == 0:
            came, score = np.where(first[:, None], np.arange(k), came), np.where(first[:, None], d, score)
        back[:, t] = np.where(here[:, t, None], came, back[:, t])
        d = np.where(here[:, t, None], score + log_b[:, t], d)
    return back, d


def expectations(x: np.ndarray, b: np.ndarray, top: np.ndarray, move: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Expected counts of each chunk as a row of numbers: states, sums, products, moves, starts, log likelihood."""
    alpha, gain = forward(b, move, before, first, here)
    beta = backward(b, move, after, here)
    g = posteriors(alpha, beta, here)
    old = np.concatenate([before[:, None], alpha[:, :-1]], axis=1)
    pairs = old[:, :, :, None] * move[:, None] * (b * beta)[:, :, None, :]
    pairs = pairs / np.maximum(pairs.sum((2, 3)), LEAST)[:, :, None, None] * here[:, :, None, None]
    pairs[first, 0] = 0
    starts = g[:, 0] * first[:, None]
    like = (gain + top * here).sum(1)
    flat = [g.sum(1), np.einsum("ctk,ctf->ckf", g, x), np.einsum("ctk,ctf,cth->ckfh", g, x, x), pairs.sum(1), starts, like]
    return np.concatenate([a.reshape(len(x), -1) for a in flat], axis=1)


def solved(sums: np.ndarray, theta: np.ndarray, states: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters that fit the expected counts, and the log likelihood of those before."""
    k, f, c = states, features, len(sums)
    cuts = np.cumsum([k, k * f, k * f * f, k * k, k])
    n, sx, sxx, pairs, starts, like = np.split(sums, cuts, axis=1)
    old = Model(theta, k, f)
    enough = n > 1e-8
    share = np.maximum(n, LEAST)
    mean = np.where(enough[:, :, None], sx.reshape(c, k, f) / share[:, :, None], old.mean)
    cov = sxx.reshape(c, k, f, f) / share[:, :, None, None] - mean[:, :, :, None] * mean[:, :, None, :]
    cov = np.where(enough[:, :, None, None], (cov + cov.transpose(0, 1, 3, 2)) / 2 + FLOOR * np.eye(f), old.cov)
    pairs = pairs.reshape(c, k, k)
    out = pairs.sum(2)
    move = np.where((out > 1e-8)[:, :, None], pairs / np.maximum(out, LEAST)[:, :, None], old.move)
    start = starts / np.maximum(starts.sum(1), LEAST)[:, None]
    return np.concatenate([start, move.reshape(c, -1), mean.reshape(c, -1), cov.reshape(c, -1)], axis=1), like[:, 0]


# chunks as rows of a table ------------------------------------------------------------------------------------------


def packed(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",), chunk_rows: int = CHUNK) -> DataFrame:
    """``keys, chunk, first, single, rn, x``: standardised features of each chunk of rows (numbered by ``rn``), and the mean and deviation
    of each key's features. Rows with a null feature are left out; a constant feature becomes zero."""
    keys, chunk = list(keys), F.floor((F.col("rn") - 1) / chunk_rows)
    whole = rows.dropna(subset=list(features)).select(*keys, "rn", chunk.alias("chunk"), *[F.col(c).cast("double").alias(c) for c in features])
    about = whole.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in features]).alias("mean"), F.array(*[F.stddev_pop(c) for c in features]).alias("std"),
        F.min("chunk").alias("__first"), (F.min("chunk") == F.max("chunk")).alias("single"),
    )
    line = F.array_sort(F.collect_list(F.struct("rn", F.array(*features).alias("x"))))
    lines = whole.groupBy(*keys, "chunk").agg(line.alias("__l"))
    joined = lines.join(about, keys)
    flat = F.flatten(
        F.transform(
            F.col("__l"),
            lambda r: F.transform(
                F.arrays_zip(r["x"].alias("x"), F.col("mean"), F.col("std")),
                lambda v: F.when(v["std"] > 0, (v["x"] - v["mean"]) / v["std"]).otherwise(0.0),
            ),
        )
    )
    return joined.select(*keys, "chunk", (F.col("chunk") == F.col("__first")).alias("first"), "single", F.col("__l.rn").alias("rn"), flat.alias("x"), "mean", "std")


def _padded(pdf: pd.DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    lines = [np.asarray(v, np.float64).reshape(-1, features) for v in pdf["x"]]
    n = max(map(len, lines))
    x, here = np.zeros((len(lines), n, features)), np.zeros((len(lines), n), bool)
    for i, v in enumerate(lines):
        x[i, : len(v)], here[i, : len(v)] = v, True
    return x, here


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _together(batches: Iterator[pd.DataFrame], size: int = TOGETHER) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size].reset_index(drop=True)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def carried(parts: DataFrame, ends: DataFrame, keys: Sequence[str], states: int, best: bool = False, fan: int = FAN) -> DataFrame:
    """``keys, chunk, before, after``: the vector that enters each chunk and the one that comes back from the chunks after it.

    ``parts`` has a matrix ``p`` for each chunk, ``ends`` the vectors ``before`` the first and ``after`` the last chunk of each key.
    """
    keys, k = list(keys), states
    key_schema = _key_schema(parts, keys)

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if best:
            return (a[..., :, :, None] + b[..., None, :, :]).max(-2)
        m = a @ b
        return m / max(m.max(), LEAST)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        mats = _stacked(pdf["p"]).reshape(-1, k, k)
        v, w = np.asarray(pdf["before"][0], float), np.asarray(pdf["after"][0], float)
        before, after = [], []
        for m in mats:
            before.append(v if best else v / max(v.sum(), LEAST))
            v = times(v[None, :], m)[0]
        for m in mats[::-1]:
            after.append(w)
            w = times(m, w[:, None])[:, 0]
        return pdf[[*keys, "chunk"]].assign(before=before, after=after[::-1])

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        m = None
        for p in pdf.sort_values("chunk")["p"]:
            p = np.asarray(p, float).reshape(k, k)
            m = p if m is None else times(m, p)
        return pdf[[*keys, "__sup"]].head(1).rename(columns={"__sup": "chunk"}).assign(p=[m.ravel()])

    vectors = f"{key_schema}, chunk long, before array<double>, after array<double>"
    width = parts.groupBy(*keys).agg((F.max("chunk") - F.min("chunk")).alias("w")).agg(F.max("w")).first()[0]
    if width is None or width < fan:
        return parts.join(ends, keys).groupBy(*keys).applyInPandas(walk, vectors)
    lifted = parts.withColumn("__sup", F.floor(F.col("chunk") / fan))
    upper = staged(lifted.groupBy(*keys, "__sup").applyInPandas(folded, f"{key_schema}, chunk long, p array<double>"), "hmm-level")
    above = carried(upper, ends, keys, states, best, fan).withColumnRenamed("chunk", "__sup")
    return lifted.join(above, [*keys, "__sup"]).groupBy(*keys, "__sup").applyInPandas(walk, vectors)


def fit(
    chunks: DataFrame, keys: Sequence[str], states: int, features: int, start: np.ndarray, rounds: int = 200, tol: float = 1e-4, fan: int = FAN
) -> DataFrame:
    """``keys, theta, loglik, rounds``: a model for each key. A key stops when a round raises its log likelihood by less than ``tol``."""
    keys, k, f = list(keys), states, features
    key_schema = _key_schema(chunks, keys)
    schema = f"{key_schema}, theta array<double>, loglik double, rounds int"

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            x, here = _padded(pdf, f)
            theta, like = np.tile(start, (len(pdf), 1)), np.full(len(pdf), -np.inf)
            took, first = np.zeros(len(pdf), int), np.ones(len(pdf), bool)
            for _ in range(rounds):
                on = np.flatnonzero(took >= 0)
                if not len(on):
                    break
                m = Model(theta[on], k, f)
                b, top = scaled(m.log_density(x[on]))
                sums = expectations(x[on], b, top, m.move, m.start, np.ones((len(on), k)), first[on], here[on])
                new, now = solved(sums, theta[on], k, f)
                rise = now - like[on]
                theta[on], like[on], took[on] = new, now, took[on] + 1
                took[on[rise < tol]] *= -1
            yield pdf[keys].assign(theta=list(theta), loglik=like, rounds=np.abs(took))

    small = chunks.where("single").select(*keys, "x").mapInPandas(alone, schema)
    long = chunks.where("not single")
    now = staged(
        long.select(*keys).distinct().select(*keys, F.lit(start.tolist()).cast("array<double>").alias("theta"), F.lit(float("-inf")).alias("loglik"), F.lit(0).alias("rounds"), F.lit(False).alias("done")),
        "hmm-theta",
    )
    for _ in range(rounds):
        if now.where("not done").isEmpty():
            break
        now = staged(_round(long, now, keys, k, f, tol, fan), "hmm-theta")
    return small.union(now.select(*keys, "theta", "loglik", "rounds"))


def _products(chunks: DataFrame, theta: DataFrame, keys: list[str], k: int, f: int, best: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            (x, here), m, first = _padded(pdf, f), Model(_stacked(pdf["theta"]), k, f), pdf["first"].to_numpy(bool)
            log_b = m.log_density(x)
            with np.errstate(divide="ignore"):
                p = best_products(log_b, np.log(m.move), first, here) if best else products(scaled(log_b)[0], m.move, first, here)
            yield pdf[[*keys, "chunk"]].assign(p=list(p.reshape(len(p), -1)))

    rows = chunks.join(theta.select(*keys, "theta"), keys).select(*keys, "chunk", "first", "x", "theta")
    return staged(rows.mapInPandas(run, f"{_key_schema(chunks, keys)}, chunk long, p array<double>"), "hmm-products")


def _ends(theta: DataFrame, keys: list[str], k: int) -> DataFrame:
    return theta.select(*keys, F.slice("theta", 1, k).alias("before"), F.array_repeat(F.lit(1.0), k).alias("after"))


def _round(chunks: DataFrame, now: DataFrame, keys: list[str], k: int, f: int, tol: float, fan: int) -> DataFrame:
    open_ = now.where("not done").select(*keys, "theta")
    context = carried(_products(chunks, open_, keys, k, f, False), _ends(open_, keys, k), keys, k, False, fan)
    rows = chunks.join(open_, keys).join(context, [*keys, "chunk"]).select(*keys, "first", "x", "theta", "before", "after")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            (x, here), m = _padded(pdf, f), Model(_stacked(pdf["theta"]), k, f)
            b, top = scaled(m.log_density(x))
            sums = expectations(x, b, top, m.move, _stacked(pdf["before"]), _stacked(pdf["after"]), pdf["first"].to_numpy(bool), here)
            # a key's chunks of a batch are added up before they move
            group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            total = np.zeros((group.max() + 1, sums.shape[1]))
            np.add.at(total, group, sums)
            yield pdf[keys].drop_duplicates().assign(sums=list(total))

    schema = _key_schema(chunks, keys)
    each = rows.mapInPandas(run, f"{schema}, sums array<double>")
    at = each.select(*keys, F.posexplode("sums").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    sums = at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda r: r["v"]).alias("sums"))

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches, 1024):
            theta, like = solved(_stacked(pdf["sums"]), _stacked(pdf["theta"]), k, f)
            yield pdf[keys].assign(theta=list(theta), loglik=like, rounds=pdf["rounds"] + 1, done=like - pdf["loglik"] < tol)

    out = f"{schema}, theta array<double>, loglik double, rounds int, done boolean"
    return now.where("not done").join(sums, keys).mapInPandas(update, out).union(now.where("done"))


def decode(chunks: DataFrame, theta: DataFrame, keys: Sequence[str], states: int, features: int, fan: int = FAN) -> DataFrame:
    """``keys, rn, state, probabilities``: the most likely path and the posterior of each row."""
    keys, k, f = list(keys), states, features
    theta = theta.select(*keys, "theta")
    schema = _key_schema(chunks, keys)
    context = carried(_products(chunks, theta, keys, k, f, False), _ends(theta, keys, k), keys, k, False, fan)
    log_ends = _ends(theta, keys, k).withColumn("before", F.transform("before", lambda v: F.when(v > 0, F.log(v)).otherwise(float("-inf"))))
    scores = carried(_products(chunks, theta, keys, k, f, True), log_ends, keys, k, True, fan)
    scores = scores.select(*keys, "chunk", F.col("before").alias("score"))

    def steps(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (x, here), m = _padded(pdf, f), Model(_stacked(pdf["theta"]), k, f)
        with np.errstate(divide="ignore"):
            back, d = best_steps(m.log_density(x), np.log(m.move), _stacked(pdf["score"]), pdf["first"].to_numpy(bool), here)
        return back, d, here

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            back, d, _ = steps(pdf)
            at = np.tile(np.arange(k), (len(pdf), 1))
            for t in range(back.shape[1] - 1, -1, -1):
                at = np.take_along_axis(back[:, t], at, 1)
            p = (at[:, None, :] == np.arange(k)[:, None]).astype(float)
            yield pdf[[*keys, "chunk"]].assign(p=list(p.reshape(len(p), -1)), score=list(d))

    rows = chunks.join(theta, keys).join(scores, [*keys, "chunk"]).select(*keys, "chunk", "first", "x", "theta", "score")
    mapped = staged(rows.mapInPandas(maps, f"{schema}, chunk long, p array<double>, score array<double>"), "hmm-maps")
    last = mapped.groupBy(*keys).agg(F.max_by("score", "chunk").alias("s"))
    place = F.array_position("s", F.array_max("s")) - 1
    ends = last.select(
        *keys, F.array_repeat(F.lit(1.0), k).alias("before"),
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == place).cast("double")).alias("after"),
    )
    exits = carried(mapped.select(*keys, "chunk", "p"), ends, keys, k, False, fan).select(*keys, "chunk", F.col("after").alias("exit"))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            back, _, here = steps(pdf)
            (x, _), m, first = _padded(pdf, f), Model(_stacked(pdf["theta"]), k, f), pdf["first"].to_numpy(bool)
            b, _ = scaled(m.log_density(x))
            g = posteriors(forward(b, m.move, _stacked(pdf["before"]), first, here)[0], backward(b, m.move, _stacked(pdf["after"]), here), here)
            at, path = _stacked(pdf["exit"]).argmax(1), np.zeros(here.shape, int)
            for t in range(here.shape[1] - 1, -1, -1):
                path[:, t] = at
                at = np.take_along_axis(back[:, t], at[:, None], 1)[:, 0]
            n = here.sum(1)
            out = pdf[keys].loc[np.repeat(np.arange(len(pdf)), n)].reset_index(drop=True)
            yield out.assign(rn=np.concatenate(pdf["rn"].tolist()), state=path[here].astype(np.int32), probabilities=list(g[here]))

    full = chunks.join(theta, keys).join(scores, [*keys, "chunk"]).join(context, [*keys, "chunk"]).join(exits, [*keys, "chunk"])
    full = full.select(*keys, "rn", "x", "first", "theta", "score", "before", "after", "exit")
    return full.mapInPandas(rows_of, f"{schema}, rn long, state int, probabilities array<double>")


# market states ----------------------------------------------------------------------------------------------------


def _labels(states: int, features: int, ret: int, vol: int):
    """Column with the label of each state: most volatile, then by mean return; from mean and deviation of the features."""
    base = states + states * states

    def at(s: int, feature: int):
        return F.element_at("theta", base + s * features + feature + 1) * F.element_at("std", feature + 1) + F.element_at("mean", feature + 1)

    info = F.array(*[F.struct(at(s, vol).alias("v"), (-F.lit(s)).alias("o"), F.lit(s).alias("s")) for s in range(states)])
    loud = F.array_max(info)["s"]
    by_return = F.array_sort(F.filter(F.array(*[F.struct((-at(s, ret)).alias("r"), F.lit(s).alias("s")) for s in range(states)]), lambda x: x["s"] != loud))

    def label(s):
        place = F.array_position(F.transform(by_return, lambda x: x["s"]), s)
        return F.when(s == loud, "high_vol").when(place == 1, "bull").when(place == states - 1, "bear").otherwise("sideways")

    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), label)


def market_states(
    rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("symbol",), states: int = 4, ret: str = "ret5", vol: str = "vol20",
    least_rows: int = 60, rounds: int = 200, tol: float = 1e-4, chunk_rows: int = CHUNK, fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """The states of each row and the fitted model of each key (keys with fewer than ``least_rows`` whole rows are left out).

    First: ``keys, rn, state, regime, confidence, probabilities``; confidence is the posterior of the state on the best path.
    Second: ``keys, theta, labels, loglik, rounds, n``.
    """
    keys, f = list(keys), len(features)
    i, j = list(features).index(ret), list(features).index(vol)
    enough = rows.dropna(subset=list(features)).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    chunks = staged(packed(rows.join(enough.select(*keys), keys), features, keys, chunk_rows), "hmm-chunks")
    theta = staged(fit(chunks, keys, states, f, initial(states, f, i, j), rounds, tol, fan), "hmm-models")
    about = chunks.where("first").select(*keys, "mean", "std")
    models = theta.join(about, keys).join(enough, keys).select(*keys, "theta", _labels(states, f, i, j).alias("labels"), "loglik", "rounds", "n")
    found = decode(chunks, theta, keys, states, f, fan).join(models.select(*keys, "labels"), keys)
    at = F.col("state") + 1
    return found.select(
        *keys, "rn", "state", F.element_at("labels", at).alias("regime"), F.element_at("probabilities", at).alias("confidence"), "probabilities"
    ), models


def current_states(found: DataFrame, models: DataFrame, keys: Sequence[str] = ("symbol",), states: int = 4, recent: int = 20) -> DataFrame:
    """Per key: the present regime with its confidence, the transition row from its state, the posteriors, the share of each
    regime over all rows and the number of changes among the last ``recent`` rows; maps are by label."""
    from barloom.operators.forecast import last_rows

    keys = list(keys)
    last = found.groupBy(*keys).agg(F.max_by(F.struct("state", "regime", "confidence", "probabilities"), "rn").alias("l"), F.max("rn").alias("rn"))
    share = found.groupBy(*keys, "regime").agg(F.count("*").alias("c"))
    share = share.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("regime", "c"))).alias("c"), F.sum("c").alias("n_rows"))
    tail = last_rows(found.select(*keys, "rn", "state"), recent, keys)
    path = tail.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "state"))), lambda r: r["state"]).alias("p"))
    moved = F.size(F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i) != F.get("p", i - 1)))
    path = path.select(*keys, F.when(F.size("p") > 1, moved).otherwise(0).cast("long").alias("regime_changes"))
    row = F.slice("theta", F.lit(states + 1) + F.col("l.state") * states, states)
    return last.join(models, keys).join(share, keys).join(path, keys).select(
        *keys, "rn", F.col("l.regime").alias("regime"), F.col("l.confidence").alias("confidence"),
        F.map_from_arrays("labels", row).alias("transition"), F.map_from_arrays("labels", "l.probabilities").alias("probabilities"),
        F.map_from_arrays("labels", F.transform("labels", lambda s: F.coalesce(F.try_element_at("c", s), F.lit(0)) / F.col("n_rows"))).alias("distribution"),
        "regime_changes", "loglik", "rounds", "n_rows",
    )
