"""Forecast and strategy metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import magnitude_bucket, same_sign, sdiv
from barloom.operators.layout import carry_scan
from barloom.operators.ranks import quantiles_large_groups, rank_correlation

Y, P = "y_true", "y_pred"


def finite_pairs(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    ok = F.lit(True)
    for c in (y, p):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return df.where(ok)


def error_metrics(y: str = Y, p: str = P) -> dict[str, Column]:
    yc, pc = F.col(y), F.col(p)
    e = yc - pc
    n = F.count(F.lit(1))
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "smape": 100.0 * F.avg(2.0 * F.abs(e) / (F.abs(yc) + F.abs(pc) + 1e-8)),
        "r2": 1.0 - F.sum(e * e) / (n * F.var_pop(yc) + 1e-10),
        "directional_accuracy": F.avg(same_sign(yc, pc).cast("double")),
        "n_samples": n,
    }


def prediction_metrics(df: DataFrame, groups: Sequence[str], y: str = Y, p: str = P) -> DataFrame:
    """Errors, hit rate and rank correlation per group of any size."""
    rows = finite_pairs(df, y, p)
    m = error_metrics(y, p)
    flat = rows.groupBy(*groups).agg(*[c.alias(k) for k, c in m.items()])
    ic = rank_correlation(rows, groups, y, p).select(*groups, "ic")
    return flat.join(ic, list(groups))


def ic_by_stride(df: DataFrame, groups: Sequence[str], horizon: int, rn: str, y: str = Y, p: str = P) -> DataFrame:
    """Rank correlation on every ``horizon``-th row, all rows if fewer than 5 would remain."""
    rows = finite_pairs(df, y, p)
    picked = rows.where((F.col(rn) - 1) % max(1, horizon) == 0)
    strided = rank_correlation(picked, groups, y, p, "ic_s").withColumnRenamed("n", "n_s")
    whole = rank_correlation(rows, groups, y, p, "ic_a").withColumnRenamed("n", "n_samples")
    both = whole.join(strided, list(groups), "left")
    enough = F.coalesce(F.col("n_s"), F.lit(0)) >= 5
    return both.select(
        *groups,
        F.coalesce(F.when(enough, F.col("ic_s")).otherwise(F.col("ic_a")), F.lit(0.0)).alias("ic"),
        F.coalesce("n_s", F.lit(0)).alias("n_independent"),
        "n_samples",
    )


def equity_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, returns: Sequence[str]
) -> DataFrame:
    """``curve_r`` = running product of (1 + r) and ``peak_r`` = its running maximum, per return r.

    One pass: inside a chunk the product starts at 1; the chunk summary holds its end, maximum and
    minimum; the prefix over chunk summaries scales them. A product that turns negative (a loss
    of more than 100 %) swaps maximum and minimum, hence both are kept.
    """
    keys, order = list(keys), list(order)
    inner = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def product(parts: tuple[Column, Column, Column]) -> Column:
        logs, negatives, zeros = parts
        sign = F.when(zeros > 0, 0.0).when(negatives % 2 == 1, -1.0).otherwise(1.0)
        return sign * F.exp(logs)

    def parts(r: str) -> tuple[Column, Column, Column]:
        g = 1.0 + F.col(r)
        size = F.when(g == 0, F.lit(0.0)).otherwise(F.log(F.abs(g)))
        return size, (g < 0).cast("long"), (g == 0).cast("long")

    local = df.select("*", chunk.alias("__chunk")).select(
        "*", *[product(tuple(F.sum(p).over(inner) for p in parts(r))).alias(f"__l_{r}") for r in returns]
    )
    local = local.select("*", *[F.max(f"__l_{r}").over(inner).alias(f"__m_{r}") for r in returns],
                         *[F.min(f"__l_{r}").over(inner).alias(f"__n_{r}") for r in returns])
    sums = []
    for r in returns:
        sums += [F.sum(p).alias(f"__p{k}_{r}") for k, p in enumerate(parts(r))]
        sums += [F.max(f"__l_{r}").alias(f"__hi_{r}"), F.min(f"__l_{r}").alias(f"__lo_{r}")]
    summary = local.groupBy(*keys, "__chunk").agg(*sums)
    line = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = [
        product(tuple(F.coalesce(F.sum(f"__p{k}_{r}").over(line), F.lit(0)) for k in range(3))).alias(f"__s_{r}")
        for r in returns
    ]
    started = summary.select("*", *starts)

    def scaled(r: str, high: str, low: str) -> Column:
        return F.when(F.col(f"__s_{r}") >= 0, F.col(f"__s_{r}") * F.col(high)).otherwise(F.col(f"__s_{r}") * F.col(low))

    carried = started.select(
        *keys,
        "__chunk",
        *[f"__s_{r}" for r in returns],
        *[F.max(scaled(r, f"__hi_{r}", f"__lo_{r}")).over(line).alias(f"__b_{r}") for r in returns],
    )
    done = local.join(carried, [*keys, "__chunk"])
    return done.select(
        *df.columns,
        *[(F.col(f"__s_{r}") * F.col(f"__l_{r}")).alias(f"curve_{r}") for r in returns],
        *[F.greatest(F.col(f"__b_{r}"), scaled(r, f"__m_{r}", f"__n_{r}")).alias(f"peak_{r}") for r in returns],
    )


def strategy_returns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    cost: float = 0.001,
    bands: tuple[float, float] = (0.33, 0.67),
    band_groups: Sequence[str] | None = None,
    y: str = Y,
    p: str = P,
) -> DataFrame:
    """Long-only and long-short positions, turnover and net returns per row.

    Long-short bands are exact quantiles of the forecasts per ``band_groups`` (default ``keys``).
    """
    rows = finite_pairs(df, y, p)
    by = list(band_groups if band_groups is not None else keys)
    q = quantiles_large_groups(rows, by, p, {"__lo": bands[0], "__hi": bands[1]})
    rows = rows.join(q, by)
    rows = rows.select(
        *df.columns,
        F.when(F.col(p) > 0, 1.0).otherwise(0.0).alias("pos_long"),
        F.when(F.col(p) >= F.col("__hi"), 1.0).when(F.col(p) <= F.col("__lo"), -1.0).otherwise(0.0).alias("pos_ls"),
    )
    prev = {f"__prev_{s}": ("prev", F.col(f"pos_{s}")) for s in ("long", "ls")}
    rows = carry_scan(rows, keys, order, chunk, prev)
    for s in ("long", "ls"):
        rows = rows.withColumn(f"turn_{s}", F.abs(F.col(f"pos_{s}") - F.coalesce(f"__prev_{s}", F.lit(0.0))))
        rows = rows.withColumn(f"ret_{s}", F.col(f"pos_{s}") * F.col(y) - F.col(f"turn_{s}") * cost)
    return rows.drop("__prev_long", "__prev_ls")


def portfolio_returns(rows: DataFrame, groups: Sequence[str], time: str = "time") -> DataFrame:
    """Equal-weight mean over symbols per time: one row per (group, time)."""
    cols = [c for s in ("long", "ls") for c in (f"ret_{s}", f"turn_{s}")]
    return rows.groupBy(*groups, time).agg(*[F.avg(c).alias(c) for c in cols])


def performance(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    horizon: int = 1,
    sides: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Sharpe, Sortino, Calmar, drawdown, annual return and turnover per key with 10 rows or more.

    ``sides`` maps a column prefix to (return, turnover) columns; all sides share one scan.
    """
    sides = sides or {"": ("ret_long", "turn_long"), "ls_": ("ret_ls", "turn_ls")}
    per_year = 252 / max(1, horizon)
    scale = math.sqrt(per_year)
    curve = equity_scan(df, keys, order, chunk, [r for r, _ in sides.values()])
    aggs = [F.count(F.lit(1)).alias("n")]
    for r, turn in sides.values():
        x, peak = F.col(r), F.col(f"peak_{r}")
        aggs += [
            F.avg(x).alias(f"mean_{r}"),
            F.stddev_pop(x).alias(f"std_{r}"),
            F.stddev_pop(F.when(x < 0, x)).alias(f"down_{r}"),
            F.min((F.col(f"curve_{r}") - peak) / (peak + 1e-10)).alias(f"mdd_{r}"),
            F.avg(turn).alias(f"turn_{r}"),
        ]
    agg = curve.groupBy(*keys).agg(*aggs).where("n >= 10")
    out = []
    for prefix, (r, _) in sides.items():
        mean, mdd = F.col(f"mean_{r}"), F.col(f"mdd_{r}")
        annual = mean * per_year

        def over(d: Column, mean: Column = mean) -> Column:
            return F.when(d > 1e-18, mean / d * scale).otherwise(F.lit(0.0))

        named = {
            "sharpe": over(F.col(f"std_{r}")),
            "sortino": over(F.col(f"down_{r}")),
            "calmar": F.when(F.abs(mdd) > 1e-6, annual / F.abs(mdd)).otherwise(F.lit(0.0)),
            "max_drawdown": mdd,
            "annual_return": annual,
            "turnover": F.col(f"turn_{r}"),
        }
        out += [c.alias(prefix + k) for k, c in named.items()]
    return agg.select(*keys, *out)


def ic_sharpe(ic: Column | str, window: int = 63) -> Column:
    c = F.col(ic) if isinstance(ic, str) else ic
    ok = (F.count(c) >= 2) & (F.stddev_pop(c) >= 1e-10)
    return F.when(ok, F.avg(c) / F.stddev_pop(c) * math.sqrt(252 / window))


def fold_summary(fold_ics: DataFrame, groups: Sequence[str], ic: str = "ic", window: int = 63) -> DataFrame:
    """Mean IC, stability, IC Sharpe and hit rate over folds."""
    return fold_ics.groupBy(*groups).agg(
        F.avg(ic).alias("mean_ic"),
        F.stddev_pop(ic).alias("ic_stability"),
        ic_sharpe(ic, window).alias("ic_sharpe"),
        F.avg((F.col(ic) > 0).cast("double")).alias("hit_rate"),
        F.count(ic).alias("n_folds"),
    )


def inverse_error_weights(errors: DataFrame, groups: Sequence[str], error: str = "rmse") -> DataFrame:
    """Weights proportional to 1/error; one row per model, so the window is tiny."""
    inv = sdiv(1.0, F.col(error))
    w = Window.partitionBy(*groups)
    return errors.withColumn("weight", F.bround(inv / F.sum(inv).over(w), 4))


def weighted_ensemble(preds: DataFrame, weights: DataFrame, keys: Sequence[str], on: Sequence[str] = ("model",)) -> DataFrame:
    """Sum of w*p over the models present, renormalised; the plain mean without any weight."""
    j = preds.join(weights, list(on), "left")
    w = F.coalesce(F.col("weight"), F.lit(0.0))
    total = F.sum(w)
    return j.groupBy(*keys).agg(
        F.when(total > 0, F.sum(w * F.col(P)) / total).otherwise(F.avg(P)).alias("ensemble"),
        F.count(F.lit(1)).alias("n_models"),
    )


def scale_on_train(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Standardise with mean and population std of the train rows only (one aggregate row)."""
    train = F.col(split) == "train"
    stats = df.agg(
        *[f(F.when(train, F.col(c))).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    one = stats.select(F.struct("*").alias("z"))
    z = one.scalar()
    scaled = [
        ((F.col(c) - z[f"m_{c}"]) / F.when(z[f"s_{c}"] > 0, z[f"s_{c}"]).otherwise(F.lit(1.0))).alias(c) for c in features
    ]
    return df.select(*[c for c in df.columns if c not in features], *scaled)


def pinball(y: Column, q: Column, level: float) -> Column:
    e = y - q
    return F.greatest((level - 1) * e, level * e)


def quantile_losses(df: DataFrame, groups: Sequence[str], y: str, quantiles: dict[str, float]) -> DataFrame:
    """Mean pinball loss over all quantiles and the mean width between the 10 % and 90 % ones."""
    total = F.lit(0.0)
    for c, level in quantiles.items():
        total = total + pinball(F.col(y), F.col(c), level)
    by_level = {v: k for k, v in quantiles.items()}
    width = F.col(by_level[0.9]) - F.col(by_level[0.1])
    return df.groupBy(*groups).agg(
        F.avg(total / len(quantiles)).alias("pinball"), F.avg(width).alias("interval_width"), F.count(F.lit(1)).alias("n")
    )


def huber(y: Column | str, p: Column | str, delta: float = 0.01) -> Column:
    e = F.abs((F.col(y) if isinstance(y, str) else y) - (F.col(p) if isinstance(p, str) else p))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def bootstrap_rank_correlation(
    df: DataFrame, groups: Sequence[str], row: str, replicas: int = 200, y: str = Y, p: str = P, level: float = 0.9
) -> DataFrame:
    """Rank-correlation interval from resampling rows with replacement.

    Each row enters a replica k times, k drawn from Poisson(1) by a hash of (row, replica): the
    distributed form of the bootstrap. A row holds its counts of all replicas as one vector, so neither
    copies nor replicas are materialised as rows; ranks use the counts.
    """
    g = list(groups)
    rows = finite_pairs(df, y, p)
    rows = rows.dropna(subset=g) if g else rows
    hashes = F.transform(F.sequence(F.lit(1), F.lit(replicas)), lambda r: F.xxhash64(*g, row, r))
    sides = {"__y": y, "__p": p}
    wide = rows.select(*g, *[F.col(c).cast("double").alias(n) for n, c in sides.items()], hashes.alias("__k"))
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.schema[: len(g)])
    drawn = wide.mapInArrow(_poisson_counts(replicas), f"{names}__y double, __p double, __k binary")
    both = drawn
    for n in sides:
        both = both.join(_replica_ranks(drawn, wide, g, n, names, replicas).withColumnRenamed("__r", f"{n}r"), [*g, n])
    sums = both.select(*g, "__k", "__yr", "__pr").mapInPandas(
        _replica_products(g, replicas), f"{names}replica int, n long, yy double, pp double, yp double"
    )
    total = sums.groupBy(*g, "replica").agg(*[F.sum(c).alias(c) for c in ("n", "yy", "pp", "yp")]).where("n > 0")
    ics = total.select(*g, F.try_divide("yp", F.sqrt(F.col("yy") * F.col("pp"))).alias("ic"))
    tail = (1 - level) / 2
    return ics.groupBy(*groups).agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_pop("ic").alias("ic_std"),
        F.percentile("ic", F.lit(tail)).alias("ic_low"),
        F.percentile("ic", F.lit(1 - tail)).alias("ic_high"),
        F.count("ic").alias("n_replicas"),
    )


def _poisson_counts(replicas: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the last column to Poisson(1) counts, a byte each."""
    steps, acc, prob = [], 0.0, math.exp(-1)
    for i in range(18):  # what is left of the tail is below the resolution of ``u``
        acc += prob
        steps.append(acc)
        prob /= i + 1

    def run(batches):
        for batch in batches:
            h = batch.column("__k").flatten().to_numpy(zero_copy_only=False).astype("int64").view("uint64")
            u = (h >> np.uint64(11)) / float(1 << 53)
            k = np.searchsorted(steps, u, side="right").astype("uint8").reshape(-1, replicas)
            arrays = [*batch.columns[:-1], pa.array([x.tobytes() for x in k], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return run


def _vectors(column: pd.Series, kind: str, replicas: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, replicas)


def _sums_by(codes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first row of each code, in the order of the codes, and the sum of its vectors."""
    order = np.argsort(codes, kind="stable")
    _, starts = np.unique(codes[order], return_index=True)
    return order[starts], np.add.reduceat(vectors[order], starts, axis=0, dtype="int64")


def _replica_ranks(drawn: DataFrame, wide: DataFrame, g: list[str], value: str, names: str, replicas: int, size: int = 4096) -> DataFrame:
    """(groups, value, __r): per replica twice the distance of the value's average rank from the mean rank, a vector of longs.

    Equal values collapse before the shuffle. The value axis is cut into magnitude buckets and these into blocks of about
    ``size`` rows; counts are carried over the blocks, so no task holds a group.
    """
    counts = wide.groupBy(*g, magnitude_bucket(value).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    line = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(*g, "__b", F.floor(F.coalesce(F.sum("__n").over(line), F.lit(0)) / size).alias("__block"))

    def collapse(batches):
        for pdf in batches:
            if len(pdf):
                codes = pdf.groupby([*g, value], sort=False, dropna=False).ngroup().to_numpy()
                first, k = _sums_by(codes, _vectors(pdf["__k"], "uint8", replicas))
                yield pdf.iloc[first][[*g, value]].assign(__k=[x.astype("int32").tobytes() for x in k])

    parts = drawn.select(*g, value, "__k").mapInPandas(collapse, f"{names}{value} double, __k binary")
    parts = parts.withColumn("__b", magnitude_bucket(value)).join(blocks, [*g, "__b"]).drop("__b")

    def totals(pdf):
        k = _vectors(pdf["__k"], "int32", replicas).sum(axis=0, dtype="int64")
        head = pdf.iloc[[0] * replicas][[*g, "__block"]].reset_index(drop=True)
        return head.assign(replica=np.arange(replicas, dtype="int32"), n=k)

    by = [*g, "__block"]
    steps = parts.groupBy(*by).applyInPandas(totals, f"{names}__block long, replica int, n long")
    every = Window.partitionBy(*g, "replica")
    below = F.coalesce(F.sum("n").over(every.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select(*by, "replica", below.alias("below"), F.sum("n").over(every).alias("n"))

    def rank(pdf, offsets):
        offsets = offsets.sort_values("replica")
        first, k = _sums_by(pdf[value].to_numpy(), _vectors(pdf["__k"], "int32", replicas))
        twice = 2 * (offsets["below"].to_numpy() + np.cumsum(k, axis=0)) - k - offsets["n"].to_numpy()
        return pdf.iloc[first][[*g, value]].assign(__r=[x.tobytes() for x in twice])

    return parts.groupBy(*by).cogroup(steps.groupBy(*by)).applyInPandas(rank, f"{names}{value} double, __r binary")


def _replica_products(g: list[str], replicas: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per group and replica the number of draws, and sums of squares and products of the centred ranks."""

    def run(batches):
        for batch in batches:
            for _, pdf in batch.groupby(g, sort=False, dropna=False) if g else [((), batch)]:
                k = _vectors(pdf["__k"], "uint8", replicas).astype("float64")
                a, b = (_vectors(pdf[c], "int64", replicas).astype("float64") for c in ("__yr", "__pr"))
                head = pdf.iloc[[0] * replicas][g].reset_index(drop=True)
                yield head.assign(
                    replica=np.arange(replicas, dtype="int32"), n=k.sum(axis=0).astype("int64"),
                    yy=(k * a * a).sum(axis=0), pp=(k * b * b).sum(axis=0), yp=(k * a * b).sum(axis=0),
                )

    return run


def by_level(df: DataFrame, levels: dict[str, str | None], extra: Sequence[str]) -> DataFrame:
    """Stack the rows once per evaluation level (universal, sector, ...), labelled.

    Used with grouped metrics that are not plain aggregates; plain aggregates use grouping sets.
    """
    tags = F.array(
        *[
            F.struct(F.lit(lv).alias("level"), (F.col(c) if c else F.lit("all")).alias("member"))
            for lv, c in levels.items()
        ]
    )
    return df.select(*extra, F.inline(tags))


def rollup_metrics(df: DataFrame, dims: Sequence[str], y: str = Y, p: str = P) -> DataFrame:
    """Error metrics for every prefix of ``dims`` in one pass (rollup)."""
    m = error_metrics(y, p)
    return finite_pairs(df, y, p).rollup(*dims).agg(*[c.alias(k) for k, c in m.items()])
