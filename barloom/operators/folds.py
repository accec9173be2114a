"""Linear models of all walk-forward folds from one pass over the rows.

A ridge or least-squares line needs the cross moments of its train rows only. The moments of the rows of each time are added up, and
running sums over the time axis are carried over it; the train part of a fold is then a difference of
running sums at its ends. Each fold is solved in a task from a matrix of the size of the feature list. However many folds there
are, the rows are read once to fit and once to forecast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan

#: Times in a chunk of the carried sums.
CHUNK = 1024


def running_moments(rows: DataFrame, axis: DataFrame, label: str, features: Sequence[str], time: str = "time") -> DataFrame:
    """``t, m``: for each time number, sums over all rows up to it of 1, the values and their products (label first)."""
    names = [label, *features]
    cells = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    products = [F.col(a).cast("double") * F.col(b).cast("double") for i, a in enumerate(names) for b in names[i:]]
    whole = rows.dropna(subset=names)
    numbered = axis.select(time, "t")
    each = whole.join(numbered, time).groupBy("t").agg(*[F.sum(c).alias(f"__m{k}") for k, c in enumerate([*cells, *products])])
    n = len(cells) + len(products)
    # times without rows count too, so that every end of a fold has its sums
    full = numbered.join(each, "t", "left")
    scans = {f"__r{k}": ("sum", F.coalesce(f"__m{k}", F.lit(0.0))) for k in range(n)}
    run = carry_scan(full, [], ["t"], F.floor(F.col("t") / CHUNK), scans)
    return run.select("t", F.array(*[f"__r{k}" for k in range(n)]).alias("m"))


def line_of(m: np.ndarray, n_features: int, ridge: float) -> tuple[int, float, list[float]]:
    """Rows, constant and slopes from sums of 1, values and products. The penalty is ``ridge`` times a feature's variance; a constant
    feature gets no slope."""
    k = n_features + 1
    n, mean = m[0], m[1 : 1 + k] / m[0]
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = m[1 + k :] / n
    full = full + np.triu(full, 1).T - np.outer(mean, mean)
    spread = np.diagonal(full)[1:]
    used = np.flatnonzero(spread > 1e-12 * (1 + mean[1:] ** 2))
    slope = np.zeros(n_features)
    if len(used):
        gram = full[1:, 1:][np.ix_(used, used)]
        slope[used] = np.linalg.lstsq(gram + ridge * np.diag(spread[used]), full[0, 1:][used], rcond=None)[0]
    return int(n), float(mean[0] - mean[1:] @ slope), slope.tolist()


def fold_lines(rows: DataFrame, axis: DataFrame, folds: DataFrame, label: str, features: Sequence[str], ridge: float = 0.01, time: str = "time") -> DataFrame:
    """``fold, n_train, const, slopes`` for each fold (``train_end``, and for folds that train on after the test part ``resume`` and ``n``)."""
    run = running_moments(rows, axis, label, features, time)

    def at(place: str) -> DataFrame:
        return run.select((F.col("t") + 1).alias(place), F.col("m").alias(f"__{place}"))

    cut = folds.join(at("train_end"), "train_end", "left")
    zero = F.array_repeat(F.lit(0.0), 1 + len(features) + 1 + (len(features) + 1) * (len(features) + 2) // 2)
    total = F.coalesce("__train_end", zero)
    if "resume" in folds.columns:
        cut = cut.join(at("resume"), "resume", "left").join(at("n"), "n", "left")
        later = F.zip_with(F.coalesce("__n", zero), F.coalesce("__resume", zero), lambda a, b: a - b)
        total = F.zip_with(total, later, lambda a, b: a + b)
    sums = cut.select("fold", total.alias("m"))
    k = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = [(f, np.asarray(m, float)) for f, m in zip(pdf["fold"], pdf["m"], strict=True) if m[0] > 0.5]
            yield pd.DataFrame([(f, *line_of(m, k, ridge)) for f, m in some], columns=["fold", "n_train", "const", "slopes"])

    return sums.mapInPandas(solve, "fold long, n_train long, const double, slopes array<double>")


def fold_forecasts(
    rows: DataFrame, axis: DataFrame, folds: DataFrame, label: str, features: Sequence[str], keep: Sequence[str], ridge: float = 0.01, time: str = "time"
) -> DataFrame:
    """``keep``, ``fold`` and ``y_pred`` of the test rows of each fold."""
    lines = fold_lines(rows, axis, folds, label, features, ridge, time)
    tested = folds.select("fold", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("t")).join(lines, "fold")
    numbered = rows.dropna(subset=list(features)).join(axis.select(time, "t"), time).join(tested, "t")
    terms = F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), "slopes", lambda x, b: x * b)
    return numbered.select(*keep, "fold", (F.col("const") + F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)).alias("y_pred"))
