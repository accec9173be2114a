"""Leakage-aware splits as labels on ordinals. No fold ever materialises its train rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan, chunk_of


def with_key_size(df: DataFrame, keys: Sequence[str] = ("symbol",), out: str = "n") -> DataFrame:
    """Row count per key from the largest ``rn``: a map-side combined aggregate and a join."""
    n = df.groupBy(*keys).agg(F.max("rn").alias(out))
    return df.join(n, list(keys))


def chronological_split(
    panel: DataFrame, train: float = 0.8, validation: float = 0.1, minimum: int = 50, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """``split`` per key by time: the test part starts at ``floor(train * n)``, the validation part
    is cut from the end of what precedes it. Keys with fewer than ``minimum`` rows are left out."""
    d = with_key_size(panel, keys).where(F.col("n") >= minimum)
    test_start = F.floor(F.col("n") * train)
    val_start = F.floor(test_start * (1 - validation / train))
    pos = F.col("rn") - 1
    label = F.when(pos >= test_start, "test").when(pos >= val_start, "val").otherwise("train")
    return d.select(*panel.columns, label.alias("split"))


def time_axis(df: DataFrame, time: str = "time", chunk_seconds: int = 30 * 86400) -> DataFrame:
    """Distinct times numbered from 0, with their count; numbers are carried over time chunks."""
    t = df.select(time).distinct()
    numbered = carry_scan(t, [], [time], chunk_of(time, chunk_seconds), {"rn": ("count", F.lit(1))})
    n = t.agg(F.count(F.lit(1))).scalar()
    return numbered.select(time, (F.col("rn") - 1).alias("t"), n.alias("n_times"))


def walk_forward_folds(axis: DataFrame, min_train: int = 500, window: int = 63, step: int | None = None, horizon: int = 1) -> DataFrame:
    """One row per fold: train is [0, train_end), test is [test_start, test_end) on the time axis."""
    step = step or window
    n = axis.agg(F.max("n_times").alias("n"))
    last = F.floor((F.col("n") - window - min_train) / step)
    folds = n.where(F.col("n") >= min_train + window).select("n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold"))
    start = F.lit(min_train) + F.col("fold") * step
    return folds.select(
        "fold", (start - horizon).alias("train_end"), start.alias("test_start"), (start + window).alias("test_end")
    ).where("train_end > 50")


def purged_folds(axis: DataFrame, n_splits: int = 5, horizon: int = 1, embargo: float = 0.01, expanding: bool = True) -> DataFrame:
    """Contiguous test folds. Train never comes within ``horizon`` before a test fold; unless
    ``expanding`` it also resumes after the test fold and an embargo."""
    n = axis.agg(F.max("n_times").alias("n"))
    size = F.floor(F.col("n") / n_splits)
    folds = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))).alias("fold"))
    start = F.col("fold") * size
    end = F.when(F.col("fold") < n_splits - 1, start + size).otherwise(F.col("n"))
    gap = F.greatest(F.lit(1).cast("long"), F.floor(size * embargo))
    rows = folds.select(
        "fold",
        F.greatest(F.lit(0).cast("long"), start - horizon).alias("train_end"),
        start.alias("test_start"),
        end.alias("test_end"),
        (F.col("n") if expanding else F.least(F.col("n"), end + gap)).alias("resume"),
        "n",
    )
    trained = F.col("train_end") + (F.col("n") - F.col("resume"))
    return rows.where((trained >= 50) & (F.col("test_end") - F.col("test_start") >= 10))


def fold_roles(axis: DataFrame, folds: DataFrame) -> DataFrame:
    """(time, t, fold, role) in long form, for fitting.

    Each fold lists the time numbers of its parts, which then meet the axis on an equality key.
    Both inputs hold one row per time or fold, never panel rows.
    """
    spans = [("train", F.lit(0).cast("long"), F.col("train_end")), ("test", F.col("test_start"), F.col("test_end"))]
    if "resume" in folds.columns:
        spans.append(("train", F.col("resume"), F.col("n")))
    parts = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.when(hi > lo, F.sequence(lo, hi - 1)).alias("ts"))
            for role, lo, hi in spans
        ]
    )
    listed = folds.select("fold", F.inline(parts)).select("fold", "role", F.explode("ts").alias("t"))
    return axis.join(listed, "t").select("time", "t", "fold", "role")


def test_fold_of(axis: DataFrame, folds: DataFrame, min_train: int, window: int, step: int) -> DataFrame:
    """(time, fold) for test rows only, by arithmetic and an equality join on the fold number."""
    first = F.floor((F.col("t") - min_train - window + 1) / step)
    cand = axis.select("time", "t", F.explode(F.sequence(first - 1, F.floor((F.col("t") - min_train) / step))).alias("fold"))
    return cand.join(folds, "fold").where("t >= test_start and t < test_end").select("time", "fold")


def stride(rn: Column | str, horizon: int) -> Column:
    """True on every ``horizon``-th row: the non-overlapping forward returns."""
    c = F.col(rn) if isinstance(rn, str) else rn
    return (c - 1) % max(1, horizon) == 0
