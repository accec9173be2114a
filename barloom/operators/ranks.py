"""Ranks, rank correlation and exact quantiles.

Inside small groups (the symbols of one time, the rows of one fold) windows do. For groups
without a size bound, :func:`value_ladder` counts equal values first, cuts the value axis into
buckets and carries counts over buckets, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import as_col, deviation, magnitude_bucket, safe_corr


def average_rank(x: Column | str, groups: Sequence[str | Column]) -> Column:
    """Rank from 1 with ties averaged; NULL for NULL. One window: the running count over the
    range frame is the rank of the last tie, ``rank`` that of the first."""
    v = as_col(x)
    w = Window.partitionBy(*groups).orderBy(v.asc_nulls_last())
    return F.when(v.isNotNull(), (F.rank().over(w) + F.count(v).over(w)) / 2.0)


def centred_rank(x: Column | str, groups: Sequence[str | Column], minimum: int = 5) -> Column:
    """Percent rank minus 0.5, NULL where fewer than ``minimum`` values are present."""
    n = F.count(as_col(x)).over(Window.partitionBy(*groups))
    return F.when(n >= minimum, average_rank(x, groups) / n - 0.5)


def centred_zscore(x: Column | str, groups: Sequence[str | Column], minimum: int = 5) -> Column:
    v = as_col(x)
    w = Window.partitionBy(*groups)
    z = F.try_divide(deviation(v, F.avg(v).over(w)), F.stddev_samp(v).over(w) + F.lit(1e-10))
    return F.when(F.count(v).over(w) >= minimum, z)


def value_ladder(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, copies, below, n): how often each value occurs and how many rows lie below.

    Equal values collapse on the map side. Buckets follow the magnitude of the value, a fixed
    rule, so the counting pass and the ranking pass always agree.
    """
    g = list(groups)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*g, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("__b", magnitude_bucket("value"))
    )
    line = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.groupBy(*g, "__b").agg(F.sum("copies").alias("__n"))
    base = steps.select(
        *g,
        "__b",
        F.coalesce(F.sum("__n").over(line), F.lit(0)).alias("__below"),
        F.sum("__n").over(Window.partitionBy(*g)).alias("n"),
    )
    inside = Window.partitionBy(*g, "__b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__below") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return counts.join(base, [*g, "__b"]).select(*g, "value", "copies", below.alias("below"), "n")


def rank_large_groups(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank inside groups of any size.

    A value shared by very many rows makes a skewed join key; the ladder side has one row for it,
    which is what adaptive skew joins split best.
    """
    ladder = value_ladder(df, groups, value).select(
        *groups, F.col("value").alias(value), (F.col("below") + (F.col("copies") + 1) / 2.0).alias(out)
    )
    return df.join(ladder, [*groups, value], "left")


def quantiles_large_groups(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per entry."""
    ladder = value_ladder(df, groups, value)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(p)
        for part, i in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("below") <= i) & (i < F.col("below") + F.col("copies"))
            cols.append(F.max(F.when(here, F.col("value"))).alias(f"__{name}_{part}"))
        cols.append(F.max(pos - F.floor(pos)).alias(f"__{name}_w"))
    picked = ladder.groupBy(*groups).agg(*cols)
    return picked.select(
        *groups,
        *[
            (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_w")).alias(n)
            for n in probs
        ],
    )


def rank_correlation(df: DataFrame, groups: Sequence[str], a: str, b: str, out: str = "ic") -> DataFrame:
    """Spearman correlation per group of any size (one row per group)."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, a, b)
    ranked = rank_large_groups(rank_large_groups(pairs, groups, a, "__ra"), groups, b, "__rb")
    return ranked.groupBy(*groups).agg(safe_corr("__ra", "__rb").alias(out), F.count(F.lit(1)).alias("n"))


def small_group_rank_correlation(
    df: DataFrame, groups: Sequence[str], a: str, b: str, minimum: int = 3, out: str = "ic"
) -> DataFrame:
    """Spearman per bounded group, e.g. across the symbols of one time; NULL below ``minimum``."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = pairs.select(*groups, average_rank(a, groups).alias("__ra"), average_rank(b, groups).alias("__rb"))
    n = F.count(F.lit(1))
    return ranked.groupBy(*groups).agg(F.when(n >= minimum, safe_corr("__ra", "__rb")).alias(out), n.alias("n"))
