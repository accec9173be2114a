"""Comparisons across the symbols of one time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ranks import centred_rank, centred_zscore

RANKED = (
    "return_1d", "return_5d", "return_20d", "rsi_14", "volume_ratio", "momentum_accel", "volatility_5d", "adx",
    "bb_position",
)


def add_ranks(df: DataFrame, features: Sequence[str] = RANKED, minimum: int = 5, time: str = "time") -> DataFrame:
    """``cs_rank_f`` in [-0.5, 0.5] and ``cs_zscore_f`` per feature.

    A group is one time, bounded by the number of symbols. One shuffle by time serves all ranks.
    """
    present = [f for f in features if f in df.columns]
    ranks = [centred_rank(f, [time], minimum).alias(f"cs_rank_{f}") for f in present]
    scores = [centred_zscore(f, [time], minimum).alias(f"cs_zscore_{f}") for f in present]
    return df.select("*", *ranks, *scores)


def add_target_ranks(
    df: DataFrame, horizons: Sequence[int] = (1, 5, 10, 20), minimum: int = 5, time: str = "time", fill: bool = False
) -> DataFrame:
    cols = [centred_rank(f"target_{h}", [time], minimum) for h in horizons]
    if fill:
        cols = [F.coalesce(c, F.lit(0.0)) for c in cols]
    return df.select("*", *[c.alias(f"target_cs_rank_{h}") for c, h in zip(cols, horizons, strict=True)])


def long_short(df: DataFrame, score: str, n: int = 3, time: str = "time", tie: str = "symbol") -> DataFrame:
    """The ``n`` best (side 1) and ``n`` worst (side -1) symbols of each time."""
    rows = df.where(F.col(score).isNotNull())
    top = F.row_number().over(Window.partitionBy(time).orderBy(F.col(score).desc(), tie))
    low = F.row_number().over(Window.partitionBy(time).orderBy(F.col(score).asc(), F.col(tie).desc()))
    side = F.when(F.col("__top") <= n, 1).when(F.col("__low") <= n, -1)
    return (
        rows.select("*", top.alias("__top"), low.alias("__low"))
        .where((F.col("__top") <= n) | (F.col("__low") <= n))
        .select(*df.columns, side.cast("int").alias("side"))
    )


def with_sector(df: DataFrame, sectors: DataFrame, default: str = "other") -> DataFrame:
    """Sector lookup; the optimizer broadcasts the dimension while its measured size allows."""
    return df.join(sectors, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def only_members(df: DataFrame, members: DataFrame, key: str, invert: bool = False) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_anti" if invert else "left_semi")
