"""Ticks to bars and bars to coarser bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bar interval used for each requested history period (fixed values).
INTERVAL_OF_PERIOD = {
    "1d": "5m",
    "5d": "15m",
    "1mo": "1h",
    "3mo": "1d",
    "6mo": "1d",
    "1y": "1d",
    "2y": "1d",
    "5y": "1wk",
    "10y": "1mo",
    "ytd": "1d",
    "max": "1mo",
}


def interval_of(period: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INTERVAL_OF_PERIOD.items() for x in kv])
    return F.coalesce(F.try_element_at(table, period), F.lit("1d"))


def bucket(time: str, interval: str) -> Column:
    """Start of the bar that holds ``time``; weeks start on Monday."""
    t = F.col(time)
    if interval == "1wk":
        return F.date_trunc("week", t)
    if interval == "1mo":
        return F.date_trunc("month", t)
    seconds = {"5m": 300, "15m": 900, "1h": 3600, "1d": 86400}[interval]
    return F.timestamp_seconds(F.floor(F.unix_seconds(t) / seconds) * seconds)


def bars_from_ticks(
    ticks: DataFrame, interval: str = "1h", seq: Sequence[str] = ("ts",), keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """OHLCV bars. Partial aggregation runs before the shuffle, so hot symbols stay small.

    ``seq`` orders the ticks uniquely; first and last tick of a bar are taken along it.
    """
    order = F.struct(*seq)
    return (
        ticks.groupBy(*keys, bucket("ts", interval).alias("time"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
    )


def coarser_bars(bars: DataFrame, interval: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys, bucket("time", interval).alias("__t")).agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("__t", "time")
