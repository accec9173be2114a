"""Windowed and deduplicating stream operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(
    ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes", seq: Sequence[str] = ("ts",),
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Tumbling OHLCV bars; a bar is emitted once the watermark has passed its end.

    Ticks later than ``delay`` are dropped and counted in the query's progress.
    """
    order = F.struct(*seq)
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), *keys)
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select(*keys, F.col("window.start").alias("time"), F.col("window.end").alias("bar_end"),
                "open", "high", "low", "close", "volume", "n_ticks")
    )


def distinct_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First event per key while the key is remembered: the state expires with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def latest_per_key(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as an update stream."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def active_at(stream: DataFrame, time: str, ttl_seconds: int, as_of: str) -> DataFrame:
    """Rows still valid at ``as_of``."""
    return stream.where(F.unix_seconds(time) + ttl_seconds > F.unix_seconds(F.lit(as_of).cast("timestamp")))
