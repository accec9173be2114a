"""Data-quality rules: accepted rows and rejected rows with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the request contract.
SYMBOL_PATTERN = r"^[A-Z0-9\-\.]{1,10}$"
PERIODS = ("1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "ytd", "max")
HORIZON_RANGE = (1, 60)


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the rules a row breaks. An unknown outcome breaks the rule."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("reasons", broken)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def request_rules(models: Sequence[str]) -> dict[str, Column]:
    lo, hi = HORIZON_RANGE
    return {
        "symbol": F.upper(F.trim("symbol")).rlike(SYMBOL_PATTERN),
        "period": F.col("period").isin(*PERIODS),
        "model": F.col("model").isin(*models),
        "horizon": F.col("horizon").between(lo, hi),
    }


def clamp_horizon(c: Column | str) -> Column:
    lo, hi = HORIZON_RANGE
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c) if isinstance(c, str) else c))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null ``column`` has no parent."""
    p = parents.select(F.col(parent_key).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(p, column, "left_anti")


def normalize_symbol(symbol: Column | str, aliases: dict[str, str]) -> Column:
    s = F.upper(F.trim(F.col(symbol) if isinstance(symbol, str) else symbol))
    if not aliases:
        return s
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), s)
