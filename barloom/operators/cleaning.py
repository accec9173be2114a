"""Cleaning of raw bars: types, missing values, duplicates, fills, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite, to_number
from barloom.operators.layout import carry_scan, chunk_of

OHLC = ("open", "high", "low", "close")


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text and other types to double; what is not a finite number becomes NULL."""
    return df.select(*[to_number(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def null_non_finite(df: DataFrame) -> DataFrame:
    return df.select(*[finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def drop_empty_bars(df: DataFrame, columns: Sequence[str] = OHLC) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def drop_partial_bars(df: DataFrame, columns: Sequence[str] = OHLC) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))


def keep_last_arrival(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One row per key: the one that arrived last.

    Written as an aggregate, not as ``row_number``: copies collapse before the shuffle, so a key
    with very many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*arrival)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*").select(*df.columns)


def forward_fill(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Last known value along ``order``; the look-back is unbounded, the chunks are carried."""
    return _fill(df, columns, keys, order, chunk, "last")


def backward_fill(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], chunk: Column
) -> DataFrame:
    """Next known value. It looks ahead in time: never use it for model inputs."""
    return _fill(df, columns, keys, order, chunk, "next")


def _fill(df, columns, keys, order, chunk, how) -> DataFrame:
    scans = {f"__f_{c}": (how, F.col(c)) for c in columns}
    out = carry_scan(df, keys, order, chunk, scans)
    return out.select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def positive_price(df: DataFrame, column: str = "close") -> DataFrame:
    return df.where(F.col(column) > 0)


def clean_bars(
    raw: DataFrame,
    arrival: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    chunk_seconds: int = 16384 * 86400,
) -> DataFrame:
    """Order of steps: coerce, dedup per (key, time), drop empty, forward fill, drop partial.

    Dedup comes before the fill so that a replaced row never leaks its values forward.
    """
    df = coerce_numbers(raw, [*OHLC, "volume"])
    df = keep_last_arrival(df, [*keys, "time"], arrival)
    df = drop_empty_bars(df)
    df = forward_fill(df, OHLC, keys, ["time"], chunk_of("time", chunk_seconds))
    return fill_zero(drop_partial_bars(df), ["volume"])


def enough_history(df: DataFrame, minimum: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Keep keys with at least ``minimum`` rows. Counting is map-side combined; the key list joins
    as a semi join, so rows need no window over a whole key."""
    long_enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum)
    return df.join(long_enough.select(*keys), list(keys), "left_semi")


def drop_warm_up(df: DataFrame, markers: Sequence[str] = ("close_to_sma_200", "close_to_ema_200", "adx")) -> DataFrame:
    """Drop rows before the first present marker column is defined."""
    for m in markers:
        if m in df.columns:
            return df.where(F.col(m).isNotNull())
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long report (column, rows, nulls, null_ratio, all_null) from one aggregate row."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot(["rows"], list(columns), "column", "present")
    nulls = F.col("rows") - F.col("present")
    return long.select(
        "column",
        "rows",
        nulls.alias("nulls"),
        F.try_divide(nulls.cast("double"), F.col("rows").cast("double")).alias("null_ratio"),
        (F.col("present") == 0).cast("int").alias("all_null"),
    )


def drop_all_null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reads one aggregate row to the driver, never data rows."""
    present = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if present[c] == 0])


def null_ratio_gate(df: DataFrame, columns: Sequence[str], warn: float = 0.5, reject: float = 0.9) -> DataFrame:
    """Mean null ratio of ``columns`` with the verdict ``ok``, ``warn`` or ``reject``."""
    share = sum((F.avg(F.col(c).isNull().cast("double")) for c in columns[1:]), F.avg(F.col(columns[0]).isNull().cast("double")))
    return df.agg((share / len(columns)).alias("null_ratio")).select(
        "null_ratio",
        F.when(F.col("null_ratio") > reject, "reject")
        .when(F.col("null_ratio") > warn, "warn")
        .otherwise("ok")
        .alias("verdict"),
    )


def utc_time(c: Column | str, zone: str | None = None) -> Column:
    """Text or timestamp to a UTC instant; ``zone`` names the zone of zone-less local times."""
    x = F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)
    return F.to_utc_timestamp(x, zone) if zone else x


def align_to_list(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Exactly ``keep`` and ``features`` in order: missing ones are 0.0, extra ones are dropped."""
    have = set(df.columns)
    cols = [
        (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in features
    ]
    return df.select(*keep, *cols)


def symbol_codes(symbols: DataFrame) -> DataFrame:
    """Dimension (symbol, symbol_encoded): position in the sorted symbol list.

    The window runs over the distinct symbols only.
    """
    d = symbols.select("symbol").distinct()
    return d.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("int").alias("symbol_encoded"))


def encode_symbols(df: DataFrame, codes: DataFrame) -> DataFrame:
    return df.join(codes, "symbol", "left").withColumn("symbol_encoded", F.coalesce("symbol_encoded", F.lit(-1)))


def hashed_symbol_code(symbol: Column | str, modulus: int = 1000) -> Column:
    """Fallback code: the 128-bit md5 number modulo ``modulus``, folded over four 32-bit digits."""
    digest = F.md5(F.col(symbol) if isinstance(symbol, str) else symbol)
    rest = F.lit(0).cast("long")
    for i in range(4):
        digit = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        rest = (rest * F.lit(2**32) + digit) % modulus
    return rest.cast("int")
