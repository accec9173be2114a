"""Fixed-length sequences of past rows, as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import block_panel


def forecast_sequences(
    panel: DataFrame, features: Sequence[str], target: str, length: int, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """(keys, time, x, y): ``x`` holds the ``length`` rows before the row, ``y`` its own target.

    Needs ``rn``. Sequences never cross keys; rows with a shorter history are left out.
    """
    w = block_panel(panel, keys, back=length)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    past = F.collect_list(vector).over(w.line.rowsBetween(-length, -1))
    done = w.with_df(w.df.withColumn("x", past)).own_rows()
    return done.where(F.size("x") == length).select(*keys, "time", "x", F.col(target).alias("y"))


def padded_tail(
    panel: DataFrame, features: Sequence[str], length: int, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The last ``length`` rows per key, zero rows in front if there are fewer.

    The cut uses the key's row count, so only the tail rows are shuffled and gathered.
    """
    n = panel.groupBy(*keys).agg(F.max("rn").alias("__n"))
    tail = panel.join(n, list(keys)).where(F.col("rn") > F.col("__n") - length)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = tail.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", vector.alias("v")))).alias("__s"))
    zero = F.array(*[F.lit(0.0) for _ in features])
    values = F.transform("__s", lambda s: s["v"])
    pad = F.array_repeat(zero, F.lit(length) - F.size("__s"))
    return rows.select(*keys, F.concat(pad, values).alias("x"))
