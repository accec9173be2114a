"""Option-chain summaries over (symbol, expiration, side, strike) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ("symbol", "expiration")


def chain_summary(chain: DataFrame, keys: Sequence[str] = CHAIN) -> DataFrame:
    call, put = F.col("side") == "call", F.col("side") == "put"

    def total(side: Column) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col("open_interest"))), F.lit(0))

    agg = chain.groupBy(*keys).agg(
        total(call).alias("total_call_oi"),
        total(put).alias("total_put_oi"),
        F.avg(F.when(call, F.col("implied_volatility"))).alias("call_iv_mean"),
        F.avg(F.when(put, F.col("implied_volatility"))).alias("put_iv_mean"),
    )
    ratio = F.bround(F.col("total_put_oi") / F.greatest(F.col("total_call_oi"), F.lit(1)), 3)
    return agg.withColumn("put_call_ratio", ratio)


def max_pain(chain: DataFrame, keys: Sequence[str] = CHAIN) -> DataFrame:
    """Strike with the smallest total payout; the lowest one on ties.

    Payouts per strike come from running sums in strike order, not from pairing strikes: the
    calls below a strike pay (K - s) fewer each, the puts above it likewise.
    """
    oi = F.col("open_interest").cast("double")
    rows = chain.groupBy(*keys, "strike").agg(
        F.sum(F.when(F.col("side") == "call", oi).otherwise(0.0)).alias("c"),
        F.sum(F.when(F.col("side") == "put", oi).otherwise(0.0)).alias("p"),
    )
    w = Window.partitionBy(*keys).orderBy("strike")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")

    def part(x: str, frame) -> tuple[Column, Column]:
        n = F.coalesce(F.sum(x).over(frame), F.lit(0.0))
        s = F.coalesce(F.sum(F.col(x) * k).over(frame), F.lit(0.0))
        return n, s

    cn, csum = part("c", above)
    pn, psum = part("p", below)
    pain = (csum - k * cn) + (k * pn - psum)
    priced = rows.select(*keys, "strike", pain.alias("pain"))
    return priced.groupBy(*keys).agg(
        F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain")
    )


def top_strikes(chain: DataFrame, n: int = 5, keys: Sequence[str] = CHAIN) -> DataFrame:
    w = Window.partitionBy(*keys, "side").orderBy(F.col("open_interest").desc(), "strike")
    return chain.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def target_expiration(chain: DataFrame, as_of: Column, days: int = 7, key: str = "symbol") -> DataFrame:
    """Nearest expiration at least ``days`` ahead, else the earliest one."""
    soon = F.datediff(F.to_date("expiration"), F.to_date(as_of)) < days
    return chain.groupBy(key).agg(F.min_by("expiration", F.struct(soon, "expiration")).alias("expiration"))


def first_expirations(chain: DataFrame, n: int = 8, key: str = "symbol") -> DataFrame:
    """The earliest ``n`` expirations as an ordered list; duplicates collapse before the window."""
    dates = chain.select(key, "expiration").distinct()
    w = Window.partitionBy(key).orderBy("expiration")
    return dates.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def risk_level(score: Column) -> Column:
    return (
        F.when(score < 10, "negligible").when(score < 20, "low").when(score < 30, "medium").when(score < 40, "high")
        .when(score.isNotNull(), "severe")
    )
