"""Macro series: alignment on one time axis, derived features, as-of joins onto panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import deviation, flag, ratio, sdiv
from barloom.operators.cleaning import backward_fill, forward_fill
from barloom.operators.layout import Blocks, block_panel, carry_scan, chunk_of, with_ordinal

YEAR = 365 * 86400

SERIES = ("vix", "sp500", "nasdaq", "russell2000", "yield_10y", "yield_3m", "tlt", "hyg", "dxy", "gold", "oil")


def pivot_series(long: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Full outer alignment of many (series, time, value) on time: one row per time."""
    return long.groupBy("time").pivot("series", list(series)).agg(F.first("value", ignorenulls=True))


def align_series(
    long: DataFrame, series: Sequence[str] = SERIES, back_fill: bool = False, chunk_seconds: int = YEAR
) -> DataFrame:
    """Aligned and forward filled. ``back_fill`` also fills the start from the future."""
    wide = forward_fill(pivot_series(long, series), series, [], ["time"], chunk_of("time", chunk_seconds))
    return backward_fill(wide, series, [], ["time"], chunk_of("time", chunk_seconds)) if back_fill else wide


def macro_blocks(macro: DataFrame, back: int, bar_seconds: int = 86400) -> Blocks:
    """The series table in row blocks: its windows need no single partition."""
    return block_panel(with_ordinal(macro, (), ("time",), chunk_seconds=16384 * bar_seconds), (), back=back)


def macro_features(macro: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """46 derived columns, from windows over the macro table alone (one row per time)."""
    blocks = macro_blocks(macro, 256)
    w = blocks.line

    def roll(n: int):
        return w.rowsBetween(-(n - 1), 0)

    def full(x, n, value):
        return F.when(F.count(x).over(roll(n)) == n, value)

    def pct(x, k):
        return sdiv(F.col(x), F.lag(x, k).over(w)) - 1.0

    def logret(x, k=1):
        return F.log(sdiv(F.col(x), F.lag(x, k).over(w)))

    def diff(x, k):
        return F.col(x) - F.lag(x, k).over(w)

    def z(x, n):
        mean, std = F.avg(x).over(roll(n)), F.stddev_samp(x).over(roll(n))
        return full(x, n, ratio(deviation(x, mean), std))

    def mark(cond):
        return flag(cond, null_as_zero)

    vix, sp = F.col("vix"), F.col("sp500")
    first: dict[str, Column] = {
        "vix_level": vix,
        "vix_change_1d": pct("vix", 1),
        "vix_change_5d": pct("vix", 5),
        "vix_zscore_20": z("vix", 20),
        "vix_high_regime": mark(vix > 25),
        "vix_extreme_regime": mark(vix > 40),
        "sp500_return_1d": logret("sp500"),
        "sp500_return_5d": logret("sp500", 5),
        "sp500_return_20d": logret("sp500", 20),
        "sp500_zscore_50": z("sp500", 50),
        "sp500_bull_regime": mark(sp > full("sp500", 200, F.avg("sp500").over(roll(200)))),
        "nasdaq_return_1d": logret("nasdaq"),
        "nasdaq_return_5d": logret("nasdaq", 5),
        "rut_return_1d": logret("russell2000"),
        "small_large_spread": logret("russell2000") - logret("sp500"),
        "yield_10y": F.col("yield_10y"),
        "yield_10y_change_1d": diff("yield_10y", 1),
        "yield_10y_change_5d": diff("yield_10y", 5),
        "yield_10y_zscore_60": z("yield_10y", 60),
        "yield_3m": F.col("yield_3m"),
        "yield_3m_change_1d": diff("yield_3m", 1),
        "yield_curve_spread": F.col("yield_10y") - F.col("yield_3m"),
        "yield_curve_inverted": mark(F.col("yield_10y") < F.col("yield_3m")),
        "tlt_return_1d": logret("tlt"),
        "tlt_return_5d": logret("tlt", 5),
        "hyg_return_1d": logret("hyg"),
        "credit_risk_spread": logret("hyg") - logret("tlt"),
    }
    for c in ("dxy", "gold", "oil"):
        first[f"{c}_return_1d"] = logret(c)
        first[f"{c}_return_5d"] = logret(c, 5)
        first[f"{c}_zscore_20"] = z(c, 20)
    layout = ("rn", "__blk", "__sub", "__copy")
    df = blocks.df.select("time", *layout, *[v.alias(k) for k, v in first.items()])
    up = flag(F.col("sp500_return_1d") > 0, null_as_zero)
    calm = flag(F.col("vix_change_1d") < 0, null_as_zero)
    lagged = [
        F.lag(c, k).over(w).alias(f"{c}_lag_{k}")
        for c in ("vix_level", "yield_10y", "sp500_return_1d", "dxy_return_1d")
        for k in (1, 5)
    ]
    done = df.select(
        "*",
        mark(F.col("dxy_zscore_20") > 1.0).alias("dxy_strong"),
        ((up + calm) / 2.0).alias("risk_on_signal"),
        *lagged,
    )
    return blocks.with_df(done).own_rows().drop("rn")


def macro_feature_names() -> list[str]:
    """Names in the order :func:`macro_features` gives them (without ``time``)."""
    vix = ["vix_level", "vix_change_1d", "vix_change_5d", "vix_zscore_20", "vix_high_regime", "vix_extreme_regime"]
    sp = ["sp500_return_1d", "sp500_return_5d", "sp500_return_20d", "sp500_zscore_50", "sp500_bull_regime"]
    eq = ["nasdaq_return_1d", "nasdaq_return_5d", "rut_return_1d", "small_large_spread"]
    y = ["yield_10y", "yield_10y_change_1d", "yield_10y_change_5d", "yield_10y_zscore_60", "yield_3m"]
    y += ["yield_3m_change_1d", "yield_curve_spread", "yield_curve_inverted"]
    credit = ["tlt_return_1d", "tlt_return_5d", "hyg_return_1d", "credit_risk_spread"]
    goods = [f"{c}_{s}" for c in ("dxy", "gold", "oil") for s in ("return_1d", "return_5d", "zscore_20")]
    lagged = [f"{c}_lag_{k}" for c in ("vix_level", "yield_10y", "sp500_return_1d", "dxy_return_1d") for k in (1, 5)]
    return vix + sp + eq + y + credit + goods + ["dxy_strong", "risk_on_signal"] + lagged


def asof_global(panel: DataFrame, macro: DataFrame, time: str = "time", back_fill: bool = False) -> DataFrame:
    """Attach the last macro row at or before each panel row.

    Every macro row is valid until the next one; it is expanded to the days it covers, which gives
    the join an equality key (a pure range condition would become a nested loop). Inside a day the
    validity interval decides. Rows before the first macro row get NULL, or with ``back_fill`` the
    first macro row (which looks ahead).
    """
    cols = [c for c in macro.columns if c != time]
    # the last macro row stays valid for good; it is found by time alone, see ``tail`` below
    line = carry_scan(macro, [], [time], chunk_of(time, YEAR), {"__to": ("after", F.col(time))})
    spans = line.select(F.col(time).alias("__from"), "__to", F.struct(*cols).alias("__m"))
    closed = spans.where("__to is not null").select(
        "*", F.explode(F.sequence(F.to_date("__from"), F.to_date("__to"))).alias("__day")
    )
    rows = panel.withColumn("__day", F.to_date(time))
    hit = (
        (rows["__day"] == closed["__day"]) & (rows[time] >= closed["__from"]) & (rows[time] < closed["__to"])
    )
    joined = rows.join(closed, hit, "left").select(*[rows[c] for c in panel.columns], closed["__m"].alias("__m"))
    # one row each: the first and the last macro row, as scalar subqueries
    tail = macro.agg(F.max_by(F.struct(F.col(time).alias("t"), F.struct(*cols).alias("m")), time)).scalar()
    value = F.when(F.col("__m").isNull() & (F.col(time) >= tail["t"]), tail["m"]).otherwise(F.col("__m"))
    out = joined.withColumn("__m", value)
    if back_fill:
        head = macro.agg(F.min_by(F.struct(F.col(time).alias("t"), F.struct(*cols).alias("m")), time)).scalar()
        out = out.withColumn("__m", F.when(F.col(time) < head["t"], head["m"]).otherwise(F.col("__m")))
    return out.select(*panel.columns, *[F.col(f"__m.{c}").alias(c) for c in cols])


def asof_keyed(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    chunk_seconds: int = 86400,
) -> DataFrame:
    """Last right row at or before each left row per key, for two large sides.

    Both sides are stacked and the last right row is carried along time. Keys are cut into time
    chunks, so one key may hold most of the rows. ``right`` must be unique per (keys, time).
    """
    marker = F.struct(*values)
    lrow = [c for c in left.columns if c not in (*keys, time)]
    ltag = left.select(*keys, time, F.lit(1).alias("__side"), F.struct(F.lit(1).alias("__one"), *lrow).alias("__l"))
    rtag = right.select(*keys, time, F.lit(0).alias("__side"), marker.alias("__r"))
    both = ltag.unionByName(rtag, allowMissingColumns=True)
    cut = F.floor(F.unix_seconds(F.col(time)) / F.lit(chunk_seconds)).cast("long")
    done = carry_scan(both, keys, [time, "__side"], cut, {"__hit": ("last", F.col("__r"))})
    return done.where("__side = 1").select(
        *keys, time, *[F.col(f"__l.{c}").alias(c) for c in lrow], *[F.col(f"__hit.{v}").alias(v) for v in values]
    )

