"""Technical features of an OHLCV panel.

Families only *declare* columns: each entry goes to a stage, and all columns of a stage are added
by one ``select``. Windows of one stage share a Window operator, and every stage uses the block
layout's single shuffle and sort, so the number of exchanges does not depend on how many
families are asked for.

Bars must be cleaned first (unique (symbol, time), no null prices): recurrences assert it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import EPS, LN2, TRADING_DAYS, clip, deviation, flag, ratio, safe_corr, safe_sqrt, sdiv
from barloom.operators.layout import Blocks, block_panel, carry_scan, chunk_of
from barloom.operators.recurrence import Recurrence, reach_of, solve, sub_rows_for

YEAR = math.sqrt(TRADING_DAYS)

SMA_WINDOWS = (7, 14, 21, 50, 100, 200)
EMA_WINDOWS = (7, 14, 21, 50, 100, 200)
RETURN_STEPS = (1, 5, 10, 20)
PRICE_LAGS = (1, 2, 3, 5, 10)
VOLUME_LAGS = (1, 2, 3)
RETURN_LAGS = (1, 2, 3, 5, 10, 20)
HORIZONS = (1, 5, 10, 20)


@dataclass
class Book:
    """Columns by stage, recurrences by generation, and how far rows look back and ahead.

    Order of evaluation: ``base`` (windows over bars), ``first`` (windows over base columns),
    first-generation recurrences, ``mid`` and ``mid2``, second-generation recurrences, ``last``, ``final``.
    """

    blocks: Blocks | None = None
    null_as_zero: bool = False
    stages: dict[str, dict[str, Column]] = field(
        default_factory=lambda: {s: {} for s in ("base", "first", "mid", "mid2", "last", "final")}
    )
    recur: dict[int, dict[str, Recurrence]] = field(default_factory=lambda: {1: {}, 2: {}})
    outputs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.O, self.H, self.L, self.C, self.V = (F.col(c) for c in ("open", "high", "low", "close", "volume"))
        self.RN = F.col("rn")

    def put(self, stage: str, name: str, col: Column, out: bool = True) -> None:
        self.stages[stage].setdefault(name, col)
        if out and name not in self.outputs:
            self.outputs.append(name)

    def hidden(self, stage: str, name: str, col: Column) -> None:
        self.put(stage, name, col, out=False)

    def recurrence(self, generation: int, name: str, drive: Column, q: float) -> None:
        self.recur[generation].setdefault(name, Recurrence(name, drive, q))


def _log_return(b: Book) -> None:
    b.hidden("base", "__c1", b.blocks.lag(b.C))
    b.hidden("base", "__lr", F.log(sdiv(b.C, b.blocks.lag(b.C))))


def _return_std(b: Book, n: int) -> Column:
    """Rolling deviation of log returns; families asking for the same ``n`` share the column."""
    b.hidden("first", f"__std_{n}", b.blocks.std("__lr", n))
    return F.col(f"__std_{n}")


def _close_stats(b: Book, n: int) -> tuple[Column, Column]:
    """Rolling mean and sample deviation of the close, shared like :func:`_return_std`."""
    b.hidden("base", f"__cmean_{n}", b.blocks.mean(b.C, n))
    b.hidden("base", f"__cdev_{n}", b.blocks.std(b.C, n))
    return F.col(f"__cmean_{n}"), F.col(f"__cdev_{n}")


def price_action(b: Book) -> None:
    w = b.blocks
    _log_return(b)
    for k in RETURN_STEPS:
        b.put("base", f"return_{k}d", w.pct_change(b.C, k))
    for k in (1, 5):
        b.put("base", f"log_return_{k}d", F.log(sdiv(b.C, w.lag(b.C, k))))
    for n in (5, 10, 20):
        b.put("mid", f"volatility_{n}d", _return_std(b, n) * YEAR)
    spread = 0.5 * F.pow(F.log(sdiv(b.H, b.L)), 2) - (2 * LN2 - 1) * F.pow(F.log(sdiv(b.C, b.O)), 2)
    b.hidden("base", "__gk", spread)
    b.put("first", "gk_volatility", safe_sqrt(w.mean("__gk", 20) * TRADING_DAYS))
    b.put("base", "high_low_range", sdiv(b.H - b.L, b.C))
    b.put("base", "close_position", ratio(b.C - b.L, b.H - b.L))
    b.put("base", "gap", sdiv(b.O, w.lag(b.C)) - 1.0)


def moving_averages(b: Book, windows: Sequence[int] = SMA_WINDOWS) -> None:
    """Rolling means; long ones as differences of the block's running sum, whose cost per row does
    not grow with n. Prices are positive and a block is short, so about 12 digits are kept."""
    w = b.blocks
    for n in (n for n in windows if n < 100):
        b.put("base", f"sma_{n}", w.mean(b.C, n))
    sofar = w.line.rowsBetween(Window.unboundedPreceding, 0)
    b.hidden("base", "__csum", F.sum(b.C).over(sofar))
    b.hidden("base", "__ccount", F.count(b.C).over(sofar))
    for n in (n for n in windows if n >= 100):
        rows = F.col("__ccount") - F.coalesce(w.lag("__ccount", n), F.lit(0))
        mean = (F.col("__csum") - F.coalesce(w.lag("__csum", n), F.lit(0.0))) / n
        b.put("first", f"sma_{n}", F.when(rows == n, mean))
    for n in windows:
        b.put("mid", f"close_to_sma_{n}", sdiv(b.C, F.col(f"sma_{n}")) - 1.0)


def _ema(b: Book, name: str, span: int) -> None:
    alpha = 2.0 / (span + 1)
    b.recurrence(1, name, F.when(b.RN == 1, b.C).otherwise(alpha * b.C), 1 - alpha)


def exponential_averages(b: Book, windows: Sequence[int] = EMA_WINDOWS) -> None:
    for n in windows:
        _ema(b, f"__ema{n}", n)
        b.put("mid", f"ema_{n}", F.when(b.RN >= n, F.col(f"__ema{n}")))
        b.put("mid", f"close_to_ema_{n}", F.when(b.RN >= n, sdiv(b.C, F.col(f"__ema{n}")) - 1.0))


def macd(b: Book, fast: int = 12, slow: int = 26, signal: int = 9) -> None:
    _ema(b, f"__ema{fast}", fast)
    _ema(b, f"__ema{slow}", slow)
    b.put("mid", "macd", F.when(b.RN >= slow, F.col(f"__ema{fast}") - F.col(f"__ema{slow}")))
    alpha = 2.0 / (signal + 1)
    drive = (
        F.when(b.RN < slow, F.lit(0.0)).when(b.RN == slow, F.col("macd")).otherwise(alpha * F.col("macd"))
    )
    b.recurrence(2, "__macd_signal", drive, 1 - alpha)
    b.put("last", "macd_signal", F.when(b.RN >= slow + signal - 1, F.col("__macd_signal")))
    b.put("final", "macd_hist", F.col("macd") - F.col("macd_signal"))
    for name in ("macd", "macd_signal"):
        b.put("final", f"{name}_norm", ratio(name, b.C))
    b.put("final", "macd_hist_norm", ratio(F.col("macd") - F.col("macd_signal"), b.C))


def _true_range(b: Book) -> None:
    prev = b.blocks.lag(b.C)
    b.hidden("base", "__tr", F.greatest(b.H - b.L, F.abs(b.H - prev), F.abs(b.L - prev)))


def average_true_range(b: Book, n: int = 14) -> None:
    w = b.blocks
    _true_range(b)
    b.hidden("first", "__tr_seed", F.avg("__tr").over(w.rolling(n)))
    drive = (
        F.when(b.RN < n, F.lit(0.0)).when(b.RN == n, F.col("__tr_seed")).otherwise(F.col("__tr") / n)
    )
    b.recurrence(1, "__atr", drive, 1 - 1.0 / n)
    b.put("mid", "atr_14", F.when(b.RN >= n, F.col("__atr")))
    b.put("last", "atr_pct", ratio("atr_14", b.C))


def directional_movement(b: Book, n: int = 14) -> None:
    """Wilder's DI and ADX: sums seeded with the first n moves, ADX with the first n DX."""
    w = b.blocks
    _true_range(b)
    up, down = b.H - w.lag(b.H), w.lag(b.L) - b.L
    b.hidden("base", "__dm_up", F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)))
    b.hidden("base", "__dm_down", F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))
    q = 1 - 1.0 / n
    for src in ("__tr", "__dm_up", "__dm_down"):
        # a plain sum over the first n moves, then decayed: the seed rows enter undecayed
        seed = F.sum(src).over(w.rolling(n))
        b.hidden("first", f"{src}_sum", seed)
        drive = (
            F.when(b.RN <= n, F.lit(0.0)).when(b.RN == n + 1, F.col(f"{src}_sum")).otherwise(F.col(src))
        )
        b.recurrence(1, f"{src}_w", drive, q)
    ready = b.RN >= n + 1
    b.put("mid", "di_plus", F.when(ready, 100.0 * sdiv("__dm_up_w", "__tr_w")))
    b.put("mid", "di_minus", F.when(ready, 100.0 * sdiv("__dm_down_w", "__tr_w")))
    total = F.col("__dm_up_w") + F.col("__dm_down_w")
    dx = F.coalesce(100.0 * sdiv(F.abs(F.col("__dm_up_w") - F.col("__dm_down_w")), total), F.lit(0.0))
    b.hidden("mid", "__dx", F.when(ready, dx))
    b.hidden("mid2", "__dx_seed", F.avg("__dx").over(w.rolling(n)))
    start = 2 * n
    drive = (
        F.when(b.RN < start, F.lit(0.0)).when(b.RN == start, F.col("__dx_seed")).otherwise(F.col("__dx") / n)
    )
    b.recurrence(2, "__adx", drive, q)
    b.put("last", "adx", F.when(b.RN >= start, F.col("__adx")))
    b.put("last", "di_spread", F.col("di_plus") - F.col("di_minus"))
    b.put("final", "trend_strong", flag(F.col("adx") > 25, b.null_as_zero))
    b.put("final", "trend_very_strong", flag(F.col("adx") > 40, b.null_as_zero))


def ichimoku(b: Book) -> None:
    w = b.blocks

    def midpoint(n: int) -> Column:
        return (w.highest(b.H, n) + w.lowest(b.L, n)) / 2.0

    b.put("base", "ichimoku_conv", midpoint(9))
    b.put("base", "ichimoku_base", midpoint(26))
    b.put("base", "ichimoku_b", midpoint(52))
    b.put("first", "ichimoku_a", (F.col("ichimoku_conv") + F.col("ichimoku_base")) / 2.0)
    for part in ("conv", "base", "a", "b"):
        b.put("mid", f"close_to_ichimoku_{part}", ratio(b.C, f"ichimoku_{part}") - 1.0)


def relative_strength(b: Book, n: int = 14) -> None:
    move = b.C - b.blocks.lag(b.C)
    b.hidden("base", "__gain", F.coalesce(F.greatest(move, F.lit(0.0)), F.lit(0.0)) / n)
    b.hidden("base", "__loss", F.coalesce(F.greatest(-move, F.lit(0.0)), F.lit(0.0)) / n)
    for side in ("gain", "loss"):
        b.recurrence(1, f"__avg_{side}", F.col(f"__{side}"), 1 - 1.0 / n)
    rsi = F.when(F.col("__avg_loss") == 0, F.lit(100.0)).otherwise(
        100.0 - 100.0 / (1.0 + sdiv("__avg_gain", "__avg_loss"))
    )
    b.put("mid", "rsi_14", F.when(b.RN >= n, rsi))


def stochastics(b: Book, n: int = 14) -> None:
    w = b.blocks
    b.hidden("base", "__hh", w.highest(b.H, n))
    b.hidden("base", "__ll", w.lowest(b.L, n))
    span = F.col("__hh") - F.col("__ll")
    b.put("first", "stoch_k", 100.0 * sdiv(b.C - F.col("__ll"), span))
    b.put("mid", "stoch_d", w.mean("stoch_k", 3))
    b.put("first", "williams_r", -100.0 * sdiv(F.col("__hh") - b.C, span))


def rate_of_change(b: Book) -> None:
    for k in (5, 10, 20):
        b.put("base", f"roc_{k}", 100.0 * sdiv(b.C - b.blocks.lag(b.C, k), b.blocks.lag(b.C, k)))


def commodity_channel(b: Book, n: int = 20) -> None:
    w = b.blocks
    tp = (b.H + b.L + b.C) / 3.0
    b.hidden("base", "__tp20", w.mean(tp, n))
    b.hidden("base", "__tps", F.collect_list(tp).over(w.rolling(n)))
    mad = F.aggregate(
        "__tps", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("__tp20")), lambda acc: acc / n
    )
    b.put("first", "cci_20", sdiv(tp - F.col("__tp20"), 0.015 * mad))


def bollinger(b: Book, n: int = 20, width: float = 2.0) -> None:
    mean, sample = _close_stats(b, n)
    dev = sample * math.sqrt((n - 1) / n)  # population deviation
    b.put("first", "bb_upper", mean + width * dev)
    b.put("first", "bb_lower", mean - width * dev)
    up, low = F.col("bb_upper"), F.col("bb_lower")
    b.put("mid", "bb_width", ratio(up - low, b.C))
    b.put("mid", "bb_position", ratio(b.C - low, up - low))


def keltner(b: Book, n: int = 20) -> None:
    w = b.blocks
    b.put("base", "kc_upper", w.mean((4.0 * b.H - 2.0 * b.L + b.C) / 3.0, n))
    b.put("base", "kc_lower", w.mean((-2.0 * b.H + 4.0 * b.L + b.C) / 3.0, n))
    for side in ("upper", "lower"):
        b.put("first", f"close_to_kc_{side}", ratio(b.C, f"kc_{side}") - 1.0)


def parkinson(b: Book) -> None:
    b.hidden("base", "__hl2", F.pow(F.log(sdiv(b.H, b.L)), 2))
    for n in (5, 20):
        b.put("first", f"parkinson_vol_{n}d", F.sqrt(b.blocks.mean("__hl2", n) / (4 * LN2) * TRADING_DAYS))


def cumulative_volume(b: Book) -> None:
    """Needs ``obv`` and ``ad_line`` from :func:`panel_with_history`."""
    b.put("base", "obv", F.col("obv"))
    b.put("base", "ad_line", F.col("ad_line"))
    b.put("base", "obv_change", b.blocks.pct_change("obv", 5))
    b.put("base", "ad_change", b.blocks.pct_change("ad_line", 5))


def money_flow(b: Book, n: int = 14) -> None:
    w = b.blocks
    tp = (b.H + b.L + b.C) / 3.0
    b.hidden("base", "__tp", tp)
    b.hidden("base", "__tp_prev", w.lag(tp))
    flow = F.col("__tp") * b.V
    up = F.when(F.col("__tp") > F.col("__tp_prev"), flow).otherwise(F.lit(0.0))
    down = F.when(F.col("__tp") < F.col("__tp_prev"), flow).otherwise(F.lit(0.0))
    pos, neg = (F.sum(x).over(w.rolling(n)) for x in (up, down))
    mfi = F.when(neg == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + sdiv(pos, neg)))
    b.put("first", "mfi_14", F.when(b.RN >= n, mfi))


def volume_ratios(b: Book) -> None:
    w = b.blocks
    b.put("base", "volume_sma_20", w.mean(b.V, 20))
    b.put("first", "volume_ratio", sdiv(b.V, F.col("volume_sma_20") + 1.0))
    b.hidden("base", "__vol_dev", w.std(b.V, 20))
    b.put("first", "volume_surge", sdiv(b.V - F.col("volume_sma_20"), F.col("__vol_dev") + 1.0))
    b.put("mid", "volume_surge_flag", flag(F.col("volume_surge") > 2.0, b.null_as_zero))
    b.put("base", "rel_volume_5", sdiv(b.V, w.mean(b.V, 5) + 1.0))
    b.hidden("base", "__up_vol", F.when(b.C > w.lag(b.C), b.V).otherwise(F.lit(0.0)))
    b.hidden("base", "__down_vol", F.when(b.C < w.lag(b.C), b.V).otherwise(F.lit(0.0)))
    b.put("first", "up_down_vol_ratio", sdiv(w.total("__up_vol", 10), w.total("__down_vol", 10) + 1.0))


def vwap_family(b: Book) -> None:
    w = b.blocks
    tp = (b.H + b.L + b.C) / 3.0
    b.put("base", "vwap_proxy", sdiv(w.total(tp * b.V, 20), w.total(b.V, 20) + 1.0))
    b.put("first", "close_to_vwap", ratio(b.C, "vwap_proxy") - 1.0)
    b.put("first", "vwap_dev_5", ratio(b.C - F.col("vwap_proxy"), "vwap_proxy"))
    partial = w.rolling(20)
    b.put("base", "vwap", sdiv(F.sum(tp * b.V).over(partial), F.sum(b.V).over(partial) + EPS))


def _central_moments(n: int) -> tuple[Column, Column, Column]:
    """Second to fourth central moment from the rolling power means ``__m<k>_<n>``.

    Returns are small around zero, so the shift by the mean loses no digits that matter, and the
    power sums cost a fraction of the built-in moment aggregates, which divide on every update.
    """
    m1, m2, m3 = (F.col(f"__m{k}_{n}") for k in (1, 2, 3))
    c2 = m2 - m1 * m1
    c2 = F.when(c2 > 1e-12 * m2, c2)
    c3 = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    m4 = F.col(f"__m4_{n}")
    c4 = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return c2, c3, c4


def moments(b: Book) -> None:
    w = b.blocks
    _log_return(b)
    lr = F.col("__lr")
    for k, power in enumerate((lr, lr * lr, lr * lr * lr, lr * lr * lr * lr), start=1):
        b.hidden("first", f"__lr_{k}", power)
        # every rolling mean is a column of its own: a window used twice would be computed twice
        for n in (20, 60) if k < 4 else (20,):
            b.hidden("mid", f"__m{k}_{n}", F.avg(f"__lr_{k}").over(w.rolling(n)))
    for n in (20, 60):
        b.hidden("mid", f"__seen_{n}", F.count("__lr_1").over(w.rolling(n)))
        c2, c3, _ = _central_moments(n)
        unbias = math.sqrt(n * (n - 1)) / (n - 2)
        b.put("mid2", f"realized_skew_{n}", F.when(F.col(f"__seen_{n}") == n, sdiv(c3, F.pow(c2, 1.5)) * unbias))
    b.put("last", "skewness_20", F.col("realized_skew_20"))
    n = 20
    c2, _, c4 = _central_moments(n)
    g2 = sdiv(c4, c2 * c2) - 3.0
    full = F.col("__seen_20") == n
    b.put("mid2", "kurtosis_20", F.when(full, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0)))
    for k in (20, 50):
        mean, dev = _close_stats(b, k)
        b.put("first", f"zscore_{k}", ratio(deviation(b.C, mean), dev))


def autocorrelations(b: Book) -> None:
    w = b.blocks
    _log_return(b)
    b.hidden("first", "__lr1", w.lag("__lr"))
    for name, n in (("autocorr_5", 20), ("return_autocorr_1", 10)):
        pairs = F.count(F.when(F.col("__lr").isNotNull(), F.col("__lr1"))).over(w.rolling(n))
        b.put("mid", name, F.when(pairs >= n, safe_corr("__lr", "__lr1", w.rolling(n))))


def microstructure(b: Book) -> None:
    w = b.blocks
    _log_return(b)
    b.put("base", "range_expansion", ratio(b.H - b.L, w.mean(b.H - b.L, 5)))
    std5, std20, std60 = (_return_std(b, n) for n in (5, 20, 60))
    b.put("mid", "vol_ratio_5_20", ratio(std5 * YEAR, std20 * YEAR))
    b.put("mid", "vol_regime_60_20", ratio(std60, std20))
    b.put("first", "idiosyncratic_return", F.col("__lr") - w.mean("__lr", 20))
    b.put("base", "momentum_accel", w.pct_change(b.C, 5) - w.pct_change(b.C, 10) / 2.0)
    b.hidden("base", "__illiq", sdiv(F.abs(F.log(sdiv(b.C, w.lag(b.C)))), b.V + 1.0))
    b.put("first", "amihud_illiq", w.mean("__illiq", 20))
    flow = ratio(b.C - b.O, b.H - b.L)
    b.put("base", "order_flow_imbalance", flow)
    b.put("first", "order_flow_ma5", w.mean("order_flow_imbalance", 5))
    moves = w.total(F.abs(F.col("__lr")), 20)
    b.hidden("base", "__net20", F.abs(b.C - w.lag(b.C, 20)))
    b.put("first", "efficiency_ratio_20", ratio("__net20", moves))
    b.hidden("base", "__step", F.abs(b.C - w.lag(b.C)))
    b.put("first", "efficiency_ratio_norm_20", ratio("__net20", w.total("__step", 20)))


def lags(b: Book) -> None:
    w = b.blocks
    _log_return(b)
    for k in PRICE_LAGS:
        b.put("base", f"close_lag_{k}", w.lag(b.C, k))
        b.put("base", f"close_return_lag_{k}", sdiv(w.lag(b.C, 1), w.lag(b.C, k + 1)) - 1.0)
    for k in VOLUME_LAGS:
        b.put("base", f"volume_lag_{k}", w.lag(b.V, k))
        b.put("base", f"volume_return_lag_{k}", sdiv(w.lag(b.V, 1), w.lag(b.V, k + 1)) - 1.0)
    for k in RETURN_LAGS:
        b.put("first", f"return_lag_{k}", w.lag("__lr", k))


def calendar(b: Book) -> None:
    day = F.to_date("time")
    b.put("base", "day_of_week", F.weekday("time"))
    b.put("base", "month", F.month("time"))
    b.put("base", "quarter", F.quarter("time"))
    b.put("base", "is_month_start", (F.dayofmonth("time") == 1).cast("int"))
    b.put("base", "is_month_end", (day == F.last_day(day)).cast("int"))


def targets(b: Book, horizons: Sequence[int] = HORIZONS) -> None:
    """Forward returns, directions and volatility; NULL where the future is not known."""
    w = b.blocks
    _log_return(b)
    for h in horizons:
        b.put("base", f"future_price_{h}", w.lead(b.C, h))
        b.put("base", f"target_{h}", sdiv(w.lead(b.C, h), b.C) - 1.0)
        b.put("first", f"target_dir_{h}", flag(F.col(f"target_{h}") > 0, b.null_as_zero))
        b.put("first", f"target_strong_{h}", flag(F.abs(F.col(f"target_{h}")) > 0.01, b.null_as_zero))
        if h == 1:
            b.put("first", "target_vol_1", F.abs(w.lead("__lr", 1)) * YEAR)
        else:
            ahead = w.line.rowsBetween(1, h)
            std = F.stddev_samp("__lr").over(ahead) * YEAR
            b.put("first", f"target_vol_{h}", F.when(F.count("__lr").over(ahead) == h, std))


def regime_inputs(b: Book) -> None:
    """Inputs of the statistical regime model; columns ``panel_std`` and ``live_volume`` come from
    :func:`regime_panel`."""
    w = b.blocks
    _log_return(b)
    relative_strength(b)
    average_true_range(b)
    b.hidden("first", "__lr0", F.coalesce(F.col("__lr"), F.lit(0.0)))
    b.put("mid", "ret5", F.coalesce(w.total("__lr0", 5), F.lit(0.0)))
    b.put("mid", "vol20", F.coalesce(w.std("__lr0", 20), F.col("panel_std")))
    b.put(
        "base",
        "vol_ratio",
        clip(F.coalesce(sdiv(w.mean("live_volume", 5), w.mean("live_volume", 20)), F.lit(1.0)), 0.1, 10.0),
    )
    b.put("last", "rsi_norm", clip((F.coalesce(F.col("rsi_14"), F.lit(50.0)) - 50.0) / 50.0, -1.0, 1.0))
    b.put("last", "atr_ratio", F.coalesce(sdiv("atr_14", b.C), F.lit(0.0)))


FAMILIES: dict[str, Callable[[Book], None]] = {
    "price_action": price_action,
    "moving_averages": moving_averages,
    "exponential_averages": exponential_averages,
    "macd": macd,
    "directional_movement": directional_movement,
    "ichimoku": ichimoku,
    "relative_strength": relative_strength,
    "stochastics": stochastics,
    "rate_of_change": rate_of_change,
    "commodity_channel": commodity_channel,
    "bollinger": bollinger,
    "average_true_range": average_true_range,
    "keltner": keltner,
    "parkinson": parkinson,
    "cumulative_volume": cumulative_volume,
    "money_flow": money_flow,
    "volume_ratios": volume_ratios,
    "vwap_family": vwap_family,
    "moments": moments,
    "autocorrelations": autocorrelations,
    "microstructure": microstructure,
    "lags": lags,
    "calendar": calendar,
}
TECHNICAL = tuple(FAMILIES)
FAMILIES_WITH_TARGETS = {**FAMILIES, "targets": targets, "regime_inputs": regime_inputs}


def panel_with_history(
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    bar_seconds: int = 86400,
    cumulative: bool = True,
    tie_is_up: bool = True,
) -> DataFrame:
    """Add ``rn`` and, if asked, the unbounded running features ``obv`` and ``ad_line``.

    On an unchanged close the volume counts as bought (``tie_is_up``) or not at all.
    """
    H, L, C, V = (F.col(c) for c in ("high", "low", "close", "volume"))
    cut = chunk_of("time", 16384 * bar_seconds)
    scans: dict = {"rn": ("count", F.lit(1))}
    if cumulative:
        scans["__prev_close"] = ("prev", C)
    out = carry_scan(bars, keys, ["time"], cut, scans)
    if not cumulative:
        return out
    tie = V if tie_is_up else F.lit(0.0)
    prev = F.col("__prev_close")
    signed = F.when(C < prev, -V).when(C > prev, V).when(prev.isNull(), V).otherwise(tie)
    spread = F.when(H == L, F.lit(0.0)).otherwise(sdiv((C - L) - (H - C), H - L) * V)
    out = carry_scan(out, keys, ["time"], cut, {"obv": ("sum", signed), "ad_line": ("sum", spread)})
    return out.drop("__prev_close")


def build_features(
    panel: DataFrame,
    families: Sequence[str] = TECHNICAL,
    keys: Sequence[str] = ("symbol",),
    keep: Sequence[str] | None = None,
    null_as_zero: bool = False,
    block_rows: int | None = None,
    custom: Sequence[Callable[[Book], None]] = (),
) -> DataFrame:
    """Evaluate feature families over a panel from :func:`panel_with_history`.

    Returns ``keep`` (default: all panel columns) plus the families' columns. The copied rows per
    block cover the longest window and, if recurrences are present, their decay length.
    """
    chosen = [FAMILIES_WITH_TARGETS[f] for f in families] + list(custom)
    # window specifications depend on the keys alone, so families can be declared before the layout
    book = Book(Blocks(panel, tuple(keys), 1024, 1, 0), null_as_zero)
    for fam in chosen:
        fam(book)
    ratios = [r.bound for gen in book.recur.values() for r in gen.values()]
    sub = sub_rows_for(ratios)
    generations = sum(1 for gen in book.recur.values() if gen)
    back = max(256, reach_of(ratios, sub) + (generations > 1) * sub)
    rows = block_rows or max(4 * back, 20 * sub)
    rows = -(-rows // sub) * sub
    back = -(-back // sub) * sub
    blocks = block_panel(panel, keys, back=back, ahead=max(HORIZONS) + 1, block_rows=rows, sub_rows=sub)
    blocks = replace(blocks, specs=book.blocks.specs)

    def add(stage: str) -> None:
        nonlocal blocks
        have = set(blocks.df.columns)
        cols = [c.alias(n) for n, c in book.stages[stage].items() if n not in have]
        if cols:
            blocks = blocks.with_df(blocks.df.select("*", *cols))

    add("base")
    add("first")
    if book.recur[1]:
        blocks = solve(blocks, list(book.recur[1].values()))
    add("mid")
    add("mid2")
    if book.recur[2]:
        blocks = solve(blocks, list(book.recur[2].values()))
    add("last")
    add("final")
    kept = list(keep) if keep is not None else [c for c in panel.columns]
    own = blocks.df.where(~F.col("__copy"))
    return own.select(*kept, *[n for n in book.outputs if n not in kept])


def regime_panel(panel: DataFrame, keys: Sequence[str] = ("symbol",), bar_seconds: int = 86400) -> DataFrame:
    """Add each key's overall log-return deviation and the volume with gaps carried forward."""
    returns = build_features(panel, ["price_action"], keys, keep=list(keys))
    whole = returns.groupBy(*keys).agg(F.stddev_samp(F.coalesce("log_return_1d", F.lit(0.0))).alias("panel_std"))
    alive = F.when(F.col("volume") != 0, F.col("volume"))
    cut = chunk_of("time", 16384 * bar_seconds)
    filled = carry_scan(panel, keys, ["time"], cut, {"live_volume": ("last", alive)})
    return filled.withColumn("live_volume", F.coalesce("live_volume", F.lit(1.0))).join(whole, list(keys))


def window_udf(n: int, fold: Callable[[Column], Column], value: Column | str) -> Callable[[Book, str], None]:
    """A rolling function of the last ``n`` values given as a column expression on their array."""

    def family(b: Book, name: str = "custom") -> None:
        w = b.blocks
        x = F.col(value) if isinstance(value, str) else value
        b.hidden("base", f"__arr_{name}", w.full(x, n, F.collect_list(x).over(w.rolling(n))))
        b.put("first", name, fold(F.col(f"__arr_{name}")))

    return family


# Columns that are levels, not ratios: useful for charts, never fed to a model.
_LEVELS = frozenset(
    ["ichimoku_a", "ichimoku_b", "ichimoku_base", "ichimoku_conv", "macd", "macd_signal", "macd_hist"]
    + ["atr_14", "bb_upper", "bb_lower", "kc_upper", "kc_lower", "obv", "ad_line", "volume_sma_20"]
    + ["vwap_proxy"]
)
_META = frozenset(["time", "open", "high", "low", "close", "volume", "target", "symbol"])
_LEVEL_PREFIXES = ("sma_", "ema_", "close_lag_", "volume_lag_", "target_", "future_price_")


def feature_columns(
    columns: Sequence[str], exclude: Sequence[str] = (), macro: Sequence[str] = (), include_macro: bool = True
) -> list[str]:
    """Model-ready columns: everything that is not meta data, a raw level or a target."""
    skip = set(exclude) | (set() if include_macro else set(macro))
    return [
        c
        for c in columns
        if c not in _META and c not in _LEVELS and c not in skip and not c.startswith(_LEVEL_PREFIXES)
    ]

