"""Technical features, lags, calendar and targets over the weekly panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators.cleaning import drop_warm_up, fill_zero
from barloom.operators.sequences import forecast_sequences, padded_tail
from barloom.plans.fixtures import Inputs
from barloom.plans.registry import query

KEYS = ["symbol"]


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING)"


ALL = "(PARTITION BY symbol ORDER BY time)"


def full(x: str, n: int, fn: str) -> str:
    """SQL: ``fn(x)`` over the last n rows once all n are there."""
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {fn}({x}) OVER {w(n)} END"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER {ALL}"


def pct(x: str, k: int) -> str:
    return f"{x} / nullif({lag(x, k)}, 0) - 1"


def select(cols: dict[str, str], source: str = "rbars") -> str:
    return "SELECT symbol, time, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {source}"


def panel_features(i: Inputs, families: Sequence[str]) -> DataFrame:
    return ft.build_features(i.panel(), families, keep=["symbol", "time"])


# SQL, digits of the double columns and integer columns of each family query
FAMILY_SQL: list[tuple[str, dict[str, int], list[str]]] = []


def feature_query(name: str, covers: str, families: Sequence[str], sql: str, doubles, ints: Sequence[str] = ()):
    def plan(i: Inputs) -> DataFrame:
        return panel_features(i, families)

    query(name, covers, sql, ["rbars"], ["time"], doubles, [*KEYS, *ints])(plan)
    FAMILY_SQL.append((sql, dict(doubles) if isinstance(doubles, dict) else {c: 6 for c in doubles}, list(ints)))


E10 = "1e-10"
_gk = "(0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2))"
_gk_mean = f"({full('gk', 20, 'avg')}) * 252"
_price = {f"return_{k}d": pct("close", k) for k in (1, 5, 10, 20)}
_price |= {f"log_return_{k}d": f"ln(close / {lag('close', k)})" for k in (1, 5)}
_price |= {f"volatility_{n}d": f"({full('lr', n, 'stddev_samp')}) * sqrt(252)" for n in (5, 10, 20)}
_price |= {
    "gk_volatility": f"CASE WHEN {_gk_mean} >= 0 THEN sqrt({_gk_mean}) END",
    "high_low_range": "(high - low) / close",
    "close_position": f"(close - low) / (high - low + {E10})",
    "gap": f"open / {lag('close', 1)} - 1",
}
feature_query(
    "features_price_action", "W-1 W-2 W-3 W-4 W-5", ["price_action"],
    select(_price, f"(SELECT *, {_gk} AS gk FROM rbars)"), list(_price),
)

_sma = {}
for n in ft.SMA_WINDOWS:
    _sma[f"sma_{n}"] = full("close", n, "avg")
    _sma[f"close_to_sma_{n}"] = f"close / ({full('close', n, 'avg')}) - 1"
feature_query("features_moving_averages", "W-6", ["moving_averages"], select(_sma), list(_sma))


def recursive(first: dict[str, str], step: dict[str, str], carry: Sequence[str] = ()) -> str:
    """SQL: a row-by-row recurrence; ``p`` is the previous row's state, ``b`` the current bar."""
    bar = ["symbol", "time", "rn", "close", *carry]
    return (
        f"WITH RECURSIVE r AS (SELECT {', '.join(bar)}, {', '.join(f'{e} AS {c}' for c, e in first.items())} FROM src WHERE rn = 1 "
        f"UNION ALL SELECT {', '.join('b.' + c for c in bar)}, {', '.join(step.values())} "
        "FROM r p JOIN src b ON b.symbol = p.symbol AND b.rn = p.rn + 1)"
    )


def with_source(source: str, recursion: str) -> str:
    return recursion.replace("WITH RECURSIVE ", f"WITH RECURSIVE src AS ({source}), ", 1)


def _ema_step(n: int, x: str = "b.close", state: str | None = None) -> str:
    a = 2.0 / (n + 1)
    return f"{a!r} * {x} + {1 - a!r} * p.{state or f'e{n}'}"


_emas = with_source(
    "SELECT * FROM rbars",
    recursive({f"e{n}": "close" for n in ft.EMA_WINDOWS}, {f"e{n}": _ema_step(n) for n in ft.EMA_WINDOWS}),
)
_ema_cols = {}
for n in ft.EMA_WINDOWS:
    _ema_cols[f"ema_{n}"] = f"CASE WHEN rn >= {n} THEN e{n} END"
    _ema_cols[f"close_to_ema_{n}"] = f"CASE WHEN rn >= {n} THEN close / e{n} - 1 END"
feature_query(
    "features_exponential_averages", "W-7 W-REC-1", ["exponential_averages"],
    _emas + " " + select(_ema_cols, "r"), list(_ema_cols),
)

_a9 = 0.2
_macd = with_source(
    "SELECT * FROM rbars",
    recursive(
        {"e12": "close", "e26": "close", "s": "CAST(NULL AS DOUBLE)"},
        {
            "e12": _ema_step(12),
            "e26": _ema_step(26),
            "s": f"CASE WHEN b.rn < 26 THEN NULL WHEN b.rn = 26 THEN ({_ema_step(12)}) - ({_ema_step(26)}) "
            f"ELSE {_a9} * (({_ema_step(12)}) - ({_ema_step(26)})) + {1 - _a9} * p.s END",
        },
    ),
)
_macd_cols = {
    "macd": "CASE WHEN rn >= 26 THEN e12 - e26 END",
    "macd_signal": "CASE WHEN rn >= 34 THEN s END",
    "macd_hist": "CASE WHEN rn >= 34 THEN e12 - e26 - s END",
    "macd_norm": f"CASE WHEN rn >= 26 THEN (e12 - e26) / (close + {E10}) END",
    "macd_signal_norm": f"CASE WHEN rn >= 34 THEN s / (close + {E10}) END",
    "macd_hist_norm": f"CASE WHEN rn >= 34 THEN (e12 - e26 - s) / (close + {E10}) END",
}
feature_query("features_macd", "W-8 W-REC-1", ["macd"], _macd + " " + select(_macd_cols, "r"), list(_macd_cols))

_moves = f"""SELECT *, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr,
   CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0.0 END AS up,
   CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0.0 END AS dn
   FROM (SELECT *, {lag('high', 1)} AS h1, {lag('low', 1)} AS l1 FROM rbars)"""
_seeds = f"SELECT *, sum(tr) OVER {w(14)} AS tr14, sum(up) OVER {w(14)} AS up14, sum(dn) OVER {w(14)} AS dn14 FROM ({_moves})"


def _wilder_sum(x: str) -> str:
    return f"CASE WHEN b.rn < 15 THEN 0.0 WHEN b.rn = 15 THEN b.{x}14 ELSE p.s_{x} * 13.0 / 14 + b.{x} END"


_dmi = with_source(_seeds, recursive({f"s_{x}": "CAST(0.0 AS DOUBLE)" for x in ("tr", "up", "dn")}, {x: _wilder_sum(x) for x in ("tr", "up", "dn")}))
_dx = f"""SELECT *, avg(dx) OVER {w(14)} AS dx_mean FROM (SELECT *, CASE WHEN rn >= 15 THEN coalesce(100 * abs(s_up - s_dn) / nullif(s_up + s_dn, 0), 0) END AS dx FROM r)"""
_adx = (
    f"{_dmi}, x AS ({_dx}), a AS (SELECT symbol, rn, time, s_tr, s_up, s_dn, CASE WHEN rn >= 28 THEN dx_mean END AS adx FROM x WHERE rn = 28 "
    "UNION ALL SELECT x.symbol, x.rn, x.time, x.s_tr, x.s_up, x.s_dn, (a.adx * 13 + x.dx) / 14 FROM a JOIN x ON x.symbol = a.symbol AND x.rn = a.rn + 1) "
)
feature_query(
    "features_directional_movement", "W-9 P-23 W-REC-1", ["directional_movement"],
    _adx + """SELECT r.symbol, r.time, CASE WHEN r.rn >= 15 THEN 100 * r.s_up / nullif(r.s_tr, 0) END AS di_plus,
      CASE WHEN r.rn >= 15 THEN 100 * r.s_dn / nullif(r.s_tr, 0) END AS di_minus, a.adx,
      CASE WHEN r.rn >= 15 THEN 100 * r.s_up / nullif(r.s_tr, 0) - 100 * r.s_dn / nullif(r.s_tr, 0) END AS di_spread,
      CAST(a.adx > 25 AS INTEGER) AS trend_strong, CAST(a.adx > 40 AS INTEGER) AS trend_very_strong
      FROM r LEFT JOIN a ON r.symbol = a.symbol AND r.rn = a.rn""",
    ["di_plus", "di_minus", "adx", "di_spread", "trend_strong", "trend_very_strong"],
)


def _mid(n: int) -> str:
    return f"(({full('high', n, 'max')}) + ({full('low', n, 'min')})) / 2"


_ichi = {"ichimoku_conv": _mid(9), "ichimoku_base": _mid(26), "ichimoku_b": _mid(52)}
_ichi["ichimoku_a"] = f"({_mid(9)} + {_mid(26)}) / 2"
_ichi |= {f"close_to_{k}": f"close / ({e} + {E10}) - 1" for k, e in list(_ichi.items())}
feature_query("features_ichimoku", "W-10", ["ichimoku"], select(_ichi), list(_ichi))

_rsi = with_source(
    "SELECT *, coalesce(greatest(close - c1, 0), 0) AS g, coalesce(greatest(c1 - close, 0), 0) AS l FROM rbars",
    recursive(
        {"ag": "CAST(0.0 AS DOUBLE)", "al": "CAST(0.0 AS DOUBLE)"},
        {"ag": "p.ag * 13.0 / 14 + b.g / 14", "al": "p.al * 13.0 / 14 + b.l / 14"},
    ),
)
feature_query(
    "features_rsi", "W-11 W-REC-1", ["relative_strength"],
    _rsi + " SELECT symbol, time, CASE WHEN rn < 14 THEN NULL WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM r",
    ["rsi_14"],
)

_span = f"nullif(({full('high', 14, 'max')}) - ({full('low', 14, 'min')}), 0)"
_osc = {
    "stoch_k": f"100 * (close - ({full('low', 14, 'min')})) / {_span}",
    "williams_r": f"-100 * (({full('high', 14, 'max')}) - close) / {_span}",
}
_osc |= {f"roc_{k}": f"100 * (close - {lag('close', k)}) / {lag('close', k)}" for k in (5, 10, 20)}
feature_query(
    "features_oscillators", "W-12 W-13 W-14", ["stochastics", "rate_of_change"],
    f"SELECT *, {full('stoch_k', 3, 'avg')} AS stoch_d FROM ({select(_osc)})", [*_osc, "stoch_d"],
)

feature_query(
    "features_commodity_channel", "W-15 X-2", ["commodity_channel"],
    f"""SELECT symbol, time, (tp - m) / nullif(0.015 * list_avg(list_transform(tps, lambda x: abs(x - m))), 0) AS cci_20
        FROM (SELECT *, {full('tp', 20, 'avg')} AS m, list(tp) OVER {w(20)} AS tps
              FROM (SELECT *, (high + low + close) / 3 AS tp FROM rbars))""",
    ["cci_20"],
)

_bb = {"bb_upper": f"({full('close', 20, 'avg')}) + 2 * ({full('close', 20, 'stddev_pop')})"}
_bb["bb_lower"] = f"({full('close', 20, 'avg')}) - 2 * ({full('close', 20, 'stddev_pop')})"
feature_query(
    "features_bollinger", "W-16", ["bollinger"],
    f"""SELECT symbol, time, bb_upper, bb_lower, (bb_upper - bb_lower) / (close + {E10}) AS bb_width,
        (close - bb_lower) / (bb_upper - bb_lower + {E10}) AS bb_position
        FROM (SELECT *, {", ".join(f"{e} AS {c}" for c, e in _bb.items())} FROM rbars)""",
    ["bb_upper", "bb_lower", "bb_width", "bb_position"],
)

_atr = with_source(
    f"SELECT *, avg(tr) OVER {w(14)} AS tr_mean FROM ({_moves})",
    recursive(
        {"atr": "CAST(0.0 AS DOUBLE)"},
        {"atr": "CASE WHEN b.rn < 14 THEN 0 WHEN b.rn = 14 THEN b.tr_mean ELSE (p.atr * 13 + b.tr) / 14 END"},
    ),
)
feature_query(
    "features_average_true_range", "W-17 W-REC-1", ["average_true_range"],
    _atr + f""" SELECT symbol, time, CASE WHEN rn >= 14 THEN atr END AS atr_14,
     CASE WHEN rn >= 14 THEN atr / (close + {E10}) END AS atr_pct FROM r""",
    ["atr_14", "atr_pct"],
)

_kc = {"kc_upper": full("ku", 20, "avg"), "kc_lower": full("kl", 20, "avg")}
_kc |= {f"close_to_{k}": f"close / (({e}) + {E10}) - 1" for k, e in list(_kc.items())}
_kc |= {f"parkinson_vol_{n}d": f"sqrt(({full('hl2', n, 'avg')}) / (4 * ln(2)) * 252)" for n in (5, 20)}
feature_query(
    "features_range_channels", "W-18 W-19", ["keltner", "parkinson"],
    select(_kc, """(SELECT *, (4 * high - 2 * low + close) / 3 AS ku, (-2 * high + 4 * low + close) / 3 AS kl,
                    power(ln(high / low), 2) AS hl2 FROM rbars)"""),
    list(_kc),
)

feature_query(
    "features_cumulative_volume", "W-20 W-22 W-REC-2", ["cumulative_volume"],
    f"""SELECT symbol, time, obv, ad_line, {pct('obv', 5)} AS obv_change, {pct('ad_line', 5)} AS ad_change FROM (
      SELECT *, sum(CASE WHEN close < c1 THEN -volume ELSE volume END) OVER {ALL} AS obv,
       sum(CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END) OVER {ALL} AS ad_line
      FROM rbars)""",
    {"obv": 4, "ad_line": 4, "obv_change": 6, "ad_change": 4},
)

_tp = f"(SELECT *, {lag('tp', 1)} AS tp1 FROM (SELECT *, (high + low + close) / 3 AS tp FROM rbars))"
_flow = f"""(SELECT *, CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END AS pf, CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END AS nf,
  tp * volume AS tv, CASE WHEN close > c1 THEN volume ELSE 0 END AS uv, CASE WHEN close < c1 THEN volume ELSE 0 END AS dv FROM {_tp})"""
_vwap = f"({full('tv', 20, 'sum')}) / (({full('volume', 20, 'sum')}) + 1)"
_vol = {
    "mfi_14": f"""CASE WHEN rn < 14 THEN NULL WHEN sum(nf) OVER {w(14)} = 0 THEN 100
                  ELSE 100 - 100 / (1 + sum(pf) OVER {w(14)} / sum(nf) OVER {w(14)}) END""",
    "volume_sma_20": full("volume", 20, "avg"),
    "volume_ratio": f"volume / (({full('volume', 20, 'avg')}) + 1)",
    "volume_surge": f"(volume - ({full('volume', 20, 'avg')})) / (({full('volume', 20, 'stddev_samp')}) + 1)",
    "rel_volume_5": f"volume / (({full('volume', 5, 'avg')}) + 1)",
    "up_down_vol_ratio": f"({full('uv', 10, 'sum')}) / (({full('dv', 10, 'sum')}) + 1)",
    "vwap_proxy": _vwap,
    "close_to_vwap": f"close / ({_vwap} + {E10}) - 1",
    "vwap_dev_5": f"(close - {_vwap}) / ({_vwap} + {E10})",
    "vwap": f"sum(tv) OVER {w(20)} / (sum(volume) OVER {w(20)} + {E10})",
}
feature_query(
    "features_volume", "W-21 W-23 W-24 W-25 W-26 W-27 W-36", ["money_flow", "volume_ratios", "vwap_family"],
    f"SELECT *, CAST(volume_surge > 2 AS INTEGER) AS volume_surge_flag FROM ({select(_vol, _flow)})",
    [*_vol, "volume_surge_flag"],
)

_stat = {f"skewness_{n}": full("lr", n, "skewness") for n in (20,)}
_stat |= {f"realized_skew_{n}": full("lr", n, "skewness") for n in (20, 60)}
_stat["kurtosis_20"] = full("lr", 20, "kurtosis")
_stat |= {
    f"zscore_{n}": f"(close - ({full('close', n, 'avg')})) / (({full('close', n, 'stddev_samp')}) + {E10})" for n in (20, 50)
}
for _name, n in (("autocorr_5", 20), ("return_autocorr_1", 10)):
    _stat[_name] = f"CASE WHEN rn >= {n} + 2 THEN corr(lr, lr1) OVER {w(n)} END"
feature_query(
    "features_moments", "W-28 W-29 W-30 W-31", ["moments", "autocorrelations"],
    select(_stat, f"(SELECT *, {lag('lr', 1)} AS lr1 FROM rbars)"), list(_stat),
)

_s5, _s20, _s60 = (f"({full('lr', n, 'stddev_samp')})" for n in (5, 20, 60))
_micro = {
    "range_expansion": f"(high - low) / (({full('hl', 5, 'avg')}) + {E10})",
    "vol_ratio_5_20": f"{_s5} * sqrt(252) / ({_s20} * sqrt(252) + {E10})",
    "vol_regime_60_20": f"{_s60} / ({_s20} + {E10})",
    "idiosyncratic_return": f"lr - ({full('lr', 20, 'avg')})",
    "momentum_accel": f"({pct('close', 5)}) - ({pct('close', 10)}) / 2",
    "amihud_illiq": full("illiq", 20, "avg"),
    "order_flow_imbalance": "imb",
    "order_flow_ma5": full("imb", 5, "avg"),
    "efficiency_ratio_20": f"abs(close - {lag('close', 20)}) / (({full('alr', 20, 'sum')}) + {E10})",
    "efficiency_ratio_norm_20": f"abs(close - {lag('close', 20)}) / (({full('step', 20, 'sum')}) + {E10})",
}
feature_query(
    "features_microstructure", "W-32 W-33 W-34 W-35 W-37 W-38 W-39", ["microstructure"],
    select(_micro, f"""(SELECT *, high - low AS hl, abs(lr) / (volume + 1) AS illiq, abs(lr) AS alr, abs(close - c1) AS step,
                       (close - open) / (high - low + {E10}) AS imb FROM rbars)"""),
    {**{c: 6 for c in _micro}, "amihud_illiq": 9, "order_flow_imbalance": 4, "order_flow_ma5": 4, "range_expansion": 4},
)

_lags = {f"close_lag_{k}": lag("close", k) for k in ft.PRICE_LAGS}
_lags |= {f"close_return_lag_{k}": f"{lag('close', 1)} / {lag('close', k + 1)} - 1" for k in ft.PRICE_LAGS}
_lags |= {f"volume_lag_{k}": lag("volume", k) for k in ft.VOLUME_LAGS}
_lags |= {f"volume_return_lag_{k}": f"{lag('volume', 1)} / {lag('volume', k + 1)} - 1" for k in ft.VOLUME_LAGS}
_lags |= {f"return_lag_{k}": lag("lr", k) for k in ft.RETURN_LAGS}
feature_query("features_lags", "W-40 W-41 W-42", ["lags"], select(_lags), list(_lags))

feature_query(
    "features_calendar", "W-43 F-4", ["calendar"],
    """SELECT symbol, time, CAST(isodow(time) - 1 AS INTEGER) AS day_of_week, CAST(month(time) AS INTEGER) AS month,
       CAST(quarter(time) AS INTEGER) AS quarter, CAST(day(time) = 1 AS INTEGER) AS is_month_start,
       CAST(CAST(time AS DATE) = last_day(time) AS INTEGER) AS is_month_end FROM rbars""",
    [], ["day_of_week", "month", "quarter", "is_month_start", "is_month_end"],
)

_tgt, _flags = {}, []
for h in ft.HORIZONS:
    fut = f"lead(close, {h}) OVER {ALL}"
    _tgt |= {f"target_{h}": f"{fut} / close - 1", f"future_price_{h}": fut}
    nxt = f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    _tgt[f"target_vol_{h}"] = (
        f"abs(lead(lr, 1) OVER {ALL}) * sqrt(252)"
        if h == 1
        else f"CASE WHEN count(lr) OVER {nxt} = {h} THEN stddev_samp(lr) OVER {nxt} * sqrt(252) END"
    )
    _flags += [f"target_dir_{h}", f"target_strong_{h}"]
feature_query(
    "forward_targets", "W-44 W-45 W-46 P-23", ["targets"],
    "SELECT *, " + ", ".join(
        f"CAST(target_{h} > 0 AS INTEGER) AS target_dir_{h}, CAST(abs(target_{h}) > 0.01 AS INTEGER) AS target_strong_{h}"
        for h in ft.HORIZONS) + f" FROM ({select(_tgt)})",
    [*_tgt, *_flags],
)


@query(
    "targets_complete_rows", "W-47",
    "SELECT symbol, time, t1 AS target_1, t20 AS target_20 FROM "
    f"(SELECT *, lead(close, 1) OVER {ALL} / close - 1 AS t1, lead(close, 20) OVER {ALL} / close - 1 AS t20 FROM rbars) "
    "WHERE t1 IS NOT NULL AND t20 IS NOT NULL",
    ["rbars"], ["time"], ["target_1", "target_20"], KEYS,
)
def _(i: Inputs) -> DataFrame:
    return panel_features(i, ["targets"]).dropna(subset=[f"target_{h}" for h in ft.HORIZONS])


_wide = f"SELECT *, {full('close', 200, 'avg')} AS s200, {full('lr', 20, 'stddev_samp')} AS v20 FROM rbars"


@query(
    "features_after_warm_up", "P-7 P-14 P-11",
    f"""SELECT symbol, time, close / s200 - 1 AS close_to_sma_200, coalesce(v20 * sqrt(252), 0) AS volatility_20d,
        coalesce({lag('close', 20).replace('rbars', 'x')} * 0 + close / {lag('close', 20)} - 1, 0) AS return_20d
        FROM ({_wide}) QUALIFY s200 IS NOT NULL""",
    ["rbars"], ["time"], ["close_to_sma_200", "volatility_20d", "return_20d"], KEYS,
)
def _(i: Inputs) -> DataFrame:
    f = panel_features(i, ["price_action", "moving_averages"])
    kept = ft.feature_columns(f.columns)
    return fill_zero(drop_warm_up(f.select("symbol", "time", *kept)), kept)


_parts = [f for f in FAMILY_SQL if "target_1" not in f[1]]
_panel = "SELECT * FROM " + " JOIN ".join(
    f"({sql}) f{k}" + (" USING (symbol, time)" if k else "") for k, (sql, _, _) in enumerate(_parts)
)


@query(
    "feature_panel_all", "P-11 P-14 X-3 F-7", _panel, ["rbars"], ["time"],
    {c: d for _, ds, _ in _parts for c, d in ds.items()}, [*KEYS, *[c for _, _, ints in _parts for c in ints]],
)
def _(i: Inputs) -> DataFrame:
    """Every technical family at once: one shuffle for all windows and recurrences."""
    return panel_features(i, ft.TECHNICAL)


@query(
    "forecast_sequences", "W-REC-4",
    f"""SELECT symbol, time, y, len(xs) AS steps, list_sum(list_transform(xs, lambda v: v)) AS total, xs[1] AS oldest, xs[120] AS newest
        FROM (SELECT symbol, time, rn, lead(close, 1) OVER {ALL} / close - 1 AS y,
          list(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS xs FROM rbars) WHERE rn > 120""",
    ["rbars"], ["time"], {"y": 6, "total": 4, "oldest": 6, "newest": 6}, [*KEYS, "steps"],
)
def _(i: Inputs) -> DataFrame:
    f = ft.build_features(i.panel(), ["targets"], keep=["symbol", "time", "rn", "close"])
    s = forecast_sequences(f, ["close"], "target_1", 120)
    flat = F.flatten("x")
    return s.select(
        "symbol", "time", F.col("y"), F.size("x").cast("long").alias("steps"),
        F.aggregate(flat, F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.element_at(flat, 1).alias("oldest"), F.element_at(flat, -1).alias("newest"),
    )


@query(
    "latest_padded_sequence", "W-REC-5",
    """SELECT symbol, CAST(greatest(0, 400 - count(*)) AS BIGINT) AS pad, sum(close) FILTER (WHERE k <= 400) AS total,
       arg_max(close, time) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM rbars) GROUP BY symbol""",
    ["rbars"], (), {"total": 4, "newest": 6}, [*KEYS, "pad"],
)
def _(i: Inputs) -> DataFrame:
    s = padded_tail(i.panel(), ["close"], 400)
    flat = F.flatten("x")
    return s.select(
        "symbol",
        F.size(F.filter(flat, lambda v: v == 0.0)).cast("long").alias("pad"),
        F.aggregate(flat, F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.element_at(flat, -1).alias("newest"),
    )


@query(
    "rolling_median_spread", "X-2",
    f"SELECT symbol, time, CASE WHEN rn >= 9 THEN median(high - low) OVER {w(9)} END AS median_spread FROM rbars",
    ["rbars"], ["time"], ["median_spread"], KEYS,
)
def _(i: Inputs) -> DataFrame:
    fold = ft.window_udf(9, lambda a: F.element_at(F.array_sort(a), 5), F.col("high") - F.col("low"))
    return ft.build_features(i.panel(), (), keep=["symbol", "time"], custom=[lambda b: fold(b, "median_spread")])


@query(
    "rounded_outputs", "P-18 F-7",
    "SELECT symbol, time, round_even(close / 7.3, 3) AS close, round_even(high / low / 3, 3) AS spread, round_even(volume / 8, 0) AS lots FROM rbars",
    ["rbars"], ["time"], ["close", "spread", "lots"], KEYS,
)
def _(i: Inputs) -> DataFrame:
    """Display rounding: ties go to the even digit."""
    half_even = F.bround
    return i.panel().select(
        "symbol", "time", half_even(F.col("close") / 7.3, 3).alias("close"), half_even(F.col("high") / F.col("low") / 3, 3).alias("spread"),
        half_even(F.col("volume") / 8, 0).alias("lots"),
    )


@query(
    "symbol_text_parts", "F-1 F-16",
    """SELECT DISTINCT symbol, upper(split_part(symbol, '#', 1)) AS exchange, lpad(split_part(symbol, '#', 2), 4, '0') AS code,
        concat_ws('|', lower(symbol), substr(symbol, 1, 3), replace(symbol, '#', '-USD')) AS joined,
        CAST(starts_with(symbol, 'Brand#1') AS INTEGER) AS ones, CAST(ends_with(replace(symbol, '#1', '-USD'), '-USD') AS INTEGER) AS coin FROM bars""",
    ["bars"], (), (), ["symbol", "exchange", "code", "joined", "ones", "coin"],
)
def _(i: Inputs) -> DataFrame:
    s = F.col("symbol")
    part = F.split(s, "#")
    return i.bars().select("symbol").distinct().select(
        "symbol", F.upper(F.element_at(part, 1)).alias("exchange"), F.lpad(F.element_at(part, 2), 4, "0").alias("code"),
        F.concat_ws("|", F.lower(s), F.substring(s, 1, 3), F.replace(s, F.lit("#"), F.lit("-USD"))).alias("joined"),
        s.startswith("Brand#1").cast("int").alias("ones"),
        F.replace(s, F.lit("#1"), F.lit("-USD")).endswith("-USD").cast("int").alias("coin"),
    )
