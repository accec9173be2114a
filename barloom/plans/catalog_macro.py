"""Macro features, as-of joins and rule-based regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import macro as mc
from barloom.operators import regime
from barloom.plans.fixtures import SERIES, Inputs
from barloom.plans.registry import query


@query("macro_aligned", "J-2 P-5", "SELECT * FROM macro", ["macro"], ["time"], list(SERIES))
def _(i: Inputs) -> DataFrame:
    return mc.align_series(i.macro_long(), SERIES)


def _roll(n: int) -> str:
    return f"(ORDER BY time ROWS {n - 1} PRECEDING)"


def _lr(c: str, k: int = 1) -> str:
    return f"ln({c} / lag({c}, {k}) OVER t)"


def _z(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {_roll(n)} = {n} THEN CASE WHEN abs({c} - avg({c}) OVER {_roll(n)}) <= 1e-12 * abs(avg({c}) OVER {_roll(n)}) THEN 0 ELSE {c} - avg({c}) OVER {_roll(n)} END / (stddev_samp({c}) OVER {_roll(n)} + 1e-10) END"


_cols = {
    "vix_level": "vix",
    "vix_change_1d": "vix / lag(vix, 1) OVER t - 1",
    "vix_change_5d": "vix / lag(vix, 5) OVER t - 1",
    "vix_zscore_20": _z("vix", 20),
    "vix_high_regime": "CAST(vix > 25 AS INTEGER)",
    "vix_extreme_regime": "CAST(vix > 40 AS INTEGER)",
    "sp500_return_1d": _lr("sp500"),
    "sp500_return_5d": _lr("sp500", 5),
    "sp500_return_20d": _lr("sp500", 20),
    "sp500_zscore_50": _z("sp500", 50),
    "sp500_bull_regime": f"CAST(sp500 > CASE WHEN count(sp500) OVER {_roll(200)} = 200 THEN avg(sp500) OVER {_roll(200)} END AS INTEGER)",
    "nasdaq_return_1d": _lr("nasdaq"),
    "nasdaq_return_5d": _lr("nasdaq", 5),
    "rut_return_1d": _lr("russell2000"),
    "small_large_spread": f"{_lr('russell2000')} - {_lr('sp500')}",
    "yield_10y": "yield_10y",
    "yield_10y_change_1d": "yield_10y - lag(yield_10y, 1) OVER t",
    "yield_10y_change_5d": "yield_10y - lag(yield_10y, 5) OVER t",
    "yield_10y_zscore_60": _z("yield_10y", 60),
    "yield_3m": "yield_3m",
    "yield_3m_change_1d": "yield_3m - lag(yield_3m, 1) OVER t",
    "yield_curve_spread": "yield_10y - yield_3m",
    "yield_curve_inverted": "CAST(yield_10y < yield_3m AS INTEGER)",
    "tlt_return_1d": _lr("tlt"),
    "tlt_return_5d": _lr("tlt", 5),
    "hyg_return_1d": _lr("hyg"),
    "credit_risk_spread": f"{_lr('hyg')} - {_lr('tlt')}",
}
for c in ("dxy", "gold", "oil"):
    _cols |= {f"{c}_return_1d": _lr(c), f"{c}_return_5d": _lr(c, 5), f"{c}_zscore_20": _z(c, 20)}
_macro_sql = (
    "SELECT *, CAST(dxy_zscore_20 > 1 AS INTEGER) AS dxy_strong, "
    "(CAST(sp500_return_1d > 0 AS INTEGER) + CAST(vix_change_1d < 0 AS INTEGER)) / 2.0 AS risk_on_signal, "
    + ", ".join(
        f"lag({c}, {k}) OVER (ORDER BY time) AS {c}_lag_{k}"
        for c in ("vix_level", "yield_10y", "sp500_return_1d", "dxy_return_1d")
        for k in (1, 5)
    )
    + " FROM (SELECT time, "
    + ", ".join(f"{e} AS {c}" for c, e in _cols.items())
    + " FROM macro WINDOW t AS (ORDER BY time))"
)


@query(
    "macro_features", "W-52 W-53 W-54 W-55 W-56 W-57 W-58 W-59 P-23", _macro_sql, ["macro"], ["time"],
    mc.macro_feature_names(),
)
def _(i: Inputs) -> DataFrame:
    return mc.macro_features(i.macro())


@query(
    "panel_with_macro_asof", "J-1 J-3",
    f"SELECT b.symbol, b.close, m.* EXCLUDE (time), b.time FROM bars b ASOF LEFT JOIN ({_macro_sql}) m ON b.time >= m.time",
    ["bars", "macro"], ["time"], ["close", *mc.macro_feature_names()], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    m = mc.macro_features(i.macro())
    return mc.asof_global(i.bars(), m.select("time", *mc.macro_feature_names()))


@query(
    "macro_asof_clipped_start", "J-1 P-6",
    """SELECT b.symbol, b.time, coalesce(m.oil, (SELECT arg_min(oil, time) FROM late)) AS oil FROM bars b
       ASOF LEFT JOIN late m ON b.time >= m.time""".replace("late", "(SELECT time, oil FROM macro WHERE time >= TIMESTAMP '1996-06-01')"),
    ["bars", "macro"], ["time"], ["oil"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    late = i.macro().where("time >= timestamp'1996-06-01'").select("time", "oil")
    return mc.asof_global(i.bars(), late, back_fill=True)


@query(
    "signal_asof_hourly_close", "J-1 T-11",
    """SELECT s.id, s.symbol, s.generated_at, b.price FROM
       (SELECT event_id AS id, event_type AS symbol, ts AS generated_at FROM events WHERE value <= 50) s
       ASOF LEFT JOIN (SELECT symbol, ts, max(price) AS price FROM event_ticks WHERE price > 50 GROUP BY ALL) b
       ON s.symbol = b.symbol AND s.generated_at >= b.ts""",
    ["event_ticks"], ["generated_at"], ["price"], ["id", "symbol"],
)
def _(i: Inputs) -> DataFrame:
    e = i.table("events").where("value <= 50")
    left = e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("generated_at"), F.col("event_id").alias("id"))
    quotes = i.event_ticks().where("price > 50").groupBy("symbol", F.col("ts").alias("generated_at"))
    return mc.asof_keyed(left, quotes.agg(F.max("price").alias("price")), ["symbol"], "generated_at", ["price"])


_regime_label = """CASE WHEN coalesce(vix, 20) >= 40 THEN 'crisis'
  WHEN coalesce(sp500 > ma, true) THEN CASE WHEN coalesce(vix, 20) < 15 THEN 'bull_low_vol' ELSE 'bull_high_vol' END
  ELSE CASE WHEN coalesce(vix, 20) < 25 THEN 'bear_low_vol' ELSE 'bear_high_vol' END END"""
_regime_rows = f"""SELECT *, {_regime_label} AS raw FROM (SELECT time, vix * 1.4 - 15 AS vix, sp500,
  CASE WHEN count(sp500) OVER {_roll(200)} >= 50 THEN avg(sp500) OVER {_roll(200)} END AS ma FROM macro)"""
_regime_smooth = f"""WITH rr AS (SELECT *, row_number() OVER (ORDER BY time) AS rn FROM ({_regime_rows})),
  votes AS (SELECT a.rn, b.raw AS label, count(*) AS k FROM rr a JOIN rr b ON b.rn BETWEEN a.rn - 4 AND a.rn GROUP BY ALL),
  best AS (SELECT rn, label, row_number() OVER (PARTITION BY rn ORDER BY k DESC, label) AS j FROM votes)
  SELECT rr.time, rr.raw, best.label AS regime, rr.rn FROM rr JOIN best ON rr.rn = best.rn AND best.j = 1"""


def regimes(i: Inputs) -> DataFrame:
    m = i.macro().select("time", (F.col("vix") * 1.4 - 15).alias("vix"), "sp500")
    return regime.rule_regimes(m)


@query("market_regimes_smoothed", "W-REC-3 W-REC-6", _regime_smooth, ["macro"], ["time"], (), ["raw", "regime"])
def _(i: Inputs) -> DataFrame:
    return regimes(i)


@query(
    "regime_transitions", "A-13",
    f"""SELECT regime, next, n, n / sum(n) OVER (PARTITION BY regime) AS p FROM (
        SELECT regime, next, count(*) AS n FROM (SELECT regime, lead(regime) OVER (ORDER BY time) AS next FROM ({_regime_smooth}))
        WHERE next IS NOT NULL GROUP BY ALL)""",
    ["macro"], (), ["p"], ["regime", "next", "n"],
)
def _(i: Inputs) -> DataFrame:
    return regime.transition_matrix(regimes(i))


@query(
    "regime_distribution", "A-13",
    f"""SELECT regime, count(*) / sum(count(*)) OVER () AS share, count(*) AS n FROM ({_regime_smooth}) GROUP BY regime""",
    ["macro"], (), ["share"], ["regime", "n"],
)
def _(i: Inputs) -> DataFrame:
    return regime.distribution(regimes(i))


@query(
    "regime_recent_history", "W-REC-7 A-13",
    f"""SELECT time, regime, CAST(sum(CAST(changed AS BIGINT)) OVER () AS BIGINT) AS changes FROM (
        SELECT time, regime, row_number() OVER (ORDER BY time DESC) AS k,
          row_number() OVER (ORDER BY time DESC) <= 19 AND regime <> lag(regime) OVER (ORDER BY time) AS changed
        FROM ({_regime_smooth})) WHERE k <= 60""",
    ["macro"], ["time"], (), ["regime", "changes"],
)
def _(i: Inputs) -> DataFrame:
    return regime.recent_history(regimes(i), 60, 20)


_w_rows = [(r, m, v) for r, ws in regime.REGIME_WEIGHTS.items() for m, v in ws.items()]
_w_rows += [(r, m, v) for r in ("bull_high_vol", "bear_low_vol") for m, v in regime.EQUAL_WEIGHTS.items()]


@query(
    "regime_weights", "J-9",
    f"""SELECT r.time, r.regime, m.model, m.weight FROM ({_regime_smooth}) r
        JOIN (VALUES {", ".join(f"('{r}', '{m}', {v})" for r, m, v in _w_rows)}) m(regime, model, weight) USING (regime)""",
    ["macro"], ["time"], ["weight"], ["regime", "model"],
)
def _(i: Inputs) -> DataFrame:
    return regime.regime_weights(regimes(i))


# the given forecasters stand for the members of the weight table
_MEMBERS = {
    "bull_low_vol": {"momentum": 0.5, "reversal": 0.3, "flat": 0.2},
    "bear_high_vol": {"reversal": 0.6, "flat": 0.4},
    "crisis": {"flat": 1.0},
}
_m_rows = [(r, m, v) for r, ws in _MEMBERS.items() for m, v in ws.items()]
_m_rows += [(r, m, 1 / 3) for r in ("bull_high_vol", "bear_low_vol") for m in ("momentum", "reversal", "flat")]


@query(
    "regime_weighted_forecasts", "M-14 J-9",
    f"""SELECT p.symbol, p.time, any_value(g.regime) AS regime, sum(m.weight * p.y_pred) / sum(m.weight) AS y_pred, count(*) AS n_models FROM predictions p
        JOIN (SELECT t.time, r.regime FROM (SELECT DISTINCT time FROM predictions) t ASOF JOIN (SELECT time, regime FROM ({_regime_smooth})) r ON t.time >= r.time) g ON g.time = p.time
        JOIN (VALUES {", ".join(f"('{r}', '{m}', {v})" for r, m, v in _m_rows)}) m(regime, model, weight) ON m.regime = g.regime AND m.model = p.model GROUP BY p.symbol, p.time""",
    ["macro", "predictions"], ["time"], {"y_pred": 9}, ["symbol", "regime", "n_models"],
)
def _(i: Inputs) -> DataFrame:
    third = dict.fromkeys(("momentum", "reversal", "flat"), 1 / 3)
    table = _MEMBERS | {"bull_high_vol": third, "bear_low_vol": third}
    return regime.weighted_forecasts(i.predictions(), regimes(i), table)
