"""Forecast metrics, strategy metrics, ensembles and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import metrics as mt
from barloom.operators import splits
from barloom.operators.crosssection import with_sector
from barloom.operators.layout import chunk_of
from barloom.operators.ranks import quantiles_large_groups, rank_correlation, small_group_rank_correlation
from barloom.plans.fixtures import WEEK, Inputs
from barloom.plans.registry import query

YEAR_CHUNK = 52 * WEEK


def avg_rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + count(*) OVER (PARTITION BY {by} ORDER BY {x})) / 2.0"


def ic_sql(by: str, source: str = "predictions", minimum: int = 1) -> str:
    return f"""SELECT {by}, CASE WHEN count(*) >= {minimum} THEN CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END END AS ic, count(*) AS n FROM (
      SELECT {by}, {avg_rank('y_true', by)} AS ra, {avg_rank('y_pred', by)} AS rb FROM {source}) GROUP BY {by}"""


_ERR = """avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
  100 * avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred) + 1e-8)) AS smape,
  1 - sum((y_true - y_pred) ** 2) / (count(*) * var_pop(y_true) + 1e-10) AS r2,
  avg(CAST(sign(y_true) = sign(y_pred) AS DOUBLE)) AS directional_accuracy, count(*) AS n_samples"""
_ERR_COLS = ["mae", "rmse", "smape", "r2", "directional_accuracy"]


@query(
    "prediction_metrics", "A-4 A-6",
    f"SELECT * FROM (SELECT model, {_ERR} FROM predictions GROUP BY model) JOIN ({ic_sql('model')}) USING (model)",
    ["predictions"], (), [*_ERR_COLS, "ic"], ["model", "n_samples"],
)
def _(i: Inputs) -> DataFrame:
    return mt.prediction_metrics(i.predictions(), ["model"])


@query(
    "prediction_metrics_by_level", "A-27",
    f"""SELECT sector, symbol, model, {_ERR} FROM (SELECT p.*, coalesce(sector, 'other') AS sector FROM predictions p LEFT JOIN sector USING (symbol))
        GROUP BY GROUPING SETS ((), (model), (model, sector), (model, sector, symbol))""",
    ["predictions", "sector"], (), _ERR_COLS, ["model", "sector", "symbol", "n_samples"],
)
def _(i: Inputs) -> DataFrame:
    return mt.rollup_metrics(with_sector(i.predictions(), i.sector()), ["model", "sector", "symbol"])


@query(
    "rank_correlation_by_level", "A-27 A-6",
    f"""{ic_sql('model, level, member', '''(SELECT model, y_true, y_pred, 'universal' AS level, 'all' AS member FROM predictions
        UNION ALL SELECT model, y_true, y_pred, 'sector', coalesce(sector, 'other') FROM predictions LEFT JOIN sector USING (symbol))''')}""",
    ["predictions", "sector"], (), ["ic"], ["model", "level", "member", "n"],
)
def _(i: Inputs) -> DataFrame:
    rows = with_sector(i.predictions(), i.sector())
    stacked = mt.by_level(rows, {"universal": None, "sector": "sector"}, ["model", "y_true", "y_pred"])
    return rank_correlation(stacked, ["model", "level", "member"], "y_true", "y_pred")


@query(
    "strided_rank_correlation", "A-5 A-6",
    f"""SELECT model, symbol, CASE WHEN n_s >= 5 THEN coalesce(s.ic, 0) ELSE coalesce(a.ic, 0) END AS ic, coalesce(n_s, 0) AS n_independent, a.n AS n_samples
        FROM ({ic_sql('model, symbol')}) a LEFT JOIN (SELECT * RENAME (n AS n_s) FROM ({ic_sql('model, symbol', '(SELECT * FROM predictions WHERE (rn - 1) % 5 = 0)')})) s
        USING (model, symbol)""",
    ["predictions"], (), ["ic"], ["model", "symbol", "n_independent", "n_samples"],
)
def _(i: Inputs) -> DataFrame:
    return mt.ic_by_stride(i.predictions(), ["model", "symbol"], 5, "rn")


def _strategy_sql() -> str:
    pos = """SELECT p.*, CASE WHEN y_pred > 0 THEN 1.0 ELSE 0.0 END AS pl,
      CASE WHEN y_pred >= quantile_cont(y_pred, 0.67) OVER m THEN 1.0 WHEN y_pred <= quantile_cont(y_pred, 0.33) OVER m THEN -1.0 ELSE 0.0 END AS ps
      FROM predictions p WINDOW m AS (PARTITION BY model, symbol)"""
    turn = f"""SELECT *, abs(pl - coalesce(lag(pl) OVER w, 0)) AS tl, abs(ps - coalesce(lag(ps) OVER w, 0)) AS ts FROM ({pos})
      WINDOW w AS (PARTITION BY model, symbol ORDER BY time)"""
    return f"SELECT *, pl * y_true - tl * 0.001 AS rl, ps * y_true - ts * 0.001 AS rs FROM ({turn})"


def _perf_sql(rows: str, by: str, ret: str, turn: str, horizon: int, prefix: str = "") -> str:
    curve = f"""SELECT *, product(1 + {ret}) OVER (PARTITION BY {by} ORDER BY time) AS curve FROM ({rows})"""
    peak = f"SELECT *, max(curve) OVER (PARTITION BY {by} ORDER BY time) AS peak FROM ({curve})"
    agg = f"""SELECT {by}, count(*) AS n, avg({ret}) AS mu, stddev_pop({ret}) AS sd, stddev_pop({ret}) FILTER (WHERE {ret} < 0) AS dn,
      min((curve - peak) / (peak + 1e-10)) AS mdd, avg({turn}) AS tr FROM ({peak}) GROUP BY {by}"""
    k = f"sqrt(252.0 / {horizon})"
    return f"""SELECT {by}, CASE WHEN sd > 1e-18 THEN mu / sd * {k} ELSE 0 END AS {prefix}sharpe,
      CASE WHEN dn > 1e-18 THEN mu / dn * {k} ELSE 0 END AS {prefix}sortino,
      CASE WHEN abs(mdd) > 1e-6 THEN mu * 252.0 / {horizon} / abs(mdd) ELSE 0 END AS {prefix}calmar,
      ln(1 + abs(mdd)) AS {prefix}drawdown_size, mu * 252.0 / {horizon} AS {prefix}annual_return, tr AS {prefix}turnover FROM ({agg}) WHERE n >= 10"""


_PERF = ["sharpe", "sortino", "calmar", "drawdown_size", "annual_return", "turnover"]


def _sized(df: DataFrame) -> DataFrame:
    """Drawdowns on a log scale: a short position in this invented data can lose many times 100 %."""
    for p in ("", "ls_"):
        df = df.withColumn(f"{p}drawdown_size", F.log1p(F.abs(f"{p}max_drawdown")))
    return df


def strategy(i: Inputs) -> DataFrame:
    # staged: the scans below read it more than once
    return i.once(
        "strategy",
        lambda: mt.strategy_returns(i.predictions(), ["model", "symbol"], ["time"], chunk_of("time", YEAR_CHUNK)),
    )


@query(
    "strategy_performance_by_symbol", "A-5 W-REC-2",
    f"""SELECT * FROM ({_perf_sql(_strategy_sql(), 'model, symbol', 'rl', 'tl', 5)}) JOIN
        ({_perf_sql(_strategy_sql(), 'model, symbol', 'rs', 'ts', 5, 'ls_')}) USING (model, symbol)""",
    ["predictions"], (), _PERF + ["ls_" + c for c in _PERF], ["model", "symbol"],
)
def _(i: Inputs) -> DataFrame:
    return _sized(mt.performance(strategy(i), ["model", "symbol"], ["time"], chunk_of("time", YEAR_CHUNK), 5))


_port = f"SELECT model, time, avg(rl) AS rl, avg(tl) AS tl, avg(rs) AS rs, avg(ts) AS ts FROM ({_strategy_sql()}) GROUP BY ALL"


@query(
    "strategy_performance_portfolio", "A-5",
    f"""SELECT * FROM ({_perf_sql(_port, 'model', 'rl', 'tl', 5)}) JOIN ({_perf_sql(_port, 'model', 'rs', 'ts', 5, 'ls_')}) USING (model)""",
    ["predictions"], (), _PERF + ["ls_" + c for c in _PERF], ["model"],
)
def _(i: Inputs) -> DataFrame:
    rows = mt.portfolio_returns(strategy(i), ["model"])
    return _sized(mt.performance(rows, ["model"], ["time"], chunk_of("time", YEAR_CHUNK), 5))


@query(
    "forecast_quantiles", "A-5",
    "SELECT model, quantile_cont(y_pred, 0.33) AS p33, quantile_cont(y_pred, 0.5) AS p50, quantile_cont(y_pred, 0.67) AS p67 FROM predictions GROUP BY model",
    ["predictions"], (), ["p33", "p50", "p67"], ["model"],
)
def _(i: Inputs) -> DataFrame:
    return quantiles_large_groups(i.predictions(), ["model"], "y_pred", {"p33": 0.33, "p50": 0.5, "p67": 0.67})


def _fold_ic_sql() -> str:
    axis = "SELECT time, row_number() OVER (ORDER BY time) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM bars)"
    rows = f"""SELECT p.model, p.time, p.y_true, p.y_pred, (a.t - 100) // 26 AS fold FROM predictions p JOIN ({axis}) a USING (time)
      WHERE a.t >= 100 AND 100 + ((a.t - 100) // 26 + 1) * 26 <= a.n"""
    return f"""SELECT model, fold, avg(ic) AS ic FROM ({ic_sql('model, fold, time', f'({rows})', 3)}) GROUP BY ALL"""


def fold_ics(i: Inputs) -> DataFrame:
    axis = splits.time_axis(i.bars())
    folds = splits.walk_forward_folds(axis, 100, 26, horizon=5)
    per_time = small_group_rank_correlation(i.predictions(), ["model", "time"], "y_true", "y_pred", 3)
    placed = per_time.join(splits.test_fold_of(axis, folds, 100, 26, 26), "time")
    return placed.groupBy("model", "fold").agg(F.avg("ic").alias("ic"))


@query("walk_forward_fold_ic", "A-7 M-5 M-4", _fold_ic_sql(), ["bars", "predictions"], (), ["ic"], ["model", "fold"])
def _(i: Inputs) -> DataFrame:
    return fold_ics(i)


@query(
    "walk_forward_summary", "A-8 A-9 M-4",
    f"""SELECT model, avg(ic) AS mean_ic, stddev_pop(ic) AS ic_stability, CASE WHEN count(ic) >= 2 AND stddev_pop(ic) >= 1e-10 THEN
        avg(ic) / stddev_pop(ic) * sqrt(252 / 26.0) END AS ic_sharpe, avg(CAST(ic > 0 AS DOUBLE)) AS hit_rate, count(ic) AS n_folds
        FROM ({_fold_ic_sql()}) GROUP BY model""",
    ["bars", "predictions"], (), ["mean_ic", "ic_stability", "ic_sharpe", "hit_rate"], ["model", "n_folds"],
)
def _(i: Inputs) -> DataFrame:
    return mt.fold_summary(fold_ics(i), ["model"], window=26)


_weights = """SELECT model, round_even((1 / rmse) / sum(1 / rmse) OVER (), 4) AS weight FROM (
  SELECT model, sqrt(avg((y_true - y_pred) ** 2)) AS rmse FROM predictions GROUP BY model)"""


def model_weights(i: Inputs) -> DataFrame:
    rmse = i.predictions().groupBy("model").agg(mt.error_metrics()["rmse"].alias("rmse"))
    return mt.inverse_error_weights(rmse, [])


@query("ensemble_weights", "A-17", _weights, ["predictions"], (), ["weight"], ["model"])
def _(i: Inputs) -> DataFrame:
    return model_weights(i)


@query(
    "weighted_ensemble", "A-18 J-16",
    f"""SELECT symbol, time, sum(weight * y_pred) / sum(weight) AS ensemble, count(*) AS n_models FROM predictions JOIN ({_weights}) USING (model) GROUP BY ALL""",
    ["predictions"], ["time"], ["ensemble"], ["symbol", "n_models"],
)
def _(i: Inputs) -> DataFrame:
    w = model_weights(i).select("model", "weight")
    return mt.weighted_ensemble(i.predictions(), w, ["symbol", "time"])


@query(
    "predictions_side_by_side", "J-16",
    """SELECT symbol, time, max(y_pred) FILTER (WHERE model = 'reversal') AS reversal, max(y_pred) FILTER (WHERE model = 'momentum') AS momentum
       FROM predictions GROUP BY ALL""",
    ["predictions"], ["time"], ["reversal", "momentum"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return i.predictions().groupBy("symbol", "time").pivot("model", ["reversal", "momentum"]).agg(F.max("y_pred"))


@query(
    "scaled_on_train_rows", "A-20 M-1",
    """SELECT symbol, time, (close - avg(close) FILTER (WHERE split = 'train') OVER ()) / stddev_pop(close) FILTER (WHERE split = 'train') OVER () AS close,
       (volume - avg(volume) FILTER (WHERE split = 'train') OVER ()) / stddev_pop(volume) FILTER (WHERE split = 'train') OVER () AS volume, split
       FROM (SELECT *, CASE WHEN rn - 1 >= ts THEN 'test' WHEN rn - 1 >= floor(ts * (1 - 0.1 / 0.8)) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS ts FROM rbars QUALIFY count(*) OVER (PARTITION BY symbol) >= 50))""",
    ["rbars"], ["time"], ["close", "volume"], ["symbol", "split"],
)
def _(i: Inputs) -> DataFrame:
    return mt.scale_on_train(splits.chronological_split(i.panel()), ["close", "volume"])


_q = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
_shift = {k: (v - 0.5) / 10 for k, v in _q.items()}


@query(
    "quantile_forecast_losses", "A-21",
    "SELECT model, (" + " + ".join(f"avg(greatest(({lv} - 1) * (y_true - y_pred - {_shift[c]}), {lv} * (y_true - y_pred - {_shift[c]})))" for c, lv in _q.items())
    + f") / 7 AS pinball, avg((y_pred + {_shift['p90']}) - (y_pred + {_shift['p10']})) AS interval_width, count(*) AS n FROM predictions GROUP BY model",
    ["predictions"], (), ["pinball", "interval_width"], ["model", "n"],
)
def _(i: Inputs) -> DataFrame:
    d = i.predictions().select("*", *[(F.col("y_pred") + s).alias(c) for c, s in _shift.items()])
    return mt.quantile_losses(d, ["model"], "y_true", _q)


@query(
    "huber_losses", "A-22",
    """SELECT model, avg(CASE WHEN abs(y_true - y_pred) <= 0.01 THEN 0.5 * (y_true - y_pred) ** 2 ELSE 0.01 * (abs(y_true - y_pred) - 0.005) END) AS huber
       FROM predictions GROUP BY model""",
    ["predictions"], (), {"huber": 9}, ["model"],
)
def _(i: Inputs) -> DataFrame:
    return i.predictions().groupBy("model").agg(mt.huber("y_true", "y_pred").alias("huber"))


@query("bootstrap_rank_correlation", "A-10", None)
def _(i: Inputs) -> DataFrame:
    rows = i.predictions().withColumn("row", F.concat_ws("/", "symbol", F.col("time").cast("string")))
    return mt.bootstrap_rank_correlation(rows, ["model"], "row")
