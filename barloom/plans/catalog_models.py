"""Per-symbol time-series models, learned ensembles, regimes, forecast paths."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import features as ft
from barloom.operators import forecast as fc
from barloom.operators import arma, folds, garch, hidden_markov, learn, metrics, shapley, splits, trials
from barloom.plans.catalog_indicators import full, lag
from barloom.plans.fixtures import WEEK, Inputs
from barloom.plans.registry import query, registered
from barloom.sources.staging import shared_folder

_lags = f"SELECT *, {lag('lr', 1)} AS lr1 FROM rbars"
_train = f"""SELECT *, floor(max(rn) OVER (PARTITION BY symbol) * 0.8) AS cut FROM ({_lags})"""
_ar = f"""SELECT symbol, n, CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS p, CASE WHEN a1 < a0 THEN c1 ELSE m END AS const, CASE WHEN a1 < a0 THEN b1 ELSE 0 END AS phi,
    least(a0, a1) AS aic FROM (SELECT *, n * ln(rss0 / n) + 4 AS a0, n * ln(rss0 * (1 - r2) / n) + 6 AS a1 FROM (
    SELECT symbol, count(*) AS n, avg(lr) AS m, var_pop(lr) * count(*) AS rss0, regr_r2(lr, lr1) AS r2, regr_slope(lr, lr1) AS b1, regr_intercept(lr, lr1) AS c1
    FROM ({_train}) WHERE rn <= cut AND lr IS NOT NULL AND lr1 IS NOT NULL GROUP BY symbol))"""


def ar1(i: Inputs) -> DataFrame:
    return fc.autoregression(i.panel(), max_order=1)


@query("autoregression_order_1", "M-10", _ar, ["rbars"], (), ["const", "phi", "aic"], ["symbol", "n", "p"])
def _(i: Inputs) -> DataFrame:
    return ar1(i).withColumn("phi", F.aggregate("coef", F.lit(0.0), lambda a, x: a + x))


# the fitted recursion from the last train return on, one step after the other
_path = f"""WITH RECURSIVE f AS ({_ar}),
  b AS (SELECT symbol, close, lr, rn, floor(max(rn) OVER (PARTITION BY symbol) * 0.8) AS cut FROM rbars),
  z AS (SELECT b.symbol, 0 AS step, b.lr AS r, CAST(0 AS DOUBLE) AS total, b.close AS p0, f.const, f.phi,
      (SELECT max(c.rn - c.cut) FROM b c WHERE c.symbol = b.symbol) AS last FROM b JOIN f ON f.symbol = b.symbol WHERE rn = cut
    UNION ALL SELECT symbol, step + 1, const + phi * r, total + const + phi * r, p0, const, phi, last FROM z WHERE step < last),
  t AS (SELECT b.symbol, b.rn, z.step, b.lr AS y_true, z.r AS y_pred, b.close AS price, z.p0 * exp(z.total) AS price_pred
    FROM b JOIN z ON z.symbol = b.symbol AND b.rn - b.cut = z.step WHERE z.step > 0)"""


@query(
    "price_path_error", "A-23 M-10", _path + " SELECT symbol, sqrt(avg((price_pred - price) ** 2)) AS path_rmse, count(*) AS n FROM t GROUP BY symbol",
    ["rbars"], (), {"path_rmse": 4}, ["symbol", "n"],
)
def _(i: Inputs) -> DataFrame:
    return arma.path_errors(arma.forecast_paths(i.panel(), arma.as_arma(ar1(i)), 1))


@query(
    "return_forecast_paths", "A-23 M-10", _path + " SELECT symbol, rn, CAST(step AS BIGINT) AS step, y_true, y_pred, price, price_pred FROM t",
    ["rbars"], (), {"y_true": 9, "y_pred": 9, "price": 4, "price_pred": 4}, ["symbol", "rn", "step"],
)
def _(i: Inputs) -> DataFrame:
    return arma.forecast_paths(i.panel(), arma.as_arma(ar1(i)), 1)


ARMA = {"max_p": 5, "max_q": 5, "long_order": 12}


@query("arma_by_aic", "M-10 A-24", None)
def _(i: Inputs) -> DataFrame:
    """ARMA fits with the white-noise test of their residuals and the error of their price path."""
    fits = i.once("arma_fits", lambda: arma.two_stage(i.panel(), **ARMA))
    white = arma.residual_white_noise(i.panel(), fits, **ARMA).drop("n")
    path = arma.path_errors(arma.forecast_paths(i.panel(), fits, **ARMA)).drop("n")
    return fits.join(white, "symbol").join(path, "symbol", "left")


@query("arma_forecast_metrics", "M-10 A-4", None)
def _(i: Inputs) -> DataFrame:
    fits = i.once("arma_fits", lambda: arma.two_stage(i.panel(), **ARMA))
    return metrics.prediction_metrics(arma.forecast_paths(i.panel(), fits, **ARMA), ["symbol"])


@query("autoregression_by_aic", "M-10", None)
def _(i: Inputs) -> DataFrame:
    return fc.autoregression(i.panel(), max_order=5)


@query("autoregression_with_inputs", "M-11", None)
def _(i: Inputs) -> DataFrame:
    """Extra regressors: volume ratio, RSI and the return five bars back, all known before the bar."""
    f = ft.build_features(i.panel(), ["volume_ratios", "relative_strength", "lags"], keep=["symbol", "time", "rn", "close"])
    w = f.select("symbol", "time", "rn", "close", F.col("return_lag_5").alias("season"), "volume_ratio", (F.col("rsi_14") / 100).alias("rsi"))
    from barloom.operators.layout import block_panel

    b = block_panel(w, back=2)
    known = b.with_df(b.df.select("*", b.lag("volume_ratio").alias("volume_before"), b.lag("rsi").alias("rsi_before"))).own_rows()
    return fc.autoregression(known, max_order=2, extra=["season", "volume_before", "rsi_before"])


_lb = ", ".join(f"sum((e - mu) * (l{k} - mu)) / sum((e - mu) ** 2) AS r{k}" for k in range(1, 11))
_resid = f"""SELECT t.symbol, t.time, t.rn, t.lr - f.const - f.phi * t.lr1 AS e FROM ({_train}) t JOIN ({_ar}) f ON f.symbol = t.symbol
    WHERE t.rn <= t.cut AND t.lr IS NOT NULL AND t.lr1 IS NOT NULL"""


@query(
    "residual_white_noise", "A-24",
    f"""SELECT symbol, n, q AS q_stat, exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) AS p_value,
        CAST(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) > 0.05 AS INTEGER) AS white FROM (
        SELECT symbol, n, n * (n + 2) * ({" + ".join(f"r{k} ** 2 / (n - {k})" for k in range(1, 11))}) AS q FROM (
        SELECT symbol, count(*) AS n, {_lb} FROM (SELECT symbol, e, avg(e) OVER (PARTITION BY symbol) AS mu, {", ".join(f"{lag('e', k)} AS l{k}" for k in range(1, 11))}
        FROM ({_resid})) GROUP BY symbol))""",
    ["rbars"], (), ["q_stat", "p_value"], ["symbol", "n", "white"],
)
def _(i: Inputs) -> DataFrame:
    return arma.residual_white_noise(i.panel(), arma.as_arma(ar1(i)), 1)


_A, _B = (0.03, 0.06, 0.1, 0.15, 0.2), (0.6, 0.7, 0.8, 0.85, 0.9)
_garch = f"""WITH RECURSIVE st AS (SELECT symbol, regr_slope(lr, lr1) AS phi, regr_intercept(lr, lr1) AS c FROM ({_lags}) GROUP BY symbol),
  e AS (SELECT l.symbol, l.rn - 1 AS rn, l.lr - st.c - st.phi * coalesce(l.lr1, 0) AS e FROM ({_lags}) l JOIN st USING (symbol) WHERE l.lr IS NOT NULL),
  v AS (SELECT symbol, avg(e * e) AS v FROM e GROUP BY symbol),
  src AS (SELECT e.symbol, rn, e, lag(e) OVER (PARTITION BY e.symbol ORDER BY rn) AS e1, v FROM e JOIN v USING (symbol)),
  h AS (SELECT symbol, rn, e, v, a, b, v AS h FROM src, (VALUES {", ".join(f"({a}, {b})" for a in _A for b in _B if a + b < 1)}) g(a, b) WHERE rn = 1
    UNION ALL SELECT s.symbol, s.rn, s.e, s.v, p.a, p.b, p.v * (1 - p.a - p.b) + p.a * s.e1 * s.e1 + p.b * p.h FROM h p JOIN src s ON s.symbol = p.symbol AND s.rn = p.rn + 1),
  ll AS (SELECT symbol, a, b, sum(-0.5 * (ln(2 * pi()) + ln(h) + e * e / h)) AS loglik, count(*) AS n, arg_max(h, rn) AS last_variance FROM h GROUP BY ALL)"""


@query(
    "garch_grid", "M-12 W-REC-1",
    _garch + """ SELECT symbol, a AS alpha, b AS beta, a + b AS persistence, phi, loglik, 10 - 2 * loglik AS aic, 5 * ln(n) - 2 * loglik AS bic, last_variance, n
      FROM ll JOIN st USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY loglik DESC) = 1""",
    ["rbars"], (), {"alpha": 6, "beta": 6, "persistence": 6, "phi": 6, "loglik": 4, "aic": 4, "bic": 4, "last_variance": 6}, ["symbol", "n"],
)
def _(i: Inputs) -> DataFrame:
    return fc.garch_grid(i.panel())


@query("garch_likelihood", "M-12", None)
def _(i: Inputs) -> DataFrame:
    return garch.garch(i.panel())


@query(
    "future_price_paths", "F-17 K-10",
    f"""SELECT symbol, s.step, epoch_time + s.step * 604800 AS due, close * (1 + e) * (1 + r) ** (s.step - 1) AS value FROM (
        SELECT symbol, CAST(epoch(time) AS BIGINT) AS epoch_time, close, (close / {lag('close', 1)} - 1) / 20 AS e, (close / {lag('close', 5)} - 1) / 100 AS r FROM rbars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1), (SELECT unnest(range(1, 11)) AS step) s""",
    ["rbars"], (), {"value": 4}, ["symbol", "step", "due"],
)
def _(i: Inputs) -> DataFrame:
    f = ft.build_features(i.panel(), ["price_action"], keep=["symbol", "time", "close"])
    from barloom.sources.feature_store import latest_rows

    last = latest_rows(f.select("symbol", "time", "close", "return_1d", "return_5d")).select(
        "symbol", F.col("time").alias("last_time"), F.col("close").alias("price"),
        (F.col("return_1d") / 20).alias("ensemble"), (F.col("return_5d") / 100).alias("step_return"),
    )
    p = fc.future_path(last.join(fc.median_spacing(i.panel()), "symbol"), 10)
    return p.select("symbol", F.col("step").cast("long").alias("step"), F.unix_seconds("time").alias("due"), "value")


@query(
    "fallback_price_paths", "F-17",
    f"""SELECT symbol, s.step, epoch_time + s.step * 3600 AS due, close * (1 + e * s.step) AS value FROM (
        SELECT symbol, CAST(epoch(time) AS BIGINT) AS epoch_time, close, (close / {lag('close', 1)} - 1) / 20 AS e FROM rbars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1), (SELECT unnest(range(1, 6)) AS step) s""",
    ["rbars"], (), {"value": 4}, ["symbol", "step", "due"],
)
def _(i: Inputs) -> DataFrame:
    last = fc.last_rows(ft.build_features(i.panel(), ["price_action"], keep=["symbol", "time", "close", "rn"]), 1)
    start = last.select("symbol", F.col("time").alias("last_time"), F.col("close").alias("price"), (F.col("return_1d") / 20).alias("ensemble"))
    p = fc.linear_path(start, 5)
    return p.select("symbol", F.col("step").cast("long").alias("step"), F.unix_seconds("time").alias("due"), "value")


def regime_rows(i: Inputs) -> DataFrame:
    def build() -> DataFrame:
        p = ft.regime_panel(i.panel(), bar_seconds=WEEK)
        return ft.build_features(p, ["regime_inputs"], keep=["symbol", "time", "rn", "close"])

    # staged: fitting passes over it many times
    return i.once("regime_rows", build)


_lr0 = "SELECT *, coalesce(lr, 0) AS lr0 FROM rbars"
_inputs = f"""SELECT symbol, time, rn, coalesce({full('lr0', 5, 'sum')}, 0) AS ret5, coalesce({full('lr0', 20, 'stddev_samp')}, stddev_samp(lr0) OVER (PARTITION BY symbol)) AS vol20,
   greatest(0.1, least(10, coalesce(({full('volume', 5, 'avg')}) / ({full('volume', 20, 'avg')}), 1))) AS vol_ratio FROM ({_lr0})"""


_inputs = f"""SELECT i.*, greatest(-1, least(1, (coalesce(r.rsi_14, 50) - 50) / 50)) AS rsi_norm, coalesce(a.atr_14 / b.close, 0) AS atr_ratio FROM ({_inputs}) i
   JOIN rbars b ON b.symbol = i.symbol AND b.time = i.time LEFT JOIN ({registered()["features_rsi"].sql}) r ON r.symbol = i.symbol AND r.time = i.time
   LEFT JOIN ({registered()["features_average_true_range"].sql}) a ON a.symbol = i.symbol AND a.time = i.time"""


@query("regime_model_inputs", "W-REC-8", _inputs, ["rbars"], ["time"], ["ret5", "vol20", "vol_ratio", "rsi_norm", "atr_ratio"], ["symbol"])
def _(i: Inputs) -> DataFrame:
    return regime_rows(i)


@query(
    "regime_window_stats", "A-29",
    f"""SELECT symbol, arg_max(ret5, rn) AS return_5bar, avg(vol20) AS volatility_20, arg_max(vol_ratio, rn) AS volume_ratio,
        arg_max(rsi_norm, rn) * 50 + 50 AS rsi, arg_max(atr_ratio, rn) AS atr_pct FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM ({_inputs})) WHERE k <= 20 GROUP BY symbol""",
    ["rbars"], (), ["return_5bar", "volatility_20", "volume_ratio", "rsi", "atr_pct"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return learn.current_window_stats(regime_rows(i))


REGIME = ["ret5", "vol20", "vol_ratio", "rsi_norm", "atr_ratio"]


def hidden_states(i: Inputs) -> tuple[DataFrame, DataFrame]:
    made: list[tuple[DataFrame, DataFrame]] = []

    def build(which: int) -> DataFrame:
        if not made:
            made.append(hidden_markov.market_states(regime_rows(i), REGIME))
        return made[0][which]

    return i.once("hidden_states", lambda: build(0)), i.once("hidden_models", lambda: build(1))


@query("hidden_market_states", "M-13", None)
def _(i: Inputs) -> DataFrame:
    return hidden_states(i)[0]


@query("hidden_state_summary", "M-13 A-13 A-29", None)
def _(i: Inputs) -> DataFrame:
    return hidden_markov.current_states(*hidden_states(i))


# a given two-state model of standardised returns: calm and wild, staying nine times in ten
_TWO = [0.5, 0.5, 0.9, 0.1, 0.1, 0.9, 0.2, -0.2, 0.5, 2.0]
_dens = "exp(-0.5 * (x - {m}) ** 2 / {v}) / sqrt(2 * pi() * {v})"
_hidden = f"""WITH RECURSIVE s AS (SELECT symbol, rn, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) AS j,
    (lr - avg(lr) OVER (PARTITION BY symbol)) / stddev_pop(lr) OVER (PARTITION BY symbol) AS x FROM rbars WHERE lr IS NOT NULL),
  e AS (SELECT *, {_dens.format(m=0.2, v=0.5)} AS e0, {_dens.format(m=-0.2, v=2.0)} AS e1 FROM s),
  a AS (SELECT symbol, rn, k, e0 * 0.5 / (0.5 * (e0 + e1)) AS a0, e1 * 0.5 / (0.5 * (e0 + e1)) AS a1, ln(0.5) + ln(e0) AS d0, ln(0.5) + ln(e1) AS d1, 0 AS c0, 1 AS c1 FROM e WHERE k = 1
    UNION ALL SELECT symbol, rn, k, f0 / (f0 + f1), f1 / (f0 + f1), greatest(d0 + ln(0.9), d1 + ln(0.1)) + ln(e0), greatest(d0 + ln(0.1), d1 + ln(0.9)) + ln(e1),
      CASE WHEN d0 + ln(0.9) >= d1 + ln(0.1) THEN 0 ELSE 1 END, CASE WHEN d0 + ln(0.1) >= d1 + ln(0.9) THEN 0 ELSE 1 END
    FROM (SELECT e.symbol, e.rn, e.k, e.e0, e.e1, p.d0, p.d1, e.e0 * (0.9 * p.a0 + 0.1 * p.a1) AS f0, e.e1 * (0.1 * p.a0 + 0.9 * p.a1) AS f1
      FROM a p JOIN e ON e.symbol = p.symbol AND e.k = p.k + 1)),
  b AS (SELECT symbol, k, j, CAST(1 AS DOUBLE) AS b0, CAST(1 AS DOUBLE) AS b1, e0, e1 FROM e WHERE j = 1
    UNION ALL SELECT symbol, k, j, g0 / (g0 + g1), g1 / (g0 + g1), e0, e1 FROM (SELECT e.symbol, e.k, e.j, e.e0, e.e1,
      0.9 * p.e0 * p.b0 + 0.1 * p.e1 * p.b1 AS g0, 0.1 * p.e0 * p.b0 + 0.9 * p.e1 * p.b1 AS g1 FROM b p JOIN e ON e.symbol = p.symbol AND e.j = p.j + 1)),
  v AS (SELECT a.symbol, a.k, CASE WHEN d0 >= d1 THEN 0 ELSE 1 END AS state, c0, c1 FROM a JOIN e ON e.symbol = a.symbol AND e.k = a.k WHERE e.j = 1
    UNION ALL SELECT a.symbol, a.k, CASE WHEN p.state = 0 THEN p.c0 ELSE p.c1 END, a.c0, a.c1 FROM v p JOIN a ON a.symbol = p.symbol AND a.k = p.k - 1)"""


@query(
    "given_model_states", "M-13",
    _hidden + """ SELECT a.symbol, a.rn, CAST(v.state AS INTEGER) AS state, a0 * b0 / (a0 * b0 + a1 * b1) AS probability
      FROM a JOIN b ON b.symbol = a.symbol AND b.k = a.k JOIN v ON v.symbol = a.symbol AND v.k = a.k""",
    ["rbars"], (), ["probability"], ["symbol", "rn", "state"],
)
def _(i: Inputs) -> DataFrame:
    """Posteriors and best path under a model that is given, in chunks of 64 rows."""
    f = ft.build_features(i.panel(), ["price_action"], keep=["symbol", "rn"]).select("symbol", "rn", F.col("log_return_1d").alias("x"))
    chunks = hidden_markov.packed(f, ["x"], chunk_rows=64)
    theta = chunks.where("first").select("symbol", F.lit(_TWO).cast("array<double>").alias("theta"))
    found = hidden_markov.decode(chunks, theta, ["symbol"], 2, 1, fan=4)
    return found.withColumn("probability", F.element_at("probabilities", 1))


@query("regime_clusters", "M-13 A-13", None)
def _(i: Inputs) -> DataFrame:
    rows = regime_rows(i).select("symbol", "time", "ret5", "vol20", "vol_ratio", "rsi_norm", "atr_ratio")
    return learn.cluster_regimes(rows, ["ret5", "vol20", "vol_ratio", "rsi_norm", "atr_ratio"])


FEATURES = ["return_1d", "return_5d", "volatility_20d", "high_low_range", "volume_ratio", "momentum_accel", "bb_position", "rsi_14"]


def learning_rows(i: Inputs) -> DataFrame:
    def build() -> DataFrame:
        fam = ["price_action", "volume_ratios", "microstructure", "bollinger", "relative_strength", "targets"]
        f = ft.build_features(i.panel(), fam, keep=["symbol", "time", "rn"])
        rows = splits.chronological_split(f.select("symbol", "time", "rn", "target_1", *FEATURES))
        return rows.dropna(subset=["target_1", *FEATURES])

    return i.once("learning_rows", build)


def fitted(i: Inputs) -> tuple[DataFrame, list[str], dict]:
    d = learn.assemble(learning_rows(i), FEATURES)
    models = learn.fit_members(d, "target_1")
    wide = learn.predict_members(d, models, ["symbol", "time", "rn", "split", "target_1"])
    return wide, list(models), models


@query("learned_ensemble_metrics", "M-6 A-17 A-18 A-4", None)
def _(i: Inputs) -> DataFrame:
    wide, names, _ = fitted(i)
    w = learn.validation_weights(wide, names, "target_1")
    scored = learn.with_ensemble(wide, names, w).where("split = 'test'").withColumn("y_true", F.col("target_1"))
    return metrics.prediction_metrics(learn.to_long(scored, [*names, "ensemble"], ["y_true"]), ["model"])


@query("stacked_ensemble", "M-7", None)
def _(i: Inputs) -> DataFrame:
    wide, names, _ = fitted(i)
    ens = learn.with_ensemble(wide, names, learn.validation_weights(wide, names, "target_1"))
    stacked = learn.stack(ens, names, "target_1").transform(ens)
    return learn.better_of(stacked, "target_1", "ensemble", "stacked")


@query("permutation_importance", "M-8 K-5", None)
def _(i: Inputs) -> DataFrame:
    d = learning_rows(i)
    model = LinearRegression(labelCol="target_1", regParam=0.01).fit(learn.assemble(d.where("split = 'train'"), FEATURES))
    return learn.permutation_importance(d.where("split = 'test'"), model, FEATURES, "target_1", ["symbol", "time"])


@query("tree_contributions", "M-8 K-5", None)
def _(i: Inputs) -> DataFrame:
    """Mean absolute Shapley values of the boosted trees over the test rows."""
    d = learning_rows(i)
    models = fitted(i)[2]
    return shapley.mean_importance(d.where("split = 'test'"), models["boosted"], FEATURES)


@query("parameter_search", "M-9", None)
def _(i: Inputs) -> DataFrame:
    """Fifty trials; the table stays in the shared folder of the session, so asking again fits nothing anew."""
    path = f"{shared_folder(i.spark)}/barloom/trials-{uuid.uuid5(uuid.NAMESPACE_URL, i.dir).hex}-{i.spark.sparkContext.applicationId}"
    return trials.search(learn.assemble(learning_rows(i), FEATURES), "target_1", path)


def fold_plan(i: Inputs) -> tuple[DataFrame, DataFrame]:
    axis = splits.time_axis(i.bars())
    return axis, splits.walk_forward_folds(axis, 150, 63)


@query("walk_forward_fitted", "M-4 M-5 X-1", None)
def _(i: Inputs) -> DataFrame:
    """A ridge line of eight features for every fold, and its errors on the fold's test rows."""
    axis, plan = fold_plan(i)
    p = folds.fold_forecasts(learning_rows(i), axis, plan, "target_1", FEATURES, ["symbol", "time", "target_1"])
    return metrics.prediction_metrics(p.withColumn("y_true", F.col("target_1")), ["fold"])


_one = f"""WITH x AS (SELECT symbol, time, {lag('close', -1)} / close - 1 AS y, close / c1 - 1 AS x FROM rbars),
  axis AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM bars)),
  f AS (SELECT k AS fold, 150 + k * 63 AS test_start, 150 + k * 63 - 1 AS train_end FROM (SELECT max(n) AS n FROM axis) m, unnest(range(CAST(floor((m.n - 213) / 63) AS BIGINT) + 1)) AS u(k)),
  r AS (SELECT x.*, axis.t FROM x JOIN axis ON axis.time = x.time WHERE x IS NOT NULL),
  l AS (SELECT fold, count(*) AS n_train, covar_pop(y, x) / (var_pop(x) * 1.01) AS slope, avg(y) AS my, avg(x) AS mx FROM r JOIN f ON t < train_end WHERE y IS NOT NULL GROUP BY fold)"""


@query(
    "walk_forward_one_feature", "M-4 X-1",
    _one + """ SELECT r.symbol, r.time, f.fold, l.my + l.slope * (r.x - l.mx) AS y_pred, l.n_train FROM r JOIN f ON r.t >= f.test_start AND r.t < f.test_start + 63 JOIN l ON l.fold = f.fold""",
    ["rbars"], ["time"], {"y_pred": 9}, ["symbol", "fold", "n_train"],
)
def _(i: Inputs) -> DataFrame:
    """The next return by the last one, fitted for each fold."""
    axis, plan = fold_plan(i)
    f = ft.build_features(i.panel(), ["price_action", "targets"], keep=["symbol", "time", "rn"]).select("symbol", "time", "target_1", "return_1d")
    p = folds.fold_forecasts(f, axis, plan, "target_1", ["return_1d"], ["symbol", "time"])
    return p.join(folds.fold_lines(f, axis, plan, "target_1", ["return_1d"]).select("fold", "n_train"), "fold")


def _load_linear():
    weights = np.array([0.5, -0.1])
    return lambda x: x @ weights + 0.01


@query(
    "batch_scored_rows", "X-4",
    f"SELECT symbol, time, 0.5 * (close / {lag('close', 1)} - 1) - 0.1 * ((high - low) / close) + 0.01 AS prediction FROM rbars",
    ["rbars"], ["time"], ["prediction"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    f = ft.build_features(i.panel(), ["price_action"], keep=["symbol", "time"])
    return learn.score_batches(f, ["symbol", "time"], ["return_1d", "high_low_range"], _load_linear)


@query(
    "decision_outcomes", "T-12 T-11 W-44",
    """SELECT d.symbol, d.time, d.decision, d.confidence, lead_close / close - 1 AS outcome_pct_change,
        CASE WHEN lead_close IS NULL THEN NULL WHEN (d.decision = 'BUY' AND lead_close > close) OR (d.decision = 'SELL' AND lead_close < close) THEN 'CORRECT' ELSE 'WRONG' END AS actual_outcome
       FROM (SELECT symbol, time, close, lead(close, 4) OVER (PARTITION BY symbol ORDER BY time) AS lead_close, CASE WHEN close > c1 THEN 'SELL' ELSE 'BUY' END AS decision,
        least(1.0, abs(close / c1 - 1)) AS confidence FROM rbars QUALIFY c1 IS NOT NULL) d""",
    ["rbars"], ["time"], ["confidence", "outcome_pct_change"], ["symbol", "decision", "actual_outcome"],
)
def _(i: Inputs) -> DataFrame:
    from barloom.operators.signals import decision_outcomes

    f = ft.build_features(i.panel(), ["price_action"], keep=["symbol", "time", "rn", "close"])
    r = F.col("return_1d")
    d = f.where(r.isNotNull()).select("symbol", "time", F.when(r > 0, "SELL").otherwise("BUY").alias("decision"), F.least(F.lit(1.0), F.abs(r)).alias("confidence"))
    return decision_outcomes(d, i.panel(), 4)


@query(
    "latest_signals", "T-11 K-1",
    """SELECT symbol, model_name, max(generated_at) AS generated_at, arg_max(prediction, (generated_at, id)) AS prediction, arg_max(confidence, (generated_at, id)) AS confidence
       FROM signals GROUP BY ALL""",
    ["signals"], ["generated_at"], ["prediction", "confidence"], ["symbol", "model_name"],
)
def _(i: Inputs) -> DataFrame:
    from barloom.operators.signals import latest_signals

    return latest_signals(i.signals())
