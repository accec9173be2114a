"""Market regimes: rules on volatility and trend, smoothing, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan, chunk_of
from barloom.operators.macro import macro_blocks

# Volatility thresholds of the rule set (fixed values).
LOW, HIGH, EXTREME = 15.0, 25.0, 40.0
ASSUMED_VIX = 20.0


def rule(vix: Column, bull: Column) -> Column:
    v = F.coalesce(vix, F.lit(ASSUMED_VIX))
    up = F.coalesce(bull, F.lit(True))
    return (
        F.when(v >= EXTREME, "crisis")
        .when(up & (v < LOW), "bull_low_vol")
        .when(up, "bull_high_vol")
        .when(v < HIGH, "bear_low_vol")
        .otherwise("bear_high_vol")
    )


def rolling_mode(labels: Column) -> Column:
    """Most frequent label of an array; ties go to the smallest label."""
    distinct = F.array_sort(F.array_distinct(labels))
    scored = F.transform(
        distinct, lambda v: F.struct((-F.size(F.filter(labels, lambda x: x == v))).alias("k"), v.alias("v"))
    )
    return F.element_at(F.array_sort(scored), 1)["v"]


def rule_regimes(macro: DataFrame, trend: int = 200, trend_min: int = 50, smooth: int = 5) -> DataFrame:
    """(time, raw, regime) from ``vix`` and ``sp500``, in row blocks of the macro table."""
    b = macro_blocks(macro, trend + smooth)
    ma = b.full("sp500", trend, F.avg("sp500").over(b.rolling(trend)), needed=trend_min)
    b = b.with_df(b.df.select("*", rule(F.col("vix"), F.col("sp500") > ma).alias("raw")))
    last = F.collect_list("raw").over(b.rolling(smooth))
    b = b.with_df(b.df.select("*", rolling_mode(last).alias("regime")))
    return b.own_rows().select("time", "raw", "regime")


def transition_matrix(
    states: DataFrame, state: str = "regime", keys: Sequence[str] = (), chunk_seconds: int = 365 * 86400
) -> DataFrame:
    """P(next | state); pairs are counted before the row totals are taken."""
    line = carry_scan(states, keys, ["time"], chunk_of("time", chunk_seconds), {"next": ("after", F.col(state))})
    n = line.where("next is not null").groupBy(*keys, state, "next").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, state)))


def distribution(states: DataFrame, state: str = "regime", keys: Sequence[str] = ()) -> DataFrame:
    n = states.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def recent_history(states: DataFrame, rows: int = 60, change_rows: int = 20, state: str = "regime") -> DataFrame:
    """The last ``rows`` labels with the number of changes among the last ``change_rows``."""
    last = states.orderBy(F.col("time").desc()).limit(rows)
    w = Window.orderBy(F.col("time").desc())
    k = F.row_number().over(w)
    moved = (F.col(state) != F.lead(state).over(w)) & (k < change_rows)
    return last.select("*", moved.alias("__m")).select(
        "time", state, F.sum(F.coalesce(F.col("__m"), F.lit(False)).cast("long")).over(Window.partitionBy()).alias("changes")
    )


# Ensemble weights per regime and the equal weights of every other regime (fixed values).
REGIME_WEIGHTS: dict[str, dict[str, float]] = {
    "bull_low_vol": {"xgboost": 0.3, "lightgbm": 0.3, "catboost": 0.2, "lstm": 0.2},
    "bear_high_vol": {"lstm": 0.4, "tft": 0.3, "xgboost": 0.2, "lightgbm": 0.1},
    "sideways": {"tft": 0.4, "lstm": 0.3, "xgboost": 0.2, "lightgbm": 0.1},
    "crisis": {"lstm": 0.5, "tft": 0.3, "xgboost": 0.2},
}
EQUAL_WEIGHTS = {"xgboost": 0.25, "lightgbm": 0.25, "catboost": 0.25, "lstm": 0.25}


def regime_weights(states: DataFrame, table: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Long (time, regime, model, weight): a literal lookup, equal weights for other regimes."""

    def entries(ws: dict[str, float]) -> Column:
        return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight")) for m, w in ws.items()])

    table = REGIME_WEIGHTS if table is None else table
    lookup = F.create_map(*[x for r, ws in table.items() for x in (F.lit(r), entries(ws))])
    chosen = F.coalesce(F.try_element_at(lookup, F.col("regime")), entries(EQUAL_WEIGHTS))
    return states.select("time", "regime", F.inline(chosen))


def weighted_forecasts(predictions: DataFrame, states: DataFrame, table: dict[str, dict[str, float]] | None = None, pred: str = "y_pred") -> DataFrame:
    """(symbol, time, regime, y_pred, n_models): the forecasts of each row weighted by the regime of the last state at or before
    its time. Weights of models without a forecast are left out and the others scaled up; models without a weight do not count."""
    from barloom.operators.macro import asof_global

    table = REGIME_WEIGHTS if table is None else table
    times = predictions.select("time").distinct()
    known = asof_global(times, states.select("time", "regime"))
    weights = regime_weights(known, table)
    joined = predictions.join(weights, ["time", "model"])
    w, p = F.col("weight"), F.col(pred)
    return joined.groupBy("symbol", "time").agg(
        F.first("regime").alias("regime"), F.try_divide(F.sum(w * p), F.sum(F.when(p.isNotNull(), w))).alias("y_pred"), F.count(p).alias("n_models")
    )
