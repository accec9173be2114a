"""Model signals and decisions: latest per model, context, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import block_panel


def latest_signals(signals: DataFrame, keys: Sequence[str] = ("symbol", "model_name")) -> DataFrame:
    rest = [c for c in signals.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("generated_at", "id")).alias("r")
    return signals.groupBy(*keys).agg(newest).select(*keys, "r.*")


def decision_context(decisions: DataFrame, signals: DataFrame, model: str) -> DataFrame:
    """Each decision with the last signal of ``model`` at or before it."""
    from barloom.operators.macro import asof_keyed

    s = signals.where(F.col("model_name") == model).groupBy("symbol", F.col("generated_at").alias("timestamp")).agg(
        F.max_by("prediction", "id").alias("prediction"), F.max_by("confidence", "id").alias("signal_confidence")
    )
    return asof_keyed(decisions, s, ["symbol"], "timestamp", ["prediction", "signal_confidence"])


def decision_outcomes(decisions: DataFrame, panel: DataFrame, horizon: int) -> DataFrame:
    """Outcome of each decision: price change over ``horizon`` bars and whether it was right."""
    w = block_panel(panel, back=0, ahead=horizon + 1)
    future = w.with_df(w.df.select("*", w.lead("close", horizon).alias("__later"))).own_rows()
    j = decisions.join(future.select("symbol", "time", F.col("close").alias("__now"), "__later"), ["symbol", "time"])
    up, down = F.col("__later") > F.col("__now"), F.col("__later") < F.col("__now")
    right = ((F.col("decision") == "BUY") & up) | ((F.col("decision") == "SELL") & down)
    outcome = F.when(F.col("__later").isNotNull(), F.when(right, "CORRECT").otherwise("WRONG"))
    change = F.try_divide(F.col("__later"), F.col("__now")) - 1.0
    return j.select(*decisions.columns, change.alias("outcome_pct_change"), outcome.alias("actual_outcome"))
