"""Model fitting on Spark ML: ensembles, stacking, importance, search, folds, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan
from barloom.operators.metrics import error_metrics, inverse_error_weights


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def members(label: str, trees: int = 20, depth: int = 4, seed: int = 42) -> dict[str, Estimator]:
    """Three regressors: boosted trees with early stopping on the validation rows, a forest, a line."""
    return {
        "boosted": GBTRegressor(
            labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed,
            validationIndicatorCol="is_validation", validationTol=1e-4,
        ),
        "forest": RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed),
        "linear": LinearRegression(labelCol=label, regParam=0.01),
    }


def fit_members(df: DataFrame, label: str, trees: int = 20, depth: int = 4) -> dict[str, object]:
    """``df`` has ``features``, the label and ``split``."""
    d = df.where(F.col("split") != "test").withColumn("is_validation", F.col("split") == "val")
    train = d.where("split = 'train'")
    return {n: e.fit(d if n == "boosted" else train) for n, e in members(label, trees, depth).items()}


def predict_members(df: DataFrame, models: dict[str, object], keep: Sequence[str]) -> DataFrame:
    """Wide forecasts: one column per member, in one pass over the rows."""
    out = df
    for name, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", name)
    return out.select(*keep, *models)


def to_long(wide: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("y_pred")) for n in names])
    return wide.select(*keep, F.inline(pairs))


def validation_weights(wide: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Inverse-RMSE weights from the validation rows."""
    long = to_long(wide.where("split = 'val'").withColumn("y_true", F.col(label)), names, ["y_true"])
    rmse = long.groupBy("model").agg(error_metrics()["rmse"].alias("rmse"))
    return inverse_error_weights(rmse, []).select("model", "weight")


def with_ensemble(wide: DataFrame, names: Sequence[str], weights: DataFrame) -> DataFrame:
    """Weighted mean as a column; the weights are one row, read as a scalar subquery."""
    m = weights.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight")))).scalar()
    num, den = F.lit(0.0), F.lit(0.0)
    for n in names:
        w = F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(0.0))
        num, den = num + w * F.col(n), den + w
    return wide.withColumn("ensemble", F.try_divide(num, den))


def stack(wide: DataFrame, names: Sequence[str], label: str, alpha: float = 1.0):
    """Ridge on standardised member forecasts of the validation rows."""
    rows = wide.where("split = 'val'")
    n = max(rows.count(), 1)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(names), outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True),
            LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=alpha / n, predictionCol="stacked"),
        ]
    ).fit(rows.drop("features"))


def better_of(scored: DataFrame, label: str, a: str, b: str, split: str = "test") -> DataFrame:
    """RMSE of both columns and which one to use: ``b`` only if it beats ``a``."""
    y = F.col(label)
    r = scored.where(F.col("split") == split).agg(
        *[F.sqrt(F.avg(F.pow(y - F.col(c), 2))).alias(f"rmse_{c}") for c in (a, b)]
    )
    return r.withColumn("chosen", F.when(F.col(f"rmse_{b}") < F.col(f"rmse_{a}"), b).otherwise(a))


def permutation_importance(df: DataFrame, model, features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Rise of RMSE when one feature is replaced by another row's value: that of the row before in the order of a hash of ``keys``.

    This keeps the column's distribution. The order is cut into a fixed number of hash ranges and the last values carried over them, so
    no task sees all rows; the first row takes its own value.
    """
    h = F.xxhash64(*keys)
    base = df.select(*keys, *features, label, h.alias("__h"))
    shifted = carry_scan(
        base, [], ["__h", *keys], F.shiftright("__h", 52), {f"__p_{f}": ("prev", F.col(f)) for f in features}
    )
    shifted = shifted.select("*", *[F.coalesce(f"__p_{f}", F.col(f)).alias(f"__q_{f}") for f in features])
    variants = [F.struct(F.lit("").alias("shuffled"), *[F.col(f) for f in features])]
    for s in features:
        variants.append(F.struct(F.lit(s).alias("shuffled"), *[(F.col(f"__q_{f}") if f == s else F.col(f)).alias(f) for f in features]))
    long = shifted.select(label, F.inline(F.array(*variants)))
    scored = model.transform(assemble(long, features))
    rmse = scored.groupBy("shuffled").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(label), 2))).alias("rmse"))
    base_rmse = rmse.where("shuffled = ''").agg(F.max("rmse")).scalar()
    return rmse.where("shuffled <> ''").select(F.col("shuffled").alias("feature"), (F.col("rmse") - base_rmse).alias("importance"))


def score_batches(
    df: DataFrame, keep: Sequence[str], features: Sequence[str], load: Callable[[], Callable], out: str = "prediction"
) -> DataFrame:
    """Score Arrow batches with any Python model; ``load`` runs once per task, not per batch."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", {out} double"
    cols = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            res = pdf[list(keep)].copy()
            res[out] = model(pdf[cols].to_numpy(dtype="float64"))
            yield res

    return df.select(*dict.fromkeys([*keep, *cols])).mapInPandas(run, schema)


def cluster_regimes(rows: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42, ret: str = "ret5", vol: str = "vol20") -> DataFrame:
    """Four market states from a Gaussian mixture on standardised features.

    Labels: the state with the highest mean volatility is ``high_vol``; the others are ordered by
    mean return (bull, sideways, bear). Adds ``regime`` and ``confidence``.
    """
    scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)
    mix = GaussianMixture(k=k, seed=seed, maxIter=50, featuresCol="features", probabilityCol="probability", predictionCol="state")
    d = rows.dropna(subset=list(features))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__raw"), scaler, mix]).fit(d)
    scored = model.transform(d)
    # state means in feature units; k rows, so the labelling windows are tiny
    scaled = model.stages[1]
    mean, std = scaled.mean.toArray(), scaled.std.toArray()
    states = []
    for s, g in enumerate(model.stages[2].gaussians):
        at = g.mean.toArray() * std + mean
        states.append((s, float(at[list(features).index(ret)]), float(at[list(features).index(vol)])))
    by_vol = sorted(states, key=lambda x: -x[2])
    names = {by_vol[0][0]: "high_vol"}
    ranked = sorted(by_vol[1:], key=lambda x: -x[1])
    for i, s in enumerate(ranked):
        names[s[0]] = "bull" if i == 0 else "bear" if i == len(ranked) - 1 else "sideways"
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return scored.select(
        *rows.columns, F.element_at(table, F.col("state")).alias("regime"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def current_window_stats(rows: DataFrame, n: int = 20, keys: Sequence[str] = ("symbol",), state: Column | None = None) -> DataFrame:
    """Last values and means of the last ``n`` bars per key (bounded tail by row number)."""
    from barloom.operators.forecast import last_rows

    tail = last_rows(rows, n, keys)
    return tail.groupBy(*keys).agg(
        F.max_by("ret5", "rn").alias("return_5bar"),
        F.avg("vol20").alias("volatility_20"),
        F.max_by("vol_ratio", "rn").alias("volume_ratio"),
        (F.max_by("rsi_norm", "rn") * 50 + 50).alias("rsi"),
        F.max_by("atr_ratio", "rn").alias("atr_pct"),
    )
