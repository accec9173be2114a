"""Parameter search by successive halving over a table of trials that survives its driver.

All trials start with few trees; the better third of each rung goes on with more. Every fit writes its result as a row of
the trial table as soon as it is done. A search that is started again on the same table takes
what is there and fits only what is missing. A bounded number of fits run side by side, each of them a distributed job.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "trees int, params string, rmse double"
SCHEMA = f"{RESULT}, rung int, trial int"
COLUMNS = ["trial", "rung", "trees", "params", "rmse"]


def proposals(trials: int, seed: int = 42) -> list[dict]:
    """Random parameter sets: depth, step, rows and features a tree sees, least rows of a leaf."""
    rng = np.random.default_rng(seed)
    return [
        {
            "maxDepth": int(rng.integers(2, 7)), "stepSize": float(np.round(10 ** rng.uniform(-2, -0.5), 4)),
            "subsamplingRate": float(np.round(rng.uniform(0.5, 1.0), 2)), "minInstancesPerNode": int(2 ** rng.integers(0, 6)),
            "featureSubsetStrategy": str(rng.choice(["all", "onethird", "sqrt"])),
        }
        for _ in range(trials)
    ]


def known(spark: SparkSession, path: str) -> DataFrame:
    """The trial table, one row for each trial and rung."""
    try:
        return spark.read.schema(SCHEMA).parquet(path).select(*COLUMNS)
    except AnalysisException as e:  # the table does not exist before the first trial
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA).select(*COLUMNS)


def search(
    df: DataFrame, label: str, path: str, trials: int = 50, rungs: Sequence[int] = (4, 8, 20), keep: float = 1 / 3, side_by_side: int = 4, seed: int = 42
) -> DataFrame:
    """The trial table after all rungs: ``trial, rung, trees, params, rmse``. ``df`` has ``features``, the label and ``split``."""
    spark = df.sparkSession
    train, val = df.where("split = 'train'").cache(), df.where("split = 'val'").cache()
    score = RegressionEvaluator(labelCol=label, metricName="rmse")
    params = proposals(trials, seed)

    def fit(trial: int, rung: int) -> None:
        model = GBTRegressor(labelCol=label, maxIter=rungs[rung], seed=seed, **params[trial]).fit(train)
        row = (rungs[rung], json.dumps(params[trial], sort_keys=True), float(score.evaluate(model.transform(val))))
        # a folder for each fit: writers side by side don't meet, and a repeated fit replaces itself
        spark.createDataFrame([row], RESULT).coalesce(1).write.mode("overwrite").parquet(f"{path}/rung={rung}/trial={trial}")

    alive = list(range(trials))
    try:
        for rung in range(len(rungs)):
            done = {r["trial"]: r["rmse"] for r in known(spark, path).where(F.col("rung") == rung).collect()}  # a row a trial
            with ThreadPoolExecutor(side_by_side) as pool:
                list(pool.map(lambda t: fit(t, rung), [t for t in alive if t not in done]))  # noqa: B023
            done = {r["trial"]: r["rmse"] for r in known(spark, path).where(F.col("rung") == rung).collect()}
            alive = sorted(alive, key=lambda t: (done[t], t))[: max(1, int(len(alive) * keep))]
    finally:
        train.unpersist()
        val.unpersist()
    return known(spark, path)


def best(table: DataFrame) -> DataFrame:
    """The trial with the smallest error on the last rung."""
    last = table.agg(F.max("rung")).scalar()
    return table.where(F.col("rung") == last).orderBy("rmse", "trial").limit(1)
