from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from barloom.operators import learn, shapley, trials

NAMES = ["a", "b", "c"]


def rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)).round(2), columns=NAMES)
    pdf["y"] = pdf["a"] * 2 + (pdf["b"] > 0) * pdf["a"] + rng.normal(0, 0.1, n)
    pdf["split"] = np.where(rng.random(n) < 0.7, "train", "val")
    return learn.assemble(spark.createDataFrame(pdf), NAMES)


def expected(leaves, x, known):
    """Forecast of a tree when only the features in ``known`` are seen: other splits go by the training shares."""
    total = 0.0
    for leaf in leaves:
        w = leaf.value
        for f, a, b, s in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True):
            w *= (a < x[f] <= b) if f in known else s
        total += w
    return total


def by_subsets(trees, x):
    out = np.zeros(len(x))
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        for size in range(len(others) + 1):
            for some in combinations(others, size):
                w = factorial(size) * factorial(len(x) - size - 1) / factorial(len(x))
                out[i] += w * sum(t * (expected(lv, x, {*some, i}) - expected(lv, x, some)) for t, lv in trees)
    return out


def test_contributions_equal_all_subsets_and_add_up_to_the_forecast(spark):
    d = rows(spark)
    for est in (GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1), RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1)):
        model = est.fit(d)
        got = shapley.contributions(model.transform(d), model, NAMES, [*NAMES, "prediction"]).toPandas()
        values = got[[f"shap_{n}" for n in NAMES]].to_numpy()
        np.testing.assert_allclose(values.sum(1) + got["base"], got["prediction"], atol=1e-9)
        trees = shapley.ensemble_leaves(model)
        for k in range(0, 60, 7):
            np.testing.assert_allclose(values[k], by_subsets(trees, got[NAMES].to_numpy()[k]), atol=1e-9)
        mean = shapley.mean_importance(d, model, NAMES).toPandas()
        want = pd.Series(np.abs(values).mean(0), NAMES).sort_values(ascending=False)
        assert mean.sort_values("place")["feature"].tolist() == want.index.tolist()
        np.testing.assert_allclose(mean.set_index("feature")["importance"][want.index], want)


def test_a_search_that_was_ended_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    d, path = rows(spark, 200), str(tmp_path / "trials")
    fits = []
    fit = GBTRegressor.fit

    def counted(self, *args):
        if len(fits) == 4:
            raise KeyboardInterrupt
        fits.append(self.getMaxIter())
        return fit(self, *args)

    monkeypatch.setattr(GBTRegressor, "fit", counted)
    try:
        trials.search(d, "y", path, 6, (1, 2), side_by_side=1)
    except KeyboardInterrupt:
        pass
    assert trials.known(spark, path).count() == 4
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, *args: (fits.append(self.getMaxIter()), fit(self, *args))[1])
    table = trials.search(d, "y", path, 6, (1, 2), side_by_side=2).toPandas()
    assert sorted(fits) == [1] * 6 + [2, 2]
    first = table[table.rung == 0].sort_values(["rmse", "trial"])
    assert set(table[table.rung == 1]["trial"]) == set(first["trial"].head(2))
    assert trials.best(trials.known(spark, path)).first()["rmse"] == table[table.rung == 1]["rmse"].min()
    trials.search(d, "y", path, 6, (1, 2), side_by_side=1)
    assert len(fits) == 8, "nothing is fitted anew"
