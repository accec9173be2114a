"""Shapley values of tree ensembles: how much each feature moves each forecast.

A tree is a sum over its leaves. Along the path to a leaf every feature has a share of the training rows that goes the
leaf's way (the product of its splits' shares) and, for a row, whether it goes that way itself. A feature's value at a leaf is
the leaf's forecast times the weighted sum over subsets of the other features of the path, which a polynomial of the path's
length gives for a whole batch of rows at once. Trees are read from the fitted model once, as bounded lists of leaves,
and sent to the tasks; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """Forecast of a leaf and, for each feature on its path, the interval ``(low, high]`` and the share of rows inside it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves_of(tree) -> list[Leaf]:
    """Leaves of a fitted Spark regression tree (continuous splits)."""
    found: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            items = sorted(path.items())
            low, high, share = (tuple(v[k] for _, v in items) for k in range(3))
            found.append(Leaf(float(node.prediction()), tuple(f for f, _ in items), low, high, share))
            return
        split, rows = node.split(), float(node.impurityStats().count())
        f, t = int(split.featureIndex()), float(split.threshold())
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, ends in ((node.leftChild(), (low, min(high, t))), (node.rightChild(), (max(low, t), high))):
            walk(child, path | {f: (*ends, share * float(child.impurityStats().count()) / rows)})

    walk(tree._java_obj.rootNode(), {})
    return found


def ensemble_leaves(model) -> list[tuple[float, list[Leaf]]]:
    """Weight and leaves of each tree of a fitted tree, forest or boosted ensemble."""
    if not hasattr(model, "trees"):
        return [(1.0, leaves_of(model))]
    boosted = "GBT" in type(model).__name__
    weights = list(model.treeWeights) if boosted else [1.0 / len(model.trees)] * len(model.trees)
    return [(float(w), leaves_of(t)) for w, t in zip(weights, model.trees, strict=True)]


def leaf_values(leaf: Leaf, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the leaf's features for the rows of ``x``, and the leaf's mean forecast."""
    m = len(leaf.features)
    share = np.array(leaf.share)
    mean = leaf.value * float(np.prod(share))
    if not m:
        return np.zeros((len(x), 0)), mean
    inside = np.stack([(x[:, f] > a) & (x[:, f] <= b) for f, a, b in zip(leaf.features, leaf.low, leaf.high, strict=True)], 1).astype(float)
    weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    out = np.zeros((len(x), m))
    for i in range(m):
        # coefficients by size of the subset: its features follow the row, the others the training shares
        poly = np.zeros((len(x), m))
        poly[:, 0] = 1
        size = 0
        for j in range(m):
            if j != i:
                size += 1
                poly[:, 1 : size + 1] = poly[:, 1 : size + 1] * share[j] + poly[:, :size] * inside[:, j, None]
                poly[:, 0] *= share[j]
        out[:, i] = leaf.value * (inside[:, i] - share[i]) * (poly @ weight)
    return out, mean


def shapley(trees: list[tuple[float, list[Leaf]]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions (row, feature) and the mean forecast; contributions and mean add up to the forecast."""
    out, base = np.zeros(x.shape), 0.0
    for w, leaves in trees:
        for leaf in leaves:
            values, mean = leaf_values(leaf, x)
            out[:, list(leaf.features)] += w * values
            base += w * mean
    return out, base


def contributions(df: DataFrame, model, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep``, ``base`` and a column ``shap_<feature>`` for each feature."""
    trees, names, keep = ensemble_leaves(model), list(features), list(keep)
    sent = df.sparkSession.sparkContext.broadcast(trees)  # bounded by the model's depth and number of trees
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    schema = ", ".join([*kept, "base double", *(f"shap_{n} double" for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, base = shapley(sent.value, pdf[names].to_numpy(float))
            yield pdf[keep].assign(base=base, **{f"shap_{n}": values[:, k] for k, n in enumerate(names)})

    return df.select(*dict.fromkeys([*keep, *names])).mapInPandas(run, schema)


def mean_importance(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """``feature, importance, place``: the mean absolute contribution over all rows."""
    each = contributions(df, model, features, [])
    sums = each.agg(*[F.avg(F.abs(f"shap_{n}")).alias(n) for n in features])
    long = sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in features])))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "feature")))
    return long.agg(ordered.alias("l")).select(F.posexplode("l").alias("k", "r")).select("r.feature", (-F.col("r.o")).alias("importance"), (F.col("k") + 1).alias("place"))
