"""Toxicity by non-negative positive-unlabelled learning.

A document is the set of its features: words, and beginnings of words of 4 and 5 characters, in lower case, hashed to ``SLOTS`` places. A
linear numpy classifier is fitted to confirmed toxic examples (positives) and to unlabelled documents, whose labels are not
looked at. With the class prior p, the risk is ``p R(positive, as toxic) + max(0, R(unlabelled, as clean) - p R(positive,
as clean))``: the second term estimates the risk of clean documents, and when it falls below zero, which only fitting the
sample too closely can do, the step goes against it. An L1 step keeps the few features that carry the decision.

The positives and the unlabelled documents are bounded samples (``POSITIVES``, ``UNLABELLED``, first by a hash of the id);
the prior is the share of toxic among all labels that may be learnt from. The fitted model has ``SLOTS`` weights at most.

Defined results: null and empty texts have no features and get the score of those; without positives or unlabelled
documents every score is the prior (0 without labels). Rows are scored one by one; repeated rows repeat, an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read, and ``doc_id`` and ``toxic`` of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc_fold, held_out, slices

SLOTS = 1 << 18
POSITIVES = 1500
UNLABELLED = 4000
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) % SLOTS


class Features(dict):
    """Word (bytes, as split by white space) to its features. Bounded: forgets all when full."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        found = []
        for w in _WORD.findall(word.decode("utf-8", "replace").lower()):
            found.append(slot(w))
            found += [slot(f"{w[:k]}-") for k in (4, 5) if len(w) > k]
        self[word] = got = tuple(found)
        return got


def features(text: bytes, known: Features) -> np.ndarray:
    return np.unique(np.fromiter((f for w in set(text.split()) for f in known[w]), np.int32))


@dataclass
class ToxicModel:
    weights: dict[int, float]
    bias: float

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fitted(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 800, rate: float = 0.5, l1: float = 4e-5) -> ToxicModel:
    """Proximal Adagrad steps on the non-negative risk with the logistic loss, over features in five documents or more."""
    prior = min(max(prior, 1e-3), 0.999)
    if not positive or not unlabelled:
        return ToxicModel({}, float(np.log(prior / (1 - prior))))
    both = positive + unlabelled
    row = np.repeat(np.arange(len(both), dtype=np.int32), [len(x) for x in both])
    column = np.concatenate(both)
    count = np.bincount(column, minlength=SLOTS)
    # features that are no commoner in the positives can't raise a score
    n, p = len(both), len(positive)
    in_positive = np.bincount(column[row < p], minlength=SLOTS)
    useful = (count >= 5) & (in_positive / p > 2 * (count - in_positive) / max(1, n - p))
    keep = useful[column]
    names = np.cumsum(useful) - 1
    row, column, kinds = row[keep], names[column[keep]], np.flatnonzero(useful)
    d = len(kinds)
    w, bias, past, past_bias = np.zeros(d), 0.0, np.full(d, 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(row, w[column], n)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean_risk = np.logaddexp(0, z[p:]).mean() - prior * np.logaddexp(0, z[:p]).mean()
        slope = np.zeros(n)
        if clean_risk >= 0:
            slope[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            slope[p:] = s[p:] / (n - p)
        else:
            slope[:p], slope[p:] = prior * s[:p] / p, -s[p:] / (n - p)
        grad, grad_bias = np.bincount(column, slope[row], d), slope.sum()
        past += grad**2
        past_bias += grad_bias**2
        pace = rate / np.sqrt(past)
        w -= pace * grad
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        bias -= rate / np.sqrt(past_bias) * grad_bias
    return ToxicModel({int(k): float(x) for k, x in zip(kinds, w, strict=True) if x}, float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicModel:
    known = labels.filter(F.col("toxic").isNotNull() & (crc_fold("doc_id") != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    if share is None:
        return ToxicModel({}, -30.0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.filter("toxic = 1").orderBy(*order).limit(positives).select("doc_id", F.lit(1).alias("y"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (crc_fold("doc_id") != 1)).distinct()
    other = ids.orderBy(*order).limit(unlabelled).select("doc_id", F.lit(0).alias("y"))
    wanted = some.union(other).groupBy("doc_id").agg(F.collect_list("y").alias("ys"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Features()
        for batch, texts in slices(batches):
            x: list[np.ndarray] = [features(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ys"), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "ys", "x"])

    # bounded by the two limits
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "ys", "text")
    found = rows.mapInArrow(task, "doc_id long, ys array<int>, x array<int>").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    sets = {y: [np.asarray(x, np.int32) for ys, x in zip(found["ys"], found["x"], strict=True) if y in ys] for y in (0, 1)}
    return fitted(sets[1], sets[0], float(share))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    class Weighted(dict):
        def __missing__(self, word: bytes) -> tuple[int, ...]:
            if len(self) >= 400_000:
                self.clear()
            self[word] = got = tuple(f for f in Features.__missing__(Features(), word) if f in model.value.weights)
            return got

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weighted()
        for batch, texts in slices(batches):
            s = np.array([model.value.score({f for fs in map(known.__getitem__, t.split()) if fs for f in fs}) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype("int32"))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
