"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

* A word gives one or two tokens: its letters in lower case, and its *shape* (capitals, marks around the letters).
* A token has a sparse random index vector (two of ``DIMS`` places, plus or minus one, by its hash). The vector of a
  token is the sum of the index vectors of its neighbours within two places, over all documents. Tokens share ``ROWS``
  rows by hash, so the vectors are a table of a fixed size (4 MB), whatever the vocabulary.
* A document is described by the mean and the spread of its tokens' vectors, the mean over its distinct tokens, and how
  often its tokens repeat. The network is fitted on a bounded sample of labelled rows (``SAMPLE``) on the driver; its
  logits are divided by a temperature that is chosen on a part of that sample that the network has not seen.

Defined results: null and empty texts are described by zeros and get the network's score for that; without any usable
label every score is 0.5, with labels of one kind only it is the (smoothed) share of that kind. Rows are scored one by
one: repeated rows repeat in the result, an empty table gives an empty one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Hashes, held_out, labelled_sample, slices, tabulated

ROWS = 1 << 15
DIMS = 32
REACH = 2
#: Labelled documents that are learnt from at most.
SAMPLE = 6000
HIDDEN = 24
_LETTERS = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class Tokens(Hashes):
    """Word to ``letters + 1`` and ``shape + 1`` (0: none) packed in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        m = _LETTERS.search(word)
        letters = m.group() if m else b""
        low = letters.lower()
        shape = (b"^" if len(letters) > 1 and letters.isupper() else b"") + b" ".join(_LETTERS.split(word))
        a = 1 + xxhash.xxh3_64_intdigest(low) % ROWS if low else 0
        b = 1 + xxhash.xxh3_64_intdigest(shape, 7) % ROWS if shape.strip() else 0
        self[word] = found = a << 20 | b
        return found


def token_rows(texts: list[bytes], known: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the tokens of all texts in a row, and the text of each token."""
    lists = [t.split() for t in texts]
    packed = np.fromiter((x for ws in lists for x in map(known.__getitem__, ws)), np.int64)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    both = np.stack([packed >> 20, packed & 0xFFFFF], 1).ravel()
    there = both > 0
    return both[there] - 1, np.repeat(doc, 2)[there]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The two places and signs of each row's index vector."""
    rng = np.random.default_rng(20)
    at = np.stack([rng.integers(0, DIMS // 2, ROWS), rng.integers(DIMS // 2, DIMS, ROWS)], 1)
    return at, rng.choice([-1.0, 1.0], (ROWS, 2))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """``ROWS`` x ``DIMS`` sums of the neighbours' index vectors over all documents, centred, each of length 1 (or 0)."""

    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        known, (at, sign) = Tokens(), index_vectors()
        for _, texts in slices(batches):
            rows, doc = token_rows(texts, known)
            for step in range(1, REACH + 1):
                same = doc[step:] == doc[:-step]
                a, b = rows[:-step][same], rows[step:][same]
                for k in range(2):
                    for x, y in ((a, b), (b, a)):
                        own += np.bincount(x * DIMS + at[y, k], sign[y, k], ROWS * DIMS).astype(own.dtype)

    total = tabulated(docs.select("text"), ROWS * DIMS, "int32", fill, "int64").reshape(ROWS, DIMS).astype("float64")
    seen = np.abs(total).sum(1) > 0
    if seen.any():
        total[seen] = total[seen] / np.linalg.norm(total[seen], axis=1, keepdims=True).clip(1)
        total[seen] -= total[seen].mean(0)
        total[seen] /= np.linalg.norm(total[seen], axis=1, keepdims=True).clip(1e-9)
    return total.astype("float32")


def described(texts: list[bytes], vectors: np.ndarray, known: Tokens) -> np.ndarray:
    """A row of numbers for each text."""
    n = len(texts)
    rows, doc = token_rows(texts, known)
    out = np.zeros((n, 3 * DIMS + 3), np.float32)
    if not len(rows):
        return out
    count = np.bincount(doc, minlength=n)
    full = np.flatnonzero(count)
    begin = np.searchsorted(doc, full)

    def means(x: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, begins, axis=0) / counts[:, None]

    v = vectors[rows]
    mean = means(v, begin, count[full])
    out[full, :DIMS] = mean
    out[full, DIMS : 2 * DIMS] = np.sqrt(np.maximum(means(v * v, begin, count[full]) - mean * mean, 0))
    kinds = np.unique(doc.astype(np.int64) * ROWS + rows)
    of, row = kinds // ROWS, kinds % ROWS
    kind_count = np.bincount(of, minlength=n)
    out[full, 2 * DIMS : 3 * DIMS] = means(vectors[row], np.searchsorted(of, full), kind_count[full])
    out[full, 3 * DIMS] = kind_count[full] / count[full]
    again = np.bincount(doc[1:][(rows[1:] == rows[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    out[full, 3 * DIMS + 1] = again[full] / count[full]
    out[full, 3 * DIMS + 2] = np.log1p(count[full]) / 8
    return out


@dataclass
class Network:
    """Two layers over standardised numbers; ``temperature`` divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype("float64")) / self.temperature, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Adam on the cross entropy over four fifths of the rows; the temperature on the rest."""
    x = x.astype("float64")
    d = x.shape[1] if x.ndim == 2 and x.size else 3 * DIMS + 3
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(y):
        return net
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.b2 = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    late, early = order[:cut], order[cut:]
    net.centre, net.scale = x[early].mean(0), x[early].std(0) + 1e-6
    net.w1, net.w2 = rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.centre) / net.scale
    for _ in range(epochs):
        rng.shuffle(early)
        for at in range(0, len(early), 128):
            rows = early[at : at + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            off = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(off, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * params[0], back.sum(0), h.T @ off + decay * params[2], np.array([off.sum()])]
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logit, want = net.logit(x[late]), y[late]
    tries = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / s) - want * logit / s) for s in tries]
    net.temperature = float(tries[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[bytes], known: Tokens) -> np.ndarray:
        return self.network.score(described(texts, self.vectors, known))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all of ``docs``, the network from at most ``sample`` of its labelled rows."""
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch, texts in slices(batches):
            x = described(texts, sent.value, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"]
            )

    seen = labelled_sample(docs, labels, "quality", sample).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = seen.mapInArrow(features, "doc_id long, y int, x array<float>").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), np.float32) if len(found) else np.zeros((0, 3 * DIMS + 3), np.float32)
    return QualityModel(vectors, fitted(x, found["y"].to_numpy().astype("float64")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch, texts in slices(batches):
            s = model.value.scores(texts, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype("int32"))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(model.value.scores(texts, known) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
