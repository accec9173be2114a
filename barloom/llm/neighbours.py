"""Approximate nearest neighbours by stable projections in kd-trees, stopped by a chi-square test.

Largest inner product is made smallest distance: with M the greatest norm, a candidate x becomes (x, sqrt(M^2 - |x|^2)) / M
and a query q becomes (q, 0) / |q|; their squared distance is 2 - 2 q.x / (|q| M), hence the order is that of the products.
``AXES`` Gaussian projections are 2-stable: the squared distance of two projections over the squared distance of the
vectors follows a chi-square law with ``AXES`` degrees of freedom, whatever the data. So if neighbours are verified in the
order of their projected distance, and the next one is farther than sqrt(quantile) times the distance of the k-th best
found, a true neighbour is still missing with probability ``1 - SURE`` at most: the search stops.

Every vector is indexed. The top of the kd-tree, at most ``LEAVES`` leaves, is cut at medians of a bounded sample
(``SAMPLE`` rows); its leaves are the cells, and a cell is cut into parts of some ``CHUNK`` rows, each with a kd-tree
of its own in its task. A query first searches its own cell, which gives a distance d_k. Then it goes to those cells whose box
(of the projections in it) is nearer than the test's radius for d_k, and each search narrows the radius on.

Defined results: rows with a null id and vectors that are null, zero, or hold a null, NaN or infinite component take no part;
only vectors of one length are compared; rows that repeat an id are candidates of their own, not for a query of
that id, whose query is its first vector; with fewer candidates than k all are found (the test
cannot stop a search that has not k); ties go to smaller ids; an empty table gives an empty result. Other columns play no part.
Scores are added in the order of the components, in double precision, on the vectors as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.vector_cells import boxes, finite, matrix, met_in_arrow, numbered, part_of, with_parts

AXES = 12
SURE = 0.97
CHUNK = 8192
BLOCK = 8192
LEAVES = 1024
SAMPLE = 65536
BUCKET = 64
FIRST = 512
SEED = 12


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile of the chi-square law for an even number of degrees of freedom, by bisection of its closed form."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    a, b = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        a, b = ((a + b) / 2, b) if below((a + b) / 2) < p else (a, (a + b) / 2)
    return b


def directions(dim: int, axes: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim + 1, axes))


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Points of the unit ball's cap: squared distances between queries and candidates fall as inner products grow."""
    own = np.sqrt(np.einsum("ij,ij->i", x, x))
    if query:
        return np.concatenate([x / own[:, None], np.zeros((len(x), 1))], axis=1)
    y = x / norm
    return np.concatenate([y, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", y, y), 0))[:, None]], axis=1)


def split_rows(p: np.ndarray, most: int, smallest: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as a list of nodes ``axis, value, left, right``; a leaf has axis -1 and its number as value. Nodes are cut at
    the median of their widest axis until there are ``most`` leaves or a leaf would hold fewer than ``smallest`` rows."""
    nodes: list[list] = [[-1, 0, -1, -1]]
    level, leaves = [(0, np.arange(len(p)))], 1
    while level and leaves < most:
        nxt = []
        for node, rows in level:
            if len(rows) < 2 * smallest or leaves >= most:
                continue
            span = p[rows].max(0) - p[rows].min(0)
            axis = int(np.argmax(span))
            value = float(np.median(p[rows, axis]))
            left = rows[p[rows, axis] <= value]
            right = rows[p[rows, axis] > value]
            if not len(right):
                continue  # equal rows: their cell is cut by rows instead
            nodes[node] = [axis, value, len(nodes), len(nodes) + 1]
            nxt += [(len(nodes), left), (len(nodes) + 1, right)]
            nodes += [[-1, 0, -1, -1], [-1, 0, -1, -1]]
            leaves += 1
        level = nxt
    for number, node in enumerate([n for n in nodes if n[0] < 0]):
        node[1] = number
    return [tuple(n) for n in nodes]


def leaf_of(p: np.ndarray, tree: list[tuple[int, float, int, int]]) -> np.ndarray:
    at, out = [(0, np.arange(len(p)))], np.zeros(len(p), int)
    while at:
        node, rows = at.pop()
        axis, value, left, right = tree[node]
        if axis < 0:
            out[rows] = value
        else:
            low = p[rows, axis] <= value
            at += [(left, rows[low]), (right, rows[~low])]
    return out


class Tree:
    """The candidates of a tile: vectors, projections, and a kd-tree over the projections with boxes of its leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray, norm: float):
        leaf = leaf_of(p, split_rows(p, max(1, len(p) // BUCKET), BUCKET // 2))
        order = np.argsort(leaf, kind="stable")
        self.ids, self.x, self.p, self.norm = ids[order], x[order], p[order], norm
        starts = np.concatenate([[0], np.flatnonzero(np.diff(leaf[order])) + 1])
        self.low, self.high = np.minimum.reduceat(self.p, starts), np.maximum.reduceat(self.p, starts)
        self.starts, self.ends = starts, np.concatenate([starts[1:], [len(p)]])

    def search(self, own: int, q: np.ndarray, p: np.ndarray, k: int, quantile: float, seed: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (id, score) among rows whose turn comes before the test holds, and the number of rows verified.

        ``seed`` is a score that k candidates elsewhere reach (-inf if there are none): the search keeps ties with it.
        """
        length = float(np.sqrt(q @ q))

        def radius(score: float) -> float:
            return quantile * max(2 - 2 * score / (length * self.norm), 0) + 1e-9

        reach = radius(seed) if seed > -np.inf else np.inf
        gaps = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        near = np.einsum("ij,ij->i", gaps, gaps) <= reach
        rows = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[near], self.ends[near], strict=True)]) if near.any() else np.zeros(0, int)
        away = ((self.p[rows] - p) ** 2).sum(1)
        fine = (away <= reach) & (self.ids[rows] != own)
        rows, away = rows[fine], away[fine]
        kept, scores, step, verified = np.zeros(0, int), np.zeros(0), FIRST, 0
        while len(rows):
            if len(rows) > step:
                cut = np.argpartition(away, step)
                now, rest = cut[:step], cut[step:]
            else:
                now, rest = np.arange(len(rows)), np.zeros(0, int)
            kept = np.concatenate([kept, rows[now]])
            scores = np.concatenate([scores, self.x[rows[now]] @ q])
            verified += len(now)
            if len(scores) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                slack = 1e-12 * length * self.norm
                kept, scores = kept[scores >= kth - slack], scores[scores >= kth - slack]
                reach = min(reach, radius(kth - slack))
            rows, away = rows[rest], away[rest]
            fine = away <= reach
            rows, away, step = rows[fine], away[fine], step * 2
        exact = np.zeros(len(kept))
        for d in range(len(q)):
            exact = exact + self.x[kept, d] * q[d]
        first = np.lexsort((self.ids[kept], -exact))[:k]
        return self.ids[kept[first]], exact[first], verified


def nearest_neighbours(
    table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", axes: int = AXES, sure: float = SURE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (over column ``id``) the ``k`` rows found nearest."""
    if axes % 2:
        raise ValueError("axes must be even")
    spark = table.sparkSession
    doubles = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = table.filter(F.col(id_col).isNotNull() & finite(F.col(vec_col)) & F.exists(F.col(vec_col), lambda x: x != 0))
    rows = numbered(good.select(F.col(id_col).cast("long").alias("id"), doubles.alias("vec"), F.size(vec_col).alias("dim")), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    norms = {r["dim"]: math.sqrt(r["n"]) for r in rows.groupBy("dim").agg(F.max(square).alias("n")).collect()}  # a number for each length
    quantile = chi_square_quantile(sure, axes)

    few = rows.select("dim", "vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toPandas()  # bounded
    leaves = min(LEAVES, -(-rows.count() // CHUNK))
    trees = {}
    for d, g in few.groupby("dim"):
        x = np.array(g["vec"].tolist(), np.float64).reshape(len(g), int(d))
        trees[int(d)] = split_rows(lifted(x, norms[d], False) @ directions(int(d), axes), leaves, 1)
    del few
    sent = spark.sparkContext.broadcast((norms, trees))

    def projected(query: bool):
        def run(batches):
            norms, trees = sent.value
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for d in map(int, np.unique(dims)):
                    some = batch.filter(pa.array(dims == d))
                    p = lifted(matrix(some.column("vec")), norms[d], query) @ directions(d, axes)
                    cells = leaf_of(p, trees.get(d, [(-1, 0.0, -1, -1)]))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id"), some.column("vec"), some.column("dim"), pa.array(list(p), pa.list_(pa.float64())), pa.array(cells, pa.int32())],
                        ["id", "vec", "dim", "p", "cell"],
                    )

        return run

    schema = "id long, vec array<double>, dim int, p array<double>, cell int"
    celled = numbered(with_parts(rows.drop("row").mapInArrow(projected(False), schema), ["dim", "cell"], CHUNK), "cells")
    first = rows.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("q"))
    asked = numbered(first.select("id", "q.vec", "q.dim").mapInArrow(projected(True), schema), "queries")
    counts = celled.groupBy("dim", "cell").agg(F.first("parts").alias("parts"))
    out = "query_id long, vec_id long, score double"

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if candidates.num_rows and asked.num_rows:
            norm = sent.value[0][candidates.column("dim")[0].as_py()]
            tree = Tree(np.asarray(candidates.column("id")), matrix(candidates.column("vec")), matrix(candidates.column("p")), norm)
            own, q, p = np.asarray(asked.column("id")), matrix(asked.column("vec")), matrix(asked.column("p"))
            seeds = np.asarray(asked.column("seed"))
            for i in range(len(q)):
                ids, scores, _ = tree.search(own[i], q[i], p[i], k, quantile, seeds[i])
                found.append((np.full(len(ids), own[i]), ids, scores))
        a, b, c = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table(
            {
                "query_id": pa.array(np.concatenate(a) if a else [], pa.int64()),
                "vec_id": pa.array(np.concatenate(b) if b else [], pa.int64()),
                "score": pa.array(np.concatenate(c) if c else [], pa.float64()),
            }
        )

    def met(queries: DataFrame) -> DataFrame:
        """What queries (with ``cell``, ``parts``, ``seed``) find in the cells they are sent to."""
        keys = ["dim", "cell"]
        blocks = queries.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        left = celled.join(blocks, keys).withColumn("part", part_of("parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = queries.join(blocks, keys).withColumn("block", part_of("blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = [*keys, "part", "block"]
        return met_in_arrow(left.select("id", "vec", "p", *key), right.select("id", "vec", "p", "seed", *key), key, search, out)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    here = best(met(asked.join(counts, ["dim", "cell"]).withColumn("seed", F.lit(float("-inf")))))
    here = numbered(here, "near-first").drop("row")
    kth = here.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("seed"))
    known = asked.withColumnRenamed("cell", "home").join(kth, "id", "left").fillna(float("-inf"), ["seed"])
    wide = boxes(celled.select("dim", "cell", F.col("p").alias("vec"))).join(counts, ["dim", "cell"])
    gap = F.zip_with(F.zip_with("low", "p", lambda a, b: a - b), F.zip_with("p", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    gap = F.aggregate(gap, F.lit(0.0), lambda a, x: a + x * x)
    size = F.sqrt(square)
    norm = F.create_map(*[F.lit(v) for pair in norms.items() for v in pair])[F.col("dim")] if norms else F.lit(1.0)
    radius = F.greatest(2 - 2 * F.col("seed") / (size * norm), F.lit(0.0)) * quantile * (1 + 1e-9) + 1e-9
    others = known.join(wide, "dim").filter((F.col("cell") != F.col("home")) & (gap <= radius))
    far = met(others.select("id", "vec", "p", "dim", "cell", "parts", "seed", "row"))
    ranked = best(here.select("query_id", "vec_id", "score").union(far))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
