"""Hard negatives of labelled vectors by Fagin's threshold algorithm.

For each anchor: its positives, the best other rows of its label, and for each positive the best rows of other labels whose
score lies in a window below the positive's score. Scores are integer inner products of ``floor(scale x)``.

A tile holds a part of the candidates and a block of anchors. The candidates are sorted once for each dimension. An anchor
reads the lists in parallel, from the end that its sign in that dimension favours; a row met in any list is scored in
full (random access); the *threshold*, the sum over dimensions of anchor component times the value at the present depth,
bounds the scores of all rows not met. An anchor stops once the threshold is strictly below the k-th score of each of its windows
(the window's lower end, where fewer than k are found), so that ties are all seen. Depths double, so at most twice the
necessary rows are read.

For positives, candidates meet anchors of their own label only: a label's rows are cut into parts, its anchors into
blocks. For negatives, rows lie in cells around centres of a bounded sample (``SAMPLE`` rows, at most ``CELLS`` cells;
they decide what is skipped, never what is found). The threshold at depth zero is the bound of the cell's box: it is taken
before anything moves, and an anchor goes to those cells only whose bound reaches one of its windows.
A tile has some ``CHUNK`` candidates and ``BLOCK`` anchors, whatever the size of the table.

Defined results: rows with a null id, a null label, a null vector, or a null, NaN or infinite component take no part; only
vectors of one length are compared; rows that repeat an id are rows of their own for others and never for that id, whose
anchor is its first row (by label, then vector); a positive that stands twice has two windows; an anchor
without positives or whose windows are empty gives no rows; an empty table gives an empty result; other columns play no
part. Scores within a long are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.vector_cells import boxes, centres, finite, marked, matrix, met_in_arrow, nearest, numbered, part_of, with_parts

CHUNK = 8192
BLOCK = 8192
CELLS = 256
SAMPLE = 8192
FIRST = 32
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class SortedLists:
    """Candidates with a list for each dimension, sorted by value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        n = len(x)
        self.ids, self.x = ids, x
        self.up = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        values = np.take_along_axis(x.T, self.up, 1)
        self.depths = [0, *(FIRST << i for i in range(32) if FIRST << i < n), n]
        ends = [t for t in self.depths if t < n]
        self.least, self.greatest = values[:, ends], values[:, [n - 1 - t for t in ends]]
        self.size = np.abs(x).max() if x.size else 0.0

    def thresholds(self, q: np.ndarray) -> np.ndarray:
        """Bound of the scores of rows not met, for each anchor and depth; below everything once all rows are met."""
        t = np.maximum(q, 0) @ self.greatest + np.minimum(q, 0) @ self.least
        return np.concatenate([t, np.full((len(q), 1), -np.inf)], axis=1)

    def exact(self, q: np.ndarray) -> bool:
        return float(np.abs(q).max(initial=0)) * self.size * max(1, len(q)) < 2.0**53

    def search(self, q: np.ndarray, t: np.ndarray, windows: np.ndarray, k: int, fits: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (least and greatest score) the k best rows among ``fits``; and the number of rows scored.

        ``t`` are the anchor's thresholds. Rows are (id, score), best first, ties to smaller ids.
        """
        low, high = windows[:, 0], windows[:, 1]
        exact, met, seen = self.exact(q), np.zeros(len(self.x), bool), 0
        if not exact:
            t = np.where(t > -np.inf, t + np.abs(np.maximum(t, -1e300)) * 1e-9 + 1, t)
        up = q > 0
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kth = low.copy()
        lists = np.flatnonzero(q)
        for at, depth in enumerate(self.depths):
            if depth:
                done = self.depths[at - 1]
                new = np.zeros(len(met), bool)
                if depth == len(met):
                    new[:] = True
                else:
                    new[self.up[lists[~up[lists]], done:depth]] = True
                    new[self.up[lists[up[lists]], len(met) - depth : len(met) - done]] = True
                new = np.flatnonzero(new & ~met)
                met[new] = True
                new = new[fits[new]]
                seen += len(new)
                got = (self.x[new] @ q).astype(np.int64) if exact else self.x[new].astype(np.int64) @ q.astype(np.int64)
                near = (got >= low.min()) & (got <= high.max())
                rows, scores = np.concatenate([rows, new[near]]), np.concatenate([scores, got[near]])
                for j in range(len(low)):
                    inside = scores[(scores >= low[j]) & (scores <= high[j])]
                    if len(inside) >= k:
                        kth[j] = np.partition(inside, len(inside) - k)[len(inside) - k]
                if len(low) == 1 and len(scores) > 4 * k:
                    rows, scores = rows[scores >= kth[0]], scores[scores >= kth[0]]
            if t[at] < kth.min():
                break
        out = []
        for j in range(len(low)):
            inside = np.flatnonzero((scores >= max(low[j], kth[j])) & (scores <= high[j]))
            first = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))][:k]
            out.append((self.ids[rows[first]], scores[first]))
        return out, seen


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    d = table.column("dim")[0].as_py()
    return np.asarray(table.column("id")), matrix(table.column("vec")) if d else np.zeros((table.num_rows, 0))


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(names, columns, strict=True)})


def positives_of(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``anchor, place, id, score``: the ``k`` best other rows of each anchor's label."""
    keys = ["dim", "label"]
    counts = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    left = rows.join(parts, keys).join(counts, keys).withColumn("part", part_of("parts"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = anchors.join(parts, keys).join(counts, keys).withColumn("block", part_of("blocks"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key, used = [*keys, "part", "block"], ["id", "vec", "dim", "label", "part", "block"]

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and asked.num_rows:
            lists, (own, q) = SortedLists(*_arrays(candidates)), _arrays(asked)
            t, whole = lists.thresholds(q), np.array([[_LEAST, _MOST]])
            for i in range(len(q)):
                [(ids, scores)], _ = lists.search(q[i], t[i], whole, k, lists.ids != own[i])
                found.append((np.full(len(ids), own[i]), ids, scores))
        return _table(found, ["anchor", "id", "score"])

    near = met_in_arrow(left.select(*used), right.select(*used), key, search, "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row with ``is_anchor`` (over
    column ``id``) and each of its positives the best rows of another label that score ``low`` to ``high`` percent of it."""
    spark = table.sparkSession
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = table.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(F.col(vec_col)))
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("vec"), F.size(vec_col).alias("dim"))
    rows = numbered(good, "labelled-vectors")
    first = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vec", "dim", "row")).alias("a"))
    anchors = first.select("id", "a.*")

    ranked = positives_of(rows, anchors, positives)
    bounds = ranked.withColumn("low", F.ceil(F.col("score").cast("decimal(38,0)") * low / 100).cast("long"))
    bounds = bounds.withColumn("high", F.floor(F.col("score").cast("decimal(38,0)") * high / 100).cast("long")).filter("low <= high")
    wanted = bounds.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "low", "high"))).alias("p"))  # at most ``positives`` each
    asked = anchors.join(wanted.withColumnRenamed("anchor", "id"), "id").select("id", "label", "vec", "dim", "row", "p")
    asked = numbered(asked.drop("row").withColumn("least", F.array_min("p.low")), "anchors")

    few = rows.select("dim", "vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toPandas()  # bounded
    count = rows.count()
    cells = {
        int(d): centres(np.array(g["vec"].tolist(), np.float64).reshape(len(g), int(d)), min(CELLS, -(-count // CHUNK)))
        for d, g in few.groupby("dim")
    }
    sent = spark.sparkContext.broadcast(cells)

    def cell(x: np.ndarray, d: int) -> np.ndarray:
        to = sent.value.get(d)
        return nearest(x, to) if to is not None and len(to) > 1 and d else np.zeros(len(x), int)

    celled = marked(rows, cell, "cell")
    celled = numbered(with_parts(celled.drop("row"), ["dim", "cell"], CHUNK), "cells")
    blocks = max(1, -(-asked.count() // BLOCK))
    left = celled.withColumn("part", part_of("parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ends = F.zip_with(
        F.zip_with("vec", "low", lambda a, b: a * b), F.zip_with("vec", "high", lambda a, b: a * b), lambda a, b: F.greatest(a, b)
    )
    reach = F.aggregate(ends, F.lit(0.0), lambda a, b: a + b)
    counts = celled.groupBy("dim", "cell").agg(F.first("parts").alias("parts"))
    goes = asked.join(boxes(celled).join(counts, ["dim", "cell"]), "dim").filter(reach * (1 + 1e-9) + 1 + F.abs(reach) * 2e-9 >= F.col("least"))
    right = goes.withColumn("block", part_of(F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["dim", "cell", "part", "block"]

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and asked.num_rows:
            lists, (own, q) = SortedLists(*_arrays(candidates)), _arrays(asked)
            labels, mine = np.asarray(candidates.column("label")), np.asarray(asked.column("label"))
            t = lists.thresholds(q)
            for i, windows in enumerate(asked.column("p").to_pylist()):
                ends = np.array([[w["low"], w["high"]] for w in windows])
                per, _ = lists.search(q[i], t[i], ends, negatives, (labels != mine[i]) & (lists.ids != own[i]))
                for w, (ids, scores) in zip(windows, per, strict=True):
                    same = [np.full(len(ids), v) for v in (own[i], w["place"], w["id"], w["score"])]
                    found.append((*same, ids, scores))
        return _table(found, ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    near = met_in_arrow(left.select("id", "vec", "label", *key), right.select("id", "vec", "label", "p", *key), key, search, schema)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
