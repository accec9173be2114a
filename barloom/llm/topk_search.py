"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers (``floor(256 x)``), so scores are exact. A score is half of |q|^2 + |x|^2 - d(q, x)^2, hence the
smallest distances bound the largest scores. For every candidate the distances to ``PIVOTS`` pivots are computed once; the
greatest |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x). Candidates are evaluated in the order of their
score bounds, a batch at a time, until the k-th best score is above every bound that is left: the result is exact.

Candidates lie in chunks of some ``CHUNK`` by a hash of their id, queries in blocks of some ``BLOCK``; each chunk meets
each block of queries, and the best k of each chunk are merged per query. Pivots are chosen farthest-first from a bounded
sample (``SAMPLE`` rows); they decide how much is skipped, never what is found.

Defined results: vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no part;
only vectors of one length are compared; repeated rows are candidates of their own (not for a query of the same id), and
of a repeated query id
the query is its first vector; with fewer candidates than k all are returned; an empty
table gives an empty result. Components up to about 2^31 / 256 keep scores within a long; products beyond 2^53 are
computed in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import staged

PIVOTS = 48
SAMPLE = 2048
CHUNK = 4096
BLOCK = 512
STEP = 256


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists of numbers as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def pivots_of(vectors: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first choice of rows, beginning with the longest vector."""
    chosen = [int(np.argmax((vectors**2).sum(1)))]
    far = ((vectors - vectors[chosen[0]]) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best(q: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (id, score) of the candidates for one query, ties to smaller ids, and how many were evaluated."""
    q_square, x_square = float(q @ q), (x**2).sum(1)
    apart = np.abs(x_table - q_table).max(1) if x_table.shape[1] else np.zeros(len(x))
    slack = 1e-6 * (1 + np.sqrt(q_square) + np.sqrt(x_square))  # rounding of the distances
    bound = (q_square + x_square - np.maximum(apart - slack, 0) ** 2) / 2 + 1
    bound[ids == own] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[: int((bound > -np.inf).sum())]
    whole = q_square * (x_square.max() if len(x) else 0) < 2.0**104
    got_ids, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(order) and (len(got) < k or bound[order[at]] >= got[-1]):
        rows = order[at : at + STEP]
        new = (x[rows] @ q).astype(np.int64) if whole else x[rows].astype(np.int64) @ q.astype(np.int64)
        got_ids, got = np.concatenate([got_ids, ids[rows]]), np.concatenate([got, new])
        first = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[first], got[first]
        at += STEP
    return got_ids, got, min(at, len(order))


def usable(table: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = table.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
    return good.select(F.col(id_col).cast("long").alias("id"), whole.alias("vec")).withColumn("dim", F.size("vec"))


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (over column ``id``) the k best other rows."""
    spark = table.sparkSession
    rows = staged(usable(table, id_col, vec_col, scale), "vectors")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # bounded
    pivots = {int(d): pivots_of(np.array(g["vec"].tolist(), np.float64).reshape(len(g), int(d)), PIVOTS) for d, g in some.groupby("dim")}
    sent = spark.sparkContext.broadcast(pivots)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                x = matrix(some.column("vec")) if d else np.zeros((some.num_rows, 0))
                p = sent.value.get(int(d), np.zeros((0, int(d))))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(distances(x, p)), pa.list_(pa.float64()))], [*some.schema.names, "pivoted"])

    pivoted = rows.mapInArrow(tabled, "id long, vec array<double>, dim int, pivoted array<double>")
    asked = rows.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("q"))
    queries = asked.select("id", "q.vec", "q.dim").mapInArrow(tabled, "id long, vec array<double>, dim int, pivoted array<double>")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(is_query, 1)), F.lit(0)).alias("q")).first()
    blocks, chunks = max(1, -(-counts["q"] // BLOCK)), max(1, -(-counts["n"] // CHUNK))

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")

    left = pivoted.withColumn("chunk", part(chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", part(blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    key = ["dim", "block", "chunk"]

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and candidates.num_rows:
            d, p = asked.column("dim")[0].as_py(), len(asked.column("pivoted")[0])
            x, q = (matrix(t.column("vec")) if d else np.zeros((t.num_rows, 0)) for t in (candidates, asked))
            xt, qt = (matrix(t.column("pivoted")) if p else np.zeros((t.num_rows, 0)) for t in (candidates, asked))
            ids, own = np.asarray(candidates.column("id")), np.asarray(asked.column("id"))
            for i in range(len(q)):
                found, score, _ = best(q[i], qt[i], x, xt, ids, own[i], k)
                out.append((np.full(len(found), own[i]), np.full(len(found), i), found, score))
        cat = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (list(zip(*out, strict=True)) or [()] * 4)]
        return pa.table({"query_id": cat[0], "vec_id": cat[2], "score": cat[3]})

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
