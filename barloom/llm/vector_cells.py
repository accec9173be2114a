"""Tables of vectors, cut into cells and parts of bounded size.

A *cell* holds vectors that lie together; a cell (or another key) with many rows is cut into *parts* by a hash of the row
number, which is written with the rows, so that repeated rows spread too and a lost task gets the same rows again. The box
of a cell, the least and greatest value of each coordinate, is gathered from partial boxes: one for each cell and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import staged
from barloom.llm.topk_search import matrix

__all__ = ["boxes", "centres", "finite", "marked", "matrix", "met_in_arrow", "numbered", "part_of", "with_parts"]


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine, F.lit(False))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder with a number ``row`` for each."""
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), name)


def part_of(parts: Column | str) -> Column:
    return F.pmod(F.xxhash64("row"), F.col(parts) if isinstance(parts, str) else parts).cast("int")


def with_parts(rows: DataFrame, keys: list[str], size: int, name: str = "parts") -> DataFrame:
    """``rows`` with the number of parts, of some ``size`` rows each, of their key: counts are combined before they move."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    return rows.join(counts, keys)


def met_in_arrow(left: DataFrame, right: DataFrame, key: list[str], search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``search(candidates, asked)`` gives for the rows of each key; both sides may come from one table."""
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def marked(rows: DataFrame, mark: Callable[[np.ndarray, int], np.ndarray], name: str, column: str = "vec") -> DataFrame:
    """``rows`` with an int column: what ``mark(matrix, dim)`` gives for the vectors of each length."""
    names = [c for c in rows.columns if c != name]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + f", `{name}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                x = matrix(some.column(column)) if d else np.zeros((some.num_rows, 0))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(mark(x, int(d)), pa.int32())], [*names, name])

    return rows.mapInArrow(run, schema)


def boxes(rows: DataFrame, column: str = "vec") -> DataFrame:
    """``dim, cell, low, high``: the box of the vectors of each cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims, cells = np.asarray(batch.column("dim")), np.asarray(batch.column("cell"))
            for d, c in np.unique(np.stack([dims, cells]), axis=1).T:
                some = batch.filter(pa.array((dims == d) & (cells == c)))
                x = matrix(some.column(column)) if d else np.zeros((some.num_rows, 0))
                low, high = found.get((d, c), (np.inf, -np.inf))
                found[(d, c)] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        for (d, c), (low, high) in found.items():
            ends = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([c], pa.int32()), *ends], ["dim", "cell", "low", "high"])

    schema = "dim int, cell int, low array<double>, high array<double>"
    each = rows.select("dim", "cell", column).mapInArrow(partial, schema)
    at = each.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    ends = at.groupBy("dim", "cell", "at").agg(F.min("x.low").alias("l"), F.max("x.high").alias("h"))
    listed = ends.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "l", "h"))).alias("b"))
    return listed.select("dim", "cell", F.col("b.l").alias("low"), F.col("b.h").alias("high"))


def centres(x: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """At most ``most`` cell centres of a bounded sample: rows at equal steps, moved to the means of their cells."""
    now = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds):
        near = nearest(x, now)
        counts = np.bincount(near, minlength=len(now))
        sums = np.zeros_like(now)
        np.add.at(sums, near, x)
        now = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], now)
    return now


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.argmin((to**2).sum(1) - 2 * (x @ to.T), axis=1)
