"""Vector codes by a codebook for each part, with memoised grid cells.

Vectors become integers (``floor(scale x)``) and are cut into ``parts`` equal parts. A codebook starts as that part of the
``entries`` vectors of smallest id; each round gives every part to the nearest entry and moves each entry to the floored
mean of its parts. All of it is integer arithmetic: the result does not depend on how the table is cut.

To find the nearest entry, a part is put into a cell of a grid of width ``WIDTH``. For the cell's box the least and
greatest squared distance to each entry are known; an entry whose least distance is above the smallest greatest one
can be nearest nowhere in the box. The entries left are kept under the cell's hash (with the cell itself, so that a shared
hash harms nothing), up to ``REMEMBERED`` bytes a task, and only they are evaluated exactly.

A task adds up sums and counts of each entry; these, ``parts * entries * (length + 1)`` numbers a task at most, are all
that a round shuffles, and the new codebooks are all that reaches the driver.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped; of the others those of
another length than the commonest (of equally common ones the shortest), or where that length is not divisible by ``parts``,
keep null codes and errors; a null id comes last and is kept; repeated rows count each; with fewer rows than ``entries`` all
of them start a codebook. Components are held within 2^27 either way, so that errors fit a long; sums of errors beyond
a long are null. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import staged
from barloom.llm.vector_cells import finite, matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
WIDTH = 64
REMEMBERED = 64_000_000
SLICE = 1024
_BOUND = 1 << 27


class Codebook:
    """The entries of one part, and for the cells met which of them can be nearest somewhere in the cell."""

    def __init__(self, entries: np.ndarray, width: int = WIDTH, remembered: int = REMEMBERED):
        self.entries, self.width, self.most = entries.astype(np.int64), width, remembered
        self.square = (self.entries**2).sum(1)
        #: Entries that may be nearest in a cell, by the cell's components as bytes.
        self.known: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.evaluated = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell (a row of grid places) the numbers of the entries that are not dominated across its box."""
        low = cells * self.width
        least, greatest = np.zeros((2, len(cells), len(self.entries)), np.int64)
        for d in range(cells.shape[1]):
            below = low[:, d, None] - self.entries[:, d]  # how far the box begins above the entry
            above = -below - (self.width - 1)  # and ends below it
            least += np.maximum(np.maximum(below, above), 0) ** 2
            greatest += np.maximum(np.abs(below), np.abs(above)) ** 2
        open_ = least <= greatest.min(1)[:, None]
        rows, entries = np.nonzero(open_)
        return np.split(entries.astype(np.uint16), np.cumsum(np.bincount(rows, minlength=len(cells)))[:-1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each row, ties to the lower number, and the squared distance."""
        cells, at = np.unique(x // self.width, axis=0, return_inverse=True)
        at = at.reshape(-1)
        keys = [c.tobytes() for c in np.ascontiguousarray(cells)]
        new = [i for i, key in enumerate(keys) if key not in self.known]
        for i, left in zip(new, self.candidates(cells[new]) if new else (), strict=True):
            if self.held > self.most:
                self.known, self.held = {k: self.known[k] for k in keys if k in self.known}, 0
                self.held = sum(len(k) + v.nbytes + 200 for k, v in self.known.items())
            self.known[keys[i]] = left
            self.held += len(keys[i]) + left.nbytes + 200
        lists = [self.known[k] for k in keys]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(lists).astype(np.int64)
        each = sizes[at]  # entries to evaluate for each row
        begins = np.cumsum(each) - each
        self.evaluated += int(each.sum())
        rows = np.repeat(np.arange(len(x)), each)
        entries = flat[np.arange(len(rows)) - np.repeat(begins - starts[at], each)]
        apart = np.zeros(len(rows), np.int64)
        for d in range(x.shape[1]):
            apart += (x[rows, d] - self.entries[entries, d]) ** 2
        least = np.minimum.reduceat(apart, begins)
        winner = np.where(apart == least[rows], entries, len(self.entries))
        return np.minimum.reduceat(winner, begins), least


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _parts(batch: pa.RecordBatch, parts: int) -> list[np.ndarray]:
    return np.split(matrix(batch.column("vec")).astype(np.int64), parts, axis=1)


def fitted_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds over ``rows`` (``id``, ``vec`` of whole numbers, one length)."""
    start = rows.filter("id is not null").orderBy("id", "vec").limit(entries).collect()  # bounded
    start += rows.filter("id is null").orderBy("vec").limit(entries - len(start)).collect() if len(start) < entries else []
    if not start:
        return []
    books = np.split(np.array([r["vec"] for r in start], np.int64), parts, axis=1)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            own = [Codebook(b) for b in books]
            total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
            for batch in _slices(batches):
                for t, book, x in zip(total, own, _parts(batch, len(books)), strict=True):
                    near, _ = book.nearest(x)
                    np.add.at(t, near, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
            for j, t in enumerate(total):
                used = np.flatnonzero(t[:, -1])
                if len(used):
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(used), j, np.int32), "entry": used.astype(np.int32), "total": pa.array(list(t[used]), pa.list_(pa.int64()))})

        found = rows.select("vec").mapInArrow(sums, "part int, entry int, total array<long>")
        at = found.select("part", "entry", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
        moved = [b.copy() for b in books]
        whole: dict[tuple[int, int], dict[int, int]] = {}
        for r in at.collect():  # parts * entries * (length + 1) numbers at most
            whole.setdefault((r["part"], r["entry"]), {})[r["at"]] = r["x"]
        for (j, e), t in whole.items():
            moved[j][e] = [t[d] // t[books[j].shape[1]] for d in range(books[j].shape[1])]
        books = moved
    return books


def vector_codes(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row whose vector is whole and finite."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: entries must be 1 to 256")
    whole = F.transform(F.col(vec_col), lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(float(_BOUND))), F.lit(-float(_BOUND))))
    good = table.filter(finite(F.col(vec_col)))
    good = good.select(F.col(id_col).cast("long").alias("id"), whole.alias("vec"), F.size(vec_col).alias("dim"), F.col(label_col).alias("label"))
    good = staged(good, "code-vectors")
    dims = good.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    dim = dims["dim"] if dims and dims["dim"] and dims["dim"] % parts == 0 else -1
    books = fitted_codebooks(good.filter(F.col("dim") == dim), parts, entries, rounds) if dim > 0 else []
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in _slices(batches):
            fits = np.asarray(batch.column("dim")) == dim
            code = np.full(batch.num_rows, None, object)
            error = np.zeros(batch.num_rows, np.int64)
            if fits.any() and own:
                found = [book.nearest(x) for book, x in zip(own, _parts(batch.filter(pa.array(fits)), parts), strict=True)]
                code[fits] = [row.tobytes().hex() for row in np.stack([near for near, _ in found], 1).astype(np.uint8)]
                error[fits] = sum(apart for _, apart in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=~fits)], ["id", "label", "code", "error"]
            )

    label = good.schema["label"].dataType.simpleString()
    each = staged(good.mapInArrow(coded, f"id long, label {label}, code string, error long"), "codes")
    total = each.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    total = total.withColumn("label_error", F.expr("try_cast(s AS bigint)"))
    return each.join(total, each["label"].eqNullSafe(total["l"])).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
