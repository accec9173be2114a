"""Words, hashes and fixed-size tables that several operators share.

A *table* here is a numpy array of a size fixed by a parameter (counters, bits, sums). Each task adds up
its own copy, the copies meet block by block in a shuffle, and only the finished table, whose size does not
depend on the data, is brought to the driver and sent to the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.staging import new_path, shared_folder, staged

__all__ = [
    "Hashes", "bit_table", "crc_fold", "held_out", "labelled_sample", "has_bit", "hashed_words", "keys_bit", "gram_hashes",
    "new_path", "shared_folder", "slices", "staged", "table", "tabulated",
]

#: Bytes of text that a task works on at once.
SLICE = 2_000_000
#: Distinct words whose hashes a task remembers.
REMEMBERED = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # whole texts go to Python: fewer rows at once than the default, which is meant for short ones
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3: rows with 1 are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


class Hashes(dict):
    """Word (bytes) to signed 64-bit hash. Forgets all when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of the batches of about ``SLICE`` bytes of text (one long text is a piece of its own); null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > SLICE:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        yield batch.slice(start), texts[start:]


def hashed_words(texts: list[bytes], hashes: Hashes, words: Callable[[bytes], list[bytes]] = bytes.split):
    """Hashes of the words of all texts in a row, and the place where each text begins (and the last ends)."""
    lists = [words(t) for t in texts]
    begins = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=begins[1:])
    ids = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.int64, begins[-1])
    return ids.view(np.uint64), begins


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on (places that have ``n`` words after them in ``ids``)."""
    m = max(0, len(ids) - n + 1)
    h = np.full(m, np.uint64(n))
    for i in range(n):
        h = h * _ODD + ids[i : i + m]
    return mixed(h)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """``id, text, label`` of at most ``most`` labelled documents that may be learnt from, those first by a hash of the id.

    Several labels of one document count as their largest. The sample is bounded by ``most``, so it may be broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & (crc_fold(id_col) != 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    few = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    return docs.select(id_col, "text").join(F.broadcast(few), id_col).select(id_col, "text", "__y")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row's remainder is 1; a row without an id is not held out, as no label can belong to it."""
    return F.coalesce(crc_fold(id_col) == 1, F.lit(False))


# tables of a fixed size -------------------------------------------------------------------------------------------


def tabulated(
    df: DataFrame, size: int, kind: str, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], wide: str, block: int = 1 << 13
) -> np.ndarray:
    """Sum over all rows of ``df`` of what ``fill(batches, array)`` adds to an array of ``size`` numbers.

    ``kind`` is the dtype in a task and ``wide`` that of the total. The shuffle carries ``size`` numbers per task at
    most, packed, and blocks without a number are left out.
    """
    parts = max(1, min(size // block, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, kind)
        fill(batches, own)
        for at in range(0, size, block):
            if (cut := own[at : at + block]).any():
                yield pa.RecordBatch.from_pydict({"at": [at], "data": [zlib.compress(cut.tobytes(), 1)]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                cut = np.frombuffer(zlib.decompress(data), kind).astype(wide)
                if at in sums:
                    sums[at] += cut
                else:
                    sums[at] = cut
        for at, cut in sums.items():
            yield pa.RecordBatch.from_pydict({"at": [at], "data": [zlib.compress(cut.tobytes(), 1)]})

    found = df.mapInArrow(partial, "at long, data binary").repartition(parts, "at").mapInArrow(added, "at long, data binary")
    total = np.zeros(size, wide)
    for row in found.collect():  # ``size`` numbers at most
        total[row["at"] : row["at"] + block] = np.frombuffer(zlib.decompress(row["data"]), wide)
    return total


#: Bits of a lossless pre-filter: 4 MB, whatever the data.
BITS = 1 << 25


def keys_bit(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (keys.view(np.uint64) * _ODD >> np.uint64(20)) % np.uint64(bits)


def bit_table(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """One bit (packed) for each value of a long column. Values that are not there may share a bit with one that is:
    a filter by this table lets through all that is wanted and some that a later join drops."""

    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            keys = np.asarray(batch.column(column).drop_null(), np.int64)
            at = keys_bit(keys, bits)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    size, block = bits // 8, 1 << 15

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        fill(batches, own)
        for at in range(0, size, block):
            if (cut := own[at : at + block]).any():
                yield pa.RecordBatch.from_pydict({"at": [at], "data": [cut.tobytes()]})

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                cut = np.frombuffer(data, np.uint8)
                sums[at] = sums[at] | cut if at in sums else cut
        for at, cut in sums.items():
            yield pa.RecordBatch.from_pydict({"at": [at], "data": [cut.tobytes()]})

    parts = max(1, min(size // block, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = df.select(column).mapInArrow(partial, "at long, data binary").repartition(parts, "at").mapInArrow(united, "at long, data binary")
    total = np.zeros(size, np.uint8)
    for row in found.collect():  # ``bits`` / 8 bytes at most
        total[row["at"] : row["at"] + block] = np.frombuffer(bytes(row["data"]), np.uint8)
    return total


def has_bit(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys_bit(keys, len(packed) * 8)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


