"""Benchmark decontamination by a prefix-filtered set join.

An item's *window* is a run of ``size`` of its words (all of them, if it has fewer). A window is a set of shingles of
three words. To occur in a document, all of its shingles must, so its necessary prefix is a single one: the rarest,
by a count of shingles over all documents. The join:

1. count the documents' shingles in a table of a fixed size (``SLOTS``), which orders shingles by rarity;
2. pick each window's rarest shingle; a bit table of these lets documents drop other shingles before any shuffle;
3. join what is left on the shingle; the words around it bound length and place: a window that starts before the
   document or ends behind it never fits;
4. compare all words of the window with the document's words there (as 64-bit hashes), and unite the places per document.

Only hits are shuffled, never texts. A frequent passage gives many rows of one shingle, whose other side has the few
windows that chose it, so Spark broadcasts that side or splits the skewed partition.

Defined results: null or wordless texts have no words and no hits; items without words have no windows; an item without
an id marks words but isn't listed; repeated documents and items repeat or count once; empty tables give no hits.
Documents are read for ``doc_id`` and ``text``, items for ``item_id`` and ``text``; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Hashes, bit_table, gram_hashes, has_bit, hashed_words, slices, staged, tabulated

WINDOW = 10
SHINGLE = 3
SLOTS = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_LOWER).split()


def row_key(id_col: str = "doc_id") -> Column:
    """Equal for rows of the same id and text only, so that results can be joined back to repeated rows."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit(""))))


def shingle_counts(docs: DataFrame) -> np.ndarray:
    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        hashes = Hashes()
        for _, texts in slices(batches):
            ids, begins = hashed_words(texts, hashes, words)
            if not len(ids):
                continue
            grams = gram_hashes(ids, SHINGLE)
            inside = np.ones(len(ids), bool)
            for last in range(1, SHINGLE):
                inside[(begins[1:] - last).clip(0)] = False
            own += np.bincount((grams[inside[: len(grams)]] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(own.dtype)

    return tabulated(docs.select("text"), SLOTS, "uint32", fill, "uint64")


def item_windows(items: DataFrame, counts: np.ndarray, size: int) -> DataFrame:
    """``token, item, skip, length, window``: each window with its rarest shingle, ``skip`` words after its start."""
    sent = items.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in slices(batches):
            ids, begins = hashed_words(texts, hashes, words)
            out: dict[str, list] = {k: [] for k in ("token", "item", "skip", "length", "window")}
            for item, a, b in zip(batch.column("item").to_pylist(), begins[:-1], begins[1:], strict=True):
                length = min(size, b - a)
                if not length:
                    continue
                own, n = ids[a:b], min(SHINGLE, length)
                grams = gram_hashes(own, n)
                rank = sent.value[(grams % np.uint64(SLOTS)).astype(np.int64)]
                for start in range(len(own) - length + 1):
                    reach = slice(start, start + length - n + 1)
                    skip = int(np.lexsort((grams[reach], rank[reach]))[0])
                    out["token"].append(int(grams[start + skip].view(np.int64)))
                    out["item"].append(item)
                    out["skip"].append(skip)
                    out["length"].append(int(length))
                    out["window"].append(own[start : start + length].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("token", pa.int64()), ("item", pa.string()), ("skip", pa.int32()), ("length", pa.int32()), ("window", pa.binary())]))

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "token long, item string, skip int, length int, window binary").distinct()


def document_places(docs: DataFrame, wanted: np.ndarray, sizes: list[int], size: int) -> DataFrame:
    """``doc_id, key, n_words, places``: for each row the places of shingles whose bit is set, with the words around."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    place = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("around", pa.binary())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in slices(batches):
            ids, begins = hashed_words(texts, hashes, words)
            places: list[list[dict]] = [[] for _ in texts]
            for n in sizes:
                grams = gram_hashes(ids, n)
                at = np.flatnonzero(has_bit(sent.value, grams))
                doc = np.searchsorted(begins, at, "right") - 1
                fits = at + n <= begins[doc + 1]
                at, doc = at[fits], doc[fits]
                near = at[:, None] + np.arange(1 - size, size)
                outside = (near < begins[doc][:, None]) | (near >= begins[doc + 1][:, None])
                around = np.where(outside, np.uint64(0), ids[near.clip(0, max(0, len(ids) - 1))]) if len(at) else near
                for a, d, gram, row in zip(at, doc, grams[at].view(np.int64), around, strict=True):
                    places[d].append({"token": int(gram), "at": int(a - begins[d]), "around": row.tobytes()})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(begins)), pa.array(places, place)], ["doc_id", "key", "n_words", "places"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return rows.mapInArrow(scan, "doc_id long, key string, n_words long, places array<struct<token:long,at:long,around:binary>>")


def contaminated_words(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each row of ``docs``."""
    windows = staged(item_windows(items, shingle_counts(docs), size), "windows")
    # three words, and fewer only if an item has no more: three rows at most
    sizes = [r[0] for r in windows.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]
    places = staged(document_places(docs, bit_table(windows, "token"), sizes, size), "places")
    near = places.select("key", F.explode("places").alias("p")).select("key", "p.token", "p.at", "p.around").distinct()
    found = (
        near.join(windows, "token")
        .filter(F.expr(f"substring(around, 8 * ({size} - 1 - skip) + 1, 8 * length) = window"))
        .select("key", "item", F.explode(F.expr("sequence(at - skip, at - skip + length - 1)")).alias("word"))
        .groupBy("key")
        .agg(F.count_distinct("word").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return places.select("doc_id", "key", "n_words").join(found, "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    bad = contaminated_words(docs, items, size).filter("contaminated").select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key()).join(bad, "__key", "left_anti").drop("__key")
