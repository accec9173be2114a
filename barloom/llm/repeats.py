"""Substring dedup by seed and extend.

*Seeds.* Of the ``SEED``-word runs in a window of ``WINDOW`` words the one with the smallest hash (the leftmost on ties) is
the window's anchor, so equal windows have equal anchors. Neighbouring windows with one anchor form a *stretch*: the anchor
extended to the left and right by all windows that chose it. Only anchors that occur twice anywhere go further (a bit
table of a fixed size drops nearly all others before the shuffle).

*Extend.* Occurrences of an anchor are joined by what they extend to: of equal stretches the first stays, the others are
repeats as wholes. Only where one anchor extends to different stretches, the first of each are compared window by window.
Repeated windows that touch or overlap unite to maximal repeats, and their words go.

Hot anchors are met by aggregates with one row per task and by joins with one row on the other side, never by a list of all
occurrences; texts without a repeat are not shuffled.

Defined results: null and wordless texts keep nothing and lose nothing; a text of fewer than ``WINDOW`` words loses nothing;
rows are ordered by ``doc_id`` (null first), rows of one id by a hash of their text, and rows that repeat both are one
document with one result for each row; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Hashes, bit_table, gram_hashes, has_bit, hashed_words, mixed, slices, staged

WINDOW = 20
SEED = 8


def stretches(ids: np.ndarray, begins: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, number of windows, text and hash of each stretch, and the hashes of all windows."""
    whole = gram_hashes(ids, window)
    m = len(whole)
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[:m]
    inside = np.arange(m) + window <= begins[1:][doc]
    seeds = gram_hashes(ids, seed)
    least, at = seeds[:m].copy(), np.arange(m)
    for k in range(1, window - seed + 1):
        other = seeds[k : k + m]
        better = other < least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + k
    places = np.flatnonzero(inside)
    if not len(places):
        none = np.zeros(0, np.int64)
        return least[:0], none, none, none, least[:0], whole
    new = np.ones(len(places), bool)
    new[1:] = (at[places][1:] != at[places][:-1]) | (doc[places][1:] != doc[places][:-1])
    cut = np.flatnonzero(new)
    first = places[cut]
    count = np.diff(np.append(cut, len(places)))
    step = np.arange(len(places)) - np.repeat(cut, count)
    content = np.add.reduceat(mixed(whole[places] + (step.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)), cut)
    return least[first], first, count, doc[first], content, whole


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for _, texts in slices(batches):
            found = stretches(*hashed_words(texts, hashes), window, seed)[0]
            kinds, count = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(count)], ["anchor", "count"])

    return docs.select("text").mapInArrow(task, "anchor long, count long")


def occurrences(docs: DataFrame, wanted: np.ndarray, window: int, seed: int) -> DataFrame:
    """``doc_id, row, anchor, content, start, windows``: stretches whose anchor has a bit. A stretch that its own document
    has had before has no ``windows`` but their number in ``count``: it is a repeat for certain."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in slices(batches):
            ids, begins = hashed_words(texts, hashes)
            anchor, first, count, doc, content, whole = stretches(ids, begins, window, seed)
            there = np.flatnonzero(has_bit(sent.value, anchor))
            if not len(there):
                continue
            order = there[np.lexsort((first[there], content[there], doc[there]))]
            again = np.zeros(len(anchor), bool)
            again[order[1:]] = (content[order][1:] == content[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            # certain repeats of one document that follow each other are one row
            start = first - begins[doc]
            lead = np.ones(len(there), bool)
            a, b = there[:-1], there[1:]
            lead[1:] = ~(again[a] & again[b] & (doc[a] == doc[b]) & (start[a] + count[a] == start[b]))
            heads = np.flatnonzero(lead)
            total = np.add.reduceat(count[there], heads)
            kept = there[heads]
            windows = [None if again[i] else whole[first[i] : first[i] + count[i]].view(np.int64) for i in kept]
            of = pa.array(doc[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("row").take(of), pa.array(anchor[kept].view(np.int64)), pa.array(content[kept].view(np.int64)), pa.array(start[kept]), pa.array(total), pa.array(windows, pa.list_(pa.int64()))],
                ["doc_id", "row", "anchor", "content", "start", "count", "windows"],
            )

    return rows_of(docs).mapInArrow(task, "doc_id long, row long, anchor long, content long, start long, count long, windows array<long>")


def repeated(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """``doc_id, row, start, count``: runs of windows that also start earlier."""
    often = anchors(docs, window, seed).groupBy("anchor").agg(F.sum("count").alias("n")).filter("n > 1")
    found = staged(occurrences(docs, bit_table(often, "anchor"), window, seed), "stretches")
    own = found.filter("windows is null").select("doc_id", "row", "start", "count")
    fresh = found.filter("windows is not null")
    place = F.struct("doc_id", "row", "start")
    firsts = fresh.groupBy("anchor", "content").agg(F.min(place).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    flagged = fresh.select("doc_id", "row", "anchor", "content", "start", "count").join(firsts, ["anchor", "content"])
    later = flagged.filter(~same).select("doc_id", "row", "start", "count")
    # an anchor that extends to several stretches: the first of each, window by window
    several = firsts.groupBy("anchor").count().filter("count > 1").select("anchor")
    kinds = firsts.join(several, "anchor").select("anchor", "content", "first")
    open_ = fresh.join(kinds, ["anchor", "content"]).filter(same)
    single = staged(open_.select("doc_id", "row", "start", F.posexplode("windows").alias("k", "hash")).select("doc_id", "row", (F.col("start") + F.col("k")).alias("start"), "hash").distinct(), "windows")
    earliest = single.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = single.join(earliest, "hash").filter(~same).select("doc_id", "row", "start", F.lit(1).cast("long").alias("count"))
    return own.union(later).union(late)


def digest(words: list[bytes], starts: list[int], counts: list[int], window: int) -> tuple[int, int, str]:
    keep = np.ones(len(words), bool)
    for a, n in zip(starts, counts, strict=True):
        keep[a : a + n + window - 1] = False
    kept = [w for w, k in zip(words, keep, strict=True) if k] if len(starts) else words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``."""
    if not 1 <= seed <= window:
        raise ValueError("a seed has one word or more, and no more than a window")
    spots = staged(repeated(docs, window, seed).distinct(), "repeats")
    by_row = spots.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(spots, "row"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def has_repeats(batch: pa.RecordBatch) -> np.ndarray:
        return has_bit(sent.value, np.asarray(batch.column("row"), np.int64)) if batch.num_rows else np.zeros(0, bool)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * len(texts)
            counts = batch.column("counts").to_pylist() if "counts" in batch.schema.names else [None] * len(texts)
            done = [digest(t.split(), s or [], c or [], window) for t, s, c in zip(texts, starts, counts, strict=True)]
            n, gone, sha = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finished(b.filter(pa.array(~has_repeats(b))) for b in batches)

    def dirty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_repeats(batch)))

    rows = rows_of(docs)
    whole = rows.mapInArrow(clean, schema)
    some = rows.mapInArrow(dirty, "doc_id long, row long, text string").alias("d")
    hit = some.join(by_row.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.row") == F.col("r.row")), "left")
    return whole.union(hit.select("d.doc_id", "d.text", "r.starts", "r.counts").mapInArrow(finished, schema))
