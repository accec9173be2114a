"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

Each match of the split pattern is encoded by itself. Its bytes are the leaves of a segment tree; a leaf holds the rank of
the pair that begins there (the part at this byte and the next live part), an inner node the least rank below it. The
root tells whether a merge is left; walking down to the left child first on ties finds the leftmost one. A merge makes
three leaf updates: the merged part, its live left neighbour, and the byte that no longer begins a part. So a match of
n bytes costs O(n log n), however long it is.

Matches repeat, so a task remembers what it has encoded (some ``REMEMBERED`` matches, then it starts anew), and new short
ones are merged together as rows of one array of trees.

Defined results: null and empty texts have no tokens and decode to nothing; repeated rows repeat; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read. Nothing is shuffled.
Bytes of a text that are no UTF-8 count as the replacement character U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices

REMEMBERED = 400_000
_NONE = 1 << 40
#: Matches of up to so many bytes are merged together, so many at a time.
_TOGETHER, _ROWS = 64, 4096


@lru_cache(maxsize=4)
def rank_table(path: str) -> dict[bytes, int]:
    """Token bytes to rank: lines of base-64 text and a number. Raises ValueError if a single byte has no rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: every byte needs a rank")
    return ranks


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the parts that are left when no pair of neighbours has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least

    while (least := tree[1]) < _NONE:
        k = 1
        while k < size:
            k = 2 * k if tree[2 * k] == least else 2 * k + 1
        i = k - size
        gone = after[i]
        right = after[i] = after[gone]
        if right <= n:
            before[right] = i
        put(gone, _NONE)
        put(i, ranks.get(piece[i : after[right]], _NONE) if right < n else _NONE)
        if (left := before[i]) >= 0:
            put(left, ranks.get(piece[left:right], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


_SLOT_BITS, _SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of pairs of ids, from every split of every token: a hash table (keys, ranks; a pair is in its slot or one of
    the next), ranks of pairs of bytes, and the id of each byte."""
    ranks = rank_table(path)
    key, rank = np.array(
        [(ranks[t[:k]] << 20 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks] or [(-1, _NONE)],
        np.int64,
    ).T.copy()
    keys, values = np.full((1 << _SLOT_BITS) + len(key), -1, np.int64), np.full((1 << _SLOT_BITS) + len(key), _NONE, np.int64)
    at, left = _slot(key), np.arange(len(key))
    while len(left):
        free = left[keys[at[left]] == -1]
        keys[at[free]] = key[free]
        values[at[free]] = rank[free]
        placed = keys[at[left]] == key[left]
        at[left] += ~placed
        left = left[~placed]
    values[keys == -1] = _NONE
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    two = np.full((256, 256), _NONE, np.int64)
    for t, r in ranks.items():
        if len(t) == 2:
            two[t[0], t[1]] = r
    return keys, values, two, single


def merged_together(pieces: list[bytes], size: int, path: str) -> list[list[int]]:
    """As ``merged`` for many matches of at most ``size`` (a power of two) bytes: their trees are rows of one array, and
    each step makes the next merge of every row that has one left."""
    keys, values, two, single = pair_table(path)
    lengths = np.array([len(p) for p in pieces])
    m, rows = len(pieces), np.arange(len(pieces))
    text = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    ids = np.zeros((m, size + 2), np.int64)
    ids[:, :size] = single[text]
    after, before = np.tile(np.arange(1, size + 3), (m, 1)), np.tile(np.arange(-1, size + 1), (m, 1))

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = _slot(key)
        out, seen = values[at], keys[at]
        more = np.flatnonzero((seen != key) & (seen != -1))
        out[seen != key] = _NONE
        while len(more):
            at[more] += 1
            seen = keys[at[more]]
            hit = more[seen == key[more]]
            out[hit] = values[at[hit]]
            more = more[(seen != key[more]) & (seen != -1)]
        return out

    tree = np.full((m, 2 * size), _NONE, np.int64)
    tree[:, size : 2 * size - 1] = np.where(np.arange(size - 1) < lengths[:, None] - 1, two[text[:, :-1], text[:, 1:]], _NONE)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(r: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
        k = i + size
        tree[r, k] = rank
        while len(k) and k[0] > 1:  # all leaves are equally deep
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    r = rows[tree[:, 1] < _NONE]
    while len(r):
        least, k = tree[r, 1], np.ones(len(r), np.int64)
        while k[0] < size:
            k = 2 * k + (tree[r, 2 * k] != least)
        i = k - size
        gone = after[r, i]
        right = after[r, gone]
        ids[r, i], after[r, i], before[r, right] = least, right, i
        put(r, gone, np.full(len(r), _NONE))
        put(r, i, np.where(right < lengths[r], rank_of(least, ids[r, right]), _NONE))
        left = before[r, i]
        has = left >= 0
        put(r[has], left[has], rank_of(ids[r[has], left[has]], least[has]))
        r = r[tree[r, 1] < _NONE]
    live, out = np.zeros((m, size + 3), bool), np.zeros(m, np.int64)
    r = rows[lengths > 0]
    while len(r):
        live[r, out[r]] = True
        out[r] = after[r, out[r]]
        r = r[out[r] < lengths[r]]
    flat, ends = ids[live[:, : size + 2]].tolist(), np.cumsum(live.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts, a list at a time, and remembers matches of the pattern with their ids (decimals joined by spaces)."""

    def __init__(self, path: str, pattern: str):
        self.path, self.ranks = path, rank_table(path)
        self.find = regex.compile(pattern).findall
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.known: dict[str, str] = {}

    def learn(self, pieces: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.known[p] = str(whole)
            elif len(raw) > _TOGETHER:
                self.known[p] = " ".join(map(str, merged(raw, self.ranks)))
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append(p)
        for size, group in by_size.items():
            for at in range(0, len(group), _ROWS):
                some = group[at : at + _ROWS]
                for p, ids in zip(some, merged_together([p.encode() for p in some], size, self.path), strict=True):
                    self.known[p] = " ".join(map(str, ids))

    def encode_all(self, texts: list[str]) -> list[str]:
        lists = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*lists).difference(self.known))
        get = self.known.__getitem__
        return [" ".join(map(get, x)) for x in lists]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` but a former ``ids``, and ``ids`` (array of int): the tokens of ``text``."""
    kept = docs.drop("ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, pattern)
        for batch, texts in slices(batches):
            ids = [[int(i) for i in x.split()] for x in coder.encode_all([t.decode("utf-8", "replace") for t in texts])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return kept.mapInArrow(task, kept.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``tokens`` and ``decoded`` (binary): the bytes of ``ids``. An id without a token raises KeyError."""
    kept = tokens.drop("decoded")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = Encoder(path, pattern).bytes_of
        for batch in batches:
            data = [b"".join(bytes_of[str(i)] for i in ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(task, kept.withColumn("decoded", F.lit(None).cast("binary")).schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and the ids decoded again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, pattern)
        for batch, texts in slices(batches):
            ids = coder.encode_all([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
