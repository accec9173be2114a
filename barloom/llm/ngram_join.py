"""N-gram Jaccard join: count vectors in R-trees find the pairs, exact sets verify them.

A document is the set of its five-word shingles (64-bit hashes). The shingles are hashed into groups, about one for four
shingles, and the group counts are a point. Two sets share at most the sum of the smaller coordinates, so a box of points
is out if the sum of the minima of the query and the box's upper corner is too small. ``RTree`` keeps such boxes.

A tree over all documents can't be spread, and points of unrelated long texts lie too close for its upper levels to part
them. So documents are first routed to trees by shingles that linked pairs must share, which loses no link:

1. *Classes.* Equal sets are one class, whatever the number of copies; its node is its smallest ``doc_id``.
2. *Cheap links.* Each class goes to one tree by the minimum of a permuted hash of its rarest shingles (see 3). A tree with
   many classes is cut into chunks of some ``BLOCK``. Classes that are already connected are not compared, so in a large
   group of near copies most members need a few comparisons. Most links are found here; none has to be.
3. *Clusters.* A set of n shingles that links with another shares one of its n - ceil(0.75 n) + 1 rarest shingles (rare by
   a count table of a fixed size over all documents); the smaller of two linked sets has it among its n - ceil(6/7 n) + 1 rarest. Classes
   meet by such a shingle and a band of sizes. Shingles whose classes are all connected by now are dropped, and of
   shingles with the same classes one is enough; the classes of each form a tree. Components that hold classes whose
   points pass the bound get into one cluster. That takes a spanning set of edges, never all pairs.
4. *All other links.* The components of a cluster are compared by trees and exact sets, again leaving out what is connected
   by then; a large cluster is cut into sides of ``BLOCK``, and each two sides are compared in a task of their own.

5. *Counts of links* (``jaccard_links`` only). Every link lies inside a component. The classes of a component are cut into
   sides like those of a cluster, and each two sides are compared in full: an inverted index over the shingles of the block
   gives the exact size of every intersection. A block returns sums weighted by the documents of the linked classes, so
   neither copies nor links become rows; only classes with a ``doc_id`` of several texts are listed as pairs, as its
   documents must not be counted twice.

Defined results: texts without words (null, empty, blank) are linked with nothing; a row without ``doc_id`` has no
component; rows of one ``doc_id`` are one node, linked by any of its texts; repeated rows repeat; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import Hashes, bit_table, gram_hashes, has_bit, hashed_words, mixed, slices, staged, tabulated
from barloom.llm.components import components

WIDTH = 5
#: Size of the table that orders shingles by rarity: 1 MB where it is sent, whatever the data. The more shingles share a
#: slot, the less it tells passages of tens of documents from unique ones, and the more shingles stay open in step 3.
SLOTS = 1 << 20
#: Classes in a tree, or in each of two that are compared; larger groups are cut.
BLOCK = 512
#: A pair links if 7 * common >= 3 * (size + size), which is a Jaccard similarity of 0.75 or more.
FAN = 8


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(texts: list[bytes], hashes: Hashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts (with repetitions) and the text of each; fewer words are one shingle."""
    ids, begins = hashed_words(texts, hashes, lower_words)
    length = np.diff(begins)
    at = np.arange(max(0, len(ids) - width + 1))
    doc = np.repeat(np.arange(len(texts)), length)[: len(at)]
    fits = at + width <= begins[1:][doc]
    found, of = [gram_hashes(ids, width)[fits]], [doc[fits]]
    for n in range(1, width):
        if len(few := np.flatnonzero(length == n)):
            found.append(gram_hashes(ids, n)[begins[few]])
            of.append(few)
    return np.concatenate(found), np.concatenate(of)


def slot(found: np.ndarray) -> np.ndarray:
    """Place of shingles in the table: the upper bits of their hash."""
    return (found >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def shingle_ranks(docs: DataFrame) -> np.ndarray:
    """Class of frequency (quarter powers of two) of the shingles in each of ``SLOTS`` slots, over all documents."""

    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        hashes = Hashes()
        for _, texts in slices(batches):
            found, _ = shingles(texts, hashes)
            np.add.at(own, slot(found), own.dtype.type(1))

    counts = tabulated(docs.select("text"), SLOTS, "uint32", fill, "uint64")
    return np.concatenate([np.minimum(4 * np.log2(cut + 1.0), 255).astype(np.uint8) for cut in np.array_split(counts, 64)])


def sets(texts: list[bytes], hashes: Hashes, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts in a row, each in order of rarity, and where each begins. A shingle is named by its rank (8
    bits) and its hash (56 bits)."""
    found, doc = shingles(texts, hashes)
    names = ranks[slot(found)].astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    names, doc = names[new], doc[new]
    return names, np.searchsorted(doc, np.arange(len(texts) + 1))


def groups_for(n: int) -> int:
    """Coordinates of the point of a set: a power of two, about a quarter of its size."""
    return 1 << min(16, max(4, (max(n, 1) // 4).bit_length()))


def point(names: np.ndarray) -> np.ndarray:
    g = groups_for(len(names))
    return np.bincount((names & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.uint16)


def prefix_of(n: int) -> int:
    """Rarest shingles of a set of ``n`` of which it shares one with any set that links: those two share 3/4 of the larger one."""
    return n - (3 * n + 3) // 4 + 1


def class_rows(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``doc_id, n, sig, route, prefix, point`` of every row; sig and the rest are null or empty without words."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in slices(batches):
            names, begins = sets(texts, hashes, sent.value)
            size = np.diff(begins)
            out: dict[str, list] = {c: [None] * len(texts) for c in ("sig", "route", "prefix", "point")}
            for i in np.flatnonzero(size):
                own = names[begins[i] : begins[i + 1]]
                rare = own[: prefix_of(len(own))]
                out["sig"][i], out["route"][i] = signature(own), route_of(rare)
                out["prefix"][i], out["point"][i] = packed(rare), zlib.compress(point(own).tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(out["sig"], pa.int64()), pa.array(out["route"], pa.int64()), pa.array(out["prefix"], pa.binary()), pa.array(out["point"], pa.binary())],
                ["doc_id", "n", "sig", "route", "prefix", "point"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, n long, sig long, route long, prefix binary, point binary")


def packed(names: np.ndarray) -> bytes:
    """Shingles as join keys of six bytes (of the hash): enough to bring sets together, as pairs are verified later."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<i8").ravel()


def shipped(names: np.ndarray) -> bytes:
    """A set in seven bytes a shingle: the rank in the upper byte follows from the hash."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def received(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.view("<u8").ravel()


def signature(names: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(names.tobytes())
    return h - (1 << 64) if h >> 63 else h


def route_of(keys: np.ndarray) -> int:
    """The tree that a class goes to: the least of its rarest shingles in another order."""
    least = mixed(keys ^ np.uint64(0x51ED270B7F4A7C15)).min()
    return int(least.view(np.int64))


def node_sets(docs: DataFrame, ranks: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """``sig, node, route, names`` of the documents whose id (``node``) has a bit in ``wanted``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((ranks, wanted))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (rank, bits) = Hashes(), sent.value
        for whole in batches:
            near = whole.filter(pa.array(has_bit(bits, np.asarray(whole.column("doc_id"), np.int64))))
            for batch, texts in slices(iter([near])):
                names, begins = sets(texts, hashes, rank)
                own = [names[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
                full = np.flatnonzero([len(x) for x in own])
                own = [own[i] for i in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([signature(x) for x in own], pa.int64()), batch.column("doc_id").take(pa.array(full)),
                        pa.array([route_of(x[: prefix_of(len(x))]) for x in own], pa.int64()), pa.array([shipped(x) for x in own], pa.binary()),
                    ],
                    ["sig", "node", "route", "names"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return rows.mapInArrow(task, "sig long, node long, route long, names binary")


def exact_sets(docs: DataFrame, ranks: np.ndarray, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (``sig, node`` and others) with ``names``, from the text of the document ``node``."""
    return node_sets(docs, ranks, bit_table(wanted, "node")).drop("route").join(wanted, ["sig", "node"])


class RTree:
    """Boxes of points: ``FAN`` neighbours (by size, then by the heaviest coordinates) to a box, level by level.

    A box keeps its upper corner and its least and greatest set size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        lead = points[:, : min(8, points.shape[1])].astype(np.int64)
        self.order = np.lexsort((lead.argmax(1), sizes))
        corner, low, high = points[self.order].astype(np.int32), sizes[self.order], sizes[self.order]
        self.levels = [(corner, low, high)]
        while len(corner) > FAN:
            cut = np.arange(0, len(corner), FAN)
            corner = np.maximum.reduceat(corner, cut)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((corner, low, high))

    def query(self, q: np.ndarray, size: int, apart: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the points that may link with ``q``, and their bounds. ``apart[k]`` says which boxes of level k count."""
        at = np.arange(len(self.levels[-1][0]))
        bound = np.zeros(0, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[k]
            at = at[(3 * size <= 4 * high[at]) & (3 * low[at] <= 4 * size)]
            if apart is not None:
                at = at[apart[k][at]]
            bound = np.minimum(corner[at], q).sum(1) if len(at) else np.zeros(0, np.int64)
            near = 7 * bound >= 3 * (size + low[at])
            at, bound = at[near], bound[near]
            if k:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at], bound

    def boxes(self, counts: np.ndarray) -> list[np.ndarray]:
        """For each level, the boxes that hold a point that counts."""
        out = [counts[self.order]]
        for k in range(1, len(self.levels)):
            out.append(np.logical_or.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
        return out


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    while len(p) > groups:
        half = len(p) // 2
        p = p[:half] + p[half:]
    return p


def trees(points: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, RTree]]:
    """For each number of coordinates: the members with so many, all members that may link with them (those and the
    ones with twice as many, folded), and their tree. Linked sizes differ by a third at most, so no pair is left out."""
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups):
        members = np.flatnonzero((groups == g) | (groups == 2 * g))
        yield np.flatnonzero(groups == g), members, RTree(np.stack([folded(points[m].astype(np.int32), g) for m in members]), sizes[members])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum())


def links_of_block(block: pa.Table) -> pa.Table:
    """Edges that connect what links in a block (``sig, node, comp, side, low, high, names``); connected members aren't
    compared. In a block of two sides only members of different sides are."""
    order = np.lexsort((np.asarray(block.column("node")), np.asarray(block.column("sig"))))  # a class counts with its least document
    first = order[np.unique(np.asarray(block.column("sig"))[order], return_index=True)[1]]
    node, comp, side = (np.asarray(block.column(c))[first] for c in ("node", "comp", "side"))
    names = [received(block.column("names")[int(i)].as_py()) for i in first]
    sizes = np.array([len(x) for x in names], np.int64)
    points = [point(x) for x in names]
    edges: list[tuple[int, int]] = []
    root = np.unique(comp, return_inverse=True)[1]
    for i, found in near_members(points, sizes, root, side, two_sides(block)):
        for j in found:
            if root[i] != root[j] and 7 * common(names[i], names[j]) >= 3 * (sizes[i] + sizes[j]):
                edges.append((int(node[i]), int(node[j])))
                root[root == root[j]] = root[i]
    return edge_table(edges)


def maybe_of_block(block: pa.Table) -> pa.Table:
    """Edges between components that connect all whose points pass the bound in a block (``comp, lead, side, low, high, n,
    point``)."""
    comp, side, sizes, lead = (np.asarray(block.column(c)) for c in ("comp", "side", "n", "lead"))
    points = [np.frombuffer(zlib.decompress(p), np.uint16) for p in block.column("point").to_pylist()]
    edges: list[tuple[int, int]] = []
    root = np.unique(comp, return_inverse=True)[1]
    for i, found in near_members(points, sizes, root, side, two_sides(block)):
        # the smaller of two sets must lead here
        led = np.where(sizes[found] < sizes[i], lead[found], np.where(sizes[found] > sizes[i], lead[i], lead[found] | lead[i]))
        for j in found[led]:
            if root[j] != root[i]:
                edges.append((int(comp[i]), int(comp[j])))
                root[root == root[j]] = root[i]
    return edge_table(edges)


def two_sides(block: pa.Table) -> bool:
    return block.column("low")[0].as_py() != block.column("high")[0].as_py()


def near_members(points: list[np.ndarray], sizes: np.ndarray, root: np.ndarray, side: np.ndarray, two: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Each member, and those of another root (and, with ``two``, of the other side) that pass the bound, best first.
    The caller may unite roots between two members."""
    for own, members, tree in trees(points, sizes):
        for i in own:
            apart = root[members] != root[i]
            if two:
                apart &= side[members] != side[i]
            if apart.any():
                found, bound = tree.query(points[i].astype(np.int32), sizes[i], tree.boxes(apart))
                yield i, members[found[np.argsort(-bound, kind="stable")]]


def edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def cut(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``side, low, high``: a group of ``count`` members is cut into sides of some ``BLOCK``, and each two
    sides (and each side with itself) are a block."""
    parts = rows.join(counts.select(key, F.expr(f"cast(ceil(count / {BLOCK}) as int)").alias("cuts")), key)
    parts = parts.withColumn("side", F.expr("cast(pmod(xxhash64(node), cuts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    return parts.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other", "cuts")


def cheap_links(docs: DataFrame, ranks: np.ndarray, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of classes that one tree holds. A class's documents all pass if one does, so its least one is its node."""
    routed = rows.filter("sig is not null and doc_id is not null").select("sig", "route").distinct()
    shared = staged(routed.groupBy("route").count().filter("count > 1"), "routes")
    nodes = routed.join(shared, "route").join(classes, "sig").select("node")
    large = shared.filter(F.col("count") > BLOCK).select("route", F.expr(f"cast(ceil(count / {BLOCK}) as long)").alias("chunks"))
    names = node_sets(docs, ranks, bit_table(nodes, "node")).join(large, "route", "left")
    whole = names.withColumn("chunk", F.expr("pmod(xxhash64(sig, route), coalesce(chunks, 1))")).drop("chunks")
    whole = whole.withColumn("comp", F.col("node")).withColumns({c: F.lit(0) for c in ("side", "low", "high")})
    return whole.groupBy("route", "chunk").applyInArrow(links_of_block, "a long, b long")


def prefixes_of(known: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """``node, comp, n, prefix`` of each class. Only rows of classes with several documents, or of a component, meet the tables of
    classes and components; any other row is its class's only one and a component by itself."""
    spark = known.sparkSession
    sent = spark.sparkContext.broadcast((bit_table(classes.filter("copies > 1"), "sig"), bit_table(comps, "node")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, joined = sent.value
        for batch in batches:
            alone = ~(has_bit(several, np.asarray(batch.column("sig"), np.int64)) | has_bit(joined, np.asarray(batch.column("doc_id"), np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone)], [*batch.schema.names, "alone"])

    rows = known.select("doc_id", "sig", "n", "prefix").mapInArrow(task, "doc_id long, sig long, n long, prefix binary, alone boolean")
    rows = staged(rows, "prefixes", ("alone",))
    nodes = classes.join(comps, "node", "left").select(F.col("node").alias("doc_id"), "sig", F.coalesce("component", "node").alias("comp"))
    some = rows.filter("not alone").join(nodes, ["doc_id", "sig"]).dropDuplicates(["doc_id", "sig"])
    some = staged(some.select(F.col("doc_id").alias("node"), "comp", "n", "prefix"), "joined")
    return rows.filter("alone").select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp"), "n", "prefix").union(some)


def lead_of(n: int) -> int:
    """Rarest shingles of a set of ``n`` of which it shares one with any set that links and is not smaller: such two share
    6/7 of the smaller one at least."""
    return n - (6 * n + 6) // 7 + 1


def token_keys(names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set of ``n`` by its prefix ``names`` (rarest first), and whether each leads.

    A key is a shingle and a size band (bits of the size), so sets of unlike size do not meet. The larger set of a pair looks under its own
    band; the smaller one leads: its ``lead_of`` rarest shingles also stand in the next band if a set a third larger lies there.
    """
    leads = np.arange(len(names)) < lead_of(n)
    own, above = int(n).bit_length(), int(4 * n // 3).bit_length()
    keys = names | np.int64(own) << np.int64(48)
    if above == own:
        return keys, leads
    more = names[leads] | np.int64(above) << np.int64(48)
    return np.concatenate([keys, more]), np.concatenate([leads, np.ones(len(more), bool)])


def met_in_tokens(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``token, node, comp, lead``: the join keys of the rows (``node, comp, n, prefix``), or those with a bit in ``wanted``."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            found = [token_keys(unpacked(k), n) for k, n in zip(batch.column("prefix").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            if not found:
                continue
            token, lead = (np.concatenate(c) for c in zip(*found, strict=True))
            row = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
            if bits is not None:
                there = has_bit(bits, token)
                token, lead, row = token[there], lead[there], row[there]
            node, comp = (np.asarray(batch.column(c)) for c in ("node", "comp"))
            for at in range(0, len(token), 1 << 17):
                some = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[some], node[row[some]], comp[row[some]], lead[some])], ["token", "node", "comp", "lead"])

    return rows.mapInArrow(task, "token long, node long, comp long, lead boolean")


def clusters_of(met: DataFrame, shapes: DataFrame) -> DataFrame:
    """``comp, cluster``: components that may link, as far as shared tokens and the bound of their points can tell, are in
    one cluster. A spanning set of edges is enough, so a block gives fewer edges than it has members."""
    # tokens with the same members give the same edges, so one of them is enough; a node may stand twice, hence a sum too
    members = [F.count("*").alias("count"), F.expr("bit_xor(xxhash64(node, lead))").alias("x"), F.expr("sum(shiftrightunsigned(xxhash64(node, lead, 1), 36))").alias("y")]
    open_ = met.groupBy("token").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.max("lead").alias("led"), *members)
    open_ = staged(open_.filter("one <> other and led").groupBy("count", "x", "y").agg(F.min("token").alias("token")), "open")
    placed = staged(cut(met, open_, "token"), "blocks")
    there = bit_table(placed, "node")
    sent = met.sparkSession.sparkContext.broadcast(there)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(sent.value, np.asarray(batch.column("node"), np.int64))))

    few = shapes.mapInArrow(needed, shapes.schema)
    edges = placed.join(few, "node").groupBy("token", "low", "high").applyInArrow(maybe_of_block, "a long, b long")
    return components(edges).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))


def cluster_links(docs: DataFrame, ranks: np.ndarray, classes: DataFrame, comps: DataFrame, clusters: DataFrame) -> DataFrame:
    """The links between the components of each cluster, by exact sets."""
    placed = classes.join(comps, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("comp")).join(clusters, "comp")
    placed = staged(placed, "clusters")
    cells = staged(cut(placed, placed.groupBy("cluster").count(), "cluster"), "cluster-sides")
    return exact_sets(docs, ranks, cells).groupBy("cluster", "low", "high").applyInArrow(links_of_block, "a long, b long")


def linked_classes(docs: DataFrame) -> tuple[np.ndarray, DataFrame, DataFrame, DataFrame]:
    """The ranks, the rows (see ``class_rows``), the classes (``sig, node``) and the components of their nodes."""
    ranks = shingle_ranks(docs)
    rows = staged(class_rows(docs, ranks), "sets")
    known = rows.filter("sig is not null and doc_id is not null")
    classes = staged(known.groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    # texts of one id are one node
    several = known.select("doc_id", "sig").distinct().join(known.groupBy("doc_id").agg(F.min("sig").alias("one"), F.max("sig").alias("other")).filter("one <> other"), "doc_id")
    edges = several.join(classes, "sig").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = staged(edges.union(cheap_links(docs, ranks, rows, classes)), "links")
    comps = components(edges)

    # shingles that classes of several components must share
    prefixes = prefixes_of(known, classes, comps)
    many = met_in_tokens(prefixes).groupBy("token").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.max("lead").alias("led"))
    met = staged(met_in_tokens(prefixes, bit_table(many.filter("one <> other and led"), "token")), "tokens")
    clusters = clusters_of(met, known.select(F.col("doc_id").alias("node"), "n", "point"))
    comps = components(edges.union(cluster_links(docs, ranks, classes, comps, clusters)))

    return ranks, rows, classes, comps


def with_component(rows: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    nodes = rows.select("doc_id", "n", "sig").join(classes, "sig", "left")
    linked = nodes.join(comps, "node", "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    _, rows, classes, comps = linked_classes(docs)
    return with_component(rows, classes, comps)


def counts_of_block(block: pa.Table) -> pa.Table:
    """The links of a block (``sig, side, low, high, names, single, mixed``): for each class ``n``, the ``single``
    documents of the classes that link with it, and as ``sig, other`` the links with or of a ``mixed`` class. In a block
    of two sides only members of different sides are compared."""
    sig, first = np.unique(np.asarray(block.column("sig")), return_index=True)
    side, single, several = (np.asarray(block.column(c))[first] for c in ("side", "single", "mixed"))
    names = [received(block.column("names")[int(i)].as_py()) for i in first]
    sizes = np.array([len(x) for x in names], np.int64)
    owner = np.repeat(np.arange(len(names)), sizes)
    flat = np.unique(np.concatenate(names), return_inverse=True)[1].ravel()
    order = np.argsort(flat, kind="stable")
    begins = np.searchsorted(flat[order], np.arange(flat.max() + 2))
    owner, ends = owner[order], np.cumsum(sizes)
    two, total, pairs = two_sides(block), np.zeros(len(names), np.int64), []
    for i in range(len(names)):
        shared = np.zeros(len(names), np.int64)
        own = flat[ends[i] - sizes[i] : ends[i]]
        for at in range(0, len(own), 1 << 12):  # each shingle's list is at most the block
            start, n = begins[own[at : at + (1 << 12)]], np.diff(begins)[own[at : at + (1 << 12)]]
            place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(owner[place], minlength=len(names))
        linked = 7 * shared >= 3 * (sizes + sizes[i])
        linked[i] = False
        if two:
            linked &= side != side[i]
        total[i] = single[linked].sum()
        pairs += [(int(sig[i]), int(sig[j])) for j in np.flatnonzero(linked & (several | several[i]))]
    some = np.flatnonzero(total)
    none = len(some) + len(pairs)
    return pa.table(
        {
            "sig": pa.array([int(x) for x in sig[some]] + [a for a, _ in pairs], pa.int64()),
            "other": pa.array([None] * len(some) + [b for _, b in pairs], pa.int64()),
            "n": pa.array([int(x) for x in total[some]] + [0] * (none - len(some)), pa.int64()),
        }
    )


def jaccard_links(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``. ``n_links`` is the number of other
    ``doc_id`` with a text that links with one of this ``doc_id`` (equal texts link); null without a ``doc_id``."""
    ranks, rows, classes, comps = linked_classes(docs)
    comps = staged(comps, "components")
    members = rows.filter("sig is not null and doc_id is not null").select("doc_id", "sig").distinct()
    several = staged(members.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("mixed")), "several")
    known = members.join(several, "doc_id", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    weights = staged(known.groupBy("sig").agg(F.count(F.when(~F.col("mixed"), 1)).alias("single"), F.max("mixed").alias("mixed")), "weights")

    placed = staged(classes.join(comps, "node"), "members")
    cells = staged(cut(placed, placed.groupBy("component").count(), "component").join(weights, "sig"), "sides")
    blocks = exact_sets(docs, ranks, cells).groupBy("component", "low", "high")
    found = staged(blocks.applyInArrow(counts_of_block, "sig long, other long, n long"), "counts")

    own = weights.join(found.filter("other is null").groupBy("sig").agg(F.sum("n").alias("more")), "sig", "left")
    own = own.select("sig", (F.col("single") + F.coalesce("more", F.lit(0))).alias("near"))
    # documents with several texts, each counted once where its classes are reached
    mixed_ids = known.filter("mixed").select("doc_id", "sig")
    reach = found.filter("other is not null").select("sig", "other").union(mixed_ids.select("sig", F.col("sig").alias("other"))).distinct()
    to_mixed = reach.join(mixed_ids.select(F.col("sig").alias("other"), F.col("doc_id").alias("id")), "other")
    by_class = to_mixed.groupBy("sig").agg(F.countDistinct("id").alias("more"))
    one_text = known.filter("not mixed").join(own, "sig").join(by_class, "sig", "left")
    one_text = one_text.select("doc_id", (F.col("near") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    reached = mixed_ids.join(reach, "sig").select("doc_id", F.col("other").alias("sig")).distinct()
    singles = reached.join(weights.drop("mixed"), "sig").groupBy("doc_id").agg(F.sum("single").alias("near"))
    others = mixed_ids.join(to_mixed, "sig").groupBy("doc_id").agg(F.countDistinct("id").alias("more"))
    many_texts = singles.join(others, "doc_id").select("doc_id", (F.col("near") + F.col("more") - 1).alias("n_links"))
    links = one_text.union(many_texts)

    every = with_component(rows, classes, comps).join(links, "doc_id", "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0)).cast("long"))
    return every.select("doc_id", "n_shingles", "component_id", n_links.alias("n_links"))


def orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those of a ``doc_id`` that isn't the smallest of its
    component. Rows without an id stay. Of rows that share an id, one stays: the first by text, then by all columns that
    can be ordered (a map can't)."""
    found = jaccard_components(docs)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    again = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__id"))
    single = left.join(again, left["doc_id"] == again["__id"], "left_anti")
    several = left.join(again, left["doc_id"] == again["__id"], "left_semi")
    order = F.struct(F.coalesce("text", F.lit("")).alias("__text"), *[f.name for f in docs.schema if orderable(f.dataType)])
    firsts = several.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return single.unionByName(firsts)
