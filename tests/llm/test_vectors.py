"""Hard negatives, approximate neighbours and vector codes against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives as hn
from barloom.llm import neighbours as nb
from barloom.llm import vector_cells, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id long, dim string, cell string, row string, part int, code string, score double"


def table(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, y, 5, "d", "c", "r", 3, "k", 0.5) for i, v, y in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 1, (6, 8))
    out = []
    for i in range(400):
        v = centre[i % 6] + rng.normal(0, 0.4, 8)
        out.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 3)) if i % 3 else 0))
    same = out[20][1]
    out += [(1000 + k, same, 1) for k in range(30)]  # ties
    out += [(20, out[21][1], 2), (40, out[40][1], out[40][2]), (41, out[41][1], out[41][2])]  # ids that repeat, with another vector or the same
    out += [(2000, None, 1), (2050, [None] * 8, 1), (2001, [float("nan")] * 8, 1), (2002, [float("inf")] + [0.0] * 7, 1), (None, same, 1)]
    out += [(2003, [0.0] * 8, 1), (2004, same, None), (2100, [0.5, 0.5], 1), (2101, [0.4, 0.5], 2), (2102, [0.5, 0.4], 1), (2103, [], 1)]
    return out


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def floors(v, scale):
    return np.floor(scale * np.asarray(v, np.float64)).astype(np.int64)


def negatives_by_loop(rows, every, low=50, high=95):
    good = [(i, floors(v, 256), y) for i, v, y in rows if i is not None and y is not None and finite(v)]
    out = []
    for a in sorted({i for i, _, _ in good if i % every == 0}):
        _, q, label = min(((y, tuple(v), v, y) for i, v, y in good if i == a), key=lambda r: r[:2])[1:]
        others = [(int(v @ q), i, y) for i, v, y in good if i != a and len(v) == len(q)]
        positives = sorted(((-s, i) for s, i, y in others if y == label))[:5]
        for s, p in positives:
            s = -s
            fits = sorted((-n, i) for n, i, y in others if y != label and low * s <= 100 * n <= high * s)[:3]
            out += [(a, p, k, i, s, -n) for k, (n, i) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_a_loop(spark, rows, small, monkeypatch):
    if small:
        for name, value in {"CHUNK": 48, "BLOCK": 3, "CELLS": 7, "SAMPLE": 60, "FIRST": 4}.items():
            monkeypatch.setattr(hn, name, value)
    got = hn.hard_negatives(table(spark, rows), F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == negatives_by_loop(rows, 10)


def test_search_stops_early_and_reads_no_row_twice():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.1, (5000, 4)))
    lists = hn.SortedLists(np.arange(5000), x)
    q = np.floor(256 * np.array([0.9, -0.3, 0.0, 0.2]))
    t = lists.thresholds(q[None])[0]
    [(ids, scores)], seen = lists.search(q, t, np.array([[hn._LEAST, hn._MOST]]), 5, np.ones(5000, bool))
    order = np.lexsort((np.arange(5000), -(x @ q)))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].astype(int).tolist()
    assert seen < 2500
    # a window out of reach is left before any list is read
    _, seen = lists.search(q, t, np.array([[10**9, 10**10]]), 3, np.ones(5000, bool))
    assert seen == 0


def test_large_whole_numbers_are_exact():
    x = np.array([[2.0**31, 1.0], [2.0**31, 2.0], [2.0**31, 0.0]])
    lists = hn.SortedLists(np.array([7, 8, 9]), x)
    q = np.array([2.0**30, 1.0])
    [(ids, scores)], _ = lists.search(q, lists.thresholds(q[None])[0], np.array([[hn._LEAST, hn._MOST]]), 2, np.ones(3, bool))
    assert ids.tolist() == [8, 7] and scores.tolist() == [2**61 + 2, 2**61 + 1]


def test_chi_square_quantile():
    # fixed values: tables of the law
    assert abs(nb.chi_square_quantile(0.95, 2) - 5.9915) < 1e-3
    assert abs(nb.chi_square_quantile(0.95, 12) - 21.0261) < 1e-3


def neighbours_by_loop(rows, every, k):
    good = [(i, np.asarray(v, np.float64)) for i, v, _ in rows if i is not None and finite(v) and any(v)]
    out = {}
    for a in {i for i, _ in good if i % every == 0}:
        q = min((len(v), tuple(v)) for i, v in good if i == a)[1]
        scores = sorted((-float(sum(x * y for x, y in zip(v, q, strict=True))), i) for i, v in good if i != a and len(v) == len(q))
        out[a] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_neighbours_recall_and_order(spark, rows, small, monkeypatch):
    if small:
        for name, value in {"CHUNK": 40, "BLOCK": 3, "LEAVES": 8, "SAMPLE": 80, "BUCKET": 4, "FIRST": 4}.items():
            monkeypatch.setattr(nb, name, value)
    got = nb.nearest_neighbours(table(spark, rows), F.col("id") % 10 == 0, 10, axes=4).toPandas()
    want = neighbours_by_loop(rows, 10, 10)
    assert set(got["query_id"]) == {a for a, w in want.items() if w}
    hits = total = 0
    for a, g in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, len(want[a]) + 1))
        pairs = list(zip(-g["score"], g["vec_id"], strict=True))
        assert pairs == sorted(pairs)
        # scores of what was found are exact, and ties go to smaller ids
        left = [s for _, s in want[a]]
        hits += sum(s >= left[-1] for s in g["score"])
        total += len(left)
        if [round(s, 12) for s in g["score"]] == [round(s, 12) for s in left]:
            assert [i for i, _ in want[a]] == g["vec_id"].tolist() and left == g["score"].tolist()
    assert hits >= 0.95 * total


def codes_by_loop(rows, parts, entries, rounds, scale):
    kept = [(i, v, y) for i, v, y in rows if finite(v)]
    sizes = [len(v) for _, v, _ in kept]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d))
    fits = [(i, floors(v, scale), y) for i, v, y in kept if len(v) == dim]
    order = sorted((r for r in fits if r[0] is not None), key=lambda r: (r[0], tuple(r[1]))) + sorted((r for r in fits if r[0] is None), key=lambda r: tuple(r[1]))
    books = [np.array([np.split(v, parts)[j] for _, v, _ in order[:entries]]) for j in range(parts)]

    def near(book, x):
        d = ((book - x) ** 2).sum(1)
        return int(d.argmin()), int(d.min())

    for _ in range(rounds):
        for j in range(parts):
            x = [np.split(v, parts)[j] for _, v, _ in fits]
            at = [near(books[j], p)[0] for p in x]
            new = books[j].copy()
            for e in set(at):
                mine = [p for p, k in zip(x, at, strict=True) if k == e]
                new[e] = [sum(int(p[c]) for p in mine) // len(mine) for c in range(len(mine[0]))]
            books[j] = new
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()
    out, totals = [], {}
    for i, v, y in kept:
        code = error = None
        if len(v) == dim:
            found = [near(books[j], p) for j, p in enumerate(np.split(floors(v, scale), parts))]
            code, error = "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)
            totals[y] = totals.get(y, 0) + error
        out.append((i, code, error, y))
    return sorted(((i, c, e, totals.get(y), digest) for i, c, e, y in out), key=repr)


@pytest.mark.parametrize(("width", "entries"), [(16, 16), (200, 256)])
def test_codes_equal_a_loop(spark, rows, width, entries, monkeypatch):
    monkeypatch.setattr(vector_codes, "SLICE", 33)
    monkeypatch.setattr(vector_codes.Codebook.__init__, "__defaults__", (width, 2000))
    got = vector_codes.vector_codes(table(spark, rows), 4, entries, 3, 1024.0).collect()
    assert sorted(map(tuple, got), key=repr) == codes_by_loop(rows, 4, entries, 3, 1024.0)


def test_cells_leave_out_only_entries_that_can_not_be_nearest():
    rng = np.random.default_rng(3)
    book = vector_codes.Codebook(rng.integers(-300, 300, (64, 4)), width=32)
    x = rng.integers(-300, 300, (4000, 4))
    near, apart = book.nearest(x)
    d = ((x[:, None] - book.entries) ** 2).sum(2)
    assert (near == d.argmin(1)).all() and (apart == d.min(1)).all()
    assert book.evaluated < 0.5 * 64 * len(x)
    before = book.evaluated
    known = dict(book.known)
    book.nearest(x[:100])
    assert book.known == known and book.evaluated > before


def test_empty_tables_and_few_rows(spark):
    none = table(spark, [])
    assert hn.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    assert nb.nearest_neighbours(none, F.col("id") % 10 == 0).count() == 0
    assert vector_codes.vector_codes(none).count() == 0
    only_null = table(spark, [(0, None, 1), (10, [None], 2), (None, [1.0], 3)])
    assert hn.hard_negatives(only_null, F.col("id") % 10 == 0).count() == 0
    assert nb.nearest_neighbours(only_null, F.col("id") % 10 == 0).count() == 0
    assert [tuple(r)[:4] for r in vector_codes.vector_codes(only_null).collect()] == [(None, None, None, None)]
    two = table(spark, [(0, [1.0, 0.0, 0.0, 0.0], 1), (1, [0.9, 0.1, 0.0, 0.0], 1)])
    assert [tuple(r) for r in nb.nearest_neighbours(two, F.col("id") % 10 == 0).collect()] == [(0, 1, 1, float(np.float32(0.9)))]
    assert hn.hard_negatives(two, F.col("id") % 10 == 0).count() == 0


def test_boxes_hold_all_rows_of_a_cell(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(3, int(i % 4), v.tolist()) for i, v in enumerate(x)], "dim int, cell int, vec array<double>").repartition(5)
    for r in vector_cells.boxes(df).collect():
        mine = x[r.cell :: 4]
        assert np.allclose(r.low, mine.min(0)) and np.allclose(r.high, mine.max(0))
