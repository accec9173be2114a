"""Windows opened by the first event and closed after a fixed time (rate limits, result reuse).

An event opens a window if it comes at least ``ttl`` after the previous opening; otherwise it
falls into the open window. That chain is sequential per key, but it splits by time: what a
segment does depends only on the last opening before it. So each segment is summarised as a table
"first opening here -> last opening here" for the few events that can be first (those of its first
``ttl`` and the one after). Tables of neighbouring segments compose, level by level; then the last
opening before every segment is handed down. No task ever sees more than one segment's events or
``fan`` segment tables. Runs between pauses of ``ttl`` are independent, and a run shorter than
``ttl`` is a single window; only longer runs go through the chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan
from barloom.sources.staging import staged


NEVER = -(2**61)  # "no window open yet": any event comes later than this plus the lifetime


def _next_index(times: np.ndarray, ttl: int) -> np.ndarray:
    return np.searchsorted(times, times + ttl, side="left")


def _candidates(times: np.ndarray, start: int, ttl: int) -> np.ndarray:
    """Indexes that can be the first opening of a segment beginning at ``start``."""
    n = int(np.searchsorted(times, start + ttl, side="left"))
    return np.arange(min(n + 1, len(times)))


def _last_openings(times: np.ndarray, ttl: int) -> np.ndarray:
    """For each event taken as an opening, the last opening of the segment."""
    nxt = _next_index(times, ttl)
    own = np.arange(len(times))
    jump = np.where(nxt < len(times), nxt, own)
    while True:  # doubling: each round squares the number of openings skipped
        further = jump[jump]
        if np.array_equal(further, jump):
            return times[jump]
        jump = further


def _pieces(values: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values as (from, to)."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _summarise(g: dict, width: int, ttl: int) -> dict:
    t = g["__t"]
    c = _candidates(t, int(g["__seg"][0]) * width, ttl)
    return {"__cand": t[c], "__exit": _last_openings(t, ttl)[c]}


def _compose(g: dict, span: int, ttl: int) -> dict:
    """One table for a run of neighbouring segments; all candidates walk the run together."""
    starts = np.unique(g["__cand"])
    first = starts[_candidates(starts, int(g["__sup"][0]) * span, ttl)]
    at, opened = first.copy(), first.copy()
    for lo, hi in _pieces(g["__seg"]):
        cand, ends = g["__cand"][lo:hi], g["__exit"][lo:hi]
        i = np.searchsorted(cand, at, side="left")
        hit = i < len(cand)
        opened[hit] = ends[i[hit]]
        at[hit] = opened[hit] + ttl
    return {"__cand": first, "__exit": opened}


def _hand_down(g: dict, ttl: int) -> dict:
    """Last opening before each segment, given the one before the whole run."""
    opened = int(g["__before"][0])
    segs, before = [], []
    for lo, hi in _pieces(g["__seg"]):
        segs.append(int(g["__seg"][lo]))
        before.append(opened)
        i = int(np.searchsorted(g["__cand"][lo:hi], opened + ttl, side="left"))
        if i < hi - lo:
            opened = int(g["__exit"][lo + i])
    return {"__seg": np.array(segs, dtype="int64"), "__open": np.array(before, dtype="int64")}


def _walk(g: dict, ttl: int) -> dict:
    """Openings of one segment: at most ``fan`` + 1 steps."""
    t, opened = g["__t"], int(g["__open"][0])
    start = np.empty(len(t), dtype="int64")
    i = 0
    while i < len(t):
        if t[i] >= opened + ttl:
            opened = int(t[i])
        j = int(np.searchsorted(t, opened + ttl, side="left"))
        start[i:j] = opened
        i = j
    return {"__t": t, "__start": start}


def per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str], step: Callable[[dict], dict], keep: Sequence[str], schema: str
) -> DataFrame:
    """Apply ``step`` to the sorted rows of each group and prepend the group's ``keep`` columns.

    Like a grouped map, but many small groups share one Arrow batch: groups are hashed to
    partitions, sorted there, and cut out of the batches as they stream by.
    """
    by, keep = list(by), list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and all(held[-1][k].iloc[-1] == pdf[k].iloc[-1] for k in by):
                held.append(pdf)  # still the same group: keep collecting its pieces
                continue
            held.append(pdf)
            rows = pd.concat(held, ignore_index=True)
            edges = starts(rows)
            yield done(rows.iloc[: edges[-1]], edges[:-1])
            held = [rows.iloc[edges[-1] :]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield done(rows, starts(rows))

    def starts(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), dtype=bool)
        new[0] = True
        for k in by:
            v = rows[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def done(rows: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        arrays = {c: rows[c].to_numpy() for c in rows.columns}
        ends = np.append(edges[1:], len(rows))
        results = [step({c: v[lo:hi] for c, v in arrays.items()}) for lo, hi in zip(edges, ends, strict=True)]
        if not results:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in keep})
        names = list(results[0])
        sizes = [len(r[names[0]]) for r in results]
        out = rows[keep].iloc[np.repeat(edges, sizes)].reset_index(drop=True)
        for n in names:
            out[n] = np.concatenate([r[n] for r in results])
        return out

    spread = df.repartition(*by).sortWithinPartitions(*by, *order)
    return spread.mapInPandas(run, schema)


def greedy_windows(
    df: DataFrame, keys: Sequence[str], time: str, tie: str, ttl_seconds: int, fan: int = 64, levels: int = 3, stage: bool = True
) -> DataFrame:
    """Add ``window_start`` and ``place`` (1 for the opening event, then counting up).

    ``tie`` orders events of the same instant and must make rows unique per key. ``stage`` writes
    the events with their run to the shared folder, because the steps below read them repeatedly.
    """
    ttl = ttl_seconds * 1_000_000
    width = ttl * fan
    given = list(keys)
    cut = F.floor(F.col("__t") / width).cast("long")
    ev = df.select("*", F.unix_micros(time).alias("__t"))
    # a pause of ttl always closes the window, so runs between pauses are independent
    ev = carry_scan(ev, given, ["__t", tie], cut, {"__p": ("prev", F.col("__t"))})
    opens = F.col("__p").isNull() | (F.col("__t") - F.col("__p") >= ttl)
    ev = carry_scan(ev, given, ["__t", tie], cut, {"__run": ("last", F.when(opens, F.col("__t")))})
    ev = staged(ev.drop("__p"), "greedy") if stage else ev.drop("__p")

    # a run shorter than ttl is one window; only longer runs need the chain
    long_runs = ev.groupBy(*given, "__run").agg(F.max("__t").alias("__end")).where(F.col("__end") - F.col("__run") >= ttl)
    keys = [*given, "__run"]
    fields = {f.name: f.dataType.simpleString() for f in ev.schema}
    kcols = ", ".join(f"{k} {fields[k]}" for k in keys)
    chained = ev.join(long_runs.select(*keys), keys, "left_semi").withColumn("__seg", cut)

    # distinct instants first: copies of one instant collapse before the grouped step
    instants = chained.select(*keys, "__seg", "__t").distinct()
    table = f"{kcols}, __seg long, __cand long, __exit long"
    above = F.floor(F.col("__seg") / fan).cast("long")
    step = partial(_summarise, width=width, ttl=ttl)
    tables = [per_group(instants, [*keys, "__seg"], ["__t"], step, [*keys, "__seg"], table)]
    for level in range(1, levels):
        step = partial(_compose, span=width * fan**level, ttl=ttl)
        lower = tables[-1].withColumn("__sup", above)
        up = per_group(
            lower, [*keys, "__sup"], ["__seg", "__cand"], step, [*keys, "__sup"], table.replace("__seg", "__sup")
        )
        tables.append(up.withColumnRenamed("__sup", "__seg"))

    opened = f"{kcols}, __seg long, __open long"
    down = partial(_hand_down, ttl=ttl)
    top = tables[-1].withColumn("__before", F.lit(NEVER))
    entries = per_group(top, keys, ["__seg", "__cand"], down, keys, opened)
    for t in reversed(tables[:-1]):
        given_open = entries.select(*keys, F.col("__seg").alias("__sup"), F.col("__open").alias("__before"))
        lower = t.withColumn("__sup", above).join(given_open, [*keys, "__sup"])
        entries = per_group(lower, [*keys, "__sup"], ["__seg", "__cand"], down, keys, opened)

    placed = per_group(
        instants.join(entries, [*keys, "__seg"]), [*keys, "__seg"], ["__t"], partial(_walk, ttl=ttl), keys,
        f"{kcols}, __t long, __start long",
    )
    rows = ev.join(placed, [*keys, "__t"], "left").withColumn("__start", F.coalesce("__start", "__run"))
    w = Window.partitionBy(*given, "__start").orderBy("__t", tie)
    return rows.select(
        *df.columns, F.timestamp_micros("__start").alias("window_start"), F.row_number().over(w).cast("long").alias("place")
    )


def rate_limit(requests: DataFrame, limit: int = 20, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """Requests per window opened by the user's first request; ``allowed`` up to ``limit``."""
    g = greedy_windows(requests, [key], "ts", "id", seconds)
    return g.withColumn("allowed", (F.col("place") <= limit).cast("int"))


def result_reuse(requests: DataFrame, keys: Sequence[str], seconds: int = 1800) -> DataFrame:
    """``hit`` = the same request was computed less than ``seconds`` ago."""
    g = greedy_windows(requests, keys, "ts", "id", seconds)
    return g.withColumn("hit", (F.col("place") > 1).cast("int"))
