"""Keyed state in event order: request windows, result reuse, monthly quota, login lockout, signals for decisions, fresh values.

Events reach a stream in any order within the watermark's delay. The events that the watermark has not passed are kept
in a buffer; an event-time timer wakes them when it has, and they then go through the rule of their key
in the order of their time, whatever batch brought them. A rule says when its state no longer matters: then a timer
removes it, so state is held only for keys in use. Events later than the delay are dropped and counted in the
query's progress. What is buffered of a busy key is bounded by its events within the delay.

A call to the state store costs far more than an event, so keys share a fixed number of buckets by hash: a bucket has one buffer
and one timer, and its events and states move in columns, a few calls per bucket and batch whatever its keys.

Rows without an id are heartbeats: they move the watermark and do nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: What a buffered event consists of: its instant, its side (smaller first among equal instants), id and the rule's fields.
EVENT = ("micros", "side", "id", "mark", "a", "b")
BUFFER = "micros long, side int, id long, mark boolean, a double, b double"

#: Groups of keys that share a buffer and a timer.
BUCKETS = 512


def use_rocks(spark: SparkSession) -> None:
    """Keyed state with several variables and timers needs the RocksDB provider."""
    spark.conf.set(PROVIDER, ROCKS)


class Rule:
    """A fold over the events of one key. ``state`` and ``out`` are schemas; a state is a tuple or None."""

    state: str
    out: str

    def step(self, state: tuple | None, event: tuple) -> tuple[tuple | None, tuple | None]:
        """State after the event, and the row to put out (or None)."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """Instant after which the state says nothing about later events; None if it holds for good."""
        return None

    def gone(self, state: tuple) -> tuple | None:
        """Row to put out when the state is removed at its end."""
        return None


class FirstOpened(Rule):
    """Windows opened by the first event: request limits (place > limit) and result reuse."""

    state, out = "start long, place long", "id long, window_start long, place long"

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def step(self, state, event):
        start, place = state or (None, 0)
        if start is None or event[0] >= start + self.ttl:
            start, place = event[0], 0
        return (start, place + 1), (event[2], start, place + 1)

    def ends(self, state):
        return state[0] + self.ttl


class Lockout(Rule):
    """``limit`` failures in a row lock the account; success and the end of the lock reset. ``mark`` is a failure."""

    state, out = "fails int, until long", "id long, outcome string, failed_attempts int"

    def __init__(self, limit: int, lock_seconds: int):
        self.limit, self.lock = limit, lock_seconds * 1_000_000

    def step(self, state, event):
        fails, until = state or (0, None)
        if until is not None and event[0] <= until:
            return (fails, until), (event[2], "rejected", fails)
        fails = (0 if until is not None else fails) + 1 if event[3] else 0
        until = event[0] + self.lock if fails >= self.limit else None
        outcome = "locked" if until is not None else "failed" if fails else "ok"
        return ((fails, until) if fails else None), (event[2], outcome, fails)

    def ends(self, state):
        return state[1]


class MonthlyCount(Rule):
    """Running use of a key that includes the month; every call counts, also rejected ones."""

    state, out = "n long, until long", "id long, used long"

    def step(self, state, event):
        if state is None:
            at = datetime.fromtimestamp(event[0] // 1_000_000, UTC)
            after = datetime(at.year + at.month // 12, at.month % 12 + 1, 1, tzinfo=UTC)
            state = 0, int(after.timestamp()) * 1_000_000
        return (state[0] + 1, state[1]), (event[2], state[0] + 1)

    def ends(self, state):
        return state[1]


class AsOf(Rule):
    """The last event of side 0 (values ``a``, ``b``) at or before each event of side 1, if it is not too old."""

    state, out = "micros long, a double, b double", "id long, micros long, seen_micros long, a double, b double"

    def __init__(self, keep_seconds: int | None):
        self.keep = None if keep_seconds is None else keep_seconds * 1_000_000

    def step(self, state, event):
        if event[1] == 0:
            return (event[0], event[4], event[5]), None
        if state is not None and self.keep is not None and event[0] > state[0] + self.keep:
            state = None
        return state, (event[2], event[0], *(state or (None, None, None)))

    def ends(self, state):
        return None if self.keep is None else state[0] + self.keep


class Freshest(Rule):
    """Newest value ``a`` of a key, put out again with ``expired`` when it has not been renewed in time."""

    state, out = "micros long, a double", "micros long, a double, expired boolean"

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def step(self, state, event):
        return (event[0], event[4]), (event[0], event[4], False)

    def ends(self, state):
        return state[0] + self.ttl - 1000  # gone once the watermark is at the end of the lifetime

    def gone(self, state):
        return (*state, True)


def fields_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(field.split()) for field in schema.split(", ")]


class EventOrdered(StatefulProcessor):
    """Runs a rule over the events of each key in the order of their time. ``keys`` are names and types; a group is a bucket of
    keys that are null in the same columns, which its second field tells (1: null)."""

    def __init__(self, rule: Rule, keys: Sequence[tuple[str, str]]):
        self.rule, self.keys = rule, [k for k, _ in keys]
        self.key_schema = "".join(f"k{n} array<{t}>, " for n, (_, t) in enumerate(keys))
        self.columns = [name for name, _ in fields_of(rule.out)] + self.keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # columns, a part of the events or of the keys with their states in each entry
        self.fold = handle.getListState("fold", self.in_columns(self.rule.state))
        self.early = handle.getListState("early", self.in_columns(BUFFER))
        self.timer = handle.getValueState("timer", "due long")

    def in_columns(self, schema: str) -> str:
        return self.key_schema + ", ".join(f"{n} array<{t}>" for n, t in fields_of(schema))

    def wake(self, micros: int) -> None:
        """One timer for each bucket, at the first millisecond after the instant that it waits for."""
        due = micros // 1000 + 1
        if (now := self.timer.get()) is not None:
            if now[0] <= due:
                return
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts, first, nulls = [], None, key[1]
        for batch in rows:
            keys = [[None] * len(batch) if gone == "1" else batch[c].tolist() for c, gone in zip(self.keys, nulls, strict=True)]
            values = [[None if pd.isna(x) else x for x in batch[c].tolist()] for c in EVENT]
            values[:3] = [[int(x) for x in column] for column in values[:3]]
            if values[0]:
                parts += in_parts([*keys, *values])
                first = min(values[0]) if first is None else min(first, *values[0])
        if parts:
            self.early.appendList(parts)
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        mark, n = timerValues.getCurrentWatermarkInMs(), len(self.keys)
        passed, later, held = {}, [], 0
        for part in self.early.get():
            for row in zip(*part, strict=True):
                held += 1
                if row[n] // 1000 < mark:
                    passed.setdefault(row[:n], []).append(row[n:])
                else:
                    later.append(row)
        before = {row[:n]: row[n:] for part in self.fold.get() for row in zip(*part, strict=True)}
        states, out = dict(before), []
        for k, events in passed.items():
            state = states.get(k)
            for event in sorted(events, key=lambda e: e[:3]):
                state, row = self.rule.step(state, event)
                if row is not None:
                    out.append((*row, *k))
            states[k] = state
        kept, due = {}, [row[n] for row in later]
        for k, state in states.items():
            ends = None if state is None else self.rule.ends(state)
            if ends is not None and ends // 1000 < mark:
                if (row := self.rule.gone(state)) is not None:
                    out.append((*row, *k))
            elif state is not None:
                kept[k] = state
                due += [] if ends is None else [ends]
        if len(later) < held:
            store(self.early, later)
        if kept != before:
            store(self.fold, [(*k, *state) for k, state in kept.items()])
        if due:
            self.wake(min(due))
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


#: Rows in one entry of a list state.
PART = 20_000


def in_parts(columns: list[list]) -> list[tuple]:
    return [tuple(c[at : at + PART] for c in columns) for at in range(0, len(columns[0]), PART)]


def store(state: ListState, rows: list[tuple]) -> None:
    """Replace what a list state holds."""
    if rows:
        state.put(in_parts([list(c) for c in zip(*rows, strict=True)]))
    else:
        state.clear()


def stand_in(kind: str) -> Column:
    """A value in the place of null: pandas turns a column of integers with nulls into floats."""
    return F.lit("1970-01-01" if kind == "date" or kind.startswith("timestamp") else 0).cast(kind)


def in_event_order(
    stream: DataFrame, keys: Sequence[str], rule: Rule, time: str = "ts", delay: str = "10 minutes",
    mark: Column | None = None, side: Column | None = None, a: Column | None = None, b: Column | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """What ``rule`` puts out for the events (``id``, ``time``) of a stream, with the keys.

    A stream keeps its number of ``buckets`` as long as its checkpoint; a bucket should hold no more events than a task can."""
    use_rocks(stream.sparkSession)
    given = {"side": (side, "int"), "mark": (mark, "boolean"), "a": (a, "double"), "b": (b, "double")}
    fields = [(F.lit(0 if n == "side" else None) if c is None else c).cast(t).alias(n) for n, (c, t) in given.items()]
    watched = stream.withWatermark(time, delay)
    # heartbeats go after the watermark has seen them: a condition that names the time is not moved before it
    real = watched.where(F.col("id").isNotNull() | F.col(time).isNull()).where(F.col(time).isNotNull())
    types = dict(stream.dtypes)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("__bucket")
    nulls = F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in keys]).alias("__nulls")
    given_keys = [F.coalesce(k, stand_in(types[k])).alias(k) for k in keys]
    events = real.select(bucket, nulls, *given_keys, "id", F.col(time), F.unix_micros(time).alias("micros"), *fields)
    schema = f"{rule.out}, " + ", ".join(f"{k} {types[k]}" for k in keys)
    processor = EventOrdered(rule, [(k, types[k]) for k in keys])
    return events.groupBy("__bucket", "__nulls").transformWithStateInPandas(processor, schema, "append", "EventTime")


def request_windows(stream: DataFrame, keys: Sequence[str], ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(id, window_start, place, keys)."""
    return in_event_order(stream, keys, FirstOpened(ttl_seconds), delay=delay)


def lockouts(stream: DataFrame, limit: int = 5, lock_seconds: int = 900, delay: str = "10 minutes") -> DataFrame:
    """Outcome per login event (``failed``): ok, failed, locked (this failure locks) or rejected."""
    return in_event_order(stream, ["user_id"], Lockout(limit, lock_seconds), delay=delay, mark=F.col("failed"))


def monthly_use(stream: DataFrame, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    return in_event_order(stream, keys, MonthlyCount(), delay=delay)


def signal_for_decision(decisions: DataFrame, signals: DataFrame, keys: Sequence[str], keep_seconds: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """Each decision (``id``, ``ts``) with the last signal (``ts``, ``prediction``, ``confidence``) of its keys at or before
    it. Both streams share one watermark, so a decision waits until earlier signals can no longer come."""
    left = decisions.select(*keys, "id", "ts", F.lit(1).alias("side"), F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("double").alias("confidence"))
    right = signals.select(*keys, "id", "ts", F.lit(0).alias("side"), "prediction", "confidence")
    both = left.unionByName(right)
    found = in_event_order(both, keys, AsOf(keep_seconds), delay=delay, side=F.col("side"), a=F.col("prediction"), b=F.col("confidence"))
    at = [F.timestamp_micros("micros").alias("ts"), F.timestamp_micros("seen_micros").alias("generated_at")]
    return found.select(*keys, "id", *at, F.col("a").alias("prediction"), F.col("b").alias("signal_confidence"))


def fresh_values(stream: DataFrame, keys: Sequence[str], value: str, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Changes of a table of newest values: a row for each newer value, and one with ``expired`` when its lifetime is over."""
    found = in_event_order(stream, keys, Freshest(ttl_seconds), delay=delay, a=F.col(value))
    return found.select(*keys, F.timestamp_micros("micros").alias("written_at"), F.col("a").alias(value), "expired")
