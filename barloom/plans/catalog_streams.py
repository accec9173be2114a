"""Streaming queries over the event files, run to completion and compared with plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.usage import month_key
from barloom.plans.catalog_usage import greedy_sql
from barloom.plans.fixtures import Inputs, pick
from barloom.plans.registry import query
from barloom.sources.staging import new_path
from barloom.sources import topics
from barloom.streaming import stateful, windows


def table_stream(i: Inputs, name: str) -> DataFrame:
    path = f"{i.dir}/{name}.parquet"
    stored = i.spark.read.parquet(path)
    files = stored.inputFiles()
    if not files:
        raise ValueError(f"no {name} files in {path}")
    # the table may be one file or a folder of part files
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return topics.read_folder(i.spark, i.dir, stored.schema, name_filter=f"{name}.parquet")
    return topics.read_folder(i.spark, path, stored.schema)


def event_stream(i: Inputs) -> DataFrame:
    return table_stream(i, "events")


def drained(i: Inputs, stream: DataFrame, name: str) -> DataFrame:
    return topics.drain(stream, new_path(i.spark, name), new_path(i.spark, f"{name}-checkpoint"))


def tick_stream(i: Inputs) -> DataFrame:
    e = event_stream(i).where("value > 0")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id")


@query(
    "stream_hourly_bars", "T-1 S-8 A-1",
    """SELECT * FROM (SELECT symbol, date_trunc('hour', ts) AS time, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
        sum(size) AS volume, count(*) AS n_ticks FROM event_ticks GROUP BY ALL)
       WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM event_ticks) - INTERVAL 10 MINUTE""",
    ["event_ticks"], ["time"], ["open", "high", "low", "close", "volume"], ["symbol", "n_ticks"],
)
def _(i: Inputs) -> DataFrame:
    """Only closed bars are emitted: the watermark trails the newest tick by ten minutes."""
    return drained(i, windows.stream_bars(tick_stream(i)), "stream_bars")


@query(
    "stream_distinct_ticks", "T-2",
    "SELECT event_id, symbol, price FROM event_ticks",
    ["event_ticks"], (), ["price"], ["event_id", "symbol"],
)
def _(i: Inputs) -> DataFrame:
    twice = tick_stream(i)
    doubled = twice.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return drained(i, windows.distinct_within(doubled, ["symbol", "event_id"], "ts", "1 hour"), "distinct_ticks")


@query(
    "stream_audit_rows", "T-3 S-8 S-9 F-10",
    """SELECT event_id AS id, user_id, upper(event_type) AS action, CAST(props->>'k' AS INTEGER) AS k, ts AS created_at FROM events""",
    (), ["created_at"], (), ["id", "user_id", "action", "k"],
)
def _(i: Inputs) -> DataFrame:
    e = event_stream(i)
    body = F.from_json("props", "k int")
    rows = e.select(F.col("event_id").alias("id"), "user_id", F.upper("event_type").alias("action"), body["k"].alias("k"), F.col("ts").alias("created_at"))
    return drained(i, rows, "audit_rows")


@query(
    "stream_first_transfer", "T-4",
    """SELECT 'k' || (o_orderkey - o_orderkey % 2) AS idempotency_key, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL""",
    (), (), (), ["idempotency_key", "n"],
)
def _(i: Inputs) -> DataFrame:
    """Every key arrives twice, far apart in event time, inside one remembered span."""
    o = table_stream(i, "orders")
    k = F.col("o_orderkey") - F.col("o_orderkey") % 2
    keyed = o.select(F.concat(F.lit("k"), k.cast("string")).alias("idempotency_key"), F.col("o_orderdate").alias("created_at"))
    first = windows.distinct_within(keyed, ["idempotency_key"], "created_at", "4000 days")
    rows = drained(i, first, "first_transfer")
    return rows.groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"))


#: Files in which the derived streams land, and how far they are out of order as a share of the whole span.
SLICES = 6


def arriving(i: Inputs, rows: DataFrame, name: str, ends: str | None = None) -> tuple[DataFrame, str]:
    """Rows (``id``, ``ts``) as a stream of several batches that are out of order, and the delay that covers it.

    A row lands late by up to one slice of the whole time span. The last file holds a heartbeat (no id), so that all rows are passed
    by the watermark: far behind the last row, or such that the watermark stands at ``ends``.
    """

    def build() -> str:
        path = new_path(i.spark, f"{name}-arriving")
        span = rows.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
        width = max(1, (span["b"] - span["a"]) // SLICES + 1) if span["a"] is not None else 1
        late = F.pmod(F.xxhash64("id"), F.lit(width))
        landed = rows.withColumn("__slice", F.floor((F.unix_micros("ts") - F.lit(span["a"] or 0) + late) / width))
        delay = 2 * width // 1_000_000 + 60
        for n in range(SLICES + 1):  # a fixed number of files, one after the other as in a landing folder
            landed.where(F.col("__slice") == n).drop("__slice").coalesce(4).write.mode("append").parquet(path)
        end = F.timestamp_micros(F.lit((span["b"] or 0) + delay * 1_000_000 + 400 * 86400 * 1_000_000))
        if ends is not None:
            end = F.timestamp_micros(F.unix_micros(F.lit(ends).cast("timestamp")) + delay * 1_000_000)
        beat = i.spark.range(1).select(*[end.alias("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        beat.write.mode("append").parquet(path)
        return f"{path} {delay} seconds"

    path, delay = build().split(" ", 1)
    return topics.read_folder(i.spark, path, rows.schema, files_per_batch=4), delay


def request_rows(i: Inputs) -> DataFrame:
    e = i.table("events").where("event_type <> 'signup'")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), "user_id", "ts", month_key("ts").alias("month"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"),
        pick(k % 3, {0: "tree", 1: "lstm"}, "arima").alias("model"),
        pick(k % 4, {0: 1, 1: 5, 2: 10}, 20).alias("horizon"),
    )


@query(
    "stream_rate_limit", "T-6",
    greedy_sql("user_id", "INTERVAL 14400 SECOND") + " SELECT id, user_id, epoch_us(opened) AS window_start, CAST(place AS BIGINT) AS place FROM g",
    ["requests"], (), (), ["id", "user_id", "window_start", "place"],
)
def _(i: Inputs) -> DataFrame:
    stream, delay = arriving(i, request_rows(i), "requests")
    return drained(i, stateful.request_windows(stream, ["user_id"], 14400, delay), "rate_limit")


@query(
    "stream_result_reuse", "T-7",
    greedy_sql("symbol, model, horizon", "INTERVAL 1800 SECOND") + " SELECT id, symbol, model, horizon, CAST(place > 1 AS INTEGER) AS hit FROM g",
    ["requests"], (), (), ["id", "symbol", "model", "horizon", "hit"],
)
def _(i: Inputs) -> DataFrame:
    stream, delay = arriving(i, request_rows(i), "requests")
    g = stateful.request_windows(stream, ["symbol", "model", "horizon"], 1800, delay)
    return drained(i, g, "result_reuse").withColumn("hit", (F.col("place") > 1).cast("int"))


@query(
    "stream_monthly_use", "T-5",
    "SELECT id, user_id, strftime(ts, '%Y:%m') AS month, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y:%m') ORDER BY ts, id) AS used FROM requests",
    ["requests"], (), (), ["id", "user_id", "month", "used"],
)
def _(i: Inputs) -> DataFrame:
    stream, delay = arriving(i, request_rows(i), "requests")
    return drained(i, stateful.monthly_use(stream, ["user_id", "month"], delay), "monthly_use")


_lock_step = """CASE WHEN p.until IS NOT NULL AND b.ts <= p.until THEN {same} ELSE {new} END"""
_base = "CASE WHEN p.until IS NULL THEN p.fails ELSE 0 END"
_lock = f"""WITH RECURSIVE src AS (SELECT id, user_id, created_at AS ts, action = 'LOGIN_FAILED' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn
    FROM audit WHERE action IN ('LOGIN_FAILED', 'LOGIN')),
  g AS (SELECT id, user_id, ts, rn, CASE WHEN failed THEN 1 ELSE 0 END AS fails, CAST(NULL AS TIMESTAMP) AS until, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome FROM src WHERE rn = 1
    UNION ALL SELECT b.id, b.user_id, b.ts, b.rn, {_lock_step.format(same="p.fails", new=f"CASE WHEN b.failed THEN {_base} + 1 ELSE 0 END")},
      {_lock_step.format(same="p.until", new=f"CASE WHEN b.failed AND {_base} + 1 >= 5 THEN b.ts + INTERVAL 2 DAY END")},
      {_lock_step.format(same="'rejected'", new=f"CASE WHEN NOT b.failed THEN 'ok' WHEN {_base} + 1 >= 5 THEN 'locked' ELSE 'failed' END")}
    FROM g p JOIN src b ON b.user_id = p.user_id AND b.rn = p.rn + 1)"""


@query(
    "stream_login_lockout", "T-8",
    _lock + " SELECT id, user_id, outcome, fails AS failed_attempts FROM g", ["audit"], (), (),
    ["id", "user_id", "outcome", "failed_attempts"],
)
def _(i: Inputs) -> DataFrame:
    # logins are sparse here: a two-day lock stands in for fifteen minutes
    e = i.table("events").where("event_type in ('error', 'click')")
    rows = e.select(F.col("event_id").alias("id"), "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    stream, delay = arriving(i, rows, "logins")
    return drained(i, stateful.lockouts(stream, 5, 2 * 86400, delay), "lockout")


@query(
    "stream_decision_context", "T-11 J-1",
    """SELECT d.id, d.symbol, d.ts AS decided_at, coalesce(s.generated_at, TIMESTAMP '1970-01-01') AS generated_at, s.prediction, s.signal_confidence FROM
       (SELECT event_id AS id, 'Brand#' || (user_id % 25 + 1) AS symbol, ts FROM events WHERE event_type IN ('click', 'purchase')) d
       ASOF LEFT JOIN (SELECT symbol, generated_at, arg_max(prediction, id) AS prediction, arg_max(confidence, id) AS signal_confidence
         FROM signals WHERE model_name = 'm0' GROUP BY ALL) s
       ON s.symbol = d.symbol AND d.ts >= s.generated_at""",
    ["signals"], ["decided_at", "generated_at"], ["prediction", "signal_confidence"], ["id", "symbol"],
)
def _(i: Inputs) -> DataFrame:
    """Two topics, each in several batches out of order, met in event time."""
    d = i.table("events").where("event_type in ('click', 'purchase')")
    decisions = d.select(F.col("event_id").alias("id"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"), "ts")
    signals = i.signals().where("model_name = 'm0'").select("id", "symbol", F.col("generated_at").alias("ts"), "prediction", "confidence")
    left, delay = arriving(i, decisions, "decisions")
    right, other = arriving(i, signals, "signals")
    delay = max(delay, other, key=lambda x: int(x.split()[0]))
    rows = drained(i, stateful.signal_for_decision(left, right, ["symbol"], None, delay), "decision_context")
    return rows.withColumnRenamed("ts", "decided_at").withColumn("generated_at", F.coalesce("generated_at", F.timestamp_seconds(F.lit(0))))


@query(
    "stream_fresh_vectors", "T-9 S-13 S-9",
    """SELECT symbol, arg_max(price, (ts, event_id)) AS price, max(ts) AS written_at FROM event_ticks GROUP BY symbol
       HAVING epoch(max(ts)) + 3600 > epoch(TIMESTAMP '2024-01-31 00:00:00')""",
    ["event_ticks"], ["written_at"], ["price"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    """Latest value per key in state with a lifetime: the stream tells of newer values and of expired keys."""
    ticks = i.event_ticks().select(F.col("event_id").alias("id"), "symbol", "ts", "price")
    stream, delay = arriving(i, ticks, "ticks", ends="2024-01-31 00:00:00")
    told = drained(i, stateful.fresh_values(stream, ["symbol"], "price", 3600, delay), "fresh_vectors")
    newest = told.groupBy("symbol").agg(F.max_by(F.struct("price", "expired"), F.struct("written_at", "expired")).alias("r"), F.max("written_at").alias("written_at"))
    return newest.where("not r.expired").select("symbol", "r.price", "written_at")
