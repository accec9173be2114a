"""Bars, cleaning, validation and layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import cleaning, resample, validate
from barloom.operators.layout import chunk_of, with_ordinal
from barloom.plans.fixtures import SERIES, TICK_ORDER, WEEK, Inputs
from barloom.plans.registry import query
from barloom.sources.staging import new_path
from barloom.sources import tables

OHLCV = {"open": 6, "high": 6, "low": 6, "close": 6, "volume": 4}


@query("bars_weekly", "A-2 S-12", "SELECT * FROM bars", ["bars"], ["time"], OHLCV, ["symbol", "n_ticks"])
def _(i: Inputs) -> DataFrame:
    return i.build_bars()


def _tick_bars_sql(width: str) -> str:
    return f"""SELECT symbol, {width} AS time, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, ts) AS close, sum(size) AS volume, count(*) AS n_ticks FROM event_ticks GROUP BY ALL"""


@query(
    "bars_hourly_rollup", "A-1",
    _tick_bars_sql("date_trunc('hour', ts)"), ["event_ticks"], ["time"], OHLCV, ["symbol", "n_ticks"],
)
def _(i: Inputs) -> DataFrame:
    return resample.bars_from_ticks(i.event_ticks(), "1h", ["ts"])


@query(
    "bars_15_minutes", "A-2 P-19",
    _tick_bars_sql("time_bucket(INTERVAL 15 MINUTE, ts)"), ["event_ticks"], ["time"], OHLCV, ["symbol", "n_ticks"],
)
def _(i: Inputs) -> DataFrame:
    return resample.bars_from_ticks(i.event_ticks(), "15m", ["ts"])


@query(
    "bars_monthly_from_weekly", "A-2",
    """SELECT symbol, date_trunc('month', time) AS time, arg_min(open, time) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM bars GROUP BY ALL""",
    ["bars"], ["time"], OHLCV, ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return resample.coarser_bars(i.bars(), "1mo")


@query(
    "bars_row_numbers", "P-20 W-REC-2",
    "SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM bars",
    ["bars"], ["time"], (), ["symbol", "rn"],
)
def _(i: Inputs) -> DataFrame:
    # chunks of a year, so that several chunks per symbol are carried even on small data
    return with_ordinal(i.bars(), chunk_seconds=365 * 86400)


# Raw bars: text prices, some broken, every third row sent again later with another close.
_RAW_SQL = """SELECT symbol, time, n_ticks, 0 AS arrival,
    CASE WHEN n_ticks % 11 = 0 THEN 'n/a' ELSE CAST(open AS VARCHAR) END AS open,
    CASE WHEN n_ticks % 7 = 0 THEN 'NaN' ELSE CAST(high AS VARCHAR) END AS high, CAST(low AS VARCHAR) AS low,
    CASE WHEN n_ticks % 13 = 0 THEN 'Infinity' ELSE CAST(close AS VARCHAR) END AS close,
    CASE WHEN n_ticks % 5 = 0 THEN NULL ELSE CAST(volume AS VARCHAR) END AS volume FROM bars
  UNION ALL SELECT symbol, time, n_ticks, 1, CAST(open AS VARCHAR), NULL, CAST(low AS VARCHAR), CAST(close + 1 AS VARCHAR),
    CAST(volume AS VARCHAR) FROM bars WHERE n_ticks % 3 = 0
  UNION ALL SELECT symbol, time, n_ticks, 2, NULL, NULL, NULL, 'bad', '5' FROM bars WHERE n_ticks % 17 = 0"""


def raw_bars(i: Inputs) -> DataFrame:
    b, n = i.bars(), F.col("n_ticks")
    text = {c: F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")}
    none = F.lit(None).cast("string")

    def rows(where, arrival, o, h, lo, c, v):
        return b.where(where).select(
            "symbol", "time", "n_ticks", F.lit(arrival).alias("arrival"),
            o.alias("open"), h.alias("high"), lo.alias("low"), c.alias("close"), v.alias("volume"),
        )

    first = rows(
        F.lit(True), 0,
        F.when(n % 11 == 0, "n/a").otherwise(text["open"]),
        F.when(n % 7 == 0, "NaN").otherwise(text["high"]),
        text["low"],
        F.when(n % 13 == 0, "Infinity").otherwise(text["close"]),
        F.when(n % 5 != 0, text["volume"]),
    )
    again = rows(n % 3 == 0, 1, text["open"], none, text["low"], (F.col("close") + 1).cast("string"), text["volume"])
    empty = rows(n % 17 == 0, 2, none, none, none, F.lit("bad"), F.lit("5"))
    return tables.union_frames(first, again, empty)


_NUM = "CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END AS {c}"


@query(
    "bars_cleaned", "P-1 P-2 P-3 P-4 P-5 P-7 P-8 U-1",
    f"""SELECT symbol, time, open, high, low, close, coalesce(volume, 0) AS volume FROM (
      SELECT symbol, time, volume, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("open", "high", "low", "close"))}
      FROM (SELECT * FROM (SELECT symbol, time, arrival, {", ".join(_NUM.format(c=c) for c in ("open", "high", "low", "close", "volume"))},
              row_number() OVER (PARTITION BY symbol, time ORDER BY arrival DESC) AS k FROM ({_RAW_SQL}))
            WHERE k = 1 AND coalesce(open, high, low, close) IS NOT NULL)
      WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING))
      WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""",
    ["bars"], ["time"], OHLCV, ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return cleaning.clean_bars(raw_bars(i), ["arrival"], chunk_seconds=52 * WEEK)


@query(
    "macro_back_filled", "P-5 P-6",
    "SELECT time, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER p, first_value({c} IGNORE NULLS) OVER n) AS {c}" for c in SERIES)
    + """ FROM macro_raw WINDOW p AS (ORDER BY time ROWS UNBOUNDED PRECEDING), n AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ["macro_raw"], ["time"], list(SERIES),
)
def _(i: Inputs) -> DataFrame:
    from barloom.operators.macro import pivot_series

    wide = pivot_series(i.macro_long(), SERIES).withColumn("all", F.lit(1))
    cut = chunk_of("time", 365 * 86400)
    wide = cleaning.forward_fill(wide, list(SERIES), ["all"], ["time"], cut)
    return cleaning.backward_fill(wide, list(SERIES), ["all"], ["time"], cut)


@query(
    "request_validation", "P-9 P-10",
    """SELECT id, CASE WHEN symbol IN ('BRAND.1') THEN 'FIRST' ELSE symbol END AS symbol,
        least(60, greatest(1, h)) AS horizon,
        concat_ws(',', CASE WHEN NOT regexp_full_match(symbol, '[A-Z0-9\\-\\.]{1,10}') THEN 'symbol' END,
          CASE WHEN period NOT IN ('1y', '2y') THEN 'period' END,
          CASE WHEN model NOT IN ('tree', 'lstm') THEN 'model' END,
          CASE WHEN NOT h BETWEEN 1 AND 60 THEN 'horizon' END) AS reasons
       FROM (SELECT id, upper(trim(CASE WHEN id % 5 = 0 THEN symbol ELSE replace(symbol, '#', '.') END)) AS symbol,
        CASE WHEN id % 7 = 0 THEN '7y' ELSE '1y' END AS period, model, horizon * (id % 9) AS h FROM requests)""",
    ["requests"], (), (), ["id", "symbol", "horizon", "reasons"],
)
def _(i: Inputs) -> DataFrame:
    r = i.requests()
    odd = F.col("id")
    raw = r.select(
        "id",
        F.when(odd % 5 == 0, F.col("symbol")).otherwise(F.replace("symbol", F.lit("#"), F.lit("."))).alias("symbol"),
        F.when(odd % 7 == 0, "7y").otherwise("1y").alias("period"),
        "model",
        (F.col("horizon") * (odd % 9)).alias("horizon"),
    )
    checked = validate.check(raw, validate.request_rules(["tree", "lstm"]))
    return checked.select(
        "id",
        validate.normalize_symbol("symbol", {"BRAND.1": "FIRST"}).alias("symbol"),
        validate.clamp_horizon("horizon").alias("horizon"),
        F.concat_ws(",", "reasons").alias("reasons"),
    )


@query(
    "period_intervals", "P-19",
    """SELECT id, CASE (id % 4) WHEN 0 THEN '5m' WHEN 1 THEN '1h' WHEN 2 THEN '1wk' ELSE '1d' END AS interval,
       CASE (id % 4) WHEN 0 THEN '6mo' WHEN 1 THEN '6mo' WHEN 2 THEN '5y' ELSE '1y' END AS feature_period FROM requests""",
    ["requests"], (), (), ["id", "interval", "feature_period"],
)
def _(i: Inputs) -> DataFrame:
    p = F.element_at(F.array(*[F.lit(x) for x in ("1d", "1mo", "5y", "3mo")]), (F.col("id") % 4 + 1).cast("int"))
    upgrade = F.when(p.isin("1d", "5d", "1mo"), "6mo").when(p.isin("3mo"), "1y").otherwise(p)
    return i.requests().select("id", resample.interval_of(p).alias("interval"), upgrade.alias("feature_period"))


@query(
    "time_normalised", "P-17 F-4",
    """SELECT event_id, ts AS plain, ts - INTERVAL 3 HOUR AS from_zone, date_trunc('second', ts) AS from_text,
       CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""",
    (), ["plain", "from_zone", "from_text"], (), ["event_id", "seconds"],
)
def _(i: Inputs) -> DataFrame:
    e = i.table("events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(
        "event_id",
        F.col("ts").alias("plain"),
        cleaning.utc_time("ts", "Asia/Riyadh").alias("from_zone"),
        cleaning.utc_time(text).alias("from_text"),
        F.unix_seconds("ts").alias("seconds"),
    )


@query(
    "null_report", "P-12",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS series, count(*) AS rows, count(*) - count({c}) AS nulls,
        (count(*) - count({c})) / count(*) AS null_ratio, CAST(count({c}) = 0 AS INTEGER) AS all_null FROM macro_raw"""
        for c in SERIES
    ),
    ["macro_raw"], (), ["null_ratio"], ["series", "rows", "nulls", "all_null"],
)
def _(i: Inputs) -> DataFrame:
    from barloom.operators.macro import pivot_series

    report = cleaning.null_counts(pivot_series(i.macro_long()), list(SERIES))
    return report.withColumnRenamed("column", "series")


_nulls = " + ".join(f"avg(CAST({c} IS NULL AS DOUBLE))" for c in SERIES)


@query(
    "null_gate", "P-12 P-13",
    f"""SELECT r AS null_ratio, CASE WHEN r > 0.9 THEN 'reject' WHEN r > 0.5 THEN 'warn' ELSE 'ok' END AS verdict, CAST({len(SERIES)} AS BIGINT) AS n_columns
        FROM (SELECT ({_nulls}) / {len(SERIES)} AS r FROM macro_raw)""",
    ["macro_raw"], (), ["null_ratio"], ["verdict", "n_columns"],
)
def _(i: Inputs) -> DataFrame:
    """A column without any value goes first, then the share of nulls in the others decides."""
    from barloom.operators.macro import pivot_series

    wide = pivot_series(i.macro_long()).withColumn("empty", F.lit(None).cast("double"))
    left = cleaning.drop_all_null_columns(wide, [*SERIES, "empty"])
    names = [c for c in left.columns if c != "time"]
    return cleaning.null_ratio_gate(left, names).withColumn("n_columns", F.lit(len(names)).cast("long"))


@query(
    "enough_history_symbols", "P-20 P-16",
    """SELECT symbol, time, close FROM event_bars QUALIFY count(*) OVER (PARTITION BY symbol) >= 677 AND close > 0"""
    .replace("event_bars", f"({_tick_bars_sql(chr(100) + 'ate_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')})"),
    ["event_ticks"], ["time"], ["close"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    bars = resample.bars_from_ticks(i.event_ticks(), "1h", ["ts"])
    return cleaning.positive_price(cleaning.enough_history(bars, 677))


@query(
    "symbol_encoding", "P-22",
    """SELECT symbol, symbol_encoded, CAST((CAST(list_reduce([CAST(('0x' || substr(m, 8 * k + 1, 8)) AS HUGEINT) FOR k IN range(4)],
         lambda a, x: (a * 4294967296 + x) % 1000) AS BIGINT)) % 1000 AS INTEGER) AS hashed FROM (
       SELECT symbol, md5(symbol) AS m, CASE WHEN sector IS NULL THEN -1
         ELSE CAST(row_number() OVER (PARTITION BY sector IS NULL ORDER BY symbol) - 1 AS INTEGER) END AS symbol_encoded
       FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN sector USING (symbol))""",
    ["bars", "sector"], (), (), ["symbol", "symbol_encoded", "hashed"],
)
def _(i: Inputs) -> DataFrame:
    codes = cleaning.symbol_codes(i.sector())
    d = cleaning.encode_symbols(i.bars().select("symbol").distinct(), codes)
    return d.select("symbol", "symbol_encoded", cleaning.hashed_symbol_code("symbol").alias("hashed"))


@query(
    "schema_alignment", "P-21",
    "SELECT symbol, time, coalesce(volume, 0) AS volume, 0.0 AS adx, coalesce(close, 0) AS close FROM bars",
    ["bars"], ["time"], ["volume", "adx", "close"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    return cleaning.align_to_list(i.bars(), ["symbol", "time"], ["volume", "adx", "close"])


@query(
    "ledger_table_rules", "S-10 P-10",
    """SELECT 'negative_balance' AS rule, count(*) AS n FROM wallets WHERE balance < 0
       UNION ALL SELECT 'duplicate_idempotency_key', count(*) FROM (SELECT idempotency_key FROM transactions GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'unknown_receiver', count(*) FROM transactions WHERE receiver_wallet_id NOT IN (SELECT wallet_id FROM wallets)
       UNION ALL SELECT 'self_transfer', count(*) FROM transactions WHERE receiver_wallet_id = sender_wallet_id""",
    ["wallets", "transactions"], (), (), ["rule", "n"],
)
def _(i: Inputs) -> DataFrame:
    w, t = i.wallets(), i.transactions()
    found = {
        "negative_balance": w.where(~F.expr(tables.CATALOGUE["wallets"].rules["balance"])),
        "duplicate_idempotency_key": validate.duplicates(t, ["idempotency_key"]),
        "unknown_receiver": validate.orphans(t, "receiver_wallet_id", w, "wallet_id"),
        "self_transfer": t.where("receiver_wallet_id = sender_wallet_id"),
    }
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("rule"), "n") for r, d in found.items()]
    return tables.union_frames(*rows)


@query(
    "bars_time_chunks", "S-11 S-1 S-2",
    """SELECT symbol, time, close FROM bars WHERE time >= TIMESTAMP '1996-03-01' AND time < TIMESTAMP '1998-09-10'""",
    ["bars"], ["time"], ["close"], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "bars_by_chunk")
    tables.write_chunked(i.bars(), path, "time", 30)
    return tables.read_chunked(i.spark, path, "time", 30, "1996-03-01", "1998-09-10")


@query(
    "bars_offline_store", "S-1 S-2 P-15",
    "SELECT symbol, time, close, '1wk' AS period FROM bars WHERE symbol = 'Brand#3'",
    ["bars"], ["time"], ["close"], ["symbol", "period"],
)
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "offline")
    tables.write_offline(i.bars().withColumn("period", F.lit("1wk")), path)
    return tables.read_offline(i.spark, path, "Brand#3", "1wk")


@query(
    "tick_duplicates_collapsed", "P-8 T-2",
    """SELECT symbol, ts, arg_max(price, seq) AS price, count(*) AS copies FROM ticks GROUP BY ALL""",
    ["ticks"], ["ts"], ["price"], ["symbol", "copies"],
)
def _(i: Inputs) -> DataFrame:
    t = i.ticks()
    kept = cleaning.keep_last_arrival(t, ["symbol", "ts"], TICK_ORDER[1:])
    n = t.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(n, ["symbol", "ts"])
