"""Table catalogue, partitioned Parquet and time-chunked layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(19, 4)


@dataclass(frozen=True)
class Table:
    """Schema with the constraints a relational store would enforce; checked as quality rules."""

    schema: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    chunk_days: tuple[str, int] | None = None


# Tables of the platform: bars and signals are time-chunked, the rest are relational.
CATALOGUE: dict[str, Table] = {
    "users": Table(
        "id string, email string, password_hash string, full_name string, role string, is_active boolean, "
        "email_verified boolean, failed_attempts int, locked boolean, lock_expires_at timestamp, avatar_url string, "
        "created_at timestamp, updated_at timestamp",
        ("id",), (("email",),),
    ),
    "wallets": Table(
        "id string, user_id string, balance decimal(19,4), currency string, version long, created_at timestamp",
        ("id",), (("user_id",),), {"user_id": ("users", "id")}, {"balance": "balance >= 0"},
    ),
    "transactions": Table(
        "id string, idempotency_key string, sender_wallet_id string, receiver_wallet_id string, amount decimal(19,4), "
        "type string, status string, description string, created_at timestamp",
        ("id",), (("idempotency_key",),),
        {"sender_wallet_id": ("wallets", "id"), "receiver_wallet_id": ("wallets", "id")}, {"amount": "amount > 0"},
    ),
    "subscription_plans": Table(
        "id string, name string, monthly_quota int, price decimal(10,2), features string, is_active boolean",
        ("id",), (("name",),),
    ),
    "user_subscriptions": Table(
        "id string, user_id string, plan_id string, status string, starts_at timestamp, expires_at timestamp",
        ("id",), (), {"user_id": ("users", "id"), "plan_id": ("subscription_plans", "id")},
    ),
    "ai_usage": Table(
        "id string, user_id string, model string, symbol string, credits int, created_at timestamp",
        ("id",), (), {"user_id": ("users", "id")},
    ),
    "notifications": Table(
        "id string, user_id string, type string, title string, message string, is_read boolean, created_at timestamp",
        ("id",), (), {"user_id": ("users", "id")},
    ),
    "audit_logs": Table(
        "id long, user_id string, action string, entity_type string, entity_id string, details string, "
        "ip_address string, created_at timestamp",
        ("id",),
    ),
    "refresh_tokens": Table(
        "id string, user_id string, token_hash string, device_info string, expires_at timestamp",
        ("id",), (("token_hash",),), {"user_id": ("users", "id")},
    ),
    "watchlist": Table(
        "id string, user_id string, symbol string, name string, position int, created_at timestamp",
        ("id",), (("user_id", "symbol"),), {"user_id": ("users", "id")},
    ),
    "price_bars": Table(
        "timestamp timestamp, symbol string, open double, high double, low double, close double, volume long",
        ("symbol", "timestamp"), chunk_days=("timestamp", 1),
    ),
    "macro_signals": Table(
        "timestamp timestamp, source string, event_type string, impact_score double, payload string",
        ("timestamp", "source"), chunk_days=("timestamp", 7),
    ),
    "model_signals": Table(
        "generated_at timestamp, symbol string, model_name string, prediction double, confidence double, "
        "horizon_hours int, metadata string",
        ("generated_at", "symbol", "model_name"), chunk_days=("generated_at", 7),
    ),
    "llm_decisions": Table(
        "timestamp timestamp, symbol string, decision string, confidence double, reasoning string, context string, "
        "actual_outcome string, outcome_pct_change double",
        ("timestamp", "symbol"), (), {}, {"decision": "decision in ('BUY','SELL','HOLD')"}, ("timestamp", 30),
    ),
}


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(CATALOGUE[name].schema)


def chunk_start(time: str | Column, days: int) -> Column:
    """First day of the ``days``-wide chunk that holds ``time``; chunks count from 1970-01-01."""
    t = F.col(time) if isinstance(time, str) else time
    day = F.unix_date(F.to_date(t))
    return F.date_from_unix_date((F.floor(day / days) * days).cast("int"))


def write_chunked(df: DataFrame, path: str, time: str, days: int) -> None:
    """Append to a folder per chunk. Rows of one chunk meet in few tasks, a large chunk spreads."""
    out = df.withColumn("chunk", chunk_start(time, days))
    out.repartition("chunk", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("append").partitionBy("chunk").parquet(path)


def read_chunked(spark: SparkSession, path: str, time: str, days: int, start=None, end=None) -> DataFrame:
    """Half-open time range; the chunk column prunes folders, the time filter reaches the files."""
    df = spark.read.parquet(path)
    for bound, after in ((start, True), (end, False)):
        if bound is None:
            continue
        t = F.lit(bound).cast("timestamp")
        edge = chunk_start(t, days)
        if after:
            df = df.where((F.col("chunk") >= edge) & (F.col(time) >= t))
        else:
            df = df.where((F.col("chunk") <= edge) & (F.col(time) < t))
    return df.drop("chunk")


def write_offline(df: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "period")) -> None:
    """Replace exactly the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_offline(spark: SparkSession, path: str, symbol: str | None = None, period: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    return df if period is None else df.where(F.col("period") == period)


def insert_if_absent(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose key is new; duplicates inside ``fresh`` count once."""
    return fresh.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def union_frames(*frames: DataFrame) -> DataFrame:
    """Stack frames whose columns differ; missing columns are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
