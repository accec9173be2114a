"""Wallet ledger: legs, balances, replay, history, transfer checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan, chunk_of
from barloom.operators.validate import check

MONEY = "decimal(19,4)"


def legs(transactions: DataFrame) -> DataFrame:
    """Two rows per transfer: the sender's debit and the receiver's credit.

    It turns "sender = w or receiver = w" into an equality on ``wallet_id``.
    """
    amount = F.col("amount")
    both = F.array(
        F.struct(
            F.col("sender_wallet_id").alias("wallet_id"), F.lit("out").alias("leg"),
            (-amount).cast(MONEY).alias("signed"), F.col("receiver_wallet_id").alias("other_wallet_id"),
        ),
        F.struct(
            F.col("receiver_wallet_id").alias("wallet_id"), F.lit("in").alias("leg"),
            amount.cast(MONEY).alias("signed"), F.col("sender_wallet_id").alias("other_wallet_id"),
        ),
    )
    rest = [c for c in transactions.columns if c not in ("sender_wallet_id", "receiver_wallet_id")]
    return transactions.select(*rest, F.inline(both))


def first_per_key(df: DataFrame, key: str = "idempotency_key", order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The first event of every key wins; re-sent ones collapse before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*").select(*df.columns)


def wallet_history(transactions: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per (wallet, transaction); a transfer to oneself appears once."""
    h = legs(transactions).where(~((F.col("leg") == "in") & (F.col("wallet_id") == F.col("other_wallet_id"))))
    return h if kind is None else h.where(F.col("type") == kind)


def page(df: DataFrame, newest: str, tie: str, size: int, number: int = 0) -> DataFrame:
    """Newest-first page. Spark plans sort + limit as a distributed top-n."""
    return df.orderBy(F.col(newest).desc(), F.col(tie)).offset(size * number).limit(size)


def page_after(df: DataFrame, newest: str, tie: str, size: int, last_time: Column, last_tie: Column) -> DataFrame:
    """Next page by key instead of offset: no skipped rows are sorted again."""
    older = (F.col(newest) < last_time) | ((F.col(newest) == last_time) & (F.col(tie) > last_tie))
    return df.where(older).orderBy(F.col(newest).desc(), F.col(tie)).limit(size)


def balances(wallets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Credits minus debits of completed transfers; partial sums before the shuffle."""
    done = legs(transactions.where("status = 'COMPLETED'"))
    zero = F.lit(0).cast(MONEY)
    moved = done.groupBy("wallet_id").agg(
        F.sum(F.when(F.col("leg") == "in", F.col("signed"))).alias("credits"),
        F.sum(F.when(F.col("leg") == "out", -F.col("signed"))).alias("debits"),
        F.count(F.lit(1)).alias("n"),
    )
    j = wallets.select("wallet_id", "balance").join(moved, "wallet_id", "left")
    c, d = F.coalesce("credits", zero), F.coalesce("debits", zero)
    return j.select("wallet_id", c.alias("credits"), d.alias("debits"), (c - d).alias("net"), F.coalesce("n", F.lit(0)).alias("n"))


def replay(wallets: DataFrame, transactions: DataFrame, chunk_seconds: int = 30 * 86400) -> DataFrame:
    """Running balance per wallet in (created_at, id) order and a flag where it is below zero.

    Running sums are carried over time chunks, so a wallet with very many transfers is spread.
    """
    done = legs(transactions.where("status = 'COMPLETED'"))
    order = ["created_at", "id", "leg"]
    scans = {"__run": ("sum", F.col("signed"))}
    run = carry_scan(done, ["wallet_id"], order, chunk_of("created_at", chunk_seconds), scans)
    start = wallets.select("wallet_id", F.col("balance").alias("__start"))
    total = (F.coalesce("__start", F.lit(0).cast(MONEY)) + F.col("__run")).cast("decimal(29,4)")
    out = run.join(start, "wallet_id", "left").withColumn("running_balance", total)
    return out.withColumn("overdrawn", (F.col("running_balance") < 0).cast("int")).drop("__start", "__run")


def check_transfers(transactions: DataFrame, wallets: DataFrame) -> DataFrame:
    """Transfers with the rules they break, against the wallets' current balances."""
    w = wallets.select("wallet_id", "balance")
    s = w.select(F.col("wallet_id").alias("sender_wallet_id"), F.col("balance").alias("__sb"))
    r = w.select(F.col("wallet_id").alias("receiver_wallet_id"), F.lit(True).alias("__known"))
    j = transactions.join(s, "sender_wallet_id", "left").join(r, "receiver_wallet_id", "left")
    rules = {
        "self_transfer": F.col("sender_wallet_id") != F.col("receiver_wallet_id"),
        "unknown_sender": F.col("__sb").isNotNull(),
        "unknown_receiver": F.col("__known").isNotNull(),
        "amount": F.col("amount") > 0,
        "insufficient_balance": F.col("__sb") >= F.col("amount"),
    }
    return check(j, rules).select(*transactions.columns, "reasons")
