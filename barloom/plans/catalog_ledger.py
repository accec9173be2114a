"""Wallet ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import ledger
from barloom.plans.fixtures import Inputs
from barloom.plans.registry import query

_legs = """SELECT id, idempotency_key, amount, type, status, created_at, sender_wallet_id AS wallet_id, 'out' AS leg, -amount AS signed, receiver_wallet_id AS other_wallet_id FROM transactions
  UNION ALL SELECT id, idempotency_key, amount, type, status, created_at, receiver_wallet_id, 'in', amount, sender_wallet_id FROM transactions"""


@query(
    "idempotent_transactions", "T-4 P-8",
    "SELECT id, idempotency_key, amount, status FROM transactions QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, id) = 1",
    ["transactions"], (), ["amount"], ["id", "idempotency_key", "status"],
)
def _(i: Inputs) -> DataFrame:
    return ledger.first_per_key(i.transactions())


@query(
    "wallet_balances", "A-28",
    f"""SELECT w.wallet_id, coalesce(c, 0) AS credits, coalesce(d, 0) AS debits, coalesce(c, 0) - coalesce(d, 0) AS net, coalesce(n, 0) AS n FROM wallets w LEFT JOIN (
        SELECT wallet_id, sum(signed) FILTER (WHERE leg = 'in') AS c, -sum(signed) FILTER (WHERE leg = 'out') AS d, count(*) AS n
        FROM ({_legs}) WHERE status = 'COMPLETED' GROUP BY wallet_id) t ON w.wallet_id = t.wallet_id""",
    ["wallets", "transactions"], (), {"credits": 4, "debits": 4, "net": 4}, ["wallet_id", "n"],
)
def _(i: Inputs) -> DataFrame:
    return ledger.balances(i.wallets(), i.transactions())


@query(
    "ledger_replay", "B-2 W-REC-2",
    f"""SELECT *, CAST(running_balance < 0 AS INTEGER) AS overdrawn FROM (SELECT t.id, t.wallet_id, t.leg, t.created_at, t.signed,
        coalesce(w.balance, 0) + sum(t.signed) OVER (PARTITION BY t.wallet_id ORDER BY t.created_at, t.id, t.leg) AS running_balance
        FROM ({_legs}) t LEFT JOIN wallets w ON t.wallet_id = w.wallet_id WHERE t.status = 'COMPLETED')""",
    ["wallets", "transactions"], ["created_at"], {"signed": 4, "running_balance": 4}, ["id", "wallet_id", "leg", "overdrawn"],
)
def _(i: Inputs) -> DataFrame:
    return ledger.replay(i.wallets(), i.transactions(), 90 * 86400)


@query(
    "wallet_history", "J-8 B-1",
    f"SELECT id, wallet_id, leg, other_wallet_id, created_at FROM ({_legs}) WHERE type = 'PAYMENT' AND NOT (leg = 'in' AND wallet_id = other_wallet_id)",
    ["transactions"], ["created_at"], (), ["id", "wallet_id", "leg", "other_wallet_id"],
)
def _(i: Inputs) -> DataFrame:
    return ledger.wallet_history(i.transactions(), "PAYMENT")


@query(
    "wallet_history_page", "B-1 K-7",
    f"SELECT id, wallet_id, leg, created_at FROM ({_legs}) WHERE wallet_id = 42 ORDER BY created_at DESC, id OFFSET 5 LIMIT 5",
    ["transactions"], ["created_at"], (), ["id", "wallet_id", "leg"],
)
def _(i: Inputs) -> DataFrame:
    return ledger.page(ledger.wallet_history(i.transactions()).where("wallet_id = 42"), "created_at", "id", 5, 1)


@query(
    "transfer_checks", "B-3 P-10 S-10",
    """SELECT t.id, concat_ws(',', CASE WHEN t.sender_wallet_id = t.receiver_wallet_id THEN 'self_transfer' END,
        CASE WHEN s.balance IS NULL THEN 'unknown_sender' END, CASE WHEN r.wallet_id IS NULL THEN 'unknown_receiver' END,
        CASE WHEN NOT t.amount > 0 THEN 'amount' END, CASE WHEN NOT coalesce(s.balance >= t.amount, false) THEN 'insufficient_balance' END) AS reasons
       FROM (SELECT id, sender_wallet_id, CASE WHEN id % 50 = 0 THEN -1 ELSE receiver_wallet_id END AS receiver_wallet_id, CAST(amount / 40 AS DECIMAL(19,4)) AS amount FROM transactions) t
       LEFT JOIN wallets s ON t.sender_wallet_id = s.wallet_id LEFT JOIN wallets r ON t.receiver_wallet_id = r.wallet_id""",
    ["wallets", "transactions"], (), (), ["id", "reasons"],
)
def _(i: Inputs) -> DataFrame:
    t = i.transactions().select(
        "id", "sender_wallet_id",
        F.when(F.col("id") % 50 == 0, -1).otherwise(F.col("receiver_wallet_id")).alias("receiver_wallet_id"),
        (F.col("amount") / 40).cast("decimal(19,4)").alias("amount"),
    )
    return ledger.check_transfers(t, i.wallets()).select("id", F.concat_ws(",", "reasons").alias("reasons"))
