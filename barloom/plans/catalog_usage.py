"""Subscriptions, quotas, audit, notifications, watchlists and request windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import greedy
from barloom.operators import usage as us
from barloom.operators.ledger import page_after
from barloom.plans.fixtures import Inputs
from barloom.plans.registry import query

NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def now():
    return F.expr("timestamp'2024-01-20 12:00:00'")


_current = f"""SELECT * FROM subscriptions WHERE status = 'ACTIVE' AND expires_at > {NOW} AND starts_at <= {NOW}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY expires_at DESC, id DESC) = 1"""
_quota = f"""SELECT u.user_id, coalesce(p.monthly_quota, (SELECT monthly_quota FROM plans WHERE name = 'FREE'), 10) AS monthly_limit
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ({_current}) s USING (user_id) LEFT JOIN plans p USING (plan_id)"""


@query("current_subscriptions", "B-5 T-10", _current, ["subscriptions"], ["expires_at"], (), ["user_id", "id", "plan_id"])
def _(i: Inputs) -> DataFrame:
    return us.current_subscriptions(i.subscriptions(), now())


def quotas(i: Inputs) -> DataFrame:
    return us.effective_quota(i.table("events"), i.subscriptions(), i.plans(), now())


@query("effective_quota", "J-6", _quota, ["subscriptions", "plans"], (), (), ["user_id", "monthly_limit"])
def _(i: Inputs) -> DataFrame:
    return quotas(i)


@query(
    "subscribers_per_active_plan", "B-4 F-10",
    f"""SELECT p.name, count(s.user_id) AS users, CASE p.name WHEN 'FREE' THEN 1 WHEN 'PRO' THEN 2 ELSE 3 END AS n_features FROM plans p LEFT JOIN ({_current}) s USING (plan_id) WHERE active GROUP BY ALL""",
    ["plans", "subscriptions"], (), (), ["name", "users", "n_features"],
)
def _(i: Inputs) -> DataFrame:
    users = us.current_subscriptions(i.subscriptions(), now()).groupBy("plan_id").agg(F.count(F.lit(1)).alias("users"))
    j = us.active_plans(i.plans()).join(users, "plan_id", "left")
    return j.select("name", F.coalesce("users", F.lit(0)).alias("users"), F.size("feature_list").alias("n_features"))


@query(
    "superseded_subscriptions", "J-15",
    """SELECT id, user_id, plan_id, CASE WHEN n IS NULL THEN 'ACTIVE' ELSE 'CANCELLED' END AS status, starts_at, coalesce(n, starts_at + INTERVAL 30 DAY) AS ended_at
       FROM (SELECT *, lead(starts_at) OVER (PARTITION BY user_id ORDER BY starts_at, id) AS n FROM subscriptions)""",
    ["subscriptions"], ["starts_at", "ended_at"], (), ["id", "user_id", "plan_id", "status"],
)
def _(i: Inputs) -> DataFrame:
    return us.superseded(i.subscriptions())


@query(
    "seeded_subscriptions", "J-13 J-14",
    """SELECT DISTINCT c_custkey AS user_id, 3 AS plan_id, 'ACTIVE' AS status, TIMESTAMP '2025-01-20 00:00:00' AS expires_at FROM customer
       WHERE c_custkey NOT IN (SELECT user_id FROM subscriptions)""",
    ["subscriptions"], ["expires_at"], (), ["user_id", "plan_id", "status"],
)
def _(i: Inputs) -> DataFrame:
    users = i.table("customer").select(F.col("c_custkey").alias("user_id"))
    return us.seed_subscriptions(users, i.subscriptions(), i.plans(), "MAX", now())


@query(
    "monthly_quota_decisions", "T-5 J-6",
    f"""SELECT r.id, r.user_id, row_number() OVER (PARTITION BY r.user_id, strftime(r.ts, '%Y:%m') ORDER BY r.ts, r.id) AS used, q.monthly_limit,
        CAST(row_number() OVER (PARTITION BY r.user_id, strftime(r.ts, '%Y:%m') ORDER BY r.ts, r.id) <= q.monthly_limit AS INTEGER) AS accepted
        FROM requests r LEFT JOIN ({_quota}) q USING (user_id)""",
    ["requests", "subscriptions", "plans"], (), (), ["id", "user_id", "used", "monthly_limit", "accepted"],
)
def _(i: Inputs) -> DataFrame:
    return us.monthly_quota(i.requests(), quotas(i))


@query(
    "quota_report", "B-6 A-14",
    f"""SELECT q.user_id, q.monthly_limit, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(greatest(0, q.monthly_limit - coalesce(used, 0)) AS BIGINT) AS remaining FROM ({_quota}) q
        LEFT JOIN (SELECT user_id, sum(credits) AS used FROM requests WHERE strftime(ts, '%Y:%m') = '2024:01' GROUP BY 1) USING (user_id)""",
    ["requests", "subscriptions", "plans"], (), (), ["user_id", "monthly_limit", "used", "remaining"],
)
def _(i: Inputs) -> DataFrame:
    return us.quota_report(i.requests(), quotas(i), "2024:01")


@query(
    "credits_since", "A-14",
    """SELECT user_id, CAST(coalesce(sum(credits) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'), 0) AS BIGINT) AS credits
       FROM (SELECT user_id, NULL AS credits, NULL AS ts FROM events UNION ALL SELECT user_id, credits, ts FROM requests) GROUP BY user_id""",
    ["requests"], (), (), ["user_id", "credits"],
)
def _(i: Inputs) -> DataFrame:
    return us.credits_since(i.requests(), i.table("events"), now())


@query(
    "audit_counts", "B-7 A-16",
    "SELECT action, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM audit GROUP BY ALL",
    ["audit"], (), (), ["action", "day", "n", "users"],
)
def _(i: Inputs) -> DataFrame:
    return us.audit_counts(i.audit())


@query(
    "audit_next_page", "B-7 K-7",
    """SELECT id, action, created_at FROM audit WHERE user_id = 7 AND created_at < (SELECT created_at FROM audit WHERE user_id = 7 ORDER BY created_at DESC, id OFFSET 9 LIMIT 1)
       ORDER BY created_at DESC, id LIMIT 10""",
    ["audit"], ["created_at"], (), ["id", "action"],
)
def _(i: Inputs) -> DataFrame:
    mine = i.audit().where("user_id = 7")
    last = mine.orderBy(F.col("created_at").desc(), "id").limit(10)
    edge = last.agg(F.min(F.struct(F.col("created_at"), F.col("id"))).alias("e")).scalar()
    return page_after(mine, "created_at", "id", 10, edge["created_at"], edge["id"])


@query(
    "notifications_marked_read", "B-8",
    "SELECT id, user_id, CAST(is_read OR id % 10 = 0 AS INTEGER) AS is_read FROM notifications",
    ["notifications"], (), (), ["id", "user_id", "is_read"],
)
def _(i: Inputs) -> DataFrame:
    n = i.notifications()
    # every fifth is read; half of those events come from another user
    reads = n.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("user_id")).otherwise(-1).alias("user_id"))
    return us.mark_read(n, reads).withColumn("is_read", F.col("is_read").cast("int"))


@query(
    "notification_unread_counts", "A-14 B-8",
    "SELECT user_id, count(*) FILTER (WHERE NOT is_read) AS unread, count(*) AS total FROM notifications GROUP BY user_id",
    ["notifications"], (), (), ["user_id", "unread", "total"],
)
def _(i: Inputs) -> DataFrame:
    return i.notifications().groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"), F.count(F.lit(1)).alias("total"))


@query(
    "foreign_read_events", "B-8 J-5",
    "SELECT id, CAST(-1 AS BIGINT) AS user_id FROM notifications WHERE id % 5 = 0 AND id % 10 <> 0",
    ["notifications"], (), (), ["id", "user_id"],
)
def _(i: Inputs) -> DataFrame:
    n = i.notifications()
    owner = F.when(F.col("id") % 10 == 0, F.col("user_id")).otherwise(F.lit(-1).cast("long"))
    return us.foreign_reads(n, n.where("id % 5 = 0").select("id", owner.alias("user_id")))


@query(
    "watchlists", "K-11 A-14",
    """SELECT user_id, upper(symbol) AS symbol, place FROM (SELECT user_id, symbol, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_ts, id) - 1 AS INTEGER) AS place FROM (
        SELECT user_id, symbol, min(ts) AS first_ts, arg_min(id, ts) AS id FROM (SELECT event_id AS id, user_id, ts, 'Brand#' || (event_id % 40) AS symbol FROM events) GROUP BY ALL)) WHERE place < 30""",
    (), (), (), ["user_id", "symbol", "place"],
)
def _(i: Inputs) -> DataFrame:
    e = i.table("events")
    symbol = F.concat(F.lit(" brand#"), (F.col("event_id") % 40).cast("string"))
    return us.watchlist(e.select(F.col("event_id").alias("id"), "user_id", "ts", symbol.alias("symbol"))).withColumnRenamed("position", "place")


@query(
    "answer_lifetimes", "F-6 F-4",
    """SELECT id, CAST(isodow(ny) <= 5 AND hour(ny) * 60 + minute(ny) >= 570 AND hour(ny) < 16 AS INTEGER) AS is_open,
        CASE WHEN isodow(ny) <= 5 AND hour(ny) * 60 + minute(ny) >= 570 AND hour(ny) < 16 THEN CASE p WHEN '1d' THEN 30 WHEN '3mo' THEN 1800 WHEN '5y' THEN 43200 ELSE 300 END
         ELSE CASE p WHEN '1d' THEN 21600 WHEN '3mo' THEN 43200 WHEN '5y' THEN 86400 ELSE 21600 END END AS ttl
       FROM (SELECT id, ts - INTERVAL 5 HOUR AS ny, CASE id % 4 WHEN 0 THEN '1d' WHEN 1 THEN '3mo' WHEN 2 THEN '5y' ELSE 'max' END AS p FROM requests)""",
    ["requests"], (), (), ["id", "is_open", "ttl"],
)
def _(i: Inputs) -> DataFrame:
    p = F.element_at(F.array(*[F.lit(x) for x in ("1d", "3mo", "5y", "max")]), (F.col("id") % 4 + 1).cast("int"))
    return i.requests().select("id", us.market_open("ts").cast("int").alias("is_open"), us.answer_ttl(p, "ts").alias("ttl"))


def greedy_sql(keys: str, ttl: str) -> str:
    """SQL: windows opened by the first event, row by row."""
    on = " AND ".join(f"b.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE src AS (SELECT id, ts, {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS rn FROM requests),
      g AS (SELECT id, ts, {keys}, rn, ts AS opened, 1 AS place FROM src WHERE rn = 1
        UNION ALL SELECT b.id, b.ts, {cols}, b.rn, CASE WHEN b.ts >= p.opened + {ttl} THEN b.ts ELSE p.opened END,
          CASE WHEN b.ts >= p.opened + {ttl} THEN 1 ELSE p.place + 1 END FROM g p JOIN src b ON {on} AND b.rn = p.rn + 1)"""


@query(
    "rate_limit_windows", "T-6",
    greedy_sql("user_id", "INTERVAL 14400 SECOND") + " SELECT id, user_id, opened AS window_start, CAST(place AS BIGINT) AS place, CAST(place <= 2 AS INTEGER) AS allowed FROM g",
    ["requests"], ["window_start"], (), ["id", "user_id", "place", "allowed"],
)
def _(i: Inputs) -> DataFrame:
    # the given events are sparse: a four-hour window and a limit of 2 stand in for 60 s and 20
    return greedy.rate_limit(i.requests(), limit=2, seconds=14400)


@query(
    "result_reuse_hits", "T-7 F-16",
    greedy_sql("symbol, model, horizon", "INTERVAL 1800 SECOND") + " SELECT id, symbol, model, horizon, CAST(place > 1 AS INTEGER) AS hit FROM g",
    ["requests"], (), (), ["id", "symbol", "model", "horizon", "hit"],
)
def _(i: Inputs) -> DataFrame:
    return greedy.result_reuse(i.requests(), ["symbol", "model", "horizon"])


@query(
    "reuse_hit_rate", "A-19 T-7",
    greedy_sql("symbol, model, horizon", "INTERVAL 1800 SECOND") + """ SELECT model, CAST(count(*) FILTER (WHERE place > 1) AS BIGINT) AS hits, count(*) AS requests,
      round_even(100.0 * count(*) FILTER (WHERE place > 1) / count(*), 2) AS hit_rate FROM g GROUP BY model""",
    ["requests"], (), ["hit_rate"], ["model", "hits", "requests"],
)
def _(i: Inputs) -> DataFrame:
    return us.hit_rate(greedy.result_reuse(i.requests(), ["symbol", "model", "horizon"]), ["model"])
