"""Subscriptions, quotas, audit, notifications, watchlists, cache lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import carry_scan, chunk_of

DAY = 86400
FALLBACK_QUOTA = 10

# Seconds a market-data answer lives, by period, while the market is open or closed (fixed values).
OPEN_TTL = {"1d": 30, "5d": 60, "1mo": 60, "3mo": 1800, "6mo": 1800, "1y": 21600, "2y": 21600, "5y": 43200}
CLOSED_TTL = {
    "1d": 21600, "5d": 21600, "1mo": 21600, "3mo": 43200, "6mo": 43200, "1y": 86400, "2y": 86400, "5y": 86400,
}


def current_subscriptions(subs: DataFrame, as_of: Column) -> DataFrame:
    """Per user the active, unexpired subscription that ends last."""
    live = subs.where((F.col("status") == "ACTIVE") & (F.col("expires_at") > as_of) & (F.col("starts_at") <= as_of))
    rest = [c for c in subs.columns if c != "user_id"]
    best = F.max_by(F.struct(*rest), F.struct("expires_at", "id")).alias("r")
    return live.groupBy("user_id").agg(best).select("user_id", "r.*")


def active_plans(plans: DataFrame, name: str | None = None) -> DataFrame:
    p = plans.where("active") if name is None else plans.where(F.col("name") == name)
    return p.withColumn("feature_list", F.from_json("features", "features array<string>")["features"])


def effective_quota(users: DataFrame, subs: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Plan of the current subscription, else the FREE plan, else a fixed small quota."""
    mine = current_subscriptions(subs, as_of).join(plans, "plan_id").select("user_id", "monthly_quota")
    free = plans.where("name = 'FREE'").agg(F.max("monthly_quota")).scalar()
    out = users.select("user_id").distinct().join(mine, "user_id", "left")
    return out.select("user_id", F.coalesce("monthly_quota", free, F.lit(FALLBACK_QUOTA)).alias("monthly_limit"))


def superseded(subs: DataFrame, days: int = 30) -> DataFrame:
    """A later subscription of the user cancels the earlier ones.

    Adds ``status`` and ``ended_at``: the next start if cancelled, else start plus ``days``.
    """
    s = carry_scan(subs, ["user_id"], ["starts_at", "id"], chunk_of("starts_at", 30 * DAY), {"__next": ("after", F.col("starts_at"))})
    later = F.col("__next").isNotNull()
    ends = F.timestamp_seconds(F.unix_seconds("starts_at") + days * DAY)
    return s.select(
        "id", "user_id", "plan_id", "starts_at", F.when(later, "CANCELLED").otherwise("ACTIVE").alias("status"),
        F.coalesce("__next", ends).alias("ended_at"),
    )


def seed_subscriptions(users: DataFrame, existing: DataFrame, plans: DataFrame, plan: str, at: Column) -> DataFrame:
    """A one-year subscription to ``plan`` for users that have none yet."""
    from barloom.sources.tables import insert_if_absent

    pid = plans.where(F.col("name") == plan).agg(F.max("plan_id")).scalar()
    fresh = users.select("user_id").distinct().select(
        "user_id", pid.alias("plan_id"), F.lit("ACTIVE").alias("status"), at.alias("starts_at"),
        F.add_months(F.to_date(at), 12).cast("timestamp").alias("expires_at"),
    )
    return insert_if_absent(existing, fresh, ["user_id"])


def month_key(ts: str) -> Column:
    return F.date_format(ts, "yyyy:MM")


def monthly_quota(requests: DataFrame, quotas: DataFrame) -> DataFrame:
    """Running use per (user, month) against the limit; rejected calls count as well.

    The running count is carried over days, so one user may issue most of the requests.
    """
    r = requests.withColumn("month", month_key("ts"))
    r = carry_scan(r, ["user_id", "month"], ["ts", "id"], chunk_of("ts", DAY), {"used": ("count", F.lit(1))})
    j = r.join(quotas, "user_id", "left")
    limit = F.coalesce("monthly_limit", F.lit(FALLBACK_QUOTA))
    return j.withColumn("monthly_limit", limit).withColumn("accepted", (F.col("used") <= F.col("monthly_limit")).cast("int"))


def quota_report(requests: DataFrame, quotas: DataFrame, month: str) -> DataFrame:
    used = requests.where(month_key("ts") == month).groupBy("user_id").agg(F.sum("credits").alias("used"))
    j = quotas.join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return j.withColumn("remaining", F.greatest(F.lit(0), F.col("monthly_limit") - F.col("used")))


def credits_since(requests: DataFrame, users: DataFrame, since: Column) -> DataFrame:
    c = requests.where(F.col("ts") >= since).groupBy("user_id").agg(F.sum("credits").alias("credits"))
    return users.select("user_id").distinct().join(c, "user_id", "left").select("user_id", F.coalesce("credits", F.lit(0)).alias("credits"))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", F.to_date("created_at").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )


def mark_read(notifications: DataFrame, read_events: DataFrame) -> DataFrame:
    """Apply (id, user_id) read events; an event of another user changes nothing."""
    e = read_events.select("id", "user_id").distinct().withColumn("__hit", F.lit(True))
    j = notifications.join(e, ["id", "user_id"], "left")
    return j.withColumn("is_read", F.col("is_read") | F.col("__hit").isNotNull()).drop("__hit").select(*notifications.columns)


def foreign_reads(notifications: DataFrame, read_events: DataFrame) -> DataFrame:
    """Read events whose notification is unknown or belongs to someone else."""
    return read_events.join(notifications.select("id", "user_id"), ["id", "user_id"], "left_anti")


def watchlist(adds: DataFrame, limit: int = 30) -> DataFrame:
    """(user, symbol, position): first addition counts, in order, up to ``limit`` per user.

    Additions collapse to one row per (user, symbol) before the window sees them.
    """
    s = adds.select("user_id", F.upper(F.trim("symbol")).alias("symbol"), "ts", "id")
    first = s.groupBy("user_id", "symbol").agg(F.min(F.struct("ts", "id")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at")
    pos = first.select("user_id", "symbol", (F.row_number().over(w) - 1).alias("position"))
    return pos.where(F.col("position") < limit)


def market_open(ts: Column | str) -> Column:
    """Monday to Friday, 9:30 to 16:00 New York time."""
    ny = F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, "America/New_York")
    minute = F.hour(ny) * 60 + F.minute(ny)
    return (F.weekday(ny) < 5) & (minute >= 570) & (minute < 960)


def answer_ttl(period: Column, ts: Column | str) -> Column:
    """Seconds a market-data answer for ``period`` stays valid when given at ``ts``."""

    def table(m: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])

    live = F.coalesce(F.try_element_at(table(OPEN_TTL), period), F.lit(300))
    shut = F.coalesce(F.try_element_at(table(CLOSED_TTL), period), F.lit(21600))
    return F.when(market_open(ts), live).otherwise(shut)


def expired(df: DataFrame, as_of: Column, column: str = "expires_at") -> DataFrame:
    return df.where(F.col(column) < as_of)


def hit_rate(log: DataFrame, groups: list[str]) -> DataFrame:
    """Hits in percent of all answers, two decimals."""
    return log.groupBy(*groups).agg(
        F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("requests"),
        F.bround(F.avg(F.col("hit").cast("double")) * 100, 2).alias("hit_rate"),
    )
