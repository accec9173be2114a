"""Market, ledger and event inputs derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.features import panel_with_history
from barloom.operators.resample import bars_from_ticks
from barloom.sources.staging import staged

TICK_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SERIES = ("vix", "sp500", "nasdaq", "russell2000", "yield_10y", "yield_3m", "tlt", "hyg", "dxy", "gold", "oil")
WEEK = 7 * 86400

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def pick(value: Column, table: dict, default: object = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(default))


class Inputs:
    """The fixtures of one data folder. Bars and macro rows are staged once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A given table; time stamps without a zone are read as UTC instants."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.select(
            *[
                F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
                for c, t in df.dtypes
            ]
        )

    def once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _STAGED:
            _STAGED[key] = staged(build(), name)
        return _STAGED[key]

    def ticks(self) -> DataFrame:
        li, part = self.table("lineitem"), self.table("part")
        return li.join(part, li.l_partkey == part.p_partkey).select(
            F.col("p_brand").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("size"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )

    def build_bars(self) -> DataFrame:
        return bars_from_ticks(self.ticks(), "1wk", TICK_ORDER)

    def bars(self) -> DataFrame:
        return self.once("bars", self.build_bars)

    def panel(self) -> DataFrame:
        """Bars with row numbers and running volume features."""
        return self.once("panel", lambda: panel_with_history(self.bars(), bar_seconds=WEEK))

    def daily_panel(self) -> DataFrame:
        """Day bars per brand and part type: the larger panel used for timing."""

        def build() -> DataFrame:
            li, part = self.table("lineitem"), self.table("part")
            ticks = li.join(part, li.l_partkey == part.p_partkey).select(
                F.concat_ws("/", "p_brand", "p_type").alias("symbol"),
                F.col("l_shipdate").alias("ts"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                F.col("l_quantity").alias("size"),
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            )
            return panel_with_history(bars_from_ticks(ticks, "1d", TICK_ORDER))

        return self.once("daily_panel", build)

    def event_ticks(self) -> DataFrame:
        e = self.table("events").where("value > 0")
        return e.select(
            F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"),
            "user_id", "event_id",
        )

    def sector(self) -> DataFrame:
        p = self.table("part").select(F.col("p_brand").alias("symbol")).distinct()
        first = F.substring(F.element_at(F.split("symbol", "#"), 2), 1, 1)
        return p.where(~F.col("symbol").isin("Brand#7", "Brand#23")).select(
            "symbol", F.concat(F.lit("S"), first).alias("sector")
        )

    def macro_observations(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        by_priority = {
            "1-URGENT": "vix", "2-HIGH": "nasdaq", "3-MEDIUM": "russell2000", "4-NOT SPECIFIED": "yield_10y",
        }
        by_segment = {"MACHINERY": "tlt", "BUILDING": "hyg", "AUTOMOBILE": "dxy", "FURNITURE": "gold"}
        rest = [F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("v")]
        first = o.select(pick(F.col("o_orderpriority"), by_priority, "yield_3m").alias("series"), *rest)
        joined = o.join(c, o.o_custkey == c.c_custkey)
        second = joined.select(pick(F.col("c_mktsegment"), by_segment, "oil").alias("series"), *rest)
        third = o.select(F.lit("sp500").alias("series"), *rest)
        return first.unionByName(second).unionByName(third)

    def macro_long(self) -> DataFrame:
        s = F.col("series")
        scale = F.when(s == "vix", 9000.0).when(s.startswith("yield"), 60000.0).otherwise(1000.0)
        g = self.macro_observations().groupBy("series", "time").agg(F.avg("v").alias("v"))
        return g.select("series", "time", (F.col("v") / scale).alias("value"))

    def macro(self) -> DataFrame:
        from barloom.operators.macro import align_series

        return self.once("macro", lambda: align_series(self.macro_long(), SERIES))

    def predictions(self) -> DataFrame:
        """Three fixed forecasters of the 5-bar return, in long form."""
        return self.once("predictions", self._predictions)

    def _predictions(self) -> DataFrame:
        from barloom.operators.layout import block_panel

        w = block_panel(self.panel(), back=8, ahead=6)
        reversal = -(F.col("close") / w.mean("close", 5) - 1)
        wide = w.with_df(
            w.df.select(
                "*",
                (w.lead("close", 5) / F.col("close") - 1).alias("y_true"),
                reversal.alias("reversal"),
                (F.col("close") / w.lag("close", 5) - 1).alias("momentum"),
                F.lit(0.0).alias("flat"),
            )
        ).own_rows()
        models = F.array(
            *[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in ("reversal", "momentum", "flat")]
        )
        return (
            wide.select("symbol", "time", "rn", "y_true", F.inline(models))
            .where("y_true is not null and y_pred is not null")
        )

    def option_chain(self) -> DataFrame:
        li, part = self.table("lineitem"), self.table("part")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return (
            li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(
                F.col("p_brand").alias("symbol"),
                F.date_trunc("quarter", "l_shipdate").alias("expiration"),
                F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("side"),
                (F.floor(F.col("p_retailprice") / 5) * 5).cast("double").alias("strike"),
            )
            .agg(
                F.sum(F.col("l_quantity").cast("long")).alias("open_interest"),
                F.avg(F.col("l_discount") + F.col("l_tax")).alias("implied_volatility"),
                F.max(price).alias("last_price"),
                F.count(F.lit(1)).alias("volume"),
            )
        )

    def wallets(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("wallet_id"),
            F.col("c_custkey").alias("user_id"),
            F.col("c_acctbal").cast("decimal(19,4)").alias("balance"),
            F.lit("TRY").alias("currency"),
        )

    def transactions(self) -> DataFrame:
        o = self.table("orders")
        n = self.table("customer").agg(F.count(F.lit(1)).alias("n"))
        k = F.col("o_orderkey")
        kinds = {"1-URGENT": "PAYMENT", "2-HIGH": "REFUND"}
        states = {"F": "COMPLETED", "O": "PENDING"}
        return o.select(
            k.alias("id"),
            F.concat(F.lit("k"), F.when(k % 10 == 9, k - 1).otherwise(k).cast("string")).alias("idempotency_key"),
            F.col("o_custkey").alias("sender_wallet_id"),
            ((F.col("o_custkey") * 7 + 1) % n.scalar()).alias("receiver_wallet_id"),
            F.col("o_totalprice").cast("decimal(19,4)").alias("amount"),
            pick(F.col("o_orderpriority"), kinds, "TRANSFER").alias("type"),
            pick(F.col("o_orderstatus"), states, "FAILED").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    def plans(self) -> DataFrame:
        rows = [
            (0, "FREE", 3, 0.0, True, '{"features": ["basic"]}'),
            (1, "PRO", 20, 19.9, True, '{"features": ["basic", "signals"]}'),
            (2, "LEGACY", 40, 9.9, False, '{"features": ["basic", "export"]}'),
            (3, "MAX", 60, 49.9, True, '{"features": ["basic", "signals", "api"]}'),
        ]
        return self.spark.createDataFrame(
            rows, "plan_id int, name string, monthly_quota int, price double, active boolean, features string"
        )

    def subscriptions(self) -> DataFrame:
        e = self.table("events").where("event_type = 'signup'")
        return e.select(
            F.col("event_id").alias("id"),
            "user_id",
            pick(F.col("user_id") % 3, {0: 0, 1: 1}, 3).alias("plan_id"),
            F.lit("ACTIVE").alias("status"),
            F.col("ts").alias("starts_at"),
            (F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("expires_at"),
        )

    def requests(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").where("event_type <> 'signup'").select(
            F.col("event_id").alias("id"),
            "user_id",
            "ts",
            _brand(F.col("user_id")).alias("symbol"),
            pick(k % 3, {0: "tree", 1: "lstm"}, "arima").alias("model"),
            F.lit("1y").alias("period"),
            pick(k % 4, {0: 1, 1: 5, 2: 10}, 20).alias("horizon"),
            F.lit(1).alias("credits"),
        )

    def audit(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.when(kind == "error", "LOGIN_FAILED").when(kind == "click", "LOGIN").otherwise(F.upper(kind)).alias("action"),
            F.lit("EVENT").alias("entity_type"),
            F.col("props").alias("details"),
            F.col("ts").alias("created_at"),
        )

    def notifications(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("event_type").alias("type"),
            F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
            (F.col("event_id") % 3 == 0).alias("is_read"),
            F.col("ts").alias("created_at"),
        )

    def signals(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("generated_at"),
            _brand(F.col("user_id")).alias("symbol"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_name"),
            (F.col("value") / 100.0 - 0.1).alias("prediction"),
            F.least(F.lit(1.0), F.col("value") / 500.0).alias("confidence"),
            F.lit(24).alias("horizon_hours"),
        )

    def news(self) -> DataFrame:
        head = F.substring_index("text", "\n", 1)
        return self.table("documents").select(
            "doc_id",
            _brand(F.col("doc_id")).alias("symbol"),
            F.trim(head).alias("title"),
            F.substring(F.col("text"), F.length(head) + 2, F.length("text")).alias("summary"),
            (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)).alias("published"),
        )

    def lexicon(self) -> DataFrame:
        up, down = "that with que und les for".split(), "was are des die from une".split()
        rows = [(w, 1) for w in up] + [(w, -1) for w in down]
        return self.spark.createDataFrame(rows, "word string, polarity int")

    def categories(self) -> DataFrame:
        rows = [
            (1, "earnings", "tionth"), (1, "earnings", "orre"), (2, "analyst", "sich"), (2, "analyst", "eaux"),
            (3, "deals", "with"), (4, "legal", "los"), (5, "product", "ing"),
        ]
        return self.spark.createDataFrame(rows, "priority int, category string, keyword string")

    def brand_years(self) -> DataFrame:
        li, part = self.table("lineitem"), self.table("part")
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        tax = F.round(F.col("l_tax") * 100).cast("long")
        return (
            li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.col("p_brand").alias("symbol"), F.year("l_shipdate").alias("y"))
            .agg(
                F.sum(F.col("l_quantity").cast("long")).alias("units"),
                (F.sum(cents) / 100.0).alias("revenue"),
                (F.sum(cents * tax) / 10000.0).alias("tax"),
            )
        )


def _brand(key: Column) -> Column:
    return F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string"))
