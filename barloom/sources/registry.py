"""Model registry as JSON documents and as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = "map<string, map<string, double>>"


def parse_file_name(path: Column) -> tuple[Column, Column]:
    """(name, version) of ``…/NAME_v12….json``; the version is a number, so 10 follows 9."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.regexp_extract(base, r"^(.+)_v(\d+)", 1), F.regexp_extract(base, r"^(.+)_v(\d+)", 2).cast("int")


def write_documents(docs: DataFrame, path: str, suffix: str = "") -> None:
    """One JSON document per (name, version) row in a partitioned folder layout.

    The folder names carry the key; ``kind`` keeps manifests, backtests and importances apart.
    """
    out = docs.withColumn("kind", F.lit(suffix or "manifest"))
    out.write.mode("append").partitionBy("kind", "name", "version").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    base = f"{schema}, kind string, name string, version int"
    return spark.read.schema(base).json(path).where(F.col("kind") == kind).drop("kind")


def scan_json_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Whole-file JSON documents named ``NAME_vN*.json``; name and version from the file name."""
    raw = spark.read.schema(schema).option("multiLine", True).json(pattern)
    name, version = parse_file_name(F.input_file_name())
    return raw.select("*", name.alias("name"), version.alias("version")).where(F.col("name") != "")


def latest_versions(docs: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Newest document per name."""
    rest = [c for c in docs.columns if c not in (*keys, "version")]
    row = F.max_by(F.struct("version", *rest), "version").alias("r")
    return docs.groupBy(*keys).agg(row).select(*keys, "r.*")


def next_version(docs: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    return docs.groupBy(*keys).agg((F.max("version") + 1).alias("next_version"))


def metrics_long(backtests: DataFrame, column: str = "metrics") -> DataFrame:
    """(name, version, section, metric, value): sections and metrics exploded."""
    s = backtests.select("name", "version", F.explode(column).alias("section", "m"))
    return s.select("name", "version", "section", F.explode("m").alias("metric", "value"))


def run_summary(long: DataFrame, wanted: Sequence[str], section: str = "ensemble") -> DataFrame:
    """One row per (name, version) with the wanted metrics as columns."""
    rows = long.where((F.col("section") == section) & F.col("metric").isin(*wanted))
    return rows.groupBy("name", "version").pivot("metric", list(wanted)).agg(F.first("value"))


def top_runs(summary: DataFrame, metric: str, n: int = 10) -> DataFrame:
    return summary.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), "name", "version").limit(n)


def top_features(importances: DataFrame, n: int, keys: Sequence[str] = ("name", "version")) -> DataFrame:
    """Rank features by mean |importance|; a document holds a bounded feature list."""
    mean = importances.groupBy(*keys, "feature").agg(F.avg(F.abs("importance")).alias("importance"))
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")
    return mean.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def enriched(manifests: DataFrame, summary: DataFrame, importances: DataFrame, n: int = 10) -> DataFrame:
    """Manifest with metrics and its leading features; missing parts stay NULL."""
    key = ["name", "version"]
    top = top_features(importances, n).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("place", "feature"))).alias("__t")
    )
    return (
        manifests.join(summary, key, "left")
        .join(top.select(*key, F.transform("__t", lambda s: s["feature"]).alias("top_features")), key, "left")
    )


def resolve(requests: DataFrame, candidates: Column, available: DataFrame, name: str = "name") -> DataFrame:
    """First available candidate per request: ``candidates`` is the ordered array of names. Columns of a request may be NULL."""
    lists = _first_available(requests, candidates, available, name)
    return _by_list(requests, candidates, lists.withColumnRenamed("__first", "resolved"))


def _first_available(requests: DataFrame, candidates: Column, available: DataFrame, name: str) -> DataFrame:
    """(``__list``, ``__first``) of the different candidate lists that have an available name.

    Names are matched once per list: requests share few names, and all requests of a name would meet in one task.
    """
    lists = requests.select(candidates.alias("__list")).distinct()
    tried = lists.select("__list", F.posexplode("__list").alias("__place", name))
    hit = tried.join(available, name, "left_semi")
    return hit.groupBy("__list").agg(F.min_by(name, "__place").alias("__first"))


def _by_list(requests: DataFrame, candidates: Column, lists: DataFrame) -> DataFrame:
    """Requests with ``resolved`` of their list; there are only as many lists as fallback orders."""
    asked = requests.select("*", candidates.alias("__list"))
    return asked.join(F.broadcast(lists.select("__list", "resolved")), "__list", "left").select(*requests.columns, "resolved")


def manifest_candidates(symbol: Column, horizon: Column, sector: Column, crypto: Column) -> Column:
    """Ordered fallbacks: horizon model, sector model, asset class, universal."""
    by_horizon = F.when(horizon >= 20, "EQUITY_H20").when(horizon >= 10, "EQUITY_H10").when(horizon >= 5, "EQUITY_H5")
    by_sector = F.when(sector.isNotNull(), F.concat(F.lit("SECTOR_"), sector))
    equity = F.array(by_horizon, by_sector, F.lit("EQUITY_UNIVERSAL"), F.lit("UNIVERSAL"))
    coin = F.array(F.lit("CRYPTO_UNIVERSAL"), F.lit("UNIVERSAL"))
    is_coin = crypto | F.upper(symbol).endswith("-USD")
    return F.array_compact(F.when(is_coin, coin).otherwise(equity))


def deep_candidates(symbol: Column, crypto: Column) -> Column:
    """Ordered fallbacks of the sequence models."""
    coin, stock = F.array(F.lit("CRYPTO_UNIVERSAL")), F.array(F.lit("EQUITY_UNIVERSAL"), F.lit("UNIVERSAL"))
    return F.when(crypto | F.upper(symbol).endswith("-USD"), coin).otherwise(stock)


def resolve_newest(requests: DataFrame, candidates: Column, available: DataFrame) -> DataFrame:
    """First candidate that the registry (``name, version``) has, in its newest version, as ``name/version``."""
    newest = available.groupBy("name").agg(F.max("version").alias("__v"))
    lists = _first_available(requests, candidates, newest, "name").join(newest.withColumnRenamed("name", "__first"), "__first", "left")
    told = F.nullif(F.concat_ws("/", "__first", F.col("__v").cast("string")), F.lit(""))
    return _by_list(requests, candidates, lists.select("__list", told.alias("resolved")))
