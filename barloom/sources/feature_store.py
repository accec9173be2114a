"""Feature store: offline partitions, online latest rows with expiry, view registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.features import EMA_WINDOWS, PRICE_LAGS, RETURN_LAGS, SMA_WINDOWS, VOLUME_LAGS

VIEW_SCHEMA = (
    "name string, description string, features array<string>, entity string, ttl_seconds int, version int, "
    "tags map<string, string>"
)

# Name, seconds to live, model types and members of the standard views (fixed values).
VIEWS: dict[str, tuple[int, str, str, list[str]]] = {
    "price_action": (
        300, "all", "price",
        [f"return_{k}d" for k in (1, 5, 10, 20)] + ["log_return_1d", "log_return_5d"]
        + [f"volatility_{n}d" for n in (5, 10, 20)] + ["gk_volatility", "high_low_range", "close_position", "gap"],
    ),
    "trend": (
        3600, "tree,dl", "trend",
        [f"close_to_sma_{n}" for n in SMA_WINDOWS] + [f"close_to_ema_{n}" for n in EMA_WINDOWS]
        + ["macd_norm", "macd_signal_norm", "macd_hist_norm", "adx", "di_plus", "di_minus", "trend_strong"]
        + ["trend_very_strong", "di_spread"] + [f"close_to_ichimoku_{p}" for p in ("a", "b", "base", "conv")],
    ),
    "momentum": (300, "all", "momentum", ["rsi_14", "stoch_k", "stoch_d", "williams_r", "roc_5", "roc_10", "roc_20", "cci_20"]),
    "volatility": (
        300, "all", "volatility",
        ["bb_width", "bb_position", "atr_pct", "close_to_kc_upper", "close_to_kc_lower", "parkinson_vol_5d", "parkinson_vol_20d"],
    ),
    "volume": (
        300, "all", "volume",
        ["obv_change", "mfi_14", "ad_change", "volume_ratio", "close_to_vwap", "volume_surge", "volume_surge_flag"],
    ),
    "statistical": (3600, "tree", "statistical", ["skewness_20", "kurtosis_20", "zscore_20", "zscore_50", "autocorr_5"]),
    "calendar": (86400, "tree", "calendar", ["day_of_week", "month", "quarter", "is_month_start", "is_month_end"]),
    "lags": (
        300, "tree", "lags",
        [f"close_return_lag_{k}" for k in PRICE_LAGS] + [f"volume_return_lag_{k}" for k in VOLUME_LAGS]
        + [f"return_lag_{k}" for k in RETURN_LAGS],
    ),
    "symbol_meta": (86400, "tree", "meta", ["symbol_encoded"]),
}


def default_views(spark: SparkSession) -> DataFrame:
    rows = [
        (n, f"{cat} features", feats, "symbol", ttl, 1, {"category": cat, "model_types": kinds})
        for n, (ttl, kinds, cat, feats) in VIEWS.items()
    ]
    return spark.createDataFrame(rows, VIEW_SCHEMA)


def register_view(views: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace views of the same name, add the others."""
    return views.join(fresh.select("name"), "name", "left_anti").unionByName(fresh)


def views_for_model(views: DataFrame, model_type: str) -> DataFrame:
    kinds = F.split(F.element_at("tags", "model_types"), ",")
    return views.where(F.array_contains(kinds, model_type) | F.array_contains(kinds, "all"))


def features_of(views: DataFrame) -> DataFrame:
    """All feature names, first mention first, each once."""
    named = views.select("name", F.posexplode("features").alias("pos", "feature"))
    first = named.groupBy("feature").agg(F.min(F.struct("name", "pos")).alias("at"))
    return first.select("feature", F.col("at.name").alias("view"), F.col("at.pos").cast("long").alias("position"))


def registry_summary(views: DataFrame, symbols: DataFrame) -> DataFrame:
    v = views.agg(F.count(F.lit(1)).alias("views"), F.array_size(F.array_distinct(F.flatten(F.collect_list("features")))).alias("f"))
    n = symbols.agg(F.count_distinct("symbol").alias("symbols")).scalar()
    return v.select("views", F.col("f").cast("long").alias("features"), n.alias("symbols"))


def match_features(have: Column, want: Column) -> dict[str, Column]:
    """Compare a stored feature list with a wanted one."""
    both = F.array_size(F.array_intersect(want, have)).cast("double")
    return {
        "missing": F.array_sort(F.array_except(want, have)),
        "extra": F.array_sort(F.array_except(have, want)),
        "match_rate": F.try_divide(both, F.array_size(F.array_distinct(want)).cast("double")),
    }


def latest_rows(features: DataFrame, keys: Sequence[str] = ("symbol",), time: str = "time") -> DataFrame:
    """Newest row per key; partial maxima leave one row per key and task to shuffle."""
    row = F.max_by(F.struct(*[c for c in features.columns if c not in keys]), time).alias("r")
    return features.groupBy(*keys).agg(row).select(*keys, "r.*")


def online_rows(latest: DataFrame, views: dict[str, tuple[int, str, str, list[str]]], written_at: Column) -> DataFrame:
    """One (symbol, view) row each: features as JSON, written and expiry time."""
    entries = []
    for name, (ttl, _, _, feats) in views.items():
        present = [f for f in feats if f in latest.columns]
        if present:
            entries.append(
                F.struct(
                    F.lit(name).alias("view"),
                    F.to_json(F.struct(*[F.col(f).cast("double").alias(f) for f in present])).alias("features"),
                    F.lit(ttl).alias("ttl"),
                )
            )
    flat = latest.select("symbol", F.inline(F.array(*entries)))
    return flat.select(
        "symbol", "view", "features", written_at.alias("written_at"),
        F.timestamp_seconds(F.unix_seconds(written_at) + F.col("ttl")).alias("expires_at"),
    )


def upsert_online(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest write per (symbol, view)."""
    both = current.unionByName(fresh)
    rest = ["features", "written_at", "expires_at"]
    newest = F.max_by(F.struct(*rest), "written_at").alias("r")
    return both.groupBy("symbol", "view").agg(newest).select("symbol", "view", "r.*")


def read_online(online: DataFrame, now: Column, views: Sequence[str] | None = None) -> DataFrame:
    """Live vectors merged into one map per symbol. The number of views bounds the list."""
    live = online.where(F.col("expires_at") > now)
    if views is not None:
        live = live.where(F.col("view").isin(*views))
    parsed = live.select("symbol", "view", F.from_json("features", "map<string,double>").alias("m"))
    maps = F.transform(F.array_sort(F.collect_list(F.struct("view", F.map_entries("m").alias("e")))), lambda s: s["e"])
    return parsed.groupBy("symbol").agg(F.map_from_entries(F.flatten(maps)).alias("features"))


def delete_online(online: DataFrame, symbol: str, view: str | None = None) -> DataFrame:
    hit = F.col("symbol") == symbol
    return online.where(~(hit if view is None else hit & (F.col("view") == view)))


def column_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, column, mean, std, min, max, null_pct) in one aggregate pass, then unpivoted."""
    aggs, packed = [F.count(F.lit(1)).alias("__n")], []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.min(x).alias(f"l_{c}"),
                 F.max(x).alias(f"h_{c}"), F.count(x).alias(f"k_{c}")]
        packed.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"a_{c}").alias("mean"), F.col(f"s_{c}").alias("std"),
                F.col(f"l_{c}").alias("min"), F.col(f"h_{c}").alias("max"),
                (100.0 * (1 - F.col(f"k_{c}") / F.col("__n"))).alias("null_pct"),
            )
        )
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.col("__n").alias("rows"), F.inline(F.array(*packed)))


def store_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), time: str = "time") -> DataFrame:
    """(keys, rows, first_time, last_time, n_columns, null_share) of a feature table."""
    nulls = F.lit(0)
    for c in columns:
        nulls = nulls + F.col(c).isNull().cast("int")
    n = len(columns)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.lit(n).cast("long").alias("n_columns"),
        (F.sum(nulls) / (F.count(F.lit(1)) * n)).alias("null_share"),
    )


def drift(online: DataFrame, views: DataFrame) -> DataFrame:
    """(symbol, view, missing, extra, match_rate, n_found): the features that each stored vector has against its view's list."""
    named = views.select(F.col("name").alias("view"), F.col("features").alias("__want"))
    have = F.map_keys(F.map_filter(F.from_json("features", "map<string, double>"), lambda _, v: v.isNotNull()))
    d = online.select("symbol", "view", have.alias("__have")).join(named, "view")
    m = match_features(F.col("__have"), F.col("__want"))
    return d.select("symbol", "view", *[c.alias(n) for n, c in m.items()], F.array_size(F.array_intersect("__want", "__have")).alias("n_found"))


def materialize(
    features: DataFrame, symbol_codes: DataFrame, columns: Sequence[str], period: str, minimum: int = 30
) -> DataFrame:
    """Rows for the offline store, all symbols in one job: enough history, no empty rows, gaps
    filled with 0, positive close, symbol code and period."""
    from barloom.operators.cleaning import encode_symbols, enough_history, positive_price

    d = positive_price(enough_history(features, minimum)).dropna(how="all", subset=list(columns))
    d = encode_symbols(d.fillna(0, subset=list(columns)), symbol_codes)
    return d.withColumn("period", F.lit(period))
