"""Feature store and model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.cleaning import symbol_codes
from barloom.operators.features import TECHNICAL, build_features
from barloom.operators.metrics import error_metrics
from barloom.plans.catalog_evaluation import _ERR
from barloom.plans.catalog_indicators import full, lag, pct
from barloom.plans.fixtures import Inputs
from barloom.plans.registry import query, registered
from barloom.sources.staging import new_path
from barloom.sources import feature_store as fs
from barloom.sources import registry as rg
from barloom.sources import tables

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
COLS = ["return_1d", "return_5d", "high_low_range", "volume_ratio"]


def small_features(i: Inputs) -> DataFrame:
    return build_features(i.panel(), ["price_action", "volume_ratios"], keep=["symbol", "time", "close"])


_small = f"""SELECT symbol, time, close, {pct('close', 1)} AS return_1d, {pct('close', 5)} AS return_5d,
   (high - low) / close AS high_low_range, volume / (({full('volume', 20, 'avg')}) + 1) AS volume_ratio FROM rbars"""
_latest = f"SELECT * FROM ({_small}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1"


@query("latest_feature_rows", "K-1", _latest, ["rbars"], ["time"], ["close", *COLS], ["symbol"])
def _(i: Inputs) -> DataFrame:
    return fs.latest_rows(small_features(i).select("symbol", "time", "close", *COLS))


_codes = "SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS symbol_encoded FROM (SELECT DISTINCT symbol FROM sector)"


# every feature of the standard views, joined from the SQL of the queries of its family
FEATURES = [f for _, _, _, members in fs.VIEWS.values() for f in members if f != "symbol_encoded"]


def _homes() -> dict[str, list[str]]:
    """Query of each family and the features that it gives."""
    found: dict[str, list[str]] = {}
    for f in FEATURES:
        home = next(n for n, q in registered().items() if n.startswith("features_") and q.sql and f in [*q.doubles, *q.plain])
        found.setdefault(home, []).append(f)
    return found


_HOMES = _homes()
_DIGITS = {f: registered()[n].doubles.get(f, 6) for n, members in _HOMES.items() for f in members}
_whole = (
    "SELECT b.symbol, b.time, b.close, b.rn, "
    + ", ".join(f"CAST(t{k}.{f} AS DOUBLE) AS {f}" for k, members in enumerate(_HOMES.values()) for f in members)
    + ", CAST(coalesce(c.symbol_encoded, -1) AS DOUBLE) AS symbol_encoded FROM rbars b "
    + " ".join(f"LEFT JOIN ({registered()[n].sql}) t{k} ON t{k}.symbol = b.symbol AND t{k}.time = b.time" for k, n in enumerate(_HOMES))
    + f" LEFT JOIN ({_codes}) c ON c.symbol = b.symbol"
)
_all = f"WITH f AS MATERIALIZED ({_whole}), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1)"
_views = ", ".join(f"('{n}', {ttl}, '{f}')" for n, (ttl, _, _, members) in fs.VIEWS.items() for f in members)
STORED = [*FEATURES, "symbol_encoded"]
_list = ", ".join(STORED)


def all_features(i: Inputs) -> DataFrame:
    """The features of all standard views but the symbol's code."""
    return i.once("store_features", lambda: build_features(i.panel(), TECHNICAL, keep=["symbol", "time", "close"]).select("symbol", "time", "close", *FEATURES))


@query(
    "feature_store_materialized", "M-16 S-2 P-7 P-16",
    _all + f""" SELECT symbol, time, close, {", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES)}, CAST(symbol_encoded AS INTEGER) AS symbol_encoded, '1wk' AS period
        FROM f WHERE close > 0""",
    ["rbars", "sector"], ["time"], {"close": 6} | _DIGITS, ["symbol", "symbol_encoded", "period"],
)
def _(i: Inputs) -> DataFrame:
    rows = fs.materialize(all_features(i), symbol_codes(i.sector()), FEATURES, "1wk")
    path = new_path(i.spark, "feature_store")
    tables.write_offline(rows, path)
    return tables.read_offline(i.spark, path, period="1wk")


@query(
    "feature_column_stats", "A-3 U-5",
    _all + f""", u AS (SELECT * FROM (SELECT symbol, time, {", ".join(FEATURES)} FROM f) UNPIVOT INCLUDE NULLS (v FOR col IN ({", ".join(FEATURES)})))
      SELECT symbol, w.view, col, count(*) AS rows, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi, 100.0 * (1 - count(v) / count(*)) AS null_pct
      FROM u JOIN (VALUES {_views}) w(view, ttl, feature) ON w.feature = u.col GROUP BY ALL""",
    ["rbars", "sector"], (), {"mean": 4, "std": 4, "lo": 4, "hi": 4, "null_pct": 6}, ["symbol", "view", "rows", "col"],
)
def _(i: Inputs) -> DataFrame:
    s = fs.column_stats(all_features(i), FEATURES).withColumnsRenamed({"column": "col", "min": "lo", "max": "hi"})
    return s.join(fs.features_of(fs.default_views(i.spark)).select(F.col("feature").alias("col"), "view"), "col")


@query(
    "feature_store_summary", "A-3 M-16",
    _all + f""" SELECT symbol, count(*) AS rows, min(time) AS first_time, max(time) AS last_time, CAST({len(FEATURES)} AS BIGINT) AS n_columns,
      sum({" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in FEATURES)}) / (count(*) * {len(FEATURES)}) AS null_share FROM f GROUP BY symbol""",
    ["rbars", "sector"], ["first_time", "last_time"], ["null_share"], ["symbol", "rows", "n_columns"],
)
def _(i: Inputs) -> DataFrame:
    return fs.store_summary(all_features(i), FEATURES)


def online(i: Inputs) -> DataFrame:
    """All nine views, written at eleven and, for the brands from 1 on, again two minutes before midnight."""

    def build() -> DataFrame:
        from barloom.operators.cleaning import encode_symbols

        latest = encode_symbols(fs.latest_rows(all_features(i)), symbol_codes(i.sector()))
        first = fs.online_rows(latest, fs.VIEWS, F.expr("timestamp'2024-01-31 23:00:00'"))
        fresh = fs.online_rows(latest.where("symbol < 'Brand#2'"), fs.VIEWS, F.expr("timestamp'2024-01-31 23:58:00'"))
        return fs.upsert_online(first, fresh)

    return i.once("online_rows", build)


_live = {f: ttl for ttl, _, _, members in fs.VIEWS.values() for f in members}


@query(
    "online_features_live", "S-13 S-14 T-9 F-9 F-10",
    _all + " SELECT symbol, " + ", ".join(f if _live[f] > 3600 else f"CASE WHEN symbol < 'Brand#2' THEN {f} END AS {f}" for f in STORED)
    + " FROM l WHERE symbol <> 'Brand#11'",
    ["rbars", "sector"], (), _DIGITS | {"symbol_encoded": 0}, ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    """Of vectors written an hour ago only those that live for a day are left; the refreshed symbols have all."""
    stored = fs.delete_online(online(i), "Brand#11")
    merged = fs.read_online(stored, F.expr(f"{NOW}"))
    return merged.select("symbol", *[F.try_element_at("features", F.lit(c)).alias(c) for c in STORED])


@query(
    "online_expiry_times", "S-13 S-15 T-9 T-10",
    f"""SELECT symbol, view, written + ttl * INTERVAL 1 SECOND AS expires_at, written AS written_at FROM (
        SELECT symbol, v.view, v.ttl, CASE WHEN symbol < 'Brand#2' THEN TIMESTAMP '2024-01-31 23:58:00' ELSE TIMESTAMP '2024-01-31 23:00:00' END AS written
        FROM (SELECT DISTINCT symbol FROM bars), (SELECT DISTINCT view, ttl FROM (VALUES {_views}) w(view, ttl, feature)) v WHERE NOT (symbol = 'Brand#12' AND view = 'volume'))""",
    ["bars"], ["written_at", "expires_at"], (), ["symbol", "view"],
)
def _(i: Inputs) -> DataFrame:
    return fs.delete_online(online(i), "Brand#12", "volume")


@query(
    "online_rows_swept", "T-10",
    f"""SELECT symbol, v.view, CAST(ttl AS INTEGER) AS ttl FROM (SELECT DISTINCT symbol FROM bars WHERE symbol >= 'Brand#2'),
        (SELECT DISTINCT view, ttl FROM (VALUES {_views}) w(view, ttl, feature)) v WHERE ttl < 3600""",
    ["bars"], (), (), ["symbol", "view", "ttl"],
)
def _(i: Inputs) -> DataFrame:
    """What a sweep at midnight removes."""
    from barloom.operators.usage import expired

    swept = expired(online(i), F.expr(NOW))
    return swept.select("symbol", "view", (F.unix_seconds("expires_at") - F.unix_seconds("written_at")).cast("int").alias("ttl"))


@query(
    "feature_drift_per_symbol", "U-3 U-5 X-6",
    _all + f""", u AS (SELECT * FROM (SELECT symbol, {_list} FROM l) UNPIVOT INCLUDE NULLS (v FOR feature IN ({_list})))
      SELECT symbol, view, coalesce(string_agg(u.feature, ',' ORDER BY u.feature) FILTER (WHERE v IS NULL), '') AS missing,
        count(*) FILTER (WHERE v IS NOT NULL) / count(*) AS match_rate, CAST(count(*) FILTER (WHERE v IS NOT NULL) AS INTEGER) AS n_found
      FROM u JOIN (VALUES {_views}) w(view, ttl, feature) ON w.feature = u.feature GROUP BY symbol, view""",
    ["rbars", "sector"], (), ["match_rate"], ["symbol", "view", "missing", "n_found"],
)
def _(i: Inputs) -> DataFrame:
    """What each stored vector holds against the features that its view names now."""
    d = fs.drift(online(i), fs.register_view(fs.default_views(i.spark), fs.default_views(i.spark).where("name = 'volume'")))
    return d.select("symbol", "view", F.array_join("missing", ",").alias("missing"), "match_rate", "n_found")


@query(
    "feature_registry_summary", "A-26 A-16 X-6",
    "SELECT CAST(9 AS BIGINT) AS views, CAST(85 AS BIGINT) AS features, (SELECT count(DISTINCT symbol) FROM bars) AS symbols",
    ["bars"], (), (), ["views", "features", "symbols"],
)
def _(i: Inputs) -> DataFrame:
    return fs.registry_summary(fs.default_views(i.spark), i.bars())


# ---- registry: one model per brand, versions 1, 2, 9, 10 from four slices of the forecasts


VERSIONS = (1, 2, 9, 10)
_slices = f"""SELECT 'SECTOR_' || coalesce(sector, 'other') AS name, CASE rn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 10 END AS version, model AS section, {_ERR}
  FROM predictions LEFT JOIN sector USING (symbol) GROUP BY ALL"""


def backtests(i: Inputs) -> DataFrame:
    from barloom.operators.crosssection import with_sector

    p = with_sector(i.predictions(), i.sector())
    v = F.element_at(F.array(*[F.lit(x) for x in VERSIONS]), (F.col("rn") % 4 + 1).cast("int"))
    m = error_metrics()
    rows = p.groupBy(F.concat(F.lit("SECTOR_"), "sector").alias("name"), v.alias("version"), F.col("model").alias("section"))
    flat = rows.agg(*[c.cast("double").alias(k) for k, c in m.items()])
    entries = F.create_map(*[x for k in m for x in (F.lit(k), F.col(k))])
    packed = flat.groupBy("name", "version").agg(F.map_from_entries(F.collect_list(F.struct("section", entries))).alias("metrics"))
    path = new_path(i.spark, "registry")
    rg.write_documents(packed, path, "backtest")
    return rg.read_documents(i.spark, path, f"metrics {rg.METRICS}", "backtest")


@query(
    "registry_metrics_long", "S-4 A-15",
    f"SELECT name, version, section, m.metric, m.value FROM ({_slices}) s, LATERAL (VALUES ('mae', mae), ('rmse', rmse), ('smape', smape), ('r2', r2), ('directional_accuracy', directional_accuracy), ('n_samples', CAST(n_samples AS DOUBLE))) m(metric, value)",
    ["predictions", "sector"], (), ["value"], ["name", "version", "section", "metric"],
)
def _(i: Inputs) -> DataFrame:
    return rg.metrics_long(backtests(i))


@query(
    "registry_run_summary", "A-15 M-15",
    f"SELECT name, version, rmse, r2, mae FROM ({_slices}) WHERE section = 'momentum'",
    ["predictions", "sector"], (), ["rmse", "r2", "mae"], ["name", "version"],
)
def _(i: Inputs) -> DataFrame:
    return rg.run_summary(rg.metrics_long(backtests(i)), ["rmse", "r2", "mae"], "momentum")


@query(
    "registry_latest_version", "K-2 M-15",
    f"""SELECT name, max(version) AS version, max(version) + 1 AS next_version, arg_max(rmse, version) AS rmse FROM ({_slices}) WHERE section = 'momentum' GROUP BY name""",
    ["predictions", "sector"], (), ["rmse"], ["name", "version", "next_version"],
)
def _(i: Inputs) -> DataFrame:
    s = rg.run_summary(rg.metrics_long(backtests(i)), ["rmse"], "momentum")
    return rg.latest_versions(s).join(rg.next_version(s), "name")


@query(
    "registry_top_runs", "K-4",
    f"SELECT name, version, directional_accuracy FROM ({_slices}) WHERE section = 'momentum' AND directional_accuracy IS NOT NULL ORDER BY directional_accuracy DESC, name, version LIMIT 10",
    ["predictions", "sector"], (), ["directional_accuracy"], ["name", "version"],
)
def _(i: Inputs) -> DataFrame:
    s = rg.run_summary(rg.metrics_long(backtests(i)), ["directional_accuracy"], "momentum")
    return rg.top_runs(s, "directional_accuracy")


@query(
    "registry_top_features", "K-5",
    """SELECT symbol AS name, feature, avg(abs(value)) AS importance, row_number() OVER (PARTITION BY symbol ORDER BY avg(abs(value)) DESC, feature) AS place
       FROM (SELECT symbol, f.feature, f.value FROM rbars, LATERAL (VALUES ('ret', lr), ('range', (high - low) / close), ('body', (close - open) / open)) f(feature, value))
       GROUP BY symbol, feature QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY avg(abs(value)) DESC, feature) <= 2""",
    ["rbars"], (), ["importance"], ["name", "feature", "place"],
)
def _(i: Inputs) -> DataFrame:
    b = build_features(i.panel(), ["price_action"], keep=["symbol", "open", "close"])
    body = (F.col("close") - F.col("open")) / F.col("open")
    pairs = F.array(
        F.struct(F.lit("ret").alias("feature"), F.col("log_return_1d").alias("importance")),
        F.struct(F.lit("range").alias("feature"), F.col("high_low_range").alias("importance")),
        F.struct(F.lit("body").alias("feature"), body.alias("importance")),
    )
    long = b.select(F.col("symbol").alias("name"), F.lit(1).alias("version"), F.inline(pairs))
    return rg.top_features(long, 2).withColumn("place", F.col("place").cast("long"))


@query(
    "registry_enriched", "J-12 M-15",
    f"""SELECT name, version, max(rmse) FILTER (WHERE section = 'momentum') AS rmse, array_to_string(list(section ORDER BY abs(mae) DESC, section)[1:2], ',') AS top_features
        FROM ({_slices}) GROUP BY name, version""",
    ["predictions", "sector"], (), ["rmse"], ["name", "version", "top_features"],
)
def _(i: Inputs) -> DataFrame:
    """Each registered document with its metrics and its two leading entries."""
    docs = backtests(i)
    long = rg.metrics_long(docs)
    leading = long.where("metric = 'mae'").select("name", "version", F.col("section").alias("feature"), F.col("value").alias("importance"))
    full = rg.enriched(docs.select("name", "version"), rg.run_summary(long, ["rmse"], "momentum"), leading, 2)
    return full.withColumn("top_features", F.array_join("top_features", ","))


@query(
    "manifest_resolution", "J-10 J-11",
    f"""SELECT id, symbol, horizon, CASE WHEN id % 11 = 0 THEN 'CRYPTO_UNIVERSAL' WHEN horizon >= 20 AND id % 11 <> 0 THEN 'EQUITY_H20'
         WHEN sector IN (SELECT 'S' || k FROM (VALUES ('1'), ('2')) v(k)) THEN 'SECTOR_' || sector ELSE 'UNIVERSAL' END AS resolved,
         CASE WHEN id % 11 = 0 THEN NULL ELSE 'UNIVERSAL/' || (SELECT max(version) FROM ({_slices})) END AS deep
        FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 'BTC-USD' ELSE symbol END AS symbol, horizon FROM requests) r LEFT JOIN sector USING (symbol)""",
    ["requests", "sector", "predictions"], (), (), ["id", "symbol", "horizon", "resolved", "deep"],
)
def _(i: Inputs) -> DataFrame:
    r = i.requests().select("id", F.when(F.col("id") % 11 == 0, "BTC-USD").otherwise(F.col("symbol")).alias("symbol"), "horizon")
    r = r.join(i.sector(), "symbol", "left")
    no = F.lit(False)
    have = i.spark.createDataFrame([(n,) for n in ("CRYPTO_UNIVERSAL", "EQUITY_H20", "SECTOR_S1", "SECTOR_S2", "UNIVERSAL")], "name string")
    deep = backtests(i).select(F.lit("UNIVERSAL").alias("name"), "version")
    c = rg.manifest_candidates(F.col("symbol"), F.col("horizon"), F.col("sector"), no)
    out = rg.resolve(r, c, have)
    out = out.select("id", "symbol", "horizon", "resolved")
    d = rg.resolve_newest(r.select("id", "symbol"), rg.deep_candidates(F.col("symbol"), no), deep)
    # both sides are as long as the requests, whatever size the planner expects of their few columns
    return out.hint("merge").join(d.select("id", F.col("resolved").alias("deep")), "id")


@query(
    "median_bar_spacing", "K-10",
    f"""SELECT symbol, CAST(floor(quantile_cont(gap, 0.5)) AS BIGINT) AS spacing FROM (
        SELECT symbol, epoch(time) - epoch({lag('time', 1)}) AS gap, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM rbars) WHERE k <= 19 GROUP BY symbol""",
    ["rbars"], (), (), ["symbol", "spacing"],
)
def _(i: Inputs) -> DataFrame:
    from barloom.operators.forecast import median_spacing

    return median_spacing(i.panel())
