import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import greedy, options
from barloom.sources import registry, tables, topics
from barloom.sources.feature_store import read_online
from barloom.streaming import stateful, windows


def brute(times, ttl):
    opened, out, place = None, [], 0
    for t in times:
        if opened is None or t >= opened + ttl:
            opened, place = t, 0
        place += 1
        out.append((opened, place))
    return out


@pytest.mark.parametrize("gap", [7, 40])
def test_request_windows_match_a_loop(spark, gap):
    """Dense events: almost everything is one long run that crosses many segments and levels."""
    rng = np.random.default_rng(gap)
    rows = []
    for user in range(3):
        t = np.cumsum(rng.integers(0, gap, 500)) + 1_700_000_000
        rows += [(user, int(x), int(user * 1000 + k)) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "user_id long, s long, id long").select("user_id", "id", F.timestamp_seconds("s").alias("ts"))
    got = greedy.greedy_windows(df, ["user_id"], "ts", "id", 60, fan=2, levels=4).toPandas().sort_values(["user_id", "id"])
    for user, g in got.groupby("user_id"):
        want = brute([r[1] for r in rows if r[0] == user], 60)
        start = (g["window_start"] - pd.Timestamp(0)).dt.total_seconds().astype(int)
        assert list(zip(start, g["place"], strict=True)) == want


def landed(spark, tmp_path, pdf, delay, beat=10_000_000, files=5):
    """A stream of several files that are out of order by less than ``delay`` seconds, then a heartbeat; and the list of progress."""
    src = str(tmp_path / "in")
    rng = np.random.default_rng(3)
    late = pdf["s"] + rng.integers(0, delay // 3, len(pdf))
    width = (late.max() - late.min()) // files + 1
    assert width <= delay // 2, "the delay must cover a file's span"
    full = pdf.assign(ts=pd.to_datetime(pdf["s"], unit="s", utc=True))
    for n in range(files):
        part = full[(late - late.min()) // width == n].sample(frac=1, random_state=n)
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    last = dict.fromkeys(schema.fieldNames()) | {"ts": full["ts"].max().to_pydatetime() + dt.timedelta(seconds=delay + beat)}
    spark.createDataFrame([tuple(last.values())], schema).coalesce(1).write.mode("append").parquet(src)
    return topics.read_folder(spark, src, schema, files_per_batch=1)


def run_out(stream, tmp_path):
    """What the stream wrote, and how many rows of state it keeps at the end."""
    query = topics.append_to(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert query.exception() is None
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    assert dropped == 0
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")).toPandas(), kept


def events(seed, users=4, n=300, gap=60):
    rng = np.random.default_rng(seed)
    rows = [(u, int(s)) for u in range(users) for s in 1_700_000_000 + np.cumsum(rng.integers(0, gap, n))]
    pdf = pd.DataFrame(rows, columns=["user_id", "s"])
    return pdf.assign(id=np.arange(len(pdf)) + (1 << 60), failed=rng.random(len(pdf)) < 0.8)  # ids beyond a double's whole numbers


def test_windows_over_late_files_equal_a_loop_and_leave_no_state(spark, tmp_path):
    pdf = events(1)
    stream = landed(spark, tmp_path, pdf, 9000)
    got, kept = run_out(stateful.request_windows(stream, ["user_id"], 120, "9000 seconds"), tmp_path)
    got = got.set_index("id")
    for _, g in pdf.groupby("user_id"):
        g = g.sort_values(["s", "id"])
        want = brute(g["s"].tolist(), 120)
        assert list(zip(got.loc[g["id"], "window_start"] // 1_000_000, got.loc[g["id"], "place"], strict=True)) == want
    assert len(got) == len(pdf) and kept == 0


def test_lockout_over_late_files_equals_a_loop(spark, tmp_path):
    pdf = events(2)
    stream = landed(spark, tmp_path, pdf, 9000)
    got, _ = run_out(stateful.lockouts(stream, 5, 900, "9000 seconds"), tmp_path)
    got = got.set_index("id")
    for _, g in pdf.groupby("user_id"):
        fails, until = 0, None
        for r in g.sort_values(["s", "id"]).itertuples():
            if until is not None and r.s <= until:
                want = "rejected"
            else:
                fails, until = (0 if until is not None else fails), None
                fails = fails + 1 if r.failed else 0
                until = r.s + 900 if fails >= 5 else None
                want = "locked" if until is not None else "failed" if fails else "ok"
            assert (got.loc[r.id, "outcome"], got.loc[r.id, "failed_attempts"]) == (want, fails)
    assert set(got["outcome"]) == {"ok", "failed", "locked", "rejected"}


def test_monthly_use_over_late_files_and_months(spark, tmp_path):
    pdf = events(5, n=600, gap=20_000)
    pdf["month"] = pd.to_datetime(pdf["s"], unit="s").dt.strftime("%Y:%m")
    stream = landed(spark, tmp_path, pdf, 3_000_000, beat=40_000_000)
    got, kept = run_out(stateful.monthly_use(stream, ["user_id", "month"], "3000000 seconds"), tmp_path)
    want = pdf.sort_values(["s", "id"]).assign(used=lambda d: d.groupby(["user_id", "month"]).cumcount() + 1)
    assert dict(zip(got["id"], got["used"], strict=True)) == dict(zip(want["id"], want["used"], strict=True))
    assert kept == 0 and want["month"].nunique() > 2


def test_signal_for_decision_over_late_files(spark, tmp_path):
    pdf = events(7).rename(columns={"user_id": "symbol"})
    rng = np.random.default_rng(0)
    pdf = pdf.assign(prediction=rng.normal(size=len(pdf)), confidence=rng.random(len(pdf)), is_signal=rng.random(len(pdf)) < 0.3)
    stream = landed(spark, tmp_path, pdf, 9000)
    # one stream is split after its watermark has been set for both sides
    decisions = stream.where("is_signal is null or not is_signal").select("symbol", "id", "ts")
    signals = stream.where("is_signal is null or is_signal").select("symbol", "id", "ts", "prediction", "confidence")
    out = stateful.signal_for_decision(decisions, signals, ["symbol"], 300, "9000 seconds")
    got, kept = run_out(out, tmp_path)
    got = got.set_index("id")
    seen = 0
    for _, g in pdf.groupby("symbol"):
        s = g[g.is_signal].sort_values(["s", "id"])
        for r in g[~g.is_signal].itertuples():
            before = s[(s.s <= r.s) & (s.s >= r.s - 300)]
            have = got.loc[r.id]
            if len(before):
                seen += 1
                assert have["prediction"] == before.iloc[-1]["prediction"] and have["signal_confidence"] == before.iloc[-1]["confidence"]
            else:
                assert pd.isna(have["prediction"])
    assert kept == 0 and seen > 100 and len(got) == (~pdf.is_signal).sum()


def test_values_that_are_not_renewed_expire(spark, tmp_path):
    pdf = pd.DataFrame({"k": ["a", "a", "b", "a"], "s": [1_700_000_000 + x for x in (0, 10, 20, 4000)], "v": [1.0, 2.0, 3.0, 4.0], "id": [1, 2, 3, 4]})
    stream = landed(spark, tmp_path, pdf, 9000, beat=5000, files=2)
    got, kept = run_out(stateful.fresh_values(stream, ["k"], "v", 3600, "9000 seconds"), tmp_path)
    told = {(r.k, r.v, bool(r.expired)) for r in got.itertuples()}
    assert told == {("a", 1.0, False), ("a", 2.0, False), ("b", 3.0, False), ("a", 4.0, False), ("b", 3.0, True), ("a", 4.0, True)}
    assert kept == 0


def test_many_keys_share_buckets_of_state(spark, tmp_path):
    """State grows with the buckets, not with the keys; null keys and keys beyond a double's whole numbers stay apart."""
    rows = [(int(u) + (1 << 60) if u else None, 1_700_000_000 + int(u) % 3600 + 20 * n, int(u) * 2 + n) for u in range(2500) for n in range(2)]
    df = spark.createDataFrame(rows, "user_id long, s long, id long").select("user_id", "id", F.timestamp_seconds("s").alias("ts"))
    src = str(tmp_path / "in")
    df.where("id % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    df.where("id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    beat = spark.createDataFrame([(None, None, dt.datetime(2025, 1, 1))], "user_id long, id long, ts timestamp")
    beat.coalesce(1).write.mode("append").parquet(src)
    stream = topics.read_folder(spark, src, df.schema, files_per_batch=1)
    query = topics.append_to(stateful.request_windows(stream, ["user_id"], 3600, "2 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # a timer and a part of the buffer per batch, in each bucket of keys that are null or not
    assert max(held) <= 2 * 3 * stateful.BUCKETS and held[-1] == 0
    got = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.user_id, r.id, r.window_start // 1_000_000, r.place) for r in got.collect()}
    assert got == {(u, i, s - 20 * (i % 2), i % 2 + 1) for u, s, i in rows}


def test_late_ticks_are_dropped(spark, tmp_path):
    src = str(tmp_path / "ticks")
    t0 = dt.datetime(2024, 1, 1, 10)

    def land(rows, n):
        spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double").coalesce(1).write.mode("append").parquet(src)

    land([("A", t0, 1.0, 1.0), ("A", t0 + dt.timedelta(minutes=20), 2.0, 1.0)], 0)
    land([("A", t0 + dt.timedelta(hours=3), 5.0, 1.0)], 1)
    schema = "symbol string, ts timestamp, price double, size double"
    check, out = str(tmp_path / "c"), str(tmp_path / "o")
    bars = topics.drain(windows.stream_bars(topics.read_folder(spark, src, schema)), out, check)
    assert bars.count() == 1
    land([("A", t0 + dt.timedelta(minutes=30), 9.0, 1.0), ("A", t0 + dt.timedelta(hours=6), 6.0, 1.0)], 2)
    bars = topics.drain(windows.stream_bars(topics.read_folder(spark, src, schema)), out, check)
    rows = {r["time"].hour: (r["high"], r["n_ticks"]) for r in bars.collect()}
    assert rows == {10: (2.0, 2), 13: (5.0, 1)}


def test_registry_files_sort_versions_as_numbers(spark, tmp_path):
    for v in (1, 2, 9, 10):
        (tmp_path / f"EQUITY_ALL_v{v}_backtest.json").write_text(json.dumps({"ensemble": {"ic": v / 10}}, indent=2))
    docs = registry.scan_json_files(spark, str(tmp_path / "*_backtest.json"), "ensemble map<string, double>")
    latest = registry.latest_versions(docs).first()
    assert (latest["name"], latest["version"], latest["ensemble"]["ic"]) == ("EQUITY_ALL", 10, 1.0)
    assert registry.next_version(docs).first()["next_version"] == 11


def test_requests_are_resolved_by_their_lists(spark):
    """Rows that come twice or hold nulls stay as they are, and no request is shuffled by a candidate's name."""
    rows = [(1, "A", 20, "S1"), (1, "A", 20, "S1"), (None, "A", 5, None), (2, "B", None, "S9"), (3, None, 10, "S2"), (4, "X-USD", 1, None)]
    asked = spark.createDataFrame(rows, "id long, symbol string, horizon int, sector string")
    have = spark.createDataFrame([("SECTOR_S1",), ("SECTOR_S2",), ("UNIVERSAL",), ("UNIVERSAL",)], "name string")
    no = F.lit(False)
    names = registry.manifest_candidates(F.col("symbol"), F.col("horizon"), F.col("sector"), no)
    out = registry.resolve(asked, names, have)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("strategy=broadcast") == 1
    want = ["SECTOR_S1", "SECTOR_S1", "UNIVERSAL", "UNIVERSAL", "SECTOR_S2", "UNIVERSAL"]
    key = lambda r: str(r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((*r, w) for r, w in zip(rows, want, strict=True)), key=key)
    versions = spark.createDataFrame([("UNIVERSAL", 9), ("UNIVERSAL", 10), ("OTHER", 11)], "name string, version int")
    deep = registry.resolve_newest(asked.select("id", "symbol"), registry.deep_candidates(F.col("symbol"), no), versions)
    got = sorted(((r["id"], r["resolved"]) for r in deep.collect()), key=key)
    assert got == sorted(((r[0], None if r[1] == "X-USD" else "UNIVERSAL/10") for r in rows), key=key)


def test_offline_store_replaces_only_given_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("A", "1d", 1.0), ("B", "1d", 2.0)], "symbol string, period string, v double")
    tables.write_offline(a, path)
    tables.write_offline(spark.createDataFrame([("B", "1d", 3.0)], a.schema), path)
    assert {(r["symbol"], r["v"]) for r in tables.read_offline(spark, path).collect()} == {("A", 1.0), ("B", 3.0)}
    plan = tables.read_offline(spark, path, "A")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def test_expired_vectors_are_not_served(spark):
    rows = [("A", "x", '{"f": 1.0}', 100), ("A", "y", '{"g": 2.0}', 10)]
    online = spark.createDataFrame(rows, "symbol string, view string, features string, e long").withColumn("expires_at", F.timestamp_seconds("e"))
    got = read_online(online, F.timestamp_seconds(F.lit(50))).first()["features"]
    assert got == {"f": 1.0}


def test_max_pain_takes_the_lowest_strike_on_ties(spark):
    rows = [("S", "2024-01-19", "call", 10.0, 5), ("S", "2024-01-19", "put", 12.0, 5), ("S", "2024-01-19", "call", 11.0, 0)]
    chain = spark.createDataFrame(rows, "symbol string, expiration string, side string, strike double, open_interest long")
    assert options.max_pain(chain).first()["max_pain"] == 10.0


def test_every_catalogue_schema_parses(spark):
    for name, t in tables.CATALOGUE.items():
        fields = tables.schema_of(name).fieldNames()
        assert set(t.key) <= set(fields)
        assert not t.chunk_days or t.chunk_days[0] in fields


def test_transfers_from_a_folder_of_part_files(spark, tmp_path):
    from barloom.plans.registry import all_queries

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(60)
    orders.repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.idempotency_key, r.n) for r in all_queries()["stream_first_transfer"].run(spark, str(tmp_path)).collect()}
    keys = {r.o_orderkey - r.o_orderkey % 2 for r in orders.select("o_orderkey").collect()}
    assert got == {(f"k{k}", 1) for k in keys}
