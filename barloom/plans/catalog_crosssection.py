"""Cross-sectional ranks, long-short selection, sectors, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import crosssection as cs
from barloom.operators import features as ft
from barloom.operators import splits
from barloom.operators.ranks import small_group_rank_correlation
from barloom.plans.catalog_indicators import ALL, full, pct
from barloom.plans.fixtures import Inputs
from barloom.plans.registry import query, registered


def crank(x: str, minimum: int = 5) -> str:
    """SQL: average-tie percent rank minus 0.5 inside one time."""
    return (
        f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY time) >= {minimum} THEN "
        f"(rank() OVER (PARTITION BY time ORDER BY {x} ASC NULLS LAST) + count({x}) OVER (PARTITION BY time ORDER BY {x} ASC NULLS LAST)) "
        f"/ 2.0 / count({x}) OVER (PARTITION BY time) - 0.5 END"
    )


def czscore(x: str, minimum: int = 5) -> str:
    return (
        f"CASE WHEN count({x}) OVER (PARTITION BY time) >= {minimum} THEN ({x} - avg({x}) OVER (PARTITION BY time)) "
        f"/ (stddev_samp({x}) OVER (PARTITION BY time) + 1e-10) END"
    )


_base = {
    "return_1d": pct("close", 1),
    "return_5d": pct("close", 5),
    "return_20d": pct("close", 20),
    "volume_ratio": f"volume / (({full('volume', 20, 'avg')}) + 1)",
    "momentum_accel": f"({pct('close', 5)}) - ({pct('close', 10)}) / 2",
    "volatility_5d": f"({full('lr', 5, 'stddev_samp')}) * sqrt(252)",
}
_feat = "SELECT symbol, time, " + ", ".join(f"{e} AS {c}" for c, e in _base.items()) + " FROM rbars"
# features whose SQL is that of their own query
_own = {"rsi_14": "features_rsi", "adx": "features_directional_movement", "bb_position": "features_bollinger"}
_feat = (
    f"SELECT p.*, {', '.join(f'{n}.{c}' for c, n in _own.items())} FROM ({_feat}) p "
    + " ".join(f"LEFT JOIN ({registered()[n].sql}) {n} ON {n}.symbol = p.symbol AND {n}.time = p.time" for n in _own.values())
)
_ranked = [*_base, *_own]
_out = [f"cs_{k}_{c}" for c in _ranked for k in ("rank", "zscore")]


@query(
    "cross_sectional_ranks", "W-48 W-49 X-3",
    "SELECT symbol, time, " + ", ".join(f"{crank(c)} AS cs_rank_{c}, {czscore(c)} AS cs_zscore_{c}" for c in _ranked) + f" FROM ({_feat})",
    ["rbars"], ["time"], _out, ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    families = ["price_action", "volume_ratios", "microstructure", "relative_strength", "directional_movement", "bollinger"]
    f = ft.build_features(i.panel(), families, keep=["symbol", "time"])
    return cs.add_ranks(f.select("symbol", "time", *_ranked), _ranked)


_fwd = ", ".join(f"lead(close, {h}) OVER {ALL} / close - 1 AS target_{h}" for h in ft.HORIZONS)


@query(
    "cross_sectional_target_ranks", "W-50",
    "SELECT symbol, time, " + ", ".join(f"coalesce({crank(f'target_{h}')}, 0) AS target_cs_rank_{h}" for h in ft.HORIZONS)
    + f" FROM (SELECT symbol, time, {_fwd} FROM rbars)",
    ["rbars"], ["time"], [f"target_cs_rank_{h}" for h in ft.HORIZONS], ["symbol"],
)
def _(i: Inputs) -> DataFrame:
    f = ft.build_features(i.panel(), ["targets"], keep=["symbol", "time"])
    return cs.add_target_ranks(f, fill=True)


@query(
    "long_short_selection", "W-51",
    f"""SELECT symbol, time, score, CAST(CASE WHEN a <= 3 THEN 1 ELSE -1 END AS INTEGER) AS side FROM (
        SELECT *, row_number() OVER (PARTITION BY time ORDER BY score DESC, symbol) AS a,
          row_number() OVER (PARTITION BY time ORDER BY score, symbol DESC) AS b
        FROM (SELECT symbol, time, {pct('close', 5)} AS score FROM rbars) WHERE score IS NOT NULL) WHERE a <= 3 OR b <= 3""",
    ["rbars"], ["time"], ["score"], ["symbol", "side"],
)
def _(i: Inputs) -> DataFrame:
    f = ft.build_features(i.panel(), ["price_action"], keep=["symbol", "time"])
    return cs.long_short(f.select("symbol", "time", F.col("return_5d").alias("score")), "score")


@query(
    "sector_bars", "J-4 P-15",
    """SELECT coalesce(sector, 'other') AS sector, time, count(*) AS symbols, avg(close) AS close, sum(volume) AS volume
       FROM bars LEFT JOIN sector USING (symbol) GROUP BY ALL""",
    ["bars", "sector"], ["time"], {"close": 6, "volume": 4}, ["sector", "symbols"],
)
def _(i: Inputs) -> DataFrame:
    d = cs.with_sector(i.bars(), i.sector())
    return d.groupBy("sector", "time").agg(
        F.count(F.lit(1)).alias("symbols"), F.avg("close").alias("close"), F.sum("volume").alias("volume")
    )


@query(
    "universe_membership", "J-5 P-15",
    """SELECT symbol, count(*) AS bars, 'known' AS kind FROM bars WHERE symbol IN (SELECT symbol FROM sector) GROUP BY symbol
       UNION ALL SELECT symbol, count(*), 'unknown' FROM bars WHERE symbol NOT IN (SELECT symbol FROM sector) GROUP BY symbol""",
    ["bars", "sector"], (), (), ["symbol", "bars", "kind"],
)
def _(i: Inputs) -> DataFrame:
    def part(invert: bool, kind: str) -> DataFrame:
        d = cs.only_members(i.bars(), i.sector(), "symbol", invert)
        return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).withColumn("kind", F.lit(kind))

    return part(False, "known").unionByName(part(True, "unknown"))


@query(
    "daily_rank_correlation", "A-7 A-6 W-48",
    f"""SELECT time, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS ic, count(*) AS n FROM (
        SELECT time, (rank() OVER (PARTITION BY time ORDER BY a) + count(*) OVER (PARTITION BY time ORDER BY a)) / 2.0 AS ra,
          (rank() OVER (PARTITION BY time ORDER BY b) + count(*) OVER (PARTITION BY time ORDER BY b)) / 2.0 AS rb
        FROM (SELECT *, {crank('r5')} AS a FROM (SELECT symbol, time, {pct('close', 5)} AS r5, lead(close, 5) OVER {ALL} / close - 1 AS b FROM rbars))
        WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY time""",
    ["rbars"], ["time"], ["ic"], ["n"],
)
def _(i: Inputs) -> DataFrame:
    return flagship(i)


def flagship(i: Inputs) -> DataFrame:
    """From bars to the rank correlation of a ranked 5-bar return with the next 5-bar return."""
    f = ft.build_features(i.panel(), ["price_action", "targets"], keep=["symbol", "time"])
    r = cs.add_ranks(f.select("symbol", "time", "return_5d", "target_5"), ["return_5d"])
    return small_group_rank_correlation(r, ["time"], "cs_rank_return_5d", "target_5")


@query(
    "chronological_split", "M-1 U-4 A-25",
    """SELECT symbol, split, count(*) AS n, min(time) AS first, max(time) AS last FROM (
        SELECT *, CASE WHEN rn - 1 >= ts THEN 'test' WHEN rn - 1 >= floor(ts * (1 - 0.1 / 0.8)) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT symbol, time, rn, floor(count(*) OVER (PARTITION BY symbol) * 0.8) AS ts FROM rbars
              QUALIFY count(*) OVER (PARTITION BY symbol) >= 50)) GROUP BY ALL""",
    ["rbars"], ["first", "last"], (), ["symbol", "split", "n"],
)
def _(i: Inputs) -> DataFrame:
    d = splits.chronological_split(i.panel())
    return d.groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last")
    )


_axis = "SELECT time, row_number() OVER (ORDER BY time) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM bars)"


@query(
    "walk_forward_folds", "M-3 X-5",
    f"""SELECT fold, s - 5 AS train_end, s AS test_start, s + 26 AS test_end FROM (
        SELECT fold, 100 + fold * 26 AS s FROM (SELECT unnest(range(100)) AS fold), (SELECT max(n) AS n FROM ({_axis}))
        WHERE 100 + fold * 26 + 26 <= n)""",
    ["bars"], (), (), ["fold", "train_end", "test_start", "test_end"],
)
def _(i: Inputs) -> DataFrame:
    return splits.walk_forward_folds(splits.time_axis(i.bars()), 100, 26, horizon=5)


@query(
    "walk_forward_roles", "M-3 M-5 X-5 J-5",
    f"""SELECT fold, role, count(*) AS n, min(time) AS first, max(time) AS last FROM (
        SELECT f.fold, b.time, CASE WHEN a.t < f.s - 5 THEN 'train' WHEN a.t >= f.s AND a.t < f.s + 26 THEN 'test' END AS role
        FROM bars b JOIN ({_axis}) a USING (time), (SELECT unnest(range(100)) AS fold, 100 + 26 * unnest(range(100)) AS s) f
        WHERE f.s + 26 <= a.n) WHERE role IS NOT NULL GROUP BY ALL""",
    ["bars"], ["first", "last"], (), ["fold", "role", "n"],
)
def _(i: Inputs) -> DataFrame:
    axis = splits.time_axis(i.bars())
    roles = splits.fold_roles(axis, splits.walk_forward_folds(axis, 100, 26, horizon=5))
    # rows per time first: fold expansion then works on one row per time, not on the panel
    per_time = i.bars().groupBy("time").agg(F.count(F.lit(1)).alias("k"))
    return roles.join(per_time, "time").groupBy("fold", "role").agg(
        F.sum("k").alias("n"), F.min("time").alias("first"), F.max("time").alias("last")
    )


def _purged_sql(expanding: bool) -> str:
    resume = "n" if expanding else "least(n, e + greatest(1, CAST(floor(size * 0.01) AS BIGINT)))"
    return f"""SELECT fold, train_end, s AS test_start, e AS test_end, {resume} AS resume FROM (
        SELECT fold, n, size, fold * size AS s, CASE WHEN fold < 4 THEN (fold + 1) * size ELSE n END AS e,
          greatest(0, fold * size - 5) AS train_end
        FROM (SELECT unnest(range(5)) AS fold), (SELECT max(n) AS n, max(n) // 5 AS size FROM ({_axis})))
        WHERE train_end + n - {resume} >= 50 AND e - s >= 10"""


for _name, _exp in (("purged_folds_expanding", True), ("purged_folds_embargo", False)):

    @query(_name, "M-2", _purged_sql(_exp), ["bars"], (), (), ["fold", "train_end", "test_start", "test_end", "resume"])
    def _(i: Inputs, expanding: bool = _exp) -> DataFrame:
        return splits.purged_folds(splits.time_axis(i.bars()), 5, 5, expanding=expanding)
