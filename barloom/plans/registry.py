"""Queries: a Spark plan over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.fixtures import Inputs
from barloom.plans.sqltext import with_views


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    plan: Callable[[Inputs], DataFrame]
    sql: str | None
    uses: tuple[str, ...]
    times: tuple[str, ...]
    doubles: dict[str, int]
    plain: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # zone-less times in the tables are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = self.plan(Inputs(spark, sf_dir))
        if not (self.times or self.doubles or self.plain):
            return df
        return df.select(
            *[F.unix_seconds(F.col(t).cast("timestamp")).alias(t) for t in self.times],
            *[_rounded(c, d).alias(c) for c, d in self.doubles.items()],
            *[c.strip('"') for c in self.plain],
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = [f"CAST(floor(epoch({t})) AS BIGINT) AS {t}" for t in self.times]
        cols += [f"floor(CAST({c} AS DOUBLE) * 1e{d} + 0.5) / 1e{d} AS {c}" for c, d in self.doubles.items()]
        cols += list(self.plain)
        return f"{with_views(self.uses)} SELECT {', '.join(cols)} FROM ({self.sql}) AS answer"


def _rounded(name: str, digits: int):
    # the same arithmetic on both sides, so that ties round alike
    return F.floor(F.col(name).cast("double") * F.lit(float(10**digits)) + 0.5).cast("double") / F.lit(
        float(10**digits)
    )


_QUERIES: dict[str, Query] = {}


def query(
    name: str,
    covers: str,
    sql: str | None = None,
    uses: Sequence[str] = (),
    times: Sequence[str] = (),
    doubles: Sequence[str] | dict[str, int] = (),
    plain: Sequence[str] = (),
):
    """Register a plan under ``name``; ``covers`` lists the blueprint ids it implements."""

    def add(plan: Callable[[Inputs], DataFrame]):
        assert name not in _QUERIES, name
        d = dict(doubles) if isinstance(doubles, dict) else {c: 6 for c in doubles}
        _QUERIES[name] = Query(name, covers, plan, sql, tuple(uses), tuple(times), d, tuple(plain))
        return plan

    return add


def registered() -> dict[str, Query]:
    """The queries of the catalogues imported so far."""
    return _QUERIES


def all_queries() -> dict[str, Query]:
    from importlib import import_module

    for part in (
        "bars", "indicators", "macro", "crosssection", "evaluation", "store", "instruments",
        "ledger", "usage", "models", "streams",
    ):
        import_module(f"barloom.plans.catalog_{part}")
    return dict(_QUERIES)
