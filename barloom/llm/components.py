"""Connected components of an edge table, with DataFrame operations only.

Alternates two steps (large star, small star) until nothing changes: every node hands the larger of its neighbours to the
smallest one, then every node hands its smaller neighbours to the smallest of them. The number of edges never grows and
the rounds grow with the logarithm of the longest path. Minima are aggregated before the shuffle; a hub's edges meet its
single minimum in a join, which Spark splits when it is skewed. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import staged


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: for each end of an edge the smallest node that it reaches. Edges with a null end, loops,
    repeated edges and an empty table are allowed; nodes without another end are not listed."""
    now = edges.filter(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = staged(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        now = staged(_stars(now), "edges")
        if (new := _print(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
