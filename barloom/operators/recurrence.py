"""Linear recurrences ``y[t] = q * y[t-1] + u[t]`` as window functions.

Inside a sub-block of ``sub_rows`` rows the closed form ``q^k * sum(u * q^-k)`` is a running sum.
What earlier rows contribute is the fold of the previous sub-block ends; since it decays by
``q^sub_rows`` per sub-block, ``depth`` of them reach double precision. All three steps run over
the block layout's one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.operators.layout import Blocks

TAIL = 37.0  # e^-37 < 1e-16: what is left out is below double precision


def sub_rows_for(ratios: Iterable[float], limit: int = 1024) -> int:
    """Largest sub-block for which ``q^-k`` stays far from overflow for every ratio."""
    steepest = max((-math.log(q) for q in ratios), default=0.0)
    size = limit
    while steepest * size > 600 and size > 2:
        size //= 2
    return size


def depth_for(q: float, sub_rows: int) -> int:
    return max(1, math.ceil(TAIL / (-math.log(q) * sub_rows)))


def reach_of(ratios: Iterable[float], sub_rows: int) -> int:
    """Rows of history a block needs so that recurrences are exact to double precision."""
    return max((sub_rows * (depth_for(q, sub_rows) + 1) for q in ratios), default=0)


@dataclass(frozen=True)
class Recurrence:
    """One recurrence: name of the result, driving term, ratio.

    ``ratio`` may be a column (grids of parameters); then ``slowest`` bounds it from above.
    """

    name: str
    drive: Column
    ratio: float | Column
    slowest: float | None = None

    @property
    def bound(self) -> float:
        return self.slowest if self.slowest is not None else float(self.ratio)

    def _q(self) -> Column:
        return self.ratio if isinstance(self.ratio, Column) else F.lit(float(self.ratio))


def solve(blocks: Blocks, items: list[Recurrence]) -> Blocks:
    """Add one column per recurrence. Every driving term must be non-null."""
    size = blocks.sub_rows
    k = (F.col("rn") - 1) - F.col("__sub") * size
    df = blocks.df
    keep = df.columns
    local = [
        (F.pow(r._q(), k) * F.sum(r.drive * F.pow(r._q(), -k)).over(blocks.sub_line)).alias(f"__y_{r.name}")
        for r in items
    ]
    df = df.select("*", *local)
    entry = []
    for r in items:
        far = F.pow(r._q(), F.lit(size))
        ends = [
            F.pow(far, F.lit(j)) * F.coalesce(blocks.lag(f"__y_{r.name}", 1 + j * size), F.lit(0.0))
            for j in range(depth_for(r.bound, size))
        ]
        total = ends[0]
        for e in ends[1:]:
            total = total + e
        entry.append(F.when(k == 0, total).alias(f"__e_{r.name}"))
    df = df.select("*", *entry)
    upto = blocks.line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = [
        (
            F.col(f"__y_{r.name}")
            + F.pow(r._q(), k + 1) * F.coalesce(F.last(f"__e_{r.name}", ignorenulls=True).over(upto), F.lit(0.0))
        ).alias(r.name)
        for r in items
    ]
    return blocks.with_df(df.select(*keep, *done))
