"""How an ordered panel is spread over tasks.

A plain ``Window.partitionBy(symbol)`` puts one symbol's whole history into one task. These
helpers split a symbol instead:

* ``carry_scan``  - running totals, maxima and last values. Every key is cut into chunks of the
  order; chunks are summarised (map-side combined), the summaries are scanned per key, and the
  result is joined back to the rows of each chunk.
* ``with_ordinal`` - the global row number of each row inside its key, as a carried count.
* ``block_panel`` - equal blocks of rows; each block also receives the rows just before (and
  after) it, so that any bounded window is evaluated inside one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.numeric import as_col

CHUNK = "__chunk"


def chunk_of(time: str | Column, seconds: int) -> Column:
    """Chunk number of a timestamp: fixed-width slices of the time axis."""
    return F.floor(F.unix_seconds(as_col(time)) / F.lit(seconds)).cast("long")


def _summary(how: str, name: str, order: Sequence[str]) -> Column:
    x = F.col(name)
    if how == "sum":
        return F.sum(x)
    if how == "count":
        return F.count(x)
    if how == "max":
        return F.max(x)
    if how == "min":
        return F.min(x)
    if how in ("last", "prev"):
        return F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))
    if how in ("next", "after"):
        return F.min_by(x, F.when(x.isNotNull(), F.struct(*order)))
    raise ValueError(f"unknown scan {how!r}")


def _prefix(how: str, name: str, before: WindowSpec, after: WindowSpec) -> Column:
    x = F.col(name)
    if how in ("sum", "count"):
        return F.sum(x).over(before)
    if how == "max":
        return F.max(x).over(before)
    if how == "min":
        return F.min(x).over(before)
    if how in ("next", "after"):
        return F.first(x, ignorenulls=True).over(after)
    return F.last(x, ignorenulls=True).over(before)


def _combine(how: str, value: str, carry: str, inner: WindowSpec) -> Column:
    x, c = F.col(value), F.col(carry)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if how == "sum":
        # the carry is NULL in the first chunk, the inner sum until the first value
        got = F.sum(x).over(upto)
        return F.when(got.isNull(), c).when(c.isNull(), got).otherwise(got + c)
    if how == "count":
        return F.count(x).over(upto) + F.coalesce(c, F.lit(0))
    if how == "max":
        return F.greatest(F.max(x).over(upto), c)
    if how == "min":
        return F.least(F.min(x).over(upto), c)
    if how == "last":
        return F.coalesce(F.last(x, ignorenulls=True).over(upto), c)
    if how == "next":
        onward = inner.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return F.coalesce(F.first(x, ignorenulls=True).over(onward), c)
    if how == "after":
        later = inner.rowsBetween(1, Window.unboundedFollowing)
        return F.coalesce(F.first(x, ignorenulls=True).over(later), c)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(x, ignorenulls=True).over(earlier), c)


def carry_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    scans: dict[str, tuple[str, Column | str]],
) -> DataFrame:
    """Add running aggregates over each key's whole history.

    ``scans`` maps an output name to ``(how, expression)``; ``how`` is one of ``sum``, ``count``,
    ``max``, ``min``, ``last`` (latest non-null up to the row), ``prev`` (latest non-null before
    the row), ``next`` (first non-null from the row on) or ``after`` (first non-null after it). ``chunk`` must not decrease along
    ``order`` and must keep one key's rows of a chunk small enough for a task.
    """
    keys, order = list(keys), list(order)
    base = df.select(
        "*", chunk.alias(CHUNK), *[as_col(e).alias(f"__v_{o}") for o, (_, e) in scans.items()]
    )
    sums = base.groupBy(*keys, CHUNK).agg(
        *[_summary(how, f"__v_{o}", order).alias(f"__s_{o}") for o, (how, _) in scans.items()]
    )
    line = Window.partitionBy(*keys).orderBy(CHUNK)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(1, Window.unboundedFollowing)
    carried = sums.select(
        *keys,
        CHUNK,
        *[_prefix(how, f"__s_{o}", before, after).alias(f"__c_{o}") for o, (how, _) in scans.items()],
    )
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return base.join(carried, [*keys, CHUNK]).select(
        *df.columns,
        *[_combine(how, f"__v_{o}", f"__c_{o}", inner).alias(o) for o, (how, _) in scans.items()],
    )


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("time",),
    chunk: Column | None = None,
    out: str = "rn",
    chunk_seconds: int = 16384 * 86400,
) -> DataFrame:
    """Row number (from 1) of each row inside its key. ``order`` must be unique per key."""
    cut = chunk if chunk is not None else chunk_of(order[0], chunk_seconds)
    return carry_scan(df, keys, order, cut, {out: ("count", F.lit(1))})


@dataclass(frozen=True)
class Blocks:
    """A panel cut into row blocks with copied neighbours; see :func:`block_panel`."""

    df: DataFrame
    keys: tuple[str, ...]
    sub_rows: int
    block_rows: int
    back: int
    specs: dict = field(default_factory=dict, compare=False, repr=False)

    def _spec(self, name: object, make: Callable[[], WindowSpec]) -> WindowSpec:
        # specifications are JVM objects behind a gateway: make each once
        if name not in self.specs:
            self.specs[name] = make()
        return self.specs[name]

    @property
    def line(self) -> WindowSpec:
        # ``__sub`` grows with ``rn``: naming it lets the sub-block windows share this sort
        return self._spec("line", lambda: Window.partitionBy(*self.keys, "__blk").orderBy("__sub", "rn"))

    @property
    def sub_line(self) -> WindowSpec:
        return self._spec("sub", lambda: Window.partitionBy(*self.keys, "__blk", "__sub").orderBy("rn"))

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(as_col(c), k).over(self.line)

    def lead(self, c: Column | str, k: int = 1) -> Column:
        return F.lead(as_col(c), k).over(self.line)

    def rolling(self, n: int) -> WindowSpec:
        return self._spec(n, lambda: self.line.rowsBetween(-(n - 1), 0))

    def full(self, x: Column | str, n: int, value: Column, needed: int | None = None) -> Column:
        """``value`` once the last ``n`` rows hold ``needed`` (all) non-null ``x``."""
        seen = F.count(as_col(x)).over(self.rolling(n))
        return F.when(seen >= (needed or n), value)

    def mean(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.avg(as_col(x)).over(self.rolling(n)))

    def total(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.sum(as_col(x)).over(self.rolling(n)))

    def std(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.stddev_samp(as_col(x)).over(self.rolling(n)))

    def std_pop(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.stddev_pop(as_col(x)).over(self.rolling(n)))

    def highest(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.max(as_col(x)).over(self.rolling(n)))

    def lowest(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.min(as_col(x)).over(self.rolling(n)))

    def pct_change(self, x: Column | str, k: int) -> Column:
        return F.try_divide(as_col(x), self.lag(x, k)) - 1.0

    def with_df(self, df: DataFrame) -> Blocks:
        return replace(self, df=df)

    def own_rows(self) -> DataFrame:
        """Drop the copied neighbours and the layout columns."""
        return self.df.where(~F.col("__copy")).drop("__blk", "__sub", "__copy")


def block_panel(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    back: int = 256,
    ahead: int = 0,
    block_rows: int = 20480,
    sub_rows: int = 1024,
) -> Blocks:
    """Copy each row to every block that must see it and shuffle once on (keys, block).

    ``df`` carries ``rn`` from :func:`with_ordinal`. A row at position p belongs to block
    ``p // block_rows`` and is copied to the blocks reached by ``p + back`` and ``p - ahead``.
    """
    pos = F.col("rn") - 1
    own = F.floor(pos / block_rows)
    first = F.greatest(F.floor((pos - ahead) / block_rows), F.lit(0))
    last = F.floor((pos + back) / block_rows)
    spread = df.select("*", own.alias("__own"), F.explode(F.sequence(first, last)).alias("__blk"))
    laid = spread.select(
        *df.columns,
        "__blk",
        F.floor(pos / sub_rows).alias("__sub"),
        (F.col("__blk") != F.col("__own")).alias("__copy"),
    )
    return Blocks(laid, tuple(keys), sub_rows, block_rows, back)
