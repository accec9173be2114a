"""Null-safe arithmetic on columns.

The library knows one kind of missing value: NULL. Anything that could turn into NaN or
infinity is mapped to NULL where it arises, because Spark sorts NaN last and aggregates
propagate it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
TRADING_DAYS = 252
LN2 = 0.6931471805599453


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sdiv(a: Column | str | float, b: Column | str | float) -> Column:
    """Division that gives NULL for a zero divisor (plain division raises in ANSI mode)."""
    num = a if isinstance(a, (str, Column)) else F.lit(float(a))
    den = b if isinstance(b, (str, Column)) else F.lit(float(b))
    return F.try_divide(as_col(num), as_col(den))


def ratio(a: Column | str, b: Column | str, eps: float = EPS) -> Column:
    """``a / (b + eps)``: the smoothed ratio used by most normalised features."""
    return sdiv(as_col(a), as_col(b) + F.lit(eps))


def finite(c: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    x = as_col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def to_number(c: Column | str) -> Column:
    """Anything that is not a finite number becomes NULL."""
    return finite(as_col(c).try_cast("double"))


def safe_sqrt(c: Column | str) -> Column:
    x = as_col(c)
    return F.when(x >= 0, F.sqrt(x))


def flag(cond: Column, null_as_zero: bool = False) -> Column:
    """0/1 integer; an unknown condition stays NULL unless ``null_as_zero``."""
    out = cond.cast("int")
    return F.coalesce(out, F.lit(0)) if null_as_zero else out


def clip(c: Column | str, lo: float, hi: float) -> Column:
    x = as_col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def same_sign(a: Column | str, b: Column | str) -> Column:
    return F.signum(as_col(a)) == F.signum(as_col(b))


def magnitude_bucket(c: Column | str, steps: int = 4096) -> Column:
    """Monotone bucket number of a double: octave and ``steps`` slices inside the octave.

    It depends on the value alone, so a recomputed task puts a row into the same bucket. The
    slice is taken relative to the rounded octave, which keeps the mapping monotone even where
    ``log2`` rounds up at a power of two.
    """
    x = as_col(c)
    mag = F.abs(x)
    octave = F.greatest(F.floor(F.log2(mag)), F.lit(-1000))
    inside = F.floor((mag / F.pow(F.lit(2.0), octave.cast("double")) - 1.0) * steps)
    rank = (octave + 1001) * steps + inside + 1
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("long"))
        .when(x == 0, F.lit(0).cast("long"))
        .otherwise((F.signum(x) * rank).cast("long"))
    )


def safe_corr(a: Column | str, b: Column | str, window=None) -> Column:
    """Pearson correlation over complete pairs; NULL where a side is constant.

    The built-in ``corr`` divides by zero on constant input, which raises in ANSI mode.
    """
    x = F.when(as_col(b).isNotNull(), as_col(a))
    y = F.when(as_col(a).isNotNull(), as_col(b))
    parts = (F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y))
    if window is not None:
        parts = tuple(p.over(window) for p in parts)
    cov, sx, sy = parts
    return F.try_divide(cov, sx * sy)


def deviation(x: Column | str, mean: Column) -> Column:
    """``x - mean``, and exactly 0 where the two differ by rounding noise only.

    A constant window has a spread of about 0; dividing the noise of its mean by a tiny epsilon
    would show up as a non-zero score.
    """
    d = as_col(x) - mean
    return F.when(F.abs(d) <= 1e-12 * F.abs(mean), F.lit(0.0)).otherwise(d)
