"""Guarded rolling expressions over an ordered window spec."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: str | Column, lo: float | Column, hi: float | Column) -> Column:
    """Null stays null (greatest/least alone would skip it)."""
    x = col(x)
    lo_, hi_ = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.greatest(lo_, F.least(hi_, x)))


def bound(x: str | Column, lo: float, hi: float) -> Column:
    """Clip of a value that is never null (scores, probabilities); half the expression."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), col(x)))


def nz(x: str | Column) -> Column:
    """Zero becomes null, for divisors."""
    return F.nullif(col(x), F.lit(0.0))


def zero(x: str | Column, value: float = 0.0) -> Column:
    return F.coalesce(col(x), F.lit(value))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def guarded(agg: Column, x: str | Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(col(x)).over(frame) >= least, agg.over(frame))


def rmean(x, w, n, m=None) -> Column:
    return guarded(F.avg(col(x)), x, trailing(w, n), n if m is None else m)


def rsum(x, w, n, m=None) -> Column:
    return guarded(F.sum(col(x)), x, trailing(w, n), n if m is None else m)


def rstd(x, w, n, m=None) -> Column:
    return guarded(F.stddev_samp(col(x)), x, trailing(w, n), n if m is None else m)


def rmedian(x, w, n, m=None) -> Column:
    """Exact median of a bounded frame: sorted frame values, middle one or two."""
    frame = trailing(w, n)
    values = F.sort_array(F.collect_list(col(x)).over(frame))
    size = F.count(col(x)).over(frame)
    low = F.get(values, F.floor((size - 1) / 2).cast("int"))
    high = F.get(values, F.floor(size / 2).cast("int"))
    return F.when(size >= (n if m is None else m), low + (high - low) * 0.5)


def change(x, w, k: int) -> Column:
    return col(x) / nz(F.lag(col(x), k).over(w)) - 1


def log_return(x, w, k: int = 1) -> Column:
    return F.ln(col(x) / F.lag(col(x), k).over(w))


def epoch(x: str | Column) -> Column:
    return col(x).cast("timestamp").cast("long")
