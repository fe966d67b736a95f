"""Ordered per-series work without one task per series.

A series (one ticker) may hold a third of all rows, so no operator here sorts a
whole series in one task.  Rows are first put in time buckets; a small table of
(series, bucket, count) gives every bucket its exact row position, and from it:

* ``in_blocks``  bounded frames: runs of buckets form blocks, neighbours are
  copied in as a halo as wide as the longest frame, windows run per block.
* ``running``    unbounded frames: partial result per bucket, a prefix over the
  bucket table, then an in-bucket window that starts from that prefix.

Both are exact.  The full data is shuffled once, by (series, block) or
(series, bucket); only the bucket table is ever windowed by series alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import stage
from .spread import salted_join


@dataclass(frozen=True)
class Layout:
    """How a frame is cut: series keys, order columns, bucket width, block rows.

    ``order`` must be unique within a series; its first column drives the
    buckets (``bucket`` seconds for times, ``bucket`` units for numbers).
    """

    keys: tuple[str, ...] = ("ticker",)
    order: tuple[str, ...] = ("ts",)
    bucket: int = 7 * 86400
    rows: int = 65536
    numeric: bool = False
    descending: bool = False

    def bucket_of(self) -> Column:
        head = F.col(self.order[0])
        units = head.cast("double") if self.numeric else head.cast("timestamp").cast("long")
        b = F.floor(units / F.lit(self.bucket)).cast("long")
        return -b if self.descending else b

    def sort(self) -> list[Column]:
        return [F.col(c).desc() if self.descending else F.col(c).asc() for c in self.order]

    def with_(self, **kw) -> Layout:
        return replace(self, **kw)


BARS = Layout()
DAILY = Layout(bucket=365 * 86400)


def _bucket_positions(df: DataFrame, lay: Layout) -> DataFrame:
    """(keys, _b, _n, _p0): rows per bucket and the position of its first row, of series of
    more than one block."""
    counts = df.groupBy(*lay.keys, lay.bucket_of().alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*lay.keys)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    long = counts.withColumns({"_p0": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)})
    return long.where(F.col("_all") > lay.rows).drop("_all")


def block_plan(df: DataFrame, back: int, ahead: int, lay: Layout) -> DataFrame:
    """(keys, _b, _p0, _own, _blk): every block a bucket of a series of more than one block
    belongs to or borders on."""
    rows = F.lit(lay.rows)
    plan = _bucket_positions(df, lay).withColumn("_own", F.floor(F.col("_p0") / rows).cast("long"))
    first = F.min("_p0").over(Window.partitionBy(*lay.keys, "_own"))
    plan = plan.withColumn("_s0", first)
    own = F.col("_own")
    last_back = F.floor((F.col("_p0") + F.col("_n") + F.lit(back - 1)) / rows).cast("long")
    # earlier blocks whose last row is fewer than `ahead` rows before this bucket
    near = F.when(F.col("_p0") - F.col("_s0") < ahead, own - 1).otherwise(own)
    far = F.greatest(F.floor((F.col("_p0") - F.lit(ahead)) / rows).cast("long") - 1, F.lit(0))
    low = F.when(F.col("_p0") - ahead < own * rows, F.least(near, far)).otherwise(near) if ahead else own
    high = F.greatest(last_back, own) if back else own
    blocks = F.sequence(F.greatest(low, F.lit(0)), high)
    return plan.select(*lay.keys, "_b", "_p0", "_own", F.explode(blocks).alias("_blk"))


def in_blocks(
    df: DataFrame,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    back: int = 0,
    ahead: int = 0,
    lay: Layout = BARS,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Run ``fn(frame, w)`` where every frame of ``w`` reaches at most ``back`` rows
    behind and ``ahead`` rows past the current one.

    ``fn`` must keep the helper columns (_b, _own, _blk); ``_pos`` is the exact
    0-based row position within the series.  ``beside`` is a table of one row for each
    series that has one; its columns are joined to the narrow rows, others are dropped.
    """
    d, w = block_frame(df, back=back, ahead=ahead, lay=lay, beside=beside)
    return finish_blocks(fn(d, w))


def block_frame(df: DataFrame, *, back: int = 0, ahead: int = 0, lay: Layout = BARS, beside: DataFrame | None = None) -> tuple[DataFrame, WindowSpec]:
    """The two halves of ``in_blocks`` for callers that need them apart."""
    # the shuffle the windows need anyway, stated so that ``along_blocks`` may rely on it
    placed = _placed(df, back, ahead, lay, beside)
    w = Window.partitionBy(*lay.keys, "_blk").orderBy(*lay.sort())
    return placed.withColumn("_pos", F.first("_p0").over(w) + F.row_number().over(w) - 1), w


def finish_blocks(d: DataFrame) -> DataFrame:
    """Drop halo copies and helper columns."""
    return d.where("_own = _blk").drop("_b", "_p0", "_own", "_blk", "_pos")


def _placed(df: DataFrame, back: int, ahead: int, lay: Layout, beside: DataFrame | None = None) -> DataFrame:
    """Rows dealt to their blocks.  A series of up to ``rows`` rows is one block; the plan of
    longer ones is a stored table, so Spark knows its size and the rows are shuffled once."""
    d = df.withColumn("_b", lay.bucket_of()).dropna(subset=[*lay.keys, "_b"])
    plan = stage(block_plan(d, back, ahead, lay))
    if lay.keys and plan.isEmpty():
        zero = F.lit(0).cast("long")
        d = d.repartition(*lay.keys)  # the join needs no other shuffle
        d = d.join(beside, list(lay.keys)) if beside is not None else d
        return d.withColumns({"_p0": zero, "_own": zero, "_blk": zero})
    d = salted_join(d, beside, list(lay.keys)) if beside is not None else d
    d = d.join(plan, [*lay.keys, "_b"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_p0", "_own", "_blk")}).repartition(*lay.keys, "_blk")


def block_groups(df: DataFrame, *, back: int = 0, ahead: int = 0, lay: Layout = BARS) -> tuple[DataFrame, list[str]]:
    """Rows with their block and halo copies, and the grouping keys: each group is
    bounded by block rows + halo, so it may go to ``applyInPandas``."""
    placed, _ = block_frame(df, back=back, ahead=ahead, lay=lay)
    return placed.withColumn("_halo", F.col("_own") != F.col("_blk")), [*lay.keys, "_blk"]


#: Rows of the whole blocks that ``along_blocks`` works at once.
PACK_ROWS = 1 << 14


#: Types of results of ``along_blocks``.
ARROW = {T.DoubleType(): pa.float64(), T.ArrayType(T.DoubleType()): pa.list_(pa.float64()), T.ArrayType(T.DateType()): pa.list_(pa.date32())}


def _column(x: np.ma.MaskedArray, kind: pa.DataType) -> pa.Array:
    """A result as Arrow; a matrix is a column of lists, one for each row."""
    flat = kind.value_type if x.ndim > 1 else kind
    value = pa.array(x.data.ravel(), pa.float64(), mask=np.ma.getmaskarray(x).ravel())
    if flat != pa.float64():  # days
        value = value.cast(pa.int32()).cast(flat)
    return value if x.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), value).cast(kind)


def along_blocks(d: DataFrame, inputs: list[str], names: list[str] | dict[str, T.DataType], fn: Callable[..., list[np.ma.MaskedArray]], keys: tuple[str, ...] = ("ticker",), order: str = "ts", heads: bool = False) -> DataFrame:
    """Add columns ``names``: ``fn(back, *inputs)`` over many whole blocks at once.  They are
    doubles, or of the types given (arrays of doubles or of dates as days: a matrix).

    ``d`` is a frame of ``block_frame``.  The rows of a block lie together, in order; ``back``
    counts the rows of its block before each row; inputs and results are doubles with nulls
    masked.  A pack holds whole blocks, so it is bounded by PACK_ROWS and a block.  With
    ``heads`` a result has one value a block, and only the first row of each comes back.
    """
    types = names if isinstance(names, dict) else dict.fromkeys(names, T.DoubleType())
    kinds = {n: ARROW[t] for n, t in types.items()}
    schema = T.StructType([*d.schema.fields, *[T.StructField(n, t) for n, t in types.items()]])
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    rows = d.withColumn("_back", F.row_number().over(w) - 1).sortWithinPartitions(*keys, "_blk", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def worked(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(part)
            back = t.column("_back").to_numpy()
            given = [np.ma.array(t.column(c).cast(pa.float64()).to_numpy(), mask=t.column(c).is_null().to_numpy()) for c in inputs]
            t = (t.filter(pa.array(back == 0)) if heads else t).drop_columns(["_back"])
            for (name, kind), x in zip(kinds.items(), fn(back, *given)):
                t = t.append_column(name, _column(x, kind))
            yield from t.to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(b.column("_back").to_numpy(zero_copy_only=False) == 0)
            if held and len(starts) and sum(h.num_rows for h in held) + int(starts[-1]) >= PACK_ROWS:
                yield from worked([*held, b.slice(0, int(starts[-1]))])
                held = []
                b = b.slice(int(starts[-1]))
            held.append(b)
        if held:
            yield from worked(held)

    return rows.mapInArrow(run, schema)


def trailing_moments(back: np.ndarray, x: np.ma.MaskedArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, squares about the mean) of the last ``n`` rows of each row's block, nulls left out.

    Values are taken up oldest first, the sum as it is and the squares from running moments,
    as Spark's own aggregates do, so the last digits agree with its windows.
    """
    size = len(x)
    there = ~np.ma.getmaskarray(x)
    value = np.where(there, x.data, 0.0)
    count, total, mean, m2 = (np.zeros(size) for _ in range(4))
    with np.errstate(all="ignore"):
        for k in range(min(n, int(back.max(initial=0)) + 1) - 1, -1, -1):
            ok = (back[k:] >= k) & there[: size - k]
            v = value[: size - k]
            count[k:] += ok
            total[k:] += np.where(ok, v, 0.0)
            delta = np.where(ok, v - mean[k:], 0.0)
            step = delta / np.maximum(count[k:], 1.0)
            mean[k:] += step
            m2[k:] += delta * (delta - step)
    return count, total, m2


def trailing_stats(back: np.ndarray, x: np.ma.MaskedArray, n: int, least: int) -> tuple[np.ma.MaskedArray, np.ma.MaskedArray]:
    """(mean, sample deviation) of ``trailing_moments``; null where fewer than ``least`` (two or
    more for the deviation) values are there."""
    count, total, m2 = trailing_moments(back, x, n)
    few = count < least
    with np.errstate(all="ignore"):
        return np.ma.array(total / count, mask=few), np.ma.array(np.sqrt(m2 / (count - 1)), mask=few)


def with_position(df: DataFrame, name: str = "pos", lay: Layout = BARS) -> DataFrame:
    """Exact 0-based position of each row in its series."""
    return in_blocks(df, lambda d, w: d.withColumn(name, F.col("_pos")), lay=lay)


_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, aggs: dict[str, tuple[str, Column]], lay: Layout = BARS, *, exclusive: bool = False) -> DataFrame:
    """Add running aggregates over all rows up to the current one.

    ``aggs`` maps an output name to (kind, expression); kinds are ``sum``,
    ``count``, ``max``, ``min``, ``last`` and ``first`` (both skip nulls).
    ``exclusive`` leaves the current row out.
    """
    d = df.withColumn("_b", lay.bucket_of())
    names = {name: f"_x{i}" for i, name in enumerate(aggs)}
    for name, (_, expr) in aggs.items():
        d = d.withColumn(names[name], expr)
    order_key = F.struct(*[F.col(c) for c in lay.order])
    newest, oldest = (F.min_by, F.max_by) if lay.descending else (F.max_by, F.min_by)

    partial = []
    for name, (kind, _) in aggs.items():
        x = F.col(names[name])
        if kind in ("last", "first"):
            pick = newest if kind == "last" else oldest
            partial.append(pick(x, F.when(x.isNotNull(), order_key)).alias(f"_p{names[name]}"))
        else:
            fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
            partial.append(fn(x).alias(f"_p{names[name]}"))
    buckets = d.groupBy(*lay.keys, "_b").agg(*partial)
    before = Window.partitionBy(*lay.keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, (kind, _) in aggs.items():
        p = F.col(f"_p{names[name]}")
        if kind == "last":
            c = F.last(p, ignorenulls=True).over(before)
        elif kind == "first":
            c = F.first(p, ignorenulls=True).over(before)
        else:
            c = _MERGE[kind](p).over(before)
        carries.append(c.alias(f"_c{names[name]}"))
    buckets = buckets.select(*lay.keys, "_b", *carries)

    inside = Window.partitionBy(*lay.keys, "_b").orderBy(*lay.sort()).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0
    )
    joined = d.join(buckets, [*lay.keys, "_b"])
    outs = []
    for name, (kind, _) in aggs.items():
        x, c = F.col(names[name]), F.col(f"_c{names[name]}")
        if kind == "last":
            v = F.coalesce(F.last(x, ignorenulls=True).over(inside), c)
        elif kind == "first":
            v = F.coalesce(c, F.first(x, ignorenulls=True).over(inside))
        elif kind == "max":
            v = F.greatest(F.max(x).over(inside), c)
        elif kind == "min":
            v = F.least(F.min(x).over(inside), c)
        elif kind == "count":
            v = F.coalesce(c, F.lit(0)) + F.count(x).over(inside)
        else:
            s = F.sum(x).over(inside)
            v = F.when(s.isNull() & c.isNull(), None).otherwise(F.coalesce(c, F.lit(0)) + F.coalesce(s, F.lit(0)))
        outs.append(v.alias(name))
    keep = [c for c in df.columns if c not in aggs]
    return joined.select(*keep, *outs)


def fill_forward(df: DataFrame, cols: list[str], lay: Layout = BARS) -> DataFrame:
    """Carry the last non-null value of each column forward."""
    filled = running(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, lay)
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
