"""Structured Streaming versions of the ingest and of the stateful operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.bars import keep_last
from ..plans import regime_fit
from ..sources.store import exists


def drain(stream: DataFrame, path: str, *, mode: str = "append", batch: Callable | None = None) -> None:
    """Run a stream over what is there now: to Parquet files, or through ``batch``."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True)
    q = w.foreachBatch(batch).start() if batch else w.format("parquet").option("path", f"{path}/data").start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def tick_bars(ticks: DataFrame, freq: str = "5 minutes", late: str = "10 minutes", tie: str = "event_id", price: str = "px") -> DataFrame:
    """Tumbling OHLCV bars; a bar is final once the watermark passes its end."""
    order = F.struct("ts", tie)
    return (
        ticks.withWatermark("ts", late)
        .groupBy("ticker", F.window("ts", freq).alias("_w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("ticker", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ingest_keep_last(stream: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Append each batch under its epoch; a replayed epoch overwrites itself, so replays
    change nothing.  ``read_keep_last`` gives the current rows."""

    def save(batch: DataFrame, epoch: int) -> None:
        keep_last(batch, keys, order).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    drain(stream, path, mode="append", batch=save)


def _epochs(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows that count, with their epochs, and the last epoch that is compacted (-1: none)."""
    rows = spark.read.parquet(f"{path}/rows").withColumn("epoch", F.col("epoch").cast("bigint"))
    if not exists(spark, f"{path}/compacted"):
        return rows, -1
    upto, folder = spark.read.parquet(f"{path}/compacted").agg(F.max(F.struct("upto", "folder"))).first()[0]
    return spark.read.parquet(folder).unionByName(rows.where(F.col("epoch") > upto)), upto


def read_keep_last(spark: SparkSession, path: str, keys: list[str], order: list[str], by_order: bool = False) -> DataFrame:
    """The current rows: of each key that of the latest epoch, then order; with ``by_order``
    the order decides between epochs too, so late rows do not win by coming late."""
    rows, _ = _epochs(spark, path)
    return keep_last(rows, keys, [*order, "epoch"] if by_order else ["epoch", *order]).drop("epoch")


def compact_keep_last(spark: SparkSession, path: str, keys: list[str], order: list[str], by_order: bool = False) -> None:
    """Fold all epochs so far into one table, so that reads do not grow with their number.

    The table has a folder of its own and counts once the manifest (a row of last epoch and
    folder) names it, so a run that dies changes nothing.  Epochs up to the manifest's are
    no longer read, also if one is replayed; their folders are pruned by partition.  Run it
    between runs of the stream, not while one commits.
    """
    rows, upto = _epochs(spark, path)
    last = spark.read.parquet(f"{path}/rows").agg(F.max(F.col("epoch").cast("bigint"))).first()[0]
    if last is None or last <= upto:
        return
    folder = f"{path}/upto-{last}-{uuid.uuid4().hex}"
    keep_last(rows, keys, [*order, "epoch"] if by_order else ["epoch", *order]).write.parquet(folder)
    spark.createDataFrame([(last, folder)], "upto bigint, folder string").coalesce(1).write.mode("append").parquet(f"{path}/compacted")


NUMPY = {"double": "float64", "int": "int32", "bigint": "int64"}


class InOrder(StatefulProcessor):
    """Rows of a key are held until the watermark has passed them and then go, in time order,
    through ``advance(memory, rows) -> (memory, result)``.

    Held rows are those of the watermark's delay and of the current trigger, packed: one
    entry of the state a batch of rows, with an array of each column.  One timer a key, at
    its earliest held row, calls for them.  So the result does not depend on how the input
    is split into files and triggers.  Rows older than the watermark are dropped, rows of
    one time go by their values.
    """

    def __init__(self, columns: dict[str, str], memory: str):
        self.columns, self.memory_schema = columns, memory
        self.types = {"us": "int64"} | {c: NUMPY[t] for c, t in columns.items()}

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"`{c}` binary" for c in self.types))
        self.due = handle.getValueState("due", "ms bigint")
        self.memory = handle.getValueState("memory", self.memory_schema)

    def _call_at(self, us: int) -> None:
        """Let the timer ring once all rows of this millisecond are behind the watermark."""
        ms = int(us // 1000 + 1)
        now = self.due.get()[0] if self.due.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def _packed(self, columns: list[np.ndarray]) -> tuple:
        return tuple(x.astype(t).tobytes() for x, t in zip(columns, self.types.values()))

    def _unpacked(self, entries: list[tuple]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*entries), self.types.values())]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (names are Spark's)
        for pdf in rows:
            if key[0] is None:
                continue
            us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            # a batch may also hold rows of other keys with nulls, which turn whole numbers to floats
            self.held.appendValue(self._packed([us, *(pdf[c].to_numpy() for c in self.columns)]))
            self._call_at(int(us.min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._unpacked(list(self.held.get()))
        self.due.clear()
        ready = held[0] < upto
        if not ready.all():
            rest = [x[~ready] for x in held]
            self.held.put([self._packed(rest)])
            self._call_at(int(rest[0].min()))
        else:
            self.held.clear()
        if not ready.any():
            return iter(())
        held = [x[ready] for x in held]
        order = np.lexsort(held[::-1])
        rows = {c: x[order] for c, x in zip(self.types, held)}
        memory, result = self.advance(self.memory.get() if self.memory.exists() else None, rows)
        self.memory.update(memory)
        return iter([pd.DataFrame({"ticker": key[0], "ts": rows["us"].astype("datetime64[us]"), **result})])


class RegimeFilter(InOrder):
    """Forward filter; the memory is the last probability vector."""

    def __init__(self, model: dict, dims: tuple[str, ...]):
        super().__init__({c: "double" for c in dims}, "probs array<double>")
        self.model, self.dims = {k: np.asarray(v, dtype=float).tolist() for k, v in model.items()}, list(dims)

    def advance(self, memory, rows):
        m = regime_fit.Chains(*(np.asarray(self.model[k])[None] for k in ("pi", "A", "mean", "cov")))
        p = regime_fit.filtered(m, [np.column_stack([rows[c] for c in self.dims])], None if memory is None else np.asarray(memory[0])[None])[0]
        named = p[:, m.roles()[0]]
        return (p[-1].tolist(),), {"p_imp": named[:, 0], "p_mr": named[:, 1], "p_st": named[:, 2]}


class TransitionCounts(InOrder):
    """Next-state probabilities; the memory is nine pair counts and the last state."""

    def __init__(self):
        super().__init__({"state": "int"}, "counts array<double>, prev int")

    def advance(self, memory, rows):
        now = rows["state"].astype(int)
        held, last = (np.ones(9), -1) if memory is None else (np.asarray(memory[0]), memory[1])
        before = np.concatenate(([last], now[:-1]))
        # one column per pair; a row sees the pairs that ended before it
        pairs = (np.arange(9) == (before * 3 + now)[:, None]) & (before >= 0)[:, None]
        total = held + np.cumsum(pairs, axis=0)
        seen = np.vstack([held, total[:-1]]).reshape(-1, 3, 3)
        row = seen[np.arange(len(now)), now]
        p = row / row.sum(axis=1, keepdims=True)
        return (total[-1].tolist(), int(now[-1])), {"state": now.astype("int32"), "next_impulse": p[:, 0], "next_mean_revert": p[:, 1], "next_stress": p[:, 2]}


def _through(stream: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    """Rows without a time are left out.  Rows without a ticker belong to no series and only
    move the watermark (a closing mark is such a row), so the processor, not a filter that
    Spark would push below the watermark, skips them."""
    d = stream.withWatermark("ts", late).where(F.col("ts").isNotNull()).select("ticker", "ts", *[F.col(c).cast(t).alias(c) for c, t in processor.columns.items()])
    return d.groupBy("ticker").transformWithStateInPandas(processor, f"ticker string, ts timestamp, {schema}", "append", "eventTime")


def regime_filter(stream: DataFrame, model: dict, dims: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """Causal regime probabilities of a fixed model per ticker, in time order behind the watermark."""
    return _through(stream, RegimeFilter(model, dims), "p_imp double, p_mr double, p_st double", late)


def transition_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Causal next-state probabilities per ticker, in time order behind the watermark.  Rows
    without a state are left out."""
    stream = stream.where(F.col("state").isNotNull() | F.col("ticker").isNull())
    return _through(stream, TransitionCounts(), "state int, next_impulse double, next_mean_revert double, next_stress double", late)


def closing_mark(df: DataFrame, after: str = "1 day") -> DataFrame:
    """One row without a ticker, ``after`` the last time of ``df``: landed last, it moves the
    watermark past all rows before it."""
    last = df.agg((F.max("ts") + F.expr(f"interval {after}")).alias("ts"))
    return last.select(*[F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
