"""Parquet and JSON-lines datasets: bars, flow bars, feature panels, fold diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OHLCV
from ..operators.bars import keep_last
from .stages import scratch, stage  # noqa: F401

FLOW = ("buy_count", "sell_count", "count_imbalance")


def _replacing(df: DataFrame):
    """A writer that replaces the partitions it holds and no others, whatever the session says."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def save_bars(df: DataFrame, path: str, partition: tuple[str, ...] = ("timeframe", "ticker")) -> None:
    """Partitioned dataset; only the partitions in ``df`` are replaced.  With very many
    tickers partition by timeframe alone and let row-group statistics prune."""
    _replacing(df.select("timeframe", "ticker", "ts", *OHLCV)).partitionBy(*partition).parquet(path)


def load_bars(spark: SparkSession, path: str, timeframe: str, ticker: str | None = None) -> DataFrame:
    """A missing ticker is simply an empty result of the partition filter."""
    d = spark.read.parquet(path).where(F.col("timeframe") == timeframe)
    d = d.where(F.col("ticker") == ticker) if ticker else d
    return d.select("ticker", "ts", *OHLCV)


def save_flow(df: DataFrame, path: str) -> None:
    have = [c for c in OHLCV + FLOW if c in df.columns]
    _replacing(df.select("ticker", "ts", *have)).partitionBy("ticker").parquet(path)


def load_flow(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select("ticker", "ts", *[c for c in OHLCV + FLOW if c in d.columns])


def save_panel(df: DataFrame, path: str, version: int) -> None:
    _replacing(df.withColumn("panel_version", F.lit(version))).partitionBy("panel_version", "ticker").parquet(path)


def load_panel(spark: SparkSession, path: str, version: int, tickers: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path).where(F.col("panel_version") == version)
    return (d.where(F.col("ticker").isin(tickers)) if tickers else d).drop("panel_version")


def append_diagnostics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def diagnostics_rollup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).groupBy("bottleneck").agg(F.count(F.lit(1)).alias("n"), F.avg("net_bps").alias("mean_net_bps"))


def resume_load(spark: SparkSession, path: str, incoming: DataFrame) -> DataFrame:
    """Merge newer bars into a stored dataset: stored rows, then incoming rows at or after
    each ticker's last stored time, keep-last.  Returns the merged frame."""
    stored = spark.read.parquet(path).select("ticker", "ts", *OHLCV)
    last = stored.groupBy("ticker").agg(F.max("ts").alias("_last"))
    fresh = incoming.join(last, "ticker", "left").where(F.col("_last").isNull() | (F.col("ts") >= F.col("_last")))
    both = stored.withColumn("_seq", F.lit(0)).unionByName(fresh.select("ticker", "ts", *OHLCV).withColumn("_seq", F.lit(1)))
    return keep_last(both, ["ticker", "ts"], ["_seq"]).drop("_seq")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark resolves the path to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def upsert_days(spark: SparkSession, path: str, incoming: DataFrame, order: tuple[str, ...] = ()) -> None:
    """Merge bars (ticker, ts, values) into a dataset with one partition a day; incoming rows win.

    Only days of ``incoming`` are read and rewritten: its first and last day prune the scan,
    a semi join does the rest.  The merged days are written aside first and then replace
    theirs, so a run that dies leaves each day old or new, and running it again gives what
    one run gives.  ``order`` decides among incoming rows of one ticker and time, which must
    be unique without it.  Rows without a time belong to no day and are left out; an empty
    input changes nothing.
    """
    fresh = incoming.where("ts is not null").withColumn("day", F.to_date("ts"))
    if order:
        fresh = keep_last(fresh, ["ticker", "ts"], list(order))
    fresh = stage(fresh.select("ticker", "ts", *OHLCV, "day"))
    lo, hi = fresh.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return
    both = fresh.withColumn("_seq", F.lit(1))
    if exists(spark, path):
        stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("day").between(lo, hi))
        stored = stored.join(fresh.select("day").distinct(), "day", "left_semi")
        both = both.unionByName(stored.withColumn("_seq", F.lit(0)))
    merged = stage(keep_last(both, ["ticker", "ts"], ["_seq"]).drop("_seq"))
    _replacing(merged).partitionBy("day").parquet(path)


def load_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("ticker", "ts", *OHLCV)


def load_plan(df: DataFrame, start: str, end: str, chunk_days: int) -> DataFrame:
    """Rows (…, start, end) to chunks of ``chunk_days`` days, ends included."""
    starts = F.sequence(F.col(start), F.col(end), F.expr(f"interval {int(chunk_days)} days"))
    d = df.withColumn("chunk_start", F.explode(starts))
    return d.withColumn("chunk_end", F.least(F.date_add("chunk_start", chunk_days - 1), F.col(end)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
