"""Query registry, the shared input views and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OHLCV
from ..functions.frames import epoch
from ..operators.bars import ticks_to_bars
from ..operators.blocks import Layout
from ..session import prepare
from ..sources.store import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

INTRADAY = Layout(bucket=2 * 86400)
DAILY = Layout(bucket=365 * 86400)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its check."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(x: str | Column, d: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), d) + F.lit(0.0)


def out(df: DataFrame, keys: list[str], values: list[str] = (), ints: list[str] = (), d: int = 6) -> DataFrame:
    """Keys as they are, values rounded, counts and flags as bigint."""
    return df.select(*keys, *[rnd(v, d).alias(v) for v in values], *[F.col(i).cast("bigint").alias(i) for i in ints])


# ---- SQL text helpers -------------------------------------------------------


def r(expr: str, d: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {d}) + 0.0)"


def sel(values: list[str], d: int = 6) -> str:
    return ", ".join(f"{r(v, d)} AS {v}" for v in values)


def ints(names: list[str]) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


W = "(PARTITION BY ticker ORDER BY ts)"


def over(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sroll(fn: str, x: str, n: int, m: int | None = None) -> str:
    call = f"quantile_cont({x}, 0.5)" if fn == "median" else f"{fn}({x})"
    return f"(CASE WHEN count({x}) OVER {over(n)} >= {n if m is None else m} THEN {call} OVER {over(n)} END)"


def smean(x, n, m=None):
    return sroll("avg", x, n, m)


def ssum(x, n, m=None):
    return sroll("sum", x, n, m)


def sstd(x, n, m=None):
    return sroll("stddev_samp", x, n, m)


def smedian(x, n, m=None):
    return sroll("median", x, n, m)


def sclip(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END)"


# ---- views over the given tables --------------------------------------------

# five-minute bars, one series per event type; a price near 100 from the event value
SQL_TICKS = """ticks AS (SELECT event_type AS ticker, ts, event_id, 100 + value / 97 AS px,
  CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS buy, CASE WHEN event_id % 3 = 1 THEN 1.0 ELSE 0.0 END AS sell FROM events)"""
SQL_BARS = f"""{SQL_TICKS},
bars AS (SELECT ticker, time_bucket(INTERVAL '5 minutes', ts) AS ts, first(px ORDER BY ts, event_id) AS open, max(px) AS high,
  min(px) AS low, last(px ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"""
SQL_FLOW = """flow AS (SELECT ticker, time_bucket(INTERVAL '5 minutes', ts) AS ts, CAST(sum(buy) AS DOUBLE) AS buy_count,
  CAST(sum(sell) AS DOUBLE) AS sell_count FROM ticks GROUP BY 1, 2)"""
# daily bars, one series per supplier
SQL_DAILY = """lines AS (SELECT 'S' || l_suppkey AS ticker, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
  100 + l_extendedprice / l_quantity / 9973 AS px FROM lineitem),
daily AS (SELECT ticker, ts, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume FROM lines GROUP BY 1, 2)"""


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("ticker"),
        "ts",
        "event_id",
        (F.lit(100) + F.col("value") / 97).alias("px"),
        F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0).alias("buy"),
        F.when(F.col("event_id") % 3 == 1, 1.0).otherwise(0.0).alias("sell"),
    )


def bars(spark: SparkSession, sf: str, freq: str = "5 minutes") -> DataFrame:
    """Bars are a stored stage: the operators read them several times, the ticks once."""
    return stage(ticks_to_bars(ticks(spark, sf), freq, price="px", tie=("event_id",)))


def flow(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf)
    return (
        t.groupBy("ticker", F.window("ts", "5 minutes").alias("_w"))
        .agg(F.sum("buy").alias("buy_count"), F.sum("sell").alias("sell_count"))
        .select("ticker", F.col("_w.start").alias("ts"), "buy_count", "sell_count")
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    line = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    # a supplier has hardly two lines a day: the lines are shorter than sums of them, so they are shuffled as they are
    li = table(spark, sf, "lineitem").select(*line).repartition("l_suppkey", "l_shipdate")
    px = F.lit(100) + F.col("l_extendedprice") / F.col("l_quantity") / 9973
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return stage(
        li.groupBy("l_suppkey", "l_shipdate")
        .agg(
            F.min_by(px, tie).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, tie).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
        .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.col("l_shipdate").alias("ts"), *OHLCV)
    )


# deterministic stand-ins for model scores and regime probabilities
def stand_in(multiplier: int, shift: int = 0) -> Column:
    h = F.floor(epoch("ts") / 300) * multiplier + F.ascii(F.substring("ticker", 2, 1)) * 104729 + shift
    return F.pmod(h, F.lit(1000)).cast("double") / 1000.0


def sql_stand_in(multiplier: int, shift: int = 0) -> str:
    return (
        f"(CAST(((CAST(epoch(ts) AS BIGINT) // 300) * {multiplier} + ascii(substr(ticker, 2, 1)) * 104729 + {shift}) % 1000 AS DOUBLE) / 1000.0)"
    )


def with_scores(df: DataFrame) -> DataFrame:
    """proba, proba_short, three regime probabilities, confidence, vol ratio, risk flag."""
    a, b, c = stand_in(131), stand_in(977), stand_in(613)
    total = a + b + c + 0.3
    return df.select(
        *df.columns,
        stand_in(7919).alias("proba"),
        stand_in(3571, 500).alias("proba_short"),
        ((a + 0.1) / total).alias("p_imp"),
        ((b + 0.1) / total).alias("p_mr"),
        ((c + 0.1) / total).alias("p_st"),
        stand_in(271).alias("conf"),
        (stand_in(433) * 1.5 + 0.5).alias("vol_ratio"),
        (stand_in(59) * 0.5).alias("vol_ann"),
        (stand_in(89) > 0.4).alias("risk_on"),
    )


def sql_scores(src: str, name: str = "scored") -> str:
    a, b, c = sql_stand_in(131), sql_stand_in(977), sql_stand_in(613)
    return f"""{name}_0 AS (SELECT *, {a} AS _a, {b} AS _b, {c} AS _c FROM {src}),
{name} AS (SELECT * EXCLUDE (_a, _b, _c), {sql_stand_in(7919)} AS proba, {sql_stand_in(3571, 500)} AS proba_short,
  (_a + 0.1) / (_a + _b + _c + 0.3) AS p_imp, (_b + 0.1) / (_a + _b + _c + 0.3) AS p_mr, (_c + 0.1) / (_a + _b + _c + 0.3) AS p_st,
  {sql_stand_in(271)} AS conf, {sql_stand_in(433)} * 1.5 + 0.5 AS vol_ratio, {sql_stand_in(59)} * 0.5 AS vol_ann,
  {sql_stand_in(89)} > 0.4 AS risk_on FROM {name}_0)"""
