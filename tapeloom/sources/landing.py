"""Landed vendor files to clean bars; fetching them is someone else's job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OHLCV
from ..operators.bars import keep_last

NTZ = "timestamp_ntz"


def parse_klines(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One JSON array per row: [open_ms, o, h, l, c, volume, _, _, trades, taker_buy, ...].

    Taker volume splits the trade count into buys and sells.
    """
    a = df.withColumn("_a", F.from_json(payload, "array<string>")).drop(payload)
    at = lambda i: F.get("_a", F.lit(i)).cast("double")
    vol, trades, taker = at(5), at(8), at(9)
    buys = F.when((vol > 0) & (trades > 0), trades * taker / vol).otherwise(0.0)
    sells = F.when((vol > 0) & (trades > 0), trades - buys).otherwise(0.0)
    keep = [c for c in df.columns if c != payload]
    d = a.select(
        *keep,
        F.timestamp_millis(F.get("_a", F.lit(0)).cast("bigint")).cast(NTZ).alias("ts"),
        *[at(i).alias(n) for i, n in enumerate(OHLCV, start=1)],
        buys.alias("buy_count"),
        sells.alias("sell_count"),
    )
    both = F.col("buy_count") + F.col("sell_count")
    return d.withColumn(
        "count_imbalance", F.when(both > 0, (F.col("buy_count") - F.col("sell_count")) / both).otherwise(0.0)
    )


def _first_of(df: DataFrame, *names: str) -> Column | None:
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n in have:
            return F.col(f"`{have[n]}`")
    return None


def parse_export(df: DataFrame, seq: str | None = None) -> DataFrame:
    """Delimited export (all strings): headers with or without angle brackets, dates and
    times that lost leading zeros, unparsable rows dropped, last row per time kept."""
    pick = lambda n: _first_of(df, f"<{n}>", n)
    day, clock = pick("date"), pick("time")
    if clock is not None:
        ts = F.try_to_timestamp(F.concat(F.lpad(day, 8, "0"), F.lpad(clock, 6, "0")), F.lit("yyyyMMddHHmmss"))
    else:
        ts = F.try_to_timestamp(day, F.lit("yyyyMMdd"))
    num = lambda n: F.expr(f"try_cast(`{pick_name(df, n)}` as double)")
    d = df.select(
        pick("ticker").alias("ticker"),
        ts.cast(NTZ).alias("ts"),
        *[num(n).alias(n) for n in OHLCV[:4]],
        num("vol").alias("volume"),
        (F.col(seq) if seq else F.monotonically_increasing_id()).alias("_seq"),
    ).where(F.col("ts").isNotNull())
    return keep_last(d, ["ticker", "ts"], ["_seq"]).drop("_seq").where(F.col("close").isNotNull())


def pick_name(df: DataFrame, n: str) -> str:
    have = {c.lower(): c for c in df.columns}
    return have.get(f"<{n}>") or have[n]


def normalize_vendor(df: DataFrame, *, zone: str | None = None, seq: str = "seq") -> DataFrame:
    """Lower-case names, adjusted close as close, zone to naive UTC, keep-last, no idle bars."""
    low = {c: c.lower() for c in df.columns}
    has_close = "close" in low.values()
    names = {c: ("close" if n == "adj close" and not has_close else n) for c, n in low.items()}
    d = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    ts = F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone) if zone else F.col("ts")
    d = d.select("ticker", ts.cast(NTZ).alias("ts"), *[F.col(c).cast("double").alias(c) for c in OHLCV if c in d.columns], seq)
    return keep_last(d, ["ticker", "ts"], [seq]).drop(seq).where(F.col("volume") > 0)


BAR_RECORD = "struct<timestamp:string," + ",".join(f"{c}:string" for c in OHLCV) + ">"


def parse_records(df: DataFrame, payload: str = "payload", seq: str = "seq") -> DataFrame:
    """JSON array of bar records whose numbers are plain or wrapped as {"value": ...}."""
    d = df.select("ticker", seq, F.posexplode(F.from_json(payload, f"array<{BAR_RECORD}>")).alias("_i", "_r"))
    num = lambda c: F.coalesce(
        F.expr(f"try_cast(coalesce(get_json_object(_r.`{c}`, '$.value'), _r.`{c}`) as double)"), F.lit(0.0)
    ).alias(c)
    d = d.select("ticker", F.expr("try_cast(_r.timestamp as timestamp)").cast(NTZ).alias("ts"), *[num(c) for c in OHLCV], seq, "_i")
    return keep_last(d.where(F.col("ts").isNotNull()), ["ticker", "ts"], [seq, "_i"]).drop(seq, "_i")


def parse_candle_pages(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON pages {"candles": {"columns": [...], "data": [[...], ...]}} by column name."""
    page = F.from_json(payload, "struct<candles:struct<columns:array<string>,data:array<array<string>>>>")
    d = df.select("ticker", page.alias("_p")).select("ticker", F.col("_p.candles.columns").alias("_c"), F.explode("_p.candles.data").alias("_d"))
    at = lambda n: F.get("_d", (F.array_position("_c", F.lit(n)) - 1).cast("int"))
    d = d.select(
        "ticker",
        F.try_to_timestamp(at("begin")).cast(NTZ).alias("ts"),
        *[at(n).alias(f"_{n}") for n in OHLCV],
    ).where(F.col("ts").isNotNull())
    return d.select("ticker", "ts", *[F.expr(f"try_cast(`_{n}` as double)").alias(n) for n in OHLCV])
