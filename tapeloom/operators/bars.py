"""Building, cleaning and reshaping bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import epoch
from .blocks import BARS, Layout, in_blocks, running
from .spread import salted_join, value_positions

NEW_YORK = "America/New_York"


def ticks_to_bars(ticks: DataFrame, freq: str, *, price: str = "price", size: str | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """OHLCV from ticks; without ``size`` the volume is the tick count."""
    order = F.struct("ts", *tie)
    volume = F.sum(size) if size else F.count(F.lit(1)).cast("double")
    return (
        ticks.groupBy("ticker", F.window("ts", freq).alias("_w"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            volume.alias("volume"),
        )
        .select("ticker", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def resample(df: DataFrame, freq: str) -> DataFrame:
    """Coarser bars: first, max, min, last, sum; bars without a close are dropped."""
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("ts"))
    return (
        df.groupBy("ticker", F.window("ts", freq).alias("_w"))
        .agg(
            F.min_by("open", has("open")).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", has("close")).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .where(F.coalesce("open", "high", "low", "close").isNotNull())
        .select("ticker", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def drop_idle(df: DataFrame) -> DataFrame:
    """Drop zero-volume bars, but only of tickers that report volume at all."""
    live = df.groupBy("ticker").agg(F.max(F.col("volume") > 0).alias("_live"))
    keep = F.coalesce(F.col("_live"), F.lit(False))
    return salted_join(df, live, ["ticker"]).where(~keep | (F.col("volume") > 0)).drop("_live")


def resample_drop_idle(df: DataFrame, freq: str = "5 minutes") -> DataFrame:
    return drop_idle(resample(df, freq).where(F.col("close").isNotNull()))


def local_time(ts: str = "ts", zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)


def regular_hours(ts: str = "ts", start: int = 570, end: int = 960, zone: str = NEW_YORK) -> Column:
    """Weekday and start <= minute of day < end on the exchange clock."""
    t = local_time(ts, zone)
    minute = F.hour(t) * 60 + F.minute(t)
    return (F.weekday(t) < 5) & (minute >= start) & (minute < end)


def keep_session(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Round-the-clock classes pass, the rest keep regular hours (columns of the dimension)."""
    d = dim.select("ticker", "asset_class")
    return (
        salted_join(df, d, ["ticker"])
        .where((F.col("asset_class") == "crypto") | regular_hours())
        .drop("asset_class")
    )


def session_of(crypto: Column, ts: str = "ts") -> Column:
    return F.when(crypto, F.to_date(F.col(ts))).otherwise(F.to_date(local_time(ts)))


def with_session(df: DataFrame, dim: DataFrame) -> DataFrame:
    d = dim.select("ticker", (F.col("asset_class") == "crypto").alias("_crypto"))
    return salted_join(df, d, ["ticker"]).withColumn("session", session_of(F.col("_crypto"))).drop("_crypto")


def session_open_flag(w) -> Column:
    prev = F.lag("session").over(w)
    return F.coalesce(prev != F.col("session"), F.lit(True))


def overnight_safe_return(w) -> Column:
    return F.when(~session_open_flag(w), F.ln(F.col("close") / F.lag("close").over(w)))


def session_closes(df: DataFrame) -> DataFrame:
    """One row per (ticker, session): last close and the time it was printed."""
    return df.groupBy("ticker", "session").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("last_ts"))


def tick_only(df: DataFrame) -> DataFrame:
    return df.where((F.col("flow_source") > 0) & (F.coalesce("buy_count", F.lit(0)) + F.coalesce("sell_count", F.lit(0)) > 0))


def tick_only_crypto(df: DataFrame, dim: DataFrame) -> DataFrame:
    d = dim.select("ticker", "asset_class")
    live = (F.col("flow_source") > 0) & (F.coalesce("buy_count", F.lit(0)) + F.coalesce("sell_count", F.lit(0)) > 0)
    return salted_join(df, d, ["ticker"]).where((F.col("asset_class") != "crypto") | live).drop("asset_class")


def common_end(df: DataFrame) -> DataFrame:
    """Cut every ticker at the earliest of the tickers' last bars."""
    end = df.groupBy("ticker").agg(F.max("ts").alias("_e")).agg(F.min("_e"))
    return df.where(F.col("ts") <= end.scalar())


def clean_symbol(x: str) -> Column:
    """Upper-cased letters and digits, 2 to 12 of them; null when the raw name is unsafe."""
    raw = F.upper(F.trim(F.col(x)))
    cleaned = F.regexp_replace(raw, "[^A-Z0-9]", "")
    unsafe = (raw == "") | F.contains(raw, F.lit("..")) | F.contains(raw, F.lit("/")) | F.contains(raw, F.lit("\\"))
    return F.when(~unsafe & cleaned.rlike("^[A-Z0-9]{2,12}$"), cleaned)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one latest in ``order``; a plain aggregate, so equal keys
    combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def subsample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """A fixed pseudo-random choice of n rows: those with the n smallest key hashes.

    The cut-off hash is an exact order statistic, so no task or driver holds the n rows.
    """
    d = df.withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    cut = value_positions(d, [], "_h").where(F.col("before") < n).select("_h", "cnt", (F.lit(n) - F.col("before")).alias("_room"))
    d = d.join(cut, "_h")
    edge = d.where(F.col("cnt") > F.col("_room"))
    w = Window.partitionBy("_h").orderBy(*key)  # rows sharing one hash value
    edge = edge.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("_room")).drop("_k")
    return d.where(F.col("cnt") <= F.col("_room")).unionByName(edge).drop("_h", "cnt", "_room")


def downsample(df: DataFrame, points: int, lay: Layout = BARS) -> DataFrame:
    """Evenly spaced rows: positions floor(i*(n-1)/(points-1)); shorter series stay whole."""
    placed = in_blocks(df, lambda d, w: d.withColumn("pos", F.col("_pos")), lay=lay)
    sizes = df.groupBy(*lay.keys).agg(F.count(F.lit(1)).alias("_n"))
    j = salted_join(placed, sizes, list(lay.keys)) if lay.keys else placed.withColumn("_n", sizes.scalar())
    # pos is hit by some i iff the first i with i*(n-1)/(points-1) >= pos still floors to pos
    step = F.col("_n") - 1
    i = F.ceil(F.col("pos") * (points - 1) / step)
    hit = (F.floor(i * step / (points - 1)) == F.col("pos")) & (i < points)
    return j.where((F.col("_n") <= points) | hit).drop("_n")


def rebase(df: DataFrame, value: str, name: str, capital: float = 1.0, lay: Layout = BARS) -> DataFrame:
    """Value over the first value of its series, times ``capital``."""
    keys = list(lay.keys)
    first = df.groupBy(*keys).agg(F.min_by(value, lay.order[0]).alias("_f0"))
    j = salted_join(df, first, keys)
    return j.withColumn(name, F.when(F.col("_f0") > 0, F.col(value) / F.col("_f0")).otherwise(F.col(value)) * capital).drop("_f0")


def compress(df: DataFrame, value: str, lay: Layout = BARS) -> DataFrame:
    """Drop rows equal to the row before, order kept."""
    d = in_blocks(
        df,
        lambda x, w: x.withColumn("_same", F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.col("_pos") > 0)),
        back=1,
        lay=lay,
    )
    return d.where(~F.col("_same")).drop("_same")


def grid_returns(df: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Simple return where the ticker also has a bar on the grid row just before.

    The grid is the union of all times; instead of filling it out, each time gets
    its grid position and only neighbours count.
    """
    times = df.select("ts").distinct()
    grid = in_blocks(times, lambda d, w: d.withColumn("gpos", F.col("_pos")), lay=lay.with_(keys=(), order=("ts",)))
    g = df.join(grid, "ts")
    return in_blocks(
        g,
        lambda d, w: d.withColumn(
            "ret",
            F.when(F.col("gpos") - F.lag("gpos").over(w) == 1, F.col("close") / F.lag("close").over(w) - 1),
        ),
        back=1,
        lay=lay,
    )


def filled_grid_mean(df: DataFrame, value: str, name: str, lay: Layout = BARS) -> DataFrame:
    """Mean over tickers of the forward-filled value at every time of the union grid.

    A running sum of each ticker's changes gives the same mean without building
    the times x tickers grid.
    """
    deltas = in_blocks(
        df,
        lambda d, w: d.withColumn("_d", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))).withColumn(
            "_c", F.when(F.col("_pos") == 0, 1).otherwise(0)
        ),
        back=1,
        lay=lay,
    )
    per_ts = deltas.groupBy("ts").agg(F.sum("_d").alias("_d"), F.sum("_c").alias("_c"))
    run = running(per_ts, {"_s": ("sum", F.col("_d")), "n": ("sum", F.col("_c"))}, lay.with_(keys=(), order=("ts",)))
    return run.select("ts", (F.col("_s") / F.col("n")).alias(name), "n")


def close_matrix(df: DataFrame, tickers: list[str]) -> DataFrame:
    """Wide closes: outer-aligned on the union of times, one column per named ticker."""
    return df.groupBy("ts").pivot("ticker", tickers).agg(F.first("close"))


def expected_bars(counts_days: DataFrame, clock) -> DataFrame:
    """(timeframe, minutes, cap_days, want_days) -> expected bars of a session market."""
    days = F.least("want_days", "cap_days")
    per_day = F.greatest(F.lit(1), F.floor(F.lit(clock.session_minutes) / F.greatest(F.lit(1), F.col("minutes"))))
    base = days * clock.trading_days / F.lit(365.0)
    est = F.when(F.col("timeframe") == "1Day", F.floor(base)).otherwise(F.floor(base * per_day))
    return counts_days.withColumn("expected", est.cast("bigint"))


def best_timeframe(df: DataFrame, count: str = "n") -> DataFrame:
    return df.groupBy().agg(F.max_by("timeframe", F.struct(F.col(count), F.col("timeframe"))).alias("timeframe"), F.max(count).alias(count))
