"""Time-ordered windows, folds and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audits
from ..operators.blocks import Layout, in_blocks, with_position
from ..operators.spread import quantiles, salted_join


def fold_slice_report(df: DataFrame, *, min_rows: int = 100) -> DataFrame:
    """Train and test top-decile edge per ticker, the first failing reason, the worst ticker.

    ``df`` holds role (train/test), proba, fwd_ret and round_trip_bps.
    """
    s = audits.top_decile_stats(df, ["ticker", "role"], "proba", "fwd_ret", "round_trip_bps", min_rows)
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    cost = df.groupBy("ticker").agg(F.max("round_trip_bps").alias("_rt"))
    g = s.groupBy("ticker").agg(pick("train", "net_bps").alias("train_net"), pick("test", "net_bps").alias("test_net"), pick("test", "gross_bps").alias("test_gross"))
    g = g.join(cost, "ticker").withColumn("_fl", F.col("_rt") * 1.25)
    g = g.withColumn("bottleneck", audits.bottleneck("train_net", "test_net", "test_gross", "_rt", "_fl"))
    worst = g.where(F.col("test_net").isNotNull()).agg(F.min_by("ticker", F.struct("test_net", "ticker")))
    return g.withColumn("is_worst", F.col("ticker") == worst.scalar()).drop("_rt", "_fl")


def windows(df: DataFrame, *, train_days: int, years: int, test_months: int) -> DataFrame:
    """Calendar folds (fold, train_start, train_end, test_start, test_end), half-open.

    The first test month is the later of the last date minus ``years`` and the first
    date plus the training length, at a month start.
    """
    lim = df.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    earliest = F.date_add(lo, train_days)
    start = F.trunc(F.greatest(F.add_months(hi, -12 * years), earliest), "MM")
    start = F.when(start < earliest, F.add_months(start, 1)).otherwise(start)
    stop = F.date_add(hi, 1)
    d = lim.select("lo", "hi", start.alias("_s"), stop.alias("_e")).where("_s < _e")
    d = d.select("lo", "_e", F.explode(F.sequence("_s", F.date_sub("_e", 1), F.expr(f"interval {int(test_months)} months"))).alias("test_start"))
    d = d.select(
        F.date_sub("test_start", train_days).alias("train_start"), F.col("test_start").alias("train_end"), "test_start",
        F.least(F.add_months("test_start", test_months), F.col("_e")).alias("test_end"), "lo",
    ).where((F.col("train_start") >= F.col("lo")) & (F.col("test_end") > F.col("test_start"))).drop("lo")
    return d.select((F.row_number().over(Window.orderBy("test_start")) - 1).cast("bigint").alias("fold"), "*")  # one row per fold


def rows_of_windows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of every window they fall in, with fold and role.

    A window is spelled out by the months it touches, so this is an equi-join on the
    month with a time filter, not a comparison of every row with every window.
    """
    span = lambda role: folds.select("fold", F.lit(role).alias("role"), F.col(f"{role}_start").alias("_s"), F.col(f"{role}_end").alias("_e"))
    w = span("train").unionByName(span("test"))
    w = w.withColumn("_m", F.explode(F.sequence(F.trunc("_s", "MM"), F.trunc(F.date_sub("_e", 1), "MM"), F.expr("interval 1 month"))))
    d = df.withColumn("_m", F.trunc("ts", "MM")).join(w, "_m")
    day = F.to_date("ts")
    return d.where((day >= F.col("_s")) & (day < F.col("_e"))).drop("_m", "_s", "_e")


def before_first_test(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows strictly before the first test day."""
    return df.where(F.to_date("ts") < folds.agg(F.min("test_start")).scalar())


def session_folds(sessions: DataFrame, k: int = 4, purge: int = 1) -> DataFrame:
    """(session, fold, role): k chronological test blocks, training without the purged band.

    ``sessions`` holds distinct session values; with under 2k of them there is one split
    at the middle.
    """
    w = Window.orderBy("session")  # one row per trading day
    d = sessions.select("session").distinct().withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    few = F.col("_n") < 2 * k
    mid = F.floor(F.col("_n") / 2)
    start = F.when(few, mid).otherwise(F.col("fold") * size)
    end = F.when(few | (F.col("fold") == k - 1), F.col("_n")).otherwise(F.least((F.col("fold") + 1) * size, F.col("_n")))
    i = F.col("_i")
    test = F.when(few, i >= F.least(mid + purge, F.col("_n"))).otherwise((i >= start) & (i < end))
    train = F.when(few, i < F.greatest(F.lit(0), mid - purge)).otherwise((i < start - purge) | (i >= end + purge))
    role = F.when(test, "test").when(train, "train")
    d = d.withColumn("role", role).where(F.col("role").isNotNull() & (~few | (F.col("fold") == 0)))
    return d.select("session", F.col("fold").cast("bigint").alias("fold"), "role")


def embargo(df: DataFrame, test_start: Column, horizon_bars: int, bar_minutes: int = 5) -> DataFrame:
    """Rows whose forward label ends before the test window starts."""
    return df.where(F.col("ts") < test_start - F.expr(f"interval {int(horizon_bars) * int(bar_minutes)} minutes"))


def fit_calibration(df: DataFrame, *, test_start: Column, horizon_bars: int, bar_minutes: int, frac: float, purge: int = 1) -> DataFrame:
    """Embargoed rows with role fit or calibrate: last sessions purged, then a cut by time order.

    The cut row comes from exact positions, so nothing is sorted in one task.
    """
    d = embargo(df, test_start, horizon_bars, bar_minutes).withColumn("_s", F.to_date("ts"))
    days = d.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.col("_s").desc())  # one row per trading day
    keep = days.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > purge).drop("_r")
    total = keep.agg(F.sum("_n")).scalar()
    d = d.join(keep.select("_s"), "_s", "left_semi")
    d = with_position(d, "_p", Layout(keys=(), order=("ts", "ticker"), bucket=86400)).withColumn("_p", F.col("_p") + 1)
    cut = F.greatest(F.lit(1), F.floor(total * (1 - min(max(frac, 0.0), 0.4))))
    return d.withColumn("role", F.when(F.col("_p") <= cut, "fit").otherwise("calibrate")).drop("_s", "_p")


def expanding_splits(df: DataFrame, folds: int, lay: Layout) -> DataFrame:
    """Rows of each series with (split, role): growing training part, next block as validation.

    Series with under 60 rows, or blocks under 20, get one 70/30 split.
    """
    keys = list(lay.keys)
    d = with_position(df, "_p", lay)
    d = salted_join(d, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    n, p = F.col("_n"), F.col("_p")
    block = F.floor(n / (folds + 1))
    single = (n < 60) | (block < 20)
    d = d.withColumn("split", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(folds - 1)))))
    i = F.col("split")
    lo = F.when(single, F.greatest(F.lit(1), F.floor(n * 0.7))).otherwise(block * (i + 1))
    hi = F.when(single | (i == folds - 1), n).otherwise(block * (i + 2))
    usable = single | ((hi - lo >= 15) & (lo >= 30))
    role = F.when(p < lo, "train").when(p < hi, "validate")
    return d.withColumn("role", role).where(F.col("role").isNotNull() & usable).drop("_p", "_n")


def quantile_split(df: DataFrame, frac: float = 0.7) -> DataFrame:
    """Role by the time quantile: at or before it train, after it test."""
    t = df.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    cut = quantiles(t, [], "_t", {"q": frac})
    return t.withColumn("role", F.when(F.col("_t") <= cut.scalar(), "train").otherwise("test")).drop("_t")


def fold_benchmarks(folds: DataFrame, prices: DataFrame) -> DataFrame:
    """Per fold: each ticker's buy-and-hold over the test window, averaged."""
    d = rows_of_windows(prices, folds).where(F.col("role") == "test")
    g = d.groupBy("fold", "ticker").agg(F.min_by("close", "ts").alias("_a"), F.max_by("close", "ts").alias("_b"))
    return g.groupBy("fold").agg(F.avg(F.col("_b") / F.col("_a") - 1).alias("bench_ret"), F.count(F.lit(1)).alias("n_tickers"))


def trailing_session_folds(sessions: DataFrame, train_sessions: int, every: int) -> DataFrame:
    """Folds that train on the ``train_sessions`` before each block of ``every`` sessions."""
    w = Window.orderBy("session")  # one row per trading day
    d = sessions.select("session").distinct().withColumn("_i", F.row_number().over(w) - 1)
    late = d.where(F.col("_i") >= train_sessions).withColumn("fold", F.floor((F.col("_i") - train_sessions) / every))
    g = late.groupBy("fold").agg((F.min("_i") - train_sessions).alias("_i"), F.min("session").alias("test_start"), F.date_add(F.max("session"), 1).alias("test_end"))
    g = g.join(d.withColumnRenamed("session", "train_start"), "_i")
    return g.select("fold", "train_start", F.col("test_start").alias("train_end"), "test_start", "test_end")
