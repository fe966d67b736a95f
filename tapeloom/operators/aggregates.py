"""Group summaries, top-k choices and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import nz
from .blocks import BARS, Layout, in_blocks, running
from .spread import quantiles, salted_join

BPS = 10_000.0


def group_stats(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Count, mean, hit rate and mean in basis points."""
    x = F.col(ret)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean_ret"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        (F.avg(x) * BPS).alias("mean_bps"),
    )


def class_shares(df: DataFrame, keys: list[str], label: str, classes: dict[str, int]) -> DataFrame:
    """Share of each class among the non-null labels of a key."""
    x = F.col(label)
    share = lambda c: F.coalesce(F.avg((x == c).cast("double")), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(x).alias("n"), *[share(c).alias(f"{name}_rate") for name, c in classes.items()])


def tick_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    tick = F.count_if(F.col("flow_source") > 0)
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(tick.alias("tick_bars"), (n - tick).alias("candle_bars"), F.round(100.0 * tick / n, 2).alias("tick_pct"))


def compounded(df: DataFrame, ret: str, name: str, lay: Layout) -> DataFrame:
    """Running product of 1 + return; missing returns count as zero."""
    d = running(df, {"_s": ("sum", F.log1p(F.coalesce(F.col(ret), F.lit(0.0))))}, lay)
    return d.withColumn(name, F.exp("_s")).drop("_s")


def equal_weight_curve(returns: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Mean return across tickers per time, compounded."""
    per_ts = returns.groupBy("ts").agg(F.avg("ret").alias("mean_ret"))
    return compounded(per_ts, "mean_ret", "value", lay.with_(keys=(), order=("ts",)))


def slice_return(df: DataFrame, keys: list[str], value: str, start, end) -> DataFrame:
    d = df.where((F.col("ts") >= start) & (F.col("ts") <= end))
    first, last = F.min_by(value, "ts"), F.max_by(value, "ts")
    return d.groupBy(*keys).agg(F.when(first > 0, last / first - 1).alias("ret"), F.count(F.lit(1)).alias("n"))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Fold rows to (metric, mean, std): one pass, no reshaping of the rows."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"m_{m}"), F.stddev_pop(m).alias(f"s_{m}"), F.count(m).alias(f"n_{m}"))]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("mean"), F.when(F.col(f"n_{m}") > 1, F.col(f"s_{m}")).alias("std")) for m in metrics
    ])
    return one.select(F.inline(rows))


def importance_by_group(df: DataFrame, groups: DataFrame, top: int = 5) -> DataFrame:
    """(feature, importance) rolled up by group: sum, share of the absolute total, top features."""
    d = df.join(groups, "feature", "left").withColumn("feature_group", F.coalesce("feature_group", F.lit("other")))
    total = d.agg(F.sum(F.abs("importance"))).scalar()
    g = d.groupBy("feature_group").agg(F.sum("importance").alias("importance_sum"), F.count(F.lit(1)).alias("n_features"))
    # rank and filter together: each task keeps only its best few before the shuffle
    w = Window.partitionBy("feature_group").orderBy(F.abs("importance").desc(), F.col("feature").desc())
    best = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    best = best.groupBy("feature_group").agg(F.array_sort(F.collect_list(F.struct("_k", "feature"))).alias("_t"))
    return g.join(best, "feature_group").select(
        "feature_group", "importance_sum", (100.0 * F.col("importance_sum") / total).alias("importance_pct"), "n_features",
        F.array_join(F.transform("_t", lambda t: t["feature"]), ",").alias("top_features"),
    )


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, quartiles, max and mean; quartiles exact without gathering a key."""
    basic = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean")
    )
    return basic.join(quantiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), keys)


def narrowed_range(df: DataFrame, step: float | None = None, pad: float = 0.15) -> DataFrame:
    """Quartile range plus padding, snapped outward to ``step``."""
    span = F.greatest(F.col("p75") - F.col("p25"), F.lit(1e-9)) * pad
    lo, hi = F.col("p25") - span, F.col("p75") + span
    if step:
        lo, hi = F.floor(lo / step) * step, F.ceil(hi / step) * step
    return df.withColumns({"low": lo.cast("double"), "high": hi.cast("double")})


def column_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null and zero share, distinct values, deviation and a constant flag per column.

    Distinct counts go through (column, value) pairs that combine before the shuffle,
    so no column's values meet in one task.
    """
    n = F.count(F.lit(1))
    one = df.agg(
        *[F.struct((100.0 * F.avg(F.col(c).isNull().cast("double"))).alias("null_pct"),
                   (100.0 * F.avg((F.coalesce(F.col(c), F.lit(0.0)) == 0).cast("double"))).alias("zero_pct"),
                   F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std")).alias(c) for c in cols]
    )
    stats = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])))
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])))
    distinct = pairs.where(F.col("v").isNotNull()).groupBy("feature", "v").agg(n).groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique"))
    d = stats.join(distinct, "feature", "left").select("feature", "s.*", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))
    return d.withColumn("constant", (F.col("n_unique") <= 1) | (F.col("std") < 1e-12))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = lim.select("lo").scalar(), lim.select("hi").scalar()
    b = F.least(F.floor((F.col(value) - lo) / nz((hi - lo) / bins)), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).groupBy(F.coalesce(b, F.lit(0)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def monthly_returns(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last value of each month and its change on the month before."""
    m = df.groupBy(*keys, F.trunc("ts", "MM").alias("month")).agg(F.max_by(value, "ts").alias("last"))
    w = Window.partitionBy(*keys).orderBy("month")  # months, not bars
    return m.withColumn("ret", F.col("last") / F.lag("last").over(w) - 1)


def year_by_month(monthly: DataFrame, keys: list[str]) -> DataFrame:
    d = monthly.withColumns({"year": F.year("month"), "m": F.month("month")})
    d = d.groupBy(*keys, "year").pivot("m", list(range(1, 13))).agg(F.first("ret"))
    return d.select(*keys, F.col("year").cast("bigint").alias("year"), *[F.col(f"`{i}`").alias(f"m{i:02d}") for i in range(1, 13)])


# ---- top-k ------------------------------------------------------------------


def latest_per_key(df: DataFrame, keys: list[str], at, time: str = "ts") -> DataFrame:
    """Last row per key at or before ``at``; a zero score never replaces a positive one."""
    d = df.where(F.col(time) <= at)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    live = F.max_by(row, F.when(F.col("score") > 0, F.col(time)))
    newest = F.max_by(row, time)
    pick = d.groupBy(*keys).agg(F.coalesce(live, newest).alias("_r"))
    return pick.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def period_ends(df: DataFrame, period: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc(period, "ts").alias("period")).agg(F.max("ts").alias("last_ts"))


def top_fraction(df: DataFrame, keys: list[str], score: str, tie: list[str], frac: float = 0.25, least: int = 5) -> DataFrame:
    """Best rows of each key: max(least, ceil(n * frac)) of them.

    The cut-off score is an exact order statistic, so a hot key is never sorted in one
    task; rows level with the cut-off are ranked among themselves.
    """
    from .spread import value_positions

    scored = df.where(F.col(score).isNotNull())
    pos = value_positions(scored, keys, score).withColumn("_take", F.least(F.greatest(F.lit(least), F.ceil(F.col("total") * frac)), F.col("total")))
    # rows strictly above a value, and how many may still be taken at it
    pos = pos.withColumn("_above", F.col("total") - F.col("before") - F.col("cnt")).withColumn("_room", F.col("_take") - F.col("_above"))
    pos = pos.where(F.col("_room") > 0).select(*keys, score, "cnt", "_room")
    d = scored.join(pos, [*keys, score])
    sure = d.where(F.col("cnt") <= F.col("_room"))
    edge = d.where(F.col("cnt") > F.col("_room"))
    w = Window.partitionBy(*keys, score).orderBy(*tie)  # one tied score value per key
    edge = edge.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("_room")).drop("_k")
    return sure.unionByName(edge).drop("cnt", "_room")


def best_candidate(df: DataFrame, keys: list[str], tier: Column, score: str, tie: str) -> DataFrame:
    """Best row per key: highest tier, then score, then ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(tier.alias("t"), F.col(score).alias("s"), F.col(tie).alias("k"))).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def preferred_side(df: DataFrame) -> DataFrame:
    """(ticker, side, net_bps, monotonic, floor_bps): cleared sides first, then the higher net."""
    cleared = ((F.col("net_bps") > F.col("floor_bps")) & F.col("monotonic")).cast("int")
    return best_candidate(df.where(F.col("net_bps").isNotNull()).withColumn("cleared", cleared), ["ticker"], F.col("cleared"), "net_bps", "side")


def tail_rows(df: DataFrame, n: int, lay: Layout = BARS) -> DataFrame:
    """Last n rows of each series, by exact position."""
    placed = in_blocks(df, lambda d, w: d.withColumn("_p", F.col("_pos")), lay=lay)
    size = df.groupBy(*lay.keys).agg(F.count(F.lit(1)).alias("_n"))
    return salted_join(placed, size, list(lay.keys)).where(F.col("_p") >= F.col("_n") - n).drop("_p", "_n")


def first_windows(df: DataFrame, n: int) -> DataFrame:
    """First n folds in order, renumbered from zero."""
    d = df.orderBy("fold").limit(n)  # n is a fold count
    return d.withColumn("fold", (F.row_number().over(Window.orderBy("fold")) - 1).cast("bigint"))


# ---- set operations ---------------------------------------------------------


def tradeable_set(stitched: DataFrame, folds: DataFrame, positive: DataFrame, mode: str) -> DataFrame:
    """Tickers by gate mode: stitched, fold_history (stitched when empty), strict, union."""
    s, f = stitched.select("ticker").distinct(), folds.select("ticker").distinct()
    if mode == "stitched":
        return s.withColumn("source", F.lit("stitched"))
    n_s, n_f = s.agg(F.count(F.lit(1))).scalar(), f.agg(F.count(F.lit(1))).scalar()
    if mode == "fold_history":
        return f.withColumn("source", F.lit("fold_history")).unionByName(s.where(n_f == 0).withColumn("source", F.lit("stitched_fallback")))
    if mode == "strict":
        both = f.intersect(positive.select("ticker"))
        return s.withColumn("source", F.lit("stitched")).unionByName(both.where(n_s == 0).withColumn("source", F.lit("strict_fold_aligned")))
    source = F.when(n_s == 0, "fold_history_only").when(n_f == 0, "stitched_only").otherwise("union")
    return s.union(f).distinct().withColumn("source", source)
