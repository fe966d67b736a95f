"""Portfolio statistics and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import with_draw
from ..functions.frames import nz, zero
from ..operators.aggregates import slice_return
from ..operators.asof import asof_join
from ..operators.blocks import BARS, Layout, in_blocks, running, with_position
from ..operators.spread import quantiles, salted_join
from ..sources.store import stage

BPS = 10_000.0


def series_layout(lay: Layout) -> Layout:
    return lay.with_(keys=(), order=("ts",))


def simple_returns(df: DataFrame, value: str, name: str, lay: Layout, keys: tuple[str, ...] = ()) -> DataFrame:
    order = lay.with_(keys=keys, order=("ts",))
    return in_blocks(df, lambda d, w: d.withColumn(name, F.col(value) / F.lag(value).over(w) - 1), back=1, lay=order)


def aligned_returns(a: DataFrame, x: str, b: DataFrame, y: str, lay: Layout = BARS) -> DataFrame:
    """Returns of two series on the times both have."""
    ra = simple_returns(a.select("ts", x), x, "rx", lay).select("ts", "rx")
    rb = simple_returns(b.select("ts", y), y, "ry", lay).select("ts", "ry")
    return ra.join(rb, "ts").where(F.col("rx").isNotNull() & F.col("ry").isNotNull())


def drawdown(df: DataFrame, value: str, lay: Layout) -> DataFrame:
    return running(df, {"_pk": ("max", F.col(value))}, lay).withColumn("drawdown", F.col(value) / F.col("_pk") - 1).drop("_pk")


def performance(equity: DataFrame, bench: DataFrame, *, per_year: float, rate: float = 0.04, lay: Layout = BARS) -> DataFrame:
    """Total, benchmark and excess return, Sharpe over a fixed rate, worst drawdown (one row)."""
    s = series_layout(lay)
    tot = lambda d, n: d.agg((F.max_by("value", "ts") / F.min_by("value", "ts") - 1).alias(n)).scalar()
    r = simple_returns(equity, "value", "_r", lay)
    x = F.col("_r") - rate / per_year
    g = r.agg((F.avg(x) / nz(F.stddev_samp(x)) * math.sqrt(per_year)).alias("sharpe"), F.count("_r").alias("n"))
    return g.select("n", "sharpe", tot(equity, "t").alias("total_ret"), tot(bench, "b").alias("bench_ret"), drawdown(equity, "value", s).agg(F.min("drawdown")).scalar().alias("max_drawdown")).withColumn(
        "excess_ret", F.col("total_ret") - F.col("bench_ret")
    )


def daily_values(equity: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Last value of every calendar day, days without one filled forward."""
    last = equity.groupBy(F.to_date("ts").alias("day")).agg(F.max_by("value", "ts").alias("value"))
    lim = last.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = lim.select(F.explode(F.sequence("a", "b")).alias("day"))
    d = spine.join(last, "day", "left").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    filled = running(d, {"v": ("last", F.col("value"))}, series_layout(lay))
    return filled.select("day", "ts", F.col("v").alias("value"))


def calendar_performance(equity: DataFrame, lay: Layout = BARS) -> DataFrame:
    """CAGR, basis points per day and the 365.25-day Sharpe of the daily values."""
    d = simple_returns(daily_values(equity, lay), "value", "_r", lay)
    g = d.agg(
        F.count("_r").alias("n_days"), F.min_by("value", "ts").alias("_a"), F.max_by("value", "ts").alias("_b"),
        (F.avg("_r") / nz(F.stddev_samp("_r")) * math.sqrt(365.25)).alias("sharpe"), (F.avg("_r") * BPS).alias("bps_per_day"),
    )
    return g.withColumn("cagr", F.pow(F.col("_b") / F.col("_a"), F.lit(365.25) / F.greatest(F.col("n_days"), F.lit(1))) - 1).drop("_a", "_b")


def alpha_stats(pairs: DataFrame, keys: list[str], *, per_year: float, rate: float = 0.04, min_rows: int = 10) -> DataFrame:
    """Alpha and beta of rx on ry above a rate, R2, information ratio, tracking error, captures."""
    rf = rate / per_year
    x, y = F.col("rx"), F.col("ry")
    act = x - y
    up = lambda c, w: F.avg(F.when(w, c))
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.regr_slope(x - rf, y - rf).alias("beta"), F.regr_intercept(x - rf, y - rf).alias("alpha"), F.regr_r2(x - rf, y - rf).alias("r2"),
        F.corr(x, y).alias("correlation"), (F.stddev_samp(act) * math.sqrt(per_year)).alias("tracking_error"), (F.avg(act) * per_year).alias("_act"),
        (up(x, y > 0) / nz(up(y, y > 0))).alias("up_capture"), (up(x, y < 0) / nz(up(y, y < 0))).alias("down_capture"),
    ).where(F.col("n_obs") >= min_rows)
    g = g.withColumn("information_ratio", zero(F.when(F.col("tracking_error") > 1e-12, F.col("_act") / F.col("tracking_error"))))
    return g.withColumn("alpha_ann", F.pow(1 + F.col("alpha"), F.lit(per_year)) - 1).drop("_act")


def trade_analytics(df: DataFrame, keys: list[str], ret: str = "net_ret") -> DataFrame:
    x = F.col(ret)
    d = df.where(x.isNotNull())
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((x > 0).cast("double")).alias("win_rate"), (F.avg(F.when(x > 0, x)) * BPS).alias("avg_win_bps"), (F.avg(F.when(x < 0, x)) * BPS).alias("avg_loss_bps"),
        (F.avg(x) * BPS).alias("expectancy_bps"), (F.sum(F.when(x > 0, x)) / nz(-F.sum(F.when(x < 0, x)))).alias("profit_factor"), (F.max(x) * BPS).alias("best_bps"), (F.min(x) * BPS).alias("worst_bps"),
    )
    return g.join(quantiles(d.select(*keys, (x * BPS).alias("_x")), keys, "_x", {"median_bps": 0.5}), keys)


def risk_summary(df: DataFrame, keys: list[str], ret: str, per_year: float) -> DataFrame:
    """Vol, skew, excess kurtosis (population), 5 percent VaR and the mean beyond it."""
    d = df.where(F.col(ret).isNotNull()).select(*keys, F.col(ret).alias("_x"))
    var = quantiles(d, keys, "_x", {"var_95": 0.05})
    j = salted_join(d, var, keys)
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.stddev_samp("_x") * math.sqrt(per_year)).alias("vol_ann"), F.skewness("_x").alias("skew"), F.kurtosis("_x").alias("excess_kurtosis"),
        F.max("var_95").alias("var_95"), F.avg(F.when(F.col("_x") <= F.col("var_95"), F.col("_x"))).alias("cvar_95"),
    )


def fold_anomalies(folds: DataFrame, *, at: float = 3.5) -> DataFrame:
    """(fold, ret, net_sum, n_trades): robust z of the fold return and the churn flag.

    One row per fold, so plain percentiles do.
    """
    every = Window.partitionBy(F.lit(0))
    d = folds.withColumn("_med", F.percentile("ret", F.lit(0.5)).over(every))
    d = d.withColumn("_dev", F.abs(F.col("ret") - F.col("_med")))
    d = d.withColumns({"_mad": F.percentile("_dev", F.lit(0.5)).over(every), "_sd": F.stddev_samp("ret").over(every)})
    z = F.when(F.col("_mad") > 1e-12, 0.6745 * (F.col("ret") - F.col("_med")) / F.col("_mad")).otherwise(zero((F.col("ret") - F.col("_med")) / nz("_sd")))
    churn = (F.col("ret") < 0) & (F.col("net_sum") > 0)
    d = d.withColumns({"robust_z": z, "churn": churn})
    return d.withColumn("anomaly", (F.abs("robust_z") >= at) | (F.col("n_trades") == 0) | F.col("churn")).drop("_med", "_dev", "_mad", "_sd")


def weighted_equity(weights: DataFrame, prices: DataFrame, cost_bps: float, lay: Layout = BARS) -> DataFrame:
    """Equity of a given weight table: the weights of one date earn the return to the next,
    the change into each date's weights is paid for, and periods compound."""
    from ..operators.signals import turnover, weight_changes

    ch = stage(weight_changes(weights, lay))
    px = prices.select("ticker", "ts", "close")
    prev = asof_join(ch.select("ts", "idx", "ticker", "prev", "weight"), px, ["close"], lay=lay)
    dates = ch.select("ts", "idx").distinct()
    before = dates.select((F.col("idx") + 1).alias("idx"), F.col("ts").alias("_t0"))
    was = ch.select("idx", "ticker", "prev").where("prev <> 0").join(before, "idx")
    start = asof_join(was.withColumnRenamed("_t0", "ts"), px.withColumnRenamed("close", "c0"), ["c0"], lay=lay).drop("ts")
    r = prev.join(start.select("idx", "ticker", "c0"), ["idx", "ticker"], "left")
    g = r.groupBy("ts").agg(zero(F.sum(F.col("prev") * (F.col("close") / F.col("c0") - 1))).alias("gross_ret"))
    g = g.join(turnover(ch, cost_bps), "ts")
    step = F.ln((1 + F.col("gross_ret")) * (1 - F.col("cost")))
    e = running(g, {"_s": ("sum", step)}, series_layout(lay))
    return e.withColumn("value", F.exp("_s")).drop("_s")


def participation(weights: DataFrame, period_returns: DataFrame) -> DataFrame:
    """(ticker, ts, weight) and (ticker, ts, ret) to dates held, mean weight, contribution, hit rate."""
    d = weights.where("weight <> 0").join(period_returns, ["ticker", "ts"])
    c = F.col("weight") * F.col("ret")
    return d.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("periods_held"), F.avg("weight").alias("mean_weight"), (100 * F.sum(c)).alias("contribution_pct"), F.avg((c > 0).cast("double")).alias("hit_rate")
    )


def entry_discount(changes: DataFrame) -> DataFrame:
    """Mean bought price against the plain average price, per ticker."""
    dw = F.greatest(F.col("dw"), F.lit(0.0))
    g = changes.groupBy("ticker").agg((F.sum(dw * F.col("close")) / nz(F.sum(dw))).alias("entry_price"), F.avg("close").alias("mean_price"))
    return g.withColumn("discount_pct", 100 * (1 - F.col("entry_price") / F.col("mean_price")))


def flat_equity(df: DataFrame, start, end) -> DataFrame:
    return df.where((F.col("ts") >= start) & (F.col("ts") < end)).select("ts").distinct().withColumn("value", F.lit(1.0))


def bootstrap(returns: DataFrame, *, paths: int, horizon: int, block: int, seed: int = 42, lay: Layout = BARS) -> DataFrame:
    """Block-bootstrap paths: (path, terminal, max_drawdown).

    Each path draws ceil(horizon/block) block starts from counters (path, block), so any
    engine draws the same; a draw is joined to the returns by position.  A path is at most
    ``horizon`` rows.  Null and non-finite returns are left out; of under ``block`` + 2
    returns there is one flat path.
    """
    returns = returns.where(F.abs("ret") < float("inf"))
    r = with_position(returns.select("ts", "ret"), "pos", series_layout(lay))
    n = returns.agg(F.count(F.lit(1))).scalar()
    spark = returns.sparkSession
    k = -(-horizon // block)
    draws = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("b"))
    draws = with_draw(draws, "_x", seed, ["path", "b"]).where(n >= block + 2)
    start = F.pmod("_x", n - block + 1)
    steps = draws.select("path", start.alias("s"), "b", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"))
    steps = steps.select("path", (F.col("b") * block + F.col("j")).alias("t"), (F.col("s") + F.col("j")).alias("pos")).where(F.col("t") < horizon)
    w = Window.partitionBy("path").orderBy("t")
    d = steps.join(r.select("pos", "ret"), "pos").withColumn("_w", F.product(1 + F.col("ret")).over(w))
    d = d.withColumn("_pk", F.max("_w").over(w))
    drawn = d.groupBy("path").agg(F.max_by("_w", "t").alias("terminal"), F.min(F.col("_w") / F.col("_pk") - 1).alias("max_drawdown"))
    flat = spark.range(1).where(n < block + 2).select(F.col("id").alias("path"), F.lit(1.0).alias("terminal"), F.lit(0.0).alias("max_drawdown"))
    return drawn.unionByName(flat)


def survival(paths: DataFrame, limit: float = 0.20) -> DataFrame:
    """Quantiles of terminal wealth and of the deepest drawdown, the shares of paths that end
    below 1, not below 1 (``survival_rate``), and that fall below ``limit`` (one row per path in)."""
    at = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    share = lambda c: F.avg(c.cast("double"))
    found = paths.agg(
        F.count(F.lit(1)).alias("n_paths"), F.percentile("terminal", at).alias("_t"), F.percentile("max_drawdown", at).alias("_d"),
        share(F.col("terminal") < 1).alias("p_loss"), share(F.col("terminal") >= 1).alias("survival_rate"), share(F.col("max_drawdown") < -limit).alias("p_ruin"),
    )
    parts = [F.get(f"_{x[0]}", i).alias(f"{x}_p{p}") for x in ("terminal", "drawdown") for i, p in enumerate((5, 50, 95))]
    return found.select("n_paths", *parts, "p_loss", "survival_rate", "p_ruin")


def research_cards(folds: DataFrame, audit: DataFrame) -> DataFrame:
    """One JSON card per ticker: verdict inputs and its folds in order (a few per ticker)."""
    f = folds.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("fold", "net_bps", "bottleneck"))).alias("folds"), F.avg("net_bps").alias("mean_net"))
    d = audit.join(f, "ticker", "left")
    return d.withColumn("card", F.to_json(F.struct("ticker", "tradeable", "mean_net", "folds")))
