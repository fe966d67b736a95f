"""Score audits: quantile bins, after-cost edge, classification and calibration metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import clip, nz
from .blocks import Layout, running
from .spread import PIECE_ROWS, average_ranks, quantiles, salted_join, value_positions

BPS = 10_000.0
NO_SKILL = 0.6931


# ---- ranks ------------------------------------------------------------------


#: Rows of one time that are ranked in one task; times with more go by positions.
TIME_ROWS = 1_000_000


def cross_rank(df: DataFrame, cols: dict[str, str], by: str = "ts", limit: int = TIME_ROWS) -> DataFrame:
    """Percentile rank across tickers at one time, average ties, nulls stay null.

    Times of up to ``limit`` rows are windows of their own.  Larger ones are ranked by the
    positions of their distinct values, spread over tasks; the ranks are the same.
    """
    large = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(by)
    if large.isEmpty():
        return _window_rank(df, cols, by)
    small = _window_rank(df.join(large, by, "left_anti"), cols, by)
    rest = df.join(large, by, "left_semi")
    for name, c in cols.items():
        rank = (F.col("before") + (F.col("cnt") + 1) / 2) / F.col("total")
        pos = value_positions(rest, [by], c).select(by, F.col(c).alias("_v"), rank.alias(name))
        rest = rest.withColumn("_v", F.col(c)).join(pos, [by, "_v"], "left").drop("_v")
    return small.unionByName(rest)


def _window_rank(df: DataFrame, cols: dict[str, str], by: str) -> DataFrame:
    outs = {}
    every = Window.partitionBy(by)
    for name, c in cols.items():
        rank = F.rank().over(every.orderBy(F.col(c).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2
        outs[name] = F.when(F.col(c).isNotNull(), rank / F.count(c).over(every))
    return df.withColumns(outs)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "ic") -> DataFrame:
    """Rank correlation per key; zero below six rows or without spread."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = average_ranks(average_ranks(d, keys, x, "_rx"), keys, y, "_ry")
    ok = (F.count(F.lit(1)) >= 6) & (F.stddev_pop("_rx") >= 1e-9) & (F.stddev_pop("_ry") >= 1e-9)
    return r.groupBy(*keys).agg(F.when(ok, F.corr("_rx", "_ry")).otherwise(0.0).alias(name), F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, keys: list[str], score: str, n: int = 10, name: str = "bin") -> DataFrame:
    """Right-closed bins between exact quantile edges, duplicate edges dropped."""
    qs = {f"_q{i}": i / n for i in range(n + 1)}
    e = quantiles(df, keys, score, qs)
    e = e.select(*keys, F.array_distinct(F.array(*qs)).alias("_edges"))
    d = df.where(F.col(score).isNotNull())
    d = salted_join(d, e, keys) if keys else d.withColumn("_edges", e.scalar())
    below = F.size(F.filter("_edges", lambda x: x < F.col(score)))
    return d.withColumn(name, F.greatest(below - 1, F.lit(0))).drop("_edges")


def top_decile_flag(df: DataFrame, keys: list[str], score: str, q: float = 0.9, name: str = "top") -> DataFrame:
    """Rows at or above the q quantile of their key (ties in)."""
    cut = quantiles(df, keys, score, {"_cut": q})
    d = salted_join(df, cut, keys, "left") if keys else df.withColumn("_cut", cut.scalar())
    return d.withColumn(name, F.col(score) >= F.col("_cut")).drop("_cut")


# ---- after-cost edge --------------------------------------------------------


def top_decile_stats(df: DataFrame, keys: list[str], score: str, ret: str, cost: str, min_rows: int = 50, deciles: int = 10) -> DataFrame:
    """Gross, cost and net basis points of the top decile; null under max(5 deciles, min_rows) rows."""
    d = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    d = top_decile_flag(d, keys, score, 1 - 1 / deciles)
    top = lambda x: F.avg(F.when(F.col("top"), F.col(x)))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (top(ret) * BPS).alias("gross_bps"), top(cost).alias("cost_bps"))
    enough = F.col("n") >= max(deciles * 5, min_rows)
    g = g.withColumns({c: F.when(enough, F.col(c)) for c in ("gross_bps", "cost_bps")})
    return g.withColumn("net_bps", F.col("gross_bps") - F.col("cost_bps"))


def decile_table(df: DataFrame, keys: list[str], score: str, ret: str, cost: str, min_rows: int = 100) -> DataFrame:
    """Per key and bin: n, mean score, gross and net basis points; keys under min_rows drop out."""
    d = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    t = quantile_bins(d, keys, score).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        (F.avg(ret) * BPS).alias("gross_bps"),
        (F.avg(F.col(ret) - F.col(cost) / BPS) * BPS).alias("net_bps"),
    )
    size = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return t.withColumn("_size", size).where(F.col("_size") >= min_rows).drop("_size")


def decile_verdict(table: DataFrame, keys: list[str]) -> DataFrame:
    """Top bin against the bottom and the next-to-top one."""
    bins = F.array_sort(F.collect_list(F.struct("bin", "net_bps", "gross_bps")))  # at most ten
    g = table.groupBy(*keys).agg(F.sum("n").alias("n"), bins.alias("_b"))
    last = F.element_at("_b", -1)
    second = F.when(F.size("_b") > 1, F.element_at("_b", F.when(F.size("_b") > 1, -2).otherwise(-1))).otherwise(F.element_at("_b", 1))
    return g.select(
        *keys, "n", last["gross_bps"].alias("top_gross_bps"), last["net_bps"].alias("top_net_bps"),
        (last["net_bps"] >= F.greatest(F.element_at("_b", 1)["net_bps"], second["net_bps"])).alias("monotonic"),
    )


def with_tradeable(verdict: DataFrame, floor: Column) -> DataFrame:
    d = verdict.withColumn("floor_bps", floor)
    d = d.withColumn("tradeable", (F.col("top_net_bps") > F.col("floor_bps")) & F.col("monotonic"))
    reasons = F.array_compact(
        F.array(F.when(F.col("top_net_bps") <= F.col("floor_bps"), "net_below_floor"), F.when(~F.col("monotonic"), "not_monotonic"))
    )
    return d.withColumn("reasons", F.array_join(reasons, ","))


def side_rows(df: DataFrame, ret: str, sides: str = "sides") -> DataFrame:
    """One row per allowed side: the side's own score, returns inverted for shorts."""
    long_ = F.when(F.col(sides).isin("long", "both"), F.struct(F.lit("long").alias("side"), F.col("proba").alias("gate_score"), F.col(ret).alias("gate_ret")))
    short = F.when(F.col(sides).isin("short", "both"), F.struct(F.lit("short").alias("side"), F.col("proba_short").alias("gate_score"), (-F.col(ret)).alias("gate_ret")))
    keep = [c for c in df.columns if c not in ("side", "gate_score", "gate_ret")]
    return df.select(*keep, F.inline(F.array_compact(F.array(long_, short))))


def side_normalised(df: DataFrame, ret: str, sides: str = "sides", side: str = "position_side") -> DataFrame:
    """Gate score, return and side per row: the traded side where both are allowed,
    otherwise the only allowed one."""
    short_only = F.col(sides) == "short"
    short = short_only | ((F.col(sides) == "both") & (F.coalesce(F.col(side), F.lit(0)) < 0))
    return df.withColumns(
        {
            "gate_score": F.when(short, F.col("proba_short")).otherwise(F.col("proba")),
            "gate_ret": F.when(short, -F.col(ret)).otherwise(F.col(ret)),
            "gate_side": F.when(short, "short").otherwise("long"),
        }
    )


def fold_gate(folds: DataFrame, floors: DataFrame, min_ok: int = 2, frac: float = 0.6) -> DataFrame:
    """(fold, ticker, net_bps, bottleneck, skipped) to tickers with repeated fold edge."""
    live = folds.where(~F.col("skipped"))
    med = quantiles(live, ["ticker"], "net_bps", {"median_net": 0.5})
    g = live.groupBy("ticker").agg(F.count_if(F.col("bottleneck") == "ok").alias("ok_folds"), F.count("net_bps").alias("n"))
    d = g.join(med, "ticker").join(floors.select("ticker", "floor_bps"), "ticker")
    m, f = F.col("median_net"), F.col("floor_bps")
    keep = (F.col("ok_folds") >= min_ok) | ((F.col("n") >= max(2, min_ok)) & (m >= frac * f)) | (m > f)
    return d.withColumn("pass", keep & (F.col("n") > 0))


def quality_pass(policies: DataFrame, floors: DataFrame, min_rate: float = 0.40) -> DataFrame:
    """(ticker, ok, holdout_bps) over folds to pass rate, mean holdout and keep flag."""
    g = policies.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("pass_rate"), F.avg("holdout_bps").alias("mean_holdout"))
    d = floors.select("ticker", "floor_bps").join(g, "ticker", "left")
    keep = F.coalesce(F.col("pass_rate") >= min_rate, F.lit(True)) | F.coalesce(F.col("mean_holdout") >= F.col("floor_bps"), F.lit(False))
    return d.withColumns({"n": F.coalesce("n", F.lit(0)), "keep": keep, "soft_size": clip("pass_rate", 0.1, 1.0)})


# ---- classification ---------------------------------------------------------


def _clipped(p: str) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def classification(df: DataFrame, keys: list[str], y: str, p: str, threshold: float | None = None) -> DataFrame:
    """Accuracy, AUC, average precision, log loss, Brier, precision and recall per key.

    AUC and average precision come from the sorted positions of the distinct scores,
    found without sorting a key in one task.
    """
    k = list(keys) or ["_all"]
    d = (df if keys else df.withColumn("_all", F.lit(0))).where(F.col(y).isNotNull() & F.col(p).isNotNull())
    d = d.select(*k, F.col(y).cast("double").alias("_y"), _clipped(p).alias("_p"))
    base = d.groupBy(*k).agg(F.avg("_y").alias("_rate"), F.count(F.lit(1)).alias("n"))
    cut = F.lit(float(threshold)) if threshold is not None else F.greatest(F.lit(0.5), F.col("_rate"))
    dj = salted_join(d, base, k).withColumn("_hat", (F.col("_p") >= cut).cast("double"))
    yy, pp, hat = F.col("_y"), F.col("_p"), F.col("_hat")
    flat = dj.groupBy(*k).agg(
        F.max("n").alias("n"),
        F.max("_rate").alias("base_rate"),
        F.avg((hat == yy).cast("double")).alias("accuracy"),
        F.avg(-(yy * F.ln(pp) + (1 - yy) * F.ln(1 - pp))).alias("_ll"),
        F.avg(F.pow(pp - yy, 2)).alias("brier"),
        F.coalesce(F.sum(hat * yy) / nz(F.sum(hat)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.sum(hat * yy) / nz(F.sum(yy)), F.lit(0.0)).alias("recall"),
    )
    # positives and positions per distinct score
    pos = value_positions(d, k, "_p")
    per = d.groupBy(*k, "_p").agg(F.sum("_y").alias("_tp"))
    s = pos.join(per, [*k, "_p"])
    rank_sum = s.groupBy(*k).agg(F.sum(F.col("_tp") * (F.col("before") + (F.col("cnt") + 1) / 2)).alias("_rs"), F.sum("_tp").alias("_np"), F.max("total").alias("_n"))
    auc = (F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2) / (F.col("_np") * (F.col("_n") - F.col("_np")))
    ap = average_precision(s, k)
    both = (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    out = flat.join(rank_sum, k).join(ap, k)
    return out.select(
        *keys, "n", "base_rate", "accuracy", "brier", "precision", "recall",
        F.when(both, auc).otherwise(0.5).alias("auc"),
        F.when(both, F.col("_ap")).otherwise(F.col("base_rate")).alias("pr_auc"),
        F.when(both, F.col("_ll")).otherwise(NO_SKILL).alias("log_loss"),
    )


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of precision times recall step over falling scores.

    ``scores`` has one row per distinct score with its count, position and positives.
    Scores are cut by position into ranges; positives above a range come from the
    range totals.
    """
    piece = F.floor(F.col("before") / PIECE_ROWS)
    d = scores.withColumn("_pc", piece)
    tot = d.groupBy(*keys, "_pc").agg(F.sum("_tp").alias("_t"))
    above = Window.partitionBy(*keys).orderBy(F.col("_pc").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_pc", F.coalesce(F.sum("_t").over(above), F.lit(0.0)).alias("_up"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_all_pos"))
    inside = Window.partitionBy(*keys, "_pc").orderBy(F.col("before").desc())
    d = d.join(tot, [*keys, "_pc"]).withColumn("_cum", F.col("_up") + F.sum("_tp").over(inside))
    precision = F.col("_cum") / (F.col("total") - F.col("before"))
    return d.groupBy(*keys).agg((F.sum(precision * F.col("_tp")) / nz(F.max("_all_pos"))).alias("_ap"))


def calibration_bins(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 5) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & (F.col(p) >= 0) & (F.col(p) <= 1))
    g = d.groupBy(*keys, b.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed")
    )
    return g.withColumn("gap", F.col("observed") - F.col("mean_pred"))


def calibration_gap(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys).agg(F.avg(F.abs("gap")).alias("calibration_mae"))


def likelihood_matrix(df: DataFrame, keys: list[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Confusion shares by actual class, log loss, Brier, AUC and the ratio to no skill (keys needed)."""
    up = (F.col(p) >= threshold).cast("double")
    yy = F.col(y).cast("double")
    share = lambda cls, x: F.coalesce(F.avg(F.when(yy == cls, x)), F.lit(0.0))
    g = df.where(yy.isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count_if(yy == 0).alias("n_down"), F.count_if(yy == 1).alias("n_up"),
        share(0, 1 - up).alias("down_down"), share(0, up).alias("down_up"), share(1, 1 - up).alias("up_down"), share(1, up).alias("up_up"),
    )
    c = classification(df, keys, y, p, threshold).select(*keys, "log_loss", "brier", "auc")
    d = g.join(c, keys)
    return d.withColumn("likelihood_ratio", NO_SKILL / F.greatest(F.col("log_loss"), F.lit(1e-6)))


def edge_correlation(df: DataFrame, keys: list[str], p: str, ret: str) -> DataFrame:
    d = df.where(F.col(p).isNotNull() & F.col(ret).isNotNull())
    ok = (F.count(F.lit(1)) >= 6) & (F.stddev_pop(p) >= 1e-12) & (F.stddev_pop(ret) >= 1e-12)
    return d.groupBy(*keys).agg(F.when(ok, F.corr(p, ret)).otherwise(0.0).alias("edge_corr"), F.count(F.lit(1)).alias("n"))


def half_life(d: DataFrame, keys: list[str], x: str, prev: str, min_rows: int = 60) -> DataFrame:
    """AR(1) half-life -ln2/b from the slope of changes on levels; null when b >= 0 or few rows."""
    dx = F.col(x) - F.col(prev)
    g = d.groupBy(*keys).agg(F.regr_slope(dx, F.col(prev)).alias("slope"), F.count(x).alias("n"))
    return g.withColumn("half_life", F.when((F.col("n") >= min_rows) & (F.col("slope") < 0), -math.log(2) / F.col("slope")))


def profit_score(net: str | Column, scale: float = 25.0) -> Column:
    n = F.col(net) if isinstance(net, str) else net
    return F.coalesce(clip(0.5 + 0.5 * n / max(scale, 1.0), 0, 1), F.lit(0.0))


def bottleneck(t_net: str, o_net: str, o_gross: str, cost: str, floor: str) -> Column:
    """First failing reason of a train/test slice."""
    t, o, g, c, f = (F.col(x) for x in (t_net, o_net, o_gross, cost, floor))
    return (
        F.when(o.isNull() & t.isNull(), "insufficient_rows")
        .when(o >= f, "ok")
        .when(g < c, F.concat(F.lit("gross<"), F.format_number(c, 1), F.lit("_cost")))
        .when((t < 0) & (o.isNull() | (o < 0)), "no_edge_train_and_oos")
        .when((t >= 0) & (o < 0), "train_ok_oos_fail")
        .when(o < 0, "oos_negative")
        .when((o >= 0) & (o < f), "oos_below_gate")
        .otherwise("unknown")
    )


# ---- data checks ------------------------------------------------------------


def row_checks(expected: DataFrame, data: DataFrame, floor: int) -> DataFrame:
    """Every expected ticker with its row count and a status; absent ones included."""
    n = data.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    d = expected.select("ticker").distinct().join(n, "ticker", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") < floor, "thin").otherwise("ok"))


def stale_or_missing(expected: DataFrame, panel: DataFrame, bars: DataFrame) -> DataFrame:
    """Tickers whose panel is absent or ends before their bars."""
    p = panel.groupBy("ticker").agg(F.max("ts").alias("panel_ts"))
    b = bars.groupBy("ticker").agg(F.max("ts").alias("bars_ts"))
    d = expected.select("ticker").distinct().join(p, "ticker", "left").join(b, "ticker", "left")
    return d.withColumn("needs_rebuild", F.col("panel_ts").isNull() | F.coalesce(F.col("panel_ts") < F.col("bars_ts"), F.lit(False)))
