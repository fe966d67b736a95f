"""Forward labels.  Functions of (frame, w) run in blocks with ``ahead`` >= the horizon."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import clip
from .blocks import BARS, Layout, along_blocks, block_frame, in_blocks
from .spread import quantiles, salted_join

BPS = 10_000.0
HOLD_BUCKETS = (12, 24, 48, 96, 144, 192, 288)  # fixed values


def forward_return(w: WindowSpec, h: int, x: str = "close") -> Column:
    return F.lead(x, h).over(w) / F.col(x) - 1


def path(w: WindowSpec, h: int) -> Column:
    """Forward returns +1..+h as an array (shorter at the tail)."""
    future = F.collect_list("close").over(w.rowsBetween(1, h))
    return F.transform(future, lambda x: x / F.col("close") - 1)


def path_steps(back: np.ndarray, close: np.ma.MaskedArray, h: int) -> tuple[np.ndarray, Iterator[tuple]]:
    """``path`` on the arrays of ``along_blocks``: its size for each row, and for each step k
    from 1 (k, the path's value k, whether it is there)."""
    size = len(close)
    there, value, row = ~np.ma.getmaskarray(close), close.data, np.arange(size)
    at, seen = np.flatnonzero(there), np.cumsum(there)
    starts = np.flatnonzero(back == 0)
    end = np.repeat([*starts[1:], size], np.diff([*starts, size]))
    n = seen[np.minimum(row + h, end - 1)] - seen

    def steps() -> Iterator[tuple]:
        for k in range(1, (h if len(at) else 0) + 1):
            later = value[at[np.minimum(seen + k - 1, len(at) - 1)]]
            yield k, later / value - 1, there & (k <= n)

    return n, steps()


def adverse(w: WindowSpec, h: int) -> Column:
    low = F.min("close").over(w.rowsBetween(1, h))
    return F.when(low.isNotNull(), F.greatest(-(low / F.col("close") - 1), F.lit(0.0)))


def favourable(w: WindowSpec, h: int) -> Column:
    high = F.max("close").over(w.rowsBetween(1, h))
    return F.when(high.isNotNull(), F.greatest(high / F.col("close") - 1, F.lit(0.0)))


def first_hit(p: Column, level: Column, above: bool) -> Column:
    """1-based bar of the first touch, null where there is none."""
    hits = F.transform(p, lambda x: (x >= level) if above else (x <= level))
    return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0))


def with_hits(df: DataFrame, path_col: str, tp: Column, sl: Column) -> DataFrame:
    """First touches of the four levels: up/down at take-profit and at stop distance."""
    p = F.col(path_col)
    return df.withColumns(
        {
            "_up_tp": first_hit(p, tp, True), "_dn_tp": first_hit(p, -tp, False),
            "_up_sl": first_hit(p, sl, True), "_dn_sl": first_hit(p, -sl, False),
        }
    )


def barrier(win: str, loss: str, path_col: str, h: Column) -> Column:
    """1 when the win level comes first, 0 when the loss level does or time runs out in a
    full window; a partial window without a touch is null."""
    t, s, n = F.col(win), F.col(loss), F.size(path_col)
    return (
        F.when(t.isNotNull() & (s.isNull() | (t < s)), 1.0)
        .when(t.isNotNull() | s.isNotNull(), 0.0)
        .when((n > 0) & (n >= h), 0.0)
    )


def direction(path_col: str, h: Column) -> Column:
    """1 long, 2 short, 0 flat: the first winning barrier; equal bars are flat."""
    won = lambda t, s: F.when(F.col(t).isNotNull() & (F.col(s).isNull() | (F.col(t) < F.col(s))), F.col(t))
    l, s, n = won("_up_tp", "_dn_sl"), won("_dn_tp", "_up_sl"), F.size(path_col)
    return (
        F.when(l.isNotNull() & (s.isNull() | (l < s)), 1.0)
        .when(s.isNotNull() & (l.isNull() | (s < l)), 2.0)
        .when(l.isNotNull(), 0.0)
        .when((n > 0) & (n >= h), 0.0)
    )


HITS = ("_up_tp", "_dn_tp", "_up_sl", "_dn_sl")


def barrier_labels(d: DataFrame, w: WindowSpec, h: int, take_bps: float, stop_bps: float) -> DataFrame:
    """Long, short and direction labels of one barrier spec."""
    d = d.withColumn("_path", path(w, h))
    d = with_hits(d, "_path", F.lit(take_bps / BPS), F.lit(stop_bps / BPS))
    n = F.lit(h)
    return d.withColumns(
        {
            "label_long": barrier("_up_tp", "_dn_sl", "_path", n),
            "label_short": barrier("_dn_tp", "_up_sl", "_path", n),
            "label_direction": direction("_path", n),
        }
    ).drop("_path", *HITS)


def _barriers(back: np.ndarray, close: np.ma.MaskedArray, h: int, take: float, stop: float) -> list[np.ma.MaskedArray]:
    """Forward return of ``h`` bars, long, short and direction label of one barrier spec, greatest
    and least close ahead, one step at a time; NaN is above all numbers, as in Spark."""
    size = len(close)
    n, steps = path_steps(back, close, h)
    none = h + 1
    hits = {c: np.full(size, none) for c in ("up", "dn", "ups", "dns")}
    value, there, fwd = close.data, ~np.ma.getmaskarray(close), np.ma.masked_all(size)
    low, high = np.full(size, np.nan), np.full(size, -np.inf)
    with np.errstate(all="ignore"):
        for k, x, ok in steps:
            for c, on in (("up", (x >= take) | np.isnan(x)), ("dn", x <= -take), ("ups", (x >= stop) | np.isnan(x)), ("dns", x <= -stop)):
                hits[c][on & ok & (hits[c] == none)] = k
        for k in range(1, min(h, size - 1) + 1):
            m = size - k
            later, ok = value[k:], (back[k:] >= k) & there[k:]
            low[:m] = np.where(ok, np.fmin(low[:m], later), low[:m])
            high[:m] = np.where(ok, np.maximum(high[:m], later), high[:m])
            if k == h:
                fwd[:m] = np.ma.array(later / value[:m] - 1, mask=~(ok & there[:m]))
    full = (n > 0) & (n >= h)
    long, short = np.where(hits["up"] < hits["dns"], hits["up"], none), np.where(hits["dn"] < hits["ups"], hits["dn"], none)
    won = lambda x, a, b: np.ma.array((x < none).astype(float), mask=~((a < none) | (b < none) | full))
    way = np.where(long < short, 1.0, np.where(short < long, 2.0, 0.0))
    known = (long < none) | (short < none) | full
    ahead = lambda x: np.ma.array(x, mask=n == 0)
    return [fwd, won(long, hits["up"], hits["dns"]), won(short, hits["dn"], hits["ups"]), np.ma.array(way, mask=~known), ahead(high), ahead(low)]


def barrier_targets(d: DataFrame, h: int, take_bps: float, stop_bps: float, keys: tuple[str, ...] = ("ticker",), order: str = "ts") -> DataFrame:
    """Forward return, long, short and direction labels of one barrier spec, excursion targets.

    Worked on arrays of whole blocks: a frame of Spark's windows would make a list for each
    row.  Take ``d`` after its windows, with the columns to be kept.
    """
    labels = ["fwd_ret", "label_long", "label_short", "label_direction"]
    d = along_blocks(d, ["close"], [*labels, "_high", "_low"], lambda back, close: _barriers(back, close, h, take_bps / BPS, stop_bps / BPS), keys, order)
    target = lambda known, e: clip(F.when(known.isNotNull(), F.greatest(e, F.lit(0.0))) * BPS, 5, 500)
    low, high = F.col("_low"), F.col("_high")
    return d.withColumns({"target_tp_bps": target(high, high / F.col("close") - 1), "target_sl_bps": target(low, -(low / F.col("close") - 1))}).drop("_low", "_high")


def cost_labels(d: DataFrame, w: WindowSpec, h: int, threshold_bps: float) -> DataFrame:
    """After-cost and positive labels of both sides; null where the window runs out."""
    f, thr = F.col("_f"), threshold_bps / BPS
    flag = lambda cond: F.when(f.isNotNull(), cond.cast("double"))
    return d.withColumn("_f", forward_return(w, h)).withColumns(
        {"long_cost": flag(f >= thr), "short_cost": flag(f <= -thr), "long_positive": flag(f > 0), "short_positive": flag(f < 0)}
    ).drop("_f")


#: Columns of a label spec.
SPEC = ("horizon", "label_type", "threshold_bps", "stop_bps")


def with_spec_labels(x: DataFrame, w: WindowSpec, max_h: int) -> DataFrame:
    """Labels of rows that carry their spec; ``w`` reaches ``max_h`` rows ahead."""
    x = x.withColumn("_path", F.slice(path(w, max_h), F.lit(1), F.col("horizon").cast("int")))
    x = with_hits(x, "_path", F.col("threshold_bps") / BPS, F.col("stop_bps") / BPS)
    h, thr = F.col("horizon"), F.col("threshold_bps") / BPS
    full = F.size("_path") >= h
    x = x.withColumn("fwd_ret_entry", F.when(full, F.element_at("_path", -1)))
    f = F.col("fwd_ret_entry")
    pick = lambda barrier_, pos, cost: F.when(F.col("label_type") == "triple_barrier", barrier_).when(f.isNull(), None).when(F.col("label_type") == "positive", pos.cast("double")).otherwise(cost.cast("double"))
    x = x.withColumns(
        {
            "label_entry": pick(barrier("_up_tp", "_dn_sl", "_path", h), f > 0, f >= thr),
            "label_entry_short": pick(barrier("_dn_tp", "_up_sl", "_path", h), f < 0, f <= -thr),
            "_dir": direction("_path", h),
            "target_tp_bps": clip(F.greatest(F.array_max("_path"), F.lit(0.0)) * BPS, 5, 500),
            "target_sl_bps": clip(F.greatest(-F.array_min("_path"), F.lit(0.0)) * BPS, 5, 500),
        }
    )
    l, s = F.col("label_entry"), F.col("label_entry_short")
    plain = F.when(l.isNull() | s.isNull(), None).when((l == 1) & (s != 1), 1.0).when((s == 1) & (l != 1), 2.0).otherwise(0.0)
    x = x.withColumn("label_direction", F.when(F.col("label_type") == "triple_barrier", F.col("_dir")).otherwise(plain))
    for t in ("target_tp_bps", "target_sl_bps"):
        x = x.withColumn(t, F.when(F.size("_path") > 0, F.col(t)))
    return x.drop("_path", "_dir", *HITS)


def spec_labels(df: DataFrame, specs: DataFrame, max_h: int, lay: Layout = BARS) -> DataFrame:
    """Labels from a per-ticker spec table (horizon, label_type, threshold_bps, stop_bps).

    One plan serves every ticker: the path reaches ``max_h`` bars and is cut to each
    ticker's horizon.
    """
    d = salted_join(df, specs.select("ticker", *SPEC), ["ticker"])
    return in_blocks(d, lambda x, w: with_spec_labels(x, w, max_h), ahead=max_h, lay=lay)


def label_rates(df: DataFrame) -> DataFrame:
    """Positive rates and direction shares per ticker."""
    k = F.col("label_direction")
    share = lambda v: F.coalesce(F.avg((k == v).cast("double")), F.lit(0.0))
    return df.groupBy("ticker").agg(
        F.avg("label_entry").alias("long_rate"), F.avg("label_entry_short").alias("short_rate"),
        share(0).alias("direction_flat_rate"), share(1).alias("direction_long_rate"), share(2).alias("direction_short_rate"),
    )


def _legacy(back: np.ndarray, close: np.ma.MaskedArray, returns: tuple[int, ...], h: int, take: float, stop: float, reaches: tuple[int, ...]) -> list[np.ma.MaskedArray]:
    """Forward returns, the long barrier label of ``h`` bars, and (adverse, favourable) of each
    reach, one step ahead at a time.  Nulls ahead are skipped; NaN is above all numbers, as in
    Spark's own comparisons."""
    size = len(close)
    value, there = close.data, ~np.ma.getmaskarray(close)
    fwd = {k: np.ma.masked_all(size) for k in returns}
    label, excursions = np.ma.masked_all(size), {}
    low, high, seen, open_ = np.full(size, np.nan), np.full(size, -np.inf), np.zeros(size, dtype=int), there.copy()
    with np.errstate(all="ignore"):
        for k in range(1, max(*returns, h, *reaches) + 1):
            n = max(size - k, 0)
            later, ok = value[k:], (back[k:] >= k) & there[k:]
            x = later / value[:n] - 1
            if k in fwd:
                fwd[k][:n] = np.ma.array(x, mask=~(ok & there[:n]))
            low[:n] = np.where(ok, np.fmin(low[:n], later), low[:n])
            high[:n] = np.where(ok, np.maximum(high[:n], later), high[:n])
            seen[:n] += ok
            if k <= h:
                up, down = ok & open_[:n] & ((x >= take) | np.isnan(x)), ok & open_[:n] & (x <= -stop)
                label[:n][up | down] = (up & ~down)[up | down]
                open_[:n] &= ~(up | down)
            if k == h:
                label[np.ma.getmaskarray(label) & (seen >= h)] = 0.0
            if k in reaches:
                worst, best = (np.where(there, np.maximum(e, 0.0), 0.0) for e in (-(low / value - 1), high / value - 1))
                excursions[k] = [np.ma.array(e, mask=seen == 0) for e in (worst, best)]
    return [*fwd.values(), label, *[e for k in reaches for e in excursions[k]]]


def legacy_labels(d: DataFrame, w: WindowSpec, base: int = 12, old: int = 20, old_threshold: float = 0.01, cost_bps: float = 5.2, stop_bps: float = 45.0, keys: tuple[str, ...] = ("ticker",), order: str = "ts") -> DataFrame:
    """The older label set; its integer labels count the null tail as zero.  Worked on arrays
    of whole blocks: frames of Spark's windows would go over up to 96 rows anew for each row."""
    reaches = (20, 48, 96)
    names = [f"fwd_ret_{base}", f"fwd_ret_{old}", f"label_barrier_{old}", *[f"{n}_{h}" for h in reaches for n in ("mae", "mfe")]]
    d = along_blocks(d, ["close"], names, lambda back, close: _legacy(back, close, (base, old), old, cost_bps / BPS, stop_bps / BPS, reaches), keys, order)
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    a, b = F.col(f"fwd_ret_{base}"), F.col(f"fwd_ret_{old}")
    return d.withColumns({
        f"label_{base}_positive": flag(a > 0), f"label_{base}_after_costs": flag(a >= cost_bps / BPS),
        f"label_{old}_1pct": flag(b >= old_threshold), f"label_{old}_after_costs": flag(b >= cost_bps / BPS),
    })


def best_hold(d: DataFrame, w: WindowSpec, buckets: tuple[int, ...] = HOLD_BUCKETS) -> DataFrame:
    """Bucket with the best forward return, the shortest of equals."""
    fwd = {b: forward_return(w, b) for b in buckets}
    cand = F.array_compact(F.array(*[F.when(f.isNotNull(), F.struct(f.alias("f"), F.lit(-b).alias("h"))) for b, f in fwd.items()]))
    return d.withColumn("best_hold", -F.array_max(cand)["h"])


def _median_shares(back: np.ndarray, close: np.ma.MaskedArray, horizons: tuple[int, ...]) -> list[np.ma.MaskedArray]:
    """(median, share at or above it, count) of each block's forward returns, horizon by horizon."""
    value, there = close.data, ~np.ma.getmaskarray(close)
    ends = [*np.flatnonzero(back == 0), len(value)]
    found = np.ma.masked_all((3 * len(horizons), len(ends) - 1))
    with np.errstate(all="ignore"):
        for j, (a, b) in enumerate(zip(ends, ends[1:])):
            for i, h in enumerate(horizons):
                known = there[a : b - h] & there[a + h : b] if b - a > h else there[:0]
                n = int(known.sum())
                if not n:
                    continue
                f = np.sort(value[a + h : b][known] / value[a : b - h][known] - 1)
                p = 0.5 * (n - 1)
                lo, hi = f[int(np.floor(p))], f[int(np.ceil(p))]
                median = lo + (hi - lo) * (p - np.floor(p))
                found[3 * i : 3 * i + 3, j] = median, float(((f >= median) | np.isnan(f)).sum()) / n, n
    return list(found)


def median_shares(df: DataFrame, horizons: tuple[int, ...], lay: Layout = BARS) -> DataFrame:
    """(keys, rank, horizon, threshold, rate, n): median of the forward returns of each horizon
    and the share of returns at or above it.  Series of one block are worked as arrays, many
    at once; the returns of longer ones are ranked by positions."""
    keys = list(lay.keys)
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > lay.rows).select(*keys)
    names = [f"_{c}{h}" for h in horizons for c in ("t", "r", "n")]
    arms = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(h).alias("horizon"), F.col(f"_t{h}").alias("threshold"), F.col(f"_r{h}").alias("rate"), F.col(f"_n{h}").cast("bigint").alias("n")) for i, h in enumerate(horizons)])
    d, _ = block_frame(df.join(long, keys, "left_anti"), lay=lay)
    d = along_blocks(d, ["close"], names, lambda back, close: _median_shares(back, close, horizons), lay.keys, lay.order[0], heads=True)
    whole = d.select(*keys, F.inline(arms)).where(F.col("n").isNotNull())

    arms = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for i, h in enumerate(horizons)])
    d = in_blocks(df.join(long, keys, "left_semi"), lambda x, w: x.withColumns({f"_f{h}": forward_return(w, h) for h in horizons}), ahead=max(horizons), lay=lay)
    d = d.select(*keys, F.inline(arms)).where(F.col("fwd").isNotNull())
    med = quantiles(d, [*keys, "horizon"], "fwd", {"threshold": 0.5})
    cut = salted_join(d, med, [*keys, "horizon"]).groupBy(*keys, "rank", "horizon", "threshold").agg(
        F.avg((F.col("fwd") >= F.col("threshold")).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    return whole.unionByName(cut)


def balanced_horizon(df: DataFrame, horizons: tuple[int, ...] = (5, 10, 15, 20, 21, 42, 63), rate: float = 0.5, least: int = 100, lay: Layout = BARS) -> DataFrame:
    """Per ticker the horizon whose share of returns at or above their median is nearest
    ``rate``, the first of equals; horizons with under ``least`` returns do not count.
    A ticker without such a horizon has the first one, threshold 0 and rate 0.5."""
    share = median_shares(df, horizons, lay).where(F.col("n") >= least)
    order = F.struct(F.round(F.abs(F.col("rate") - rate), 12), F.col("rank"))
    best = share.groupBy(*lay.keys).agg(F.min_by(F.struct("horizon", "threshold", "rate", "n"), order).alias("_b"))
    every = df.select(*lay.keys).distinct().join(best, list(lay.keys), "left")
    known = lambda c, d: F.coalesce(F.col(f"_b.{c}"), F.lit(d)).alias(c)
    return every.select(*lay.keys, known("horizon", horizons[0]), known("threshold", 0.0), known("rate", 0.5), known("n", 0))


def balanced_labels(df: DataFrame, horizons: tuple[int, ...] = (5, 10, 15, 20, 21, 42, 63), lay: Layout = BARS) -> DataFrame:
    """Median-split labels and excursion targets at each ticker's balanced horizon, with its rate."""
    pick = balanced_horizon(df, horizons, lay=lay)
    d = salted_join(df, pick.select(*lay.keys, "horizon", "threshold", "rate"), list(lay.keys))
    at = lambda make: F.coalesce(*[F.when(F.col("horizon") == h, make(h)) for h in horizons])

    def stage(x: DataFrame, w: WindowSpec) -> DataFrame:
        return x.withColumns({
            "fwd": at(lambda h: forward_return(w, h)),
            "target_tp_bps": clip(at(lambda h: favourable(w, h)) * BPS, 5, 500),
            "target_sl_bps": clip(at(lambda h: adverse(w, h)) * BPS, 5, 500),
        })

    d = in_blocks(d, stage, ahead=max(horizons), lay=lay)
    f, t = F.col("fwd"), F.col("threshold")
    return d.withColumns({
        "label_balanced": F.when(f.isNotNull(), (f >= t).cast("double")),
        "label_balanced_short": F.when(f.isNotNull(), (f <= -t).cast("double")),
    })


def excursion_targets(d: DataFrame, w: WindowSpec, h: int) -> DataFrame:
    return d.withColumns({"target_tp_bps": clip(favourable(w, h) * BPS, 5, 500), "target_sl_bps": clip(adverse(w, h) * BPS, 5, 500)})


def candidate_specs(floors: DataFrame, horizons=(12, 24, 36, 48, 72, 96), types=("triple_barrier", "after_costs"), mults=(1.0, 1.25, 1.5)) -> DataFrame:
    """(ticker, cost_floor_bps) to every label candidate; the grid is a fixed literal."""
    grid = [(h, t, m) for h in horizons for t in types for m in ((1.0,) if t == "positive" else mults)]
    lits = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(t).alias("label_type"), F.lit(m).alias("threshold_mult")) for h, t, m in grid])
    d = floors.select("ticker", "cost_floor_bps", F.inline(lits))
    return d.withColumn("threshold_bps", F.round(F.col("cost_floor_bps") * F.col("threshold_mult"), 2))


def class_edges(df: DataFrame, keys: list[str], label: str, fwd: str) -> DataFrame:
    """Mean forward basis points per direction class; shorts count with their sign turned."""
    k, f = F.col(label), F.col(fwd) * BPS
    mean = lambda v, s=1: F.coalesce(F.avg(F.when(k == v, s * f)), F.lit(0.0))
    return df.where(k.isNotNull() & F.col(fwd).isNotNull()).groupBy(*keys).agg(
        mean(0).alias("flat_edge_bps"), mean(1).alias("long_edge_bps"), mean(2, -1).alias("short_edge_bps"), F.count(F.lit(1)).alias("n")
    )
