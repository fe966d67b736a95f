"""Signals, gates, sizing, exits and turnover."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.frames import clip, nz, zero
from ..functions.regimes import dominant
from .blocks import BARS, Layout, in_blocks, running
from .labels import first_hit, path
from ..sources.store import stage as written
from .spread import quantiles, salted_join

BPS = 10_000.0


# ---- gates ------------------------------------------------------------------


def regime_gate(*, stress_max: float = 0.35, impulse_min: float = 0.25, conf_min: float | None = 0.30, entropy_max: float | None = None, allow_mean_revert: bool = True) -> Column:
    i, m, s = zero("p_imp", 0.33), zero("p_mr", 0.33), zero("p_st", 0.34)
    on = F.coalesce(F.col("risk_on"), F.lit(True))
    gate = (s <= stress_max) & (on | (i >= impulse_min + 0.1)) & ((i >= impulse_min) | (F.lit(allow_mean_revert) & (m >= 0.35)))
    if conf_min is not None:
        gate = gate & (zero("conf", 0.33) >= conf_min)
    if entropy_max is not None:
        gate = gate & (zero("prob_entropy") <= entropy_max)
    return gate


def signed_edge_ok(edge="expected_edge_bps", side="position_side", least="min_edge_bps") -> Column:
    e, s, m = S.c(edge), S.c(side), S.c(least)
    hit = F.when(s > 0, e >= m).when(s < 0, e <= -m).otherwise(False)
    return F.coalesce(hit & (m > 0), F.lit(False))


def side_ok(sides="sides", side="position_side") -> Column:
    s = S.c(side)
    return F.when(s > 0, F.col(sides) != "short").when(s < 0, F.col(sides) != "long").otherwise(True)


def tail_skip(stress_at: float = 0.42, vol_at: float = 0.22, ratio_at: float = 1.35) -> Column:
    high = F.coalesce(F.col("vol_ann") >= vol_at, F.lit(False)) | F.coalesce(F.col("vol_ratio") >= ratio_at, F.lit(False))
    return F.coalesce(F.col("p_st") >= stress_at, F.lit(False)) & high


def scored_panel(df: DataFrame, *, buy: float = 55.0, move: float = 40.0, hard_gate: bool = False) -> DataFrame:
    """Impulse, regime gate, signed score and side, expected edge."""
    d = S.signed_score(S.impulse_strength(df), "impulse", buy, move).withColumn("gate", regime_gate())
    return d.withColumn("score", F.when(F.col("gate"), F.col("score")).otherwise(0.0)) if hard_gate else d


def active_entries(df: DataFrame, impulse_min: float = 0.02) -> DataFrame:
    """Edge, impulse and side policy together."""
    ok = signed_edge_ok() & (F.col("impulse") >= impulse_min) & side_ok()
    return df.withColumn("active", ok)


def edge_stats(df: DataFrame, keys: list[str], edge: str = "expected_edge_bps", q: float = 0.65, signed: bool = False) -> DataFrame:
    """Largest, q-quantile and count of positive edges (or of edge sizes)."""
    x = F.col(edge) if signed else F.abs(edge)
    d = df.select(*keys, x.alias("_e")).where(F.col("_e").isNotNull())
    d = d.where(F.col("_e") > 0) if signed else d
    g = d.groupBy(*keys).agg(F.max("_e").alias("max_edge"), F.count(F.lit(1)).alias("n"))
    return g.join(quantiles(d, keys, "_e", {"q_edge": q}), keys)


def capped_edge(calibrated: Column, floor: Column, cap: float = 60.0) -> Column:
    """Calibrated edge lowered where the panel cannot reach it."""
    feasible = F.greatest(floor * 0.5, F.when(F.col("q_edge") > 0, F.col("q_edge")).otherwise(F.col("max_edge")))
    out = F.when((F.col("max_edge") > 0) & (F.col("max_edge") < calibrated), F.least(calibrated, feasible)).otherwise(calibrated)
    return F.least(F.greatest(out, floor * 0.5), F.lit(cap))


def search_bounds(calibrated: Column, floor: Column, span: float = 10.0) -> tuple[Column, Column]:
    hi = F.greatest(floor + span, F.least(calibrated + 5, floor + 2 * span))
    hi, lo = F.when(F.col("max_edge") > 0, F.least(hi, "max_edge")).otherwise(hi), F.when(F.col("max_edge") > 0, F.least(floor, "max_edge")).otherwise(floor)
    half = lambda x: F.bround(x * 2) / 2
    return half(lo), F.when(half(lo) >= half(hi), half(lo) + 0.5).otherwise(half(hi))


# ---- signal frames ----------------------------------------------------------


def flow_signals(df: DataFrame, *, gain: float = 100.0, buy: float = 55.0, hold: float = 50.0) -> DataFrame:
    """Tradable rows: score, bands, calibrated and tightened exits, side, exit horizon.

    ``df`` carries proba, regime context, the optional pred_tp_bps / pred_sl_bps and the
    label spec (threshold_bps, horizon) of its ticker.
    """
    d = df.withColumns({"score": S.gain_score(gain=gain), **S.bands(buy, F.lit(hold))})
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    sl = F.when(have("pred_sl_bps") > 0, have("pred_sl_bps")).otherwise(45.0)
    tp = F.when(have("pred_tp_bps") > 0, have("pred_tp_bps")).when(have("threshold_bps") > 0, have("threshold_bps")).otherwise(47.5)
    d = d.withColumns({"_tp": tp, "_sl": sl})
    t, s = S.calibrated_exits("_tp", "_sl")
    d = d.withColumns({"take_profit_bps": t, "stop_loss_bps": s})
    sc, given = F.col("score"), F.coalesce(have("position_side"), F.lit(0))
    side = F.when(sc <= 0, 0).when(given != 0, given).when(sc >= F.col("buy_threshold"), 1).when(sc <= F.col("sell_threshold"), -1).otherwise(0)
    return d.withColumns({"stop_loss_bps": S.tightened_stop("stop_loss_bps"), "position_side": side, "exit_horizon": F.coalesce(have("horizon"), F.lit(48)).cast("int")}).drop("_tp", "_sl")


def with_policies(df: DataFrame, policies: DataFrame, keys: list[str], base: dict[str, float]) -> DataFrame:
    """Per-key policy values over base values (one join, no per-fold recursion)."""
    p = policies.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in base])
    d = salted_join(df, p, keys, "left")
    return d.withColumns({c: F.coalesce(F.col(f"_p_{c}"), F.lit(v)) for c, v in base.items()}).drop(*[f"_p_{c}" for c in base])


def tradable_rows(df: DataFrame) -> DataFrame:
    """Rows that may be entered, long or short, by side or by score."""
    side, sc = F.coalesce(F.col("position_side"), F.lit(0)), F.col("score")
    long_ok = S.may_enter("score", "risk_on", "buy_threshold")
    short_ok = (sc > 0) & (F.col("risk_on") | (sc <= F.col("sell_threshold") - 5)) & (sc <= F.col("sell_threshold")) & (sc < F.col("buy_threshold"))
    ok = F.when(side == 1, long_ok).when(side == -1, short_ok).when(sc <= 0, False).otherwise(long_ok | short_ok)
    return df.where(ok)


# ---- de-overlap -------------------------------------------------------------


def grid_positions(prices: DataFrame, lay: Layout = BARS) -> DataFrame:
    """(ts, gpos): position of every time on the union grid of the price table."""
    return in_blocks(prices.select("ts").distinct(), lambda d, w: d.withColumn("gpos", F.col("_pos")), lay=lay.with_(keys=(), order=("ts",)))


#: Rows of the key blocks that go to Python together.
PACK_ROWS = 1 << 15


def _sorted_groups(pdf: pd.DataFrame, by: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by group and position, each row's group number, and each group's first row."""
    code = pdf.groupby(by, sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["_p"].to_numpy(), code))
    code = code[order]
    return pdf.iloc[order], code, np.flatnonzero(np.diff(code, prepend=-1))


def _next_free(code: np.ndarray, pos: np.ndarray, h: np.ndarray, max_h: int):
    """(at, nxt): a function from group numbers and positions to the first row of the group
    at or after the position, or the next group's first row; and that of every row's end."""
    low = int(pos.min())
    span = int(pos.max()) - low + 2 * max_h + 3
    key = code * span + (pos - low)
    at = lambda c, p: np.searchsorted(key, c * span + np.clip(p - low, 0, span - 1))
    return at, at(code, pos + h)


def _entry_tables(code: np.ndarray, first: np.ndarray, pos: np.ndarray, h: np.ndarray, start: np.ndarray, max_h: int) -> np.ndarray:
    """For each group and offset 0..max_h of the first free position into its block: the
    first free position after the block when entries are taken greedily."""
    at, nxt = _next_free(code, pos, h, max_h)
    n = len(pos)
    inside = (nxt < n) & (code[np.minimum(nxt, n - 1)] == code)
    last = np.where(inside, nxt, np.arange(n))
    while (further := last[last] != last).any():  # jumps double until every chain is at its end
        last = np.where(further, last[last], last)
    after = (pos + h)[last]
    free = start[:, None] + np.arange(max_h + 1)
    own = np.arange(len(first))[:, None]
    hit = at(np.broadcast_to(own, free.shape), free)
    end = np.append(first[1:], n)[:, None]
    return np.where(hit < end, after[np.minimum(hit, n - 1)], free)


def deoverlap(signals: DataFrame, keys: list[str], max_h: int, *, pos: str = "gpos", horizon: str = "exit_horizon", block: int = 8192, fan: int = 256) -> DataFrame:
    """Greedy non-overlapping entries per key: an entry at ``pos`` blocks the key until
    ``pos + horizon``.

    The greedy chain depends on order, but a block of positions can only be entered
    at max_h + 1 offsets, so its effect is a small table.  Tables of blocks combine into
    tables of ``fan`` blocks; one pass over those gives every block its entry state, and
    the rows are then chosen block by block.  Blocks of many keys go to Python together
    and are worked at once, in packs of bounded size, so keys of few rows cost no call each.
    Where all positions lie in one block, there is no state to bring to it.
    """
    if block < max_h:
        raise ValueError("a block must be at least as long as the longest horizon")
    k = list(keys)
    sup = block * fan
    d = signals.withColumns({"_h": F.greatest(F.lit(1), F.col(horizon).cast("bigint")), "_p": F.col(pos).cast("bigint")})
    d = d.withColumn("_h", F.when(F.assert_true(F.col("_h") <= max_h, F.lit("horizon above max_h")).isNull(), F.col("_h")))
    d = written(d.withColumns({"_blk": F.floor(F.col("_p") / block), "_sup": F.floor(F.col("_p") / sup)}))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.select(*k).schema)
    known = d.select(*k, "_sup", "_blk", "_p", "_h").dropna()  # the rows are found by key and position
    rows, lo, hi = known.agg(F.count(F.lit(1)), F.min("_blk"), F.max("_blk")).first()
    packs = F.lit(max(1, -(-rows // PACK_ROWS)))

    def in_packs(df: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
        return df.withColumn("_pack", F.pmod(F.xxhash64(*by), packs)).groupBy("_pack").applyInPandas(fn, schema)

    def each(by: list[str], fn):
        return lambda pdf: pd.concat([fn(g) for _, g in pdf.groupby(by, sort=False)])

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, code, first = _sorted_groups(pdf, [*k, "_blk"])
        heads = pdf.iloc[first]
        t = _entry_tables(code, first, pdf["_p"].to_numpy(), pdf["_h"].to_numpy(), heads["_blk"].to_numpy() * block, max_h)
        return heads[k + ["_sup", "_blk"]].assign(_t=list(t))

    def through(free: np.ndarray, blocks, width: int) -> list[np.ndarray]:
        """State before each block of a run, and after the last."""
        states = [free]
        for b, t in blocks:
            t = np.asarray(t)
            free = t[np.clip(free - b * width, 0, max_h)]
            free = np.maximum(free, states[-1])
            states.append(free)
        return states

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        start = int(pdf["_sup"].iloc[0]) * sup
        end = through(start + np.arange(max_h + 1), zip(pdf["_blk"], pdf["_t"]), block)[-1]
        return pdf.iloc[:1][k + ["_sup"]].assign(_t=[end.tolist()])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sup")
        states = through(np.array([0]), zip(pdf["_sup"], pdf["_t"]), sup)[:-1]
        return pdf[k + ["_sup"]].assign(_free=[int(s[0]) for s in states])

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        states = through(np.array([int(pdf["_free"].iloc[0])]), zip(pdf["_blk"], pdf["_t"]), block)[:-1]
        return pdf[k + ["_blk"]].assign(_free=[int(s[0]) for s in states])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, code, first = _sorted_groups(pdf, [*k, "_blk"])
        at, nxt = _next_free(code, pdf["_p"].to_numpy(), pdf["_h"].to_numpy(), max_h)
        chain = np.arange(len(first))
        now = at(chain, pdf["_free"].to_numpy()[first])
        keep = np.zeros(len(pdf), dtype=bool)
        while True:  # one entry of every chain at a time
            live = now < len(pdf)
            live[live] = code[now[live]] == chain[live]
            now, chain = now[live], chain[live]
            if not len(now):
                return pdf[k + ["_p"]][keep]
            keep[now] = True
            now = nxt[now]

    if lo == hi:
        entered = known.withColumn("_free", F.lit(0).cast("bigint"))
    else:
        level1 = in_packs(known, [*k, "_blk"], tables, f"{key_schema}, _sup bigint, _blk bigint, _t array<bigint>")
        level2 = in_packs(level1, [*k, "_sup"], each([*k, "_sup"], combine), f"{key_schema}, _sup bigint, _t array<bigint>")
        entry2 = in_packs(level2, k, each(k, walk), f"{key_schema}, _sup bigint, _free bigint")
        entry1 = in_packs(level1.join(entry2, [*k, "_sup"]), [*k, "_sup"], each([*k, "_sup"], spread), f"{key_schema}, _blk bigint, _free bigint")
        entered = known.join(entry1, [*k, "_blk"])
    chosen = in_packs(entered, [*k, "_blk"], choose, f"{key_schema}, _p bigint")
    return d.join(chosen, [*k, "_p"], "left_semi").select(*signals.columns)


def net_returns(df: DataFrame, ret: str, cost: str = "round_trip_bps", side: str | None = None) -> DataFrame:
    """Return after the round trip; shorts earn the negative move."""
    gross = F.col(ret) if side is None else F.when(F.col(side) < 0, -F.col(ret)).otherwise(F.col(ret))
    return df.withColumn("net_ret", gross - F.col(cost) / BPS)


def horizon_values(entries: DataFrame, prices: DataFrame, horizons: tuple[int, ...], cost_bps: float, lay: Layout = BARS) -> DataFrame:
    """De-overlapped after-cost value per (regime, horizon).

    ``entries`` has ticker, ts, regime; forward prices are read ``h`` rows on in the union
    grid, and only where the ticker has a bar there.
    """
    grid = grid_positions(prices, lay)
    px = prices.select("ticker", "ts", "close").join(grid, "ts")
    e = entries.select("ticker", "ts", "regime").join(px, ["ticker", "ts"])
    e = e.withColumn("exit_horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    kept = deoverlap(e, ["ticker", "regime", "exit_horizon"], max(horizons))
    later = px.select("ticker", F.col("gpos").alias("_g"), F.col("close").alias("_c1"))
    r = kept.withColumn("_g", F.col("gpos") + F.col("exit_horizon")).join(later, ["ticker", "_g"])
    net = F.col("_c1") / F.col("close") - 1 - cost_bps / BPS
    g = r.groupBy("regime", "exit_horizon").agg(F.count(F.lit(1)).alias("n_trades"), F.avg(net).alias("_m"), F.stddev_samp(net).alias("_s"))
    t = F.when((F.col("n_trades") > 1) & (F.col("_s") > 1e-12), F.col("_m") / (F.col("_s") / F.sqrt("n_trades"))).otherwise(0.0)
    return g.select("regime", F.col("exit_horizon").alias("horizon"), "n_trades", (F.col("_m") * BPS).alias("ev_bps"), t.alias("ev_tstat"))


def pick_horizons(values: DataFrame, default: int, min_trades: int = 20) -> DataFrame:
    """Best paying horizon per regime with enough trades, else the default."""
    ok = (F.col("n_trades") >= min_trades) & (F.col("ev_bps") > 0)
    best = F.max_by("horizon", F.when(ok, F.struct("ev_bps", "ev_tstat", "n_trades")))
    return values.groupBy("regime").agg(F.coalesce(best, F.lit(default)).alias("chosen_horizon"), (F.count_if(ok) == 0).alias("is_default"))


# ---- sizing -----------------------------------------------------------------


def inverse_vol_budget(vols: DataFrame, max_w: float = 0.35) -> DataFrame:
    """Inverse-vol weights capped at ``max_w``, the excess shared out in proportion.

    With weights in falling order the capped names are a prefix: the k-th stays capped
    while its share of what the capped ones leave is above the cap.  One row per name.
    """
    inv = 1 / F.greatest(F.col("vol"), F.lit(1e-4))
    d = vols.withColumn("_i", inv)
    every = Window.partitionBy(F.lit(0))
    d = d.withColumn("_raw", F.col("_i") / F.sum("_i").over(every)).withColumn("_n", F.count(F.lit(1)).over(every))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_raw").desc(), "ticker")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_k": F.row_number().over(order) - 1, "_cum": zero(F.sum("_raw").over(before))})
    share = F.col("_raw") * (1 - F.col("_k") * max_w) / nz(1 - F.col("_cum"))
    d = d.withColumn("_capped", (share > max_w + 1e-12).cast("int"))
    d = d.withColumn("_c", F.min("_capped").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({"_m": F.sum("_c").over(every), "_left": 1 - F.sum(F.when(F.col("_c") == 1, F.col("_raw")).otherwise(0.0)).over(every)})
    equal = F.least(F.lit(max_w), 1 / F.col("_n"))
    w = F.when(F.col("_m") * max_w >= 1, equal).when(F.col("_m") == F.col("_n"), equal).when(F.col("_c") == 1, max_w).otherwise((1 - F.col("_m") * max_w) * F.col("_raw") / F.col("_left"))
    return d.withColumn("weight", w).drop("_i", "_raw", "_n", "_k", "_cum", "_capped", "_c", "_m", "_left")


def with_totals(df: DataFrame, by: str, **totals: Column) -> DataFrame:
    """Rows with the totals of their ``by``: summed before the shuffle and joined back, so
    the rows of one time never meet in one task."""
    return salted_join(df, df.groupBy(by).agg(*[t.alias(n) for n, t in totals.items()]), [by])


def vol_target_weights(picks: DataFrame, *, max_w: float = 0.20, target: float = 0.12, freeze: float = 1.5) -> DataFrame:
    """Weights per date from score and vol: none in a vol freeze, capped per name, the
    gross scaled by the market's vol ratio."""
    vol = F.when(F.col("vol_ann").isNull() | (F.col("vol_ann") < 0.05), 0.25).otherwise(F.col("vol_ann"))
    gross = F.col("exposure_cap") * F.least(F.lit(1.0), 1 / F.greatest(F.col("bench_vol_ratio"), F.lit(0.75)))
    raw = F.col("position_side") * (target / vol) * (0.75 + 0.5 * F.col("score") / 100)
    d = picks.where(F.col("bench_vol_ratio") <= freeze).withColumns({"_raw": raw, "_gross": gross})
    d = with_totals(d, "ts", _t=F.sum(F.abs("_raw"))).where(F.col("_t") > 0)
    d = d.withColumn("_w", F.signum("_raw") * F.least(F.lit(max_w), F.abs("_raw") / F.col("_t") * F.col("_gross")))
    d = with_totals(d, "ts", _tw=F.sum(F.abs("_w")))
    scale = F.when(F.col("_tw") > F.col("_gross"), F.col("_gross") / F.col("_tw")).otherwise(1.0)
    return d.withColumn("weight", F.col("_w") * scale).drop("_raw", "_gross", "_t", "_w", "_tw")


def normalised(df: DataFrame, w: str = "weight", signed: bool = False, by: str = "ts") -> DataFrame:
    x = F.col(w) if signed else F.greatest(F.col(w), F.lit(0.0))
    d = with_totals(df, by, _t=F.sum(F.abs(x)))
    return d.where(F.col("_t") > 1e-9).withColumn(w, x / F.col("_t")).drop("_t")


def tilted(book: DataFrame, budget: float) -> DataFrame:
    """(ts, ticker, base, picked): shift ``budget`` of the core book to the picked names."""
    b = min(max(budget, 0.0), 1.0)
    rest = F.sum(F.when(~F.col("picked"), F.col("base")).otherwise(0.0))
    d = with_totals(book, "ts", _k=F.count_if("picked"), _rest=rest)
    cut = F.when((F.col("_k") > 0) & (F.col("_rest") > 1e-9), F.greatest(F.lit(0.0), F.col("base") - b * F.col("base") / F.col("_rest"))).otherwise(F.col("base"))
    w = F.when(F.col("picked"), F.col("base") + b / F.col("_k")).otherwise(cut)
    return normalised(d.withColumn("weight", w).drop("_k", "_rest"))


def first_exits(df: DataFrame, max_h: int, lay: Layout = BARS) -> DataFrame:
    """Entry rows (``entry`` true) with the bar, reason and return of their first exit:
    take-profit, stop or horizon, whichever comes first; stop before target on one bar."""

    def stage(d: DataFrame, w) -> DataFrame:
        sign = F.when(F.col("position_side") < 0, -1.0).otherwise(1.0)
        d = d.withColumn("_path", F.when(F.col("entry"), F.slice(path(w, max_h), F.lit(1), F.col("exit_horizon"))))
        d = d.withColumn("_path", F.transform("_path", lambda x: x * sign))
        return d.withColumns({"_tp": first_hit(F.col("_path"), F.col("take_profit_bps") / BPS, True), "_sl": first_hit(F.col("_path"), -F.col("stop_loss_bps") / BPS, False)})

    d = in_blocks(df, stage, ahead=max_h, lay=lay).where(F.col("entry") & (F.size("_path") > 0))
    bar = F.least(F.col("_tp"), F.col("_sl"), F.size("_path"))
    reason = F.when(F.col("_sl") == bar, "stop").when(F.col("_tp") == bar, "take_profit").when(F.size("_path") < F.col("exit_horizon"), "open").otherwise("horizon")
    return d.withColumns({"exit_bar": bar, "exit_reason": reason, "exit_ret": F.get("_path", bar.cast("int") - 1)}).drop("_path", "_tp", "_sl")


# ---- turnover ---------------------------------------------------------------


def weight_changes(weights: DataFrame, lay: Layout = BARS) -> DataFrame:
    """(ts, idx, ticker, weight) to every change between consecutive dates, exits included.

    A name missing on the next date leaves there; no full grid is built.
    """
    weights = written(weights.select("ts", "ticker", "weight"))
    dates = in_blocks(weights.select("ts").distinct(), lambda d, w: d.withColumn("idx", F.col("_pos")), lay=lay.with_(keys=(), order=("ts",)))
    w = weights.select("ts", "ticker", "weight").join(dates, "ts")

    def stage(d: DataFrame, win) -> DataFrame:
        came = F.when(F.lag("idx").over(win) == F.col("idx") - 1, F.lag("weight").over(win)).otherwise(0.0)
        stays = F.coalesce(F.lead("idx").over(win) == F.col("idx") + 1, F.lit(False))
        return d.withColumns({"prev": came, "_leaves": ~stays})

    d = in_blocks(w, stage, back=1, ahead=1, lay=lay)
    gone = d.where("_leaves").select((F.col("idx") + 1).alias("idx"), "ticker", F.col("weight").alias("prev"), F.lit(0.0).alias("weight"))
    gone = gone.join(dates, "idx")  # drops the step after the last date
    return d.select("ts", "idx", "ticker", "prev", "weight").unionByName(gone.select("ts", "idx", "ticker", "prev", "weight"))


def turnover(changes: DataFrame, cost_bps: float, band: float = 0.0) -> DataFrame:
    """Traded weight and its cost per date; ``band`` keeps held names whose target moved less."""
    dw = F.col("weight") - F.col("prev")
    kept = (F.col("prev") > 0) & (F.abs(dw) < band) & (F.col("weight") != 0)
    moved = F.when(kept, 0.0).otherwise(F.abs(dw)) if band > 0 else F.abs(dw)
    g = changes.groupBy("ts").agg(F.sum(moved).alias("turnover"))
    return g.withColumn("cost", F.col("turnover") * cost_bps / BPS)


def trade_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Eligible rows, dates with a position and mean exposure."""
    rows = df.groupBy(*keys).agg(F.count_if("active").alias("signal_rows"))
    per = df.groupBy(*keys, "ts").agg(F.sum(F.abs("weight")).alias("_x"))
    held = per.groupBy(*keys).agg(F.count_if(F.col("_x") > 0).alias("active_rebalances"), (100 * F.avg("_x")).alias("avg_exposure_pct"))
    return rows.join(held, keys)
