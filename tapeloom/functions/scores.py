"""Row-level score, cost, gate and policy expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXITS, Exits
from .frames import bound, clip, nz, zero

EDGE_CAP_BPS, EDGE_BUFFER_BPS = 60.0, 2.0


def c(x: str | float | Column) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


# ---- costs and floors -------------------------------------------------------


def edge_floor(commission, slippage, *, mode: str = "full_round_trip", buffer: float = EDGE_BUFFER_BPS, stop: float = EXITS.stop_bps) -> Column:
    """Least predicted edge worth trading, by mode."""
    com, slip = c(commission), c(slippage)
    if mode == "full_round_trip":
        return 2 * (com + slip) + buffer
    if mode == "stop_plus_commission":
        return stop + 2 * com + slip + buffer
    return 2 * com + buffer


def min_edge(requested, floor, calibrated=None, *, fallback: float = 0.0, cap: float = EDGE_CAP_BPS) -> Column:
    """Requested edge raised to the floor, a fallback and a calibrated value, then capped."""
    out = F.greatest(c(requested), c(floor))
    if fallback > 0:
        out = F.greatest(out, F.lit(min(fallback, cap)))
    if calibrated is not None:
        out = F.greatest(out, F.when(c(calibrated).isNotNull(), F.least(c(calibrated), F.lit(cap))))
    return F.least(out, F.lit(cap))


def calibrated_exits(take, stop, x: Exits = EXITS) -> tuple[Column, Column]:
    tp, sl = c(take), c(stop)
    live = (tp > 0) & (sl > 0)
    s = F.least(F.greatest(sl, F.lit(5.0)), F.lit(x.stop_cap))
    low = F.greatest(F.lit(x.take_floor), s * max(x.min_ratio, 0.5))
    t = F.greatest(F.least(F.greatest(tp, low), s * x.max_ratio), low)
    return F.when(live, t).otherwise(tp), F.when(live, s).otherwise(sl)


def tightened_stop(stop, p_stress: str = "p_st", vol: str = "vol_ann", ratio: str = "vol_ratio", x: Exits = EXITS) -> Column:
    """Stop shortened by the smallest factor that applies, not under the floor."""
    one = F.lit(1.0)
    f = F.least(
        F.when(c(p_stress) >= x.stress_at, x.stress_factor).otherwise(one),
        F.when(c(vol) >= x.vol_at, x.vol_factor).otherwise(one),
        F.when(c(ratio) >= x.ratio_at, x.ratio_factor).otherwise(one),
    )
    return F.greatest(c(stop) * f, F.lit(x.stop_floor))


# ---- factor score -----------------------------------------------------------


def factor_scores(df: DataFrame, weights: tuple[float, float, float] = (0.30, 0.35, 0.35)) -> DataFrame:
    """Trend, mean-reversion and risk sub-scores (0..100), their blend and the label."""
    t, z, on, vr = F.col("trend_12_1"), F.col("z_sma"), F.col("risk_on"), F.col("vol_ratio")
    trend = F.coalesce(clip(50 + t * 125, 0, 100), F.lit(50.0))
    mean_rev = (
        F.when(z < -2.0, clip(50 + F.least(F.abs(z), F.lit(3.0)) * 18, 0, 100))
        .when(z < -1.0, clip(50 + F.abs(z) * 12, 0, 100))
        .when(z > 1.5, clip(50 - (z - 1.5) * 20, 0, 100))
        .otherwise(50.0)
    )
    risk = 50 + F.when(on, 20.0).otherwise(-25.0) + F.when(vr < 0.85, 10.0).when(vr > 1.25, -20.0).when(vr > 1.0, -8.0).otherwise(0.0)
    d = df.withColumns({"trend_score": trend, "mean_rev_score": mean_rev, "risk_score": clip(risk, 0, 100)})
    total = weights[0] * F.col("trend_score") + weights[1] * F.col("mean_rev_score") + weights[2] * F.col("risk_score")
    d = d.withColumn("score", F.round(total, 1))
    return d.withColumn("decision", F.when(F.col("score") >= 65, "BUY").when(F.col("score") >= 45, "HOLD").otherwise("REDUCE"))


# ---- thresholds, edges, entry score -----------------------------------------


def bands(buy, hold=None, lo: float = 51.0, hi: float = 58.0) -> dict[str, Column]:
    """Symmetric buy, sell and hold thresholds around 50."""
    b = F.least(F.greatest(c(buy), F.lit(lo)), F.lit(hi))
    s = F.greatest(F.lit(0.0), 100 - F.greatest(b, F.lit(50 + 1e-6)))
    h = F.coalesce(c(hold), F.lit(40.0)) if hold is not None else F.lit(40.0)
    h = F.when(h >= b, s + F.greatest(F.lit(2.0), (b - s) * 0.35)).otherwise(h)
    h = F.when(h <= s, s + 1.0).otherwise(h)
    return {"buy_threshold": b, "sell_threshold": s, "hold_threshold": h}


def conviction_edge(p, base: float = 0.5) -> Column:
    """Share of the way from the base rate to certainty; probabilities are never null
    (a missing model scores 0.5)."""
    b = min(max(base, 1e-6), 1 - 1e-6)
    return F.greatest(F.lit(0.0), (bound(c(p), 1e-6, 1 - 1e-6) - b) / max(1 - b, 1e-6))


def signed_score(df: DataFrame, impulse: str = "impulse", buy: float = 55.0, move: float | str = 20.0, least_lead: float = 0.01) -> DataFrame:
    """Signed 0..100 score, side and expected edge from two probabilities and the impulse."""
    d = df.withColumns({"long_edge": conviction_edge("proba"), "short_edge": conviction_edge("proba_short"), "_imp": bound(impulse, 0, 1.5)})
    l, s, imp = F.col("long_edge"), F.col("short_edge"), F.col("_imp")
    boost = 0.5 + 0.5 * F.least(imp, F.lit(1.0))
    d = d.withColumn("score", bound(50 + (l - s) / F.greatest(l + s, F.lit(1e-6)) * 50 * boost, 0, 100))
    b = bands(buy)
    side = F.when((s >= l + least_lead) & (F.col("score") <= b["sell_threshold"]), -1).when((l >= s + least_lead) & (F.col("score") >= b["buy_threshold"]), 1).otherwise(0)
    return d.withColumns({"position_side": side, "expected_edge_bps": (l - s) * c(move) * (0.5 + imp)}).drop("_imp")


# fixed values: weights of the impulse blend
IMPULSE_WEIGHTS = {"ml": 0.30, "mom": 0.20, "nw": 0.15, "flow": 0.15, "vp": 0.20}


def impulse_strength(df: DataFrame, w: dict[str, float] = IMPULSE_WEIGHTS, name: str = "impulse") -> DataFrame:
    """Weighted blend of edge, momentum, envelope, flow and profile, damped by stress and confidence."""
    have = lambda x, d: F.coalesce(F.col(x), F.lit(d)) if x in df.columns else F.lit(d)
    parts = {
        "ml": conviction_edge("proba"),
        "mom": F.least(F.abs(have("roc_6", 0.0)) * 50, F.lit(1.0)),
        "nw": F.abs(have("nw_env_pos", 0.5) - 0.5) * 2,
        "flow": F.least(F.lit(1.0), F.abs(have("vol_imbalance", 0.0)) + have("power_shift", 0.0) * 2),
        "vp": F.least(F.lit(1.0), F.abs(have("vp_composite", 0.0))),
    }
    total = sum(w.values()) or 1.0
    raw = sum((w[k] * v for k, v in parts.items()), F.lit(0.0)) / total
    return df.withColumn(name, raw * (1 - have("p_st", 0.34)) * (0.5 + 0.5 * have("conf", 0.33)))


def entry_score(p="proba", impulse="impulse") -> Column:
    boost = 0.5 + 0.5 * F.least(bound(impulse, 0, 1.5), F.lit(1.0))
    return bound((50 + 50 * bound(p, 0, 1)) * boost, 0, 100)


def expected_edge(p="proba", impulse="impulse", move=20.0, base: float = 0.5) -> Column:
    b = min(max(base, 1e-6), 1 - 1e-6)
    return (c(p) - b) / max(1 - b, 1e-6) * c(move) * (0.5 + bound(impulse, 0, 1.5))


def expected_move(hold: int, base: float = 20.0, ref: int = 12) -> float:
    return base if hold <= ref else base * math.sqrt(hold / ref)


def gain_score(p="proba", gain: float = 100.0) -> Column:
    return bound(50 + (c(p) - 0.5) * gain, 0, 100)


def direction(long_="proba", short="proba_short", base: float = 0.5, least: float = 0.05) -> Column:
    """1 long, 2 short, 0 flat."""
    l, s = c(long_), c(short)
    return F.when((l - base >= least) & (l > s), 1).when((s - base >= least) & (s > l), 2).otherwise(0)


# ---- sample weights ---------------------------------------------------------


def recency_weights(df: DataFrame, reference: Column, halflife: float = 120.0, keys: list[str] = (), name: str = "weight") -> DataFrame:
    """Half-life decay by age in days, scaled to mean one per key."""
    from ..operators.spread import salted_join

    age = F.greatest(F.lit(0.0), (reference.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400)
    d = df.withColumn("_w", F.greatest(F.exp(-math.log(2) / max(halflife, 1.0) * age), F.lit(1e-6)))
    if not keys:
        return d.withColumn(name, F.col("_w") / d.agg(F.avg("_w")).scalar()).drop("_w")
    mean = d.groupBy(*keys).agg(F.avg("_w").alias("_m"))
    return salted_join(d, mean, list(keys)).withColumn(name, F.col("_w") / F.col("_m")).drop("_w", "_m")


def class_weights(df: DataFrame, label: str, keys: list[str] = (), name: str = "weight") -> DataFrame:
    """Inverse class frequency, scaled to mean one per key (at most a few classes)."""
    from ..operators.spread import salted_join

    k = [*keys, label]
    n = df.where(F.col(label).isNotNull()).groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # mean of 1/n over rows = classes / rows
    w = n.withColumn(name, (F.sum("_n").over(per_key) / F.count(F.lit(1)).over(per_key)) / F.col("_n")).drop("_n")
    return salted_join(df, w, k, "left")


# ---- model and candidate scoring -------------------------------------------

# fixed values: weights of the model criteria
CRITERIA = {
    "top_decile_net_bps": 0.60, "accuracy": 0.12, "precision": 0.08, "recall": 0.08, "auc": 0.04, "pr_auc": 0.02, "edge_corr": 0.06,
    "ic": 0.0, "log_loss": 0.0, "brier": 0.0, "calibration_mae": 0.0, "fold_stability": 0.0,
}


def criterion(name: str, v: Column) -> Column:
    """Metric mapped to 0..1, higher is better."""
    maps = {
        "auc": (v - 0.5) * 2, "log_loss": (0.693 - v) / 0.693, "brier": (0.25 - v) / 0.25, "ic": (v + 1) / 2, "edge_corr": (v + 1) / 2,
        "calibration_mae": (0.25 - v) / 0.25, "fold_stability": 1 - F.least(v / 0.15, F.lit(1.0)), "top_decile_net_bps": 0.5 + 0.5 * v / 25.0,
    }
    return F.coalesce(clip(maps.get(name, v), 0, 1), F.lit(0.0))


def composite(columns: list[str], weights: dict[str, float] = CRITERIA) -> Column:
    total = sum(weights.values())
    terms = [w * criterion(k, F.col(k)) for k, w in weights.items() if k in columns]
    return F.round(sum(terms, F.lit(0.0)) / total, 4)


def trial_objective(*, gap_weight: float = 0.45, gap_scale: float = 8.0) -> Column:
    """Profit objective of a trial; -1 where gross cannot clear the round trip."""
    net, gross, rt, gap = (F.col(x) for x in ("top_decile_net_bps", "gross_bps", "cost_bps", "gap_bps"))
    base = criterion("top_decile_net_bps", net)
    base = F.when(gross.isNotNull() & rt.isNotNull(), F.least(F.lit(1.0), base + 0.15 * F.greatest(F.lit(0.0), gross - rt) / 25)).otherwise(base)
    penalty = F.coalesce(gap_weight * F.least(gap / max(gap_scale, 1.0), F.lit(1.0)), F.lit(0.0))
    return F.when(gross < rt, -1.0).otherwise(F.greatest(F.lit(0.0), base - penalty))


def reject_reason(min_net: float | None = None, max_gap: float | None = None) -> Column:
    out = F.when(F.col("gross_bps") < F.col("cost_bps"), "gross_below_rt")
    if min_net is not None:
        out = out.when(F.col("top_decile_net_bps") < min_net, "net_below_min")
    return out.when(F.col("gap_bps") > max_gap, "train_oos_gap") if max_gap is not None else out


def fold_objective(*, sharpe="sharpe", mean_ret="mean_return_pct", active="active_rebalances", net="mean_trade_net_bps", penalty="penalty", days="fold_days", freq_weight: float = 0.0) -> Column:
    """Sharpe + return - churn - loss, plus or minus frequency and expectancy."""
    ret = c(mean_ret) / 10.0
    base = c(sharpe) + ret - 0.04 * c(active) - 2.0 * F.greatest(F.lit(0.0), -ret) - zero(c(penalty))
    per_year = c(active) * 365.0 / F.greatest(c(days), F.lit(7.0))
    bonus = F.when(ret > 0, freq_weight * F.least(F.lit(1.0), per_year / 30.0)).otherwise(0.0)
    base = F.when((base < 0) & (bonus > 0), base - bonus).otherwise(base + bonus)
    expectancy = F.when(c(net) >= 0, 0.5 * c(net) / 20.0).when(c(net) < 0, -0.5 * F.abs(c(net)) / 10.0).otherwise(0.0)
    return base + expectancy


def balance_factor(rate, lo: float = 0.08, hi: float = 0.55) -> Column:
    r = c(rate)
    return F.when((r >= lo) & (r <= hi), 1.0).when(r < lo, F.greatest(F.lit(0.0), r / lo) if lo > 0 else F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - (r - hi) / max(1 - hi, 1e-6)))


def target_score(*, cv="cv", net="net_edge_bps", rate="positive_rate", horizon="horizon", per_year="bars_per_year", w=(0.25, 0.45, 0.15, 0.15), tpy: float = 30.0, pen: float = 0.0008) -> Column:
    """Candidate score: model, economics, balance and frequency; losers only up to a quarter."""
    one = lambda x: clip(x, 0, 1)
    h = F.greatest(F.lit(1.0), c(horizon))
    cv_s, econ, bal, freq = one(c(cv) / 0.6), one(c(net) / 20.0), balance_factor(rate), one(c(rate) * c(per_year) / h / max(tpy, 1.0))
    blended = (w[0] * cv_s + w[1] * econ + w[2] * bal + w[3] * freq) / sum(w)
    losers = (w[0] * cv_s + w[2] * bal + w[3] * freq) / max(w[0] + w[2] + w[3], 1e-6)
    return F.round(F.greatest(F.lit(0.0), F.when(c(net) > 0, 0.5 + 0.5 * blended).otherwise(0.25 * losers) - pen * h), 4)


# fixed values: wanted share of each direction class
CLASS_RANGES = {"flat": (0.15, 0.45), "long": (0.20, 0.45), "short": (0.20, 0.45)}


def direction_penalties(flat, long_, short, max_flat: float = 0.50, min_dir: float = 0.35) -> tuple[Column, Column]:
    d = c(long_) + c(short)
    flat_p = F.when(c(flat) > max_flat, F.greatest(F.lit(0.0), 1 - (c(flat) - max_flat) / max(1 - max_flat, 1e-6))).otherwise(1.0)
    return flat_p, F.when(d < min_dir, F.greatest(F.lit(0.0), d / min_dir)).otherwise(1.0)


def direction_balance(flat, long_, short) -> Column:
    parts = [balance_factor(x, *CLASS_RANGES[n]) for x, n in ((flat, "flat"), (long_, "long"), (short, "short"))]
    return (parts[0] + parts[1] + parts[2]) / 3


# ---- sizing and verdicts ----------------------------------------------------


def soft_size(*, hard_zero: bool = True) -> Column:
    """Exposure multiplier from policy diagnostics (quality_ok, pass_rate, cv_net, holdout_net,
    alignment, band_lo, band_hi, soft_keep)."""
    ok, rate, cv, ho, al = (F.col(x) for x in ("quality_ok", "pass_rate", "cv_net", "holdout_net", "alignment"))
    size = F.least(
        F.when(rate.isNotNull(), clip(rate, 0.1, 1)).when(~ok, 0.35).otherwise(1.0),
        F.coalesce(clip((cv - F.col("band_lo")) / F.greatest(F.col("band_hi") - F.col("band_lo"), F.lit(1e-9)), 0.1, 1), F.lit(1.0)),
        F.when(ho < 0, 0.35).otherwise(1.0),
        F.when(al < 0, 0.25).otherwise(1.0),
    )
    size = F.greatest(F.lit(0.1), F.least(F.lit(1.0), size))
    return F.when(block_reason().isNotNull(), 0.0).otherwise(size) if hard_zero else size


def block_reason() -> Column:
    kept = F.coalesce(F.col("soft_keep"), F.lit(False))
    return F.when(~kept & ~F.col("quality_ok"), "quality").when(~kept & (F.col("holdout_net") < 0), "holdout")


def may_enter(score, risk_on, buy=50.0) -> Column:
    return (c(score) >= c(buy)) & (c(risk_on) | (c(score) >= c(buy) + 5))


def may_hold(score, risk_on, hold=45.0, buy=65.0) -> Column:
    return (c(score) >= F.least(F.lit(40.0), c(hold))) & (c(risk_on) | (c(score) >= c(buy)))


def may_short(score, risk_on, buy=55.0, sell=None) -> Column:
    b = bands(buy)
    s = c(sell) if sell is not None else b["sell_threshold"]
    return (c(score) > 0) & (c(risk_on) | (c(score) <= s - 5)) & (c(score) <= s) & (c(score) < b["buy_threshold"])


def may_hold_short(score, risk_on, hold=45.0, buy=65.0) -> Column:
    return (c(score) <= F.greatest(c(buy), 100 - c(hold))) & (c(risk_on) | (c(score) <= c(buy)))


def verdict(tradeable, oos_net, total_ret, floor: float = 5.0) -> Column:
    net, ret = zero(c(oos_net)), zero(c(total_ret))
    return F.when(c(tradeable) & (net >= floor), "TRADE").when((net > 0) | (ret > 0), "WATCH").otherwise("SKIP")


def go_reasons(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(v, k) for k, v in conditions.items()]))))


def blended_weights(prior: tuple[str, ...], found: tuple[str, ...], share: float = 0.65) -> list[Column]:
    mix = [share * c(p) + (1 - share) * c(o) for p, o in zip(prior, found)]
    total = sum(mix[1:], mix[0])
    return [m / total for m in mix]


def constraint_limits(rows: str, sessions: str, base=(5, 1, 0.05)) -> dict[str, Column]:
    r, s = c(rows), c(sessions)
    return {
        "min_rows": F.greatest(F.lit(3), F.least(F.lit(base[0]), F.greatest(F.lit(3), F.floor(r * 0.001)))),
        "min_rebalances": F.greatest(F.lit(1), F.least(F.lit(base[1]), F.greatest(F.lit(1), F.floor(s / 4)))),
        "min_exposure": F.least(F.lit(base[2]), F.greatest(F.lit(0.02), base[2] * F.least(F.lit(1.0), s / 20.0))),
    }


def constraint_penalty(rows, rebalances, exposure, limits=(30, 3, 0.5), weight: float = 5.0) -> Column:
    short = lambda x, m: F.greatest(F.lit(0.0), 1 - c(x) / m)
    return weight * (short(rows, limits[0]) + short(rebalances, limits[1]) + short(exposure, limits[2]))


# ---- rule book --------------------------------------------------------------


def rule_move(vol, bars: int, per_year: float = 252.0) -> Column:
    return F.greatest(c(vol), F.lit(1e-6)) * math.sqrt(max(bars, 1) / per_year)


def stop_probability(prev: str = "p_imp_prev") -> Column:
    i, m, s = F.col("p_imp"), F.col("p_mr"), F.col("p_st")
    p = m + 0.12 * s + F.greatest(F.lit(0.0), 0.38 - i) + zero(F.when(F.col(prev).isNotNull(), 0.45 * F.greatest(F.lit(0.0), F.col(prev) - i)))
    return clip(p, 0, 1)


def growth_probability(stop: str = "p_stop", prev: str = "p_imp_prev") -> Column:
    fade = zero(F.when(F.col(prev).isNotNull(), F.greatest(F.lit(0.0), F.col(prev) - F.col("p_imp"))))
    p = 0.40 * F.col("p_mr") + 0.35 * F.col(stop) + F.when(F.col("risk_on"), 0.10).otherwise(0.0) + 0.20 * fade - 0.18 * F.greatest(F.lit(0.0), F.col("p_st") - 0.5) / 0.5
    return clip(p, 0, 1)


def touch_buy(pos="nw_env_pos", growth="p_growth", touch: float = 0.12, least: float = 0.32, neutral: float = 45.0) -> Column:
    """(score, side) of the lower-band touch book; never sells."""
    strength = F.least(F.lit(1.0), (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c(pos)) / touch)) * (0.35 + 0.65 * F.least(F.lit(1.0), (c(growth) - least) / (1 - least))))
    away, weak = c(pos) > touch, c(growth) < least
    score = F.when(away | weak, neutral).otherwise(F.least(F.lit(100.0), neutral + (100 - neutral) * strength))
    side = F.when(away, "neutral").when(weak, "neutral_regime").otherwise("buy_touch")
    return F.struct(score.alias("score"), side.alias("signal_side"))


def exhaustion(ret="ret_frac", vol="vol_ann", stop="p_stop", bars: int = 5, mult: float = 0.90, least: float = 0.32, neutral: float = 45.0, per_year: float = 252.0) -> Column:
    """(score, side) of a dump or rally that is running out; rallies are never sold."""
    thr = rule_move(vol, bars, per_year) * mult
    exc = F.least(F.lit(1.0), (c(stop) - least) / (1 - least))
    strength = exc * F.least(F.lit(1.0), F.abs(c(ret)) / F.greatest(thr, F.lit(1e-9)))
    quiet = c(stop) < least
    dump, rally = ~quiet & (c(ret) <= -thr), ~quiet & (c(ret) >= thr)
    score = F.when(dump, F.least(F.lit(100.0), neutral + (100 - neutral) * strength)).otherwise(neutral)
    side = F.when(dump, "buy_dump").when(rally, "sell_rally").otherwise("neutral")
    return F.struct(score.alias("score"), side.alias("signal_side"))
