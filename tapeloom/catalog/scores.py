"""Scalar scores, gates, sizing, and regime expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import regimes as R
from ..functions import scores as S
from ..functions.frames import log_return
from ..operators import aggregates as A
from ..operators import features as X
from ..operators.blocks import in_blocks
from ..operators.spread import salted_join
from .audits import SQL_FOLD_NETS, direction, fold_nets
from .bars import SQL_SUPPLIERS, supplier_dim
from .base import DAILY, INTRADAY, SQL_BARS, SQL_DAILY, W, bars, daily, out, query, r, rnd, sel, table, with_scores
from .features import FAC, SQL_FACTORS, SQL_IMPULSE, SQL_RETS, SQL_RULE_ENV, factor_frame, impulse_frame, lag
from .scored import SQL_SCORED, scored
from .base import sql_scores, sstd, smean

K = ["ticker", "ts"]

SQL_COSTED = f"""{SQL_SUPPLIERS}, cd AS (SELECT *, CASE WHEN s_acctbal > 0 THEN s_acctbal / 8000.0::DOUBLE END AS vol, 2 * (commission_bps + slippage_bps) AS rt FROM dim),
ce AS (SELECT *, slippage_bps * CASE WHEN vol IS NOT NULL AND vol > 0 THEN greatest(0.5, least(2, vol / vol_ref)) ELSE 1 END AS slip_vol, greatest(0.5, least(2.5, coalesce(vol, vol_ref) / vol_ref)) AS vs FROM cd),
cost AS (SELECT *, 2 * (commission_bps + slip_vol) AS rt_vol, sqrt(vs) AS vscale, 2 * (commission_bps + slippage_bps * greatest(0.5, least(2, coalesce(vol, vol_ref) / vol_ref))) AS rt_ref FROM ce)"""


def costed(spark, sf):
    return supplier_dim(spark, sf).withColumn("vol", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 8000.0))


@query("sc01_costs", f"WITH {SQL_COSTED} SELECT ticker, {r('commission_bps')} AS commission_bps, {r('slip_vol')} AS slippage_vol_bps, {r('rt')} AS round_trip_bps, {r('rt_vol')} AS round_trip_vol_bps FROM cost")
def sc01(spark, sf):
    d = costed(spark, sf).withColumns({"slippage_vol_bps": dims.scaled_slippage("vol"), "round_trip_vol_bps": dims.round_trip(F.col("vol"))})
    return out(d, ["ticker"], ["commission_bps", "slippage_vol_bps", "round_trip_bps", "round_trip_vol_bps"])


@query("sc02_edge_floors", f"WITH {SQL_COSTED} SELECT ticker, {r('rt + 2')} AS full_floor, {r('45 + 2 * commission_bps + slippage_bps + 2')} AS stop_floor, {r('2 * commission_bps + 2')} AS commission_floor FROM cost")
def sc02(spark, sf):
    d = costed(spark, sf)
    f = {n: S.edge_floor("commission_bps", "slippage_bps", mode=m) for n, m in (("full_floor", "full_round_trip"), ("stop_floor", "stop_plus_commission"), ("commission_floor", "commission_only"))}
    return out(d.withColumns(f), ["ticker"], list(f))


@query("sc03_min_edge", f"WITH {SQL_COSTED} SELECT ticker, {r('least(60, greatest(s_acctbal / 100, rt + 2, CASE WHEN vol IS NOT NULL THEN least(vol * 30, 60) END))')} AS min_edge_bps FROM cost")
def sc03(spark, sf):
    d = costed(spark, sf)
    e = S.min_edge(F.col("s_acctbal") / 100, S.edge_floor("commission_bps", "slippage_bps"), F.col("vol") * 30)
    return out(d.withColumn("min_edge_bps", e), ["ticker"], ["min_edge_bps"])


@query(
    "sc04_exits",
    f"""WITH {SQL_SCORED}, x AS (SELECT ticker, ts, proba * 100 AS tp, proba_short * 120 AS sl, p_st, vol_ann, vol_ratio FROM scored), y AS (SELECT *, least(greatest(sl, 5), 75) AS s FROM x),
z AS (SELECT *, greatest(least(greatest(tp, greatest(40, s)), s * 2), greatest(40, s)) AS t FROM y)
SELECT ticker, ts, {r('CASE WHEN tp > 0 AND sl > 0 THEN t ELSE tp END')} AS take_bps, {r('CASE WHEN tp > 0 AND sl > 0 THEN s ELSE sl END')} AS stop_bps,
  {r("greatest(12, sl * least(CASE WHEN p_st >= 0.35 THEN 0.70 ELSE 1.0 END, CASE WHEN vol_ann >= 0.22 THEN 0.80 ELSE 1.0 END, CASE WHEN vol_ratio >= 1.35 THEN 0.85 ELSE 1.0 END))")} AS tight_stop_bps FROM z""",
)
def sc04(spark, sf):
    d = scored(spark, sf).withColumns({"tp": F.col("proba") * 100, "sl": F.col("proba_short") * 120})
    t, s = S.calibrated_exits("tp", "sl")
    return out(d.withColumns({"take_bps": t, "stop_bps": s, "tight_stop_bps": S.tightened_stop("sl")}), K, ["take_bps", "stop_bps", "tight_stop_bps"])


SQL_FSCORE = f"""{SQL_FACTORS}, fs0 AS (SELECT *, coalesce(CASE WHEN trend_12_1 IS NOT NULL THEN greatest(0, least(100, 50 + trend_12_1 * 125)) END, 50) AS trend_score,
  CASE WHEN z_sma < -2 THEN greatest(0, least(100, 50 + least(abs(z_sma), 3) * 18)) WHEN z_sma < -1 THEN greatest(0, least(100, 50 + abs(z_sma) * 12)) WHEN z_sma > 1.5 THEN greatest(0, least(100, 50 - (z_sma - 1.5) * 20)) ELSE 50 END AS mean_rev_score,
  greatest(0, least(100, 50 + CASE WHEN risk_on THEN 20 ELSE -25 END + CASE WHEN vol_ratio < 0.85 THEN 10 WHEN vol_ratio > 1.25 THEN -20 WHEN vol_ratio > 1.0 THEN -8 ELSE 0 END)) AS risk_score FROM factors),
fscore AS (SELECT *, 0.30 * trend_score + 0.35 * mean_rev_score + 0.35 * risk_score AS raw_score FROM fs0)"""


@query(
    "sc05_factor_score",
    f"WITH {SQL_FSCORE}, s AS (SELECT *, round(raw_score, 1) AS score FROM fscore) SELECT ticker, ts, {sel(['trend_score', 'mean_rev_score', 'risk_score'], 4)}, {r('score', 1)} AS score, CASE WHEN score >= 65 THEN 'BUY' WHEN score >= 45 THEN 'HOLD' ELSE 'REDUCE' END AS decision FROM s",
)
def sc05(spark, sf):
    d = S.factor_scores(factor_frame(spark, sf))
    d = out(d, ["ticker", "ts", "decision", "score"], ["trend_score", "mean_rev_score", "risk_score"], d=4)
    return d.withColumn("score", rnd("score", 1))


@query("sc06_economics", f"WITH {SQL_COSTED} SELECT ticker, {r('vscale')} AS vol_scale, {r('greatest(rt_ref, rt_ref * 1.25 * vscale)')} AS floor_bps, {r('-2 * greatest(rt_ref, rt_ref * 1.25 * vscale)')} AS band_lo FROM cost")
def sc06(spark, sf):
    d = costed(spark, sf).withColumns({"vol_scale": dims.vol_scale("vol"), "floor_bps": dims.economics_floor("vol")})
    return out(d.withColumn("band_lo", -2 * F.col("floor_bps")), ["ticker"], ["vol_scale", "floor_bps", "band_lo"])


@query(
    "sc07_realised_vol",
    f"""WITH {SQL_RETS}, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM daily), u AS (SELECT ticker, ln(close / lag(close) OVER {W}) AS lr FROM t WHERE rn <= 252)
SELECT ticker, {r('CASE WHEN count(lr) >= 49 THEN stddev_samp(lr) * sqrt(252) END')} AS vol_ann FROM u GROUP BY 1""",
)
def sc07(spark, sf):
    t = A.tail_rows(daily(spark, sf).select("ticker", "ts", "close"), 252, DAILY)
    d = in_blocks(t, lambda x, w: x.withColumn("lr", log_return("close", w)), back=1, lay=DAILY)
    g = d.groupBy("ticker").agg(F.when(F.count("lr") >= 49, F.stddev_samp("lr") * F.sqrt(F.lit(252.0))).alias("vol_ann"))
    return out(g, ["ticker"], ["vol_ann"])


@query(
    "sc08_bands",
    f"""WITH {SQL_SCORED}, x AS (SELECT ticker, ts, least(greatest(40 + proba * 30, 51), 58) AS b, 30 + conf * 30 AS h FROM scored), y AS (SELECT *, 100 - b AS s FROM x), z AS (SELECT *, CASE WHEN h >= b THEN s + greatest(2, (b - s) * 0.35) ELSE h END AS h1 FROM y)
SELECT ticker, ts, {r('b')} AS buy_threshold, {r('s')} AS sell_threshold, {r('CASE WHEN h1 <= s THEN s + 1 ELSE h1 END')} AS hold_threshold FROM z""",
)
def sc08(spark, sf):
    d = scored(spark, sf).withColumns(S.bands(40 + F.col("proba") * 30, 30 + F.col("conf") * 30))
    return out(d, K, ["buy_threshold", "sell_threshold", "hold_threshold"])


SQL_SIGNED = """sg0 AS (SELECT *, greatest(0, (greatest(1e-6, least(1 - 1e-6, proba)) - 0.5) / 0.5) AS le, greatest(0, (greatest(1e-6, least(1 - 1e-6, proba_short)) - 0.5) / 0.5) AS se, greatest(0, least(1.5, impulse)) AS im FROM {src}),
sg1 AS (SELECT *, greatest(0, least(100, 50 + (le - se) / greatest(le + se, 1e-6) * 50 * (0.5 + 0.5 * least(im, 1)))) AS score FROM sg0),
signed AS (SELECT *, CASE WHEN se >= le + 0.01 AND score <= 45 THEN -1 WHEN le >= se + 0.01 AND score >= 55 THEN 1 ELSE 0 END AS position_side, (le - se) * 20 * (0.5 + im) AS expected_edge_bps FROM sg1)"""


@query("sc09_signed_score", f"WITH {SQL_SCORED}, im AS (SELECT *, conf * 1.2 AS impulse FROM scored), {SQL_SIGNED.format(src='im')} SELECT ticker, ts, {sel(['score', 'expected_edge_bps'])}, CAST(position_side AS BIGINT) AS position_side FROM signed")
def sc09(spark, sf):
    return out(S.signed_score(scored(spark, sf).withColumn("impulse", F.col("conf") * 1.2)), K, ["score", "expected_edge_bps"], ["position_side"])


SQL_STRENGTH = f"""{SQL_IMPULSE}, {sql_scores('impulse', 'ism')},
strength AS (SELECT *, (0.30 * greatest(0, (greatest(1e-6, least(1 - 1e-6, proba)) - 0.5) / 0.5) + 0.20 * least(abs(mom_short) * 50, 1) + 0.15 * abs(nw_env_pos - 0.5) * 2 + 0.15 * least(1, abs(coalesce(vol_imbalance, 0)) + power_shift * 2)) / 1.0 * (1 - p_st) * (0.5 + 0.5 * conf) AS impulse FROM ism)"""


def strength(spark, sf):
    return S.impulse_strength(with_scores(impulse_frame(spark, sf)))


@query("sc10_impulse_strength", f"WITH {SQL_STRENGTH} SELECT ticker, ts, {r('impulse')} AS impulse FROM strength")
def sc10(spark, sf):
    return out(strength(spark, sf), K, ["impulse"])


@query(
    "sc11_entry_score",
    f"WITH {SQL_SCORED}, x AS (SELECT *, greatest(0, least(1.5, conf * 1.2)) AS im FROM scored) SELECT ticker, ts, {r('greatest(0, least(100, (50 + 50 * proba) * (0.5 + 0.5 * least(im, 1))))')} AS entry_score, "
    f"{r('(proba - 0.5) / 0.5 * 40 * (0.5 + im)')} AS expected_edge_bps, {r('greatest(0, least(100, 50 + (proba - 0.5) * 120))')} AS gain_score FROM x",
)
def sc11(spark, sf):
    d = scored(spark, sf).withColumn("impulse", F.col("conf") * 1.2)
    return out(d.withColumns({"entry_score": S.entry_score(), "expected_edge_bps": S.expected_edge(move=S.expected_move(48)), "gain_score": S.gain_score(gain=120.0)}), K, ["entry_score", "expected_edge_bps", "gain_score"])


@query("sc12_direction", f"WITH {SQL_SCORED} SELECT ticker, ts, CAST(CASE WHEN proba - 0.5 >= 0.05 AND proba > proba_short THEN 1 WHEN proba_short - 0.5 >= 0.05 AND proba_short > proba THEN 2 ELSE 0 END AS BIGINT) AS direction FROM scored")
def sc12(spark, sf):
    return out(scored(spark, sf).withColumn("direction", S.direction()), K, ints=["direction"])


@query(
    "sc13_recency_weights",
    f"WITH {SQL_DAILY}, x AS (SELECT ticker, ts, greatest(exp(-ln(2) / 120 * greatest(0, epoch(TIMESTAMP '2001-01-01' - ts) / 86400)), 1e-6) AS w FROM daily) SELECT ticker, ts, {r('w / avg(w) OVER (PARTITION BY ticker)')} AS weight FROM x",
)
def sc13(spark, sf):
    return out(S.recency_weights(daily(spark, sf), F.lit("2001-01-01").cast("timestamp"), 120.0, ["ticker"]), K, ["weight"])


@query(
    "sc14_class_weights",
    f"WITH {SQL_SCORED}, d AS (SELECT ticker, ts, CASE WHEN fwd_ret > 0.005 THEN 1 WHEN fwd_ret < -0.005 THEN 2 WHEN fwd_ret IS NOT NULL THEN 0 END AS k FROM scored), n AS (SELECT ticker, k, count(*) AS n FROM d WHERE k IS NOT NULL GROUP BY 1, 2), "
    f"w AS (SELECT ticker, k, sum(n) OVER (PARTITION BY ticker) / count(*) OVER (PARTITION BY ticker) / n AS w FROM n) SELECT d.ticker, ts, {r('w')} AS weight FROM d LEFT JOIN w ON w.ticker = d.ticker AND w.k = d.k",
)
def sc14(spark, sf):
    return out(S.class_weights(direction(scored(spark, sf)), "direction", ["ticker"]), K, ["weight"])


SQL_TRIALS = f"""{SQL_FOLD_NETS}, trials AS (SELECT ticker, fold, net_bps AS top_decile_net_bps, gross_bps, round_trip_bps AS cost_bps, CASE WHEN fold % 2 = 0 THEN fold - 1995.0 END AS gap_bps, 0.5 + (fold - 1998) * 0.01::DOUBLE AS accuracy, 0.5 + (fold - 1997) * 0.02::DOUBLE AS auc, 0.4 + (fold - 1996) * 0.03::DOUBLE AS prec, 0.9 - (fold - 1994) * 0.04::DOUBLE AS rec FROM foldnets)"""


def trials(spark, sf):
    d = fold_nets(spark, sf)
    return d.select(
        "ticker", "fold", F.col("net_bps").alias("top_decile_net_bps"), "gross_bps", F.col("round_trip_bps").alias("cost_bps"), F.when(F.col("fold") % 2 == 0, F.col("fold") - 1995.0).alias("gap_bps"),
        (0.5 + (F.col("fold") - 1998) * 0.01).alias("accuracy"), (0.5 + (F.col("fold") - 1997) * 0.02).alias("auc"),
        (0.4 + (F.col("fold") - 1996) * 0.03).alias("precision"), (0.9 - (F.col("fold") - 1994) * 0.04).alias("recall"), "n",
    )


PS = "coalesce(greatest(0, least(1, 0.5 + 0.5 * top_decile_net_bps / 25)), 0)"


@query(
    "sc15_trial_scores",
    f"""WITH {SQL_TRIALS} SELECT ticker, fold, {r(PS)} AS profit_score, {r(f'(0.60 * {PS} + 0.12 * greatest(0, least(1, accuracy)) + 0.08 * greatest(0, least(1, prec)) + 0.08 * greatest(0, least(1, rec)) + 0.04 * greatest(0, least(1, (auc - 0.5) * 2))) / 1.0', 4)} AS composite,
  {r(f"CASE WHEN gross_bps < cost_bps THEN -1 ELSE greatest(0, least(1, {PS} + 0.15 * greatest(0, gross_bps - cost_bps) / 25) - coalesce(0.45 * least(gap_bps / 8, 1), 0)) END")} AS objective,
  CASE WHEN gross_bps < cost_bps THEN 'gross_below_rt' WHEN gap_bps > 4 THEN 'train_oos_gap' END AS reason FROM trials""",
)
def sc15(spark, sf):
    d = trials(spark, sf)
    d = d.withColumns({"profit_score": S.criterion("top_decile_net_bps", F.col("top_decile_net_bps")), "composite": S.composite(["accuracy", "top_decile_net_bps", "auc", "precision", "recall"]), "objective": S.trial_objective(), "reason": S.reject_reason(max_gap=4.0)})
    return d.select("ticker", "fold", rnd("profit_score").alias("profit_score"), rnd("composite", 4).alias("composite"), rnd("objective").alias("objective"), "reason")


@query(
    "sc16_fold_objective",
    f"""WITH {SQL_FOLD_NETS}, x AS (SELECT *, gross_bps / 100 AS mr, net_bps / 50 AS sh FROM foldnets)
SELECT ticker, fold, {r("sh + mr / 10 - 0.04 * (n % 7) - 2 * greatest(0, -mr / 10) + CASE WHEN net_bps >= 0 THEN 0.5 * net_bps / 20 ELSE -0.5 * abs(net_bps) / 10 END")} AS objective FROM x""",
)
def sc16(spark, sf):
    d = fold_nets(spark, sf).withColumns({"sharpe": F.col("net_bps") / 50, "mean_return_pct": F.col("gross_bps") / 100, "active_rebalances": F.col("n") % 7, "mean_trade_net_bps": F.col("net_bps"), "penalty": F.lit(0.0), "fold_days": F.lit(365.0)})
    return out(d.withColumn("objective", S.fold_objective()), ["ticker", "fold"], ["objective"])


def sbal(x, lo, hi):
    return f"(CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN 1 WHEN {x} < {lo} THEN greatest(0, {x} / {lo}) ELSE greatest(0, 1 - ({x} - {hi}) / (1 - {hi})) END)"


@query(
    "sc17_target_scores",
    f"""WITH {SQL_SCORED}, d AS (SELECT ticker, CASE WHEN fwd_ret > 0.005 THEN 1 WHEN fwd_ret < -0.005 THEN 2 WHEN fwd_ret IS NOT NULL THEN 0 END AS k, fwd_ret FROM scored),
g AS (SELECT ticker, avg(CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END) AS fl, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS lg, avg(CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END) AS sh, avg(fwd_ret) * 10000 AS net FROM d WHERE k IS NOT NULL GROUP BY 1),
s AS (SELECT *, greatest(0, least(1, 0.5 / 0.6)) AS cv, greatest(0, least(1, net / 20)) AS ec, {sbal('lg', 0.08, 0.55)} AS ba, greatest(0, least(1, lg * 252 / 12 / 30)) AS fr FROM g)
SELECT ticker, {r("greatest(0, CASE WHEN net > 0 THEN 0.5 + 0.5 * (0.25 * cv + 0.45 * ec + 0.15 * ba + 0.15 * fr) ELSE 0.25 * (0.25 * cv + 0.15 * ba + 0.15 * fr) / 0.55 END - 0.0008 * 12)", 4)} AS score,
  {r(f"({sbal('fl', 0.15, 0.45)} + {sbal('lg', 0.20, 0.45)} + {sbal('sh', 0.20, 0.45)}) / 3")} AS direction_balance, {r('CASE WHEN fl > 0.5 THEN greatest(0, 1 - (fl - 0.5) / 0.5) ELSE 1 END')} AS flat_penalty, {r('CASE WHEN lg + sh < 0.35 THEN greatest(0, (lg + sh) / 0.35) ELSE 1 END')} AS directional_penalty FROM s""",
)
def sc17(spark, sf):
    d = direction(scored(spark, sf)).where(F.col("direction").isNotNull())
    g = A.class_shares(d, ["ticker"], "direction", {"flat": 0, "long": 1, "short": 2}).join(d.groupBy("ticker").agg((F.avg("fwd_ret") * 1e4).alias("net_edge_bps")), "ticker")
    g = g.withColumns({"cv": F.lit(0.5), "positive_rate": F.col("long_rate"), "horizon": F.lit(12.0), "bars_per_year": F.lit(252.0)})
    fp, dp = S.direction_penalties("flat_rate", "long_rate", "short_rate")
    g = g.withColumns({"score": S.target_score(), "direction_balance": S.direction_balance("flat_rate", "long_rate", "short_rate"), "flat_penalty": fp, "directional_penalty": dp})
    return g.select("ticker", rnd("score", 4).alias("score"), *[rnd(c).alias(c) for c in ("direction_balance", "flat_penalty", "directional_penalty")])


SQL_SOFT = f"""{SQL_FOLD_NETS}, pol AS (SELECT ticker, fold, net_bps AS cv, CASE WHEN fold % 3 <> 0 THEN gross_bps - 20 END AS ho, CASE WHEN fold % 4 = 0 THEN -0.1 WHEN fold % 4 = 1 THEN 0.1 END AS al, bottleneck <> 'cost' AS ok, CASE WHEN fold % 5 = 0 THEN 0.6::DOUBLE END AS pr, round_trip_bps * 1.25 AS fl, fold % 2 = 0 AS keep FROM foldnets),
soft AS (SELECT *, greatest(0.1, least(1, least(CASE WHEN pr IS NOT NULL THEN greatest(0.1, least(1, pr)) WHEN NOT ok THEN 0.35 ELSE 1 END, greatest(0.1, least(1, (cv + 2 * fl) / (3 * fl))), CASE WHEN ho < 0 THEN 0.35 ELSE 1 END, CASE WHEN al < 0 THEN 0.25 ELSE 1 END))) AS size,
  CASE WHEN NOT keep AND NOT ok THEN 'quality' WHEN NOT keep AND ho < 0 THEN 'holdout' END AS reason FROM pol)"""


def policies(spark, sf):
    f = F.col("fold")
    return fold_nets(spark, sf).select(
        "ticker", "fold", F.col("net_bps").alias("cv_net"), F.when(f % 3 != 0, F.col("gross_bps") - 20).alias("holdout_net"), F.when(f % 4 == 0, -0.1).when(f % 4 == 1, 0.1).alias("alignment"),
        (F.col("bottleneck") != "cost").alias("quality_ok"), F.when(f % 5 == 0, 0.6).alias("pass_rate"), (F.col("round_trip_bps") * 1.25).alias("band_hi"), (-2.5 * F.col("round_trip_bps")).alias("band_lo"), (f % 2 == 0).alias("soft_keep"), "n",
    )


@query("sc18_soft_size", f"WITH {SQL_SOFT} SELECT ticker, fold, {r('CASE WHEN reason IS NOT NULL THEN 0 ELSE size END')} AS soft_size, reason FROM soft")
def sc18(spark, sf):
    d = policies(spark, sf).withColumns({"soft_size": S.soft_size(), "reason": S.block_reason()})
    return d.select("ticker", "fold", rnd("soft_size").alias("soft_size"), "reason")


SQL_RULE = f"""{SQL_DAILY}, {SQL_RULE_ENV.format(src='daily')}, {sql_scores('renv', 'rsc')},
ru0 AS (SELECT *, {lag('p_imp')} AS prev, close / {lag('close', 5)} - 1 AS ret_frac, ln(close / {lag('close')}) AS lr FROM rsc),
ru1 AS (SELECT *, greatest(0, least(1, p_mr + 0.12 * p_st + greatest(0, 0.38 - p_imp) + coalesce(0.45 * CASE WHEN prev IS NOT NULL THEN greatest(0, prev - p_imp) END, 0))) AS p_stop, {sstd('lr', 20)} * sqrt(252) AS vol20 FROM ru0),
ru2 AS (SELECT *, greatest(0, least(1, 0.40 * p_mr + 0.35 * p_stop + CASE WHEN risk_on THEN 0.10 ELSE 0 END + 0.20 * coalesce(CASE WHEN prev IS NOT NULL THEN greatest(0, prev - p_imp) END, 0) - 0.18 * greatest(0, p_st - 0.5) / 0.5)) AS p_growth FROM ru1),
rule AS (SELECT *, CASE WHEN nw_env_pos > 0.12 THEN 45 WHEN p_growth < 0.32 THEN 45 ELSE least(100, 45 + 55 * least(1, (1 - least(1, greatest(0, nw_env_pos) / 0.12)) * (0.35 + 0.65 * least(1, (p_growth - 0.32) / 0.68)))) END AS score,
  CASE WHEN nw_env_pos > 0.12 THEN 'neutral' WHEN p_growth < 0.32 THEN 'neutral_regime' ELSE 'buy_touch' END AS signal_side, greatest(vol20, 1e-6) * sqrt(5 / 252.0::DOUBLE) * 0.9 AS thr FROM ru2)"""


def rule_frame(spark, sf):
    def stage(d, w):
        d = X.rule_envelope(d, w)
        d = with_scores(d).withColumns({"p_imp_prev": F.lag("p_imp").over(w), "ret_frac": F.col("close") / F.lag("close", 5).over(w) - 1, "_lr": log_return("close", w)})
        from ..functions.frames import rstd

        return d.withColumn("vol20", rstd("_lr", w, 20) * F.sqrt(F.lit(252.0))).drop("_lr")

    d = in_blocks(daily(spark, sf), stage, back=X.RULE_ENVELOPE_BACK, lay=DAILY)
    d = d.withColumn("p_stop", S.stop_probability())
    return d.withColumn("p_growth", S.growth_probability())


@query("sc19_rule_scores", f"WITH {SQL_RULE} SELECT ticker, ts, {sel(['p_stop', 'p_growth', 'score'])}, signal_side FROM rule")
def sc19(spark, sf):
    d = rule_frame(spark, sf).withColumn("_t", S.touch_buy()).select("*", "_t.*")
    return out(d, ["ticker", "ts", "signal_side"], ["p_stop", "p_growth", "score"])


@query(
    "sc20_eligibility",
    f"""WITH {SQL_SCORED}, x AS (SELECT *, proba * 100 AS sc FROM scored) SELECT ticker, ts, CAST(sc >= 55 AND (risk_on OR sc >= 60) AS BIGINT) AS enter_long, CAST(sc >= least(40, 45) AND (risk_on OR sc >= 65) AS BIGINT) AS hold_long,
  CAST(sc > 0 AND (risk_on OR sc <= 40) AND sc <= 45 AND sc < 55 AS BIGINT) AS enter_short, CAST(sc <= greatest(65, 55) AND (risk_on OR sc <= 65) AS BIGINT) AS hold_short FROM x""",
)
def sc20(spark, sf):
    d = scored(spark, sf).withColumn("sc", F.col("proba") * 100)
    f = {"enter_long": S.may_enter("sc", "risk_on", 55.0), "hold_long": S.may_hold("sc", "risk_on"), "enter_short": S.may_short("sc", "risk_on", 55.0), "hold_short": S.may_hold_short("sc", "risk_on")}
    return out(d.withColumns({k: v.cast("int") for k, v in f.items()}), K, ints=list(f))


@query(
    "sc21_bottleneck",
    f"""WITH {SQL_FOLD_NETS}, x AS (SELECT *, CASE WHEN fold % 3 > 0 THEN net_bps - 10 END AS t, CASE WHEN fold % 4 > 0 THEN net_bps END AS o, round_trip_bps AS c, round_trip_bps * 1.25 AS f FROM foldnets)
SELECT ticker, fold, CASE WHEN o IS NULL AND t IS NULL THEN 'insufficient_rows' WHEN o >= f THEN 'ok' WHEN gross_bps < c THEN 'gross<' || printf('%.1f', c) || '_cost' WHEN t < 0 AND (o IS NULL OR o < 0) THEN 'no_edge_train_and_oos'
  WHEN t >= 0 AND o < 0 THEN 'train_ok_oos_fail' WHEN o < 0 THEN 'oos_negative' WHEN o >= 0 AND o < f THEN 'oos_below_gate' ELSE 'unknown' END AS bottleneck FROM x""",
)
def sc21(spark, sf):
    from ..operators.audits import bottleneck

    d = fold_nets(spark, sf).withColumns({"t": F.when(F.col("fold") % 3 > 0, F.col("net_bps") - 10), "o": F.when(F.col("fold") % 4 > 0, F.col("net_bps")), "c": F.col("round_trip_bps"), "f": F.col("round_trip_bps") * 1.25})
    return d.select("ticker", "fold", bottleneck("t", "o", "gross_bps", "c", "f").alias("bottleneck"))


@query(
    "sc22_verdicts",
    f"""WITH {SQL_FOLD_NETS}, g AS (SELECT ticker, avg(net_bps) AS net, avg(gross_bps) AS gross, bool_or(bottleneck = 'ok') AS tr FROM foldnets GROUP BY 1)
SELECT ticker, CASE WHEN tr AND net >= 5 THEN 'TRADE' WHEN net > 0 OR gross > 3 THEN 'WATCH' ELSE 'SKIP' END AS verdict, concat_ws(',', CASE WHEN gross < 0 THEN 'a_gross' END, CASE WHEN NOT tr THEN 'b_not_tradeable' END, CASE WHEN net < 0 THEN 'c_net' END) AS reasons FROM g""",
)
def sc22(spark, sf):
    g = fold_nets(spark, sf).groupBy("ticker").agg(F.avg("net_bps").alias("net"), F.avg("gross_bps").alias("gross"), F.bool_or(F.col("bottleneck") == "ok").alias("tr"))
    why = S.go_reasons({"c_net": F.col("net") < 0, "b_not_tradeable": ~F.col("tr"), "a_gross": F.col("gross") < 0})
    return g.select("ticker", S.verdict("tr", "net", F.col("gross") - 3).alias("verdict"), F.array_join(why, ",").alias("reasons"))


@query("sc23_weight_blend", f"WITH {SQL_SCORED}, x AS (SELECT ticker, ts, 0.65 * 0.30 + 0.35 * p_imp AS a, 0.65 * 0.35 + 0.35 * p_mr AS b, 0.65 * 0.35 + 0.35 * p_st AS c FROM scored) SELECT ticker, ts, {r('a / (a + b + c)')} AS w_trend, {r('b / (a + b + c)')} AS w_mean_rev, {r('c / (a + b + c)')} AS w_risk FROM x")
def sc23(spark, sf):
    d = scored(spark, sf)
    a, b, c_ = S.blended_weights((F.lit(0.30), F.lit(0.35), F.lit(0.35)), ("p_imp", "p_mr", "p_st"))
    return out(d.withColumns({"w_trend": a, "w_mean_rev": b, "w_risk": c_}), K, ["w_trend", "w_mean_rev", "w_risk"])


@query(
    "sc24_constraints",
    f"""WITH {SQL_FOLD_NETS} SELECT ticker, fold, CAST(greatest(3, least(5, greatest(3, floor(n * 40 * 0.001)))) AS BIGINT) AS min_rows, CAST(greatest(1, least(1, greatest(1, floor(n / 4.0)))) AS BIGINT) AS min_rebalances, {r('least(0.05, greatest(0.02, 0.05 * least(1, n / 20.0)))')} AS min_exposure,
  {r('5 * (greatest(0, 1 - n / 30.0) + greatest(0, 1 - (n % 5) / 3.0) + greatest(0, 1 - (n % 3) / 10.0 / 0.5))')} AS penalty FROM foldnets""",
)
def sc24(spark, sf):
    d = fold_nets(spark, sf)
    d = d.withColumns({**S.constraint_limits(F.col("n") * 40, "n"), "penalty": S.constraint_penalty("n", F.col("n") % 5, (F.col("n") % 3) / 10.0)})
    return out(d, ["ticker", "fold"], ["min_exposure", "penalty"], ["min_rows", "min_rebalances"])


@query(
    "sc25_text_and_time",
    """SELECT event_id, upper(trim(event_type)) AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k, timezone('America/New_York', timezone('UTC', ts)) AS local_ts, CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(date_trunc('month', ts) + INTERVAL 3 MONTH AS DATE) AS next_window FROM events""",
)
def sc25(spark, sf):
    e = table(spark, sf, "events")
    from ..operators.bars import local_time

    return e.select(
        "event_id", F.upper(F.trim("event_type")).alias("name"), F.from_json("props", "k bigint")["k"].alias("k"), local_time().cast("timestamp_ntz").alias("local_ts"),
        F.to_date(F.trunc("ts", "MM")).alias("month_start"), F.add_months(F.trunc("ts", "MM"), 3).alias("next_window"),
    )


# ---- regimes by rule --------------------------------------------------------

SQL_OBSERVED = f"""{SQL_FACTORS}, ro AS (SELECT *, (log_ret - {smean('log_ret', 12, 6)}) / nullif({sstd('log_ret', 12, 6)}, 0) AS ret_z FROM factors),
rf AS (SELECT *, coalesce(vol_ratio, 1) AS vr, coalesce(log_ret, 0) AS lr, coalesce(ret_z, 0) AS z FROM ro),
rg AS (SELECT *, CASE WHEN risk_on THEN 1.0 ELSE 0.0 END AS o, greatest(0, least(2, (vr - 1) / 0.25)) AS vs, tanh(lr / 0.04) AS rs, tanh(z) AS zs, exp(-abs(lr) / 0.025) * exp(-abs(z) / 0.6) AS fl, greatest(0, least(2, -lr / 0.06)) AS ls FROM rf),
rl AS (SELECT *, -0.35 + 2.2 * o + 2.8 * rs + 1.4 * zs - 2.5 * vs - 3.2 * (1 - o) AS l0, 0.10 + 2.4 * fl + 0.8 * (1 - least(vs, 1)) - 1.2 * abs(rs) - 0.6 * abs(zs) AS l1,
  -0.55 + 2.4 * (1 - o) + 2.2 * vs + 2.4 * ls + greatest(0, -zs) - 2.2 * greatest(0, rs) * (1 - o) AS l2 FROM rg),
prior AS (SELECT *, exp(l0) / (exp(l0) + exp(l1) + exp(l2)) AS r_imp, exp(l1) / (exp(l0) + exp(l1) + exp(l2)) AS r_mr, exp(l2) / (exp(l0) + exp(l1) + exp(l2)) AS r_st FROM rl)"""


def observed(spark, sf):
    def stage(d, w):
        from ..functions.frames import log_return, nz, rmean, rstd

        # before the factors, whose arrays end the shuffle that these windows use
        d = d.withColumn("log_ret", log_return("close", w))
        d = d.withColumn("ret_z", (F.col("log_ret") - rmean("log_ret", w, 12, 6)) / nz(rstd("log_ret", w, 12, 6)))
        return X.factors(d, w)

    return in_blocks(daily(spark, sf), stage, back=X.FACTORS_BACK + 12, lay=DAILY)


@query("reg01_rule_prior", f"WITH {SQL_OBSERVED} SELECT ticker, ts, {sel(['r_imp', 'r_mr', 'r_st'])} FROM prior")
def reg01(spark, sf):
    return out(R.rule_prior(observed(spark, sf)), K, ["r_imp", "r_mr", "r_st"])


def cap(k, cond, src, amount, to_st):
    """One capped move of the SQL twin."""
    gain = {"p_imp": "0", "p_mr": f"{1 - to_st:.2f}", "p_st": f"{to_st}"}
    cols = ", ".join((f"greatest(0, {p} - a)" if p == src else p) + f" + {gain[p]} * a AS {p}" for p in ("p_imp", "p_mr", "p_st"))
    return f"c{k}a AS (SELECT *, CASE WHEN {cond} AND {amount} > 0 THEN {amount} ELSE 0 END AS a FROM c{k - 1}), c{k} AS (SELECT * EXCLUDE (p_imp, p_mr, p_st, a), {cols} FROM c{k}a)"


RALLY = "(lr >= 0.05 AND z >= 0.75 AND risk_on AND vr < 1.15)"
SQL_FUSED = f"""{SQL_OBSERVED}, {sql_scores('(SELECT * EXCLUDE (risk_on, vol_ratio), risk_on AS ron FROM prior)', 'fz')},
fu0 AS (SELECT * EXCLUDE (risk_on, vol_ratio), ron AS risk_on, greatest(CASE WHEN lr <= -0.05 OR vr > 1.25 OR (NOT ron AND lr < 0) THEN 0.50 ELSE 0.28 END, CASE WHEN lr >= 0.05 AND z >= 0.75 AND ron AND vr < 1.15 THEN 0.45 ELSE 0 END) AS lam FROM fz),
c0 AS (SELECT ticker, ts, lr, vr, z, risk_on, (1 - lam) * p_imp + lam * r_imp AS p_imp, (1 - lam) * p_mr + lam * r_mr AS p_mr, (1 - lam) * p_st + lam * r_st AS p_st FROM fu0),
{cap(1, 'NOT risk_on', 'p_imp', '(p_imp - CASE WHEN lr >= 0 THEN 0.35 ELSE 0.15 END)', 0.7)}, {cap(2, 'lr <= -0.05', 'p_imp', '(p_imp - 0.20)', 0.7)},
{cap(3, 'lr <= -0.05 AND p_st < 0.28', 'p_imp', 'least(0.28 - p_st, p_imp * 0.5)', 0.7)}, {cap(4, 'vr > 1.25', 'p_imp', '(p_imp - 0.15)', 0.7)},
{cap(5, 'vr > 1.25 AND p_st < 0.38', 'p_mr', 'least(0.38 - p_st, p_mr * 0.6)', 1.0)}, {cap(6, RALLY, 'p_mr', '(p_mr - 0.30)', 0.15)},
c7 AS (SELECT * EXCLUDE (p_imp, p_mr), p_imp + CASE WHEN {RALLY} AND p_imp < 0.40 THEN least(0.40 - p_imp, p_mr) ELSE 0 END AS p_imp, p_mr - CASE WHEN {RALLY} AND p_imp < 0.40 THEN least(0.40 - p_imp, p_mr) ELSE 0 END AS p_mr FROM c6),
fused AS (SELECT ticker, ts, vr, risk_on, lr, z, p_imp / (p_imp + p_mr + p_st) AS p_imp, p_mr / (p_imp + p_mr + p_st) AS p_mr, p_st / (p_imp + p_mr + p_st) AS p_st FROM c7)"""


def fused(spark, sf):
    # probabilities stand in for the filter output; the observables are the real ones
    d = observed(spark, sf).withColumnsRenamed({"risk_on": "_on", "vol_ratio": "_vr"})
    p = with_scores(d).drop("risk_on", "vol_ratio", "vol_ann", "proba", "proba_short", "conf")
    return R.fuse(p.withColumnsRenamed({"_on": "risk_on", "_vr": "vol_ratio"}))


@query("reg02_fused", f"WITH {SQL_FUSED} SELECT ticker, ts, {sel(['p_imp', 'p_mr', 'p_st'])} FROM fused")
def reg02(spark, sf):
    return out(fused(spark, sf), K, ["p_imp", "p_mr", "p_st"])


@query(
    "reg03_rule_regime",
    f"""WITH {SQL_FACTORS} SELECT ticker, ts, CASE WHEN coalesce(vol_ratio, 1) > 1.25 OR NOT risk_on THEN 'stress' WHEN coalesce(trend_12_1, 0) > 0.05 AND coalesce(vol_ratio, 1) < 1.1 THEN 'impulse' WHEN abs(coalesce(z_sma, 0)) < 1 AND coalesce(vol_ratio, 1) < 1.15 THEN 'mean_revert'
  WHEN coalesce(trend_12_1, 0) > 0 THEN 'impulse' ELSE 'mean_revert' END AS regime FROM factors""",
)
def reg03(spark, sf):
    return factor_frame(spark, sf).select("ticker", "ts", R.rule_regime().alias("regime"))


def smix(i):
    return " + ".join(f"{p} * {R.PROFILES[n][i]}" for p, n in zip(R.PROBS, R.NAMES))


@query(
    "reg04_soft_profile",
    f"""WITH {SQL_SCORED}, x AS (SELECT *, greatest(0.05, {smix(0)}) AS a, greatest(0.05, {smix(1)}) AS b, greatest(0.05, {smix(2)}) AS c FROM scored)
SELECT ticker, ts, {r('a / (a + b + c)', 3)} AS w_trend, {r('b / (a + b + c)', 3)} AS w_mean_rev, {r('c / (a + b + c)', 3)} AS w_risk, {r(smix(3), 1)} AS buy_threshold, {r(smix(5), 3)} AS exposure_cap,
  CASE WHEN p_imp >= p_mr AND p_imp >= p_st THEN 'impulse' WHEN p_mr >= p_st THEN 'mean_revert' ELSE 'stress' END AS dominant FROM x""",
)
def reg04(spark, sf):
    d = R.soft_profile(scored(spark, sf))
    return d.select("ticker", "ts", *[rnd(c, 3).alias(c) for c in ("w_trend", "w_mean_rev", "w_risk", "exposure_cap")], rnd("buy_threshold", 1).alias("buy_threshold"), "dominant")


@query(
    "reg09_entropy",
    f"WITH {SQL_SCORED} SELECT ticker, ts, {r('-(p_imp * ln(p_imp) + p_mr * ln(p_mr) + p_st * ln(p_st)) / ln(3)')} AS prob_entropy, {r('list_sort([p_imp, p_mr, p_st])[3] - list_sort([p_imp, p_mr, p_st])[2]')} AS conviction, {r('p_imp - p_st')} AS impulse_edge FROM scored",
)
def reg09(spark, sf):
    d = scored(spark, sf).withColumns({"prob_entropy": R.entropy(), "conviction": R.conviction(), "impulse_edge": F.col("p_imp") - F.col("p_st")})
    return out(d, K, ["prob_entropy", "conviction", "impulse_edge"])


STATE = "CASE WHEN p_imp >= p_mr AND p_imp >= p_st THEN 0 WHEN p_mr >= p_st THEN 1 ELSE 2 END"
TR = ["next_impulse", "next_mean_revert", "next_stress", "transition_entropy", "expected_duration"]


def scount(j):
    cell = lambda i: f"sum(CASE WHEN prev = {i} AND state = {j} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"1.0::DOUBLE + coalesce(CASE state WHEN 0 THEN {cell(0)} WHEN 1 THEN {cell(1)} ELSE {cell(2)} END, 0)"


@query(
    "reg10_transitions",
    f"""WITH {SQL_SCORED}, s AS (SELECT ticker, ts, {STATE} AS state FROM scored), p AS (SELECT *, {lag('state')} AS prev FROM s), c AS (SELECT *, {scount(0)} AS c0, {scount(1)} AS c1, {scount(2)} AS c2 FROM p),
n AS (SELECT *, c0 / (c0 + c1 + c2) AS next_impulse, c1 / (c0 + c1 + c2) AS next_mean_revert, c2 / (c0 + c1 + c2) AS next_stress FROM c),
e AS (SELECT *, -(next_impulse * ln(next_impulse) + next_mean_revert * ln(next_mean_revert) + next_stress * ln(next_stress)) / ln(3) AS transition_entropy, 1 / greatest(1 - CASE state WHEN 0 THEN next_impulse WHEN 1 THEN next_mean_revert ELSE next_stress END, 1e-6) AS expected_duration FROM n)
SELECT ticker, ts, {sel(TR)}, CAST(state AS BIGINT) AS state FROM e""",
)
def reg10(spark, sf):
    d = scored(spark, sf).select("ticker", "ts", F.when((F.col("p_imp") >= F.col("p_mr")) & (F.col("p_imp") >= F.col("p_st")), 0).when(F.col("p_mr") >= F.col("p_st"), 1).otherwise(2).alias("state"))
    return out(R.transition_features(d, DAILY), K, TR, ["state"])


@query("reg11_dominant", f"WITH {SQL_SCORED} SELECT ticker, ts, CASE WHEN p_imp >= p_mr AND p_imp >= p_st THEN 'impulse' WHEN p_mr >= p_st THEN 'mean_revert' ELSE 'stress' END AS regime FROM scored")
def reg11(spark, sf):
    return scored(spark, sf).select("ticker", "ts", R.dominant().alias("regime"))


@query("reg12_blended", f"WITH {SQL_FACTORS} SELECT ts, bool_and(risk_on) AS risk_on, {r('max(vol_ratio)')} AS vol_ratio, count(*) AS n FROM factors GROUP BY 1")
def reg12(spark, sf):
    d = factor_frame(spark, sf).groupBy("ts").agg(F.bool_and("risk_on").alias("risk_on"), F.max("vol_ratio").alias("vol_ratio"), F.count(F.lit(1)).alias("n"))
    return d.select("ts", "risk_on", rnd("vol_ratio").alias("vol_ratio"), "n")
