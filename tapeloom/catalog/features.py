"""Feature windows and cross-section ranks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..dims import round_trip
from ..functions.frames import change, epoch, log_return, rstd
from ..operators import bars as B
from ..operators import features as X
from ..operators.blocks import in_blocks
from ..operators.spread import average_ranks, quantiles, salted_join
from .bars import SQL_DIM, SQL_SESSION, SQL_SUPPLIERS, sessions, supplier_dim
from .base import (
    DAILY, INTRADAY, SQL_BARS, SQL_DAILY, SQL_FLOW, W, bars, daily, flow, ints, out, over, query, r, sclip, sel, smean, smedian,
    sql_scores, sroll, sstd, ssum, with_scores,
)

K = ["ticker", "ts"]


def lag(x, k=1):
    return f"lag({x}, {k}) OVER {W}"


def schange(x, k=1):
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def block(df, fn, back, lay=DAILY):
    return in_blocks(df, fn, back=back, lay=lay)


SQL_RETS = f"{SQL_DAILY}, rets AS (SELECT *, {schange('close')} AS ret, ln(close / {lag('close')}) AS log_ret FROM daily)"


@query("feat01_returns", f"WITH {SQL_DAILY} SELECT ticker, ts, " + ", ".join(f"{r(schange('close', k))} AS ret_{k}" for k in (1, 6, 12, 24)) + " FROM daily")
def feat01(spark, sf):
    return out(block(daily(spark, sf), X.returns, 24), K, ["ret_1", "ret_6", "ret_12", "ret_24"])


# candle shape and flow
SQL_SHAPE = """shape0 AS (SELECT *, nullif(high - low, 0) AS hl, greatest(least(open, close) - low, 0) AS lw, greatest(high - greatest(open, close), 0) AS uw, abs(close - open) AS body FROM {src}),
shape AS (SELECT *, coalesce(greatest(-1, least(1, ((close - low) - (high - close)) / hl)), 0) AS clv_raw, coalesce(lw / hl, 0) AS lower_wick_ratio, coalesce(uw / hl, 0) AS upper_wick_ratio,
  coalesce(body / hl, 0) AS body_ratio, coalesce(lw / nullif(body, 0), coalesce(lw / hl, 0)) AS hammer_score FROM shape0),
shaped AS (SELECT * EXCLUDE (clv_raw), CASE WHEN hl IS NULL THEN 0 ELSE clv_raw END AS clv, CASE WHEN hl IS NULL THEN 0 ELSE greatest(-1, least(1, (lw - uw) / hl)) END AS wick_bias,
  coalesce(last_value(nullif(sign(close - open), 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS bsign FROM shape),
cflow0 AS (SELECT *, greatest(0, least(1, 0.45 * (clv + 1) / 2 + 0.30 * (wick_bias + 1) / 2 + 0.25 * (bsign + 1) / 2)) AS share FROM shaped),
cflow AS (SELECT *, share AS buy_share, volume * share AS buy_vol_est, volume * (1 - share) AS sell_vol_est,
  coalesce((volume * share - volume * (1 - share)) / nullif(volume, 0), 0) AS vol_imbalance FROM cflow0)"""
SHAPE_D, SHAPE_B = SQL_SHAPE.format(src="daily"), SQL_SHAPE.format(src="bars")
SQL_HYBRID = f"""{SQL_BARS}, {SQL_FLOW}, {SHAPE_B},
hy0 AS (SELECT c.* EXCLUDE (buy_share, buy_vol_est, sell_vol_est, vol_imbalance, share), coalesce(buy_count, 0) + coalesce(sell_count, 0) > 0 AS live,
  CASE WHEN coalesce(buy_count, 0) + coalesce(sell_count, 0) > 0 THEN (buy_count - sell_count) / (buy_count + sell_count) ELSE 0.0 END AS tick_imbalance,
  c.buy_share AS bs, c.vol_imbalance AS vi, c.buy_vol_est AS bv, c.sell_vol_est AS sv FROM cflow c LEFT JOIN flow f USING (ticker, ts)),
hybrid AS (SELECT *, CASE WHEN live THEN tick_imbalance ELSE vi END AS vol_imbalance, CASE WHEN live THEN (tick_imbalance + 1) / 2 ELSE bs END AS buy_share,
  CASE WHEN live THEN volume * ((tick_imbalance + 1) / 2) ELSE bv END AS buy_vol_est, CASE WHEN live THEN volume * (1 - (tick_imbalance + 1) / 2) ELSE sv END AS sell_vol_est,
  CASE WHEN live THEN 1.0 ELSE 0.0 END AS flow_source FROM hy0)"""


def hybrid(spark, sf):
    return X.hybrid_flow(bars(spark, sf), flow(spark, sf), INTRADAY)


IMB = "coalesce(vol_imbalance, 0)"


@query(
    "feat02_imbalance",
    f"WITH {SQL_HYBRID} SELECT ticker, ts, {r(smean(IMB, 6, 1))} AS imb_ma_6, {r(smean(IMB, 12, 1))} AS imb_ma_12, "
    f"{r(f'({IMB} - {smean(IMB, 48, 12)}) / nullif({sstd(IMB, 48, 12)}, 0)')} AS imb_z FROM hybrid",
)
def feat02(spark, sf):
    return out(block(hybrid(spark, sf), X.imbalance_stats, 48, INTRADAY), K, ["imb_ma_6", "imb_ma_12", "imb_z"])


@query("feat03_volume_body", f"WITH {SQL_DAILY} SELECT ticker, ts, {r('volume / nullif(' + smean('volume', 20, 5) + ', 0)')} AS vol_z, {r('(close - open) / nullif(open, 0)')} AS body_pct FROM daily")
def feat03(spark, sf):
    return out(block(daily(spark, sf), X.volume_and_body, 20), K, ["vol_z", "body_pct"])


@query(
    "feat04_session_position",
    f"""WITH {SQL_BARS}, {SQL_DIM}, {SQL_SESSION} SELECT ticker, ts, row_number() OVER (PARTITION BY ticker, session ORDER BY ts) - 1 AS session_pos,
  {r("(row_number() OVER (PARTITION BY ticker, session ORDER BY ts) - 1)::DOUBLE / greatest(count(close) OVER (PARTITION BY ticker, session) - 1, 1)")} AS session_progress FROM sess""",
)
def feat04(spark, sf):
    return out(X.session_position(sessions(spark, sf)), K, ["session_progress"], ["session_pos"])


@query("feat05_realised_vol", f"WITH {SQL_RETS} SELECT ticker, ts, {r(sstd('ret', 12, 4))} AS vol_realized_12 FROM rets")
def feat05(spark, sf):
    def fn(d, w):
        d = d.withColumn("_r", change("close", w, 1))
        return d.withColumn("vol_realized_12", rstd("_r", w, 12, 4))

    return out(block(daily(spark, sf), fn, 13), K, ["vol_realized_12"])


SHAPES = ["clv", "lower_wick_ratio", "upper_wick_ratio", "body_ratio", "hammer_score"]


@query("feat06_candle_shape", f"WITH {SQL_DAILY}, {SHAPE_D} SELECT ticker, ts, {sel(SHAPES)} FROM cflow")
def feat06(spark, sf):
    return out(X.candle_shape(daily(spark, sf)), K, SHAPES)


FLOWS = ["buy_share", "buy_vol_est", "sell_vol_est", "vol_imbalance"]


@query("feat07_candle_flow", f"WITH {SQL_DAILY}, {SHAPE_D} SELECT ticker, ts, {sel(FLOWS, 5)} FROM cflow")
def feat07(spark, sf):
    return out(X.candle_flow(daily(spark, sf), DAILY), K, FLOWS, d=5)


@query("feat08_hybrid_flow", f"WITH {SQL_HYBRID} SELECT ticker, ts, {sel(FLOWS + ['tick_imbalance', 'flow_source'], 5)} FROM hybrid")
def feat08(spark, sf):
    return out(hybrid(spark, sf), K, FLOWS + ["tick_imbalance", "flow_source"], d=5)


def skernel(n: int, bw: float) -> str:
    wts = ", ".join(repr(x) for x in reversed(X.kernel_weights(n, bw)))
    return f"(CASE WHEN count(close) OVER {over(n)} = {n} THEN list_dot_product(list(close) OVER {over(n)}, CAST([{wts}] AS DOUBLE[])) END)"


def sql_envelope(src: str) -> str:
    return f"""env0 AS (SELECT *, {skernel(48, 6.0)} AS nw_est FROM {src}),
env1 AS (SELECT *, close - nw_est AS res FROM env0),
env2 AS (SELECT *, coalesce({sstd('res', 24, 8)}, {smean('abs(res)', 8)}) AS band FROM env1),
env3 AS (SELECT *, nw_est + 2 * band AS up, nw_est - 2 * band AS lo, nullif((nw_est + 2 * band) - (nw_est - 2 * band), 0) AS width FROM env2),
env AS (SELECT *, (nw_est - {lag('nw_est', 6)}) / nullif({lag('nw_est', 6)}, 0) AS nw_slope, coalesce(CASE WHEN width IS NOT NULL THEN greatest(0, least(1, (close - lo) / width)) END, 0.5) AS nw_env_pos,
  coalesce(width / nullif(close, 0), 0) AS nw_band_width, CASE WHEN close > up THEN 1.0 ELSE 0.0 END AS nw_breakout_up, CASE WHEN close < lo THEN 1.0 ELSE 0.0 END AS nw_breakout_dn FROM env3)"""


@query("feat09_kernel_estimate", f"WITH {SQL_DAILY} SELECT ticker, ts, {r(skernel(48, 6.0))} AS nw_est FROM daily")
def feat09(spark, sf):
    return out(block(daily(spark, sf), lambda d, w: d.withColumn("nw_est", X.kernel_estimate(w, 48, 6.0)), 48), K, ["nw_est"])


ENV = ["nw_est", "nw_slope", "nw_env_pos", "nw_band_width", "nw_breakout_up", "nw_breakout_dn"]


@query("feat10_envelope", f"WITH {SQL_DAILY}, {sql_envelope('daily')} SELECT ticker, ts, {sel(ENV)} FROM env")
def feat10(spark, sf):
    return out(block(daily(spark, sf), X.envelope, X.ENVELOPE_BACK), K, ENV)


@query(
    "feat11_rsi",
    f"""WITH {SQL_DAILY}, d AS (SELECT *, close - {lag('close')} AS delta FROM daily), g AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS up, CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS dn FROM d)
SELECT ticker, ts, {r(f"coalesce(100 - 100 / (1 + {smean('up', 14)} / nullif({smean('dn', 14)}, 0)), 50) / 100")} AS rsi_14 FROM g""",
)
def feat11(spark, sf):
    return out(block(daily(spark, sf), X.with_rsi, 16), K, ["rsi_14"])


@query(
    "feat12_macd",
    f"""WITH RECURSIVE {SQL_DAILY}, p AS MATERIALIZED (SELECT ticker, ts, close, row_number() OVER {W} AS i FROM daily),
e AS (SELECT ticker, ts, i, close AS f, close AS s, CAST(0 AS DOUBLE) AS g FROM p WHERE i = 1
  UNION ALL SELECT p.ticker, p.ts, p.i, p.close * (2.0 / 13::DOUBLE) + e.f * (1 - 2.0 / 13::DOUBLE), p.close * (2.0 / 27::DOUBLE) + e.s * (1 - 2.0 / 27::DOUBLE),
  ((p.close * (2.0 / 13::DOUBLE) + e.f * (1 - 2.0 / 13::DOUBLE)) - (p.close * (2.0 / 27::DOUBLE) + e.s * (1 - 2.0 / 27::DOUBLE))) * 0.2 + e.g * 0.8 FROM e JOIN p ON p.ticker = e.ticker AND p.i = e.i + 1)
SELECT ticker, ts, {r('(f - s) - g')} AS macd_hist FROM e""",
)
def feat12(spark, sf):
    return out(block(daily(spark, sf), X.macd_hist, X.MACD_BACK), K, ["macd_hist"])


SQL_IMPULSE = f"""{SQL_HYBRID}, {sql_envelope('hybrid')},
imp0 AS (SELECT *, {schange('close', 6)} AS roc_6, {schange('close', 12)} AS roc_12, {schange('close', 24)} AS roc_24 FROM env),
imp1 AS (SELECT *, coalesce(roc_6, 0) AS mom_short, coalesce(roc_24, 0) AS mom_long FROM imp0),
impulse AS (SELECT *, CASE WHEN coalesce(nullif(sign(mom_short), 0) <> nullif(sign(mom_long), 0), true) THEN 1.0 ELSE 0.0 END AS side_shift,
  0.4 * abs(mom_short) + 0.3 * abs((nw_env_pos - 0.5) * 2 * sign(mom_short)) + 0.3 * abs(vol_imbalance * sign(mom_short)) AS impulse_raw,
  lower_wick_ratio * greatest(vol_imbalance, 0) * (1 - nw_env_pos) AS power_shift FROM imp1)"""
IMP = ["roc_6", "roc_12", "roc_24", "mom_short", "mom_long", "side_shift", "impulse_raw", "power_shift"]


def impulse_frame(spark, sf):
    return block(hybrid(spark, sf), lambda d, w: X.impulse(X.envelope(d, w), w), X.ENVELOPE_BACK + 24, INTRADAY)


@query("feat13_impulse", f"WITH {SQL_IMPULSE} SELECT ticker, ts, {sel(IMP)} FROM impulse")
def feat13(spark, sf):
    return out(impulse_frame(spark, sf), K, IMP)


@query(
    "feat14_trend_efficiency",
    f"""WITH {SQL_DAILY}, d AS (SELECT *, abs(close - {lag('close')}) AS step FROM daily)
SELECT ticker, ts, {r(sclip(f"abs(close - {lag('close', 24)}) / nullif({ssum('step', 24, 8)}, 0)", 0, 1))} AS trend_efficiency_24 FROM d""",
)
def feat14(spark, sf):
    return out(block(daily(spark, sf), X.trend_efficiency, 26), K, ["trend_efficiency_24"])


@query(
    "feat15_autocorrelation",
    f"""WITH {SQL_RETS}, a AS (SELECT *, ret - {smean('ret', 24, 12)} AS dev FROM rets), b AS (SELECT *, dev * {lag('dev')} AS prod FROM a)
SELECT ticker, ts, {r(sclip(f"{smean('prod', 24, 12)} / nullif({sroll('var_pop', 'dev', 24, 12)}, 0)", -1, 1))} AS ret_autocorr_24 FROM b""",
)
def feat15(spark, sf):
    return out(block(daily(spark, sf), X.return_autocorrelation, 52), K, ["ret_autocorr_24"])


@query(
    "feat16_range_z",
    f"""WITH {SQL_RETS}, a AS (SELECT *, avg(CASE WHEN greatest(high - low, 0) <= 1e-12 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY ticker) > 0.5 AS flat FROM rets),
b AS (SELECT *, CASE WHEN flat THEN coalesce(abs(ret), 0) * abs(close) ELSE greatest(high - low, 0) END AS rng FROM a)
SELECT ticker, ts, {r(f"coalesce((rng - {smean('rng', 96, 12)}) / (CASE WHEN {sstd('rng', 96, 12)} > 1e-12 THEN {sstd('rng', 96, 12)} END), 0)")} AS hl_range_z_24 FROM b""",
)
def feat16(spark, sf):
    d = daily(spark, sf)
    d = salted_join(d, X.flat_share(d), ["ticker"])
    return out(block(d, X.range_z, 97), K, ["hl_range_z_24"])


@query("feat17_vol_of_vol", f"WITH {SQL_RETS}, a AS (SELECT *, {sstd('ret', 12, 4)} AS rv FROM rets) SELECT ticker, ts, {r(sstd('rv', 24, 8))} AS vol_of_vol_24 FROM a")
def feat17(spark, sf):
    return out(block(daily(spark, sf), X.vol_of_vol, 40), K, ["vol_of_vol_24"])


@query(
    "feat18_distances",
    f"""WITH {SQL_DAILY}, {sql_envelope('daily')}, v AS (SELECT *, (high + low + close) / 3.0::DOUBLE * greatest(volume, 0) AS pv FROM env)
SELECT ticker, ts, {r(f"(close - {ssum('pv', 78, 19)} / nullif({ssum('volume', 78, 19)}, 0)) / nullif(close, 0)")} AS vwap_dist, {r('(close - nw_est) / nullif(close, 0) / nullif(nw_band_width, 0)')} AS nw_z FROM v""",
)
def feat18(spark, sf):
    return out(block(daily(spark, sf), lambda d, w: X.distances(X.envelope(d, w), w), X.ENVELOPE_BACK), K, ["vwap_dist", "nw_z"])


SQL_POS = f"{SQL_RETS}, p AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM rets)"


@query(
    "feat19_hurst",
    f"""WITH {SQL_POS}, seg AS (SELECT e.ticker, e.pos AS e, p.pos, p.ret FROM p e JOIN p ON p.ticker = e.ticker AND p.pos BETWEEN e.pos - 191 AND e.pos WHERE e.pos % 12 = 11 AND e.pos >= 191 AND p.ret IS NOT NULL),
dev AS (SELECT *, ret - avg(ret) OVER (PARTITION BY ticker, e) AS d FROM seg), cs AS (SELECT *, sum(d) OVER (PARTITION BY ticker, e ORDER BY pos) AS y FROM dev),
h AS (SELECT ticker, e, ln((max(y) - min(y)) / stddev_samp(ret)) / ln(count(*)) AS hurst_rs FROM cs GROUP BY 1, 2)
SELECT p.ticker, ts, {r('hurst_rs')} AS hurst_rs FROM p LEFT JOIN h ON h.ticker = p.ticker AND h.e = (p.pos - 11) // 12 * 12 + 11 AND p.pos >= 191""",
)
def feat19(spark, sf):
    return out(X.hurst(daily(spark, sf), 192, DAILY), K, ["hurst_rs"])


SPEC = ["spec_dominant_period", "spec_entropy", "spec_low_high_ratio"]


@query(
    "feat20_spectral",
    f"""WITH {SQL_BARS}, rets AS (SELECT *, {schange('close')} AS ret FROM bars), p AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM rets),
seg AS (SELECT e.ticker, e.pos AS e, p.pos, p.ret, row_number() OVER (PARTITION BY e.ticker, e.pos ORDER BY p.pos) - 1 AS j, count(*) OVER (PARTITION BY e.ticker, e.pos) AS n,
  avg(p.ret) OVER (PARTITION BY e.ticker, e.pos) AS m FROM p e JOIN p ON p.ticker = e.ticker AND p.pos BETWEEN e.pos - 95 AND e.pos WHERE e.pos % 12 = 11 AND e.pos >= 95 AND p.ret IS NOT NULL),
ft AS (SELECT ticker, e, n, k, power(sum((ret - m) * cos(2 * pi() * k * j / n)), 2) + power(sum((ret - m) * sin(2 * pi() * k * j / n)), 2) AS pw FROM seg, range(1, 49) t(k) WHERE k <= n // 2 GROUP BY 1, 2, 3, 4),
tot AS (SELECT *, sum(pw) OVER (PARTITION BY ticker, e) AS total, count(*) OVER (PARTITION BY ticker, e) AS mm FROM ft),
s AS (SELECT ticker, e, n::DOUBLE / arg_max(k, pw) AS spec_dominant_period, -sum(greatest(pw / total, 1e-12) * ln(greatest(pw / total, 1e-12))) / ln(any_value(mm)) AS spec_entropy,
  sum(CASE WHEN k <= mm // 3 THEN pw END) / sum(CASE WHEN k > mm // 3 THEN pw END) AS spec_low_high_ratio FROM tot GROUP BY ticker, e, n)
SELECT p.ticker, ts, {sel(SPEC)} FROM p LEFT JOIN s ON s.ticker = p.ticker AND s.e = (p.pos - 11) // 12 * 12 + 11 AND p.pos >= 95""",
)
def feat20(spark, sf):
    return out(X.spectral(bars(spark, sf), 96, INTRADAY), K, SPEC)


@query(
    "feat21_conditional_vol",
    f"""WITH {SQL_RETS}, a AS (SELECT *, {sstd('ret', 12, 4)} AS rv FROM rets), b AS (SELECT *, {smedian('rv', 48, 12)} AS med FROM a)
SELECT ticker, ts, {r('rv')} AS garch_cond_vol, {r('coalesce(CASE WHEN med > 1e-12 THEN rv / med END, 1)')} AS garch_vol_ratio FROM b""",
)
def feat21(spark, sf):
    return out(block(daily(spark, sf), X.conditional_vol, 62), K, ["garch_cond_vol", "garch_vol_ratio"])


SQL_PROFILE = f"""{SQL_BARS}, {SQL_DIM}, {SQL_SESSION},
vb AS (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY ts) AS n, min(low) OVER ws AS lo, max(high) OVER ws AS hi, sum(volume) OVER ws AS vsum FROM sess
  WINDOW ws AS (PARTITION BY ticker, session ORDER BY ts)),
hist AS (SELECT a.ticker, a.ts, a.lo, a.hi, greatest(0, least(floor(((b.high + b.low + b.close) / 3.0::DOUBLE - a.lo) / (a.hi - a.lo) * 24), 23)) AS bin, sum(b.volume) AS v
  FROM vb a JOIN vb b ON a.ticker = b.ticker AND a.session = b.session AND b.ts <= a.ts WHERE a.n >= 6 AND a.hi > a.lo AND a.vsum > 0 GROUP BY 1, 2, 3, 4, 5),
ranked AS (SELECT *, row_number() OVER o AS rk, sum(v) OVER (PARTITION BY ticker, ts ORDER BY v DESC, bin ROWS UNBOUNDED PRECEDING) - v AS before, sum(v) OVER (PARTITION BY ticker, ts) AS tot FROM hist
  WINDOW o AS (PARTITION BY ticker, ts ORDER BY v DESC, bin)),
lv AS (SELECT ticker, ts, max(CASE WHEN rk = 1 THEN lo + (bin + 0.5) * (hi - lo) / 24 END) AS poc, max(CASE WHEN before < tot * 0.7::DOUBLE THEN lo + (bin + 0.5) * (hi - lo) / 24 END) AS vah,
  min(CASE WHEN before < tot * 0.7::DOUBLE THEN lo + (bin + 0.5) * (hi - lo) / 24 END) AS val FROM ranked GROUP BY 1, 2),
vp AS (SELECT vb.*, coalesce(poc, close) AS vp_poc, coalesce(vah, close) AS vp_vah, coalesce(val, close) AS vp_val FROM vb LEFT JOIN lv USING (ticker, ts)),
geo AS (SELECT *, (close - vp_poc) / vp_poc AS vp_poc_dist, greatest(vp_vah - vp_val, 1e-9) / greatest(vp_poc, 1e-9) AS vp_va_width, CASE WHEN close >= vp_val AND close <= vp_vah THEN 1.0 ELSE 0.0 END AS vp_in_value,
  CASE WHEN close > vp_poc THEN 1.0 ELSE 0.0 END AS vp_above_poc, CASE WHEN close < vp_val THEN 1.0 ELSE 0.0 END AS vp_below_val, CASE WHEN abs(close - vp_poc) / greatest(vp_poc, 1e-9) < 0.002 THEN 1.0 ELSE 0.0 END AS vp_near_poc FROM vp)"""


def profile(spark, sf):
    return X.profile_geometry(X.volume_profile(sessions(spark, sf)))


@query("feat22_volume_profile", f"WITH {SQL_PROFILE} SELECT ticker, ts, {sel(['vp_poc', 'vp_vah', 'vp_val'])} FROM geo")
def feat22(spark, sf):
    return out(X.volume_profile(sessions(spark, sf)), K, ["vp_poc", "vp_vah", "vp_val"])


GEO = ["vp_poc_dist", "vp_va_width", "vp_in_value", "vp_above_poc", "vp_below_val", "vp_near_poc"]


@query("feat23_profile_geometry", f"WITH {SQL_PROFILE} SELECT ticker, ts, {sel(GEO)} FROM geo")
def feat23(spark, sf):
    return out(profile(spark, sf), K, GEO)


@query(
    "feat24_profile_regime",
    f"""WITH {SQL_PROFILE}, {sql_scores('geo')}, f AS (SELECT *, CASE WHEN vp_above_poc = 0 THEN 0.5 ELSE vp_above_poc END AS ab, CASE WHEN vp_in_value = 0 THEN 0.5 ELSE vp_in_value END AS inn, greatest(vp_va_width, 1e-6) AS wd FROM scored),
g AS (SELECT *, greatest(-1, least(2, ab * (1 + vp_poc_dist) + (1 - inn) * 0.5)) AS tr, greatest(-1, least(1.5, vp_below_val - vp_above_poc * (vp_poc_dist / wd) * 0.5 + CASE WHEN vp_poc_dist < -0.001 * wd THEN abs(vp_poc_dist) * 0.5 ELSE 0 END)) AS rg FROM f)
SELECT ticker, ts, {r('p_imp * tr', 4)} AS vp_impulse_sig, {r('p_mr * rg', 4)} AS vp_mean_revert_sig, {r('greatest(0, 1 - p_st * 1.5) * (p_imp * tr + p_mr * rg)', 4)} AS vp_composite FROM g""",
)
def feat24(spark, sf):
    return out(X.profile_regime_signals(with_scores(profile(spark, sf))), K, ["vp_impulse_sig", "vp_mean_revert_sig", "vp_composite"], d=4)


SQL_FACTORS = f"""{SQL_RETS}, fa0 AS (SELECT *, {sstd('log_ret', 20)} * sqrt(252) AS ann_vol, (close - {smean('close', 200)}) / nullif({sstd('close', 200)}, 0) AS z_sma,
  {lag('close', 21)} / {lag('close', 273)} - 1 AS trend_12_1, coalesce(close > {smean('close', 200)}, false) AS risk_on FROM rets),
factors AS (SELECT *, ann_vol / nullif({smedian('ann_vol', 1260, 252)}, 0) AS vol_ratio FROM fa0)"""
FAC = ["ann_vol", "z_sma", "trend_12_1", "vol_ratio"]


def factor_frame(spark, sf):
    return block(daily(spark, sf), X.factors, X.FACTORS_BACK)


@query("feat25_factors", f"WITH {SQL_FACTORS} SELECT ticker, ts, {sel(FAC)}, CAST(risk_on AS BIGINT) AS risk_on FROM factors")
def feat25(spark, sf):
    d = factor_frame(spark, sf).withColumn("risk_on", F.col("risk_on").cast("int"))
    return out(d, K, FAC, ["risk_on"])


def sql_observations(src: str) -> str:
    return f"""ob0 AS (SELECT *, ln(close / {lag('close')}) AS log_ret FROM {src}),
ob1 AS (SELECT *, {smean('log_ret', 12, 6)} AS mu, {sstd('log_ret', 12, 6)} AS sd, coalesce(close > {smean('close', 288, 12)}, false) AS risk_on FROM ob0),
ob2 AS (SELECT *, (log_ret - mu) / nullif(sd, 0) AS ret_z, sd * sqrt(105120) AS vol, (mu - {smean('mu', 288, 12)}) / nullif({sstd('mu', 288, 12)}, 0) AS trend_z FROM ob1),
ob3 AS (SELECT *, vol / nullif({smedian('vol', 288, 72)}, 0) AS vol_ratio FROM ob2),
obs AS (SELECT *, (vol_ratio - {smean('vol_ratio', 12, 6)}) / nullif({sstd('vol_ratio', 12, 6)}, 0) AS vol_z FROM ob3)"""


OBS = ["log_ret", "ret_z", "vol_ratio", "vol_z", "trend_z"]


@query(
    "feat26_bar_observations",
    f"WITH {SQL_BARS}, {sql_observations('bars')} SELECT ticker, ts, {sel(OBS)}, CAST(risk_on AS BIGINT) AS risk_on FROM obs WHERE ret_z IS NOT NULL AND vol_z IS NOT NULL AND trend_z IS NOT NULL",
)
def feat26(spark, sf):
    d = block(bars(spark, sf), X.bar_observations, X.OBSERVATIONS_BACK, INTRADAY).dropna(subset=["ret_z", "vol_z", "trend_z"])
    return out(d.withColumn("risk_on", F.col("risk_on").cast("int")), K, OBS, ["risk_on"])


@query(
    "feat27_period_observations",
    f"""WITH {SQL_RETS}, a AS (SELECT *, {sstd('log_ret', 20)} * sqrt(365) AS vol FROM rets), b AS (SELECT ticker, ts, log_ret, vol / nullif({smedian('vol', 252, 20)}, 0) AS vol_ratio FROM a),
c AS (SELECT * FROM b WHERE log_ret IS NOT NULL AND vol_ratio IS NOT NULL),
d AS (SELECT *, (log_ret - {smean('log_ret', 12, 6)}) / nullif({sstd('log_ret', 12, 6)}, 0) AS ret_z, (vol_ratio - {smean('vol_ratio', 12, 6)}) / nullif({sstd('vol_ratio', 12, 6)}, 0) AS vol_z FROM c)
SELECT ticker, ts, {sel(['log_ret', 'vol_ratio', 'ret_z', 'vol_z'])} FROM d WHERE ret_z IS NOT NULL AND vol_z IS NOT NULL""",
)
def feat27(spark, sf):
    return out(X.period_features(daily(spark, sf).select("ticker", "ts", "close"), DAILY), K, ["log_ret", "vol_ratio", "ret_z", "vol_z"])


@query(
    "feat28_window_explainer",
    f"""WITH {SQL_DAILY}, p AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY ticker) - 1 AS lastp FROM daily),
s AS (SELECT * FROM p WHERE pos <= least(250, lastp) AND pos > least(250, lastp) - 12),
t AS (SELECT ticker, ts, close, pos, lastp, ln(close / {lag('close')}) AS log_ret, row_number() OVER {W} - 1 AS bar FROM s),
u AS (SELECT *, avg(log_ret) OVER (PARTITION BY ticker) AS mu, stddev_samp(log_ret) OVER (PARTITION BY ticker) AS sigma, pos = least(250, lastp) AS is_current FROM t)
SELECT ticker, ts, {r('close')} AS close, {r('log_ret')} AS log_ret, {r('mu')} AS mu, {r('sigma')} AS sigma, CAST(bar AS BIGINT) AS bar, CAST(is_current AS BIGINT) AS is_current,
  {r("(max(CASE WHEN is_current THEN log_ret END) OVER (PARTITION BY ticker) - mu) / (CASE WHEN sigma > 1e-12 THEN sigma END)")} AS ret_z FROM u""",
)
def feat28(spark, sf):
    d = X.window_explainer(daily(spark, sf).select("ticker", "ts", "close"), F.lit(250), 12, DAILY)
    d = d.withColumn("is_current", F.col("is_current").cast("int"))
    return out(d, K, ["close", "log_ret", "mu", "sigma", "ret_z"], ["bar", "is_current"])


@query("feat29_cost_feature", f"WITH {SQL_DAILY}, {SQL_SUPPLIERS} SELECT ticker, ts, {r('2 * (commission_bps + slippage_bps)')} AS round_trip_bps FROM daily JOIN dim USING (ticker)")
def feat29(spark, sf):
    dim = supplier_dim(spark, sf).select("ticker", "round_trip_bps")
    return out(salted_join(daily(spark, sf), dim, ["ticker"]), K, ["round_trip_bps"])


CATALOG = X.active_columns()


@query(
    "feat30_catalogue",
    f"WITH {SQL_DAILY}, {SHAPE_D}, x AS (SELECT *, {schange('close')} AS ret_1 FROM cflow), "
    + "c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{g}' AS feature_group, count({c}) AS n_values FROM x" for c, g in (("ret_1", "price_momentum"), ("lower_wick_ratio", "candle_geometry"), ("upper_wick_ratio", "candle_geometry"))
    )
    + ") SELECT * FROM c",
)
def feat30(spark, sf):
    d = block(X.candle_flow(daily(spark, sf), DAILY), lambda x, w: X.returns(x, w, (1,)), 1)
    have = X.resolve_columns(d)
    counts = d.agg(*[F.count(c).alias(c) for c in have])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(X.feature_group(c)).alias("feature_group"), F.col(c).alias("n_values")) for c in have])
    return counts.select(F.inline(rows))


@query(
    "feat31_rolling_sharpe",
    f"""WITH {SQL_RETS}, b AS (SELECT ts, avg(ret) AS bench FROM rets WHERE ret IS NOT NULL GROUP BY 1), x AS (SELECT rets.*, bench, ret - bench AS exc FROM rets LEFT JOIN b USING (ts))
SELECT ticker, ts, {r(f"{smean('ret', 60, 20)} / nullif({sstd('ret', 60, 20)}, 0) * sqrt(252)")} AS rolling_sharpe, {r(smean('exc', 60, 20) + ' * 10000', 4)} AS rolling_excess_bps FROM x""",
)
def feat31(spark, sf):
    d = block(daily(spark, sf), lambda x, w: x.withColumn("ret", change("close", w, 1)), 1)
    bench = d.groupBy("ts").agg(F.avg("ret").alias("bench"))
    d = d.join(bench, "ts", "left")
    d = block(d, lambda x, w: X.rolling_excess(X.rolling_sharpe(x, w, "ret", 60, 252), w, "ret", "bench", 60), 61)
    return d.select(*K, F.round("rolling_sharpe", 6).alias("rolling_sharpe"), (F.round("rolling_excess_bps", 4) + 0.0).alias("rolling_excess_bps"))


SQL_GRID = f"""g AS (SELECT ts, row_number() OVER (ORDER BY ts) AS gpos FROM (SELECT DISTINCT ts FROM bars)),
gr AS (SELECT bars.*, gpos, CASE WHEN gpos - lag(gpos) OVER {W} = 1 THEN close / lag(close) OVER {W} - 1 END AS ret FROM bars JOIN g USING (ts))"""


@query(
    "feat32_grid_returns",
    f"""WITH {SQL_BARS}, {SQL_GRID}, w AS (SELECT a.ticker, a.ts, a.ret, stddev_samp(b.ret) AS sd, count(b.ret) AS n FROM gr a JOIN gr b ON a.ticker = b.ticker AND b.gpos BETWEEN a.gpos - 19 AND a.gpos GROUP BY a.ticker, a.ts, a.ret)
SELECT ticker, ts, {r('ret')} AS ret, {r('CASE WHEN n >= 5 THEN sd * sqrt(105120) END', 4)} AS vol_20 FROM w""",
)
def feat32(spark, sf):
    d = B.grid_returns(bars(spark, sf), INTRADAY)

    def vol(x, w):
        # twenty grid rows back, counted on the grid; a ticker has at most one bar per grid row
        span = Window.partitionBy("ticker", "_blk").orderBy("gpos").rangeBetween(-19, 0)
        return x.withColumn("vol_20", F.when(F.count("ret").over(span) >= 5, F.stddev_samp("ret").over(span)) * math.sqrt(105120))

    d = block(d, vol, 20, INTRADAY)
    return d.select(*K, (F.round("ret", 6) + 0.0).alias("ret"), F.round("vol_20", 4).alias("vol_20"))


RULE = ["nw_est", "nw_upper", "nw_lower", "nw_width", "nw_env_pos", "nw_dev_below", "nw_slope"]
SQL_RULE_ENV = f"""re0 AS (SELECT *, {skernel(80, 24.0)} AS nw_est FROM {{src}}), re1 AS (SELECT *, close - nw_est AS res FROM re0),
re2 AS (SELECT *, coalesce({sstd('res', 40, 10)}, {smean('abs(res)', 8, 4)}) AS band FROM re1),
re3 AS (SELECT *, nw_est + 2 * band AS nw_upper, nw_est - 2 * band AS nw_lower, nullif((nw_est + 2 * band) - (nw_est - 2 * band), 0) AS nw_width FROM re2),
re4 AS (SELECT *, coalesce(CASE WHEN nw_width IS NOT NULL THEN greatest(0, least(1, (close - nw_lower) / nw_width)) END, 0.5) AS nw_env_pos,
  coalesce(CASE WHEN nw_width IS NOT NULL THEN greatest(-((close - nw_lower) / nw_width), 0) END, 0) AS nw_dev_below, coalesce(nw_est / {lag('nw_est', 5)} - 1, 0) AS nw_slope FROM re3),
renv AS (SELECT *, nw_env_pos <= 0.12 AS nw_touches_lower FROM re4)"""


@query("feat33_rule_envelope", f"WITH {SQL_DAILY}, {SQL_RULE_ENV.format(src='daily')} SELECT ticker, ts, {sel(RULE)}, CAST(nw_touches_lower AS BIGINT) AS nw_touches_lower FROM renv")
def feat33(spark, sf):
    d = block(daily(spark, sf), X.rule_envelope, X.RULE_ENVELOPE_BACK).withColumn("nw_touches_lower", F.col("nw_touches_lower").cast("int"))
    return out(d, K, RULE, ["nw_touches_lower"])
