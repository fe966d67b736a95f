"""Joins by time and key; signals, gates, sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import instrument_dim
from ..functions import regimes as R
from ..functions import scores as S
from ..functions.frames import log_return
from ..operators import bars as B
from ..operators import signals as G
from ..operators.labels import HOLD_BUCKETS
from ..operators.asof import asof_join
from ..operators.blocks import fill_forward, in_blocks
from .audits import SQL_FOLD_NETS, fold_nets
from .bars import SQL_DIM, SQL_SUPPLIERS, event_dim, supplier_dim
from .base import DAILY, INTRADAY, SQL_BARS, SQL_DAILY, SQL_FLOW, SQL_TICKS, W, bars, daily, flow, out, query, r, rnd, sel, smean, sstd, table, ticks, with_scores, sql_scores
from .features import SQL_FACTORS, factor_frame
from .labels import fut
from ..sources.store import stage
from .scored import SQL_SCORED, scored, stored
from .scores import SQL_FSCORE, SQL_RULE, SQL_SIGNED, rule_frame, sc05

K = ["ticker", "ts"]

# hourly regime rows of each ticker, seventeen minutes past the hour
SQL_REGIME = """regime AS (SELECT ticker, date_trunc('hour', ts) + INTERVAL 17 MINUTE AS ts, avg(px) - 100 AS p, count(*) AS n FROM ticks GROUP BY 1, 2)"""


def regime_rows(spark, sf):
    t = ticks(spark, sf)
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return t.groupBy("ticker", h.alias("_h")).agg((F.avg("px") - 100).alias("p"), F.count(F.lit(1)).alias("n")).select("ticker", (F.col("_h") + F.expr("interval 17 minutes")).alias("ts"), "p", "n")


@query("jn01_asof_backward", f"WITH {SQL_BARS}, {SQL_REGIME} SELECT b.ticker, b.ts, {r('close')} AS close, {r('coalesce(p, 1.0 / 3)')} AS p, coalesce(n, 0) AS n FROM bars b ASOF LEFT JOIN regime g ON b.ticker = g.ticker AND b.ts >= g.ts")
def jn01(spark, sf):
    d = asof_join(bars(spark, sf).select(*K, "close"), regime_rows(spark, sf), ["p", "n"], lay=INTRADAY)
    return out(d.withColumns({"p": F.coalesce("p", F.lit(1 / 3)), "n": F.coalesce("n", F.lit(0))}), K, ["close", "p"], ["n"])


SQL_MONTHLY = """monthly AS (SELECT ticker, date_trunc('month', ts) AS ts, avg(close) AS level FROM daily GROUP BY 1, 2)"""


def monthly(spark, sf, days=None):
    days = daily(spark, sf) if days is None else days
    return days.groupBy("ticker", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("close").alias("level"))


@query("jn02_monthly_to_daily", f"WITH {SQL_DAILY}, {SQL_MONTHLY} SELECT d.ticker, d.ts, {r('level')} AS level FROM daily d ASOF LEFT JOIN monthly m ON d.ticker = m.ticker AND d.ts >= m.ts")
def jn02(spark, sf):
    return out(asof_join(daily(spark, sf).select(*K), monthly(spark, sf), ["level"], lay=DAILY), K, ["level"])


@query(
    "jn03_trades_to_folds",
    f"""WITH folds AS (SELECT 'all' AS g, date_trunc('quarter', o_orderdate) AS ts, row_number() OVER (ORDER BY date_trunc('quarter', o_orderdate)) - 1 AS fold FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 2)
SELECT o_orderkey, fold, {r('o_totalprice', 2)} AS price FROM orders o ASOF LEFT JOIN folds f ON 'all' = f.g AND o.o_orderdate >= f.ts""",
)
def jn03(spark, sf):
    o = table(spark, sf, "orders")
    q = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    starts = o.where(F.col("o_orderdate") >= "1996-01-01").select(q.alias("ts")).distinct()
    folds = in_blocks(starts, lambda d, w: d.withColumn("fold", F.col("_pos")), lay=DAILY.with_(keys=(), order=("ts",)))
    d = asof_join(o.select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("ts")), folds, ["fold"], by=(), lay=DAILY.with_(bucket=30 * 86400))
    return d.select("o_orderkey", F.col("fold").cast("bigint").alias("fold"), rnd("o_totalprice", 2).alias("price"))


@query("jn04_context_lookup", f"WITH {SQL_BARS}, ctx AS (SELECT ts, avg(close) > 100.5 AS risk_on, max(high) - min(low) AS spread FROM bars WHERE ticker IN ('view', 'click') GROUP BY 1) SELECT b.ticker, b.ts, coalesce(risk_on, true) AS risk_on, {r('coalesce(spread, 1)')} AS spread FROM bars b ASOF LEFT JOIN ctx c ON b.ts >= c.ts")
def jn04(spark, sf):
    b = bars(spark, sf)
    ctx = b.where(F.col("ticker").isin("view", "click")).groupBy("ts").agg((F.avg("close") > 100.5).alias("risk_on"), (F.max("high") - F.min("low")).alias("spread"))
    d = asof_join(b.select(*K), ctx, ["risk_on", "spread"], by=(), lay=INTRADAY)
    return d.select(*K, F.coalesce("risk_on", F.lit(True)).alias("risk_on"), rnd(F.coalesce("spread", F.lit(1.0))).alias("spread"))


@query("jn05_asof_forward", f"WITH {SQL_BARS}, {SQL_REGIME} SELECT g.ticker, g.ts, b.ts AS bar_ts, {r('close')} AS close FROM regime g ASOF LEFT JOIN bars b ON g.ticker = b.ticker AND g.ts <= b.ts")
def jn05(spark, sf):
    d = asof_join(regime_rows(spark, sf).select(*K), bars(spark, sf), ["close"], forward=True, lay=INTRADAY, matched_time="bar_ts")
    return out(d, [*K, "bar_ts"], ["close"])


@query("jn06_join_fill", f"WITH {SQL_BARS}, {SQL_FLOW}, j AS (SELECT b.ticker, b.ts, CASE WHEN buy_count > 0 THEN close END AS x FROM bars b LEFT JOIN flow f USING (ticker, ts)) SELECT ticker, ts, {r(f'last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS x FROM j")
def jn06(spark, sf):
    d = bars(spark, sf).join(flow(spark, sf), K, "left").select(*K, F.when(F.col("buy_count") > 0, F.col("close")).alias("x"))
    return out(fill_forward(d, ["x"], INTRADAY), K, ["x"])


@query("jn07_flow_join", f"WITH {SQL_BARS}, {SQL_FLOW} SELECT ticker, ts, {r('coalesce(buy_count, 0)')} AS buy_count, {r('coalesce(sell_count, 0)')} AS sell_count FROM bars LEFT JOIN flow USING (ticker, ts)")
def jn07(spark, sf):
    d = bars(spark, sf).join(flow(spark, sf), K, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("buy_count", "sell_count")})
    return out(d, K, ["buy_count", "sell_count"])


@query("jn08_bars_with_regime", f"WITH {SQL_DAILY}, reg AS (SELECT ticker, ts, max(volume) AS v FROM daily GROUP BY 1, 2) SELECT ticker, ts, {r('close')} AS close, {r('v')} AS v FROM daily JOIN reg USING (ticker, ts)")
def jn08(spark, sf):
    d = daily(spark, sf)
    reg = B.keep_last(d.select(*K, F.col("volume").alias("v")), K, ["v"])
    return out(d.join(reg, K), K, ["close", "v"])


SQL_TWO = """a AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"""


def two_series(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "ts")
    s = lambda st, n: o.where(F.col("o_orderstatus") == st).groupBy("ts").agg(F.avg("o_totalprice").alias(n))
    return s("F", "x"), s("O", "y")


@query("jn09_aligned_returns", f"WITH {SQL_TWO}, ra AS (SELECT ts, x / lag(x) OVER (ORDER BY ts) - 1 AS rx FROM a), rb AS (SELECT ts, y / lag(y) OVER (ORDER BY ts) - 1 AS ry FROM b) SELECT ts, {r('rx')} AS rx, {r('ry')} AS ry FROM ra JOIN rb USING (ts) WHERE rx IS NOT NULL AND ry IS NOT NULL")
def jn09(spark, sf):
    from ..plans.portfolio import aligned_returns

    a, b = two_series(spark, sf)
    return out(aligned_returns(a, "x", b, "y", DAILY), ["ts"], ["rx", "ry"])


@query("jn10_merged_regimes", f"WITH {SQL_SCORED}, s AS (SELECT *, CASE WHEN asset_class = 'crypto' THEN 0.34 ELSE 0.33 END AS w FROM scored) SELECT ts, {r('sum(w * p_imp) / sum(w)')} AS p_imp, {r('sum(w * p_mr) / sum(w)')} AS p_mr, {r('sum(w * p_st) / sum(w)')} AS p_st, {r('max(vol_ratio)')} AS vol_ratio, bool_and(risk_on) AS risk_on, string_agg(ticker, '+' ORDER BY ticker) AS sources FROM s GROUP BY 1")
def jn10(spark, sf):
    d = scored(spark, sf).withColumns({"log_ret": F.lit(0.0), "ret_z": F.lit(0.0)}).drop("asset_class")
    w = supplier_dim(spark, sf).select("ticker", F.when(F.col("asset_class") == "crypto", 0.34).otherwise(0.33).alias("weight"))
    return out(R.merged_regimes(d, w), ["ts", "risk_on", "sources"], ["p_imp", "p_mr", "p_st", "vol_ratio"])


@query("jn11_policy_override", f"WITH {SQL_DAILY}, {SQL_SUPPLIERS}, p AS (SELECT ticker, s_acctbal / 100 AS buy FROM dim WHERE sides = 'both') SELECT ticker, ts, {r('coalesce(buy, 55)', 4)} AS buy_threshold FROM daily LEFT JOIN p USING (ticker)")
def jn11(spark, sf):
    p = supplier_dim(spark, sf).where("sides = 'both'").select("ticker", (F.col("s_acctbal") / 100).alias("buy_threshold"))
    return out(G.with_policies(daily(spark, sf), p, ["ticker"], {"buy_threshold": 55.0}), K, ["buy_threshold"], d=4)


@query("jn12_semi_join", f"WITH {SQL_DAILY}, s AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY 1 HAVING count(*) >= 7) SELECT ticker, ts, {r('close')} AS close FROM daily WHERE CAST(ts AS DATE) IN (SELECT d FROM s)")
def jn12(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("session")).agg(F.count(F.lit(1)).alias("n")).where("n >= 7")
    return out(daily(spark, sf).withColumn("session", F.to_date("ts")).join(s, "session", "left_semi"), K, ["close"])


@query("jn13_anti_join", f"WITH {SQL_DAILY}, {SQL_SUPPLIERS} SELECT ticker, ts, {r('close')} AS close FROM daily WHERE ticker NOT IN (SELECT ticker FROM dim WHERE sides = 'long')")
def jn13(spark, sf):
    return out(daily(spark, sf).join(supplier_dim(spark, sf).where("sides = 'long'"), "ticker", "left_anti"), K, ["close"])


@query("jn15_time_intersection", f"WITH {SQL_TWO}, j AS (SELECT ts, x, y FROM a JOIN b USING (ts)) SELECT ts, {r('x / (SELECT arg_min(x, ts) FROM j)')} AS x, {r('y / (SELECT arg_min(y, ts) FROM j)')} AS y FROM j")
def jn15(spark, sf):
    a, b = two_series(spark, sf)
    j = a.join(b, "ts")
    f = j.agg(F.min_by("x", "ts").alias("x0"), F.min_by("y", "ts").alias("y0"))
    return out(j.select("ts", (F.col("x") / f.select("x0").scalar()).alias("x"), (F.col("y") / f.select("y0").scalar()).alias("y")), ["ts"], ["x", "y"])


# ---- signals ----------------------------------------------------------------

SQL_PANEL = f"""{SQL_SCORED}, pim AS (SELECT *, (0.30 * greatest(0, (greatest(1e-6, least(1 - 1e-6, proba)) - 0.5) / 0.5)) * (1 - p_st) * (0.5 + 0.5 * conf) AS impulse FROM scored), {SQL_SIGNED.format(src='pim')},
panel AS (SELECT *, (le - se) * 40 * (0.5 + im) AS edge, p_st <= 0.35 AND (risk_on OR p_imp >= 0.35) AND (p_imp >= 0.25 OR p_mr >= 0.35) AND conf >= 0.30 AS gate, 2 * (commission_bps + slippage_bps) + 2 AS min_edge_bps FROM signed)"""


def panel(spark, sf):
    d = G.scored_panel(scored(spark, sf))
    return d.withColumn("min_edge_bps", S.edge_floor("commission_bps", "slippage_bps"))


@query("sig01_scored_panel", f"WITH {SQL_PANEL} SELECT ticker, ts, {r('impulse')} AS impulse, {r('score')} AS score, {r('edge')} AS expected_edge_bps, CAST(position_side AS BIGINT) AS position_side FROM panel")
def sig01(spark, sf):
    return out(panel(spark, sf), K, ["impulse", "score", "expected_edge_bps"], ["position_side"])


@query("sig02_regime_gate", f"WITH {SQL_PANEL} SELECT ticker, ts, gate FROM panel")
def sig02(spark, sf):
    return panel(spark, sf).select(*K, "gate")


EDGE_OK = "(CASE WHEN position_side > 0 THEN edge >= min_edge_bps WHEN position_side < 0 THEN edge <= -min_edge_bps ELSE false END)"
SIDE_OK = "(CASE WHEN position_side > 0 THEN sides <> 'short' WHEN position_side < 0 THEN sides <> 'long' ELSE true END)"


@query("sig03_signed_edge", f"WITH {SQL_PANEL} SELECT ticker, ts, {EDGE_OK} AS ok FROM panel")
def sig03(spark, sf):
    return panel(spark, sf).select(*K, G.signed_edge_ok().alias("ok"))


@query("sig04_side_policy", f"WITH {SQL_PANEL} SELECT ticker, ts, {SIDE_OK} AS ok FROM panel")
def sig04(spark, sf):
    return panel(spark, sf).select(*K, G.side_ok().alias("ok"))


@query("sig05_tail_filter", f"WITH {SQL_SCORED} SELECT ticker, ts, p_st >= 0.42 AND (vol_ann >= 0.22 OR vol_ratio >= 1.35) AS skip FROM scored")
def sig05(spark, sf):
    return scored(spark, sf).select(*K, G.tail_skip().alias("skip"))


ACTIVE = f"({EDGE_OK} AND impulse >= 0.02 AND {SIDE_OK})"


@query("sig06_active_entries", f"WITH {SQL_PANEL} SELECT ticker, ts, {r('edge')} AS expected_edge_bps, {ACTIVE} AS active FROM panel")
def sig06(spark, sf):
    return out(G.active_entries(panel(spark, sf)), [*K, "active"], ["expected_edge_bps"])


@query(
    "sig07_edge_stats",
    f"""WITH {SQL_PANEL}, g AS (SELECT asset_class, max(abs(edge)) AS mx, quantile_cont(abs(edge), 0.65) AS q, count(*) AS n, CAST(max(min_edge_bps) AS DOUBLE) AS fl FROM panel GROUP BY 1),
c AS (SELECT *, 25.0::DOUBLE AS cal, least(greatest(CASE WHEN mx > 0 AND mx < 25 THEN least(25, greatest(fl * 0.5, CASE WHEN q > 0 THEN q ELSE mx END)) ELSE 25 END, fl * 0.5), 60) AS capped, least(fl, mx) AS lo, least(greatest(fl + 10, least(30, fl + 20)), mx) AS hi FROM g)
SELECT asset_class, n, {r('mx')} AS max_edge, {r('q')} AS q_edge, {r('capped')} AS capped_edge, {r('round_even(lo * 2, 0) / 2')} AS edge_lo, {r('CASE WHEN round_even(lo * 2, 0) >= round_even(hi * 2, 0) THEN round_even(lo * 2, 0) / 2 + 0.5 ELSE round_even(hi * 2, 0) / 2 END')} AS edge_hi FROM c""",
)
def sig07(spark, sf):
    p = stage(panel(spark, sf).select("asset_class", "expected_edge_bps", "min_edge_bps"))
    g = G.edge_stats(p, ["asset_class"]).join(p.groupBy("asset_class").agg(F.max("min_edge_bps").alias("fl")), "asset_class")
    lo, hi = G.search_bounds(F.lit(25.0), F.col("fl"))
    return out(g.withColumns({"capped_edge": G.capped_edge(F.lit(25.0), F.col("fl")), "edge_lo": lo, "edge_hi": hi}), ["asset_class"], ["max_edge", "q_edge", "capped_edge", "edge_lo", "edge_hi"], ["n"])


SQL_SF = """sf0 AS (SELECT *, greatest(0, least(100, 50 + (proba - 0.5) * 100)) AS score, 55.0 AS buy_threshold, 45.0 AS sell_threshold, CAST(45.0 + 2 * commission_bps + 1.5 AS DOUBLE) AS thr FROM scored),
sf1 AS (SELECT *, greatest(least(greatest(thr, 45), 90), 45) AS take_profit_bps, 45.0::DOUBLE AS sl FROM sf0),
sigframe AS (SELECT *, greatest(12, sl * least(CASE WHEN p_st >= 0.35 THEN 0.70 ELSE 1 END, CASE WHEN vol_ann >= 0.22 THEN 0.80 ELSE 1 END, CASE WHEN vol_ratio >= 1.35 THEN 0.85 ELSE 1 END)) AS stop_loss_bps,
  CASE WHEN score <= 0 THEN 0 WHEN score >= 55 THEN 1 WHEN score <= 45 THEN -1 ELSE 0 END AS position_side FROM sf1)"""


def signal_frame(spark, sf, days=None):
    """The scores are a stored stage: folded into one projection, the exits and sides on top
    would work out every score many times a row."""
    return G.flow_signals(stage(scored(spark, sf, days, ("threshold_bps", F.lit(12).alias("horizon")))))


@query("sig08_signal_frame", f"WITH {SQL_SCORED}, {SQL_SF} SELECT ticker, ts, {sel(['score', 'take_profit_bps', 'stop_loss_bps'])}, CAST(position_side AS BIGINT) AS position_side, CAST(12 AS BIGINT) AS exit_horizon FROM sigframe")
def sig08(spark, sf):
    return out(signal_frame(spark, sf), K, ["score", "take_profit_bps", "stop_loss_bps"], ["position_side", "exit_horizon"])


@query(
    "sig09_policy_signals",
    f"""WITH {SQL_FOLD_NETS}, p AS (SELECT ticker, fold, 50 + n % 8 AS buy FROM foldnets WHERE bottleneck <> 'cost'), x AS (SELECT s.*, coalesce(buy, 55) AS buy_threshold, greatest(0, least(100, 50 + (proba - 0.5) * 100)) AS score FROM scored s LEFT JOIN p ON p.ticker = s.ticker AND p.fold = year(s.ts))
SELECT ticker, ts, {r('buy_threshold')} AS buy_threshold, score >= buy_threshold AND (risk_on OR score >= buy_threshold + 5) AS enter FROM x""",
)
def sig09(spark, sf):
    p = fold_nets(spark, sf).where("bottleneck <> 'cost'").select("ticker", "fold", (50.0 + F.col("n") % 8).alias("buy_threshold"))
    d = G.with_policies(scored(spark, sf).withColumn("fold", F.year("ts").cast("bigint")), p, ["ticker", "fold"], {"buy_threshold": 55.0})
    d = d.withColumn("score", S.gain_score())
    return d.select(*K, rnd("buy_threshold").alias("buy_threshold"), S.may_enter("score", "risk_on", "buy_threshold").alias("enter"))


@query(
    "sig10_factor_signals",
    f"WITH {SQL_FSCORE}, s AS (SELECT *, round(raw_score, 1) AS score FROM fscore) SELECT ticker, ts, {r('score', 1)} AS score, {r('ann_vol')} AS vol_ann, risk_on FROM s WHERE ann_vol IS NOT NULL",
)
def sig10(spark, sf):
    d = S.factor_scores(factor_frame(spark, sf)).where(F.col("ann_vol").isNotNull())
    return d.select(*K, rnd("score", 1).alias("score"), rnd("ann_vol").alias("vol_ann"), "risk_on")


@query("sig11_touch_buy", f"WITH {SQL_RULE} SELECT ticker, ts, {r('score')} AS score, signal_side FROM rule WHERE nw_est IS NOT NULL")
def sig11(spark, sf):
    d = rule_frame(spark, sf).where(F.col("nw_est").isNotNull()).withColumn("_t", S.touch_buy()).select("*", "_t.*")
    return out(d, [*K, "signal_side"], ["score"])


@query(
    "sig12_exhaustion",
    f"""WITH {SQL_RULE}, e AS (SELECT *, least(1, (p_stop - 0.32) / 0.68) * least(1, abs(ret_frac) / greatest(thr, 1e-9)) AS st FROM rule WHERE vol20 IS NOT NULL AND ret_frac IS NOT NULL)
SELECT ticker, ts, {r('CASE WHEN p_stop >= 0.32 AND ret_frac <= -thr THEN least(100, 45 + 55 * st) ELSE 45 END')} AS score, CASE WHEN p_stop < 0.32 THEN 'neutral' WHEN ret_frac <= -thr THEN 'buy_dump' WHEN ret_frac >= thr THEN 'sell_rally' ELSE 'neutral' END AS signal_side FROM e""",
)
def sig12(spark, sf):
    d = rule_frame(spark, sf).where(F.col("vol20").isNotNull() & F.col("ret_frac").isNotNull())
    d = d.withColumn("_t", S.exhaustion(vol="vol20")).select("*", "_t.*")
    return out(d, [*K, "signal_side"], ["score"])


SQL_GPOS = "gp AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS gpos FROM (SELECT DISTINCT ts FROM daily))"


@query(
    "sig13_deoverlap",
    f"""WITH RECURSIVE {SQL_SCORED}, {SQL_SF}, {SQL_GPOS}, c AS MATERIALIZED (SELECT ticker, ts, gpos, 5 + CAST(floor(conf * 40) AS BIGINT) AS h FROM sigframe JOIN gp USING (ts) WHERE position_side <> 0),
k AS (SELECT ticker, min(gpos) AS gpos FROM c GROUP BY 1 UNION ALL SELECT k.ticker, (SELECT min(d.gpos) FROM c d WHERE d.ticker = k.ticker AND d.gpos >= k.gpos + x.h) FROM k JOIN c x ON x.ticker = k.ticker AND x.gpos = k.gpos WHERE k.gpos IS NOT NULL)
SELECT c.ticker, c.ts, CAST(c.gpos AS BIGINT) AS gpos, h FROM c JOIN k ON k.ticker = c.ticker AND k.gpos = c.gpos""",
)
def sig13(spark, sf):
    grid = G.grid_positions(daily(spark, sf), DAILY)
    s = signal_frame(spark, sf).where("position_side != 0").select(*K, (5 + F.floor(F.col("conf") * 40)).alias("h")).join(grid, "ts")
    return out(G.deoverlap(s, ["ticker"], 48, horizon="h"), K, ints=["gpos", "h"])


@query("sig14_net_returns", f"WITH {SQL_SCORED}, {SQL_SF} SELECT ticker, ts, {r('CASE WHEN position_side < 0 THEN -fwd_ret ELSE fwd_ret END - round_trip_bps / 10000')} AS net_ret FROM sigframe WHERE fwd_ret IS NOT NULL AND position_side <> 0")
def sig14(spark, sf):
    d = signal_frame(spark, sf).where(F.col("fwd_ret").isNotNull() & (F.col("position_side") != 0))
    return out(G.net_returns(d, "fwd_ret", side="position_side"), K, ["net_ret"])


REGIME = "CASE WHEN p_imp >= p_mr AND p_imp >= p_st THEN 'impulse' WHEN p_mr >= p_st THEN 'mean_revert' ELSE 'stress' END"


@query(
    "sig15_regime_horizons",
    f"""WITH RECURSIVE {SQL_SCORED}, {SQL_SF}, {SQL_GPOS}, c AS MATERIALIZED (SELECT ticker, ts, gpos, close, {REGIME} AS regime, unnest({list(HOLD_BUCKETS)}) AS h FROM sigframe JOIN gp USING (ts) WHERE position_side > 0),
k AS (SELECT ticker, regime, h, min(gpos) AS gpos FROM c GROUP BY 1, 2, 3 UNION ALL SELECT k.ticker, k.regime, k.h, (SELECT min(d.gpos) FROM c d WHERE d.ticker = k.ticker AND d.regime = k.regime AND d.h = k.h AND d.gpos >= k.gpos + k.h) FROM k WHERE k.gpos IS NOT NULL),
r AS (SELECT c.regime, c.h, d.close / c.close - 1 - 0.0005 AS net FROM k JOIN c ON c.ticker = k.ticker AND c.regime = k.regime AND c.h = k.h AND c.gpos = k.gpos JOIN gp g ON g.gpos = c.gpos + c.h JOIN daily d ON d.ticker = c.ticker AND d.ts = g.ts),
v AS (SELECT regime, h, count(*) AS n, avg(net) * 10000 AS ev, avg(net) / (stddev_samp(net) / sqrt(count(*))) AS t FROM r GROUP BY 1, 2), b AS (SELECT regime, coalesce(arg_max(h, ev) FILTER (n >= 20 AND ev > 0), 36) AS chosen FROM v GROUP BY 1)
SELECT regime, CAST(h AS BIGINT) AS horizon, n AS n_trades, {r('ev', 4)} AS ev_bps, {r('t')} AS ev_tstat, CAST(chosen AS BIGINT) AS chosen_horizon FROM v JOIN b USING (regime)""",
)
def sig15(spark, sf):
    days = daily(spark, sf)
    e = signal_frame(spark, sf, days).where("position_side > 0").select(*K, R.dominant().alias("regime"))
    v = G.horizon_values(e, days, HOLD_BUCKETS, 5.0, DAILY)
    p = v.join(G.pick_horizons(v, 36), "regime")
    return p.select("regime", F.col("horizon").cast("bigint").alias("horizon"), F.col("n_trades").cast("bigint").alias("n_trades"), rnd("ev_bps", 4).alias("ev_bps"), rnd("ev_tstat").alias("ev_tstat"), F.col("chosen_horizon").cast("bigint").alias("chosen_horizon"))


@query(
    "sig16_inverse_vol",
    f"""WITH RECURSIVE {SQL_BARS}, v AS (SELECT ticker, stddev_samp(close) / (1 + 3 * (ascii(ticker) % 4)) AS vol FROM bars GROUP BY 1), i AS (SELECT ticker, vol, (1 / greatest(vol, 1e-4)) / sum(1 / greatest(vol, 1e-4)) OVER () AS raw, count(*) OVER () AS n FROM v),
o AS (SELECT *, row_number() OVER (ORDER BY raw DESC, ticker) AS rn, coalesce(sum(raw) OVER (ORDER BY raw DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
s AS (SELECT *, raw * (1 - (rn - 1) * 0.25) / (1 - before) > 0.25 AS hit FROM o), c AS (SELECT *, bool_and(hit) OVER (ORDER BY rn) AS capped FROM s), t AS (SELECT *, sum(capped::INT) OVER () AS m, 1 - sum(CASE WHEN capped THEN raw ELSE 0 END) OVER () AS l FROM c)
SELECT ticker, {r('CASE WHEN capped THEN 0.25 ELSE (1 - m * 0.25) * raw / l END')} AS weight FROM t""",
)
def sig16(spark, sf):
    v = bars(spark, sf).groupBy("ticker").agg(F.stddev_samp("close").alias("s")).select("ticker", (F.col("s") / (1 + 3 * (F.ascii("ticker") % 4))).alias("vol"))
    return out(G.inverse_vol_budget(v, 0.25), ["ticker"], ["weight"])


SQL_WEIGHTS = """pk AS (SELECT *, 1.0 AS exposure_cap, 0.5 + (day(ts) % 10) / 8.0::DOUBLE AS bvr FROM sigframe WHERE position_side <> 0 AND score > 0), pk1 AS (SELECT * FROM pk WHERE bvr <= 1.5),
pk2 AS (SELECT *, position_side * (0.12 / CASE WHEN vol_ann < 0.05 THEN 0.25 ELSE vol_ann END) * (0.75 + 0.5 * score / 100) AS raw, least(1, 1 / greatest(bvr, 0.75)) AS gross FROM pk1),
pk3 AS (SELECT *, sign(raw) * least(0.20, abs(raw) / sum(abs(raw)) OVER (PARTITION BY ts) * gross) AS w FROM pk2), pk4 AS (SELECT *, sum(abs(w)) OVER (PARTITION BY ts) AS tw FROM pk3),
weights AS (SELECT ticker, ts, w * CASE WHEN tw > gross THEN gross / tw ELSE 1 END AS weight FROM pk4)"""


WEIGHED = ["position_side", "score", "vol_ann"]


def weights(spark, sf, frame=None):
    """Weights of the signal frame, whose rows are stored narrow: the totals read them four times."""
    frame = signal_frame(spark, sf) if frame is None else frame
    p = stage(frame.where("position_side <> 0 AND score > 0").select(*K, *WEIGHED))
    p = p.withColumns({"exposure_cap": F.lit(1.0), "bench_vol_ratio": 0.5 + (F.dayofmonth("ts") % 10) / 8.0})
    return G.vol_target_weights(p).select("ticker", "ts", "weight")


@query("sig17_vol_target", f"WITH {SQL_SCORED}, {SQL_SF}, {SQL_WEIGHTS} SELECT ticker, ts, {r('weight')} AS weight FROM weights")
def sig17(spark, sf):
    return out(weights(spark, sf), K, ["weight"])


@query(
    "sig18_tilt",
    f"""WITH {SQL_SCORED}, b AS (SELECT ticker, ts, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS base, proba > 0.8 AS picked FROM scored), g AS (SELECT *, count(*) FILTER (picked) OVER (PARTITION BY ts) AS k, coalesce(sum(base) FILTER (NOT picked) OVER (PARTITION BY ts), 0) AS rest FROM b),
t AS (SELECT *, CASE WHEN picked THEN base + 0.3 / k WHEN k > 0 AND rest > 1e-9 THEN greatest(0, base - 0.3 * base / rest) ELSE base END AS w FROM g) SELECT ticker, ts, {r('w / sum(w) OVER (PARTITION BY ts)')} AS weight FROM t""",
)
def sig18(spark, sf):
    d = scored(spark, sf).select(*K, (F.col("proba") > 0.8).alias("picked"))
    n = d.groupBy("ts").agg((1.0 / F.count(F.lit(1))).alias("base"))
    return out(G.tilted(d.join(n, "ts"), 0.3), K, ["weight"])


@query(
    "sig19_first_exits",
    f"""WITH {SQL_SCORED}, {SQL_SF}, p AS (SELECT *, list_transform(coalesce(list(close) OVER {fut(12)}, []), lambda x: (x / close - 1) * CASE WHEN position_side < 0 THEN -1 ELSE 1 END) AS p FROM sigframe),
h AS (SELECT *, len(p) AS n, nullif(list_position(list_transform(p, lambda x: x >= take_profit_bps / 10000), true), 0) AS tpos, nullif(list_position(list_transform(p, lambda x: x <= -stop_loss_bps / 10000), true), 0) AS spos FROM p WHERE position_side <> 0),
e AS (SELECT *, CAST(least(coalesce(tpos, n), coalesce(spos, n), n) AS BIGINT) AS b FROM h WHERE n > 0)
SELECT ticker, ts, CAST(b AS BIGINT) AS exit_bar, CASE WHEN spos = b THEN 'stop' WHEN tpos = b THEN 'take_profit' WHEN n < 12 THEN 'open' ELSE 'horizon' END AS exit_reason, {r('p[b]')} AS exit_ret FROM e""",
)
def sig19(spark, sf):
    d = G.first_exits(signal_frame(spark, sf).withColumn("entry", F.col("position_side") != 0), 12, DAILY)
    return out(d, [*K, "exit_reason"], ["exit_ret"], ["exit_bar"])


@query(
    "sig20_turnover",
    f"""WITH {SQL_SCORED}, {SQL_SF}, {SQL_WEIGHTS}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) AS idx FROM (SELECT DISTINCT ts FROM weights)), w AS (SELECT * FROM weights JOIN d USING (ts)),
c AS (SELECT coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.weight, 0) AS cur, coalesce(b.weight, 0) AS prev FROM w a FULL JOIN w b ON a.ticker = b.ticker AND a.idx = b.idx + 1)
SELECT d.ts, {r('sum(CASE WHEN prev > 0 AND abs(cur - prev) < 0.002 AND cur <> 0 THEN 0 ELSE abs(cur - prev) END)')} AS turnover, {r('sum(CASE WHEN prev > 0 AND abs(cur - prev) < 0.002 AND cur <> 0 THEN 0 ELSE abs(cur - prev) END) * 3.5 / 10000', 8)} AS cost FROM c JOIN d USING (idx) GROUP BY 1""",
)
def sig20(spark, sf):
    d = G.turnover(G.weight_changes(weights(spark, sf), DAILY), 3.5, 0.002)
    return d.select("ts", rnd("turnover").alias("turnover"), rnd("cost", 8).alias("cost"))


@query(
    "sig21_trade_metrics",
    f"""WITH {SQL_SCORED}, {SQL_SF}, {SQL_WEIGHTS}, x AS (SELECT year(s.ts) AS fold, s.ts, w.ticker IS NOT NULL AS active, coalesce(weight, 0) AS weight FROM sigframe s LEFT JOIN weights w ON w.ticker = s.ticker AND w.ts = s.ts),
p AS (SELECT fold, ts, sum(abs(weight)) AS x FROM x GROUP BY 1, 2), a AS (SELECT fold, count(*) FILTER (active) AS signal_rows FROM x GROUP BY 1), b AS (SELECT fold, count(*) FILTER (x > 0) AS active_rebalances, 100 * avg(x) AS avg_exposure_pct FROM p GROUP BY 1)
SELECT fold, signal_rows, active_rebalances, {r('avg_exposure_pct', 5)} AS avg_exposure_pct FROM a JOIN b USING (fold)""",
)
def sig21(spark, sf):
    frame = stage(signal_frame(spark, sf).select(*K, *WEIGHED))
    s = frame.select(*K).join(weights(spark, sf, frame).withColumn("_w", F.lit(True)), K, "left")
    d = s.select(F.year("ts").cast("bigint").alias("fold"), "ts", F.coalesce("_w", F.lit(False)).alias("active"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return out(G.trade_metrics(d, ["fold"]), ["fold"], ["avg_exposure_pct"], ["signal_rows", "active_rebalances"], d=5)
