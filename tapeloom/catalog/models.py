"""Panel, regime fits, models, policies and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import regimes as R
from ..functions import scores as S
from ..functions.frames import rstd
from ..operators import audits as E
from ..operators import features as X
from ..operators import labels as L
from ..operators import signals as G
from ..operators.aggregates import preferred_side
from ..operators.asof import asof_join
from ..operators.blocks import in_blocks
from ..operators.spread import salted_join
from ..plans import grouped as GR
from ..plans import models as M
from ..plans import panel as PN
from ..plans import policies as PO
from ..plans import regime_fit as H
from ..plans import targets as TG
from ..plans import walkforward as V
from ..sources.store import scratch, stage
from ..streaming import streams as T
from .audits import side_audit
from .bars import SQL_SUPPLIERS, supplier_dim
from .base import DAILY, INTRADAY, SQL_BARS, SQL_DAILY, SQL_TICKS, W, bars, daily, out, query, r, rnd, sel, smean, sstd, table, ticks
from .features import SHAPE_D, lag, schange, sql_envelope, sql_observations
from .labels import SQL_SPEC_LABELS, sql_barrier, specs
from .portfolio import SQL_SPLITS
from .scored import SQL_SCORED, scored
from .scores import SQL_FUSED, STATE, TR, fused, scount
from .signals import ACTIVE, SQL_MONTHLY, SQL_PANEL, monthly, panel

K = ["ticker", "ts"]

# ---- panel ------------------------------------------------------------------

PCOLS = ["ret_12", "vol_realized_12", "vol_z", "nw_env_pos", "fwd_ret_entry", "label_entry"]
SQL_PROWS = f"""{SQL_SPEC_LABELS}, {sql_envelope('daily')}, pr0 AS (SELECT *, {schange('close')} AS ret_1, {schange('close', 12)} AS ret_12, volume / nullif({smean('volume', 20, 5)}, 0) AS vol_z FROM env),
pr1 AS (SELECT *, {sstd('ret_1', 12, 4)} AS vol_realized_12 FROM pr0), prow AS (SELECT pr1.*, fwd_ret_entry, label_entry FROM pr1 JOIN spec USING (ticker, ts) WHERE ret_12 IS NOT NULL AND vol_realized_12 IS NOT NULL AND fwd_ret_entry IS NOT NULL AND volume > 0)"""


@query("bar15_panel_rows", f"WITH {SQL_PROWS} SELECT ticker, ts, {sel(PCOLS)} FROM prow")
def bar15(spark, sf):
    return out(PN.panel_rows(daily(spark, sf), specs(spark, sf), max_h=24, lay=DAILY), K, PCOLS)


SQL_PCT = lambda c: f"(rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY ts)"


@query(
    "bar16_panel",
    f"""WITH {SQL_PROWS}, {SQL_MONTHLY}, ce AS (SELECT min(m) AS m FROM (SELECT ticker, max(ts) AS m FROM prow GROUP BY 1)), cut AS (SELECT * FROM prow WHERE ts <= (SELECT m FROM ce)),
rk AS (SELECT *, {SQL_PCT('ret_12')} AS ret_12_cs_rank, {SQL_PCT('nw_env_pos')} AS nw_env_pos_cs_rank FROM cut)
SELECT rk.ticker, rk.ts, {sel(PCOLS + ['ret_12_cs_rank', 'nw_env_pos_cs_rank', 'level'])}, {r('2 * (commission_bps + slippage_bps)')} AS round_trip_bps FROM rk JOIN dim USING (ticker) ASOF LEFT JOIN monthly m ON rk.ticker = m.ticker AND rk.ts >= m.ts""",
)
def bar16(spark, sf):
    days = daily(spark, sf)
    d = PN.build_panel(days, specs(spark, sf), supplier_dim(spark, sf), monthly(spark, sf, days), ["level"], max_h=24, lay=DAILY)
    return out(d, K, PCOLS + ["ret_12_cs_rank", "nw_env_pos_cs_rank", "level", "round_trip_bps"])


# ---- regime fits ------------------------------------------------------------


def observations(spark, sf):
    d = in_blocks(bars(spark, sf), X.bar_observations, back=X.OBSERVATIONS_BACK, lay=INTRADAY)
    return d.dropna(subset=["ret_z", "vol_z", "trend_z"]).select(*K, "close", "log_ret", "ret_z", "vol_ratio", "vol_z", "trend_z", "risk_on")


BLOCKED = INTRADAY.with_(rows=4096, bucket=86400)


@query("reg05_fitted_models")
def reg05(spark, sf):
    return H.fitted_models(stage(observations(spark, sf)), lay=INTRADAY)


def regime_bars(spark, sf):
    return H.regime_table(stage(observations(spark, sf)), lay=BLOCKED)


@query("reg06_regime_table")
def reg06(spark, sf):
    return regime_bars(spark, sf)


@query("reg07_session_regimes")
def reg07(spark, sf):
    p = X.period_features(daily(spark, sf).select(*K, "close"), DAILY)
    return H.regime_table(stage(p), ("ret_z", "vol_z"), train=60, every=60, least=24, rounds=20, lay=DAILY.with_(rows=4096))


@query("reg08_blended_regimes")
def reg08(spark, sf):
    t = stage(regime_bars(spark, sf))
    n = t.select("ticker").distinct()
    return H.blended_frame(t, n.withColumn("weight", F.lit(1.0)))


# ---- models -----------------------------------------------------------------

FEATURES = ["ret_1", "ret_6", "ret_12", "vol_realized_12", "vol_z", "body_pct", "clv"]


def ml_panel(spark, sf, *wanted):
    """Features and the ``wanted`` columns of every daily bar: labels of both sides and of
    direction, excursions, forward return, columns of the instrument."""
    dim = supplier_dim(spark, sf).select("ticker", "asset_class", "round_trip_bps", "sides")
    of_dim = [c for c in dim.columns if c != "ticker" and c in wanted]
    # an instrument's rows come with its narrow bars, so wide rows are written once and not shuffled
    dim = dim.groupBy("ticker").agg(F.collect_list(F.struct(*(of_dim or [F.lit(1).alias("_one")]))).alias("_dim"))

    def fn(d, w):
        d = X.volume_and_body(X.returns(d, w), w).withColumn("vol_realized_12", rstd("ret_1", w, 12, 4))
        d = d.select(*K, "close", *FEATURES, "_dim", "_b", "_p0", "_own", "_blk", "_pos")
        return L.barrier_targets(d, 12, 120.0, 110.0)

    d = in_blocks(X.candle_shape(daily(spark, sf)).drop("_wick_bias"), fn, back=25, ahead=12, lay=DAILY, beside=dim)
    labels = [c for c in wanted if c not in of_dim]
    return stage(d.where(F.col("ret_12").isNotNull()).select(*K, *FEATURES, *labels, F.inline("_dim")).select(*K, *FEATURES, *wanted))


def split(d, at="1999-06-01"):
    t = F.lit(at).cast("timestamp_ntz")
    return V.embargo(d, t, 12, 1440), d.where(F.col("ts") >= t)


@query("ml01_entry_model")
def ml01(spark, sf):
    tr, te = split(ml_panel(spark, sf, "label_long"))
    m = M.fit_entry(tr, FEATURES, "label_long")
    return M.score_entry(m, te, known=tr).select(*K, "label_long", "proba")


def fit_trees(rows):
    return M.fit_entry(rows, FEATURES, "label_long")


@query("ml01_model_bundles")
def ml01_bundles(spark, sf):
    """A model per ticker, one per asset class and a pooled one; each row takes the first of
    these it has."""
    tr, te = split(ml_panel(spark, sf, "label_long", "asset_class"))
    by_ticker = GR.KeyModels.fit(tr, "ticker", FEATURES, "label_long")
    by_class = GR.ClassModels.fit(tr, "asset_class", fit_trees, "label_long")
    d = M.score_entry(fit_trees(tr), te, "pooled")
    d = by_class.score(d, "class", M.score_entry)
    d = GR.with_fallback(by_ticker.score(d, "own"), ["own", "class", "pooled"])
    return d.select(*K, "asset_class", "label_long", "own", "class", "pooled", "proba", "model_level")


@query("ml02_short_model")
def ml02(spark, sf):
    tr, te = split(ml_panel(spark, sf, "label_short"))
    return M.score_entry(M.fit_entry(tr, FEATURES, "label_short"), te, "proba_short").select(*K, "label_short", "proba_short")


@query("ml03_direction_model")
def ml03(spark, sf):
    tr, te = split(ml_panel(spark, sf, "label_direction"))
    return M.score_direction(M.fit_direction(tr, FEATURES), te).select(*K, "label_direction", "pred_direction", "p_flat", "p_long", "p_short")


@query("ml04_exit_regressors")
def ml04(spark, sf):
    tr, te = split(ml_panel(spark, sf, "target_tp_bps", "target_sl_bps"))
    return M.score_exits(M.fit_exits(tr, FEATURES), te).select(*K, "pred_tp_bps", "pred_sl_bps", "take_profit_bps", "stop_loss_bps")


@query("ml05_recency_refit")
def ml05(spark, sf):
    d = ml_panel(spark, sf, "label_long")
    folds = V.windows(d, train_days=730, years=2, test_months=12)
    return M.walk_forward(d, folds, FEATURES, "label_long", horizon_bars=12, bar_minutes=1440, weights=120.0).select(*K, "fold", "proba")


@query("ml06_isotonic")
def ml06(spark, sf):
    d = scored(spark, sf).where(F.col("fwd_ret").isNotNull()).withColumn("y", F.when(F.col("fwd_ret") > 0, 1.0).otherwise(0.0))
    tr, te = split(stage(d))
    return M.calibrate(tr, te, "y").select(*K, "proba", "proba_cal")


CMP = [f"{n}_{k}" for n in "ab" for k in range(3)]


@query(
    "ml07_compare_directions",
    f"""WITH {SQL_SCORED}, d AS (SELECT CASE WHEN fwd_ret > 0.005 THEN 1 WHEN fwd_ret < -0.005 THEN 2 ELSE 0 END AS y, CASE WHEN proba - 0.5 >= 0.05 AND proba > proba_short THEN 1 WHEN proba_short - 0.5 >= 0.05 AND proba_short > proba THEN 2 ELSE 0 END AS a,
  CASE WHEN p_imp >= p_mr AND p_imp >= p_st THEN 1 WHEN p_mr >= p_st THEN 0 ELSE 2 END AS b FROM scored WHERE fwd_ret IS NOT NULL)
SELECT CAST(y AS BIGINT) AS actual, """ + ", ".join(f"count(*) FILTER ({n} = {k}) AS {n}_{k}" for n in "ab" for k in range(3))
    + f", count(*) AS n, {r('(SELECT avg(CASE WHEN a = y THEN 1.0 ELSE 0.0 END) FROM d)')} AS accuracy_a, {r('(SELECT avg(CASE WHEN b = y THEN 1.0 ELSE 0.0 END) FROM d)')} AS accuracy_b, {r('(SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FROM d)')} AS agreement FROM d GROUP BY 1",
)
def ml07(spark, sf):
    d = scored(spark, sf).where(F.col("fwd_ret").isNotNull())
    f = F.col("fwd_ret")
    b = F.when((F.col("p_imp") >= F.col("p_mr")) & (F.col("p_imp") >= F.col("p_st")), 1).when(F.col("p_mr") >= F.col("p_st"), 0).otherwise(2)
    d = d.select(F.when(f > 0.005, 1).when(f < -0.005, 2).otherwise(0).alias("y"), S.direction().alias("a"), b.alias("b"))
    return out(M.compare_directions(d, "y", "a", "b"), [], ["accuracy_a", "accuracy_b", "agreement"], ["actual", *CMP, "n"])


def search_rows(spark, sf, grid):
    """Features, costs and the labels of every candidate on the daily bars."""
    dim = supplier_dim(spark, sf).select("ticker", "asset_class", "round_trip_bps", (F.col("round_trip_bps") + 2).alias("cost_floor_bps"), F.lit(45.0).alias("stop_bps"))
    lab = TG.labelled(salted_join(daily(spark, sf).select(*K, "close"), dim, ["ticker"]), grid, DAILY)
    return ml_panel(spark, sf).select(*K, *FEATURES).join(lab.select(*K, "round_trip_bps", "fwd", "ends", "entry", "direction"), K)


GRID, WAYS = TG.Grid(), TG.Grid(tuple(h for h in TG.HORIZONS if h >= TG.DIRECTION_LEAST_HORIZON))


@query("ml08_target_candidates")
def ml08(spark, sf):
    """All entry candidates of each ticker over purged folds; the best one."""
    found = TG.search_entry(search_rows(spark, sf, GRID), FEATURES, GRID, bars_per_year=252.0)
    return TG.best_entry(found).select("ticker", "horizon", "label_type", "threshold_mult", "net_edge_bps", "positive_rate", "cv", "n_folds", "score")


@query("ml08_direction_candidates")
def ml08_direction(spark, sf):
    """All direction candidates of each ticker over purged folds; the best one."""
    found = TG.search_direction(search_rows(spark, sf, WAYS), FEATURES, WAYS, bars_per_year=252.0)
    return TG.best_direction(found).select("ticker", "horizon", "label_type", "threshold_mult", "direction_accuracy", "n_folds", "flat_rate", "long_rate", "short_rate", "long_edge_bps", "short_edge_bps", "feasible", "score")


RATES = ["flat_rate", "long_rate", "short_rate", "flat_edge_bps", "long_edge_bps", "short_edge_bps"]
_hit = lambda cond: f"nullif(list_position(list_transform(p, lambda x: {cond}), true), 0)"
_cut = lambda c: f"CASE WHEN {c} <= h THEN {c} END"
SQL_RATES = f"""WITH {SQL_DAILY}, {SQL_SUPPLIERS}, fl AS (SELECT daily.*, 2 * (commission_bps + slippage_bps) + 2 AS fl FROM daily JOIN dim USING (ticker)),
pt AS (SELECT *, list_transform(coalesce(list(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 96 FOLLOWING), []), lambda x: x / close - 1) AS p FROM fl),
lv AS (SELECT ticker, ts, p, len(p) AS n, t, m, round(fl * m, 2) / 10000 AS thr FROM pt, (VALUES (0, 1.0), (1, 1.25), (2, 1.5)) v(t, m)),
ht AS (SELECT *, {_hit('x >= thr')} AS ut, {_hit('x <= -thr')} AS dt, {_hit('x >= 0.0045')} AS us, {_hit('x <= -0.0045')} AS ds FROM lv),
cd AS (SELECT *, CASE WHEN n >= h THEN p[h] END AS f, {_cut('ut')} AS u, {_cut('dt')} AS d, {_cut('us')} AS u2, {_cut('ds')} AS d2 FROM ht, (VALUES (0, 24), (1, 36), (2, 48), (3, 72), (4, 96)) g(i, h), (VALUES (0), (1)) y(kind)),
wn AS (SELECT *, i * 6 + kind * 3 + t AS cand, CASE WHEN u IS NOT NULL AND (d2 IS NULL OR u < d2) THEN u END AS lw, CASE WHEN d IS NOT NULL AND (u2 IS NULL OR d < u2) THEN d END AS sw FROM cd),
wy AS (SELECT *, CASE WHEN kind = 1 THEN CASE WHEN f IS NULL THEN NULL WHEN f >= thr AND NOT f <= -thr THEN 1 WHEN f <= -thr AND NOT f >= thr THEN 2 ELSE 0 END
  WHEN lw IS NOT NULL AND (sw IS NULL OR lw < sw) THEN 1 WHEN sw IS NOT NULL AND (lw IS NULL OR sw < lw) THEN 2 WHEN lw IS NOT NULL OR n >= h THEN 0 END AS way FROM wn),
rt AS (SELECT ticker, cand, count(*) AS n, avg(CASE WHEN way = 0 THEN 1.0 ELSE 0.0 END) AS flat_rate, avg(CASE WHEN way = 1 THEN 1.0 ELSE 0.0 END) AS long_rate, avg(CASE WHEN way = 2 THEN 1.0 ELSE 0.0 END) AS short_rate,
  coalesce(avg(f * 10000) FILTER (way = 0), 0) AS flat_edge_bps, coalesce(avg(f * 10000) FILTER (way = 1), 0) AS long_edge_bps, coalesce(avg(-f * 10000) FILTER (way = 2), 0) AS short_edge_bps FROM wy WHERE way IS NOT NULL GROUP BY 1, 2)
SELECT ticker, {sel(RATES, 4)}, CAST(cand AS BIGINT) AS cand, n FROM rt"""


@query("ml08_direction_rates", SQL_RATES)
def ml08_rates(spark, sf):
    """Class shares and edges of every direction candidate of each ticker."""
    dim = supplier_dim(spark, sf).select("ticker", (F.col("round_trip_bps") + 2).alias("cost_floor_bps"), F.lit(45.0).alias("stop_bps"))
    lab = TG.labelled(salted_join(daily(spark, sf).select(*K, "close"), dim, ["ticker"]), WAYS, DAILY)
    lab = stage(lab.select("ticker", "fwd", "direction"))
    return out(TG.direction_rates(lab, WAYS), ["ticker"], RATES, ["cand", "n"], d=4)


@query("ml09_grid_search")
def ml09(spark, sf):
    d = ml_panel(spark, sf, "label_long", "fwd_ret", "round_trip_bps").where(F.col("label_long").isNotNull())
    return M.grid_search(d, d.select(F.to_date("ts").alias("session")), FEATURES, "label_long", [{"maxDepth": d_, "stepSize": s_} for d_ in (2, 4) for s_ in (0.05, 0.1)])


@query("wf08_trailing_scores")
def wf08(spark, sf):
    """Train on the trailing sessions, score the next block, refit per block."""
    d = ml_panel(spark, sf, "label_long")
    folds = V.trailing_session_folds(d.select(F.to_date("ts").alias("session")), 900, 500)
    return M.walk_forward(d, folds, FEATURES, "label_long", horizon_bars=12, bar_minutes=1440).select(*K, "fold", "proba", "label_long")


@query("wf09_calendar_walk_forward")
def wf09(spark, sf):
    """Scores per calendar fold with a policy from the fold's own past, stitched."""
    d = ml_panel(spark, sf, "label_long", "fwd_ret", "asset_class", "round_trip_bps")
    folds = V.windows(d, train_days=730, years=2, test_months=12)
    s = stage(M.walk_forward(d, folds, FEATURES, "label_long", horizon_bars=12, bar_minutes=1440, weights=120.0))
    f = E.top_decile_stats(s, ["fold", "asset_class"], "proba", "fwd_ret", "round_trip_bps")
    prev = f.select((F.col("fold") + 1).alias("fold"), "asset_class", F.when(F.col("net_bps") > 0, 50.0).otherwise(58.0).alias("buy_threshold"))
    g = G.with_policies(s.withColumn("score", S.gain_score()), prev, ["fold", "asset_class"], {"buy_threshold": 55.0})
    return g.select(*K, "fold", "proba", "buy_threshold", (F.col("score") >= F.col("buy_threshold")).alias("enter"))


# ---- policies ---------------------------------------------------------------


# a ticker of the given tables has some 600 days: a quarter of them, not the 200 rows that bars of a few minutes allow
HELD_ROWS, TRADES = 100, 20


def gate_rows(spark, sf):
    d = scored(spark, sf)
    return d.select(*K, "round_trip_bps", F.col("proba").alias("gate_score"), F.col("fwd_ret").alias("gate_ret")).where(F.col("gate_ret").isNotNull())


def floors(spark, sf):
    return supplier_dim(spark, sf).select("ticker", (F.col("round_trip_bps") * 1.25).alias("floor_bps"))


SQL_CV = f"""{SQL_SCORED}, gr AS (SELECT ticker, ts, proba, fwd_ret, round_trip_bps FROM scored WHERE fwd_ret IS NOT NULL), {SQL_SPLITS.format(src='gr')}, vq AS (SELECT ticker, split, quantile_cont(proba, 0.9) AS cut, count(*) AS n FROM splits WHERE role = 'validate' GROUP BY 1, 2),
vn AS (SELECT s.ticker, s.split, any_value(vq.n) AS n, avg(fwd_ret) FILTER (proba >= cut) * 10000 - avg(round_trip_bps) FILTER (proba >= cut) AS net FROM splits s JOIN vq ON vq.ticker = s.ticker AND vq.split = s.split WHERE role = 'validate' GROUP BY 1, 2),
cv AS (SELECT ticker, avg(net) AS cv_net, CAST(sum(n) AS BIGINT) AS n_val FROM vn WHERE n >= 50 GROUP BY 1)"""


@query("cal01_cv_top_net", f"WITH {SQL_CV} SELECT ticker, {r('cv_net', 4)} AS cv_net, n_val, cv_net >= 2 * (commission_bps + slippage_bps) * 1.25 AS quality_ok FROM cv JOIN dim USING (ticker)")
def cal01(spark, sf):
    d = M.cv_top_net(stage(gate_rows(spark, sf)), floors(spark, sf), lay=DAILY)
    return d.select("ticker", rnd("cv_net", 4).alias("cv_net"), F.col("n_val").cast("bigint").alias("n_val"), "quality_ok")


def sql_threshold(src: str, key: str, x: str, y: str, lo, hi, name: str, points: int = 40, fallback: float = 0.85) -> str:
    """The smallest quantile whose rising fit reaches 0: running sums and minima find the crossing."""
    qs = ", ".join(str(0.05 + (0.99 - 0.05) * i / (points - 1)) for i in range(points))
    w = f"(PARTITION BY {key} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}0 AS (SELECT {key}, {x} AS x, count(*) AS k, sum({y}) AS s FROM {src} WHERE {y} IS NOT NULL GROUP BY 1, 2),
{name}1 AS (SELECT *, sum(s) OVER {w} AS c, sum(k) OVER {w} AS nc FROM {name}0), {name}2 AS (SELECT *, c - s AS e, nc - k AS nb FROM {name}1),
{name}3 AS (SELECT *, min(e) OVER {w} AS pe, min(c) OVER (PARTITION BY {key} ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sc FROM {name}2),
{name}4 AS (SELECT {key}, sum(k) AS n, min(x) FILTER (pe <= sc) AS xh FROM {name}3 GROUP BY 1), {name}5 AS (SELECT f.*, e AS e0, nb AS b0 FROM {name}4 f LEFT JOIN {name}2 t ON t.{key} = f.{key} AND t.x = f.xh),
{name}6 AS (SELECT t.{key}, min((c - e0) / (nc - b0)) FILTER (x >= xh) AS vh, max(x) FILTER (x < xh) AS xb, max(CASE WHEN x < xh THEN (e0 - e) / (b0 - nb) END) AS vb FROM {name}2 t JOIN {name}5 f ON t.{key} = f.{key} GROUP BY 1),
{name}7 AS (SELECT {key}, quantile_cont({x}, [{qs}]) AS grid, quantile_cont({x}, {fallback}) AS qf FROM {src} WHERE {y} IS NOT NULL GROUP BY 1),
{name}8 AS (SELECT g.{key}, qf, CASE WHEN n >= 50 THEN list_filter(grid, lambda g: g >= xh OR (g > xb AND vb + (vh - vb) / (xh - xb) * (g - xb) >= 0))[1] END AS hit FROM {name}7 g JOIN {name}5 f ON g.{key} = f.{key} JOIN {name}6 v ON g.{key} = v.{key}),
{name} AS (SELECT {key}, greatest({lo}, least({hi}, coalesce(hit, qf))) AS threshold, hit IS NOT NULL AS reached FROM {name}8)"""


@query("cal02_isotonic_threshold", f"WITH {SQL_SCORED}, nr AS (SELECT ticker, proba * 100 AS x0, (fwd_ret - round_trip_bps / 10000) * 10000 AS y0 FROM scored WHERE fwd_ret IS NOT NULL), {sql_threshold('nr', 'ticker', 'x0', 'y0', 30, 95, 'th')} SELECT ticker, {r('threshold', 4)} AS threshold, reached FROM th")
def cal02(spark, sf):
    d = G.net_returns(scored(spark, sf), "fwd_ret").withColumns({"x": F.col("proba") * 100, "y": F.col("net_ret") * 1e4})
    t = PO.isotonic_threshold(stage(d.select("ticker", "x", "y").where(F.col("y").isNotNull())), ["ticker"], "x", "y", lo=30, hi=95)
    return t.select("ticker", rnd("threshold", 4).alias("threshold"), "reached")


BUYS = (52.0, 55.0, 58.0)
# fixed values: bounds of both thresholds
BUY_LO, BUY_HI, EDGE_LO, EDGE_HI = 30.0, 55.0, 4.0, 12.0


def policy_rows(spark, sf):
    d = panel(spark, sf).where(F.col("fwd_ret").isNotNull())
    return G.net_returns(d, "fwd_ret", side="position_side")


def proposals(rows, keys):
    """Isotonic proposals for both thresholds of each key."""
    d = rows.withColumn("y", F.col("net_ret") * 1e4)
    buy = PO.isotonic_threshold(d, keys, "score", "y", lo=BUY_LO, hi=BUY_HI, name="buy")
    edge = PO.isotonic_threshold(d, keys, "expected_edge_bps", "y", lo=EDGE_LO, hi=EDGE_HI, name="edge")
    return stage(buy.drop("reached").join(edge.drop("reached"), keys))


def searched(rows, keys, centres, lay, min_trades):
    """The best candidate around the centres over chronological validation blocks."""
    grids = PO.centred_grids(centres, keys, buy_lo=BUY_LO, buy_hi=BUY_HI, edge_lo=EDGE_LO, edge_hi=EDGE_HI)
    blocks = V.expanding_splits(rows, 3, lay).where("role = 'validate'")
    return PO.best_of_grid(PO.grid_nets(blocks, grids, keys, "split"), keys, min_trades=min_trades)


BY_CLASS = DAILY.with_(keys=("asset_class",), order=("ts", "ticker"))
_steps = lambda c, by, lo, hi: f"list_distinct(list_transform([{', '.join(f'{c} + ({s})' for s in by)}, {lo}, {hi}], lambda v: round(greatest({lo}, least({hi}, v)), 9)))"
SQL_GRID_POLICY = f"""{SQL_PANEL}, pn AS (SELECT *, CASE WHEN position_side < 0 THEN -fwd_ret ELSE fwd_ret END - round_trip_bps / 10000 AS net FROM panel WHERE fwd_ret IS NOT NULL),
py AS (SELECT *, net * 10000 AS y FROM pn), {sql_threshold('py', 'asset_class', 'score', 'y', BUY_LO, BUY_HI, 'pb')}, {sql_threshold('py', 'asset_class', 'edge', 'y', EDGE_LO, EDGE_HI, 'pe')},
cgr AS (SELECT pb.asset_class, pb.threshold AS buy, pe.threshold AS edg, {_steps('pb.threshold', PO.BUY_STEPS, BUY_LO, BUY_HI)} AS buys, {_steps('pe.threshold', PO.EDGE_STEPS, EDGE_LO, EDGE_HI)} AS edges FROM pb JOIN pe ON pb.asset_class = pe.asset_class),
cnd AS (SELECT asset_class, buy, edg, b, unnest(edges) AS m FROM (SELECT *, unnest(buys) AS b FROM cgr)),
sp0 AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY ts, ticker) - 1 AS p, count(*) OVER (PARTITION BY asset_class) AS n FROM pn), sp1 AS (SELECT *, unnest([0, 1, 2]) AS split FROM sp0),
sp2 AS (SELECT * FROM sp1 WHERE p >= (n // 4) * (split + 1) AND p < CASE WHEN split = 2 THEN n ELSE (n // 4) * (split + 2) END),
gp AS (SELECT sp2.asset_class, split, b, m, avg(net) * 10000 AS net_bps, count(*) AS n FROM sp2 JOIN cnd ON sp2.asset_class = cnd.asset_class WHERE impulse >= 0 AND CASE WHEN position_side > 0 THEN score >= b AND edge >= m WHEN position_side < 0 THEN 100 - score >= b AND -edge >= m ELSE false END GROUP BY 1, 2, 3, 4),
gb AS (SELECT asset_class, b, m, avg(net_bps) AS net_bps, CAST(sum(n) AS BIGINT) AS n_trades FROM gp WHERE n >= 200 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY round(net_bps, 9) DESC, n_trades DESC, b DESC, m) AS rn FROM gb)"""


@query("cal03_policy_grid", f"WITH {SQL_GRID_POLICY} SELECT k.asset_class, {r('buy', 4)} AS buy_proposal, {r('edg', 4)} AS edge_proposal, {r('b', 4)} AS buy_threshold, {r('m', 4)} AS min_edge_bps, {r('net_bps', 4)} AS net_bps, n_trades FROM k JOIN cgr ON k.asset_class = cgr.asset_class WHERE rn = 1")
def cal03(spark, sf):
    rows = stage(policy_rows(spark, sf).select(*K, "asset_class", "score", "expected_edge_bps", "position_side", "impulse", "net_ret"))
    centres = proposals(rows, ["asset_class"])
    b = searched(rows, ["asset_class"], centres, BY_CLASS, 200).join(centres.select("asset_class", F.col("buy").alias("buy_proposal"), F.col("edge").alias("edge_proposal")), "asset_class")
    return out(b, ["asset_class"], ["buy_proposal", "edge_proposal", "buy_threshold", "min_edge_bps", "net_bps"], ["n_trades"], d=4)


@query("cal04_policy_table")
def cal04(spark, sf):
    """Per ticker: gate quality of the preferred side by blocks and on a holdout, thresholds
    searched around the isotonic proposals, soft size."""
    rows = stage(policy_rows(spark, sf).select(*K, "sides", "score", "expected_edge_bps", "position_side", "impulse", "net_ret", "proba", "proba_short", "fwd_ret", "round_trip_bps"))
    side = preferred_side(side_audit(spark, sf).withColumnRenamed("top_net_bps", "net_bps")).select("ticker", "side")
    gate = salted_join(E.side_rows(rows, "fwd_ret"), side, ["ticker", "side"])
    quality = PO.gate_quality(gate, floors(spark, sf), DAILY, min_rows=HELD_ROWS)
    centres = proposals(rows, ["ticker"])
    best = searched(rows, ["ticker"], centres, DAILY, TRADES)
    return PO.policy_table(supplier_dim(spark, sf), best, quality, centres)


@query("cal05_policy_folds")
def cal05(spark, sf):
    """Candidates scored on purged folds from de-overlapped trades."""
    d = policy_rows(spark, sf)
    grid = G.grid_positions(daily(spark, sf), DAILY)
    d = d.join(grid, "ts").withColumn("exit_horizon", F.lit(12))
    act = F.when(F.col("position_side") > 0, F.col("score") >= F.col("buy")).when(F.col("position_side") < 0, F.col("score") <= 100 - F.col("buy")).otherwise(False)
    c = d.withColumn("buy", F.explode(F.array(*[F.lit(b) for b in BUYS]))).where(act).select(*K, "buy", "gpos", "exit_horizon", "net_ret")
    kept = G.deoverlap(c, ["ticker", "buy"], 12).withColumn("session", F.to_date("ts"))
    folds = V.session_folds(daily(spark, sf).select(F.to_date("ts").alias("session")), 3, 1).where("role = 'test'")
    o = M.policy_objective(kept.join(folds, "session"), ["buy", "fold"])
    return o.groupBy("buy").agg(F.avg("objective").alias("objective"), F.sum("active_rebalances").alias("trades"))


@query(
    "ev14_signal_quality",
    f"""WITH {SQL_CV}, fq AS (SELECT ticker, quantile_cont(proba, 0.9) AS cut FROM gr GROUP BY 1), fn AS (SELECT gr.ticker, avg(fwd_ret) FILTER (proba >= cut) * 10000 - avg(round_trip_bps) FILTER (proba >= cut) AS net FROM gr JOIN fq ON fq.ticker = gr.ticker GROUP BY 1)
SELECT ticker, {r('cv_net', 4)} AS cv_net, {r('net', 4)} AS net_bps, {r('abs(cv_net - net)', 4)} AS gap_bps FROM cv JOIN fn USING (ticker)""",
)
def ev14(spark, sf):
    g = stage(gate_rows(spark, sf))
    cv = M.cv_top_net(g, floors(spark, sf), lay=DAILY).select("ticker", "cv_net")
    d = cv.join(E.top_decile_stats(g, ["ticker"], "gate_score", "gate_ret", "round_trip_bps"), "ticker").withColumn("gap_bps", F.abs(F.col("cv_net") - F.col("net_bps")))
    return out(d, ["ticker"], ["cv_net", "net_bps", "gap_bps"], d=4)


# ---- streams ----------------------------------------------------------------


def tick_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.lit(100) + F.col("value") / 97).alias("px"))


@query("str01_stream_bars", f"WITH {SQL_BARS} SELECT ticker, ts, {sel(['open', 'high', 'low', 'close', 'volume'])} FROM bars WHERE ts + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def str01(spark, sf):
    path = scratch(spark)
    T.drain(T.tick_bars(tick_stream(spark, sf)), path)
    d = spark.read.parquet(f"{path}/data").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return out(d, K, ["open", "high", "low", "close", "volume"])


@query("str02_stream_keep_last", f"WITH k AS (SELECT event_type AS ticker, date_trunc('minute', ts) AS ts, value, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY event_id DESC) AS rn FROM events) SELECT ticker, ts, {r('value')} AS value FROM k WHERE rn = 1")
def str02(spark, sf):
    path = scratch(spark)
    e = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")
    # the second landing replays part of the first; each run takes up what is new, the first's epochs are folded
    for part in ("event_id % 3 < 2", "event_id % 3 > 0"):
        e.where(part).write.mode("append").parquet(f"{path}/in")
        T.ingest_keep_last(spark.readStream.schema(e.schema).parquet(f"{path}/in"), path, K, ["event_id"])
        if part.endswith("< 2"):
            T.compact_keep_last(spark, path, K, ["event_id"], by_order=True)
    return out(T.read_keep_last(spark, path, K, ["event_id"], by_order=True), K, ["value"])


def landed(spark, df, parts):
    """A landing folder: the rows in ``parts`` files out of time order, then a closing mark."""
    path = scratch(spark)
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(parts, F.xxhash64("ts")).write.parquet(f"{path}/in")
    rows = spark.read.schema(df.schema).parquet(f"{path}/in")
    T.closing_mark(rows).write.parquet(f"{path}/mark")
    return path, df.schema


def streamed(spark, df, through, parts=8):
    """All rows through a stream: one run takes the files, one the closing mark."""
    path, schema = landed(spark, df, parts)
    source = spark.readStream.schema(schema).parquet(f"{path}/in")
    T.drain(through(source.unionByName(spark.readStream.schema(schema).parquet(f"{path}/mark"))), path)
    return spark.read.parquet(f"{path}/data").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("str03_stream_regime")
def str03(spark, sf):
    model = {"pi": [1 / 3] * 3, "A": [[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]], "mean": [[1.0, 0.0, 0.0], [0.0, -0.5, 0.0], [-1.0, 1.0, 0.0]], "cov": [[[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]] * 3}
    dims = ("trend_z", "vol_z", "ret_z")
    return streamed(spark, observations(spark, sf).select(*K, *dims), lambda d: T.regime_filter(d, model, dims))


@query(
    "str04_stream_transitions",
    f"""WITH {SQL_SCORED}, s AS (SELECT ticker, ts, {STATE} AS state FROM scored), p AS (SELECT *, {lag('state')} AS prev FROM s), c AS (SELECT *, {scount(0)} AS c0, {scount(1)} AS c1, {scount(2)} AS c2 FROM p)
SELECT ticker, ts, CAST(state AS BIGINT) AS state, {r('c0 / (c0 + c1 + c2)')} AS next_impulse, {r('c1 / (c0 + c1 + c2)')} AS next_mean_revert, {r('c2 / (c0 + c1 + c2)')} AS next_stress FROM c""",
)
def str04(spark, sf):
    s = F.when((F.col("p_imp") >= F.col("p_mr")) & (F.col("p_imp") >= F.col("p_st")), 0).when(F.col("p_mr") >= F.col("p_st"), 1).otherwise(2)
    d = streamed(spark, scored(spark, sf).select(*K, s.alias("state")), T.transition_counts)
    return out(d, K, ["next_impulse", "next_mean_revert", "next_stress"], ["state"])
