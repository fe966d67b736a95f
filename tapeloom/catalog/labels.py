"""Forward labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.blocks import in_blocks
from .base import DAILY, SQL_DAILY, W, daily, out, query, r, rnd, sel
from .bars import SQL_SUPPLIERS, supplier_dim

K = ["ticker", "ts"]


def ahead(df, fn, n):
    return in_blocks(df, fn, ahead=n, lay=DAILY)


def fut(n):
    return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def fwd(h):
    return f"(lead(close, {h}) OVER {W} / close - 1)"


@query("lbl01_forward_return", f"WITH {SQL_DAILY} SELECT ticker, ts, {r(fwd(12))} AS fwd_12, {r(fwd(48))} AS fwd_48 FROM daily")
def lbl01(spark, sf):
    d = ahead(daily(spark, sf), lambda x, w: x.withColumns({f"fwd_{h}": L.forward_return(w, h) for h in (12, 48)}), 48)
    return out(d, K, ["fwd_12", "fwd_48"])


@query(
    "lbl02_forward_path",
    f"WITH {SQL_DAILY}, p AS (SELECT ticker, ts, close, list(close) OVER {fut(6)} AS f FROM daily), q AS (SELECT ticker, ts, list_transform(coalesce(f, []), lambda x: x / close - 1) AS p FROM p) "
    f"SELECT ticker, ts, len(p) AS n, {r('p[1]')} AS first_ret, {r('p[len(p)]')} AS last_ret, {r('list_sum(p)')} AS total FROM q",
)
def lbl02(spark, sf):
    d = ahead(daily(spark, sf), lambda x, w: x.withColumn("p", L.path(w, 6)), 6)
    d = d.withColumns({"n": F.size("p"), "first_ret": F.get("p", 0), "last_ret": F.get("p", F.size("p") - 1), "total": F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda a, b: a + b))})
    return out(d, K, ["first_ret", "last_ret", "total"], ["n"])


EXC = [f"{n}_{h}" for h in (20, 48) for n in ("mae", "mfe")]


def sexc(h):
    return (
        f"CASE WHEN min(close) OVER {fut(h)} IS NOT NULL THEN greatest(-(min(close) OVER {fut(h)} / close - 1), 0) END AS mae_{h}, "
        f"CASE WHEN max(close) OVER {fut(h)} IS NOT NULL THEN greatest(max(close) OVER {fut(h)} / close - 1, 0) END AS mfe_{h}"
    )


@query("lbl03_excursions", f"WITH {SQL_DAILY}, e AS (SELECT *, {sexc(20)}, {sexc(48)} FROM daily) SELECT ticker, ts, {sel(EXC)} FROM e")
def lbl03(spark, sf):
    d = ahead(daily(spark, sf), lambda x, w: x.withColumns({f"{n}_{h}": fn(w, h) for h in (20, 48) for n, fn in (("mae", L.adverse), ("mfe", L.favourable))}), 48)
    return out(d, K, EXC)


def sql_barrier(src: str, h, tp: str, sl: str, max_h: int, name: str = "bar") -> str:
    """First touches over the next ``max_h`` bars cut to ``h``; then the three labels."""
    first = lambda cond: f"list_position(list_transform(p, lambda x: {cond}), true)"
    return f"""{name}0 AS (SELECT *, list_transform(list_slice(coalesce(list(close) OVER {fut(max_h)}, []), 1, {h}), lambda x: x / close - 1) AS p FROM {src}),
{name}1 AS (SELECT *, len(p) AS n, nullif({first(f'x >= {tp}')}, 0) AS ut, nullif({first(f'x <= -({tp})')}, 0) AS dt, nullif({first(f'x >= {sl}')}, 0) AS us, nullif({first(f'x <= -({sl})')}, 0) AS ds FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN ut IS NOT NULL AND (ds IS NULL OR ut < ds) THEN ut END AS lw, CASE WHEN dt IS NOT NULL AND (us IS NULL OR dt < us) THEN dt END AS sw FROM {name}1),
{name} AS (SELECT *, CASE WHEN lw IS NOT NULL THEN 1.0 WHEN ut IS NOT NULL OR ds IS NOT NULL THEN 0.0 WHEN n > 0 AND n >= {h} THEN 0.0 END AS label_long,
  CASE WHEN sw IS NOT NULL THEN 1.0 WHEN dt IS NOT NULL OR us IS NOT NULL THEN 0.0 WHEN n > 0 AND n >= {h} THEN 0.0 END AS label_short,
  CASE WHEN lw IS NOT NULL AND (sw IS NULL OR lw < sw) THEN 1.0 WHEN sw IS NOT NULL AND (lw IS NULL OR sw < lw) THEN 2.0 WHEN lw IS NOT NULL THEN 0.0 WHEN n > 0 AND n >= {h} THEN 0.0 END AS label_direction FROM {name}2)"""


SQL_B12 = sql_barrier("daily", 12, "0.012", "0.011", 12)


def b12(spark, sf):
    return ahead(daily(spark, sf), lambda x, w: L.barrier_labels(x, w, 12, 120.0, 110.0), 12)


@query("lbl04_barrier_long", f"WITH {SQL_DAILY}, {SQL_B12} SELECT ticker, ts, {r('label_long')} AS label_long FROM bar")
def lbl04(spark, sf):
    return out(b12(spark, sf), K, ["label_long"])


@query("lbl05_barrier_short", f"WITH {SQL_DAILY}, {SQL_B12} SELECT ticker, ts, {r('label_short')} AS label_short FROM bar")
def lbl05(spark, sf):
    return out(b12(spark, sf), K, ["label_short"])


@query("lbl06_direction", f"WITH {SQL_DAILY}, {SQL_B12} SELECT ticker, ts, {r('label_direction')} AS label_direction FROM bar")
def lbl06(spark, sf):
    return out(b12(spark, sf), K, ["label_direction"])


CST = ["long_cost", "short_cost", "long_positive", "short_positive"]


@query(
    "lbl07_cost_labels",
    f"""WITH {SQL_DAILY}, f AS (SELECT *, {fwd(12)} AS f FROM daily) SELECT ticker, ts, """
    + ", ".join(f"CASE WHEN f IS NOT NULL THEN CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS {n}" for n, c in zip(CST, ("f >= 0.004", "f <= -0.004", "f > 0", "f < 0")))
    + " FROM f",
)
def lbl07(spark, sf):
    return out(ahead(daily(spark, sf), lambda x, w: L.cost_labels(x, w, 12, 40.0), 12), K, CST)


SQL_SPECS = f"""{SQL_SUPPLIERS}, specs AS (SELECT ticker, CASE WHEN s_acctbal > 5000 THEN 24 ELSE 12 END AS horizon, CASE WHEN sides = 'both' THEN 'triple_barrier' WHEN sides = 'long' THEN 'after_costs' ELSE 'positive' END AS label_type,
  45 + 2 * commission_bps + 1.5 AS threshold_bps, 45.0 AS stop_bps FROM dim)"""


def specs(spark, sf):
    d = supplier_dim(spark, sf)
    return d.select(
        "ticker", F.when(F.col("s_acctbal") > 5000, 24).otherwise(12).alias("horizon"),
        F.when(F.col("sides") == "both", "triple_barrier").when(F.col("sides") == "long", "after_costs").otherwise("positive").alias("label_type"), "threshold_bps", "stop_bps",
    )


SPEC = ["fwd_ret_entry", "label_entry", "label_entry_short", "label_direction", "target_tp_bps", "target_sl_bps"]
SQL_SPEC_LABELS = f"""{SQL_DAILY}, {SQL_SPECS}, sp AS (SELECT * FROM daily JOIN specs USING (ticker)), {sql_barrier('sp', 'horizon', '(threshold_bps / 10000)', '(stop_bps / 10000)', 24)},
sl0 AS (SELECT *, CASE WHEN n >= horizon THEN p[n] END AS fwd_ret_entry, threshold_bps / 10000 AS thr FROM bar),
sl1 AS (SELECT *, CASE label_type WHEN 'triple_barrier' THEN label_long WHEN 'positive' THEN CASE WHEN fwd_ret_entry > 0 THEN 1.0 WHEN fwd_ret_entry IS NOT NULL THEN 0.0 END ELSE CASE WHEN fwd_ret_entry >= thr THEN 1.0 WHEN fwd_ret_entry IS NOT NULL THEN 0.0 END END AS label_entry,
  CASE label_type WHEN 'triple_barrier' THEN label_short WHEN 'positive' THEN CASE WHEN fwd_ret_entry < 0 THEN 1.0 WHEN fwd_ret_entry IS NOT NULL THEN 0.0 END ELSE CASE WHEN fwd_ret_entry <= -thr THEN 1.0 WHEN fwd_ret_entry IS NOT NULL THEN 0.0 END END AS label_entry_short FROM sl0),
spec AS (SELECT ticker, ts, fwd_ret_entry, label_entry, label_entry_short, CASE WHEN label_type = 'triple_barrier' THEN label_direction WHEN label_entry IS NULL OR label_entry_short IS NULL THEN NULL WHEN label_entry = 1 AND label_entry_short <> 1 THEN 1.0
  WHEN label_entry_short = 1 AND label_entry <> 1 THEN 2.0 ELSE 0.0 END AS label_direction, CASE WHEN n > 0 THEN greatest(5, least(500, greatest(list_max(p), 0) * 10000)) END AS target_tp_bps,
  CASE WHEN n > 0 THEN greatest(5, least(500, greatest(-list_min(p), 0) * 10000)) END AS target_sl_bps FROM sl1)"""


def spec_frame(spark, sf):
    return L.spec_labels(daily(spark, sf), specs(spark, sf), 24, DAILY)


@query("lbl08_spec_labels", f"WITH {SQL_SPEC_LABELS} SELECT ticker, ts, {sel(SPEC, 5)} FROM spec")
def lbl08(spark, sf):
    return out(spec_frame(spark, sf), K, SPEC, d=5)


LEG = ["fwd_ret_12", "fwd_ret_20", "label_barrier_20"] + [f"{n}_{h}" for h in (20, 48, 96) for n in ("mae", "mfe")]
LEG_I = ["label_12_positive", "label_12_after_costs", "label_20_1pct", "label_20_after_costs"]


@query(
    "lbl09_legacy_labels",
    f"""WITH {SQL_DAILY}, {sql_barrier('daily', 20, '0.00052', '0.0045', 20)}, x AS (SELECT *, {fwd(12)} AS fwd_ret_12, {fwd(20)} AS fwd_ret_20, label_long AS label_barrier_20, {sexc(20)}, {sexc(48)}, {sexc(96)} FROM bar)
SELECT ticker, ts, {sel(LEG)}, CAST(coalesce(fwd_ret_12 > 0, false) AS BIGINT) AS label_12_positive, CAST(coalesce(fwd_ret_12 >= 0.00052, false) AS BIGINT) AS label_12_after_costs,
  CAST(coalesce(fwd_ret_20 >= 0.01, false) AS BIGINT) AS label_20_1pct, CAST(coalesce(fwd_ret_20 >= 0.00052, false) AS BIGINT) AS label_20_after_costs FROM x""",
)
def lbl09(spark, sf):
    return out(ahead(daily(spark, sf), L.legacy_labels, 96), K, LEG, LEG_I)


BUCKETS = L.HOLD_BUCKETS


@query(
    "lbl10_best_hold",
    f"WITH {SQL_DAILY}, u AS (" + " UNION ALL ".join(f"SELECT ticker, ts, {h} AS h, {fwd(h)} AS f FROM daily" for h in BUCKETS)
    + "), b AS (SELECT ticker, ts, first(h ORDER BY f DESC, h) FILTER (f IS NOT NULL) AS best_hold FROM u GROUP BY 1, 2) SELECT ticker, ts, CAST(best_hold AS BIGINT) AS best_hold FROM b",
)
def lbl10(spark, sf):
    return out(ahead(daily(spark, sf), L.best_hold, max(BUCKETS)), K, ints=["best_hold"])


BH = (5, 10, 15, 20, 21, 42, 63)
SQL_BAL = f"""{SQL_DAILY}, u AS (""" + " UNION ALL ".join(f"SELECT ticker, ts, {i} AS rk, {h} AS horizon, {fwd(h)} AS f FROM daily" for i, h in enumerate(BH)) + """),
m AS (SELECT ticker, horizon, rk, quantile_cont(f, 0.5) AS thr, count(f) AS n FROM u WHERE f IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT u.ticker, u.horizon, u.rk, any_value(thr) AS threshold, any_value(n) AS n, avg(CASE WHEN f >= thr THEN 1.0 ELSE 0.0 END) AS rate FROM u JOIN m USING (ticker, horizon) WHERE f IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(abs(rate - 0.5), 12), rk) AS rn FROM s WHERE n >= 100),
pick AS (SELECT t.ticker, coalesce(k.horizon, 5) AS horizon, coalesce(k.threshold, 0) AS threshold, coalesce(k.rate, 0.5) AS rate FROM (SELECT DISTINCT ticker FROM daily) t LEFT JOIN k ON k.ticker = t.ticker AND k.rn = 1)"""


@query(
    "lbl11_balanced",
    f"""WITH {SQL_BAL} SELECT u.ticker, ts, CAST(p.horizon AS BIGINT) AS horizon, {r('rate')} AS rate, CASE WHEN f IS NOT NULL THEN CASE WHEN f >= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS label_balanced,
  CASE WHEN f IS NOT NULL THEN CASE WHEN f <= -threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS label_balanced_short FROM u JOIN pick p ON p.ticker = u.ticker AND p.horizon = u.horizon""",
)
def lbl11(spark, sf):
    d = daily(spark, sf).select("ticker", "ts", "close")
    return out(L.balanced_labels(d, BH, DAILY), K, ["rate", "label_balanced", "label_balanced_short"], ["horizon"])


@query("lbl12_excursion_targets", f"WITH {SQL_DAILY}, e AS (SELECT *, {sexc(20)} FROM daily) SELECT ticker, ts, {r('CASE WHEN mfe_20 IS NOT NULL THEN greatest(5, least(500, mfe_20 * 10000)) END', 4)} AS target_tp_bps, {r('CASE WHEN mae_20 IS NOT NULL THEN greatest(5, least(500, mae_20 * 10000)) END', 4)} AS target_sl_bps FROM e")
def lbl12(spark, sf):
    return out(ahead(daily(spark, sf), lambda x, w: L.excursion_targets(x, w, 20), 20), K, ["target_tp_bps", "target_sl_bps"], d=4)


@query(
    "lbl13_candidate_specs",
    f"""WITH {SQL_SUPPLIERS}, f AS (SELECT ticker, CAST(2 * (commission_bps + slippage_bps) + 2 AS DOUBLE) AS fl FROM dim)
SELECT ticker, CAST(h AS BIGINT) AS horizon, t AS label_type, {r('m')} AS threshold_mult, {r('fl * m', 2)} AS threshold_bps FROM f, (VALUES (12), (24), (36), (48), (72), (96)) a(h), (VALUES ('triple_barrier'), ('after_costs')) b(t), (VALUES (1.0::DOUBLE), (1.25::DOUBLE), (1.5::DOUBLE)) c(m)""",
)
def lbl13(spark, sf):
    f = supplier_dim(spark, sf).select("ticker", (F.col("round_trip_bps") + 2).alias("cost_floor_bps"))
    d = L.candidate_specs(f)
    return d.select("ticker", F.col("horizon").cast("bigint").alias("horizon"), "label_type", rnd("threshold_mult").alias("threshold_mult"), rnd("threshold_bps", 2).alias("threshold_bps"))


@query("lbl14_relabel", f"WITH {SQL_SPEC_LABELS}, x AS (SELECT ticker, avg(label_entry) AS long_rate, avg(label_entry_short) AS short_rate, " + ", ".join(f"coalesce(avg(CASE WHEN label_direction = {v} THEN 1.0 WHEN label_direction IS NOT NULL THEN 0.0 END), 0) AS direction_{n}_rate" for v, n in ((0, "flat"), (1, "long"), (2, "short"))) + f" FROM spec GROUP BY 1) SELECT ticker, {sel(['long_rate', 'short_rate', 'direction_flat_rate', 'direction_long_rate', 'direction_short_rate'])} FROM x")
def lbl14(spark, sf):
    return out(L.label_rates(spec_frame(spark, sf)), ["ticker"], ["long_rate", "short_rate", "direction_flat_rate", "direction_long_rate", "direction_short_rate"])


@query(
    "lbl15_class_edges",
    f"WITH {SQL_SPEC_LABELS}, x AS (SELECT ticker, coalesce(avg(fwd_ret_entry * 10000) FILTER (label_direction = 0), 0) AS flat_edge_bps, coalesce(avg(fwd_ret_entry * 10000) FILTER (label_direction = 1), 0) AS long_edge_bps, coalesce(avg(-fwd_ret_entry * 10000) FILTER (label_direction = 2), 0) AS short_edge_bps, count(*) AS n FROM spec WHERE label_direction IS NOT NULL AND fwd_ret_entry IS NOT NULL GROUP BY 1) "
    f"SELECT ticker, n, {sel(['flat_edge_bps', 'long_edge_bps', 'short_edge_bps'], 4)} FROM x",
)
def lbl15(spark, sf):
    return out(L.class_edges(spec_frame(spark, sf), ["ticker"], "label_direction", "fwd_ret_entry"), ["ticker"], ["flat_edge_bps", "long_edge_bps", "short_edge_bps"], ["n"], d=4)
