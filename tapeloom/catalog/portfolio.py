"""Walk-forward windows and portfolio tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.draws import sql_draw
from ..operators import bars as B
from ..operators import signals as G
from ..operators.blocks import in_blocks
from ..plans import portfolio as P
from ..plans import walkforward as V
from .audits import SQL_FOLD_NETS, fold_nets, with_ret
from .base import DAILY, SQL_DAILY, W, daily, out, query, r, rnd, sel, table
from .features import SQL_RETS
from .scored import SQL_SCORED, scored, stored
from .signals import SQL_SF, SQL_TWO, SQL_WEIGHTS, signal_frame, two_series, weights

K = ["ticker", "ts"]

SQL_WINDOWS = """lim AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM daily), st AS (SELECT lo, hi, CAST(date_trunc('month', greatest(CAST(hi - INTERVAL 4 YEAR AS DATE), lo + 365)) AS DATE) AS s FROM lim),
s2 AS (SELECT lo, hi + 1 AS e, CASE WHEN s < lo + 365 THEN CAST(s + INTERVAL 1 MONTH AS DATE) ELSE s END AS s FROM st), w0 AS (SELECT lo, e, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e - 1 AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS test_start FROM s2),
windows AS (SELECT row_number() OVER (ORDER BY test_start) - 1 AS fold, test_start - 365 AS train_start, test_start AS train_end, test_start, least(CAST(test_start + INTERVAL 3 MONTH AS DATE), e) AS test_end FROM w0 WHERE test_start - 365 >= lo AND test_start < e)"""


def wins(spark, sf):
    return V.windows(daily(spark, sf), train_days=365, years=4, test_months=3)


@query("wf01_windows", f"WITH {SQL_DAILY}, {SQL_WINDOWS} SELECT * FROM windows")
def wf01(spark, sf):
    return wins(spark, sf)


SQL_WROWS = """wrows AS (SELECT d.*, fold, 'train' AS role FROM daily d JOIN windows w ON CAST(d.ts AS DATE) >= train_start AND CAST(d.ts AS DATE) < train_end UNION ALL
  SELECT d.*, fold, 'test' FROM daily d JOIN windows w ON CAST(d.ts AS DATE) >= test_start AND CAST(d.ts AS DATE) < test_end)"""


@query("jn14_window_rows", f"WITH {SQL_DAILY}, {SQL_WINDOWS}, {SQL_WROWS} SELECT ticker, fold, role, count(*) AS n, {r('avg(close)')} AS mean_close FROM wrows GROUP BY 1, 2, 3")
def jn14(spark, sf):
    d = V.rows_of_windows(daily(spark, sf), wins(spark, sf)).groupBy("ticker", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"))
    return out(d, ["ticker", "fold", "role"], ["mean_close"], ["n"])


@query("wf02_before_first_test", f"WITH {SQL_DAILY}, {SQL_WINDOWS} SELECT ticker, ts, {r('close')} AS close FROM daily WHERE CAST(ts AS DATE) < (SELECT min(test_start) FROM windows)")
def wf02(spark, sf):
    return out(V.before_first_test(daily(spark, sf), wins(spark, sf)), K, ["close"])


@query(
    "wf03_session_folds",
    f"""WITH {SQL_DAILY}, s AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS session FROM daily)),
f AS (SELECT *, unnest([0, 1, 2, 3]) AS fold FROM s), g AS (SELECT *, fold * (n // 4) AS a, CASE WHEN fold = 3 THEN n ELSE (fold + 1) * (n // 4) END AS b FROM f)
SELECT session, CAST(fold AS BIGINT) AS fold, CASE WHEN i >= a AND i < b THEN 'test' ELSE 'train' END AS role FROM g WHERE (i >= a AND i < b) OR i < a - 2 OR i >= b + 2""",
)
def wf03(spark, sf):
    return V.session_folds(daily(spark, sf).select(F.to_date("ts").alias("session")), 4, 2)


@query("wf04_embargo", f"WITH {SQL_DAILY} SELECT ticker, ts, {r('close')} AS close FROM daily WHERE ts < TIMESTAMP '1999-01-01' - INTERVAL 12 DAY")
def wf04(spark, sf):
    return out(V.embargo(daily(spark, sf), F.lit("1999-01-01").cast("timestamp_ntz"), 12, 1440), K, ["close"])


@query(
    "wf05_fit_calibration",
    f"""WITH {SQL_DAILY}, e AS (SELECT *, CAST(ts AS DATE) AS s FROM daily WHERE ts < TIMESTAMP '1999-01-01' - INTERVAL 12 DAY), k AS (SELECT * FROM e WHERE s NOT IN (SELECT s FROM (SELECT DISTINCT s FROM e) ORDER BY s DESC LIMIT 2)),
p AS (SELECT *, row_number() OVER (ORDER BY ts, ticker) AS rn, count(*) OVER () AS n FROM k) SELECT ticker, ts, CASE WHEN rn <= greatest(1, floor(n * (1 - 0.15::DOUBLE))) THEN 'fit' ELSE 'calibrate' END AS role FROM p""",
)
def wf05(spark, sf):
    return V.fit_calibration(daily(spark, sf), test_start=F.lit("1999-01-01").cast("timestamp_ntz"), horizon_bars=12, bar_minutes=1440, frac=0.15, purge=2).select("ticker", "ts", "role")


SQL_SPLITS = f"""spl AS (SELECT *, row_number() OVER {W} - 1 AS p, count(*) OVER (PARTITION BY ticker) AS n FROM {{src}}), spx AS (SELECT *, unnest([0, 1, 2]) AS split FROM spl),
spy AS (SELECT *, (n // 4) * (split + 1) AS lo, CASE WHEN split = 2 THEN n ELSE (n // 4) * (split + 2) END AS hi FROM spx), splits AS (SELECT *, CASE WHEN p < lo THEN 'train' ELSE 'validate' END AS role FROM spy WHERE p < hi)"""


@query("wf06_expanding_splits", f"WITH {SQL_DAILY}, {SQL_SPLITS.format(src='daily')} SELECT ticker, CAST(split AS BIGINT) AS split, role, count(*) AS n, {r('avg(close)')} AS mean_close FROM splits GROUP BY 1, 2, 3")
def wf06(spark, sf):
    d = V.expanding_splits(daily(spark, sf), 3, DAILY).groupBy("ticker", F.col("split").cast("bigint").alias("split"), "role").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"))
    return out(d, ["ticker", "split", "role"], ["mean_close"], ["n"])


@query("wf07_quantile_split", f"WITH {SQL_DAILY}, q AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.7) AS c FROM daily) SELECT ticker, ts, CASE WHEN epoch_us(ts) <= c THEN 'train' ELSE 'test' END AS role FROM daily, q")
def wf07(spark, sf):
    return V.quantile_split(daily(spark, sf), 0.7).select("ticker", "ts", "role")


# ---- portfolio --------------------------------------------------------------


def series(spark, sf, status="F"):
    a, b = two_series(spark, sf)
    return (a.select("ts", F.col("x").alias("value")) if status == "F" else b.select("ts", F.col("y").alias("value")))


@query(
    "pf01_performance",
    f"""WITH {SQL_TWO}, q AS (SELECT ts, x, x / lag(x) OVER (ORDER BY ts) - 1 - 0.04 / 252 AS e, x / max(x) OVER (ORDER BY ts) - 1 AS dd FROM a), g AS (SELECT count(e) AS n, avg(e) / stddev_samp(e) * sqrt(252) AS sharpe, arg_max(x, ts) / arg_min(x, ts) - 1 AS total_ret, min(dd) AS max_drawdown FROM q), h AS (SELECT arg_max(y, ts) / arg_min(y, ts) - 1 AS bench_ret FROM b)
SELECT n, {sel(['sharpe', 'total_ret', 'bench_ret', 'max_drawdown'])}, {r('total_ret - bench_ret')} AS excess_ret FROM g, h""",
)
def pf01(spark, sf):
    return out(P.performance(series(spark, sf), series(spark, sf, "O"), per_year=252, lay=DAILY), [], ["sharpe", "total_ret", "bench_ret", "max_drawdown", "excess_ret"], ["n"])


@query(
    "pf02_calendar",
    f"""WITH {SQL_TWO}, l AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM a), sp AS (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS ts FROM l),
f AS (SELECT sp.ts, last_value(x IGNORE NULLS) OVER (ORDER BY sp.ts ROWS UNBOUNDED PRECEDING) AS v FROM sp LEFT JOIN a USING (ts)), g AS (SELECT ts, v, v / lag(v) OVER (ORDER BY ts) - 1 AS rr FROM f)
SELECT count(rr) AS n_days, {r('avg(rr) / stddev_samp(rr) * sqrt(365.25)')} AS sharpe, {r('avg(rr) * 10000', 4)} AS bps_per_day, {r('power(arg_max(v, ts) / arg_min(v, ts), 365.25 / count(rr)) - 1')} AS cagr FROM g""",
)
def pf02(spark, sf):
    d = P.calendar_performance(series(spark, sf), DAILY)
    return d.select(F.col("n_days").cast("bigint").alias("n_days"), rnd("sharpe").alias("sharpe"), rnd("bps_per_day", 4).alias("bps_per_day"), rnd("cagr").alias("cagr"))


ALPHA = ["beta", "alpha", "r2", "correlation", "tracking_error", "information_ratio", "up_capture", "down_capture"]


@query(
    "pf03_alpha",
    f"""WITH {SQL_RETS}, m AS (SELECT ts, avg(ret) AS ry FROM rets WHERE ret IS NOT NULL GROUP BY 1), p AS (SELECT ticker, ret AS rx, ry FROM rets JOIN m USING (ts) WHERE ret IS NOT NULL),
g AS (SELECT ticker, count(*) AS n_obs, regr_slope(rx - 0.04 / 252, ry - 0.04 / 252) AS beta, regr_intercept(rx - 0.04 / 252, ry - 0.04 / 252) AS alpha, regr_r2(rx - 0.04 / 252, ry - 0.04 / 252) AS r2, corr(rx, ry) AS correlation, stddev_samp(rx - ry) * sqrt(252) AS tracking_error,
  avg(rx - ry) * 252 / (stddev_samp(rx - ry) * sqrt(252)) AS information_ratio, avg(rx) FILTER (ry > 0) / avg(ry) FILTER (ry > 0) AS up_capture, avg(rx) FILTER (ry < 0) / avg(ry) FILTER (ry < 0) AS down_capture FROM p GROUP BY 1) SELECT ticker, n_obs, {sel(ALPHA)} FROM g WHERE n_obs >= 10""",
)
def pf03(spark, sf):
    d = with_ret(daily(spark, sf)).where(F.col("ret").isNotNull())
    p = d.join(d.groupBy("ts").agg(F.avg("ret").alias("ry")), "ts").select("ticker", F.col("ret").alias("rx"), "ry")
    return out(P.alpha_stats(p, ["ticker"], per_year=252), ["ticker"], ALPHA, ["n_obs"])


TRD = ["win_rate", "avg_win_bps", "avg_loss_bps", "expectancy_bps", "profit_factor", "median_bps", "best_bps", "worst_bps"]


@query(
    "pf04_trade_analytics",
    f"""WITH {SQL_SCORED}, t AS (SELECT ticker, fwd_ret - round_trip_bps / 10000 AS x FROM scored WHERE fwd_ret IS NOT NULL), g AS (SELECT ticker, count(*) AS n_trades, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(x) FILTER (x > 0) * 10000 AS avg_win_bps, avg(x) FILTER (x < 0) * 10000 AS avg_loss_bps, avg(x) * 10000 AS expectancy_bps,
  sum(x) FILTER (x > 0) / -sum(x) FILTER (x < 0) AS profit_factor, quantile_cont(x * 10000, 0.5) AS median_bps, max(x) * 10000 AS best_bps, min(x) * 10000 AS worst_bps FROM t GROUP BY 1) SELECT ticker, n_trades, {sel(TRD, 4)} FROM g""",
)
def pf04(spark, sf):
    return out(P.trade_analytics(G.net_returns(stored(spark, sf), "fwd_ret"), ["ticker"]), ["ticker"], TRD, ["n_trades"], d=4)


RSK = ["vol_ann", "skew", "excess_kurtosis", "var_95", "cvar_95"]


@query(
    "pf05_risk_summary",
    f"""WITH {SQL_RETS}, q AS (SELECT ticker, quantile_cont(ret, 0.05) AS v FROM rets WHERE ret IS NOT NULL GROUP BY 1), m AS (SELECT ticker, avg(ret) AS mu FROM rets GROUP BY 1), z AS (SELECT r.ticker, ret, v, ret - mu AS d FROM rets r JOIN q USING (ticker) JOIN m USING (ticker) WHERE ret IS NOT NULL),
g AS (SELECT ticker, count(*) AS n, stddev_samp(ret) * sqrt(252) AS vol_ann, avg(power(d, 3)) / power(avg(d * d), 1.5) AS skew, avg(power(d, 4)) / power(avg(d * d), 2) - 3 AS excess_kurtosis, any_value(v) AS var_95, avg(ret) FILTER (ret <= v) AS cvar_95 FROM z GROUP BY 1) SELECT ticker, n, {sel(RSK)} FROM g""",
)
def pf05(spark, sf):
    return out(P.risk_summary(with_ret(daily(spark, sf)), ["ticker"], "ret", 252), ["ticker"], RSK, ["n"])


@query("pf06_fold_benchmarks", f"WITH {SQL_DAILY}, {SQL_WINDOWS}, {SQL_WROWS}, g AS (SELECT fold, ticker, arg_max(close, ts) / arg_min(close, ts) - 1 AS rr FROM wrows WHERE role = 'test' GROUP BY 1, 2) SELECT fold, {r('avg(rr)')} AS bench_ret, count(*) AS n_tickers FROM g GROUP BY 1")
def pf06(spark, sf):
    return out(V.fold_benchmarks(wins(spark, sf), daily(spark, sf)), ["fold"], ["bench_ret"], ["n_tickers"])


SQL_FOLD_ROWS = f"""{SQL_FOLD_NETS}, fr AS (SELECT fold, avg(gross_bps) / 10000 AS ret, sum(net_bps) AS net_sum, sum(CASE WHEN bottleneck = 'ok' THEN n ELSE 0 END) AS n_trades FROM foldnets GROUP BY 1),
fm AS (SELECT *, (SELECT quantile_cont(ret, 0.5) FROM fr) AS med FROM fr), fa AS (SELECT *, quantile_cont(abs(ret - med), 0.5) OVER () AS mad FROM fm), anomalies AS (SELECT *, 0.6745 * (ret - med) / mad AS robust_z, ret < 0 AND net_sum > 0 AS churn FROM fa)"""


def fold_rows(spark, sf):
    d = fold_nets(spark, sf)
    return d.groupBy("fold").agg((F.avg("gross_bps") / 1e4).alias("ret"), F.sum("net_bps").alias("net_sum"), F.sum(F.when(F.col("bottleneck") == "ok", F.col("n")).otherwise(0)).alias("n_trades"))


@query("pf07_fold_anomalies", f"WITH {SQL_FOLD_ROWS} SELECT fold, {r('ret')} AS ret, {r('robust_z', 5)} AS robust_z, churn, abs(robust_z) >= 3.5 OR n_trades = 0 OR churn AS anomaly FROM anomalies")
def pf07(spark, sf):
    d = P.fold_anomalies(fold_rows(spark, sf))
    return d.select("fold", rnd("ret").alias("ret"), rnd("robust_z", 5).alias("robust_z"), "churn", "anomaly")


@query("jn16_fold_lookup", f"WITH {SQL_FOLD_ROWS} SELECT f.ticker, f.fold, {r('net_bps', 4)} AS net_bps, {r('robust_z', 5)} AS robust_z FROM foldnets f LEFT JOIN anomalies a USING (fold)")
def jn16(spark, sf):
    d = fold_nets(spark, sf).join(P.fold_anomalies(fold_rows(spark, sf)).select("fold", "robust_z"), "fold", "left")
    return d.select("ticker", "fold", rnd("net_bps", 4).alias("net_bps"), rnd("robust_z", 5).alias("robust_z"))


@query("pf08_research_cards", f"WITH {SQL_FOLD_NETS} SELECT ticker, bool_or(bottleneck = 'ok') AS tradeable, {r('avg(net_bps)', 4)} AS mean_net, count(*) AS n_folds FROM foldnets GROUP BY 1")
def pf08(spark, sf):
    f = fold_nets(spark, sf)
    c = P.research_cards(f, f.groupBy("ticker").agg(F.bool_or(F.col("bottleneck") == "ok").alias("tradeable")))
    back = F.from_json("card", "ticker string, tradeable boolean, mean_net double, folds array<struct<fold:bigint>>")
    return c.select(back.alias("c")).select("c.ticker", "c.tradeable", rnd("c.mean_net", 4).alias("mean_net"), F.size("c.folds").cast("bigint").alias("n_folds"))


@query(
    "pf09_equity_chart",
    f"""WITH {SQL_TWO}, j AS (SELECT ts, x, y, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM a JOIN b USING (ts)), i AS (SELECT DISTINCT CAST(floor(k * (n - 1) / 199.0::DOUBLE) AS BIGINT) AS pos FROM (SELECT DISTINCT n FROM j), range(200) t(k))
SELECT ts, {r('x / (SELECT arg_min(x, ts) FROM j) * 100000', 2)} AS strategy, {r('y / (SELECT arg_min(y, ts) FROM j) * 100000', 2)} AS benchmark FROM j WHERE n <= 200 OR pos IN (SELECT pos FROM i)""",
)
def pf09(spark, sf):
    a, b = two_series(spark, sf)
    j = a.join(b, "ts")
    f = j.agg(F.min_by("x", "ts").alias("x0"), F.min_by("y", "ts").alias("y0"))
    d = j.select("ts", (F.col("x") / f.select("x0").scalar() * 100000).alias("strategy"), (F.col("y") / f.select("y0").scalar() * 100000).alias("benchmark"))
    return out(B.downsample(d, 200, DAILY.with_(keys=(), order=("ts",))), ["ts"], ["strategy", "benchmark"], d=2)


@query(
    "pf10_participation",
    f"""WITH {SQL_SCORED}, {SQL_SF}, {SQL_WEIGHTS}, d AS (SELECT w.ticker, weight, fwd_ret AS ret FROM weights w JOIN scored s USING (ticker, ts) WHERE fwd_ret IS NOT NULL AND weight <> 0)
SELECT ticker, count(*) AS periods_held, {r('avg(weight)')} AS mean_weight, {r('100 * sum(weight * ret)')} AS contribution_pct, {r('avg(CASE WHEN weight * ret > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM d GROUP BY 1""",
)
def pf10(spark, sf):
    days = daily(spark, sf)
    rets = scored(spark, sf, days).where(F.col("fwd_ret").isNotNull()).select("ticker", "ts", F.col("fwd_ret").alias("ret"))
    return out(P.participation(weights(spark, sf, signal_frame(spark, sf, days)), rets), ["ticker"], ["mean_weight", "contribution_pct", "hit_rate"], ["periods_held"])


SQL_BOOK = """bk AS (SELECT ticker, date_trunc('month', ts) AS m, max(ts) AS ts FROM daily GROUP BY 1, 2), me AS (SELECT m, max(ts) AS ts FROM bk GROUP BY 1), bw0 AS (SELECT DISTINCT d.ticker, me.ts FROM daily d JOIN me ON date_trunc('month', d.ts) = me.m WHERE d.volume > 40),
book AS (SELECT ticker, ts, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS weight FROM bw0)"""


def book(spark, sf):
    """Month-end equal weights of the names that traded in size that month."""
    d = daily(spark, sf)
    m = d.withColumn("m", F.trunc("ts", "MM"))
    ends = m.groupBy("m").agg(F.max("ts").alias("ts"))
    names = m.where("volume > 40").select("ticker", "m").distinct().join(ends, "m").select("ticker", "ts")
    return names.join(names.groupBy("ts").agg((1.0 / F.count(F.lit(1))).alias("weight")), "ts").select("ticker", "ts", "weight")


@query(
    "pf11_weighted_equity",
    f"""WITH {SQL_DAILY}, {SQL_BOOK}, dt AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx FROM (SELECT DISTINCT ts FROM book)), w AS (SELECT * FROM book JOIN dt USING (ts)),
c AS (SELECT coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.weight, 0) AS cur, coalesce(b.weight, 0) AS prev, b.ts AS t0 FROM w a FULL JOIN w b ON a.ticker = b.ticker AND a.idx = b.idx + 1),
x AS (SELECT c.*, dt.ts FROM c JOIN dt USING (idx)), p1 AS (SELECT x.*, d.close AS c1 FROM x ASOF LEFT JOIN daily d ON x.ticker = d.ticker AND x.ts >= d.ts), p0 AS (SELECT p1.*, d.close AS c0 FROM p1 ASOF LEFT JOIN daily d ON p1.ticker = d.ticker AND p1.t0 >= d.ts),
g AS (SELECT ts, coalesce(sum(prev * (c1 / c0 - 1)), 0) AS gross_ret, sum(abs(cur - prev)) AS turnover FROM p0 GROUP BY 1)
SELECT ts, {r('gross_ret')} AS gross_ret, {r('turnover')} AS turnover, {r('exp(sum(ln((1 + gross_ret) * (1 - turnover * 3.5 / 10000))) OVER (ORDER BY ts))')} AS value FROM g""",
)
def pf11(spark, sf):
    return out(P.weighted_equity(book(spark, sf), daily(spark, sf), 3.5, DAILY), ["ts"], ["gross_ret", "turnover", "value"])


SURVIVAL = ["terminal_p5", "terminal_p50", "terminal_p95", "drawdown_p5", "drawdown_p50", "drawdown_p95", "p_loss", "survival_rate", "p_ruin"]


@query(
    "pf12_bootstrap",
    f"""WITH {SQL_RETS}, m AS (SELECT ts, avg(ret) AS ret FROM rets GROUP BY 1 HAVING avg(ret) IS NOT NULL), p AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS pos, ret FROM m), n AS (SELECT count(*) AS n FROM p),
c AS (SELECT path, b FROM range(2000) x(path), range(21) y(b)), starts AS (SELECT path, b, u % (n - 12 + 1) AS s FROM {sql_draw('c', 'u', 42, ['path', 'b'])}, n),
steps AS (SELECT path, 12 * b + j AS t, s + j AS pos FROM starts, range(12) z(j) WHERE 12 * b + j < 252), w AS (SELECT path, t, product(1 + ret) OVER (PARTITION BY path ORDER BY t ROWS UNBOUNDED PRECEDING) AS w FROM steps JOIN p USING (pos)),
k AS (SELECT *, w / max(w) OVER (PARTITION BY path ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM w), e AS (SELECT path, arg_max(w, t) AS terminal, min(dd) AS max_drawdown FROM k GROUP BY 1)
SELECT count(*) AS n_paths, {', '.join(f"{r(f'quantile_cont({c}, {q / 100})')} AS {n}_p{q}" for c, n in (('terminal', 'terminal'), ('max_drawdown', 'drawdown')) for q in (5, 50, 95))},
  {r('avg(CAST(terminal < 1 AS INT))')} AS p_loss, {r('avg(CAST(terminal >= 1 AS INT))')} AS survival_rate, {r('avg(CAST(max_drawdown < -0.2 AS INT))')} AS p_ruin FROM e""",
)
def pf12(spark, sf):
    d = with_ret(daily(spark, sf)).groupBy("ts").agg(F.avg("ret").alias("ret")).where(F.col("ret").isNotNull())
    return out(P.survival(P.bootstrap(d, paths=2000, horizon=252, block=12, lay=DAILY)), [], SURVIVAL, ["n_paths"])


@query("pf13_flat_equity", f"WITH {SQL_DAILY} SELECT DISTINCT ts, 1.0::DOUBLE AS value FROM daily WHERE ts >= TIMESTAMP '1999-01-01' AND ts < TIMESTAMP '2000-01-01'")
def pf13(spark, sf):
    return P.flat_equity(daily(spark, sf), F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz"))


@query(
    "pf14_entry_discount",
    f"WITH {SQL_SCORED}, d AS (SELECT ticker, close, greatest(proba - lag(proba) OVER {W}, 0) AS dw FROM scored), g AS (SELECT ticker, sum(dw * close) / nullif(sum(dw), 0) AS entry_price, avg(close) AS mean_price FROM d GROUP BY 1) SELECT ticker, {sel(['entry_price', 'mean_price'])}, {r('100 * (1 - entry_price / mean_price)')} AS discount_pct FROM g",
)
def pf14(spark, sf):
    d = in_blocks(scored(spark, sf).select("ticker", "ts", "close", "proba"), lambda x, w: x.withColumn("dw", F.greatest(F.col("proba") - F.lag("proba").over(w), F.lit(0.0))), back=1, lay=DAILY)
    return out(P.entry_discount(d), ["ticker"], ["entry_price", "mean_price", "discount_pct"])
