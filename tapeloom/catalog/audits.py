"""Ranks, aggregates, top-k, set operations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import audits as E
from ..operators import bars as B
from ..operators import features as X
from ..operators.blocks import in_blocks
from ..operators.spread import salted_join
from .bars import SQL_FLOWED, flowed
from .base import DAILY, INTRADAY, SQL_BARS, SQL_DAILY, W, bars, daily, out, query, r, rnd, sel, table
from .features import SQL_GRID, SQL_RETS
from ..sources.store import stage
from .scored import SQL_SCORED, scored, stored

K = ["ticker", "ts"]


def with_ret(d, lay=DAILY):
    return in_blocks(d, lambda x, w: x.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1), back=1, lay=lay)


# ---- ranks ------------------------------------------------------------------


@query(
    "rank01_cross_section",
    f"""WITH {SQL_RETS} SELECT ticker, ts, {r("CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY ret ASC NULLS LAST) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2.0) / count(ret) OVER (PARTITION BY ts) END")} AS ret_rank,
  {r("(rank() OVER (PARTITION BY ts ORDER BY volume ASC NULLS LAST) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY ts)")} AS volume_rank FROM rets""",
)
def rank01(spark, sf):
    return out(E.cross_rank(with_ret(daily(spark, sf)), {"ret_rank": "ret", "volume_rank": "volume"}), K, ["ret_rank", "volume_rank"])


@query(
    "rank02_spearman",
    f"""WITH {SQL_SCORED}, d AS (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY proba) + (count(*) OVER (PARTITION BY ticker, proba) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY ticker ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY ticker, fwd_ret) - 1) / 2.0::DOUBLE AS ry FROM scored WHERE fwd_ret IS NOT NULL)
SELECT ticker, {r('CASE WHEN count(*) >= 6 THEN corr(rx, ry) ELSE 0 END')} AS ic, count(*) AS n FROM d GROUP BY 1""",
)
def rank02(spark, sf):
    return out(E.spearman(stored(spark, sf), ["ticker"], "proba", "fwd_ret"), ["ticker"], ["ic"], ["n"])


def sql_bins(src: str, key: str = "ticker", score: str = "proba", name: str = "binned", ret: str = "fwd_ret") -> str:
    qs = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    on = f"USING ({key})" if key else "ON true"
    return f"""{name}_e AS (SELECT {key + ',' if key else ''} list_sort(list_distinct(quantile_cont({score}, {qs}))) AS edges FROM {src} WHERE {score} IS NOT NULL AND {ret} IS NOT NULL {'GROUP BY ' + key if key else ''}),
{name} AS (SELECT s.*, greatest(len(list_filter(edges, lambda e: e < {score})) - 1, 0) AS bin FROM {src} s JOIN {name}_e {on} WHERE {score} IS NOT NULL AND {ret} IS NOT NULL)"""


@query("rank03_decile_bins", f"WITH {SQL_SCORED}, {sql_bins('scored')} SELECT ticker, ts, {r('proba')} AS proba, CAST(bin AS BIGINT) AS bin FROM binned")
def rank03(spark, sf):
    return out(E.quantile_bins(stored(spark, sf).where(F.col("fwd_ret").isNotNull()), ["ticker"], "proba"), K, ["proba"], ["bin"])


@query(
    "rank04_top_decile",
    f"WITH {SQL_SCORED}, q AS (SELECT ticker, quantile_cont(proba, 0.9) AS cut FROM scored GROUP BY 1) SELECT ticker, ts, {r('proba')} AS proba FROM scored JOIN q USING (ticker) WHERE proba >= cut",
)
def rank04(spark, sf):
    return out(E.top_decile_flag(stored(spark, sf), ["ticker"], "proba").where("top"), K, ["proba"])


# ---- aggregates -------------------------------------------------------------


@query(
    "agg01_group_stats",
    f"WITH {SQL_SCORED} SELECT ticker, asset_class, count(fwd_ret) AS n, {r('avg(fwd_ret)')} AS mean_ret, {r('avg(CASE WHEN fwd_ret > 0 THEN 1.0 WHEN fwd_ret IS NOT NULL THEN 0.0 END)')} AS hit_rate, {r('avg(fwd_ret) * 10000', 4)} AS mean_bps FROM scored GROUP BY 1, 2",
)
def agg01(spark, sf):
    d = A.group_stats(scored(spark, sf), ["ticker", "asset_class"], "fwd_ret")
    return d.select("ticker", "asset_class", "n", rnd("mean_ret").alias("mean_ret"), rnd("hit_rate").alias("hit_rate"), rnd("mean_bps", 4).alias("mean_bps"))


DIRECTION = "CASE WHEN fwd_ret > 0.005 THEN 1 WHEN fwd_ret < -0.005 THEN 2 WHEN fwd_ret IS NOT NULL THEN 0 END"


def direction(d):
    f = F.col("fwd_ret")
    return d.withColumn("direction", F.when(f > 0.005, 1).when(f < -0.005, 2).when(f.isNotNull(), 0))


@query(
    "agg02_class_shares",
    f"WITH {SQL_SCORED}, d AS (SELECT ticker, {DIRECTION} AS k FROM scored) SELECT ticker, count(k) AS n, "
    + ", ".join(f"{r(f'coalesce(avg(CASE WHEN k = {c} THEN 1.0 WHEN k IS NOT NULL THEN 0.0 END), 0)')} AS {n}_rate" for n, c in (("flat", 0), ("long", 1), ("short", 2)))
    + " FROM d GROUP BY 1",
)
def agg02(spark, sf):
    d = A.class_shares(direction(scored(spark, sf)), ["ticker"], "direction", {"flat": 0, "long": 1, "short": 2})
    return out(d, ["ticker"], ["flat_rate", "long_rate", "short_rate"], ["n"])


@query(
    "agg03_tick_coverage",
    f"WITH {SQL_FLOWED} SELECT ticker, count(*) FILTER (flow_source > 0) AS tick_bars, count(*) FILTER (NOT flow_source > 0) AS candle_bars, {r('100.0 * count(*) FILTER (flow_source > 0) / count(*)', 2)} AS tick_pct FROM flowed GROUP BY 1",
)
def agg03(spark, sf):
    return out(A.tick_coverage(flowed(spark, sf), ["ticker"]), ["ticker"], ["tick_pct"], ["tick_bars", "candle_bars"], d=2)


@query(
    "agg04_equal_weight_curve",
    f"WITH {SQL_BARS}, {SQL_GRID}, m AS (SELECT ts, avg(ret) AS mean_ret FROM gr GROUP BY 1) SELECT ts, {r('mean_ret')} AS mean_ret, {r('exp(sum(ln(1 + coalesce(mean_ret, 0))) OVER (ORDER BY ts))')} AS value FROM m",
)
def agg04(spark, sf):
    return out(A.equal_weight_curve(B.grid_returns(bars(spark, sf), INTRADAY), INTRADAY), ["ts"], ["mean_ret", "value"])


@query(
    "agg05_equal_weight_basket",
    f"""WITH {SQL_DAILY}, f AS (SELECT ticker, close AS c0 FROM daily WHERE ts = (SELECT min(ts) FROM daily)),
g AS (SELECT t.ts, f.ticker, d.close / c0 AS v FROM (SELECT DISTINCT ts FROM daily) t CROSS JOIN f LEFT JOIN daily d ON d.ts = t.ts AND d.ticker = f.ticker),
h AS (SELECT ts, ticker, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM g) SELECT ts, {r('avg(v)')} AS value, count(*) AS n FROM h GROUP BY 1""",
)
def agg05(spark, sf):
    d = daily(spark, sf)
    start = d.agg(F.min("ts")).scalar()
    founders = d.where(F.col("ts") == start).select("ticker", F.col("close").alias("_c0"))
    held = salted_join(d, founders, ["ticker"]).withColumn("v", F.col("close") / F.col("_c0"))
    # every time of the grid is kept, also those without a founding ticker
    other = d.select("ts").distinct()
    curve = B.filled_grid_mean(held, "v", "value", DAILY)
    from ..operators.asof import asof_join

    full = asof_join(other, curve, ["value", "n"], by=(), lay=DAILY)
    return out(full, ["ts"], ["value"], ["n"])


@query(
    "agg06_slice_return",
    f"WITH {SQL_DAILY} SELECT ticker, {r('CASE WHEN arg_min(close, ts) > 0 THEN arg_max(close, ts) / arg_min(close, ts) - 1 END')} AS ret, count(*) AS n FROM daily WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1",
)
def agg06(spark, sf):
    return out(A.slice_return(daily(spark, sf), ["ticker"], "close", F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")), ["ticker"], ["ret"], ["n"])


METRICS = ["mean_ret", "hit_rate", "mean_bps"]
SQL_FOLDS = f"{SQL_SCORED}, folds AS (SELECT year(ts) AS fold, avg(fwd_ret) AS mean_ret, avg(CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(fwd_ret) * 10000 AS mean_bps FROM scored WHERE fwd_ret IS NOT NULL GROUP BY 1)"


@query("agg07_metric_summary", f"WITH {SQL_FOLDS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {r(f'avg({m})', 5)} AS mean, {r(f'stddev_pop({m})', 5)} AS std FROM folds" for m in METRICS))
def agg07(spark, sf):
    folds = A.group_stats(scored(spark, sf).where(F.col("fwd_ret").isNotNull()), [F.year("ts").alias("fold")], "fwd_ret")
    return out(A.metric_summary(folds, METRICS), ["metric"], ["mean", "std"], d=5)


@query(
    "agg08_importance_groups",
    f"""WITH i AS (SELECT 'f' || p_partkey AS feature, p_size * 1.0 - 20 AS importance, p_brand AS g FROM part),
t AS (SELECT g AS feature_group, importance, feature, row_number() OVER (PARTITION BY g ORDER BY abs(importance) DESC, feature DESC) AS rn FROM i)
SELECT feature_group, {r('sum(importance)', 4)} AS importance_sum, {r('100.0 * sum(importance) / (SELECT sum(abs(importance)) FROM i)', 4)} AS importance_pct, count(*) AS n_features, string_agg(CASE WHEN rn <= 5 THEN feature END, ',' ORDER BY rn) AS top_features FROM t GROUP BY 1""",
)
def agg08(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("feature"), (F.col("p_size") * 1.0 - 20).alias("importance"), F.col("p_brand").alias("feature_group"))
    d = A.importance_by_group(p.select("feature", "importance"), p.select("feature", "feature_group"))
    return out(d, ["feature_group", "top_features"], ["importance_sum", "importance_pct"], ["n_features"], d=4)


def sql_verdict(src: str, key: str) -> str:
    """Decile table and verdict of one grouping."""
    return f"""SELECT {key} AS group_key, n, top_gross, top_net, top_net >= greatest(bottom, second) AS monotonic FROM (SELECT {key}, sum(n) AS n, arg_max(gross, bin) AS top_gross, arg_max(net, bin) AS top_net, arg_min(net, bin) AS bottom,
  coalesce(arg_max(net, bin) FILTER (rk = 2), arg_min(net, bin)) AS second FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY bin DESC) AS rk FROM
  (SELECT {key}, bin, count(*) AS n, avg(fwd_ret) * 10000 AS gross, avg(fwd_ret - round_trip_bps / 10000) * 10000 AS net FROM {src} GROUP BY 1, 2)) GROUP BY 1) WHERE n >= 100"""


@query(
    "agg09_audit_levels",
    f"""WITH {SQL_SCORED}, alls AS (SELECT *, 'all' AS everyone FROM scored), {sql_bins('alls', 'everyone', name='b0')}, {sql_bins('scored', 'asset_class', name='b1')}, {sql_bins('scored', 'ticker', name='b2')},
u AS (SELECT 'portfolio' AS level, * FROM ({sql_verdict('b0', 'everyone')}) UNION ALL SELECT 'asset_class', * FROM ({sql_verdict('b1', 'asset_class')}) UNION ALL SELECT 'ticker', * FROM ({sql_verdict('b2', 'ticker')}))
SELECT level, group_key, CAST(n AS BIGINT) AS n, {r('top_gross', 4)} AS top_gross_bps, {r('top_net', 4)} AS top_net_bps, CAST(monotonic AS BIGINT) AS monotonic FROM u""",
)
def agg09(spark, sf):
    d = stored(spark, sf).select("ticker", "asset_class", "proba", "fwd_ret", "round_trip_bps")
    # each row goes to its three groups; the bins of every group are found in one pass
    g = d.select(
        F.inline(F.array(
            F.struct(F.lit("portfolio").alias("level"), F.lit("all").alias("group_key")),
            F.struct(F.lit("asset_class").alias("level"), F.col("asset_class").alias("group_key")),
            F.struct(F.lit("ticker").alias("level"), F.col("ticker").alias("group_key")),
        )), "proba", "fwd_ret", "round_trip_bps",
    )
    k = ["level", "group_key"]
    v = E.decile_verdict(E.decile_table(g, k, "proba", "fwd_ret", "round_trip_bps"), k)
    return out(v.withColumn("monotonic", F.col("monotonic").cast("int")), k, ["top_gross_bps", "top_net_bps"], ["n", "monotonic"], d=4)


FIVE = ["lowest", "p25", "p50", "p75", "highest", "mean"]
SQL_FIVE = """five AS (SELECT o_orderpriority AS param, count(*) AS n, min(v) AS lowest, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS highest, avg(v) AS mean
  FROM (SELECT *, o_totalprice / 97 AS v FROM orders) GROUP BY 1)"""


def params(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("param"), (F.col("o_totalprice") / 97).alias("v"))


@query("agg10_five_numbers", f"WITH {SQL_FIVE} SELECT param, n, {sel(FIVE, 4)} FROM five")
def agg10(spark, sf):
    return out(A.five_numbers(params(spark, sf), ["param"], "v"), ["param"], FIVE, ["n"], d=4)


@query(
    "agg11_narrowed_range",
    f"WITH {SQL_FIVE} SELECT param, {r('floor((p25 - greatest(p75 - p25, 1e-9) * 0.15) / 25) * 25', 4)} AS low, {r('ceil((p75 + greatest(p75 - p25, 1e-9) * 0.15) / 25) * 25', 4)} AS high FROM five",
)
def agg11(spark, sf):
    return out(A.narrowed_range(A.five_numbers(params(spark, sf), ["param"], "v"), 25.0), ["param"], ["low", "high"], d=4)


@query(
    "agg12_trial_summary",
    f"""WITH t AS (SELECT l_suppkey % 12 AS fold, unnest([l_discount, l_tax]) AS v, unnest(['discount', 'tax']) AS param FROM lineitem)
SELECT param, fold, count(*) AS n, {r('min(v)')} AS lowest, {r('quantile_cont(v, 0.25)')} AS p25, {r('quantile_cont(v, 0.5)')} AS p50, {r('quantile_cont(v, 0.75)')} AS p75, {r('max(v)')} AS highest, {r('avg(v)')} AS mean FROM t GROUP BY 1, 2""",
)
def agg12(spark, sf):
    li = table(spark, sf, "lineitem")
    trial = lambda n, c: F.struct(F.lit(n).alias("param"), F.col(c).alias("v"))
    nested = li.select((F.col("l_suppkey") % 12).alias("fold"), F.array(trial("discount", "l_discount"), trial("tax", "l_tax")).alias("trials"))
    flat = nested.select("fold", F.explode_outer("trials").alias("t")).select("fold", "t.param", "t.v")
    return out(A.five_numbers(flat, ["param", "fold"], "v"), ["param", "fold"], FIVE, ["n"])


QUAL = ["ret", "volume", "flat_col"]


@query(
    "agg13_column_quality",
    f"WITH {SQL_RETS}, x AS (SELECT ret, volume, 0.0::DOUBLE AS flat_col FROM rets) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 4)} AS null_pct, {r(f'100.0 * avg(CASE WHEN coalesce({c}, 0) = 0 THEN 1.0 ELSE 0.0 END)', 4)} AS zero_pct, "
        f"count(DISTINCT {c}) AS n_unique, {r(f'coalesce(stddev_samp({c}), 0)')} AS std, CAST(count(DISTINCT {c}) <= 1 OR stddev_samp({c}) < 1e-12 AS BIGINT) AS constant FROM x"
        for c in QUAL
    ),
)
def agg13(spark, sf):
    d = A.column_quality(with_ret(daily(spark, sf)).withColumn("flat_col", F.lit(0.0)), QUAL)
    return d.select("feature", rnd("null_pct", 4).alias("null_pct"), rnd("zero_pct", 4).alias("zero_pct"), F.col("n_unique").cast("bigint").alias("n_unique"), rnd("std").alias("std"), F.col("constant").cast("bigint").alias("constant"))


SQL_FOLD_NETS = f"""{SQL_SCORED}, fn AS (SELECT ticker, year(ts) AS fold, count(*) AS n, avg(fwd_ret) * 10000 AS gross_bps, avg(fwd_ret - round_trip_bps / 10000) * 10000 AS net_bps, max(round_trip_bps) AS round_trip_bps FROM scored WHERE fwd_ret IS NOT NULL GROUP BY 1, 2),
foldnets AS (SELECT *, CASE WHEN net_bps >= round_trip_bps * 1.25 THEN 'ok' WHEN gross_bps < round_trip_bps THEN 'cost' ELSE 'below_gate' END AS bottleneck FROM fn)"""


def fold_nets(spark, sf):
    d = scored(spark, sf).where(F.col("fwd_ret").isNotNull()).groupBy("ticker", F.year("ts").cast("bigint").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("fwd_ret") * 1e4).alias("gross_bps"),
        (F.avg(F.col("fwd_ret") - F.col("round_trip_bps") / 1e4) * 1e4).alias("net_bps"), F.max("round_trip_bps").alias("round_trip_bps"),
    )
    c = F.when(F.col("net_bps") >= F.col("round_trip_bps") * 1.25, "ok").when(F.col("gross_bps") < F.col("round_trip_bps"), "cost").otherwise("below_gate")
    return stage(d.withColumn("bottleneck", c))


@query(
    "agg14_fold_statistics",
    f"""WITH {SQL_FOLD_NETS} SELECT ticker, count(*) AS folds, {r('avg(gross_bps)', 4)} AS gross_mean, {r('quantile_cont(gross_bps, 0.5)', 4)} AS gross_median, {r('min(gross_bps)', 4)} AS gross_min, {r('max(gross_bps)', 4)} AS gross_max,
  count(*) FILTER (gross_bps > 0) AS positive_folds, count(*) FILTER (bottleneck = 'ok') AS ok_folds, count(*) FILTER (bottleneck = 'cost') AS cost_folds FROM foldnets GROUP BY 1""",
)
def agg14(spark, sf):
    d = fold_nets(spark, sf)
    g = d.groupBy("ticker").agg(  # a ticker has one row per fold here
        F.count(F.lit(1)).alias("folds"), F.avg("gross_bps").alias("gross_mean"), F.percentile("gross_bps", F.lit(0.5)).alias("gross_median"),
        F.min("gross_bps").alias("gross_min"), F.max("gross_bps").alias("gross_max"), F.count_if(F.col("gross_bps") > 0).alias("positive_folds"),
        F.count_if(F.col("bottleneck") == "ok").alias("ok_folds"), F.count_if(F.col("bottleneck") == "cost").alias("cost_folds"),
    )
    return out(g, ["ticker"], ["gross_mean", "gross_median", "gross_min", "gross_max"], ["folds", "positive_folds", "ok_folds", "cost_folds"], d=4)


@query(
    "agg15_signal_summary",
    f"WITH {SQL_SCORED} SELECT ticker, count(*) AS n_signals, {r('avg(proba)')} AS mean_score, {r('100 * avg(CASE WHEN proba >= 0.6 THEN 1.0 ELSE 0.0 END)', 4)} AS pct_enter, {r('100 * avg(CASE WHEN risk_on THEN 1.0 ELSE 0.0 END)', 4)} AS pct_risk_on FROM scored GROUP BY 1",
)
def agg15(spark, sf):
    d = scored(spark, sf).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg("proba").alias("mean_score"), (100 * F.avg((F.col("proba") >= 0.6).cast("double"))).alias("pct_enter"), (100 * F.avg(F.col("risk_on").cast("double"))).alias("pct_risk_on")
    )
    return d.select("ticker", "n_signals", rnd("mean_score").alias("mean_score"), rnd("pct_enter", 4).alias("pct_enter"), rnd("pct_risk_on", 4).alias("pct_risk_on"))


@query(
    "agg16_month_table",
    f"""WITH {SQL_DAILY}, m AS (SELECT ticker, date_trunc('month', ts) AS month, arg_max(close, ts) AS last FROM daily GROUP BY 1, 2), x AS (SELECT *, last / lag(last) OVER (PARTITION BY ticker ORDER BY month) - 1 AS ret FROM m)
SELECT ticker, year(month) AS year, """ + ", ".join(f"{r(f'max(CASE WHEN month(month) = {i} THEN ret END)')} AS m{i:02d}" for i in range(1, 13)) + " FROM x GROUP BY 1, 2",
)
def agg16(spark, sf):
    d = A.year_by_month(A.monthly_returns(daily(spark, sf), ["ticker"], "close"), ["ticker"])
    return out(d, ["ticker", "year"], [f"m{i:02d}" for i in range(1, 13)])


@query(
    "agg17_histogram",
    f"WITH {SQL_RETS}, l AS (SELECT min(ret) AS lo, max(ret) AS hi FROM rets) SELECT CAST(coalesce(least(floor((ret - lo) / nullif((hi - lo) / 40, 0)), 39), 0) AS BIGINT) AS bin, count(*) AS n FROM rets, l WHERE ret IS NOT NULL GROUP BY 1",
)
def agg17(spark, sf):
    return A.histogram(with_ret(daily(spark, sf)), "ret", 40)


@query("agg18_policy_median", f"WITH {SQL_FOLD_NETS} SELECT ticker, {r('quantile_cont(net_bps, 0.5)', 4)} AS median_net, {r('max(gross_bps)', 4)} AS max_gross FROM foldnets GROUP BY 1")
def agg18(spark, sf):
    from ..operators.spread import medians

    d = fold_nets(spark, sf)
    m = medians(d, ["ticker"], "net_bps", "median_net").join(d.groupBy("ticker").agg(F.max("gross_bps").alias("max_gross")), "ticker")
    return out(m, ["ticker"], ["median_net", "max_gross"], d=4)


# ---- top-k and sets ---------------------------------------------------------


@query(
    "top01_latest_per_key",
    f"""WITH {SQL_SCORED}, s AS (SELECT ticker, ts, close, CASE WHEN proba < 0.5 THEN 0.0 ELSE proba END AS score FROM scored WHERE ts <= TIMESTAMP '1999-06-30')
SELECT ticker, coalesce(max(ts) FILTER (score > 0), max(ts)) AS ts, {r('coalesce(arg_max(close, ts) FILTER (score > 0), arg_max(close, ts))')} AS close, {r('coalesce(arg_max(score, ts) FILTER (score > 0), arg_max(score, ts))')} AS score FROM s GROUP BY 1""",
)
def top01(spark, sf):
    s = scored(spark, sf).select("ticker", "ts", "close", F.when(F.col("proba") < 0.5, 0.0).otherwise(F.col("proba")).alias("score"))
    return out(A.latest_per_key(s, ["ticker"], F.lit("1999-06-30").cast("timestamp_ntz")), K, ["close", "score"])


@query("top02_period_ends", f"WITH {SQL_DAILY} SELECT ticker, date_trunc('month', ts) AS period, max(ts) AS last_ts FROM daily GROUP BY 1, 2")
def top02(spark, sf):
    d = A.period_ends(daily(spark, sf), "month", ["ticker"])
    return d.select("ticker", F.col("period").cast("timestamp_ntz").alias("period"), "last_ts")


@query(
    "top03_top_fraction",
    f"""WITH {SQL_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY proba DESC, ts) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM scored)
SELECT ticker, ts, {r('proba')} AS proba FROM k WHERE rn <= greatest(5, ceil(n * 0.25))""",
)
def top03(spark, sf):
    return out(A.top_fraction(stored(spark, sf), ["ticker"], "proba", ["ts"]), K, ["proba"])


@query(
    "top04_best_candidate",
    f"""WITH {SQL_FOLD_NETS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY (CASE WHEN net_bps > 0 AND n >= 30 THEN 2 WHEN net_bps > 0 THEN 1 ELSE 0 END) DESC, gross_bps DESC, fold DESC) AS rn FROM foldnets)
SELECT ticker, fold, {r('net_bps', 4)} AS net_bps FROM k WHERE rn = 1""",
)
def top04(spark, sf):
    d = fold_nets(spark, sf)
    tier = F.when((F.col("net_bps") > 0) & (F.col("n") >= 30), 2).when(F.col("net_bps") > 0, 1).otherwise(0)
    return out(A.best_candidate(d, ["ticker"], tier, "gross_bps", "fold"), ["ticker", "fold"], ["net_bps"], d=4)


SQL_SIDES = f"""{SQL_SCORED}, sr AS (SELECT ticker, 'long' AS side, proba AS gate_score, fwd_ret AS gate_ret, round_trip_bps FROM scored WHERE sides IN ('long', 'both') UNION ALL
  SELECT ticker, 'short', proba_short, -fwd_ret, round_trip_bps FROM scored WHERE sides IN ('short', 'both')),
siderows AS (SELECT *, ticker || ':' || side AS tside FROM sr WHERE gate_ret IS NOT NULL), {sql_bins('siderows', 'tside', 'gate_score', 'sb', 'gate_ret')},
sdec AS (SELECT ticker, side, tside, bin, count(*) AS n, avg(gate_ret) * 10000 AS gross, avg(gate_ret - round_trip_bps / 10000) * 10000 AS net, max(round_trip_bps) AS rt FROM sb GROUP BY 1, 2, 3, 4),
sver AS (SELECT ticker, side, sum(n) AS n, arg_max(gross, bin) AS top_gross, arg_max(net, bin) AS top_net, arg_min(net, bin) AS bottom, coalesce(arg_max(net, bin) FILTER (rk = 2), arg_min(net, bin)) AS second, max(rt) * 1.25 AS floor_bps
  FROM (SELECT *, row_number() OVER (PARTITION BY tside ORDER BY bin DESC) AS rk FROM sdec) GROUP BY 1, 2),
sideaudit AS (SELECT *, top_net >= greatest(bottom, second) AS monotonic, top_net > floor_bps AND top_net >= greatest(bottom, second) AS tradeable FROM sver WHERE n >= 100)"""


def side_audit(spark, sf):
    d = E.side_rows(stored(spark, sf), "fwd_ret")
    k = ["ticker", "side"]
    v = E.decile_verdict(E.decile_table(d, k, "gate_score", "gate_ret", "round_trip_bps"), k)
    from .bars import supplier_dim

    floors = supplier_dim(spark, sf).select("ticker", (F.col("round_trip_bps") * 1.25).alias("_floor"))
    return stage(E.with_tradeable(v.join(floors, "ticker"), F.col("_floor")).drop("_floor"))


@query(
    "top05_preferred_side",
    f"""WITH {SQL_SIDES}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CAST(tradeable AS INT) DESC, top_net DESC, side DESC) AS rn FROM sideaudit)
SELECT ticker, side, {r('top_net', 4)} AS net_bps, CAST(tradeable AS BIGINT) AS cleared FROM k WHERE rn = 1""",
)
def top05(spark, sf):
    d = side_audit(spark, sf).withColumnRenamed("top_net_bps", "net_bps")
    return out(A.preferred_side(d), ["ticker", "side"], ["net_bps"], ["cleared"], d=4)


@query("top06_tail_rows", f"WITH {SQL_DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM daily) SELECT ticker, ts, {r('close')} AS close FROM k WHERE rn <= 50")
def top06(spark, sf):
    return out(A.tail_rows(daily(spark, sf), 50, DAILY), K, ["close"])


@query(
    "top07_first_windows",
    f"WITH {SQL_FOLDS}, k AS (SELECT *, row_number() OVER (ORDER BY fold) AS rn FROM folds) SELECT rn - 1 AS fold, {r('mean_bps', 4)} AS mean_bps FROM k WHERE rn <= 3",
)
def top07(spark, sf):
    folds = A.group_stats(scored(spark, sf).where(F.col("fwd_ret").isNotNull()), [F.year("ts").alias("fold")], "fwd_ret")
    return out(A.first_windows(folds, 3), ["fold"], ["mean_bps"], d=4)


@query("set01_union_sorted", f"WITH {SQL_BARS}, {SQL_DAILY} SELECT ticker, ts, {r('close')} AS close FROM bars UNION ALL SELECT ticker, ts, {r('close')} AS close FROM daily")
def set01(spark, sf):
    from ..sources.store import union_all

    return out(union_all([bars(spark, sf).drop("volume"), daily(spark, sf)]).orderBy("ts", "ticker"), K, ["close"])


@query(
    "set02_keep_last",
    f"WITH k AS (SELECT 'U' || user_id AS ticker, date_trunc('hour', ts) AS ts, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) AS rn FROM events) SELECT ticker, ts, {r('value')} AS value FROM k WHERE rn = 1",
)
def set02(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")
    return out(B.keep_last(e, ["ticker", "ts"], ["event_id"]), K, ["value"])


@query(
    "set03_tradeable_set",
    f"""WITH {SQL_SIDES}, st AS (SELECT DISTINCT ticker FROM sideaudit WHERE tradeable),
fo AS (SELECT DISTINCT ticker FROM sideaudit WHERE top_net > 0), m AS (SELECT ticker FROM st UNION SELECT ticker FROM fo)
SELECT ticker, CASE WHEN (SELECT count(*) FROM st) = 0 THEN 'fold_history_only' WHEN (SELECT count(*) FROM fo) = 0 THEN 'stitched_only' ELSE 'union' END AS source FROM m""",
)
def set03(spark, sf):
    a = side_audit(spark, sf)
    return A.tradeable_set(a.where("tradeable"), a.where("top_net_bps > 0"), a.where("top_net_bps > 0"), "union")


@query("set04_disabled", f"WITH {SQL_SIDES} SELECT DISTINCT ticker FROM dim EXCEPT SELECT ticker FROM sideaudit WHERE tradeable")
def set04(spark, sf):
    from .bars import supplier_dim

    return supplier_dim(spark, sf).select("ticker").subtract(side_audit(spark, sf).where("tradeable").select("ticker"))


# ---- evaluation -------------------------------------------------------------


@query(
    "ev01_top_decile",
    f"""WITH {SQL_SCORED}, f AS (SELECT * FROM scored WHERE fwd_ret IS NOT NULL), q AS (SELECT ticker, quantile_cont(proba, 0.9) AS cut, count(*) AS n FROM f GROUP BY 1),
t AS (SELECT ticker, any_value(q.n) AS n, avg(fwd_ret) FILTER (proba >= cut) * 10000 AS gross, avg(round_trip_bps) FILTER (proba >= cut) AS cost FROM f JOIN q USING (ticker) GROUP BY 1)
SELECT ticker, n, {r('CASE WHEN n >= 50 THEN gross END', 4)} AS gross_bps, {r('CASE WHEN n >= 50 THEN cost END', 4)} AS cost_bps, {r('CASE WHEN n >= 50 THEN gross - cost END', 4)} AS net_bps FROM t""",
)
def ev01(spark, sf):
    return out(E.top_decile_stats(stored(spark, sf), ["ticker"], "proba", "fwd_ret", "round_trip_bps"), ["ticker"], ["gross_bps", "cost_bps", "net_bps"], ["n"], d=4)


@query(
    "ev02_decile_audit",
    f"""WITH {SQL_SCORED}, {sql_bins('scored')}, d AS (SELECT ticker, bin, count(*) AS n, avg(proba) AS mean_score, avg(fwd_ret) * 10000 AS gross_bps, avg(fwd_ret - round_trip_bps / 10000) * 10000 AS net_bps FROM binned GROUP BY 1, 2),
e AS (SELECT *, sum(n) OVER (PARTITION BY ticker) AS total FROM d) SELECT ticker, CAST(bin AS BIGINT) AS bin, n, {r('mean_score', 4)} AS mean_score, {r('gross_bps', 4)} AS gross_bps, {r('net_bps', 4)} AS net_bps FROM e WHERE total >= 100""",
)
def ev02(spark, sf):
    return out(E.decile_table(stored(spark, sf), ["ticker"], "proba", "fwd_ret", "round_trip_bps"), ["ticker"], ["mean_score", "gross_bps", "net_bps"], ["bin", "n"], d=4)


@query(
    "ev03_side_audit",
    f"""WITH {SQL_SIDES} SELECT ticker, side, CAST(n AS BIGINT) AS n, {r('top_gross', 4)} AS top_gross_bps, {r('top_net', 4)} AS top_net_bps, CAST(monotonic AS BIGINT) AS monotonic, CAST(tradeable AS BIGINT) AS tradeable,
  concat_ws(',', CASE WHEN top_net <= floor_bps THEN 'net_below_floor' END, CASE WHEN NOT monotonic THEN 'not_monotonic' END) AS reasons FROM sideaudit""",
)
def ev03(spark, sf):
    d = side_audit(spark, sf).withColumns({c: F.col(c).cast("int") for c in ("monotonic", "tradeable")})
    return out(d, ["ticker", "side", "reasons"], ["top_gross_bps", "top_net_bps"], ["n", "monotonic", "tradeable"], d=4)


POSITION = "(CASE WHEN proba > proba_short + 0.1 THEN 1 WHEN proba_short > proba + 0.1 THEN -1 ELSE 0 END)"


@query(
    "ev04_side_normalised",
    f"""WITH {SQL_SCORED}, p AS (SELECT *, sides = 'short' OR (sides = 'both' AND {POSITION} < 0) AS sh FROM scored)
SELECT ticker, ts, {r('CASE WHEN sh THEN proba_short ELSE proba END')} AS gate_score, {r('CASE WHEN sh THEN -fwd_ret ELSE fwd_ret END')} AS gate_ret, CASE WHEN sh THEN 'short' ELSE 'long' END AS gate_side FROM p""",
)
def ev04(spark, sf):
    pos = F.when(F.col("proba") > F.col("proba_short") + 0.1, 1).when(F.col("proba_short") > F.col("proba") + 0.1, -1).otherwise(0)
    return out(E.side_normalised(scored(spark, sf).withColumn("position_side", pos), "fwd_ret"), ["ticker", "ts", "gate_side"], ["gate_score", "gate_ret"])


@query(
    "ev05_fold_gate",
    f"""WITH {SQL_FOLD_NETS}, g AS (SELECT ticker, count(*) FILTER (bottleneck = 'ok') AS ok_folds, count(net_bps) AS n, quantile_cont(net_bps, 0.5) AS med, max(round_trip_bps) * 1.25 AS fl FROM foldnets WHERE fold <> 1998 GROUP BY 1)
SELECT ticker, ok_folds, n, {r('med', 4)} AS median_net, CAST(ok_folds >= 2 OR (n >= 2 AND med >= 0.6 * fl) OR med > fl AS BIGINT) AS pass FROM g""",
)
def ev05(spark, sf):
    f = fold_nets(spark, sf).withColumn("skipped", F.col("fold") == 1998)
    from .bars import supplier_dim

    floors = supplier_dim(spark, sf).select("ticker", (F.col("round_trip_bps") * 1.25).alias("floor_bps"))
    return out(E.fold_gate(f, floors).withColumn("pass", F.col("pass").cast("int")), ["ticker"], ["median_net"], ["ok_folds", "n", "pass"], d=4)


@query(
    "ev06_quality_pass",
    f"""WITH {SQL_FOLD_NETS}, g AS (SELECT ticker, count(*) AS n, avg(CASE WHEN bottleneck = 'ok' THEN 1.0 ELSE 0.0 END) AS pr, avg(net_bps) AS mh, max(round_trip_bps) * 1.25 AS fl FROM foldnets GROUP BY 1)
SELECT ticker, n, {r('pr', 4)} AS pass_rate, {r('mh', 4)} AS mean_holdout, {r('greatest(0.1, least(1, pr))', 4)} AS soft_size, CAST(pr >= 0.40 OR mh >= fl AS BIGINT) AS keep FROM g""",
)
def ev06(spark, sf):
    from .bars import supplier_dim

    p = fold_nets(spark, sf).select("ticker", (F.col("bottleneck") == "ok").alias("ok"), F.col("net_bps").alias("holdout_bps"))
    floors = supplier_dim(spark, sf).join(p.select("ticker").distinct(), "ticker").select("ticker", (F.col("round_trip_bps") * 1.25).alias("floor_bps"))
    return out(E.quality_pass(p, floors).withColumn("keep", F.col("keep").cast("int")), ["ticker"], ["pass_rate", "mean_holdout", "soft_size"], ["n", "keep"], d=4)


def sql_classification(key: str, src: str) -> str:
    return f"""ck AS (SELECT {key} AS k, CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END AS y, greatest(1e-6, least(1 - 1e-6, proba)) AS p FROM {src} WHERE fwd_ret IS NOT NULL),
cb AS (SELECT *, avg(y) OVER (PARTITION BY k) AS rate, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0::DOUBLE AS rk,
  sum(y) OVER (PARTITION BY k ORDER BY p DESC) / count(*) OVER (PARTITION BY k ORDER BY p DESC) AS prec FROM ck),
cm AS (SELECT k, count(*) AS n, max(rate) AS base_rate, avg(CASE WHEN (p >= greatest(0.5, rate)) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(power(p - y, 2)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss,
  coalesce(sum(CASE WHEN p >= greatest(0.5, rate) THEN y END) / nullif(count(*) FILTER (p >= greatest(0.5, rate)), 0), 0) AS "precision", coalesce(sum(CASE WHEN p >= greatest(0.5, rate) THEN y ELSE 0 END) / nullif(sum(y), 0), 0) AS recall,
  (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, sum(prec * y) / sum(y) AS pr_auc FROM cb GROUP BY 1)"""


CLS = ["base_rate", "accuracy", "brier", "precision", "recall", "auc", "pr_auc", "log_loss"]
SEL_CLS = ", ".join(f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in CLS)


def labelled(spark, sf):
    return stored(spark, sf).where(F.col("fwd_ret").isNotNull()).withColumn("y", F.when(F.col("fwd_ret") > 0, 1.0).otherwise(0.0))


@query("ev07_classification", f"WITH {SQL_SCORED}, {sql_classification('asset_class', 'scored')} SELECT k AS asset_class, n, {SEL_CLS} FROM cm")
def ev07(spark, sf):
    return out(E.classification(labelled(spark, sf), ["asset_class"], "y", "proba"), ["asset_class"], CLS, ["n"])


@query(
    "ev08_calibration_bins",
    f"""WITH {SQL_SCORED}, b AS (SELECT ticker, CAST(least(floor(proba * 5), 4) AS BIGINT) AS bin, proba, CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END AS y FROM scored WHERE fwd_ret IS NOT NULL),
g AS (SELECT ticker, bin, count(*) AS n, avg(proba) AS mean_pred, avg(y) AS observed FROM b GROUP BY 1, 2)
SELECT ticker, bin, n, {r('mean_pred')} AS mean_pred, {r('observed')} AS observed, {r('observed - mean_pred')} AS gap, {r('avg(abs(observed - mean_pred)) OVER (PARTITION BY ticker)')} AS calibration_mae FROM g""",
)
def ev08(spark, sf):
    b = E.calibration_bins(labelled(spark, sf), ["ticker"], "y", "proba")
    return out(b.join(E.calibration_gap(b, ["ticker"]), "ticker"), ["ticker"], ["mean_pred", "observed", "gap", "calibration_mae"], ["bin", "n"])


MATRIX = ["down_down", "down_up", "up_down", "up_up", "log_loss", "brier", "auc", "likelihood_ratio"]


@query(
    "ev09_likelihood_matrix",
    f"""WITH {SQL_SCORED}, {sql_classification('asset_class', 'scored')},
x AS (SELECT k, count(*) FILTER (y = 0) AS n_down, count(*) FILTER (y = 1) AS n_up, avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (y = 0) AS down_down, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (y = 0) AS down_up,
  avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (y = 1) AS up_down, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (y = 1) AS up_up FROM ck GROUP BY 1), z AS (SELECT *, 0.6931 / greatest(log_loss, 1e-6) AS likelihood_ratio FROM x JOIN cm USING (k))
SELECT k AS asset_class, n_down, n_up, {sel(MATRIX)} FROM z""",
)
def ev09(spark, sf):
    return out(E.likelihood_matrix(labelled(spark, sf), ["asset_class"], "y", "proba"), ["asset_class"], MATRIX, ["n_down", "n_up"])


@query("ev10_edge_correlation", f"WITH {SQL_SCORED} SELECT ticker, {r('CASE WHEN count(*) >= 6 THEN corr(proba, fwd_ret) ELSE 0 END')} AS edge_corr, count(*) AS n FROM scored WHERE fwd_ret IS NOT NULL GROUP BY 1")
def ev10(spark, sf):
    return out(E.edge_correlation(scored(spark, sf), ["ticker"], "proba", "fwd_ret"), ["ticker"], ["edge_corr"], ["n"])


@query(
    "ev11_drift",
    f"""WITH {SQL_SCORED}, {sql_classification('year(ts)', 'scored')}, b AS (SELECT k, least(floor(p * 5), 4) AS bin, avg(y) - avg(p) AS gap FROM ck GROUP BY 1, 2), c AS (SELECT k, avg(abs(gap)) AS calibration_mae FROM b GROUP BY 1),
t AS (SELECT avg(auc) AS a FROM cm) SELECT k AS fold, n, {r('auc')} AS auc, {r('calibration_mae')} AS calibration_mae, {r('auc - a')} AS auc_drift FROM cm JOIN c USING (k), t""",
)
def ev11(spark, sf):
    d = labelled(spark, sf).withColumn("fold", F.year("ts").cast("bigint"))
    c = E.classification(d, ["fold"], "y", "proba").join(E.calibration_gap(E.calibration_bins(d, ["fold"], "y", "proba"), ["fold"]), "fold")
    c = c.withColumn("auc_drift", F.col("auc") - c.agg(F.avg("auc")).scalar())
    return out(c, ["fold"], ["auc", "calibration_mae", "auc_drift"], ["n"])


REGIME_SQL = "CASE WHEN p_imp >= p_mr AND p_imp >= p_st THEN 'impulse' WHEN p_mr >= p_st THEN 'mean_revert' ELSE 'stress' END"


@query(
    "ev12_by_regime",
    f"WITH {SQL_SCORED} SELECT {REGIME_SQL} AS regime, count(*) AS n, {r('avg(CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, {r('avg(fwd_ret) * 10000', 4)} AS mean_bps, {r('100.0 * count(*) / (SELECT count(*) FROM scored WHERE fwd_ret IS NOT NULL)', 4)} AS coverage_pct FROM scored WHERE fwd_ret IS NOT NULL AND proba >= 0.6 GROUP BY 1",
)
def ev12(spark, sf):
    from ..functions.regimes import dominant

    d = scored(spark, sf).where(F.col("fwd_ret").isNotNull())
    total = d.agg(F.count(F.lit(1))).scalar()
    g = A.group_stats(d.where(F.col("proba") >= 0.6), [dominant().alias("regime")], "fwd_ret").withColumn("coverage_pct", 100.0 * F.col("n") / total)
    return g.select("regime", "n", rnd("hit_rate").alias("hit_rate"), rnd("mean_bps", 4).alias("mean_bps"), rnd("coverage_pct", 4).alias("coverage_pct"))


@query(
    "ev13_fold_slices",
    f"""WITH {SQL_SCORED}, f AS (SELECT *, CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS role FROM scored WHERE fwd_ret IS NOT NULL), q AS (SELECT ticker, role, quantile_cont(proba, 0.9) AS cut, count(*) AS n FROM f GROUP BY 1, 2),
t AS (SELECT ticker, role, any_value(q.n) AS n, avg(fwd_ret) FILTER (proba >= cut) * 10000 AS gross, avg(fwd_ret) FILTER (proba >= cut) * 10000 - avg(round_trip_bps) FILTER (proba >= cut) AS net, max(round_trip_bps) AS rt FROM f JOIN q USING (ticker, role) GROUP BY 1, 2),
w AS (SELECT ticker, max(rt) AS rt, max(net) FILTER (role = 'train' AND n >= 100) AS tn, max(net) FILTER (role = 'test' AND n >= 100) AS o, max(gross) FILTER (role = 'test' AND n >= 100) AS og FROM t GROUP BY 1)
SELECT ticker, {r('tn', 4)} AS train_net, {r('o', 4)} AS test_net, {r('og', 4)} AS test_gross, CASE WHEN o IS NULL AND tn IS NULL THEN 'insufficient_rows' WHEN o >= rt * 1.25 THEN 'ok' WHEN og < rt THEN 'gross<' || printf('%.1f', rt) || '_cost'
  WHEN tn < 0 AND (o IS NULL OR o < 0) THEN 'no_edge_train_and_oos' WHEN tn >= 0 AND o < 0 THEN 'train_ok_oos_fail' WHEN o < 0 THEN 'oos_negative' WHEN o >= 0 AND o < rt * 1.25 THEN 'oos_below_gate' ELSE 'unknown' END AS bottleneck,
  ticker = (SELECT arg_min(ticker, (o, ticker)) FROM w WHERE o IS NOT NULL) AS is_worst FROM w""",
)
def ev13(spark, sf):
    from ..plans.walkforward import fold_slice_report

    d = stored(spark, sf).withColumn("role", F.when(F.col("ts") < F.lit("1999-01-01").cast("timestamp_ntz"), "train").otherwise("test"))
    g = fold_slice_report(d, min_rows=100)
    return g.select("ticker", *[rnd(c, 4).alias(c) for c in ("train_net", "test_net", "test_gross")], "bottleneck", "is_worst")


@query(
    "ev15_half_life",
    f"""WITH {SQL_DAILY}, d AS (SELECT ticker, close AS x, lag(close) OVER {W} AS p, count(*) OVER (PARTITION BY ticker) AS n FROM daily), g AS (SELECT ticker, regr_slope(x - p, p) AS b, max(n) AS n FROM d GROUP BY 1)
SELECT ticker, {r('b')} AS slope, {r('CASE WHEN n >= 60 AND b < 0 THEN -ln(2) / b END')} AS half_life, n FROM g""",
)
def ev15(spark, sf):
    d = in_blocks(daily(spark, sf), lambda x, w: x.withColumn("prev", F.lag("close").over(w)), back=1, lay=DAILY)
    return out(E.half_life(d, ["ticker"], "close", "prev"), ["ticker"], ["slope", "half_life"], ["n"])


@query(
    "ev16_row_checks",
    f"""WITH {SQL_DAILY}, x AS (SELECT 'S' || s_suppkey AS ticker FROM supplier UNION SELECT 'S' || (s_suppkey + 1000000) FROM supplier WHERE s_suppkey % 10 = 0), n AS (SELECT ticker, count(*) AS n FROM daily GROUP BY 1)
SELECT ticker, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 540 THEN 'thin' ELSE 'ok' END AS status FROM x LEFT JOIN n USING (ticker)""",
)
def ev16(spark, sf):
    s = table(spark, sf, "supplier")
    x = s.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker")).unionByName(s.where("s_suppkey % 10 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey") + 1000000).alias("ticker")))
    return E.row_checks(x, daily(spark, sf), 540).select("ticker", F.col("n").cast("bigint").alias("n"), "status")


@query(
    "ev17_staleness",
    f"""WITH {SQL_DAILY}, p AS (SELECT ticker, max(ts) AS panel_ts FROM daily WHERE volume >= 20 GROUP BY 1), b AS (SELECT ticker, max(ts) AS bars_ts FROM daily GROUP BY 1)
SELECT b.ticker, panel_ts, bars_ts, CAST(panel_ts IS NULL OR panel_ts < bars_ts AS BIGINT) AS needs_rebuild FROM b LEFT JOIN p USING (ticker)""",
)
def ev17(spark, sf):
    d = daily(spark, sf)
    g = E.stale_or_missing(d.select("ticker"), d.where(F.col("volume") >= 20), d)
    return g.select("ticker", "panel_ts", "bars_ts", F.col("needs_rebuild").cast("bigint").alias("needs_rebuild"))
