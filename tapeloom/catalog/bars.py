"""Sources, sinks, bar building, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CLOCK, OHLCV
from ..dims import instrument_dim
from ..functions.frames import epoch
from ..operators import bars as B
from ..operators.blocks import in_blocks
from ..sources import landing, store
from .base import (
    DAILY, INTRADAY, SQL_BARS, SQL_DAILY, SQL_FLOW, SQL_TICKS, W, bars, daily, flow, ints, out, query, r, rnd, sel, table, ticks,
)

O = list(OHLCV)
SEL_BARS = f"SELECT ticker, ts, {sel(O)} FROM bars"

# event types stand for instruments; two of them trade round the clock
SQL_DIM = """dim AS (SELECT DISTINCT event_type AS ticker, CASE WHEN event_type IN ('click', 'view') THEN 'crypto' ELSE 'tradfi' END AS asset_class FROM events)"""


def event_dim(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_type").alias("ticker")).distinct()
    return instrument_dim(t.withColumn("asset_class", F.when(F.col("ticker").isin("click", "view"), "crypto").otherwise("tradfi")))


@query("src01_scan_bars", f"WITH {SQL_BARS} {SEL_BARS} WHERE ticker = 'click'")
def src01(spark, sf):
    path = store.scratch(spark)
    store.save_bars(bars(spark, sf).withColumn("timeframe", F.lit("5Min")), path)
    return out(store.load_bars(spark, path, "5Min", "click"), ["ticker", "ts"], O)


@query(
    "src02_scan_flow",
    f"WITH {SQL_BARS}, {SQL_FLOW} SELECT ticker, ts, {sel(O + ['buy_count', 'sell_count'])}, "
    + r("CASE WHEN buy_count + sell_count > 0 THEN (buy_count - sell_count) / (buy_count + sell_count) END")
    + " AS count_imbalance FROM bars JOIN flow USING (ticker, ts)",
)
def src02(spark, sf):
    path = store.scratch(spark)
    both = F.col("buy_count") + F.col("sell_count")
    f = bars(spark, sf).join(flow(spark, sf), ["ticker", "ts"])
    store.save_flow(f.withColumn("count_imbalance", F.when(both > 0, (F.col("buy_count") - F.col("sell_count")) / both)), path)
    return out(store.load_flow(spark, path), ["ticker", "ts"], O + ["buy_count", "sell_count", "count_imbalance"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "src03_close_matrix",
    f"WITH {SQL_BARS} SELECT ts, "
    + ", ".join(f"{r(f'max(CASE WHEN ticker = {t!r} THEN close END)')} AS {t}" for t in EVENT_TYPES)
    + " FROM bars GROUP BY ts",
)
def src03(spark, sf):
    return out(B.close_matrix(bars(spark, sf), EVENT_TYPES), ["ts"], EVENT_TYPES)


@query(
    "src04_parse_klines",
    """WITH k AS (SELECT event_type AS ticker, ts, event_id, value AS v, event_id % 7 AS n, value * (event_id % 5) / 4.0 AS tb FROM events),
p AS (SELECT *, CASE WHEN v > 0 AND n > 0 THEN n * tb / v ELSE 0.0 END AS b FROM k),
q AS (SELECT *, CASE WHEN v > 0 AND n > 0 THEN n - b ELSE 0.0 END AS s FROM p) """
    + f"SELECT ticker, date_trunc('millisecond', ts) AS ts, {r('v + 1')} AS open, {r('v + 2')} AS high, {r('v')} AS low, {r('v + 1.5')} AS close, "
    + f"{r('v')} AS volume, {r('b')} AS buy_count, {r('s')} AS sell_count, "
    + r("CASE WHEN b + s > 0 THEN (b - s) / (b + s) ELSE 0.0 END") + " AS count_imbalance FROM q",
)
def src04(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    parts = [
        F.unix_millis(F.col("ts").cast("timestamp")), v + 1, v + 2, v, v + 1.5, v, F.lit(0), F.lit(0),
        F.col("event_id") % 7, v * (F.col("event_id") % 5) / 4.0,
    ]
    landed = e.select(F.col("event_type").alias("ticker"), F.to_json(F.array(*[p.cast("string") for p in parts])).alias("payload"))
    return out(landing.parse_klines(landed), ["ticker", "ts"], O + ["buy_count", "sell_count", "count_imbalance"])


@query(
    "src05_parse_export",
    """WITH raw AS (SELECT 'S' || l_suppkey AS ticker, l_shipdate + to_seconds(l_linenumber * 3600) AS ts, l_extendedprice AS px, l_quantity AS qty,
  l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM raw WHERE l_orderkey % 97 <> 0) """
    + f"SELECT ticker, ts, {r('px')} AS open, {r('px + 1')} AS high, {r('px - 1')} AS low, {r('px')} AS close, {r('qty')} AS volume FROM k "
    "WHERE rn = 1 AND l_orderkey % 89 <> 0",
)
def src05(spark, sf):
    li = table(spark, sf, "lineitem")
    day = F.when(F.col("l_orderkey") % 97 == 0, "garbage").otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    px = F.col("l_extendedprice")
    text = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("<TICKER>"),
        day.alias("<DATE>"),
        (F.col("l_linenumber") * 10000).cast("string").alias("<TIME>"),
        px.cast("string").alias("<OPEN>"),
        (px + 1).cast("string").alias("<HIGH>"),
        (px - 1).cast("string").alias("<LOW>"),
        F.when(F.col("l_orderkey") % 89 == 0, "n/a").otherwise(px.cast("string")).alias("<CLOSE>"),
        F.col("l_quantity").cast("string").alias("<VOL>"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"),
    )
    return out(landing.parse_export(text, "seq"), ["ticker", "ts"], O)


@query(
    "src06_vendor_bars",
    """WITH raw AS (SELECT 'C' || o_custkey AS ticker, o_orderdate + INTERVAL 12 HOUR AS local, o_totalprice AS px, o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE 1.0 + o_orderkey % 10 END AS vol FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, local ORDER BY o_orderkey DESC) AS rn FROM raw) """
    + "SELECT ticker, timezone('UTC', timezone('America/New_York', local)) AS ts, "
    + f"{r('px')} AS open, {r('px')} AS high, {r('px')} AS low, {r('px * 2')} AS close, {r('vol')} AS volume FROM k WHERE rn = 1 AND vol > 0",
)
def src06(spark, sf):
    o = table(spark, sf, "orders")
    px = F.col("o_totalprice")
    raw = o.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("Ticker"),
        (F.col("o_orderdate") + F.expr("interval 12 hours")).alias("Ts"),
        px.alias("Open"), px.alias("High"), px.alias("Low"), (px * 2).alias("Adj Close"),
        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(1.0 + F.col("o_orderkey") % 10).alias("Volume"),
        F.col("o_orderkey").alias("Seq"),
    )
    return out(landing.normalize_vendor(raw, zone="America/New_York"), ["ticker", "ts"], O)


@query(
    "src07_nested_records",
    """WITH raw AS (SELECT event_type AS ticker, date_trunc('minute', ts) AS ts, value AS v, event_id FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id DESC) AS rn FROM raw) """
    + f"SELECT ticker, ts, {r('v')} AS open, {r('v + 1')} AS high, {r('v')} AS low, {r('v')} AS close, {r('0.0')} AS volume FROM k WHERE rn = 1",
)
def src07(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    wrap = lambda x: F.to_json(F.struct(x.cast("string").alias("value")))
    record = F.concat(
        F.lit('[{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00'Z'"),
        F.lit('","open":'), wrap(v), F.lit(',"high":'), wrap(v + 1), F.lit(',"low":'), wrap(v), F.lit(',"close":'), v.cast("string"), F.lit("}]"),
    )
    landed = e.select(F.col("event_type").alias("ticker"), F.col("event_id").alias("seq"), record.alias("payload"))
    return out(landing.parse_records(landed), ["ticker", "ts"], O)


@query(
    "src08_candle_pages",
    f"SELECT event_type AS ticker, date_trunc('second', ts) AS ts, {r('value')} AS open, {r('value + 1')} AS high, {r('value')} AS low, {r('value')} AS close, {r('event_id')} AS volume FROM events",
)
def src08(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    cells = F.array(v.cast("string"), v.cast("string"), (v + 1).cast("string"), v.cast("string"), F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    pages = (
        e.select(F.col("event_type").alias("ticker"), (F.col("event_id") % 64).alias("page"), F.floor(F.col("event_id") / 6400).alias("part"), cells.alias("c"))
        .groupBy("ticker", "page", "part")
        .agg(F.collect_list("c").alias("data"))
        .select(
            "ticker",
            F.to_json(
                F.struct(F.struct(F.array(*[F.lit(x) for x in ("open", "close", "high", "low", "volume", "begin")]).alias("columns"), F.col("data")).alias("candles"))
            ).alias("payload"),
        )
    )
    return out(landing.parse_candle_pages(pages), ["ticker", "ts"], O)


@query("src09_save_bars", f"WITH {SQL_DAILY} SELECT ticker, ts, {sel(O)} FROM daily")
def src09(spark, sf):
    path = store.scratch(spark)
    d = daily(spark, sf).withColumn("timeframe", F.lit("1Day"))
    store.save_bars(d, path, ("timeframe",))
    return out(store.load_bars(spark, path, "1Day"), ["ticker", "ts"], O)


@query("src10_panel_store", f"WITH {SQL_BARS} SELECT ticker, ts, {sel(O)} FROM bars")
def src10(spark, sf):
    path = store.scratch(spark)
    store.save_panel(bars(spark, sf), path, 14)
    return out(store.load_panel(spark, path, 14).orderBy("ts", "ticker"), ["ticker", "ts"], O)


@query(
    "src11_fold_diagnostics",
    """WITH d AS (SELECT CASE WHEN value < 20 THEN 'cost' WHEN value < 60 THEN 'signal' ELSE 'ok' END AS bottleneck, value - 20 AS net_bps FROM events) """
    + f"SELECT bottleneck, count(*) AS n, {r('avg(net_bps)')} AS mean_net_bps FROM d GROUP BY 1",
)
def src11(spark, sf):
    path = store.scratch(spark)
    e = table(spark, sf, "events")
    v = F.col("value")
    d = e.select(
        F.col("event_type").alias("ticker"),
        F.when(v < 20, "cost").when(v < 60, "signal").otherwise("ok").alias("bottleneck"),
        (v - 20).alias("net_bps"),
    )
    store.append_diagnostics(d.where(F.col("ticker") < "p"), path)
    store.append_diagnostics(d.where(F.col("ticker") >= "p"), path)
    return out(store.diagnostics_rollup(spark, path, "ticker string, bottleneck string, net_bps double"), ["bottleneck"], ["mean_net_bps"], ["n"])


@query("src12_resume_load", f"WITH {SQL_BARS} {SEL_BARS}")
def src12(spark, sf):
    path = store.scratch(spark)
    b = bars(spark, sf)
    b.where(F.col("ts") < "2024-01-20 10:00:00").write.parquet(path)
    return out(store.resume_load(spark, path, b), ["ticker", "ts"], O)


@query("src12_upsert_days", f"WITH {SQL_BARS} SELECT ticker, ts, " + ", ".join(f"{r(f'CASE WHEN ts >= TIMESTAMP {chr(39)}2024-01-20 10:00:00{chr(39)} THEN {c} + 1 ELSE {c} END')} AS {c}" for c in O) + " FROM bars")
def src12_upsert(spark, sf):
    path = store.scratch(spark)
    b = bars(spark, sf)
    late = F.col("ts") >= "2024-01-20 10:00:00"
    store.upsert_days(spark, path, b.where(F.col("ts") < "2024-01-20 14:00:00"))
    store.upsert_days(spark, path, b.where(late).select("ticker", "ts", *[(F.col(c) + 1).alias(c) for c in O]))
    return out(store.load_days(spark, path), ["ticker", "ts"], O)


@query(
    "src13_load_plan",
    """WITH s AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
c AS (SELECT k, b, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 90 DAY)) AS DATE) AS chunk_start FROM s)
SELECT k, chunk_start, CAST(least(chunk_start + 89, b) AS DATE) AS chunk_end FROM c""",
)
def src13(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return store.load_plan(s, "a", "b", 90).select("k", "chunk_start", "chunk_end")


# ---- bar building -----------------------------------------------------------


@query(
    "bar01_resample",
    f"WITH {SQL_BARS} SELECT ticker, date_trunc('hour', ts) AS ts, {r('first(open ORDER BY ts)')} AS open, {r('max(high)')} AS high, {r('min(low)')} AS low, "
    f"{r('last(close ORDER BY ts)')} AS close, {r('sum(volume)')} AS volume FROM bars GROUP BY 1, 2",
)
def bar01(spark, sf):
    return out(B.resample(bars(spark, sf), "1 hour"), ["ticker", "ts"], O)


@query(
    "bar02_resample_idle",
    f"""WITH {SQL_TICKS}, m AS (SELECT ticker, date_trunc('minute', ts) AS ts, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY ts, event_id) AS close, CASE WHEN ticker = 'view' THEN 0.0 ELSE CAST(sum(buy) AS DOUBLE) END AS volume FROM ticks GROUP BY 1, 2),
f AS (SELECT ticker, time_bucket(INTERVAL '5 minutes', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM m GROUP BY 1, 2),
g AS (SELECT *, max(volume) OVER (PARTITION BY ticker) > 0 AS live FROM f)
SELECT ticker, ts, {sel(O)} FROM g WHERE NOT live OR volume > 0""",
)
def bar02(spark, sf):
    t = ticks(spark, sf).withColumn("size", F.when(F.col("ticker") == "view", 0.0).otherwise(F.col("buy")))
    m = B.ticks_to_bars(t, "1 minute", price="px", size="size", tie=("event_id",))
    return out(B.resample_drop_idle(m), ["ticker", "ts"], O)


NY = "timezone('America/New_York', timezone('UTC', ts))"
RTH = f"(isodow({NY}) <= 5 AND hour({NY}) * 60 + minute({NY}) >= 570 AND hour({NY}) * 60 + minute({NY}) < 960)"


@query("bar03_regular_hours", f"WITH {SQL_BARS} {SEL_BARS} WHERE {RTH}")
def bar03(spark, sf):
    return out(bars(spark, sf).where(B.regular_hours()), ["ticker", "ts"], O)


@query("bar04_session_filter", f"WITH {SQL_BARS}, {SQL_DIM} SELECT ticker, ts, {sel(O)} FROM bars JOIN dim USING (ticker) WHERE asset_class = 'crypto' OR {RTH}")
def bar04(spark, sf):
    return out(B.keep_session(bars(spark, sf), event_dim(spark, sf)), ["ticker", "ts"], O)


SQL_SESSION = f"sess AS (SELECT bars.*, CASE WHEN asset_class = 'crypto' THEN CAST(ts AS DATE) ELSE CAST({NY} AS DATE) END AS session FROM bars JOIN dim USING (ticker))"


def sessions(spark, sf):
    return B.with_session(bars(spark, sf), event_dim(spark, sf))


@query("bar05_session_id", f"WITH {SQL_BARS}, {SQL_DIM}, {SQL_SESSION} SELECT ticker, ts, session, {r('close')} AS close FROM sess")
def bar05(spark, sf):
    return out(sessions(spark, sf), ["ticker", "ts", "session"], ["close"])


@query(
    "bar06_session_open",
    f"WITH {SQL_BARS}, {SQL_DIM}, {SQL_SESSION} SELECT ticker, ts, CAST(coalesce(session <> lag(session) OVER {W}, true) AS BIGINT) AS is_open FROM sess",
)
def bar06(spark, sf):
    d = in_blocks(sessions(spark, sf), lambda x, w: x.withColumn("is_open", B.session_open_flag(w).cast("int")), back=1, lay=INTRADAY)
    return out(d, ["ticker", "ts"], ints=["is_open"])


@query(
    "bar07_overnight_safe_returns",
    f"""WITH {SQL_BARS}, {SQL_DIM}, {SQL_SESSION} SELECT ticker, ts,
  {r(f"CASE WHEN session = lag(session) OVER {W} THEN ln(close / lag(close) OVER {W}) END")} AS log_ret FROM sess""",
)
def bar07(spark, sf):
    d = in_blocks(sessions(spark, sf), lambda x, w: x.withColumn("log_ret", B.overnight_safe_return(w)), back=1, lay=INTRADAY)
    return out(d, ["ticker", "ts"], ["log_ret"])


@query(
    "bar08_session_closes",
    f"WITH {SQL_BARS}, {SQL_DIM}, {SQL_SESSION} SELECT ticker, session, max(ts) AS last_ts, {r('arg_max(close, ts)')} AS close FROM sess GROUP BY 1, 2",
)
def bar08(spark, sf):
    return out(B.session_closes(sessions(spark, sf)), ["ticker", "session", "last_ts"], ["close"])


SQL_FLOWED = f"{SQL_BARS}, {SQL_FLOW}, flowed AS (SELECT *, CASE WHEN buy_count + sell_count > 0 THEN 1.0 ELSE 0.0 END AS flow_source FROM bars JOIN flow USING (ticker, ts))"


def flowed(spark, sf):
    d = bars(spark, sf).join(flow(spark, sf), ["ticker", "ts"])
    return d.withColumn("flow_source", F.when(F.col("buy_count") + F.col("sell_count") > 0, 1.0).otherwise(0.0))


@query("bar09_tick_only", f"WITH {SQL_FLOWED} SELECT ticker, ts, {sel(O)} FROM flowed WHERE flow_source > 0 AND buy_count + sell_count > 0")
def bar09(spark, sf):
    return out(B.tick_only(flowed(spark, sf)), ["ticker", "ts"], O)


@query(
    "bar10_tick_only_crypto",
    f"WITH {SQL_FLOWED}, {SQL_DIM} SELECT ticker, ts, {sel(O)} FROM flowed JOIN dim USING (ticker) WHERE asset_class <> 'crypto' OR (flow_source > 0 AND buy_count + sell_count > 0)",
)
def bar10(spark, sf):
    return out(B.tick_only_crypto(flowed(spark, sf), event_dim(spark, sf)), ["ticker", "ts"], O)


@query(
    "bar11_common_end",
    f"WITH {SQL_DAILY}, e AS (SELECT min(m) AS m FROM (SELECT ticker, max(ts) AS m FROM daily GROUP BY 1)) SELECT ticker, ts, {sel(O)} FROM daily WHERE ts <= (SELECT m FROM e)",
)
def bar11(spark, sf):
    return out(B.common_end(daily(spark, sf)), ["ticker", "ts"], O)


@query(
    "bar12_clean_symbols",
    """WITH s AS (SELECT CASE WHEN s_suppkey % 11 = 0 THEN '../' || s_name WHEN s_suppkey % 7 = 0 THEN ' x ' ELSE ' sp#' || s_suppkey || '-' END AS raw FROM supplier),
c AS (SELECT raw, regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g') AS k FROM s)
SELECT raw, CASE WHEN NOT contains(raw, '/') AND NOT contains(raw, '..') AND regexp_full_match(k, '[A-Z0-9]{2,12}') THEN k END AS symbol FROM c""",
)
def bar12(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    raw = F.when(k % 11 == 0, F.concat(F.lit("../"), F.col("s_name"))).when(k % 7 == 0, " x ").otherwise(F.concat(F.lit(" sp#"), k, F.lit("-")))
    return s.select(raw.alias("raw")).select("raw", B.clean_symbol("raw").alias("symbol"))


SQL_SUPPLIERS = """sup AS (SELECT 'S' || s_suppkey AS ticker, CASE WHEN n_regionkey % 2 = 0 THEN 'crypto' ELSE 'tradfi' END AS asset_class,
  CASE s_suppkey % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'both' END AS sides, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dim AS (SELECT *, CASE WHEN asset_class = 'crypto' THEN 1.1 ELSE 0.5 END AS commission_bps, CASE WHEN asset_class = 'crypto' THEN 1.5 ELSE 2.0 END AS slippage_bps,
  CASE WHEN asset_class = 'crypto' THEN 0.80 ELSE 0.18 END AS vol_ref FROM sup)"""


def supplier_dim(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    t = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
        F.when(F.col("n_regionkey") % 2 == 0, "crypto").otherwise("tradfi").alias("asset_class"),
        F.when(F.col("s_suppkey") % 4 == 0, "long").when(F.col("s_suppkey") % 4 == 1, "short").otherwise("both").alias("sides"),
        "s_acctbal",
    )
    return instrument_dim(t)


@query(
    "bar13_instrument_dim",
    f"WITH {SQL_SUPPLIERS} SELECT ticker, asset_class, sides, {r('commission_bps')} AS commission_bps, {r('slippage_bps')} AS slippage_bps, "
    f"{r('2 * (commission_bps + slippage_bps)')} AS round_trip_bps, {r('45 + 2 * commission_bps + 1.5')} AS threshold_bps, CAST(48 AS BIGINT) AS horizon FROM dim",
)
def bar13(spark, sf):
    return out(supplier_dim(spark, sf), ["ticker", "asset_class", "sides"], ["commission_bps", "slippage_bps", "round_trip_bps", "threshold_bps"], ["horizon"])


@query(
    "bar14_best_timeframe",
    f"""WITH {SQL_BARS}, n AS (SELECT '5Min' AS timeframe, 5 AS minutes, 60 AS cap, count(*) AS n, date_diff('day', min(ts), max(ts)) AS days FROM bars
UNION ALL SELECT '1Hour', 60, 730, count(DISTINCT (ticker, date_trunc('hour', ts))), date_diff('day', min(ts), max(ts)) FROM bars
UNION ALL SELECT '1Day', 390, 7300, count(DISTINCT (ticker, date_trunc('day', ts))), date_diff('day', min(ts), max(ts)) FROM bars)
SELECT timeframe, n, CAST(CASE WHEN timeframe = '1Day' THEN floor(least(days, cap) * 252 / 365.0::DOUBLE)
  ELSE floor(least(days, cap) * 252 / 365.0::DOUBLE * greatest(1, floor(390 / minutes))) END AS BIGINT) AS expected,
  timeframe = (SELECT arg_max(timeframe, n) FROM n) AS is_best FROM n""",
)
def bar14(spark, sf):
    b = bars(spark, sf)
    hours, days = F.date_trunc("hour", "ts"), F.date_trunc("day", "ts")
    one = b.select("ticker", "ts", hours.alias("_h"), days.alias("_d"))
    span = F.date_diff(F.max("ts"), F.min("ts"))
    tot = one.agg(
        F.count(F.lit(1)).alias("n5"), F.count_distinct("ticker", "_h").alias("n60"), F.count_distinct("ticker", "_d").alias("n390"), span.alias("want_days")
    )
    rows = F.array(*[
        F.struct(F.lit(tf).alias("timeframe"), F.lit(m).alias("minutes"), F.lit(cap).alias("cap_days"), F.col(c).alias("n"))
        for tf, m, cap, c in (("5Min", 5, 60, "n5"), ("1Hour", 60, 730, "n60"), ("1Day", 390, 7300, "n390"))
    ])
    t = B.expected_bars(tot.select("want_days", F.inline(rows)), CLOCK)
    best = B.best_timeframe(t).select("timeframe")
    return t.select("timeframe", "n", "expected", (F.col("timeframe") == best.scalar()).alias("is_best"))


@query(
    "bar18_downsample",
    f"""WITH {SQL_DAILY}, p AS (SELECT ticker, ts, close, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM daily),
i AS (SELECT DISTINCT ticker, CAST(floor(k * (n - 1) / 99.0::DOUBLE) AS BIGINT) AS pos FROM (SELECT DISTINCT ticker, n FROM p) CROSS JOIN range(100) t(k))
SELECT p.ticker, ts, {r('close')} AS close, CAST(p.pos AS BIGINT) AS pos FROM p LEFT JOIN i ON p.ticker = i.ticker AND p.pos = i.pos WHERE n <= 100 OR i.pos IS NOT NULL""",
)
def bar18(spark, sf):
    return out(B.downsample(daily(spark, sf), 100, DAILY), ["ticker", "ts"], ["close"], ["pos"])


@query("bar17_subsample", f"WITH {SQL_BARS} SELECT least(5000, count(*)) AS n, least(5000, count(*)) AS n_again, true AS all_known FROM bars")
def bar17(spark, sf):
    d = bars(spark, sf)
    a, b = B.subsample(d, 5000, ["ticker", "ts"]), B.subsample(d, 5000, ["ticker", "ts"])
    same = a.select("ticker", "ts").join(b.select("ticker", "ts"), ["ticker", "ts"]).groupBy().agg(F.count(F.lit(1)).alias("n_again"))
    known = a.join(d.select("ticker", "ts"), ["ticker", "ts"], "left_anti").groupBy().agg((F.count(F.lit(1)) == 0).alias("all_known"))
    return same.select(a.groupBy().agg(F.count(F.lit(1))).scalar().alias("n"), "n_again", known.scalar().alias("all_known"))


@query(
    "bar19_rebase",
    f"WITH {SQL_DAILY} SELECT ticker, ts, {r(f'close / first_value(close) OVER {W} * 10000', 4)} AS equity FROM daily",
)
def bar19(spark, sf):
    return out(B.rebase(daily(spark, sf), "close", "equity", 10000.0, DAILY), ["ticker", "ts"], ["equity"], d=4)


@query(
    "bar20_compress",
    f"WITH {SQL_BARS}, c AS (SELECT ticker, ts, volume, lag(volume) OVER {W} AS prev FROM bars) SELECT ticker, ts, {r('volume')} AS volume FROM c WHERE prev IS NULL OR prev <> volume",
)
def bar20(spark, sf):
    return out(B.compress(bars(spark, sf), "volume", INTRADAY), ["ticker", "ts"], ["volume"])
