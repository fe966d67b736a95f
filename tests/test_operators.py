"""Operators that SQL states badly, against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import draws
from tapeloom.functions import scores as S
from tapeloom.operators import features as X
from tapeloom.operators import labels as L
from tapeloom.operators import signals as G
from tapeloom.operators.blocks import Layout, in_blocks
from tapeloom.operators.spread import value_positions
from tapeloom.plans import panel as PN
from tapeloom.plans import policies as PO
from tapeloom.plans import portfolio as P
from tapeloom.plans import regime_fit as H
from tapeloom.sources.store import scratch
from tapeloom.streaming import streams as T


def walk(n=600, seed=0, ticker="A", start="2024-01-01"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return pd.DataFrame({"ticker": ticker, "ts": pd.date_range(start, periods=n, freq="5min"), "close": close, "open": close * 0.999, "high": close * 1.002, "low": close * 0.998, "volume": 10.0})


@pytest.mark.parametrize("block,fan", [(64, 2), (64, 256), (8192, 256)])
def test_deoverlap_is_the_greedy_chain(spark, block, fan):
    rng = np.random.default_rng(3)
    rows = []
    for t, n in (("HOT", 900), ("B", 60)):
        pos = np.sort(rng.choice(3000, size=n, replace=False))
        rows += [(t, int(p), int(h)) for p, h in zip(pos, rng.integers(1, 60, n))]
    df = spark.createDataFrame(rows, "ticker string, gpos bigint, exit_horizon int")
    got = {(r.ticker, r.gpos) for r in G.deoverlap(df, ["ticker"], 60, block=block, fan=fan).collect()}
    want = set()
    for t in ("HOT", "B"):
        free = -1
        for _, p, h in sorted(r for r in rows if r[0] == t):
            if p >= free:
                want.add((t, p))
                free = p + h
    assert got == want


def test_deoverlap_takes_many_small_keys_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(f"K{i}", int(p), int(h)) for i in range(300) for p, h in zip(rng.integers(0, 90, 6), rng.integers(1, 40, 6))]
    rows = list({r[:2]: r for r in rows}.values()) + [(None, 3, 5), ("K1", None, 5)]
    df = spark.createDataFrame(rows, "ticker string, gpos bigint, exit_horizon int")
    d = G.deoverlap(df, ["ticker"], 40)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    want, free = set(), {}
    for t, p, h in sorted(r for r in rows if None not in r):
        if p >= free.get(t, 0):
            want.add((t, p))
            free[t] = p + h
    assert {(r.ticker, r.gpos) for r in d.collect()} == want


def plain_isotonic(x, y):
    """Distinct x and the rising fit, by its definition."""
    g = pd.DataFrame({"x": x, "y": y}).groupby("x").y.agg(["sum", "count"]).reset_index()
    s, n = np.r_[0, g["sum"].cumsum()], np.r_[0, g["count"].cumsum()]
    mean = lambda i, j: (s[j + 1] - s[i]) / (n[j + 1] - n[i])
    low = np.array([[mean(i, j) if j >= i else np.inf for j in range(len(g))] for i in range(len(g))])
    return g.x.to_numpy(), np.array([low[: t + 1, t:].min(1).max() for t in range(len(g))])


@pytest.mark.parametrize("piece", [7, 37, 65536])
def test_isotonic_crossings_are_those_of_the_fit(spark, piece, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(PO, "PIECE", piece)
    parts = []
    for key, slope, n in (("UP", 0.3, 300), ("FLAT", 0.0, 300), ("DOWN", -0.3, 200), ("FEW", 1.0, 20), ("RISING", 1.0, 150)):
        x = np.round(rng.random(n) * 100, 1)
        parts.append(pd.DataFrame({"ticker": key, "x": x, "y": (x - 40) * slope + (0 if key == "RISING" else 1) * rng.normal(0, 12, n)}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf)
    cross = {r.ticker: r for r in PO.isotonic_crossing(df, ["ticker"], "x", "y", 0.0).collect()}
    got = {r.ticker: r for r in PO.isotonic_threshold(df, ["ticker"], "x", "y", lo=5, hi=95).collect()}
    for key, d in pdf.groupby("ticker"):
        x, v = plain_isotonic(d.x, d.y)
        hit = np.flatnonzero(v >= 0)
        if len(hit):
            assert cross[key].x_hit == x[hit[0]] and np.isclose(cross[key].v_hit, v[hit[0]])
            assert hit[0] == 0 or (cross[key].x_before == x[hit[0] - 1] and np.isclose(cross[key].v_before, v[hit[0] - 1]))
        else:
            assert cross[key].x_hit is None
        grid = np.unique(np.quantile(d.x, np.linspace(0.05, 0.99, 40)))
        ok = grid[np.interp(grid, x, v) >= 0]
        reached = len(ok) > 0 and len(d) >= 50
        want = ok[0] if reached else np.quantile(d.x, 0.85)
        assert got[key].reached == reached and np.isclose(got[key].threshold, np.clip(want, 5, 95))


def test_centred_grids_against_plain_masks(spark):
    rng = np.random.default_rng(9)
    n = 4000
    pdf = pd.DataFrame({"ticker": rng.choice(["A", "B"], n, p=[0.9, 0.1]), "split": rng.integers(0, 3, n), "score": rng.random(n) * 100, "expected_edge_bps": rng.normal(0, 10, n), "position_side": rng.integers(-1, 2, n), "impulse": rng.normal(0.2, 0.2, n), "net_ret": rng.normal(0, 0.01, n)})
    df = spark.createDataFrame(pdf)
    centres = spark.createDataFrame([("A", 33.0, 5.5), ("B", 55.0, 4.0)], "ticker string, buy double, edge double")
    grids = PO.centred_grids(centres, ["ticker"], buy_lo=30.0, buy_hi=55.0, edge_lo=4.0, edge_hi=12.0)
    g = {r.ticker: (r.buys, r.edges) for r in grids.collect()}
    assert g["A"] == ([30.0, 33.0, 36.0, 39.0, 55.0], [4.0, 4.5, 5.5, 6.5, 7.5, 12.0]) and g["B"][0] == [30.0, 49.0, 52.0, 55.0]
    got = {(r.ticker, r.split, r.buy_threshold, r.min_edge_bps): (r.n_trades, r.net_bps) for r in PO.grid_nets(df, grids, ["ticker"], "split", impulse_min=0.05).collect()}
    for (t, s), d in pdf[pdf.impulse >= 0.05].groupby(["ticker", "split"]):
        for b in g[t][0]:
            for m in g[t][1]:
                on = ((d.position_side > 0) & (d.score >= b) & (d.expected_edge_bps >= m)) | ((d.position_side < 0) & (d.score <= 100 - b) & (d.expected_edge_bps <= -m))
                k, v = got.pop((t, s, b, m), (0, None))
                assert k == on.sum() and (not k or np.isclose(v, d.net_ret[on].mean() * 1e4))
    assert not got


def test_gate_quality_holds_out_the_end(spark):
    rng = np.random.default_rng(4)
    n = 1200
    pdf = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "gate_score": rng.random(n), "round_trip_bps": 5.0, "position_side": rng.choice([-1, 0, 1], n), "expected_edge_bps": rng.normal(0, 9, n)})
    pdf["gate_ret"] = pdf.gate_score * 0.01 * np.where(np.arange(n) < 900, 1, -1) + rng.normal(0, 0.001, n)
    pdf["fwd_ret"] = pdf.gate_ret
    floors = spark.createDataFrame([("A", 6.0), ("NEW", 6.0)], "ticker string, floor_bps double")
    q = PO.gate_quality(spark.createDataFrame(pdf), floors, Layout(bucket=90 * 86400)).collect()
    assert [r.ticker for r in q] == ["A"]
    held = pdf.iloc[900:]
    top = held[held.gate_score >= held.gate_score.quantile(0.9)]
    assert np.isclose(q[0].holdout_net, top.gate_ret.mean() * 1e4 - 5) and q[0].holdout_net < 0 < q[0].cv_net and q[0].n_holdout == 300
    assert q[0].pass_rate == 1.0 and not q[0].quality_ok
    on = held[held.position_side != 0]
    assert np.isclose(q[0].alignment, on.expected_edge_bps.abs().rank().corr((on.fwd_ret * on.position_side).rank()))


def test_macd_equals_the_recursion_over_chunks(spark):
    pdf = walk(1900)
    lay = Layout(bucket=86400, rows=700)
    got = in_blocks(spark.createDataFrame(pdf), X.macd_hist, back=X.MACD_BACK, lay=lay).toPandas().sort_values("ts")
    e = lambda s, k: s.ewm(span=k, adjust=False).mean()
    m = e(pdf.close, 12) - e(pdf.close, 26)
    np.testing.assert_allclose(got.macd_hist.to_numpy(), (m - e(m, 9)).to_numpy(), atol=1e-9)


def test_features_are_causal(spark):
    pdf = walk(500, 2)
    lay = Layout(bucket=43200, rows=200)

    def stage(d, w):
        for f in (X.returns, X.envelope, X.with_rsi, X.macd_hist, X.trend_efficiency, X.return_autocorrelation, X.vol_of_vol, X.conditional_vol, X.factors, X.bar_observations):
            d = f(d, w)
        return d

    run = lambda p: in_blocks(spark.createDataFrame(p), stage, back=2048, lay=lay).toPandas().sort_values("ts").reset_index(drop=True)
    full, cut = run(pdf), run(pdf.iloc[:380])
    pd.testing.assert_frame_equal(full.iloc[:380], cut, check_dtype=False, atol=1e-9)


def test_regime_table_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(7)
    n = 420
    pdf = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    kw = dict(dims=("a", "b"), train=96, every=24, least=30, rounds=3)
    whole = H.regime_table(df, lay=Layout(bucket=3600, rows=100000), **kw).toPandas().sort_values("ts")
    parts = H.regime_table(df, lay=Layout(bucket=3600, rows=80), **kw).toPandas().sort_values("ts")
    assert len(whole) == n - 30
    np.testing.assert_allclose(whole[["p_imp", "p_mr", "p_st"]], parts[["p_imp", "p_mr", "p_st"]], atol=1e-8)
    # brute force for one refit
    x = pdf[["a", "b"]].to_numpy()
    m = H.fit([x[24:120]], 3)
    p = H.filtered(m, [x[24:144]])[0][96:][:, m.roles()[0]]
    np.testing.assert_allclose(whole[["p_imp", "p_mr", "p_st"]].to_numpy()[90:114], p, atol=1e-8)


def test_regime_blocks_go_to_python_together(spark):
    rng = np.random.default_rng(8)
    each = [pd.DataFrame({"ticker": f"T{i}", "ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "a": rng.normal(size=n), "b": rng.normal(size=n)}) for i, n in enumerate((90, 200, 20, 131))]
    kw = dict(dims=("a", "b"), train=60, every=24, least=30, rounds=3, lay=Layout(bucket=3600, rows=80))
    got = H.regime_table(spark.createDataFrame(pd.concat(each)), **kw)
    assert "FlatMapGroupsInPandas [_pack" in got._jdf.queryExecution().toString()
    got = got.toPandas().sort_values(["ticker", "ts"])
    alone = pd.concat([H.regime_table(spark.createDataFrame(p), **kw).toPandas().sort_values("ts") for p in each])
    assert len(got) == sum(max(0, len(p) - 30) for p in each)
    np.testing.assert_allclose(got[["p_imp", "p_mr", "p_st"]], alone[["p_imp", "p_mr", "p_st"]], atol=1e-8)
    assert (got.hmm_state.to_numpy() == alone.hmm_state.to_numpy()).all()


def test_factors_work_many_blocks_at_once_and_equal_plain_windows(spark):
    each = [walk(n, i, f"T{i}") for i, n in enumerate((700, 40, 1, 330, 25))]
    df = pd.concat(each).reset_index(drop=True)
    df.loc[[5, 300, 301, 900], "close"] = np.nan
    frame = spark.createDataFrame(df).withColumn("close", F.nanvl("close", F.lit(None)))
    size = dict(vol=10, trend=40, skip=5, sma=30, med=120)
    d = in_blocks(frame, lambda x, w: X.factors(x, w, **size), back=140, lay=Layout(bucket=3600, rows=256))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    got = d.toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    df = df.sort_values(["ticker", "ts"]).reset_index(drop=True)
    g = lambda x, n, m: df.assign(x=x).groupby("ticker").x.rolling(n, min_periods=m)
    at = lambda r: r.reset_index(level=0, drop=True).sort_index()
    ret = np.log(df.close / df.groupby("ticker").close.shift())
    vol = at(g(ret, 10, 10).std()) * np.sqrt(252)
    mean, sd = at(g(df.close, 30, 30).mean()), at(g(df.close, 30, 30).std())
    np.testing.assert_allclose(got.ann_vol.astype(float), vol, rtol=1e-9)
    np.testing.assert_allclose(got.z_sma.astype(float), (df.close - mean) / sd, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(got.vol_ratio.astype(float), vol / at(g(vol, 120, 40).median()), rtol=1e-9)
    assert (got.risk_on == (df.close > mean)).all() and got.vol_ratio.notna().sum() > 300


def test_balanced_horizon_of_short_series_is_worked_as_arrays(spark):
    each = [walk(n, 20 + i, f"T{i}") for i, n in enumerate((300, 7, 1, 150))]
    df = pd.concat(each).reset_index(drop=True)
    df.loc[[3, 100, 310], "close"] = np.nan
    d = spark.createDataFrame(df).withColumn("close", F.nanvl("close", F.lit(None))).select("ticker", "ts", "close")
    whole = L.median_shares(d, (5, 10, 20), Layout(bucket=3600))
    cut = L.median_shares(d, (5, 10, 20), Layout(bucket=3600, rows=100))
    key = lambda t: sorted(t.collect(), key=lambda r: (r.ticker, r["rank"]))
    assert key(whole) == key(cut) and whole.count() == 7
    assert "MapInArrow" in whole._jdf.queryExecution().optimizedPlan().toString()


def test_small_keys_cost_no_sketch(spark):
    df = spark.createDataFrame([(k, float(v)) for k in range(40) for v in range(30)] + [(None, 1.0)], "k int, x double")
    pos = value_positions(df, ["k"], "x")
    rows = pos.collect()
    assert len(rows) == 1200 and all(r.before == r.x and r.total == 30 for r in rows)
    assert "percentile_approx" not in pos._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_macd_sorts_the_rows_once(spark):
    each = [walk(n, 30 + i, f"T{i}") for i, n in enumerate((1200, 40, 1))]
    df = pd.concat(each).reset_index(drop=True)
    d = in_blocks(spark.createDataFrame(df), X.macd_hist, back=X.MACD_BACK, lay=Layout(bucket=3600, rows=600))
    got = d.toPandas()
    assert d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("+- Sort [ticker") <= 2
    for t, p in df.groupby("ticker"):
        fast, slow = (p.close.ewm(span=n, adjust=False).mean() for n in (12, 26))
        want = (fast - slow) - (fast - slow).ewm(span=9, adjust=False).mean()
        np.testing.assert_allclose(got[got.ticker == t].sort_values("ts").macd_hist.astype(float), want, atol=1e-9)


def test_regime_fit_against_plain_sums():
    from itertools import product
    from math import isclose, log

    rng = np.random.default_rng(3)
    windows = [rng.normal(size=(n, 2)) for n in (40, 60, 60, 10)]
    ll = [H.log_likelihood(H.fit(windows, k), windows) for k in range(6)]
    assert all((b[:3] >= a[:3] - 0.05).all() for a, b in zip(ll, ll[1:]))  # rises, but for the addition to the variances
    both, alone = H.fit(windows, 4), H.fit([windows[0]], 4)
    np.testing.assert_allclose(both.mean[0], alone.mean[0], atol=1e-9)  # batches do not mix
    assert (both.mean[3] == 0).all()  # too short: flat
    # every path of five rows, summed
    m, x = H.Chains(*(getattr(both, k)[:1] for k in ("start", "move", "mean", "cov"))), windows[0][:5]
    dens = lambda s, r: np.exp(-0.5 * (r - m.mean[0, s]) @ np.linalg.inv(m.cov[0, s]) @ (r - m.mean[0, s])) / (2 * np.pi * np.sqrt(np.linalg.det(m.cov[0, s])))
    end, total = np.zeros(3), 0.0
    for path in product(range(3), repeat=5):
        w = m.start[0, path[0]] * dens(path[0], x[0])
        for a, b, r in zip(path, path[1:], x[1:]):
            w *= m.move[0, a, b] * dens(b, r)
        end[path[-1]] += w
        total += w
    np.testing.assert_allclose(H.filtered(m, [x])[0][-1], end / total, atol=1e-9)
    assert isclose(H.log_likelihood(m, [x])[0], log(total), rel_tol=1e-6)


def test_held_rows_are_packed():
    """A batch of rows is one entry of the state, whatever its rows; what is left is one again."""

    class State:
        def __init__(self):
            self.now = []

        appendValue = lambda self, x: self.now.append(x)  # noqa: E731, N815
        appendList = lambda self, x: self.now.extend(x)  # noqa: E731, N815
        put = update = lambda self, x: setattr(self, "now", list(x))
        get = lambda self: self.now
        exists = lambda self: bool(self.now)
        clear = lambda self: self.now.clear()

    class Handle:
        registerTimer = deleteTimer = lambda self, ms: None  # noqa: N815
        getListState = getValueState = lambda self, name, schema: State()  # noqa: N815

    class Times:
        getCurrentWatermarkInMs = lambda self: 100 * 300_000  # noqa: N802

    p = T.TransitionCounts()
    p.init(Handle())
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ts": pd.to_datetime(np.arange(150) * 300, unit="s"), "state": rng.integers(0, 3, 150).astype("int32")})
    mixed = pdf.sample(frac=1, random_state=1)
    list(p.handleInputRows(("A",), iter([mixed[:70], mixed[70:]]), None))
    assert len(p.held.now) == 2
    (got,) = p.handleExpiredTimer(("A",), Times(), None)
    assert len(p.held.now) == 1 and (got.ts.to_numpy() == pdf.ts[:100].to_numpy()).all()
    assert (got.state == pdf.state[:100]).all() and p.memory.now[1] == pdf.state[99]


def test_grid_search_shares_the_medians_of_a_fold(spark, monkeypatch):
    from pyspark.ml.feature import Imputer

    from tapeloom.plans import models as M

    fits, fit = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, d: fits.append(1) or fit(self, d))
    rng = np.random.default_rng(5)
    x = rng.normal(size=1200)
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=1200, freq="2h"), "x": np.where(rng.random(1200) < 0.1, np.nan, x), "y": (x > 0.3) * 1.0, "fwd_ret": x / 100, "round_trip_bps": 4.0})
    d = spark.createDataFrame(pdf)
    grid = [{"maxDepth": k, "maxIter": 2} for k in (1, 2)]
    found = {r.trial: r for r in M.grid_search(d, d.select(F.to_date("ts").alias("session")), ["x"], "y", grid, folds=2).collect()}
    assert len(fits) == 2 and found[0].n_folds == found[1].n_folds == 2
    plan = M.walkforward.session_folds(d.select(F.to_date("ts").alias("session")), 2, 1)
    part = d.withColumn("session", F.to_date("ts")).join(plan, "session")
    for i, params in enumerate(grid):
        net = []
        for f in (0, 1):
            rows = part.where(F.col("fold") == f)
            model = M.fit_entry(rows.where("role = 'train'"), ["x"], "y", params=params)
            s = M.audits.top_decile_stats(M.score_entry(model, rows), ["role"], "proba", "fwd_ret", "round_trip_bps")
            net.append({r.role: r.net_bps for r in s.collect()}["test"])
        assert abs(found[i].top_decile_net_bps - np.mean(net)) < 1e-6


def test_streamed_filter_and_counts_equal_batch(spark):
    rng = np.random.default_rng(9)
    n = 90
    pdf = pd.DataFrame({"ticker": ["A", "B"] * (n // 2), "ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "a": rng.normal(size=n), "b": rng.normal(size=n), "state": rng.integers(0, 3, n).astype("int32")})
    # rows of less than a millisecond apart keep their order too
    pdf.loc[4:9, "ts"] = pdf.ts[4] + pd.to_timedelta([0, 0, 2, 2, 1, 1], unit="us")
    model = {"pi": [1 / 3] * 3, "A": [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]], "mean": [[1.0, 0.0], [0.0, -0.5], [-1.0, 1.0]], "cov": [[[1.0, 0], [0, 1.0]]] * 3}
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    of_none = df.limit(3).withColumns({"ticker": F.lit(None).cast("string"), "state": F.lit(None).cast("int")})

    def run(path, late, parts):
        """Land the parts one file each, streaming after each half: the state carries on."""
        src = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        for i, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{path}/in")
            if i in (len(parts) // 2 - 1, len(parts) - 1):
                T.drain(T.regime_filter(src(), model, ("a", "b"), late), f"{path}/f")
                T.drain(T.transition_counts(src(), late), f"{path}/c")
        read = lambda x: spark.read.parquet(f"{path}/{x}/data").toPandas().sort_values(["ticker", "ts"])
        return read("f"), read("c")

    mark = T.closing_mark(df)
    shuffled = [df.where(F.pmod(F.xxhash64("ts", "ticker"), F.lit(3)) == i) for i in range(3)]
    in_order = [df.where("ts < '2024-01-01 03:00:00'").unionByName(of_none), df.where("ts >= '2024-01-01 03:00:00'").unionByName(df.limit(2)), mark]
    m = H.Chains(*(np.asarray(model[k], float)[None] for k in ("pi", "A", "mean", "cov")))
    # files in any order within the delay, and files in order of which the second repeats rows too late to count
    for late, parts in (("10 hours", [*shuffled, mark]), ("10 minutes", in_order)):
        got, cnt = run(scratch(spark), late, parts)
        assert len(got) == len(cnt) == n
        for t, g in pdf.groupby("ticker"):
            g = g.sort_values("ts")
            want = H.filtered(m, [g[["a", "b"]].to_numpy()])[0][:, m.roles()[0]]
            np.testing.assert_allclose(got[got.ticker == t][["p_imp", "p_mr", "p_st"]], want, atol=1e-9)
            assert (got[got.ticker == t].ts.to_numpy() == g.ts.to_numpy()).all()
            c, prev, rows = np.ones((3, 3)), None, []
            for s in g.state:
                rows.append(c[s] / c[s].sum())
                if prev is not None:
                    c[prev, s] += 1
                prev = s
            np.testing.assert_allclose(cnt[cnt.ticker == t][["next_impulse", "next_mean_revert", "next_stress"]], rows, atol=1e-12)
    # without a mark the rows of the delay stay held
    got, _ = run(scratch(spark), "1 hour", [df, df.limit(0)])
    assert (got.ts < pdf.ts.max() - pd.Timedelta("1h")).all() and len(got) == (pdf.ts < pdf.ts.max() - pd.Timedelta("1h")).sum()


def test_bootstrap_paths(spark):
    n = 60
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="D"), "ret": [0.01] * n}))
    p = P.bootstrap(df, paths=20, horizon=25, block=7, lay=Layout(bucket=10 * 86400)).toPandas()
    assert len(p) == 20
    np.testing.assert_allclose(p.terminal, 1.01**25)
    assert (p.max_drawdown == 0).all()
    again = P.bootstrap(df, paths=20, horizon=25, block=7, lay=Layout(bucket=10 * 86400)).toPandas()
    assert set(again.path) == set(p.path)


def test_bootstrap_equals_plain_loop(spark):
    rng = np.random.default_rng(4)
    ret = np.concatenate([rng.normal(0, 0.05, 40), [-1.0], rng.normal(0, 0.05, 20)])
    times = pd.date_range("2024-01-01", periods=len(ret) + 2, freq="D")
    df = spark.createDataFrame(list(zip(times.to_pydatetime(), [*ret.tolist(), None, float("inf")])), "ts timestamp_ntz, ret double")
    lay = Layout(bucket=10 * 86400)
    got = {r.path: (r.terminal, r.max_drawdown) for r in P.bootstrap(df, paths=30, horizon=25, block=7, seed=9, lay=lay).collect()}
    for path in range(30):
        starts = [draws.mixed(draws.mixed(draws.mixed(9) ^ path) ^ b) % (len(ret) - 7 + 1) for b in range(4)]
        w = np.cumprod(1 + np.concatenate([ret[s : s + 7] for s in starts])[:25])
        np.testing.assert_allclose(got[path], (w[-1], (w / np.maximum.accumulate(w) - 1).min()), atol=1e-12)
    few = P.bootstrap(df.limit(8), paths=30, horizon=25, block=7, lay=lay).collect()
    assert [tuple(r) for r in few] == [(0, 1.0, 0.0)]
    assert P.survival(P.bootstrap(df.limit(0), paths=30, horizon=25, block=7, lay=lay)).first().survival_rate == 1.0


def test_draws_are_even():
    x = np.array([draws.mixed(draws.mixed(draws.mixed(42) ^ i) ^ j) for i in range(2000) for j in range(21)])
    for m in (2, 7, 64, 1000):
        counts = np.bincount(x % m, minlength=m)
        assert abs(((counts - len(x) / m) ** 2 / (len(x) / m)).sum() - (m - 1)) < 5 * (2 * m) ** 0.5
    assert len({draws.mixed(i) for i in range(50_000)}) == 50_000


def test_inverse_vol_budget(spark):
    df = spark.createDataFrame([("A", 0.1), ("B", 0.2), ("C", 0.9), ("D", 1.5)], "ticker string, vol double")
    w = {r.ticker: r.weight for r in G.inverse_vol_budget(df, 0.35).collect()}
    assert abs(sum(w.values()) - 1) < 1e-12 and max(w.values()) <= 0.35 + 1e-12
    two = spark.createDataFrame([("A", 0.1), ("B", 0.2)], "ticker string, vol double")
    assert {r.weight for r in G.inverse_vol_budget(two, 0.35).collect()} == {0.35}


def test_min_edge_ignores_a_missing_calibration(spark):
    df = spark.createDataFrame([(3.0, 7.0, None), (3.0, 7.0, 30.0), (3.0, 7.0, 99.0)], "r double, f double, c double")
    got = [r.e for r in df.select(S.min_edge("r", "f", F.col("c")).alias("e")).collect()]
    assert got == [7.0, 30.0, 60.0]


def test_cross_ranks_of_large_times_are_the_same(spark):
    from tapeloom.operators.audits import cross_rank

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"ts": np.repeat([1, 2, 3], [50, 200, 5]), "x": rng.integers(0, 40, 255).astype(float)})
    pdf.loc[::9, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    key = lambda d: sorted((r.ts, -1 if r.x is None else r.x, round(r.rank, 9) if r.rank is not None else None) for r in d.collect())
    assert key(cross_rank(df, {"rank": "x"}, limit=60)) == key(cross_rank(df, {"rank": "x"}))


def test_short_series_fall_back_to_the_first_horizon(spark):
    from tapeloom.operators import labels as L

    pdf = walk(90)
    got = L.balanced_labels(spark.createDataFrame(pdf).select("ticker", "ts", "close"), (5, 10), Layout(bucket=86400, rows=700)).toPandas()
    assert len(got) == 90 and set(got.horizon) == {5} and set(got.threshold) == {0.0}


def test_panel_moves_only_what_is_asked_for(spark):
    """Ranks, costs and regimes per ticker and time, a row per spec, and no column is carried
    along that nobody reads."""
    pdf = pd.concat([walk(150, i, t) for i, t in enumerate("ABC")])
    bars = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spec = spark.createDataFrame([("A", 12, "positive", 40.0, 45.0), ("B", 12, "triple_barrier", 40.0, 45.0), ("B", 24, "after_costs", 30.0, 45.0), ("C", 24, "after_costs", 40.0, 45.0)], "ticker string, horizon int, label_type string, threshold_bps double, stop_bps double")
    dim = spark.createDataFrame([("A", "x", 5.0), ("B", "y", 6.0)], "ticker string, asset_class string, round_trip_bps double")
    regime = bars.where(F.minute("ts") == 0).select("ticker", "ts", F.col("close").alias("level"))
    d = PN.build_panel(bars, spec, dim, regime, ["level"], max_h=24)
    few = d.select("ticker", "ts", "horizon", "ret_12", "ret_12_cs_rank", "round_trip_bps", "level")
    assert "macd_hist" not in few._jdf.queryExecution().executedPlan().toString()
    got = few.toPandas().sort_values(["ticker", "ts", "horizon"], ignore_index=True)
    assert got.groupby(["ticker", "horizon"]).size().to_dict() == {("A", 12): 114, ("B", 12): 114, ("B", 24): 114, ("C", 24): 114}
    assert np.allclose(got["ret_12_cs_rank"], got.groupby("ts")["ret_12"].rank(pct=True))
    assert got.groupby("ticker")["round_trip_bps"].first().to_dict()["B"] == 6.0 and got.loc[got["ticker"] == "C", "round_trip_bps"].isna().all()
    known = pdf[pdf["ts"].dt.minute == 0].set_index(["ticker", "ts"])["close"]
    assert [known[t, s.floor("h")] for t, s in zip(got["ticker"], got["ts"])] == got["level"].tolist()


def test_legacy_labels_skip_nulls_ahead_and_need_no_window_frames(spark):
    pdf = walk(260, 5)
    pdf.loc[[40, 41, 100], "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None)))
    for rows in (64, 65536):
        lay = Layout(bucket=3600, rows=rows)
        d = in_blocks(df, L.legacy_labels, ahead=96, lay=lay)
        assert "collect_list" not in d._jdf.queryExecution().optimizedPlan().toString()
        got = d.toPandas().sort_values("ts", ignore_index=True)
        c = pdf["close"].to_numpy()
        for i in range(len(c)):
            for h in (20, 48, 96):
                future = c[i + 1 : i + 1 + h]
                future = future[~np.isnan(future)]
                want = [np.nan] * 2 if not len(future) else [0.0] * 2 if np.isnan(c[i]) else [max(0.0, -(future.min() / c[i] - 1)), max(0.0, future.max() / c[i] - 1)]
                assert np.allclose(got.loc[i, [f"mae_{h}", f"mfe_{h}"]].astype(float), want, equal_nan=True)
            future = c[i + 1 : i + 21]
            step = future[~np.isnan(future)] / c[i] - 1
            hit = np.flatnonzero((step >= 5.2e-4) | (step <= -45e-4))
            want = float(step[hit[0]] > 0) if len(hit) else 0.0 if len(step) >= 20 else np.nan
            assert np.isclose(got.loc[i, "label_barrier_20"], want, equal_nan=True)
            later = c[i + 12] / c[i] - 1 if i + 12 < len(c) else np.nan
            assert np.isclose(got.loc[i, "fwd_ret_12"], later, equal_nan=True) and got.loc[i, "label_12_positive"] == int(later > 0)


def test_weights_work_the_signal_frame_once(spark):
    """The totals per time read stored rows, not the plan behind the signal frame again."""
    from pyspark.sql import Window

    from tapeloom.catalog import signals

    rows = [(t, f"2024-01-0{d}", s, 50.0 + 10 * i, 0.2) for d in (1, 2) for i, (t, s) in enumerate((("A", 1), ("B", -1), ("C", 1), ("D", 0)))]
    frame = spark.createDataFrame(rows, "ticker string, day string, position_side int, score double, vol_ann double")
    frame = frame.withColumns({"ts": F.col("day").cast("timestamp_ntz"), "_n": F.row_number().over(Window.partitionBy("ticker").orderBy("day"))}).where("_n > 0")
    w = signals.weights(spark, "", frame)
    assert "Window" not in w._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.ticker, r.ts.day): r.weight for r in w.collect()}
    assert set(got) == {(t, d) for t in "ABC" for d in (1, 2)}
    for d in (1, 2):  # three names of near equal weight, each above the cap of a fifth
        assert [round(got[t, d], 9) for t in "ABC"] == [0.2, -0.2, 0.2]


def test_signal_frame_works_each_score_once(spark, tmp_path):
    """The plan of the exits and sides reads the scores; it does not hold their expressions."""
    from tapeloom.catalog import signals

    spark.createDataFrame([(1, 0, 100.0), (2, 0, 9000.0)], "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    days = pd.concat([walk(30, i, t) for i, t in enumerate(("S1", "S2"))]).assign(ts=pd.concat([walk(30)["ts"]] * 2) + pd.to_timedelta(np.tile(np.arange(30), 2), unit="D"))
    days = spark.createDataFrame(days).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    d = signals.signal_frame(spark, str(tmp_path), days)
    assert "ascii(" not in d._jdf.queryExecution().optimizedPlan().toString()
    got = d.toPandas()
    assert len(got) == 60 and set(got["ticker"]) == {"S1", "S2"} and got["position_side"].isin([-1, 0, 1]).all()
    assert np.allclose(got["score"], np.clip(got["proba"] * 100, 0, 100))


def test_long_frames_are_those_of_the_windows(spark):
    from tapeloom.operators.blocks import block_frame, finish_blocks

    rng = np.random.default_rng(21)
    rows = []
    for t, n in (("A", 260), ("B", 9)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        close[5:9] = close[4]
        for i, day in enumerate(pd.date_range("2023-01-01", periods=n, freq="D")):
            gone = lambda v: None if rng.random() < 0.05 else float(v)
            rows.append((t, day.to_pydatetime(), gone(close[i]), gone(close[i] * 1.01), gone(close[i] * 0.99), gone(rng.integers(0, 9)), gone(rng.normal()), t == "B"))
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, close double, high double, low double, volume double, vol_imbalance double, _mostly_flat boolean")
    lay = Layout(bucket=20 * 86400, rows=130)
    frame, w = block_frame(d, back=X.MACD_BACK, lay=lay)
    got = {(r.ticker, r.ts): r for r in finish_blocks(X.long_frames(frame, w)).collect()}
    want, w = block_frame(d, back=X.MACD_BACK, lay=lay)
    want = X.macd_hist(want, w).repartition("ticker", "_blk")
    for f in (X.returns, X.imbalance_stats, X.with_rsi, X.trend_efficiency, X.return_autocorrelation, X.range_z, X.vol_of_vol, X.distances):
        want = f(want, w)
    want = want.withColumn("vol_realized_12", X.rstd("ret_1", w, 12, 4)).withColumn("garch_cond_vol", F.col("vol_realized_12"))
    want = want.withColumn("_med", X.rmedian("garch_cond_vol", w, 48, 12))
    want = finish_blocks(want).collect()
    assert len(want) == len(got) == len(rows)
    for r in want:
        for c in X.LONG_FRAMES:
            a, b = r[c], got[r.ticker, r.ts][c]
            assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-12, atol=1e-12)), (r.ticker, r.ts, c, a, b)


def test_barrier_targets_are_those_of_the_windows(spark):
    from tapeloom.operators.blocks import block_frame, finish_blocks

    rng = np.random.default_rng(4)
    rows = []
    for t, n in (("A", 230), ("B", 7), ("C", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.006, n)))
        rows += [(t, day.to_pydatetime(), None if t == "A" and rng.random() < 0.1 else float(c)) for day, c in zip(pd.date_range("2023-01-01", periods=n, freq="D"), close)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, close double")
    names = ("fwd_ret", "label_long", "label_short", "label_direction", "target_tp_bps", "target_sl_bps")
    frame, w = block_frame(d, ahead=12, lay=Layout(bucket=20 * 86400, rows=100))
    found = finish_blocks(L.barrier_targets(frame, 12, 120.0, 110.0))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {(r.ticker, r.ts): r for r in found.collect()}
    want = L.excursion_targets(L.barrier_labels(frame, w, 12, 120.0, 110.0), w, 12).withColumn("fwd_ret", L.forward_return(w, 12))
    want = finish_blocks(want).collect()
    assert len(want) == len(got) == len(rows)
    for r in want:
        assert all(r[c] == got[r.ticker, r.ts][c] for c in names), r
