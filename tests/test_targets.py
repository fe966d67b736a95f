"""Label search: labels against the per-spec operator, bin metrics against plain sums."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.operators import labels as L
from tapeloom.operators.blocks import Layout
from tapeloom.plans import targets as TG

LAY = Layout(bucket=40 * 86400, rows=150)


def test_labels_of_all_candidates(spark):
    rng = np.random.default_rng(6)
    n = 260
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    d = spark.createDataFrame(pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="D"), "close": close, "cost_floor_bps": 60.0, "stop_bps": 45.0}))
    grid = TG.Grid(horizons=(6, 20), types=("triple_barrier", "after_costs", "positive"), mults=(1.0, 1.5))
    got = TG.labelled(d, grid, LAY).toPandas().sort_values("ts")
    for i, (h, kind, m) in enumerate(grid.candidates):
        spec = spark.createDataFrame([("A", h, kind, round(60.0 * m, 2), 45.0)], "ticker string, horizon int, label_type string, threshold_bps double, stop_bps double")
        want = L.spec_labels(d.drop("stop_bps"), spec, 20, LAY).toPandas().sort_values("ts")
        mine = lambda c: np.array([np.nan if v[i] is None else v[i] for v in got[c]])  # noqa: E731, B023
        np.testing.assert_array_equal(mine("entry"), want.label_entry.to_numpy(float))
        np.testing.assert_array_equal(mine("direction"), want.label_direction.to_numpy(float))
        j = grid.horizons.index(h)
        fwd = np.array([np.nan if v[j] is None else v[j] for v in got.fwd])
        np.testing.assert_allclose(fwd, want.fwd_ret_entry.to_numpy(float))


def test_bin_metrics(spark):
    rng = np.random.default_rng(7)
    b = np.sort(rng.integers(0, TG.BINS, 400))
    y, f = (rng.random(400) < b / TG.BINS).astype(float), rng.normal(0, 0.01, 400)
    d = pd.DataFrame({"k": "A", "bin": b.astype("int32"), "n": 1.0, "pos": y, "fn": 1.0, "fsum": f, "fsq": f**2}).groupby(["k", "bin"], as_index=False).sum()
    m = TG.bin_metrics(spark.createDataFrame(d), ["k"]).first()
    p = (b + 0.5) / TG.BINS
    hat = p >= max(0.5, y.mean())
    gt = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
    auc = gt[np.ix_(y > 0, y == 0)].mean()
    top = p >= np.quantile(p, 0.9)
    assert m.n == 400 and np.isclose(m.accuracy, (hat == y).mean()) and np.isclose(m.auc, auc)
    assert np.isclose(m.precision, y[hat].mean()) and np.isclose(m.recall, hat[y > 0].mean())
    assert np.isclose(m.edge_corr, np.corrcoef(p, f)[0, 1]) and np.isclose(m.gross_bps, f[top].mean() * 1e4)


def test_masks_end_before_the_test_block(spark):
    days = pd.date_range("2024-01-01", periods=40, freq="D")
    d = spark.createDataFrame(pd.DataFrame({"ts": days, "ends": [[(t + pd.Timedelta(days=5)).date()] for t in days]}), "ts timestamp, ends array<date>")
    bounds = TG.fold_bounds(d, 4)
    assert [(str(a), str(b)) for a, b in bounds] == [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-01-31"), ("2024-01-31", "2024-02-10")]
    rows = d.select("ts", TG.masks(bounds, 1, 2).alias("w"), TG.test_fold(bounds).alias("f")).orderBy("ts").collect()
    assert [r.f for r in rows] == [float(i // 10) for i in range(40)]
    second = [i for i, r in enumerate(rows) if r.w[1]]
    assert second == [*range(5), *range(22, 40)]  # labels end before day 10; two days' purge after day 19
    assert TG.fold_bounds(d.where(F.lit(False)), 4) == []


def test_labels_skip_missing_closes_and_are_worked_on_arrays(spark):
    rng = np.random.default_rng(9)
    n = 170
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    rows = [(t, d.to_pydatetime(), None if rng.random() < 0.1 else float(c), 60.0 if t == "A" else None, 45.0) for t, at in (("A", 0), ("B", 30)) for d, c in list(zip(pd.date_range("2024-01-01", periods=n, freq="D"), close))[at:]]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, close double, cost_floor_bps double, stop_bps double")
    grid = TG.Grid(horizons=(6, 20), types=("triple_barrier", "after_costs", "positive"), mults=(1.0, 1.5))
    found = TG.labelled(d, grid, LAY)
    assert "collect_list" not in found._jdf.queryExecution().toString()  # a list a row, gone over anew for each level
    got = {(r.ticker, r.ts): r for r in found.collect()}
    assert len(got) == len(rows)
    for t in "AB":
        mine = [r for r in rows if r[0] == t]
        for i, (_, ts, c, floor, stop) in enumerate(mine):
            path = [None if c is None else x / c - 1 for _, _, x, _, _ in mine[i + 1 : i + 21] if x is not None]
            r = got[t, ts]
            assert [e and e.isoformat() for e in r.ends] == [mine[i + h][1].date().isoformat() if i + h < len(mine) else None for h in grid.horizons]
            for v, h in zip(r.fwd, grid.horizons):
                assert v == (path[h - 1] if len(path) >= h else None)
            for k, (h, kind, m) in enumerate(grid.candidates):
                p, full = path[:h], len(path) >= h
                thr = None if floor is None else round(floor * m, 2) / 1e4
                first = lambda test: next((j for j, x in enumerate(p) if x is not None and test(x)), 99)
                up, dn = (99, 99) if thr is None else (first(lambda x: x >= thr), first(lambda x: x <= -thr))  # noqa: B023
                ups, dns = first(lambda x: x >= stop / 1e4), first(lambda x: x <= -stop / 1e4)  # noqa: B023
                long, short = up if up < dns else 99, dn if dn < ups else 99
                if kind == "triple_barrier":
                    entry = 1.0 if long < 99 else 0.0 if min(up, dns) < 99 or full else None
                    way = 1.0 if long < short else 2.0 if short < long else 0.0 if long < 99 or full else None
                else:
                    bar, f = 0.0 if kind == "positive" else thr, p[-1] if full else None
                    some = f is not None and bar is not None
                    entry = float(f > 0 if kind == "positive" else f >= bar) if some else None
                    way = (1.0 if some and (f > 0 or f == bar > 0) and f >= bar else 2.0 if some and f <= -bar and f < 0 else 0.0) if full else None
                assert (r.entry[k], r.direction[k]) == (entry, way), (t, i, h, kind, m)


def test_metrics_where_bins_are_counted_are_those_of_spark(spark):
    rng = np.random.default_rng(11)
    rows, mats = [], []
    for c in range(8):
        size = (400, 400, 30, 0, 60, 60, 55, 1)[c]
        b = rng.integers(0, TG.BINS, size) if c != 4 else np.full(size, 700)
        y = (rng.random(size) < 0.4).astype(float) if c != 5 else np.zeros(size)
        have, f = (rng.random(size) < 0.8).astype(float), rng.normal(0, 0.01, size)
        each = [np.bincount(b, weights=v, minlength=TG.BINS) for v in (np.ones(size), y, have, f * have, f * f * have)]
        mats.append(each)
        rows += [(c, int(i), *[float(v[i]) for v in each]) for i in np.flatnonzero(each[0])]
    bins = spark.createDataFrame(rows, "k int, bin int, n double, pos double, fn double, fsum double, fsq double")
    want = {r.k: r for r in TG.bin_metrics(bins, ["k"]).collect()}
    got = TG.measured(*[np.array([m[i] for m in mats]) for i in range(5)])
    assert sorted(want) == [c for c in range(8) if got["n"][c] > 0] == [0, 1, 2, 4, 5, 6, 7]
    for c, r in want.items():
        for name in TG.METRICS:
            w = getattr(r, name)
            assert np.isclose(got[name][c], np.nan if w is None else w, atol=1e-12, equal_nan=True), (c, name)


def test_entry_search_counts_short_tickers_without_bins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 420
    parts = []
    for t in "AB":
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        parts.append(pd.DataFrame({"ticker": t, "ts": pd.date_range("2022-01-01", periods=n, freq="D"), "close": close, "x": rng.normal(size=n), "cost_floor_bps": 60.0, "stop_bps": 45.0, "round_trip_bps": 5.0}))
    grid = TG.Grid(horizons=(6, 12), mults=(1.0,))
    d = TG.labelled(spark.createDataFrame(pd.concat(parts)), grid, Layout(bucket=400 * 86400))
    staged = []
    monkeypatch.setattr(TG, "stage", lambda df, real=TG.stage: staged.append((df.columns, real(df))) or staged[-1][1])
    found = lambda: sorted(TG.search_entry(d, ["x"], grid, bars_per_year=252.0).collect())
    one = found()
    assert [x.count() for c, x in staged if "bin" in c] == [0]
    monkeypatch.setattr(TG.GR, "BLOCK", 100)
    many = found()
    assert len(one) == len(many) == 8
    for a, b in zip(one, many):
        assert a[:2] == b[:2] and np.allclose([float(v) for v in a[2:7] if not isinstance(v, str)], [float(v) for v in b[2:7] if not isinstance(v, str)], atol=2e-4)
