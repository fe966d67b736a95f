"""Block, running, as-of and order-statistic helpers against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators.asof import asof_join
from tapeloom.operators.blocks import Layout, in_blocks, running, with_position
from tapeloom.operators.spread import average_ranks, quantiles, value_positions


def series(seed=0, n=400):
    rng = np.random.default_rng(seed)
    parts = []
    for name, size in (("HOT", n), ("B", n // 8), ("ONE", 1)):
        minutes = np.sort(rng.choice(n * 6, size=size, replace=False))
        x = np.round(rng.normal(size=size), 1)
        x[rng.random(size) < 0.2] = np.nan
        parts.append(pd.DataFrame({
            "ticker": name, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes * 5, unit="min"), "x": x}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    for c, t in df.dtypes:
        if t == "double":
            df = df.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
    return df


@pytest.mark.parametrize("rows,back,ahead", [(64, 30, 0), (16, 50, 0), (64, 0, 20), (16, 11, 40), (8, 3, 70), (4096, 5, 5)])
def test_blocks_equal_whole_windows(spark, rows, back, ahead):
    pdf = series()
    lay = Layout(bucket=3 * 3600, rows=rows)
    got = in_blocks(
        to_spark(spark, pdf),
        lambda d, w: d.withColumn("s", F.sum("x").over(w.rowsBetween(-back, ahead)))
        .withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(-back, ahead)))
        .withColumn("pos", F.col("_pos")),
        back=back, ahead=ahead, lay=lay,
    ).toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    assert len(got) == len(pdf)
    for t, g in pdf.groupby("ticker"):
        x = g.x.to_numpy()
        mine = got[got.ticker == t]
        for i in range(len(x)):
            win = x[max(0, i - back): i + ahead + 1]
            row = mine.iloc[i]
            assert row.n == len(win) and row.pos == i
            want = np.nansum(win) if np.isfinite(win).any() else np.nan
            assert (np.isnan(row.s) and np.isnan(want)) or abs(row.s - want) < 1e-9


def test_running(spark):
    pdf = series(1)
    lay = Layout(bucket=3 * 3600)
    got = running(to_spark(spark, pdf), {
        "s": ("sum", F.col("x")), "c": ("count", F.col("x")), "mx": ("max", F.col("x")),
        "mn": ("min", F.col("x")), "la": ("last", F.col("x")), "fi": ("first", F.col("x"))}, lay,
    ).toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    for t, g in pdf.groupby("ticker"):
        m = got[got.ticker == t].reset_index(drop=True)
        x = g.x.reset_index(drop=True)
        pd.testing.assert_series_equal(m.la, x.ffill(), check_names=False)
        pd.testing.assert_series_equal(m.s, x.cumsum().ffill(), check_names=False)
        pd.testing.assert_series_equal(m.mx, x.cummax().ffill(), check_names=False)
        pd.testing.assert_series_equal(m.mn, x.cummin().ffill(), check_names=False)
        assert (m.c == x.notna().cumsum()).all()


@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, forward):
    left, right = series(2), series(3, 100).rename(columns={"x": "y"})
    right["y"] = np.arange(len(right), dtype=float)
    lay = Layout(bucket=5 * 3600)
    got = asof_join(to_spark(spark, left), to_spark(spark, right), ["y"], forward=forward, lay=lay).toPandas()
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="ticker",
                         direction="forward" if forward else "backward")
    key = ["ticker", "ts"]
    pd.testing.assert_frame_equal(
        got.sort_values(key).reset_index(drop=True)[key + ["y"]].astype({"ts": "datetime64[ns]"}),
        want.sort_values(key).reset_index(drop=True)[key + ["y"]], check_dtype=False)


def test_ranks_and_quantiles(spark):
    pdf = series(4)
    df = to_spark(spark, pdf)
    r = average_ranks(df, ["ticker"], "x", "r").toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    want = pdf.sort_values(["ticker", "ts"]).reset_index(drop=True)
    pd.testing.assert_series_equal(r.r, want.groupby("ticker").x.rank(), check_names=False)
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}
    q = quantiles(df, ["ticker"], "x", qs).toPandas().set_index("ticker")
    for t, g in pdf.groupby("ticker"):
        if g.x.notna().any():
            for n, p in qs.items():
                assert abs(q.loc[t, n] - g.x.quantile(p)) < 1e-12
    tot = value_positions(df, [], "x").agg(F.max(F.col("before") + F.col("cnt"))).first()[0]
    assert tot == pdf.x.notna().sum()


@pytest.mark.parametrize("rows", [3, 40, 100000])
def test_positions_over_many_pieces(spark, rows):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": ["HOT"] * 3000 + ["S"] * 5, "x": np.r_[np.round(rng.normal(size=2000), 2), np.zeros(1000), rng.random(5)]})
    got = value_positions(spark.createDataFrame(pdf), ["k"], "x", rows).toPandas()
    for k, g in pdf.groupby("k"):
        mine = got[got.k == k].sort_values("x")
        n = g.x.value_counts().sort_index()
        assert (mine.cnt.to_numpy() == n.to_numpy()).all() and (mine.total == len(g)).all()
        assert (mine.before.to_numpy() == np.r_[0, n.cumsum().to_numpy()[:-1]]).all()


def test_position(spark):
    pdf = series(5)
    got = with_position(to_spark(spark, pdf), lay=Layout(bucket=3600, rows=10)).toPandas()
    got = got.sort_values(["ticker", "ts"])
    assert (got.pos == got.groupby("ticker").cumcount()).all()


def test_series_of_one_block_are_shuffled_once(spark):
    from tapeloom.operators.blocks import Layout, in_blocks

    n = 400
    ts = pd.date_range("2020-01-01", periods=n, freq="D")
    rows = [(k, t.to_pydatetime(), float(i)) for k, m in (("A", n), ("B", 50), (None, 3)) for i, t in enumerate(ts[:m])]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, x double")
    beside = spark.createDataFrame([("A", 1), ("C", 2)], "ticker string, own int")
    fn = lambda x, w: x.withColumns({"p": F.col("_pos"), "s": F.sum("x").over(w.rowsBetween(-5, 3))})
    whole = in_blocks(d, fn, back=5, ahead=3, lay=Layout(bucket=30 * 86400))
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert in_blocks(d, fn, back=5, ahead=3, lay=Layout(bucket=30 * 86400), beside=beside).select("ticker", "own").distinct().collect() == [("A", 1)]
    # A is several blocks here, B one
    parts = in_blocks(d, fn, back=5, ahead=3, lay=Layout(bucket=30 * 86400, rows=100), beside=beside.union(spark.createDataFrame([("B", 3)], beside.schema)))
    rows = lambda x: sorted(x.select("ticker", "ts", "x", "p", "s").collect())
    assert rows(whole) == rows(parts) and len(rows(whole)) == n + 50
