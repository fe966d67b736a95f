"""Walk-forward chain: stored stages are made once, labels end before the day they are known."""

import os
from datetime import date
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators.blocks import Layout
from tapeloom.plans import folds as FC
from tapeloom.plans import targets as TG
from tapeloom.sources.store import scratch, stage

LAY = Layout(bucket=200 * 86400)
GRID = TG.Grid(horizons=(2, 5), types=("after_costs",), mults=(1.0,))


def made(spark, n=800, tickers="AB"):
    rng = np.random.default_rng(12)
    parts = []
    for t in tickers:
        x = rng.normal(size=n)
        close = 100 * np.exp(np.cumsum(0.004 * np.roll(x, 1) + rng.normal(0, 0.004, n)))
        parts.append(pd.DataFrame({"ticker": t, "ts": pd.date_range("2021-01-01", periods=n, freq="D"), "close": close, "x": x, "cost_floor_bps": 20.0, "stop_bps": 45.0, "round_trip_bps": 10.0}))
    d = spark.createDataFrame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return stage(TG.labelled(d, GRID, LAY).drop("direction"))


def files(path):
    return {str(p.relative_to(path)): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_labels_known_by_a_day(spark):
    d = FC.known_by(made(spark, 40, "A"), date(2021, 1, 20), GRID).toPandas().sort_values("ts")
    for i, (h, _, _) in enumerate(GRID.candidates):
        known = d.ts + pd.Timedelta(days=h) < pd.Timestamp("2021-01-20")
        assert (d.fwd.map(lambda v, j=GRID.horizons.index(h): pd.notna(v[j])) == known).all()
        assert (d.entry.map(lambda v, i=i: pd.notna(v[i])) == known).all()


def test_store_makes_only_what_is_not_whole(spark):
    root = scratch(spark)
    store = FC.FoldStore(spark, root, {"a": 1})
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    assert store.table(0, "target", make).count() == 5 and store.table(0, "target", make).count() == 5 and len(calls) == 1
    before = files(root)
    # a stage without its marker was cut off: it is made again, the others are left alone
    spark.range(2).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(store.path(1, "target"))
    again = FC.FoldStore(spark, root, {"a": 1})
    assert not again.done(1, "target") and again.table(1, "target", make).count() == 5 and len(calls) == 2
    after = files(root)
    assert all(after[k] == t for k, t in before.items())
    with pytest.raises(ValueError):
        FC.FoldStore(spark, root, {"a": 2})
