"""Day upserts and folded stream epochs: replays, crashes, untouched partitions."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import store
from tapeloom.streaming import streams as T


def made(spark, days, price):
    return spark.sql(f"select t as ticker, timestampadd(HOUR, h, d) as ts from (select explode(array({', '.join(f'timestamp_ntz {chr(39)}2024-01-{x:02d} 00:00:00{chr(39)}' for x in days)})) as d), (select explode(sequence(0, 23)) as h), (select explode(array('A', 'B', null)) as t)").withColumns(
        {c: F.lit(float(price)) for c in ("open", "high", "low", "close", "volume")}
    )


def files(path):
    return {str(p.relative_to(path)): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}


def state(spark, path):
    return sorted((str(r.ticker), r.ts, r.close) for r in store.load_days(spark, path).collect())


def test_upsert_rewrites_only_its_days(spark, monkeypatch):
    path = store.scratch(spark) + "/bars"
    store.upsert_days(spark, path, made(spark, (1, 2, 3, 5), 1))
    before = files(path)
    day = made(spark, (2, 5), 2).where("hour(ts) >= 12")
    store.upsert_days(spark, path, day)
    after = files(path)
    same = {k for k in before if before[k] == after.get(k)}
    assert {k.split("/")[0] for k in same} == {"day=2024-01-01", "day=2024-01-03"} and len(same) == sum(k.split("/")[0] in ("day=2024-01-01", "day=2024-01-03") for k in before)
    got = state(spark, path)
    assert len(got) == 4 * 24 * 3 and sum(c == 2 for *_, c in got) == 2 * 12 * 3
    store.upsert_days(spark, path, day)  # a replay changes nothing
    assert state(spark, path) == got
    store.upsert_days(spark, path, day.where("false"))
    assert state(spark, path) == got

    def dies(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_replacing", dies)
        with pytest.raises(RuntimeError):
            store.upsert_days(spark, path, made(spark, (3, 9), 7))
    assert state(spark, path) == got
    twice = made(spark, (3, 9), 6).withColumn("n", F.lit(0)).unionByName(made(spark, (3, 9), 7).withColumn("n", F.lit(1)))
    store.upsert_days(spark, path, twice, order=("n",))
    got = state(spark, path)
    assert len(got) == 5 * 24 * 3 and sum(c == 7 for *_, c in got) == 2 * 24 * 3 and not any(c == 6 for *_, c in got)


def test_folded_epochs(spark):
    path = store.scratch(spark)
    schema = "k string, v long, n long"

    def land(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/in")
        T.ingest_keep_last(spark.readStream.schema(schema).parquet(f"{path}/in"), path, ["k"], ["n"])

    def now(by_order):
        return sorted((tuple(r) for r in T.read_keep_last(spark, path, ["k"], ["n"], by_order).select("k", "v", "n").collect()), key=str)

    land([("a", 1, 5), ("b", 1, 5), (None, 1, 1)])
    land([("a", 2, 4), ("c", 2, 6)])
    late, ordered = now(False), now(True)
    assert ("a", 2, 4) in late and ("a", 1, 5) in ordered
    T.compact_keep_last(spark, path, ["k"], ["n"])
    assert now(False) == late
    T.compact_keep_last(spark, path, ["k"], ["n"])  # nothing new: nothing done
    assert spark.read.parquet(f"{path}/compacted").count() == 1
    # a folded epoch that is written again is not read, a table no manifest names neither
    spark.createDataFrame([("a", 9, 9)], schema).write.mode("overwrite").parquet(f"{path}/rows/epoch=0")
    spark.createDataFrame([("a", 9, 9)], schema).write.parquet(f"{path}/upto-99-lost")
    assert now(False) == late
    land([("b", 3, 1)])
    assert ("b", 3, 1) in now(False)
    T.compact_keep_last(spark, path, ["k"], ["n"])
    assert spark.read.parquet(f"{path}/compacted").count() == 2 and ("b", 3, 1) in now(False) and len(now(False)) == 4
