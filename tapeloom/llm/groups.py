"""Exact joins inside candidate clusters, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(members: DataFrame, cluster: str, spread: str, limit: int, weight: str | None = None) -> DataFrame:
    """Give the rows of each cluster their place (_g blocks, block _own): a cluster of up to
    ``limit`` rows (or ``weight``) is one block, a larger one is cut by the hash ``spread``
    into blocks of about ``limit``."""
    total = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = members.groupBy(cluster).agg(F.greatest(F.ceil(total / limit), F.lit(1)).cast("int").alias("_g"))
    return members.join(sizes, cluster).withColumn("_own", F.pmod(F.col(spread), F.col("_g")).cast("int"))


def dealt(rows: DataFrame, cluster: str) -> DataFrame:
    """Deal placed rows to groups (_c, _i, _j), one for every two blocks of a cluster, so
    that every two rows of a cluster meet in a group of at most about 2 * limit rows."""
    d = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return d.withColumns({"_c": F.col(cluster), "_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_g", "_own", "_other")


def each_group(rows: DataFrame, columns: list[str], work: Callable[[list[list]], Iterator[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Run ``work`` on the columns of every group (_c, _i, _j), one group in memory at a time."""
    ordered = rows.select("_c", "_i", "_j", *columns).repartition("_c", "_i", "_j").sortWithinPartitions("_c", "_i", "_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [[] for _ in columns], []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            values = [b.column(i + 3).to_pylist() for i in range(len(columns))]
            at = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[at]:
                    continue
                if keys[at] != key:
                    if len(held[0]) > 1:
                        out.extend(work(held))
                    key, held = keys[at], [[] for _ in columns]
                for h, v in zip(held, values):
                    h.extend(v[at:k])
                at = k
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                out = []
        if len(held[0]) > 1:
            out.extend(work(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return ordered.mapInArrow(run, schema)


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def stars(self) -> Iterator[tuple[int, int]]:
        for x in range(len(self.up)):
            if (r := self.find(x)) != x:
                yield r, x
