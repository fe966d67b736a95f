"""Sharding by rendezvous hashing: each key takes the shard with its best weighted score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage

#: Distinct rows that one window of slots holds about.
BUCKET_ROWS = 100_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: the index with the least -ln(u) / weight, where u is the hash of
    (key, index) in (0, 1).  A further shard, or a larger weight, takes keys only into
    itself, and each shard's share follows its weight.  A null key hashes like any other."""
    scores = []
    for i, weight in enumerate(weights):
        # 52 bits of the hash, moved off both ends, are exact in a double
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 12).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("s"), F.lit(i).alias("i")))
    return F.least(*scores)["i"] if len(scores) > 1 else F.lit(0)


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Equal rows are counted first and spread out again at the end, so many copies of a row
    never meet in one window.  Distinct rows are dealt into hash buckets of about
    BUCKET_ROWS; a small table of bucket totals gives each bucket its first slot.
    """
    cols = rows.columns
    counted = stage(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64(*cols)))
    per_shard = max(1, counted.count() // BUCKET_ROWS)  # more buckets than needed: per shard
    counted = counted.withColumn("_b", F.pmod("_h", F.lit(per_shard)))
    totals = counted.groupBy(shard, "_b").agg(F.sum("_n").alias("_t"))
    before = W.partitionBy(shard).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    first = totals.select(shard, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy(shard, "_b").orderBy("_h", *[c for c in cols if c != shard]).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(first, [shard, "_b"])
    start = F.col("_first") + F.col("_in")
    return placed.select(*cols, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", new_weight: float = 1.0) -> DataFrame:
    """One row per input row: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (gapless in its shard), ``grown_shard`` (with one more shard).

    Only the id and the number and weights of shards decide.  A null text has size 1 and
    the checksum of the empty text; rows with a null id share one shard; repeated rows get
    slots of their own; an empty table gives an empty table; other columns are not read.
    """
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        key.alias(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).cast("int").alias("shard"),
        rendezvous(key, [*weights, new_weight]).cast("int").alias("grown_shard"),
    )
    slots = with_slots(rows)
    return slots.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
