"""Importance resampling towards a target: hashed word features, log-ratio weights, and a
draw of the best weights plus Gumbel noise (a weighted draw without replacement).

Features are hashed by CRC-32.  Distinct features are grouped by the length of their
bytes into matrices of bytes, one row a feature; all checksums of a matrix are updated
column by column, and the buckets are scattered back to the features' places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage

#: Bytes of a matrix' row; longer features are hashed in pieces of this width.
WIDTH = 4096
MEMO = 500_000  # entries of a task's memo of feature buckets
#: Characters of a text handled at once.
SLICE = 1 << 20
#: Eligible rows that one window of ranks holds about.
RANGE_ROWS = 100_000

_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _table()


def advance(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of their rows, column by column."""
    for column in rows.T:
        state = TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _over_zeros(state: int, basis: np.ndarray) -> int:
    """A state after WIDTH zero bytes: the map is linear in its 32 bits."""
    bits = np.nonzero((state >> np.arange(32)) & 1)[0]
    return int(np.bitwise_xor.reduce(basis[bits])) if len(bits) else 0


def crc32_all(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each feature, by matrices of features of equal length.

    A feature over WIDTH bytes is a head of the odd length and pieces of WIDTH bytes: the
    pieces are rows of one matrix, and since a checksum is linear, the states are joined
    by carrying the state so far over WIDTH zero bytes.
    """
    out = np.empty(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    heads = np.where(lengths > WIDTH, lengths % WIDTH, lengths)
    order = np.argsort(heads, kind="stable")
    at = np.flatnonzero(np.diff(heads[order], prepend=-1))
    for group in np.split(order, at[1:]):
        if not len(group):
            continue
        n = int(heads[group[0]])
        data = b"".join(features[i][:n] for i in group.tolist())
        rows = np.frombuffer(data, np.uint8).reshape(len(group), n)
        out[group] = advance(np.full(len(group), 0xFFFFFFFF, np.uint32), rows)
    basis = None
    for i in np.flatnonzero(lengths > WIDTH).tolist():
        if basis is None:
            basis = advance(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((32, WIDTH), np.uint8))
        rows = np.frombuffer(features[i], np.uint8, offset=int(heads[i])).reshape(-1, WIDTH)
        state = int(out[i])
        for piece in advance(np.zeros(len(rows), np.uint32), rows).tolist():
            state = _over_zeros(state, basis) ^ piece
        out[i] = state
    return out ^ np.uint32(0xFFFFFFFF)


class Buckets(dict):
    """Buckets of features (bytes), learned a batch at a time."""

    def __init__(self, n_buckets: int):
        self.n = n_buckets

    def of(self, features: list[bytes]) -> np.ndarray:
        new = [x for x in set(features) if x not in self]
        if new:
            if len(self) + len(new) > MEMO:
                self.clear()
                new = list(set(features))
            self.update(zip(new, (crc32_all(new) % np.uint32(self.n)).tolist()))
        return np.fromiter(map(self.__getitem__, features), np.int32, len(features))


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, a slice at a time: runs of digits, letters
    a to z and characters beyond ASCII.  A word over the end of a slice goes to the next."""
    rest = []
    for i in range(0, max(len(text), 1), SLICE):
        part = text[i : i + SLICE].encode().translate(_WORD)
        words = part.split()
        if rest and not part.startswith(b" ") and words:
            rest.append(words.pop(0))
            if not words and not part.endswith(b" "):
                continue  # a word longer than a slice
        if rest:
            words.insert(0, b"".join(rest))
            rest = []
        if words and part and not part.endswith(b" ") and i + SLICE < len(text):
            rest = [words.pop()]
        yield words
    if rest:
        yield [b"".join(rest)]


def buckets_of(text: str | None, most: int, buckets: Buckets) -> tuple[int, np.ndarray]:
    """(words, the bucket of each feature): runs of 1 to ``most`` consecutive words."""
    n, out, last = 0, [], []
    for words in words_of(text or ""):
        n += len(words)
        out.append(buckets.of(words))
        for k in range(2, most + 1):
            both = (last[-(k - 1) :] if last else []) + words
            out.append(buckets.of([b" ".join(both[i : i + k]) for i in range(len(both) - k + 1)]))
        if most > 1:
            last = (last + words)[-(most - 1) :]
    return n, np.concatenate(out) if out else np.empty(0, np.int32)


def hashed(docs: DataFrame, n_buckets: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, features): each row's feature buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(n_buckets)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, found = zip(*[buckets_of(x.as_py(), most, buckets) for x in part.column(1)])
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists], ["id", "n_words", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, features array<int>")


def counted(features: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, n) over all rows; each task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    return features.select("features").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """The gain of each bucket: 1000 times the log ratio of its shares in the target and in
    the documents, both with one more feature per bucket, floored.  Both tables have at
    most ``n_buckets`` rows, so the driver holds them."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for into, table in ((s, own), (t, target)):
        for bucket, n in table.collect():
            into[bucket] = n
    ratio = ((t + 1) * (s.sum() + n_buckets)) / ((s + 1) * (t.sum() + n_buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of a key, from the first 32 bits of the SHA-256 of ``seed:key``."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    u = (first + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, take: int, order: list[Column]) -> DataFrame:
    """Add ``rank`` 1..take in the given order, null beyond.

    Equal rows are counted first and spread out at the end.  The rows are dealt into ranges
    of the order, and a table of range sizes gives each range its first rank.
    """
    cols = rows.columns
    one = stage(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies")))
    n = one.count() // RANGE_ROWS + 1
    placed = stage(one.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.sum("_copies").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(sizes, "_range").withColumn("_at", F.col("_first") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)) + 1)
    each = placed.select(*cols, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_copies") - 1)).alias("_place"))
    return each.select(*cols, F.when(F.col("_place") <= take, F.col("_place")).cast("long").alias("rank"))


def importance_resample(
    docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, most: int = 1, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_features``, ``weight``, ``score``, ``rank``.

    The ``percent`` of the rows with at least ``min_words`` words that have the highest
    scores are drawn and ranked from 1, ties by the smaller id (a null id first); other
    rows have a null rank.  A null or empty text has no features and weight 0; rows with a
    null id share their noise; repeated rows are ranked each; an empty table gives an empty
    table; an empty target leaves counts of 0; other columns are not read.  Very long texts
    are read in slices, but the bucket numbers of one text are held at once.
    """
    spark = docs.sparkSession
    found = stage(hashed(docs, n_buckets, most, id_col, text_col))
    aim = hashed(target.select(F.lit(None).cast("long").alias("_none"), F.col(target_col).alias("_text")), n_buckets, most, "_none", "_text")
    gain = spark.sparkContext.broadcast(gains(counted(found, n_buckets), counted(aim, n_buckets), n_buckets))  # n_buckets numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            total = np.concatenate(([0], np.cumsum(gain.value[lists.flatten().to_numpy(zero_copy_only=False)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(total[ends[1:]] - total[ends[:-1]])], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = found.select("id", "n_words", "features").mapInArrow(weigh, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    rows = stage(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    fit = rows.where(F.col("n_words") >= min_words)
    take = fit.count() * percent // 100
    cols = ["id", "n_features", "weight", "score"]
    drawn = ranked(fit.select(*cols), take, [F.col("score").desc(), F.col("id").asc(), F.col("n_features").asc(), F.col("weight").asc()])
    rest = rows.where(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", id_col)
