"""Fingerprints of documents by closed syncmers.

A k-mer of characters is a closed syncmer if its least inner substring (s-mer, by hash)
lies at its start or its end.  That depends on the k-mer alone, so an edit moves no anchor
outside itself, and at least one in k - s + 1 neighbours is chosen.  A fingerprint holds
the ``keep`` chosen k-mers of least hash with the place of their first occurrence: a sample
by hash, comparable between any two texts.  Likeness chains the anchors that both samples
hold in the order of their places, so scattered chance matches count for little.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a k-mer and of its inner substrings, and anchors of a fingerprint.
K, S, KEEP = 8, 3, 48
#: Characters of a text handled at once.
SLICE = 1 << 20
#: Rows of a range of ids at least, and ranges of a task at most.
RANGE_ROWS, RANGES = 2000, 8
#: Bytes of texts that a task holds to combine equal rows.
HELD_BYTES = 32 << 20

_ANCHOR = np.dtype([("hash", "<u4"), ("at", "<u4")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` characters."""
    n = len(codes) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x100000001B3) + codes[i : i + n]
    return _mixed(total)


def syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the closed syncmers among the k-mers of a text."""
    if len(codes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inner = _windows(codes, s)
    n, last = len(codes) - k + 1, k - s
    least = inner[:n].copy()
    for i in range(1, last + 1):
        np.minimum(least, inner[i : i + n], out=least)
    at = np.flatnonzero((inner[:n] == least) | (inner[last : last + n] == least))
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = total * np.uint64(0x100000001B3) + codes[at + i]
    return _mixed(total), at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def fingerprint(text: str, k: int = K, s: int = S, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` anchors of least hash (all, if there are no more), by hash, each with the
    place of its first occurrence.  A text too short to hold a syncmer is one anchor itself."""
    best = np.empty(0, _ANCHOR)
    for start in range(0, max(len(text), 1), SLICE):
        part = text[start : start + SLICE + k - 1]
        codes = _codes(part)
        hashes, at = syncmers(codes, k, s)
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        if len(hashes) > 16 * keep:  # only the least can stay; more where copies crowd them
            few = hashes <= np.partition(hashes, 8 * keep)[8 * keep]
            if len(np.unique(hashes[few])) > keep:
                hashes, at = hashes[few], at[few]
        found = np.empty(len(hashes), _ANCHOR)
        found["hash"], found["at"] = hashes, np.minimum(at + start, 0xFFFFFFFF)
        both = np.concatenate([best, found])
        _, first = np.unique(both["hash"], return_index=True)
        best = both[first[:keep]]
    if text and not len(best):
        best = np.array([(int(_windows(_codes(text), len(text))[0] >> np.uint64(32)), 0)], _ANCHOR)
    return best


def shown(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.tobytes()).decode()


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _ANCHOR)


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Shared anchors in order, over the mean number of anchors, as far as both samples
    reach: 1 for equal fingerprints (two empty ones too), 0 where nothing is shared."""
    reach = min(int(x["hash"][-1]) if len(x) >= keep else 0xFFFFFFFF for x in (a, b))
    a, b = a[: np.searchsorted(a["hash"], reach, "right")], b[: np.searchsorted(b["hash"], reach, "right")]
    if not len(a) + len(b):
        return 1.0
    _, i, j = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    order = np.lexsort((b["at"][j], a["at"][i]))
    ends: list[int] = []  # least last place of a chain of each length
    for place in b["at"][j][order].tolist():
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return 2.0 * len(ends) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(docs: DataFrame, id_col: str, tasks: int) -> tuple[np.ndarray, int]:
    """Upper ids of the ranges (an id with many rows several times) and the ranges of null
    ids; tasks get several ranges each, so that they are evenly filled."""
    n, nulls = docs.agg(F.count(id_col), F.count_if(F.col(id_col).isNull())).first()
    rows = max(RANGE_ROWS, (n + nulls) // (RANGES * tasks))
    k = n // rows
    cuts = []
    if k:
        shares = F.array(*[F.lit(i / (k + 1)) for i in range(1, k + 1)])
        cuts = docs.agg(F.percentile_approx(id_col, shares, F.lit(max(10_000, 20 * k)))).first()[0] or []
    return np.array(cuts, np.int64), nulls // rows + 1


def ranges(ids: pa.Array, hashes: np.ndarray, cuts: np.ndarray, for_null: int) -> np.ndarray:
    """The range of each row in the order (null ids first, id, hash).  Null ids, and an id
    that is a cut several times, are spread over ranges by the order of the hash."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    width = np.where(null, for_null, np.maximum(high - low, 1))
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    inside = np.minimum((share * width).astype(np.int64), width - 1)
    return np.where(null, inside, for_null + low + inside)


class Side:
    """A document met in order, with its fingerprint made once."""

    def __init__(self, key, text: str):
        self.key, self.text, self.anchors = key, text, fingerprint(text)

    def row(self, following: Side) -> tuple:
        text = edited(self.text, following.text)
        anchors = fingerprint(text)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return self.key, len(self.text), sha, shown(self.anchors), shown(anchors), likeness(self.anchors, anchors), likeness(self.anchors, following.anchors)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the next by ascending integer id, null ids first, equal ids by the
    64-bit hash of the text; after the last comes the first.  A null text counts as empty;
    two empty texts are alike (1.0); repeated rows each get their row and are each other's
    next; a single document is its own next; an empty table gives an empty table; other
    columns are not read.

    Ids are dealt into ranges; the texts travel once, compressed.  Each range also gets
    the first document of the next one, so ranges are done on their own.  Rows equal in id
    and text are combined before they travel.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("id", F.xxhash64("t").alias("h"), "t")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts, for_null = _cuts(d, "id", tasks)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple] = {}
        for b in batches:
            where = ranges(b.column(0), b.column(1).to_numpy(), cuts, for_null)
            order = np.lexsort((b.column(1).to_numpy(), b.column(0).fill_null(0).to_numpy(zero_copy_only=False), where))
            _, at = np.unique(where[order], return_index=True)
            for i in order[at].tolist():
                key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                w = int(where[i])
                first[w] = min(first.get(w, key), key, key=lambda x: (x[0] or 0, x[1]))
        rows = [(w, *k) for w, k in first.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["r", "id", "h"])

    firsts = d.select("id", "h").mapInArrow(least, "r bigint, id bigint, h bigint").groupBy("r").agg(F.min(F.struct("id", "h")).alias("k"))
    heads = sorted((r.r, (r.k.id, r.k.h)) for r in firsts.collect())  # one row per range
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        held: dict[tuple, list] = {}
        size = 0

        def rows():
            out = []
            for (key, h), (w, data, n) in held.items():
                out.append((w, False, key, h, n, data))
                if (key, h) in before:
                    out.append((before[key, h], True, key, h, 1, data))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["r", "last", "id", "h", "n", "t"])

        for b in batches:
            where = ranges(b.column(0), b.column(1).to_numpy(), cuts, for_null).tolist()
            for w, key, h, text in zip(where, b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                found = held.get((key, h))
                if found:
                    found[2] += 1
                    continue
                held[key, h] = [w, packer.compress(text.as_py()), 1]
                size += len(held[key, h][1]) + 200
                if size > HELD_BYTES:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        now, at, copies, out = None, None, 0, []
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for b in batches:
            for w, last, key, h, n, data in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5)):
                if now is not None and at == (w, key, h) and not last:
                    copies += n
                    continue
                if last and now is None:
                    continue  # a further copy of the next range's first row
                following = Side(key, opener.decompress(data.as_py()).decode())
                if now is not None:
                    if copies > 1:
                        same = now.row(now)
                        for _ in range(copies - 1):
                            out.append(same)
                            if len(out) >= 2048:
                                yield batch()
                                out = []
                    out.append(now.row(following))
                now, at, copies = (None, None, 0) if last else (following, (w, key, h), n)
                if len(out) >= 512:
                    yield batch()
                    out = []
        if out:
            yield batch()

    placed = d.mapInArrow(place, "r bigint, last boolean, id bigint, h bigint, n bigint, t binary")
    ordered = placed.repartition(tasks, "r").sortWithinPartitions("r", "last", "id", "h")
    found = ordered.mapInArrow(compare, f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn(id_col, F.col(id_col).cast(kind))
