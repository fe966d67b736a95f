"""Packing by cutting-stock column generation.

Texts become ids, cut into pieces of at most ``capacity`` ids.  The histogram of piece
lengths, in classes of GRAIN ids, is all the plan needs: a linear program over patterns
(which classes share a sequence), its columns priced by a knapsack recursion, solved on
the driver at a cost that depends on the classes and not on the documents.  Rounded
patterns are dealt to the pieces by their rank within their class.  The worst-filled
patterns are taken apart again, and their pieces, cut at multiples of GRAIN, fill the
gaps of the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage
from .pieces import id_pieces, ids_of
from .sharding import with_slots

CAPACITY, GRAIN = 2048, 16
#: A gap is filled with cut pieces from so many grains on.
MIN_GAP = 2
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, blocks array<bigint>"


@dataclass
class Pattern:
    """``items``: how many pieces of each class (size in grains); ``n``: how many sequences."""

    items: dict[int, int]
    n: int

    @property
    def used(self) -> int:
        return sum(size * k for size, k in self.items.items())


def knapsack(prices: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The dearest multiset of sizes 1..room that fits; ``prices[s]`` is the price of size s."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        gains = best[c - 1 :: -1] + prices[1 : c + 1]  # size s leaves c - s
        s = int(gains.argmax())
        best[c], took[c] = (gains[s], s + 1) if gains[s] > best[c - 1] else (best[c - 1], 0)
    items: dict[int, int] = {}
    c = room
    while c > 0:
        s = int(took[c])
        if s:
            items[s] = items.get(s, 0) + 1
        c -= s or 1
    return float(best[room]), items


def columns(demand: dict[int, int], room: int) -> list[Pattern]:
    """Patterns that cover the demand exactly: the linear program's, rounded down, then
    the rest by filling sequences from the largest size on."""
    sizes = sorted(s for s, d in demand.items() if d)
    if not sizes:
        return []
    m, row = len(sizes), {s: i for i, s in enumerate(sizes)}
    basis = [{s: room // s} for s in sizes]
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    x = inverse @ np.array([demand[s] for s in sizes], float)
    for _ in range(50 * m + 1000):  # ends by itself; the bound only guards against cycling
        y = inverse.sum(axis=0)
        prices = np.full(room + 1, -1.0)
        prices[sizes] = y
        value, items = knapsack(prices, room)
        if value <= 1 + 1e-9:
            break
        column = np.zeros(m)
        for s, k in items.items():
            column[row[s]] = k
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = items
    left, plan = dict(demand), []
    for items, share in zip(basis, x):
        n = min([int(share + 1e-6), *(left[s] // k for s, k in items.items())])
        if n > 0:
            plan.append(Pattern(items, n))
            for s, k in items.items():
                left[s] -= n * k
    while any(left.values()):
        space, items = room, {}
        for s in sorted(left, reverse=True):
            if k := min(left[s], space // s):
                items[s], space = k, space - k * s
        n = min(left[s] // k for s, k in items.items())
        plan.append(Pattern(items, n))
        for s, k in items.items():
            left[s] -= n * k
    return plan


def dissolved(plan: list[Pattern], room: int) -> tuple[list[Pattern], list[Pattern]]:
    """(kept, taken apart): the worst-filled sequences whose pieces fit the kept ones' gaps."""
    plan = sorted(plan, key=lambda p: -p.used)
    gaps = sum(p.n * (room - p.used) for p in plan if room - p.used >= MIN_GAP)
    kept, apart, stream = list(plan), [], 0
    while kept:
        p = kept.pop()
        gap = room - p.used if room - p.used >= MIN_GAP else 0
        if not gap:
            kept.append(p)
            break
        # n sequences taken apart add n * used to the stream and n * gap less to fill
        n = min(p.n, max(0, (gaps - stream) // (p.used + gap)))
        if n:
            apart.append(Pattern(p.items, n))
            stream, gaps = stream + n * p.used, gaps - n * gap
        if n < p.n:
            kept.append(Pattern(p.items, p.n - n))
            break
    return kept, apart


def crc_of_blocks(blocks: list[int], first: int, ids: int, last_ids: int) -> int:
    """Checksum of the ids of neighbouring blocks from their own: all of GRAIN ids but
    perhaps the last, ``last_ids`` long.  Appending a block is linear in the checksum."""
    crc = 0
    count = -(-ids // GRAIN)
    for j in range(count):
        n = last_ids if j == count - 1 else GRAIN
        zeros = bytes(4 * n)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ blocks[first + j] if j else blocks[first]
    return crc


def cut(docs: DataFrame, path: str, end_id: int, spaces: bool, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Whole sequences from the front of each document and what remains, with checksums;
    those of the blocks are kept only for remainders, which may be cut again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end, crc = id_pieces(path, spaces), np.array([end_id], "<u4").tobytes(), zlib.crc32
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("blocks", pa.list_(pa.int64()))])
        wide = 4 * GRAIN
        for b in batches:
            rows: list[list] = [[] for _ in schema]
            for key, text in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
                ids = memoryview(ids_of(pieces, text or "") + end)
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    blocks = [crc(part[i : i + wide]) for i in range(0, len(part), wide)] if n < capacity else []
                    for column, value in zip(rows, (key, at, n, crc(part), total, blocks)):
                        column.append(value)
                if len(rows[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def refilled(parts: DataFrame) -> DataFrame:
    """The cut pieces, with checksums made from those of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for start, length, at, total, blocks in zip(*(b.column(c).to_pylist() for c in ("start", "length", "at", "whole", "blocks"))):
                last = length - GRAIN * ((length - 1) // GRAIN)
                crcs.append(crc_of_blocks(blocks, at // GRAIN, length, last))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
            yield pa.RecordBatch.from_arrays([pa.array(crcs, pa.int64()) if n == "ids_crc32" else b.column(n) for n in names], names)

    return parts.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint")


def pack(docs: DataFrame, path: str, end_id: int = 1, spaces: bool = False, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, where it starts there, its length and checksum,
    the document's ids, its sequence and its place there.

    A null or empty text is just the end id.  Repeated rows and ids are packed each; null
    ids stay null; an empty table gives an empty table; other columns are not read.
    ``capacity`` is a multiple of GRAIN.
    """
    spark, room = docs.sparkSession, capacity // GRAIN
    pieces = stage(cut(docs, path, end_id, spaces, capacity, id_col, text_col).withColumn("size", F.ceil(F.col("length") / GRAIN).cast("int")))
    demand = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity / GRAIN rows
    kept, apart = dissolved(columns(demand, room), room)

    # where each class's ranks go: rows (size, first rank, end, per sequence, base, kept)
    rank, deal, sequence, gaps, at = dict.fromkeys(demand, 0), [], 0, [], 0
    for p in kept:
        for s, k in p.items.items():
            deal.append((s, rank[s], rank[s] + k * p.n, k, sequence, True))
            rank[s] += k * p.n
        if (gap := room - p.used) >= MIN_GAP:
            gaps.append((at * GRAIN, gap * GRAIN, sequence))
            at += gap * p.n
        sequence += p.n
    stream = 0
    for p in apart:
        for s, k in p.items.items():
            deal.append((s, rank[s], rank[s] + k * p.n, s * GRAIN, stream * GRAIN, False))
            rank[s] += k * p.n
            stream += s * k * p.n
    table = spark.createDataFrame(deal, "size int, lo long, hi long, per long, base long, whole_piece boolean")

    ranked = with_slots(pieces, "size")
    placed = ranked.join(F.broadcast(table), "size").where((F.col("slot") >= F.col("lo")) & (F.col("slot") < F.col("hi")))  # the plan: bounded by the classes
    whole = placed.where("whole_piece").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor((F.col("slot") - F.col("lo")) / F.col("per"))).cast("long").alias("sequence_id"))
    out = whole
    if apart:
        # both the pieces and the gaps lie on one line: cut the pieces where gaps end
        d = placed.where("not whole_piece").withColumn("s", F.col("base") + (F.col("slot") - F.col("lo")) * F.col("per")).withColumn("e", F.col("s") + F.col("length"))
        known = F.array(*[F.struct(F.lit(g[0]).cast("long").alias("at"), F.lit(g[1]).cast("long").alias("gap"), F.lit(g[2]).cast("long").alias("seq")) for g in gaps])
        until = F.lit(at * GRAIN).cast("long")
        last = F.size(F.filter(known, lambda g: g["at"] < F.col("e")))
        first = F.size(F.filter(known, lambda g: g["at"] <= F.col("s")))
        d = d.withColumn("k", F.explode(F.sequence(first, last))).withColumn("g", F.element_at(known, F.col("k"))).withColumn("to", F.coalesce(F.get(known, F.col("k"))["at"], until))
        lo, hi = F.greatest("s", F.col("g.at")), F.least("e", "to")
        index = lambda x: F.floor((x - F.col("g.at")) / F.col("g.gap")).cast("long")
        d = d.withColumn("j", F.explode(F.sequence(index(lo), index(hi - 1))))
        begin = F.greatest("s", F.col("g.at") + F.col("j") * F.col("g.gap"))
        end = F.least("e", F.col("g.at") + (F.col("j") + 1) * F.col("g.gap"))
        d = d.withColumn("at", begin - F.col("s")).withColumn("n", end - begin)
        parts = d.select("doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("n").alias("length"), "doc_tokens", "at", F.col("length").alias("whole"), "blocks", (F.col("g.seq") + F.col("j")).alias("sequence_id"))
        out = whole.unionByName(refilled(parts))
    inside = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))  # a sequence holds at most ``capacity`` pieces
