"""Jaccard join of word n-gram sets by a partition of the universe.

Sets of similar sizes fall into a band.  A band cuts the universe of n-grams by hash into
segments.  Two sets that are similar enough differ in at most ``H`` n-grams (a bound of
the band), so they cannot differ once in every plain segment and twice in every segment
that also posts its one-deletion neighbourhood, if there are more of these chances than
H.  So similar sets share the hash of a segment's subset.  How many segments a band has
and how many of them get the neighbourhood is chosen by cost from the number of sets in
the band.  Sets that meet form candidate clusters, in which a prefix filter finds the
pairs and the sets themselves decide.

N-grams are named by 64-bit hashes: within two sets of 10,000 n-grams a wrong match has
a chance under 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage
from .components import components
from .groups import Union, dealt, each_group, in_blocks
from .names import free

#: A band's upper size over its lower one.
RATIO = 1.4
#: What the cost of a plan expects: the share of other sets of the band that hold a passage of
#: a set, and the part of the set that it is.
SHARING, PASSAGE = 0.01, 0.2
#: N-grams of a block of a candidate cluster.
BLOCK = 4_000_000
#: Bits that mark the documents of clusters.
BITS = 1 << 23
WORDS = 500_000  # entries of a task's memo of word hashes


class Words(dict):
    """Hashes of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngrams(text: str | None, width: int, memo: Words) -> np.ndarray:
    """The sorted distinct n-grams of a text: words between ASCII white space, A-Z in lower
    case; with fewer words, the whole sequence as one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total, i) + h[i : i + n]
    return np.unique(mixed(total, width))


def bands(largest: int) -> list[int]:
    """Lower sizes of the bands, the last beyond ``largest``."""
    at = [1]
    while at[-1] <= largest:
        at.append(max(at[-1] + 1, ceil(at[-1] * RATIO)))
    return at


def differences(upper: int, similar: Fraction) -> int:
    """H: how many n-grams similar sets differ in at most, if the smaller has up to ``upper``."""
    return int(upper * (1 - similar) / similar)


def _tail(mean1: np.ndarray, mean2: np.ndarray, most: int) -> np.ndarray:
    """[i, s]: the chance that a Poisson count of mean1[i] plus twice one of mean2[i] is over s."""
    s = np.arange(most + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most + 1)))))
    pmf = lambda mean: np.exp(s * np.log(np.maximum(mean, 1e-300))[:, None] - mean[:, None] - logs)
    one, two = pmf(mean1), pmf(mean2)
    both = np.zeros_like(one)
    for i in range(most // 2 + 1):
        both[:, 2 * i :] += two[:, i : i + 1] * one[:, : most + 1 - 2 * i]
    return np.clip(1 - np.cumsum(both, axis=1), 0, 1)


@lru_cache(maxsize=None)
def allocation(upper: int, similar: Fraction, n_sets: int) -> tuple[int, int, int]:
    """(segments, how many of them with one-deletion neighbourhoods, spare chances) for a
    band, by cost.

    Plain segments are one chance each, those with neighbourhoods two; all but H + 1 are
    spare: a set whose segments as good as empty weigh no more than the spare chances need
    not post them.  The cost of a set is the rows it posts, the ties to sets that share a
    passage and have nothing else in a segment, and, if it is one of the few that must
    post the empty subset, comparisons with all others of that kind, which follow the size.
    """
    least = differences(upper, similar) + 1
    spares = sorted({0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192} & set(range(2 * least + 4)))
    best = None
    for spare in spares:
        need = least + spare
        a = np.unique(np.linspace(0, need // 2, 17).astype(int))
        m = need - a
        mean = upper / RATIO / m
        empty, few = np.exp(-mean), np.exp(-mean) * (1 + mean)
        wide = _tail((m - a) * empty, a * few, spare)[:, spare]
        foreign = mean * (1 - PASSAGE)
        pure = (1 - np.exp(-mean * PASSAGE)) * np.exp(-2 * foreign)
        ties = n_sets * SHARING * ((m - a) * pure + a * pure * (1 + foreign) ** 2)
        cost = m + a * mean + wide * wide * n_sets * (1 + upper / 8) + ties
        i = int(cost.argmin())
        if best is None or cost[i] < best[0] - 1e-9:
            best = float(cost[i]), int(m[i]), int(a[i]), spare
    return best[1:]


def posts(grams: np.ndarray, band: int, m: int, a: int, spare: int) -> np.ndarray:
    """Hashes of the segments' subsets of a set under a band's plan; the first ``a``
    segments also post each subset less one n-gram."""
    segment = ((mixed(grams, 11) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, values = segment[order].astype(np.int64), mixed(grams, 13)[order]
    counts = np.bincount(segment, minlength=m)
    sums = np.zeros(m, np.uint64)
    filled = counts > 0
    sums[filled] = np.add.reduceat(values, np.concatenate(([0], np.cumsum(counts)[:-1]))[filled])
    trivial = np.where(np.arange(m) < a, counts <= 1, counts == 0)
    wide = int(trivial[:a].sum()) * 2 + int(trivial[a:].sum()) > spare
    ids = np.arange(m, dtype=np.uint64)
    out = [sums if wide else sums[filled]]
    where = [ids if wide else ids[filled]]
    if a:
        inside = segment < a
        fewer = sums[segment[inside]] - values[inside]
        if not wide:
            inside_count = counts[segment[inside]] > 1
            fewer, inside_ids = fewer[inside_count], segment[inside][inside_count]
        else:
            inside_ids = segment[inside]
        out.append(fewer)
        where.append(inside_ids.astype(np.uint64))
    return mixed(np.concatenate(out) + mixed(np.concatenate(where), 17), band)


def _named(g: np.ndarray) -> tuple[int, int]:
    """The name of a set: two sums of hashes of its n-grams."""
    return tuple(int(mixed(g, s).sum(dtype=np.uint64)) for s in (1, 2))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc, th, n, k1, k2): the size and name of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in batches:
            sets = [(len(g), *_named(g)) for g in (ngrams(x.as_py(), width, memo) for x in b.column(2))]
            n, k1, k2 = zip(*sets) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), _signed(k1), _signed(k2)], ["doc", "th", "n", "k1", "k2"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "th", "t").mapInArrow(run, f"doc {kind}, th bigint, n bigint, k1 bigint, k2 bigint")


def _posts(docs: DataFrame, width: int, similar: Fraction, plan: dict[int, int]) -> DataFrame:
    """(k1, sig): what each set posts, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, at = Words(), set(), bands(1)
        names, sigs, held = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (names, sigs)], ["k1", "sig"])

        for b in batches:
            for text in (x.as_py() for x in b.column(0)):
                g = ngrams(text, width, memo)
                n, name = len(g), _named(g)
                if not n or name in seen:
                    continue
                seen.add(name)
                if n >= at[-1]:
                    at = bands(n)
                own = int(np.searchsorted(at, n, "right")) - 1
                for k in (own, own - 1):
                    upper = at[k + 1] - 1
                    if k >= 0 and n * similar <= upper and differences(upper, similar) > 0:
                        sigs.append(posts(g, k, *allocation(upper, similar, plan.get(k, 1))))
                        names.append(np.full(len(sigs[-1]), name[0], np.uint64))
                        held += len(sigs[-1])
                if held > 1 << 16:
                    yield batch()
                    names, sigs, held = [], [], 0
        if held:
            yield batch()

    return docs.select("t").mapInArrow(run, "k1 bigint, sig bigint")


def similar_in(sets: list[np.ndarray], similar: Fraction) -> Union:
    """The components of a group of sets: prefix filter over rare n-grams, then the sets."""
    found = Union(len(sets))
    sizes = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    each = np.split(rank[code], np.cumsum(sizes)[:-1])
    often = np.sort(count)
    posted: dict[int, list[int]] = {}
    up, down = similar.numerator, similar.denominator
    for x in np.argsort(sizes, kind="stable").tolist():
        codes = np.sort(each[x])
        n = len(codes)
        first = codes[: n - ceil(n * similar) + 1]
        first = first[often[first] > 1].tolist()
        seen = set()
        for c in first:
            for y in posted.get(c, ()):
                if y in seen:
                    continue
                seen.add(y)
                if sizes[y] * down >= n * up and found.find(x) != found.find(y):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both * down >= (n + int(sizes[y]) - both) * up:
                        found.join(x, y)
            posted.setdefault(c, []).append(x)
    return found


def _marked(docs: DataFrame, keys: DataFrame, doc: str, th: str, kdoc: str, kth: str) -> DataFrame:
    """``docs`` with a flag ``_hit``: true for the rows that may be among ``keys``, and some
    others.  Hashes are marked in BITS bits, at most BITS / 64 rows, so no text is shuffled."""
    bit = lambda *key: F.pmod(F.xxhash64(*key), F.lit(BITS))
    one = keys.select(bit(kdoc, kth).alias("_bit"))
    marks = one.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_marks"))
    d = docs.withColumn("_bit", bit(doc, th)).withColumn("_word", F.shiftright("_bit", 6))
    d = d.join(F.broadcast(marks), "_word", "left").withColumn("_hit", F.expr("coalesce(getbit(_marks, cast(_bit % 64 as int)) = 1, false)"))
    return d.drop("_word", "_bit", "_marks")


def possible(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may be among ``placed``, and some others, so that texts that
    are in no cluster are not shuffled."""
    return _marked(docs, placed, "doc", "th", "mdoc", "mth").where("_hit").drop("_hit")


def similar_documents(docs: DataFrame, width: int = 5, similar: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``text_hash``, ``n_shingles``, ``component_id`` (the least
    id of its component) and ``component_hash`` (that document's text hash).

    Texts without words have empty sets and are components of their own; a null id is the
    least of ids in comparisons only where a component has no other; repeated rows share a
    component; an empty table gives an empty table; other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    # sets per band, by words: only the cost of a plan depends on it, one row per band
    lower = F.array(*[F.lit(x) for x in bands(1 << 40)])
    words = F.size(F.split(F.coalesce("t", F.lit("")), r"[\x20\x09-\x0D]+"))
    band = F.size(F.filter(lower, lambda x: x <= F.col("w"))) - 1  # over an aggregate: a lambda would count the words again for every bound
    plan = {r[0]: r[1] for r in d.groupBy(words.alias("w")).count().groupBy(band.alias("b")).agg(F.sum("count")).collect()}

    sets = stage(_sets(d, width))
    pivot = F.min("k1").over(W.partitionBy("sig"))
    met = _posts(d, width, similar, plan).withColumn("b", pivot).where("k1 != b").select(F.col("k1").alias("a"), "b").distinct()
    clusters = components(met)

    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "th")
    each = stage(sets.where("n > 0").groupBy("k1", "k2").agg(F.min(order).alias("first"), F.first("n").alias("n")))
    members = each.join(clusters.withColumnRenamed("node", "k1"), "k1").select("k1", "k2", "n", "root", F.col("first.doc").alias("mdoc"), F.col("first.th").alias("mth"))
    # similar sets have similar sizes: a cluster falls into parts by doubling sizes, and a set
    # also joins the next part if its partners may be there; a part of one needs no text
    part = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    reaches = F.col("n") * similar.denominator >= F.pow(F.lit(2.0), part + 1) * similar.numerator
    parts = F.when(reaches, F.array(part, part + 1)).otherwise(F.array(part))
    members = members.withColumn("_part", F.explode(parts)).withColumn("root", F.xxhash64("root", "_part"))
    several = members.groupBy("root").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("root")
    placed = stage(in_blocks(members.join(several, "root"), "root", "k2", BLOCK, "n").select("k1", "k2", "root", "mdoc", "mth", "_g", "_own"))
    texts = possible(d, placed).join(placed, d["doc"].eqNullSafe(F.col("mdoc")) & (d["th"] == F.col("mth"))).select("k1", "k2", "root", "_g", "_own", "t")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in batches:
            held = [ngrams(x.as_py(), width, memo).tobytes() for x in b.column(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(held, pa.binary())], ["k1", "k2", "root", "_g", "_own", "grams"])

    groups = dealt(texts.mapInArrow(grams, "k1 bigint, k2 bigint, root bigint, _g int, _own int, grams binary"), "root")

    def work(columns: list[list]) -> Iterator[tuple]:
        # rows that share id and text name one set
        rows = sorted({(a, b): g for a, b, g in zip(*columns)}.items())
        if len(rows) > 1:
            for x, y in similar_in([np.frombuffer(g, np.uint64) for _, g in rows], similar).stars():
                yield *rows[x][0], *rows[y][0]

    links = each_group(groups, ["k1", "k2", "grams"], work, "a1 bigint, a2 bigint, b1 bigint, b2 bigint", ["a1", "a2", "b1", "b2"])
    name = lambda x: F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2")).alias(x)
    roots = components(links.select(name("a"), name("b"))).select("node.k1", "node.k2", "root")
    known = each.join(roots, ["k1", "k2"], "left").withColumn("root", F.coalesce("root", F.struct("k1", "k2")))
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.select("k1", "k2", "root").join(least, "root").select("k1", "k2", "least")
    out = sets.join(known, ["k1", "k2"], "left")
    one = F.when(F.col("n") > 0, F.col("least")).otherwise(order)
    return out.select(F.col("doc").alias(id_col), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), one["doc"].alias("component_id"), one["th"].alias("component_hash"))


def one_of_each(docs: DataFrame, width: int = 5, similar: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns) that stay: of each component the one with the least id.
    Rows that share id and text are one document and leave one row.

    Texts without words, null ones too, resemble nothing and all stay; a null id stays only
    if its component has no other; texts of any length count whole; an empty table gives an
    empty table; other columns, of whatever name, are carried along.
    """
    given = docs.columns
    names = free(docs, *(f"n{i}" for i in range(len(given))))  # so that helper columns hide none
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)])
    key, text = names[given.index(id_col)], names[given.index(text_col)]
    found = similar_documents(docs, width, similar, id_col, text_col)
    stays = F.col(id_col).eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("component_hash"))
    each = found.select(F.col(id_col).alias("kept_doc"), F.col("text_hash").alias("kept_th"), stays.alias("stays"))
    each = each.groupBy("kept_doc", "kept_th").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    # documents that go or are there twice; only texts that may be among them are shuffled
    touched = stage(each.where("not stays or n > 1").drop("n"))
    d = _marked(d.withColumn("_th", F.xxhash64(text)), touched, key, "_th", "kept_doc", "kept_th")
    some = d.where("_hit").join(touched, F.col(key).eqNullSafe(F.col("kept_doc")) & (F.col("_th") == F.col("kept_th")), "left")
    some = some.where(F.coalesce("stays", F.lit(True))).dropDuplicates([key, "_th"])
    both = d.where("not _hit").select(*names).unionByName(some.select(*names))
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, given)])
