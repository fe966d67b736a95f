"""Whitening, importance resampling and fingerprints against second implementations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import fingerprints, importance, importance_sql, whitening

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_checksums_by_matrices():
    rng = random.Random(1)
    lengths = [0, 1, 2, 3, 9, 4095, 4096, 4097, 8192, 20_000]
    features = [rng.randbytes(rng.choice(lengths)) for _ in range(80)]
    assert importance.crc32_all(features).tolist() == [zlib.crc32(x) for x in features]
    assert len(importance.crc32_all([])) == 0


def test_words_over_slices(monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 7)
    monkeypatch.setattr(importance, "MEMO", 5)
    rng, buckets = random.Random(2), importance.Buckets(1000)
    for _ in range(400):
        text = "".join(rng.choice("aBİ1é .\n€") for _ in range(rng.randrange(40)))
        found = words(text)
        assert [x.decode() for part in importance.words_of(text) for x in part] == found
        runs = [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]
        n, got = importance.buckets_of(text, 3, buckets)
        assert n == len(found) and Counter(got.tolist()) == Counter(zlib.crc32(x.encode()) % 1000 for x in runs)


def resampled(docs, target, most):
    """The definition, in plain Python."""
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for key, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[b] for b in f)
        out.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0, out[i][1]))
    rank = {i: at + 1 for at, i in enumerate(order[: 10 * len(order) // 100])}
    return Counter((*r[:4], rank.get(i)) for i, r in enumerate(out))


@pytest.mark.parametrize("most", [1, 2])
def test_importance(spark, docs, no_docs, most, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 20)
    many = docs.select("doc_id", "text").unionByName(docs.sparkSession.range(40).select((F.col("id") % 30 + 100).alias("doc_id"), F.concat(F.lit("alpha1 the of "), F.repeat(F.lit("word7 and "), 12)).alias("text")))
    target = spark.createDataFrame([("alpha1 alpha2 the",), (None,), ("",)], "text string")
    for d in (docs, many):
        got = Counter(map(tuple, importance.importance_resample(d, target, most=most).collect()))
        assert got == resampled([(r.doc_id, r.text) for r in d.collect()], [r.text for r in target.collect()], most)
    assert importance.importance_resample(no_docs, target).count() == 0
    assert importance.importance_resample(docs, target.where("false")).count() == docs.count()


def test_importance_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = importance.importance_resample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(importance_sql.SQL).fetchall())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 8)) * 0.3  # of rank six, before the floors
    rows = [(i, x.tolist(), 1) for i, x in enumerate(base)] + [(7, base[7].tolist(), 2), (None, base[9].tolist(), 3)]
    rows += [(900, None, 0), (901, [1.0, None] + [0.0] * 6, 0), (902, [float("nan")] + [0.0] * 7, 0), (903, [float("inf")] * 8, 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").withColumns({"component": F.lit(1), "v": F.lit(2)}).repartition(5)


def whitened(rows, most):
    x = np.array([np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), (c @ v / np.sqrt(e))[:, :most], (e / e.sum())[:most]


@pytest.mark.parametrize("most", [3, 32])
def test_whitening(vectors, most):
    got = whitening.whiten(vectors, most).toPandas()
    rows = [(r.vec_id, r.embedding) for r in vectors.where("vec_id < 900 or vec_id is null").collect()]
    deviation, want, share = whitened(rows, most)
    k = min(most, 8)
    assert len(got) == len(rows) * k and set(got["n"]) == {302} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for i, (key, _) in enumerate(rows):
        mine = got[got.vec_id.isna() if key is None else got.vec_id == key].drop_duplicates().sort_values("component")  # id 7 is there twice
        assert (mine.deviation == deviation[i]).all() and np.allclose(mine.explained.values[:k], share, rtol=1e-9)
        assert np.allclose(np.abs(mine.whitened.values[:k]), np.abs(want[i]), atol=1e-8)


def test_whitening_of_flat_and_ill_scaled_rows(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.where("false")).count() == 0
    rng = np.random.default_rng(1)
    rows = [(i, [float(a * 1e7), float(b), float(a * 1e7), 3.0]) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-6  # the other two directions hold nothing
    assert abs(got.explained.groupby(got.component).first().sum() - 1) < 1e-9


def test_whitening_of_integers_beyond_a_long():
    x = np.array([[1_000_000, 2_000_000], [1_000_001, 2_000_000]])
    assert whitening.deviations(x, 10**10, np.array([10**16, 2 * 10**16])) == [0, None]
    assert whitening.deviations(x, 2, x.sum(axis=0)) == [1, 1]


def naive_syncmers(text, k, s):
    """By definition: k-mers whose least s-mer by hash is at an edge."""
    codes = np.array([ord(c) for c in text], np.uint64)
    inner = fingerprints._windows(codes, s).tolist() if len(text) >= s else []
    at = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    return {text[i : i + k]: i for i in reversed(at)}, at


def test_syncmers(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice("abcdé 👍") for _ in range(rng.randrange(300)))
        first, at = naive_syncmers(text, 8, 3)
        got = fingerprints.fingerprint(text, 8, 3, keep=10_000)
        assert fingerprints.syncmers(fingerprints._codes(text), 8, 3)[1].tolist() == at
        assert sorted(got["at"].tolist()) == sorted(first.values()) or (text and not at and got["at"].tolist() == [0])
        assert all(b - a <= 8 - 3 for a, b in zip(at, at[1:]))  # context-free, yet never far apart
        short = fingerprints.fingerprint(text, 8, 3, keep=20)
        assert short.tolist() == got[:20].tolist()
        with monkeypatch.context() as m:
            m.setattr(fingerprints, "SLICE", 13)
            assert fingerprints.fingerprint(text, 8, 3, keep=20).tolist() == short.tolist()
        assert fingerprints.likeness(short, short) == 1.0 and fingerprints.read_back(fingerprints.shown(short)).tolist() == short.tolist()


def test_likeness_follows_shared_text():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    a, b = (" ".join(word() for _ in range(3000)) for _ in range(2))
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(a), f(b)) < 0.1
    for share in (0.25, 0.5, 0.9):
        mixed = a[: int(len(a) * share)] + b[: int(len(b) * (1 - share))]
        assert abs(fingerprints.likeness(f(a), f(mixed)) - share) < 0.2
    moved = "some words before " + a[:9000] + " and some between " + a[9000:]
    assert fingerprints.likeness(f(a), f(moved)) > 0.9
    assert fingerprints.likeness(f(""), f("")) == 1.0 and fingerprints.likeness(f(""), f(a)) == 0.0


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_fingerprints(spark, docs, no_docs, range_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    copies = spark.range(25).select(F.lit(3).cast("long").alias("doc_id"), F.when(F.col("id") > 9, F.lit("copies of one text, many times")).otherwise(F.concat(F.lit("own text "), F.col("id"))).alias("text"))
    for d in (docs, docs.select("doc_id", "text").unionByName(copies), docs.where("doc_id = 13"), spark.read.parquet(f"{SF}/documents.parquet")):
        got = fingerprints.fingerprints(d).collect()
        hashed = d.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("h")).collect()
        order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
        want = Counter()
        for r, after in zip(order, order[1:] + order[:1]):
            text = fingerprints.edited(r.t, after.t)
            a, b, c = map(fingerprints.fingerprint, (r.t, text, after.t))
            assert len(text) <= len(r.t) and text[: len(r.t) - len(r.t) // 2] == r.t[: len(r.t) - len(r.t) // 2]
            want[(r.doc_id, len(r.t), hashlib.sha256(text.encode()).hexdigest(), fingerprints.shown(a), fingerprints.shown(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c))] += 1
        assert Counter(map(tuple, got)) == want
    assert fingerprints.fingerprints(no_docs).count() == 0
