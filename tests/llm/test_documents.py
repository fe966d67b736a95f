"""Shards, quality rules, line and document dedup, decontamination, archives, quotes and
the pipeline against brute force."""

import io
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import components, decontam, line_dedup, ngram_join, quality, quotes, sharding, warc
from tapeloom.llm.groups import Union
from tapeloom.sources.store import scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_shards(spark, docs, no_docs):
    got = sharding.shard_documents(docs, [1.0] * 4).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4) and 0 <= r.shard < 4
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(no_docs, [1.0, 2.0]).count() == 0
    many = spark.range(20000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert 0.72 < dict(many)[1] / 20000 < 0.78  # three quarters of the weight


def test_slots_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    d = spark.range(1000).select((F.col("id") % 2).alias("shard"), F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("x"))
    for s in (0, 1):
        assert sorted(r.slot for r in sharding.with_slots(d).where(f"shard = {s}").collect()) == list(range(500))


def base_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, no_docs):
    big = spark.read.parquet(f"{SF}/documents.parquet")
    for d in (docs, big):
        got = quality.quality_rules(d).collect()
        want = Counter((r.doc_id, *base_counts(r.text or "")) for r in d.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept) and 0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1
    assert quality.quality_rules(no_docs).count() == 0
    one = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5], [1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>, c array<double>, d array<double>")
    r = one.select(quality.js_distance(F.col("a"), F.col("b")), quality.js_distance(F.col("c"), F.col("d"))).first()
    assert r[0] == 0 and abs(r[1] - 1) < 1e-12


def test_common_words_by_themselves(spark):
    rng = random.Random(5)

    def text(lang, n, common=0.22):
        words = quality.COMMON[lang]
        return " ".join(rng.choices(words, range(20, 0, -1))[0] if rng.random() < common else "".join(rng.choices("abcdefgh", k=6)) for _ in range(n))

    clean = [(100 * i + j, text(k, n), k) for i, k in enumerate(quality.COMMON) for j, n in enumerate((60, 120, 400, 1000) * 10)]
    bad = [(1000 + i, text("en", n, 0), "en") for i, n in enumerate((60, 400))]
    bad += [(1100 + i, text(a, 600), b) for i, (a, b) in enumerate([("de", "en"), ("fr", "es"), ("es", "fr"), ("en", "de")])]
    d = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string")
    dropped = {r.doc_id for r in quality.quality_rules(d).where("not kept").collect()}
    assert dropped ^ {k for k, *_ in bad} == set()


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        if not s:
            break
        at = rng.randrange(len(s))
        s[at : at + rng.choice((0, 1))] = rng.choice(["", "x", "y"])
    return "".join(s)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_edit_distance(k):
    rng = random.Random(k)
    for _ in range(1500):
        a = "".join(rng.choices("abxy", k=rng.randrange(1, 110)))
        b = edit(rng, a, rng.randrange(7)) if rng.random() < 0.8 else "".join(rng.choices("abxy", k=rng.randrange(90)))
        assert line_dedup.edits_within(a, b, k) == (distance(a, b) <= k)


def test_line_classes(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 5)  # so that clusters are cut into blocks
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh ", k=n)) for n in (20, 33, 40, 47, 60, 120)]
    texts = [(i, "\n".join(edit(rng, rng.choice(base), rng.randrange(4)) for _ in range(6))) for i in range(12)]
    fuzzy = spark.createDataFrame([*texts, (20, texts[0][1]), (None, base[3]), (21, None), (22, "")], "doc_id long, text string")
    for d in (fuzzy, docs):
        lines = sorted(((r.doc_id is not None, r.doc_id or 0, i, x) for r in d.collect() if r.text for i, x in enumerate(r.text.split("\n"))))
        far = sorted({x for *_, x in lines if len(x) >= line_dedup.EXACT_MIN})
        at, sets = {x: i for i, x in enumerate(far)}, Union(len(far))
        for a in far:
            for b in far:
                if a < b and min(len(a), len(b)) >= line_dedup.NEAR_MIN and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                    sets.join(at[a], at[b])
        first, size = {}, Counter()
        for has, k, i, x in lines:
            if x in at:
                first.setdefault(sets.find(at[x]), (k if has else None, i))
                size[sets.find(at[x])] += 1
        want = sorted(((k if has else None, i, *(first[sets.find(at[x])] if x in at else (k if has else None, i)), size[sets.find(at[x])] if x in at else 1) for has, k, i, x in lines), key=str)
        assert rows(line_dedup.line_classes(d), "doc_id", "line_no", "class_doc", "class_line", "class_size") == want
    kept = line_dedup.without_duplicates(fuzzy)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert 20 not in left and left[21] is None and left[22] == "" and kept.columns == fuzzy.columns
    names = ("_doc", "_th", "_gone", "_lines", "_left", "gone_doc", "GONE_LINES", "left_lines")
    clash = line_dedup.without_duplicates(fuzzy.withColumns({c: F.coalesce("doc_id", F.lit(-1)) for c in names}))
    assert rows(clash, "doc_id", "text", *names) == sorted(((k, t, *[-1 if k is None else k] * len(names)) for k, t in left.items()), key=str)
    assert line_dedup.line_classes(no_docs).count() == 0 and line_dedup.without_duplicates(no_docs).count() == 0


def test_short_lines_have_classes(spark):
    texts = [(1, "Les.\n----\n\nRead more here now\n7"), (2, "Les.\n----\n\nRead mare here, now\n7"), (3, "Les!\n}\n}\nRead all of it here\n----------------\n----------------")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.class_size) for r in line_dedup.line_classes(d).collect()}
    linked = {k: v for k, v in got.items() if v[2] > 1}
    assert linked == {(1, 0): (1, 0, 2), (2, 0): (1, 0, 2), (1, 3): (1, 3, 2), (2, 3): (1, 3, 2), (1, 4): (1, 4, 2), (2, 4): (1, 4, 2), (3, 4): (3, 4, 2), (3, 5): (3, 4, 2)}


@pytest.mark.parametrize("width,similar", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_similar_documents(spark, docs, no_docs, width, similar, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2000)
    rng = random.Random(width)
    made = []
    for n in (4, 9, 12, 20, 33, 70, 150):
        words = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(9):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(n)] = f"w{rng.randrange(400)}"
            made.append(" ".join(copy))
    fuzzy = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for d in (fuzzy, docs):
        sets = []
        for r in d.collect():
            w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(r.text or "")]
            sets.append((r.doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
        u = Union(len(sets))
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets[:i]):
                if a and b and len(a & b) * similar.denominator >= len(a | b) * similar.numerator:
                    u.join(i, j)
        least = defaultdict(list)
        for i, (k, _) in enumerate(sets):
            least[u.find(i)].append(k)
        want = sorted(((k, len(s), min([x for x in least[u.find(i)] if x is not None], default=None)) for i, (k, s) in enumerate(sets)), key=str)
        assert rows(ngram_join.similar_documents(d, width, similar), "doc_id", "n_shingles", "component_id") == want
        kept = ngram_join.one_of_each(d, width, similar)
        assert kept.columns == d.columns
        full = [k for k, _, c in want if k == c]
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(set(map(str, full)))
    names = ("_h", "_doc", "_th", "kept_h", "Kept_Doc", "n")
    clash = ngram_join.one_of_each(fuzzy.withColumns({c: F.col("doc_id") * 3 for c in names}), width, similar)
    assert {(r.doc_id * 3,) * len(names) for r in clash.collect()} == {tuple(r[2:]) for r in clash.collect()}
    assert ngram_join.similar_documents(no_docs).count() == 0


def test_texts_that_stay_alone_are_not_shuffled(spark):
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3], texts[5] + " x", None, "", ""])] + [(7, texts[7])], "doc_id long, text string")
    kept = ngram_join.one_of_each(d)
    # the branch of rows that nothing else resembles has a filter over a broadcast join, no more
    assert kept._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [*range(200), 202, 203, 204]
    hit = ngram_join._marked(d.withColumn("th", F.xxhash64("text")), d.where("doc_id in (3, 7)").select("doc_id", F.xxhash64("text").alias("kth")), "doc_id", "th", "doc_id", "kth").where("_hit")
    assert {3, 7} <= {r.doc_id for r in hit.collect()} and hit.count() < 10


def test_allocations_leave_no_gap():
    for similar in (Fraction(9, 10), Fraction(4, 5)):
        for upper in (9, 12, 30, 200, 3000):
            for n in (1, 10**6, 10**12):
                m, a, spare = ngram_join.allocation(upper, similar, n)
                assert 0 <= a <= m and m + a == ngram_join.differences(upper, similar) + 1 + spare
    # neighbourhoods come where ties would cost more than their rows
    assert ngram_join.allocation(1000, Fraction(4, 5), 10**3)[1] == 0 < ngram_join.allocation(1000, Fraction(4, 5), 10**7)[1]


@pytest.mark.parametrize("n", [150, 1300, 5000])
def test_long_unrelated_sets_do_not_meet(n):
    rng = np.random.default_rng(8)
    similar = Fraction(4, 5)
    at = ngram_join.bands(n)
    plan = ngram_join.allocation(at[-1] - 1, similar, 20_000)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2000 if n < 5000 else 300)]
    seen = Counter(h for s in sets for h in ngram_join.posts(s, 9, *plan).tolist())
    assert max(seen.values()) < 20


def test_tails():
    rng = np.random.default_rng(3)
    one, two = rng.poisson(1.7, 400_000), rng.poisson(0.4, 400_000)
    got = ngram_join._tail(np.array([1.7]), np.array([0.4]), 12)[0]
    assert all(abs(got[k] - (one + 2 * two > k).mean()) < 0.004 for k in range(13))


@pytest.mark.parametrize("similar", [Fraction(9, 10), Fraction(4, 5)])
def test_similar_sets_share_a_post_under_every_plan(similar):
    rng = np.random.default_rng(2)
    for upper in (9, 14, 26, 60):
        most = ngram_join.differences(upper, similar)
        for spare, a in [(s, a) for s in (0, 2, 5) for a in range((most + 1 + s) // 2 + 1)]:
            m = most + 1 + spare - a
            for _ in range(50):
                base = rng.integers(0, 2**63, upper + most).astype(np.uint64)
                gone = int(rng.integers(0, most + 1))
                one, two = np.unique(base[gone:upper]), np.unique(base[: upper + most - gone][: upper])
                two = np.unique(np.concatenate([two, base[upper : upper + most - gone]]))
                assert len(np.setxor1d(one, two)) <= most
                assert len(np.intersect1d(ngram_join.posts(one, 3, m, a, spare), ngram_join.posts(two, 3, m, a, spare)))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    u = Union(500)
    for a, b in links:
        u.join(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert rows(got, "node", "root") == sorted(((x, u.find(x)) for x in nodes), key=str)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


QUESTION = "Alice has 12 apples and then gives Bob 5 apples after 12 days, how many apples does she now have?"


def test_leaks(spark, docs, no_docs, monkeypatch):
    said = [
        (1, "Some words first. " + QUESTION), (2, QUESTION.replace("12", "30").replace("5", "7").replace("Bob", "Carl")), (3, QUESTION.replace("12 days", "31 days")),
        (4, "Alice has 12 apples and then nothing more to say about anything"), (5, None), (6, ""), (None, QUESTION), (1, "Some words first. " + QUESTION), (7, QUESTION.upper()),
    ]
    d = spark.createDataFrame(said, "doc_id long, text string").withColumns({"item": F.lit(0), "tokens": F.lit(0), "_h": F.lit(0)})
    items = spark.createDataFrame([(1, QUESTION), (2, "Too short"), (3, None), (4, "12 13 14 15 16 17 18 19 20 21"), (None, QUESTION)], "item_id long, text string").withColumn("doc", F.lit(1))
    found = {(r.doc_id, r.item_id): r.same_values for r in decontam.leaks(d, items).collect()}
    assert found == {(1, 1): True, (2, 1): False}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert len(decontam.leaks(d, items).collect()) == 2
    kept = decontam.decontaminate(d, items)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "7"]) and kept.columns == d.columns
    # a document is an id with its text; helper columns never touch the caller's
    clean = d.limit(0).select("doc_id", "text").unionByName(spark.createDataFrame([(1, "A clean text under the id of one that leaks"), (None, "no id, no leak"), (None, QUESTION)], "doc_id long, text string"))
    names = ("_leak", "leak_doc", "LEAK_TH", "doc", "th", "key")
    kept = decontam.decontaminate(clean.withColumns({c: F.length("text") for c in names}), items)
    assert rows(kept, "doc_id", *names) == sorted([(1, *[43] * 6), (None, *[14] * 6)], key=str)
    assert decontam.decontaminate(no_docs, items).count() == 0 and decontam.decontaminate(clean, items.where("false")).count() == 3
    assert decontam.leaks(no_docs, items).count() == 0 and decontam.leaks(d, items.where("false")).count() == 0
    assert decontam.leaks(docs, items).count() == 0
    real, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = [(r.item_id, r.text) for r in bench.collect()]
    want = sorted(((r.doc_id, k) for r in real.collect() for k, t in held if t in r.text), key=str)
    assert rows(decontam.leaks(real, bench), "doc_id", "item_id") == want


LONG_QUESTION = QUESTION + " Explain every step of the long way to your answer, then check the sum again with a friend of yours, since Alice still has 12 apples in mind."


def test_leaks_by_window(spark):
    said = [(1, LONG_QUESTION.replace("has 12 apples in mind", "has 31 apples in mind")), (2, LONG_QUESTION), (2, LONG_QUESTION.replace("5 apples", "6 apples").replace("12 days", "13 days")), (3, QUESTION.replace("12 days", "31 days"))]
    d = spark.createDataFrame(said, "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG_QUESTION), (2, QUESTION)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in decontam.leaks(d, items).collect()}
    n = got[2, 1][1]
    assert got[1, 1][0] < n and got[2, 1] == (n, n) and (3, 2) not in got and (3, 1) not in got


def test_leaks_in_any_case(spark):
    said = [(1, QUESTION.upper()), (2, QUESTION.title()), (3, QUESTION.lower()), (4, QUESTION), (5, QUESTION.upper().replace("5 APPLES", "7 APPLES")), (6, QUESTION.upper().replace("12 DAYS", "31 DAYS")), (7, "Other words in CAPITALS only, which ask nobody for anything at all today")]
    d = spark.createDataFrame(said, "doc_id long, text string")
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    found = {r.doc_id: r.same_values for r in decontam.leaks(d, items, any_case=True).collect()}
    assert found == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_archives(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ \r\nq", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "ü", "é" * 200_000), (2, "http://b/ \r\nq", "<p>x</p>"), (None, "n", "<p>x</p>")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"id": F.lit(0), "p": F.lit(0), "k": F.lit(0)})
    root = scratch(spark)
    manifest = warc.write(d, root)
    got = rows(warc.read(spark, manifest, root), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter((r[0], r[3], r[4]) for r in got) == Counter([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (None, "revisit", 1)])
    want = Counter((len((h or "").encode()), warc.digest32((h or "").encode())) for _, _, h in pages)
    assert Counter((r[1], r[2]) for r in got) == want and warc.gaps(spark, manifest, root).count() == 0
    none = warc.write(d.where("false"), scratch(spark))
    assert warc.read(spark, none, root).count() == 0
    assert warc.digest32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(packed)

    def one(i):
        data = warc.record(i, f"http://h/{i}", rng.randbytes(rng.randrange(5000)), None, False, "2024-01-01T00:00:00Z")
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush() if packed else data

    parts = [one(i) for i in range(60)]
    at = [sum(map(len, parts[:i])) for i in range(61)]
    data = bytearray(b"".join(parts))
    for k in (7, 20, 21):
        data[at[k + 1] - 12] ^= 0xFF
    found = list(warc.salvage(io.BytesIO(bytes(data[: at[60] - 3]))))
    assert [r["page_id"] for kind, _, _, r in found if kind == "record"] == [i for i in range(59) if i not in (7, 20, 21)]
    assert [x[1:3] for x in found if x[0] == "gap"] == [(at[7], at[8]), (at[20], at[22]), (at[59], at[60] - 3)]
    assert list(warc.salvage(io.BytesIO(b""))) == [] and [x[:3] for x in warc.salvage(io.BytesIO(b"no archive"))] == [("gap", 0, 10)]


def test_quotes(spark):
    chats = [
        (1, 0, "user", "Hello there my dear friend\nHow are you doing today?"),
        (1, 1, "assistant", "On Monday, Bob wrote:\n> How are you doing today?\nI am fine and well, thanks.\n> Hello there my dear friend"),
        (1, 2, "user", ">> How are you doing today?\n> I am fine and well,   THANKS\nGood to hear it."),
        (5, 0, "user", "> Good to hear it.\nMe too I must say."), (5, 1, "user", None), (5, 1, "user", None),
        (None, None, "x", "> Good to hear it."), (6, 0, "user", "> nobody wrote this line here"), (7, 0, "user", ""),
    ]
    d = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(0), "own": F.lit(0), "q": F.lit(0)})
    got = {(r.conv_id, r.turn, r.position): r for r in quotes.conversations(d).collect()}
    assert len(got) == len(chats)
    assert {k: (r.parent_conv, r.parent_turn) for k, r in got.items() if r.parent_conv is not None} == {(1, 1, 1): (1, 0), (1, 2, 2): (1, 1), (5, 0, 0): (1, 2)}
    assert got[1, 1, 1].text == "I am fine and well, thanks." and got[6, 0, 0].text == "" and got[1, 2, 2].text == "Good to hear it."
    assert {k[0]: r.thread_id for k, r in got.items()} == {1: 1, 5: 1, None: None, 6: 6, 7: 7}
    assert quotes.conversations(d.where("false")).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    d, sf = spark.read.parquet(f"{SF}/documents.parquet"), SF
    seen = [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark)
        out = stage(spark, d, sf)
        assert name == "packing" or out.columns == d.columns
        out.write.parquet(path)
        d = spark.read.parquet(path)
        seen.append(d.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] >= seen[4] > 0
    first = corpus_pipeline.keep_quality(spark, docs, sf)
    verdict = quality.quality_rules(docs).where("kept")
    names = ("_key", "_bad", "_th", "bad_doc", "bad_th")
    clash = docs.withColumns({c: F.col("doc_id") + 7 for c in names})
    assert rows(corpus_pipeline.keep_quality(spark, clash, sf), "doc_id", *names) == sorted(((r.doc_id, *[None if r.doc_id is None else r.doc_id + 7] * 5) for r in verdict.collect()), key=str)
    assert rows(first, "doc_id") == rows(verdict, "doc_id") and first.columns == docs.columns
    assert corpus_pipeline.keep_quality(spark, docs.where("false"), sf).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
