"""Token counts, token files and packing against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import packing, pieces, token_counts, token_files
from tapeloom.sources.store import scratch

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CASES = [(BYTES, True), (WORDS, False)]


def library(path, text):
    return pieces.load(path).encode(text or "", add_special_tokens=False).ids


def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("path,spaces", CASES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab Zé'.,1 \n\t\x1c ßΣς"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_give_the_library_s_ids(path, spaces, text):
    assert np.frombuffer(pieces.ids_of(pieces.id_pieces(path, spaces), text), "<u4").tolist() == library(path, text)


def test_slices_and_full_memos(monkeypatch):
    text = "some words, here. " * 400
    monkeypatch.setattr(pieces, "MEMO", 3)
    p = pieces.id_pieces.__wrapped__(BYTES, True)
    ids = b"".join(v for s in pieces.slices(text, 100) for v in p.values(s))
    assert len(list(pieces.slices(text, 100))) > 10
    assert np.frombuffer(ids, "<u4").tolist() == library(BYTES, text)


@pytest.mark.parametrize("path,spaces", CASES)
@pytest.mark.parametrize("memo", [1, 3, 6])
def test_ids_do_not_depend_on_a_full_memo(monkeypatch, path, spaces, memo):
    monkeypatch.setattr(pieces, "MEMO", memo)
    p = pieces.id_pieces.__wrapped__(path, spaces)
    text = "some words, here. " * 20 + "Other plain words\nand some more of them here, ÄRGER  two " * 20
    for size in (50, 1 << 20):
        ids = b"".join(v for s in pieces.slices(text, size) for v in p.values(s))
        assert np.frombuffer(ids, "<u4").tolist() == library(path, text)
    assert np.frombuffer(p.encode([" word"])[0], "<u4").tolist() == library(path, " word")


def test_token_counts(docs, no_docs):
    got = sorted(map(tuple, token_counts.token_counts(docs, BYTES, limit=20).collect()), key=str)
    want = sorted(((k, len(t.encode()), n := len(library(BYTES, t)), n > 20) for k, t in rows(docs)), key=str)
    assert got == want
    assert token_counts.token_counts(no_docs, BYTES).count() == 0
    whole = token_counts.whole_tokens(BYTES)
    assert "Ġthe" in whole and len(whole) > 45_000


def test_token_files(spark, docs, no_docs):
    root = scratch(spark)
    manifest = token_files.write(docs, root, BYTES)
    got = sorted(map(tuple, token_files.read(spark, manifest, root).collect()), key=lambda r: r[1])
    coded = [(k, np.array(library(BYTES, t) + [0], "<u4")) for k, t in rows(docs)]
    want = sorted(((k, len(i), zlib.crc32(i.tobytes())) for k, i in coded), key=str)
    assert sorted(((k, n, c) for k, _, n, c in got), key=str) == want
    assert [s for _, s, _, _ in got] == [sum(n for _, _, n, _ in got[:i]) for i in range(len(got))]
    assert [k for k, *_ in got] == sorted((k for k, _ in coded), key=lambda k: (k is not None, k))
    paths = [r.path for r in manifest.collect()]
    assert sum(len(token_files.lookup(root, p, 10)) for p in paths) == 2
    assert [i.tolist() for p in paths for i in token_files.lookup(root, p, 8)] == [dict((k, i.tolist()) for k, i in coded)[8]]
    empty = scratch(spark)
    assert token_files.read(spark, token_files.write(no_docs, empty, BYTES), empty).count() == 0
    small = token_files.trained([b"abcdefgh%d" % (i % 7) * 9 for i in range(500)], 1024)
    assert token_files.trained([b"x"]) == b"" and len(small) > 0


def test_packing(docs, no_docs):
    got = packing.pack(docs, WORDS, capacity=256).collect()
    coded = defaultdict(list)
    for k, t in rows(docs):
        coded[k].append(np.array(library(WORDS, t) + [1], "<u4"))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for k, texts in coded.items():
        ids = texts[0]  # equal ids hold equal texts here
        assert sum(r.length for r in by[k]) == len(ids) * len(texts)
        for r in by[k]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(no_docs, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), min_size=1, max_size=12))
def test_columns_cover_the_demand(demand):
    plan = packing.columns(dict(demand), 32)
    assert all(0 < p.used <= 32 for p in plan)
    got = defaultdict(int)
    for p in plan:
        for s, k in p.items.items():
            got[s] += k * p.n
    assert dict(got) == demand
    kept, apart = packing.dissolved(plan, 32)
    room = sum(p.n * (32 - p.used) for p in kept if 32 - p.used >= packing.MIN_GAP)
    assert sum(p.n * p.used for p in apart) <= room
    assert sum(p.n for p in kept) >= -(-sum(s * d for s, d in demand.items()) // 32)
