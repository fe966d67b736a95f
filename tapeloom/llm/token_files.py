"""Token ids in binary files with one shared zstandard dictionary.

File: MAGIC, the SHA-256 of the dictionary, one zstandard frame per document, the index
(INDEX rows in file order), then the tail (TAIL): where the index begins, its rows, MAGIC.
A frame holds the ids as little-endian 16-bit numbers if the vocabulary allows, else
32-bit.  The dictionary lies beside the files as ``dictionary-<hash>.zdict``; a reader
refuses files whose hash is another one.  With the index one short document is read
without its neighbours.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stage
from .files import Rolling, opened
from .pieces import id_pieces, ids_of

MAGIC = b"TIDS0001"
INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u8")])
TAIL = "<QQ8s"
FILE_BYTES = 64 << 20
#: The dictionary is trained on at most so many documents of at most so many bytes each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1024, 1 << 16, 64 << 10
MANIFEST = "path string, n_docs bigint, n_ids bigint, has_id boolean, first_id bigint, first_hash bigint"


def trained(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for the samples; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def _narrow(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def train(docs: DataFrame, path: str, end_id: int, spaces: bool, vocab: int, text_col: str) -> bytes:
    """Dictionary from a bounded sample of documents, the same for every run: those whose
    hash lies under a bound that leaves about half of SAMPLE_DOCS, copies taken once.
    Only the fit uses a sample; every document is encoded."""
    share = min(1.0, SAMPLE_DOCS / 2 / max(docs.count(), 1))
    bound = min(int(share * 2**64) - 2**63, 2**63 - 1)
    few = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).where((F.col("h") <= bound) & F.octet_length("t").between(1, SAMPLE_BYTES))
    rows = few.groupBy("h").agg(F.min("t").alias("t")).limit(SAMPLE_DOCS).collect()
    pieces, end = id_pieces(path, spaces), np.array([end_id], "<u4").tobytes()
    return trained([np.frombuffer(ids_of(pieces, r.t) + end, "<u4").astype(_narrow(vocab)).tobytes() for r in sorted(rows)])


def write(docs: DataFrame, root: str, path: str, end_id: int = 0, spaces: bool = True, vocab: int = 50257, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, level: int = 1) -> DataFrame:
    """Encode every text, add ``end_id``, write the files under ``root`` in ascending id
    order (null first, equal ids by the text's hash); the manifest, one row per file.

    A null or empty text is just the end id.  Repeated ids each get their document; an
    empty table gives no file; other columns are not read.
    """
    spark = docs.sparkSession
    data = train(docs, path, end_id, spaces, vocab, text_col)
    digest = hashlib.sha256(data).digest()
    fs, base = opened(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary-{digest.hex()}.zdict") as out:
        out.write(data)
    end, kind = np.array([end_id], "<u4").tobytes(), _narrow(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, roll, index, total, first = id_pieces(path, spaces), Rolling(root, ".tids", FILE_BYTES, MAGIC + digest), [], 0, None
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_content_size=True)

        def finished():
            table = np.array(index, INDEX)
            roll.write(table.tobytes() + struct.pack(TAIL, roll.at, len(index), MAGIC))
            return [roll.close(), len(index), total, first[0] is not None, first[0] or 0, first[1]]

        rows = []
        for b in batches:
            for key, text, h in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), b.column(2).to_pylist()):
                ids = np.frombuffer(ids_of(pieces, text or "") + end, "<u4")
                frame = packer.compress(ids.astype(kind).tobytes())
                first = first if index else (key, h)
                index.append((key is not None, key or 0, roll.write(frame), len(frame), len(ids)))
                total += len(ids)
                if roll.full:
                    rows.append(finished())
                    index, total = [], 0
        if index:
            rows.append(finished())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "n_docs", "n_ids", "has_id", "first_id", "first_hash"])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ordered.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")
    return stage(ordered.mapInArrow(run, MANIFEST))


def read(spark: SparkSession, manifest: DataFrame, root: str, vocab: int = 50257) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32``, all from the files."""
    kind = _narrow(vocab)
    # one row per file of FILE_BYTES: a table of names, far smaller than the data
    before = W.orderBy("has_id", "first_id", "first_hash").rowsBetween(W.unboundedPreceding, -1)
    named = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    named = named.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for key, ids in documents(root, path, kind):
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _index(fs, path: str):
    size = fs.get_file_info(path).size
    f = fs.open_input_file(path)
    tail = struct.calcsize(TAIL)
    at, n, magic = struct.unpack(TAIL, f.read_at(tail, size - tail))
    head = f.read_at(len(MAGIC) + 32, 0)
    if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{path} is no token file")
    return f, head[len(MAGIC) :], np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX)


def _unpacker(fs, base: str, digest: bytes):
    with fs.open_input_stream(f"{base}/dictionary-{digest.hex()}.zdict") as f:
        data = f.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary is not the one the file was written with")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(data))


def documents(root: str, path: str, kind: str = "<u2") -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of all documents of a file, in order, one frame in memory at a time."""
    fs, base = opened(root)
    f, digest, index = _index(fs, path)
    unpack = _unpacker(fs, base, digest)
    with f:
        for has, key, at, length, n in index.tolist():
            ids = np.frombuffer(unpack.decompress(f.read_at(length, at)), kind)
            if len(ids) != n:
                raise ValueError(f"{path}: the index does not fit the frame at {at}")
            yield key if has else None, ids


def lookup(root: str, path: str, doc_id: int, kind: str = "<u2") -> list[np.ndarray]:
    """The ids of one document id in a file (one array per document), by the index alone."""
    fs, base = opened(root)
    f, digest, index = _index(fs, path)
    unpack = _unpacker(fs, base, digest)
    with f:
        hits = index[(index["doc_id"] == doc_id) & (index["has_id"] == 1)]
        return [np.frombuffer(unpack.decompress(f.read_at(int(r["length"]), int(r["offset"]))), kind) for r in hits]
