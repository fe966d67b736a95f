"""WARC archives of pages, and a reader that goes on after damage.

Each record is a gzip member of its own.  The reader checks every member (its checksum,
the version line, the header, the length of the block, the payload's digest).  Where a
check fails it searches for the next place at which a whole member, or in plain files a
version line with a whole record, begins; it recovers the records from there on and
reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stage
from .files import Rolling, opened

CRLF, GZIP = b"\r\n", b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, READ = 64 << 20, 1 << 20
MANIFEST = "path string, n_records bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, path string, begin bigint"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_uri(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def page_key(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def record(key: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the response's headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_uri(key)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: {page_uri(refers)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def parsed(data: bytes) -> tuple[dict, int] | None:
    """The record at the start of ``data`` and its length; None if any check fails."""
    version = VERSION.match(data)
    end = data.find(CRLF + CRLF)
    if not version or end < 0:
        return None
    try:
        pairs = [x.split(": ", 1) for x in data[version.end() : end].decode().split("\r\n")]
        head = {k.lower(): v for k, v in pairs}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        whole = len(block) == size and size >= 0 and data[end + 4 + size : end + 8 + size] == CRLF + CRLF
        if not whole or head["warc-block-digest"] != f"sha1:{digest32(block)}":
            return None
        cut = block.index(CRLF + CRLF)
        payload = block[cut + 4 :]
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and digest != digest32(payload):
            return None
        length = next(int(x.split(b":")[1]) for x in block[:cut].split(CRLF) if x.lower().startswith(b"content-length:"))
    except (KeyError, ValueError, StopIteration, UnicodeDecodeError):
        return None
    row = {
        "page_id": page_key(head.get("warc-record-id")),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_key(head.get("warc-refers-to")),
        "url": head.get("warc-target-uri"),
    }
    return row, end + 8 + size


class Window:
    """The bytes of a file from a moving start on; reads ahead, forgets what lies behind."""

    def __init__(self, f):
        self.f, self.at, self.data, self.ended = f, 0, bytearray(), False

    def more(self) -> bool:
        got = b"" if self.ended else self.f.read(READ)
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def find(self, mark: re.Pattern | bytes, start: int) -> int:
        """Offset of the next mark in the window at or after ``start``, or -1 at the end."""
        while True:
            hit = self.data.find(mark, start) if isinstance(mark, bytes) else (m.start() if (m := mark.search(self.data, start)) else -1)
            if hit >= 0:
                return hit
            start = max(start, len(self.data) - 16)
            if not self.more():
                return -1


def member(w: Window, at: int) -> tuple[bytes, int] | None:
    """The unpacked gzip member that begins at ``at`` and where it ends; None if damaged."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if pos >= len(w.data) and not w.more():
                return None
            part = bytes(w.data[pos : pos + READ])
            pos += len(part)
            out.append(unpack.decompress(part))
    except zlib.error:
        return None
    return b"".join(out), pos - len(unpack.unused_data)


def plain(w: Window, at: int) -> tuple[dict, int] | None:
    """The plain record at ``at`` and where it ends."""
    head = w.find(CRLF + CRLF, at)
    if head < 0:
        return None
    size = re.search(rb"\r\nContent-Length: (\d{1,18})(?=\r\n)", bytes(w.data[at : head + 2]), re.I)
    if not size:
        return None
    end = head + 8 + int(size[1])
    while len(w.data) < end and w.more():
        pass
    found = parsed(bytes(w.data[at:end]))
    return (found[0], end) if found else None


def salvage(f) -> Iterator[tuple[str, int, int, dict | None]]:
    """("record", begin, end, row) of each sound record, ("gap", begin, end, None) of what
    lies between.  Memory follows the largest record, not the file."""
    w = Window(f)
    bad = None
    while w.data or w.more():
        found = None
        while len(w.data) < 16 and w.more():
            pass
        if w.data[:3] == GZIP:
            if (m := member(w, 0)) and (p := parsed(m[0])) and p[1] == len(m[0]):
                found = p[0], m[1]
        elif VERSION.match(w.data):
            found = plain(w, 0)
        if found:
            if bad is not None:
                yield "gap", bad, w.at, None
                bad = None
            yield "record", w.at, w.at + found[1], found[0]
            w.drop(found[1])
            continue
        bad = w.at if bad is None else bad
        nexts = [x for x in (w.find(re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n"), 1),) if x >= 0]
        w.drop(nexts[0] if nexts else len(w.data))
    if bad is not None:
        yield "gap", bad, w.at, None


def write(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3) -> DataFrame:
    """Write one record per row under ``root``; the manifest, one row per file.

    Of rows with equal payloads the one with the smallest id is the response, the others
    revisit it; of rows that also share that id one is the response.  A null html is an
    empty payload; a null id never wins over another; an empty table gives no file; other
    columns are not read.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("p"))
    d = d.withColumn("k", F.sha1("p")).withColumn("row", F.monotonically_increasing_id())
    # keys of payloads that occur again: copies meet as (id, row) pairs, never as payloads
    # the row number decides only between rows that share payload and id: it may differ when a task runs again
    same = d.groupBy("k", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("c"))
    order = F.struct(F.col("id").isNull().alias("n"), "id", F.when(F.col("c") > 1, F.col("row")).alias("row"))
    firsts = stage(same.groupBy("k").agg(F.min(order).alias("f"), F.sum("c").alias("c")).where("c > 1").select("k", "f"))
    d = d.join(firsts, "k", "left")
    revisit = F.col("f").isNotNull() & (~F.col("f.id").eqNullSafe(F.col("id")) | F.coalesce(F.col("f.row") != F.col("row"), F.lit(False)))
    d = d.select("id", "url", "p", F.col("f.id").alias("refers"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, n, done = Rolling(root, ".warc.gz", FILE_BYTES), 0, []
        for b in batches:
            for i in range(b.num_rows):
                key, url, data, refers, again = (b.column(c)[i].as_py() for c in range(5))
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                roll.write(pack.compress(record(key, url, data, refers, again, date)) + pack.flush())
                n += 1
                if roll.full:
                    done.append((roll.close(), n))
                    n = 0
        if n:
            done.append((roll.close(), n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "n_records"])

    return stage(d.mapInArrow(run, MANIFEST))


def _each(spark: SparkSession, manifest: DataFrame, root: str) -> tuple[DataFrame, str]:
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("path").repartition(n, "path"), root


def read(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """All sound records of the archives, one row each (RECORDS)."""
    names, root = _each(spark, manifest, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path) as f:
                    for kind, begin, _, row in salvage(f):
                        if kind == "record":
                            rows.append(row | {"path": path, "begin": begin})
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return names.mapInArrow(run, RECORDS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORDS.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema)


def gaps(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """The quarantined byte ranges of the archives: path, first byte, byte after the last."""
    names, root = _each(spark, manifest, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path) as f:
                    found = [(path, x[1], x[2]) for x in salvage(f) if x[0] == "gap"]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "begin", "end"), x)) for x in found], pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    return names.mapInArrow(run, "path string, begin bigint, end bigint")
