"""Whitening of embeddings by shifted Cholesky QR.

The centred rows A are never gathered.  Each pass sums the Gram matrix of A R^-1 over all
rows (R starts as the identity, the rows are solved against it inside the tasks) and
multiplies the Cholesky factor of that sum, shifted on the first passes so that it always
exists, into R.  Two or three passes make A R^-1 orthonormal.  The singular values and
vectors of R, with the square root of the last Gram sum folded in so that directions
without variance stay exact, are those of A.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are whole multiples of 1 / SCALE, moved by SHIFT to be positive.
SCALE, SHIFT = 64.0, 1_000_000
#: Passes at most, and the distance of the Gram sum from the identity that ends them.
PASSES, NEAR = 6, 1e-12
#: Directions whose standard deviation is under this part of the largest have no variance.
RANK_TOL = 1e-10
#: Rows of a batch solved at once.
ROWS = 4096


def integer_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(indexes of usable rows by length, their integers by length): rows that are not null
    and hold neither nulls nor non-finite numbers, as floor(SCALE * c) + SHIFT."""
    n = len(column)
    if not n:
        return {}, {}
    flat = column.flatten()  # null rows leave nothing behind
    ends = np.concatenate(([0], np.cumsum([0 if x is None else x for x in column.value_lengths().to_pylist()])))
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (bad[ends[1:]] == bad[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    where, rows = {}, {}
    for d in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == d))
        block = values[(ends[at][:, None] + np.arange(d)).astype(np.int64)]
        where[d], rows[d] = at, np.floor(SCALE * block).astype(np.int64) + SHIFT
    return where, rows


def _each(vectors: DataFrame, d: int, work: Callable[[Iterator[np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``work`` on a task's blocks of integer rows of length ``d``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (x[i : i + ROWS] for b in batches for x in [integer_rows(b.column(0))[1].get(d)] if x is not None for i in range(0, len(x), ROWS))
        out = list(work(blocks))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return vectors.mapInArrow(run, schema)


def totals(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums per place for each length of vector; each task sends one row per
    length and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = {}, {}
        for b in batches:
            for d, x in integer_rows(b.column(0))[1].items():
                n[d] = n.get(d, 0) + len(x)
                sums[d] = sums.get(d, 0) + x.sum(axis=0)
        rows = [(d, i, n[d], int(s)) for d in n for i, s in enumerate([0, *sums[d].tolist()])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["d", "i", "n", "s"])

    sent = vectors.mapInArrow(run, "d bigint, i bigint, n bigint, s bigint")
    found = sent.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # as many numbers as a vector has
    out: dict[int, tuple[int, dict]] = {}
    for d, i, n, s in found:
        out.setdefault(d, (n, {}))[1][i] = s
    return {d: (n, [s[i] for i in range(1, d + 1)]) for d, (n, s) in out.items()}


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n: the difference is taken in integers where they hold it."""
    if n * int(np.abs(x).max(initial=1)) < 1 << 62:
        return (n * x - s) / n
    return x - s.astype(np.float64) / n


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x R^-1 for an upper triangular R, column by column."""
    q = np.empty_like(x)
    for j in range(len(r)):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def summed(vectors: DataFrame, d: int, r: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram sum of ``rows_of`` each block (r columns).  Tasks send their sums row by row;
    these are added up by row, and the driver holds the r x r result."""

    def gram(blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
        total = None
        for x in blocks:
            q = rows_of(x)
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield from ((i, row.tobytes()) for i, row in enumerate(total))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["i", "row"])

    sent = _each(vectors, d, gram, "i bigint, row binary")
    added = sent.repartition("i").mapInArrow(add, "i bigint, row binary")
    g = np.zeros((r, r))
    for i, row in added.collect():
        g[i] += np.frombuffer(row)
    return (g + g.T) / 2


def factor(vectors: DataFrame, d: int, n: int, s: np.ndarray) -> np.ndarray:
    """A d x d matrix with the singular values and right vectors of the centred rows."""
    r, g = np.eye(d), None
    for i in range(PASSES):

        def rows_of(x: np.ndarray, r: np.ndarray | None = r if i else None) -> np.ndarray:
            return centred(x, n, s) if r is None else solved(centred(x, n, s), r)

        g = summed(vectors, d, d, rows_of)
        if i and np.abs(g - np.eye(d)).max() <= NEAR * max(1.0, d):
            break
        if i == PASSES - 1:
            break
        if not g.any():
            return np.zeros((d, d))  # equal rows
        # the shift of the first factor bounds the rounding of the sum, so it is positive
        norm = float(np.linalg.norm(g, 2))
        shift = 11 * (n * d + d * (d + 1)) * 2.0**-53 * norm if not i else 0.0
        shift = min(shift, norm * 1e-3)
        while True:
            try:
                step = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:
                shift = max(shift * 10, norm * 1e-15)
        r = step @ r
    # A'A = R' G R: the last sum corrects what is not orthonormal
    values, q = np.linalg.eigh(g)
    return (np.sqrt(np.maximum(values, 0))[:, None] * q.T) @ r


def components(vectors: DataFrame, d: int, n: int, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit vectors as columns, trace) of the covariance, by falling eigenvalue;
    directions without variance are left out.  The largest entry of a vector is positive."""
    _, sigma, vt = np.linalg.svd(factor(vectors, d, n, s))
    k = int((sigma > RANK_TOL * max(sigma[0], np.finfo(float).tiny)).sum()) if d else 0
    k = min(k, most)
    v = vt[:k].T
    if k:
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    return sigma[:k] ** 2 / n, v, float((sigma**2).sum() / n)


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - s) squared over a row; null where a long cannot hold one."""
    if not x.shape[1]:
        return [0] * len(x)
    reach = int(np.abs(x - s // n).max(initial=0)) + 1
    if n * int(np.abs(x).max(initial=1)) < 1 << 62 and (n * reach) ** 2 * x.shape[1] < 1 << 62:
        return ((n * x - s) ** 2).sum(axis=1).tolist()
    total = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in total]


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``) for each usable row and its first ``most`` components.

    Rows whose vector is null, or holds null or non-finite entries, go, and so do vectors
    of another length than the most frequent (of several, the longest).  Directions without
    variance have no component, so a table of equal rows, like an empty one, gives no row.
    Null ids stay null; repeated rows count and stay; other columns are not read.
    ``deviation`` is null where a long cannot hold it.
    """
    spark = vectors.sparkSession
    only = vectors.select(F.col(vector_col).alias("v"))
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sizes = {d: x for d, x in totals(only).items() if d}
    if not sizes:
        return spark.createDataFrame([], schema)
    d = max(sizes, key=lambda d: (sizes[d][0], d))
    n, s = sizes[d][0], np.array(sizes[d][1], np.int64)
    e, v, trace = components(only, d, n, s, most)
    k = len(e)
    project = v / np.sqrt(e)
    error = float(np.abs(summed(only, d, k, lambda x: centred(x, n, s) @ project) / n - np.eye(k)).max()) if k else 0.0
    share = (e / trace).tolist() if k else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows = integer_rows(b.column(1))
            if not k or d not in rows:
                continue
            for i in range(0, len(rows[d]), ROWS):
                x, at = rows[d][i : i + ROWS], where[d][i : i + ROWS]
                m = len(x)
                each = np.repeat(np.arange(m), k)
                ids = b.column(0).take(pa.array(at[each]))
                deviation = pa.array(deviations(x, n, s), pa.int64()).take(pa.array(each))
                white = (centred(x, n, s) @ project).ravel()
                numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m))
                columns = [ids, numbers, pa.array(np.full(m * k, n)), deviation, pa.array(white), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(id_col), F.col(vector_col).alias("v")).mapInArrow(run, schema)
