"""Token counts: vocabulary strings that encode alone as one token are counted at sight,
only the other pre-tokens are merged.

``whole_tokens`` proves the shortcut offline: it runs the model's own merges on every
vocabulary string and keeps those that give back exactly their own token.  The proof is
as large as the vocabulary, so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces, load, slices


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (in the model's own alphabet) that encode alone as their token."""
    tok = load(path)
    found = []
    for text, token in tok.get_vocab(with_added_tokens=False).items():
        merged = tok.model.tokenize(text)
        if len(merged) == 1 and merged[0].id == token:
            found.append(text)
    return frozenset(found)


_counters: dict[str, Pieces] = {}  # kept by a worker from task to task


def counter(path: str, whole: frozenset[str]) -> Pieces:
    """Pieces whose values are their numbers of tokens."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = _counter(path, whole)
    return _counters[path]


def _counter(path: str, whole: frozenset[str]) -> Pieces:
    tok = load(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    memo: dict[str, int] = {}

    def one(pre: str) -> int:
        if pre in whole:
            return 1
        n = memo.get(pre)
        if n is None:
            if len(memo) > 200_000:
                memo.clear()
            n = memo[pre] = len(tok.model.tokenize(pre))
        return n

    def count(texts: list[str]) -> list[int]:
        out = []
        for t in texts:
            if any(s in t for s in special):
                out.append(len(tok.encode(t, add_special_tokens=False).ids))
            else:
                out.append(sum(one(pre) for pre, _ in tok.pre_tokenizer.pre_tokenize_str(t)))
        return out

    return Pieces(count, spaces=True)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    For byte-level vocabularies without a normalizer.  A null text counts as empty
    (0 bytes, 0 tokens); a null id stays null; repeated rows stay repeated; an empty
    table gives an empty table; other columns are not read.  Very long texts are
    handled in slices, so memory follows the slice and not the text.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path, whole.value)
        for b in batches:
            counts = [sum(sum(pieces.values(s)) for s in slices(t)) if t else 0 for t in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("t"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
