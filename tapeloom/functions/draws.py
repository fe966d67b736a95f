"""Random numbers as functions of counters, in integer arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Multiplier and mask of a 32-bit mixing function; products stay below 2^59.
FACTOR, MASK = 0x45D9F3B, 0xFFFFFFFF


def mixed(x: int) -> int:
    """A well-mixed 32-bit number of a 32-bit number, one to one."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * FACTOR & MASK
    return (x >> 16) ^ x


def with_draw(df: DataFrame, name: str, seed: int, counters: list[str]) -> DataFrame:
    """Add ``name``: a number from 0 to 2^32 - 1 that depends on the seed and the counters
    (their lower 32 bits) alone.  Rows in any order and any engine draw the same.

    Every step is a projection of its own, so no step's expression is written out twice.
    """
    d = df.withColumn(name, F.lit(mixed(seed & MASK)).cast("long"))
    halves = lambda: F.shiftright(name, 16).bitwiseXOR(F.col(name))
    for c in counters:
        d = d.withColumn(name, F.col(name).bitwiseXOR(F.col(c).cast("long").bitwiseAND(F.lit(MASK))))
        for _ in range(2):
            d = d.withColumn(name, (halves() * FACTOR).bitwiseAND(F.lit(MASK)))
        d = d.withColumn(name, halves())
    return d


def sql_draw(source: str, name: str, seed: int, counters: list[str]) -> str:
    """The same as SQL: a subquery over ``source`` with the column ``name`` added."""
    out = f"(SELECT *, CAST({mixed(seed & MASK)} AS BIGINT) AS {name} FROM {source})"
    step = lambda inner, e: f"(SELECT * REPLACE ({e} AS {name}) FROM {inner})"
    halves = f"xor({name} >> 16, {name})"
    for c in counters:
        out = step(out, f"xor({name}, CAST({c} AS BIGINT) & {MASK})")
        for _ in range(2):
            out = step(out, f"({halves} * {FACTOR}) & {MASK}")
        out = step(out, halves)
    return out
