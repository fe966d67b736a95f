"""Joins and rankings that stay spread out when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join against a per-key table: the table is repeated per salt, the rows of
    a hot key are dealt over the salts.  Small enough tables Spark broadcasts anyway."""
    spread = [c for c in big.columns if c not in on] or big.columns
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


PIECE_ROWS = 65536
FINEST = 1024
STRIDE = 32


def value_positions(df: DataFrame, keys: list[str], value: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(keys, value, cnt, before, total): sorted position of every distinct value.

    Equal values collapse first.  A key of up to ``piece_rows`` distinct values is one
    window.  Sketched cut points deal the values of a larger key over ranges of about
    ``piece_rows`` (up to FINEST); they only balance the work, the positions are exact.
    No task ever sorts a whole hot key, and small keys cost no sketch each.
    """
    k = list(keys) or ["_all"]
    base = df.where(F.col(value).isNotNull()).select(*keys, value)
    base = base.dropna(subset=keys) if keys else base.withColumn("_all", F.lit(0))
    counts = base.groupBy(*k, value).agg(F.count(F.lit(1)).alias("cnt"))
    sizes = counts.groupBy(*k).agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("_d")).where(F.col("_d") > piece_rows)
    inside = lambda *by: Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    small = counts.join(sizes, k, "left_anti").withColumns(
        {"before": F.coalesce(F.sum("cnt").over(inside(*k)), F.lit(0)), "total": F.sum("cnt").over(Window.partitionBy(*k))}
    )
    hot = salted_join(counts, sizes, k)
    points = [i / FINEST for i in range(1, FINEST)]
    cuts = hot.groupBy(*k, "total", "_d").agg(F.percentile_approx(value, points, 4 * FINEST).alias("_c"))
    need = F.least(F.lit(FINEST), F.ceil(F.col("_d") / piece_rows))
    step = F.greatest(F.lit(1), F.floor(F.lit(FINEST) / need))
    thin = F.filter("_c", lambda c, i: (i + 1) % F.col("_s") == 0)
    cuts = cuts.withColumn("_s", step).select(*k, "total", thin.alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: (i + 1) % STRIDE == 0))
    tagged = salted_join(counts, cuts, k)
    below = lambda arr: F.size(F.filter(arr, lambda c: c < F.col(value)))
    tagged = tagged.withColumn("_j", below("_coarse") * STRIDE)
    fine = below(F.slice("_cuts", F.col("_j") + 1, F.lit(STRIDE)))
    tagged = tagged.withColumn("_piece", F.col("_j") + fine).drop("_cuts", "_coarse", "_j")
    before = Window.partitionBy(*k).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces_ = tagged.groupBy(*k, "_piece").agg(F.sum("cnt").alias("_n"))
    pieces_ = pieces_.select(*k, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    large = tagged.join(pieces_, [*k, "_piece"]).withColumn(
        "before", F.col("_off") + F.coalesce(F.sum("cnt").over(inside(*k, "_piece")), F.lit(0))
    )
    cols = [*keys, value, "cnt", "before", "total"]
    return small.select(*cols).unionByName(large.select(*cols))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per entry of ``qs``."""
    pos = value_positions(df, keys, value)
    picks: list[Column] = []
    for name, q in qs.items():
        p = F.lit(float(q)) * (F.col("total") - 1)
        for side, at in (("lo", F.floor(p)), ("hi", F.ceil(p))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    found = pos.groupBy(*keys).agg(F.max("total").alias("_total"), *picks)
    outs = []
    for name, q in qs.items():
        p = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (p - F.floor(p))).alias(name))
    return found.select(*keys, *outs)


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows with the 1-based average rank of ``value`` among the non-null rows of its key."""
    pos = value_positions(df, keys, value).select(
        *keys, F.col(value).alias("_v"), (F.col("before") + (F.col("cnt") + 1) / 2).alias(name)
    )
    left = df.withColumn("_v", F.col(value))
    return left.join(pos, [*keys, "_v"], "left").drop("_v")
