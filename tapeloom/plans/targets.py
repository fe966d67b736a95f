"""Search of label candidates per ticker: horizon, label type and threshold.

All candidates share one labelled table (labels as one array per row), one set of packed
blocks and one run of grouped fits: a ticker's candidates and purged folds are the arms of
its model, folds are masks.  Validation scores are counted into BINS bins per ticker,
candidate and fold, so every later step is bounded whatever the ticker's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as S
from ..functions.frames import clip
from ..operators import labels as L
from ..operators.aggregates import best_candidate
from ..operators.blocks import BARS, Layout, along_blocks, block_frame, finish_blocks
from ..operators.spread import salted_join
from ..sources.store import stage
from . import grouped as GR

#: Resolution of a validation score.
BINS = 1024
DOUBLES = T.ArrayType(T.DoubleType())
# The shipped grid, rows a fold needs to train and to validate, the weights of
# the direction score, its edge and accuracy scales, the shares it allows.
HORIZONS, TYPES, MULTS = (12, 24, 36, 48, 72, 96), ("triple_barrier", "after_costs"), (1.0, 1.25, 1.5)
DIRECTION_LEAST_HORIZON = 24
MIN_TRAIN, MIN_VALIDATE, DECILE_ROWS = 200, 50, 50
DIRECTION_WEIGHTS = {"accuracy": 0.35, "economics": 0.35, "balance": 0.20, "frequency": 0.10}
MAX_FLAT, MIN_DIRECTIONAL = 0.50, 0.35


@dataclass(frozen=True)
class Grid:
    """Candidates in the order of the label arrays."""

    horizons: tuple[int, ...] = HORIZONS
    types: tuple[str, ...] = TYPES
    mults: tuple[float, ...] = MULTS

    @property
    def candidates(self) -> list[tuple[int, str, float]]:
        return [(h, t, m) for h in self.horizons for t in self.types for m in ((1.0,) if t == "positive" else self.mults)]

    def rows(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *c) for i, c in enumerate(self.candidates)], "cand int, horizon int, label_type string, threshold_mult double")


def labelled(df: DataFrame, grid: Grid, lay: Layout = BARS) -> DataFrame:
    """Add ``fwd`` and ``ends`` (forward return and last day of the label, per horizon),
    ``entry`` and ``direction`` (per candidate).  ``df`` holds close, cost_floor_bps and stop_bps.

    The path is read once up to the longest horizon: a barrier counts for a horizon if it is
    touched within it.
    """
    longest, levels = max(grid.horizons), sorted(set(grid.mults) | {1.0})
    given = {"_day": F.unix_date(F.to_date(lay.order[0])), "_stop": F.col("stop_bps") / L.BPS, **{f"_thr{i}": F.round(F.col("cost_floor_bps") * m, 2) / L.BPS for i, m in enumerate(levels)}}
    names = {"fwd": DOUBLES, "ends": T.ArrayType(T.DateType()), "entry": DOUBLES, "direction": DOUBLES}
    d, _ = block_frame(df.withColumns(given), ahead=longest, lay=lay)
    d = along_blocks(d, ["close", *given], names, lambda *x: _labels(grid, levels, *x), lay.keys, lay.order[0])
    return finish_blocks(d).drop(*given)


def _labels(grid: Grid, levels: list[float], back: np.ndarray, close: np.ma.MaskedArray, day: np.ma.MaskedArray, stop: np.ma.MaskedArray, *thr: np.ma.MaskedArray) -> list[np.ma.MaskedArray]:
    """Matrices (rows by horizon or candidate) of ``labelled``, one step ahead at a time.  A path
    is the closes that are there among the rows ahead; NaN is above all numbers, as in Spark."""
    size, longest = len(close), max(grid.horizons)
    none = longest + 1
    n, steps = L.path_steps(back, close, longest)
    levels_up = [*thr, stop]
    up, dn = ([np.full(size, none, dtype=np.int32) for _ in levels_up] for _ in range(2))
    fwd = {h: np.ma.masked_all(size) for h in grid.horizons}
    level = [(t.data, ~np.ma.getmaskarray(t)) for t in levels_up]
    with np.errstate(all="ignore"):
        for k, x, ok in steps:
            high = np.isnan(x)
            for j, (t, given) in enumerate(level):
                on = ok & given
                up[j][on & (up[j] == none) & ((x >= t) | high)] = k
                dn[j][on & (dn[j] == none) & (x <= -t)] = k
            if k in fwd:
                fwd[k] = np.ma.array(x, mask=~ok)
    ends = np.ma.masked_all((size, len(grid.horizons)))
    for i, h in enumerate(grid.horizons):
        later = back[h:] >= h
        ends[: max(size - h, 0), i] = np.ma.array(day.data[h:], mask=~later | np.ma.getmaskarray(day)[h:])
    entry, way = (np.ma.masked_all((size, len(grid.candidates))) for _ in range(2))
    for c, (h, kind, m) in enumerate(grid.candidates):
        j, full = levels.index(m), n >= h
        if kind == "triple_barrier":
            u, d, us, ds = (np.where(v <= h, v, none) for v in (up[j], dn[j], up[-1], dn[-1]))
            long, short = np.where(u < ds, u, none), np.where(d < us, d, none)
            is_long, is_short = long < short, short < long
            entry[:, c] = np.ma.array((long < none).astype(float), mask=~((u < none) | (ds < none) | full))
            way[:, c] = np.ma.array(np.where(is_long, 1.0, np.where(is_short, 2.0, 0.0)), mask=~(is_long | is_short | (long < none) | full))
            continue
        f, there = fwd[h].data, ~np.ma.getmaskarray(fwd[h])
        with np.errstate(all="ignore"):
            if kind == "positive":
                rises, falls = (f > 0) | np.isnan(f), f < 0
            else:
                there &= level[j][1]
                rises, falls = (f >= level[j][0]) | np.isnan(f), f <= -level[j][0]
        rises, falls = rises & there, falls & there
        entry[:, c] = np.ma.array(rises.astype(float), mask=~(full & there))
        way[:, c] = np.ma.array(np.where(rises & ~falls, 1.0, np.where(falls & ~rises, 2.0, 0.0)), mask=~full)
    return [np.ma.stack([np.ma.array(fwd[h], mask=np.ma.getmaskarray(fwd[h]) | (n < h)) for h in grid.horizons], axis=1), ends, entry, way]


def fold_bounds(df: DataFrame, k: int) -> list[tuple]:
    """(first day, day after the last) of k chronological test blocks of equal numbers of days."""
    days = df.select(F.to_date("ts").alias("day")).where(F.col("day").isNotNull()).distinct()
    n = days.count()
    if n < 2 * k:
        return []
    at = days.withColumn("_i", F.row_number().over(Window.orderBy("day")) - 1)  # one row per day
    size = n // k
    starts = [r.day for r in at.where((F.col("_i") % size == 0) & (F.col("_i") < k * size)).orderBy("day").collect()]
    last = days.agg(F.date_add(F.max("day"), 1)).first()[0]
    return list(zip(starts, [*starts[1:], last]))


def masks(bounds: list[tuple], horizons: int, purge: int) -> Column:
    """Weights (horizon by fold): 1 for rows whose label ends before the test block, or that
    begin ``purge`` days after it."""
    day = F.to_date("ts")
    out = []
    for h in range(horizons):
        for start, end in bounds:
            ahead = F.coalesce(F.col("ends")[h] < F.lit(start), F.lit(False))
            out.append(F.when(ahead | (day >= F.date_add(F.lit(end), purge)), 1.0).otherwise(0.0))
    return F.array(*out)


def test_fold(bounds: list[tuple]) -> Column:
    """The test block of a row, -1 outside."""
    day = F.to_date("ts")
    return F.coalesce(*[F.when((day >= F.lit(a)) & (day < F.lit(b)), float(i)) for i, (a, b) in enumerate(bounds)], F.lit(-1.0))


def _blocks(d: DataFrame, features: list[str], y: Column, bounds: list[tuple], grid: Grid, purge: int) -> DataFrame:
    scale = stage(GR.scales(d, ["ticker"], features))
    more = F.concat(F.array(test_fold(bounds)), F.transform("fwd", lambda x: F.coalesce(x, F.lit(float("nan")))))
    d = salted_join(d, scale, ["ticker"]).select("ticker", "_n", "ts", GR.inputs(features).alias("_x"), F.transform(y, lambda x: F.coalesce(x, F.lit(float("nan")))).alias("_y"), masks(bounds, len(grid.horizons), purge).alias("_w"), more.alias("_more"))
    return GR.packed(d, ["ticker"], ["ts"], "_x", "_y", "_w", "_more")


def _validated(row, n_cand: int, per: int) -> list[tuple]:
    """For each fold with rows: (fold, rows, probabilities (rows, candidates * per), fitted)."""
    x, more = GR._matrix(row["x"], row["n"]), GR._matrix(row["more"], row["n"])
    arms = n_cand * per
    k = len(row["fitted"]) // arms
    beta, fitted = np.asarray(row["beta"]).reshape(arms, k, -1), np.asarray(row["fitted"]).reshape(arms, k)
    out = []
    for f in range(k):
        at = np.flatnonzero(more[:, 0] == f)
        if len(at):
            out.append((f, at, GR._sigmoid(x[at] @ beta[:, f].T), fitted[:, f]))
    return out


def _counted(row, cands: int, where: np.ndarray):
    """For each fold with rows: (fold, rows, positives, and rows, sum and squares of forward
    returns, each a matrix candidate by bin)."""
    y_all, more = GR._matrix(row["y"], row["n"]), GR._matrix(row["more"], row["n"])
    for f, at, p, fitted in _validated(row, cands, 1):
        y, r = y_all[at], more[at][:, 1 + where]
        ok = ~np.isnan(y) & fitted
        cell = (np.arange(cands) * BINS + np.minimum((p * BINS).astype(int), BINS - 1))[ok]
        have = ~np.isnan(r[ok])
        fwd = np.where(have, r[ok], 0.0)
        yield f, *[np.bincount(cell, weights=v, minlength=cands * BINS).reshape(cands, BINS) for v in (None, y[ok], have.astype(float), fwd, fwd**2)]


def entry_metrics(blocks: DataFrame, beta: DataFrame, grid: Grid) -> DataFrame:
    """(ticker, cand, fold, metrics) of the validation rows.  A ticker of one block has them
    from its bins where they are counted, as its bins are about as many as its rows; the
    bins of longer ones are added up first."""
    cands = len(grid.candidates)
    where = np.array([grid.horizons.index(h) for h, _, _ in grid.candidates])
    own = GR.beside(blocks, beta.select("ticker", "blocks", "beta", "fitted").withColumnRenamed("blocks", "_blocks").withColumn("blocks", F.col("_blocks")), ["ticker"])

    def count(pdfs):
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                for f, *each in _counted(row, cands, where):
                    cand, met = np.nonzero(each[0])
                    yield pd.DataFrame({"ticker": row["ticker"], "cand": cand, "fold": f, "bin": met, **{c: v[cand, met].astype(float) for c, v in zip(("n", "pos", "fn", "fsum", "fsq"), each)}})

    def measure(pdfs):
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                for f, *each in _counted(row, cands, where):
                    m = pd.DataFrame(measured(*each)).assign(ticker=row["ticker"], cand=np.arange(cands), fold=f)
                    yield m[m["n"] > 0]

    sent = own.where("_blocks > 1").mapInPandas(count, "ticker string, cand int, fold int, bin int, n double, pos double, fn double, fsum double, fsq double")
    bins = sent.groupBy("ticker", "cand", "fold", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "fn", "fsum", "fsq")])
    several = bin_metrics(stage(bins), ["ticker", "cand", "fold"])
    names = ", ".join(f"{c} double" for c in METRICS)
    return own.where("_blocks = 1").mapInPandas(measure, f"ticker string, cand int, fold int, {names}").unionByName(several)


METRICS = ("n", "accuracy", "precision", "recall", "auc", "pr_auc", "edge_corr", "gross_bps")


def measured(n: np.ndarray, pos: np.ndarray, fn: np.ndarray, fsum: np.ndarray, fsq: np.ndarray) -> dict[str, np.ndarray]:
    """``bin_metrics`` of every row of matrices by bin; NaN where it has null."""
    n = n.astype(float)
    p, neg = (np.arange(BINS) + 0.5) / BINS, n - pos
    before = lambda x: np.cumsum(x, 1) - x
    upward = lambda x: np.cumsum(x[:, ::-1], 1)[:, ::-1]
    whole = lambda x: x.sum(1)
    total, npos, rows = whole(n), whole(pos), whole(fn)
    with np.errstate(all="ignore"):
        over = lambda a, b, other: np.where(b != 0, a / b, other)
        at, first = 0.9 * (rows - 1), before(fn)
        # the bin that holds the row at this position
        bin_at = lambda i: p[np.minimum((first + fn <= i[:, None]).sum(1), BINS - 1)]
        lo, hi = bin_at(np.floor(at)), bin_at(np.ceil(at))
        top = p >= (lo + (hi - lo) * (at - np.floor(at)))[:, None]
        hat = p >= np.maximum(0.5, npos / total)[:, None]
        s, sp, sr, p2, r2 = whole(p * fsum), whole(p * fn), whole(fsum), whole(p * p * fn), whole(fsq)
        spread = np.sqrt(np.maximum((rows * p2 - sp * sp) * (rows * r2 - sr * sr), 0.0))
        hit = whole(np.where(hat, pos, 0.0))
        return {
            "n": total, "accuracy": whole(np.where(hat, pos, neg)) / total,
            "precision": over(hit, whole(np.where(hat, n, 0.0)), 0.0), "recall": over(hit, npos, 0.0),
            "auc": over(whole(pos * (before(neg) + neg / 2)), npos * whole(neg), 0.5),
            "pr_auc": over(whole(np.where(pos > 0, pos * upward(pos) / upward(n), 0.0)), npos, 0.0),
            "edge_corr": over(rows * s - sp * sr, spread, 0.0),
            "gross_bps": np.where(rows >= DECILE_ROWS, over(whole(np.where(top, fsum, 0.0)), whole(np.where(top, fn, 0.0)), np.nan) * L.BPS, np.nan),
        }


def bin_metrics(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of each key from its bins (at most BINS rows): the score is the bin's middle.
    The top decile is null under DECILE_ROWS rows."""
    whole = Window.partitionBy(*keys)
    up = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    down = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda x: F.coalesce(F.sum(x).over(up), F.lit(0.0))
    d = bins.withColumns({"p": (F.col("bin") + 0.5) / BINS, "neg": F.col("n") - F.col("pos")})
    d = d.withColumns({"_neg": before("neg"), "_fn": before("fn"), "_rows": F.sum("fn").over(whole), "_all": F.sum("n").over(whole), "_pos": F.sum("pos").over(whole), "_ge": F.sum("n").over(down), "_gepos": F.sum("pos").over(down)})
    at = 0.9 * (F.col("_rows") - 1)
    holds = lambda i: (F.col("_fn") <= i) & (i < F.col("_fn") + F.col("fn"))
    d = d.withColumns({"_lo": F.max(F.when(holds(F.floor(at)), F.col("p"))).over(whole), "_hi": F.max(F.when(holds(F.ceil(at)), F.col("p"))).over(whole)})
    cut = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))
    top, hat = F.col("p") >= cut, F.col("p") >= F.greatest(F.lit(0.5), F.col("_pos") / F.col("_all"))
    of = lambda cond, x: F.sum(F.when(cond, F.col(x)).otherwise(0.0))
    nz = lambda x: F.nullif(x, F.lit(0.0))
    s, p, r, n = F.sum(F.col("p") * F.col("fsum")), F.sum(F.col("p") * F.col("fn")), F.sum("fsum"), F.sum("fn")
    p2, r2 = F.sum(F.col("p") * F.col("p") * F.col("fn")), F.sum("fsq")
    spread = F.sqrt(F.greatest((n * p2 - p * p) * (n * r2 - r * r), F.lit(0.0)))
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        ((F.sum(F.when(hat, F.col("pos")).otherwise(F.col("neg")))) / F.sum("n")).alias("accuracy"),
        F.coalesce(of(hat, "pos") / nz(of(hat, "n")), F.lit(0.0)).alias("precision"),
        F.coalesce(of(hat, "pos") / nz(F.sum("pos")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.sum(F.col("pos") * (F.col("_neg") + F.col("neg") / 2)) / nz(F.sum("pos") * F.sum("neg")), F.lit(0.5)).alias("auc"),
        F.coalesce(F.sum(F.col("pos") * F.col("_gepos") / F.col("_ge")) / nz(F.sum("pos")), F.lit(0.0)).alias("pr_auc"),
        F.coalesce((n * s - p * r) / nz(spread), F.lit(0.0)).alias("edge_corr"),
        F.when(n >= DECILE_ROWS, of(top, "fsum") / nz(of(top, "fn")) * L.BPS).alias("gross_bps"),
    )


def search_entry(d: DataFrame, features: list[str], grid: Grid = Grid(), *, k: int = 4, purge: int = 1, bars_per_year: float, rounds: int = 8) -> DataFrame:
    """(ticker, cand, ...): purged-fold metrics and score of every candidate that had a fold.

    ``d`` is ``labelled`` and holds the features and round_trip_bps.
    """
    spark = d.sparkSession
    d = stage(d.select("ticker", "ts", *features, "round_trip_bps", "fwd", "ends", "entry"))
    bounds = fold_bounds(d, k)
    schema = "ticker string, cand int, n_folds bigint, cv double, net_edge_bps double, positive_rate double"
    if not bounds:
        return _scored_entry(spark.createDataFrame([], schema), grid, bars_per_year)
    blocks = _blocks(d, features, F.col("entry"), bounds, grid, purge)
    k, cands = len(bounds), grid.candidates
    arms = [(c, grid.horizons.index(h) * k + f) for c, (h, _, _) in enumerate(cands) for f in range(k)]
    beta = fit = GR.fit_logistic(blocks, ["ticker"], arms, rounds=rounds, balance=False, min_rows=MIN_TRAIN)
    m = entry_metrics(blocks, beta, grid).where(F.col("n") >= MIN_VALIDATE)
    cost = d.groupBy("ticker").agg(F.max("round_trip_bps").alias("_rt"))
    m = salted_join(m, cost, ["ticker"], salts=1).withColumn("top_decile_net_bps", F.col("gross_bps") - F.col("_rt"))
    rate = fit.select("ticker", F.posexplode(F.zip_with("positives", "n", lambda a, b: a / F.nullif(b, F.lit(0.0))))).select("ticker", F.floor(F.col("pos") / k).cast("int").alias("cand"), F.pmod("pos", F.lit(k)).alias("fold"), F.col("col").alias("_rate"))
    m = m.join(rate, ["ticker", "cand", "fold"])
    names = ("accuracy", "precision", "recall", "auc", "pr_auc", "edge_corr", "top_decile_net_bps")
    g = m.groupBy("ticker", "cand").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("_rate").alias("positive_rate"), *[F.round(F.avg(c), 4).alias(c) for c in names])
    g = g.withColumns({"cv": S.composite(list(names)), "net_edge_bps": F.coalesce("top_decile_net_bps", F.lit(0.0))})
    return _scored_entry(g.select("ticker", "cand", "n_folds", "cv", "net_edge_bps", "positive_rate"), grid, bars_per_year)


def _scored_entry(g: DataFrame, grid: Grid, bars_per_year: float) -> DataFrame:
    g = g.join(grid.rows(g.sparkSession), "cand").withColumn("bars_per_year", F.lit(float(bars_per_year)))
    return g.withColumn("score", S.target_score()).drop("bars_per_year")


def best_entry(found: DataFrame) -> DataFrame:
    """Per ticker the best score among candidates with a positive net edge, else the least
    negative edge; the shorter horizon and lower threshold of equals."""
    won = F.col("net_edge_bps") > 0
    d = found.withColumns({"_s": F.when(won, F.col("score")).otherwise(F.col("net_edge_bps")), "_t": -F.col("cand")})
    return best_candidate(d, ["ticker"], won.cast("int"), "_s", "_t").drop("_s", "_t")


def direction_rates(d: DataFrame, grid: Grid) -> DataFrame:
    """(ticker, cand, n, shares and forward edges of the classes) over all labelled rows.  A
    short edge counts with its sign turned; a class without rows has edge 0."""
    each = d.select("ticker", "fwd", F.posexplode("direction").alias("cand", "way")).where(F.col("way").isNotNull())
    fwd = F.get("fwd", F.get(F.array(*[F.lit(grid.horizons.index(h)) for h, _, _ in grid.candidates]), F.col("cand")))
    each = each.withColumn("_f", fwd * L.BPS)
    share = lambda v: F.avg((F.col("way") == v).cast("double"))
    edge = lambda v, s: F.coalesce(F.avg(F.when(F.col("way") == v, s * F.col("_f"))), F.lit(0.0))
    return each.groupBy("ticker", "cand").agg(
        F.count(F.lit(1)).alias("n"), share(0).alias("flat_rate"), share(1).alias("long_rate"), share(2).alias("short_rate"),
        edge(0, 1).alias("flat_edge_bps"), edge(1, 1).alias("long_edge_bps"), edge(2, -1).alias("short_edge_bps"),
    )


def direction_hits(blocks: DataFrame, beta: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(ticker, cand, fold, n, hits): validation rows and those whose likeliest class is right."""
    c = len(grid.candidates)

    def count(pdfs):
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                y_all = GR._matrix(row["y"], row["n"])
                for f, at, p, fitted in _validated(row, c, 3):
                    p = np.where(fitted, p, -1.0).reshape(len(at), c, 3)
                    y = y_all[at]
                    ok = ~np.isnan(y) & (fitted.reshape(c, 3).sum(1) > 1)
                    hit = ok & (p.argmax(2) == y)
                    yield pd.DataFrame({"ticker": row["ticker"], "cand": np.arange(c), "fold": f, "n": ok.sum(0), "hits": hit.sum(0)})

    own = GR.beside(blocks, beta.select("ticker", "blocks", "beta", "fitted"), ["ticker"])
    sent = own.mapInPandas(count, "ticker string, cand int, fold int, n bigint, hits bigint")
    return sent.groupBy("ticker", "cand", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def direction_score(*, tpy: float = 30.0, pen: float = 0.0008) -> Column:
    """Score of a direction candidate: accuracy, the worse side's edge, balance and frequency,
    less what is too flat; candidates that lose on a side only up to a quarter."""
    one = lambda x: clip(x, 0, 1)
    w, h = DIRECTION_WEIGHTS, F.greatest(F.lit(1.0), F.col("horizon").cast("double"))
    long_, short = F.col("long_edge_bps"), F.col("short_edge_bps")
    acc, econ = one((F.col("direction_accuracy") - 0.33) / 0.20), one(F.least(long_, short) / 80.0)
    rates = ("flat_rate", "long_rate", "short_rate")
    bal, freq = S.direction_balance(*rates), one((F.col("long_rate") + F.col("short_rate")) * F.col("bars_per_year") / h / max(tpy, 1.0))
    flat_p, dir_p = S.direction_penalties(*rates, MAX_FLAT, MIN_DIRECTIONAL)
    blended = (w["accuracy"] * acc + w["economics"] * econ + w["balance"] * bal + w["frequency"] * freq) / sum(w.values()) * flat_p * dir_p
    losers = (w["accuracy"] * acc + w["balance"] * bal + w["frequency"] * freq) / (sum(w.values()) - w["economics"])
    return F.round(F.greatest(F.lit(0.0), F.when((long_ > 0) & (short > 0), 0.5 + 0.5 * blended).otherwise(0.25 * losers) - pen * h), 4)


def search_direction(d: DataFrame, features: list[str], grid: Grid, *, k: int = 4, purge: int = 1, bars_per_year: float, rounds: int = 8) -> DataFrame:
    """(ticker, cand, ...): accuracy over purged folds, shares, edges and score of every
    direction candidate that had a fold.  Each class is an arm over the same labels, weighed to
    equal classes."""
    spark = d.sparkSession
    d = stage(d.select("ticker", "ts", *features, "fwd", "ends", "direction"))
    bounds = fold_bounds(d, k)
    rates = direction_rates(d, grid)
    if bounds:
        blocks = _blocks(d, features, F.col("direction"), bounds, grid, purge)
        n = len(bounds)
        arms = [(c, grid.horizons.index(h) * n + f, float(i)) for c, (h, _, _) in enumerate(grid.candidates) for i in range(3) for f in range(n)]
        beta = GR.fit_logistic(blocks, ["ticker"], arms, rounds=rounds, min_rows=MIN_TRAIN)
        hits = direction_hits(blocks, beta, grid, n).where(F.col("n") >= MIN_VALIDATE)
        acc = hits.groupBy("ticker", "cand").agg(F.round(F.avg(F.col("hits") / F.col("n")), 4).alias("direction_accuracy"), F.count(F.lit(1)).alias("n_folds"))
    else:
        acc = spark.createDataFrame([], "ticker string, cand int, direction_accuracy double, n_folds bigint")
    g = rates.join(acc, ["ticker", "cand"]).join(grid.rows(spark), "cand").withColumn("bars_per_year", F.lit(float(bars_per_year)))
    return g.withColumn("score", direction_score()).drop("bars_per_year")


def best_direction(found: DataFrame) -> DataFrame:
    """Per ticker the best score among feasible candidates that earn on both sides, else among
    feasible ones, else the candidate whose worse side loses least."""
    feasible = (F.col("flat_rate") <= MAX_FLAT) & (F.col("long_rate") + F.col("short_rate") >= MIN_DIRECTIONAL)
    worse = F.least("long_edge_bps", "short_edge_bps")
    tier = F.when(feasible & (worse > 0), 2).when(feasible, 1).otherwise(0)
    d = found.withColumns({"_s": F.when(feasible, F.col("score")).otherwise(worse), "_t": -F.col("cand"), "feasible": feasible})
    return best_candidate(d, ["ticker"], tier, "_s", "_t").drop("_s", "_t")
