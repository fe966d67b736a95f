"""Walk-forward over calendar folds as a chain of stored stages: target, model, policy, scores.

Each stage of each fold is a table of its own, so a run that dies is taken up where it
stopped.  The driver walks over folds and stages only; every stage is a few Spark jobs
whose number does not depend on the number of tickers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import signals as G
from ..operators.blocks import BARS, Layout
from ..operators.spread import salted_join
from ..sources.store import exists, stage
from . import grouped as GR
from . import policies as PO
from . import targets as TG
from . import walkforward

STAGES = ("target", "own_scale", "own_beta", "all_scale", "all_beta", "policy", "scores")
# Bounds of both thresholds, rows a policy needs, policies of unknown tickers.
BUY, EDGE = (30.0, 55.0), (4.0, 12.0)
DEFAULT_BUY, DEFAULT_EDGE = 36.0, 4.0


class FoldStore:
    """Tables under ``root/fold=k/stage``.  ``settings`` are kept beside them: a store made
    with others is refused, as its finished stages would not fit."""

    def __init__(self, spark: SparkSession, root: str, settings: dict):
        self.spark, self.root = spark, root.rstrip("/")
        text = json.dumps(settings, sort_keys=True, default=str)
        path = f"{self.root}/settings"
        if exists(spark, f"{path}/_SUCCESS"):
            if spark.read.text(path).first()[0] != text:
                raise ValueError(f"{root} holds folds of other settings")
        else:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def path(self, fold: int, name: str) -> str:
        return f"{self.root}/fold={fold}/{name}"

    def done(self, fold: int, name: str) -> bool:
        """Whether the stage was written whole: the marker is the last file of a write."""
        return exists(self.spark, f"{self.path(fold, name)}/_SUCCESS")

    def table(self, fold: int, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, made first if it is not there or not whole."""
        if not self.done(fold, name):
            make().write.mode("overwrite").parquet(self.path(fold, name))
        return self.spark.read.parquet(self.path(fold, name))


def known_by(d: DataFrame, day: date, grid: TG.Grid) -> DataFrame:
    """Labels and forward returns that end before ``day``; the others become null."""
    ended = F.transform("ends", lambda e: F.coalesce(e < F.lit(day), F.lit(False)))
    d = d.withColumn("_ok", ended)
    fwd = F.zip_with("fwd", "_ok", lambda v, o: F.when(o, v))
    entry = F.zip_with("entry", F.transform(_horizon_at(grid), lambda i: F.get("_ok", i)), lambda v, o: F.when(o, v))
    return d.withColumns({"fwd": fwd, "entry": entry}).drop("_ok")


def _horizon_at(grid: TG.Grid) -> Column:
    return F.array(*[F.lit(grid.horizons.index(h)) for h, _, _ in grid.candidates])


def with_target(d: DataFrame, target: DataFrame, grid: TG.Grid) -> DataFrame:
    """Add ``label`` and ``fwd_ret`` of each ticker's own candidate; tickers without one take
    the first candidate."""
    d = salted_join(d, target.select("ticker", "cand"), ["ticker"], "left").withColumn("cand", F.coalesce("cand", F.lit(0)))
    return d.withColumns({"label": F.get("entry", F.col("cand")), "fwd_ret": F.get("fwd", F.get(_horizon_at(grid), F.col("cand")))})


def _scored(d: DataFrame, own: GR.KeyModels, pooled: GR.KeyModels) -> DataFrame:
    """Probability of the ticker's own model, else of the pooled one, else 0.5; score and edge."""
    d = pooled.score(own.score(d, "own"), "pooled")
    d = GR.with_fallback(d, ["own", "pooled"])
    return d.withColumns({"score": S.gain_score(), "expected_edge_bps": S.expected_edge(impulse=F.lit(0.5)), "position_side": F.lit(1), "impulse": F.lit(0.5)})


def policy_of(rows: DataFrame, tickers: DataFrame, floors: DataFrame, lay: Layout, *, min_rows: int, min_trades: int) -> DataFrame:
    """Policy per ticker from rows scored out of sample: isotonic proposals, search around
    them over chronological blocks, gate quality with a holdout."""
    rows = stage(rows.withColumn("y", F.col("net_ret") * 1e4))
    buy = PO.isotonic_threshold(rows, ["ticker"], "score", "y", lo=BUY[0], hi=BUY[1], name="buy").drop("reached")
    edge = PO.isotonic_threshold(rows, ["ticker"], "expected_edge_bps", "y", lo=EDGE[0], hi=EDGE[1], name="edge").drop("reached")
    centres = stage(buy.join(edge, "ticker"))
    grids = PO.centred_grids(centres, ["ticker"], buy_lo=BUY[0], buy_hi=BUY[1], edge_lo=EDGE[0], edge_hi=EDGE[1])
    blocks = walkforward.expanding_splits(rows, 3, lay).where("role = 'validate'")
    best = PO.best_of_grid(PO.grid_nets(blocks, grids, ["ticker"], "split"), ["ticker"], min_trades=min_trades)
    gate = rows.withColumns({"gate_score": F.col("proba"), "gate_ret": F.col("fwd_ret")})
    quality = PO.gate_quality(gate, floors, lay, min_rows=min_rows)
    return PO.policy_table(tickers, best, quality, centres, buy=DEFAULT_BUY, edge=DEFAULT_EDGE)


def fold_chain(d: DataFrame, folds: DataFrame, features: list[str], root: str, grid: TG.Grid, *, bars_per_year: float, calibration: float = 0.4, halflife: float = 120.0, search_folds: int = 4, min_rows: int = PO.MIN_ROWS, min_trades: int = PO.MIN_TRADES, lay: Layout = BARS) -> DataFrame:
    """Stitched scores of all test windows; see the stages below.

    ``d`` is ``targets.labelled`` and holds the features and round_trip_bps; ``folds`` comes
    from ``walkforward.windows``.  Within a fold nothing is read that ends on or after its
    first test day: ``target`` searches the label candidates of each ticker over purged
    blocks of the training window; the models (per ticker and pooled) are fitted with
    recency weights on labels that end before the calibration part, the last ``calibration``
    of the window; ``policy`` comes from that part's scores; ``scores`` are the test rows.
    Rows without a ticker or time have no part; a ticker new in the test window is scored
    by the pooled model under the default policy with no size.  No folds give no rows.
    """
    spark = d.sparkSession
    d = d.where(F.col("ticker").isNotNull() & F.col("ts").isNotNull())
    plan = folds.orderBy("fold").collect()  # a few rows
    settings = {"features": features, "grid": grid.candidates, "folds": [r.asDict() for r in plan], "bars_per_year": bars_per_year, "calibration": calibration, "halflife": halflife, "search_folds": search_folds, "min_rows": min_rows, "min_trades": min_trades}
    store = FoldStore(spark, root, settings)
    day = F.to_date("ts")
    parts = []
    for w in plan:
        fold, end = int(w["fold"]), w["test_start"]
        if store.done(fold, "scores"):
            parts.append(store.table(fold, "scores", None))
            continue
        cut = end - timedelta(days=int((end - w["train_start"]).days * calibration))
        train = known_by(d.where((day >= F.lit(w["train_start"])) & (day < F.lit(w["train_end"]))), end, grid)
        target = store.table(fold, "target", lambda: TG.best_entry(TG.search_entry(train, features, grid, k=search_folds, bars_per_year=bars_per_year)))
        own, pooled = _models(store, fold, train, target, features, grid, cut, halflife)

        def policy() -> DataFrame:
            rows = _scored(with_target(train.where(day >= F.lit(cut)), target, grid).where(F.col("fwd_ret").isNotNull()), own, pooled)
            cost = train.groupBy("ticker").agg(F.max("round_trip_bps").alias("_rt"))
            floors = cost.select("ticker", (F.col("_rt") * 1.25).alias("floor_bps"))
            rows = G.net_returns(rows, "fwd_ret").select("ticker", "ts", "proba", "score", "expected_edge_bps", "position_side", "impulse", "net_ret", "fwd_ret", "round_trip_bps")
            return policy_of(rows, cost, floors, lay, min_rows=min_rows, min_trades=min_trades)

        rules = store.table(fold, "policy", policy)

        def scores() -> DataFrame:
            test = with_target(d.where((day >= F.lit(w["test_start"])) & (day < F.lit(w["test_end"]))), target, grid)
            s = _scored(test, own, pooled).withColumn("fold", F.lit(fold).cast("bigint"))
            s = salted_join(s, rules.select("ticker", "buy_threshold", "min_edge_bps", "source", "soft_size"), ["ticker"], "left")
            s = s.withColumns({"buy_threshold": F.coalesce("buy_threshold", F.lit(DEFAULT_BUY)), "min_edge_bps": F.coalesce("min_edge_bps", F.lit(DEFAULT_EDGE)), "source": F.coalesce("source", F.lit("unknown_ticker")), "soft_size": F.coalesce("soft_size", F.lit(0.0))})
            enter = (F.col("score") >= F.col("buy_threshold")) & (F.col("expected_edge_bps") >= F.col("min_edge_bps")) & (F.col("soft_size") > 0)
            return s.select("ticker", "ts", "fold", "cand", "label", "fwd_ret", "round_trip_bps", "proba", "model_level", "score", "expected_edge_bps", "buy_threshold", "min_edge_bps", "source", "soft_size", enter.alias("enter"))

        parts.append(store.table(fold, "scores", scores))
    if not parts:
        return spark.createDataFrame([], "ticker string, ts timestamp_ntz, fold bigint, cand int, label double, fwd_ret double, round_trip_bps double, proba double, model_level string, score double, expected_edge_bps double, buy_threshold double, min_edge_bps double, source string, soft_size double, enter boolean")
    return reduce(DataFrame.unionByName, parts)


def _models(store: FoldStore, fold: int, train: DataFrame, target: DataFrame, features: list[str], grid: TG.Grid, cut: date, halflife: float) -> tuple[GR.KeyModels, GR.KeyModels]:
    """The fold's own and pooled models, read from the store or fitted on labels that end
    before ``cut``."""
    rows = None

    def fitted(key: str) -> GR.KeyModels:
        nonlocal rows
        if rows is None:
            fit = with_target(known_by(train, cut, grid), target, grid).where(F.col("label").isNotNull())
            fit = S.recency_weights(fit, F.lit(cut).cast("timestamp_ntz"), halflife)
            rows = stage(fit.select("ticker", "ts", *features, "label", "weight", F.lit("all").alias("_pool")))
        return GR.KeyModels.fit(rows, key, features, "label", weight="weight", spread=["ts", "ticker"] if key != "ticker" else ["ts"])

    out = []
    for name, key in (("own", "ticker"), ("all", "_pool")):
        model = None if store.done(fold, f"{name}_scale") and store.done(fold, f"{name}_beta") else fitted(key)
        scale = store.table(fold, f"{name}_scale", lambda: model.scale)  # noqa: B023
        beta = store.table(fold, f"{name}_beta", lambda: model.beta)  # noqa: B023
        out.append(GR.KeyModels(key, features, scale, beta))
    return out[0], _Pooled(out[1])


class _Pooled:
    """Scores every row by the one model of the pool."""

    def __init__(self, model: GR.KeyModels):
        self.model = model

    def score(self, df: DataFrame, name: str) -> DataFrame:
        return self.model.score(df.withColumn("_pool", F.lit("all")), name).drop("_pool")
