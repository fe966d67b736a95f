"""The scored panel the audit, signal and policy queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import in_blocks
from ..sources.store import stage
from .bars import SQL_SUPPLIERS, supplier_dim
from .base import DAILY, SQL_DAILY, W, daily, sql_scores, with_scores

SQL_SCORED = f"""{SQL_DAILY}, {SQL_SUPPLIERS},
fw AS (SELECT daily.*, lead(close, 12) OVER {W} / close - 1 AS fwd_ret, asset_class, sides, vol_ref, commission_bps, slippage_bps, 2 * (commission_bps + slippage_bps) AS round_trip_bps FROM daily JOIN dim USING (ticker)),
{sql_scores('fw')}"""

DIM_COLS = ["asset_class", "sides", "vol_ref", "commission_bps", "slippage_bps", "round_trip_bps"]


def stored(spark, sf) -> DataFrame:
    """The panel as a stored stage, for operators that read it several times."""
    return stage(scored(spark, sf))


def scored(spark, sf, days: DataFrame | None = None, more: tuple = ()) -> DataFrame:
    """``more`` are further columns of the instrument.  Its columns come to the narrow bars
    where their blocks are, so the bars are shuffled once."""
    days = daily(spark, sf) if days is None else days
    lists = [F.collect_list(F.struct(*cols)).alias(name) for name, cols in (("_dim", DIM_COLS), ("_more", more)) if cols]
    dim = supplier_dim(spark, sf).groupBy("ticker").agg(*lists)
    d = in_blocks(days, lambda x, w: x.withColumn("fwd_ret", F.lead("close", 12).over(w) / F.col("close") - 1), ahead=12, lay=DAILY, beside=dim)
    for name in ("_dim", "_more")[: len(lists)]:  # a row for each row of the instrument, as joins would give
        d = d.select(*[c for c in d.columns if c != name], F.inline(name))
    return with_scores(d)
