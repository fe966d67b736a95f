"""The instrument dimension: class, costs, label spec and side policy per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import COSTS, ECONOMICS, EXITS, Costs
from .functions.frames import clip


def instrument_dim(tickers: DataFrame, costs: Costs = COSTS, horizon: int = 48, min_rows: int = 200) -> DataFrame:
    """(ticker, asset_class[, sides]) plus commission, slippage, round trip and label spec."""
    crypto = F.col("asset_class") == "crypto"
    d = tickers if "sides" in tickers.columns else tickers.withColumn("sides", F.lit("both"))
    d = d.withColumns(
        {
            "commission_bps": F.when(crypto, costs.commission_crypto).otherwise(costs.commission_tradfi),
            "slippage_bps": F.when(crypto, costs.slippage_crypto).otherwise(costs.slippage_tradfi),
            "vol_ref": F.when(crypto, costs.vol_ref_crypto).otherwise(costs.vol_ref_tradfi),
            "needs_ticks": crypto,
        }
    )
    d = d.withColumn("round_trip_bps", 2 * (F.col("commission_bps") + F.col("slippage_bps")))
    stop = F.lit(EXITS.stop_bps)
    return d.withColumns(
        {
            "horizon": F.lit(horizon),
            "label_type": F.lit("triple_barrier"),
            "stop_bps": stop,
            # least gross take-profit of a label: stop + both commissions + one default slippage
            "threshold_bps": stop + 2 * F.col("commission_bps") + costs.slippage_crypto,
            "min_rows": F.lit(min_rows),
        }
    )


def scaled_slippage(vol=None, costs: Costs = COSTS):
    """Slippage per side, scaled by clip(vol/ref, 0.5, 2) where the vol is known."""
    v = F.col(vol) if isinstance(vol, str) else vol
    scale = F.when(v.isNotNull() & (v > 0), clip(v / F.col("vol_ref"), *costs.vol_clip)).otherwise(1.0)
    return F.col("slippage_bps") * scale


def round_trip(vol=None, costs: Costs = COSTS):
    slip = F.col("slippage_bps") if vol is None else scaled_slippage(vol, costs)
    return 2 * (F.col("commission_bps") + slip)


def vol_scale(vol: str, e=ECONOMICS):
    return F.pow(clip(F.coalesce(F.col(vol), F.col("vol_ref")) / F.col("vol_ref"), *e.scale_clip), F.lit(e.vol_exp))


def economics_floor(vol: str, e=ECONOMICS):
    rt = round_trip(F.coalesce(F.col(vol), F.col("vol_ref")))
    return F.greatest(rt, rt * e.over_cost * vol_scale(vol, e))
