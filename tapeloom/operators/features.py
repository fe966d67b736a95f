"""Causal bar features.  Functions take (frame, w) and are run inside ``in_blocks``;
the ``*_BACK`` numbers say how many earlier rows a stage needs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import change, clip, guarded, log_return, nz, rmean, rmedian, rstd, rsum, trailing, zero
from .blocks import BARS, Layout, along_blocks, block_frame, fill_forward, finish_blocks, in_blocks, running, trailing_moments, trailing_stats, with_position
from .spread import salted_join

# kernel envelope: lookback bars, bandwidth, band width in deviations
NW = {"lookback": 48, "bandwidth": 6.0, "mult": 2.0}
NW_RULE = {"lookback": 80, "bandwidth": 24.0, "mult": 2.0, "band": 40, "touch": 0.12}
EMA_CHUNK = 512
MACD_BACK = 4 * EMA_CHUNK


def returns(d: DataFrame, w: WindowSpec, steps: tuple[int, ...] = (1, 6, 12, 24)) -> DataFrame:
    return d.withColumns({f"ret_{k}": change("close", w, k) for k in steps})


def imbalance_stats(d: DataFrame, w: WindowSpec) -> DataFrame:
    d = d.withColumn("_imb", zero("vol_imbalance"))
    z = (F.col("_imb") - rmean("_imb", w, 48, 12)) / nz(rstd("_imb", w, 48, 12))
    return d.withColumns({"imb_ma_6": rmean("_imb", w, 6, 1), "imb_ma_12": rmean("_imb", w, 12, 1), "imb_z": z}).drop("_imb")


def volume_and_body(d: DataFrame, w: WindowSpec) -> DataFrame:
    d = d.withColumn("_v", zero("volume"))
    return d.withColumns(
        {
            "vol_z": F.col("_v") / nz(rmean("_v", w, 20, 5)),
            "body_pct": (F.col("close") - F.col("open")) / nz("open"),
        }
    ).drop("_v")


def session_position(df: DataFrame) -> DataFrame:
    """Bar number inside its session and progress to the session's final bar (a look-ahead
    column, kept out of model inputs)."""
    w = Window.partitionBy("ticker", "session")
    pos = F.row_number().over(w.orderBy("ts")) - 1
    size = F.count("close").over(w)
    return df.withColumns({"session_pos": pos, "session_progress": pos / F.greatest(size - 1, F.lit(1))})


def candle_shape(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    hl = nz(h - l)
    low = F.greatest(F.least(o, c) - l, F.lit(0.0))
    up = F.greatest(h - F.greatest(o, c), F.lit(0.0))
    body = F.abs(c - o)
    return df.withColumns(
        {
            "clv": zero(clip(((c - l) - (h - c)) / hl, -1, 1)),
            "lower_wick_ratio": zero(low / hl),
            "upper_wick_ratio": zero(up / hl),
            "body_ratio": zero(body / hl),
            "hammer_score": F.coalesce(low / nz(body), zero(low / hl)),
            "_wick_bias": zero(clip((low - up) / hl, -1, 1)),
        }
    )


def candle_flow(df: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Volume split into buys and sells by candle shape; a doji takes the last body's sign."""
    d = running(candle_shape(df), {"_bs": ("last", nz(F.signum(F.col("close") - F.col("open"))))}, lay)
    share = clip(
        0.45 * (F.col("clv") + 1) / 2 + 0.30 * (F.col("_wick_bias") + 1) / 2 + 0.25 * (zero("_bs") + 1) / 2, 0, 1
    )
    v = zero("volume")
    d = d.withColumn("buy_share", share).withColumns({"buy_vol_est": v * share, "sell_vol_est": v * (1 - share)})
    imb = zero((F.col("buy_vol_est") - F.col("sell_vol_est")) / nz(v))
    return d.withColumn("vol_imbalance", imb).drop("_bs", "_wick_bias")


def hybrid_flow(df: DataFrame, flow: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Tick imbalance replaces the candle estimate where ticks exist."""
    d = candle_flow(df, lay).join(flow.select("ticker", "ts", "buy_count", "sell_count"), ["ticker", "ts"], "left")
    b, s = zero("buy_count"), zero("sell_count")
    live = b + s > 0
    tick = F.when(live, (b - s) / (b + s)).otherwise(0.0)
    d = d.withColumns({"tick_imbalance": tick, "flow_source": F.when(live, 1.0).otherwise(0.0)})
    share = (F.col("tick_imbalance") + 1) / 2
    d = d.withColumns(
        {
            "vol_imbalance": F.when(live, F.col("tick_imbalance")).otherwise(F.col("vol_imbalance")),
            "buy_share": F.when(live, share).otherwise(F.col("buy_share")),
        }
    )
    return d.withColumns(
        {
            "buy_vol_est": F.when(live, F.col("volume") * F.col("buy_share")).otherwise(F.col("buy_vol_est")),
            "sell_vol_est": F.when(live, F.col("volume") * (1 - F.col("buy_share"))).otherwise(F.col("sell_vol_est")),
        }
    )


def kernel_weights(lookback: int, bandwidth: float) -> list[float]:
    raw = [math.exp(-0.5 * (i / bandwidth) ** 2) for i in range(lookback)]
    total = math.fsum(raw)
    return [x / total for x in raw]


def kernel_estimate(w: WindowSpec, lookback: int, bandwidth: float, value: str = "close") -> Column:
    """Causal Gaussian-kernel mean; null until ``lookback`` non-null rows exist."""
    terms = [F.lit(k) * (F.col(value) if i == 0 else F.lag(value, i).over(w)) for i, k in enumerate(kernel_weights(lookback, bandwidth))]
    while len(terms) > 1:  # pairwise, to keep the expression shallow
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


ENVELOPE_BACK = 48 + 24 + 8


def envelope(d: DataFrame, w: WindowSpec, p: dict = NW) -> DataFrame:
    d = d.withColumn("nw_est", kernel_estimate(w, p["lookback"], p["bandwidth"]))
    d = d.withColumn("_res", F.col("close") - F.col("nw_est")).withColumn("_ares", F.abs("_res"))
    band = F.coalesce(rstd("_res", w, p["lookback"] // 2, 8), rmean("_ares", w, 8))
    d = d.withColumn("_band", band)
    up = F.col("nw_est") + p["mult"] * F.col("_band")
    lo = F.col("nw_est") - p["mult"] * F.col("_band")
    width = nz(up - lo)
    prev = F.lag("nw_est", 6).over(w)
    d = d.withColumns(
        {
            "nw_slope": (F.col("nw_est") - prev) / nz(prev),
            "nw_env_pos": F.coalesce(clip((F.col("close") - lo) / width, 0, 1), F.lit(0.5)),
            "nw_band_width": zero(width / nz("close")),
            "nw_breakout_up": F.when(F.col("close") > up, 1.0).otherwise(0.0),
            "nw_breakout_dn": F.when(F.col("close") < lo, 1.0).otherwise(0.0),
        }
    )
    return d.drop("_res", "_ares", "_band")


RULE_ENVELOPE_BACK = 80 + 40 + 5


def rule_envelope(d: DataFrame, w: WindowSpec, p: dict = NW_RULE) -> DataFrame:
    """Envelope of the daily rule book, with the lower-band touch."""
    d = d.withColumn("nw_est", kernel_estimate(w, p["lookback"], p["bandwidth"]))
    d = d.withColumn("_res", F.col("close") - F.col("nw_est")).withColumn("_ares", F.abs("_res"))
    band = F.coalesce(rstd("_res", w, p["band"], max(8, p["band"] // 4)), rmean("_ares", w, 8, 4))
    d = d.withColumn("_band", band)
    d = d.withColumns(
        {"nw_upper": F.col("nw_est") + p["mult"] * F.col("_band"), "nw_lower": F.col("nw_est") - p["mult"] * F.col("_band")}
    )
    d = d.withColumn("nw_width", nz(F.col("nw_upper") - F.col("nw_lower")))
    raw = (F.col("close") - F.col("nw_lower")) / F.col("nw_width")
    d = d.withColumn("nw_env_pos", F.coalesce(clip(raw, 0, 1), F.lit(0.5)))
    return d.withColumns(
        {
            "nw_touches_lower": F.col("nw_env_pos") <= p["touch"],
            "nw_dev_below": zero(F.when(raw.isNotNull(), F.greatest(-raw, F.lit(0.0)))),
            "nw_slope": zero(F.col("nw_est") / F.lag("nw_est", 5).over(w) - 1),
        }
    ).drop("_res", "_ares", "_band")


def rsi(w: WindowSpec, n: int = 14) -> Column:
    """Simple-mean RSI in 0..1; zero loss gives one half."""
    delta = F.col("_delta")
    gain = rmean(F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))), w, n)
    loss = rmean(F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))), w, n)
    return F.coalesce(100 - 100 / (1 + gain / nz(loss)), F.lit(50.0)) / 100


def with_rsi(d: DataFrame, w: WindowSpec) -> DataFrame:
    d = d.withColumn("_delta", F.col("close") - F.lag("close").over(w))
    return d.withColumn("rsi_14", rsi(w)).drop("_delta")


def _ema(back: np.ndarray, pos: np.ndarray, x: np.ma.MaskedArray, span: int) -> np.ma.MaskedArray:
    """Recursive EMA (first value seeds) of each block's rows.

    Positions fall in chunks of EMA_CHUNK rows.  Inside a chunk the recursion is a
    weighted running sum; the chunk before adds its final value times a decay.  Older
    chunks weigh at most (1-a)^EMA_CHUNK, under 1e-16 for spans up to 26.
    """
    a = 2.0 / (span + 1)
    q = 1.0 - a
    k = pos % EMA_CHUNK
    there = ~np.ma.getmaskarray(x)
    term = np.where(there, x.data * np.where(pos == 0, 1.0, a) * q**-k, 0.0)
    total, seen, carry = np.empty(len(x)), np.empty(len(x), dtype=bool), np.zeros(len(x))
    ends = [*np.flatnonzero((back == 0) | (k == 0)), len(x)]
    before = 0.0
    for i, j in zip(ends, ends[1:]):
        before = 0.0 if back[i] == 0 else before
        total[i:j] = np.cumsum(term[i:j])
        seen[i:j] = np.logical_or.accumulate(there[i:j])
        carry[i:j] = before
        if seen[j - 1] and k[j - 1] == EMA_CHUNK - 1:
            before = q ** k[j - 1] * total[j - 1]
    return np.ma.array(q**k * total + carry * q ** (k + 1), mask=~seen)


def macd_hist(d: DataFrame, w: WindowSpec, keys: tuple[str, ...] = ("ticker",), order: str = "ts") -> DataFrame:
    """Worked on arrays of whole blocks: their rows are sorted once."""

    def hist(back: np.ndarray, pos: np.ma.MaskedArray, close: np.ma.MaskedArray) -> list[np.ma.MaskedArray]:
        at = pos.data
        line = _ema(back, at, close, 12) - _ema(back, at, close, 26)
        return [line - _ema(back, at, line, 9)]

    return along_blocks(d, ["_pos", "close"], ["macd_hist"], hist, keys, order)


#: Columns of ``long_frames``.
LONG_FRAMES = ("macd_hist", "imb_ma_6", "imb_ma_12", "imb_z", "rsi_14", "trend_efficiency_24", "ret_autocorr_24", "hl_range_z_24", "vol_realized_12", "vol_of_vol_24", "vwap_dist", "garch_cond_vol", "_med")


def _long_frames(back: np.ndarray, pos: np.ma.MaskedArray, close: np.ma.MaskedArray, high: np.ma.MaskedArray, low: np.ma.MaskedArray, volume: np.ma.MaskedArray, imbalance: np.ma.MaskedArray, flat: np.ma.MaskedArray) -> list[np.ma.MaskedArray]:
    def lag(x: np.ma.MaskedArray, k: int = 1) -> np.ma.MaskedArray:
        out = np.ma.masked_all(len(x))
        out[k:] = np.ma.array(x.data[: max(len(x) - k, 0)], mask=(back[k:] < k) | np.ma.getmaskarray(x)[: max(len(x) - k, 0)])
        return out

    masked = lambda x, hide: np.ma.array(x.data, mask=np.ma.getmaskarray(x) | hide)
    nz = lambda x: masked(x, x.data == 0)
    zero = lambda x: np.ma.array(x.filled(0.0))

    def over(a: np.ma.MaskedArray, b: np.ma.MaskedArray) -> np.ma.MaskedArray:
        """Quotient, null where either is; numpy's own would hide more."""
        return np.ma.array(a.data / b.data, mask=np.ma.getmaskarray(a) | np.ma.getmaskarray(b))

    def clip(x: np.ma.MaskedArray, lo: float, hi: float) -> np.ma.MaskedArray:
        return np.ma.array(np.clip(x.data, lo, hi), mask=np.ma.getmaskarray(x))

    def sums(x: np.ma.MaskedArray, n: int, least: int) -> np.ma.MaskedArray:
        count, total, _ = trailing_moments(back, x, n)
        return np.ma.array(total, mask=count < least)

    with np.errstate(all="ignore"):
        line = _ema(back, pos.data, close, 12) - _ema(back, pos.data, close, 26)
        macd = line - _ema(back, pos.data, line, 9)

        imb = zero(imbalance)
        mean, sd = trailing_stats(back, imb, 48, 12)
        imb_z = over(imb - mean, nz(sd))

        delta = close - lag(close)
        gain, loss = (trailing_stats(back, np.ma.array(np.maximum(x.data, 0.0), mask=np.ma.getmaskarray(x)), 14, 14)[0] for x in (delta, -delta))
        rsi_ = (100 - 100 / (1 + over(gain, nz(loss)))).filled(50.0) / 100

        efficiency = clip(over(abs(close - lag(close, 24)), nz(sums(abs(delta), 24, 8))), 0, 1)

        ret = over(close, nz(lag(close)))
        ret = np.ma.array(ret.data - 1, mask=np.ma.getmaskarray(ret))
        dev = ret - trailing_stats(back, ret, 24, 12)[0]
        num = trailing_stats(back, dev * lag(dev), 24, 12)[0]
        count, _, m2 = trailing_moments(back, dev, 24)
        autocorr = clip(over(num, nz(np.ma.array(m2 / count, mask=count < 12))), -1, 1)

        own = np.maximum((high - low).filled(0.0), 0.0)
        made = np.maximum((np.ma.array(abs(ret).filled(0.0)) * abs(close)).filled(0.0), 0.0)
        rng = np.ma.array(np.where(flat.filled(0.0) > 0, made, own))
        mean, sd = trailing_stats(back, rng, 96, 12)
        range_z_ = over(rng - mean, masked(sd, sd.data <= 1e-12)).filled(0.0)

        vol = trailing_stats(back, ret, 12, 4)[1]
        traded = np.ma.array(np.maximum(volume.filled(0.0), 0.0))
        price = sums((high + low + close) / 3.0 * traded, 78, 19)
        vwap = over(price, nz(sums(traded, 78, 19)))
        dist = over(close - vwap, nz(close))
        averages = [trailing_stats(back, imb, n, 1)[0] for n in (6, 12)]
        return [macd, *averages, imb_z, np.ma.array(rsi_), efficiency, autocorr, np.ma.array(range_z_), vol, trailing_stats(back, vol, 24, 8)[1], dist, vol, _medians(back, vol, 48, 12)]


def long_frames(d: DataFrame, w: WindowSpec, keys: tuple[str, ...] = ("ticker",), order: str = "ts") -> DataFrame:
    """What ``macd_hist``, ``imbalance_stats``, ``with_rsi``, ``trend_efficiency``, ``return_autocorrelation``,
    ``range_z``, ``vol_of_vol`` and the volume-weighted price of ``distances`` add, with the deviation
    of returns over 12 bars and what ``conditional_vol`` takes from it: worked on arrays of whole blocks, where a frame of Spark's windows
    goes over up to 96 rows anew for each row.  Needs what these need."""
    given = ["_pos", "close", "high", "low", "volume", "vol_imbalance", "_flat"]
    d = d.withColumn("_flat", F.col("_mostly_flat").cast("double"))
    return along_blocks(d, given, list(LONG_FRAMES), _long_frames, keys, order).drop("_flat")


def impulse(d: DataFrame, w: WindowSpec) -> DataFrame:
    """Momentum stack; needs nw_env_pos, vol_imbalance and lower_wick_ratio."""
    d = d.withColumns({f"roc_{k}": change("close", w, k) for k in (6, 12, 24)})
    d = d.withColumns({"mom_short": zero("roc_6"), "mom_long": zero("roc_24")})
    s, l = nz(F.signum("mom_short")), nz(F.signum("mom_long"))
    direction, imb = F.signum("mom_short"), zero("vol_imbalance")
    ext = (F.col("nw_env_pos") - 0.5) * 2 * direction
    return d.withColumns(
        {
            "side_shift": F.when(F.coalesce(s != l, F.lit(True)), 1.0).otherwise(0.0),
            "impulse_raw": 0.4 * F.abs("mom_short") + 0.3 * F.abs(ext) + 0.3 * F.abs(imb * direction),
            "power_shift": zero("lower_wick_ratio") * F.greatest(imb, F.lit(0.0)) * (1 - F.col("nw_env_pos")),
        }
    )


def trend_efficiency(d: DataFrame, w: WindowSpec, n: int = 24) -> DataFrame:
    d = d.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(w)))
    net = F.abs(F.col("close") - F.lag("close", n).over(w))
    return d.withColumn(f"trend_efficiency_{n}", clip(net / nz(rsum("_step", w, n, max(4, n // 3))), 0, 1)).drop("_step")


def return_autocorrelation(d: DataFrame, w: WindowSpec, n: int = 24) -> DataFrame:
    """Lag-1 autocorrelation around each row's own rolling mean (three window stages)."""
    m = max(8, n // 2)
    d = d.withColumn("_r", change("close", w, 1))
    d = d.withColumn("_dev", F.col("_r") - rmean("_r", w, n, m))
    d = d.withColumn("_prod", F.col("_dev") * F.lag("_dev").over(w))
    num = rmean("_prod", w, n, m)
    den = guarded(F.var_pop("_dev"), "_dev", trailing(w, n), m)
    return d.withColumn(f"ret_autocorr_{n}", clip(num / nz(den), -1, 1)).drop("_r", "_dev", "_prod")


def flat_share(df: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Per ticker: are most bars without a range?"""
    flat = (F.greatest(F.col("high") - F.col("low"), F.lit(0.0)) <= 1e-12).cast("double")
    return df.groupBy(*lay.keys).agg((F.avg(flat) > 0.5).alias("_mostly_flat"))


def range_z(d: DataFrame, w: WindowSpec, n: int = 24) -> DataFrame:
    """Z of the bar range over 4n bars; needs _mostly_flat from ``flat_share``."""
    m = max(8, n // 2)
    own = F.greatest(F.col("high") - F.col("low"), F.lit(0.0))
    synthetic = F.greatest(zero(F.abs(change("close", w, 1))) * F.abs("close"), F.lit(0.0))
    d = d.withColumn("_rng", F.when(F.col("_mostly_flat"), synthetic).otherwise(own))
    sd = rstd("_rng", w, 4 * n, m)
    z = (F.col("_rng") - rmean("_rng", w, 4 * n, m)) / F.when(sd > 1e-12, sd)
    return d.withColumn(f"hl_range_z_{n}", zero(z)).drop("_rng")


def vol_of_vol(d: DataFrame, w: WindowSpec, n: int = 24) -> DataFrame:
    d = d.withColumn("_r", change("close", w, 1))
    d = d.withColumn("_rv", rstd("_r", w, 12, 4))
    return d.withColumn(f"vol_of_vol_{n}", rstd("_rv", w, n, max(6, n // 3))).drop("_r", "_rv")


def distances(d: DataFrame, w: WindowSpec, n: int = 78) -> DataFrame:
    """Envelope z and distance to the rolling volume-weighted price."""
    m = max(8, n // 4)
    vol = F.greatest(F.col("volume"), F.lit(0.0))
    if "nw_est" in d.columns:
        d = d.withColumn("nw_z", (F.col("close") - F.col("nw_est")) / nz("close") / nz("nw_band_width"))
    if "vwap_dist" in d.columns:  # from ``long_frames``
        return d
    d = d.withColumns({"_pv": (F.col("high") + F.col("low") + F.col("close")) / 3.0 * vol, "_vv": vol})
    vwap = rsum("_pv", w, n, m) / nz(rsum("_vv", w, n, m))
    return d.withColumn("vwap_dist", (F.col("close") - vwap) / nz("close")).drop("_pv", "_vv")


def structure(df: DataFrame, lay: Layout = BARS) -> DataFrame:
    """All structure features in one block pass."""

    def stages(d: DataFrame, w: WindowSpec) -> DataFrame:
        for f in (trend_efficiency, return_autocorrelation, range_z, vol_of_vol, distances):
            d = f(d, w)
        return d

    d = salted_join(df, flat_share(df, lay), list(lay.keys))
    return in_blocks(d, stages, back=100, lay=lay).drop("_mostly_flat")


# ---- features computed every 12 bars and held ------------------------------

STEP = 12


def step_segment(w: WindowSpec, value: str, window: int) -> Column:
    """The last ``window`` non-null values at every 12th bar from the first whole window on; null on the
    bars between."""
    at_step = (F.pmod(F.col("_pos") - (window - 1), F.lit(STEP)) == 0) & (F.col("_pos") >= window - 1)
    return F.when(at_step, F.collect_list(value).over(trailing(w, window)))


def hurst_from(seg: Column) -> Column:
    """Rescaled range exponent of one array: one pass for the mean, which the second
    pass carries in its state so that it is worked out once."""
    d = lambda x: F.lit(float(x))
    mean = F.aggregate(seg, d(0), lambda s, x: s + x) / F.size(seg)
    start = F.struct(
        mean.alias("m"), F.size(seg).cast("double").alias("n"), d(0).alias("y"), d(-1e300).alias("hi"), d(1e300).alias("lo"), d(0).alias("ss")
    )

    def step(a: Column, x: Column) -> Column:
        e = x - a["m"]
        y = a["y"] + e
        return F.struct(
            a["m"].alias("m"), a["n"].alias("n"), y.alias("y"),
            F.greatest(a["hi"], y).alias("hi"), F.least(a["lo"], y).alias("lo"), (a["ss"] + e * e).alias("ss"),
        )

    def finish(a: Column) -> Column:
        sd = F.sqrt(a["ss"] / (a["n"] - 1))
        span = a["hi"] - a["lo"]
        return F.when((a["n"] >= 32) & (sd >= 1e-12) & (span > 0), F.ln(span / sd) / F.ln(a["n"]))

    return F.aggregate(seg, start, step, finish)


def hurst(df: DataFrame, window: int = 192, lay: Layout = BARS) -> DataFrame:
    """Exponent at every 12th bar, then held; a step that cannot be computed keeps the
    last computed value."""

    def stage(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_r", change("close", w, 1))
        d = d.withColumn("_seg", step_segment(w, "_r", window))
        return d.withColumn("hurst_rs", F.when(F.col("_seg").isNotNull(), hurst_from(F.col("_seg")))).drop("_r", "_seg")

    return fill_forward(in_blocks(df, stage, back=window + 1, lay=lay), ["hurst_rs"], lay)


SPECTRAL = "struct<spec_dominant_period:double,spec_entropy:double,spec_low_high_ratio:double>"


def _spectra(x: np.ndarray) -> np.ndarray:
    """(period, entropy, low/high power) of each row of equally long segments; NaN where a
    segment is too short or flat.  One transform serves the whole matrix."""
    n = x.shape[1]
    out = np.full((len(x), 3), np.nan)
    if n < 16:
        return out
    lively = np.flatnonzero(x.std(axis=1) >= 1e-12)
    spectrum = np.fft.rfft(x[lively] - x[lively].mean(axis=1, keepdims=True), axis=1)[:, 1:]
    power = spectrum.real**2 + spectrum.imag**2
    total = power.sum(axis=1)
    some = total >= 1e-18
    lively, power, total = lively[some], power[some], total[some]
    bins = power.shape[1]
    share = np.clip(power / total[:, None], 1e-12, 1.0)
    low = power[:, : max(1, bins // 3)].sum(axis=1)
    high = power[:, max(1, bins // 3) :].sum(axis=1)
    out[lively, 0] = n / (power.argmax(axis=1) + 1)
    out[lively, 1] = -(share * np.log(share)).sum(axis=1) / np.log(bins)
    out[lively, 2] = np.where(high > 1e-18, low / np.where(high > 1e-18, high, 1.0), np.nan)
    return out


def spectral(df: DataFrame, window: int = 96, lay: Layout = BARS) -> DataFrame:
    """Dominant period, spectral entropy and low/high power, from Arrow batches of
    bounded arrays (one per 12 bars), transformed together."""
    @F.pandas_udf(SPECTRAL)
    def spectrum(seg: pd.Series) -> pd.DataFrame:
        out = np.full((len(seg), 3), np.nan)
        lengths = np.array([-1 if s is None else len(s) for s in seg])
        for n in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == n)
            out[rows] = _spectra(np.stack([np.asarray(seg.iloc[i], float) for i in rows]))
        return pd.DataFrame(out, columns=["spec_dominant_period", "spec_entropy", "spec_low_high_ratio"])

    names = ["spec_dominant_period", "spec_entropy", "spec_low_high_ratio"]

    def segments(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_r", change("close", w, 1))
        return d.withColumn("_seg", step_segment(w, "_r", window)).drop("_r")

    d, w = block_frame(df, back=window + 2 * STEP, lay=lay)
    d = segments(d, w)
    # only the step rows carry an array to Python, one value per array comes back
    d = d.withColumn("_s", spectrum("_seg"))
    hold = w.rowsBetween(-(STEP - 1), 0)
    live = F.when(F.col("_seg").isNotNull(), F.struct(*[F.nanvl(f"_s.{c}", F.lit(None)).alias(c) for c in names]))
    d = d.withColumn("_h", F.last(live, ignorenulls=True).over(hold))
    return finish_blocks(d).select(*df.columns, *[F.col(f"_h.{c}").alias(c) for c in names])


def _medians(back: np.ndarray, x: np.ma.MaskedArray, n: int, m: int) -> np.ma.MaskedArray:
    """Rolling median inside each block (skip list, n log n in all)."""
    values, out = x.filled(np.nan), np.empty(len(x))
    ends = [*np.flatnonzero(back == 0), len(x)]
    for a, b in zip(ends, ends[1:]):
        out[a:b] = pd.Series(values[a:b]).rolling(n, min_periods=m).median().to_numpy()
    return np.ma.array(out, mask=np.isnan(out))


def block_median(d: DataFrame, x: str, name: str, n: int, m: int, keys: tuple[str, ...] = ("ticker",), order: str = "ts") -> DataFrame:
    """Long rolling median inside a block; blocks go to Python many at a time and the block
    shuffle is reused."""
    return along_blocks(d, [x], [name], lambda back, v: [_medians(back, v, n, m)], keys, order)


def conditional_vol(d: DataFrame, w: WindowSpec) -> DataFrame:
    """Realised vol and its ratio to the 48-bar median (the defined fallback)."""
    if "_med" not in d.columns:  # from ``long_frames``
        d = d.withColumn("_r", change("close", w, 1)).withColumn("garch_cond_vol", rstd("_r", w, 12, 4)).drop("_r")
        d = d.withColumn("_med", rmedian("garch_cond_vol", w, 48, 12))
    ratio = F.when(F.col("_med") > 1e-12, F.col("garch_cond_vol") / F.col("_med"))
    return d.withColumn("garch_vol_ratio", F.coalesce(ratio, F.lit(1.0))).drop("_med")


# ---- volume profile ---------------------------------------------------------

BINS, VALUE_AREA, MIN_PROFILE_BARS = 24, 0.70, 6


def _profile_levels(lo, hi, close, typical, vol):
    """Point of control and value area at every bar of one session, bars so far included."""
    run_lo, run_hi = np.minimum.accumulate(lo), np.maximum.accumulate(hi)
    levels = np.repeat(np.asarray(close, dtype=float)[:, None], 3, axis=1)
    for j in range(MIN_PROFILE_BARS - 1, len(close)):
        a, b = run_lo[j], run_hi[j]
        if b <= a:
            continue
        slot = np.clip(np.floor((typical[: j + 1] - a) / (b - a) * BINS), 0, BINS - 1).astype(int)
        hist = np.bincount(slot, weights=vol[: j + 1], minlength=BINS)
        total = hist.sum()
        if total <= 0:
            continue
        order = np.argsort(-hist, kind="stable")
        taken = order[: int(np.searchsorted(np.cumsum(hist[order]), total * VALUE_AREA)) + 1]
        centre = lambda i: a + (i + 0.5) * (b - a) / BINS
        levels[j] = centre(order[0]), centre(taken.max()), centre(taken.min())
    return levels


def volume_profile(df: DataFrame) -> DataFrame:
    """Session-expanding profile.  One row per session carries its bars as a bounded
    array; Arrow batches of sessions go through one vectorised function."""
    level = "array<struct<vp_poc:double,vp_vah:double,vp_val:double>>"

    @F.pandas_udf(level)
    def levels(bars: pd.Series) -> pd.Series:
        out = []
        for session in bars:
            m = np.array([[b["low"], b["high"], b["close"], b["tp"], b["vol"]] for b in session], dtype=float).T
            lv = _profile_levels(*m)
            out.append([{"vp_poc": p, "vp_vah": h, "vp_val": l} for p, h, l in lv.tolist()])
        return pd.Series(out)

    rest = [c for c in df.columns if c not in ("ticker", "session")]
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    bar = F.struct("ts", F.struct(*rest).alias("row"), "low", "high", "close", tp.alias("tp"), zero("volume").alias("vol"))
    s = df.groupBy("ticker", "session").agg(F.array_sort(F.collect_list(bar)).alias("_bars"))
    s = s.withColumn("_lv", levels(F.transform("_bars", lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), b["close"].alias("close"), b["tp"].alias("tp"), b["vol"].alias("vol")))))
    d = s.select("ticker", "session", F.explode(F.arrays_zip(F.col("_bars.row").alias("row"), F.col("_lv").alias("lv"))).alias("z"))
    return d.select("ticker", "session", "z.row.*", "z.lv.*")


def profile_geometry(df: DataFrame) -> DataFrame:
    c, poc, vah, val = (F.col(x) for x in ("close", "vp_poc", "vp_vah", "vp_val"))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return df.withColumns(
        {
            "vp_poc_dist": (c - poc) / poc,
            "vp_va_width": F.greatest(vah - val, F.lit(1e-9)) / F.greatest(poc, F.lit(1e-9)),
            "vp_in_value": flag((c >= val) & (c <= vah)),
            "vp_above_poc": flag(c > poc),
            "vp_below_val": flag(c < val),
            "vp_near_poc": flag(F.abs(c - poc) / F.greatest(poc, F.lit(1e-9)) < 0.002),
        }
    )


def profile_regime_signals(df: DataFrame) -> DataFrame:
    """Profile geometry weighted by the regime; zero counts as missing where the source
    columns have a non-zero default."""
    dist = F.col("vp_poc_dist")
    falsy = lambda x, dflt: F.when(F.col(x).isNull() | (F.col(x) == 0), F.lit(dflt)).otherwise(F.col(x))
    above, inside = falsy("vp_above_poc", 0.5), falsy("vp_in_value", 0.5)
    width = F.greatest(falsy("vp_va_width", 0.01), F.lit(1e-6))
    trend = clip(above * (1 + dist) + (1 - inside) * 0.5, -1, 2)
    rng = F.col("vp_below_val") - F.col("vp_above_poc") * (dist / width) * 0.5
    rng = clip(rng + F.when(dist < -0.001 * width, F.abs(dist) * 0.5).otherwise(0.0), -1, 1.5)
    damp = F.greatest(F.lit(0.0), 1 - F.col("p_st") * 1.5)
    return df.withColumns(
        {
            "vp_impulse_sig": F.round(F.col("p_imp") * trend, 4),
            "vp_mean_revert_sig": F.round(F.col("p_mr") * rng, 4),
            "vp_composite": F.round(damp * (F.col("p_imp") * trend + F.col("p_mr") * rng), 4),
        }
    )


# ---- factor and regime observations ----------------------------------------


def factors(d: DataFrame, w: WindowSpec, *, vol: int = 20, trend: int = 252, skip: int = 21, sma: int = 200, med: int = 1260, ann: int = 252) -> DataFrame:
    """Long frames are worked on arrays of whole blocks: one pass over a frame's rows for all
    blocks of a pack, where a window would go over the frame anew for each row."""
    d = d.withColumns({
        "log_ret": log_return("close", w),
        "trend_12_1": F.lag("close", skip).over(w) / F.lag("close", trend + skip).over(w) - 1,
    })

    def frames(back: np.ndarray, close: np.ma.MaskedArray, ret: np.ma.MaskedArray) -> list[np.ma.MaskedArray]:
        _, sd = trailing_stats(back, ret, vol, vol)
        ann_vol = sd * math.sqrt(ann)
        return [ann_vol, *trailing_stats(back, close, sma, sma), _medians(back, ann_vol, med, trend)]

    d = along_blocks(d, ["close", "log_ret"], ["ann_vol", "_mean", "_sd", "_med"], frames)
    return d.withColumns({
        "z_sma": (F.col("close") - F.col("_mean")) / nz("_sd"),
        "risk_on": F.coalesce(F.col("close") > F.col("_mean"), F.lit(False)),
        "vol_ratio": F.col("ann_vol") / nz("_med"),
    }).drop("_mean", "_sd", "_med")


FACTORS_BACK = 1260 + 20 + 1


def bar_observations(d: DataFrame, w: WindowSpec, *, hour: int = 12, day: int = 288, rolling_min: int = 6, per_year: int = 288 * 365) -> DataFrame:
    """Hour and day scale observations for the regime model (frame sizes are explicit)."""
    m = max(6, hour // 2)
    d = d.withColumn("log_ret", log_return("close", w))
    d = d.withColumns({"_mu": rmean("log_ret", w, hour, m), "_sd": rstd("log_ret", w, hour, m)})
    d = d.withColumns(
        {
            "ret_z": (F.col("log_ret") - F.col("_mu")) / nz("_sd"),
            "_vol": F.col("_sd") * math.sqrt(per_year),
            "risk_on": F.coalesce(F.col("close") > rmean("close", w, day, hour), F.lit(False)),
            "trend_z": (F.col("_mu") - rmean("_mu", w, day, hour)) / nz(rstd("_mu", w, day, hour)),
        }
    )
    d = block_median(d, "_vol", "_med", day, max(hour, day // 4))
    d = d.withColumn("vol_ratio", F.col("_vol") / nz("_med")).drop("_med")
    z = (F.col("vol_ratio") - rmean("vol_ratio", w, hour, rolling_min)) / nz(rstd("vol_ratio", w, hour, rolling_min))
    d = d.withColumn("vol_z", z)
    return d.drop("_mu", "_sd", "_vol")


OBSERVATIONS_BACK = 288 + 288 + 24 + 1




def rolling_z(d: DataFrame, w: WindowSpec, n: int = 12, m: int = 6) -> DataFrame:
    z = lambda x: (F.col(x) - rmean(x, w, n, m)) / nz(rstd(x, w, n, m))
    return d.withColumns({"ret_z": z("log_ret"), "vol_z": z("vol_ratio")})


def period_features(closes: DataFrame, lay: Layout = BARS) -> DataFrame:
    """Two passes: rows without a vol ratio leave the series before the z-scores."""

    def first(d, w):
        d = d.withColumn("log_ret", log_return("close", w))
        d = d.withColumn("_vol", rstd("log_ret", w, 20) * math.sqrt(365))
        d = block_median(d, "_vol", "_med", 252, 20)
        return d.withColumn("vol_ratio", F.col("_vol") / nz("_med")).drop("_vol", "_med")

    d = in_blocks(closes, first, back=252 + 22, lay=lay).where(F.col("log_ret").isNotNull() & F.col("vol_ratio").isNotNull())
    d = in_blocks(d, rolling_z, back=12, lay=lay)
    return d.where(F.col("ret_z").isNotNull() & F.col("vol_z").isNotNull())


def window_explainer(df: DataFrame, at: Column, lookback: int = 12, lay: Layout = BARS) -> DataFrame:
    """The bars behind one z-score per ticker: the ``lookback`` bars up to position ``at``."""
    d = with_position(df, "pos", lay)
    last = d.groupBy(*lay.keys).agg(F.max("pos").alias("_last"))
    d = salted_join(d, last, list(lay.keys)).withColumn("_t", F.least(at, F.col("_last")))
    d = d.where((F.col("pos") > F.col("_t") - lookback) & (F.col("pos") <= F.col("_t")))
    w = Window.partitionBy(*lay.keys).orderBy("pos")  # at most `lookback` rows per ticker from here
    d = d.withColumn("log_ret", log_return("close", w)).withColumn("bar", F.row_number().over(w) - 1)
    every = Window.partitionBy(*lay.keys)
    d = d.withColumns({"mu": F.avg("log_ret").over(every), "sigma": F.stddev_samp("log_ret").over(every), "is_current": F.col("pos") == F.col("_t")})
    cur = F.max(F.when(F.col("is_current"), F.col("log_ret"))).over(every)
    return d.withColumn("ret_z", (cur - F.col("mu")) / F.when(F.col("sigma") > 1e-12, F.col("sigma"))).drop("_last", "_t", "pos")


def rolling_sharpe(d: DataFrame, w: WindowSpec, ret: str, n: int, per_year: float) -> DataFrame:
    m = max(n // 3, 5)
    return d.withColumn("rolling_sharpe", rmean(ret, w, n, m) / nz(rstd(ret, w, n, m)) * math.sqrt(per_year))


def rolling_excess(d: DataFrame, w: WindowSpec, ret: str, bench: str, n: int) -> DataFrame:
    d = d.withColumn("_x", F.col(ret) - F.col(bench))
    return d.withColumn("rolling_excess_bps", rmean("_x", w, n, max(n // 3, 5)) * 1e4).drop("_x")


# ---- feature catalogue ------------------------------------------------------

# fixed values: feature groups in order, the columns kept for diagnostics only, and the
# groups kept out of the models
GROUPS = {
    "price_momentum": ("ret_1", "ret_6", "ret_12", "ret_24", "vol_realized_12", "vol_z"),
    "flow_microstructure": ("vol_imbalance", "imb_ma_6", "imb_ma_12", "imb_z", "buy_share", "tick_imbalance"),
    "candle_geometry": ("body_pct", "clv", "lower_wick_ratio", "upper_wick_ratio", "body_ratio", "hammer_score"),
    "nw_envelope": ("nw_est", "nw_slope", "nw_env_pos", "nw_band_width"),
    "classic_momentum": ("roc_6", "roc_12", "roc_24", "rsi_14", "macd_hist", "mom_short", "mom_long", "side_shift", "power_shift"),
    "volume_profile": ("vp_poc", "vp_vah", "vp_val", "vp_poc_dist", "vp_va_width", "vp_near_poc"),
    "vp_hmm_blend": ("vp_hmm_impulse_sig", "vp_hmm_mean_revert_sig", "vp_hmm_composite"),
    "hmm_regime": ("prob_hmm_impulse", "prob_hmm_mean_revert", "prob_hmm_stress", "hmm_confidence", "hmm_vol_ratio"),
    "hmm_dynamics": (
        "hmm_prob_entropy", "hmm_transition_entropy", "hmm_next_impulse", "hmm_next_mean_revert", "hmm_next_stress", "hmm_expected_duration_bars",
        "hmm_vol_ratio_1h_vs_1d", "hmm_impulse_edge", "hmm_regime_conviction",
    ),
    "long_memory": ("hurst_rs",),
    "spectral": ("spec_low_high_ratio", "spec_entropy", "spec_dominant_period"),
    "garch_vol": ("garch_cond_vol", "garch_vol_ratio"),
    "structure_path": ("trend_efficiency_24", "ret_autocorr_24", "hl_range_z_24", "vol_of_vol_24", "nw_z", "vwap_dist"),
    "cross_sectional": ("ret_12_cs_rank", "vol_realized_12_cs_rank", "nw_env_pos_cs_rank", "hurst_rs_cs_rank", "spec_low_high_ratio_cs_rank", "vp_poc_dist_cs_rank", "garch_vol_ratio_cs_rank"),
}
EXCLUDED_COLUMNS = (
    "flow_source", "session_progress", "hmm_risk_on", "vp_in_value", "vp_above_poc", "vp_below_val", "nw_breakout_up", "nw_breakout_dn", "impulse_raw",
    "vol_imbalance", "imb_ma_6", "imb_ma_12", "imb_z", "buy_share", "tick_imbalance", "body_pct", "clv", "body_ratio", "hammer_score",
)
EXCLUDED_GROUPS = ("hmm_regime", "hmm_dynamics", "vp_hmm_blend")


def active_columns(excluded: tuple[str, ...] = EXCLUDED_GROUPS) -> list[str]:
    return [c for g, cols in GROUPS.items() if g not in excluded for c in cols if c not in EXCLUDED_COLUMNS]


def resolve_columns(df: DataFrame) -> list[str]:
    return [c for c in active_columns() if c in df.columns]


def feature_group(column: str) -> str:
    return next((g for g, cols in GROUPS.items() if column in cols), "other")
