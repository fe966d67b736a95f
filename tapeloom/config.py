"""Frozen parameters, passed to operators; nothing reads them as globals at run time."""

from __future__ import annotations

from dataclasses import dataclass

REGIMES = ("impulse", "mean_revert", "stress")
OHLCV = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Costs:
    # fixed values: basis points per side
    commission_crypto: float = 1.1
    commission_tradfi: float = 0.5
    slippage_crypto: float = 1.5
    slippage_tradfi: float = 2.0
    vol_ref_crypto: float = 0.80
    vol_ref_tradfi: float = 0.18
    vol_clip: tuple[float, float] = (0.5, 2.0)


@dataclass(frozen=True)
class Exits:
    # fixed values: basis points, ratios, stop factors
    stop_bps: float = 45.0
    take_bps: float = 47.5
    min_ratio: float = 1.0
    max_ratio: float = 2.0
    take_floor: float = 40.0
    stop_cap: float = 75.0
    stress_at: float = 0.35
    stress_factor: float = 0.70
    vol_at: float = 0.22
    vol_factor: float = 0.80
    ratio_at: float = 1.35
    ratio_factor: float = 0.85
    stop_floor: float = 12.0


@dataclass(frozen=True)
class Economics:
    # fixed values
    over_cost: float = 1.25
    vol_exp: float = 0.5
    scale_clip: tuple[float, float] = (0.5, 2.5)
    band_over_floor: float = 2.0
    max_weight: float = 0.35


@dataclass(frozen=True)
class BarClock:
    minutes: int = 5
    bars_per_hour: int = 12
    bars_per_day: int = 288
    days_per_year: int = 365
    session_minutes: int = 390
    trading_days: int = 252

    @property
    def bars_per_year(self) -> int:
        return self.bars_per_day * self.days_per_year


COSTS = Costs()
EXITS = Exits()
ECONOMICS = Economics()
CLOCK = BarClock()
