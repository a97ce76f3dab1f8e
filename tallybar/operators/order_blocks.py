"""Order blocks: swing points whose range is broken with volume, and that price then comes back to.

Supply (above price) and demand (below) obey the same rules with prices mirrored, so each side is judged on a
``Side`` whose prices point the same way: a block forms at a swing high, breaks downwards, and is confirmed
when price comes back into the zone and leaves it downwards. A window that is not yet full does not qualify.
Confirmation is sequential within an instrument, as a breaker looks at the blocks confirmed before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as k
from .structure import peaks

TINY = 1e-9


@dataclass(frozen=True)
class OrderBlockConfig:
    """Thresholds and switches; names and defaults are part of the interface."""

    zigzag_prominence_peak: float = 0.01
    zigzag_prominence_valley: float = 0.01
    zigzag_distance: int = 5
    zigzag_width: int | None = None
    zigzag_wlen: int | None = None
    zigzag_rel_height: float = 0.5
    lookback_min: int = 5
    lookback_max: int = 50
    lookback_atr_multiplier: float = 2.0
    use_dynamic_lookback: bool = True
    multiple_breakouts: bool = False
    breakout_volume_threshold: float = 1.0
    breakout_impulse_multiplier: float = 0.0
    use_adx_filter: bool = False
    adx_period: int = 14
    adx_threshold: float = 25.0
    use_market_structure_filter: bool = False
    structure_lookback: int = 10
    min_structure_extremes: int = 3
    max_extreme_age: int = 0
    require_fvg: bool = False
    fvg_tolerance: float = 0.0
    fvg_volume_multiplier: float = 0.0
    fvg_volume_mode: str = "any"
    fvg_bonus_multiplier: float = 1.0
    check_breaker: bool = False
    breaker_lookback: int = 50
    breaker_bonus_multiplier: float = 1.5
    breaker_require_displacement: bool = False
    check_orderflow_shift: bool = False
    shift_lookforward: int = 10
    shift_require_extremes: bool = True
    zone_entry_mode: str = "wick"
    require_closure_outside: bool = False
    displacement_multiplier: float = 0.0
    use_rsi_confirmation: bool = False
    rsi_period: int = 14
    rsi_overbought: float = 70.0
    rsi_oversold: float = 30.0
    use_macd_confirmation: bool = False
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    confirmation_window: int = 10
    min_reaction_size: float = 0.002
    max_zone_penetration: float = 0.5
    atr_period: int = 14
    zone_atr_multiplier: float = 1.0
    volume_window: int = 20
    liquidity_window: int = 10
    liquidity_tolerance: float = 0.001
    strength_log_volume: bool = False
    strength_atr_normalize: bool = False
    strength_age_penalty: bool = False
    strength_age_halflife: int = 20
    strength_max_multiplier: float = 10.0
    strength_reaction_cap: float = 3.0
    cluster_blocks: bool = False
    cluster_price_tolerance: float = 0.001
    max_cluster_time_gap: timedelta | None = timedelta(days=30)
    max_history: int | None = None

    def __post_init__(self):
        if not 0 < self.strength_reaction_cap <= self.strength_max_multiplier:
            raise ValueError("strength_reaction_cap must be positive and at most strength_max_multiplier")


@dataclass
class Block:
    side: int
    start: int
    broken: int
    retest: int
    zone_low: float
    zone_high: float
    strength: float
    label: str | None = None
    trend: str | None = None
    number: int = 0


@dataclass
class Side:
    """One side's view: sign 1 for supply, -1 for demand; prices times the sign, high and low swapped with it."""

    sign: int
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    swing: np.ndarray
    zone_low: np.ndarray
    zone_high: np.ndarray


@dataclass
class Market:
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    volume: np.ndarray
    cfg: OrderBlockConfig
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        c = self.cfg
        self.atr = k.atr(self.high, self.low, self.close, c.atr_period)
        self.mean_volume = k.sma(self.volume, c.volume_window)
        wlen, width = c.zigzag_wlen or 0, -1 if c.zigzag_width is None else c.zigzag_width
        self.peaks = peaks(self.high, c.zigzag_prominence_peak, c.zigzag_distance, wlen, width, c.zigzag_rel_height)
        self.valleys = peaks(-self.low, c.zigzag_prominence_valley, c.zigzag_distance, wlen, width, c.zigzag_rel_height)
        reach = c.zone_atr_multiplier * self.atr
        self.sides = {}
        for sign, top, bottom, swing in ((1, self.high, self.low, self.peaks), (-1, -self.low, -self.high, self.valleys)):
            self.sides[sign] = Side(sign, top, bottom, sign * self.close, swing, sign * self.close - reach, sign * self.close + reach)
        if c.use_adx_filter:
            self.extra["adx"], _, self.extra["plus"], self.extra["minus"] = k.adx(self.high, self.low, self.close, c.adx_period)
        if c.use_rsi_confirmation:
            self.extra["rsi"] = k.rsi(self.close, c.rsi_period)
        if c.use_macd_confirmation:
            self.extra["hist"] = k.macd(self.close, c.macd_fast, c.macd_slow, c.macd_signal)[2]

    def lookback(self) -> int:
        c, known = self.cfg, self.atr[~np.isnan(self.atr)]
        if not c.use_dynamic_lookback or not len(known):
            return c.lookback_min
        return int(min(c.lookback_max, max(c.lookback_min, float(np.median(known)) * c.lookback_atr_multiplier)))

    def breaks(self, side: Side, at: int, bar: int) -> bool:
        """Whether a bar breaks the swing at ``at`` with enough volume, impulse and trend."""
        c = self.cfg
        if not (side.low[bar] < side.low[at] and self.volume[bar] > c.breakout_volume_threshold * self.mean_volume[bar]):
            return False
        if c.breakout_impulse_multiplier > 0 and not self.high[bar] - self.low[bar] >= c.breakout_impulse_multiplier * self.atr[bar]:
            return False
        if c.use_adx_filter:
            down = side.sign * (self.extra["minus"][bar] - self.extra["plus"][bar])
            return bool(self.extra["adx"][bar] >= c.adx_threshold and down > 0)
        return True

    def candidates(self) -> list[tuple[int, int, int, float]]:
        """(sign, swing, break, base strength), in the order of the swings."""
        c, back, out = self.cfg, self.lookback(), []
        tops = {s: k.rolled(side.high, c.liquidity_window, np.max) for s, side in self.sides.items()}
        swings = {int(p): -1 for p in self.valleys} | {int(p): 1 for p in self.peaks}
        for at, sign in sorted(swings.items()):
            side, first = self.sides[sign], at + back
            if first >= len(self.close) or not tops[sign][at] - side.high[at] < c.liquidity_tolerance:
                continue
            last = first + c.lookback_max if c.multiple_breakouts else first + 1
            bar = next((b for b in range(first, min(last, len(self.close))) if self.breaks(side, at, b)), None)
            if bar is not None:
                move = (side.close[at] - side.close[bar]) / max(self.close[at], TINY)
                out.append((sign, at, bar, max(0.0, move) if c.multiple_breakouts else 1.0))
        return out if c.multiple_breakouts else sorted(out, key=lambda x: x[2])

    def structure(self, at: int) -> tuple[str | None, str | None]:
        """Labels of the last two extremes of each kind up to a bar, and the trend that the last extremes agree on."""
        c = self.cfg
        tops, lows = (x[x <= at][-c.structure_lookback :] for x in (self.peaks, self.valleys))
        if (self.peaks <= at).sum() < 2 or (self.valleys <= at).sum() < 2:
            return None, None
        votes = {1: self.high[tops[-1]] > self.high[tops[-2]], 0: self.low[lows[-1]] > self.low[lows[-2]]} if min(len(tops), len(lows)) > 1 else {}
        if not votes:
            return None, None
        recent = sorted([(int(p), 1) for p in tops] + [(int(p), 0) for p in lows])[-c.min_structure_extremes :]
        ups = sum(bool(votes[kind]) for _, kind in recent)
        trend = "up" if ups >= c.min_structure_extremes else "down" if len(recent) - ups >= c.min_structure_extremes else None
        return f"{'HH' if votes[1] else 'LH'}/{'HL' if votes[0] else 'LL'}", trend

    def gap(self, side: Side, bar: int) -> bool:
        """Whether the bars around a break leave a gap, with volume if asked."""
        c = self.cfg
        if not 1 <= bar < len(self.close) - 1:
            return False
        allowed = c.fvg_tolerance * abs(self.high[bar - 1] - self.low[bar + 1])
        if not side.high[bar + 1] < side.low[bar - 1] + allowed:
            return False
        if c.fvg_volume_multiplier <= 0:
            return True
        loud = self.volume[bar - 1 : bar + 2] > c.fvg_volume_multiplier * self.mean_volume[bar]
        return bool({"center": loud[1], "first": loud[0], "last": loud[2]}.get(c.fvg_volume_mode, loud.any()))

    def breaker(self, side: Side, at: int, bar: int, confirmed: list[Block]) -> float:
        """The bonus for breaking an earlier, opposite, overlapping block."""
        c = self.cfg
        for old in confirmed[max(0, len(confirmed) - c.breaker_lookback) :]:
            low, high = sorted((side.sign * old.zone_low, side.sign * old.zone_high))
            beyond = low - side.close[bar]
            if old.side == side.sign or not (side.zone_high[at] > low and side.zone_low[at] < high) or not beyond > 0:
                continue
            if not c.breaker_require_displacement or beyond >= c.displacement_multiplier * self.atr[bar]:
                return c.breaker_bonus_multiplier * (1 + old.strength)
        return 1.0

    def enters(self, side: Side, low: float, high: float, bar: int) -> bool:
        by_wick, by_close = low <= side.low[bar] <= high, low <= side.close[bar] <= high
        return {"wick": by_wick, "close": by_close}.get(self.cfg.zone_entry_mode, by_wick or by_close)

    def agrees(self, side: Side, bar: int) -> bool:
        """Whether the oscillators that are asked for confirm."""
        c = self.cfg
        if c.use_rsi_confirmation:
            r = self.extra["rsi"][bar]
            if not (r >= c.rsi_overbought if side.sign > 0 else r <= c.rsi_oversold):
                return False
        return not c.use_macd_confirmation or bool(side.sign * self.extra["hist"][bar] <= 0)

    def shifts(self, side: Side, at: int, bar: int) -> bool:
        """Whether the first extreme after a bar lies beyond the last one of its kind before the swing."""
        c, ahead = self.cfg, []
        for price, places in ((self.high, self.peaks), (self.low, self.valleys)):
            later = places[(places > bar) & (places < bar + c.shift_lookforward)]
            if len(later):
                ahead.append((int(later[0]), price, places))
        if not ahead:
            return not c.shift_require_extremes
        first, price, places = min(ahead, key=lambda x: x[0])
        before = places[places < at]
        return bool(len(before) and side.sign * (price[first] - price[before[-1]]) < 0)

    def confirm(self) -> list[Block]:
        c, out = self.cfg, []
        for sign, at, bar, base in self.candidates():
            side, age = self.sides[sign], bar - at
            low, high = side.zone_low[at], side.zone_high[at]
            if c.max_extreme_age and age > c.max_extreme_age or np.isnan(low):
                continue
            label = trend = None
            if c.use_market_structure_filter:
                label, trend = self.structure(at)
                if trend not in (None, "down" if sign > 0 else "up"):
                    continue
            if c.require_fvg and not self.gap(side, bar):
                continue
            bonus = self.breaker(side, at, bar, out) if c.check_breaker else 1.0
            if c.require_fvg:
                bonus *= c.fvg_bonus_multiplier
            for j in range(bar + 1, min(bar + c.confirmation_window, len(self.close))):
                if not (self.enters(side, low, high, j) and self.volume[j] > self.mean_volume[j] and self.agrees(side, j)):
                    continue
                if c.require_closure_outside and not side.close[j] < low:
                    continue
                reaction = high - side.close[j]
                share = reaction / max(sign * high, TINY)
                if not (reaction >= c.displacement_multiplier * self.atr[j] if c.displacement_multiplier > 0 else share >= c.min_reaction_size):
                    continue
                if c.check_orderflow_shift and not self.shifts(side, at, j):
                    continue
                loud = self.volume[j] / max(self.mean_volume[j], TINY)
                weight = np.log1p(loud) if c.strength_log_volume else loud
                weight *= min(reaction / max(self.atr[j], TINY) if c.strength_atr_normalize else share, c.strength_reaction_cap)
                if c.strength_age_penalty and c.strength_age_halflife > 0:
                    weight *= 0.5 ** (age / c.strength_age_halflife)
                zone = sorted((sign * low, sign * high))
                out.append(Block(sign, at, bar, j, *zone, max(0.0, base * min(weight * bonus, c.strength_max_multiplier)), label, trend, len(out)))
                break
        return out


def cluster(blocks: list[Block], times: np.ndarray, tolerance: float, gap: timedelta | None) -> list[Block]:
    """Chains of one side's blocks, in the order of their zones' middles, as one block each.

    A block joins the chain before it if its middle is within the tolerance of that of the chain's whole zone, and it
    starts at most ``gap`` after the chain's first start.
    """

    def middle(b: Block) -> float:
        return (b.zone_low + b.zone_high) / 2

    def joins(chain: Block, b: Block) -> bool:
        apart = abs(middle(b) - middle(chain)) / max(middle(chain), TINY)
        return chain.side == b.side and apart <= tolerance and (gap is None or times[b.start] - times[chain.start] <= np.timedelta64(gap))

    def union(chain: Block, b: Block) -> Block:
        low = {f: min(getattr(chain, f), getattr(b, f)) for f in ("start", "zone_low")}
        high = {f: max(getattr(chain, f), getattr(b, f)) for f in ("broken", "retest", "zone_high", "strength")}
        return replace(chain, **low, **high)

    chains: list[Block] = []
    for b in sorted(blocks, key=lambda b: (b.side, middle(b), b.start)):
        if chains and joins(chains[-1], b):
            chains[-1] = union(chains[-1], b)
        else:
            chains.append(b)
    return chains


def order_blocks(bars: DataFrame, key: str, order: str, cfg: OrderBlockConfig | None = None) -> DataFrame:
    """key, id, block_type, start, break, retest, zone_low, zone_high, strength, structure_label, trend_direction."""
    cfg, when = cfg or OrderBlockConfig(), bars.schema[order].dataType
    names = [(key, bars.schema[key].dataType), ("id", T.LongType()), ("block_type", T.StringType()), ("start", when), ("break", when), ("retest", when), ("zone_low", T.DoubleType()), ("zone_high", T.DoubleType()), ("strength", T.DoubleType()), ("structure_label", T.StringType()), ("trend_direction", T.StringType())]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable", ignore_index=True)
        if cfg.max_history is not None:
            frame = frame.tail(cfg.max_history).reset_index(drop=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = Market(*(frame[c].to_numpy(dtype=float) for c in ("high", "low", "close", "volume")), cfg).confirm()
        times = frame[order].to_numpy()
        if cfg.cluster_blocks:
            found = cluster(found, times, cfg.cluster_price_tolerance, cfg.max_cluster_time_gap)
        rows = [(frame[key].iloc[0], b.number, "supply" if b.side > 0 else "demand", times[b.start], times[b.broken], times[b.retest], b.zone_low, b.zone_high, b.strength, b.label, b.trend) for b in sorted(found, key=lambda b: (b.start, b.number))]
        return pd.DataFrame(rows, columns=[n for n, _ in names])

    return bars.groupBy(key).applyInPandas(run, T.StructType([T.StructField(*n) for n in names]))
