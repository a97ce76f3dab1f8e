"""Supply and demand zones by a fixed look-back: swing points whose level is broken a set number of bars later,
with volume, and that price then comes back to and leaves again.

Only the search for swing points and the true range need a pass in order; all else is one set of windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as k
from .recursive import Recursive, with_recursive

Bound = float | tuple[float | None, float | None] | None


@dataclass(frozen=True)
class PeakSearch:
    """What a local maximum must meet; a single number is the least, a pair the least and the most."""

    height: Bound = None
    threshold: Bound = None
    distance: float | None = None
    prominence: Bound = None
    width: Bound = None
    wlen: float | None = None
    rel_height: float = 0.5
    plateau_size: Bound = None


def _within(values: np.ndarray, bound: Bound, largest: np.ndarray | None = None) -> np.ndarray:
    least, most = bound if isinstance(bound, tuple) else (bound, None)
    ok = np.ones(len(values), dtype=bool)
    if least is not None:
        ok &= values >= least
    if most is not None:
        ok &= (values if largest is None else largest) <= most
    return ok


def _tops(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles and lengths of the level runs with lower neighbours on both sides."""
    edges = np.flatnonzero(x[1:] != x[:-1]) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(x)])) - 1
    inner = np.flatnonzero((starts > 0) & (ends < len(x) - 1))
    inner = inner[(x[starts[inner] - 1] < x[starts[inner]]) & (x[ends[inner] + 1] < x[ends[inner]])]
    return (starts[inner] + ends[inner]) // 2, ends[inner] - starts[inner] + 1


def _apart(places: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Keeps the highest and drops those nearer to it than ``distance``, then the next highest left, and so on."""
    keep = np.ones(len(places), dtype=bool)
    for i in np.argsort(heights, kind="stable")[::-1].tolist():
        if keep[i]:
            lo, hi = np.searchsorted(places, (places[i] - distance + 1, places[i] + distance))
            keep[lo:hi] = False
            keep[i] = True
    return keep


def _bases(x: np.ndarray, p: int, wlen: int) -> tuple[int, int]:
    """The lowest bar on each side, nearest first, before price is higher than at ``p`` or the window ends."""
    lo, hi = (max(p - wlen // 2, 0), min(p + wlen // 2, len(x) - 1)) if wlen else (0, len(x) - 1)
    left, right = x[lo : p + 1][::-1], x[p : hi + 1]
    higher = np.flatnonzero(left > x[p])
    left = left[: higher[0]] if len(higher) else left
    higher = np.flatnonzero(right > x[p])
    right = right[: higher[0]] if len(higher) else right
    return p - int(np.argmin(left)), p + int(np.argmin(right))


def _crossing(x: np.ndarray, p: int, base: int, level: float) -> float:
    """Where the line through the bars from ``p`` to its base falls to the level."""
    way = 1 if base > p else -1
    path = x[p : base + 1] if way > 0 else x[base : p + 1][::-1]
    under = np.flatnonzero(path <= level)
    i = p + way * (int(under[0]) if len(under) else len(path) - 1)
    return i - way * (level - x[i]) / (x[i - way] - x[i]) if x[i] < level else float(i)


def find_peaks(x: np.ndarray, search: PeakSearch) -> np.ndarray:
    """Places of the local maxima that meet a search; a level top counts once, at its middle.

    Filters follow one another: plateau, height, threshold, distance, prominence, width. NaN is no maximum.
    """
    s = search
    if s.wlen is not None and s.wlen <= 1 or s.distance is not None and s.distance < 1:
        raise ValueError("wlen must be over 1 and distance at least 1")
    if len(x) < 3:
        return np.empty(0, dtype=int)
    found, lengths = _tops(x)
    found = found[_within(lengths, s.plateau_size)]
    found = found[_within(x[found], s.height)]
    if s.threshold is not None:
        sides = np.stack((x[found] - x[found - 1], x[found] - x[found + 1]))
        found = found[_within(sides.min(axis=0), s.threshold, sides.max(axis=0))]
    if s.distance is not None:
        found = found[_apart(found, x[found], math.ceil(s.distance))]
    if s.prominence is None and s.width is None:
        return found
    bases = [_bases(x, int(p), math.ceil(s.wlen) if s.wlen else 0) for p in found]
    stands = np.array([x[p] - max(x[a], x[b]) for p, (a, b) in zip(found, bases, strict=True)])
    ok = _within(stands, s.prominence)
    if s.width is not None:
        levels = x[found] - stands * s.rel_height
        widths = [_crossing(x, int(p), b, h) - _crossing(x, int(p), a, h) for p, (a, b), h in zip(found, bases, levels, strict=True)]
        ok &= _within(np.array(widths), s.width)
    return found[ok]


def order_zones(bars: DataFrame, key: str, order: str, peak: PeakSearch = PeakSearch(), valley: PeakSearch = PeakSearch(), lookback: int = 20, confirmation_window: int = 10, min_reaction_size: float = 0.002, atr_period: int = 14, volume_window: int = 20, liquidity_window: int = 10, liquidity_tolerance: float = 0.001) -> DataFrame:
    """key, block_type, start, break, retest, zone_low, zone_high: one row per confirmed zone.

    ``peak`` is searched in high and ``valley`` in low, both for maxima. A peak near the lowest low of the last
    ``liquidity_window`` bars gives supply, any other bar that is a valley near the highest high gives demand.
    The reaction is a share of the zone's edge, so where prices are positive the rule holds only for a bar that
    closes at its extreme, on the edge itself; it confirms freely where the lower edge is negative.
    A window that is not full, and a zone whose edge is 0, confirm nothing.
    """
    if confirmation_window < 2:
        raise ValueError("confirmation_window must be 2 or more, as the break itself is its first bar")

    def swings(high, low, close):
        flags = np.zeros((2, len(high)))
        for row, x, search in zip(flags, (high, low), (peak, valley), strict=True):
            row[find_peaks(x, search)] = 1.0
        return k.atr(high, low, close, atr_period), *flags

    plain = bars.select(F.col(key).alias("key"), F.col(order).alias("at"), *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    marked = with_recursive(plain, "key", "at", [Recursive(("atr", "peak", "valley"), ("high", "low", "close"), swings)])
    over = Window.partitionBy("key").orderBy("at")

    def full(how, column, n):
        last = over.rowsBetween(1 - n, 0)
        return F.when(F.count(column).over(last) == n, how(column).over(last))

    supply = F.col("peak") == 1
    known = marked.withColumns({
        "mean": full(F.avg, "volume", volume_window),
        "near": F.coalesce(F.when(supply, F.abs(full(F.min, "low", liquidity_window) - F.col("low"))).otherwise(F.abs(full(F.max, "high", liquidity_window) - F.col("high"))) < liquidity_tolerance, F.lit(False)),
        "zone_low": F.col("close") - F.col("atr"),
        "zone_high": F.col("close") + F.col("atr"),
    })
    bar = F.struct("at", "high", "low", "close", "volume", "mean")
    ahead = F.collect_list(bar).over(over.rowsBetween(lookback + 1, lookback + confirmation_window - 1))
    placed = known.withColumns({"b": F.lead(bar, lookback).over(over), "later": ahead})
    broken = (F.col("b.volume") > F.col("b.mean")) & F.when(supply, F.col("b.low") < F.col("low")).otherwise(F.col("b.high") > F.col("high"))

    def leaves(x):
        low, high = F.col("zone_low"), F.col("zone_high")
        reached = F.when(supply, x["low"]).otherwise(x["high"])
        reaction = F.when(supply, F.try_divide(low - x["close"], low)).otherwise(F.try_divide(x["close"] - high, high))
        return reached.between(low, high) & (x["volume"] > x["mean"]) & (reaction >= min_reaction_size)

    found = placed.where((supply | (F.col("valley") == 1)) & F.col("near") & broken).withColumn("r", F.get(F.filter("later", leaves), F.lit(0))).where("r is not null")
    return found.select(F.col("key").alias(key), F.when(supply, "supply").otherwise("demand").alias("block_type"), F.col("at").alias("start"), F.col("b.at").alias("break"), F.col("r.at").alias("retest"), "zone_low", "zone_high")
