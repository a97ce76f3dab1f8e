"""Swing points and market structure."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def flat_tops(x: np.ndarray, least: int) -> np.ndarray:
    """Middles of level runs of three bars or more, counted without the series' first and last bar, that are at
    least ``least`` long, and next to which the neighbour on each side stands above the bar beyond it."""
    n = len(x)
    edges = np.flatnonzero(np.diff(x) != 0) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [n])) - 1
    found = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = max(s - 1, 0), min(e + 1, n - 1)
        rises, falls = left == 0 or x[left] > x[left - 1], right == n - 1 or x[right] > x[right + 1]
        if e - s >= 2 and right - left - 1 >= least and rises and falls:
            found.append(left + 1 + (right - left - 1) // 2)
    return np.array(found, dtype=int)


def peaks(x: np.ndarray, prominence: float = 0.0, distance: int = 1, wlen: int = 0, width: int = -1, rel_height: float = 0.5, plateau_size: int = -1) -> np.ndarray:
    """Places of strict local maxima, and with a ``plateau_size`` of 0 or more of flat tops, that stand out by
    ``prominence``, at most one for each ``distance`` bars.

    Prominence is measured to the higher of the two sides' lowest points, each side taken whole or half of
    ``wlen``; of maxima too close to the first of their group, the highest stays.
    """
    n = len(x)
    found = 1 + np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) if n > 2 else np.empty(0, int)
    if plateau_size >= 0 and n > 2:
        found = np.sort(np.concatenate((found, flat_tops(x, plateau_size))))
    if prominence > 0 or width >= 0:
        kept = []
        if wlen <= 0:
            low_left, low_right = np.minimum.accumulate(x), np.minimum.accumulate(x[::-1])[::-1]
        for p in found.tolist():
            lo, hi = (max(p - wlen // 2, 0), min(p + wlen // 2, n - 1)) if wlen > 0 else (0, n - 1)
            base = max(x[lo : p + 1].min(), x[p : hi + 1].min()) if wlen > 0 else max(low_left[p], low_right[p])
            if x[p] - base < prominence:
                continue
            if width >= 0:
                level = x[p] - (x[p] - base) * rel_height
                left = np.flatnonzero(x[lo : p + 1] <= level)
                right = np.flatnonzero(x[p : hi + 1] <= level)
                if (p + right[0] if len(right) else p) - (lo + left[-1] if len(left) else p) < width:
                    continue
            kept.append(p)
        found = np.array(kept, dtype=int)
    if distance > 1 and len(found) > 1:
        kept, i = [], 0
        while i < len(found):
            j = int(np.searchsorted(found, found[i] + distance))
            kept.append(found[i + int(np.argmax(x[found[i:j]]))])
            i = j
        found = np.array(kept, dtype=int)
    return found


def zigzag(bars: DataFrame, key: str, order: str, prominence_peak: float = 0.01, prominence_valley: float = 0.01, distance: int = 5, wlen: int = 0, width: int = -1, rel_height: float = 0.5, plateau_size: int = -1) -> DataFrame:
    """Bars with is_peak (of high) and is_valley (of low)."""
    schema = T.StructType([*bars.schema.fields, T.StructField("is_peak", T.BooleanType()), T.StructField("is_valley", T.BooleanType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable", ignore_index=True)
        for name, x, least in (("is_peak", frame["high"], prominence_peak), ("is_valley", -frame["low"], prominence_valley)):
            flags = np.zeros(len(frame), dtype=bool)
            flags[peaks(x.to_numpy(dtype=float), least, distance, wlen, width, rel_height, plateau_size)] = True
            frame[name] = flags
        return frame

    return bars.groupBy(key).applyInPandas(run, schema)


def market_structure(flagged: DataFrame, key: str, order: str, lookback: int = 10, min_consecutive: int = 3) -> DataFrame:
    """structure_label and trend_direction as of every bar with an extreme, from bars with is_peak and is_valley.

    The label says whether the last peak is above the one before it (HH, else LH) and the last valley above its
    predecessor (HL, else LL); it needs two of each, and a ``lookback``, in extremes of a kind, that holds two. The trend
    is up if the last ``min_consecutive`` extremes within the lookback, peaks after valleys of the same bar, are all of kinds
    that rose, down if all are of kinds that did not, else null.
    """
    high, low = (F.struct(F.lit(i).alias("kind"), F.col(c).alias("price")) for i, c in ((1, "high"), (0, "low")))
    both = F.array_compact(F.array(F.when(F.col("is_valley"), low), F.when(F.col("is_peak"), high)))
    extremes = flagged.select(key, order, F.explode(both).alias("x")).select(key, order, "x.kind", "x.price")
    along = Window.partitionBy(key).orderBy(order, "kind")
    sofar = along.rowsBetween(Window.unboundedPreceding, 0)
    above = F.col("price") > F.lag("price").over(Window.partitionBy(key, "kind").orderBy(order))
    out = extremes.withColumn("above", above)
    for i, name in ((1, "peak"), (0, "valley")):
        is_kind = F.col("kind") == i
        seen = F.count(F.when(is_kind, 1))
        out = out.withColumns({f"{name}s": seen.over(sofar), f"{name}_up": F.last(F.when(is_kind, F.col("above")), ignorenulls=True).over(sofar), f"{name}_near": (seen.over(along.rowsBetween(1 - min_consecutive, 0)) > 0) | F.lit(min_consecutive > lookback)})
    known = (F.col("peaks") >= 2) & (F.col("valleys") >= 2) & F.lit(lookback >= 2)
    enough = known & (F.least("peaks", F.lit(lookback)) + F.least("valleys", F.lit(lookback)) >= min_consecutive)
    agree = lambda way: reduce(lambda a, b: a & b, (~F.col(f"{n}_near") | (F.col(f"{n}_up") == way) for n in ("peak", "valley")))
    label = F.concat(F.when(F.col("peak_up"), "HH").otherwise("LH"), F.lit("/"), F.when(F.col("valley_up"), "HL").otherwise("LL"))
    trend = F.when(enough & agree(True), "up").when(enough & agree(False), "down")
    out = out.withColumn("last", F.row_number().over(Window.partitionBy(key, order).orderBy(F.col("kind").desc()))).where("last = 1")
    return out.select(key, order, F.when(known, label).alias("structure_label"), trend.alias("trend_direction"))
