"""Pivot levels of the period before, and Ichimoku's forward frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.bars import UNITS, as_of, resample

NONE = "cast(null as double)"
_R, _P = "(high - low)", "((high + low + close) / 3.0)"
_DEMARK = "(0.25 * (high + low + close + case when open = close then close when close > open then high else low end))"
_WOODIE = "((2 * open + high + low) / 4.0)"
_COMMON = {"S1": "2 * {p} - high", "R1": "2 * {p} - low"}


def _steps(p: str, down: list[str], up: list[str]) -> dict[str, str]:
    return {"P": p} | {f"S{i}": v for i, v in enumerate(down, 1)} | {f"R{i}": v for i, v in enumerate(up, 1)}


def _around(centre: str, factors: list[str]) -> tuple[list[str], list[str]]:
    return [f"{centre} - {f} * {_R}" for f in factors], [f"{centre} + {f} * {_R}" for f in factors]


def _double(p: str) -> tuple[str, str]:
    return f"2 * {p} - high", f"2 * {p} - low"


#: Levels by method over the period's open, high, low and close; the factors are fixed values.
METHODS: dict[str, dict[str, str]] = {
    "camarilla": _steps(_P, *_around("close", [repr(11 / 120), repr(11 / 60), "0.275", "0.55"])),
    "classic": _steps(_P, *([_double(_P)[i], *_around(_P, ["1.0", "2.0", "3.0"])[i]] for i in (0, 1))),
    "demark": _steps(_DEMARK, *([_double(_DEMARK)[i], NONE, NONE, NONE] for i in (0, 1))),
    "fibonacci": _steps(_P, *([*_around(_P, ["0.382", "0.618", "1.0"])[i], NONE] for i in (0, 1))),
    "traditional": _steps(_P, *([_double(_P)[i], *_around(_P, ["1.0", "2.0", "2.0"])[i]] for i in (0, 1))),
    "woodie": _steps(_WOODIE, [_double(_WOODIE)[0], f"{_WOODIE} - {_R}", f"low - 2 * (high - {_WOODIE})", f"low - 2 * (high - {_WOODIE}) - {_R}"], [_double(_WOODIE)[1], f"{_WOODIE} + {_R}", f"high + 2 * ({_WOODIE} - low)", f"high + 2 * ({_WOODIE} - low) + {_R}"]),
}


def pivot_names(method: str, anchor: str) -> dict[str, str]:
    return {k: f"PIVOTS_{method[:4].upper()}_{anchor}_{k}" for k in METHODS[method]}


def pivots(bars: DataFrame, key: str, order: str, method: str = "traditional", anchor: str = "D", join: str = "backward") -> DataFrame:
    """Bars with the levels of the last finished period (``backward``: no look-ahead) or, ``forward``, of the
    period whose end is the next one at or after the bar."""
    if method not in METHODS:
        raise ValueError(f"unknown pivot method {method!r}; known: {', '.join(METHODS)}")
    unit = UNITS[anchor]
    names = pivot_names(method, anchor)
    end = F.col("period") + F.expr(f"interval 1 {unit}")
    levels = resample(bars, key, order, anchor).select(key, end.alias(order), *(F.expr(sql).alias(names[k]) for k, sql in METHODS[method].items()))
    return as_of(bars, levels, key, order, list(names.values()), join)


def ichimoku_forward(bars: DataFrame, key: str, order: str, tenkan: int = 9, kijun: int = 26, senkou: int = 52, step: str = "interval 1 day") -> DataFrame:
    """The next kijun values of the leading spans: key, order, ISA, ISB."""
    longest = max(tenkan, kijun, senkou)
    over = Window.partitionBy(key).orderBy(order)
    mid = lambda n: 0.5 * (F.max("high").over(over.rowsBetween(1 - n, 0)) + F.min("low").over(over.rowsBetween(1 - n, 0)))
    seen = bars.withColumns({"n": F.row_number().over(over), "a": 0.5 * (mid(tenkan) + mid(kijun)), "b": mid(senkou), "from_end": F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())), "last": F.max(order).over(Window.partitionBy(key))})
    ready = F.col("n") >= longest
    ahead = seen.where(F.col("from_end") <= kijun)
    return ahead.select(key, F.expr(f"last + {step} * ({kijun} + 1 - from_end)").alias(order), F.when(ready, F.col("a")).alias(f"ISA_{tenkan}"), F.when(ready, F.col("b")).alias(f"ISB_{senkou}"))
