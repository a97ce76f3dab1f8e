"""Recursive indicators as one fused grouped map per request."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as k


@dataclass(frozen=True)
class Recursive:
    """outputs of ``kernel``, which takes the columns ``inputs`` as arrays and returns one array or a tuple."""

    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    kernel: Callable


C, HLC, OHLC = ("close",), ("high", "low", "close"), ("open", "high", "low", "close")


def _make(outputs, inputs, function, *args):
    return Recursive(tuple(outputs), inputs, lambda *a: function(*a, *args))


def tag(*parts) -> str:
    """Parameters as a column name's tail."""
    return "_".join(f"{p:g}" if isinstance(p, float) else str(p) for p in parts).replace(".", "_").replace("-", "m")


def _average(name: str):
    def build(length=10):
        return _make([f"{name.upper()}_{length}"], C, k.AVERAGES[name], length)

    return build


def average(output: str, kind: str, column: str, length: int) -> Recursive:
    """A moving average of any column, by name."""
    return _make([output], (column,), lambda x: k.moving_average(kind, x, length))


INDICATORS: dict[str, Callable[..., Recursive]] = {
    "ema": _average("ema"),
    "rma": _average("rma"),
    "smma": lambda length=10: _make([f"SMMA_{length}"], C, k.rma, length),
    "dema": _average("dema"),
    "tema": _average("tema"),
    "t3": lambda length=10, a=0.7: _make([f"T3_{tag(length, a)}"], C, k.t3, length, a),
    "kama": lambda length=10, fast=2, slow=30, drift=1: _make([f"KAMA_{length}_{fast}_{slow}"], C, k.kama, length, fast, slow, drift),
    "vidya": lambda length=14, drift=1: _make([f"VIDYA_{length}"], C, k.vidya, length, drift),
    "mama": lambda fastlimit=0.5, slowlimit=0.05, prenan=3: _make([f"{n}_{tag(fastlimit, slowlimit)}" for n in ("MAMA", "FAMA")], C, k.mama, fastlimit, slowlimit, prenan),
    "jma": lambda length=7, phase=0.0: _make([f"JMA_{tag(length, phase)}"], C, k.jma, length, phase),
    "hwma": lambda na=0.2, nb=0.1, nc=0.1: _make([f"HWMA_{tag(na, nb, nc)}"], C, k.hwma, na, nb, nc),
    "mcgd": lambda length=10, c=1.0: _make([f"MCGD_{length}"], C, k.mcgd, length, c),
    "ssf": lambda length=20, everget=False: _make([f"SSF{'e' if everget else ''}_{length}"], C, k.ssf, length, everget),
    "ssf3": lambda length=20: _make([f"SSF3_{length}"], C, k.ssf3, length),
    "zlma": lambda length=10, mamode="ema": _make([f"ZL_{mamode.upper()}_{length}"], C, k.zlma, length, mamode),
    "alligator": lambda jaw=13, teeth=8, lips=5: _make([f"AG{n}_{jaw}_{teeth}_{lips}" for n in "jtl"], C, k.alligator, jaw, teeth, lips),
    "rsi": lambda length=14, scalar=100.0, drift=1: _make([f"RSI_{length}"], C, k.rsi, length, scalar, drift),
    "atr": lambda length=14, mamode="rma", drift=1, percent=False: _make([f"ATR_{length}"], HLC, k.atr, length, mamode, drift, percent),
    "atrts": lambda length=14, ma_length=20, kk=3.0, mamode="ema", percent=False: _make([f"ATRTS_{tag(length, ma_length, kk)}"], HLC, k.atr_stop, length, ma_length, kk, mamode, percent),
    "aberration": lambda length=5, atr_length=15: _make([f"ABER_{n}_{length}_{atr_length}" for n in ("ZG", "SG", "XG", "ATR")], HLC, k.aberration, length, atr_length),
    "macd": lambda fast=12, slow=26, signal=9, asmode=False: _make([f"MACD{'AS' if asmode else ''}{n}_{fast}_{slow}_{signal}" for n in ("", "s", "h")], C, k.macd, fast, slow, signal, asmode),
    "adx": lambda length=14, signal_length=None, adxr_length=2, scalar=100.0, mamode="rma", drift=1, tvmode=False: _make([f"ADX_{signal_length or length}", f"ADXR_{signal_length or length}_{adxr_length}", f"DMP_{length}", f"DMN_{length}"], HLC, k.adx, length, signal_length, adxr_length, scalar, mamode, drift, tvmode),
    "rwi": lambda length=14, mamode="rma", drift=1: _make([f"RWI_HIGH_{length}", f"RWI_LOW_{length}"], HLC, k.rwi, length, mamode, drift),
    "supertrend": lambda length=7, atr_length=None, multiplier=3.0, atr_mamode="rma": _make([f"SUPERT{n}_{tag(length, multiplier)}" for n in ("", "d", "l", "s")], HLC, k.supertrend, length, atr_length, multiplier, atr_mamode),
    "stochrsi": lambda length=14, rsi_length=14, kk=3, d=3, mamode="sma": _make([f"STOCHRSI{n}_{length}_{rsi_length}_{kk}_{d}" for n in "kd"], C, k.stochrsi, length, rsi_length, kk, d, mamode),
    "crsi": lambda rsi_length=3, streak_length=2, rank_length=100, scalar=100.0, normalize=False: _make([f"CRSI_{rsi_length}_{streak_length}_{rank_length}"], C, k.crsi, rsi_length, streak_length, rank_length, scalar, normalize),
    "ha": lambda: _make([f"HA_{n}" for n in OHLC], OHLC, k.heikin_ashi),
    "kagi": lambda reversal=5.0: _make(["KAGI"], C, k.kagi, reversal),
    "pf_trend": lambda box_size=2.0, reversal=3: _make(["PF_TREND"], C, k.point_and_figure, box_size, reversal),
    "renko": lambda box_size=2.0: _make(["RENKO"], C, k.renko, box_size),
    "ott": lambda length=2, percent=1.4, ma_type="VAR": _make([f"{n}_{tag(length, percent)}_{ma_type}" for n in ("OTT_MA", "OTT_LONG_STOP", "OTT_SHORT_STOP", "OTT_DIRECTION", "OTT")], C, k.ott, length, percent, ma_type),
    "rsi_clouds": lambda rsi_length=14, macd_fast=12, macd_slow=26, macd_signal=9, rsi_scalar=100.0, rsi_drift=1, macd_mamode="ema": _make([f"RSI_CLOUDS_{n}_{rsi_length}" for n in ("RSI", "MACD", "SIGNAL", "HIST")], OHLC, k.rsi_clouds, rsi_length, macd_fast, macd_slow, macd_signal, rsi_scalar, rsi_drift, macd_mamode),
    "scrsi": lambda domcycle=20, vibration=10, leveling=10.0: _make([f"SCRSI_{n}_{domcycle}_{vibration}" for n in ("scaled", "crsi", "lb", "ub")], C, k.scrsi, domcycle, vibration, leveling),
    "avsl": lambda fast=12, slow=26, stand_div=1.0, max_deviation=None: _make(["avsl"], ("low", "close", "volume"), k.price_volume_stop, fast, slow, stand_div, max_deviation, -1),
    "avsl_older": lambda length_fast=12, length_slow=26, stand_div=1.0: _make(["avsl"], ("low", "close", "volume"), k.price_volume_stop, length_fast, length_slow, stand_div, None, -1, True),
    "avsr": lambda fast=12, slow=26, stand_div=1.0, max_deviation=None: _make(["avsr"], ("high", "close", "volume"), k.price_volume_stop, fast, slow, stand_div, max_deviation, 1),
    "avsr_older": lambda length_fast=12, length_slow=26, stand_div=1.0: _make(["avsr"], ("high", "close", "volume"), k.price_volume_stop, length_fast, length_slow, stand_div, None, 1, True),
}


def with_recursive(bars: DataFrame, key: str, order: str, requests: list[Recursive]) -> DataFrame:
    """Bars with the requests' outputs, computed in one pass over each series."""
    outputs = [n for r in requests for n in r.outputs]
    bars = bars.drop(*outputs)
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in outputs)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable", ignore_index=True)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for r in requests:
                out = r.kernel(*(frame[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in r.inputs))
                for name, values in zip(r.outputs, out if isinstance(out, tuple) else (out,), strict=True):
                    frame[name] = np.where(np.isfinite(values), values, np.nan)
        return frame

    return bars.groupBy(key).applyInPandas(run, schema)
