"""SQL for the finite-window queries, written from their definitions with DuckDB's own aggregates.

Nothing here comes from the declarations that the queries run, so that agreement says something about both. ``w5``
stands for the window of the last five bars, ``w`` for the order, ``all`` for the whole series; ``rn`` is a bar's number and
``p`` the close before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Plain:
    """columns of the result; first: columns made before them, in stages."""

    columns: dict[str, str]
    first: tuple[dict[str, str], ...] = ()


def sql(bars: str, shown: str, plain: Plain) -> str:
    """The query over the bars; shown: what follows the table ``last_stage``."""
    stages = [{"rn": "row_number() over w", "p": "lag(close) over w"}, *plain.first]
    parts, table = [f"bars as ({bars})"], "bars"
    for i, stage in enumerate([*stages, plain.columns]):
        last = i == len(stages)
        text = ", ".join(f'{x} as "{n}"' for n, x in stage.items())
        frames = ["w as (partition by sym order by ts)", "all_ as (partition by sym)"]
        frames += [f"w{n} as (partition by sym order by ts rows {int(n) - 1} preceding)" for n in sorted(set(re.findall(r"\bover w(\d+)\b", text)))]
        name = "last_stage" if last else f"x{i}"
        parts.append(f"{name} as (select {'sym, ts' if last else '*'}, {text} from {table} window {', '.join(frames)})")
        table = name
    return f"with {', '.join(parts)} {shown}"


def after(n: int, value: str) -> str:
    return f"case when rn >= {n} then {value} end"


def dot(n: int, weight: str, x: str = "close") -> str:
    """Mean of the last n values, oldest first, by a weight in terms of i = 1..n."""
    weights = f"list_transform(range(1, {n + 1}), lambda i: cast({weight} as double))"
    return f"list_dot_product(list(coalesce(cast({x} as double), 0)) over w{n}, {weights}) / list_sum({weights})"


def spread(n: int, x: str) -> str:
    """Mean absolute deviation of the last n values."""
    return f"list_avg(list_transform(list({x}) over w{n}, lambda v: abs(v - mean)))"


def over_range(n: int, value: str) -> str:
    """A value's place between the lowest low and the highest high."""
    return f"({value} - min(low) over w{n}) / nullif(max(high) over w{n} - min(low) over w{n}, 0)"


RANGE = "greatest(high - low, abs(high - p), abs(low - p))"
WIDE = "4 * (high - low) / nullif(high + low, 0)"
PRICES = ("open", "high", "low", "close")
FIBONACCI = "list_extract([1, 1, 2, 3, 5, 8, 13, 21, 34, 55], i)"
LINE, SLOPE = "regr_intercept(close, rn) over w14 + regr_slope(close, rn) over w14 * rn", "regr_slope(close, rn) over w14"


def _regression(name: str, value: str) -> Plain:
    return Plain({f"LINREG_{name}_14": after(14, value)})


def _deviations(whole: str, bar: str = "true") -> Plain:
    """Regression line over a part of the series and its bands."""
    line = "regr_intercept(y, rn) over all_ + regr_slope(y, rn) over all_ * rn"
    columns = {f"{whole}_LR": f"case when y is not null then {line} end"}
    for k in (1, 2, 3):
        columns |= {f"{whole}_{s}_{k}": f"case when y is not null then {line} {sign} {k} * stddev_samp(y) over all_ end" for s, sign in (("L", "-"), ("U", "+"))}
    return Plain(columns, ({"total": "count(*) over all_"}, {"y": f"case when {bar} then close end"}))


def _price_volume(name: str, price: str, below: bool, older: bool = False) -> Plain:
    """The level that price and volume hold: bars 12 and 26 back, a part over a number of bars that the pressure gives."""
    part = f"list_sum(list_slice(ratios, -n, -1)) / divisor / n / 100"
    if older:
        part = f"case when list_contains(list_transform(list_slice(ratios, -n, -1), lambda r: r is null), true) then null else {part} end"
    sign = ("-", "+") if below else ("+", "-")
    stages = (
        {f"vw{n}": after(n, f"sum(close * volume) over w{n} / sum(volume) over w{n}") for n in (12, 26)} | {f"m{n}": f"avg(close) over w{n}" for n in (12, 26)} | {"flow": after(26, "avg(volume) over w12 / avg(volume) over w26")},
        {"spread": "vw26 - m26", "relation": "vw12 / m12"},
        {"pressure": "spread * relation * flow", "ratios": f"list({price} / relation) over w"},
        {"n": "cast(round_even(case when spread < 0 then abs(pressure - 3) else pressure + 3 end, 0) as bigint)", "divisor": "case when spread > -1 and spread < 0 then -1 when spread >= 0 and spread < 1 then 1 else spread end"},
        {"level": f"case when pressure is not null then {price} {sign[0]} (case when n <= 0 then {price} else {part} end) {sign[1]} pressure * flow end"},
    )
    return Plain({name: "case when count(level) over w26 = 26 then avg(level) over w26 end"}, stages)


FINITE: dict[str, Plain] = {
    "sma": Plain({"SMA_10": after(10, "avg(close) over w10")}),
    "sma_orders": Plain({"SMA_20": after(20, "avg(close) over w20")}),
    "wma": Plain({"WMA_10": after(10, dot(10, "i"))}),
    "wma_desc": Plain({"WMA_10": after(10, dot(10, "11 - i"))}),
    "fwma": Plain({"FWMA_10": after(10, dot(10, FIBONACCI))}),
    "pwma": Plain({"PWMA_10": after(10, dot(10, "list_extract([1, 9, 36, 84, 126, 126, 84, 36, 9, 1], i)"))}),
    "sinwma": Plain({"SINWMA_14": after(14, dot(14, "sin(pi() * i / 15)"))}),
    "swma": Plain({"SWMA_10": after(10, dot(10, "least(i, 11 - i)"))}),
    "alma": Plain({"ALMA_9_6_0_85": after(9, dot(9, "exp(-0.5 * power((6.0 / 9) * (i - 1 - 0.85 * 8), 2))"))}),
    "trima": Plain({"TRIMA_10": after(9, "avg(half) over w5")}, ({"half": after(5, "avg(close) over w5")},)),
    "hma": Plain({"HMA_10": after(12, dot(3, "i", "raw"))}, ({"raw": after(10, f"2 * {dot(5, 'i')} - {dot(10, 'i')}")},)),
    "linreg": _regression("line", LINE),
    "linreg_slope": _regression("slope", SLOPE),
    "linreg_intercept": _regression("intercept", f"{LINE} - 14 * ({SLOPE})"),
    "linreg_angle": _regression("angle", f"atan({SLOPE})"),
    "linreg_tsf": _regression("tsf", f"{LINE} + {SLOPE}"),
    "linreg_r": _regression("r", "corr(close, rn) over w14"),
    "midpoint": Plain({"MIDPOINT_2": after(2, "(min(close) over w2 + max(close) over w2) / 2")}),
    "midprice": Plain({"MIDPRICE_2": after(2, "(min(low) over w2 + max(high) over w2) / 2")}),
    "vwma": Plain({"VWMA_10": after(10, "sum(close * volume) over w10 / nullif(sum(volume) over w10, 0)")}),
    "hl2": Plain({"HL2": "0.5 * high + 0.5 * low"}),
    "hlc3": Plain({"HLC3": "list_avg([high, low, close])"}),
    "ohlc4": Plain({"OHLC4": "list_avg([open, high, low, close])"}),
    "wcp": Plain({"WCP": "list_avg([high, low, close, close])"}),
    "ichimoku": Plain(
        {"ITS_9": "tenkan", "IKS_26": "kijun", "ISA_9": "(lag(tenkan, 25) over w + lag(kijun, 25) over w) / 2", "ISB_52": "lag(senkou, 25) over w", "ICS_26": "lead(close, 25) over w"},
        ({name: after(52, f"(max(high) over w{n} + min(low) over w{n}) / 2") for name, n in (("tenkan", 9), ("kijun", 26), ("senkou", 52))},),
    ),
    "ao": Plain({"AO_5_34": after(34, "avg((high + low) / 2) over w5 - avg((high + low) / 2) over w34")}),
    "apo": Plain({"APO_12_26": after(26, "avg(close) over w12 - avg(close) over w26")}),
    "bias": Plain({"BIAS_SMA_26": after(26, "close / avg(close) over w26 - 1")}),
    "bop": Plain({"BOP": "(close - open) / nullif(high - low, 0)"}),
    "brar": Plain({"AR_26": after(26, "100 * sum(high - open) over w26 / nullif(sum(open - low) over w26, 0)"), "BR_26": after(27, "100 * sum(greatest(high - p, 0)) over w26 / nullif(sum(greatest(p - low, 0)) over w26, 0)")}),
    "cci": Plain({"CCI_14_0_015": after(14, f"(typical - mean) / nullif(0.015 * {spread(14, 'typical')}, 0)")}, ({"typical": "(high + low + close) / 3"}, {"mean": "avg(typical) over w14"})),
    "cfo": Plain({"CFO_9": after(9, "100 - 100 * (regr_intercept(close, rn) over w9 + regr_slope(close, rn) over w9 * (rn + 1)) / close")}),
    "cg": Plain({"CG_10": after(10, f"-55 * {dot(10, 'i')} / sum(close) over w10")}),
    "cmo": Plain({"CMO_14": after(15, "100 * sum(close - p) over w14 / nullif(sum(abs(close - p)) over w14, 0)")}),
    "coppock": Plain({"COPC_11_14_10": after(24, dot(10, "i", "rates"))}, ({"rates": after(15, "100 * (close / lag(close, 11) over w + close / lag(close, 14) over w - 2)")},)),
    "roc": Plain({"ROC_10": "100 * (close - lag(close, 10) over w) / nullif(lag(close, 10) over w, 0)"}),
    "stochf": Plain({"STOCHFk_14_3": "k", "STOCHFd_14_3": after(16, "case when count(k) over w3 = 3 then avg(k) over w3 end")}, ({"k": after(14, f"100 * {over_range(14, 'close')}")},)),
    "entropy": Plain({"ENTP_10": after(10, "-list_sum(list_transform(list(close) over w10, lambda v: case when v > 0 then v / s * log2(v / s) else 0 end))")}, ({"s": "sum(close) over w10"},)),
    "skew": Plain({"SKEW_30": after(30, "skewness(close) over w30")}),
    "kurtosis": Plain({"KURT_30": after(30, "kurtosis(close) over w30 / 29")}),
    "kurtosis_corrected": Plain({"KURT_30": after(30, "kurtosis(close) over w30")}),
    "mad": Plain({"MAD_30": after(30, spread(30, "close"))}, ({"mean": "avg(close) over w30"},)),
    "median": Plain({"MEDIAN_30": after(30, "quantile_cont(close, 0.5) over w30")}),
    "quantile": Plain({"QTL_30_0_5": after(30, "quantile_disc(close, 0.5) over w30")}),
    "stdev": Plain({"STDEV_30": after(30, "stddev_samp(close) over w30")}),
    "stdev_multi": Plain({f"{c}_stdev": after(30, f"stddev_samp({c}) over w30") for c in PRICES}),
    "variance": Plain({"VAR_30": after(30, "var_samp(close) over w30")}),
    "zscore": Plain({"ZS_30": after(30, "(close - avg(close) over w30) / nullif(stddev_samp(close) over w30, 0)")}),
    "true_range": Plain({"TRUERANGE_1": after(2, RANGE)}),
    "atr_sma": Plain({"ATR_14": after(15, f"avg({RANGE}) over w14")}),
    "accbands": Plain({"ACCBU_20": after(20, "avg(hi) over w20"), "ACCBM_20": after(20, "avg(close) over w20"), "ACCBL_20": after(20, "avg(lo) over w20")}, ({"hi": f"high + high * {WIDE}", "lo": f"low - low * {WIDE}"},)),
    "bbands": Plain(
        {"BBL_20_2_2": "m - 2 * d", "BBM_20_2_2": "m", "BBU_20_2_2": "m + 2 * d", "BBB_20_2_2": "400 * d / nullif(m, 0)", "BBP_20_2_2": "0.5 + (close - m) / nullif(4 * d, 0)"},
        ({"m": after(20, "avg(close) over w20"), "d": after(20, "stddev_samp(close) over w20")},),
    ),
    "cdl_z": Plain({f"{c}_Z_30_1": after(30, f"coalesce(({c} - avg({c}) over w30) / nullif(stddev_samp({c}) over w30, 0), 0)") for c in PRICES}),
    "cdl_z_full": Plain({f"{c}_Za": f"coalesce(({c} - avg({c}) over all_) / nullif(stddev_samp({c}) over all_, 0), 0)" for c in PRICES}),
    "tos_stdevall": _deviations("TOS_STDEVALL"),
    "tos_stdevall_last": _deviations("TOS_STDEVALL_100", "rn > total - 100"),
    "doji": Plain({"CDL_DOJI_10_10": "cast(case when rn >= 10 and 10 * abs(close - open) < avg(high - low) over w10 then 100 else 0 end as double)"}),
    "avsl": _price_volume("avsl", "low", True),
    "avsr": _price_volume("avsr", "high", False),
    "avsl_older": _price_volume("avsl", "low", True, True),
    "avsr_older": _price_volume("avsr", "high", False, True),
}
