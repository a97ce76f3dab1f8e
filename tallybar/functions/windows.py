"""Indicators over finite windows, declared as SQL expressions.

An indicator is a list of stages; a stage gives names to expressions over the columns before it. ``@W(n)``
stands for the last n bars of the series, ``@O`` for the series in order, ``@U`` for all bars so far. The
same declaration compiles to DataFrame columns here and to plain SQL text elsewhere, so Catalyst plans all
indicators of a request over shared windows and no row leaves the JVM.

A stage may also ask for a recursive average by name (``Average``); those of a stage run in one grouped map, while
finite averages stay expressions.

Missing values are NULL, never NaN. A window counts only if all its inputs are there; a division by zero
gives NULL.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Average:
    """A recursive moving average of a column, by name."""

    kind: str
    column: str
    length: int


Stage = dict[str, str | Average]


@dataclass(frozen=True)
class Indicator:
    """stages of expressions; outputs: the names that stay. duck: stages in DuckDB's dialect where it differs."""

    stages: tuple[Stage, ...]
    outputs: tuple[str, ...]
    duck: tuple[Stage, ...] | None = None


def render(expression: str, key: str, order: str) -> str:
    """An expression with its windows spelled out."""
    over = f"partition by {key} order by {order}"
    out = re.sub(r"@W\((\d+)\)", lambda m: f"over ({over} rows between {int(m[1]) - 1} preceding and current row)", expression)
    out = out.replace("@K", key)
    return out.replace("@U", f"over ({over} rows between unbounded preceding and current row)").replace("@O", f"over ({over})")


def reach(indicator: Indicator) -> int | None:
    """How many bars before a bar its values come from; None if bars after it, all bars or a recursion take part."""
    total = 0
    for stage in indicator.stages:
        if any(isinstance(x, Average) or re.search(r"@U|@K|\blead\(", x) for x in stage.values()):
            return None
        text = " ".join(stage.values())
        back = [int(n) - 1 for n in re.findall(r"@W\((\d+)\)", text)] + [int(k) for k in re.findall(r"\blag\([^()]*, (\d+)\) @O", text)]
        if len(back) < text.count("@W(") + text.count("@O"):
            return None
        total += max(back, default=0)
    return total


def full(x: str, n: int, value: str) -> str:
    """``value`` where the window of n bars holds n values of x."""
    return f"case when count({x}) @W({n}) = {n} then {value} end"


def avg(x: str, n: int) -> str:
    return full(x, n, f"avg({x}) @W({n})")


def total(x: str, n: int) -> str:
    return full(x, n, f"sum({x}) @W({n})")


def low(x: str, n: int) -> str:
    return full(x, n, f"min({x}) @W({n})")


def high(x: str, n: int) -> str:
    return full(x, n, f"max({x}) @W({n})")


def back(x: str, k: int) -> str:
    return f"lag({x}, {k}) @O" if k else x


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def weighted(x: str, weights: list[float]) -> str:
    """Sum of weights (oldest first) times values; NULL where one is missing."""
    n = len(weights)
    return "(" + " + ".join(f"{w!r} * ({back(x, n - 1 - i)})" for i, w in enumerate(weights)) + ")"


def normed(weights: list[float]) -> list[float]:
    s = math.fsum(weights)
    return [float(w) / s for w in weights]


def spread(x: str, n: int, ddof: int) -> str:
    """Standard deviation of the last n values."""
    return full(x, n, f"sqrt(greatest(var_pop({x}) @W({n}), 0.0) * {n}.0 / {n - ddof}.0)") if n > ddof else "cast(null as double)"


# weights of the weighted averages


def linear_weights(n: int, asc: bool = True) -> list[float]:
    w = [float(i + 1) for i in range(n)]
    return normed(w if asc else w[::-1])


def fibonacci_weights(n: int, asc: bool = True) -> list[float]:
    w = [1.0, 1.0]
    while len(w) < n:
        w.append(w[-1] + w[-2])
    return normed(w[:n] if asc else w[:n][::-1])


def pascal_weights(n: int, asc: bool = True) -> list[float]:
    return normed([float(math.comb(n - 1, i)) for i in range(n)])


def sine_weights(n: int) -> list[float]:
    return normed([math.sin((i + 1) * math.pi / (n + 1)) for i in range(n)])


def triangle_weights(n: int) -> list[float]:
    return normed([float(min(i + 1, n - i)) for i in range(n)])


def gauss_weights(n: int, sigma: float, offset: float) -> list[float]:
    centre = offset * (n - 1)
    return normed([math.exp(-0.5 * (sigma / n * (i - centre)) ** 2) for i in range(n)])


def regression(x: str, n: int) -> dict[str, str]:
    """Slope and intercept of x over 1..n, as weighted sums of the window."""
    mean = (n + 1) / 2
    square = n * (n * n - 1) / 12
    slope = weighted(x, [(i + 1 - mean) / square for i in range(n)])
    return {"slope": slope, "level": avg(x, n)}


def one(name: str, expression: str) -> Indicator:
    return Indicator(({name: expression},), (name,))


def _ma(kind: str, x: str, n: int) -> str | Average:
    """A moving average of column x by name: an expression if it is one finite window, else a request; unknown names are EMA's."""
    finite = {
        "sma": lambda: avg(x, n),
        "wma": lambda: weighted(x, linear_weights(n)),
        "fwma": lambda: weighted(x, fibonacci_weights(n)),
        "pwma": lambda: weighted(x, pascal_weights(n)),
        "sinwma": lambda: weighted(x, sine_weights(n)),
        "swma": lambda: weighted(x, triangle_weights(n)),
        "midpoint": lambda: f"0.5 * ({low(x, n)} + {high(x, n)})",
    }
    return finite[kind.lower()]() if kind.lower() in finite else Average(kind.lower(), x, n)


def _true_range(drift: int = 1) -> str:
    p = back("close", drift)
    return f"case when {p} is not null then greatest(high - low, abs(high - ({p})), abs(low - ({p}))) end"


def sma(length=10):
    return one(f"SMA_{length}", avg("close", length))


def wma(length=10, asc=True):
    return one(f"WMA_{length}", weighted("close", linear_weights(length, asc)))


def fwma(length=10, asc=True):
    return one(f"FWMA_{length}", weighted("close", fibonacci_weights(length, asc)))


def pwma(length=10, asc=True):
    return one(f"PWMA_{length}", weighted("close", pascal_weights(length, asc)))


def sinwma(length=14):
    return one(f"SINWMA_{length}", weighted("close", sine_weights(length)))


def swma(length=10):
    return one(f"SWMA_{length}", weighted("close", triangle_weights(length)))


def alma(length=9, sigma=6.0, dist_offset=0.85):
    return one(f"ALMA_{length}_{sigma:g}_{dist_offset:g}".replace(".", "_"), weighted("close", gauss_weights(length, sigma, dist_offset)))


def trima(length=10):
    n = (length + 1) // 2
    return Indicator(({"x1": avg("close", n)}, {f"TRIMA_{length}": avg("x1", n)}), (f"TRIMA_{length}",))


def hma(length=10, mamode="wma"):
    half, root = length // 2, int(math.sqrt(length))
    stages = ({"x2": _ma(mamode, "close", half), "x3": _ma(mamode, "close", length)}, {"x1": "2 * x2 - x3"}, {f"HMA_{length}": _ma(mamode, "x1", root)})
    return Indicator(stages, (f"HMA_{length}",))


def linreg(length=14, mode="line", degrees=False):
    name, r = f"LINREG_{mode}_{length}", regression("close", length)
    mid = (length + 1) / 2
    value = {"slope": r["slope"], "intercept": f"{r['level']} - {mid!r} * {r['slope']}", "line": f"{r['level']} + {length - mid!r} * {r['slope']}", "tsf": f"{r['level']} + {length + 1 - mid!r} * {r['slope']}", "angle": f"atan({r['slope']})" + (f" * {180 / math.pi!r}" if degrees else "")}
    if mode == "r":
        scale = math.sqrt((length * length - 1) / 12)
        return one(name, ratio(f"{r['slope']} * {scale!r}", spread("close", length, 0)))
    return one(name, value[mode])


def midpoint(length=2):
    return one(f"MIDPOINT_{length}", f"0.5 * ({low('close', length)} + {high('close', length)})")


def midprice(length=2):
    return one(f"MIDPRICE_{length}", f"0.5 * ({low('low', length)} + {high('high', length)})")


def vwma(length=10):
    return Indicator(({"x1": "close * volume"}, {f"VWMA_{length}": ratio(avg("x1", length), avg("volume", length))}), (f"VWMA_{length}",))


def hl2():
    return one("HL2", "(high + low) / 2.0")


def hlc3():
    return one("HLC3", "(high + low + close) / 3.0")


def ohlc4():
    return one("OHLC4", "(open + high + low + close) / 4.0")


def wcp():
    return one("WCP", "(high + low + 2 * close) / 4.0")


def hilo(high_length=13, low_length=21, mamode="sma"):
    a = f"{high_length}_{low_length}"
    ph, pl = back("mh", 1), back("ml", 1)
    up, down = f"close > ({ph})", f"close < ({pl})"
    stages = (
        {"mh": _ma(mamode, "high", high_length), "ml": _ma(mamode, "low", low_length)},
        {"up": f"coalesce({up}, false)", "down": f"coalesce({down}, false)"},
        {"turn": "case when up then ml when down then mh end", "own": "up or down"},
        {"since": "count(case when own then 1 end) @U"},
        {f"HILO_{a}": "max(turn) over (partition by @K, since)"},
        {f"HILOl_{a}": f"case when down and not up then null else HILO_{a} end", f"HILOs_{a}": f"case when up then null else HILO_{a} end"},
    )
    return Indicator(stages, (f"HILO_{a}", f"HILOl_{a}", f"HILOs_{a}"))


def ichimoku(tenkan=9, kijun=26, senkou=52, include_chikou=True, lookahead=True):
    longest = max(tenkan, kijun, senkou)
    ready = f"count(close) @W({longest}) = {longest}"
    mid = lambda n: f"case when {ready} then 0.5 * (max(high) @W({n}) + min(low) @W({n})) end"
    names = [f"ITS_{tenkan}", f"IKS_{kijun}", f"ISA_{tenkan}", f"ISB_{senkou}"]
    last = {names[2]: f"lag(0.5 * ({names[0]} + {names[1]}), {kijun - 1}) @O", names[3]: f"lag(x1, {kijun - 1}) @O"}
    if include_chikou and lookahead:
        names.append(f"ICS_{kijun}")
        last[names[4]] = f"lead(close, {kijun - 1}) @O"
    return Indicator(({names[0]: mid(tenkan), names[1]: mid(kijun), "x1": mid(senkou)}, last), tuple(names))


def ao(fast=5, slow=34):
    fast, slow = min(fast, slow), max(fast, slow)
    return Indicator(({"x1": "0.5 * (high + low)"}, {f"AO_{fast}_{slow}": f"{avg('x1', fast)} - {avg('x1', slow)}"}), (f"AO_{fast}_{slow}",))


def apo(fast=12, slow=26, mamode="sma"):
    fast, slow = min(fast, slow), max(fast, slow)
    return Indicator(({"x1": _ma(mamode, "close", fast), "x2": _ma(mamode, "close", slow)}, {f"APO_{fast}_{slow}": "x1 - x2"}), (f"APO_{fast}_{slow}",))


def bias(length=26, mamode="sma"):
    name = f"BIAS_{mamode.upper()}_{length}"
    return Indicator(({"x1": _ma(mamode, "close", length)}, {name: ratio("close", "x1") + " - 1"}), (name,))


def bop(scalar=1.0):
    return one("BOP", f"{scalar!r} * {ratio('close - open', 'high - low')}")


def brar(length=26, scalar=100.0, drift=1):
    p = back("close", drift)
    stages = ({"x1": "high - open", "x2": "open - low", "x3": f"case when {p} is not null then greatest(high - ({p}), 0.0) end", "x4": f"case when {p} is not null then greatest(({p}) - low, 0.0) end"}, {f"AR_{length}": f"{scalar!r} * {ratio(total('x1', length), total('x2', length))}", f"BR_{length}": f"{scalar!r} * {ratio(total('x3', length), total('x4', length))}"})
    return Indicator(stages, (f"AR_{length}", f"BR_{length}"))


def _deviation(x: str, n: int) -> str:
    """Mean absolute deviation from the window's mean, over lags of x; ``x`` + 'm' holds the mean."""
    return "(" + " + ".join(f"abs(({back(x, i)}) - {x}m)" for i in range(n)) + f") / {n}.0"


def cci(length=14, c=0.015):
    name = f"CCI_{length}_{c:g}".replace(".", "_")
    return Indicator(({"x": "(high + low + close) / 3.0"}, {"xm": avg("x", length)}, {name: ratio("x - xm", f"{c!r} * {_deviation('x', length)}")}), (name,))


def cfo(length=9, scalar=100.0):
    r = regression("close", length)
    tsf = f"({r['level']} + {length + 1 - (length + 1) / 2!r} * {r['slope']})"
    return one(f"CFO_{length}", f"{scalar!r} * {ratio(f'close - {tsf}', 'close')}")


def cg(length=10):
    return one(f"CG_{length}", ratio(f"-{weighted('close', [float(i + 1) for i in range(length)])}", total("close", length)))


def cmo(length=14, scalar=100.0, drift=1):
    d = f"close - ({back('close', drift)})"
    stages = ({"x1": f"case when {d} is not null then greatest({d}, 0.0) end", "x2": f"case when {d} is not null then greatest(-({d}), 0.0) end"}, {f"CMO_{length}": f"{scalar!r} * {ratio(f'{total('x1', length)} - {total('x2', length)}', f'{total('x1', length)} + {total('x2', length)}')}"})
    return Indicator(stages, (f"CMO_{length}",))


def coppock(fast=11, slow=14, wma_length=10):
    name = f"COPC_{fast}_{slow}_{wma_length}"
    roc_of = lambda n: f"100.0 * {ratio(f'close - {back('close', n)}', back('close', n))}"
    return Indicator(({"x1": f"{roc_of(fast)} + {roc_of(slow)}"}, {name: weighted("x1", linear_weights(wma_length))}), (name,))


def roc(length=10, scalar=100.0):
    return one(f"ROC_{length}", f"{scalar!r} * {ratio(f'close - {back('close', length)}', back('close', length))}")


def stochf(k=14, d=3, mamode="sma"):
    a, b = f"STOCHFk_{k}_{d}", f"STOCHFd_{k}_{d}"
    return Indicator(({a: f"100.0 * {ratio(f'close - {low('low', k)}', f'{high('high', k)} - {low('low', k)}')}"}, {b: _ma(mamode, a, d)}), (a, b))


def entropy(length=10, base=2.0):
    x = lambda i: ratio(back("close", i), "s")
    terms = " + ".join(f"coalesce({x(i)} * ln(nullif(greatest({x(i)}, 0.0), 0)), 0.0)" for i in range(length))
    return Indicator(({"s": total("close", length)}, {f"ENTP_{length}": f"case when s > 0 then -({terms}) / {math.log(base)!r} end"}), (f"ENTP_{length}",))


def _centred(n: int, power: int) -> str:
    return "(" + " + ".join(f"power(({back('close', i)}) - m, {power})" for i in range(n)) + ")"


def skew(length=30):
    name = f"SKEW_{length}"
    f = length / ((length - 1) * (length - 2)) if length > 2 else 0.0
    return Indicator(({"m": avg("close", length)}, {"m2": _centred(length, 2), "m3": _centred(length, 3)}, {name: f"case when m2 > 1e-12 then {f!r} * m3 / power(m2 / {length - 1}.0, 1.5) end" if length > 2 else "cast(null as double)"}), (name,))


def kurtosis(length=30, corrected=False):
    """The excess kurtosis divided by length - 1; ``corrected`` gives the usual sample excess kurtosis."""
    name, n = f"KURT_{length}", length
    value = f"({n * (n + 1)}.0 * m4 - {3 * (n - 1)}.0 * m2 * m2) / ({(n - 2) * (n - 3)}.0 * m2 * m2)" + (f" * {n - 1}.0" if corrected else "")
    value = f"(({n * (n + 1)}.0 * m4 * {n - 1}.0 / (m2 * m2)) - {3 * (n - 1) ** 2}.0) / {(n - 2) * (n - 3)}.0" if corrected else value
    return Indicator(({"m": avg("close", n)}, {"m2": _centred(n, 2), "m4": _centred(n, 4)}, {name: f"case when m2 > 1e-12 then {value} end" if n > 3 else "cast(null as double)"}), (name,))


def mad(length=30):
    name = f"MAD_{length}"
    return Indicator(({"x": "close", "xm": avg("close", length)}, {name: _deviation("x", length)}), (name,))


def median(length=30):
    name = f"MEDIAN_{length}"
    lo, hi = (length - 1) // 2 + 1, length // 2 + 1
    pick = "(element_at(s, {}) + element_at(s, {})) / 2.0"
    return Indicator(({"s": full("close", length, f"array_sort(collect_list(close) @W({length}))")}, {name: pick.format(lo, hi)}), (name,), ({name: full("close", length, f"median(close) @W({length})")},))


def quantile(length=30, q=0.5):
    name, at = f"QTL_{length}_{q:g}".replace(".", "_"), int(round(q * (length - 1))) + 1
    return Indicator(({"s": full("close", length, f"array_sort(collect_list(close) @W({length}))")}, {name: f"element_at(s, {at})"}), (name,), ({name: full("close", length, f"list_extract(list_sort(list(close) @W({length})), {at})")},))


def stdev(length=30, ddof=1):
    return one(f"STDEV_{length}", spread("close", length, ddof))


def stdev_multi(columns=("open", "high", "low", "close"), length=30, ddof=1):
    return Indicator(({f"{c}_stdev": spread(c, length, ddof) for c in columns},), tuple(f"{c}_stdev" for c in columns))


def variance(length=30, ddof=1):
    return one(f"VAR_{length}", f"power({spread('close', length, ddof)}, 2)")


def zscore(length=30, multiplier=1.0, ddof=1):
    return one(f"ZS_{length}", ratio(f"close - {avg('close', length)}", f"{multiplier!r} * {spread('close', length, ddof)}"))


def true_range(drift=1, prenan=False):
    """The first ``drift`` bars have no value, with ``prenan`` or without."""
    return one(f"TRUERANGE_{drift}", _true_range(drift))


def atr_sma(length=14, drift=1):
    return Indicator(({"x1": _true_range(drift)}, {f"ATR_{length}": avg("x1", length)}), (f"ATR_{length}",))


def accbands(length=20, c=4.0, mamode="sma"):
    a, b, d = (f"ACCB{k}_{length}" for k in "UML")
    stages = ({"x0": f"{c!r} * {ratio('high - low', 'high + low')}"}, {"x1": "low * (1 - x0)", "x2": "high * (1 + x0)"}, {a: _ma(mamode, "x2", length), b: _ma(mamode, "close", length), d: _ma(mamode, "x1", length)})
    return Indicator(stages, (a, b, d))


def bbands(length=20, lower_std=2.0, upper_std=2.0, ddof=1, mamode="sma"):
    n = f"{length}_{lower_std:g}_{upper_std:g}"
    l, m, u, b, p = (f"BB{k}_{n}" for k in "LMUBP")  # noqa: E741
    stages = ({m: _ma(mamode, "close", length), "x1": spread("close", length, ddof)}, {l: f"{m} - {lower_std!r} * x1", u: f"{m} + {upper_std!r} * x1"}, {b: f"100.0 * {ratio(f'{u} - {l}', m)}", p: ratio(f"close - {l}", f"{u} - {l}")})
    return Indicator(stages, (l, m, u, b, p))


def cdl_z(length=30, ddof=1):
    names = {c: f"{c}_Z_{length}_{ddof}" for c in ("open", "high", "low", "close")}
    score = lambda c: f"case when {spread(c, length, ddof)} = 0 then 0.0 else {ratio(f'{c} - {avg(c, length)}', spread(c, length, ddof))} end"
    return Indicator(({n: score(c) for c, n in names.items()},), tuple(names.values()))


def cdl_z_full(ddof=1):
    whole = "over (partition by @K)"
    dev = lambda c: f"sqrt(var_pop({c}) {whole} * count({c}) {whole} / nullif(count({c}) {whole} - {ddof}, 0))"
    names = {c: f"{c}_Za" for c in ("open", "high", "low", "close")}
    return Indicator(({f"d_{c}": dev(c) for c in names}, {n: f"case when d_{c} = 0 then 0.0 else ({c} - avg({c}) {whole}) / d_{c} end" for c, n in names.items()}), tuple(names.values()))


def tos_stdevall(length=None, stds=(1, 2, 3), ddof=1):
    """Regression line over all bars, or the last ``length``, and bands of the price's deviation around it."""
    name = "TOS_STDEVALL" + (f"_{length}" if length else "")
    whole = "over (partition by @K)"
    used = f"case when rn > n - {length} then close end" if length else "close"
    stages = (
        {"rn": "row_number() @O", "n": f"count(*) {whole}"},
        {"y": used, "x": "cast(rn as double)"},
        {"xy": "case when y is not null then x end"},
        {"b": f"(avg(xy * y) {whole} - avg(xy) {whole} * avg(y) {whole}) / nullif(avg(xy * xy) {whole} - avg(xy) {whole} * avg(xy) {whole}, 0)", "d": f"sqrt(greatest(var_pop(y) {whole}, 0.0) * count(y) {whole} / nullif(count(y) {whole} - {ddof}, 0))"},
        {f"{name}_LR": f"case when y is not null then avg(y) {whole} + b * (x - avg(xy) {whole}) end"},
        {f"{name}_{s}_{k}": f"{name}_LR {'-' if s == 'L' else '+'} {k} * d" for k in stds for s in "LU"},
    )
    return Indicator(stages, (f"{name}_LR", *(f"{name}_{s}_{k}" for k in stds for s in "LU")))


def doji(length=10, factor=10.0, scalar=100.0, naive=False, asint=True):
    """A body below ``factor`` per cent of the mean range, or with ``naive`` of the bar's own; ``asint`` gives scalar or 0, else a boolean."""
    name = f"CDL_DOJI_{length}_{factor:g}"
    small = f"abs(open - close) < {factor / 100!r} * {'x1' if naive else avg('x1', length)}"
    value = f"cast(case when {small} then {scalar!r} else 0.0 end as double)" if asint else f"coalesce({small}, false)"
    return Indicator(({"x1": "high - low"}, {name: value}), (name,))


INDICATORS = {f.__name__: f for f in (sma, wma, fwma, pwma, sinwma, swma, alma, trima, hma, linreg, midpoint, midprice, vwma, hl2, hlc3, ohlc4, wcp, hilo, ichimoku, ao, apo, bias, bop, brar, cci, cfo, cg, cmo, coppock, roc, stochf, entropy, skew, kurtosis, mad, median, quantile, stdev, stdev_multi, variance, zscore, true_range, atr_sma, accbands, bbands, cdl_z, cdl_z_full, tos_stdevall, doji)}
