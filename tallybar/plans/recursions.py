"""Recursive indicators as SQL can follow them: a seed over a series' first bars, then one step a bar.

In a step x is the new bar, with its number ``rn`` and the close before it ``p``; s is the state before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Recursion:
    """``state``: seed and step of each variable, known from bar ``first`` on; ``extra``: columns of x, over window w."""

    first: int
    state: dict[str, tuple[str, str]]
    outputs: dict[str, str]
    extra: dict[str, str] = field(default_factory=dict)


def _moved(n: float, state: str = "s.v", value: str = "x.close") -> str:
    """A state moved by 1/n towards a value."""
    return f"({state} + ({value} - {state}) / {n})"


def _begun(last: int, count: int, n: float, state: str, value: str) -> str:
    """A state that first gathers a mean, over the ``count`` bars up to ``last``, then moves by 1/n."""
    return f"(case when x.rn <= {last - count} then 0.0 when x.rn <= {last} then {state} + {value} / {count} else {_moved(n, state, value)} end)"


def _mean(n: int, move: float, output: str) -> Recursion:
    return Recursion(n, {"v": ("avg(close)", _moved(move))}, {output: "v"})


def _true_range(x: str = "") -> str:
    return f"greatest({x}high - {x}low, abs({x}high - {x}p), abs({x}low - {x}p))"


def _range(n: int) -> tuple[str, str]:
    """Seed at bar n + 1, and step, of the average true range."""
    return f"avg(case when rn > 1 then {_true_range()} end)", _moved(n, "s.v", _true_range("x."))


def _chain(n: int) -> tuple[dict[str, tuple[str, str]], int, int]:
    """Three averages of each other, and where the second and third begin."""
    half, second, third = (n + 1) / 2, 2 * n - 1, 3 * n - 2
    a = _moved(half, "s.a")
    b = _begun(second, n, half, "s.b", a)
    c = _begun(third, n, half, "s.c", b)
    return {"a": ("avg(close)", a), "b": (f"avg(close) / {n}", b), "c": ("0.0", c)}, second, third


def _double(n: int, output: str) -> Recursion:
    state, second, _ = _chain(n)
    return Recursion(n, {v: state[v] for v in "ab"}, {output: f"case when x.rn >= {second} then 2 * a - b end"})


def _triple(n: int, output: str) -> Recursion:
    state, _, third = _chain(n)
    return Recursion(n, state, {output: f"case when x.rn >= {third} then 3 * a - 3 * b + c end"})


def _macd() -> Recursion:
    fast, slow = _moved(6.5, "s.f"), _moved(13.5, "s.w")
    seed = "sum(case when rn <= 12 then power(11.0 / 13, 14) * close / 12 else 2.0 / 13 * power(11.0 / 13, 26 - rn) * close end)"
    state = {"f": (seed, fast), "w": ("avg(close)", slow), "g": (f"({seed} - avg(close)) / 9", _begun(34, 9, 5, "s.g", f"({fast} - {slow})"))}
    return Recursion(26, state, {"MACD_12_26_9": "f - w", "MACDs_12_26_9": "case when x.rn >= 34 then g end", "MACDh_12_26_9": "case when x.rn >= 34 then f - w - g end"})


def _kama(output: str) -> Recursion:
    rate = f"power(x.share * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)"
    share = "coalesce(abs(close - lag(close, 10) over w) / nullif(sum(abs(close - p)) over (partition by sym order by ts rows 9 preceding), 0), 0)"
    return Recursion(10, {"v": ("avg(close)", f"s.v + {rate} * (x.close - s.v)")}, {output: "v"}, {"share": share})


def _vidya(n: int, output: str) -> Recursion:
    over = f"over (partition by sym order by ts rows {n - 1} preceding)"
    share = f"case when rn > {n} then coalesce(abs(sum(close - p) {over}) / nullif(sum(abs(close - p)) {over}, 0), 0) else 0 end"
    return Recursion(1, {"v": ("avg(close)", f"s.v + x.share * {2 / (n + 1)!r} * (x.close - s.v)")}, {output: "v"}, {"share": share})


def _hwma() -> Recursion:
    level = "(0.8 * (s.l + s.v + 0.5 * s.a) + 0.2 * x.close)"
    speed = f"(0.9 * (s.v + s.a) + 0.1 * ({level} - s.l))"
    return Recursion(1, {"l": ("avg(close)", level), "v": ("0.0", speed), "a": ("0.0", f"0.9 * s.a + 0.1 * ({speed} - s.v)")}, {"HWMA_0_2_0_1_0_1": "l + v + 0.5 * a"})


def _filter(inputs: int, feedback: list[float], output: str) -> Recursion:
    """A linear filter whose first outputs are its inputs; ``inputs`` is 1 or 2."""
    names = "abc"[: len(feedback)]
    new = f"{1 - sum(feedback)!r} * {'0.5 * (x.close + x.p)' if inputs == 2 else 'x.close'} + " + " + ".join(f"({f!r}) * s.{v}" for f, v in zip(feedback, names, strict=True))
    steps = [new, *(f"s.{v}" for v in names[:-1])]
    state = {v: (f"max(case when rn = {len(names) - i} then close end)", steps[i]) for i, v in enumerate(names)}
    return Recursion(len(names), state, {output: "coalesce(a, close)"})


def _smooth(n: int, output: str, everget: bool = False) -> Recursion:
    decay = math.exp(-3.14159 * 1.414 / n)
    turn = 2 * decay * math.cos((3.14159 if everget else 180) * 1.414 / n)
    return _filter(2, [turn, -decay * decay], output)


def _smooth3(n: int, output: str) -> Recursion:
    decay = math.exp(-3.14159 / n)
    turn, square = 2 * decay * math.cos(3.14159 * 1.732 / n), decay**2
    return _filter(1, [turn + square, -square - square * turn, square * square], output)


def _supertrend() -> Recursion:
    seed, unit = _range(7)
    middle = "max(case when rn = 8 then (high + low) / 2 end)"
    way = "(case when x.close > s.u then 1 when x.close < s.l then -1 else s.d end)"
    low, high = (f"((x.high + x.low) / 2 {sign} 3 * {unit})" for sign in "-+")
    state = {
        "v": (seed, unit),
        "l": (f"{middle} - 3 * {seed}", f"case when {way} > 0 then greatest({low}, s.l) else {low} end"),
        "u": (f"{middle} + 3 * {seed}", f"case when {way} < 0 then least({high}, s.u) else {high} end"),
        "d": ("1.0", way),
    }
    long, short = "case when x.rn > 8 and d > 0 then l end", "case when x.rn > 8 and d < 0 then u end"
    return Recursion(8, state, {"SUPERT_7_3": f"coalesce({long}, {short})", "SUPERTd_7_3": "case when x.rn > 8 then d end", "SUPERTl_7_3": long, "SUPERTs_7_3": short})


def _kagi(reversal: float) -> Recursion:
    starts = f"s.d = 0 and abs(x.close - s.e) >= {reversal}"
    turns = f"s.d <> 0 and (s.e - x.close) * s.d >= {reversal}"
    way = f"case when {starts} then sign(x.close - s.e) when {turns} then -s.d else s.d end"
    extreme = f"case when {starts} or {turns} or (x.close - s.e) * s.d > 0 then x.close else s.e end"
    return Recursion(1, {"d": ("0.0", way), "e": ("avg(close)", extreme)}, {"KAGI": "d"})


def _adx() -> Recursion:
    up, down = "({0}high - {0}ph)", "({0}pl - {0}low)"

    def moves(x, a, b):
        a, b = a.format(x), b.format(x)
        return f"(case when {a} > {b} and {a} > 0 then {a} else 0 end)"

    state = {"v": _range(14)}
    for name, a, b in (("u", up, down), ("d", down, up)):
        state[name] = (f"avg(case when rn > 1 then {moves('', a, b)} end)", _moved(14, f"s.{name}", moves("x.", a, b)))

    def index(u, d):
        return f"coalesce(100 * abs({u} - {d}) / nullif({u} + {d}, 0), 0)"

    (seed_u, step_u), (seed_d, step_d) = state["u"], state["d"]
    state["g"] = (f"{index(seed_u, seed_d)} / 14", _begun(28, 14, 14, "s.g", index(step_u, step_d)))
    line = "case when x.rn >= 28 then g end"
    outputs = {"ADX_14": line, "ADXR_14_2": f"0.5 * (({line}) + lag({line}, 2) over w)", "DMP_14": "100 * u / nullif(v, 0)", "DMN_14": "100 * d / nullif(v, 0)"}
    return Recursion(15, state, outputs, {"ph": "lag(high) over w", "pl": "lag(low) over w"})


def _rwi() -> Recursion:
    unit = f"nullif(v * {math.sqrt(14)!r}, 0)"
    return Recursion(15, {"v": _range(14)}, {"RWI_HIGH_14": f"(high - low14) / {unit}", "RWI_LOW_14": f"(high14 - low) / {unit}"}, {"low14": "lag(low, 14) over w", "high14": "lag(high, 14) over w"})


def _alligator() -> Recursion:
    state = {v: (f"avg(close) / {n}", _begun(n, n, n, f"s.{v}", "x.close")) for v, n in (("j", 13), ("t", 8), ("l", 5))}
    return Recursion(1, state, {f"AG{v}_13_8_5": f"case when x.rn >= {n} then {v} end" for v, n in (("j", 13), ("t", 8), ("l", 5))})


def _heikin_ashi() -> Recursion:
    state = {"o": ("avg(0.5 * (open + close))", "0.5 * (s.o + s.c)"), "c": ("avg(0.25 * (open + high + low + close))", "0.25 * (x.open + x.high + x.low + x.close)")}
    return Recursion(1, state, {"HA_open": "o", "HA_high": "greatest(high, o, c)", "HA_low": "least(low, o, c)", "HA_close": "c"})


def _rsi() -> Recursion:
    def change(a, b):
        return f"sum(case when rn > 1 then greatest({a} - {b}, 0) else 0 end) / 14"

    state = {"g": (change("close", "p"), "(13 * s.g + greatest(x.close - x.p, 0)) / 14"), "l": (change("p", "close"), "(13 * s.l + greatest(x.p - x.close, 0)) / 14")}
    return Recursion(14, state, {"RSI_14": "100 * g / nullif(g + l, 0)"})


def _range_stop() -> Recursion:
    unit, mean = _begun(15, 14, 14, "s.v", _true_range("x.")), _begun(20, 20, 10.5, "s.m", "x.close")
    stop = f"case when x.rn < 21 then null when x.close > {mean} then greatest(x.close - 3 * {unit}, s.o) else least(x.close + 3 * {unit}, s.o) end"
    return Recursion(1, {"v": ("0.0", unit), "m": ("avg(close) / 20", mean), "o": ("null", stop)}, {"ATRTS_14_20_3": "o"})


def _aberration() -> Recursion:
    middle = {"mid": "case when rn >= 5 then avg((high + low + close) / 3) over (partition by sym order by ts rows 4 preceding) end"}
    outputs = {"ABER_ZG_5_15": "mid", "ABER_SG_5_15": "mid + v", "ABER_XG_5_15": "mid - v", "ABER_ATR_5_15": "v"}
    return Recursion(16, {"v": _range(15)}, outputs, middle)


def _tracker(n: int, kind: str) -> Recursion:
    """The trend tracker over an average: of fixed weights (oldest bar first), or one that is a recursion itself."""
    weights = {"SMA": [0.2] * 5, "WMA": [i / 15 for i in range(1, 6)], "TMA": [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9], "TSF": [0.2 + 0.3 * i for i in range(-2, 3)]}
    extra = {}
    if kind in weights:
        first, step = 5, "x.mean"
        extra["mean"] = " + ".join(f"({w!r}) * {f'lag(close, {4 - i}) over w' if i < 4 else 'close'}" for i, w in enumerate(weights[kind]))
        seed = "max(case when rn = 5 then mean end)"
    elif kind == "VAR":
        plain = _vidya(9, "")
        extra, first = plain.extra, 1
        seed, step = "avg(close)", f"(s.m + x.share * {2 / (n + 1)!r} * (x.close - s.m))"
    elif kind == "ZLEMA":
        extra["ahead"] = f"2 * close - lag(close, {n // 2}) over w"
        first, seed, step = n + n // 2, "avg(ahead)", _moved((n + 1) / 2, "s.m", "x.ahead")
    else:
        first = 1 if kind == "WWMA" else n
        seed, step = "avg(close)", _moved(n if kind == "WWMA" else (n + 1) / 2, "s.m")
    state = {
        "m": (seed, step),
        "l": (f"0.986 * {seed}", f"greatest(s.l, 0.986 * {step})"),
        "u": (f"1.014 * {seed}", f"least(s.u, 1.014 * {step})"),
        "d": ("1.0", f"case when s.d < 0 and {step} > s.u then 1 when s.d > 0 and {step} < s.l then -1 else s.d end"),
    }
    stop, tail = "(case when d > 0 then l else u end)", f"{n}_1_4_{kind}"
    line = f"case when m > {stop} then {stop} * 1.007 else {stop} * 0.993 end"
    return Recursion(first, state, {f"OTT_MA_{tail}": "m", f"OTT_LONG_STOP_{tail}": "l", f"OTT_SHORT_STOP_{tail}": "u", f"OTT_DIRECTION_{tail}": "coalesce(d, 1)", f"OTT_{tail}": line}, extra)


def _exponentials(n: int, depth: int, value: str = "x.close") -> list[str]:
    """Steps of an average, of its average, and so on: states e1, e2, ... from bar 1 on."""
    steps = [value]
    for k in range(1, depth + 1):
        steps.append(_begun(k * (n - 1) + 1, n, (n + 1) / 2, f"s.e{k}", steps[-1]))
    return steps[1:]


def _t3(n: int, output: str) -> Recursion:
    steps = _exponentials(n, 6)
    state = {f"e{k}": (f"avg(close) / {n}" if k == 1 else "0.0", step) for k, step in enumerate(steps, 1)}
    weights = (-0.7**3, 3 * 0.7**2 + 3 * 0.7**3, -6 * 0.7**2 - 3 * 0.7 - 3 * 0.7**3, 1 + 3 * 0.7 + 0.7**3 + 3 * 0.7**2)
    mix = " + ".join(f"({w!r}) * e{k}" for w, k in zip(weights, (6, 5, 4, 3), strict=True))
    return Recursion(1, state, {output: f"case when x.rn >= {6 * n - 5} then {mix} end"})


def _macd_after_signal() -> Recursion:
    state = dict(_macd().state)
    (_, fast), (_, slow), (_, trigger) = (state[v] for v in "fwg")
    state["h"] = ("0.0", _begun(42, 9, 5, "s.h", f"(({fast} - {slow}) - {trigger})"))
    outputs = {"MACDAS_12_26_9": "case when x.rn >= 34 then f - w - g end", "MACDASs_12_26_9": "case when x.rn >= 42 then h end", "MACDASh_12_26_9": "case when x.rn >= 42 then f - w - g - h end"}
    return Recursion(26, state, outputs)


def _clouds() -> Recursion:
    gain, loss = (f"((13 * s.{v} + greatest({a} - {b}, 0)) / 14)" for v, a, b in (("g", "x.q", "x.pq"), ("l", "x.pq", "x.q")))
    index, seed = f"(100 * {gain} / nullif({gain} + {loss}, 0))", "(100 * sum(greatest(q - pq, 0)) / nullif(sum(abs(q - pq)), 0))"
    fast, slow = _begun(25, 12, 6.5, "s.f", index), _begun(39, 26, 13.5, "s.w", index)
    state = {
        "g": ("sum(coalesce(greatest(q - pq, 0), 0)) / 14", gain),
        "l": ("sum(coalesce(greatest(pq - q, 0), 0)) / 14", loss),
        "f": (f"{seed} / 12", fast),
        "w": (f"{seed} / 26", slow),
        "t": ("0.0", _begun(47, 9, 5, "s.t", f"({fast} - {slow})")),
    }
    outputs = {"RSI": "100 * g / nullif(g + l, 0)", "MACD": "case when x.rn >= 39 then f - w end", "SIGNAL": "case when x.rn >= 47 then t end", "HIST": "case when x.rn >= 47 then f - w - t end"}
    extra = {"q": "(open + high + low + close) / 4", "pq": "(lag(open) over w + lag(high) over w + lag(low) over w + lag(close) over w) / 4"}
    return Recursion(14, state, {f"RSI_CLOUDS_{k}_14": v for k, v in outputs.items()}, extra)


def _cycle() -> Recursion:
    """The scaled index of the last bars stands in a, b, c, d, newest first."""
    over = "over (partition by sym order by ts rows 9 preceding)"
    up, down = (f"sum(coalesce(greatest({x}, 0), 0)) {over}" for x in ("close - p", "p - close"))
    scaled = f"case when rn >= 10 then coalesce(200 * {up} / nullif({up} + {down}, 0), 100) - 100 end"
    at = lambda k: f"max(case when rn = {14 - k} then sc end)"
    state = {"a": (at(0), "x.sc"), "b": (at(1), "s.a"), "c": (at(2), "s.b"), "d": (at(3), "s.c"), "v": (f"2.0 / 11 * (2 * {at(0)} - {at(4)})", "2.0 / 11 * (2 * x.sc - s.d) + 9.0 / 11 * s.v")}
    bound = lambda q, none: f"case when count(v) over (partition by x.sym) >= 40 then quantile_cont(case when x.rn < 54 then v end, {q}) over (partition by x.sym) else {none} end"
    names = {"scaled": "sc", "crsi": "v", "lb": bound(0.1, -100.0), "ub": bound(0.9, 100.0)}
    return Recursion(14, state, {f"SCRSI_{k}_20_10": v for k, v in names.items()}, {"sc": scaled})


def _streaks() -> Recursion:
    way = "sign(x.close - x.p)"
    streak = f"(case when {way} = 0 then 0 else {way} + case when s.k * {way} > 0 then s.k else 0 end end)"
    state = {
        "k": ("0.0", streak),
        "g": ("0.0", _begun(3, 3, 3, "s.g", "greatest(x.close - x.p, 0)")),
        "l": ("0.0", _begun(3, 3, 3, "s.l", "greatest(x.p - x.close, 0)")),
        "a": ("0.0", _begun(2, 2, 2, "s.a", f"greatest({streak} - s.k, 0)")),
        "b": ("0.0", _begun(2, 2, 2, "s.b", f"greatest(s.k - {streak}, 0)")),
    }
    rank = "case when rn >= 100 then len(list_filter(list(close) over (partition by sym order by ts rows 99 preceding), lambda v: v < close)) / 0.99 end"
    return Recursion(1, state, {"CRSI_3_2_100": "(100 * g / nullif(g + l, 0) + 100 * a / nullif(a + b, 0) + rank) / 3"}, {"rank": rank})


def _point_and_figure() -> Recursion:
    move, box = "(x.close - s.e)", "floor(x.close / 2) * 2"
    starts, goes, turns = f"(s.k = 0 and abs({move}) >= 2)", f"(s.k <> 0 and {move} * s.k >= 2)", f"(s.k <> 0 and -{move} * s.k >= 6)"
    kind = f"case when {starts} then sign({move}) when {turns} then -s.k else s.k end"
    return Recursion(1, {"k": ("0.0", kind), "e": ("avg(close)", f"case when {starts} or {goes} or {turns} then {box} else s.e end")}, {"PF_TREND": "k"})


def _bricks() -> Recursion:
    laid = "trunc((x.close - s.a) / 2)"
    return Recursion(1, {"a": ("avg(close)", f"s.a + 2 * {laid}"), "o": ("0.0", f"sign({laid})")}, {"RENKO": "o"})


def _hilo_exponential() -> Recursion:
    over, under = _begun(13, 13, 7, "s.m", "x.high"), _begun(21, 21, 11, "s.k", "x.low")
    up, down = "(x.rn > 13 and x.close > s.m)", "(x.rn > 21 and x.close < s.k)"
    line = f"case when {up} then (case when x.rn >= 21 then {under} end) when {down} then {over} else s.h end"
    state = {"m": ("avg(high) / 13", over), "k": ("avg(low) / 21", under), "u": ("0.0", f"case when {up} then 1 else 0 end"), "d": ("0.0", f"case when {down} then 1 else 0 end"), "h": ("null", line)}
    return Recursion(1, state, {"HILO_13_21": "h", "HILOl_13_21": "case when d = 0 or u = 1 then h end", "HILOs_13_21": "case when u = 0 then h end"})


def _hilo() -> Recursion:
    mean = lambda c, n, rows: f"case when rn >= {n} then avg({c}) over (partition by sym order by ts {rows}) end"
    extra = {"m": mean("high", 13, "rows 12 preceding"), "k": mean("low", 21, "rows 20 preceding"), "pm": mean("high", 14, "rows between 13 preceding and 1 preceding"), "pk": mean("low", 22, "rows between 21 preceding and 1 preceding")}
    up, down = "coalesce(x.close > x.pm, false)", "coalesce(x.close < x.pk, false)"
    state = {"u": ("0.0", f"case when {up} then 1 else 0 end"), "d": ("0.0", f"case when {down} then 1 else 0 end"), "h": ("null", f"case when {up} then x.k when {down} then x.m else s.h end")}
    return Recursion(1, state, {"HILO_13_21": "h", "HILOl_13_21": "case when d = 0 or u = 1 then h end", "HILOs_13_21": "case when u = 0 then h end"}, extra)


def _bands_exponential() -> Recursion:
    outputs = {"L": "v - 2 * d", "M": "v", "U": "v + 2 * d", "B": "400 * d / v", "P": "(close - v + 2 * d) / nullif(4 * d, 0)"}
    return Recursion(20, {"v": ("avg(close)", _moved(10.5))}, {f"BB{k}_20_2_2": v for k, v in outputs.items()}, {"d": "stddev_samp(close) over (partition by sym order by ts rows 19 preceding)"})


def _acceleration_exponential() -> Recursion:
    wide = "4 * (high - low) / (high + low)"
    state = {v: (f"avg({c})", _moved(10.5, f"s.{v}", f"x.{c}")) for v, c in (("u", "hi"), ("m", "close"), ("l", "lo"))}
    return Recursion(20, state, {"ACCBU_20": "u", "ACCBM_20": "m", "ACCBL_20": "l"}, {"hi": f"high * (1 + {wide})", "lo": f"low * (1 - {wide})"})


def _hull_exponential() -> Recursion:
    short, long = _begun(5, 5, 3, "s.a", "x.close"), _begun(10, 10, 5.5, "s.b", "x.close")
    state = {"a": ("avg(close) / 5", short), "b": ("avg(close) / 10", long), "c": ("0.0", _begun(12, 3, 2, "s.c", f"(2 * {short} - {long})"))}
    return Recursion(1, state, {"HMA_10": "case when x.rn >= 12 then c end"})


def _stochastic_exponential() -> Recursion:
    over = "over (partition by sym order by ts rows 13 preceding)"
    raw = f"case when rn >= 14 then 100 * (close - min(low) {over}) / nullif(max(high) {over} - min(low) {over}, 0) end"
    return Recursion(16, {"v": ("avg(k)", _moved(2, "s.v", "x.k"))}, {"STOCHFk_14_3": "k", "STOCHFd_14_3": "v"}, {"k": raw})


def _strategy() -> Recursion:
    """An index of 14 bars and the average of 10 highs, beside the mean of 10 closes."""
    state = {"e": ("avg(high) / 10", _begun(10, 10, 5.5, "s.e", "x.high"))}
    state |= {v: ("0.0", _begun(14, 14, 14, f"s.{v}", f"greatest({a} - {b}, 0)")) for v, a, b in (("g", "x.close", "x.p"), ("l", "x.p", "x.close"))}
    index, top = "(case when x.rn >= 14 then 100 * g / nullif(g + l, 0) end)", "(case when x.rn >= 10 then e end)"
    outputs = {"entry_long": f"coalesce({index} < 45 and close > mean, false)", "exit_long": f"coalesce(({index} > 55 or close > {top}) and not close < mean, false)"}
    return Recursion(1, state, outputs, {"mean": "case when rn >= 10 then avg(close) over (partition by sym order by ts rows 9 preceding) end"})


RECURSIONS: dict[str, Recursion] = {
    "ema": _mean(10, 5.5, "EMA_10"),
    "rma": _mean(10, 10, "RMA_10"),
    "smma": _mean(10, 10, "SMMA_10"),
    "ma_ema": _mean(10, 5.5, "MA_ema"),
    "ma_rma": _mean(10, 10, "MA_rma"),
    "dema": _double(10, "DEMA_10"),
    "ma_dema": _double(10, "MA_dema"),
    "tema": _triple(10, "TEMA_10"),
    "ma_tema": _triple(10, "MA_tema"),
    "kama": _kama("KAMA_10_2_30"),
    "ma_kama": _kama("MA_kama"),
    "vidya": _vidya(14, "VIDYA_14"),
    "ma_vidya": _vidya(10, "MA_vidya"),
    "hwma": _hwma(),
    "ssf": _smooth(20, "SSF_20"),
    "ssf_everget": _smooth(20, "SSFe_20", True),
    "ma_ssf": _smooth(10, "MA_ssf"),
    "ssf3": _smooth3(20, "SSF3_20"),
    "alligator": _alligator(),
    "ha": _heikin_ashi(),
    "rsi": _rsi(),
    "atr": Recursion(15, {"v": _range(14)}, {"ATR_14": "v"}),
    "atr_percent": Recursion(15, {"v": _range(14)}, {"ATR_14": "100 * v / close"}),
    "macd": _macd(),
    "adx": _adx(),
    "rwi": _rwi(),
    "supertrend": _supertrend(),
    "kagi": _kagi(5.0),
    "zlma": Recursion(14, {"v": ("avg(ahead)", _moved(5.5, value="x.ahead"))}, {"ZL_EMA_10": "v"}, {"ahead": "2 * close - lag(close, 4) over w"}),
    "aberration": _aberration(),
    "atrts": _range_stop(),
    "ott": _tracker(2, "VAR"),
    **{f"ott_{kind.lower()}": _tracker(5, kind) for kind in ("SMA", "EMA", "WMA", "TMA", "WWMA", "ZLEMA", "TSF")},
    "t3": _t3(10, "T3_10_0_7"),
    "ma_t3": _t3(10, "MA_t3"),
    "macd_as": _macd_after_signal(),
    "rsi_clouds": _clouds(),
    "scrsi": _cycle(),
    "crsi": _streaks(),
    "pf_trend": _point_and_figure(),
    "renko": _bricks(),
    "hilo": _hilo(),
    "hilo_ema": _hilo_exponential(),
    "bbands_ema": _bands_exponential(),
    "accbands_ema": _acceleration_exponential(),
    "hma_ema": _hull_exponential(),
    "stochf_ema": _stochastic_exponential(),
    "bias_ema": Recursion(26, {"v": ("avg(close)", _moved(13.5))}, {"BIAS_EMA_26": "close / v - 1"}),
    "apo_ema": Recursion(26, {v: _macd().state[v] for v in "fw"}, {"APO_12_26": "f - w"}),
    "strategy_text": _strategy(),
}
