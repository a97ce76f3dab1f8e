"""Candlestick patterns as SQL conditions over the current and earlier bars.

``o0 h0 l0 c0`` are the current bar's prices, ``o1 ...`` those of the bar before, and so on; ``b`` is a bar's
body, ``r`` its range, ``u`` and ``d`` its upper and lower shadow. A pattern's value is that of the first
condition that holds, else 0.0; a bar with too few predecessors gets 0.0. The thresholds are fixed values, but for
``@B`` and ``@S``, the factors of smallest body and largest shadow, whose defaults stand in ``FACTORS`` or with the
pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

BARS = 5


@dataclass(frozen=True)
class Pattern:
    """bars in use, (value, condition) cases, and (body, shadow) factors for the strict form over those bars."""

    bars: int
    cases: tuple[tuple[float, str], ...]
    strict: tuple[float, float] | None = None
    mirror: tuple[float, str] | None = None
    ahead: int = 0


def white(*bars: int) -> str:
    return " and ".join(f"c{k} > o{k}" for k in bars)


def black(*bars: int) -> str:
    return " and ".join(f"c{k} < o{k}" for k in bars)


def rising(*names: str) -> str:
    """Names in rising order."""
    return " and ".join(f"{a} < {b}" for a, b in zip(names, names[1:], strict=False))


def ranged(n: int) -> str:
    return " and ".join(f"r{k} > 0" for k in range(n))


def mask(bars: int, *parts: str) -> Pattern:
    return Pattern(bars, ((1.0, " and ".join(f"({p})" for p in parts)),))


def signed(bars: int, up: str | None, down: str | None, strict=None, mirror=None, ahead=0) -> Pattern:
    cases = tuple((v, c) for v, c in ((1.0, up), (-1.0, down)) if c)
    return Pattern(bars, cases, strict, mirror, ahead)


def _hammer_shape() -> str:
    # the lower shadow is measured from the upper edge of the body
    return "r0 > 0 and b0 > 0 and greatest(o0, c0) - l0 >= 2 * b0 and u0 <= b0"


def _kicking() -> str:
    return f"{ranged(2)} and u1 <= 0.1 * r1 and d1 <= 0.1 * r1 and u0 <= 0.1 * r0 and d0 <= 0.1 * r0 and (({white(1)} and {black(0)}) or ({black(1)} and {white(0)})) and (least(o0, c0) > greatest(o1, c1) or greatest(o0, c0) < least(o1, c1))"


def _evening() -> str:
    return f"{ranged(3)} and {white(2)} and b1 <= @B * r1 and l1 > h2 and {black(0)} and c0 <= o2 + 0.5 * b2"


def _hikkake(price_low: str, price_high: str, share: float) -> Pattern:
    broke_up, broke_down = "h0 > h1 and l0 >= l1", "l0 < l1 and h0 <= h1"
    inside = "h1 < h2 and l1 > l2"
    turned_down, turned_up = f"low_{price_low} < l1", f"high_{price_high} > h1"
    return signed(3, f"{inside} and {broke_down} and not ({broke_up}) and {turned_up}", f"{inside} and {broke_up} and {turned_down}", None, None, 3)


_SIDE = "abs(o0 - o1) <= 0.25 * (r1 + r0) and abs(c0 - c1) <= 0.25 * (r1 + r0)"
_SMALL4 = " and ".join(f"r{k} > 0 and b{k} <= 0.4 * r4 and h{k} <= c4 and l{k} >= o4" for k in (3, 2, 1))
_SMALL_B4 = " and ".join(f"r{k} > 0 and b{k} <= 0.4 * b4 and h{k} <= h4 and l{k} >= l4" for k in (3, 2, 1))

PATTERNS: dict[str, Pattern] = {
    "invertedhammer": mask(1, "r0 > 0", "b0 > 0", "u0 >= 2 * b0", "greatest(o0, c0) - l0 <= 0.25 * b0", "b0 <= 0.4 * r0"),
    "2crows": mask(3, white(2), black(1), "o1 > c2", "c1 > o2", "c1 < c2", black(0), "o0 > c1", "c0 < c1"),
    "3blackcrows": mask(3, black(2, 1, 0), "o1 < o2 and o1 > c2", "o0 < o1 and o0 > c1", rising("c0", "c1", "c2")),
    "3inside": signed(3, f"{black(2)} and {white(1)} and o1 < o2 and c1 > c2 and {white(0)} and c0 > c1", f"{white(2)} and {black(1)} and o1 > c2 and c1 < o2 and {black(0)} and c0 < c1"),
    "3linestrike": signed(4, f"{white(3, 2, 1)} and {rising('c3', 'c2', 'c1')} and {black(0)} and o0 > c1 and c0 < c3", f"{black(3, 2, 1)} and {rising('c1', 'c2', 'c3')} and {white(0)} and o0 < c1 and c0 > c3", (0.0, 1.0)),
    "3outside": signed(3, f"{black(2)} and {white(1)} and o1 <= c2 and c1 >= o2 and {white(0)} and c0 > c1", f"{white(2)} and {black(1)} and o1 >= c2 and c1 <= o2 and {black(0)} and c0 < c1", (0.0, 1.0)),
    "3starsinsouth": signed(3, f"{black(2, 1, 0)} and {rising('l0', 'l1', 'l2')} and c0 > c1", None, (0.0, 1.0), (-1.0, f"{white(2, 1, 0)} and {rising('h2', 'h1', 'h0')} and c0 < c1")),
    "3whitesoldiers": signed(3, f"{white(2, 1, 0)} and {rising('c2', 'c1', 'c0')} and {rising('o2', 'o1', 'o0')}", None, (0.0, 1.0), (-1.0, f"{black(2, 1, 0)} and {rising('c0', 'c1', 'c2')} and {rising('o0', 'o1', 'o2')}")),
    "abandonedbaby": signed(3, f"{black(2)} and b1 <= r1 * 0.1 and l1 > h2 and o0 > h1 and {white(0)}", f"{white(2)} and b1 <= r1 * 0.1 and h1 < l2 and o0 < l1 and {black(0)}", (0.0, 1.0)),
    "advanceblock": signed(3, None, f"{white(2, 1, 0)} and {rising('c2', 'c1', 'c0')} and {rising('o2', 'o1', 'o0')} and {rising('b0', 'b1', 'b2')}", (0.0, 1.0), (1.0, f"{black(2, 1, 0)} and {rising('c0', 'c1', 'c2')} and {rising('o0', 'o1', 'o2')} and {rising('b0', 'b1', 'b2')}")),
    "belthold": signed(1, f"{white(0)} and o0 = l0 and b0 > r0 * 0.5", f"{black(0)} and o0 = h0 and b0 > r0 * 0.5", (0.0, 1.0)),
    "breakaway": signed(5, f"{black(4, 3, 2, 1)} and o3 < l4 and {white(0)} and c0 > c1 and c0 > c4", f"{white(4, 3, 2, 1)} and o3 > h4 and {black(0)} and c0 < c1 and c0 < c4", (0.0, 1.0)),
    "closingmarubozu": signed(1, f"r0 > 0 and {white(0)} and c0 = h0", f"r0 > 0 and {black(0)} and c0 = l0", (0.5, 0.2)),
    "concealbabyswall": Pattern(4, ((1.0, f"{ranged(4)} and {black(3, 2, 1, 0)} and c3 = h3 and c2 = h2 and o1 < o2 and o1 > c2 and c1 < c2 and o0 < o1 and o0 > c1 and c0 < c1"),), (0.5, 0.3)),
    "counterattack": signed(2, f"{ranged(2)} and {black(1)} and {white(0)} and o0 < l1 and c0 > c1 and abs(c0 - c1) <= 0.25 * (r0 + r1)", f"{ranged(2)} and {white(1)} and {black(0)} and o0 > h1 and c0 < c1 and abs(c0 - c1) <= 0.25 * (r0 + r1)", (0.3, 0.5)),
    "darkcloudcover": signed(2, None, f"{ranged(2)} and {white(1)} and {black(0)} and o0 > h1 and c0 < c1 and c0 > o1 and c0 < o1 + 0.5 * b1", (0.5, 0.5)),
    "dojistar": signed(2, f"{ranged(2)} and b0 <= @B * r0 and h0 < l1", f"{ranged(2)} and b0 <= @B * r0 and l0 > h1"),
    "dragonflydoji": mask(1, "r0 > 0", "b0 <= @B * r0", "o0 = h0", "c0 = h0"),
    "engulfing": signed(2, f"{ranged(2)} and {black(1)} and {white(0)} and o0 <= c1 and c0 >= o1", f"{ranged(2)} and {white(1)} and {black(0)} and o0 >= c1 and c0 <= o1", (0.3, 0.5)),
    "eveningdojistar": signed(3, None, _evening()),
    "eveningstar": signed(3, None, _evening()),
    "gapsidesidewhite": signed(3, f"{ranged(3)} and {white(2, 1, 0)} and l1 > h2 and {_SIDE}", f"{ranged(3)} and {black(2)} and {white(1, 0)} and h1 < l2 and {_SIDE}", (0.3, 0.5)),
    "gravestonedoji": signed(1, None, "r0 > 0 and b0 <= @B * r0 and o0 = l0 and c0 = l0"),
    "hammer": Pattern(1, ((1.0, _hammer_shape()),)),
    "hangingman": Pattern(1, ((-1.0, _hammer_shape()),)),
    "harami": signed(2, f"{ranged(2)} and {black(1)} and {white(0)} and o0 >= c1 and c0 <= o1", f"{ranged(2)} and {white(1)} and {black(0)} and o0 <= c1 and c0 >= o1"),
    "haramicross": signed(2, f"{ranged(2)} and {black(1)} and b0 <= @B * r0 and o0 >= c1 and c0 <= o1", f"{ranged(2)} and {white(1)} and b0 <= @B * r0 and o0 <= c1 and c0 >= o1"),
    # the lower shadow is measured from the upper edge of the body
    "highwave": mask(1, "r0 > 0", "b0 <= @B * r0", "u0 >= @S * r0", "greatest(o0, c0) - l0 >= @S * r0"),
    "hikkake": _hikkake("low", "high", 0.2),
    "hikkakemod": _hikkake("close", "close", 0.25),
    "homingpigeon": mask(2, black(1, 0), "o0 <= o1", "c0 >= c1"),
    "identical3crows": mask(3, black(2, 1, 0), rising("c0", "c1", "c2"), ranged(3), *(f"c{k} - l{k} <= 0.25 * r{k}" for k in (2, 1, 0)), "abs(o1 - c2) <= 0.25 * r1", "abs(o0 - c1) <= 0.25 * r0"),
    "inneck": mask(2, black(1), "r1 > 0", white(0), "o0 < l1", "c0 > c1 and c0 <= o1", "c0 - c1 <= 0.25 * r1"),
    "inside": mask(2, "h0 < h1", "l0 > l1"),
    "kicking": mask(2, _kicking()),
    "kickingbylength": mask(2, _kicking(), "b0 > b1"),
    "ladderbottom": mask(5, black(4, 3, 2, 1), "r1 > 0", "c1 - l1 >= 2 * b1", white(0), "c0 > o1"),
    "longleggeddoji": mask(1, "r0 > 0", "b0 <= 0.1 * r0", "u0 >= 0.4 * r0", "greatest(o0, c0) - l0 >= 0.4 * r0"),
    "longline": mask(1, "r0 > 0", "b0 >= 0.6 * r0", "u0 <= 0.2 * r0", "d0 <= 0.2 * r0"),
    "marubozu": mask(1, "r0 > 0", "b0 > 0", "u0 <= 0.05 * r0", "d0 <= 0.05 * r0", "b0 >= 0.9 * r0"),
    "matchinglow": mask(2, black(1, 0), "abs(l0 - l1) <= 1e-12", "c0 > c1"),
    "mathold": mask(5, white(4), "r4 > 0", "b4 >= 0.6 * r4", _SMALL4, white(0), "c0 > c4"),
    "morningdojistar": mask(3, black(2), "r2 > 0", "b2 >= 0.6 * r2", "r1 > 0", "b1 <= 0.1 * r1", "h1 < c2", white(0), "c0 > (o2 + c2) * 0.5"),
    "morningstar": mask(3, black(2), "r2 > 0", "b2 >= 0.6 * r2", "r1 > 0", "b1 <= 0.4 * b2", "h1 < c2", white(0), "r0 > 0", "b0 >= 0.6 * r0", "c0 > (o2 + c2) * 0.5"),
    "onneck": mask(2, black(1), "r1 > 0", "b1 >= 0.6 * r1", white(0), "o0 < l1", "abs(c0 - c1) <= 0.1 * b1"),
    "piercing": mask(2, black(1), "r1 > 0", "b1 >= 0.6 * r1", white(0), "r0 > 0", "b0 >= 0.6 * r0", "o0 < l1", "c0 > (o1 + c1) * 0.5", "c0 < o1"),
    "rickshawman": mask(1, "r0 > 0", "b0 <= 0.1 * r0", "u0 >= 0.4 * r0", "d0 >= 0.4 * r0", "abs(u0 - d0) <= 0.2 * r0"),
    "risefall3methods": mask(5, "r4 > 0", "b4 >= 0.6 * r4", _SMALL_B4, "r0 > 0", "b0 >= 0.6 * r0", f"({white(4, 0)} and {black(3, 2, 1)} and c0 > c4) or ({black(4, 0)} and {white(3, 2, 1)} and c0 < c4)"),
    "separatinglines": mask(2, "abs(o0 - o1) < 1e-12", f"({black(1)} and {white(0)} and c0 > c1) or ({white(1)} and {black(0)} and c0 < c1)"),
    "shootingstar": mask(1, "r0 > 0", "b0 <= 0.3 * r0", "d0 <= 0.1 * r0", "u0 >= 0.6 * r0", "u0 >= 2 * b0"),
    "shortline": mask(1, "r0 > 0", "b0 <= 0.3 * r0", "u0 <= 0.3 * r0", "d0 <= 0.3 * r0"),
    "spinningtop": mask(1, "r0 > 0", "b0 >= 0.1 * r0", "b0 <= 0.4 * r0", "u0 >= 0.2 * r0", "d0 >= 0.2 * r0"),
    "stalledpattern": mask(3, white(2, 1, 0), ranged(3), "b2 >= 0.6 * r2", "b1 >= 0.5 * r1", "c1 > c2", "b0 < b1", "b0 <= 0.5 * r0", "u0 >= 0.3 * r0", "d0 <= 0.3 * r0", "c0 > c1", "c0 - c1 <= 0.5 * b1"),
    "sticksandwich": mask(3, black(2), white(1), black(0), ranged(3), "b2 >= 0.4 * r2", "c1 < o2 and c1 > c2", "o1 < o2 and o1 > c2", "b0 >= 0.4 * r0", "abs(c0 - c2) <= 1e-12"),
    "takuri": mask(1, "r0 > 0", "b0 <= 0.2 * r0", "u0 <= 0.1 * r0", "d0 >= 0.6 * r0", "d0 >= 3 * b0"),
    "tasukigap": mask(3, f"({white(2, 1)} and l1 > h2 and {black(0)} and o0 > o1 and o0 < c1 and c0 > h2 and c0 < l1) or ({black(2, 1)} and h1 < l2 and {white(0)} and o0 > c1 and o0 < o1 and c0 > h1 and c0 < l2)"),
    "thrusting": mask(2, black(1), "r1 > 0", "b1 >= 0.6 * r1", white(0), "o0 < l1", "c0 > c1", "c0 < (o1 + c1) * 0.5"),
    "tristar": mask(3, ranged(3), "b2 <= 0.1 * r2", "b1 <= 0.1 * r1", "b0 <= 0.1 * r0", "l1 > h2 or h1 < l2", "l0 > h1 or h0 < l1"),
    "unique3river": mask(3, black(2, 1), white(0), ranged(3), "b2 >= 0.6 * r2", "b1 <= 0.4 * b2", "l1 < l2", "b0 <= 0.6 * r0", "c0 > c1 and c0 < o2", "o0 > l1"),
    "upsidegap2crows": mask(3, white(2), black(1, 0), ranged(3), "b2 >= 0.6 * r2", "b1 >= 0.4 * r1", "c1 > c2", "o0 > o1", "c0 > c2 and c0 < c1"),
    "xsidegap3methods": mask(3, f"({white(2, 1)} and o1 > c2 and {black(0)} and c0 > c2 and c0 < o1) or ({black(2, 1)} and o1 < c2 and {white(0)} and c0 > o1 and c0 < c2)"),
}

#: Default factors of the patterns whose forms are not "every body and shadow within its factor".
FACTORS: dict[str, tuple[float, float]] = {
    "dojistar": (0.1, 1.0),
    "dragonflydoji": (0.1, 0.5),
    "gravestonedoji": (0.1, 0.5),
    "eveningdojistar": (0.1, 0.5),
    "eveningstar": (0.3, 0.5),
    "hammer": (0.5, 0.3),
    "hangingman": (0.5, 0.3),
    "harami": (0.3, 0.5),
    "haramicross": (0.1, 0.5),
    "highwave": (0.1, 0.3),
    "concealbabyswall": (0.5, 0.3),
}
#: Their strict forms, and those of the hikkake forms: condition by name.
STRICT: dict[str, str] = {
    "dojistar": "u0 + d0 <= @S * r0",
    "dragonflydoji": "r0 >= @S * r0",
    "gravestonedoji": "r0 >= @S * r0",
    "eveningdojistar": " and ".join(f"u{k} + d{k} <= @S * r{k}" for k in (2, 1, 0)),
    "eveningstar": " and ".join(f"u{k} + d{k} <= @S * r{k}" for k in (2, 1, 0)),
    "hammer": "b0 <= @B * r0 and u0 <= @S * r0",
    "hangingman": "b0 <= @B * r0 and u0 <= @S * r0",
    "harami": "b1 >= @B * r1 and b0 <= @S * r0 and u1 + d1 <= @S * r1 and u0 + d0 <= @S * r0",
    "haramicross": "b1 >= @B * r1 and u1 + d1 <= @S * r1 and u0 + d0 <= @S * r0",
    "highwave": "u0 >= 2 * b0 and greatest(o0, c0) - l0 >= 2 * b0",
    "hikkake": "r2 > 0 and r1 > 0 and r1 >= 0.2 * r2",
    "hikkakemod": "r2 > 0 and r1 > 0 and r1 >= 0.25 * r2",
    "concealbabyswall": "b3 >= @B * r3 and b2 >= @B * r2 and " + " and ".join(f"u{k} + d{k} <= @S * r{k}" for k in range(4)),
}
#: Patterns whose symmetric form takes its sign from the body instead.
BY_BODY = ("dragonflydoji", "gravestonedoji", "hammer", "hangingman", "highwave")


def strict_condition(name: str) -> str:
    """What the strict form asks besides the pattern itself."""
    p = PATTERNS[name]
    if name in STRICT:
        return STRICT[name]
    if not p.strict:
        return "true"
    return " and ".join(f"b{k} >= @B * r{k} and u{k} + d{k} <= @S * r{k}" for k in range(p.bars))


def pattern_sql(name: str, strict: bool = False, symmetric: bool = False, min_body_factor: float | None = None, max_shadow_factor: float | None = None) -> str:
    """The value of a pattern over the columns of ``bar_stages``; a factor of None is the pattern's default."""
    p = PATTERNS[name]
    cases = [*p.cases, *([p.mirror] if symmetric and p.mirror else [])]
    extra = f" and {strict_condition(name)}" if strict else ""
    parts = []
    for value, condition in cases:
        result = repr(value)
        if symmetric and name in BY_BODY:
            result = f"case when c0 < o0 then -1.0 when c0 > o0 then 1.0 else {value if name not in ('hammer', 'hangingman', 'highwave') else 1.0!r} end"
        parts.append(f"when ({condition}){extra} then {result}")
    sql = f"cast(case {' '.join(parts)} else 0.0 end as double)"
    defaults = FACTORS.get(name) or p.strict or (0.0, 1.0)
    for token, given, default in zip(("@B", "@S"), (min_body_factor, max_shadow_factor), defaults, strict=True):
        sql = sql.replace(token, repr(float(default if given is None else given)))
    return sql


def bar_stages(name: str | None = None, lookahead: int = 3) -> tuple[dict[str, str], ...]:
    """Stages that make the bars' columns; all five bars, or those that one pattern uses."""
    p = PATTERNS[name] if name else None
    n = p.bars if p else BARS
    prices = {f"{a}{k}": (f"lag({c}, {k}) @O" if k else c) for k in range(n) for a, c in zip("ohlc", ("open", "high", "low", "close"), strict=True)}
    shapes = {}
    for k in range(n):
        shapes |= {f"b{k}": f"abs(c{k} - o{k})", f"r{k}": f"h{k} - l{k}", f"u{k}": f"h{k} - greatest(o{k}, c{k})", f"d{k}": f"least(o{k}, c{k}) - l{k}"}
    if p is None or p.ahead:
        for c in ("low", "close"):
            prices[f"low_{c}"] = f"case when lead({c}, {lookahead}) @O is not null then least({', '.join(f'lead({c}, {i}) @O' for i in range(1, lookahead + 1))}) end"
        for c in ("high", "close"):
            prices[f"high_{c}"] = f"case when lead({c}, {lookahead}) @O is not null then greatest({', '.join(f'lead({c}, {i}) @O' for i in range(1, lookahead + 1))}) end"
    used = set(re.findall(r"\b[a-z_]+\d?\b", pattern_sql(name, True, True))) if name else None
    return prices, {k: v for k, v in shapes.items() if used is None or k in used}
