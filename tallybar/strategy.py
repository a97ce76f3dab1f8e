"""Strategies as text: indicators by type and parameters, and conditions on their fields.

A strategy is a JSON object. ``indicators`` names each indicator with its ``type``, its ``source`` (a column in place
of close) and its parameters; ``entry`` and ``exit`` hold, for each side, conditions that must all be true. A condition
may use ``price``, any price column, and ``name.field``: a field is an output's name without its parameters, in lower
case, and ``value`` is the first output. Conditions are parsed to a tree; no part of the text is executed.
"""

from __future__ import annotations

import inspect
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from .frame import PRICES, BarFrame
from .functions import signals, windows
from .operators import recursive


@dataclass(frozen=True)
class Strategy:
    """indicators: (name, source, declaration); rules: conditions by ``entry_long`` and the like."""

    indicators: tuple[tuple[str, str, windows.Indicator | recursive.Recursive], ...]
    rules: dict[str, tuple[str, ...]]


def parse(text: str | dict) -> Strategy:
    """A strategy from JSON text, or from what it decodes to."""
    spec = json.loads(text) if isinstance(text, str) else text
    unknown = set(spec) - {"indicators", "entry", "exit", "risk"}
    if unknown:
        raise ValueError(f"a strategy has no {', '.join(sorted(unknown))}")
    made = []
    for name, how in spec.get("indicators", {}).items():
        how = dict(how)
        if not name.isidentifier() or name in ("price", *PRICES):
            raise ValueError(f"{name!r} cannot name an indicator")
        kind, source = str(how.pop("type")).lower(), how.pop("source", "close")
        build = windows.INDICATORS.get(kind) or recursive.INDICATORS.get(kind)
        if build is None:
            raise ValueError(f"unknown indicator type {kind!r}")
        wrong = set(how) - set(inspect.signature(build).parameters)
        if wrong:
            raise ValueError(f"{kind} has no parameter {', '.join(sorted(wrong))}")
        made.append((name, source, build(**how)))
    rules = {f"{when}_{side}": tuple(conditions) for when in ("entry", "exit") for side, conditions in spec.get(when, {}).items()}
    return Strategy(tuple(made), rules)


def field(output: str) -> str:
    """An output's name without its parameters."""
    return re.sub(r"_m?\d.*$", "", output).lower()


def apply(frame: BarFrame, strategy: Strategy) -> BarFrame:
    """The frame with a boolean column for each rule; a rule with a missing value is false."""
    names = {"price": "close"} | {c: c for c in PRICES if c in frame.df.columns}
    own = frame.df.columns
    for name, source, made in strategy.indicators:
        # the indicator reads its source as close; what it adds gets the strategy's name for it
        before = frame.df
        df = before if source == "close" else before.withColumns({"__close": F.col("close"), "close": F.col(source).cast("double")})
        added = frame._with(df)
        added = added.finite(made) if isinstance(made, windows.Indicator) else added.recursive(made)
        df = added.df if source == "close" else added.df.withColumn("close", F.col("__close")).drop("__close")
        renamed = {o: f"{name}__{field(o)}" for o in made.outputs}
        frame = frame._with(df.select(*before.columns, *(F.col(o).alias(c) for o, c in renamed.items())))
        names |= {f"{name}.{field(o)}": c for o, c in renamed.items()} | {f"{name}.value": renamed[made.outputs[0]]}
    rules = {rule: F.coalesce(reduce(lambda a, b: a & b, (signals.condition(c, names) for c in conditions), F.lit(True)), F.lit(False)) for rule, conditions in strategy.rules.items()}
    return frame._with(frame.df.withColumns(rules).select(*own, *rules))
