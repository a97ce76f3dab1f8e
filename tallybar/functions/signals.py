"""Signals from indicator columns, and the condition language that combines them.

Conditions are parsed to a tree and compiled to Columns; text never reaches the SQL parser.
"""

from __future__ import annotations

import ast
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def crossed_up(a: Column, b: Column, over, strict: bool = False) -> Column:
    """Whether a is above b now and was below before, or with ``strict`` off at most equal."""
    before, other = F.lag(a).over(over), F.lag(b).over(over)
    return F.coalesce((a > b) & (before < other if strict else before <= other), F.lit(False))


def crossed_down(a: Column, b: Column, over, strict: bool = False) -> Column:
    return crossed_up(b, a, over, strict)


def first_label(cases: list[tuple[str, Column]]) -> Column:
    """The name of the first case that holds, else the empty string."""
    return reduce(lambda rest, case: F.when(case[1], F.lit(case[0])).otherwise(rest), reversed(cases), F.lit(""))


def ott_signals(df: DataFrame, key: str, order: str, price: str, ott: str, ma: str, suffix: str = "") -> DataFrame:
    """Six crosses of price, average and line, and the first of them as a label."""
    over = Window.partitionBy(key).orderBy(order)
    p, o, m = F.col(price), F.col(ott), F.col(ma)
    turn = F.lag(o).over(over)
    parts = {"buy_price_cross": crossed_up(p, o, over), "sell_price_cross": crossed_down(p, o, over), "buy_support_cross": crossed_up(m, o, over), "sell_support_cross": crossed_down(m, o, over), "buy_color_change": F.coalesce(o > turn, F.lit(False)), "sell_color_change": F.coalesce(o < turn, F.lit(False))}
    out = df.withColumns({f"{n}{suffix}": c for n, c in parts.items()})
    names = [f"{side}_{kind}" for side in ("buy", "sell") for kind in ("price_cross", "support_cross", "color_change")]
    return out.withColumn(f"signal{suffix}", first_label([(n, F.col(f"{n}{suffix}")) for n in names]))


def last_ott_signal(signals: DataFrame, key: str, order: str, suffix: str = "") -> DataFrame:
    """Each instrument's last signal; price crosses come before support crosses, those before colour changes."""
    names = [f"{side}_{kind}" for kind in ("price_cross", "support_cross", "color_change") for side in ("buy", "sell")]
    label = first_label([(n, F.col(f"{n}{suffix}")) for n in names])
    return signals.groupBy(key).agg(F.max_by(label, order).alias("signal"))


def clouds_signals(df: DataFrame, key: str, order: str, line: str, trigger: str, histogram: str) -> DataFrame:
    """macd_cross, 1 where the line crosses its trigger upwards and -1 downwards, and hist_cross, the same of the histogram and zero; else 0."""
    over = Window.partitionBy(key).orderBy(order)

    def crossing(a: Column, b: Column) -> Column:
        return F.when(crossed_up(a, b, over, True), 1).when(crossed_down(a, b, over, True), -1).otherwise(0)

    return df.withColumns({"macd_cross": crossing(F.col(line), F.col(trigger)), "hist_cross": crossing(F.col(histogram), F.lit(0.0))})


def last_clouds_signal(signals: DataFrame, key: str, order: str) -> DataFrame:
    """Each instrument's last line cross as buy, sell or null."""
    name = F.when(F.col("macd_cross") == 1, "buy").when(F.col("macd_cross") == -1, "sell")
    return signals.groupBy(key).agg(F.max_by(F.struct(name.alias("x")), order)["x"].alias("signal"))


def cycle_signals(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """buy where the index rises to 50 or above 0, sell where it falls to 50 or below 100, as 0 or 1."""
    now, before = F.col(column), F.lag(column).over(Window.partitionBy(key).orderBy(order))
    buy = ((before < 50) & (now >= 50)) | ((before <= 0) & (now > 0))
    sell = ((before > 50) & (now <= 50)) | ((before >= 100) & (now < 100))
    return df.withColumns({"buy": F.coalesce(buy, F.lit(False)).cast("int"), "sell": F.coalesce(sell, F.lit(False)).cast("int")})


def last_cycle_signal(signals: DataFrame, key: str, order: str) -> DataFrame:
    """Each instrument's last signal as long, short or null; a buy comes first."""
    name = F.when(F.col("buy") == 1, "long").when(F.col("sell") == 1, "short")
    return signals.groupBy(key).agg(F.max_by(F.struct(name.alias("x")), order)["x"].alias("signal"))


def band_signal(df: DataFrame, key: str, order: str, upper: str, lower: str, price: str = "close") -> DataFrame:
    """Buy where the price falls back under the current upper band, sell where it rises back over the lower."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(order))
    p = F.col(price)
    return df.withColumns({"buy": F.coalesce((p < F.col(upper)) & (before > F.col(upper)), F.lit(False)), "sell": F.coalesce((p > F.col(lower)) & (before < F.col(lower)), F.lit(False))})


def last_value(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Each instrument's value at its last bar, null if it is missing there."""
    return df.groupBy(key).agg(F.max_by(F.struct(F.col(column).alias("x")), order)["x"].alias(column))


def trend_gate(df: DataFrame, key: str, order: str, column: str, trigger: float) -> DataFrame:
    """Whether each instrument's last value, cut to an integer, reaches the trigger."""
    return df.groupBy(key).agg((F.max_by(F.col(column), order).cast("int") >= trigger).alias("trending"))


def stochastic_cross(df: DataFrame, key: str, order: str, k: str, d: str, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """%K crossing %D upwards below ``low`` (buy), downwards above ``high`` (sell)."""
    over = Window.partitionBy(key).orderBy(order)
    a, b = F.col(k), F.col(d)
    return df.withColumns({"buy": crossed_up(a, b, over, True) & (a < low), "sell": crossed_down(a, b, over, True) & (a > high)})


_COMPARE = {ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_COMPUTE = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}


def condition(text: str, names: dict[str, str]) -> Column:
    """A condition such as ``rsi < 30 and not macd.hist < 0`` as a Column.

    names: column of each name that may be used, ``indicator`` or ``indicator.field``.
    """

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.BoolOp):
            return reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(build, node.values))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~build(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Compare):
            sides = [build(x) for x in (node.left, *node.comparators)]
            return reduce(operator.and_, (_COMPARE[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:], strict=False)))
        if isinstance(node, ast.BinOp) and type(node.op) in _COMPUTE:
            return _COMPUTE[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(node.value)
        if isinstance(node, (ast.Name, ast.Attribute)):
            name = ast.unparse(node)
            if name not in names:
                raise ValueError(f"unknown name {name!r} in a condition")
            return F.col(names[name])
        raise ValueError(f"a condition may not hold {type(node).__name__}")

    try:
        return build(ast.parse(text.replace("\n", " ").strip(), mode="eval"))
    except (SyntaxError, KeyError) as error:
        raise ValueError(f"not a condition: {text!r}") from error


def strategy_signals(df: DataFrame, names: dict[str, str], entry: str, exit_: str) -> DataFrame:
    """Boolean columns entry and exit; a condition over missing values does not hold."""
    return df.withColumns({"entry": F.coalesce(condition(entry, names), F.lit(False)), "exit": F.coalesce(condition(exit_, names), F.lit(False))})
