"""A price frame: validated bars of many instruments, and indicators over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import patterns, windows
from .operators import recursive

PRICES = ("open", "high", "low", "close", "volume")


class BarFrame:
    """Bars with an instrument key and an order, whose indicators are planned together.

    Spark frames have no order of their own, so ``order`` must be unique within ``key``. ``columns`` maps
    open, high, low, close, volume to the frame's names. NaN and infinities become NULL on the way in.
    """

    def __init__(self, df: DataFrame, key: str, order: str, columns: dict[str, str] | None = None, required=("close",)):
        names = {c: c for c in PRICES} | (columns or {})
        missing = [names[c] for c in required if names[c] not in df.columns] + [c for c in (key, order) if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        df = df.withColumnsRenamed({own: name for name, own in names.items() if own != name and own in df.columns})
        for name in (c for c in PRICES if c in df.columns):
            value = F.col(name).cast("double")
            df = df.withColumn(name, F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value))
        if df.schema[order].dataType.simpleString() == "string":
            df = df.withColumn(order, F.to_timestamp(order))
        self.key, self.order = key, order
        self.df = df

    def _over(self):
        return Window.partitionBy(self.key).orderBy(self.order)

    def fill(self, policy: str, columns=PRICES) -> BarFrame:
        """Missing prices by ``raise``, ``ffill``, ``bfill`` or ``both``."""
        past = self._over().rowsBetween(Window.unboundedPreceding, 0)
        future = self._over().rowsBetween(0, Window.unboundedFollowing)
        out = self.df
        for c in (c for c in columns if c in out.columns):
            before, after = F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(future)
            value = {"raise": F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} has missing values")).cast("double")), "ffill": before, "bfill": after, "both": F.coalesce(before, after)}.get(policy)
            if value is None:
                raise ValueError(f"unknown policy {policy!r}")
            out = out.withColumn(c, value)
        return self._with(out)

    def _with(self, df: DataFrame) -> BarFrame:
        other = object.__new__(BarFrame)
        other.df, other.key, other.order = df, self.key, self.order
        return other

    def finite(self, *indicators: windows.Indicator, slices: int = 1) -> BarFrame:
        """Append indicators over finite windows.

        slices: into how many spans of time a long series is cut, so that it takes as many tasks; each span brings along
        as many earlier bars as the indicators look back. Series too short for that, and indicators that also look ahead
        or at all bars, are not cut.
        """
        whole = [i for i in indicators if windows.reach(i) is None]
        near = [i for i in indicators if windows.reach(i) is not None]
        out = self.df
        if slices > 1 and near:
            out = sliced(out, near, self.key, self.order, slices)
        else:
            whole = list(indicators)
        out = reduce(lambda df, i: apply_stages(df, i.stages, i.outputs, self.key, self.order), whole, out)
        names = [o for i in indicators for o in i.outputs]
        return self._with(out.select(*(c for c in self.df.columns if c not in names), *dict.fromkeys(names)))

    def recursive(self, *indicators: recursive.Recursive) -> BarFrame:
        """Append recursive indicators, all in one grouped map."""
        return self._with(recursive.with_recursive(self.df, self.key, self.order, list(indicators)))

    def patterns(self, *names: str, strict: bool = False, symmetric: bool = False, min_body_factor: float | None = None, max_shadow_factor: float | None = None, lookahead: int = 3) -> BarFrame:
        """Append candlestick patterns as CDL_<NAME>; all share one window over the lagged bars.

        The factors replace the defaults of the patterns that have them; ``lookahead`` is for the hikkake forms.
        """
        extra: dict[str, str] = {}
        stages: tuple[dict[str, str], ...] = ({}, {})
        for n in names:
            a, b = patterns.bar_stages(n, lookahead)
            stages = (stages[0] | a, stages[1] | b)
            extra[f"CDL_{n.upper()}"] = patterns.pattern_sql(n, strict, symmetric, min_body_factor, max_shadow_factor)
        return self._with(apply_stages(self.df, (*stages, extra), tuple(extra), self.key, self.order))

    def shifted(self, columns, offset: int = 0, fillna: float | None = None) -> BarFrame:
        """Move columns by ``offset`` bars and fill what is missing."""
        out = self.df
        for c in columns:
            value = F.lag(c, offset).over(self._over()) if offset else F.col(c)
            out = out.withColumn(c, value if fillna is None else F.coalesce(value, F.lit(fillna)))
        return self._with(out)

    def trimmed(self, columns) -> DataFrame:
        """Without the warm-up: bars from the first one at which every column has a value."""
        ready = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        begun = F.max(F.when(ready, 1)).over(self._over().rowsBetween(Window.unboundedPreceding, 0))
        return self.df.withColumn("__begun", begun).where("__begun = 1").drop("__begun")

    def tail(self, n: int) -> DataFrame:
        """The last n bars of each instrument."""
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.col(self.order).desc()))
        return self.df.withColumn("__last", last).where(F.col("__last") <= n).drop("__last")


def apply_stages(df: DataFrame, stages, outputs, key: str, order: str) -> DataFrame:
    """Run the stages and keep the frame's own columns and the outputs."""
    own = [c for c in df.columns if c not in outputs]
    for stage in stages:
        averages = {name: x for name, x in stage.items() if isinstance(x, windows.Average)}
        plain = {name: F.expr(windows.render(x, key, order)) for name, x in stage.items() if name not in averages}
        if plain:
            df = df.withColumns(plain)
        if averages:
            df = recursive.with_recursive(df, key, order, [recursive.average(name, x.kind, x.column, x.length) for name, x in averages.items()])
    return df.select(*own, *outputs)


def sliced(df: DataFrame, indicators: list[windows.Indicator], key: str, order: str, slices: int) -> DataFrame:
    """Indicators that only look back, with each series cut into spans of time that are windows of their own."""
    reach = max(windows.reach(i) for i in indicators)
    kind = df.schema[order].dataType.simpleString()
    at = F.unix_micros(F.col(order).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(order)
    cuts = df.groupBy(key).agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 10_000).alias("__cuts"))
    cut = df.withColumn("__at", at).join(cuts, key, "left").withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.col("__at"))))
    # a span must hold all that the next one looks back to
    sizes = cut.groupBy(key, "__slice").count().groupBy(key).agg((F.min("count") >= reach).alias("__long"))
    cut = cut.drop("__cuts", "__at").join(sizes, key, "left").withColumn("__slice", F.when(F.col("__long"), F.col("__slice")).otherwise(0)).drop("__long")
    last = F.row_number().over(Window.partitionBy(key, "__slice").orderBy(F.col(order).desc()))
    also = F.when(last <= reach, F.array(F.struct(F.lit(False).alias("own"), (F.col("__slice") + 1).alias("slice")))).otherwise(F.array().cast("array<struct<own:boolean,slice:int>>"))
    both = F.concat(F.array(F.struct(F.lit(True).alias("own"), F.col("__slice").alias("slice"))), also)
    spread = cut.withColumn("__x", both).drop("__slice").withColumn("__x", F.explode("__x"))
    spread = spread.select(*df.columns, F.col("__x.own").alias("__own"), F.col("__x.slice").alias("__slice"))
    done = reduce(lambda d, i: apply_stages(d, i.stages, i.outputs, f"{key}, __slice", order), indicators, spread)
    return done.where("__own").drop("__own", "__slice")
