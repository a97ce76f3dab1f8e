"""One query per operator over bars made from the tables, and DuckDB's SQL for the same rows.

Every query reads its whole tables. Doubles are rounded to six places, as two engines add up in different
orders; times are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import strategy
from ..frame import BarFrame
from ..functions import patterns, signals, windows
from ..operators import levels, order_blocks, recursive, structure, zones
from ..sources import bars as sources
from . import finite_sql
from .recursions import RECURSIONS

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = "select event_type as sym, date_trunc('hour', ts) as ts, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, cast(count(*) as double) as volume from events group by 1, 2"
ORDERS = "select o_orderpriority as sym, date_trunc('day', o_orderdate) as ts, arg_min(cast(o_totalprice as double), o_orderkey) as open, cast(max(o_totalprice) as double) as high, cast(min(o_totalprice) as double) as low, arg_max(cast(o_totalprice as double), o_orderkey) as close, cast(count(*) as double) as volume from orders group by 1, 2"
SOURCES: dict[str, tuple[Query, str]] = {"events": (sources.events_hourly, EVENTS), "orders": (sources.orders_daily, ORDERS)}

#: Queries over finite windows: name, indicator, and source of bars.
FINITE: dict[str, tuple[windows.Indicator, str]] = {
    **{name: (make(), "events") for name, make in windows.INDICATORS.items()},
    "wma_desc": (windows.wma(10, False), "events"),
    "linreg_slope": (windows.linreg(14, "slope"), "events"),
    "linreg_intercept": (windows.linreg(14, "intercept"), "events"),
    "linreg_angle": (windows.linreg(14, "angle"), "events"),
    "linreg_tsf": (windows.linreg(14, "tsf"), "events"),
    "linreg_r": (windows.linreg(14, "r"), "events"),
    "kurtosis_corrected": (windows.kurtosis(30, True), "events"),
    "ichimoku": (windows.ichimoku(), "orders"),
    "tos_stdevall_last": (windows.tos_stdevall(100), "events"),
    "sma_orders": (windows.sma(20), "orders"),
}


def _shown(df: DataFrame, outputs) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("sym", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *((F.round(c, 6) + 0.0 if kinds[c] == "double" else F.col(c)).alias(c) for c in outputs))


def _shown_sql(outputs, table: str = "last_stage", plain=()) -> str:
    columns = ", ".join(f'"{c}"' if c in plain else f'round("{c}", 6) + 0.0 as "{c}"' for c in outputs)
    return f"select sym, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {columns} from {table}"


def _staged_sql(source: str, stages, outputs) -> str:
    parts, table = [f"bars as ({SOURCES[source][1]})"], "bars"
    for i, stage in enumerate(stages):
        if stage:
            columns = ", ".join(f'{windows.render(sql, "sym", "ts")} as "{name}"' for name, sql in stage.items())
            parts.append(f"stage_{i} as (select *, {columns} from {table})")
            table = f"stage_{i}"
    return f"with {', '.join(parts)} {_shown_sql(outputs, table)}"


def _finite(indicator: windows.Indicator, source: str) -> Query:
    return lambda spark, d: _shown(BarFrame(SOURCES[source][0](spark, d), "sym", "ts").finite(indicator).df, indicator.outputs)


def _recursive(request: recursive.Recursive, source: str = "events") -> Query:
    return lambda spark, d: _shown(BarFrame(SOURCES[source][0](spark, d), "sym", "ts").recursive(request).df, request.outputs)


def _pattern(names: list[str], strict: bool = False, symmetric: bool = False, **how) -> Query:
    outputs = [f"CDL_{n.upper()}" for n in names]
    return lambda spark, d: _shown(BarFrame(sources.events_hourly(spark, d), "sym", "ts").patterns(*names, strict=strict, symmetric=symmetric, **how).df, outputs)


def _pattern_sql(names: list[str], strict: bool = False, symmetric: bool = False) -> str:
    stages: tuple[dict, ...] = ({}, {})
    for n in names:
        a, b = patterns.bar_stages(n)
        stages = (stages[0] | a, stages[1] | b)
    values = {f"CDL_{n.upper()}": patterns.pattern_sql(n, strict, symmetric) for n in names}
    return _staged_sql("events", (*stages, values), values)


def _pivots(method: str, anchor: str, join: str = "backward") -> Query:
    outputs = list(levels.pivot_names(method, anchor).values())
    return lambda spark, d: _shown(levels.pivots(sources.orders_daily(spark, d), "sym", "ts", method, anchor, join), outputs)


#: Each method's middle and the levels below and above it, by the period's open, high, low, close (o, h, l, c) and range r.
PIVOTS = {
    "camarilla": ("(h + l + c) / 3", ("c - 11 * r / 120", "c - 11 * r / 60", "c - 33 * r / 120", "c - 66 * r / 120"), ("c + 11 * r / 120", "c + 11 * r / 60", "c + 33 * r / 120", "c + 66 * r / 120")),
    "classic": ("(h + l + c) / 3", ("p + p - h", "p - r", "p - 2 * r", "p - 3 * r"), ("p + p - l", "p + r", "p + 2 * r", "p + 3 * r")),
    "demark": ("(h + l + c + case when o = c then c when c > o then h else l end) / 4", ("p + p - h", None, None, None), ("p + p - l", None, None, None)),
    "fibonacci": ("(h + l + c) / 3", ("p - 382 * r / 1000", "p - 618 * r / 1000", "p - r", None), ("p + 382 * r / 1000", "p + 618 * r / 1000", "p + r", None)),
    "traditional": ("(h + l + c) / 3", ("p + p - h", "p - r", "p - 2 * r", "p - 2 * r"), ("p + p - l", "p + r", "p + 2 * r", "p + 2 * r")),
    "woodie": ("(o + o + h + l) / 4", ("p + p - h", "p - r", "2 * p + l - 2 * h", "2 * p + l - 2 * h - r"), ("p + p - l", "p + r", "2 * p + h - 2 * l", "2 * p + h - 2 * l + r")),
}


def _pivots_sql(method: str, anchor: str, join: str = "backward") -> str:
    unit, names = sources.UNITS[anchor], levels.pivot_names(method, anchor)
    middle, below, above = PIVOTS[method]
    shown = {"P": "p"} | {f"{side}{i}": x or "cast(null as double)" for side, steps in (("S", below), ("R", above)) for i, x in enumerate(steps, 1)}
    columns = ", ".join(f'{x} as "{names[k]}"' for k, x in shown.items())
    periods = f"select sym, date_trunc('{unit}', ts) as period, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close from bars group by 1, 2"
    compare = ">=" if join == "backward" else "<="
    return f"with bars as ({ORDERS}), periods as ({periods}), middles as (select sym, period, o, h, l, c, h - l as r, {middle} as p from (select sym, period, open as o, high as h, low as l, close as c from periods)), levels as (select sym, period + interval 1 {unit} as until, {columns} from middles), last_stage as (select b.sym, b.ts, l.* exclude (sym, until) from bars b asof left join levels l on b.sym = l.sym and b.ts {compare} l.until) {_shown_sql(names.values())}"


def _recursion_tables(name: str) -> str:
    """All tables up to last_stage, which holds unrounded outputs."""
    r = RECURSIONS[name]
    seeds = ", ".join(f"{seed} as {v}" for v, (seed, _) in r.state.items())
    steps = ", ".join(step for _, step in r.state.values())
    shown = ", ".join(f'{sql} as "{n}"' for n, sql in r.outputs.items())
    extra = "".join(f", {sql} as {n}" for n, sql in r.extra.items())
    return f"""with recursive bars as ({EVENTS}), plain as (select *, row_number() over w as rn, lag(close) over w as p from bars window w as (partition by sym order by ts)),
x as (select *{extra} from plain window w as (partition by sym order by ts)),
seed as (select sym, {r.first} as rn, {seeds} from x where rn <= {r.first} group by sym having count(*) = {r.first}),
s as (select sym, cast(rn as bigint) as rn, {', '.join(f'cast({v} as double) as {v}' for v in r.state)} from seed union all select x.sym, x.rn, {steps} from s join x on x.sym = s.sym and x.rn = s.rn + 1),
last_stage as (select x.sym, x.ts, {shown} from x left join s on s.sym = x.sym and s.rn = x.rn window w as (partition by x.sym order by x.ts))"""


def _recursion_sql(name: str) -> str:
    outputs = RECURSIONS[name].outputs
    return f"{_recursion_tables(name)} {_shown_sql(outputs, plain=[n for n in outputs if n.startswith(('entry', 'exit'))])}"


def _crosses(a: str, b: str, over: str = "over (partition by sym order by ts)") -> str:
    return f"coalesce({a} > {b} and lag({a}) {over} <= lag({b}) {over}, false)"


def _ott_signals_sql(names: list[str], last: bool) -> str:
    """The first of the named crosses that holds, at every bar or at each series' last."""
    line, turn = "OTT_2_1_4_VAR", "lag(OTT_2_1_4_VAR) over (partition by sym order by ts)"
    close, mean = (f"priced.{c}" for c in ("close", "OTT_MA_2_1_4_VAR"))
    rules = {"buy_price_cross": _crosses(close, line), "sell_price_cross": _crosses(line, close), "buy_support_cross": _crosses(mean, line), "sell_support_cross": _crosses(line, mean), "buy_color_change": f"coalesce({line} > {turn}, false)", "sell_color_change": f"coalesce({line} < {turn}, false)"}
    label = "case " + " ".join(f"when {rules[n]} then '{n}'" for n in names) + " else '' end"
    tables = f"{_recursion_tables('ott')}, priced as (select l.*, close from last_stage l join bars using (sym, ts)), labelled as (select sym, ts, {label} as signal from priced)"
    return f"{tables} select sym, arg_max(signal, ts) as signal from labelled group by sym" if last else f"{tables} {_shown_sql(['signal'], 'labelled', ['signal'])}"


def _stochastic_tables() -> str:
    def mean(column):
        return f"case when count({column}) over v = 3 then avg({column}) over v end"

    window = "window v as (partition by sym order by ts rows 2 preceding)"
    return f"""{_recursion_tables('rsi')}, ranged as (select sym, ts, RSI_14 as r, count(RSI_14) over v as n, min(RSI_14) over v as low, max(RSI_14) over v as high from last_stage window v as (partition by sym order by ts rows 13 preceding)),
raw as (select sym, ts, case when n = 14 then coalesce(100 * (r - low) / nullif(high - low, 0), 50) end as v from ranged), line as (select sym, ts, {mean('v')} as k from raw {window}), stochastic as (select sym, ts, k as "STOCHRSIk_14_14_3_3", {mean('k')} as "STOCHRSId_14_14_3_3" from line {window})"""


def _stochastic_signals_sql() -> str:
    k, d = '"STOCHRSIk_14_14_3_3"', '"STOCHRSId_14_14_3_3"'
    crosses = f"select sym, ts, coalesce({k} > {d} and lag({k}) over w < lag({d}) over w and {k} < 20, false) as buy, coalesce({k} < {d} and lag({k}) over w > lag({d}) over w and {k} > 80, false) as sell from stochastic window w as (partition by sym order by ts)"
    return f"{_stochastic_tables()}, crosses as ({crosses}) {_shown_sql(['buy', 'sell'], 'crosses', ['buy', 'sell'])}"


def _clouds_tables() -> str:
    signs = {"macd_cross": ("RSI_CLOUDS_MACD_14", "RSI_CLOUDS_SIGNAL_14"), "hist_cross": ("RSI_CLOUDS_HIST_14", "0")}
    before = lambda x: x if x == "0" else f"lag({x}) over w"
    columns = ", ".join(f"case when {before(a)} < {before(b)} and {a} > {b} then 1 when {before(a)} > {before(b)} and {a} < {b} then -1 else 0 end as {n}" for n, (a, b) in signs.items())
    return f"{_recursion_tables('rsi_clouds')}, crosses as (select sym, ts, {columns} from last_stage window w as (partition by sym order by ts))"


def _cycle_tables() -> str:
    now, before = "SCRSI_crsi_20_10", "lag(SCRSI_crsi_20_10) over w"
    buy = f"case when ({before} < 50 and {now} >= 50) or ({before} <= 0 and {now} > 0) then 1 else 0 end"
    sell = f"case when ({before} > 50 and {now} <= 50) or ({before} >= 100 and {now} < 100) then 1 else 0 end"
    return f"{_recursion_tables('scrsi')}, crosses as (select sym, ts, {buy} as buy, {sell} as sell from last_stage window w as (partition by sym order by ts))"


def _last_sql(tables: str, label: str) -> str:
    return f"{tables} select sym, {label} as signal from crosses qualify row_number() over (partition by sym order by ts desc) = 1"


def _swings_sql(column: str, least: float = 0.01, apart: int = 5) -> str:
    """Strict maxima of a column that stand out by ``least`` above the higher of both sides' lowest points; of those less than ``apart`` bars after the first of their group, the highest."""
    tops = f"select sym, rn, {column} as v, {column} > lag({column}) over w and {column} > lead({column}) over w as top, {column} - greatest(min({column}) over (partition by sym order by rn), min({column}) over (partition by sym order by rn desc)) as out from x window w as (partition by sym order by rn)"
    kept = f"select sym, rn, v, min(rn) over (partition by sym order by rn range between {apart} following and unbounded following) as next from ({tops}) where top and out >= {least}"
    return kept


def _zigzag_tables(source: str = "events") -> str:
    heads = lambda n: f"g{n} as (select sym, min(rn) as rn from k{n} group by sym union all select k{n}.sym, k{n}.next from g{n} join k{n} using (sym, rn) where k{n}.next is not null)"
    best = lambda n: f"f{n} as (select g.sym, arg_max(k.rn, (k.v, -k.rn)) as rn from g{n} g join k{n} k on k.sym = g.sym and k.rn between g.rn and g.rn + 4 group by g.sym, g.rn)"
    x = f"x as (select *, -low as neg, row_number() over (partition by sym order by ts) as rn from bars)"
    parts = [f"bars as ({SOURCES[source][1]})", x]
    for n, column in ((1, "high"), (2, "neg")):
        parts += [f"k{n} as ({_swings_sql(column)})", heads(n), best(n)]
    parts.append("last_stage as (select x.sym, x.ts, x.rn, x.high, x.low, f1.rn is not null as is_peak, f2.rn is not null as is_valley from x left join f1 on f1.sym = x.sym and f1.rn = x.rn left join f2 on f2.sym = x.sym and f2.rn = x.rn)")
    return f"with recursive {', '.join(parts)}"


def _market_structure_sql() -> str:
    """For each bar with an extreme: all peaks and valleys so far, as lists of prices and of kinds."""
    extremes = "select sym, ts, rn * 2 as pos, 'V' as kind, low as price from last_stage where is_valley union all select sym, ts, rn * 2 + 1, 'P', high from last_stage where is_peak"
    lists = "select sym, ts, pos, list(price) filter (where kind = 'P') over w as p, list(price) filter (where kind = 'V') over w as v, list(kind) over w as kinds from extremes window w as (partition by sym order by pos)"
    judged = "select sym, ts, pos, len(p) >= 2 and len(v) >= 2 as known, case when p[-1] > p[-2] then 'HH' else 'LH' end as a, case when v[-1] > v[-2] then 'HL' else 'LL' end as b, kinds[-3:] as recent from lists"
    votes = "list_transform(recent, lambda k: case k when 'P' then a else b end)"
    trend = f"case when known and len(recent) = 3 and len(list_filter({votes}, lambda t: t[1] = 'H')) = 3 and not list_contains({votes}, 'LH') then case when list_contains({votes}, 'LL') then null else 'up' end when known and len(recent) = 3 and len(list_filter({votes}, lambda t: t in ('LH', 'LL'))) = 3 then 'down' end"
    last = f"select sym, ts, case when known then a || '/' || b end as structure_label, {trend} as trend_direction from judged qualify row_number() over (partition by sym, ts order by pos desc) = 1"
    return f"{_zigzag_tables()}, extremes as ({extremes}), lists as ({lists}), judged as ({judged}), structures as ({last}) {_shown_sql(['structure_label', 'trend_direction'], 'structures', ['structure_label', 'trend_direction'])}"


def _order_blocks_sql(source: str, most: int) -> str:
    """Blocks of the default rules, whose look-back stops at ``most``: swings, the one bar that may break each, the first bar that tests its zone."""
    return f"""{_zigzag_tables(source)},
y as (select *, lag(close) over w as p, case when rn >= 20 then avg(volume) over m end as mean, case when rn >= 10 then max(high) over l end as top, case when rn >= 10 then min(low) over l end as bottom, count(*) over (partition by sym) as total from x window w as (partition by sym order by rn), m as (partition by sym order by rn rows 19 preceding), l as (partition by sym order by rn rows 9 preceding)),
t as (select sym, rn, greatest(high - low, abs(high - p), abs(low - p)) as tr from y where rn > 1),
s as (select sym, cast(15 as bigint) as rn, avg(tr) as atr from t where rn <= 15 group by sym having count(*) = 14 union all select t.sym, t.rn, s.atr + (t.tr - s.atr) / 14 from s join t on t.sym = s.sym and t.rn = s.rn + 1),
back as (select sym, cast(trunc(least({most}, greatest(5, 2 * median(atr)))) as bigint) as bars from s group by sym),
swings as (select sym, rn, true as supply from f1 union all select sym, rn, false from f2 anti join f1 using (sym, rn)),
zones as (select a.sym, a.rn, a.supply, o.ts as start, b.ts as break, b.rn as b_rn, o.close - s.atr as lo, o.close + s.atr as hi from swings a join y o using (sym, rn) join s using (sym, rn) join back k on k.sym = a.sym join y b on b.sym = a.sym and b.rn = a.rn + k.bars
where case when a.supply then o.top - o.high < 0.001 and b.low < o.low else o.low - o.bottom < 0.001 and b.high > o.high end and b.volume > b.mean),
tests as (select z.*, j.ts as retest, j.rn as j_rn, j.volume / greatest(j.mean, 1e-9) as loud, case when supply then (hi - j.close) / greatest(hi, 1e-9) else (j.close - lo) / greatest(lo, 1e-9) end as share from zones z join y j on j.sym = z.sym and j.rn between z.b_rn + 1 and z.b_rn + 9 where j.volume > j.mean and case when supply then j.low else j.high end between lo and hi),
firsts as (select * from tests where share >= 0.002 qualify row_number() over (partition by sym, rn order by j_rn) = 1)
select sym, row_number() over (partition by sym order by rn) - 1 as id, case when supply then 'supply' else 'demand' end as block_type, strftime(start, '%Y-%m-%d %H:%M:%S') as start, strftime(break, '%Y-%m-%d %H:%M:%S') as "break", strftime(retest, '%Y-%m-%d %H:%M:%S') as retest, round(lo, 6) as zone_low, round(hi, 6) as zone_high, round(greatest(0, least(loud * least(share, 3), 10)), 6) as strength, cast(null as varchar) as structure_label, cast(null as varchar) as trend_direction from firsts"""


ADX_AHEAD = f"""with recursive bars as ({EVENTS}), x as (select *, row_number() over w as rn, count(*) over (partition by sym) as total, high - lag(high) over w as up, lag(low) over w - low as down, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from bars window w as (partition by sym order by ts)),
m as (select *, case when up > down and up > 0 then up else 0 end as plus, case when down > up and down > 0 then down else 0 end as minus from x),
s as (select sym, cast(15 as bigint) as rn, avg(tr) as v, sum(plus) / avg(tr) as a, sum(minus) / avg(tr) as b from m where rn between 2 and 15 group by sym having count(*) = 14 union all select m.sym, m.rn, s.v + (m.tr - s.v) / 14, (m.plus / (s.v + (m.tr - s.v) / 14) + 13 * s.a) / 14, (m.minus / (s.v + (m.tr - s.v) / 14) + 13 * s.b) / 14 from s join m on m.sym = s.sym and m.rn = s.rn + 1),
d as (select sym, rn - 14 as rn, coalesce(100 * abs(a - b) / nullif(a + b, 0), 0) as dx from s where rn >= 29),
l as (select sym, cast(28 as bigint) as rn, avg(dx) as v from d where rn <= 28 group by sym having count(*) = 14 union all select d.sym, d.rn, l.v + (d.dx - l.v) / 14 from l join d on d.sym = l.sym and d.rn = l.rn + 1),
last_stage as (select x.sym, x.ts, l.v as "ADX_14", 0.5 * (l.v + lag(l.v, 2) over (partition by x.sym order by x.rn)) as "ADXR_14_2", 100 * s.a as "DMP_14", 100 * s.b as "DMN_14" from x left join s using (sym, rn) left join l on l.sym = x.sym and l.rn = x.rn) """ + _shown_sql(["ADX_14", "ADXR_14_2", "DMP_14", "DMN_14"])


def _mama_sql(fast: float = 0.5, slow: float = 0.05) -> str:
    """The phase of a Hilbert transform: each list holds the last values, newest first, and each level of the step names new ones."""

    def turned(new: str, old: str) -> str:
        return f"scale * (0.0962 * {new} + 0.5769 * {old}[2] - 0.5769 * {old}[4] - 0.0962 * {old}[6])"

    levels = [
        "0.075 * period + 0.54 as scale, 0.4 * close + 0.3 * p1 + 0.2 * p2 + 0.1 * p3 as n_smooth",
        f"{turned('n_smooth', 'smooth')} as n_flat, flat[3] as n_phase",
        f"{turned('n_flat', 'flat')} as n_quad",
        f"0.2 * (n_phase - {turned('n_quad', 'quad')}) + 0.8 * i2 as n_i, 0.2 * (n_quad + {turned('n_phase', 'phases')}) + 0.8 * q2 as n_q",
        "0.2 * (n_i * i2 + n_q * q2) + 0.8 * re as n_re, 0.2 * (n_i * q2 + n_q * i2) + 0.8 * im as n_im",
        "case when n_im <> 0 and n_re <> 0 then 360 / atan(n_im / n_re) else 0.0 end as raw",
        "0.2 * least(greatest(greatest(least(raw, 1.5 * period), 0.67 * period), 6.0), 50.0) + 0.8 * period as n_period, case when n_phase <> 0 then atan(n_quad / n_phase) else angle end as n_angle",
        f"least(greatest({fast} / greatest(angle - n_angle, 1.0), {slow}), {fast}) as alpha",
        "mama + alpha * (close - mama) as n_mama",
    ]
    step = "select x.*, s.smooth, s.flat, s.quad, s.phases, s.period, s.i2, s.q2, s.re, s.im, s.angle, s.mama, s.fama from s join x on x.sym = s.sym and x.rn = s.rn + 1"
    for level in levels:
        step = f"select *, {level} from ({step})"
    kept = ", ".join(f"list_prepend(n_{new}, {old})[1:6]" for new, old in (("smooth", "smooth"), ("flat", "flat"), ("quad", "quad"), ("phase", "phases")))
    step = f"select sym, rn, {kept}, n_period, n_i, n_q, n_re, n_im, n_angle, n_mama, fama + 0.5 * alpha * (n_mama - fama) from ({step})"
    zeros = "[0.0::double, 0.0, 0.0, 0.0, 0.0, 0.0]"
    names = ("smooth", "flat", "quad", "phases", "period", "i2", "q2", "re", "im", "angle")
    seed = ", ".join(f"{zeros if i < 4 else '0.0::double'} as {n}" for i, n in enumerate(names))
    x = "select *, row_number() over w as rn, lag(close) over w as p1, lag(close, 2) over w as p2, lag(close, 3) over w as p3, count(*) over (partition by sym) as total from bars window w as (partition by sym order by ts)"
    shown = "select x.sym, x.ts, case when x.rn > 3 and x.total >= 6 then coalesce(s.mama, x.close) end as \"MAMA_0_5_0_05\", case when x.rn > 3 and x.total >= 6 then coalesce(s.fama, x.close) end as \"FAMA_0_5_0_05\" from x left join s using (sym, rn)"
    return f"with recursive bars as ({EVENTS}), x as ({x}), s as (select sym, cast(6 as bigint) as rn, {seed}, close as mama, close as fama from x where rn = 6 union all {step}), last_stage as ({shown}) {_shown_sql(['MAMA_0_5_0_05', 'FAMA_0_5_0_05'])}"


FORWARD = f"""with bars as ({ORDERS}), seen as (select sym, ts, row_number() over w as rn, count(*) over (partition by sym) - row_number() over w as left_, max(ts) over (partition by sym) as last,
(max(high) over a + min(low) over a + max(high) over b + min(low) over b) / 4 as one, (max(high) over c + min(low) over c) / 2 as two from bars window w as (partition by sym order by ts), a as (partition by sym order by ts rows 8 preceding), b as (partition by sym order by ts rows 25 preceding), c as (partition by sym order by ts rows 51 preceding)),
last_stage as (select sym, last + to_days(cast(26 - left_ as integer)) as ts, case when rn >= 52 then one end as "ISA_9", case when rn >= 52 then two end as "ISB_52" from seen where left_ < 26) """ + _shown_sql(["ISA_9", "ISB_52"])

FACTORS = {
    "cdl_engulfing_factors": ("CDL_ENGULFING", "case when r0 > 0 and r1 > 0 and b0 >= 0.1 * r0 and b1 >= 0.1 * r1 and r0 - b0 <= 0.9 * r0 and r1 - b1 <= 0.9 * r1 then case when c1 < o1 and close > open and open <= c1 and close >= o1 then 1.0 when c1 > o1 and close < open and open >= c1 and close <= o1 then -1.0 else 0.0 end else 0.0 end"),
    "cdl_eveningstar_factors": ("CDL_EVENINGSTAR", "case when r0 > 0 and r1 > 0 and r2 > 0 and c2 > o2 and b1 <= 0.6 * r1 and l1 > h2 and close < open and close <= o2 + 0.5 * (c2 - o2) then -1.0 else 0.0 end"),
    "cdl_hikkake_ahead": ("CDL_HIKKAKE", "case when rn + 5 <= n and h1 < h2 and l1 > l2 then case when low < l1 and high <= h1 and top5 > h1 then 1.0 when high > h1 and low >= l1 and bottom5 < l1 then -1.0 else 0.0 end else 0.0 end"),
}


def _factors_sql(name: str) -> str:
    output, value = FACTORS[name]
    lags = ", ".join(f"lag({c}, {k}) over w as {c[0]}{k}" for c in ("open", "high", "low", "close") for k in (1, 2))
    shapes = "high - low as r0, abs(close - open) as b0, h1 - l1 as r1, abs(c1 - o1) as b1, h2 - l2 as r2"
    ahead = "max(high) over f as top5, min(low) over f as bottom5, row_number() over w as rn, count(*) over (partition by sym) as n"
    return f"with bars as ({EVENTS}), lagged as (select *, {lags}, {ahead} from bars window w as (partition by sym order by ts), f as (partition by sym order by ts rows between 1 following and 5 following)), shaped as (select *, {shapes} from lagged), last_stage as (select sym, ts, cast(coalesce({value}, 0) as double) as {output} from shaped) {_shown_sql([output])}"


#: Moving averages by name that are finite windows.
AVERAGES = {n: windows.INDICATORS[n](10) for n in ("sma", "wma", "fwma", "pwma", "sinwma", "swma", "trima", "hma", "linreg", "midpoint")}


def _average_sql(name: str) -> str:
    i = AVERAGES[name]
    return f'select sym, ts, "{i.outputs[0]}" as "MA_{name}" from ({_staged_sql("events", i.duck or i.stages, i.outputs)})'


def _zigzag(spark: SparkSession, d: str) -> DataFrame:
    return _shown(structure.zigzag(sources.events_hourly(spark, d), "sym", "ts"), ["is_peak", "is_valley"])


def _zigzag_flat(spark: SparkSession, d: str) -> DataFrame:
    """Whole prices, so that tops are flat now and then."""
    bars = sources.events_hourly(spark, d).withColumns({c: F.round(c) for c in ("high", "low")})
    return _shown(structure.zigzag(bars, "sym", "ts", plateau_size=3), ["is_peak", "is_valley"])


def _market_structure(spark: SparkSession, d: str) -> DataFrame:
    flagged = structure.zigzag(sources.events_hourly(spark, d), "sym", "ts")
    return _shown(structure.market_structure(flagged, "sym", "ts"), ["structure_label", "trend_direction"])


def _order_blocks(bars=sources.orders_daily, **how) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = order_blocks.order_blocks(bars(spark, d), "sym", "ts", order_blocks.OrderBlockConfig(**how))
        times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "break", "retest")]
        numbers = [F.round(c, 6).alias(c) for c in ("zone_low", "zone_high", "strength")]
        return found.select("sym", "id", "block_type", *times, *numbers, "structure_label", "trend_direction")

    return run


def _order_zones(spark: SparkSession, d: str) -> DataFrame:
    """A tolerance that lets every swing pass, as hourly prices of events jump."""
    found = zones.order_zones(sources.events_hourly(spark, d), "sym", "ts", lookback=8, min_reaction_size=0.0, liquidity_tolerance=1e9)
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "break", "retest")]
    return found.select("sym", "block_type", *times, F.round("zone_low", 6).alias("zone_low"), F.round("zone_high", 6).alias("zone_high"))


def _tops_sql(column: str) -> str:
    """Middles of the level runs with lower neighbours."""
    return f"""(select sym, (min(rn) + max(rn)) // 2 as rn, lag(v) over r < v and lead(v) over r < v as top from (select sym, rn, v, sum(turn) over (partition by sym order by rn) as run from (select sym, rn, {column} as v, case when {column} = lag({column}) over w then 0 else 1 end as turn from x window w as (partition by sym order by rn))) group by sym, run, v window r as (partition by sym order by run))"""


ORDER_ZONES = f"""with recursive bars as ({EVENTS}), x as (select *, row_number() over w as rn, lag(close) over w as p, case when count(*) over v = 20 then avg(volume) over v end as mean, count(*) over l = 10 as near from bars window w as (partition by sym order by ts), v as (partition by sym order by ts rows 19 preceding), l as (partition by sym order by ts rows 9 preceding)),
t as (select sym, rn, greatest(high - low, abs(high - p), abs(low - p)) as tr from x where rn > 1),
s as (select sym, cast(15 as bigint) as rn, avg(tr) as atr from t where rn <= 15 group by sym having count(*) = 14 union all select t.sym, t.rn, (13 * s.atr + t.tr) / 14 from s join t on t.sym = s.sym and t.rn = s.rn + 1),
peaks as (select sym, rn from {_tops_sql('high')} where top), valleys as (select sym, rn from {_tops_sql('low')} where top),
swings as (select sym, rn, 'supply' as block_type from peaks union all select sym, rn, 'demand' from valleys anti join peaks using (sym, rn)),
zones as (select a.sym, a.rn, block_type, x.ts as start, b.ts as break, b.rn as b_rn, x.close - atr as zone_low, x.close + atr as zone_high from swings a join x using (sym, rn) join s using (sym, rn) join x b on b.sym = a.sym and b.rn = a.rn + 8 where x.near and b.volume > b.mean and case block_type when 'supply' then b.low < x.low else b.high > x.high end),
tests as (select z.*, j.ts as retest from zones z join x j on j.sym = z.sym and j.rn between z.b_rn + 1 and z.b_rn + 9 where j.volume > j.mean and case block_type when 'supply' then j.low between zone_low and zone_high and (zone_low - j.close) / nullif(zone_low, 0) >= 0 else j.high between zone_low and zone_high and (j.close - zone_high) / nullif(zone_high, 0) >= 0 end)
select sym, block_type, strftime(start, '%Y-%m-%d %H:%M:%S') as start, strftime(any_value(break), '%Y-%m-%d %H:%M:%S') as "break", strftime(min(retest), '%Y-%m-%d %H:%M:%S') as retest, round(any_value(zone_low), 6) as zone_low, round(any_value(zone_high), 6) as zone_high from tests group by sym, block_type, start"""


def _ott_signals(spark: SparkSession, d: str) -> DataFrame:
    request = recursive.INDICATORS["ott"]()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(request).df
    return _shown(signals.ott_signals(frame, "sym", "ts", "close", request.outputs[4], request.outputs[0]), ["signal"])


def _last_ott_signal(spark: SparkSession, d: str) -> DataFrame:
    request = recursive.INDICATORS["ott"]()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(request).df
    return signals.last_ott_signal(signals.ott_signals(frame, "sym", "ts", "close", request.outputs[4], request.outputs[0]), "sym", "ts")


def _clouds(spark: SparkSession, d: str) -> DataFrame:
    request = recursive.INDICATORS["rsi_clouds"]()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(request).df
    return signals.clouds_signals(frame, "sym", "ts", *request.outputs[1:])


def _clouds_signals(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_clouds(spark, d), ["macd_cross", "hist_cross"])


def _last_clouds_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.last_clouds_signal(_clouds(spark, d), "sym", "ts")


def _cycle(spark: SparkSession, d: str) -> DataFrame:
    request = recursive.INDICATORS["scrsi"]()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(request).df
    return signals.cycle_signals(frame, "sym", "ts", request.outputs[1])


def _scrsi_signals(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_cycle(spark, d), ["buy", "sell"])


def _last_scrsi_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.last_cycle_signal(_cycle(spark, d), "sym", "ts")


def _band_signals(spark: SparkSession, d: str) -> DataFrame:
    i = windows.accbands()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").finite(i).df
    return _shown(signals.band_signal(frame, "sym", "ts", i.outputs[0], i.outputs[2]), ["buy", "sell"])


def _band_sql() -> str:
    i = windows.accbands()
    up, low = i.outputs[0], i.outputs[2]
    last = {"buy": f"coalesce(close < {up} and lag(close) @O > {up}, false)", "sell": f"coalesce(close > {low} and lag(close) @O < {low}, false)"}
    sql = _staged_sql("events", (*i.stages, last), ["buy", "sell"])
    return sql[: sql.rindex("select sym, strftime")] + _shown_sql(["buy", "sell"], f"stage_{len(i.stages)}", ["buy", "sell"])


def _last_avsl(spark: SparkSession, d: str) -> DataFrame:
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(recursive.INDICATORS["avsl_older"]()).df
    return signals.last_value(frame, "sym", "ts", "avsl").select("sym", (F.round("avsl", 6) + 0.0).alias("avsl"))


def _trend_gate(spark: SparkSession, d: str) -> DataFrame:
    request = recursive.INDICATORS["adx"]()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(request).df
    return signals.trend_gate(frame, "sym", "ts", request.outputs[0], 20)


def _stochastic_signals(spark: SparkSession, d: str) -> DataFrame:
    request = recursive.INDICATORS["stochrsi"]()
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").recursive(request).df
    return _shown(signals.stochastic_cross(frame, "sym", "ts", *request.outputs), ["buy", "sell"])


def _strategy(spark: SparkSession, d: str) -> DataFrame:
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").finite(windows.sma(10), windows.bbands(20)).df
    named = {"close": "close", "sma": "SMA_10", "bb.lower": "BBL_20_2_2", "bb.upper": "BBU_20_2_2"}
    return _shown(signals.strategy_signals(frame, named, "close > sma and not close > bb.upper", "close < bb.lower or close < sma * 0.5"), ["entry", "exit"])


def _strategy_sql() -> str:
    stages = (*windows.sma(10).stages, *windows.bbands(20).stages, {"entry": "coalesce(close > SMA_10 and not close > BBU_20_2_2, false)", "exit": "coalesce(close < BBL_20_2_2 or close < SMA_10 * 0.5, false)"})
    sql = _staged_sql("events", stages, ["entry"])
    return sql[: sql.rindex("select sym, strftime")] + _shown_sql(["entry", "exit"], f"stage_{len(stages) - 1}", ["entry", "exit"])


#: A strategy that names its own indicators.
STRATEGY = """{"indicators": {"rsi": {"type": "RSI", "length": 14}, "mean": {"type": "SMA", "length": 10}, "top": {"type": "EMA", "source": "high", "length": 10}},
"entry": {"long": ["rsi.value < 45", "price > mean.sma"]}, "exit": {"long": ["rsi.rsi > 55 or price > top.value", "not price < mean.value"]}}"""


def _strategy_text(spark: SparkSession, d: str) -> DataFrame:
    frame = strategy.apply(BarFrame(sources.events_hourly(spark, d), "sym", "ts"), strategy.parse(STRATEGY))
    return _shown(frame.df, ["entry_long", "exit_long"])


def _bars(source: str) -> Query:
    return lambda spark, d: _shown(SOURCES[source][0](spark, d), ["open", "high", "low", "close", "volume"])


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    out = sources.resample(sources.orders_daily(spark, d), "sym", "ts", "M").withColumnRenamed("period", "ts")
    return _shown(out, ["open", "high", "low", "close", "volume"])


MONTHLY = f"with bars as ({ORDERS}), last_stage as (select sym, date_trunc('month', ts) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from bars group by 1, 2) " + _shown_sql(["open", "high", "low", "close", "volume"])


def _forward(spark: SparkSession, d: str) -> DataFrame:
    return _shown(levels.ichimoku_forward(sources.orders_daily(spark, d), "sym", "ts"), ["ISA_9", "ISB_52"])


def _tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 bars of each series (the feature is a tail)."""
    return _shown(BarFrame(sources.events_hourly(spark, d), "sym", "ts").tail(50), ["close"])


def _shifted(spark: SparkSession, d: str) -> DataFrame:
    frame = BarFrame(sources.events_hourly(spark, d), "sym", "ts").finite(windows.sma(10)).shifted(["SMA_10"], 3, 0.0)
    return _shown(frame.df, ["SMA_10"])


def _trimmed(spark: SparkSession, d: str) -> DataFrame:
    return _shown(BarFrame(sources.events_hourly(spark, d), "sym", "ts").finite(windows.sma(10)).trimmed(["SMA_10"]), ["SMA_10"])


def _average(name: str) -> Query:
    return _recursive(recursive.Recursive((f"MA_{name}",), ("close",), lambda x: recursive.k.moving_average(name, x, 10)))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"bars_{s}": _bars(s) for s in SOURCES}
    out |= {name: _finite(*spec) for name, spec in FINITE.items()}
    out |= {name: _recursive(make()) for name, make in recursive.INDICATORS.items()}
    out |= {f"ott_{m.lower()}": _recursive(recursive.INDICATORS["ott"](5, 1.4, m)) for m in ("SMA", "EMA", "WMA", "TMA", "WWMA", "ZLEMA", "TSF")}
    out |= {"macd_as": _recursive(recursive.INDICATORS["macd"](asmode=True)), "ssf_everget": _recursive(recursive.INDICATORS["ssf"](everget=True)), "adx_ahead": _recursive(recursive.INDICATORS["adx"](tvmode=True)), "atr_percent": _recursive(recursive.INDICATORS["atr"](percent=True))}
    out |= {f"ma_{name}": _average(name) for name in recursive.k.AVERAGES}
    out |= {f"cdl_{name}": _pattern([name]) for name in patterns.PATTERNS}
    out |= {"cdl_all_strict": _pattern(list(patterns.PATTERNS), True), "cdl_all_symmetric": _pattern(list(patterns.PATTERNS), False, True)}
    out |= {f"pivots_{m}": _pivots(m, "M") for m in levels.METHODS}
    out |= {"pivots_weekly": _pivots("classic", "W"), "pivots_daily": _pivots("classic", "D"), "pivots_yearly": _pivots("classic", "Y"), "pivots_forward": _pivots("traditional", "M", "forward")}
    out |= {"resample_monthly": _monthly, "ichimoku_forward": _forward, "tail": _tail, "offset_fillna": _shifted, "trim": _trimmed}
    # the default look-back finds nothing in the daily orders of the smallest tables, so hourly events stand in there
    out |= {"order_blocks": _order_blocks(lookback_max=8), "order_blocks_default": _order_blocks(sources.events_hourly)}
    blocks = {"order_blocks_all_breakouts": {"check_breaker": True, "use_market_structure_filter": True}, "order_blocks_clustered": {"cluster_blocks": True, "cluster_price_tolerance": 0.05}}
    for name, how in blocks.items():
        out |= {name: _order_blocks(multiple_breakouts=True, **how), f"{name}_short": _order_blocks(lookback_max=8, multiple_breakouts=True, **how)}
    out |= {"zigzag": _zigzag, "zigzag_flat": _zigzag_flat, "order_zones": _order_zones, "market_structure": _market_structure, "ott_signals": _ott_signals, "last_ott_signal": _last_ott_signal, "rsi_clouds_signals": _clouds_signals, "last_rsi_clouds_signal": _last_clouds_signal, "scrsi_signals": _scrsi_signals, "last_scrsi_signal": _last_scrsi_signal, "strategy_text": _strategy_text, "last_avsl": _last_avsl, "acceleration_bands_signals": _band_signals, "adx_trend": _trend_gate, "stochrsi_signals": _stochastic_signals, "strategy_dsl": _strategy}
    modes = {"apo_ema": windows.apo(mamode="ema"), "bias_ema": windows.bias(mamode="ema"), "bbands_ema": windows.bbands(mamode="ema"), "accbands_ema": windows.accbands(mamode="ema"), "hma_ema": windows.hma(mamode="ema"), "hilo_ema": windows.hilo(mamode="ema"), "stochf_ema": windows.stochf(mamode="ema"), "doji_naive": windows.doji(naive=True)}
    out |= {name: _finite(i, "events") for name, i in modes.items()}
    out |= {"cdl_engulfing_factors": _pattern(["engulfing"], True, min_body_factor=0.1, max_shadow_factor=0.9), "cdl_eveningstar_factors": _pattern(["eveningstar"], min_body_factor=0.6), "cdl_hikkake_ahead": _pattern(["hikkake"], lookahead=5)}
    return out


def oracle_sql() -> dict[str, str]:
    prices = ["open", "high", "low", "close", "volume"]
    out = {f"bars_{s}": f"with last_stage as ({sql}) {_shown_sql(prices)}" for s, (_, sql) in SOURCES.items()}
    out |= {name: _staged_sql(source, i.duck or i.stages, i.outputs) for name, (i, source) in FINITE.items() if name not in finite_sql.FINITE}
    out |= {name: finite_sql.sql(SOURCES[FINITE[name][1] if name in FINITE else "events"][1], _shown_sql(plain.columns), plain) for name, plain in finite_sql.FINITE.items()}
    out |= {name: _recursion_sql(name) for name in RECURSIONS} | {f"ma_{name}": _average_sql(name) for name in AVERAGES}
    out |= {f"cdl_{name}": _pattern_sql([name]) for name in patterns.PATTERNS}
    out |= {"cdl_all_strict": _pattern_sql(list(patterns.PATTERNS), True), "cdl_all_symmetric": _pattern_sql(list(patterns.PATTERNS), False, True)}
    out |= {f"pivots_{m}": _pivots_sql(m, "M") for m in levels.METHODS}
    out |= {"pivots_weekly": _pivots_sql("classic", "W"), "pivots_daily": _pivots_sql("classic", "D"), "pivots_yearly": _pivots_sql("classic", "Y"), "pivots_forward": _pivots_sql("traditional", "M", "forward")}
    kinds, sides = ("price_cross", "support_cross", "color_change"), ("buy", "sell")
    out |= {"ott_signals": _ott_signals_sql([f"{a}_{b}" for a in sides for b in kinds], False), "last_ott_signal": _ott_signals_sql([f"{a}_{b}" for b in kinds for a in sides], True)}
    out |= {"stochrsi": f"{_stochastic_tables()} {_shown_sql(['STOCHRSIk_14_14_3_3', 'STOCHRSId_14_14_3_3'], 'stochastic')}", "stochrsi_signals": _stochastic_signals_sql()}
    out |= {"rsi_clouds_signals": f"{_clouds_tables()} {_shown_sql(['macd_cross', 'hist_cross'], 'crosses', ['macd_cross', 'hist_cross'])}", "last_rsi_clouds_signal": _last_sql(_clouds_tables(), "case macd_cross when 1 then 'buy' when -1 then 'sell' end")}
    out |= {"scrsi_signals": f"{_cycle_tables()} {_shown_sql(['buy', 'sell'], 'crosses', ['buy', 'sell'])}", "last_scrsi_signal": _last_sql(_cycle_tables(), "case when buy = 1 then 'long' when sell = 1 then 'short' end")}
    out |= {"zigzag": f"{_zigzag_tables()} {_shown_sql(['is_peak', 'is_valley'], plain=['is_peak', 'is_valley'])}", "market_structure": _market_structure_sql(), "ichimoku_forward": FORWARD}
    out |= {name: _factors_sql(name) for name in FACTORS}
    out |= {"order_blocks": _order_blocks_sql("orders", 8), "order_blocks_default": _order_blocks_sql("events", 50)}
    out |= {"adx_ahead": ADX_AHEAD, "mama": _mama_sql()}
    out["last_avsl"] = finite_sql.sql(EVENTS, 'select sym, round(arg_max(case when avsl is null then null else avsl end, ts), 6) + 0.0 as avsl from last_stage group by sym', finite_sql.FINITE["avsl_older"])
    out["doji_naive"] = f"with bars as ({EVENTS}), last_stage as (select sym, ts, cast(case when abs(open - close) < 0.1 * (high - low) then 100 else 0 end as double) as \"CDL_DOJI_10_10\" from bars) {_shown_sql(['CDL_DOJI_10_10'])}"
    out["adx_trend"] = f"{_recursion_tables('adx')} select sym, trunc(arg_max(ADX_14, ts)) >= 20 as trending from last_stage group by sym"
    out |= {"resample_monthly": MONTHLY, "order_zones": ORDER_ZONES, "acceleration_bands_signals": _band_sql(), "strategy_dsl": _strategy_sql()}
    sma = windows.sma(10)
    out["tail"] = f"with bars as ({EVENTS}), last_stage as (select * from bars qualify row_number() over (partition by sym order by ts desc) <= 50) {_shown_sql(['close'])}"
    out["offset_fillna"] = _staged_sql("events", ({"x": sma.stages[0]["SMA_10"]}, {"SMA_10": "coalesce(lag(x, 3) @O, 0.0)"}), ["SMA_10"])
    out["trim"] = _staged_sql("events", sma.stages, ["SMA_10"]) + " where SMA_10 is not null"
    return out


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    """Averages, bands and an oscillator over hourly bars, in one plan."""
    frame = BarFrame(sources.events_hourly(spark, directory), "sym", "ts").finite(windows.sma(10), windows.bbands(20)).recursive(recursive.INDICATORS["rsi"](), recursive.INDICATORS["macd"]())
    return frame.df


