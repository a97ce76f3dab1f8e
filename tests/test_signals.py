"""Signals over hand-written series that hold ties and every level in each direction; structure and strategies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybar import strategy
from tallybar.frame import BarFrame
from tallybar.functions import signals, windows
from tallybar.operators import kernels, order_blocks, recursive, structure


def series(spark, **columns):
    names = list(columns)
    rows = [("a", i, *(None if v is None else float(v) for v in values)) for i, values in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "sym string, ts int, " + ", ".join(f"{n} double" for n in names))


def column(df, *names):
    rows = df.orderBy("ts").collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_stochastic_crosses_are_strict(spark):
    k = [100, 90, 10, 15, 95, 90, 85, 10, 12, None, 15]
    d = [100, 95, 12, 12, 90, 92, 85, 10, 11, 10, 10]
    got = column(signals.stochastic_cross(series(spark, k=k, d=d), "sym", "ts", "k", "d"), "buy", "sell")
    # a tie before is no cross: not at 1, 8; bar 3 buys, bar 5 sells
    assert [i for i, x in enumerate(got) if x[0]] == [3] and [i for i, x in enumerate(got) if x[1]] == [5]


def test_cloud_crosses(spark):
    line, trigger = [1, 3, 2, 2, 1, 2, 4, None, 5], [2, 2, 2, 1, 2, 2, 3, 3, 3]
    hist = [a - b if a is not None else None for a, b in zip(line, trigger, strict=True)]
    df = signals.clouds_signals(series(spark, l=line, t=trigger, h=hist), "sym", "ts", "l", "t", "h")
    want = [0, 1, 0, 0, -1, 0, 0, 0, 0]
    assert column(df, "macd_cross") == want and column(df, "hist_cross") == want
    assert [r.signal for r in signals.last_clouds_signal(df, "sym", "ts").collect()] == [None]
    assert [r.signal for r in signals.last_clouds_signal(df.where("ts < 5"), "sym", "ts").collect()] == ["sell"]
    assert [r.signal for r in signals.last_clouds_signal(df.where("ts < 2"), "sym", "ts").collect()] == ["buy"]


def test_cycle_levels(spark):
    values = [40, 50, 60, 50, 40, 60, -5, 0, 5, -1, 1, 100, 99, 120, 90, 100, 101, None, 10]
    df = signals.cycle_signals(series(spark, v=values), "sym", "ts", "v")
    got = column(df, "buy", "sell")

    def rule(before, now):
        if before is None or now is None:
            return (0, 0)
        return (int(before < 50 <= now or before <= 0 < now), int(before > 50 >= now or before >= 100 > now))

    assert got == [rule(a, b) for a, b in zip([None, *values], values, strict=False)]
    assert got[1] == (1, 0) and got[3] == (0, 1) and got[8] == (1, 0) and got[12] == (0, 1)
    assert got[6] == (0, 1) and got[9] == (0, 0)  # a fall through 0 alone is no sell, a rise through 100 alone no buy
    assert got[13] == (0, 0)
    last = lambda n: signals.last_cycle_signal(df.where(f"ts <= {n}"), "sym", "ts").first().signal
    assert (last(1), last(3), last(2)) == ("long", "short", None)


def plain_structure(peaks, valleys, high, low, lookback, need):
    """Labels of the last two extremes of each kind, and the trend that the last extremes vote for."""
    if min(len(peaks), len(valleys)) < 2:
        return None, None
    p, v = peaks[-lookback:], valleys[-lookback:]
    if min(len(p), len(v)) < 2:
        return None, None
    up = {1: high[p[-1]] > high[p[-2]], 0: low[v[-1]] > low[v[-2]]}
    recent = [kind for _, kind in sorted([(x, 1) for x in p] + [(x, 0) for x in v])][-need:]
    votes = sum(up[k] for k in recent)
    trend = "up" if votes >= need else "down" if len(recent) - votes >= need else None
    return f"{'HH' if up[1] else 'LH'}/{'HL' if up[0] else 'LL'}", trend


@pytest.mark.parametrize("lookback,need", [(10, 3), (2, 3), (3, 6), (1, 1), (5, 1)])
def test_market_structure(spark, lookback, need):
    rng = np.random.default_rng(lookback)
    n = 120
    high = np.round(np.cumsum(rng.normal(size=n)) + 50, 1)
    low = high - np.round(rng.uniform(0.5, 2, n), 1)
    peak, valley = rng.random(n) < 0.25, rng.random(n) < 0.25
    df = spark.createDataFrame([("a", i, float(high[i]), float(low[i]), bool(peak[i]), bool(valley[i])) for i in range(n)], "sym string, ts int, high double, low double, is_peak boolean, is_valley boolean")
    got = {r.ts: (r.structure_label, r.trend_direction) for r in structure.market_structure(df, "sym", "ts", lookback, need).collect()}
    assert sorted(got) == np.flatnonzero(peak | valley).tolist()
    for at, found in got.items():
        ps, vs = (np.flatnonzero(x[: at + 1]).tolist() for x in (peak, valley))
        assert found == plain_structure(ps, vs, high, low, lookback, need)


def test_market_structure_as_in_order_blocks(spark):
    rng = np.random.default_rng(9)
    close = 100 + np.cumsum(rng.normal(size=300))
    high, low, volume = close + rng.uniform(0, 1, 300), close - rng.uniform(0, 1, 300), rng.uniform(1, 2, 300)
    cfg = order_blocks.OrderBlockConfig()
    market = order_blocks.Market(high, low, close, volume, cfg)
    bars = spark.createDataFrame([("a", i, float(high[i]), float(low[i])) for i in range(300)], "sym string, ts int, high double, low double")
    flags = bars.withColumns({"is_peak": F.col("ts").isin(market.peaks.tolist()), "is_valley": F.col("ts").isin(market.valleys.tolist())})
    rows = structure.market_structure(flags, "sym", "ts", cfg.structure_lookback, cfg.min_structure_extremes).collect()
    assert len(rows) > 10 and all(market.structure(r.ts) == (r.structure_label, r.trend_direction) for r in rows)


@pytest.fixture
def bars(spark):
    rng = np.random.default_rng(4)
    close = 50 + np.cumsum(rng.normal(size=80))
    return spark.createDataFrame([("a", i, float(c), float(c + 1), float(c - 1), float(c + 0.3), 10.0 + i, "kept") for i, c in enumerate(close)], "sym string, ts int, open double, high double, low double, close double, volume double, note string")


@pytest.mark.parametrize("mode", ["ema", "dema", "kama", "T3", "no such average"])
def test_averages_by_name(bars, mode):
    rows = BarFrame(bars, "sym", "ts").finite(windows.bbands(10, mamode=mode), windows.apo(5, 10, mamode=mode), windows.stochf(5, 3, mamode=mode), windows.accbands(10, mamode=mode), windows.hma(9, mode), windows.bias(10, mode), windows.hilo(5, 7, mode)).df.orderBy("ts").collect()
    assert {r.note for r in rows} == {"kept"}
    pick = lambda c: np.array([np.nan if r[c] is None else r[c] for r in rows])
    ma, close = kernels.AVERAGES.get(mode.lower(), kernels.ema), pick("close")
    same = lambda a, b: np.testing.assert_allclose(a, b, rtol=1e-9, equal_nan=True)
    same(pick("BBM_10_2_2"), ma(close, 10))
    same(pick("APO_5_10"), ma(close, 5) - ma(close, 10))
    same(pick("STOCHFd_5_3"), ma(pick("STOCHFk_5_3"), 3))
    same(pick("HMA_9"), ma(2 * ma(close, 4) - ma(close, 9), 3))
    same(pick(f"BIAS_{mode.upper()}_10"), close / ma(close, 10) - 1)
    wide = 4 * (pick("high") - pick("low")) / (pick("high") + pick("low"))
    same(pick("ACCBU_10"), ma(pick("high") * (1 + wide), 10))


def test_kernel_parameters(bars):
    frame = BarFrame(bars, "sym", "ts")
    make = recursive.INDICATORS
    pairs = [("supertrend", {"atr_mamode": "sma"}), ("atrts", {"mamode": "sma", "percent": True}), ("rwi", {"mamode": "sma", "drift": 2}), ("stochrsi", {"mamode": "ema"}), ("crsi", {"rank_length": 20, "scalar": 50.0}), ("rsi_clouds", {"macd_mamode": "sma", "rsi_scalar": 50.0})]
    for name, how in pairs:
        plain, other = (frame.recursive(make[name](**kw)).df.orderBy("ts").collect() for kw in ({"rank_length": 20} if name == "crsi" else {}, how))
        outputs = make[name](**how).outputs
        assert [[r[c] for c in outputs] for r in plain] != [[r[c] for c in outputs] for r in other], name
    filled = frame.recursive(make["crsi"](rank_length=20, normalize=True)).df.orderBy("ts").collect()
    assert filled[0]["CRSI_3_2_20"] == 50.0


def test_doji_forms(bars):
    rows = BarFrame(bars, "sym", "ts").finite(windows.doji(5, 20.0, naive=True, asint=False), windows.doji(5, 10.0, 1.0)).df.collect()
    assert all(r["CDL_DOJI_5_20"] == (abs(r.open - r.close) < 0.2 * (r.high - r.low)) for r in rows)
    assert {r["CDL_DOJI_5_10"] for r in rows} <= {0.0, 1.0}


def test_pattern_factors(spark):
    bars = [(10.0, 10.6, 9.0, 9.8), (9.7, 10.4, 9.4, 10.1), (10.0, 11.0, 9.9, 10.05)]
    df = spark.createDataFrame([("a", i, *b) for i, b in enumerate(bars)], "sym string, ts int, open double, high double, low double, close double")
    got = lambda name, **how: column(BarFrame(df, "sym", "ts").patterns(name, **how).df, f"CDL_{name.upper()}")
    assert got("engulfing") == [0.0, 1.0, 0.0]
    assert got("engulfing", strict=True) == [0.0, 0.0, 0.0] and got("engulfing", strict=True, min_body_factor=0.1, max_shadow_factor=0.9) == [0.0, 1.0, 0.0]
    assert got("engulfing", strict=True, min_body_factor=0.1) == [0.0, 0.0, 0.0]


def test_strategy_text(bars):
    text = """{"indicators": {"rsi": {"type": "RSI", "length": 5}, "ott": {"type": "OTT", "length": 2, "percent": 1.4, "ma_type": "VAR"}, "top": {"type": "sma", "source": "high", "length": 3}},
    "entry": {"long": ["rsi.value < 60", "price > ott.ott"], "short": []}, "exit": {"long": ["price < ott.ott or not rsi.rsi <= 70", "close < top.value"]}, "risk": {}}"""
    out = strategy.apply(BarFrame(bars, "sym", "ts"), strategy.parse(text)).df
    assert out.columns == [*bars.columns, "entry_long", "entry_short", "exit_long"]
    rows = out.orderBy("ts").collect()
    close = np.array([r.close for r in rows])
    rsi, line, top = kernels.rsi(close, 5), kernels.ott(close)[4], kernels.sma(np.array([r.high for r in rows]), 3)
    assert [r.entry_long for r in rows] == ((rsi < 60) & (close > line)).tolist() and all(r.entry_short for r in rows)
    assert [r.exit_long for r in rows] == (((close < line) | (rsi > 70)) & (close < top)).tolist()


@pytest.mark.parametrize("text", ['{"indicators": {"a": {"type": "nothing"}}}', '{"indicators": {"a": {"type": "rsi", "size": 3}}}', '{"indicators": {"close": {"type": "rsi"}}}', '{"enter": {}}'])
def test_wrong_strategies(text):
    with pytest.raises(ValueError):
        strategy.parse(text)


def test_unknown_names_and_code_are_refused(bars):
    for condition in ("b.value > 1", "__import__('os')", "price.real > 1", "[1][0] > 0"):
        with pytest.raises(ValueError):
            strategy.apply(BarFrame(bars, "sym", "ts"), strategy.parse({"entry": {"long": [condition]}}))


def test_reach():
    assert windows.reach(windows.sma(10)) == 9 and windows.reach(windows.trima(10)) == 8 and windows.reach(windows.coppock()) == 23
    assert windows.reach(windows.roc(10)) == 10 and windows.reach(windows.hlc3()) == 0
    assert [windows.reach(i) for i in (windows.ichimoku(), windows.cdl_z_full(), windows.hilo(), windows.apo(mamode="ema"))] == [None] * 4


def test_sliced_windows_are_the_same(spark):
    rng = np.random.default_rng(8)
    rows = [(sym, int(t), *(float(x) for x in rng.uniform(1, 9, 5))) for sym, n in (("long", 900), ("other", 400), ("short", 30), ("one", 1)) for t in np.cumsum(rng.integers(1, 50, n))]
    df = spark.createDataFrame(rows, "sym string, ts long, open double, high double, low double, close double, volume double").selectExpr("sym", "timestamp_seconds(ts * 60) as ts", "open", "high", "low", "close", "volume").repartition(5)
    every = [make() for name, make in windows.INDICATORS.items() if windows.reach(make()) is not None]
    assert len(every) > 40
    every += [windows.ichimoku(), windows.bbands(10, mamode="ema")]
    outputs = [o for i in every for o in i.outputs]
    plain, cut = ({(r.sym, r.ts): r for r in BarFrame(df, "sym", "ts").finite(*every, slices=n).df.collect()} for n in (1, 6))
    assert plain.keys() == cut.keys() and len(plain) == len(rows)
    for at, r in plain.items():
        for o in outputs:
            assert (r[o] is None) == (cut[at][o] is None) and (r[o] is None or abs(r[o] - cut[at][o]) <= 1e-9 * max(1, abs(r[o]))), (at, o)
    plan = BarFrame(df, "sym", "ts").finite(windows.sma(10), slices=6).df._jdf.queryExecution().optimizedPlan().toString()
    assert "__slice" in plan
