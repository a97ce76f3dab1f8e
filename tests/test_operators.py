import datetime as dt
import math

import numpy as np
import pytest

from tallybar.frame import BarFrame
from tallybar.functions import patterns, signals, windows
from tallybar.operators import kernels as k
from tallybar.operators import levels, order_blocks, recursive, structure, zones
from tallybar.sources import bars as sources
from tallybar.streaming import bars as streams

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    close = 100 + np.cumsum(rng.normal(size=300))
    open_ = close + rng.normal(size=300) * 0.5
    high, low = np.maximum(open_, close) + rng.random(300), np.minimum(open_, close) - rng.random(300)
    return open_, high, low, close, rng.integers(1, 50, 300).astype(float)


def table(spark, bars, key="a"):
    rows = [(key, DAY + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(zip(*bars, strict=True))]
    return spark.createDataFrame(rows, "sym string, ts timestamp, open double, high double, low double, close double, volume double")


def seeded(x, n, alpha):
    out = [math.nan] * len(x)
    out[n - 1] = sum(x[:n]) / n
    for i in range(n, len(x)):
        out[i] = alpha * x[i] + (1 - alpha) * out[i - 1]
    return np.array(out)


def test_averages(walk):
    x = walk[3]
    assert np.allclose(k.ema(x, 10), seeded(x, 10, 2 / 11), equal_nan=True)
    assert np.allclose(k.rma(x, 10), seeded(x, 10, 0.1), equal_nan=True)
    second = k.ema(k.ema(x, 5)[4:], 5)
    assert np.allclose(k.dema(x, 5)[4:], 2 * k.ema(x, 5)[4:] - second, equal_nan=True)
    assert np.allclose(k.linear_forecast(x, 14, 14)[13], np.polyval(np.polyfit(range(1, 15), x[:14], 1), 14))
    assert np.allclose(k.t3(np.full(60, 5.0), 5)[-1], 5.0)


@pytest.mark.parametrize("name", sorted(k.AVERAGES))
def test_average_of_a_constant(name):
    out = k.moving_average(name, np.full(80, 100.0), 10)
    known = out[~np.isnan(out)]
    assert len(known) >= 20 and np.allclose(known, 100.0)


@pytest.mark.parametrize("name", sorted(recursive.INDICATORS))
@pytest.mark.parametrize("n", [0, 1, 5, 14, 15])
def test_short_series(name, n):
    request = recursive.INDICATORS[name]()
    x = np.linspace(10, 20, n)
    out = request.kernel(*([x] * len(request.inputs)))
    out = out if isinstance(out, tuple) else (out,)
    assert len(out) == len(request.outputs) and all(len(o) == n for o in out)


def test_rsi_and_atr_warm_up(walk):
    open_, high, low, close, _ = walk
    r = k.rsi(close, 14)
    assert np.isnan(r[:13]).all() and not np.isnan(r[13:]).any() and ((r[13:] >= 0) & (r[13:] <= 100)).all()
    a = k.atr(high, low, close, 14)
    assert np.isnan(a[:14]).all() and not np.isnan(a[14:]).any()
    assert np.allclose(k.rsi(np.arange(30.0), 5)[4:], 100) and np.isnan(k.rsi(np.full(30, 1.0), 5)).all()
    line, trigger, rest = k.macd(close)
    assert np.isnan(line[:25]).all() and np.isnan(trigger[:33]).all() and not np.isnan(trigger[33:]).any()
    assert np.allclose(rest[33:], line[33:] - trigger[33:])


def test_state_machines():
    path = np.array([100, 101, 106, 104, 100, 99, 110, 111.0])
    assert k.kagi(path, 5).tolist() == [0, 0, 1, 1, -1, -1, 1, 1]
    assert k.renko(path, 5).tolist() == [0, 0, 1, 0, -1, 0, 1, 0]
    assert k.point_and_figure(path, 2, 3).tolist() == [0, 0, 1, 1, -1, -1, 1, 1]
    mean, long, short, way, line = k.ott(path, 2, 1.4, "SMA")
    assert (np.diff(long[1:]) >= 0).all() and (np.diff(short[1:]) <= 0).all() and set(way) <= {1, -1}
    trend, way, lo, hi = k.supertrend(path + 1, path - 1, path, 2, None, 1.0)
    assert ((way == 1) == ~np.isnan(lo)).all() and ((way == -1) == ~np.isnan(hi)).all()


def test_unknown_names():
    path = np.array([1.0, 4.0, 2.0, 8.0, 5.0])
    np.testing.assert_array_equal(k.moving_average("nope", path, 2), k.ema(path, 2))
    np.testing.assert_array_equal(k.moving_average(None, path, 2), k.ema(path, 2))
    with pytest.raises(ValueError):
        k.ott(np.ones(5), 2, 1.4, "nope")


def test_statistics(spark, walk):
    frame = BarFrame(table(spark, walk), "sym", "ts").finite(windows.skew(30), windows.kurtosis(30), windows.mad(30), windows.entropy(10), windows.stdev(30), windows.zscore(30))
    got = frame.df.orderBy("ts").toPandas()
    x = walk[3][-30:]
    m, s = x.mean(), x.std(ddof=1)
    assert np.isclose(got["MAD_30"].iloc[-1], np.abs(x - m).mean()) and np.isclose(got["STDEV_30"].iloc[-1], s)
    assert np.isclose(got["SKEW_30"].iloc[-1], 30 / (29 * 28) * (((x - m) / s) ** 3).sum())
    m2, m4 = ((x - m) ** 2).sum(), ((x - m) ** 4).sum()
    assert np.isclose(got["KURT_30"].iloc[-1], (30 * 31 * m4 - 3 * 29 * m2 * m2) / (28 * 27 * m2 * m2))
    p = walk[3][-10:] / walk[3][-10:].sum()
    assert np.isclose(got["ENTP_10"].iloc[-1], -(p * np.log2(p)).sum())
    assert got["SKEW_30"].isna().sum() == 29


def test_windows_stay_inside_a_series(spark, walk):
    both = table(spark, walk, "a").unionByName(table(spark, walk, "b"))
    got = BarFrame(both, "sym", "ts").finite(windows.sma(10)).recursive(recursive.INDICATORS["ema"](10)).df.toPandas()
    a, b = (got[got.sym == s].sort_values("ts") for s in "ab")
    for c in ("SMA_10", "EMA_10"):
        assert np.allclose(a[c], b[c], equal_nan=True) and a[c].isna().sum() == 9


def test_frame_checks(spark, walk):
    df = table(spark, walk)
    with pytest.raises(ValueError):
        BarFrame(df, "sym", "when")
    odd = spark.createDataFrame([("a", "2024-01-01", float("nan")), ("a", "2024-01-02", 2.0), ("a", "2024-01-03", float("inf"))], "sym string, ts string, close_price double")
    frame = BarFrame(odd, "sym", "ts", {"close": "close_price"})
    assert [r.close for r in frame.df.orderBy("ts").collect()] == [None, 2.0, None] and frame.df.schema["ts"].dataType.simpleString() == "timestamp"
    assert [r.close for r in frame.fill("both").df.orderBy("ts").collect()] == [2.0, 2.0, 2.0]
    assert [r.close for r in frame.fill("ffill").df.orderBy("ts").collect()] == [None, 2.0, 2.0]
    with pytest.raises(Exception, match="missing values"):
        frame.fill("raise").df.collect()


def hit(spark, name, *bars, **how):
    o, h, l, c = zip(*bars, strict=True)
    df = table(spark, (o, h, l, c, [1.0] * len(o)))
    return [r[f"CDL_{name.upper()}"] for r in BarFrame(df, "sym", "ts").patterns(name, **how).df.orderBy("ts").collect()]


def test_patterns(spark):
    assert hit(spark, "engulfing", (10, 10.5, 8.5, 9), (8.8, 11.2, 8.7, 11)) == [0.0, 1.0]
    assert hit(spark, "engulfing", (9, 10.5, 8.5, 10), (10.2, 10.4, 8.0, 8.5)) == [0.0, -1.0]
    assert hit(spark, "marubozu", (10, 20, 10, 20)) == [1.0] and hit(spark, "marubozu", (12, 20, 10, 18)) == [0.0]
    assert hit(spark, "3whitesoldiers", (10, 12, 9, 11), (10.5, 13, 10, 12), (11.5, 14, 11, 13)) == [0.0, 0.0, 1.0]
    falling = [(13, 13.5, 11, 12), (12.5, 12.6, 10, 11), (11.5, 11.6, 9, 10)]
    assert hit(spark, "3whitesoldiers", *falling) == [0.0] * 3 and hit(spark, "3whitesoldiers", *falling, symmetric=True)[2] == -1.0
    assert hit(spark, "inside", (10, 12, 8, 11), (10, 11, 9, 10)) == [0.0, 1.0]
    assert hit(spark, "hikkake", (10, 12, 8, 11), (10, 11, 9, 10), (10, 11.5, 9.5, 11), (9, 10, 8.5, 9), (9, 10, 9, 9), (9, 10, 9, 9)) == [0.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    assert hit(spark, "tristar", (10, 11, 9, 10), (12, 13, 11.5, 12), (10, 11, 9, 10)) == [0.0, 0.0, 1.0]
    assert len(patterns.PATTERNS) == 61


def test_as_of(spark):
    left = spark.createDataFrame([("a", i, float(i)) for i in range(6)] + [("b", 1, 1.0)], "sym string, ts bigint, close double")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0)], "sym string, ts bigint, level double")
    back = {(r.sym, r.ts): r.level for r in sources.as_of(left, right, "sym", "ts", ["level"]).collect()}
    assert [back["a", i] for i in range(6)] == [None, 10, 10, 10, 40, 40] and back["b", 1] is None
    ahead = {(r.sym, r.ts): r.level for r in sources.as_of(left, right, "sym", "ts", ["level"], "forward").collect()}
    assert [ahead["a", i] for i in range(6)] == [10, 10, 40, 40, 40, None]


def test_pivots_do_not_look_ahead(spark, walk):
    df = table(spark, walk)
    got = levels.pivots(df, "sym", "ts", "classic", "M").orderBy("ts").toPandas()
    jan = got[got.ts < "2024-02-01"]
    assert jan["PIVOTS_CLAS_M_P"].isna().all()
    want = (jan["high"].max() + jan["low"].min() + jan["close"].iloc[-1]) / 3
    assert np.allclose(got[(got.ts >= "2024-02-01") & (got.ts < "2024-03-01")]["PIVOTS_CLAS_M_P"], want)
    with pytest.raises(ValueError):
        levels.pivots(df, "sym", "ts", "nope")


def test_ichimoku_forward(spark, walk):
    got = levels.ichimoku_forward(table(spark, walk), "sym", "ts").orderBy("ts").toPandas()
    assert len(got) == 26 and got["ts"].iloc[0] == DAY + dt.timedelta(days=300)
    assert np.isclose(got["ISB_52"].iloc[-1], (walk[1][-52:].max() + walk[2][-52:].min()) / 2)


def test_peaks():
    x = np.array([0, 3, 1, 5, 2, 4, 0, 1, 0.0])
    assert structure.peaks(x).tolist() == [1, 3, 5, 7]
    assert structure.peaks(x, prominence=2).tolist() == [1, 3, 5]
    assert structure.peaks(x, distance=3).tolist() == [3, 5]
    flat = np.array([0, 1, 4, 4, 4, 1, 0, 2, 5, 5, 1, 0.0])
    assert structure.peaks(flat).tolist() == []
    assert structure.peaks(flat, plateau_size=0).tolist() == [3]
    assert structure.peaks(flat, plateau_size=4).tolist() == []
    assert structure.peaks(np.array([0.0, 0, 0, 0, 1, 0]), plateau_size=0).tolist() == [2, 4]


def test_adx_ahead(walk):
    _, high, low, close, _ = walk
    n, signal = 14, 5
    line, _, plus, minus = k.adx(high, low, close, n, signal, tvmode=True)
    unit, move = k.atr(high, low, close, n), np.zeros((2, len(close)))
    for i in range(1, len(close)):
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        move[0, i], move[1, i] = up if up > down and up > 0 else 0, down if down > up and down > 0 else 0
    first = int(np.flatnonzero(unit > 0)[0])
    for got, m in zip((plus, minus), move, strict=True):
        want = [math.nan] * first + [100 * m[first - n + 1 : first + 1].sum() / unit[first]]
        for i in range(first + 1, len(close)):
            want.append(100 * m[i] / unit[i] / n + (1 - 1 / n) * want[-1])
        np.testing.assert_allclose(got, want, rtol=1e-9)
    dx = 100 * np.abs(plus - minus) / (plus + minus)
    want = dx[2 * n : 2 * n + signal].mean()
    for i in range(n + signal - 1, len(close) - n):
        want = want if i == n + signal - 1 else dx[i + n] / signal + (1 - 1 / signal) * want
        assert abs(line[i] - want) < 1e-9
    assert np.isnan(line[: n + signal - 1]).all() and np.isnan(line[len(close) - n :]).all()


def test_conditions(spark):
    df = spark.createDataFrame([("a", 1, 25.0, 1.0), ("a", 2, 50.0, -1.0), ("a", 3, None, 1.0)], "sym string, ts bigint, rsi double, hist double")
    names = {"rsi": "rsi", "macd.hist": "hist"}
    got = signals.strategy_signals(df, names, "rsi < 30 and not macd.hist < 0", "rsi / 2 > 20 or -macd.hist > 0").orderBy("ts").collect()
    assert [r.entry for r in got] == [True, False, False] and [r.exit for r in got] == [False, True, False]
    for bad in ("rsi <", "__import__('os')", "rsi.x > 1", "drop > 1", "rsi in (1, 2)"):
        with pytest.raises(ValueError):
            signals.condition(bad, names)


def test_stream(spark, tmp_path):
    rows = [("a", DAY + dt.timedelta(minutes=20 * i), i, float(i % 7)) for i in range(60)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, ts timestamp, id bigint, v double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k string, ts timestamp, id bigint, v double").parquet(source)
    bars = streams.stream_bars(stream, "k", "ts", "v", "id")
    query = bars.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = spark.table("bars").orderBy("ts").collect()
    first = sources.make_bars(spark.read.parquet(source), "k", __import__("pyspark.sql.functions", fromlist=["x"]).date_trunc("hour", "ts"), "v", ["ts", "id"]).orderBy("ts").collect()
    assert len(got) >= 15 and [tuple(r) for r in got] == [tuple(r) for r in first[: len(got)]]


def test_stream_average(spark, tmp_path):
    rows = [("a", DAY + dt.timedelta(hours=i), float(i * i % 11)) for i in range(30)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "sym string, ts timestamp, close double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("sym string, ts timestamp, close double").parquet(source)
    query = streams.stream_average(stream, 5).writeStream.format("memory").queryName("averages").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    got = [r.average for r in spark.table("averages").orderBy("ts").collect()]
    assert np.allclose(np.array(got, dtype=float), k.ema(np.array([r[2] for r in rows]), 5), equal_nan=True)


def mirrored(high, low, close, volume, level=400.0):
    return level - low, level - high, level - close, volume


def test_order_blocks(walk):
    _, high, low, close, volume = walk
    how = {"multiple_breakouts": True, "min_reaction_size": 0.0, "check_breaker": True, "displacement_multiplier": 0.1, "strength_atr_normalize": True}
    cfg = order_blocks.OrderBlockConfig(**how)
    found = order_blocks.Market(high, low, close, volume, cfg).confirm()
    assert len(found) >= 3 and {b.side for b in found} == {1, -1}
    for b in found:
        assert b.start < b.broken < b.retest < b.broken + cfg.confirmation_window and b.zone_low < b.zone_high and 0 <= b.strength <= 10
        if b.side > 0:
            assert low[b.broken] < low[b.start] and b.zone_low <= low[b.retest] <= b.zone_high
        else:
            assert high[b.broken] > high[b.start] and b.zone_low <= high[b.retest] <= b.zone_high
    other = order_blocks.Market(*mirrored(high, low, close, volume), cfg).confirm()
    assert [(b.start, b.broken, b.retest, b.side) for b in found] == [(b.start, b.broken, b.retest, -b.side) for b in other]
    every = order_blocks.OrderBlockConfig(**how, use_adx_filter=True, adx_threshold=5.0, use_market_structure_filter=True, require_fvg=True, fvg_tolerance=1.0, check_orderflow_shift=True, use_rsi_confirmation=True, rsi_overbought=10, rsi_oversold=90, use_macd_confirmation=True, strength_age_penalty=True, strength_log_volume=True, zone_entry_mode="any", require_closure_outside=False)
    assert len(order_blocks.Market(high, low, close, volume, every).confirm()) <= len(found)
    with pytest.raises(ValueError):
        order_blocks.OrderBlockConfig(strength_reaction_cap=20.0)


def test_cluster_of_blocks():
    make = lambda start, low, high, side=1: order_blocks.Block(side, start, start + 1, start + 2, low, high, float(start))
    times = np.array([np.datetime64("2024-01-01") + np.timedelta64(i, "D") for i in range(99)])
    merged = order_blocks.cluster([make(0, 10, 11), make(3, 10.005, 11.005), make(60, 10.006, 11.006), make(4, 10, 11, -1)], times, 0.001, dt.timedelta(days=30))
    assert [(b.side, b.start, b.retest, b.strength) for b in merged] == [(-1, 4, 6, 4.0), (1, 0, 5, 3.0), (1, 60, 62, 60.0)]


def test_find_peaks():
    look = lambda x, **how: zones.find_peaks(np.array(x, dtype=float), zones.PeakSearch(**how)).tolist()
    assert look([]) == look([1, 2]) == look([1, 1, 1]) == look([3, 2, 1]) == look([1, 2, 2]) == []
    assert look([0, 1, 1, 0, 2, 2, 2, 1]) == [1, 5] and look([0, 1, 1, 0, 2, 2, 2, 1], plateau_size=3) == [5]
    x = [0, 2, 1, 3, 0]
    assert look(x, height=2.5) == [3] and look(x, height=(None, 2.5)) == [1] and look(x, threshold=(None, 2)) == [1]
    assert look(x, prominence=1) == [1, 3] and look(x, prominence=1.5) == [3] and look(x, prominence=(0, 2)) == [1]
    assert look(x, width=0.75) == [1, 3] and look(x, width=0.76) == [3] and look(x, width=1.25) == [3] and look(x, width=1.26) == []
    assert look([0, 3, 1, 5, 2, 4, 0], distance=3) == [3] and look([0, 3, 1, 5, 2, 4, 0], distance=2) == [1, 3, 5]
    assert look([9, 0, 4, 3, 3, 5], wlen=3, prominence=1) == [2] and look([9, 0, 4, 3, 3, 5], wlen=3, prominence=2) == []
    assert look([math.nan, 1, 0, 2, math.nan]) == []
    for bad in ({"wlen": 1}, {"distance": 0}):
        with pytest.raises(ValueError):
            look(x, **bad)


def test_order_zones(spark, walk):
    walk = (*(x - 100 for x in walk[:4]), walk[4])  # around zero: above it, the rule as it is confirms next to nothing
    bars = table(spark, walk)
    how = {"lookback": 4, "min_reaction_size": 0.0, "liquidity_tolerance": 2.0}
    got = sorted((r.block_type, r.start, r["break"], r.retest) for r in zones.order_zones(bars, "sym", "ts", **how).collect())
    _, high, low, close, volume = walk
    atr, mean, want, n = k.atr(high, low, close, 14), k.sma(volume, 20), [], len(close)
    tops, swells = (set(zones.find_peaks(x, zones.PeakSearch()).tolist()) for x in (high, low))
    for i in range(9, n - 4):
        down, b = i in tops, i + 4
        near = abs(low[i - 9 : i + 1].min() - low[i]) < 2 if down else abs(high[i - 9 : i + 1].max() - high[i]) < 2
        if (not down and i not in swells) or not near or not volume[b] > mean[b] or not (low[b] < low[i] if down else high[b] > high[i]):
            continue
        lo, hi = close[i] - atr[i], close[i] + atr[i]
        for j in range(b + 1, min(b + 10, n)):
            if lo <= (low[j] if down else high[j]) <= hi and volume[j] > mean[j] and ((lo - close[j]) / lo if down else (close[j] - hi) / hi) >= 0:
                want.append(("supply" if down else "demand", *(DAY + dt.timedelta(days=int(t)) for t in (i, b, j))))
                break
    assert got == sorted(want) and want
    assert zones.order_zones(bars.limit(0), "sym", "ts").count() == 0 and zones.order_zones(bars.limit(5), "sym", "ts").count() == 0
    with pytest.raises(ValueError):
        zones.order_zones(bars, "sym", "ts", confirmation_window=1)
