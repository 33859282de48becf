"""Windows, as-of joins, grids and ranks on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import features as X
from tidegrid.functions.recursive import ema, macd, recursive_columns, rsi, wilder
from tidegrid.operators import frames as R

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def series(spark, values, ticker="A", name="p"):
    return spark.createDataFrame([(ticker, day(i), v) for i, v in enumerate(values)], f"ticker string, date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def test_returns_and_gaps(spark):
    df = X.with_columns(series(spark, [100.0, 110.0, None, 121.0, 0.0]), {"q": R.positive(F.col("p"))})
    df = X.with_columns(df, {"r1": X.simple_return("q", 1), "r2": X.simple_return("q", 2), "l2": X.log_return("q", 2)})
    assert column(df, "r1") == [None, pytest.approx(0.1), None, None, None]
    assert column(df, "r2") == [None, None, None, pytest.approx(0.1), None]


def test_rolled_needs_cover_and_warm_up(spark):
    values = [float(i) for i in range(1, 13)]
    values[3] = None
    df = series(spark, values).withColumn("m", R.rolled(F.avg("p"), F.col("p"), 10, warm=9))
    got = column(df, "m")
    assert got[:9] == [None] * 9 and got[9] == pytest.approx((55 - 4) / 9) and got[11] is not None


def test_true_range_is_missing_if_a_part_is(spark):
    df = spark.createDataFrame([("A", day(0), 10.0, 8.0, 9.0), ("A", day(1), 12.0, 11.0, 11.5), ("A", day(2), None, 9.0, 9.0), ("A", day(3), 9.5, 9.0, 9.2)], "ticker string, date date, h double, l double, c double")
    assert column(df.withColumn("t", X.true_range("h", "l", "c")), "t") == [None, 3.0, None, 0.5]


def test_drawdown_in_window(spark):
    df = series(spark, [10.0, 12.0, 6.0, 9.0, 15.0, 12.0]).withColumn("d", X.max_drawdown("p", 3))
    assert column(df, "d")[3:] == [pytest.approx(-0.5), pytest.approx(-0.5), pytest.approx(-0.2)]


def test_both_drawdowns_agree(spark):
    import numpy as np

    from tidegrid.functions.recursive import drawdown

    rng = np.random.default_rng(2)
    p = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))
    p[rng.random(60) < 0.05] = np.nan
    df = series(spark, [None if np.isnan(v) else float(v) for v in p]).withColumn("d", X.max_drawdown("p", 20))
    assert [np.nan if v is None else v for v in column(df, "d")] == pytest.approx(drawdown(p, 20).tolist(), nan_ok=True)


def test_crosses_and_flat_defaults(spark):
    df = series(spark, [1.0, -1.0, None, 1.0, 1.0], name="s")
    out = X.with_columns(df, X.crosses("s"))
    assert column(out, "golden_cross") == [0.0, 0.0, None, 1.0, 0.0] and column(out, "death_cross") == [0.0, 1.0, None, 0.0, 0.0]
    flat = series(spark, [5.0] * 25).withColumns({"b": X.percent_b("p"), "k": X.stoch_k("p", "p", "p")})
    assert column(flat, "b")[-1] == 0.5 and column(flat, "k")[-1] == 50.0


def test_recursions():
    import numpy as np

    nan = float("nan")
    assert wilder(np.array([1.0, 2.0, nan, 3.0, 6.0]), 3).tolist()[3:] == [2.0, pytest.approx((2 * 2 + 6) / 3)]
    assert np.isnan(wilder(np.array([1.0, 2.0, 3.0, nan]), 3)[3])
    got = ema(np.array([nan, 1.0, 3.0, nan, 5.0]), 2)
    assert np.isnan(got[1]) and got[2] == got[3] == 2.0 and got[4] == pytest.approx(5 * 2 / 3 + 2 / 3)
    assert rsi(np.full(30, 7.0))[-1] == 50.0 and rsi(np.arange(1.0, 30))[-1] == 100.0
    line, signal, hist = macd(np.arange(1.0, 80))
    assert np.isnan(line[24]) and not np.isnan(line[25]) and np.isnan(signal[32]) and not np.isnan(signal[33]) and hist[-1] == line[-1] - signal[-1]


def test_recursive_columns_stay_in_their_ticker(spark):
    a, b = series(spark, [float(i) for i in range(1, 41)]), series(spark, [50.0] * 40, "B")
    out = recursive_columns(a.unionByName(b).withColumn("t", F.lit(1.0)), "p", "p", "t")
    got = {(r.ticker, r.date): r for r in out.collect()}
    assert got["B", day(39)].ema_20 == 50.0 and got["B", day(39)].rsi_14 == 50.0 and got["A", day(18)].ema_20 is None
    assert got["A", day(19)].ema_20 == pytest.approx(10.5) and got["A", day(39)].atr_14 == 1.0


def test_asof(spark):
    left = spark.createDataFrame([("a", day(5), 1), ("a", day(9), 2), ("a", day(30), 3), ("b", day(5), 4), ("a", day(5), 5)], "k string, date date, id int")
    right = spark.createDataFrame([("a", day(3), 1.5), ("a", day(9), 2.5), ("a", day(20), 3.5)], "k string, date date, v double")
    run = lambda **kw: {r.id: r.v for r in R.asof_backward(left, right, ["k"], ["v"], **kw).collect()}
    assert run() == {1: 1.5, 2: 2.5, 3: 3.5, 4: None, 5: 1.5}
    assert run(strict=True)[2] == 1.5 and run(tolerance_days=5)[3] is None and run(not_after_last=True)[3] is None


def test_carry_and_grid(spark):
    have = spark.createDataFrame([(day(0), 1.0)], "date date, v double")
    grid = spark.createDataFrame([(day(i),) for i in range(1, 9)], "date date")
    assert [r.v for r in R.carry_onto(have, grid, "v", 5).orderBy("date").collect()] == [1.0] * 5 + [None] * 3
    bars = spark.createDataFrame([("A", day(1), 1.0), ("A", day(4), 2.0), ("Z", day(0), 3.0)], "ticker string, date date, close double")
    sessions = spark.createDataFrame([("V", day(i)) for i in (0, 1, 2, 3, 5)], "venue string, date date")
    venues = spark.createDataFrame([("A", "V")], "ticker string, venue string")
    got = [(r.ticker, r.date, r.stored) for r in R.session_grid(bars, sessions, venues).orderBy("ticker", "date").collect()]
    assert got == [("A", day(1), True), ("A", day(2), False), ("A", day(3), False), ("A", day(4), True), ("Z", day(0), True)]


def test_cross_sections(spark):
    rows = [(DAY, f"t{i}", v) for i, v in enumerate([1.0, 2.0, 2.0, 5.0, None, float("inf")])]
    df = spark.createDataFrame(rows, "date date, ticker string, x double")
    out = df.select("ticker", R.cross_rank(F.col("x"), 2).alias("r"), R.cross_zscore(F.col("x"), 2).alias("z"), R.cross_rank(F.col("x")).alias("few")).orderBy("ticker").collect()
    assert [r.r for r in out] == [0.0, 0.5, 0.5, 1.0, None, None] and {r.few for r in out} == {None}
    assert sum(r.z for r in out if r.z is not None) == pytest.approx(0)
    same = df.withColumn("x", F.lit(0.1)).select(R.cross_zscore(F.col("x"), 2).alias("z")).collect()
    assert {r.z for r in same} == {0.0}
    lone = df.limit(1).select(R.cross_rank(F.col("x"), 1).alias("r")).first()
    assert lone.r == 0.5


def test_values_do_not_look_ahead(spark):
    import random

    rng = random.Random(3)
    values = [rng.uniform(5, 10) for _ in range(80)]
    build = lambda v: X.with_columns(series(spark, v).withColumn("lr", X.log_return("p", 1)), {"v": X.realized_vol("lr", 21), "m": X.sma("p", 20), "r": X.simple_return("p", 5)})
    a, b = build(values), build(values[:60] + [rng.uniform(5, 10) for _ in range(20)])
    for c in ("v", "m", "r"):
        assert column(a, c)[:60] == column(b, c)[:60]
