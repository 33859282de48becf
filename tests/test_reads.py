"""Every read with an as_of: rows from later are planted and must never show, and asking for them raises."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.pit import LookAheadError
from tidegrid.plans import reads as R
from tidegrid.sources.store import Store

CUT = dt.date(2023, 3, 1)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    axis = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(90)]
    rows = []
    for t in ("A", "B", "C", "M"):
        p = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(axis))))
        rows += [(t, d, x, x * 1.01, x * 0.99, x, 1e5, x, False) for d, x in zip(axis, map(float, p), strict=True)]
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.write("bars", spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, close_eur double, quarantined boolean"))
    acts = [("A", axis[40], "dividend", 0.5), ("A", axis[80], "dividend", 0.7), ("B", axis[30], "split", 1.05)]
    s.write("actions", spark.createDataFrame(acts, "ticker string, date date, action string, value double"))
    s.write("rates", spark.createDataFrame([("ESTR", d, 3.6) for d in axis], "series string, date date, rate double"))
    s.write("fx", spark.createDataFrame([("EURUSD", d, 1.1) for d in axis], "pair string, date date, rate double"))
    sessions = spark.createDataFrame([("V", d) for d in axis], "venue string, date date")
    listings = spark.createDataFrame([(t, "V") for t in "ABCM"], "ticker string, venue string")
    return s, sessions, listings


READERS = {
    "bars": lambda w, **k: w[0].read_bars(**k), "actions": lambda w, **k: w[0].read("actions", **k), "fx": lambda w, **k: w[0].read("fx", **k), "rates": lambda w, **k: w[0].read("rates", **k),
    "adjusted": lambda w, **k: R.read_adjusted(w[0], **k), "total_return": lambda w, **k: R.read_total_return(w[0], **k), "benchmarks": lambda w, **k: R.read_benchmarks(w[0], ["M"], **k),
    **{n: (lambda f: lambda w, **k: f(*w, **k))(getattr(R, f"read_{n}")) for n in ("returns", "momentum", "volatility", "trend", "oscillators", "liquidity", "labels", "backtest_prices")},
    "relatives": lambda w, **k: R.read_relatives(*w, "M", **k),
}


@pytest.mark.parametrize("name", READERS)
def test_nothing_later_comes_back(world, name):
    df = READERS[name](world, as_of=CUT)
    assert df.agg(F.max("date")).first()[0] <= CUT and df.count() > 0
    with pytest.raises(LookAheadError):
        READERS[name](world, as_of=CUT, end=CUT + dt.timedelta(days=1))


def test_later_rows_change_nothing(world, spark, tmp_path):
    s, sessions, listings = world
    short = Store(spark, str(tmp_path))
    short.write("bars", s.scan("bars").where(F.col("date") <= F.lit(CUT)))
    short.write("actions", s.scan("actions").where(F.col("date") <= F.lit(CUT)))
    for read in (R.read_returns, R.read_volatility, R.read_labels):
        a, b = (read(x, sessions, listings, as_of=CUT).orderBy("ticker", "date").toPandas().astype(str) for x in (s, short))
        assert a.equals(b)


def test_a_window_is_part_of_the_whole(world):
    start = dt.date(2023, 2, 20)
    for read in (R.read_returns, R.read_momentum, R.read_trend):
        whole = read(*world, as_of=CUT).where(F.col("date") >= F.lit(start)).orderBy("ticker", "date").toPandas().round(9).astype(str)
        part = read(*world, as_of=CUT, start=start).orderBy("ticker", "date").toPandas().round(9).astype(str)
        assert whole.equals(part)


def test_risk_free(world):
    s, sessions, _ = world
    rf = [r.rf for r in R.read_risk_free(s, sessions.select("date"), as_of=CUT).orderBy("date").collect()]
    assert rf[0] == 0.0 and rf[1] == pytest.approx(3.6 / 100 / 360)
