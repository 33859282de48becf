"""Stores, upserts, point-in-time reads, adapters, ingest, quarantine and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid import pit
from tidegrid import schema as S
from tidegrid.operators import quality as Q
from tidegrid.sources import store as ST
from tidegrid.sources.store import Store
from tidegrid.streaming.ingest import upsert_stream

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame([(t, d, c, c, c, c, v) for t, d, c, v in rows], "ticker string, date date, open double, high double, low double, close double, volume double")


def test_as_of_rules():
    assert pit.resolve_as_of("2024-05-06") == D(2024, 5, 6) == pit.resolve_as_of(dt.datetime(2024, 5, 6, 7))
    with pytest.raises(ValueError):
        pit.resolve_as_of(None)
    with pytest.raises(pit.LookAheadError):
        pit.bound_end(D(2024, 2, 1), D(2024, 1, 1))
    with pytest.raises(pit.LookAheadError):
        pit.bound_end(None, D(2024, 1, 1), D(2024, 1, 2))


def test_guard_fails_when_run(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 3),)], "date date")
    assert pit.guard(df, D(2024, 1, 3)).count() == 2
    with pytest.raises(Exception, match="after as_of"):
        pit.guard(df, D(2024, 1, 2)).collect()


def test_conform_refuses(spark):
    good = bars(spark, [("A", D(2024, 1, 1), float("nan"), 1.0)])
    out = S.conform(good, S.BARS, ["ticker", "date"])
    assert out.columns == S.BARS.names and out.first().close is None and out.first().quarantined is False
    for bad in (good.drop("close"), good.withColumn("more", F.lit(1)), good.unionByName(good), good.withColumn("ticker", F.lit(" ")), good.withColumn("date", F.lit("2024-01-01").cast("timestamp"))):
        with pytest.raises(S.SchemaError):
            S.conform(bad, S.BARS, ["ticker", "date"])


def test_store_upsert_is_idempotent_and_reads_in_time(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.scan("bars").count() == 0
    first = bars(spark, [("A", D(2024, 1, 1), 10.0, 1.0), ("A", D(2024, 1, 2), 11.0, 1.0), ("B", D(2024, 1, 1), 5.0, 1.0)])
    assert {(r.ticker, r.added, r.updated, r.unchanged) for r in s.upsert("bars", first).collect()} == {("A", 2, 0, 0), ("B", 1, 0, 0)}
    assert {(r.ticker, r.added, r.updated, r.unchanged) for r in s.upsert("bars", first).collect()} == {("A", 0, 0, 2), ("B", 0, 0, 1)}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    later = bars(spark, [("A", D(2024, 1, 2), 12.0, 1.0), ("A", D(2024, 1, 3), 13.0, 1.0)])
    assert [(r.added, r.updated, r.unchanged) for r in s.upsert("bars", later).collect()] == [(1, 1, 0)]
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    assert {p for p in files if "ticker=B" in str(p)} == {p for p in now if "ticker=B" in str(p) and now[p] == files.get(p)}
    read = s.read_bars(as_of=D(2024, 1, 2))
    assert sorted((r.ticker, r.close) for r in read.collect()) == [("A", 10.0), ("A", 12.0), ("B", 5.0)]
    plan = s.read_bars(["A"], as_of=D(2024, 1, 2), start=D(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "LessThanOrEqual(date" in plan
    with pytest.raises(pit.LookAheadError):
        s.read_bars(as_of=D(2024, 1, 2), end=D(2024, 1, 5))
    assert s.has_column("bars", "close_eur") and not s.has_column("bars", "nothing")


def test_carried_columns(spark):
    from tidegrid.operators.upsert import merge_bars

    old = bars(spark, [("A", D(2024, 1, 1), 10.0, 1.0), ("A", D(2024, 1, 2), 10.0, 1.0)]).withColumns({"close_eur": F.lit(9.0), "quarantined": F.lit(True)})
    new = bars(spark, [("A", D(2024, 1, 1), 10.0, 2.0), ("A", D(2024, 1, 2), 11.0, 1.0)]).withColumns({"close_eur": F.lit(None).cast("double"), "quarantined": F.lit(False)})
    got = {r.date.day: (r.close_eur, r.quarantined, r.change) for r in merge_bars(old, new).collect()}
    assert got == {1: (9.0, True, "updated"), 2: (None, True, "updated")}


def test_other_tables(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    acts = spark.createDataFrame([("A", D(2024, 1, 5), "split", 4.0), ("A", D(2024, 2, 5), "dividend", 0.1)], "ticker string, date date, action string, value double")
    s.upsert("actions", acts).collect()
    assert [r.action for r in s.read("actions", as_of=D(2024, 1, 31)).collect()] == ["split"]
    assert s.read("actions", as_of=D(2024, 12, 31), kind="dividend").count() == 1
    s.upsert("fx", spark.createDataFrame([("EURUSD", D(2024, 1, 1), 1.1)], "pair string, date date, rate double")).collect()
    assert s.read("fx", ["EURGBP"], as_of=D(2024, 1, 1)).count() == 0


def test_adapters(spark):
    raw = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 0.5, 1.5, 10, 0.0, 0.0, 0), ("2024-01-02", 1.0, 2.0, 0.5, 1.7, 12, 0.3, 2.0, 1)], "Date string, Open double, High double, Low double, Close double, Volume long, Dividends double, `Stock Splits` double, seq int")
    (bar,) = ST.to_bars("A", raw).collect()
    assert (bar.ticker, bar.close, bar.volume) == ("A", 1.7, 12.0)
    assert sorted((r.action, r.value) for r in ST.to_actions("A", raw.where("seq = 1")).collect()) == [("dividend", 0.3), ("split", 2.0)]
    got = ST.rate_series(spark, "ESTR", ["d,r", "2024-01-01,3.9", "bad,1", "2024-01-02,."]).collect()
    assert [(r.series, r.rate) for r in got] == [("ESTR", 3.9)]


def test_dimension_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# rules\ncheck,scope,start,end,verdict,reason\nflat_price,A,2024-01-01,,bad-data,why\n")
    assert ST.read_dimension(spark, str(tmp_path / "t.csv"), S.TRIAGE).first().verdict == "bad-data"
    (tmp_path / "u.csv").write_text("ticker,name\nA,B\n")
    with pytest.raises(S.SchemaError):
        ST.read_dimension(spark, str(tmp_path / "u.csv"), S.UNIVERSE)


def test_ingest_never_raises(spark, tmp_path):
    s = Store(spark, str(tmp_path))

    def fetch(ticker, start, end):
        if ticker == "BAD":
            raise OSError("no route")
        return bars(spark, [(ticker, start, 1.0, 1.0)])

    waits = []
    run = ST.ingest(s, fetch, ["A", "BAD"], D(2024, 1, 1), as_of=D(2024, 1, 9), run_id="r1", sleep=waits.append)
    assert waits == [1.0, 2.0] and {r.ticker: r.attempts for r in run.collect()} == {"A": 1, "BAD": 3}
    assert {(r.ticker, r.status) for r in run.collect()} == {("A", "ok"), ("BAD", "failed")}
    again = ST.ingest(s, fetch, ["A"], D(2020, 1, 1), as_of=D(2024, 1, 9), run_id="r2").first()
    assert again.start == D(2023, 12, 27)
    both = ST.append_run(ST.append_run(run, run.where("ticker = 'A'")), run.withColumn("run_id", F.lit("r0")).withColumn("started_at", F.lit("2000-01-01").cast("timestamp")))
    assert both.count() == 3 and {r.run_id for r in ST.last_run(both).collect()} == {"r1"}


def test_trials(spark):
    empty = spark.createDataFrame([], "id string, family string, params string, first_logged date, last_logged date, runs long, sharpe double")
    new = spark.createDataFrame([("f", "{}", D(2024, 1, 1), 1.0)], "family string, params string, logged date, sharpe double")
    one = ST.record_trials(empty, new)
    two = ST.record_trials(one, new.withColumns({"logged": F.lit("2024-02-01").cast("date"), "sharpe": F.lit(2.0)}))
    r = two.first()
    assert (r.runs, r.sharpe, r.first_logged, r.last_logged) == (2, 2.0, D(2024, 1, 1), D(2024, 2, 1)) and ST.count_variants(two) == 1 and len(r.id) == 12


def test_duplicate_dates_and_order_of_reports(spark):
    rows = [("A", D(2024, 1, 1), 10.0, 1.0), ("A", D(2024, 1, 1), 11.0, 1.0), ("A", D(2024, 1, 2), 30.0, 1.0), ("A", D(2024, 1, 4), -1.0, 1.0)]
    splits = spark.createDataFrame([], "ticker string, date date, value double")
    ls = spark.createDataFrame([("A", "V")], "ticker string, venue string")
    sessions = spark.createDataFrame([("V", D(2024, 1, d)) for d in (1, 2, 3, 4)], "venue string, date date")
    rules = spark.createDataFrame([(0, "bad_price", "A", None, None, "bad-data", "x")], "idx int, check string, scope string, start date, end date, verdict string, reason string")
    got = Q.run_checks(bars(spark, rows), splits, sessions, ls, rules).collect()
    assert [r.check for r in got] == ["bad_price", "duplicate_date", "unexplained_move", "missing_session"] and got[0].verdict == "bad-data"


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    a = bars(spark, [("A", D(2024, 1, 1), 10.0, 1.0), ("B", D(2024, 1, 1), 10.0, 1.0)])
    b = bars(spark, [("A", D(2024, 1, 1), 12.0, 1.0), ("A", D(2024, 1, 2), 13.0, 1.0)])
    s = Store(spark, str(tmp_path / "store"))
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(str(src))
        upsert_stream(spark.readStream.schema(part.schema).parquet(str(src)), s, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.ticker, r.date.day, r.close) for r in s.scan("bars").collect())
    assert got == [("A", 1, 12.0), ("A", 2, 13.0), ("B", 1, 10.0)]


def test_ingest_retries_and_gives_up(spark, tmp_path):
    s, calls = Store(spark, str(tmp_path)), []

    def fetch(ticker, start, end):
        calls.append(ticker)
        if ticker == "LATE" and calls.count("LATE") < 3:
            raise OSError("busy")
        if ticker == "GONE":
            raise ST.Refused("no such name")
        if ticker.startswith("X"):
            raise OSError("no route")
        return bars(spark, [(ticker, start, 1.0, 1.0)])

    run = ST.ingest(s, fetch, ["GONE", "LATE", "X1", "X2", "A"], D(2024, 1, 1), as_of=D(2024, 1, 9), run_id="r", give_up_after=2, sleep=lambda _: None)
    got = {r.ticker: (r.status, r.attempts) for r in run.collect()}
    assert got == {"GONE": ("failed", 1), "LATE": ("ok", 3), "X1": ("failed", 3), "X2": ("failed", 3), "A": ("skipped", 0)}


def test_upsert_scans_the_partitions_it_names(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.upsert("bars", bars(spark, [(t, D(2024, 1, 1), 10.0, 1.0) for t in "ABC"])).collect()
    plans = []
    whole = ST.merge_bars
    monkeypatch.setattr(ST, "merge_bars", lambda old, new: (plans.append(old._jdf.queryExecution().executedPlan().toString()), whole(old, new))[1])
    one = s.upsert("bars", bars(spark, [("B", D(2024, 1, 1), 11.0, 1.0)]))
    two = s.upsert("bars", bars(spark, [("C", D(2024, 1, 2), 12.0, 1.0)]))  # before the first answer is read
    assert [tuple(r) for r in one.collect()] == [("B", 0, 1, 0)] and [tuple(r) for r in two.collect()] == [("C", 1, 0, 0)]
    assert "PartitionFilters: [isnotnull(ticker" in plans[0] and "(ticker" in plans[0] and "= B" in plans[0]
    assert sorted((r.ticker, r.close) for r in s.scan("bars").collect()) == [("A", 10.0), ("B", 11.0), ("C", 10.0), ("C", 12.0)]


def test_quarantine_of_some_tickers_leaves_the_others(spark):
    from tidegrid.operators import quality as Q

    b = bars(spark, [(t, D(2024, 1, 1), 10.0, 1.0) for t in "AB"]).withColumns({"open": F.lit(1.0), "high": F.lit(1.0), "low": F.lit(1.0)})
    b = b.withColumn("quarantined", F.lit(True))
    old = b.select("ticker", "date", F.lit("bad_price").alias("check"), "open", "high", "low", "close", "volume", F.lit("error").alias("severity"), F.lit("").alias("detail"), F.lit("").alias("reason"), F.lit("2020-01-01").cast("timestamp").alias("quarantined_at"), F.lit(None).cast("timestamp").alias("released_at"))
    none = spark.createDataFrame([], "check string, ticker string, date date, detail string, idx int, verdict string, reason string")
    now = F.lit("2021-01-01").cast("timestamp")
    records, flagged = Q.apply_quarantine(old, none, b, now, ["A"])
    assert {r.ticker: r.released_at is None for r in records.collect()} == {"A": False, "B": True}
    assert {r.ticker: r.quarantined for r in flagged.collect()} == {"A": False, "B": True}
    records, flagged = Q.apply_quarantine(old, none, b, now)
    assert all(r.released_at is not None for r in records.collect()) and not any(r.quarantined for r in flagged.collect())
