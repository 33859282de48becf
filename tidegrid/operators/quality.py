"""Checks on bars, their triage by interval rules, the quarantine, and session calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.frames import w_t, island_ids
from tidegrid.operators.upsert import append_only

#: Each check's severity, in the order of reports; thresholds.
CHECKS = {
    "bad_price": "error", "high_below_low": "error", "duplicate_date": "error", "unexplained_move": "error",
    "close_out_of_range": "warning", "flat_price": "warning", "missing_session": "warning", "off_calendar": "warning",
}
MOVE, FLAT_RUN, SLACK = 0.40, 5, 1e-9
BAD_DATA = "bad-data"
PRICES = ["open", "high", "low", "close"]


def _flags(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), "ticker", "date", detail.alias("detail"))


def expected_sessions(bars: DataFrame, sessions: DataFrame, listings: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """(ticker, date): the venue's sessions, unscheduled closures left out, between a ticker's first and last bar."""
    if closures is not None:
        sessions = sessions.join(F.broadcast(closures.select("venue", "date")), ["venue", "date"], "left_anti")
    spans = bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).join(F.broadcast(listings.select("ticker", "venue")), "ticker")
    return spans.join(sessions, "venue").where(F.col("date").between(F.col("lo"), F.col("hi"))).select("ticker", "date")


def session_gaps(bars: DataFrame, sessions: DataFrame, listings: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """(ticker, missing, off_calendar, excused): counts of sessions without a bar, bars without a session, and
    closures in the ticker's span."""
    want, have = expected_sessions(bars, sessions, listings, closures), bars.select("ticker", "date").distinct()
    missing = want.join(have, ["ticker", "date"], "left_anti").select("ticker", F.lit("missing").alias("kind"))
    off = have.join(want, ["ticker", "date"], "left_anti").select("ticker", F.lit("off_calendar").alias("kind"))
    parts = [missing, off]
    if closures is not None:
        parts.append(expected_sessions(bars, closures.select("venue", "date"), listings).select("ticker", F.lit("excused").alias("kind")))
    counted = reduce(DataFrame.unionByName, parts).groupBy("ticker").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "off_calendar", "excused")])
    return bars.select("ticker").distinct().join(counted, "ticker", "left").fillna(0)


def calendar_flags(bars: DataFrame, sessions: DataFrame, listings: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    want, have = expected_sessions(bars, sessions, listings, closures), bars.select("ticker", "date").distinct()
    known = have.join(F.broadcast(listings.select("ticker")), "ticker", "left_semi")
    return _flags(want.join(have, ["ticker", "date"], "left_anti"), "missing_session", F.lit("no bar on a session")).unionByName(
        _flags(known.join(want, ["ticker", "date"], "left_anti"), "off_calendar", F.lit("a bar outside the venue's sessions"))
    )


def moves(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Close-to-close moves of over 40 % that no split between the two bars explains: the splits are tagged into the
    bars and gathered up to the next one, so no range join is needed."""
    a = bars.where("close > 0").select("ticker", "date", "close", F.lit(None).cast("double").alias("ratio"), F.lit(1).alias("_side"))
    b = splits.select("ticker", "date", F.lit(None).cast("double").alias("close"), F.col("value").alias("ratio"), F.lit(0).alias("_side"))
    w = Window.partitionBy("ticker").orderBy("date", "_side")
    tagged = a.unionByName(b).withColumn("_run", F.sum(F.when(F.col("_side") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    tagged = tagged.withColumn("_run", F.coalesce("_run", F.lit(0)))
    ratios = F.collect_list("ratio").over(Window.partitionBy("ticker", "_run"))
    own = tagged.withColumn("ratios", ratios).where("_side = 1")
    move = F.col("close") / F.lag("close").over(w_t())
    odd = own.withColumn("move", move).where(F.abs(F.col("move") - 1) > MOVE)
    explained = F.exists("ratios", lambda r: F.abs(F.col("move") * r - 1) <= MOVE)
    return odd.where(~explained).select("ticker", "date", "move")


def flat_runs(bars: DataFrame, least: int = FLAT_RUN) -> DataFrame:
    """(ticker, start, end, n): runs of one unchanged close; a missing close ends a run."""
    starts = ~F.coalesce(F.col("close") == F.lag("close").over(w_t()), F.lit(False))
    runs = bars.select("ticker", "date", "close", island_ids(starts).alias("_run")).where("close is not null")
    return runs.groupBy("ticker", "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def bar_flags(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Flags of the checks on prices. Repeated dates are flagged, then the last of each counts."""
    order = F.col("_seq") if "_seq" in bars.columns else F.struct(*[c for c in PRICES])
    w = Window.partitionBy("ticker", "date").orderBy(order.desc())
    marked = bars.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.count("*").over(Window.partitionBy("ticker", "date")))
    one = marked.where("_n = 1")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) <= 0) for c in PRICES])
    inverted = F.col("high") < F.col("low")
    outside = (F.col("close") > F.col("high") + SLACK * F.abs("high")) | (F.col("close") < F.col("low") - SLACK * F.abs("low"))
    runs = flat_runs(one)
    # one scan for the checks of a single row
    single = F.array(*[
        F.when(cond, F.struct(F.lit(k).alias("check"), F.lit(text).alias("detail")))
        for k, cond, text in (
            ("bad_price", bad, "a price that is missing or not above 0"), ("high_below_low", inverted, "high below low"),
            ("duplicate_date", F.col("_c") > 1, "several rows for the date"), ("close_out_of_range", outside & ~inverted, "close outside low..high"),
        )
    ])
    flags = one.select("ticker", "date", F.explode(F.filter(single, lambda x: x.isNotNull())).alias("f")).select("f.check", "ticker", "date", "f.detail")
    odd = _flags(moves(one, splits), "unexplained_move", F.format_string("moved to %.4f of the close before", F.col("move")))
    flat = _flags(runs.withColumn("date", F.col("start")), "flat_price", F.format_string("%d equal closes", F.col("n")))
    return flags.unionByName(odd).unionByName(flat)


def apply_triage(flags: DataFrame, rules: DataFrame, listings: DataFrame) -> DataFrame:
    """flags with verdict and reason of the first rule, in file order (`idx`), whose check, scope (a ticker or a
    venue) and dates fit. Two equi-joins on (check, scope), none on the dates alone."""
    keyed = flags.join(F.broadcast(listings.select("ticker", "venue")), "ticker", "left").withColumn("_id", F.struct("check", "ticker", "date", "detail"))
    scoped = keyed.withColumn("scope", F.explode(F.array_compact(F.array("ticker", "venue"))))
    r = rules.select("check", "scope", "start", "end", F.struct("idx", "verdict", "reason").alias("rule"))
    met = scoped.join(r, ["check", "scope"], "left").withColumn("rule", F.when(F.col("date").between(F.coalesce("start", F.lit("0001-01-01").cast("date")), F.coalesce("end", F.lit("9999-12-31").cast("date"))), F.col("rule")))
    first = met.groupBy("check", "ticker", "date", "detail").agg(F.min("rule").alias("rule"))
    return first.select("check", "ticker", "date", "detail", "rule.idx", "rule.verdict", "rule.reason")


def unused_rules(rules: DataFrame, triaged: DataFrame) -> DataFrame:
    return rules.join(triaged.where("idx is not null").select("idx").distinct(), "idx", "left_anti")


def run_checks(bars: DataFrame, splits: DataFrame, sessions: DataFrame, listings: DataFrame, rules: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """All flags, quarantined rows included, with severity and triage, ordered by severity, check, ticker and date."""
    flags = bar_flags(bars, splits).unionByName(calendar_flags(bars, sessions, listings, closures))
    names = list(CHECKS)
    severity = F.create_map(*[F.lit(x) for k, v in CHECKS.items() for x in (k, v)])
    order = F.array_position(F.array(*[F.lit(k) for k in names]), F.col("check"))
    out = apply_triage(flags, rules, listings).withColumn("severity", severity[F.col("check")])
    return out.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), order, "ticker", "date")


def apply_quarantine(records: DataFrame, triaged: DataFrame, bars: DataFrame, now: Column, tickers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, bars) after a run: bad-data flags on stored bars open records, vanished ones close theirs
    (`released_at`), nothing is deleted; a bar is flagged while any record of it is open. With `tickers`, the run
    checked only those: the records and bar flags of all others stay as they are."""
    cols = ["open", "high", "low", "close", "volume"]
    checked = F.lit(True) if tickers is None else F.col("ticker").isin(tickers)
    triaged = triaged.where(checked)
    wanted = triaged.where(F.col("verdict") == BAD_DATA).join(bars.select("ticker", "date", *cols), ["ticker", "date"]).dropDuplicates(["ticker", "date", "check"])
    keys = ["ticker", "date", "check"]
    open_ = records.where("released_at is null").where(checked)
    closed = open_.join(wanted.select(*keys), keys, "left_anti").withColumn("released_at", now)
    severity = F.create_map(*[F.lit(x) for k, v in CHECKS.items() for x in (k, v)])
    fresh = wanted.join(open_.select(*keys), keys, "left_anti").select(*keys, *cols, severity[F.col("check")].alias("severity"), "detail", F.coalesce("reason", F.lit("")).alias("reason"), now.alias("quarantined_at"), F.lit(None).cast("timestamp").alias("released_at"))
    kept = append_only(records, closed, [*keys, "quarantined_at"]).unionByName(fresh.select(records.columns))
    marks = wanted.select("ticker", "date").distinct().withColumn("_q", F.lit(True))
    before = F.coalesce("quarantined", F.lit(False)) if "quarantined" in bars.columns else F.lit(False)
    after = F.when(checked, F.coalesce("_q", F.lit(False))).otherwise(before)
    flagged = bars.join(marks, ["ticker", "date"], "left").withColumn("quarantined", after).drop("_q")
    return kept, flagged


def freshness(bars: DataFrame, listings: DataFrame, as_of: Column, stale_days: int = 5) -> DataFrame:
    """(ticker, last_date, age, status): ok, stale, or empty without any bar."""
    last = listings.select("ticker").join(bars.groupBy("ticker").agg(F.max("date").alias("last_date")), "ticker", "left")
    age = F.datediff(as_of, F.col("last_date"))
    return last.select("ticker", "last_date", age.alias("age"), F.when(age.isNull(), "empty").when(age > stale_days, "stale").otherwise("ok").alias("status"))
