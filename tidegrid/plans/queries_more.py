"""Queries of stores, rules and tables that the other query modules only use inside larger ones."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import functions as F

from tidegrid import pit
from tidegrid import schema as SC
from tidegrid.operators import labels as L
from tidegrid.operators import market as M
from tidegrid.operators import metrics as A
from tidegrid.operators import models as ML
from tidegrid.operators import portfolio as B
from tidegrid.operators import quality as Q
from tidegrid.operators.frames import average_rank, cross_rank, positive
from tidegrid.operators.upsert import append_only, merge_bars
from tidegrid.plans import harness as H
from tidegrid.plans import queries_data as QD
from tidegrid.plans import queries_portfolio as QP
from tidegrid.plans.catalog import query, with_
from tidegrid.plans.queries_features import GRID, W, _SCORED, scored
from tidegrid.sources import store as S

D = dt.date
_TWO = "ticker IN ('Brand#3', 'Brand#11')"


def scratch(spark) -> S.Store:
    """A store of its own under the folder that the cluster shares; a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
    return S.Store(spark, f"{folder.rstrip('/')}/tidegrid/store-{uuid.uuid4().hex}")


def some_bars(spark, sf):
    return H.bars(spark, sf).where(_TWO)


# ---- stores -----------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('close', true), ('close_eur', true), ('nothing', false)) v(name, present)", "name present")
def s2_column_probe(spark, sf):
    s = scratch(spark)
    s.write("bars", some_bars(spark, sf))
    return spark.createDataFrame([(c, s.has_column("bars", c)) for c in ("close", "close_eur", "nothing")], "name string, present boolean")


@query(with_(H.BARS_SQL, result="SELECT 'Brand#3' AS ticker, max(date) AS last_date FROM bars WHERE ticker = 'Brand#3' UNION ALL SELECT 'none', NULL"), "ticker last_date")
def s4_max_stored_date(spark, sf):
    b = H.bars(spark, sf)
    return spark.createDataFrame([(t, S.max_stored_date(b, t)) for t in ("Brand#3", "none")], "ticker string, last_date date")


@query(with_(H.BARS_SQL, result="SELECT trim(ticker) AS ticker, date, open, high, low, CASE WHEN CAST(volume AS BIGINT) % 5 = 0 THEN NULL ELSE close END AS close, volume, false AS quarantined FROM bars"), "ticker date quarantined", "open high low close volume", 9)
def s7_conform(spark, sf):
    """Blanks round a key, columns in another order, NaN, and a column that is missing."""
    b = H.bars(spark, sf).withColumn("close", F.when(F.col("volume").cast("long") % 5 == 0, float("nan")).otherwise(F.col("close")))
    return SC.conform(b.select("volume", "close", "low", "high", "open", "date", F.concat(F.lit(" "), "ticker").alias("ticker")), *SC.KEYS["bars"])


@query(with_(H.BARS_SQL, result=f"SELECT ticker, date, CASE WHEN ticker = 'Brand#3' THEN close * 2 ELSE close END AS close FROM bars WHERE {_TWO} AND (ticker <> 'Brand#3' OR year(date) = 1996)"), "ticker date", "close", 9)
def s8_partition_overwrite(spark, sf):
    s, b = scratch(spark), some_bars(spark, sf)
    s.write("bars", b)
    s.write("bars", b.where("ticker = 'Brand#3' AND year(date) = 1996").withColumn("close", F.col("close") * 2))
    return s.scan("bars")


@query(
    with_(H.BARS_SQL, "st AS (SELECT *, CASE WHEN CAST(volume AS BIGINT) % 4 <> 0 THEN close * 2 END AS ce, CAST(volume AS BIGINT) % 11 = 0 AS q FROM bars WHERE year(date) < 1997)",
          "nw AS (SELECT ticker, date, open, high, low, close + CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS close, volume FROM bars WHERE year(date) >= 1996)",
          result="SELECT coalesce(n.ticker, s.ticker) AS ticker, coalesce(n.date, s.date) AS date, CASE WHEN s.ticker IS NULL THEN 'added' WHEN n.ticker IS NULL THEN 'kept' WHEN n.close = s.close THEN 'unchanged' ELSE 'updated' END AS change, coalesce(s.q, false) AS quarantined, CASE WHEN n.ticker IS NULL OR n.close = s.close THEN s.ce END AS close_eur FROM st s FULL JOIN nw n ON s.ticker = n.ticker AND s.date = n.date"),
    "ticker date change quarantined", "close_eur", 9,
)
def s9_carried_columns(spark, sf):
    b = H.bars(spark, sf)
    n = F.col("volume").cast("long")
    old = b.where("year(date) < 1997").withColumns({"close_eur": F.when(n % 4 != 0, F.col("close") * 2), "quarantined": n % 11 == 0})
    new = b.where("year(date) >= 1996").withColumns({"close": F.col("close") + F.when(n % 7 == 0, 1).otherwise(0), "close_eur": F.lit(None).cast("double"), "quarantined": F.lit(False)})
    return merge_bars(old, new)


@query(with_(*QD.ACT, result=f"SELECT ticker, date, action, CASE WHEN action = 'dividend' AND year(date) >= 1996 THEN value * 2 ELSE value END AS value FROM actions WHERE {_TWO}"), "ticker date action", "value", 9)
def s10_action_upsert(spark, sf):
    s, a = scratch(spark), H.actions(some_bars(spark, sf))
    s.upsert("actions", a.where("year(date) < 1998")).collect()
    s.upsert("actions", a.where("year(date) >= 1996").withColumn("value", F.when(F.col("action") == "dividend", F.col("value") * 2).otherwise(F.col("value")))).collect()
    return s.scan("actions")


@query(with_(H.FX_SQL, H.RATES_SQL, result="SELECT pair AS name, date, rate FROM fx UNION ALL SELECT series, date, CASE WHEN series = 'ESTR' THEN rate + 1 ELSE rate END FROM rates"), "name date", "rate", 9)
def s11_rate_upserts(spark, sf):
    s, f, r = scratch(spark), H.fx(spark, sf), H.rates(spark, sf)
    s.upsert("fx", f.where("year(date) < 1996").withColumn("rate", F.lit(0.0))).collect()
    s.upsert("fx", f).collect()
    s.upsert("rates", r).collect()
    s.upsert("rates", r.where("series = 'ESTR'").withColumn("rate", F.col("rate") + 1)).collect()
    return s.scan("fx").select(F.col("pair").alias("name"), "date", "rate").unionByName(s.scan("rates").select(F.col("series").alias("name"), "date", "rate"))


@query(
    with_(*QD.ACT, H.FX_SQL, H.RATES_SQL, result=f"SELECT 'actions' AS name, ticker AS key, date, value FROM actions WHERE {_TWO} AND action = 'split' AND date <= DATE '1997-06-30' UNION ALL SELECT 'fx', pair, date, rate FROM fx WHERE pair = 'EURUSD' AND date BETWEEN DATE '1995-01-01' AND DATE '1996-01-01' UNION ALL SELECT 'rates', series, date, rate FROM rates WHERE date <= DATE '1997-06-30'"),
    "name key date", "value", 9,
)
def s12_dated_scans(spark, sf):
    s = scratch(spark)
    s.write("actions", H.actions(some_bars(spark, sf)))
    s.write("fx", H.fx(spark, sf))
    s.write("rates", H.rates(spark, sf))
    as_of = QD.AS_OF
    parts = (("actions", "ticker", "value", s.read("actions", as_of=as_of, kind="split")), ("fx", "pair", "rate", s.read("fx", ["EURUSD"], as_of=as_of, start=D(1995, 1, 1), end=D(1996, 1, 1))), ("rates", "series", "rate", s.read("rates", as_of=as_of)))
    out = [df.select(F.lit(n).alias("name"), F.col(k).alias("key"), "date", F.col(v).alias("value")) for n, k, v, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_RECORDS = "rc AS (SELECT ticker, date, n % 3 = 0 AS released FROM numbered WHERE n % 89 = 5)"


@query(with_(*QD.ACT, _RECORDS, result=f"SELECT false AS every, ticker, date FROM rc WHERE {_TWO} AND date <= DATE '1997-06-30' AND NOT released UNION ALL SELECT true, ticker, date FROM rc WHERE date <= DATE '1997-06-30'"), "every ticker date")
def s13_quarantine_scan(spark, sf):
    from tidegrid.operators.frames import w_t

    n = H.bars(spark, sf).withColumn("n", F.row_number().over(w_t())).where("n % 89 = 5")
    text = lambda x, name: F.lit(x).alias(name)
    then = F.lit("2020-01-01").cast("timestamp")
    rows = n.select("ticker", "date", text("bad_price", "check"), "open", "high", "low", "close", "volume", text("error", "severity"), text("", "detail"), text("", "reason"), then.alias("quarantined_at"), F.when(F.col("n") % 3 == 0, then).alias("released_at"))
    s = scratch(spark)
    s.write("quarantine", rows)
    some, every = s.read_quarantine(["Brand#3", "Brand#11"], as_of=QD.AS_OF), s.read_quarantine(as_of=QD.AS_OF, include_released=True)
    return some.withColumn("every", F.lit(False)).unionByName(every.withColumn("every", F.lit(True)))


@query("SELECT 'E' AS ticker, CAST(ts AS DATE) AS date, arg_max(value, {'t': ts, 'e': event_id}) AS close, arg_max(user_id, {'t': ts, 'e': event_id}) AS volume FROM events GROUP BY CAST(ts AS DATE)", "ticker date", "close volume", 9)
def s14_response_to_bars(spark, sf):
    """Events as a provider's answer with many rows a session; the last of each counts."""
    e = H.table(spark, sf, "events")
    seq = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return S.to_bars("E", e.select(F.to_date("ts").alias("Date"), *[F.col("value").alias(c) for c in ("Open", "High", "Low", "Close")], F.col("user_id").alias("Volume"), seq.alias("seq")))


@query("SELECT 'ESTR' AS series, date, rate FROM (VALUES (DATE '2024-01-01', 3.9), (DATE '2024-01-03', 3.95)) v(date, rate)", "series date", "rate")
def s16_rate_csv(spark, sf):
    return S.rate_series(spark, "ESTR", ["DATE,RATE", "2024-01-01,3.9", "2024-01-02,.", "later,4", "2024-01-03,3.95"])


@query(with_(H.LISTINGS_SQL, result="SELECT ticker, 'n' || ticker AS name, venue AS exchange, currency, sector, 'X' AS country FROM listings"), "ticker name exchange currency sector country")
def s17_dimension(spark, sf):
    lines = H.listings(spark, sf).select(F.concat_ws(",", "ticker", F.concat(F.lit("n"), "ticker"), "venue", "currency", "sector", F.lit("X")).alias("value"))
    path = scratch(spark).path("universe")
    head = spark.createDataFrame([("# listed names",), (",".join(SC.UNIVERSE.names),)], "value string")
    lines.withColumn("k", F.lit(1)).unionByName(head.withColumn("k", F.lit(0))).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return S.read_dimension(spark, path, SC.UNIVERSE)


@query(
    with_(H.BARS_SQL, "e AS (SELECT ticker, count(*) FILTER (date < DATE '1997-01-01') AS old, count(*) AS n, max(date) FILTER (date < DATE '1997-01-01') - 5 AS since FROM bars GROUP BY ticker)",
          result="SELECT ticker, 'ok' AS status, since AS start, n - old AS rows_added, (SELECT count(*) FROM bars b WHERE b.ticker = e.ticker AND b.date >= since AND b.date < DATE '1997-01-01') AS rows_unchanged FROM e WHERE ticker IN ('Brand#3', 'Brand#11') UNION ALL SELECT 'gone', 'failed', DATE '1992-01-01', NULL, NULL"),
    "ticker status start rows_added rows_unchanged",
)
def s20_ingest(spark, sf):
    s, b = scratch(spark), some_bars(spark, sf)
    s.write("bars", b.where("date < '1997-01-01'"))

    def fetch(ticker, start, end):
        if ticker == "gone":
            raise S.Refused("no such name")
        return b.where(F.col("ticker") == ticker).where(F.col("date").between(start, end))

    return S.ingest(s, fetch, ["Brand#3", "gone", "Brand#11"], D(1992, 1, 1), as_of=D(2100, 1, 1), run_id="r")


@query(with_(H.BARS_SQL, result="SELECT 'r' || year(date) AS run_id, ticker, count(*) AS rows_added, year(date) = 1998 AS latest FROM bars WHERE year(date) IN (1996, 1998) GROUP BY year(date), ticker"), "run_id ticker rows_added latest")
def s21_manifest(spark, sf):
    """Two runs, the first of them logged twice; `latest` marks those of the last run."""
    year = F.year("date")
    counted = H.bars(spark, sf).groupBy(F.concat(F.lit("r"), year).alias("run_id"), "ticker").agg(F.count("*").alias("rows_added"), F.min("date").cast("timestamp").alias("started_at"))
    first, last = counted.where("run_id = 'r1996'"), counted.where("run_id = 'r1998'")
    book = S.append_run(S.append_run(S.append_run(first.limit(0), first.withColumn("rows_added", F.lit(0).cast("long"))), last), first)
    return book.join(S.last_run(book).select("run_id", "ticker").withColumn("latest", F.lit(True)), ["run_id", "ticker"], "left").fillna(False, ["latest"])


_TRIALS = "SELECT substr(sha1(event_type || chr(10) || 'w=' || (user_id % 5)), 1, 12) AS id, event_type AS family, 'w=' || (user_id % 5) AS params, count(*) + CASE WHEN event_type = 'click' THEN 3 ELSE 0 END AS runs, max(CAST(ts AS DATE)) AS last_logged FROM events GROUP BY 1, 2, 3"


@query(_TRIALS, "id family params runs last_logged")
def s24_trials_ledger_grows(spark, sf):
    """A ledger that has some of the variants already."""
    e = H.table(spark, sf, "events")
    params = F.concat(F.lit("w="), (F.col("user_id") % 5).cast("string"))
    new = e.select(F.col("event_type").alias("family"), params.alias("params"), F.to_date("ts").alias("logged"), F.col("value").alias("sharpe"))
    empty = spark.createDataFrame([], "id string, family string, params string, first_logged date, last_logged date, runs long, sharpe double")
    early = new.where("family = 'click'").select("family", "params").distinct().select("family", "params", F.lit("2000-01-01").cast("date").alias("logged"), F.lit(0.0).alias("sharpe"))
    book = S.record_trials(empty, early.unionByName(early).unionByName(early))
    return S.record_trials(book, new)


# ---- point in time, masks ---------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('date', DATE '2024-05-06'), ('text', DATE '2024-05-06'), ('time', DATE '2024-05-06'), ('none', NULL)) v(given, resolved)", "given resolved")
def f1_resolve_as_of(spark, sf):
    def resolved(x):
        try:
            return pit.resolve_as_of(x)
        except ValueError:
            return None

    cases = {"date": D(2024, 5, 6), "text": "2024-05-06", "time": dt.datetime(2024, 5, 6, 7), "none": None}
    return spark.createDataFrame([(k, resolved(v)) for k, v in cases.items()], "given string, resolved date")


@query("SELECT * FROM (VALUES ('open', DATE '2024-05-06'), ('earlier', DATE '2024-01-01'), ('later', NULL), ('starts later', NULL)) v(given, bound)", "given bound")
def f2_bound_end(spark, sf):
    as_of = D(2024, 5, 6)

    def bound(end, start=None):
        try:
            return pit.bound_end(end, as_of, start)
        except pit.LookAheadError:
            return None

    return spark.createDataFrame([("open", bound(None)), ("earlier", bound(D(2024, 1, 1))), ("later", bound(D(2024, 6, 1))), ("starts later", bound(None, D(2024, 6, 1)))], "given string, bound date")


@query(with_(H.BARS_SQL, result="SELECT ticker, date, CASE WHEN CAST(volume AS BIGINT) % 3 = 1 THEN close END AS price FROM bars"), "ticker date", "price", 9)
def f4_positive_prices(spark, sf):
    odd = F.when(F.col("volume").cast("long") % 3 == 0, -F.col("close")).when(F.col("volume").cast("long") % 3 == 2, float("nan")).otherwise(F.col("close"))
    return H.bars(spark, sf).select("ticker", "date", positive(odd).alias("price"))


@query(
    with_(H.BARS_SQL, "m AS (SELECT *, CAST(volume AS BIGINT) % 2 = 0 AS member FROM bars)", "k AS (SELECT *, count(*) FILTER (member) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY CASE WHEN member THEN close END NULLS LAST) + (count(*) OVER (PARTITION BY date, CASE WHEN member THEN close END) - 1) / 2.0 AS r FROM m)",
          result="SELECT ticker, date, CASE WHEN member AND n >= 10 THEN (r - 1) / (n - 1) END AS x_rank FROM k"),
    "ticker date", "x_rank",
)
def f6_cross_section_mask(spark, sf):
    b = H.bars(spark, sf)
    return b.select("ticker", "date", cross_rank(F.col("close"), mask=F.col("volume").cast("long") % 2 == 0).alias("x_rank"))


# ---- joins, reads, checks ---------------------------------------------------------------------


@query(with_(H.BARS_SQL, "a AS (SELECT * FROM bars WHERE year(date) < 1997)", "b AS (SELECT ticker, date, close * 2 AS close FROM bars WHERE year(date) >= 1996)", result="SELECT ticker, date, close FROM a ANTI JOIN b USING (ticker, date) UNION ALL SELECT ticker, date, close FROM b"), "ticker date", "close", 9)
def j6_replace_by_key(spark, sf):
    b = H.bars(spark, sf).select("ticker", "date", "close")
    return append_only(b.where("year(date) < 1997"), b.where("year(date) >= 1996").withColumn("close", F.col("close") * 2), ["ticker", "date"])


@query(with_(H.BARS_SQL, QP._ADV, result="SELECT ticker, date, close * 0.3 AS adj_close_eur, open * 0.3 AS adj_open_eur, CASE WHEN CAST(volume AS BIGINT) % 3 <> 0 THEN adv END AS adv_eur_21 FROM bars JOIN adv USING (ticker, date)"), "ticker date", "adj_close_eur adj_open_eur adv_eur_21", 8)
def b3_backtest_prices(spark, sf):
    b = H.bars(spark, sf)
    total = b.select("ticker", "date", (F.col("close") * 0.3).alias("adj_close_eur"))
    liquid = QP.prices(spark, sf).join(b.select("ticker", "date", "volume"), ["ticker", "date"]).where(F.col("volume").cast("long") % 3 != 0)
    return B.backtest_prices(total, b, liquid)


@query(
    with_(H.BARS_SQL, "ps AS (SELECT 'equal_weight' AS scenario, date, ticker, 1.0::DOUBLE AS score FROM bars UNION ALL SELECT 'random_' || s, date, ticker, CAST('0x' || substr(md5(s || ':' || ticker || ':' || date), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 FROM bars, range(3) r(s) UNION ALL SELECT 'volume', date, ticker, volume FROM bars WHERE CAST(volume AS BIGINT) % 2 = 0)", result="SELECT * FROM ps"),
    "scenario date ticker", "score", 9,
)
def b4_score_sources(spark, sf):
    p = QP.prices(spark, sf)
    v = H.bars(spark, sf).select("ticker", "date", F.when(F.col("volume").cast("long") % 2 == 0, F.col("volume")).alias("v"))
    return B.constant_scores(p).unionByName(B.random_scores(p, 3)).unionByName(B.column_scores(v, "v", "volume"))


_EARLY = H.BARS_SQL.replace("bars AS (SELECT", "all_bars AS (SELECT", 1)


@query(
    with_(_EARLY, "bars AS (SELECT * FROM all_bars WHERE date <= DATE '1997-06-30' AND ticker IN ('Brand#3', 'Brand#11'))", H.ACTIONS_SQL, *QD._VIS, QD._SPLITF, *QD._DIVS, QD._ADJ, result="SELECT ticker, date, adj_close FROM adjusted WHERE date >= DATE '1995-01-01'"),
    "ticker date", "adj_close",
)
def c6_read_adjusted(spark, sf):
    """Adjusted prices of a store as they were known on a date; its later bars and actions do not reach them."""
    from tidegrid.plans.reads import read_adjusted

    s, b = scratch(spark), some_bars(spark, sf)
    s.write("bars", b)
    s.write("actions", H.actions(b))
    return read_adjusted(s, as_of=QD.AS_OF, start=D(1995, 1, 1))


_ALL_FLAGS = (
    "dup AS (SELECT 'duplicate_date', ticker, date FROM numbered WHERE n % 211 = 4)",
    "miss AS (SELECT 'missing_session', w.ticker, w.date FROM want w WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = w.ticker AND b.date = w.date))",
    "off AS (SELECT 'off_calendar', b.ticker, b.date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM want w WHERE b.ticker = w.ticker AND b.date = w.date))",
    "eight AS (SELECT * FROM flags UNION ALL SELECT * FROM dup UNION ALL SELECT * FROM miss UNION ALL SELECT * FROM off)",
    "od AS (SELECT check_name, ticker, date, CASE WHEN check_name IN ('bad_price', 'high_below_low', 'duplicate_date', 'unexplained_move') THEN 'error' ELSE 'warning' END AS severity, list_position(['bad_price', 'high_below_low', 'duplicate_date', 'unexplained_move', 'close_out_of_range', 'flat_price', 'missing_session', 'off_calendar'], check_name) AS o FROM eight)",
)


@query(
    with_(*QD.ACT, H.LISTINGS_SQL, H.SESSIONS_SQL, "spans AS (SELECT ticker, venue, min(date) AS lo, max(date) AS hi FROM bars JOIN listings USING (ticker) GROUP BY 1, 2)", QD._CLOSED, QD.EXPECTED, QD._BAD, *QD._FLAGS, *_ALL_FLAGS, QD._RULES, QD._TRIAGED.replace("FROM flags f", "FROM od f"),
          result="SELECT od.check_name, od.ticker, od.date, severity, r.verdict, row_number() OVER (ORDER BY severity <> 'error', o, od.ticker, od.date) AS position FROM od JOIN triaged t ON t.check_name = od.check_name AND t.ticker = od.ticker AND t.date = od.date LEFT JOIN rules r ON r.idx = t.idx"),
    "check_name ticker date severity verdict position",
)
def c15_run_checks(spark, sf):
    """All eight checks, triaged and in report order, on bars with defects and some dates twice."""
    from tidegrid.operators.frames import w_t

    b, ls, s, closed = QD.market(spark, sf)
    bad = QD.bad_bars(b)
    twice = bad.join(b.withColumn("n", F.row_number().over(w_t())).where("n % 211 = 4").select("ticker", "date"), ["ticker", "date"], "left_semi")
    flags = Q.run_checks(bad.unionByName(twice), M.events(H.actions(b), "split"), s, ls, QD.rules(spark), closed)
    # the order that run_checks gives, as a number
    names = F.array(*[F.lit(k) for k in Q.CHECKS])
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("severity") != "error", F.array_position(names, F.col("check")), "ticker", "date"))
    return flags.withColumn("position", place).withColumnRenamed("check", "check_name")


# ---- measures ---------------------------------------------------------------------------------


@query(
    with_(H.BARS_SQL, "f AS (SELECT ticker, date, DATE '1992-02-29' AS d0 FROM bars WHERE date > DATE '1992-02-29')", "y AS (SELECT *, year(date) - 1992 - CASE WHEN make_date(year(date), 2, CASE WHEN year(date) % 4 = 0 THEN 29 ELSE 28 END) > date THEN 1 ELSE 0 END AS y FROM f)",
          "z AS (SELECT *, make_date(1992 + y, 2, CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END) AS a, make_date(1993 + y, 2, CASE WHEN (y + 1) % 4 = 0 THEN 29 ELSE 28 END) AS b FROM y)", result="SELECT ticker, date, y + (date - a) / (b - a)::DOUBLE AS years FROM z"),
    "ticker date", "years", 9,
)
def a2_year_fraction(spark, sf):
    """Years since a leap day."""
    b = H.bars(spark, sf).where("date > '1992-02-29'")
    return b.select("ticker", "date", A.year_fraction_column(F.lit("1992-02-29").cast("date"), F.col("date")).alias("years"))


@query(
    with_(H.BARS_SQL, "t AS (SELECT ticker AS series, date, volume, date_trunc('month', date) AS decided FROM bars)", "f AS (SELECT series, min(decided) AS first FROM t GROUP BY 1)", "v AS (SELECT series, sum(volume) AS v FROM t JOIN f USING (series) WHERE decided > first GROUP BY 1)",
          result="SELECT series, coalesce(any_value(v), 0) / 2 / avg(t.volume) * 252 / greatest(count(*) - 1, 1) AS turnover FROM t LEFT JOIN v USING (series) GROUP BY series"),
    "series", "turnover",
)
def a6_turnover(spark, sf):
    b = H.bars(spark, sf)
    trades = b.select(F.col("ticker").alias("series"), F.trunc("date", "month").alias("decided"), F.col("volume").alias("value_eur"))
    return A.turnover(trades, b.select(F.col("ticker").alias("series"), "date", F.col("volume").alias("equity_eur")))


@query("SELECT trials, 1 - 0.05 / greatest(1, trials) AS level FROM (VALUES (0), (1), (20), (57)) v(trials)", "trials", "level", 9)
def a12_familywise_level(spark, sf):
    return spark.createDataFrame([(n, A.familywise_level(0.95, n)) for n in (0, 1, 20, 57)], "trials int, level double")


@query(with_(H.BARS_SQL, result="SELECT ticker, (count(*) - 1) / ((max(date) - min(date)) / 365.25) AS periods FROM bars GROUP BY ticker"), "ticker", "periods")
def a23_axis_periods(spark, sf):
    return H.bars(spark, sf).groupBy("ticker").agg(A.axis_periods(F.count("*"), F.min("date"), F.max("date")).alias("periods"))


_K = (*QP._FRAME,)
_CORR = "co AS (SELECT corr(a, b) AS ab, corr(a, v) AS av, corr(b, v) AS bv FROM k)"


def ranks(spark, sf):
    g = scored(spark, sf).where("y is not null").withColumn("v", F.col("a") * 0.5 + F.col("b"))
    return g.select("date", "ticker", *[cross_rank(F.col(c)).alias(n) for c, n in (("a", "a"), ("b", "b"), ("v", "v"), ("y", "target"))])


@query(with_(*GRID, _SCORED, *_K, _CORR, result="SELECT 'a' AS feature, NULL AS twin FROM co UNION ALL SELECT 'b', CASE WHEN abs(ab) > 0.5 THEN 'a' END FROM co UNION ALL SELECT 'v', CASE WHEN abs(av) > 0.5 THEN 'a' WHEN abs(ab) <= 0.5 AND abs(bv) > 0.5 THEN 'b' END FROM co"), "feature twin")
def a16_correlation_prune(spark, sf):
    pruned = ML.correlation_prune(ML.rank_correlation(ranks(spark, sf), ["a", "b", "v"]), ["a", "b", "v"], 0.5)
    return spark.createDataFrame(pruned, "feature string, twin string")


@query(
    with_(*GRID, _SCORED, *_K, "fu AS (SELECT a, b, v FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND v IS NOT NULL), m AS (SELECT corr(a, b) AS ab, corr(a, v) AS av, corr(b, v) AS bv FROM fu)",
          result="SELECT 'a' AS feature, (ab * ab + av * av - 2 * ab * av * bv) / (1 - bv * bv) AS share FROM m UNION ALL SELECT 'b', (ab * ab + bv * bv - 2 * ab * av * bv) / (1 - av * av) FROM m UNION ALL SELECT 'v', (av * av + bv * bv - 2 * ab * av * bv) / (1 - ab * ab) FROM m"),
    "feature", "share",
)
def a17_explained_share(spark, sf):
    return spark.createDataFrame(ML.explained_share(ranks(spark, sf), ["a", "b", "v"]), "feature string, share double")


@query(
    with_(*GRID, _SCORED, *_K, _CORR, result="SELECT 'c: not decided' AS problem UNION ALL SELECT 'b: 2 times' UNION ALL SELECT 'v: use ''maybe''' UNION ALL SELECT 'a: no reason' UNION ALL SELECT 'a and b: correlation ' || printf('%.3f', ab) FROM co WHERE abs(ab) > 0.0001"),
    "problem",
)
def a18_selection_check(spark, sf):
    chosen = [{"name": "a", "use": "model", "why": ""}, {"name": "b", "use": "model", "why": "x"}, {"name": "b", "use": "model", "why": "x"}, {"name": "v", "use": "maybe", "why": "x"}]
    corr = ML.rank_correlation(ranks(spark, sf), ["a", "b", "v"])
    return spark.createDataFrame([(p,) for p in ML.check_selection(chosen, ["a", "b", "c", "v"], corr, 0.0001)], "problem string")


_IC = "ic AS (SELECT date, round(corr(ra, ry), 9) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY date ORDER BY target) + (count(*) OVER (PARTITION BY date, target) - 1) / 2.0 AS ry FROM fr WHERE target IS NOT NULL) GROUP BY date HAVING count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(ry) > 0)"


@query(with_(*GRID, _SCORED, *_K, _IC, result="SELECT year(date) AS year, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS share_positive, avg(ic) / stddev_samp(ic) * sqrt(count(*)) / sqrt(21.0) AS t FROM ic GROUP BY 1"), "year n", "mean std share_positive t")
def a21_ic_summary(spark, sf):
    """The information coefficient's summary for each year, as it is made for each fold."""
    f = QP.model_frame(spark, sf).where("target is not null")
    ic = L.information_coefficient(f.withColumnRenamed("a", "s"), "s", "target").where("ic is not null")
    return ML.ic_summary(ic.withColumns({"year": F.year("date"), "ic": F.round("ic", 9)}), by=["year"])


@query(
    with_(*GRID, _SCORED, *_K, result="SELECT date, count(*) AS n, corr(ra, rb) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY date ORDER BY b) + (count(*) OVER (PARTITION BY date, b) - 1) / 2.0 AS rb FROM fr) GROUP BY date HAVING count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0"),
    "date n", "ic",
)
def x10_score_correlation(spark, sf):
    f = QP.model_frame(spark, sf)
    return ML.score_correlation(f.withColumn("score", F.col("a")), f.withColumn("score", F.col("b"))).where("ic is not null")


@query(with_(H.BARS_SQL, QP.CURVES, QP._LINE, QP._DRAWS, QP._RESAMPLED, result="SELECT 'a' AS series, quantile_cont(sa, 0.025) AS low, quantile_cont(sa, 0.975) AS high, stddev_samp(sa) AS se FROM smp UNION ALL SELECT 'b', quantile_cont(sb, 0.025), quantile_cont(sb, 0.975), stddev_samp(sb) FROM smp"), "series", "low high se")
def z1_sharpe_intervals(spark, sf):
    line, starts, n = QP.excess_line(spark, sf)
    return A.sharpe_intervals(line, starts, n, ["a", "b"])


@query(with_(H.BARS_SQL, "ax AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars))", result="SELECT ticker, date, close FROM bars JOIN ax USING (date) WHERE i BETWEEN 1021 AND 1420"), "ticker date", "close", 9)
def z8_fold_select(spark, sf):
    folds = L.fold_table(spark, QP.fold_dates(spark, sf)[0])
    return L.select_fold(H.bars(spark, sf), folds, 1, "test")


# ---- models -----------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('gbt', 'score'), ('gbt_clf', 'probability'), ('logit', 'probability'), ('ridge', 'score')) v(name, output)", "name output")
def m1_model_registry(spark, sf):
    return spark.createDataFrame(ML.registry(), "name string, output string")


@query(
    with_(*GRID, _SCORED, *_K, "x AS (SELECT date, ticker, target, date < DATE '1997-01-01' AS early FROM fr)",
          result="SELECT 'rows' AS check_name, false AS passed UNION ALL SELECT 'folds', false UNION ALL SELECT 'targets', false UNION ALL SELECT 'unique', true UNION ALL SELECT 'scores', true UNION ALL SELECT 'axis', false UNION ALL SELECT 'span', false UNION ALL SELECT 'names', true UNION ALL SELECT 'coverage', false UNION ALL SELECT 'order', true"),
    "check_name passed",
)
def m9_fairness(spark, sf):
    """Ten checks on two prediction tables, the second of which ends early."""
    f = QP.model_frame(spark, sf).select("date", "ticker", "target", F.col("a").alias("score"), F.year("date").alias("fold"))
    return ML.fairness(f, f.where("date < '1997-01-01'")).withColumnRenamed("check", "check_name")
