"""Queries of stores, upserts, as-of joins, market data and quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegrid import pit
from tidegrid.operators import market as M
from tidegrid.operators import quality as Q
from tidegrid.operators.frames import w_t, carry_onto, session_grid
from tidegrid.operators.upsert import compare, counts
from tidegrid.plans import harness as H
from tidegrid.plans.catalog import query, with_
from tidegrid.sources import store as S

GRID = (H.BARS_SQL, H.LISTINGS_SQL, H.SESSIONS_SQL, H.GRID_SQL)
AS_OF = dt.date(1997, 6, 30)
ASKED = ["Brand#25", "Brand#3", "Brand#none", "Brand#11"]


@query(with_(H.BARS_SQL, result="SELECT * FROM bars WHERE ticker IN ('Brand#3', 'Brand#11') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"), "ticker date", "open high low close volume", 9)
def s1_read_bars(spark, sf):
    return S.read_bars(H.bars(spark, sf), ["Brand#3", "Brand#11"], as_of=AS_OF, start=dt.date(1996, 1, 1))


@query(with_(H.BARS_SQL, result="SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker"), "ticker last_date")
def s3_max_stored_dates(spark, sf):
    return S.max_stored_dates(H.bars(spark, sf))


@query(with_(H.BARS_SQL, "asked AS (SELECT * FROM (VALUES (0, 'Brand#25'), (1, 'Brand#3'), (2, 'Brand#none'), (3, 'Brand#11')) v(position, ticker))", result="SELECT position, a.ticker, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(date) AS bars FROM asked a LEFT JOIN bars b ON a.ticker = b.ticker GROUP BY 1, 2"), "position ticker first_date last_date bars")
def s5_coverage(spark, sf):
    return S.coverage(H.bars(spark, sf), ASKED).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(with_(H.BARS_SQL, result="SELECT DISTINCT ticker FROM bars"), "ticker")
def s6_stored_tickers(spark, sf):
    return S.stored_tickers(H.bars(spark, sf))


#: A later delivery: bars from a date on, every seventh volume changed, against a store that ends a year later.
_DELIVERY = (
    "stored AS (SELECT ticker, date, close, volume FROM bars WHERE date < DATE '1997-01-01')",
    "incoming AS (SELECT ticker, date, close, volume + CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS volume FROM bars WHERE date >= DATE '1996-01-01')",
)


def delivery(spark, sf):
    b = H.bars(spark, sf).select("ticker", "date", "close", "volume")
    new = b.where("date >= '1996-01-01'").withColumn("volume", F.col("volume") + F.when(F.col("volume").cast("long") % 7 == 0, 1).otherwise(0))
    return b.where("date < '1997-01-01'"), new


@query(
    with_(H.BARS_SQL, *_DELIVERY, result="SELECT coalesce(s.ticker, i.ticker) AS ticker, count(*) FILTER (s.ticker IS NULL) AS added, count(*) FILTER (s.ticker IS NOT NULL AND i.ticker IS NOT NULL AND (s.close IS DISTINCT FROM i.close OR s.volume IS DISTINCT FROM i.volume)) AS updated, count(*) FILTER (s.ticker IS NOT NULL AND i.ticker IS NOT NULL AND NOT (s.close IS DISTINCT FROM i.close OR s.volume IS DISTINCT FROM i.volume)) AS unchanged FROM stored s FULL JOIN incoming i ON s.ticker = i.ticker AND s.date = i.date GROUP BY 1"),
    "ticker added updated unchanged",
)
def s9_upsert_counts(spark, sf):
    old, new = delivery(spark, sf)
    return counts(compare(old, new, ["ticker", "date"], ["close", "volume"]), ["ticker"])


@query(with_(H.BARS_SQL, *_DELIVERY, result="SELECT ticker, date, close, volume FROM incoming UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.ticker = s.ticker AND i.date = s.date)"), "ticker date", "close volume", 9)
def s9_upsert_rows(spark, sf):
    from tidegrid.operators.upsert import upsert

    old, new = delivery(spark, sf)
    return upsert(old, new, ["ticker", "date"], ["close", "volume"])


@query(with_(H.BARS_SQL, "n AS (SELECT ticker, date, close AS dividends, CASE WHEN CAST(volume AS BIGINT) % 50 = 0 THEN 2.0 ELSE 0.0 END AS splits FROM bars)", result="SELECT ticker, date, 'dividend' AS action, dividends AS value FROM n WHERE dividends <> 0 UNION ALL SELECT ticker, date, 'split', splits FROM n WHERE splits <> 0"), "ticker date action", "value", 9)
def s15_actions_adapter(spark, sf):
    b = H.bars(spark, sf)
    response = b.select("ticker", F.col("date").alias("Date"), F.col("close").alias("Dividends"), F.when(F.col("volume").cast("long") % 50 == 0, 2.0).otherwise(0.0).alias("Stock Splits"))
    return S.to_actions(F.col("ticker"), response)


@query(with_(H.BARS_SQL, "m AS (SELECT ticker, max(date) AS d FROM bars GROUP BY 1)", result="SELECT ticker, greatest(DATE '1998-10-01', d - 5) AS start FROM m"), "ticker start")
def s19_incremental_start(spark, sf):
    ends = S.max_stored_dates(H.bars(spark, sf))
    return ends.select("ticker", S.incremental_start(F.lit("1998-10-01").cast("date"), F.col("last_date")).alias("start"))


@query(
    "SELECT substr(sha1(event_type || chr(10) || 'w=' || (user_id % 5)), 1, 12) AS id, event_type AS family, 'w=' || (user_id % 5) AS params, count(*) AS runs, min(CAST(ts AS DATE)) AS first_logged, max(CAST(ts AS DATE)) AS last_logged FROM events GROUP BY 1, 2, 3",
    "id family params runs first_logged last_logged",
)
def s24_trials_ledger(spark, sf):
    e = H.table(spark, sf, "events")
    new = e.select(F.col("event_type").alias("family"), F.concat(F.lit("w="), (F.col("user_id") % 5).cast("string")).alias("params"), F.to_date("ts").alias("logged"), F.col("value").alias("sharpe"))
    empty = spark.createDataFrame([], "id string, family string, params string, first_logged date, last_logged date, runs long, sharpe double")
    return S.record_trials(empty, new)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1", "user_id event_id event_type")
def s25_last_rows(spark, sf):
    return S.last_rows(H.table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query(with_(H.BARS_SQL, result="SELECT ticker, date, close FROM bars WHERE date <= DATE '1997-06-30'"), "ticker date", "close", 9)
def f3_guarded_read(spark, sf):
    return pit.guard(S.read_bars(H.bars(spark, sf), as_of=AS_OF), AS_OF)


# ---- as-of and grids --------------------------------------------------------------------------

_TO_EUR = (
    "px AS (SELECT b.*, currency, venue, CASE WHEN currency <> 'EUR' THEN 'EUR' || currency END AS pair FROM bars b LEFT JOIN listings USING (ticker))",
    "last_fx AS (SELECT pair, max(date) AS last FROM fx WHERE rate IS NOT NULL GROUP BY pair)",
    "aj AS (SELECT px.*, f.rate, f.date AS fdate, l.last FROM px ASOF LEFT JOIN fx f ON px.pair = f.pair AND px.date >= f.date LEFT JOIN last_fx l ON l.pair = px.pair)",
    "eur AS (SELECT ticker, date, close, CASE WHEN currency = 'EUR' THEN 1.0 WHEN date - fdate <= 5 AND date <= last THEN 1 / rate END * close * CASE WHEN venue = 'XLON' THEN 0.01 ELSE 1 END AS close_eur FROM aj)",
)


@query(with_(H.BARS_SQL, H.LISTINGS_SQL, H.FX_SQL, *_TO_EUR, result="SELECT ticker, date, close_eur FROM eur"), "ticker date", "close_eur")
def j7_asof_fx(spark, sf):
    return M.to_eur(H.bars(spark, sf).select("ticker", "date", "close"), H.fx(spark, sf), H.listings(spark, sf))


_SHORT = "sr AS (SELECT date, arg_min(rate, CASE series WHEN 'ESTR' THEN 1 ELSE 2 END) AS rate FROM rates GROUP BY date)"


@query(with_(H.RATES_SQL, _SHORT, result="SELECT * FROM sr"), "date", "rate")
def c11_short_rate(spark, sf):
    return M.short_rate(H.rates(spark, sf))


@query(
    with_(H.BARS_SQL, H.RATES_SQL, _SHORT, "dd AS (SELECT DISTINCT date FROM bars)", "k AS (SELECT dd.date, CASE WHEN dd.date - sr.date <= 7 THEN rate END AS rate FROM dd ASOF LEFT JOIN sr ON dd.date >= sr.date)",
          result="SELECT date, CASE WHEN row_number() OVER (ORDER BY date) = 1 THEN 0 ELSE lag(rate) OVER (ORDER BY date) / 100 * (date - lag(date) OVER (ORDER BY date)) / 360.0 END AS rf FROM k"),
    "date", "rf", 9,
)
def j8_risk_free(spark, sf):
    return M.risk_free_returns(H.bars(spark, sf).select("date"), H.rates(spark, sf))


@query(with_(*GRID, result="SELECT ticker, date, stored, close FROM grid"), "ticker date stored", "close", 9)
def j9_session_grid(spark, sf):
    b, ls = H.bars(spark, sf), H.listings(spark, sf)
    return session_grid(b, H.sessions(b, ls), ls.select("ticker", "venue"))


@query(
    with_(*GRID, "u AS (SELECT coalesce(h.ticker, w.ticker) AS ticker, coalesce(h.date, w.date) AS date, close, w.date IS NOT NULL AS g FROM bars h FULL JOIN days w ON h.ticker = w.ticker AND h.date = w.date)",
          "c AS (SELECT ticker, date, g, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM u)", result="SELECT ticker, date, close FROM c WHERE g"),
    "ticker date", "close", 9,
)
def j10_carry_onto(spark, sf):
    """Each ticker's closes carried onto its venue's sessions, five of them at most."""
    b, ls = H.bars(spark, sf), H.listings(spark, sf)
    days = session_grid(b.select("ticker", "date"), H.sessions(b, ls), ls.select("ticker", "venue")).select("ticker", "date")
    return carry_onto(b.select("ticker", "date", "close"), days, "close", 5, ["ticker"])


# ---- corporate actions ------------------------------------------------------------------------

ACT = (H.BARS_SQL, H.ACTIONS_SQL)
_VIS = (
    "sp AS (SELECT ticker, date, sum(value) AS ratio FROM actions WHERE action = 'split' GROUP BY 1, 2)",
    "vis AS (SELECT sp.*, (SELECT arg_min(close, b.date) FROM bars b WHERE b.ticker = sp.ticker AND b.date >= sp.date) / (SELECT arg_max(close, b.date) FROM bars b WHERE b.ticker = sp.ticker AND b.date < sp.date) AS move FROM sp)",
    "vis2 AS (SELECT ticker, date, ratio, move, abs(ln(ratio)) < 0.2 AS ambiguous, coalesce(abs(ln(ratio)) >= 0.2 AND abs(ln(move * ratio)) < abs(ln(move)), false) AS in_bars FROM vis)",
)
_SPLITF = "sf AS (SELECT b.ticker, b.date, b.close, coalesce((SELECT product(1 / ratio) FROM vis2 v WHERE v.ticker = b.ticker AND v.in_bars AND v.date > b.date), 1.0) AS split_factor FROM bars b)"
_DIVS = (
    "dv AS (SELECT ticker, date, sum(value) AS value FROM actions WHERE action = 'dividend' GROUP BY 1, 2)",
    "base AS (SELECT ticker, date, close * split_factor AS base FROM sf)",
    "df AS (SELECT dv.ticker, dv.date, 1 - dv.value / b.base AS factor FROM dv ASOF JOIN base b ON dv.ticker = b.ticker AND dv.date > b.date)",
)
_ADJ = "adj AS (SELECT sf.*, coalesce((SELECT exp(sum(ln(factor))) FROM df WHERE df.ticker = sf.ticker AND df.date > sf.date), 1.0) AS dividend_factor FROM sf), adjusted AS (SELECT *, close * split_factor * dividend_factor AS adj_close FROM adj)"


def act(spark, sf):
    b = H.bars(spark, sf)
    return b, H.actions(b)


@query(with_(*ACT, *_VIS, result="SELECT * FROM vis2"), "ticker date ambiguous in_bars", "ratio move")
def c1_split_visibility(spark, sf):
    return M.split_visibility(*act(spark, sf))


@query(with_(*ACT, *_VIS, _SPLITF, result="SELECT ticker, date, split_factor FROM sf"), "ticker date", "split_factor")
def c2_split_factors(spark, sf):
    return M.split_factors(*act(spark, sf))


@query(with_(*ACT, *_VIS, _SPLITF, *_DIVS, result="SELECT * FROM df"), "ticker date", "factor", 8)
def c3_dividend_factors(spark, sf):
    return M.dividend_events(*act(spark, sf))


@query(with_(*ACT, result="SELECT ticker, date, sum(value) AS value FROM actions WHERE action = 'dividend' GROUP BY 1, 2"), "ticker date", "value")
def c4_events(spark, sf):
    return M.events(act(spark, sf)[1], "dividend")


@query(with_(*ACT, *_VIS, _SPLITF, *_DIVS, _ADJ, result="SELECT ticker, date, split_factor, dividend_factor, adj_close FROM adjusted"), "ticker date", "split_factor dividend_factor adj_close")
def c5_adjust(spark, sf):
    return M.adjust(*act(spark, sf))


@query(
    with_(*ACT, H.LISTINGS_SQL, H.FX_SQL, *_TO_EUR, *_VIS, _SPLITF, *_DIVS, _ADJ, result="SELECT a.ticker, a.date, adj_close, close_eur, adj_close * close_eur / a.close AS adj_close_eur FROM adjusted a LEFT JOIN eur e ON a.ticker = e.ticker AND a.date = e.date"),
    "ticker date", "adj_close close_eur adj_close_eur",
)
def c9_total_return(spark, sf):
    b, a = act(spark, sf)
    eur = M.to_eur(b, H.fx(spark, sf), H.listings(spark, sf))
    return M.total_return(eur, a)


@query(with_(H.BARS_SQL, H.LISTINGS_SQL, H.FX_SQL, *_TO_EUR, "stored AS (SELECT ticker, date, CASE WHEN CAST(floor(close) AS BIGINT) % 3 = 0 THEN close ELSE close_eur END AS old FROM eur)", result="SELECT e.ticker, e.date, e.close_eur FROM eur e JOIN stored s ON e.ticker = s.ticker AND e.date = s.date WHERE s.old IS DISTINCT FROM e.close_eur"), "ticker date", "close_eur")
def c8_refresh_close_eur(spark, sf):
    b, f, ls = H.bars(spark, sf), H.fx(spark, sf), H.listings(spark, sf)
    eur = M.to_eur(b, f, ls)
    old = eur.withColumn("close_eur", F.when(F.floor("close") % 3 == 0, F.col("close")).otherwise(F.col("close_eur")))
    return M.refresh_close_eur(old, f, ls)


@query(with_(H.BARS_SQL, H.LISTINGS_SQL, H.FX_SQL, *_TO_EUR, "r AS (SELECT ticker, date, close / first_value(close IGNORE NULLS) OVER w AS li, close_eur / first_value(close_eur IGNORE NULLS) OVER w AS ei FROM eur WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", result="SELECT ticker, date, li AS local_index, ei AS eur_index, li / ei AS fx_index, coalesce(abs(ei - li / (li / ei)) <= 1e-4, false) AS holds FROM r"), "ticker date holds", "local_index eur_index fx_index")
def c10_divergence(spark, sf):
    eur = M.to_eur(H.bars(spark, sf).select("ticker", "date", "close"), H.fx(spark, sf), H.listings(spark, sf))
    return M.divergence(eur.select("ticker", "date", F.col("close").alias("local"), F.col("close_eur").alias("eur")))


@query(with_(*ACT, *_VIS, _SPLITF, *_DIVS, _ADJ, "g AS (SELECT ticker, date, abs(adj_close / close - 1) AS gap FROM adjusted)", result="SELECT ticker, max(gap) AS worst, count(*) AS n, max(gap) > 0.005 AS diverges FROM g GROUP BY ticker"), "ticker n diverges", "worst")
def c17_compare_adjusted(spark, sf):
    b, a = act(spark, sf)
    return M.compare_adjusted(M.adjust(b, a), b.select("ticker", "date", F.col("close").alias("adj_close")))


# ---- comparisons ------------------------------------------------------------------------------


@query(with_(*GRID, result="SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) / first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS growth FROM grid"), "ticker date", "growth")
def c19_growth(spark, sf):
    b, ls = H.bars(spark, sf), H.listings(spark, sf)
    return M.growth(session_grid(b, H.sessions(b, ls), ls.select("ticker", "venue")), "close")


@query(with_(H.BARS_SQL, "r AS (SELECT date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)", "d AS (SELECT date, coalesce(avg(r), 0) AS r FROM r GROUP BY date)", result="SELECT date, sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS log_growth FROM d"), "date", "log_growth")
def c19_equal_weight(spark, sf):
    return M.equal_weight(H.bars(spark, sf), "close")


@query(
    with_(H.BARS_SQL, "own AS (SELECT ticker, date, close FROM bars)", "dd AS (SELECT DISTINCT date FROM own)", "lo AS (SELECT ticker, min(date) AS lo FROM own GROUP BY 1)",
          result="SELECT lo.ticker, dd.date, last_value(close IGNORE NULLS) OVER (PARTITION BY lo.ticker ORDER BY dd.date ROWS UNBOUNDED PRECEDING) AS close FROM lo JOIN dd ON dd.date >= lo LEFT JOIN own ON own.ticker = lo.ticker AND own.date = dd.date"),
    "ticker date", "close", 9,
)
def c20_union_calendar(spark, sf):
    return M.on_union_calendar(H.bars(spark, sf), "close")


@query(
    with_(H.BARS_SQL, "bench AS (SELECT date, avg(close) AS bench FROM (SELECT date, close FROM bars ORDER BY date, ticker) GROUP BY date)",
          "s AS (SELECT ticker, min(date) AS since, arg_max(close, date) / arg_min(close, date) AS own FROM bars GROUP BY 1)", "z AS (SELECT arg_max(bench, date) AS last FROM bench)",
          result="SELECT ticker, since, own, last / b.bench AS bench, own > last / b.bench AS ahead FROM s JOIN bench b ON b.date = since CROSS JOIN z"),
    "ticker since ahead", "own bench",
)
def c20_outperformers(spark, sf):
    b = H.bars(spark, sf)
    return M.outperformers(b, b.groupBy("date").agg(F.avg("close").alias("bench")), "close")


@query(
    with_(H.BARS_SQL, "r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)", "a AS (SELECT ticker, arg_max(close, date) / arg_min(close, date) AS t, (max(date) - min(date)) / 365.25 AS y, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY 1)",
          result="SELECT ticker, t - 1 AS total, pow(t, 1 / y) - 1 AS cagr, s * sqrt(252.0) AS vol, m / s * sqrt(252.0) AS sharpe FROM a"),
    "ticker", "total cagr vol sharpe",
)
def c21_performance(spark, sf):
    return M.performance(H.bars(spark, sf), "close")


# ---- quality ----------------------------------------------------------------------------------

#: Closures of a year's first days, and bars with defects of each kind.
_CLOSED = "closures AS (SELECT DISTINCT venue, date FROM sessions WHERE month(date) = 7 AND day(date) = 4)"
_BAD = """bad AS (SELECT ticker, date, open, CASE WHEN n % 97 = 3 THEN low / 2 ELSE high END AS high, low,
  CASE WHEN n % 89 = 5 THEN NULL WHEN n % 101 BETWEEN 10 AND 15 THEN 500.0 WHEN n % 83 = 1 THEN high * 1.5 ELSE close END AS close, volume FROM numbered)"""
EXPECTED = "want AS (SELECT ticker, s.date FROM spans JOIN (SELECT * FROM sessions ANTI JOIN closures USING (venue, date)) s USING (venue) WHERE s.date BETWEEN lo AND hi)"


def market(spark, sf):
    b, ls = H.bars(spark, sf), H.listings(spark, sf)
    s = H.sessions(b, ls)
    return b, ls, s, s.where("month(date) = 7 and day(date) = 4")


def bad_bars(b):
    n = b.withColumn("n", F.row_number().over(w_t()))
    close = F.when(F.col("n") % 89 == 5, F.lit(None)).when((F.col("n") % 101).between(10, 15), 500.0).when(F.col("n") % 83 == 1, F.col("high") * 1.5).otherwise(F.col("close"))
    return n.select("ticker", "date", "open", F.when(F.col("n") % 97 == 3, F.col("low") / 2).otherwise(F.col("high")).alias("high"), "low", close.alias("close"), "volume")


@query(
    with_(*GRID, _CLOSED, EXPECTED, "exc AS (SELECT ticker, c.date FROM spans JOIN closures c USING (venue) WHERE c.date BETWEEN lo AND hi)",
          result="SELECT ticker, (SELECT count(*) FROM want w WHERE w.ticker = t.ticker AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = w.ticker AND b.date = w.date)) AS missing, (SELECT count(*) FROM bars b WHERE b.ticker = t.ticker AND NOT EXISTS (SELECT 1 FROM want w WHERE b.ticker = w.ticker AND b.date = w.date)) AS off_calendar, (SELECT count(*) FROM exc e WHERE e.ticker = t.ticker) AS excused FROM (SELECT DISTINCT ticker FROM bars) t"),
    "ticker missing off_calendar excused",
)
def c13_session_gaps(spark, sf):
    b, ls, s, closed = market(spark, sf)
    return Q.session_gaps(b, s, ls, closed)


_FLAGS = (
    "one AS (SELECT * FROM bad)",
    "q1 AS (SELECT 'bad_price' AS check_name, ticker, date FROM one WHERE open IS NULL OR open <= 0 OR high IS NULL OR high <= 0 OR low IS NULL OR low <= 0 OR close IS NULL OR close <= 0)",
    "q2 AS (SELECT 'high_below_low', ticker, date FROM one WHERE high < low)",
    "q3 AS (SELECT 'close_out_of_range', ticker, date FROM one WHERE (close > high * (1 + 1e-9) OR close < low * (1 - 1e-9)) AND NOT high < low)",
    "pos AS (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS pd FROM one WHERE close > 0)",
    "q4 AS (SELECT 'unexplained_move', ticker, date FROM pos WHERE abs(close / pc - 1) > 0.4 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.action = 'split' AND a.ticker = pos.ticker AND a.date > pd AND a.date <= pos.date AND abs(close / pc * a.value - 1) <= 0.4))",
    "fl AS (SELECT *, sum(CASE WHEN close = pc2 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc2 FROM one))",
    "runs AS (SELECT ticker, min(date) AS start, max(date) AS stop, count(*) AS n FROM fl WHERE close IS NOT NULL GROUP BY ticker, run HAVING count(*) >= 5)",
    "q5 AS (SELECT 'flat_price', ticker, start FROM runs)",
    "flags AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4 UNION ALL SELECT * FROM q5)",
)


@query(with_(*ACT, _BAD, *_FLAGS, result="SELECT * FROM flags"), "check_name ticker date")
def c14_bar_flags(spark, sf):
    b, a = act(spark, sf)
    return Q.bar_flags(bad_bars(b), M.events(a, "split")).withColumnRenamed("check", "check_name")


@query(with_(*ACT, _BAD, *_FLAGS, result="SELECT ticker, start, stop, n FROM runs"), "ticker start stop n")
def t30_flat_runs(spark, sf):
    return Q.flat_runs(bad_bars(H.bars(spark, sf))).withColumnRenamed("end", "stop")


@query(with_(*ACT, _BAD, *_FLAGS, result="SELECT q4.ticker, q4.date, close / pc AS move FROM q4 JOIN pos ON q4.ticker = pos.ticker AND q4.date = pos.date"), "ticker date", "move")
def t31_unexplained_moves(spark, sf):
    b, a = act(spark, sf)
    return Q.moves(bad_bars(b), M.events(a, "split"))


_RULES = "rules AS (SELECT * FROM (VALUES (0, 'flat_price', 'Brand#3', DATE '1995-01-01', DATE '1996-12-31', 'expected'), (1, 'flat_price', 'V1', NULL, NULL, 'bad-data'), (2, 'bad_price', 'XLON', NULL, DATE '1997-12-31', 'bad-data'), (3, 'bad_price', 'Brand#2', NULL, NULL, 'expected'), (4, 'bad_price', 'Brand#none', NULL, NULL, 'expected')) v(idx, chk, scope, s, e, verdict))"


def rules(spark):
    d = dt.date
    rows = [(0, "flat_price", "Brand#3", d(1995, 1, 1), d(1996, 12, 31), "expected", ""), (1, "flat_price", "V1", None, None, "bad-data", ""), (2, "bad_price", "XLON", None, d(1997, 12, 31), "bad-data", ""), (3, "bad_price", "Brand#2", None, None, "expected", ""), (4, "bad_price", "Brand#none", None, None, "expected", "")]
    return spark.createDataFrame(rows, "idx int, check string, scope string, start date, end date, verdict string, reason string")


_TRIAGED = "triaged AS (SELECT f.check_name, f.ticker, f.date, (SELECT min(idx) FROM rules r WHERE r.chk = f.check_name AND (r.scope = f.ticker OR r.scope = l.venue) AND f.date BETWEEN coalesce(s, DATE '0001-01-01') AND coalesce(e, DATE '9999-12-31')) AS idx FROM flags f LEFT JOIN listings l ON l.ticker = f.ticker)"


@query(with_(*ACT, H.LISTINGS_SQL, _BAD, *_FLAGS, _RULES, _TRIAGED, result="SELECT check_name, ticker, date, t.idx AS rule, verdict FROM triaged t LEFT JOIN rules r ON r.idx = t.idx"), "check_name ticker date rule verdict")
def j11_triage(spark, sf):
    b, a = act(spark, sf)
    flags = Q.bar_flags(bad_bars(b), M.events(a, "split"))
    return Q.apply_triage(flags, rules(spark), H.listings(spark, sf)).select(F.col("check").alias("check_name"), "ticker", "date", F.col("idx").alias("rule"), "verdict")


@query(with_(*ACT, H.LISTINGS_SQL, _BAD, *_FLAGS, _RULES, _TRIAGED, result="SELECT idx FROM rules WHERE idx NOT IN (SELECT idx FROM triaged WHERE idx IS NOT NULL)"), "idx")
def j11_unused_rules(spark, sf):
    b, a = act(spark, sf)
    return Q.unused_rules(rules(spark), Q.apply_triage(Q.bar_flags(bad_bars(b), M.events(a, "split")), rules(spark), H.listings(spark, sf)))


@query(
    with_(*ACT, H.LISTINGS_SQL, _BAD, *_FLAGS, _RULES, _TRIAGED, "w AS (SELECT DISTINCT check_name, ticker, date FROM triaged JOIN rules USING (idx) WHERE verdict = 'bad-data')",
          "old AS (SELECT 'bad_price' AS check_name, ticker, date FROM numbered WHERE n % 89 = 5 OR n % 89 = 7)",
          result="SELECT coalesce(o.check_name, w.check_name) AS check_name, coalesce(o.ticker, w.ticker) AS ticker, coalesce(o.date, w.date) AS date, o.ticker IS NULL AS opened, w.ticker IS NULL AS closed FROM old o FULL JOIN w ON o.check_name = w.check_name AND o.ticker = w.ticker AND o.date = w.date"),
    "check_name ticker date opened closed",
)
def c16_quarantine(spark, sf):
    b, a = act(spark, sf)
    bad = bad_bars(b)
    triaged = Q.apply_triage(Q.bar_flags(bad, M.events(a, "split")), rules(spark), H.listings(spark, sf))
    n = bad.withColumn("n", F.row_number().over(w_t())).where("n % 89 in (5, 7)")
    then, now = F.lit("2020-01-01").cast("timestamp"), F.lit("2021-01-01").cast("timestamp")
    old = n.select("ticker", "date", F.lit("bad_price").alias("check"), "open", "high", "low", "close", "volume", F.lit("error").alias("severity"), F.lit("").alias("detail"), F.lit("").alias("reason"), then.alias("quarantined_at"), F.lit(None).cast("timestamp").alias("released_at"))
    records, _ = Q.apply_quarantine(old, triaged, bad, now)
    return records.select(F.col("check").alias("check_name"), "ticker", "date", (F.col("quarantined_at") == now).alias("opened"), F.col("released_at").isNotNull().alias("closed"))


@query(with_(H.BARS_SQL, H.LISTINGS_SQL, result="SELECT l.ticker, max(date) AS last_date, DATE '1998-12-10' - max(date) AS age, CASE WHEN max(date) IS NULL THEN 'empty' WHEN DATE '1998-12-10' - max(date) > 5 THEN 'stale' ELSE 'ok' END AS status FROM listings l LEFT JOIN bars b ON b.ticker = l.ticker GROUP BY 1"), "ticker last_date status", "age")
def c18_freshness(spark, sf):
    return Q.freshness(H.bars(spark, sf), H.listings(spark, sf), F.lit("1998-12-10").cast("date"))
