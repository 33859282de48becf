"""Queries of metrics, bootstrap, portfolios, folds, models, calibration, the panel and event bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegrid.functions import features as X
from tidegrid.operators import labels as L
from tidegrid.operators import market as M
from tidegrid.operators import metrics as A
from tidegrid.operators import models as ML
from tidegrid.operators import portfolio as B
from tidegrid.operators.frames import cross_rank
from tidegrid.plans import book_sql as S
from tidegrid.plans import harness as H
from tidegrid.plans import panel as P
from tidegrid.plans.catalog import query, with_
from tidegrid.plans.queries_features import GRID, _SCORED, grid, lagged, scored, stored
from tidegrid.streaming.ingest import event_bars

#: An equity curve for each ticker: its closes; excess over a fixed rate.
CURVES = "curve AS (SELECT ticker AS series, date, close AS value FROM bars), r AS (SELECT *, value / lag(value) OVER (PARTITION BY series ORDER BY date) - 1 AS ret FROM curve)"


def curves(spark, sf):
    return H.bars(spark, sf).select(F.col("ticker").alias("series"), "date", F.col("close").alias("value"))


@query(
    with_(H.BARS_SQL, CURVES, "x AS (SELECT series, date, value, ret, ret - 0.0001 AS ex FROM r)",
          "g AS (SELECT series, arg_max(value, date) / arg_min(value, date) AS t, stddev_samp(ret) * sqrt(252.0) AS vol, avg(ex) / stddev_samp(ex) * sqrt(252.0) AS sharpe, avg(ex) / sqrt(avg(CASE WHEN ex IS NOT NULL THEN least(ex, 0) * least(ex, 0) END)) * sqrt(252.0) AS sortino, count(*) FILTER (ret > 0) / nullif(count(*) FILTER (ret <> 0), 0)::DOUBLE AS hit_rate, avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret < 0) AS avg_loss, count(ret) AS n FROM x GROUP BY series)",
          result="SELECT series, n, t - 1 AS total, vol, sharpe, sortino, hit_rate, avg_win, avg_loss, avg_win / -avg_loss AS payoff FROM g"),
    "series n", "total vol sharpe sortino hit_rate avg_win avg_loss payoff",
)
def a1_metrics(spark, sf):
    r = A.session_returns(curves(spark, sf))
    rf = r.select("date").distinct().withColumn("rf", F.lit(0.0001))
    return A.summary(A.excess_returns(r, rf))


@query(with_(H.BARS_SQL, CURVES, result="SELECT series, date, value / max(value) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve"), "series date", "drawdown")
def a4_drawdown_series(spark, sf):
    return A.drawdown_series(curves(spark, sf))


@query(
    with_(H.BARS_SQL, CURVES, "k AS (SELECT *, coalesce(value >= max(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top FROM curve)",
          "i AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS id, min(date) FILTER (top) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM k)",
          "g AS (SELECT series, id, min(date) AS peak, arg_min(date, {'v': value, 'd': date}) AS trough, arg_min(nxt, date) AS recovery, min(value) / max(value) FILTER (top) AS r, count(*) AS n, max(date) AS last FROM i GROUP BY 1, 2)",
          result="SELECT series, peak, trough, coalesce(CAST(recovery AS VARCHAR), 'open') AS recovery, r - 1 AS depth, CASE WHEN recovery IS NULL THEN n - 1 ELSE n END AS sessions, coalesce(recovery, last) - peak AS days FROM g WHERE n > 1"),
    "series peak trough recovery sessions days", "depth",
)
def a4_drawdown_episodes(spark, sf):
    return A.drawdown_episodes(curves(spark, sf)).withColumn("recovery", F.coalesce(F.col("recovery").cast("string"), F.lit("open")))


@query(
    with_(H.BARS_SQL, "held AS (SELECT ticker, date FROM bars WHERE CAST(volume AS BIGINT) % 3 <> 0)", "ax AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars))",
          "g AS (SELECT ticker, h.date, i - row_number() OVER (PARTITION BY ticker ORDER BY h.date) AS run FROM held h JOIN ax USING (date))", result='SELECT ticker, min(date) AS "start", max(date) AS stop, count(*) AS sessions FROM g GROUP BY ticker, run'),
    'ticker start stop sessions',
)
def a7_holding_spells(spark, sf):
    b = H.bars(spark, sf)
    one = b.withColumn("series", F.lit("all"))
    return A.holding_spells(one.where(F.col("volume").cast("long") % 3 != 0).select("series", "ticker", "date"), one.select("series", "date")).withColumnRenamed("end", "stop")


def _periods(unit: str) -> str:
    return with_(H.BARS_SQL, CURVES, f"e AS (SELECT series, CAST(date_trunc('{unit}', date) AS DATE) AS period, arg_max(value, date) AS last, arg_min(value, date) AS first, count(*) AS n FROM curve GROUP BY 1, 2)",
                 "b AS (SELECT *, lag(last) OVER (PARTITION BY series ORDER BY period) AS before FROM e)", result="SELECT series, period, last / coalesce(before, first) - 1 AS ret FROM b WHERE NOT (before IS NULL AND n = 1)")


@query(_periods("year"), "series period", "ret")
def a8_calendar_returns(spark, sf):
    return A.period_returns(curves(spark, sf), "year")


@query(_periods("month"), "series period", "ret")
def a8_monthly_returns(spark, sf):
    return A.period_returns(curves(spark, sf), "month")


@query(with_(H.BARS_SQL, CURVES, result="SELECT series, date, CASE WHEN count(ret) OVER w = 63 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252.0) END AS sharpe FROM r WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"), "series date", "sharpe")
def t29_rolling_sharpe(spark, sf):
    return A.rolling_sharpe(A.session_returns(curves(spark, sf)), 63)


#: The market's sessions: each day's mean return over all tickers; resampled with blocks whose starts are arithmetic,
#: so that SQL can draw the same.
_REPS = 5000
_LINE = "line AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, m - 0.0001 AS a, m * 0.5 + 0.01 AS b FROM (SELECT date, avg(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY date)), sz AS (SELECT count(*) AS n FROM line)"
_DRAWS = f"draws AS (SELECT rep, k, (rep * 7919 + k * 104729 + 39) % n AS start, n FROM sz, range({_REPS}) a(rep), range((SELECT (n + 20) // 21 FROM sz)) b(k))"
_RESAMPLED = "smp AS (SELECT rep, avg(a) / stddev_samp(a) * sqrt(252.0) AS sa, avg(b) / stddev_samp(b) * sqrt(252.0) AS sb FROM draws JOIN range(21) o(j) ON k * 21 + j < n JOIN line ON i = (start + j) % n GROUP BY rep)"


def excess_line(spark, sf):
    """(series of two columns, starts of blocks, length)."""
    r = A.session_returns(curves(spark, sf)).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("m"))
    line = r.select("date", (F.col("m") - 0.0001).alias("a"), (F.col("m") * 0.5 + 0.01).alias("b"))
    n = line.count()
    ids = spark.range(_REPS).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n + 20) // 21 - 1).cast("long"))).alias("k"))
    return line, ids.withColumn("start", (F.col("replicate") * 7919 + F.col("k") * 104729 + 39) % n), n


@query(with_(H.BARS_SQL, CURVES, _LINE, _DRAWS, _RESAMPLED, result="SELECT quantile_cont(sa, 0.025) AS low, quantile_cont(sa, 0.975) AS high, stddev_samp(sa) AS se, avg(CASE WHEN sa <= 0 THEN 1.0 ELSE 0.0 END) AS p_below FROM smp"), "", "low high se p_below")
def a10_bootstrap_sharpe(spark, sf):
    line, starts, n = excess_line(spark, sf)
    return A.bootstrap_sharpe(line, starts, n, "a")


@query(with_(H.BARS_SQL, CURVES, _LINE, _DRAWS, _RESAMPLED, result="SELECT quantile_cont(sa - sb, 0.025) AS low, quantile_cont(sa - sb, 0.975) AS high, stddev_samp(sa - sb) AS se, avg(CASE WHEN sa - sb <= 0 THEN 1.0 ELSE 0.0 END) AS p_below FROM smp"), "", "low high se p_below")
def a11_bootstrap_difference(spark, sf):
    line, starts, n = excess_line(spark, sf)
    return A.bootstrap_difference(line, starts, n, "a", "b")


_SHARPES = "sh AS (SELECT series, avg(ret) / stddev_samp(ret) AS sharpe FROM r GROUP BY series)"


@query(with_(H.BARS_SQL, CURVES, _SHARPES, result="SELECT source, sharpe FROM (SELECT arg_max(series, {'s': sharpe, 'n': series}) AS source, max(sharpe) AS sharpe FROM sh WHERE series IN ('Brand#3', 'Brand#11') UNION ALL SELECT 'random', quantile_cont(sharpe, 0.95) FROM sh WHERE series NOT IN ('Brand#3', 'Brand#11')) ORDER BY sharpe DESC LIMIT 1"), "source", "sharpe")
def a13_the_bar(spark, sf):
    s = A.session_returns(curves(spark, sf)).groupBy("series").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
    named = F.col("series").isin("Brand#3", "Brand#11")
    return A.the_bar(s.where(named), s.where(~named))


@query(with_(H.BARS_SQL, CURVES, _SHARPES, "q AS (SELECT quantile_cont(sharpe, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]) AS v FROM sh)", result="SELECT unnest([0, 5, 25, 50, 75, 95, 100]) AS percentile, unnest(v) AS value FROM q"), "percentile", "value")
def z2_random_distribution(spark, sf):
    s = A.session_returns(curves(spark, sf)).groupBy("series").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
    return A.random_distribution(s)


# ---- portfolios -------------------------------------------------------------------------------


def prices(spark, sf):
    b = H.bars(spark, sf)
    b = b.withColumn("ev", X.eur_volume("volume", "close")).withColumn("adv_eur_21", X.average_daily_value("ev"))
    return b.select("ticker", "date", F.col("close").alias("adj_close_eur"), F.col("open").alias("adj_open_eur"), "adv_eur_21")


_ADV = "adv AS (SELECT ticker, date, CASE WHEN count(*) OVER w >= 19 AND row_number() OVER (PARTITION BY ticker ORDER BY date) > 20 THEN avg(volume * close) OVER w END AS adv FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"


@query(with_(H.BARS_SQL, _ADV, result="SELECT ticker, date, (5 + (10 / 2.0 + 5) * CASE WHEN adv > 0 THEN least(greatest(1e8 / adv, 1), 10) ELSE 10 END) / 10000 AS rate FROM adv"), "ticker date", "rate", 9)
def b2_cost_rates(spark, sf):
    return prices(spark, sf).withColumn("rate", B.CostModel().rate_column(F.col("adv_eur_21")))


def momentum_scores(spark, sf):
    m = stored(grid(spark, sf).withColumn("mom_12_1", X.skip_return("close", 252)))
    # a date with fewer than ten scored names has no cross-section, as in the panel
    return B.column_scores(m.withColumn("mom_12_1", F.when(cross_rank(F.col("mom_12_1")).isNotNull(), F.col("mom_12_1"))), "mom_12_1", "momentum")


def book(spark, sf, **options):
    return B.run_backtest(prices(spark, sf), momentum_scores(spark, sf), **options)


_PX = "px AS (SELECT ticker, date, close AS c, open AS o, adv FROM bars JOIN adv USING (ticker, date))"
_MOMENTUM = (
    f"mo AS (SELECT * FROM (SELECT ticker, date, stored, {lagged('close', 21)} / {lagged('close', 252)} - 1 AS m FROM grid) WHERE stored)",
    "mk AS (SELECT date, ticker, m FROM (SELECT *, count(m) OVER (PARTITION BY date) AS n FROM mo) WHERE m IS NOT NULL AND n >= 10)",
)
_ONE_BOOK = "books AS (SELECT 'momentum' AS scenario, {k} AS k, {even} AS even, NULL::DOUBLE AS flat, {first}::DATE AS first, {last}::DATE AS last)"
_SC = "sc AS (SELECT 'momentum' AS scenario, date, ticker, m AS score FROM mk)"


def _book_sql(result: str, k: int = 10, even: str = "false", first: str = "NULL", last: str = "NULL") -> str:
    return with_(*GRID, _ADV, _PX, *_MOMENTUM, _ONE_BOOK.format(k=k, even=even, first=first, last=last), _SC, S.SETTING, result=result)


@query(_book_sql(S.EQUITY), "scenario date n_names rebalance", "equity_eur cash_eur cost_eur", 3)
def b1_backtest_equity(spark, sf):
    return B.equity_of(book(spark, sf, kinds=("equity",)))


@query(_book_sql(S.TRADES), "scenario date ticker side decided", "shares price_eur value_eur cost_eur", 3)
def b1_backtest_trades(spark, sf):
    return B.trades_of(book(spark, sf, kinds=("trade",)))


@query(_book_sql("SELECT *, ln(shares) AS log_shares FROM (" + S.POSITIONS + ")"), "scenario date ticker", "log_shares price_eur weight", 7)
def b1_backtest_positions(spark, sf):
    return B.positions_of(book(spark, sf, kinds=("position",))).withColumn("log_shares", F.ln("shares"))


@query(_book_sql(S.TRADES, 5, "true", "DATE '1993-06-01'", "DATE '1997-06-30'"), "scenario date ticker side decided", "shares price_eur value_eur cost_eur", 3)
def b1_backtest_reweighted(spark, sf):
    """Five names brought back to equal weights, between two dates."""
    return B.trades_of(book(spark, sf, kinds=("trade",), k=5, reweight=True, start=dt.date(1993, 6, 1), end=dt.date(1997, 6, 30)))


_SWEEP = (0, 5, 10, 25, 50)
#: Books whose worth runs over many powers of ten are compared by its logarithm, cash and costs as parts of it.
_PARTS = "SELECT scenario, date, n_names, rebalance, ln(equity_eur) AS log_equity, cash_eur / equity_eur AS cash_part, cost_eur / equity_eur AS cost_part FROM (" + S.EQUITY + ")"


def parts(equity):
    e = F.col("equity_eur")
    return equity.select("scenario", "date", "n_names", "rebalance", F.ln(e).alias("log_equity"), (F.col("cash_eur") / e).alias("cash_part"), (F.col("cost_eur") / e).alias("cost_part"))


#: Axis of the baselines: from the first date that has a year of history behind it to the newest bar.
FIRST, LAST, SEEDS = dt.date(1993, 2, 1), dt.date(2100, 1, 1), 200


def baseline_books(spark, sf):
    p = prices(spark, sf)
    mean = H.bars(spark, sf).groupBy("date").agg(*[(F.sum(F.round(F.col(c) * 10000).cast("decimal(38,0)")).cast("double") / F.count("*") / 10000).alias(n) for c, n in (("close", "adj_close_eur"), ("open", "adj_open_eur"))])
    bench = mean.select(F.lit("BENCH").alias("ticker"), "date", "adj_close_eur", "adj_open_eur", F.lit(None).cast("double").alias("adv_eur_21"))
    return B.baselines(p, bench, momentum_scores(spark, sf).withColumnRenamed("score", "mom_12_1"), FIRST, LAST, SEEDS, kinds=("equity",))


_BASELINES = (
    "be AS (SELECT date, CAST(sum(CAST(round(close * 10000) AS DECIMAL(38,0))) AS DOUBLE) / count(*) / 10000 AS c, CAST(sum(CAST(round(open * 10000) AS DECIMAL(38,0))) AS DOUBLE) / count(*) / 10000 AS o FROM bars GROUP BY date)",
    "px AS (SELECT ticker, date, close AS c, open AS o, adv FROM bars JOIN adv USING (ticker, date) UNION ALL SELECT 'BENCH', date, c, o, NULL FROM be)",
    f"books AS (SELECT scenario, k, even, NULL::DOUBLE AS flat, DATE '{FIRST}' AS first, DATE '{LAST}' AS last FROM (SELECT 'benchmark' AS scenario, 1 AS k, false AS even UNION ALL SELECT 'momentum', 10, false UNION ALL SELECT 'equal_weight_hold', (SELECT count(DISTINCT ticker) FROM bars), false"
    f" UNION ALL SELECT 'equal_weight_rebalanced', (SELECT count(DISTINCT ticker) FROM bars), true UNION ALL SELECT 'random_' || s, 10, false FROM range({SEEDS}) r(s)))",
    "sc AS (SELECT 'benchmark' AS scenario, date, 'BENCH' AS ticker, 1.0::DOUBLE AS score FROM be UNION ALL SELECT 'momentum', date, ticker, m FROM mk UNION ALL SELECT e, date, ticker, 1.0 FROM bars, (VALUES ('equal_weight_hold'), ('equal_weight_rebalanced')) v(e)"
    f" UNION ALL SELECT 'random_' || s, date, ticker, CAST('0x' || substr(md5(s || ':' || ticker || ':' || date), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 FROM bars, range({SEEDS}) r(s))",
)


@query(with_(*GRID, _ADV, *_MOMENTUM, *_BASELINES, S.SETTING, result=_PARTS), "scenario date n_names rebalance", "log_equity cash_part cost_part")
def b5_baseline_books(spark, sf):
    return parts(B.equity_of(baseline_books(spark, sf)))


@query(
    with_(*GRID, _ADV, _PX, f"mk AS (SELECT * FROM (SELECT ticker, date, stored, close / {lagged('close', 63)} - 1 AS m FROM grid) WHERE stored AND m IS NOT NULL)",
          f"books AS (SELECT 'ret_63d@' || b AS scenario, 10 AS k, false AS even, b::DOUBLE AS flat, NULL::DATE AS first, NULL::DATE AS last FROM (SELECT unnest([{', '.join(f'{b}.0::DOUBLE' for b in _SWEEP)}]) AS b))", "sc AS (SELECT scenario, date, ticker, m AS score FROM mk, books)", S.SETTING, result=_PARTS),
    "scenario date n_names rebalance", "log_equity cash_part cost_part",
)
def z11_cost_sweep(spark, sf):
    s = B.column_scores(stored(grid(spark, sf).withColumn("s", X.simple_return("close", 63))), "s", "ret_63d")
    return parts(B.equity_of(B.run_backtest(prices(spark, sf), B.cost_sweep(s, list(_SWEEP)), kinds=("equity",))))


@query(
    with_(H.BARS_SQL, H.LISTINGS_SQL, H.SESSIONS_SQL, "e AS (SELECT venue, date, lead(date, 21) OVER (PARTITION BY venue ORDER BY date) AS le FROM sessions)", "sp AS (SELECT venue, min(date) AS lo, max(date) AS hi FROM sessions GROUP BY 1)", "ax AS (SELECT DISTINCT date FROM bars)",
          "m AS (SELECT a.date, coalesce(e.le, DATE '9999-12-31') AS le FROM (SELECT ax.date, venue FROM ax JOIN sp ON ax.date BETWEEN lo AND hi) a ASOF JOIN e ON a.venue = e.venue AND a.date >= e.date)",
          result="SELECT date, CAST(max(le) AS VARCHAR) AS label_end FROM m GROUP BY date"),
    "date label_end",
)
def b6_label_ends(spark, sf):
    b, ls = H.bars(spark, sf), H.listings(spark, sf)
    return L.label_end_dates(b.select("date"), H.sessions(b, ls), 21).withColumn("label_end", F.col("label_end").cast("string"))


# ---- models -----------------------------------------------------------------------------------

FEATURES = ["a", "b", "v"]


def model_frame(spark, sf):
    g = scored(spark, sf).select("ticker", "date", "a", "b", "y").where("y is not null")
    f = g.withColumn("v", F.col("a") * 0.5 + F.col("b"))
    ranks = X.with_columns(f, {"a": cross_rank(F.col("a")), "b": cross_rank(F.col("b")), "v": cross_rank(F.col("v")), "target": cross_rank(F.col("y"))})
    return ML.build_frame(ranks, ranks.select("date", "ticker", "target"), FEATURES, "target")


def fold_dates(spark, sf):
    axis = [r.date for r in H.bars(spark, sf).select("date").distinct().orderBy("date").collect()]  # a calendar
    ends = {d: axis[i + 21] if i + 21 < len(axis) else L.OPEN_END for i, d in enumerate(axis)}
    return L.walk_forward_splits(axis, ends, min_train=600, test=400, embargo=21, horizon=21), ends


_FOLDS = (
    "ax AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars))",
    "fo AS (SELECT st, row_number() OVER (ORDER BY st) - 1 AS fold FROM (SELECT unnest(range(621, (SELECT count(*) FROM ax), 400)) AS st))",
    "fd AS (SELECT CAST(fold AS INTEGER) AS fold, date, CASE WHEN i < st THEN 'train' ELSE 'test' END AS role FROM fo JOIN ax ON i + 21 < st OR (i >= st AND i < st + 400))",
)


@query(with_(H.BARS_SQL, *_FOLDS, result="SELECT fold, date, role FROM fd"), "fold date role")
def b7_walk_forward_folds(spark, sf):
    return L.fold_table(spark, fold_dates(spark, sf)[0])


_FRAME = (
    "c AS (SELECT ticker, date, a, b, a * 0.5 + b AS v, y FROM sc WHERE y IS NOT NULL)",
    "k AS (SELECT ticker, date, " + ", ".join(f"CASE WHEN count({x}) OVER (PARTITION BY date) >= 10 AND {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0 - 1) / (count({x}) OVER (PARTITION BY date) - 1) END AS {n}" for x, n in (("a", "a"), ("b", "b"), ("v", "v"), ("y", "target"))) + " FROM c)",
    "fr AS (SELECT date, ticker, coalesce(a, 0.5) AS a, coalesce(b, 0.5) AS b, coalesce(v, 0.5) AS v, target FROM k WHERE a IS NOT NULL OR b IS NOT NULL OR v IS NOT NULL)",
)


@query(with_(*GRID, _SCORED, *_FRAME, result="SELECT * FROM fr"), "date ticker", "a b v target")
def m5_model_frame(spark, sf):
    return model_frame(spark, sf)


@query(with_(*GRID, _SCORED, *_FRAME, result="SELECT date, " + ", ".join(f"sum({x} * {y}) AS {n}" for x, y, n in (("1", "1", "g0_0"), ("1", "a", "g0_1"), ("a", "b", "g1_2"), ("a", "target", "g1_4"), ("target", "target", "g4_4"))) + " FROM fr WHERE target IS NOT NULL GROUP BY date"), "date", "g0_0 g0_1 g1_2 g1_4 g4_4")
def m2_gram_by_date(spark, sf):
    return ML.gram_by_date(model_frame(spark, sf), FEATURES)


def _ridge_sql() -> tuple[str, ...]:
    """The penalised normal equations of three centred features, solved by determinants."""
    cols = ("a", "b", "v")
    sums = ", ".join(f"sum({x} * {y}) - sum({x}) * sum({y}) / count(*) AS {x}{y}" for i, x in enumerate((*cols, "target")) for y in (*cols, "target")[i:])
    means = ", ".join(f"avg({x}) AS m_{x}" for x in (*cols, "target"))
    pair = lambda x, y: "(" + "".join(sorted((x, y))) + (" + 1)" if x == y else ")")
    rows = [[pair(x, y) for y in cols] for x in cols]
    right = [f"({x}target)" for x in cols]

    def det(m):
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    solved = ", ".join(f"{det([[right[r] if c == k else rows[r][c] for c in range(3)] for r in range(3)])} / {det(rows)} AS w_{x}" for k, x in enumerate(cols))
    return (
        f"gs AS (SELECT fold, {sums}, {means} FROM fr JOIN fd USING (date) WHERE role = 'train' AND target IS NOT NULL GROUP BY fold)",
        f"ws AS (SELECT fold, m_a, m_b, m_v, m_target, {solved} FROM gs)",
    )


_RIDGE = with_(*GRID, _SCORED, *_FRAME, *_FOLDS, *_ridge_sql(), result="SELECT fold, date, ticker, m_target + w_a * (a - m_a) + w_b * (b - m_b) + w_v * (v - m_v) AS score, target FROM fr JOIN fd USING (date) JOIN ws USING (fold) WHERE role = 'test'")


@query(_RIDGE, "fold date ticker", "score target")
def m2_ridge_predictions(spark, sf):
    folds = L.fold_table(spark, fold_dates(spark, sf)[0])
    return ML.ridge_walk_forward(model_frame(spark, sf), folds, FEATURES)[0]


@query(
    with_(*GRID, _SCORED, *_FRAME, *_FOLDS, *_ridge_sql(), "lw AS (SELECT fold, feature, value FROM (SELECT fold, w_a AS a, w_b AS b, w_v AS v FROM ws) UNPIVOT (value FOR feature IN (a, b, v)))",
          result="SELECT feature, avg(value) AS mean, arg_max(value, fold) AS last, min(value) AS low, max(value) AS high, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM lw GROUP BY feature"),
    "feature", "mean last low high positive",
)
def a22_coefficients(spark, sf):
    folds = L.fold_table(spark, fold_dates(spark, sf)[0])
    return ML.coefficient_table(ML.ridge_walk_forward(model_frame(spark, sf), folds, FEATURES)[1])


@query()
def m8_calibrated_walk_forward(spark, sf):
    folds, ends = fold_dates(spark, sf)
    f = model_frame(spark, sf).withColumn("target", F.when(F.col("target").isNotNull(), (F.col("target") > 0.8).cast("double"))).persist()
    return ML.calibrated_walk_forward(f, folds, ends, "logit", FEATURES)


@query()
def m3_boosted_trees(spark, sf):
    folds = L.fold_table(spark, fold_dates(spark, sf)[0])
    return ML.walk_forward(model_frame(spark, sf), folds, "gbt", FEATURES, trees=5, depth=3)


_PROB = "pr AS (SELECT event_type, (event_id * 37 % 1000) / 1000.0 AS p, CASE WHEN (event_id * 53 % 1000) / 1000.0 < (event_id * 37 % 1000) / 1000.0 THEN 1.0 ELSE 0.0 END AS y FROM events)"


def probabilities(spark, sf):
    e = H.table(spark, sf, "events")
    p = (F.col("event_id") * 37 % 1000) / 1000.0
    return e.select("event_type", p.alias("p"), ((F.col("event_id") * 53 % 1000) / 1000.0 < p).cast("double").alias("target"))


@query(
    with_(_PROB, "rk AS (SELECT p, y, rank() OVER (ORDER BY p) AS r FROM pr)", "ed AS (SELECT unnest(quantile_cont(r, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM rk)",
          "bn AS (SELECT p, y, (SELECT count(*) FROM ed WHERE e < r) AS bin FROM rk)", result="SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed, avg(y) - avg(p) AS gap, 1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*)) AS margin FROM bn GROUP BY bin"),
    "bin n", "mean_p observed gap margin",
)
def a19_reliability(spark, sf):
    return ML.reliability(probabilities(spark, sf), "p")


@query(
    with_(_PROB, "rk AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY p) + (count(*) OVER (PARTITION BY event_type, p) - 1) / 2.0 AS r, greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM pr)",
          result="SELECT event_type, count(*) AS n, avg(y) AS base, avg((p - y) * (p - y)) AS brier, 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS skill, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, quantile_cont(p, 0.05) AS p05, quantile_cont(p, 0.95) AS p95 FROM rk GROUP BY event_type"),
    "event_type n", "base brier skill log_loss auc p05 p95",
)
def a20_probability_scores(spark, sf):
    return ML.probability_scores(probabilities(spark, sf), "p", by=["event_type"])


@query(with_(*GRID, _SCORED, result="SELECT feature, year(date) AS year, avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT date, 'a' AS feature, a AS x FROM sc UNION ALL SELECT date, 'b', b FROM sc UNION ALL SELECT date, 'y', y FROM sc) GROUP BY 1, 2"), "feature year", "share")
def a14_nan_coverage(spark, sf):
    return ML.nan_coverage(scored(spark, sf), ["a", "b", "y"])


@query(with_(*GRID, _SCORED, *_FRAME, result="SELECT 'a' AS a, 'b' AS b, corr(a, b) AS corr, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n FROM k UNION ALL SELECT 'a', 'target', corr(a, target), count(*) FILTER (a IS NOT NULL AND target IS NOT NULL) FROM k UNION ALL SELECT 'b', 'target', corr(b, target), count(*) FILTER (b IS NOT NULL AND target IS NOT NULL) FROM k"), "a b n", "corr")
def a15_rank_correlation(spark, sf):
    g = scored(spark, sf).where("y is not null")
    ranks = g.select(cross_rank(F.col("a")).alias("a"), cross_rank(F.col("b")).alias("b"), cross_rank(F.col("y")).alias("target"))
    return ML.rank_correlation(ranks, ["a", "b", "target"])


# ---- panel and streams ------------------------------------------------------------------------


@query()
def s23_feature_panel(spark, sf):
    """All of the panel's columns over whole tables; in euros of the listing's own currency here."""
    b, ls = H.bars(spark, sf).persist(), H.listings(spark, sf)  # a stored table in use: here it is made from line items
    p = M.adjust(b, H.actions(b)).select("ticker", "date", "adj_close").join(b, ["ticker", "date"])
    p = p.withColumn("close_eur", F.col("close")).withColumn("adj_close_eur", F.col("adj_close"))
    return P.build(p, H.sessions(b, ls), ls, b.groupBy("date").agg(F.avg("close").alias("bench")), as_of=dt.date(2100, 1, 1))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, arg_min(value, {'t': ts, 'e': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'t': ts, 'e': event_id}) AS close, sum(value) AS total FROM events GROUP BY 1, 2", "event_type start n", "open high low close total", 5)
def w1_event_bars(spark, sf):
    bars = event_bars(H.table(spark, sf, "events"))
    return bars.withColumn("start", F.col("start").cast("timestamp_ntz"))
