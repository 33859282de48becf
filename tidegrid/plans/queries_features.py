"""Queries of the rolling, recursive and cross-sectional features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.functions import features as X
from tidegrid.functions.recursive import recursive_columns
from tidegrid.operators import labels as L
from tidegrid.operators.frames import cross_rank, cross_zscore, sector_demean, session_grid
from tidegrid.plans import harness as H
from tidegrid.plans.catalog import query, with_

GRID = (H.BARS_SQL, H.LISTINGS_SQL, H.SESSIONS_SQL, H.GRID_SQL)
W = "(PARTITION BY ticker ORDER BY date)"


def over(n: int, end: int = 0) -> str:
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def lagged(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER {W}"


def rolled(agg: str, x: str, n: int, warm: int) -> str:
    return f"CASE WHEN count({x}) OVER {over(n)} >= {-(-9 * n // 10)} AND row_number() OVER {W} > {warm} THEN {agg} OVER {over(n)} END"


def grid(spark, sf):
    b = H.bars(spark, sf)
    ls = H.listings(spark, sf)
    return session_grid(b, H.sessions(b, ls), ls.select("ticker", "venue"))


def stored(df):
    return df.where("stored")


@query(with_(*GRID, result="SELECT * FROM (SELECT ticker, date, stored, " + ", ".join(f"close / {lagged('close', h)} - 1 AS ret_{h}d, ln(close) - {lagged('ln(close)', h)} AS logret_{h}d" for h in X.HORIZONS) + " FROM grid) WHERE stored"), "ticker date", " ".join(f"ret_{h}d logret_{h}d" for h in X.HORIZONS))
def t1_returns(spark, sf):
    return stored(X.with_columns(grid(spark, sf), X.returns("close")))


@query(with_(*GRID, result=f"SELECT * FROM (SELECT ticker, date, stored, {lagged('close', 21)} / {lagged('close', 252)} - 1 AS mom_12_1, {lagged('close', 21)} / {lagged('close', 126)} - 1 AS mom_6_1, -(close / {lagged('close', 5)} - 1) AS rev_5d FROM grid) WHERE stored"), "ticker date", "mom_12_1 mom_6_1 rev_5d")
def t3_momentum(spark, sf):
    return stored(X.with_columns(grid(spark, sf), X.momentum("close")))


_LOGRET = f"r AS (SELECT *, ln(close) - {lagged('ln(close)', 1)} AS lr FROM grid)"


@query(
    with_(*GRID, _LOGRET, result="SELECT * FROM (SELECT ticker, date, stored, " + ", ".join(f"{rolled('stddev_samp(lr)', 'lr', n, n)} * sqrt(252.0) AS vol_{n}d" for n in X.VOLATILITY) + f", sqrt({rolled('avg(least(lr, 0) * least(lr, 0))', 'lr', 63, 63).replace('avg(least(lr, 0) * least(lr, 0))', 'avg(CASE WHEN lr IS NOT NULL THEN least(lr, 0) * least(lr, 0) END)')}) * sqrt(252.0) AS downdev_63d FROM r) WHERE stored"),
    "ticker date", "vol_21d vol_63d vol_252d downdev_63d",
)
def t5_volatility(spark, sf):
    g = grid(spark, sf).withColumn("lr", X.log_return("close", 1))
    return stored(X.with_columns(g, {f"vol_{n}d": X.realized_vol("lr", n) for n in X.VOLATILITY} | {"downdev_63d": X.downside_deviation("lr")}))


@query(with_(*GRID, result=f"SELECT * FROM (SELECT ticker, date, stored, CASE WHEN high IS NOT NULL AND low IS NOT NULL AND {lagged('close', 1)} IS NOT NULL THEN greatest(high - low, abs(high - {lagged('close', 1)}), abs(low - {lagged('close', 1)})) END AS true_range FROM grid) WHERE stored"), "ticker date", "true_range", 9)
def t7_true_range(spark, sf):
    return stored(grid(spark, sf).withColumn("true_range", X.true_range("high", "low", "close")))


@query(
    with_(*GRID, f"w AS (SELECT ticker, date, stored, count(close) OVER {over(253)} AS n, list(close) OVER {over(253)} AS ps FROM grid)",
          "f AS (SELECT ticker, date, n, list_filter(ps, lambda x: x IS NOT NULL) AS ps FROM w WHERE stored AND n >= 228)",
          "u AS (SELECT ticker, date, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM f)",
          "m AS (SELECT ticker, date, p / max(p) OVER (PARTITION BY ticker, date ORDER BY i) - 1 AS d FROM u)",
          result="SELECT ticker, date, least(min(d), 0) AS mdd_252d FROM m GROUP BY 1, 2"),
    "ticker date", "mdd_252d",
)
def t9_drawdown_window(spark, sf):
    """The drawdown of the panel's grouped pass."""
    g = grid(spark, sf).withColumn("tr", F.lit(None).cast("double"))
    return stored(recursive_columns(g, "close", "close", "tr")).where("mdd_252d is not null")


_SMA = "s AS (SELECT *, " + ", ".join(f"{rolled('avg(close)', 'close', n, n - 1)} AS sma_{n}" for n in X.AVERAGES) + " FROM grid)"


def with_sma(spark, sf):
    return X.with_columns(grid(spark, sf), {f"sma_{n}": X.sma("close", n) for n in X.AVERAGES})


@query(
    with_(*GRID, _SMA, result="SELECT * FROM (SELECT ticker, date, stored, " + ", ".join(f"close / sma_{n} - 1 AS dist_sma_{n}, sma_{n} / {lagged(f'sma_{n}', 5)} - 1 AS slope_sma_{n}" for n in X.AVERAGES) + " FROM s) WHERE stored"),
    "ticker date", " ".join(f"dist_sma_{n} slope_sma_{n}" for n in X.AVERAGES),
)
def t10_trend(spark, sf):
    g = with_sma(spark, sf)
    return stored(X.with_columns(g, {f"dist_sma_{n}": X.distance("close", f"sma_{n}") for n in X.AVERAGES} | {f"slope_sma_{n}": X.slope(f"sma_{n}") for n in X.AVERAGES}))


@query(
    with_(*GRID, _SMA, "z AS (SELECT ticker, date, CASE WHEN sma_50 > sma_200 THEN 1.0 WHEN sma_50 <= sma_200 THEN -1.0 END AS t FROM s WHERE stored)",
          "y AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM z)",
          result="SELECT ticker, date, t AS trend_50_200, CASE WHEN t IS NOT NULL THEN CASE WHEN t > 0 AND b < 0 THEN 1.0 ELSE 0.0 END END AS golden_cross, CASE WHEN t IS NOT NULL THEN CASE WHEN t < 0 AND b > 0 THEN 1.0 ELSE 0.0 END END AS death_cross FROM y"),
    "ticker date", "trend_50_200 golden_cross death_cross",
)
def t14_crosses(spark, sf):
    g = stored(with_sma(spark, sf).withColumn("trend_50_200", X.trend_state()))
    return X.with_columns(g, X.crosses("trend_50_200"))


@query(
    with_(*GRID, f"k AS (SELECT *, CASE WHEN row_number() OVER {W} >= 14 AND count(high + low) OVER {over(14)} >= 13 AND close IS NOT NULL THEN CASE WHEN max(high) OVER {over(14)} = min(low) OVER {over(14)} THEN 50.0 ELSE greatest(least(100 * (close - min(low) OVER {over(14)}) / (max(high) OVER {over(14)} - min(low) OVER {over(14)}), 100.0), 0.0) END END AS stoch_k FROM grid)",
          result=f"SELECT * FROM (SELECT ticker, date, stored, stoch_k, CASE WHEN count(stoch_k) OVER {over(3)} = 3 THEN avg(stoch_k) OVER {over(3)} END AS stoch_d FROM k) WHERE stored"),
    "ticker date", "stoch_k stoch_d",
)
def t17_stochastic(spark, sf):
    g = grid(spark, sf).withColumn("stoch_k", X.stoch_k("high", "low", "close"))
    return stored(g.withColumn("stoch_d", X.stoch_d("stoch_k")))


@query(
    with_(*GRID, f"m AS (SELECT *, {rolled('avg(close)', 'close', 20, 19)} AS a, stddev_pop(close) OVER {over(20)} AS s, max(close) OVER {over(20)} = min(close) OVER {over(20)} AS flat FROM grid)",
          result="SELECT ticker, date, CASE WHEN a IS NOT NULL AND close IS NOT NULL THEN CASE WHEN flat THEN 0.5 ELSE (close - (a - 2 * s)) / (4 * s) END END AS bb_pctb FROM m WHERE stored"),
    "ticker date", "bb_pctb",
)
def t18_percent_b(spark, sf):
    return stored(grid(spark, sf).withColumn("bb_pctb", X.percent_b("close")))


_EV = f"e AS (SELECT *, CASE WHEN volume * close >= 0 THEN volume * close END AS ev FROM grid), g2 AS (SELECT *, CASE WHEN ev > 0 THEN ln(ev) END AS le, coalesce(sign(close - {lagged('close', 1)}) * ev, 0) AS sg FROM e)"


@query(
    with_(*GRID, _EV, result="SELECT * FROM (SELECT ticker, date, stored, " + f"""{rolled('avg(ev)', 'ev', 21, 20)} AS adv_eur_21,
      CASE WHEN count(le) OVER {over(63, -1)} >= 57 AND row_number() OVER {W} > 63 AND max(le) OVER {over(63, -1)} > min(le) OVER {over(63, -1)} THEN (le - avg(le) OVER {over(63, -1)}) / stddev_samp(le) OVER {over(63, -1)} END AS volume_z_63,
      CASE WHEN ev IS NOT NULL THEN sum(sg) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END AS obv,
      {rolled('sum(sg)', 'ev', 21, 21)} / sum(ev) OVER {over(21)} AS obv_flow_21,
      CASE WHEN coalesce({rolled('avg(ev)', 'ev', 21, 20)} >= 5000000, false) THEN 1 ELSE 0 END AS tradable FROM g2) WHERE stored"""),
    "ticker date", "adv_eur_21 volume_z_63 obv obv_flow_21 tradable", 4,
)
def t19_liquidity(spark, sf):
    g = grid(spark, sf).withColumn("ev", X.eur_volume("volume", "close"))
    g = g.withColumn("sg", X.signed_value("close", "ev"))
    g = X.with_columns(g, {"adv_eur_21": X.average_daily_value("ev"), "volume_z_63": X.volume_zscore("ev"), "obv": X.on_balance_volume("sg", "ev"), "obv_flow_21": X.obv_flow("sg", "ev")})
    return stored(g.withColumn("tradable", X.tradable("adv_eur_21").cast("int")))


_MARKET = "market AS (SELECT date, avg(close) AS bench FROM (SELECT date, close FROM bars ORDER BY date, ticker) GROUP BY date)"


def with_market(spark, sf):
    g = grid(spark, sf)
    bench = H.bars(spark, sf).groupBy("date").agg(F.avg("close").alias("bench"))
    return g.join(bench, "date", "left")


@query(
    with_(*GRID, _MARKET, f"j AS (SELECT grid.*, bench FROM grid LEFT JOIN market USING (date)), k AS (SELECT *, ln(close) - {lagged('ln(close)', 1)} AS ri, ln(bench) - {lagged('ln(bench)', 1)} AS rm FROM j)",
          "p AS (SELECT *, CASE WHEN ri IS NOT NULL AND rm IS NOT NULL THEN rm END AS x, CASE WHEN ri IS NOT NULL AND rm IS NOT NULL THEN ri END AS y FROM k)",
          f"q AS (SELECT *, count(x) OVER {over(252)} AS n, var_pop(x) OVER {over(252)} AS vm, var_pop(y) OVER {over(252)} AS vi, covar_pop(x, y) OVER {over(252)} AS c, row_number() OVER {W} AS rn FROM p)",
          "b AS (SELECT *, CASE WHEN rn > 252 AND n >= 189 AND vm > 1e-16 THEN c / vm END AS beta_252, CASE WHEN rn > 252 AND n >= 189 AND vm > 1e-16 THEN sqrt(greatest(vi - c * c / vm, 0) * 252) END AS idio_vol_252 FROM q)",
          result=f"SELECT * FROM (SELECT ticker, date, stored, beta_252, idio_vol_252, ({lagged('ln(close)', 21)} - {lagged('ln(close)', 252)}) - beta_252 * ({lagged('ln(bench)', 21)} - {lagged('ln(bench)', 252)}) AS mom_resid_12_1 FROM b) WHERE stored"),
    "ticker date", "beta_252 idio_vol_252 mom_resid_12_1",
)
def t25_beta(spark, sf):
    g = X.with_columns(with_market(spark, sf), {"ri": X.log_return("close", 1), "rm": X.log_return("bench", 1)})
    g = X.with_rolling_beta(g, "ri", "rm")
    return stored(g.withColumn("mom_resid_12_1", X.residual_momentum("close", "bench", "beta_252")))


@query(
    with_(H.BARS_SQL, f"o AS (SELECT ticker, date, close, row_number() OVER {W} AS i FROM bars)",
          "e AS (SELECT ticker, 20 AS i, avg(close) AS l FROM o WHERE i <= 20 GROUP BY ticker HAVING count(*) = 20 UNION ALL SELECT o.ticker, o.i, o.close * 2.0 / 21 + e.l * 19.0 / 21 FROM e JOIN o ON o.ticker = e.ticker AND o.i = e.i + 1)",
          result="SELECT o.ticker, o.date, l AS ema_20 FROM o LEFT JOIN e ON e.ticker = o.ticker AND e.i = o.i"),
    "ticker date", "ema_20",
)
def t11_ema(spark, sf):
    """The average on each ticker's own bars; beside it a recursive query."""
    b = H.bars(spark, sf).withColumn("tr", X.true_range("high", "low", "close"))
    return recursive_columns(b, "close", "close", "tr")


def _smoothed(name: str, source: str, value: str, n: int, weight: str) -> list[str]:
    """SQL of an average that feeds on its last value, over the valued rows of a ticker: seeded with the mean of the
    first n, then `weight` for each new value. `name` has it at those rows."""
    return [
        f"o_{name} AS MATERIALIZED (SELECT ticker, date, {value} AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM {source} WHERE {value} IS NOT NULL)",
        f"r_{name} AS (SELECT ticker, {n}::BIGINT AS i, avg(x) AS l FROM o_{name} WHERE i <= {n} GROUP BY ticker HAVING count(*) = {n} UNION ALL SELECT o.ticker, o.i, o.x * {weight} + e.l * (1 - {weight}) FROM r_{name} e JOIN o_{name} o ON o.ticker = e.ticker AND o.i = e.i + 1)",
        f"{name} AS MATERIALIZED (SELECT ticker, date, l FROM r_{name} JOIN o_{name} USING (ticker, i))",
    ]


_EMAS = [x for n in (20, 50, 200, 12, 26) for x in _smoothed(f"ema{n}", "grid", "close", n, f"(2.0::DOUBLE / {n + 1})")]
_LEVELS = "lv AS MATERIALIZED (SELECT g.ticker, g.date, " + ", ".join(f"last_value(ema{n}.l IGNORE NULLS) OVER w AS e{n}" for n in (20, 50, 200, 12, 26)) + " FROM grid g " + " ".join(f"LEFT JOIN ema{n} ON ema{n}.ticker = g.ticker AND ema{n}.date = g.date" for n in (20, 50, 200, 12, 26)) + " WINDOW w AS (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING))"
_RECURSIVE = (
    f"tr AS MATERIALIZED (SELECT ticker, date, stored, close - {lagged('close', 1)} AS ch, CASE WHEN high IS NOT NULL AND low IS NOT NULL AND {lagged('close', 1)} IS NOT NULL THEN greatest(high - low, abs(high - {lagged('close', 1)}), abs(low - {lagged('close', 1)})) END AS r FROM grid)",
    *_EMAS, _LEVELS, "ln AS MATERIALIZED (SELECT ticker, date, e12 - e26 AS macd FROM lv)", *_smoothed("sig", "ln", "macd", 9, "0.2::DOUBLE"),
    "ud AS MATERIALIZED (SELECT ticker, date, greatest(ch, 0) AS u, greatest(-ch, 0) AS d FROM tr WHERE ch IS NOT NULL)",
    *_smoothed("atr", "tr", "r", 14, "(1.0::DOUBLE / 14)"), *_smoothed("up", "ud", "u", 14, "(1.0::DOUBLE / 14)"), *_smoothed("dn", "ud", "d", 14, "(1.0::DOUBLE / 14)"),
)


@query(
    with_(*GRID, *_RECURSIVE, "al AS (SELECT tr.ticker, tr.date, stored, e20, e50, e200, atr.l AS a, up.l AS u, dn.l AS d, macd, last_value(sig.l IGNORE NULLS) OVER (PARTITION BY tr.ticker ORDER BY tr.date ROWS UNBOUNDED PRECEDING) AS s FROM tr JOIN lv USING (ticker, date) JOIN ln USING (ticker, date) LEFT JOIN atr USING (ticker, date) LEFT JOIN up USING (ticker, date) LEFT JOIN dn USING (ticker, date) LEFT JOIN sig USING (ticker, date))",
          result="SELECT ticker, date, e20 AS ema_20, e50 AS ema_50, e200 AS ema_200, a AS atr_14, CASE WHEN u + d = 0 THEN 50 ELSE 100 * u / (u + d) END AS rsi_14, macd, s AS macd_signal, macd - s AS macd_hist FROM al WHERE stored"),
    "ticker date", "ema_20 ema_50 ema_200 atr_14 rsi_14 macd macd_signal macd_hist",
)
def t8_recursive(spark, sf):
    g = grid(spark, sf).withColumn("tr", X.true_range("high", "low", "close"))
    return stored(recursive_columns(g, "close", "close", "tr")).select("ticker", "date", "ema_20", "ema_50", "ema_200", "atr_14", "rsi_14", "macd", "macd_signal", "macd_hist")


# ---- labels and cross-sections ----------------------------------------------------------------

_LABELS = (
    f"f AS (SELECT * FROM (SELECT ticker, date, stored, close AS price, lead(close, 5) OVER {W} / close - 1 AS fwd_ret_5d, lead(close, 21) OVER {W} / close - 1 AS fwd_ret_21d FROM grid) WHERE stored)",
    "c AS (SELECT *, "
    + ", ".join(f"count(fwd_ret_{n}d) OVER (PARTITION BY date) AS n{n}, avg(fwd_ret_{n}d) OVER (PARTITION BY date) AS m{n}, rank() OVER (PARTITION BY date ORDER BY fwd_ret_{n}d NULLS LAST) + (count(*) OVER (PARTITION BY date, fwd_ret_{n}d) - 1) / 2.0 AS r{n}" for n in (5, 21))
    + " FROM f)",
)


@query(
    with_(*GRID, *_LABELS, result="SELECT ticker, date, price, " + ", ".join(f"fwd_ret_{n}d, CASE WHEN n{n} >= 10 THEN fwd_ret_{n}d - m{n} END AS fwd_xs_{n}d, CASE WHEN n{n} >= 10 AND fwd_ret_{n}d IS NOT NULL THEN CASE WHEN r{n} / n{n} > 0.8 THEN 1 ELSE 0 END END AS fwd_top_{n}d" for n in (5, 21)) + " FROM c"),
    "ticker date", "price " + " ".join(f"fwd_ret_{n}d fwd_xs_{n}d fwd_top_{n}d" for n in (5, 21)),
)
def t28_labels(spark, sf):
    return L.labels(grid(spark, sf), "close")


_MOM = f"mom AS (SELECT * FROM (SELECT ticker, date, stored, {lagged('close', 21)} / {lagged('close', 252)} - 1 AS x FROM grid) WHERE stored), xs AS (SELECT m.*, sector FROM mom m JOIN listings USING (ticker))"


def momentum(spark, sf):
    g = stored(grid(spark, sf).withColumn("x", X.skip_return("close", 252)))
    return g.join(F.broadcast(H.listings(spark, sf)), "ticker")


@query(
    with_(*GRID, _MOM, "k AS (SELECT *, count(x) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS r FROM xs)",
          result="SELECT ticker, date, CASE WHEN n >= 10 AND x IS NOT NULL THEN CASE WHEN n > 1 THEN (r - 1) / (n - 1) ELSE 0.5 END END AS x_rank FROM k"),
    "ticker date", "x_rank",
)
def x1_cross_rank(spark, sf):
    return momentum(spark, sf).withColumn("x_rank", cross_rank(F.col("x")))


@query(
    with_(*GRID, _MOM, "k AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, max(x) OVER w = min(x) OVER w AS flat FROM xs WINDOW w AS (PARTITION BY date))",
          result="SELECT ticker, date, CASE WHEN n >= 10 AND x IS NOT NULL THEN CASE WHEN flat THEN 0 ELSE greatest(least((x - m) / s, 3), -3) END END AS x_z FROM k"),
    "ticker date", "x_z",
)
def x2_cross_zscore(spark, sf):
    return momentum(spark, sf).withColumn("x_z", cross_zscore(F.col("x"), limit=3.0))


@query(with_(*GRID, _MOM, result="SELECT ticker, date, CASE WHEN count(x) OVER (PARTITION BY date, sector) >= 3 THEN x - avg(x) OVER (PARTITION BY date, sector) END AS x_sec FROM xs"), "ticker date", "x_sec")
def x4_sector_demean(spark, sf):
    return momentum(spark, sf).withColumn("x_sec", sector_demean(F.col("x")))


@query(with_(*GRID, _MOM, "k AS (SELECT date, x, avg(x) OVER (PARTITION BY date) AS m, avg(x) OVER (PARTITION BY date, sector) AS s FROM xs WHERE x IS NOT NULL)", result="SELECT date, sum((s - m) * (s - m)) / nullif(sum((x - m) * (x - m)), 0) AS eta2 FROM k GROUP BY date"), "date", "eta2")
def x5_sector_share(spark, sf):
    return L.sector_share(momentum(spark, sf), "x")


@query(
    with_(*GRID, _MOM, "k AS (SELECT *, count(x) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS r FROM xs)",
          "y AS (SELECT date, sector, CASE WHEN n >= 10 AND x IS NOT NULL THEN (r - 1) / (n - 1) END AS q FROM k)",
          result="SELECT date, " + ", ".join(f"avg(q) FILTER (sector = 'S{i}') AS S{i}" for i in range(1, 5)) + " FROM y GROUP BY date"),
    "date", "S1 S2 S3 S4",
)
def x6_sector_mean_rank(spark, sf):
    m = momentum(spark, sf).withColumn("q", cross_rank(F.col("x")))
    return L.sector_mean_rank(m, "q", [f"S{i}" for i in range(1, 5)])


@query(with_(*GRID, _MOM, "k AS (SELECT *, count(x) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS r FROM xs)", result="SELECT ticker, date, CASE WHEN x IS NOT NULL THEN CASE WHEN r / n > 0.8 THEN 1 ELSE 0 END END AS top FROM k"), "ticker date", "top")
def x8_top_quantile(spark, sf):
    return momentum(spark, sf).withColumn("top", L.top_quantile(F.col("x")))


_SCORED = (
    f"sc AS (SELECT * FROM (SELECT ticker, date, stored, {lagged('close', 21)} / {lagged('close', 126)} - 1 AS a, -(close / {lagged('close', 5)} - 1) AS b, lead(close, 21) OVER {W} / close - 1 AS y FROM grid) WHERE stored)"
)


def scored(spark, sf):
    g = grid(spark, sf)
    return stored(X.with_columns(g, {"a": X.skip_return("close", 126), "b": -X.simple_return("close", 5), "y": X.forward_return("close", 21)}))


@query(
    with_(*GRID, _SCORED, "k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM sc WHERE a IS NOT NULL AND y IS NOT NULL)",
          result="SELECT date, count(*) AS n, CASE WHEN count(*) >= 3 AND min(ra) < max(ra) AND min(ry) < max(ry) THEN corr(ra, ry) END AS ic FROM k GROUP BY date"),
    "date n", "ic",
)
def x9_information_coefficient(spark, sf):
    return L.information_coefficient(scored(spark, sf), "a", "y")


@query(
    with_(*GRID, _SCORED, *(f"t{c} AS (SELECT date, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {c} DESC, ticker) AS p FROM sc WHERE {c} IS NOT NULL) WHERE p <= 5)" for c in "ab"),
          "sz AS (SELECT date, least(count(*), 5) AS k FROM sc WHERE a IS NOT NULL GROUP BY date)",
          result="SELECT sz.date, count(tb.ticker) / any_value(k)::DOUBLE AS overlap FROM sz JOIN (SELECT DISTINCT date FROM tb) d USING (date) LEFT JOIN ta ON ta.date = sz.date LEFT JOIN tb ON tb.date = ta.date AND tb.ticker = ta.ticker GROUP BY sz.date"),
    "date", "overlap",
)
def x11_top_overlap(spark, sf):
    s = scored(spark, sf)
    return L.top_overlap(s.select("date", "ticker", F.col("a").alias("score")), s.select("date", "ticker", F.col("b").alias("score")), 5)


@query(with_(*GRID, _EV, result=f"SELECT ticker, date, adv FROM (SELECT ticker, date, {rolled('avg(ev)', 'ev', 21, 20)} AS adv FROM g2 WHERE date <= DATE '1996-06-03') WHERE date = DATE '1996-06-03' ORDER BY adv NULLS FIRST, ticker LIMIT 5"), "ticker date", "adv", 4)
def x12_thinnest(spark, sf):
    """The five names with the least value traded on a day: a report of that many rows."""
    g = grid(spark, sf).withColumn("ev", X.eur_volume("volume", "close")).withColumn("adv", X.average_daily_value("ev"))
    return L.thinnest(g.where("date = '1996-06-03'"), "adv", 5)


@query(with_(*GRID, _MOM, result="SELECT date, ticker, place, x AS score FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x DESC, ticker) AS place FROM xs WHERE x IS NOT NULL) WHERE place <= 10"), "date ticker place", "score")
def x13_top_k(spark, sf):
    m = momentum(spark, sf)
    return L.top_k(m.select("date", "ticker", F.col("x").alias("score")), 10)
