"""Reads of a store, each with a mandatory as_of: nothing later is looked at, and a window past it raises.

Features that look back h sessions read 2 h + 14 days more than asked and are cut afterwards; adjusted prices and
recursive averages read all history up to as_of, since their values depend on it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import features as X
from tidegrid.functions.recursive import recursive_columns
from tidegrid.operators import labels as L
from tidegrid.operators import market as M
from tidegrid.operators import portfolio as B
from tidegrid.operators.frames import carry_onto, positive, ratio, session_grid
from tidegrid.pit import bound_end, guard, resolve_as_of
from tidegrid.sources.store import Store


def _cut(df: DataFrame, as_of: dt.date, start: dt.date | None, end: dt.date | None) -> DataFrame:
    last = bound_end(end, as_of, start)
    df = df.where(F.col("date") <= F.lit(last))
    return guard(df.where(F.col("date") >= F.lit(start)) if start else df, as_of)


def _padded(start: dt.date | None, sessions: int) -> dt.date | None:
    return start - dt.timedelta(days=2 * sessions + 14) if start else None


def read_adjusted(store: Store, tickers: list[str] | None = None, *, as_of, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Factors on all history up to as_of, then the dates asked for."""
    until = resolve_as_of(as_of)
    bound_end(end, until, start)
    bars = store.read_bars(tickers, as_of=until)
    return _cut(M.adjust(bars, store.read("actions", tickers, as_of=until)), until, start, end)


def read_total_return(store: Store, tickers: list[str] | None = None, *, as_of, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    until = resolve_as_of(as_of)
    bound_end(end, until, start)
    bars = store.read_bars(tickers, as_of=until)
    return _cut(M.total_return(bars, store.read("actions", tickers, as_of=until)), until, start, end)


def read_benchmarks(store: Store, tickers: list[str], *, as_of, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Total-return series of the benchmarks, as multiples of their first value."""
    series = read_total_return(store, tickers, as_of=as_of, start=start, end=end)
    return M.growth(series, "adj_close_eur")


def read_risk_free(store: Store, dates: DataFrame, *, as_of) -> DataFrame:
    until = resolve_as_of(as_of)
    return guard(M.risk_free_returns(dates.where(F.col("date") <= F.lit(until)), store.read("rates", as_of=until)), until)


def _grid(store: Store, sessions: DataFrame, listings: DataFrame, until: dt.date, tickers: list[str] | None, since: dt.date | None) -> DataFrame:
    """Bars and adjusted prices on the venues' sessions from `since` on."""
    bars = store.read_bars(tickers, as_of=until)
    prices = M.total_return(bars, store.read("actions", tickers, as_of=until)).select("ticker", "date", "adj_close", "adj_close_eur")
    full = bars.join(prices, ["ticker", "date"], "left")
    full = full.where(F.col("date") >= F.lit(since)) if since else full
    g = session_grid(full, sessions.where(F.col("date") <= F.lit(until)), listings.select("ticker", "venue"))
    return g.withColumns({"p": positive(F.col("adj_close_eur")), "q": positive(F.col("adj_close")), "ah": X.adjusted("high"), "al": X.adjusted("low"), "ev": X.eur_volume()})


def _read(store, sessions, listings, columns, names, as_of, tickers, start, end, lookback):
    until = resolve_as_of(as_of)
    bound_end(end, until, start)
    g = _grid(store, sessions, listings, until, tickers, _padded(start, lookback) if lookback is not None else None)
    return _cut(columns(g).where("stored").select("ticker", "date", *names), until, start, end)


def read_returns(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    make = X.returns("p")
    return _read(store, sessions, listings, lambda g: X.with_columns(g, make), list(make), as_of, tickers, start, end, max(X.HORIZONS))


def read_momentum(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    make = X.momentum("p")
    return _read(store, sessions, listings, lambda g: X.with_columns(g, make), list(make), as_of, tickers, start, end, 252)


def read_volatility(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    def make(g):
        g = X.with_columns(g, {"lr": X.log_return("p", 1), "tr": X.true_range("ah", "al", "q")})
        return X.with_columns(recursive_columns(g, "p", "q", "tr"), {f"vol_{n}d": X.realized_vol("lr", n) for n in X.VOLATILITY} | {"downdev_63d": X.downside_deviation("lr"), "atr_14_pct": ratio(F.col("atr_14"), F.col("q"))})

    names = [*(f"vol_{n}d" for n in X.VOLATILITY), "downdev_63d", "atr_14_pct", "mdd_252d"]
    return _read(store, sessions, listings, make, names, as_of, tickers, start, end, None)


def read_trend(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    kinds = [(k, n) for k in ("sma", "ema") for n in X.AVERAGES]

    def make(g):
        g = X.with_columns(g.withColumn("tr", F.lit(None).cast("double")), {f"sma_{n}": X.sma("p", n) for n in X.AVERAGES})
        g = recursive_columns(g, "p", "q", "tr").withColumn("trend_50_200", X.trend_state())
        g = X.with_columns(g, {f"dist_{k}_{n}": X.distance("p", f"{k}_{n}") for k, n in kinds} | {f"slope_{k}_{n}": X.slope(f"{k}_{n}") for k, n in kinds})
        return X.with_columns(g.where("stored"), X.crosses("trend_50_200"))

    names = [*(f"dist_{k}_{n}" for k, n in kinds), *(f"slope_{k}_{n}" for k, n in kinds), "trend_50_200", "golden_cross", "death_cross"]
    return _read(store, sessions, listings, make, names, as_of, tickers, start, end, None)


def read_oscillators(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    def make(g):
        g = recursive_columns(g.withColumn("tr", F.lit(None).cast("double")), "p", "q", "tr")
        g = X.with_columns(g, {"stoch_k": X.stoch_k("ah", "al", "q"), "bb_pctb": X.percent_b("q")} | {f"{c}_pct": ratio(F.col(c), F.col("q")) for c in ("macd", "macd_signal", "macd_hist")})
        return g.withColumn("stoch_d", X.stoch_d("stoch_k"))

    names = ["rsi_14", "macd_pct", "macd_signal_pct", "macd_hist_pct", "stoch_k", "stoch_d", "bb_pctb"]
    return _read(store, sessions, listings, make, names, as_of, tickers, start, end, None)


def read_liquidity(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    def make(g):
        g = g.withColumn("sg", X.signed_value("q", "ev"))
        g = X.with_columns(g, {"adv_eur_21": X.average_daily_value("ev"), "volume_z_63": X.volume_zscore("ev"), "obv_flow_21": X.obv_flow("sg", "ev")})
        return g.withColumn("tradable", X.tradable("adv_eur_21"))

    return _read(store, sessions, listings, make, ["adv_eur_21", "volume_z_63", "obv_flow_21", "tradable"], as_of, tickers, start, end, None)


def read_relatives(store, sessions, listings, benchmark: str, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    until = resolve_as_of(as_of)
    bench = read_total_return(store, [benchmark], as_of=until).select("date", F.col("adj_close_eur").alias("bench"))

    def make(g):
        days = g.select("date").distinct()
        g = g.join(F.broadcast(carry_onto(bench, days, "bench", 5)), "date", "left")
        g = X.with_columns(g, {"ri": X.log_return("p", 1), "rm": X.log_return("bench", 1)})
        return X.with_rolling_beta(g, "ri", "rm").withColumn("mom_resid_12_1", X.residual_momentum("p", "bench", "beta_252"))

    return _read(store, sessions, listings, make, ["beta_252", "idio_vol_252", "mom_resid_12_1"], as_of, tickers, start, end, 252)


def read_labels(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    """Labels whose whole span lies before as_of; others are missing, not guessed."""
    until = resolve_as_of(as_of)
    bound_end(end, until, start)
    return _cut(L.labels(_grid(store, sessions, listings, until, tickers, None), "p"), until, start, end)


def read_backtest_prices(store, sessions, listings, tickers=None, *, as_of, start=None, end=None) -> DataFrame:
    until = resolve_as_of(as_of)
    total = read_total_return(store, tickers, as_of=until, start=start, end=end)
    return guard(B.backtest_prices(total, store.read_bars(tickers, as_of=until), read_liquidity(store, sessions, listings, tickers, as_of=until)), until)
