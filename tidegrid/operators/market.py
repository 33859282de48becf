"""Corporate actions, currencies, overnight rates, total return and comparisons of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.frames import asof_backward, ratio

#: A split nearer to 1 than that (in logs) can't be told from a move; ages in days; day count.
AMBIGUOUS, FX_AGE, RATE_AGE, DAY_COUNT = 0.2, 5, 7, 360.0
PENCE_VENUES = ("XLON",)


def events(actions: DataFrame, kind: str) -> DataFrame:
    """Events of one kind, those of a day summed."""
    return actions.where(F.col("action") == kind).groupBy("ticker", "date").agg(F.sum("value").alias("value"))


def split_visibility(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """For each split the move over it and whether the bars show it: in_bars when scaling by the ratio brings the
    move nearer to none; a ratio too near to 1 is ambiguous and counts as not shown."""
    splits = events(actions, "split").withColumnRenamed("value", "ratio")
    closes = bars.where("close is not null").select("ticker", "date", "close")
    before = asof_backward(splits, closes, ["ticker"], ["close"], strict=True).withColumnRenamed("close", "before").drop("matched_on")
    nxt = closes.withColumns({"date": F.date_sub(F.lit("2300-01-01").cast("date"), F.datediff("date", F.lit("1900-01-01").cast("date")))})
    turned = before.withColumn("_ex", F.col("date")).withColumn("date", F.date_sub(F.lit("2300-01-01").cast("date"), F.datediff("date", F.lit("1900-01-01").cast("date"))))
    both = asof_backward(turned, nxt, ["ticker"], ["close"]).withColumn("date", F.col("_ex")).drop("_ex", "matched_on").withColumnRenamed("close", "after")
    move, log_ratio = ratio(F.col("after"), F.col("before")), F.ln("ratio")
    ambiguous = F.abs(log_ratio) < AMBIGUOUS
    seen = F.when(move.isNull() | ambiguous, F.lit(False)).otherwise(F.abs(F.ln(move * F.col("ratio"))) < F.abs(F.ln(move)))
    return both.select("ticker", "date", "ratio", move.alias("move"), ambiguous.alias("ambiguous"), seen.alias("in_bars"))


def factors_after(dates: DataFrame, factors: DataFrame, name: str) -> DataFrame:
    """dates(ticker, date) with the product of factors(ticker, date, factor) strictly after each date: events are
    tagged into the dates and summed backwards in logs, one sort for each ticker."""
    a = dates.select("ticker", "date", F.lit(0.0).alias("lf"), F.lit(True).alias("_own"))
    b = factors.select("ticker", "date", F.ln("factor").alias("lf"), F.lit(False).alias("_own"))
    # on one date the event comes first: it is not after that date
    w = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("_own")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(name, F.exp(F.sum("lf").over(w)))
    return both.where("_own").select("ticker", "date", name)


def split_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(ticker, date, split_factor): product of 1 / ratio of the splits that the bars show, after each session."""
    shown = split_visibility(bars, actions).where("in_bars").select("ticker", "date", (1 / F.col("ratio")).alias("factor"))
    return factors_after(bars.select("ticker", "date"), shown, "split_factor")


def dividend_events(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(ticker, date, factor): 1 - dividend / split-adjusted close of the last session before, for dividends
    inside the bars' span; a factor of 0 or less raises when run."""
    closes = bars.where("close is not null").join(split_factors(bars, actions), ["ticker", "date"]).select("ticker", "date", (F.col("close") * F.col("split_factor")).alias("base"))
    spans = closes.groupBy("ticker").agg(F.max("date").alias("_hi"))
    paid = asof_backward(events(actions, "dividend"), closes, ["ticker"], ["base"], strict=True).where("base is not null").join(spans, "ticker").where("date <= _hi")
    factor = 1 - F.col("value") / F.col("base")
    safe = F.when(factor > 0, factor).otherwise(F.raise_error(F.concat(F.lit("dividend of the price or more: "), F.col("ticker"), F.lit(" "), F.col("date").cast("string"))).cast("double"))
    return paid.select("ticker", "date", safe.alias("factor"))


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(ticker, date, close, split_factor, dividend_factor, adj_close) of bars with a close. Cut dates after this,
    never before: the factors need all history up to as_of."""
    closes = bars.where("close is not null").select("ticker", "date", "close")
    with_splits = closes.join(split_factors(bars, actions), ["ticker", "date"])
    out = with_splits.join(factors_after(closes.select("ticker", "date"), dividend_events(bars, actions), "dividend_factor"), ["ticker", "date"])
    return out.select("ticker", "date", "close", "split_factor", "dividend_factor", (F.col("close") * F.col("split_factor") * F.col("dividend_factor")).alias("adj_close"))


# ---- currencies -------------------------------------------------------------------------------


def pair_for(currency: Column) -> Column:
    return F.when(currency != "EUR", F.concat(F.lit("EUR"), currency))


def quote_scale(venue: Column) -> Column:
    """Some venues quote in hundredths of their currency."""
    return F.when(venue.isin(*PENCE_VENUES), 0.01).otherwise(1.0)


def rate_on(dates: DataFrame, fx: DataFrame, max_age: int = FX_AGE) -> DataFrame:
    """dates(pair, date, ...) with the rate of the day or the last before it, at most max_age days old, and
    none after the pair's newest rate."""
    out = asof_backward(dates, fx.where("rate is not null"), ["pair"], ["rate"], max_age, not_after_last=True)
    return out.drop("matched_on")


def to_eur(prices: DataFrame, fx: DataFrame, listings: DataFrame, column: str = "close", max_age: int = FX_AGE) -> DataFrame:
    """prices(ticker, date, column) with column_eur: scaled price over the rate; euro prices pass."""
    known = prices.join(F.broadcast(listings.select("ticker", "currency", "venue")), "ticker", "left").withColumn("pair", pair_for(F.col("currency")))
    rated = rate_on(known, fx, max_age)
    scaled = F.col(column) * quote_scale(F.col("venue"))
    eur = F.when(F.col("currency") == "EUR", scaled).otherwise(ratio(scaled, F.col("rate")))
    return rated.withColumn(f"{column}_eur", eur).drop("pair", "rate", "currency", "venue")


def refresh_close_eur(bars: DataFrame, fx: DataFrame, listings: DataFrame) -> DataFrame:
    """The bars whose stored close_eur differs from a fresh one, with it: what has to be written."""
    fresh = to_eur(bars.select("ticker", "date", "close"), fx, listings).select("ticker", "date", F.col("close_eur").alias("_new"))
    changed = bars.join(fresh, ["ticker", "date"]).where(~F.col("close_eur").eqNullSafe(F.col("_new")))
    return changed.withColumn("close_eur", F.col("_new")).drop("_new")


def total_return(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(ticker, date, close, adj_close, close_eur, adj_close_eur)."""
    adj = adjust(bars, actions).select("ticker", "date", "close", "adj_close")
    both = adj.join(bars.select("ticker", "date", "close_eur"), ["ticker", "date"], "left")
    return both.withColumn("adj_close_eur", ratio(F.col("adj_close") * F.col("close_eur"), F.col("close")))


def divergence(returns: DataFrame) -> DataFrame:
    """returns(ticker, date, local, eur): both as indices of the first day, the rate's share, and whether
    (1 + eur) = (1 + local) / (1 + fx) holds to a basis point."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local, eur = ratio(F.col("local"), F.first("local", ignorenulls=True).over(w)), ratio(F.col("eur"), F.first("eur", ignorenulls=True).over(w))
    fx = ratio(local, eur)
    return returns.select("ticker", "date", local.alias("local_index"), eur.alias("eur_index"), fx.alias("fx_index"), F.coalesce(F.abs(eur - ratio(local, fx)) <= 1e-4, F.lit(False)).alias("holds"))


# ---- overnight rates --------------------------------------------------------------------------


def short_rate(rates: DataFrame, order: tuple[str, ...] = ("ESTR", "EONIA")) -> DataFrame:
    """One rate a day: the first series of the order that has one."""
    priority = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("series"))
    return rates.where((priority > 0) & F.col("rate").isNotNull()).groupBy("date").agg(F.min_by("rate", priority).alias("rate"))


def risk_free_returns(dates: DataFrame, rates: DataFrame, max_age: int = RATE_AGE) -> DataFrame:
    """dates(date) with rf: the rate known at the date before, accrued over the days since; the first is 0, a rate
    older than max_age days is missing. A calendar's one series: it is as long as its dates."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    # the key is a constant: the series is one
    known = asof_backward(dates.select("date").distinct().withColumn("_k", F.lit(1)), short_rate(rates).withColumn("_k", F.lit(1)), ["_k"], ["rate"], max_age)
    accrued = F.lag("rate").over(w) / 100 * F.datediff("date", F.lag("date").over(w)) / DAY_COUNT
    return known.select("date", F.when(F.row_number().over(w) == 1, 0.0).otherwise(accrued).alias("rf"))


# ---- comparisons ------------------------------------------------------------------------------


def growth(prices: DataFrame, value: str, by: str = "ticker") -> DataFrame:
    """Series as multiples of their first value, gaps carried."""
    w = Window.partitionBy(by).orderBy("date")
    carried = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return prices.select(by, "date", ratio(carried, first).alias("growth"))


def equal_weight(prices: DataFrame, value: str) -> DataFrame:
    """(date, log_growth, growth): each day's mean of the daily returns there are, compounded."""
    w = Window.partitionBy("ticker").orderBy("date")
    daily = prices.select("date", (ratio(F.col(value), F.lag(value).over(w)) - 1).alias("r")).groupBy("date").agg(F.avg("r").alias("r"))
    line = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.ln(1 + F.coalesce("r", F.lit(0.0)))).over(line)
    return daily.select("date", total.alias("log_growth"), F.exp(total).alias("growth"))


def on_union_calendar(series: DataFrame, value: str, by: str = "ticker") -> DataFrame:
    """Every series on every date of any, from its own first date on, values carried."""
    days = series.select("date").distinct()
    spans = series.where(F.col(value).isNotNull()).groupBy(by).agg(F.min("date").alias("_lo"))
    grid = spans.join(days, F.col("date") >= F.col("_lo")).select(by, "date")
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(series.select(by, "date", value), [by, "date"], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def outperformers(series: DataFrame, benchmark: DataFrame, value: str) -> DataFrame:
    """(ticker, since, own, bench, ahead): growth since the ticker's own first session against the benchmark's."""
    s = series.where(F.col(value).isNotNull()).groupBy("ticker").agg(F.min("date").alias("since"), ratio(F.max_by(value, "date"), F.min_by(value, "date")).alias("own"))
    marks = benchmark.where("bench is not null").withColumn("_k", F.lit(1))
    first = asof_backward(s.select("ticker", "own", F.col("since").alias("date")).withColumn("_k", F.lit(1)), marks, ["_k"], ["bench"])
    last = benchmark.where("bench is not null").agg(F.max_by("bench", "date").alias("_last"))
    out = first.join(F.broadcast(last))  # one row
    return out.select("ticker", F.col("date").alias("since"), "own", ratio(F.col("_last"), F.col("bench")).alias("bench"), (F.col("own") > ratio(F.col("_last"), F.col("bench"))).alias("ahead"))


def performance(series: DataFrame, value: str, by: str = "ticker", periods: float = 252.0) -> DataFrame:
    """(by, total, cagr, vol, sharpe): years of 365.25 days, Sharpe without a risk-free rate."""
    w = Window.partitionBy(by).orderBy("date")
    r = ratio(F.col(value), F.lag(value).over(w)) - 1
    total = ratio(F.max_by(value, "date"), F.min_by(value, "date"))
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    agg = series.where(F.col(value).isNotNull()).withColumn("_r", r).groupBy(by).agg(total.alias("_t"), years.alias("_y"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"))
    root = F.sqrt(F.lit(periods))
    return agg.select(by, (F.col("_t") - 1).alias("total"), F.when(F.col("_y") > 0, F.pow("_t", 1 / F.col("_y")) - 1).alias("cagr"), (F.col("_s") * root).alias("vol"), (ratio(F.col("_m"), F.col("_s")) * root).alias("sharpe"))


def compare_adjusted(ours: DataFrame, theirs: DataFrame, threshold: float = 5e-3) -> DataFrame:
    """(ticker, worst, worst_date, n, diverges): largest |a / b - 1| of two adjusted closes on common dates."""
    both = ours.select("ticker", "date", F.col("adj_close").alias("a")).join(theirs.select("ticker", "date", F.col("adj_close").alias("b")), ["ticker", "date"])
    gap = both.withColumn("gap", F.abs(ratio(F.col("a"), F.col("b")) - 1)).where("gap is not null")
    return gap.groupBy("ticker").agg(F.max("gap").alias("worst"), F.max_by("date", F.struct("gap", "date")).alias("worst_date"), F.count("*").alias("n")).withColumn("diverges", F.col("worst") > threshold)
