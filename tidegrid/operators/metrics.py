"""Measures of equity curves and fills: one aggregation for each, in terms of (series, date, value) frames."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.operators.frames import ratio

#: Bootstrap block, resamples, level and seed.
BLOCK, RESAMPLES, LEVEL, SEED = 21, 5000, 0.95, 39


def w_s():
    """Rows of a series in date order."""
    return Window.partitionBy("series").orderBy("date")


def session_returns(curve: DataFrame, value: str = "value") -> DataFrame:
    return curve.select("series", "date", value, (ratio(F.col(value), F.lag(value).over(w_s())) - 1).alias("ret"))


def year_fraction(start: dt.date, end: dt.date) -> float:
    """Whole anniversaries (29 February falls on the 28th), and the rest as a share of the year it lies in."""

    def anniversary(k: int) -> dt.date:
        try:
            return start.replace(year=start.year + k)
        except ValueError:
            return start.replace(year=start.year + k, day=28)

    years = end.year - start.year
    if anniversary(years) > end:
        years -= 1
    last, following = anniversary(years), anniversary(years + 1)
    return years + (end - last).days / (following - last).days


def year_fraction_column(start: Column, end: Column) -> Column:
    """year_fraction as a column: add_months gives 28 February for a 29th."""
    years = F.floor(F.months_between(end, start) / 12 + F.lit(1e-9)).cast("int")
    years = F.when(F.add_months(start, years * 12) > end, years - 1).otherwise(years)
    last, following = F.add_months(start, years * 12), F.add_months(start, (years + 1) * 12)
    return years + F.datediff(end, last) / F.datediff(following, last)


def excess_returns(returns: DataFrame, risk_free: DataFrame) -> DataFrame:
    return returns.join(risk_free, "date", "left").withColumn("excess", F.col("ret") - F.col("rf"))


def summary(returns: DataFrame, value: str = "value", periods: float = 252.0) -> DataFrame:
    """(series, total, cagr, vol, sharpe, sortino, hit_rate, avg_win, avg_loss, payoff, n) from session_returns or
    excess_returns. Sharpe and Sortino are missing if any excess is; flat sessions count for neither win nor loss."""
    x = F.col("excess") if "excess" in returns.columns else F.col("ret")
    root = F.sqrt(F.lit(periods))
    moved = F.col("ret").isNotNull()
    whole = F.count_if(moved & x.isNull()) == 0
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    own = F.when(moved, x)
    agg = returns.groupBy("series").agg(
        F.min_by(value, "date").alias("_a"), F.max_by(value, "date").alias("_b"), F.min("date").alias("_from"), F.max("date").alias("_to"),
        (F.stddev_samp("ret") * root).alias("vol"), F.when(whole, ratio(F.avg(own), F.stddev_samp(own)) * root).alias("sharpe"),
        F.when(whole, ratio(F.avg(own), F.sqrt(F.avg(F.when(own.isNotNull(), F.pow(F.least(own, F.lit(0.0)), 2))))) * root).alias("sortino"),
        ratio(F.count_if(F.col("ret") > 0).cast("double"), F.count_if(F.col("ret") != 0).cast("double")).alias("hit_rate"),
        win.alias("avg_win"), loss.alias("avg_loss"), ratio(win, -loss).alias("payoff"), F.count("ret").alias("n"),
    )
    years = year_fraction_column(F.col("_from"), F.col("_to"))
    total = ratio(F.col("_b"), F.col("_a"))
    return agg.select("series", (total - 1).alias("total"), F.when(years > 0, F.pow(total, 1 / years) - 1).alias("cagr"), "vol", "sharpe", "sortino", "hit_rate", "avg_win", "avg_loss", "payoff", "n")


def drawdown_series(curve: DataFrame, value: str = "value") -> DataFrame:
    peak = F.max(value).over(w_s().rowsBetween(Window.unboundedPreceding, 0))
    return curve.select("series", "date", value, peak.alias("peak"), (ratio(F.col(value), peak) - 1).alias("drawdown"))


def drawdown_episodes(curve: DataFrame, value: str = "value") -> DataFrame:
    """(series, peak, trough, recovery, depth, sessions, days): from the last equal peak to the first date at or
    above it; recovery is null while below."""
    before = F.max(value).over(w_s().rowsBetween(Window.unboundedPreceding, -1))
    at_peak = F.coalesce(F.col(value) >= before, F.lit(True))
    marked = curve.withColumn("_top", at_peak).withColumn("_id", F.sum(F.when(F.col("_top"), 1).otherwise(0)).over(w_s().rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_next", F.min(F.when(F.col("_top"), F.col("date"))).over(w_s().rowsBetween(1, Window.unboundedFollowing)))
    runs = marked.groupBy("series", "_id").agg(
        F.min("date").alias("peak"), F.min_by("date", F.struct(F.col(value), F.col("date"))).alias("trough"), F.min_by("_next", "date").alias("recovery"),
        ratio(F.min(value), F.max_by(value, F.col("_top").cast("int"))).alias("_r"), F.count("*").alias("_n"), F.max("date").alias("_last"),
    )
    below = runs.where("_n > 1")
    sessions = F.when(F.col("recovery").isNotNull(), F.col("_n")).otherwise(F.col("_n") - 1)
    return below.select("series", "peak", "trough", "recovery", (F.col("_r") - 1).alias("depth"), sessions.alias("sessions"), F.datediff(F.coalesce("recovery", "_last"), "peak").alias("days"))


def turnover(trades: DataFrame, equity: DataFrame, periods: float = 252.0) -> DataFrame:
    """(series, turnover): half of the value traded after the first decision, over mean equity, a year."""
    first = Window.partitionBy("series")
    later = trades.withColumn("_first", F.min("decided").over(first)).where("decided > _first").groupBy("series").agg(F.sum("value_eur").alias("v"))
    base = equity.groupBy("series").agg(F.avg("equity_eur").alias("m"), F.count("*").alias("n"))
    return base.join(later, "series", "left").select("series", (ratio(F.coalesce("v", F.lit(0.0)) / 2, F.col("m")) * periods / F.greatest(F.col("n") - 1, F.lit(1))).alias("turnover"))


def holding_spells(positions: DataFrame, axis: DataFrame) -> DataFrame:
    """(series, ticker, start, end, sessions): unbroken holdings on the axis(series, date)."""
    numbered = axis.select("series", "date").distinct().withColumn("_i", F.row_number().over(w_s()))
    w = Window.partitionBy("series", "ticker").orderBy("date")
    held = positions.join(numbered, ["series", "date"]).withColumn("_run", F.col("_i") - F.row_number().over(w))
    return held.groupBy("series", "ticker", "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions")).drop("_run")


def period_returns(curve: DataFrame, unit: str = "year", value: str = "value") -> DataFrame:
    """(series, period, ret): last value of a period over the last of the period before; the first period counts from
    the first value and is left out if that is its only one."""
    period = F.trunc("date", unit).alias("period")
    ends = curve.groupBy("series", period).agg(F.max_by(value, "date").alias("last"), F.min_by(value, "date").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("series").orderBy("period")
    before = F.lag("last").over(w)
    out = ends.withColumn("_base", F.coalesce(before, "first")).withColumn("_only", before.isNull() & (F.col("n") == 1)).where("not _only")
    return out.select("series", "period", (ratio(F.col("last"), F.col("_base")) - 1).alias("ret"))


def rolling_sharpe(returns: DataFrame, n: int = 252, periods: float = 252.0) -> DataFrame:
    frame = w_s().rowsBetween(-(n - 1), 0)
    x = F.col("excess") if "excess" in returns.columns else F.col("ret")
    return returns.select("series", "date", F.when(F.count(x).over(frame) == n, ratio(F.avg(x).over(frame), F.stddev_samp(x).over(frame)) * F.sqrt(F.lit(periods))).alias("sharpe"))


# ---- block bootstrap --------------------------------------------------------------------------


def block_starts(n: int, resamples: int = RESAMPLES, block: int = BLOCK, seed: int = SEED, chunk: int = 500) -> np.ndarray:
    """Starts of circular blocks, resamples x blocks; drawn in chunks from one generator."""
    rng, blocks = np.random.default_rng(seed), math.ceil(n / block)
    return np.concatenate([rng.integers(0, n, size=(min(chunk, resamples - at), blocks)) for at in range(0, resamples, chunk)])


def starts_table(spark: SparkSession, n: int, **kw) -> DataFrame:
    """(replicate, k, start) of block_starts."""
    import pandas as pd

    s = block_starts(n, **kw)
    rep, k = np.meshgrid(np.arange(len(s)), np.arange(s.shape[1]), indexing="ij")
    return spark.createDataFrame(pd.DataFrame({"replicate": rep.ravel().astype("int64"), "k": k.ravel().astype("int64"), "start": s.ravel().astype("int64")}))


def hashed_starts(spark: SparkSession, n: int, resamples: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(replicate, k, start) from a hash of (seed, replicate, k): nothing is drawn on the driver."""
    blocks = math.ceil(n / block)
    ids = spark.range(resamples * blocks).select((F.col("id") / blocks).cast("long").alias("replicate"), (F.col("id") % blocks).alias("k"))
    return ids.withColumn("start", F.pmod(F.crc32(F.concat_ws(":", F.lit(seed), "replicate", "k").cast("binary")), F.lit(n)))


def bootstrap_moments(excess: DataFrame, starts: DataFrame, n: int, values: list[str], block: int = BLOCK) -> DataFrame:
    """(replicate, and mean_v, std_v for each value): sums of whole circular blocks are made once for each start and
    joined by it; a replicate then adds n / block rows instead of n."""
    w0 = Window.partitionBy(F.lit(1)).orderBy("date")
    line = excess.select((F.row_number().over(w0) - 1).cast("long").alias("i"), *values)
    twice = line.unionByName(line.withColumn("i", F.col("i") + n))
    blocks = -(-n // block)
    last = n - (blocks - 1) * block
    sums = []
    for size in {block, last}:
        frame = Window.partitionBy(F.lit(1)).orderBy("i").rowsBetween(0, size - 1)
        sums.append(twice.select("i", F.lit(size).alias("size"), *[F.sum(v).over(frame).alias(f"s_{v}") for v in values], *[F.sum(F.col(v) * F.col(v)).over(frame).alias(f"q_{v}") for v in values]).where(F.col("i") < n))
    table = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    drawn = starts.withColumn("size", F.when(F.col("k") == blocks - 1, last).otherwise(block)).withColumnRenamed("start", "i")
    met = drawn.join(table, ["i", "size"]).groupBy("replicate").agg(*[F.sum(f"{p}_{v}").alias(f"{p}_{v}") for v in values for p in "sq"])
    out = []
    for v in values:
        mean = F.col(f"s_{v}") / n
        out += [mean.alias(f"mean_{v}"), F.sqrt(F.greatest((F.col(f"q_{v}") - n * mean * mean) / (n - 1), F.lit(0.0))).alias(f"std_{v}")]
    return met.select("replicate", *out)


def bootstrap_sharpe(excess: DataFrame, starts: DataFrame, n: int, value: str = "excess", level: float = LEVEL, periods: float = 252.0) -> DataFrame:
    """One row: low and high of the percentile interval, se, share of replicates at or below 0."""
    m = bootstrap_moments(excess, starts, n, [value])
    s = ratio(F.col(f"mean_{value}"), F.col(f"std_{value}")) * F.sqrt(F.lit(periods))
    return _interval(m.select(s.alias("s")), level)


def bootstrap_difference(pairs: DataFrame, starts: DataFrame, n: int, a: str, b: str, level: float = LEVEL, periods: float = 252.0) -> DataFrame:
    """The same for the difference of two Sharpe ratios over the same blocks."""
    m = bootstrap_moments(pairs, starts, n, [a, b])
    sharpe = lambda v: ratio(F.col(f"mean_{v}"), F.col(f"std_{v}")) * F.sqrt(F.lit(periods))
    return _interval(m.select((sharpe(a) - sharpe(b)).alias("s")), level)


def _interval(s: DataFrame, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return s.agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"), F.stddev_samp("s").alias("se"), F.avg((F.col("s") <= 0).cast("double")).alias("p_below"))


def familywise_level(level: float, trials: int) -> float:
    return 1 - (1 - level) / max(1, trials)


def the_bar(named: DataFrame, random: DataFrame, q: float = 0.95) -> DataFrame:
    """(source, sharpe): the best of the named Sharpe ratios and the q-quantile of the random ones."""
    best = named.agg(F.max_by("series", F.struct("sharpe", "series")).alias("source"), F.max("sharpe").alias("sharpe"))
    wide = random.agg(F.percentile("sharpe", F.lit(q)).alias("sharpe")).select(F.lit("random").alias("source"), "sharpe")
    return best.unionByName(wide).where("sharpe is not null").orderBy(F.desc("sharpe")).limit(1)


def random_distribution(random: DataFrame, value: str = "sharpe") -> DataFrame:
    points = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    return random.agg(F.percentile(value, F.array(*[F.lit(p) for p in points])).alias("p")).select(F.posexplode("p").alias("at", "value")).select(F.element_at(F.array(*[F.lit(int(p * 100)) for p in points]), F.col("at") + 1).alias("percentile"), "value")


def axis_periods(dates: Column, first: Column, last: Column) -> Column:
    """Dates a year on an axis."""
    return F.when(F.datediff(last, first) > 0, (dates - 1) / (F.datediff(last, first) / 365.25))


def sharpe_intervals(excess: DataFrame, starts: DataFrame, n: int, names: list[str], level: float = LEVEL, periods: float = 252.0) -> DataFrame:
    """(series, low, high, se, p_below) for named columns of excess(date, ...), over the same blocks."""
    m = bootstrap_moments(excess, starts, n, names)
    each = F.array(*[F.struct(F.lit(v).alias("series"), (ratio(F.col(f"mean_{v}"), F.col(f"std_{v}")) * F.sqrt(F.lit(periods))).alias("s")) for v in names])
    tail = (1 - level) / 2
    return m.select(F.inline(each)).groupBy("series").agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"), F.stddev_samp("s").alias("se"), F.avg((F.col("s") <= 0).cast("double")).alias("p_below"))


def compare_with_bar(sharpe: float, bar: DataFrame) -> DataFrame:
    """(source, bar, sharpe, beats): a strategy against the_bar()."""
    return bar.select("source", F.col("sharpe").alias("bar"), F.lit(sharpe).alias("sharpe"), (F.lit(sharpe) > F.col("sharpe")).alias("beats"))
