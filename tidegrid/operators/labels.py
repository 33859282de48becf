"""Forward labels, walk-forward folds, rank statistics of scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.features import forward_return
from tidegrid.operators.frames import asof_backward, average_rank, ratio

#: Label horizons, share that counts as the top, fewest names of a date.
HORIZONS, TOP, MIN_NAMES = (5, 21), 0.2, 10
#: A label whose end is not known yet ends here.
OPEN_END = dt.date(9999, 12, 31)


def labels(grid: DataFrame, price: str, horizons: tuple[int, ...] = HORIZONS, min_names: int = MIN_NAMES, mask: Column | None = None) -> DataFrame:
    """(ticker, date, price, fwd_ret_N, fwd_xs_N, fwd_top_N): return over N sessions, its excess over the date's mean,
    and 1 for the top fifth by rank with ties averaged; the last two need min_names names."""
    out = grid.select("ticker", "date", *(["stored"] if "stored" in grid.columns else []), F.col(price).alias("price"), *[forward_return(price, n).alias(f"fwd_ret_{n}d") for n in horizons])
    if "stored" in out.columns:
        out = out.where("stored").drop("stored")
    extra = []
    for n in horizons:
        x = F.col(f"fwd_ret_{n}d") if mask is None else F.when(mask, F.col(f"fwd_ret_{n}d"))
        rank, count = average_rank(x, ["date"])
        enough = count >= min_names
        extra += [F.when(enough, x - F.avg(x).over(Window.partitionBy("date"))).alias(f"fwd_xs_{n}d"), F.when(enough & rank.isNotNull(), (rank / count > 1 - TOP).cast("double")).alias(f"fwd_top_{n}d")]
    return out.select("*", *extra)


def top_quantile(value: Column, q: float = TOP) -> Column:
    """1 where the percentile rank (ties averaged) is above 1 - q; no floor on names."""
    rank, n = average_rank(value, ["date"])
    return F.when(rank.isNotNull(), (rank / n > 1 - q).cast("double"))


def information_coefficient(df: DataFrame, score: str, target: str, least: int = 3) -> DataFrame:
    """(date, ic, n): rank correlation per date; missing with fewer than `least` names or a constant side."""
    both = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    a, _ = average_rank(F.col(score), ["date"])
    b, _ = average_rank(F.col(target), ["date"])
    ranked = both.select("date", a.alias("a"), b.alias("b"))
    varied = (F.min("a") < F.max("a")) & (F.min("b") < F.max("b")) & (F.count("*") >= least)
    # not F.corr, which divides before the condition is looked at
    corr = ratio(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return ranked.groupBy("date").agg(F.when(varied, corr).alias("ic"), F.count("*").alias("n"))


def top_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(date, overlap): share of the k best of two score tables that they have in common, ties by ticker."""
    w = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    top = lambda df: df.where("score is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("date", "ticker")
    ta, tb = top(a), top(b)
    sizes = a.where("score is not null").groupBy("date").agg(F.least(F.count("*"), F.lit(k)).alias("k"))
    both = ta.join(tb, ["date", "ticker"]).groupBy("date").agg(F.count("*").alias("both"))
    dates = tb.select("date").distinct()
    return sizes.join(dates, "date").join(both, "date", "left").select("date", (F.coalesce("both", F.lit(0)) / F.col("k")).alias("overlap"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    return scores.where("score is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def thinnest(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n rows with the least value, unknown first."""
    return df.orderBy(F.asc_nulls_first(value), "ticker").limit(n)


def sector_share(df: DataFrame, value: str, sector: str = "sector") -> DataFrame:
    """(date, eta2): share of a date's variance that lies between sectors."""
    x = F.col(value)
    marked = df.where(x.isNotNull() & F.col(sector).isNotNull()).select("date", x.alias("x"), F.avg(x).over(Window.partitionBy("date")).alias("m"), F.avg(x).over(Window.partitionBy("date", sector)).alias("s"))
    between, total = F.sum((F.col("s") - F.col("m")) * (F.col("s") - F.col("m"))), F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))
    return marked.groupBy("date").agg(ratio(between, total).alias("eta2"))


def sector_mean_rank(df: DataFrame, rank: str, sectors: list[str], sector: str = "sector") -> DataFrame:
    return df.groupBy("date").pivot(sector, sectors).agg(F.avg(rank))


# ---- folds ------------------------------------------------------------------------------------


def label_end_dates(axis: DataFrame, sessions: DataFrame, horizon: int) -> DataFrame:
    """axis(date) with label_end: the horizon-th session after it, the latest over the calendars that span the date;
    OPEN_END where one of them does not reach that far."""
    w = Window.partitionBy("venue").orderBy("date")
    ends = sessions.withColumn("label_end", F.lead("date", horizon).over(w)).withColumn("label_end", F.coalesce("label_end", F.lit(OPEN_END)))
    spans = sessions.groupBy("venue").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    asked = spans.join(axis.select("date").distinct(), F.col("date").between(F.col("lo"), F.col("hi"))).select("venue", "date")
    met = asof_backward(asked, ends, ["venue"], ["label_end"])
    return axis.select("date").distinct().join(met.groupBy("date").agg(F.max("label_end").alias("label_end")), "date", "left").withColumn("label_end", F.coalesce("label_end", F.lit(OPEN_END)))


def walk_forward_splits(axis: list[dt.date], ends: dict[dt.date, dt.date], *, min_train: int, test: int, embargo: int, horizon: int, step: int | None = None, rolling: int | None = None) -> list[tuple[int, list[dt.date], list[dt.date]]]:
    """(fold, train dates, test dates): training ends `embargo` dates before the test and holds only dates whose
    label ends before the first test date. A fold with fewer than min_train is skipped without a number."""
    if embargo < horizon:
        raise ValueError(f"embargo {embargo} is shorter than the label's horizon {horizon}")
    out = []
    for start in range(min_train + embargo, len(axis), step or test):
        days = axis[start : start + test]
        window = axis[max(0, start - embargo - rolling) if rolling else 0 : start - embargo]
        train = [d for d in window if ends.get(d, OPEN_END) < days[0]]
        if len(train) >= min_train:
            out.append((len(out), train, days))
    return out


def fold_table(spark: SparkSession, folds: list[tuple[int, list[dt.date], list[dt.date]]]) -> DataFrame:
    """(fold, date, role): as many rows as dates in folds, to join with."""
    rows = [(k, d, role) for k, train, test in folds for role, days in (("train", train), ("test", test)) for d in days]
    return spark.createDataFrame(rows, "fold int, date date, role string")


def select_fold(df: DataFrame, folds: DataFrame, fold: int, role: str) -> DataFrame:
    return df.join(F.broadcast(folds.where((F.col("fold") == fold) & (F.col("role") == role)).select("date")), "date", "left_semi")
