"""Window helpers that the features share: covered rolling aggregates, as-of joins, grids, ranks, islands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERAGE = 0.9


def w_t():
    """Rows of a ticker in date order. Made on use: a window needs a session, a module must not."""
    return Window.partitionBy("ticker").orderBy("date")


def rows(n: int, window=None, end: int = 0):
    """The n rows that end `end` rows after the current one (negative: before)."""
    return (window or w_t()).rowsBetween(end - n + 1, end)


def need(n: int) -> int:
    return math.ceil(COVERAGE * n)


def rolled(agg: Column, value: Column, n: int, warm: int | None = None, window=None, least: int | None = None, end: int = 0) -> Column:
    """agg over n rows where at least 90 % of them hold a value, and not before `warm` rows lie behind."""
    frame = rows(n, window, end)
    ok = F.count(value).over(frame) >= (need(n) if least is None else least)
    if warm:
        ok = ok & (F.row_number().over(window or w_t()) > warm)
    return F.when(ok, agg.over(frame))


def positive(price: Column) -> Column:
    return F.when((price > 0) & ~F.isnan(price), price)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.try_divide(a, b)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


# ---- as-of ------------------------------------------------------------------------------------


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], values: list[str], tolerance_days: int | None = None, on: str = "date", strict: bool = False, not_after_last: bool = False) -> DataFrame:
    """left with the latest row of right at or before (strict: before) its date: values, and `matched_on`.

    Both sides are tagged into one stream per key and the latest right row carried forward: one shuffle and
    one sort on (by, on), no pair of rows is ever compared. A match older than the tolerance is no match; with
    not_after_last, neither is one for a date after the key's last right row. Rows of left keep their number.
    """
    keys = [*by, on]
    carried = F.struct(F.col(on).alias("matched_on"), *values)
    a = left.select(*keys, F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_hit"))
    b = right.where(F.col(on).isNotNull()).select(*keys, F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), carried.alias("_hit"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_hit", ignorenulls=True).over(w))
    if not_after_last:
        both = both.withColumn("_end", F.max(F.col("_hit.matched_on")).over(Window.partitionBy(*by)))
    ok = F.lit(True)
    if tolerance_days is not None:
        ok = F.datediff(on, F.col("_last.matched_on")) <= tolerance_days
    if not_after_last:
        ok = ok & (F.col(on) <= F.col("_end"))
    out = both.where(F.col("_row").isNotNull())
    return out.select("_row.*", *[F.when(ok, F.col(f"_last.{v}")).alias(v) for v in [*values, "matched_on"]])


def carry_onto(series: DataFrame, grid: DataFrame, value: str, limit: int = 5, by: list[str] | None = None) -> DataFrame:
    """grid(by..., date) with `value` carried over at most `limit` rows of the union of both calendars."""
    by = by or []
    # a series of its own calendar has no key to deal by; it is as long as its calendar
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("date").rowsBetween(-limit, 0)
    have = series.select(*by, "date", F.col(value).alias("_v"))
    union = grid.select(*by, "date").distinct().withColumn("_g", F.lit(True)).join(have, [*by, "date"], "full_outer")
    return union.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_g").select(*by, "date", value)


# ---- grids ------------------------------------------------------------------------------------


def session_grid(bars: DataFrame, sessions: DataFrame, venues: DataFrame) -> DataFrame:
    """bars on every session of the ticker's venue between its first and last bar, and on its own dates.

    bars(ticker, date, ...), sessions(venue, date), venues(ticker, venue). `stored` tells a bar from a gap,
    whose other columns are null. A ticker without venue keeps its own rows.
    """
    spans = bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).join(F.broadcast(venues), "ticker")
    days = spans.join(sessions, "venue").where(F.col("date").between(F.col("lo"), F.col("hi"))).select("ticker", "date")
    grid = days.unionByName(bars.select("ticker", "date")).distinct()
    return grid.join(bars.withColumn("stored", F.lit(True)), ["ticker", "date"], "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


# ---- per-date ---------------------------------------------------------------------------------


def average_rank(value: Column, by: list[str], mask: Column | None = None) -> tuple[Column, Column]:
    """(rank from 1 with ties averaged, number of valued rows) of value within by; null where value is."""
    x = finite(value) if mask is None else F.when(mask, finite(value))
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    peers = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(w) + (peers - 1) / F.lit(2.0)), F.count(x).over(Window.partitionBy(*by))


def cross_rank(value: Column, min_names: int = 10, by: list[str] | None = None, mask: Column | None = None) -> Column:
    """Rank within the date scaled to 0..1, ties averaged, a lone name 0.5; missing below min_names."""
    rank, n = average_rank(value, by or ["date"], mask)
    return F.when(n >= min_names, F.when(rank.isNotNull(), F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.5)))


def cross_zscore(value: Column, min_names: int = 10, limit: float | None = None, by: list[str] | None = None, mask: Column | None = None) -> Column:
    """Population z-score within the date; 0 where all are equal; optionally clipped."""
    x = finite(value) if mask is None else F.when(mask, finite(value))
    w = Window.partitionBy(*(by or ["date"]))
    spread = F.stddev_pop(x).over(w)
    # all equal by their bounds: a computed spread of equal values need not be 0
    z = F.when(F.max(x).over(w) == F.min(x).over(w), F.when(x.isNotNull(), 0.0)).otherwise(ratio(x - F.avg(x).over(w), spread))
    z = clip(z, -limit, limit) if limit else z
    return F.when(F.count(x).over(w) >= min_names, z)


def sector_demean(value: Column, sector: str = "sector", least: int = 3) -> Column:
    """value less the mean of its date and sector; missing where fewer than `least` names have one."""
    w = Window.partitionBy("date", sector)
    x = finite(value)
    return F.when(F.col(sector).isNotNull() & (F.count(x).over(w) >= least), x - F.avg(x).over(w))


# ---- gaps and islands -------------------------------------------------------------------------


def island_ids(starts: Column, window=None) -> Column:
    """A number that grows by one at each row where `starts` holds."""
    return F.sum(F.when(starts, 1).otherwise(0)).over((window or w_t()).rowsBetween(Window.unboundedPreceding, 0))
