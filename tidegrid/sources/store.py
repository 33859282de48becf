"""Stored tables: Hive-partitioned Parquet scans and sinks, CSV dimensions, source adapters, ledgers."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid import schema as S
from tidegrid.operators.upsert import ADDED, KEPT, UNCHANGED, UPDATED, append_only, compare, merge_bars
from tidegrid.pit import bound_end, guard, resolve_as_of

REFETCH_DAYS = 5


class Store:
    """A root folder with a table for each dataset; bars and actions are partitioned by ticker."""

    PARTITION = {"bars": "ticker", "actions": "ticker", "fx": "pair", "rates": "series", "quarantine": "ticker"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path)

    def scan(self, name: str) -> DataFrame:
        """The whole table under its declared schema; columns that old files lack are null."""
        schema, _ = S.KEYS[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema])).parquet(self.path(name))
        return df.withColumn("quarantined", F.coalesce("quarantined", F.lit(False))) if name == "bars" else df

    def has_column(self, name: str, column: str) -> bool:
        return self.exists(name) and column in self.spark.read.option("mergeSchema", True).parquet(self.path(name)).columns

    def write(self, name: str, df: DataFrame, check: bool = True) -> None:
        """Replace the partitions that df has, and no others, when the job commits."""
        schema, keys = S.KEYS[name]
        out = S.conform(df, schema, keys, check)
        part = self.PARTITION.get(name)
        writer = out.repartition(part).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd")
        if part:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(part)
        writer.parquet(self.path(name))

    def upsert(self, name: str, incoming: DataFrame) -> DataFrame:
        """Merge rows on the table's key and return added, updated, unchanged per partition value. Only the
        partitions that the rows name are scanned; those without a change are not written. The merged rows are
        stored aside first, as they derive from the table, under a path of this call's own."""
        schema, keys = S.KEYS[name]
        part = self.PARTITION[name]
        rows = S.conform(incoming, schema, keys)
        values = [c for c in schema.names if c not in keys]
        named = [r[0] for r in rows.select(part).distinct().collect()]  # a value for each partition delivered
        held = self.scan(name).where(F.col(part).isin(named))
        changes = merge_bars(held, rows) if name == "bars" else compare(held, rows, keys, values)
        staged = f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"
        changes.select(*keys, *values, "change").write.parquet(staged)
        done = self.spark.read.parquet(staged)
        dirty = done.where(F.col("change").isin(ADDED, UPDATED)).select(part).distinct()
        if not dirty.isEmpty():
            self.write(name, done.join(dirty, part, "left_semi").drop("change"), check=False)
        return done.where(F.col("change") != KEPT).groupBy(part).agg(*[F.count_if(F.col("change") == c).alias(c) for c in (ADDED, UPDATED, UNCHANGED)])

    # ---- reads that name a date ----

    def read_bars(self, tickers: list[str] | None = None, *, as_of, start: dt.date | None = None, end: dt.date | None = None, include_quarantined: bool = False) -> DataFrame:
        return read_bars(self.scan("bars"), tickers, as_of=as_of, start=start, end=end, include_quarantined=include_quarantined)

    def read(self, name: str, keys: list[str] | None = None, *, as_of, start: dt.date | None = None, end: dt.date | None = None, kind: str | None = None) -> DataFrame:
        """actions, fx or rates between dates, for some keys and one kind of action."""
        until = resolve_as_of(as_of)
        df = self.scan(name).where(F.col("date") <= F.lit(bound_end(end, until, start)))
        df = df.where(F.col("date") >= F.lit(start)) if start else df
        df = df.where(F.col(self.PARTITION[name]).isin(keys)) if keys is not None else df
        return guard(df.where(F.col("action") == kind) if kind else df, until)

    def read_quarantine(self, tickers: list[str] | None = None, *, as_of, include_released: bool = False) -> DataFrame:
        until = resolve_as_of(as_of)
        df = self.scan("quarantine").where(F.col("date") <= F.lit(until))
        df = df.where(F.col("ticker").isin(tickers)) if tickers is not None else df
        return df if include_released else df.where("released_at is null")


def read_bars(bars: DataFrame, tickers: list[str] | None = None, *, as_of, start: dt.date | None = None, end: dt.date | None = None, include_quarantined: bool = False) -> DataFrame:
    """Bars up to as_of; ticker prunes partitions, the dates reach the scan as pushed filters."""
    until = resolve_as_of(as_of)
    last = bound_end(end, until, start)
    df = bars.where(F.col("date") <= F.lit(last))
    df = df.where(F.col("date") >= F.lit(start)) if start else df
    df = df.where(F.col("ticker").isin(tickers)) if tickers is not None else df
    return df if include_quarantined or "quarantined" not in df.columns else df.where(~F.coalesce("quarantined", F.lit(False)))


def max_stored_dates(bars: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    df = bars.where(F.col("ticker").isin(tickers)) if tickers is not None else bars
    return df.groupBy("ticker").agg(F.max("date").alias("last_date"))


def max_stored_date(bars: DataFrame, ticker: str) -> dt.date | None:
    row = bars.where(F.col("ticker") == ticker).agg(F.max("date")).first()
    return row[0]


def coverage(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """First and last date and number of bars for each ticker asked for, in that order, 0 for absent ones."""
    spark = bars.sparkSession
    asked = spark.createDataFrame(list(enumerate(tickers)), "position int, ticker string")
    have = bars.where(F.col("ticker").isin(tickers)).groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))
    return asked.join(have, "ticker", "left").select("position", "ticker", "first_date", "last_date", F.coalesce("n", F.lit(0)).alias("bars")).orderBy("position")


def stored_tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()


def incremental_start(requested: Column, stored_last: Column, refetch_days: int = REFETCH_DAYS) -> Column:
    """Where a fetch begins: the requested date, or the stored end less some days to pick up late changes."""
    return F.greatest(requested, F.date_sub(stored_last, refetch_days))


def last_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The latest row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# ---- adapters ---------------------------------------------------------------------------------


def to_bars(ticker: str, response: DataFrame, sequence: str = "seq") -> DataFrame:
    """A provider's daily table as bars: lower-case names, of several rows for a session the last one."""
    names = {c: c.lower().replace(" ", "_") for c in response.columns}
    df = response.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    df = last_rows(df, ["date"], [F.col(sequence).desc()])
    return df.select(F.lit(ticker).alias("ticker"), F.to_date("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def to_actions(ticker: str | Column, response: DataFrame) -> DataFrame:
    """A provider's dividend and split columns as rows; zero cells are no event. `ticker` is a name, or a column of
    a response for several."""
    names = {c: c.lower().replace(" ", "_") for c in response.columns}
    df = response.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    own = F.lit(ticker) if isinstance(ticker, str) else ticker
    wide = df.select(own.alias("ticker"), F.to_date("date").alias("date"), F.col("dividends").cast("double").alias("dividend"), F.col("stock_splits").cast("double").alias("split"))
    long = wide.unpivot(["ticker", "date"], ["dividend", "split"], "action", "value")
    return long.where("value is not null and value <> 0").select("ticker", "date", "action", "value")


def rate_series(spark: SparkSession, series: str, lines: Iterable[str]) -> DataFrame:
    """A two-column CSV (date, rate) as rates; cells that do not parse are dropped."""
    df = spark.read.schema("date string, rate string").option("header", True).csv(spark.sparkContext.parallelize(list(lines), 1))
    return df.select(F.lit(series).alias("series"), F.expr("try_cast(date as date)").alias("date"), F.expr("try_cast(rate as double)").alias("rate")).where("date is not null and rate is not null")


def read_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV dimension under a declared header; another header raises. Lines that begin with # are comments."""
    head = next(x for x in spark.read.text(path).toLocalIterator() if x.value.strip() and not x.value.startswith("#")).value
    if [c.strip() for c in head.split(",")] != schema.names:
        raise S.SchemaError(f"header {head!r}, not {','.join(schema.names)!r}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("comment", "#").csv(path)


# ---- ingest and ledgers -----------------------------------------------------------------------


class Refused(Exception):
    """A provider's answer that no further attempt changes."""


def attempt(call: Callable[[], DataFrame], attempts: int = 3, wait: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame | None, int, Exception | None]:
    """(result, attempts made, last error): a call is tried again after waits that grow by `factor`, at once given
    up when Refused."""
    for n in range(1, attempts + 1):
        try:
            return call(), n, None
        except Refused as e:
            return None, n, e
        except Exception as e:  # whatever a provider's client raises
            if n == attempts:
                return None, n, e
            sleep(wait * factor ** (n - 1))
    raise ValueError("attempts must be 1 or more")


def ingest(
    store: Store, fetch: Callable[[str, dt.date, dt.date], DataFrame], tickers: list[str], requested: dt.date, *, as_of, run_id: str,
    attempts: int = 3, wait: float = 1.0, give_up_after: int = 10, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Fetch and merge each ticker; a row of the manifest for each, failures included, and nothing raised.

    Each fetch is tried up to `attempts` times with growing waits. After give_up_after failures in a row the
    provider counts as gone: the tickers that are left are `skipped`. The loop is over fetches, which are requests
    to a provider; all stored ends come from one aggregation, and a merge scans its own ticker's partition.
    """
    failures = 0
    until = resolve_as_of(as_of)
    ends = {r.ticker: r.last_date for r in max_stored_dates(store.scan("bars"), tickers).collect()}  # one row for each ticker asked for
    out = []
    for ticker in tickers:
        began = dt.datetime.now()
        last = ends.get(ticker)
        start = max(requested, last - dt.timedelta(days=REFETCH_DAYS)) if last else requested
        row = dict.fromkeys(S.MANIFEST.names) | {"run_id": run_id, "ticker": ticker, "started_at": began, "as_of": until, "requested_start": requested, "start": start, "end": until, "refetch_days": REFETCH_DAYS, "attempts": 1}
        if failures >= give_up_after:
            out.append(row | {"status": "skipped", "attempts": 0, "error": f"{failures} failures in a row before", "finished_at": began, "seconds": 0.0})
            continue
        rows, row["attempts"], error = attempt(lambda t=ticker, s=start: fetch(t, s, until), attempts, wait, sleep=sleep)
        try:
            if error is not None:
                raise error
            counted = store.upsert("bars", rows).first()
            row |= {"status": "ok", "rows_added": counted.added, "rows_updated": counted.updated, "rows_unchanged": counted.unchanged} if counted else {"status": "empty"}
            failures = 0
        except Exception as e:  # a provider's failure is a status, not the end of the run
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
            failures += 1
        now = dt.datetime.now()
        out.append(row | {"finished_at": now, "seconds": (now - began).total_seconds()})
    return store.spark.createDataFrame([tuple(r[c] for c in S.MANIFEST.names) for r in out], S.MANIFEST)


def append_run(manifest: DataFrame, run: DataFrame) -> DataFrame:
    """The manifest with a run; rows that the same run id wrote before are replaced."""
    return append_only(manifest, run, ["run_id"])


def last_run(manifest: DataFrame) -> DataFrame:
    """The rows of the run that started last."""
    last = manifest.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return manifest.join(F.broadcast(last), "run_id", "left_semi")


def trial_id(family: Column, params: Column) -> Column:
    """12 hex digits of the SHA-1 of a family and its canonical parameters."""
    return F.substring(F.sha1(F.concat_ws("\n", family, params)), 1, 12)


def record_trials(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """ledger(id, family, params, first_logged, last_logged, runs, sharpe) with new(family, params, logged, sharpe):
    known variants count one run more for each, with the latest result; others are added."""
    rows = new.withColumn("id", trial_id(F.col("family"), F.col("params"))).select(
        "id", "family", "params", F.col("logged").alias("first_logged"), F.col("logged").alias("last_logged"), F.lit(1).cast("long").alias("runs"), "sharpe"
    )
    both = ledger.select(rows.columns).unionByName(rows)
    return both.groupBy("id", "family", "params").agg(
        F.min("first_logged").alias("first_logged"), F.max("last_logged").alias("last_logged"), F.sum("runs").alias("runs"), F.max_by("sharpe", F.struct("last_logged", "sharpe")).alias("sharpe")
    )


def count_variants(ledger: DataFrame, family: str | None = None) -> int:
    df = ledger.where(F.col("family") == family) if family else ledger
    return df.select(F.count_distinct("id")).first()[0]


def incremental_panel(existing: DataFrame, fresh: DataFrame, since: Column) -> DataFrame:
    """The stored panel with the dates from `since` on replaced whole."""
    return existing.where(F.col("date") < since).unionByName(fresh.where(F.col("date") >= since))
