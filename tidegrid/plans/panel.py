"""The feature panel: its column contract, its build as one chain of windows, and its incremental tail."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import features as X
from tidegrid.functions.recursive import recursive_columns
from tidegrid.operators.frames import carry_onto, positive, ratio, sector_demean, session_grid
from tidegrid.pit import guard, resolve_as_of
from tidegrid.sources.store import incremental_panel

#: Names of the panel's columns. Each feature but the log returns also has a rank and a z-score.
META = ["date", "ticker", "sector"]
RETURNS = [f"{p}_{h}d" for p in ("ret", "logret") for h in X.HORIZONS]
FEATURES = [
    *RETURNS, "mom_12_1", "mom_6_1", "rev_5d", "vol_21d", "vol_63d", "vol_252d", "downdev_63d", "atr_14_pct", "mdd_252d",
    *(f"dist_{k}_{n}" for k in ("sma", "ema") for n in X.AVERAGES), *(f"slope_{k}_{n}" for k in ("sma", "ema") for n in X.AVERAGES),
    "rsi_14", "macd_pct", "macd_signal_pct", "macd_hist_pct", "stoch_k", "stoch_d", "bb_pctb", "adv_eur_21", "volume_z_63", "obv_flow_21",
    "beta_252", "idio_vol_252", "mom_resid_12_1", "mom_12_1_sec", "mom_6_1_sec", "mom_resid_12_1_sec", "rev_5d_sec", "vol_63d_sec", "dist_sma_200_sec",
]
FLAGS = ["trend_50_200", "golden_cross", "death_cross", "tradable"]
COMPARABLE = [f for f in FEATURES if not f.startswith("logret_")]
COLUMNS = [*META, *FEATURES, *FLAGS, *(f"{f}{s}" for f in COMPARABLE for s in ("_rank", "_z"))]
SECTOR_LESS = ["mom_12_1", "mom_6_1", "mom_resid_12_1", "rev_5d", "vol_63d", "dist_sma_200"]
#: Features that are compared in logs: their values span orders of magnitude.
LOGGED = {"adv_eur_21"}
TAIL_DAYS, MIN_NAMES, Z_LIMIT = 10, 10, None


#: The sign that a feature's relation to later returns is expected to have, and sessions it looks back.
NEGATIVE = {
    "ret_1d", "ret_5d", "ret_21d", "logret_1d", "logret_5d", "logret_21d", "vol_21d", "vol_63d", "vol_252d", "downdev_63d", "atr_14_pct", "dist_sma_20", "dist_ema_20",
    "death_cross", "rsi_14", "stoch_k", "stoch_d", "bb_pctb", "adv_eur_21", "beta_252", "idio_vol_252", "vol_63d_sec",
}
NEUTRAL = {*META, "tradable"}
WINDOWS = {"mom_12_1": 252, "mom_6_1": 126, "rev_5d": 5, "atr_14_pct": 14, "rsi_14": 14, "macd_pct": 26, "macd_signal_pct": 34, "macd_hist_pct": 34, "stoch_k": 14, "stoch_d": 16, "bb_pctb": 20, "volume_z_63": 64, "trend_50_200": 200, "golden_cross": 200, "death_cross": 200, "tradable": 21, "mom_resid_12_1": 252}


def window_of(name: str) -> int | None:
    """Sessions that a column looks back, from its name where that tells."""
    base = name.removesuffix("_rank").removesuffix("_z").removesuffix("_sec")
    if base in META or base in WINDOWS:
        return WINDOWS.get(base)
    n = int(re.search(r"(\d+)d?$", base)[1])
    return n + X.SLOPE if base.startswith("slope_") else n


def registry() -> list[dict]:
    """The contract: name, kind, window and direction of every column, in order."""
    out = []
    for c in COLUMNS:
        base = c.removesuffix("_rank").removesuffix("_z") if c not in FEATURES else c
        kind = "meta" if c in META else "flag" if c in FLAGS else "feature" if c in FEATURES else c.rpartition("_")[2]
        direction = "neutral" if base in NEUTRAL else "negative" if base in NEGATIVE else "positive"
        out.append({"name": c, "kind": kind, "window": window_of(c), "direction": direction})
    return out


def registry_digest() -> str:
    """16 hex digits that change with the contract."""
    return hashlib.sha256(json.dumps(registry(), sort_keys=True).encode()).hexdigest()[:16]


def check_registry(df: DataFrame) -> DataFrame:
    """df, or an error if its columns are not the contract's, in order."""
    if df.columns != COLUMNS:
        missing, extra = [c for c in COLUMNS if c not in df.columns], [c for c in df.columns if c not in COLUMNS]
        raise ValueError(f"not the panel's columns: missing {missing}, unexpected {extra}")
    return df


def features(prices: DataFrame, sessions: DataFrame, listings: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Features and flags on bar dates.

    prices(ticker, date, open, high, low, close, volume, adj_close, close_eur, adj_close_eur), listings(ticker,
    venue, sector), benchmark(date, bench). All windows and the recursive averages share one layout by ticker, in
    date order.
    """
    g = session_grid(prices, sessions, listings.select("ticker", "venue"))
    days = g.select("date").distinct()
    bench = carry_onto(benchmark.select("date", "bench"), days, "bench", 5)
    g = g.join(F.broadcast(bench), "date", "left")  # a row for each date of a calendar
    g = g.select(
        "ticker", "date", "stored", "volume", "close_eur", positive(F.col("adj_close_eur")).alias("p"), positive(F.col("adj_close")).alias("q"), positive(F.col("bench")).alias("m"),
        X.adjusted("high").alias("ah"), X.adjusted("low").alias("al"),
    )
    g = X.with_columns(g, {"ev": X.eur_volume(), "tr": X.true_range("ah", "al", "q"), **{f"sma_{n}": X.sma("p", n) for n in X.AVERAGES}})
    g = recursive_columns(g, "p", "q", "tr")
    g = X.with_columns(g, X.returns("p") | X.momentum("p") | {"rm": X.log_return("m", 1), "sg": X.signed_value("q", "ev"), "stoch_k": X.stoch_k("ah", "al", "q"), "bb_pctb": X.percent_b("q")})
    wide = {f"vol_{n}d": X.realized_vol("logret_1d", n) for n in X.VOLATILITY} | {"downdev_63d": X.downside_deviation("logret_1d"), "atr_14_pct": ratio(F.col("atr_14"), F.col("q")), "stoch_d": X.stoch_d("stoch_k")}
    wide |= {f"dist_{k}_{n}": X.distance("p", f"{k}_{n}") for k in ("sma", "ema") for n in X.AVERAGES} | {f"slope_{k}_{n}": X.slope(f"{k}_{n}") for k in ("sma", "ema") for n in X.AVERAGES}
    wide |= {f"{c}_pct": ratio(F.col(c), F.col("q")) for c in ("macd", "macd_signal", "macd_hist")}
    wide |= {"adv_eur_21": X.average_daily_value("ev"), "volume_z_63": X.volume_zscore("ev"), "obv_flow_21": X.obv_flow("sg", "ev"), "trend_50_200": X.trend_state()}
    g = X.with_rolling_beta(X.with_columns(g, wide), "logret_1d", "rm")
    g = g.withColumn("mom_resid_12_1", X.residual_momentum("p", "m", "beta_252")).withColumn("tradable", X.tradable("adv_eur_21"))
    own = X.with_columns(g.where("stored"), X.crosses("trend_50_200"))
    return own.join(F.broadcast(listings.select("ticker", "sector")), "ticker", "left")


def ranks_and_scores(x: np.ndarray, z: np.ndarray, starts: np.ndarray, min_names: int) -> tuple[np.ndarray, np.ndarray]:
    """Of names x columns, dates one after another from `starts` on: ranks of x within the date scaled to 0..1, ties
    averaged, a lone name 0.5, and population z-scores of z, 0 where all are equal. NaN is missing, and so is a
    column that fewer than min_names of a date have."""
    rows = len(x)
    size = np.diff(np.r_[starts, rows])
    date, at = np.repeat(np.arange(len(starts)), size), np.arange(rows)
    known, place = ~np.isnan(x), np.empty(x.shape)
    for c in range(x.shape[1]):
        values = np.where(known[:, c], x[:, c], np.inf)
        order = np.lexsort((values, date))
        new = np.ones(rows + 1, bool)
        new[1:rows] = (values[order[1:]] != values[order[:-1]]) | (date[order[1:]] != date[order[:-1]])
        first = np.flatnonzero(new[:rows])
        n = np.diff(np.r_[first, rows])
        place[order, c] = np.repeat(first + (n - 1) / 2, n) - starts[date[order]]
    per_date = lambda f, values: f.reduceat(values, starts, axis=0)[date]
    n, nz, there = per_date(np.add, known.astype(float)), per_date(np.add, (~np.isnan(z)).astype(float)), ~np.isnan(z)
    with np.errstate(divide="ignore", invalid="ignore"):
        rank = np.where(known & (n >= min_names), np.where(n > 1, place / (n - 1), 0.5), np.nan)
        off = z - per_date(np.add, np.where(there, z, 0.0)) / nz
        spread = np.sqrt(per_date(np.add, np.where(there, off, 0.0) ** 2) / nz)
        flat = per_date(np.maximum, np.where(there, z, -np.inf)) == per_date(np.minimum, np.where(there, z, np.inf))
        score = np.where(flat, 0.0, np.where(spread > 0, off / spread, np.nan))
    return rank, np.where(there & (nz >= min_names), score, np.nan)


def normalise(df: DataFrame, columns: list[str] = COMPARABLE, min_names: int = MIN_NAMES, mask: Column | None = None) -> DataFrame:
    """df(date, ticker, ...) with a rank and a z-score within the date for each column.

    One window for each column would sort a date's rows as often as there are columns, and a row for each value
    would make that many rows of one. So rows are dealt by date, sorted, and ranked in Arrow batches of whole
    dates; a batch's last date waits for the next batch.
    """
    made = [f"{c}_{k}" for c in columns for k in ("rank", "z")]
    kept = [c for c in df.columns if c not in made]
    logged, k = [c in LOGGED for c in columns], len(columns)

    def done(table: pa.Table, days: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        x = np.where(np.isfinite(x), x, np.nan)
        z = x.copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            z[:, logged] = np.where(x[:, logged] > 0, np.log(x[:, logged]), np.nan)
        rank, score = ranks_and_scores(x, z, np.flatnonzero(np.r_[True, days[1:] != days[:-1]]), min_names)
        if Z_LIMIT:
            score = np.clip(score, -Z_LIMIT, Z_LIMIT)
        both = np.stack([rank, score], axis=2).ravel()
        lists = pa.ListArray.from_arrays(np.arange(0, len(both) + 1, 2 * k, dtype=np.int32), pa.array(both))
        yield from table.drop_columns(["_x"]).append_column("_y", lists).combine_chunks().to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            days = table["date"].cast(pa.int32()).fill_null(-(2**31)).to_numpy()
            last = int(np.flatnonzero(np.r_[True, days[1:] != days[:-1]])[-1])
            if last:
                yield from done(table.slice(0, last), days[:last])
            held = table.slice(last)
        if held is not None:
            yield from done(held, np.zeros(held.num_rows))

    value = lambda c: F.coalesce((F.col(c) if mask is None else F.when(mask, F.col(c))).cast("double"), F.lit(float("nan")))
    rows = df.select(*kept, F.array(*[value(c) for c in columns]).alias("_x"))
    rows = rows.repartition("date").sortWithinPartitions("date")
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("_y", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).select(*kept, *[F.nanvl(F.get("_y", F.lit(i)), F.lit(None).cast("double")).alias(c) for i, c in enumerate(made)])


def build(prices: DataFrame, sessions: DataFrame, listings: DataFrame, benchmark: DataFrame, *, as_of) -> DataFrame:
    """The panel up to as_of, under its contract."""
    until = resolve_as_of(as_of)
    known = lambda df: df.where(F.col("date") <= F.lit(until))
    df = features(known(prices), known(sessions), listings, known(benchmark))
    df = X.with_columns(df, {f"{c}_sec": sector_demean(F.col(c)) for c in SECTOR_LESS})
    return guard(check_registry(normalise(df).select(*COLUMNS)), until)


def update(existing: DataFrame, digest: str, prices: DataFrame, sessions: DataFrame, listings: DataFrame, benchmark: DataFrame, *, as_of) -> DataFrame:
    """The stored panel with its last TAIL_DAYS days made anew, so that late bars count. Another contract's panel or
    one that reaches past as_of is refused."""
    until = resolve_as_of(as_of)
    if digest != registry_digest():
        raise ValueError(f"the stored panel has contract {digest}, not {registry_digest()}")
    last = existing.agg(F.max("date")).first()[0]
    if last is not None and last > until:
        raise ValueError(f"the stored panel reaches {last}, after as_of {until}")
    fresh = build(prices, sessions, listings, benchmark, as_of=until)
    since = last - dt.timedelta(days=TAIL_DAYS) if last else dt.date.min
    return incremental_panel(existing, fresh, F.lit(since))


def write(df: DataFrame, path: str, as_of) -> None:
    """The panel, and a sidecar with its contract: footers take no keys of ours."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    meta = {"registry": registry_digest(), "as_of": str(resolve_as_of(as_of)), "columns": len(COLUMNS)}
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def read(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("date", "ticker", *[c for c in columns if c not in ("date", "ticker")]) if columns else df


def metadata(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.meta").first().value)
