"""Averages that feed on their own last value: one pass over a ticker's rows, all columns in one grouped map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Periods of the smoothed indicators.
EMA_PERIODS, WILDER, MACD = (20, 50, 200), 14, (12, 26, 9)


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Weight 2 / (n + 1), seeded with the mean of the first n values; a gap repeats the level."""
    out = np.full(len(x), np.nan)
    level, total, seen, a = np.nan, 0.0, 0, 2.0 / (n + 1)
    for i, v in enumerate(x):
        if v == v:
            seen += 1
            if seen < n:
                total += v
            elif seen == n:
                level = (total + v) / n
            else:
                level = a * v + (1 - a) * level
        out[i] = level
    return out


def wilder(x: np.ndarray, n: int = WILDER) -> np.ndarray:
    """Weight 1 / n, seeded with the mean of the first n values; a gap has no value and changes nothing."""
    out = np.full(len(x), np.nan)
    level, total, seen = np.nan, 0.0, 0
    for i, v in enumerate(x):
        if v != v:
            continue
        seen += 1
        if seen < n:
            total += v
            continue
        level = (total + v) / n if seen == n else ((n - 1) * level + v) / n
        out[i] = level
    return out


def rsi(p: np.ndarray, n: int = WILDER) -> np.ndarray:
    """100 U / (U + D) of smoothed rises and falls; 50 where nothing moved."""
    change = np.r_[np.nan, np.diff(p)] if len(p) else p
    up, down = wilder(np.where(np.isnan(change), np.nan, np.maximum(change, 0)), n), wilder(np.where(np.isnan(change), np.nan, np.maximum(-change, 0)), n)
    total = up + down
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 50.0, 100 * up / total)


def macd(p: np.ndarray, fast: int = MACD[0], slow: int = MACD[1], signal: int = MACD[2]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(p, fast) - ema(p, slow)
    smooth = ema(line, signal)
    return line, smooth, line - smooth


def drawdown(p: np.ndarray, n: int = 252) -> np.ndarray:
    """Worst fall from the running peak inside each window of n + 1 rows, of which 90 % must have a price."""
    padded = np.r_[np.full(n, np.nan), p]
    out = np.full(len(p), np.nan)
    for at in range(0, len(p), 2000):  # a bounded number of windows at once
        w = np.lib.stride_tricks.sliding_window_view(padded[at : at + 2000 + n], n + 1)[: len(p) - at]
        with np.errstate(invalid="ignore"):
            fall = np.where(np.isnan(w), 0.0, w / np.fmax.accumulate(w, axis=1) - 1).min(axis=1)
        out[at : at + len(w)] = np.where((~np.isnan(w)).sum(axis=1) >= -(-9 * (n + 1) // 10), fall, np.nan)
    return out


NEW = (*(f"ema_{n}" for n in EMA_PERIODS), "atr_14", "rsi_14", "macd", "macd_signal", "macd_hist", "mdd_252d")


def recursive_columns(df: DataFrame, price: str, osc_price: str, true_range: str) -> DataFrame:
    """df with ema_*, atr_14, rsi_14, macd, macd_signal, macd_hist, mdd_252d; one task a ticker, in date order.

    A ticker's rows meet in one task as a window's would, and pass through it with their other columns, so that
    nothing is joined back. Columns of df with these names are replaced.
    """
    kept = [c for c in df.columns if c not in NEW]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in NEW)])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("date")
        p, q, r = (group[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (price, osc_price, true_range))
        out = {f"ema_{n}": ema(p, n) for n in EMA_PERIODS} | {"atr_14": wilder(r), "rsi_14": rsi(q), "mdd_252d": drawdown(p)}
        out |= dict(zip(("macd", "macd_signal", "macd_hist"), macd(q), strict=True))
        for c in NEW:
            group = group.append_column(c, pa.array(out[c], pa.float64(), mask=np.isnan(out[c])))
        return group

    return df.select(*kept).groupBy("ticker").applyInArrow(run, schema)
