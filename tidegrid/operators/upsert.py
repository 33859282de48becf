"""Keyed upserts with change counts, for any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED, UPDATED, UNCHANGED, KEPT = "added", "updated", "unchanged", "kept"


def compare(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key of either side: keys, values (the incoming row's where there is one), `change`.

    added: not stored; updated: some value differs, null equal to null; unchanged; kept: not incoming.
    A full outer join on the key: one shuffle of each side.
    """
    a = stored.select(*keys, F.struct(*values).alias("_old"))
    b = incoming.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, keys, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"_old.{v}").eqNullSafe(F.col(f"_new.{v}")) for v in values], F.lit(True))
    change = F.when(F.col("_old").isNull(), ADDED).when(F.col("_new").isNull(), KEPT).when(same, UNCHANGED).otherwise(UPDATED)
    row = F.coalesce("_new", "_old")
    return both.select(*keys, *[row[v].alias(v) for v in values], *[F.col(f"_old.{v}").alias(f"_old_{v}") for v in values], change.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The table after the upsert, rows the source forgot included."""
    return compare(stored, incoming, keys, values).select(*keys, *values)


def counts(changes: DataFrame, by: list[str]) -> DataFrame:
    """added, updated, unchanged per group of by."""
    return changes.groupBy(*by).agg(*[F.count_if(F.col("change") == c).alias(c) for c in (ADDED, UPDATED, UNCHANGED)])


def merge_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """compare() for bars, carrying derived columns: close_eur stays where the incoming row has none and the
    close is the same; a row that was quarantined stays so."""
    prices = ["open", "high", "low", "close", "volume"]
    values = [*prices, "close_eur", "quarantined"]
    changes = compare(stored, incoming, ["ticker", "date"], values)
    same = reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(f"_old_{v}")) for v in prices])
    carried = F.when(F.col("close_eur").isNull() & F.col("close").eqNullSafe(F.col("_old_close")), F.col("_old_close_eur")).otherwise(F.col("close_eur"))
    flagged = F.coalesce("quarantined", F.lit(False)) | F.coalesce("_old_quarantined", F.lit(False))
    change = F.when(F.col("change").isin(UPDATED, UNCHANGED), F.when(same, UNCHANGED).otherwise(UPDATED)).otherwise(F.col("change"))
    return changes.select("ticker", "date", *prices, carried.alias("close_eur"), flagged.alias("quarantined"), change.alias("change"))


def append_only(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not incoming, then the incoming ones."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)
