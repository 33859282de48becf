"""All queries over the harness tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.plans import harness as H

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, keys: str = "", values: str = "", digits: int = DIGITS):
    """Register a query: its result has the key columns as they are and the value columns rounded, as has its SQL."""
    ks, vs = keys.split(), values.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*ks, *[F.round(F.col(v).cast("double"), digits).alias(v) for v in vs]) if ks or vs else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql is not None:
            columns = ", ".join([*ks, *[f"round(CAST({v} AS DOUBLE), {digits}) + 0.0 AS {v}" for v in vs]]) or "*"
            body, _, last = sql.rpartition("\nRESULT ")
            _SQL[f.__name__] = f"WITH RECURSIVE {body}, result AS ({last})\nSELECT {columns} FROM result" if body else f"SELECT {columns} FROM ({last})"
        return run

    return add


def with_(*parts: str, result: str) -> str:
    return ",\n".join(p.strip() for p in parts) + "\nRESULT " + result


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars per brand, 12-1 momentum in months, ranks within the month."""
    from tidegrid.operators.frames import w_t, cross_rank, ratio

    monthly = H.bars(spark, sf_dir, monthly=True)
    momentum = ratio(F.lag("close", 1).over(w_t()), F.lag("close", 12).over(w_t())) - 1
    df = monthly.select("ticker", "date", "close", momentum.alias("mom_12_1"))
    return df.withColumn("mom_12_1_rank", cross_rank(F.col("mom_12_1")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from tidegrid.plans import queries_data, queries_features, queries_more, queries_portfolio  # noqa: F401  they register themselves
