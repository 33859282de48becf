"""Point in time: every read names a date, and nothing later comes back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATEST = "latest"


class LookAheadError(ValueError):
    """Something from after the date that a read named."""


def resolve_as_of(as_of: dt.date | dt.datetime | str | None) -> dt.date:
    """The date of an as_of argument: a date, a datetime, ISO text, or LATEST for today. None is refused."""
    if as_of is None:
        raise ValueError("as_of is required; use LATEST for everything there is")
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    if as_of == LATEST:
        return dt.date.today()
    return dt.date.fromisoformat(as_of)


def bound_end(end: dt.date | None, as_of: dt.date, start: dt.date | None = None) -> dt.date:
    """The last date of a window: `end`, or as_of without one. A window that reaches past as_of raises."""
    if start is not None and start > as_of:
        raise LookAheadError(f"start {start} is after as_of {as_of}")
    if end is not None and end > as_of:
        raise LookAheadError(f"end {end} is after as_of {as_of}")
    return end or as_of


def guard(df: DataFrame, as_of: dt.date, column: str = "date") -> DataFrame:
    """df, failing when run if a row is dated after as_of. Lazy: no job of its own."""
    message = F.concat(F.lit(f"row after as_of {as_of}: "), F.col(column).cast("string"))
    return df.where(F.when(F.col(column) > F.lit(as_of), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
