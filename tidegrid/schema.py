"""Declared table schemas and the checks that frames must pass before they are stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A frame that does not have the declared columns, types or keys."""


_TYPES = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """A schema from `name type [not null], ...`, made without a session."""
    fields = [x.split() for x in text.split(",")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) == 2) for f in fields])


BARS = _struct("ticker string not null, date date not null, open double, high double, low double, close double, volume double, close_eur double, quarantined boolean")
ACTIONS = _struct("ticker string not null, date date not null, action string not null, value double not null")
FX = _struct("pair string not null, date date not null, rate double")
RATES = _struct("series string not null, date date not null, rate double")
QUARANTINE = _struct(
    "ticker string not null, date date not null, check string not null, open double, high double, low double, close double, volume double, "
    "severity string not null, detail string not null, reason string not null, quarantined_at timestamp not null, released_at timestamp"
)
MANIFEST = _struct(
    "run_id string not null, ticker string not null, started_at timestamp, finished_at timestamp, as_of date, requested_start date, start date, end date, "
    "status string, attempts int, rows_fetched long, rows_added long, rows_updated long, rows_unchanged long, first_date date, last_date date, "
    "stored_rows long, seconds double, error string, source string, refetch_days int, version string"
)
UNIVERSE = _struct("ticker string, name string, exchange string, currency string, sector string, country string")
TRIAGE = _struct("check string, scope string, start date, end date, verdict string, reason string")

KEYS = {
    "bars": (BARS, ["ticker", "date"]),
    "actions": (ACTIONS, ["ticker", "date", "action"]),
    "fx": (FX, ["pair", "date"]),
    "rates": (RATES, ["series", "date"]),
    "quarantine": (QUARANTINE, ["ticker", "date", "check", "quarantined_at"]),
    "manifest": (MANIFEST, ["run_id", "ticker"]),
}
#: Columns that an old or incoming frame may lack, and what they then hold.
DERIVED = {"close_eur": None, "quarantined": False}


def conform(df: DataFrame, schema: T.StructType, keys: list[str], check: bool = True) -> DataFrame:
    """df with exactly the columns of schema, in order and type; NaN becomes null.

    Missing or unexpected columns raise at once. With check, one aggregation refuses null or blank keys and
    repeated ones before anything is stored; timestamps where dates are declared are refused, as a zone
    would decide which day they are.
    """
    have, want = set(df.columns), set(schema.names)
    missing = [c for c in schema.names if c not in have and c not in DERIVED]
    if missing or have - want:
        raise SchemaError(f"missing {missing}, unexpected {sorted(have - want)}")
    types = dict(df.dtypes)
    for f in schema:
        if isinstance(f.dataType, T.DateType) and types.get(f.name, "date").startswith("timestamp"):
            raise SchemaError(f"{f.name} is a timestamp, not a date")
    columns = []
    for f in schema:
        c = F.col(f.name) if f.name in have else F.lit(DERIVED[f.name])
        if isinstance(f.dataType, T.DoubleType):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        if f.name == "quarantined":
            c = F.coalesce(c.cast("boolean"), F.lit(False))
        if f.name in keys and isinstance(f.dataType, T.StringType):
            c = F.trim(c)
        columns.append(c.cast(f.dataType).alias(f.name))
    out = df.select(*columns)
    if check:
        check_keys(out, keys)
    return out


def check_keys(df: DataFrame, keys: list[str]) -> None:
    """Raise SchemaError on null, blank or repeated keys; names at most five."""
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys])
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where(blank | (F.col("n") > 1)).limit(5).collect()
    if bad:
        raise SchemaError(f"null, blank or repeated keys: {[tuple(r) for r in bad]}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every double NaN as null, once, at the scan."""
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
