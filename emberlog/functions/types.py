"""The language's types over Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(t, T.DayTimeIntervalType):
        return "duration"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.MapType, T.StructType)):
        return "object"
    return "unknown"


NUMERIC = {"int", "float"}


def duration(us: float) -> Column:
    """An interval of so many microseconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(round(us) / 1_000_000).cast("decimal(18,6)"))


def seconds(interval: Column) -> Column:
    """An interval in seconds, as a double."""
    return interval.cast("interval second").cast("decimal(20,6)").cast("double")


def micros(interval: Column) -> Column:
    return (interval.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def of_micros(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def bin_time(ts: Column, us: float) -> Column:
    """The start of the epoch-aligned bucket of `us` microseconds."""
    span = max(1, round(us))
    at = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at, F.lit(span)))
