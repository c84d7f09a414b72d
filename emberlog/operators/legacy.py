"""Operators of the former dialect, as functions of frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import HIDDEN, Frame, Order, col, from_dataframe
from ..functions.types import kind_of
from ..staging import numbered


def fillnull(frame: Frame, value="0", fields: list[str] | None = None) -> Frame:
    """Nulls replaced by a value, cast to each field's type; what can't be cast stays null."""
    chosen = fields or frame.columns
    fill = lambda c: F.coalesce(col(c), F.lit(value).cast("string").try_cast(frame.kind(c))).alias(c)
    return frame.select(*(fill(c) if c in chosen and kind_of(frame.kind(c)) not in ("array", "object", "unknown") else col(c) for c in frame.columns))


def makemv(frame: Frame, field: str, delimiter: str = ",") -> Frame:
    """Text split into an array."""
    return frame.having(frame.df.withColumn(field, F.split(col(field), "\\Q" + delimiter + "\\E")))


def nomv(frame: Frame, field: str, delimiter: str = "\n") -> Frame:
    """An array joined into text."""
    return frame.having(frame.df.withColumn(field, F.array_join(col(field).cast("array<string>"), delimiter)))


def mvcombine(frame: Frame, field: str) -> Frame:
    """Rows that are equal but for one field, as one row with an array of its values in order."""
    keys = [c for c in frame.columns if c != field]
    rows = F.collect_list(F.struct(frame.rank().alias("r"), col(field).alias("v")))
    df = frame.df.groupBy(*map(col, keys)).agg(F.transform(F.array_sort(rows), lambda x: x["v"]).alias(field))
    return Frame(df).ordered_by([(col(k), False) for k in keys], keep=False, is_sorted=False)


def untable(frame: Frame, x: str, name: str, value: str) -> Frame:
    """A row for each cell of the columns other than x."""
    rest = [c for c in frame.columns if c != x]
    df = frame.df.select(*map(col, (x, *rest)))
    df = df.select(col(x), *(col(c).cast("string").alias(c) for c in rest)).unpivot([x], rest, name, value).where(col(value).isNotNull())
    return Frame(df).ordered_by([(col(x), False), (col(name), False)], keep=False, is_sorted=False)


def pack_json(frame: Frame, fields: list[str] | None = None, into: str = "_raw") -> Frame:
    """Fields as one JSON text."""
    chosen = fields or [c for c in frame.columns if not c.startswith("_")]
    return frame.having(frame.df.withColumn(into, F.to_json(F.struct(*map(col, chosen)))))


def reverse(frame: Frame) -> Frame:
    """The other way round."""
    flipped = tuple(Order(o.name, not o.desc) for o in frame.order)
    return replace(frame, order=flipped, sorted=True)


def offset(frame: Frame, n: int) -> Frame:
    """All but the first n rows of the order."""
    df = frame.df.orderBy(*frame.sort_columns()) if frame.order else frame.df
    return replace(frame, df=df.offset(n), sorted=frame.sorted or bool(frame.order))


def unpack(frame: Frame, form: str, field: str = "_raw", prefix: str = "", options: dict | None = None) -> Frame:
    """The fields of a format in a text field; texts that aren't of the format give nulls."""
    from ..lang.ast import Field, Stage
    from ..plans.build import Builder
    from ..sources.catalog import Catalog
    from .parsing import parse_stage

    stage = Stage("parse", {"format": (form, options or {}), "from": Field(field), "into": [], "prefix": prefix, "on_error": "null"})
    return parse_stage(Builder(Catalog(frame.df.sparkSession)), frame, stage)


def appendcols(left: Frame, right: Frame) -> Frame:
    """Rows of both side by side, by their place; missing partners are null."""
    a, b = (numbered(f.df, f.sort_columns() or [F.lit(0)], "__n") for f in (left, right))
    b = b.select(*(col(c) for c in right.columns if c not in left.columns), "__n")
    df = a.join(b, "__n", "full").drop("__n")
    shown = [c for c in df.columns if not c.startswith(HIDDEN)]
    return left.having(df.select(*map(col, shown), *(col(c) for c in df.columns if c.startswith(HIDDEN))))


def fieldformat(frame: Frame, field: str, fmt: str) -> Frame:
    return frame.having(frame.df.withColumn(field, F.format_string(fmt, col(field))))


def makeresults(spark: SparkSession, n: int = 1) -> Frame:
    return from_dataframe(spark.range(n).select(F.current_timestamp().alias("_time"), F.col("id").alias("n")), ["n"])
