"""Named sources: frames, Parquet tables, files and views, found by name or glob."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..frame import Frame, from_dataframe
from ..functions.scalar import glob_regex
from ..lang.ast import Source
from ..lang.errors import QueryError, did_you_mean


#: Schemas by path, with the path's time and length when they were read; a changed path is read anew.
_schemas: dict[str, tuple[tuple, StructType]] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose footers are looked at once, as finding a schema takes a job of its own."""
    stamp = None
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        stamp = status.getModificationTime(), status.getLen()
    except Py4JJavaError:  # globs, and stores that can't tell
        pass
    if not stamp or not stamp[0]:
        return spark.read.parquet(path)
    known = _schemas.get(path)
    if known and known[0] == stamp:
        return spark.read.schema(known[1]).parquet(path)
    df = spark.read.parquet(path)
    _schemas[path] = stamp, df.schema
    return df


class Catalog:
    """Sources by name; what a name stands for is read when a query uses it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.makers = spark, {}

    def add(self, name: str, source: DataFrame | Callable[[], DataFrame], order: list[str] | None = None, time: str | None = None, raw: str | None = None) -> Catalog:
        """order: columns whose values tell rows apart and give the arrival order; time, raw: the columns that `_time`
        and `_raw` stand for."""

        def make() -> Frame:
            df = source() if callable(source) else source
            if raw and raw != "_raw" and "_raw" not in df.columns:
                df = df.withColumn("_raw", df[raw])
            return from_dataframe(df, order, time)

        self.makers[name] = make
        return self

    def add_parquet(self, name: str, path: str, **options) -> Catalog:
        return self.add(name, lambda: read_parquet(self.spark, path), **options)

    def names(self) -> list[str]:
        return sorted(self.makers)

    def match(self, sources: list[Source]) -> list[str]:
        """Names that the sources take, in order, without those excluded."""
        out: list[str] = []
        for s in sources:
            if s.cte:
                out.append("$" + s.name)
                continue
            pattern = re.compile(glob_regex(s.name, crosses=True))
            hit = [n for n in self.names() if pattern.match(n)]
            if s.exclude:
                out = [n for n in out if n not in hit]
            elif not hit and not re.search(r"[*?\[{]", s.name):
                raise QueryError("S010", f"unknown source `{s.name}`", 0, "", did_you_mean(s.name, self.names()))
            else:
                out += [n for n in hit if n not in out]
        return out

    def frame(self, name: str) -> Frame:
        return self.makers[name]()
