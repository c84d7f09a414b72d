"""Questions about a source: its fields, their values, histograms, samples, and a window against the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import col
from ..functions.types import bin_time


def histogram(df: DataFrame, span_us: float, time: str = "_time", by: str | None = None) -> DataFrame:
    """bucket, [by] and count."""
    keys = [bin_time(col(time), span_us).alias("bucket"), *([col(by)] if by else [])]
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def field_values(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """value, count and percent of a field's values, most frequent first: all of them, or the `limit` first."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    made = counts.crossJoin(F.broadcast(total)).select("value", "count", F.round(F.col("count") * 100.0 / F.col("total"), 2).alias("percent"))
    made = made.orderBy(F.col("count").desc(), "value")
    return made if limit is None else made.limit(limit)


def field_catalog(df: DataFrame) -> DataFrame:
    """field, type, present, coverage and distinct (exact counts, one pass over the rows)."""
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        plain = F.to_json(col(c)) if kinds[c].startswith(("struct", "array", "map")) else col(c)
        aggs += [F.count(col(c)).alias(f"c{i}"), F.approx_count_distinct(plain, 0.02).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.col(f"c{i}").alias("present"), (F.col(f"c{i}") / F.col("n")).alias("coverage"), F.col(f"d{i}").alias("distinct_est")) for i, c in enumerate(df.columns)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sources(catalog) -> DataFrame:
    """name and columns of each source of a catalog."""
    rows = [(n, catalog.frame(n).columns) for n in catalog.names()]
    return catalog.spark.createDataFrame(rows, "name string, fields array<string>")


def sample(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    return df.sample(fraction=share, seed=seed)


def last(engine, source: str, span: str = "1h", limit: int | None = None) -> DataFrame:
    """The events of the last `span`, in order: all of them, or the `limit` newest."""
    return engine.query(f"from {source}[-{span}]" + (f" | tail {limit}" if limit is not None else ""))


def diff(engine, text: str, span: str) -> DataFrame:
    """A query's rows beside those of the window before."""
    return engine.query(f"{text} | compare previous {span}")
