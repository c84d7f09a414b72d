"""Live queries: the stages that a stream can hold, with watermarks for grouping.

`tail` gives rows as they come; `windows` gives time buckets once the watermark has passed them; `sessions` closes a
key's session when its gap has passed; `maintain` keeps a view up to date batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..engine import Engine
from ..frame import from_dataframe
from ..functions.types import duration
from ..lang.ast import Call, Pipeline, Query
from ..lang.desugar import desugar_query
from ..lang.errors import QueryError
from ..lang.parser import parse

#: Stages that take a row at a time.
ROWWISE = {"from", "where", "parse", "extend", "keep", "drop", "rename", "explode", "dedup"}
SKEW = "200 milliseconds"


def check(query: Query, windowed: bool = False) -> None:
    """Refuse what would have to wait for the stream's end."""
    for s in query.pipeline.stages:
        if s.name in ROWWISE:
            continue
        if windowed and s.name == "stats" and any(isinstance(a.value, Call) and a.value.name == "bin" for a in s.args["by"]):
            continue
        hint = "group by bin(_time, ...)" if s.name == "stats" else "run it as a batch query"
        raise QueryError("S050", f"`{s.name}` needs all rows, and a stream has no end", s.at, query.text, hint)


def _run(engine: Engine, text: str, stream: DataFrame, windowed: bool, watermark: str) -> DataFrame:
    query = desugar_query(parse(text, engine.fragments))
    check(query, windowed)
    live = from_dataframe(stream.withWatermark("_time", watermark) if "_time" in stream.columns else stream)
    inner = Engine(engine.spark, engine.strict_fields, engine.approximate, engine.fragments)
    inner.catalog.makers = {**engine.catalog.makers, **{s.name: (lambda: live) for s in query.pipeline.stages[0].args["sources"]}}
    return inner.builder(query).run(Pipeline(query.pipeline.stages)).output()


def tail(engine: Engine, text: str, stream: DataFrame, since=None, watermark: str = SKEW) -> DataFrame:
    """The query's rows over a stream of events, those after `since` only (a cursor that a catch-up query has reached)."""
    if since is not None:
        stream = stream.where(F.col("_time") > F.lit(since))
    return _run(engine, text, stream, False, watermark)


def follow(engine: Engine, text: str, past: DataFrame, stream: DataFrame, sink, checkpoint: str, watermark: str = SKEW, **trigger) -> StreamingQuery:
    """What has been and what comes, in one call: the query's rows over `past` go to `sink` (a function of a frame) once,
    in the order of time, and then each micro-batch of the stream, without events up to the newest of the past.

    The past's newest time is the cursor.  Events of that very time that come later are told from those that have been
    shown by their whole row.  `trigger` bounds the micro-batches (processingTime="1 second", availableNow=True).
    """
    cursor = past.agg(F.max("_time")).first()[0]
    edge = past.where(F.col("_time") == F.lit(cursor)) if cursor is not None else past.limit(0)
    inner = Engine(engine.spark, engine.strict_fields, engine.approximate, engine.fragments)
    query = desugar_query(parse(text, engine.fragments))
    check(query)

    def rows(df: DataFrame) -> DataFrame:
        live = from_dataframe(df, ["_time"])
        inner.catalog.makers = {**engine.catalog.makers, **{s.name: (lambda: live) for s in query.pipeline.stages[0].args["sources"]}}
        frame = inner.builder(query).run(Pipeline(query.pipeline.stages))
        return frame.df.orderBy(*frame.sort_columns()).select(*(F.col(f"`{c}`") for c in frame.columns))

    sink(rows(past))
    new = stream if cursor is None else stream.where(F.col("_time") >= F.lit(cursor))

    def batch(df: DataFrame, _: int) -> None:
        fresh = df if cursor is None else df.where(F.col("_time") > F.lit(cursor)).unionByName(df.where(F.col("_time") == F.lit(cursor)).exceptAll(edge))
        sink(rows(fresh))

    return new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windows(engine: Engine, text: str, stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A query with stats by bin(_time, ...): each bucket's row comes once, when the watermark has passed its end.

    The bucket is a Spark window, by which state is dropped; later events are left out.
    """
    query = desugar_query(parse(text, engine.fragments))
    check(query, True)
    at = next((i for i, s in enumerate(query.pipeline.stages) if s.name == "stats"), None)
    if at is None or at != len(query.pipeline.stages) - 1:
        raise QueryError("S051", "a windowed stream ends in stats by bin(_time, ...)", 0, text)
    stats = query.pipeline.stages[at]
    live = from_dataframe(stream.withWatermark("_time", watermark))
    inner = Engine(engine.spark, engine.strict_fields, engine.approximate, engine.fragments)
    inner.catalog.makers = {s.name: (lambda: live) for s in query.pipeline.stages[0].args["sources"]}
    builder = inner.builder(query)
    frame = builder.run(Pipeline(query.pipeline.stages[:at]))
    ex, ctx = builder.exprs(frame), builder.context(frame, stats.args["by"])
    keys, names = [], []
    for a in stats.args["by"]:
        if isinstance(a.value, Call) and a.value.name == "bin":
            keys.append(F.window("_time", f"{round(a.value.args[1].value)} microseconds").alias("__w"))
            names.append(F.col("__w.start").alias(a.name))
        else:
            keys.append(ex.column(a.value).alias(a.name))
            names.append(F.col(f"`{a.name}`"))
    aggs = [ex.aggregate(a.call, ctx).alias(a.name) for a in stats.args["aggs"]]
    return frame.df.groupBy(*keys).agg(*aggs).select(*names, *(F.col(f"`{a.name}`") for a in stats.args["aggs"]))


def dedup(stream: DataFrame, fields: list[str], watermark: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark("_time", watermark).dropDuplicatesWithinWatermark(fields)


def sessions(stream: DataFrame, key: str, maxpause_us: float, watermark: str = "10 minutes") -> DataFrame:
    """key, start, end and events of each session, once it is closed by the watermark."""
    gap = F.session_window("_time", f"{round(maxpause_us)} microseconds")
    made = stream.withWatermark("_time", watermark).groupBy(F.col(key), gap.alias("w")).agg(F.count("*").alias("events"))
    return made.select(key, F.col("w.start").alias("_session_start"), (F.col("w.end") - duration(maxpause_us)).alias("_session_end"), "events")


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """streamstats over a stream: count and sum so far of each key, kept as state between batches."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        parts = list(batches)  # one key's rows of one micro-batch
        for pdf in [pd.concat(parts).sort_values("_time", kind="stable").reset_index(drop=True)] if parts else []:
            sums = pdf[value].fillna(0.0).cumsum() + total
            counts = pd.Series(range(n + 1, n + len(pdf) + 1), index=pdf.index)
            yield pd.DataFrame({key: pdf[key], "_time": pdf["_time"], value: pdf[value], "running_count": counts, "running_sum": sums})
            n, total = n + len(pdf), float(sums.iloc[-1]) if len(pdf) else total
        state.update((n, total))

    kind = dict(stream.dtypes)
    schema = f"`{key}` {kind[key]}, _time {kind['_time']}, `{value}` {kind[value]}, running_count long, running_sum double"
    return stream.select(key, "_time", value).groupBy(key).applyInPandasWithState(step, schema, "n long, total double", "append", GroupStateTimeout.NoTimeout)


def maintain(views, name: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Add each batch's states to a view; a batch that is run again replaces what it wrote before."""
    return stream.writeStream.foreachBatch(lambda df, i: views.append(name, df, f"stream-{i}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
