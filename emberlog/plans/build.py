"""From stages to DataFrames: one method for each core stage; helpers are in `operators`."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import HIDDEN, Frame, Order, col, orderable
from ..functions import aggregates as A
from ..functions.scalar import glob_regex
from ..functions.types import duration, kind_of
from ..lang.ast import Agg, Assign, Call, Field, Literal, Pipeline, Stage
from ..lang.errors import QueryError, did_you_mean
from ..lang.unparse import flat_name
from ..operators import helpers, parsing
from ..sources.catalog import Catalog
from ..sources.timerange import bounds
from .exprs import Exprs


class Builder:
    def __init__(self, catalog: Catalog, lets: dict[str, Pipeline] | None = None, now: datetime | None = None, text: str = "", strict_fields: bool = False, approximate: bool = False, sinks=None, views=None):
        self.catalog, self.lets, self.text = catalog, lets or {}, text
        self.now = now or datetime.now(timezone.utc)
        self.strict_fields, self.approximate, self.sinks, self.views = strict_fields, approximate, sinks, views
        self.shift = timedelta(0)
        self.bound: dict[tuple[str, timedelta], Frame] = {}

    def exprs(self, frame: Frame) -> Exprs:
        return Exprs(frame, self.now, self.text, self.strict_fields)

    def run(self, pipeline: Pipeline) -> Frame:
        frame: Frame | None = None
        for i, stage in enumerate(pipeline.stages):
            if stage.name == "compare":
                frame = self.compare(Pipeline(pipeline.stages[:i]), frame, stage)
            elif stage.name in helpers.STAGES:
                frame = helpers.STAGES[stage.name](self, frame, stage)
            else:
                frame = getattr(self, f"do_{stage.name}")(frame, stage)
        return frame

    def fail(self, code: str, message: str, stage: Stage, hint: str = ""):
        raise QueryError(code, message, stage.at, self.text, hint)

    # sources

    def do_from(self, _, stage: Stage) -> Frame:
        low, high = bounds(stage.get("ranges", []), self.now)
        low, high = (x and x - self.shift for x in (low, high))
        names = self.catalog.match(stage.args["sources"])
        if not names:
            self.fail("S010", "no source matches", stage)
        frames = [self.cte(n[1:], stage) if n.startswith("$") else self.catalog.frame(n) for n in names]
        frames = [self.within(f, low, high) for f in frames]
        return frames[0] if len(frames) == 1 else self.unite(frames)

    def within(self, frame: Frame, low, high) -> Frame:
        if "_time" not in frame.columns:
            return frame
        for bound, op in ((low, "ge"), (high, "lt")):
            if bound is not None:
                t = F.lit(bound.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast(frame.kind("_time"))
                frame = frame.having(frame.df.where(col("_time") >= t if op == "ge" else col("_time") < t))
        return frame

    def cte(self, name: str, stage: Stage) -> Frame:
        if name not in self.lets:
            self.fail("S011", f"unknown name `${name}`", stage, did_you_mean(name, self.lets))
        key = (name, self.shift)
        if key not in self.bound:
            earlier = {n: p for n, p in list(self.lets.items())[: list(self.lets).index(name)]}
            inner = Builder(self.catalog, earlier, self.now, self.text, self.strict_fields, self.approximate, self.sinks, self.views)
            inner.shift = self.shift
            self.bound[key] = inner.run(self.lets[name])
        return self.bound[key]

    def sub(self, pipeline: Pipeline) -> Frame:
        inner = Builder(self.catalog, self.lets, self.now, self.text, self.strict_fields, self.approximate, self.sinks, self.views)
        inner.shift, inner.bound = self.shift, self.bound
        return inner.run(pipeline)

    def unite(self, frames: list[Frame]) -> Frame:
        """Rows of all frames by name; the order is by frame, then each frame's own."""
        order, at, parts = [Order(f"{HIDDEN}0")], 1, []
        for i, f in enumerate(frames):
            own = [(o, Order(f"{HIDDEN}{at + j}", o.desc)) for j, o in enumerate(f.order)]
            at += len(own)
            order += [n for _, n in own]
            parts.append(f.df.select(*map(col, f.columns), F.lit(i).alias(f"{HIDDEN}0"), *(col(o.name).alias(n.name) for o, n in own)))
        return Frame(reduce(lambda a, b: _union(a, b), parts), tuple(order), streaming=any(f.streaming for f in frames), warnings=sum((f.warnings for f in frames), ()))

    # rows and columns

    def do_where(self, frame: Frame, stage: Stage) -> Frame:
        ex = self.exprs(frame)
        p = ex.predicate(stage.args["predicate"])
        return self.noted(frame, ex).having(frame.df.where(p))

    def noted(self, frame: Frame, ex: Exprs) -> Frame:
        for name in ex.missing:
            frame = frame.warn(f"field `{name}` is in no stage's output" + (f"; {h}" if (h := did_you_mean(name, ex.names)) else ""))
        return frame

    def do_extend(self, frame: Frame, stage: Stage) -> Frame:
        """Assignments that don't see each other share one projection."""
        pending: dict[str, Column] = {}
        for a in stage.args["assigns"]:
            seen = {flat_name(n) or getattr(n, "name", "") for n in _names(a.value)} | {n.name for n in _names(a.value) if isinstance(n, Field)}
            if pending and (seen & pending.keys() or a.name in pending):
                frame = frame.having(frame.df.withColumns(pending))
                pending = {}
            ex = self.exprs(frame)
            c = ex.compile(a.value)
            frame = self.noted(frame, ex)
            pending[a.name] = c.col
        return frame.having(_with_columns(frame.df, pending))

    def expand(self, frame: Frame, patterns: list[str]) -> list[str]:
        import re

        out: list[str] = []
        for p in patterns:
            if any(c in p for c in "*?[{"):
                rx = re.compile(glob_regex(p, crosses=True))
                out += [c for c in frame.columns if rx.match(c) and c not in out]
            elif p not in out:
                out.append(p)
        return out

    def do_keep(self, frame: Frame, stage: Stage) -> Frame:
        gone = self.expand(frame, stage.args["except"])
        names = [n for n in self.expand(frame, stage.args["patterns"]) if n not in gone]
        for n in names:
            if n not in frame.columns:
                if self.strict_fields:
                    self.fail("S001", f"unknown field `{n}`", stage, did_you_mean(n, frame.columns))
                frame = frame.warn(f"field `{n}` is in no stage's output")
        return frame.select(*(col(n) if n in frame.columns else F.lit(None).cast("string").alias(n) for n in names))

    def do_drop(self, frame: Frame, stage: Stage) -> Frame:
        gone = set(self.expand(frame, stage.args["patterns"]))
        return frame.select(*(col(c) for c in frame.columns if c not in gone))

    def do_rename(self, frame: Frame, stage: Stage) -> Frame:
        renames = dict(stage.args["renames"])
        taken = {n for o, n in renames.items() if o in frame.columns}
        return frame.select(*(col(c).alias(renames.get(c, c)) for c in frame.columns if c in renames or c not in taken))

    # aggregation

    def context(self, frame: Frame, by: list[Assign], window: bool = False) -> A.Context:
        span = next((a.value.args[1].value / 1e6 for a in by if isinstance(a.value, Call) and a.value.name == "bin" and isinstance(a.value.args[1], Literal)), None)
        return A.Context(frame.rank, col("_time") if "_time" in frame.columns else None, span, window, self.approximate)

    def grouped(self, frame: Frame, aggs: list[Agg], by: list[Assign]) -> tuple[list[Column], list[Column], Frame]:
        ex = self.exprs(frame)
        ctx = self.context(frame, by)
        keys = [ex.column(a.value).alias(a.name) for a in by]
        made = [ex.aggregate(a.call, ctx).alias(a.name) for a in aggs]
        return keys, made, self.noted(frame, ex)

    def summed(self, df: DataFrame, keys: list[Column], aggs: list[Agg], made: list[Column]) -> DataFrame:
        """The aggregates of each group, in one row.

        Beside each value that `dc` tells apart Spark keeps the states of all aggregates.  A sketch is wide however few
        rows it has seen, so sketches are made apart, one a group and task; the two rows of a group then become one.
        """
        of = lambda d, columns: d.groupBy(*keys).agg(*columns) if keys else d.agg(*columns)
        wide = [a.call.name in A.WIDE for a in aggs]
        if df.isStreaming or not any(wide) or not any(a.call.name == "dc" for a in aggs):
            return of(df, made)
        marks, held = [f"__k{i}" for i in range(len(keys))], [f"__a{i}" for i in range(len(made))]
        named, keys = keys, [k.alias(m) for k, m in zip(keys, marks)]
        parts = [of(df, [c.alias(h) for c, h, w in zip(made, held, wide) if w == is_wide]) for is_wide in (False, True)]
        both, keys = parts[0].unionByName(parts[1], allowMissingColumns=True), [col(m) for m in marks]
        both = of(both, [F.first(h, ignorenulls=True).alias(h) for h in held])
        names = df.select(*named).columns + [a.name for a in aggs]
        return both.select(*(col(m).alias(n) for m, n in zip(marks + held, names)))

    def do_stats(self, frame: Frame, stage: Stage) -> Frame:
        by = stage.args["by"]
        keys, made, frame = self.grouped(frame, stage.args["aggs"], by)
        df = self.summed(frame.df, keys, stage.args["aggs"], made)
        out = Frame(df, streaming=frame.streaming, warnings=frame.warnings)
        named = [a.name for a in by if orderable(df.schema[a.name].dataType)]
        return out if frame.streaming else out.ordered_by([(col(n), False) for n in named], keep=False, is_sorted=False)

    def do_eventstats(self, frame: Frame, stage: Stage) -> Frame:
        """The groups' values by a null-safe join, so that a hot group is summed up before it is dealt out and the rows
        keep their places; without keys the one row of values is broadcast."""
        by = stage.args["by"]
        keys, made, frame = self.grouped(frame, stage.args["aggs"], by)
        names = [a.name for a in stage.args["aggs"]]
        left = frame.df.drop(*names)
        if not keys:
            values = self.summed(frame.df, [], stage.args["aggs"], made)
            return frame.having(_hidden_last(left.crossJoin(F.broadcast(values))))
        marks = [f"__k{i}" for i in range(len(keys))]
        values = self.summed(frame.df, [k.alias(m) for k, m in zip(keys, marks)], stage.args["aggs"], made)
        own = [f"__l{i}" for i in range(len(keys))]
        ex = self.exprs(frame)
        left = frame.df.withColumns({o: ex.column(a.value) for o, a in zip(own, by)}).drop(*names)
        on = reduce(lambda a, b: a & b, (col(o).eqNullSafe(col(m)) for o, m in zip(own, marks)))
        return frame.having(_hidden_last(left.join(values, on, "left").drop(*own, *marks)))

    def do_streamstats(self, frame: Frame, stage: Stage) -> Frame:
        by, n, current = stage.args["by"], int(stage.get("window", 0)), stage.args["current"]
        if not frame.order:
            self.fail("S020", "streamstats needs a row order", stage, "sort first")
        if not by:
            frame = frame.warn("streamstats without `by` runs over all rows in one task")
        ex = self.exprs(frame)
        part = Window.partitionBy(*(ex.column(a.value) for a in by)) if by else Window.partitionBy()
        part = part.orderBy(*frame.sort_columns())
        lo = Window.unboundedPreceding if not n else -(n - 1) if current else -n
        w = part.rowsBetween(lo, 0 if current else -1)
        ctx, made = self.context(frame, by, True), {}
        for a in stage.args["aggs"]:
            made[a.name] = self.window_call(ex, a.call, ctx, part, w)
        return self.noted(frame, ex).having(_with_columns(frame.df, made))

    def window_call(self, ex: Exprs, call: Call, ctx: A.Context, part, w) -> Column:
        if call.name in A.WINDOW_ONLY:
            least, most = A.WINDOW_ONLY[call.name]
            if not least <= len(call.args) <= most:
                ex.error("S007", f"`{call.name}` takes {least} to {most} arguments", call)
            args = [ex.compile(x) for x in call.args]
            if call.name == "row_number":
                return F.row_number().over(part).cast("bigint")
            x = args[0].col
            if call.name in ("lag", "lead"):
                return (F.lag if call.name == "lag" else F.lead)(x, int(args[1].value) if len(args) > 1 else 1).over(part)
            if call.name == "running_sum":
                return F.sum(x).over(part.rowsBetween(Window.unboundedPreceding, 0))
            return F.avg(x).over(part.rowsBetween(-(int(args[1].value) - 1), 0))
        if call.name in ("first", "last"):
            x = ex.column(call.args[0])
            x = x if call.where is None else F.when(ex.predicate(call.where), x)
            return (F.first if call.name == "first" else F.last)(x, ignorenulls=True).over(w)
        if call.name == "list":
            return F.collect_list(ex.column(call.args[0])).over(w)
        if call.name in ("values", "mode", "dc"):
            x = ex.column(call.args[0])
            x = x if call.where is None else F.when(ex.predicate(call.where), x)
            if call.name == "mode":
                return F.mode(x, deterministic=True).over(w)
            seen = F.collect_set(x).over(w)
            return F.array_sort(seen) if call.name == "values" else F.size(seen).cast("bigint")
        if call.name in ("range", "sumsq", "rate", "per_second", "per_minute", "per_hour", "per_day", "earliest_time", "latest_time", "estdc_error"):
            x = ex.column(call.args[0]) if call.args else None
            if call.name == "range":
                return F.max(x).over(w) - F.min(x).over(w)
            if call.name == "sumsq":
                return F.sum(x * x).over(w)
            if call.name in ("earliest_time", "latest_time"):
                return F.unix_micros((F.min if call.name[0] == "e" else F.max)(ctx.time).over(w).cast("timestamp")) / 1e6
            ex.error("S005", f"`{call.name}` has no running form", call)
        return ex.aggregate(call, ctx).over(w)

    # order

    def do_sort(self, frame: Frame, stage: Stage) -> Frame:
        ex = self.exprs(frame)
        keys = [(ex.column(k.value), k.desc) for k in stage.args["keys"]]
        return self.noted(frame, ex).ordered_by(keys)

    def do_head(self, frame: Frame, stage: Stage) -> Frame:
        df = frame.df.orderBy(*frame.sort_columns()) if frame.order and not frame.streaming else frame.df
        return replace(frame, df=df.limit(stage.args["n"]), sorted=frame.sorted or bool(frame.order))

    def do_tail(self, frame: Frame, stage: Stage) -> Frame:
        df = frame.df.orderBy(*frame.sort_columns(reverse=True)) if frame.order else frame.df
        return replace(frame, df=df.limit(stage.args["n"]), sorted=bool(frame.order))

    def do_dedup(self, frame: Frame, stage: Stage) -> Frame:
        ex = self.exprs(frame)
        keys = [ex.column(Field(f)) for f in stage.args["fields"]]
        n = stage.args["n"]
        if frame.streaming:
            if n != 1:
                self.fail("S021", "a stream keeps one row of each key", stage)
            return frame.having(frame.df.dropDuplicatesWithinWatermark(stage.args["fields"]))
        order = frame.sort_columns() or [F.lit(0)]
        ranked = frame.df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return frame.having(ranked.where(col("__n") <= n).drop("__n"))

    # several inputs

    def do_join(self, frame: Frame, stage: Stage) -> Frame:
        """Columns that both sides have are the left's; a key that is null has no partner.  Which side is broadcast is
        left to Spark, which knows the sizes."""
        right, on = self.sub(stage.args["right"]), stage.args["on"]
        for f, side in ((frame, "left"), (right, "right")):
            for k in on:
                if k not in f.columns:
                    self.fail("S008", f"the {side} side has no field `{k}`", stage, did_you_mean(k, f.columns))
        other = right.df.select(*(col(c) for c in right.columns if c in on or c not in frame.columns))
        how = {"inner": "inner", "left": "left", "outer": "full"}[stage.args["type"]]
        return replace(frame.having(_hidden_last(frame.df.join(other, on, how))), warnings=frame.warnings + right.warnings)

    def do_union(self, frame: Frame, stage: Stage) -> Frame:
        return self.unite([frame, *(self.sub(p) for p in stage.args["others"])])

    def do_explode(self, frame: Frame, stage: Stage) -> Frame:
        ex = self.exprs(frame)
        field = stage.args["field"]
        arr = ex.compile(field)
        t = ex.type_of(arr.col)
        out = stage.args["as"] or flat_name(field)
        if arr.kind == "null":
            return self.noted(frame, ex).having(frame.df.where(F.lit(False)))
        if not isinstance(t, T.ArrayType):
            self.fail("S003", f"explode takes an array, not {kind_of(t)}", stage)
        rest = [c for c in frame.df.columns if c != out and not c.startswith(HIDDEN)]
        df = frame.df.select(*map(col, rest), *map(col, frame.hidden), F.posexplode(arr.col).alias(f"{HIDDEN}at", out))
        made = [col(out)]
        if isinstance(t.elementType, T.StructType):
            made += [col(out).getField(f).alias(f"{out}.{f}") for f in t.elementType.names if f"{out}.{f}" not in rest]
        place = {c: i for i, c in enumerate(frame.columns)}
        visible = [c for c in frame.columns if c != out] if out not in place else frame.columns
        shown = [col(c) for c in visible] + ([] if out in place else made[:1]) + made[1:]
        order = (*frame.order, Order(f"{HIDDEN}{len(frame.order)}"))
        return replace(frame, df=df.select(*shown, *map(col, frame.hidden), col(f"{HIDDEN}at").alias(order[-1].name)), order=order)

    def do_parse(self, frame: Frame, stage: Stage) -> Frame:
        return parsing.parse_stage(self, frame, stage)

    def compare(self, prefix: Pipeline, now: Frame, stage: Stage) -> Frame:
        """The prefix over the window before, matched on the fields that aren't numbers (times moved by the shift)."""
        us = stage.args["shift"]
        before, self.shift = self.shift, self.shift + timedelta(microseconds=us)
        try:
            old = self.run(prefix)
        finally:
            self.shift = before
        numbers = [c for c in now.columns if kind_of(now.kind(c)) in ("int", "float")]
        keys = [c for c in now.columns if c not in numbers]
        moved = [(col(c) + duration(us) if kind_of(old.kind(c)) == "timestamp" else col(c)).alias(f"__k{i}") for i, c in enumerate(keys)]
        right = old.df.select(*moved, *(col(c).alias(f"previous_{c}") for c in numbers))
        on = reduce(lambda a, b: a & b, (col(c).eqNullSafe(col(f"__k{i}")) for i, c in enumerate(keys)), F.lit(True))
        if keys:
            joined = now.df.join(right, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))
        else:  # one row on either side
            joined = now.df.crossJoin(F.broadcast(right.limit(1)))
        made = {f"change_{c}": col(c) - col(f"previous_{c}") for c in numbers}
        return now.having(_hidden_last(_with_columns(joined, made)))

    # management

    def do_tee(self, frame: Frame, stage: Stage) -> Frame:
        if self.sinks is None:
            self.fail("S030", "tee isn't enabled here", stage)
        self.sinks(stage.args["sink"], frame)
        return frame

    def do_viewscan(self, _, stage: Stage) -> Frame:
        return self.views.scan(stage)

    def do_materialize(self, frame: Frame, stage: Stage) -> Frame:
        self.fail("S031", "materialize creates a view; it can't be run as a query", stage, "use Engine.materialize")


def _names(node):
    from ..lang.ast import Field as Fd
    from ..lang.ast import Member, walk

    return [n for n in walk(node) if isinstance(n, (Fd, Member))]


def _hidden_last(df: DataFrame) -> DataFrame:
    return df.select(*(col(c) for c in df.columns if not c.startswith(HIDDEN)), *(col(c) for c in df.columns if c.startswith(HIDDEN)))


def _with_columns(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    return _hidden_last(df.withColumns(made)) if made else df


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """By name; a column of different types on both sides becomes text."""
    for c in set(a.columns) & set(b.columns):
        x, y = a.schema[c].dataType, b.schema[c].dataType
        if x != y and {kind_of(x), kind_of(y)} not in ({"int"}, {"float"}, {"int", "float"}, {"timestamp"}):
            a, b = a.withColumn(c, col(c).cast("string")), b.withColumn(c, col(c).cast("string"))
    return _hidden_last(a.unionByName(b, allowMissingColumns=True))
