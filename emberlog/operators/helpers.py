"""Investigation stages: each takes (builder, frame, stage) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import HIDDEN, Frame, col
from ..functions.types import bin_time, kind_of, micros, seconds
from ..lang.ast import Assign, Field
from ..lang.unparse import span as span_text
from ..staging import numbered


def _keys(b, frame, by: list[Assign]):
    ex = b.exprs(frame)
    return [ex.column(a.value).alias(a.name) for a in by]


def _text(frame: Frame, name: str):
    t = frame.kind(name)
    return F.to_json(col(name)) if isinstance(t, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else col(name).cast("string")


def _new(frame: Frame, df, keys: list, is_sorted: bool = True) -> Frame:
    out = Frame(df, warnings=frame.warnings)
    return out.ordered_by(keys, keep=False, is_sorted=is_sorted)


def facets(b, frame: Frame, stage) -> Frame:
    """The most frequent values of each field, in one pass: rows are exploded into (field, value) and counted."""
    fields, limit = stage.args["fields"], stage.args["limit"]
    ex = b.exprs(frame)
    pairs = F.array(*(F.struct(F.lit(f).alias("f"), (_text(frame, f) if f in frame.columns else ex.column(Field(f))).alias("v")) for f in fields))
    counts = frame.df.select(F.explode(pairs).alias("p")).groupBy(F.col("p.f").alias("_facet"), F.col("p.v").alias("_value")).agg(F.count("*").alias("count"))
    order = [F.col("count").desc(), F.col("_value").asc_nulls_last()]
    ranked = counts.withColumn("__n", F.row_number().over(Window.partitionBy("_facet").orderBy(*order))).where(F.col("__n") <= limit).drop("__n")
    at = reduce(lambda w, x: w.when(F.col("_facet") == x[1], x[0]), enumerate(fields[1:], 1), F.when(F.col("_facet") == fields[0], 0))
    return _new(frame, ranked, [(at, False), (F.col("count"), True), (F.col("_value"), False)])


def describe(b, frame: Frame, stage) -> Frame:
    """field, type, coverage, distinct_est and top_values of each field: one pass that counts (field, value) pairs."""
    names = frame.columns
    pairs = F.array(*(F.struct(F.lit(n).alias("f"), _text(frame, n).alias("v")) for n in names))
    counts = frame.df.select(F.explode(pairs).alias("p")).groupBy(F.col("p.f").alias("field"), F.col("p.v").alias("v")).agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    made = counts.groupBy("field").agg((known / F.sum("n")).alias("coverage"), F.count("v").alias("distinct_est"))
    # Each task keeps five values of a field before they are dealt out by field.
    top = counts.where("v is not null").withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("v")))).where("r <= 5")
    told = F.struct("r", F.concat("v", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    top = top.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]).alias("top_values"))
    made = made.join(top, "field", "left").withColumn("top_values", F.coalesce("top_values", F.array().cast("array<string>")))
    kinds = F.create_map(*(F.lit(x) for n in names for x in (n, kind_of(frame.kind(n)))))
    made = made.select("field", F.element_at(kinds, F.col("field")).alias("type"), "coverage", "distinct_est", "top_values")
    return _new(frame, made, [(F.array_position(F.array(*map(F.lit, names)), F.col("field")), False)])


#: Tokens that stand for a variable part, tried on each token of a message.
VARIABLE = r"^[\[\](){}<>\"',;:=]*(?:[-+]?\d[\d.,:]*(?:ns|us|ms|s|m|h|d|B|KB|MB|GB|%)?|0[xX][0-9a-fA-F]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?)[\[\](){}<>\"',;:=]*$"


class Templates:
    """Templates of messages of one length: each message joins the most similar template (the first of several), if it is
    similar enough, or begins a new one.  A row of `table` holds a template's tokens as numbers; 0 stands for any.

    A template that is similar enough has `need` tokens of the message, so one at least among any `size - need + 1`
    places: of MANY templates, only those that stand under the rarest of these places' tokens are compared.
    """

    MANY = 32

    def __init__(self, similarity: float, size: int):
        self.codes, self.counts, self.examples = {"<*>": 0}, [], []
        self.need = next((m for m in range(size + 1) if m / size >= similarity), size + 1)
        self.table = np.zeros((1, size), np.int64)
        self.under: list[dict[int, list[int]]] = []  # of MANY templates, their rows by place and token

    def close(self, code: list[int]) -> np.ndarray | slice:
        """Rows of all templates that may be similar enough, in order."""
        if not self.under:
            return slice(0, len(self.counts))
        lists = sorted(([u.get(c, ()), u.get(0, ()) if c else ()] for u, c in zip(self.under, code)), key=lambda x: len(x[0]) + len(x[1]))
        found = [x for two in lists[: max(0, len(code) - self.need + 1)] for x in two]
        if sum(map(len, found)) >= len(self.counts) or self.need < 1:
            return slice(0, len(self.counts))
        return np.unique(np.fromiter(chain(*found), np.int64))

    def add(self, parts: list[str], count: int, example: str) -> None:
        code, n = [self.codes.setdefault(t, len(self.codes)) for t in parts], len(self.counts)
        tokens, rows = np.array(code), self.close(code)
        held = self.table[rows]
        if n and len(held):
            same = ((held == tokens) | (held == 0)).sum(axis=1)
            at = int(same.argmax())
            if same[at] >= self.need:
                best = at if isinstance(rows, slice) else int(rows[at])
                for i in np.flatnonzero((held[at] != tokens) & (held[at] != 0)).tolist():
                    self.table[best, i] = 0
                    if self.under:
                        self.under[i].setdefault(0, []).append(best)
                self.counts[best] += count
                self.examples[best] = min(self.examples[best], example)
                return
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = tokens
        self.counts.append(count)
        self.examples.append(example)
        if n + 1 >= self.MANY:
            first = n if self.under else 0
            self.under = self.under or [{} for _ in parts]
            for row in range(first, n + 1):
                for u, c in zip(self.under, self.table[row].tolist()):
                    u.setdefault(c, []).append(row)

    def told(self) -> list[tuple[str, int, str]]:
        """(pattern, count, example); templates that have become equal are one."""
        words, found = list(self.codes), {}
        for code, n, e in zip(self.table, self.counts, self.examples):
            p = " ".join([words[c] for c in code])
            had = found.get(p)
            found[p] = (n + had[0], min(e, had[1])) if had else (n, e)
        return [(p, n, e) for p, (n, e) in found.items()]


def merged(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Templates of masked messages that come by length and first token, most frequent first."""

    def sent():
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 10_000]), (pa.string(), pa.int64(), pa.string()))], ["pattern", "count", "example"])

    key, group, out = None, None, []
    for batch in batches:
        for p, n, e in zip(*(batch.column(c).to_pylist() for c in ("pattern", "count", "example"))):
            parts = p.split(" ")
            if len(parts) == 1:  # a group of its own
                out.append((p, n, e))
                continue
            if (len(parts), parts[0]) != key:
                if group:
                    out += group.told()
                key, group = (len(parts), parts[0]), Templates(similarity, len(parts))
            group.add(parts, n, e)
        yield from sent()
        out = []
    out = group.told() if group else []
    yield from sent()


def patterns(b, frame: Frame, stage) -> Frame:
    """Message templates, most frequent first.

    Variable tokens are masked and equal messages counted by Spark, so that only distinct masked messages go on.  With
    mode=mask that is all.  Otherwise they are merged in groups of equal length and first token (the tree's upper
    levels): in order of frequency, each joins the most similar template, if similar enough, or begins a new one.
    Groups come sorted to one call of Python a task, as there may be as many as messages.
    """
    field = stage.get("field", "_raw")
    most, similarity = int(stage.get("max_templates", 50)), float(stage.get("similarity", 0.4))
    body = b.exprs(frame).column(Field(field)).cast("string")
    masked = F.array_join(F.transform(F.filter(F.split(body, r"\s+"), lambda t: t != ""), lambda t: F.when(t.rlike(VARIABLE), F.lit("<*>")).otherwise(t)), " ")
    counts = frame.df.select(masked.alias("pattern"), body.alias("line")).where("pattern is not null and pattern <> ''").groupBy("pattern").agg(F.count("*").alias("count"), F.min("line").alias("example"))
    if stage.get("mode") != "mask":
        tokens = F.split("pattern", " ")
        heads = counts.withColumn("len", F.size(tokens)).withColumn("head", tokens[0]).repartition("len", "head")
        heads = heads.sortWithinPartitions("len", "head", F.col("count").desc(), "pattern").drop("len", "head")
        counts = heads.mapInArrow(lambda batches: merged(batches, similarity), "pattern string, count long, example string")
    # Straight from the rows: from `counts`, they would be masked and merged once more.
    total = frame.df.where(body.rlike(r"\S")).agg(F.count("*").alias("__total"))
    made = counts.crossJoin(F.broadcast(total)).select("pattern", "count", F.round(F.col("count") * 100.0 / F.col("__total"), 2).alias("percent"), "example")
    out = _new(frame, made, [(F.col("count"), True), (F.col("pattern"), False)])
    return replace(out, df=out.df.orderBy(*out.sort_columns()).limit(most))


def outliers(b, frame: Frame, stage) -> Frame:
    """_outlier and _score by quartiles, mean or median; the one row of statistics is broadcast.

    Quartiles and medians are exact unless the engine is `approximate`, which bounds their memory.
    """
    quantile = (lambda c, p: F.percentile_approx(c, p, 10_000)) if b.approximate else F.percentile
    method = stage.get("method", "iqr")
    if stage.get("mode") is not None:
        b.fail("S003", "`outliers` has no `mode`; it marks all rows", stage, "| where _outlier")
    limit = float(stage.get("threshold", {"iqr": 1.5, "zscore": 3.0, "mad": 3.5}.get(method, 0)))
    v = b.exprs(frame).column(Field(stage.args["field"])).cast("double")
    zero = F.lit(0.0)
    if method == "iqr":
        stats = frame.df.agg(F.count(v).alias("__c"), quantile(v, 0.25).alias("__a"), quantile(v, 0.75).alias("__z"))
        spread = F.col("__z") - F.col("__a")
        low, high = F.col("__a") - limit * spread, F.col("__z") + limit * spread
        score = F.when(v < low, (low - v) / spread).when(v > high, (v - high) / spread).otherwise(zero)
        ok, out = (F.col("__c") >= 4) & (spread != 0), (v < low) | (v > high)
    elif method == "zscore":
        stats = frame.df.agg(F.count(v).alias("__c"), F.avg(v).alias("__a"), F.stddev_samp(v).alias("__z"))
        score = F.abs((v - F.col("__a")) / F.col("__z"))
        ok, out = (F.col("__c") >= 2) & (F.col("__z") != 0), score > limit
    elif method == "mad":
        middle = frame.df.agg(F.count(v).alias("__c"), quantile(v, 0.5).alias("__a"))
        stats = frame.df.select(v.alias("v")).crossJoin(F.broadcast(middle)).groupBy("__c", "__a").agg(quantile(F.abs(F.col("v") - F.col("__a")), 0.5).alias("__z"))
        score = 0.6745 * F.abs(v - F.col("__a")) / F.col("__z")
        ok, out = (F.col("__c") >= 3) & (F.col("__z") != 0), score > limit
    else:
        b.fail("S003", f"unknown method `{method}`", stage, "iqr, zscore or mad")
    df = frame.df.crossJoin(F.broadcast(stats))
    df = df.withColumns({"_outlier": F.coalesce(F.when(ok, out), F.lit(False)), "_score": F.coalesce(F.when(ok, score), zero)})
    return frame.having(df.select(*map(col, frame.columns), "_outlier", "_score", *map(col, frame.hidden)))


def sessionize(b, frame: Frame, stage) -> Frame:
    """_session_id (numbers sessions by key and start), _session_start and _session_end.

    Sessions are cut within each key; only one row per session is numbered over all keys.
    """
    keys = _keys(b, frame, stage.args["by"])
    marks = [f"__k{i}" for i in range(len(keys))]
    df = frame.df.withColumns({m: k for m, k in zip(marks, keys)})
    w = Window.partitionBy(*map(F.col, marks)).orderBy(F.col("_time"), *frame.sort_columns())
    gap = F.unix_micros(F.col("_time").cast("timestamp")) - F.unix_micros(F.lag("_time").over(w).cast("timestamp"))
    df = df.withColumn("__new", F.when(gap.isNull() | (gap > F.lit(round(stage.args["maxpause"]))), 1).otherwise(0))
    df = df.withColumn("__s", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sessions = df.groupBy(*marks, "__s").agg(F.min("_time").alias("_session_start"), F.max("_time").alias("_session_end"))
    sessions = numbered(sessions, [*(F.col(m).asc_nulls_first() for m in marks), F.col("_session_start").asc()], "_session_id")
    sessions = sessions.withColumnsRenamed({m: f"{m}r" for m in [*marks, "__s"]})
    on = reduce(lambda x, y: x & y, (F.col(m).eqNullSafe(F.col(f"{m}r")) for m in marks), F.col("__s") == F.col("__sr"))
    joined = df.join(sessions, on)
    return frame.having(joined.select(*map(col, frame.columns), "_session_id", "_session_start", "_session_end", *map(col, frame.hidden)))


def transaction(b, frame: Frame, stage) -> Frame:
    """One row for each transaction: its first event's fields, duration in seconds, eventcount and _raw joined by lines.

    A gap above maxspan, an event that matches startswith, or the one after an event that matches endswith begins a new
    transaction of its key.
    """
    fields = stage.args["fields"]
    ex = b.exprs(frame)
    keys = [ex.column(Field(f)) for f in fields]
    w = Window.partitionBy(*keys).orderBy(F.col("_time"), *frame.sort_columns())
    new = F.lag(F.lit(1)).over(w).isNull()
    if stage.get("maxspan"):
        gap = F.unix_micros(F.col("_time").cast("timestamp")) - F.unix_micros(F.lag("_time").over(w).cast("timestamp"))
        new = new | F.coalesce(gap > F.lit(round(stage.args["maxspan"])), F.lit(False))
    if stage.get("startswith") is not None:
        new = new | F.coalesce(ex.predicate(stage.args["startswith"]), F.lit(False))
    if stage.get("endswith") is not None:
        new = new | F.coalesce(F.lag(ex.predicate(stage.args["endswith"])).over(w), F.lit(False))
    df = frame.df.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("__t", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(F.col("_time").alias("t"), frame.rank().alias("r"))
    rest = [c for c in frame.columns if c not in (*fields, "_time", "_raw", "duration", "eventcount")]
    first = F.min_by(F.struct(*(col(c) for c in rest)), rank) if rest else F.min(F.lit(None).cast("string"))
    aggs = [F.min("_time").alias("_time"), seconds(F.max("_time") - F.min("_time")).alias("duration"), F.count("*").alias("eventcount"), first.alias("__first")]
    if "_raw" in frame.columns:
        lines = F.collect_list(F.struct(rank.alias("k"), F.col("_raw").cast("string").alias("v")))
        aggs.append(F.array_join(F.transform(F.array_sort(lines), lambda x: x["v"]), "\n").alias("_raw"))
    made = df.groupBy(*(k.alias(f) for k, f in zip(keys, fields)), "__t").agg(*aggs)
    shown = [c for c in frame.columns if c not in ("duration", "eventcount")]
    pick = lambda c: col(c) if c in (*fields, "_time", "_raw") else F.col("__first").getField(c).alias(c)
    made = made.select(*map(pick, shown), "duration", "eventcount")
    return _new(frame, made, [(F.col("_time"), False), *((col(f), False) for f in fields)], False)


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of each key they have, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []  # rows of the last key, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        last = keys.index(keys[-1])
        if held and (last or held[0].column(key)[0].as_py() != keys[-1]):
            held, done = [], held
            yield pa.Table.from_batches([*done, batch.slice(0, last)]).combine_chunks()
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tree(sids: list[str], pids: list[str], label: Callable[[int], str]) -> Iterator[tuple[int, int, str]]:
    """(row, depth, drawn branch) of each of a trace's spans, from the roots down."""
    known = {s for s in sids if s}
    below: dict[str, list[int]] = {}
    roots = []
    for i, p in enumerate(pids):
        (below.setdefault(p, []) if p and p in known else roots).append(i)
    seen = set()
    todo, rest = [(i, 0, "", True) for i in reversed(roots)], iter(range(len(sids)))
    while todo or len(seen) < len(sids):
        i, depth, lead, is_last = todo.pop() if todo else (next(rest), 0, "", True)
        if i in seen:
            continue
        seen.add(i)
        mark = "" if not depth else "└── " if is_last else "├── "
        yield i, depth, lead + mark + label(i)
        children = below.get(sids[i], []) if sids[i] else []
        inner = "" if not depth else lead + ("    " if is_last else "│   ")
        todo += [(j, depth + 1, inner, k == len(children) - 1) for k, j in reversed(list(enumerate(children)))]


def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of rows sorted by trace; a table goes on when it has many rows or characters."""
    for table in whole(batches, "tid"):
        tids, sids, pids, services, operations, durations = (table.column(c).to_pylist() for c in ("tid", "sid", "pid", "service", "operation", "duration_ms"))

        def label(i):
            name = ".".join(x for x in (services[i], operations[i]) if x) or f"span:{sids[i][:8]}"
            return name + (f" [{durations[i]:.0f}ms]" if durations[i] is not None else "")

        def taken():
            rows = table.select(["_time", "tid", "service", "operation", "duration_ms"]).take(pa.array(at, pa.int64()))
            for name, values, kind in (("_span_depth", depths, pa.int64()), ("_span_tree", trees, pa.string()), ("n", places, pa.int64())):
                rows = rows.append_column(name, pa.array(values, kind))
            return rows.combine_chunks().to_batches()

        at, depths, trees, places, size, begin = [], [], [], [], 0, 0
        while begin < len(tids):
            end = begin + 1
            while end < len(tids) and tids[end] == tids[begin]:
                end += 1
            for n, (i, depth, text) in enumerate(tree(sids[begin:end], pids[begin:end], lambda i: label(begin + i))):
                at.append(begin + i)
                depths.append(depth)
                trees.append(text)
                places.append(n)
                size += len(text)
                if len(at) >= 10_000 or size >= 1 << 24:
                    yield from taken()
                    at, depths, trees, places, size = [], [], [], [], 0
            begin = end
        if at:
            yield from taken()


def trace(b, frame: Frame, stage) -> Frame:
    """Span trees: each trace's spans from the roots down, with depth and a drawn branch.  A task holds one trace.

    Spans that are each other's parents have no root: the earliest of them stands as one, so that no span is lost.
    """
    ids = stage.get("trace_id", "trace_id"), stage.get("span_id", "span_id")
    parent = stage.get("parent_id") or stage.get("parent_span_id") or ("parent_id" if "parent_id" in frame.columns else "parent_span_id")
    first = lambda *names: F.coalesce(*(F.nullif(col(n).cast("string"), F.lit("")) for n in names if n in frame.columns), F.lit(None).cast("string"))
    number = F.coalesce(*(col(n).cast("double") for n in ("duration_ms", "duration", "elapsed_ms") if n in frame.columns), F.lit(None).cast("double"))
    # Names of fields are tried in turn (fixed values of the stage's output).
    made = frame.df.select(col("_time").cast("timestamp").alias("_time"), col(ids[0]).cast("string").alias("tid"), F.coalesce(col(ids[1]).cast("string"), F.lit("")).alias("sid"), F.coalesce(col(parent).cast("string"), F.lit("")).alias("pid"), first("service", "service_name", "component").alias("service"), first("operation", "operation_name", "name", "handler").alias("operation"), F.when(~F.isnan(number), number).alias("duration_ms"), col("_time").alias("__at"), *map(col, frame.hidden)).where("tid is not null and tid <> ''")
    # Python is called once a task, not once a trace: rows come sorted, and traces are told apart in their batches.
    made = made.repartition("tid").sortWithinPartitions("tid", "__at", *frame.sort_columns()).drop("__at", *frame.hidden)
    done = made.mapInArrow(drawn, "_time timestamp, tid string, service string, operation string, duration_ms double, _span_depth long, _span_tree string, n long")
    done = done.select("_time", F.col("tid").alias(ids[0]), "service", "operation", "duration_ms", "_span_depth", "_span_tree", F.col("n").alias("__n"))
    out = _new(frame, done, [(col(ids[0]), False), (F.col("__n"), False)])
    return out.having(out.df.drop("__n"))


def topology(b, frame: Frame, stage) -> Frame:
    """Edges with their counts; degrees count events."""
    source, dest = stage.get("source_field", "service"), stage.get("dest_field", "downstream")
    ex = b.exprs(frame)
    s, d = (ex.column(Field(f)).cast("string") for f in (source, dest))
    aggs = [F.count("*").alias("_edge_count")]
    weight = stage.get("weight_field")
    if weight:
        aggs.append(F.sum(ex.column(Field(weight)).cast("double")).alias("_edge_weight"))
    edges = frame.df.where((s != "") & (d != "")).groupBy(s.alias("_source"), d.alias("_destination")).agg(*aggs)
    edges = edges.withColumns({"_source_out_degree": F.sum("_edge_count").over(Window.partitionBy("_source")), "_dest_in_degree": F.sum("_edge_count").over(Window.partitionBy("_destination"))})
    edges = edges.select("_source", "_destination", "_edge_count", "_source_out_degree", "_dest_in_degree", *(["_edge_weight"] if weight else []))
    out = _new(frame, edges, [(F.col("_edge_count"), True), (F.col("_source"), False), (F.col("_destination"), False)])
    if stage.get("max_nodes"):
        out = replace(out, df=out.df.orderBy(*out.sort_columns()).limit(int(stage.args["max_nodes"])))
    return out


def correlate(b, frame: Frame, stage) -> Frame:
    """One row: _correlation, _method, _n, _field1, _field2.  Spearman ranks equal values by their order, unaveraged."""
    f1, f2 = stage.args["fields"]
    method = stage.get("method", "pearson")
    if method not in ("pearson", "spearman"):
        b.fail("S003", f"unknown method `{method}`", stage, "pearson or spearman")
    ex = b.exprs(frame)
    df = frame.df.select(ex.column(Field(f1)).cast("double").alias("x"), ex.column(Field(f2)).cast("double").alias("y"), *map(col, frame.hidden)).where("x is not null and y is not null")
    if method == "spearman":
        order = frame.sort_columns()
        df = numbered(numbered(df, [F.col("x").asc(), *order], "__x"), [F.col("y").asc(), *order], "__y").select(F.col("__x").cast("double").alias("x"), F.col("__y").cast("double").alias("y"))
    r = F.when(F.count("*") >= 2, F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)))
    made = df.agg(r.alias("_correlation"), F.lit(method).alias("_method"), F.count("*").alias("_n"), F.lit(f1).alias("_field1"), F.lit(f2).alias("_field2"))
    return Frame(made, warnings=frame.warnings)


def rollup(b, frame: Frame, stage) -> Frame:
    """Counts per bucket at several resolutions: counted at the common divisor of the spans, then summed up."""
    from math import gcd

    spans, by = [round(s) for s in stage.args["spans"]], stage.args["by"]
    keys, base = _keys(b, frame, by), gcd(*(round(s) for s in stage.args["spans"]))
    names = [a.name for a in by]
    fine = frame.df.groupBy(bin_time(col("_time"), base).alias("__b"), *keys).agg(F.count("*").alias("__n"))
    each = F.array(*(F.struct(F.lit(span_text(s)).alias("r"), F.lit(i).alias("i"), bin_time(F.col("__b"), s).alias("b")) for i, s in enumerate(spans)))
    made = fine.select(F.explode(each).alias("e"), *map(col, names), "__n").groupBy(F.col("e.r").alias("_resolution"), F.col("e.i").alias("__i"), F.col("e.b").alias("_bucket"), *map(col, names)).agg(F.sum("__n").alias("count"))
    out = _new(frame, made, [(F.col("__i"), False), (F.col("_bucket"), False), *((col(n), False) for n in names)])
    return out.having(out.df.drop("__i"))


def xyseries(b, frame: Frame, stage) -> Frame:
    """A row for each x, a column for each y value; the last value of a cell wins."""
    x, y, v = stage.args["fields"]
    ex = b.exprs(frame)
    named = ex.column(Field(y)).cast("string")
    rank = frame.rank()
    df = frame.df.select(ex.column(Field(x)).alias(x), F.coalesce(named, F.lit("")).alias("__y"), ex.column(Field(v)).alias("__v"), rank.alias("__r"))
    # The y values name the output's columns: they are few, or the pivot fails.
    made = df.groupBy(col(x)).pivot("__y").agg(F.max_by("__v", "__r"))
    return _new(frame, made, [(col(x), False)], False)


def glimpse(frame: Frame):
    """A summary of each field (count, mean, spread, quartiles)."""
    return frame.output().summary()


STAGES = {f.__name__: f for f in (facets, describe, patterns, outliers, sessionize, transaction, trace, topology, correlate, rollup, xyseries)}
__all__ = ["STAGES", "HIDDEN", "micros"]
