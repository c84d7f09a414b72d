"""Materialised views: mergeable aggregate state in Parquet, and queries rewritten to read it.

A view is `from <source> | [where|parse|extend ...] | stats <aggs> by <keys>`.  Its table holds partial states, a batch
of rows for each refresh; reading merges them.  Every aggregate is kept as columns that merge by sum, min, max or a
sketch, so a query may also ask for fewer keys, wider time buckets, or any aggregate that the states give.
"""

from __future__ import annotations

import atexit
import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import HIDDEN, Frame, col
from ..functions.types import bin_time
from ..lang.ast import Agg, Assign, Call, Literal, Pipeline, Query, Stage
from ..lang.desugar import Rewrite, desugar_query, show
from ..lang.errors import QueryError, did_you_mean
from ..lang.parser import parse
from ..lang.unparse import unparse
from ..staging import delete, shared_root

SKETCH_LG, KLL_K = 14, 200
PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: States that an aggregate needs, and how each begins and merges.
NEEDS = {"count": ("n",), "sum": ("s", "n"), "avg": ("s", "n"), "min": ("lo",), "max": ("hi",), "range": ("lo", "hi"), "sumsq": ("q", "n"), "stdev": ("n", "s", "m2"), "var": ("n", "s", "m2"), "stdevp": ("n", "s", "m2"), "varp": ("n", "s", "m2"), "estdc": ("hll",)} | {p: ("kll",) for p in PERCENTILES}
#: m2 is the sum of squared distances from the mean.
BEGIN = {"m2": lambda x: F.var_pop(x.cast("double")) * F.count(x), "n": F.count, "s": F.sum, "q": lambda x: F.sum(x.cast("double") * x.cast("double")), "lo": F.min, "hi": F.max, "hll": lambda x: F.hll_sketch_agg(x, F.lit(SKETCH_LG)), "kll": lambda x: F.kll_sketch_agg_double(x.cast("double"), KLL_K)}
MERGE = {"n": F.sum, "s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max, "hll": lambda x: F.hll_union_agg(x), "kll": lambda x: F.kll_merge_agg_double(x)}
ROWS = "rows"


def _state(call: Call, part: str) -> str:
    """The column that holds a part of the state of an aggregate's argument (and condition)."""
    arg = unparse(call.args[0]) if call.args else ROWS
    return f"{part}|{arg}" + (f"|{unparse(call.where)}" if call.where is not None else "")


def _final(call: Call) -> Column:
    """An aggregate from its merged states."""
    get = lambda p: col(_state(call, p))
    name = call.name
    if name == "count":
        return F.coalesce(get("n"), F.lit(0))
    if name == "sum":
        return get("s")
    if name == "avg":
        return F.when(get("n") > 0, get("s") / get("n"))
    if name in ("min", "max"):
        return get("lo" if name == "min" else "hi")
    if name == "range":
        return get("hi") - get("lo")
    if name == "sumsq":
        return get("q")
    if name == "estdc":
        return F.hll_sketch_estimate(get("hll"))
    if name in PERCENTILES:
        return F.kll_sketch_get_quantile_double(get("kll"), F.lit(PERCENTILES[name]))
    n, spread = get("n"), F.greatest(F.lit(0.0), get("m2"))
    var = F.when(n > 1, spread / (n - 1)) if name in ("stdev", "var") else F.when(n > 0, spread / n)
    return F.sqrt(var) if name.startswith("stdev") else var


def shared_folder(spark) -> str:
    """A new folder that driver and executors share, deleted when the driver's Python ends."""
    path = f"{shared_root(spark)}/views-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


@dataclass
class View:
    """status: active, paused or rebuilding; retention in microseconds."""

    name: str
    text: str
    status: str = "active"
    retention: float | None = None
    stages: Pipeline | None = field(default=None, repr=False)

    @property
    def stats(self) -> Stage:
        return self.stages.stages[-1]

    @property
    def prefix(self) -> tuple[str, ...]:
        return tuple(show(s) for s in self.stages.stages[:-1])

    @property
    def keys(self) -> dict[str, Assign]:
        return {unparse(a.value): a for a in self.stats.args["by"]}


class Views:
    """Views of an engine, kept under `root` (a folder that driver and executors share)."""

    def __init__(self, engine, root: str):
        self.engine, self.root, self.views = engine, root.rstrip("/"), {}
        engine.views = self

    # files, by Hadoop, so that any store will do

    def _path(self, *parts: str):
        jvm = self.engine.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return p, p.getFileSystem(self.engine.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self) -> None:
        """Write the definitions beside the states."""
        rows = [json.dumps({"name": v.name, "text": v.text, "status": v.status, "retention": v.retention}) for v in self.views.values()]
        self.engine.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_views")

    def load(self) -> Views:
        for (line,) in self.engine.spark.read.text(f"{self.root}/_views").collect():
            d = json.loads(line)
            self.views[d["name"]] = self._parsed(View(**d))
        return self

    def _parsed(self, view: View) -> View:
        pipeline = desugar_query(parse(view.text, self.engine.fragments)).pipeline
        stages = list(pipeline.stages)
        if stages[-1].name == "materialize":
            view.retention = stages[-1].get("retention", view.retention)
            if stages[-1].get("partition_by"):
                raise QueryError("S042", "views aren't partitioned by fields", stages[-1].at, view.text, "leave partition_by out: states are small")
            stages.pop()
        allowed = {"where", "parse", "extend"}
        bad = next((s for s in stages[1:-1] if s.name not in allowed), None)
        if stages[-1].name != "stats" or bad:
            raise QueryError("S040", f"a view can't hold `{(bad or stages[-1]).name}`", 0, view.text, "from | where, parse, extend ... | stats")
        for a in stages[-1].args["aggs"]:
            if a.call.name not in NEEDS:
                raise QueryError("S041", f"`{a.call.name}` has no mergeable state", a.call.at, view.text, did_you_mean(a.call.name, NEEDS))
        view.stages = Pipeline(tuple(stages))
        return view

    def create(self, text: str, name: str | None = None, backfill: bool = True) -> View:
        """A view of a query that ends in stats, or in `materialize "name"`."""
        last = parse(text, self.engine.fragments).pipeline.stages[-1]
        view = self._parsed(View(name or last.args["name"], text))
        self.views[view.name] = view
        if backfill:
            self.rebuild(view.name)
        return view

    def _partial(self, view: View, source: Frame | None) -> DataFrame:
        """State rows of the view's source, or of `source` in its place."""
        builder = self.engine.builder(Query((), view.stages, view.text))
        frame = builder.run(Pipeline(view.stages.stages[:1])) if source is None else source
        for s in view.stages.stages[1:-1]:
            frame = getattr(builder, f"do_{s.name}")(frame, s)
        ex = builder.exprs(frame)
        made: dict[str, Column] = {}
        calls = [a.call for a in view.stats.args["aggs"]] + [Call("count")]
        for call in calls:
            x = ex.column(call.args[0]) if call.args else F.lit(1)
            if call.where is not None:
                x = F.when(ex.predicate(call.where), x)
            for part in NEEDS[call.name]:
                made[_state(call, part)] = BEGIN[part](x)
        keys = [ex.column(a.value).alias(a.name) for a in view.stats.args["by"]]
        aggs = [c.alias(n) for n, c in made.items()]
        return frame.df.groupBy(*keys).agg(*aggs) if keys else frame.df.agg(*aggs)

    def append(self, name: str, batch: DataFrame | None = None, key: str | None = None) -> None:
        """Add the states of new rows; `key` names the batch, so that a repeated one replaces itself."""
        view = self.views[name]
        if view.status == "paused":
            return
        from ..frame import from_dataframe

        source = None
        if batch is not None:
            source = from_dataframe(batch, time="_time" if "_time" in batch.columns else None)
        self._partial(view, source).write.mode("overwrite").parquet(f"{self.root}/{name}/{self._generation(name)}/batch={key or uuid.uuid4().hex}")

    # A view's states lie in the generation that its pointer names; a new one is written whole before the pointer moves,
    # and the old one goes last, so that a crash leaves one or the other.

    def _generation(self, name: str) -> str:
        for file in ("_current", "_next"):
            p, fs = self._path(name, file)
            if fs.exists(p):
                jvm, stream = self.engine.spark.sparkContext._jvm, fs.open(p)
                try:
                    return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return "first"

    def _replace(self, name: str, states: DataFrame) -> None:
        old, new = self._generation(name), uuid.uuid4().hex
        states.write.parquet(f"{self.root}/{name}/{new}/batch={new}")
        after, fs = self._path(name, "_next")
        out = fs.create(after, True)
        out.write(bytearray(new.encode()))
        out.close()
        now, _ = self._path(name, "_current")
        fs.delete(now, False)
        fs.rename(after, now)
        fs.delete(self._path(name, old)[0], True)

    def rebuild(self, name: str) -> None:
        """The states anew from the source; readers see the old ones until the new ones are whole."""
        view = self.views[name]
        before, view.status = view.status, "rebuilding"
        try:
            self._replace(name, self._partial(view, None))
        finally:
            view.status = before

    def pause(self, name: str) -> None:
        """No more states and no answers until `resume`."""
        self.views[name].status = "paused"

    def resume(self, name: str) -> None:
        self.views[name].status = "active"

    def compact(self, name: str) -> None:
        """Merge all batches into one."""
        self._replace(name, self.merged(self.views[name], None))

    def drop_data(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    def drop(self, name: str) -> None:
        self.views.pop(name)
        self.drop_data(name)

    def expire(self, name: str, now: datetime | None = None) -> None:
        """Remove states older than the view's retention; its keys must have a time bucket."""
        view = self.views[name]
        if view.retention is None:
            return
        low = (now or datetime.now(timezone.utc)) - timedelta(microseconds=view.retention)
        kept = self.merged(view, None).where(col("_time") >= F.lit(low.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
        self._replace(name, kept)

    def merged(self, view: View, by: list[tuple[Column, str]] | None) -> DataFrame:
        """The view's states merged by `by` (columns and names), or by its own keys."""
        df = self.engine.spark.read.parquet(f"{self.root}/{view.name}/{self._generation(view.name)}").drop("batch")
        names = [a.name for a in view.stats.args["by"]]
        keys = [(col(n), n) for n in names] if by is None else by
        aggs = [MERGE[c.split("|")[0]](col(c)).alias(c) for c in df.columns if "|" in c and not c.startswith("m2|")]
        for i, c in enumerate(c for c in df.columns if c.startswith("m2|")):
            # Distances of the parts' means from a mean of theirs are small numbers, whose squares cancel nothing.
            n, s = (col(f"{p}{c[2:]}") for p in ("n", "s"))
            df = df.withColumn(f"__d{i}", s / n - F.avg(s / n).over(Window.partitionBy(*(k for k, _ in keys))))
            d = F.col(f"__d{i}")
            aggs.append((F.sum(col(c)) + F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / F.sum(n)).alias(c))
        return df.groupBy(*(k.alias(n) for k, n in keys)).agg(*aggs) if keys else df.agg(*aggs)

    def read(self, name: str) -> DataFrame:
        """The view's rows, finished."""
        view = self.views[name]
        return self._finish(self.merged(view, None), view.stats.args["aggs"], [a.name for a in view.stats.args["by"]])

    def _finish(self, df: DataFrame, aggs: list[Agg], names: list[str]) -> DataFrame:
        return df.select(*map(col, names), *(_final(a.call).alias(a.name) for a in aggs))

    # rewriting

    def match(self, stages: tuple[Stage, ...]) -> tuple[View, list] | None:
        """A view that can give the last of `stages` (a stats), with its keys as columns of the view."""
        stats = stages[-1]
        prefix = tuple(show(s) for s in stages[:-1])
        for view in self.views.values():
            if view.status not in ("active", "rebuilding") or view.prefix != prefix:
                continue
            if not self.engine.approximate and any(a.call.name in PERCENTILES for a in stats.args["aggs"]):
                continue  # a sketch would answer where the engine is exact
            have = set()
            for a in [*view.stats.args["aggs"], Agg(Call("count"), "")]:
                have |= {_state(a.call, p) for p in NEEDS[a.call.name]}
            if not all(a.call.name in NEEDS and {_state(a.call, p) for p in NEEDS[a.call.name]} <= have for a in stats.args["aggs"]):
                continue
            by, own = [], view.keys
            for a in stats.args["by"]:
                text = unparse(a.value)
                if text in own:
                    by.append((col(own[text].name), a.name))
                    continue
                wide = self._wider(a, own)
                if wide is None:
                    break
                by.append((wide, a.name))
            else:
                return view, by
        return None

    def _wider(self, a: Assign, own: dict[str, Assign]) -> Column | None:
        """A time bucket that is a multiple of the view's."""
        span = lambda c: c.args[1].value if isinstance(c, Call) and c.name == "bin" and isinstance(c.args[1], Literal) else None
        for k in own.values():
            if span(a.value) and span(k.value) and a.value.args[0] == k.value.args[0] and span(a.value) % span(k.value) == 0:
                return bin_time(col(k.name), span(a.value))
        return None

    def rewrite(self, query: Query, rewrites: list[Rewrite] | None = None) -> Query:
        stages = query.pipeline.stages
        at = next((i for i, s in enumerate(stages) if s.name == "stats"), None)
        if at is None or (found := self.match(stages[: at + 1])) is None:
            return query
        view, by = found
        scan = Stage("viewscan", {"view": view.name, "stats": stages[at], "by": by}, stages[at].at)
        if rewrites is not None:
            rewrites.append(Rewrite(" | ".join(map(show, stages[: at + 1])), f'view "{view.name}"'))
        return Query(query.lets, Pipeline((scan, *stages[at + 1 :])), query.text)

    def scan(self, stage: Stage) -> Frame:
        view, stats, by = self.views[stage.args["view"]], stage.args["stats"], stage.args["by"]
        df = self._finish(self.merged(view, by), stats.args["aggs"], [n for _, n in by])
        return Frame(df).ordered_by([(col(n), False) for _, n in by], keep=False, is_sorted=False)


__all__ = ["HIDDEN", "View", "Views"]
