"""The engine: queries over named sources, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .frame import Frame, from_dataframe
from .lang.ast import Pipeline, Query
from .lang.desugar import Rewrite, desugar_query, show, show_query
from .lang.lint import Lint, lint
from .lang.parser import parse
from .plans.build import Builder
from .session import configure
from .sources.catalog import Catalog


@dataclass
class Result:
    """A query's frame, and what has been done to its text."""

    frame: Frame
    query: Query
    rewrites: list[Rewrite] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.frame.output()

    @property
    def warnings(self) -> tuple[str, ...]:
        return self.frame.warnings


class Engine:
    """strict_fields: unknown fields are errors instead of nulls; approximate: percentiles by sketches; fragments: texts
    for `use`; tee: whether tee may write files."""

    def __init__(self, spark: SparkSession, strict_fields: bool = False, approximate: bool = False, fragments: dict[str, str] | None = None, tee: bool = False):
        self.spark = configure(spark)
        self.catalog = Catalog(spark)
        self.strict_fields, self.approximate, self.fragments, self.tee = strict_fields, approximate, fragments or {}, tee
        self.views = None

    def source(self, name: str, df, **options) -> Engine:
        """Name a DataFrame (or a function that makes one): order=[...], time=..., raw=..."""
        self.catalog.add(name, df, **options)
        return self

    def builder(self, query: Query, now: datetime | None = None) -> Builder:
        return Builder(self.catalog, dict(query.lets), now, query.text, self.strict_fields, self.approximate, self._tee if self.tee else None, self.views)

    def _tee(self, sink: str, frame: Frame) -> None:
        frame.output().write.mode("append").json(sink)

    def run(self, text: str, now: datetime | None = None) -> Result:
        rewrites: list[Rewrite] = []
        query = desugar_query(parse(text, self.fragments), rewrites)
        if self.views is not None:
            query = self.views.rewrite(query, rewrites)
        return Result(self.builder(query, now).run(query.pipeline), query, rewrites)

    def query(self, text: str, now: datetime | None = None) -> DataFrame:
        return self.run(text, now).df

    def explain(self, text: str) -> str:
        """The query in core stages, one a line, and Spark's plan."""
        found = self.run(text)
        plan = found.df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join(map(show, found.query.pipeline.stages)) + "\n\n" + plan

    def lint(self, text: str) -> list[Lint]:
        return lint(parse(text, self.fragments))

    def format(self, text: str) -> str:
        """The canonical spelling of a query."""
        return show_query(parse(text, self.fragments))

    def frame(self, df: DataFrame, **options) -> LogFrame:
        return LogFrame(self, from_dataframe(df, **options))


class LogFrame:
    """Stages by method: each takes the text of a stage's arguments, `frame.where('status >= 500').stats('count()')`."""

    def __init__(self, engine: Engine, frame: Frame):
        self.engine, self.frame = engine, frame

    def __getattr__(self, name: str):
        from .lang.parser import STAGES

        if name not in STAGES or name == "from":
            raise AttributeError(name)
        return lambda args="": self.pipe(f"{name} {args}")

    def pipe(self, stages: str) -> LogFrame:
        query = desugar_query(parse(f"from main | {stages}", self.engine.fragments))
        inner = Engine(self.engine.spark, self.engine.strict_fields, self.engine.approximate, self.engine.fragments, self.engine.tee)
        inner.catalog.makers = dict(self.engine.catalog.makers) | {"main": lambda: self.frame}
        return LogFrame(self.engine, inner.builder(query).run(Pipeline(query.pipeline.stages)))

    @property
    def df(self) -> DataFrame:
        return self.frame.output()
