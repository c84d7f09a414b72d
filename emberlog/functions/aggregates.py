"""Aggregates: what each is over a group, and over a window of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import seconds

#: Relative error of `estdc`: that of a HyperLogLog sketch of 2^14 registers.
HLL_LG, RSD = 14, 0.008
#: Aggregates whose state is wide from the first row on (26 KB for `estdc`).
WIDE = {"estdc"}


@dataclass
class Context:
    """order: makes the row order as one comparable column, `rank`; time: the event time; span: seconds of a bucket, if grouped by
    one; window: whether the aggregate runs over a window; approximate: percentiles by sketches."""

    order: Callable[[], Column]
    time: Column | None
    span: float | None = None
    window: bool = False
    approximate: bool = False

    @property
    def rank(self) -> Column:
        return self.order()


@dataclass(frozen=True)
class Aggregate:
    least: int
    most: int
    build: Callable[..., Column]  # (context, condition applied to the arguments, *arguments)


REGISTRY: dict[str, Aggregate] = {}


def register(name: str, least: int, most: int | None = None):
    def put(build):
        REGISTRY[name] = Aggregate(least, least if most is None else most, build)
        return build

    return put


def plain(name: str, fn) -> None:
    REGISTRY[name] = Aggregate(1, 1, lambda ctx, x: fn(x))


@register("count", 0, 1)
def count(ctx, x=None):
    return F.count(F.lit(1) if x is None else x)


plain("sum", F.sum)
plain("avg", F.avg)
plain("min", F.min)
plain("max", F.max)
plain("stdev", F.stddev_samp)
plain("var", F.var_samp)
plain("stdevp", F.stddev_pop)
plain("varp", F.var_pop)
plain("sumsq", lambda x: F.sum(x * x))
plain("range", lambda x: F.max(x) - F.min(x))


@register("dc", 1)
def dc(ctx, x):
    return F.size(F.collect_set(x)).cast("bigint") if ctx.window else F.countDistinct(x)


@register("estdc", 1)
def estdc(ctx, x):
    return F.approx_count_distinct(x, RSD)


@register("estdc_error", 1)
def estdc_error(ctx, x):
    return F.max(F.lit(1.04 / 2 ** (HLL_LG / 2)))


def percentile(ctx: Context, x: Column, p: float) -> Column:
    if ctx.approximate and not ctx.window:
        return F.percentile_approx(x.cast("double"), p / 100, 10_000)
    return F.percentile(x.cast("double"), p / 100)


@register("perc", 2)
def perc(ctx, x, p):
    return percentile(ctx, x, float(p))


for _p in (25, 50, 75, 90, 95, 99):
    for _name in (f"p{_p}", f"perc{_p}"):
        REGISTRY[_name] = Aggregate(1, 1, lambda ctx, x, _p=_p: percentile(ctx, x, _p))


@register("mode", 1)
def mode(ctx, x):
    return F.mode(x, deterministic=True)


def _ends(pick):
    return lambda ctx, x: pick(x, F.when(x.isNotNull(), ctx.rank))


REGISTRY["first"] = Aggregate(1, 1, _ends(F.min_by))
REGISTRY["last"] = Aggregate(1, 1, _ends(F.max_by))


def _by_time(pick):
    def build(ctx, x):
        return pick(x, F.when(x.isNotNull(), F.struct(ctx.time.alias("t"), ctx.rank.alias("r"))))

    return build


REGISTRY["earliest"] = Aggregate(1, 1, _by_time(F.min_by))
REGISTRY["latest"] = Aggregate(1, 1, _by_time(F.max_by))


def _epoch(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1e6


@register("earliest_time", 0, 1)
def earliest_time(ctx, x=None):
    return _epoch(F.min(ctx.time if x is None else F.when(x.isNotNull(), ctx.time)))


@register("latest_time", 0, 1)
def latest_time(ctx, x=None):
    return _epoch(F.max(ctx.time if x is None else F.when(x.isNotNull(), ctx.time)))


@register("values", 1)
def values(ctx, x):
    return F.array_sort(F.collect_set(x))


@register("list", 1)
def list_(ctx, x):
    rows = F.collect_list(F.when(x.isNotNull(), F.struct(ctx.rank.alias("r"), x.alias("x"))))
    return F.transform(F.array_sort(rows), lambda s: s["x"])


def _span(ctx: Context) -> Column:
    """Seconds that a group covers: its bucket, or from its first to its last event."""
    if ctx.span:
        return F.lit(ctx.span)
    return F.nullif(seconds(F.max(ctx.time) - F.min(ctx.time)), F.lit(0.0))


@register("rate", 0, 1)
def rate(ctx, x=None):
    return count(ctx, x) / _span(ctx)


def _per(scale: float):
    return lambda ctx, x: F.sum(x) * scale / _span(ctx)


for _name, _scale in (("per_second", 1.0), ("per_minute", 60.0), ("per_hour", 3600.0), ("per_day", 86400.0)):
    REGISTRY[_name] = Aggregate(1, 1, _per(_scale))

#: Functions of streamstats only: name to (least, most) arguments.
WINDOW_ONLY = {"lag": (1, 2), "lead": (1, 2), "row_number": (0, 0), "running_sum": (1, 1), "moving_avg": (2, 2)}
