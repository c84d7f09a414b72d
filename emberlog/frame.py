"""A DataFrame with its arrival order, and builders of columns that respect it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = "__o"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))


@dataclass(frozen=True)
class Order:
    """One key of the row order; nulls are last ascending and first descending."""

    name: str
    desc: bool = False

    def sort(self) -> Column:
        return col(self.name).desc_nulls_first() if self.desc else col(self.name).asc_nulls_last()

    def reverse(self) -> Column:
        return col(self.name).asc_nulls_last() if self.desc else col(self.name).desc_nulls_first()


@dataclass(frozen=True)
class Frame:
    """df: visible columns and hidden order keys (names beginning with HIDDEN); order: the keys, most significant first;
    sorted: the output is to come in this order; warnings: what the user should know."""

    df: DataFrame
    order: tuple[Order, ...] = ()
    sorted: bool = False
    time: str = "_time"
    streaming: bool = False
    warnings: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def having(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def warn(self, text: str) -> Frame:
        return replace(self, warnings=(*self.warnings, text))

    def select(self, *columns: Column) -> Frame:
        """New visible columns; the order keys go along."""
        return self.having(self.df.select(*columns, *map(col, self.hidden)))

    def ordered_by(self, keys: list[tuple[Column, bool]], keep: bool = True, is_sorted: bool = True) -> Frame:
        """Order by `keys` (column, descending), then by the present order."""
        before = self.order if keep else ()
        final = [f"{HIDDEN}{i}" for i in range(len(keys) + len(before))]
        made = [k.alias(n) for (k, _), n in zip(keys, final)] + [col(o.name).alias(n) for o, n in zip(before, final[len(keys) :])]
        order = [Order(n, d) for (_, d), n in zip(keys, final)] + [Order(n, o.desc) for o, n in zip(before, final[len(keys) :])]
        return replace(self, df=self.df.select(*map(col, self.columns), *made), order=tuple(order), sorted=is_sorted)

    def sort_columns(self, reverse: bool = False) -> list[Column]:
        return [o.reverse() if reverse else o.sort() for o in self.order]

    def rank(self) -> Column:
        """A struct that compares as rows are ordered.

        Descending keys are turned: numbers and timestamps are negated, others have their characters turned.
        """
        parts = []
        for i, o in enumerate(self.order):
            c, kind = col(o.name), self.kind(o.name)
            if o.desc:
                parts.append(c.isNotNull().alias(f"n{i}"))
                if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                    c = -F.unix_micros(c.cast("timestamp"))
                elif isinstance(kind, T.BooleanType):
                    c = ~c
                elif isinstance(kind, T.NumericType):
                    c = -c
                else:
                    c = F.transform(F.split(c.cast("string"), ""), lambda x: -F.ascii(x))
                    c = F.concat(c, F.array(F.lit(1)))  # a longer text is greater, so it comes first here
            else:
                parts.append(c.isNull().alias(f"n{i}"))
            parts.append(c.alias(f"v{i}"))
        return F.struct(*parts) if parts else F.struct(F.lit(0).alias("v"))

    def output(self) -> DataFrame:
        """Without hidden columns, in order if a sort asks for it."""
        df = self.df
        if self.sorted and self.order and not self.streaming:
            df = df.orderBy(*self.sort_columns())
        return df.select(*map(col, self.columns))


def from_dataframe(df: DataFrame, order: list[str] | None = None, time: str | None = None) -> Frame:
    """A frame over any DataFrame; `order` names columns that tell rows apart, `time` the event time."""
    if time and time != "_time" and "_time" not in df.columns:
        df = df.withColumn("_time", col(time))
    frame = Frame(df, streaming=df.isStreaming)
    if order and not df.isStreaming:
        frame = frame.ordered_by([(col(o), False) for o in order], keep=False, is_sorted=False)
    return frame
