"""Expressions of the language as Spark columns, with the type checks that Spark would paper over."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, col
from ..functions import aggregates as A
from ..functions import scalar as S
from ..functions.types import NUMERIC, duration, kind_of, micros, of_micros, seconds
from ..lang.ast import Array, Between, Binary, Call, Field, Index, Lambda, Literal, Member, Object, Unary
from ..lang.errors import QueryError, did_you_mean
from ..lang.unparse import flat_name, unparse

ALIASES = {"source": "_source", "sourcetype": "_sourcetype"}


class Exprs:
    """Compiles the expressions of one stage over one frame."""

    def __init__(self, frame: Frame, now: datetime | None = None, text: str = "", strict_fields: bool = False):
        self.frame, self.now, self.text, self.strict_fields = frame, now or datetime.now(timezone.utc), text, strict_fields
        self.names = set(frame.columns)
        self.locals: dict[str, S.Arg] = {}
        self.missing: list[str] = []

    def error(self, code: str, message: str, node, hint: str = ""):
        raise QueryError(code, message, getattr(node, "at", 0), self.text, hint)

    def column(self, node) -> Column:
        return self.compile(node).col

    def type_of(self, c: Column) -> T.DataType | None:
        """The type that Spark gives a column; unknown inside a lambda."""
        if self.locals:
            return None
        try:
            return self.frame.df.select(c.alias("x")).schema["x"].dataType
        except AnalysisException as e:
            raise QueryError("S002", str(e).split("\n")[0][:300], 0, self.text) from None

    def typed(self, c: Column, kind: str | None = None, node=None) -> S.Arg:
        if kind is None:
            t = self.type_of(c)
            kind = kind_of(t) if t is not None else "unknown"
        return S.Arg(c, kind, node=node)

    def predicate(self, node) -> Column:
        found = self.compile(node)
        if found.kind not in ("bool", "null", "unknown"):
            self.error("S004", f"`{unparse(node)}` is {found.kind}, not bool", node)
        return found.col.cast("boolean") if found.kind == "null" else found.col

    # nodes

    def compile(self, node) -> S.Arg:
        return getattr(self, f"on_{type(node).__name__.lower()}")(node)

    def on_literal(self, n: Literal) -> S.Arg:
        if n.kind == "duration":
            return S.Arg(duration(n.value), "duration", n.value, True)
        if n.kind == "timestamp":
            return S.Arg(F.lit(n.value).cast("timestamp"), "timestamp", n.value, True)
        if n.kind == "int":
            return S.Arg(F.lit(n.value).cast("bigint"), "int", n.value, True)
        return S.Arg(F.lit(n.value), n.kind, n.value, True)

    def on_field(self, n: Field) -> S.Arg:
        if n.name in self.locals:
            return self.locals[n.name]
        name = n.name if n.name in self.names else ALIASES.get(n.name, n.name)
        if name in self.names:
            return S.Arg(col(name), kind_of(self.frame.kind(name)), node=n)
        return self.absent(n.name, n)

    def absent(self, name: str, node) -> S.Arg:
        if self.strict_fields:
            self.error("S001", f"unknown field `{name}`", node, did_you_mean(name, self.names))
        self.missing.append(name)
        return S.Arg(F.lit(None).cast("string"), "null", None, False, node)

    def is_absent(self, node) -> bool:
        name = flat_name(node)
        root = node
        while isinstance(root, (Member, Index)):
            root = root.target
        return name is not None and name not in self.names and name not in self.locals and not (isinstance(root, Field) and (root.name in self.names or root.name in self.locals or ALIASES.get(root.name) in self.names))

    def on_member(self, n: Member) -> S.Arg:
        flat = flat_name(n)
        if flat in self.names:
            return S.Arg(col(flat), kind_of(self.frame.kind(flat)), node=n)
        if self.is_absent(n):
            return self.absent(flat, n)
        return self.access(self.compile(n.target), n.name, n)

    def access(self, target: S.Arg, name: str, node) -> S.Arg:
        t = self.type_of(target.col)
        if isinstance(t, T.StructType):
            if name not in t.names:
                return S.Arg(F.lit(None).cast("string"), "null")
            return S.Arg(target.col.getField(name), kind_of(t[name].dataType), node=node)
        if isinstance(t, T.MapType):
            return S.Arg(F.try_element_at(target.col, F.lit(name)), kind_of(t.valueType), node=node)
        if isinstance(t, T.VariantType):
            return S.Arg(F.try_variant_get(target.col, f'$["{name}"]', "string"), "string", node=node)
        if t is None:
            return S.Arg(target.col.getField(name), "unknown", node=node)
        return S.Arg(F.lit(None).cast("string"), "null")

    def on_index(self, n: Index) -> S.Arg:
        target = self.compile(n.target)
        if isinstance(n.index, Literal) and n.index.kind == "string":
            return self.access(target, n.index.value, n)
        i = self.compile(n.index)
        at = i.col.cast("int")
        t = self.type_of(target.col)
        if isinstance(t, T.MapType):
            return self.typed(F.try_element_at(target.col, i.col), kind_of(t.valueType))
        found = F.try_element_at(target.col, F.when(at >= 0, at + 1).otherwise(at))
        return self.typed(found, kind_of(t.elementType) if isinstance(t, T.ArrayType) else "unknown")

    def on_array(self, n: Array) -> S.Arg:
        items = [self.compile(x) for x in n.items]
        kinds = {i.kind for i in items} - {"null"}
        if len(kinds) > 1 and not kinds <= NUMERIC:  # a mixed literal holds the string forms
            return S.Arg(F.array(*(S.string(i) for i in items)), "array")
        return S.Arg(F.array(*(i.col for i in items)), "array")

    def on_object(self, n: Object) -> S.Arg:
        return S.Arg(F.struct(*(self.compile(v).col.alias(k) for k, v in n.items)), "object")

    def on_unary(self, n: Unary) -> S.Arg:
        if n.op == "not":
            return S.Arg(~self.predicate(n.arg), "bool")
        a = self.compile(n.arg)
        return S.Arg(of_micros(-micros(a.col)) if a.kind == "duration" else -a.col, a.kind)

    def on_between(self, n: Between) -> S.Arg:
        v, lo, hi = (self.compile(x) for x in (n.value, n.low, n.high))
        v, lo = self.comparable(v, lo, n)
        _, hi = self.comparable(v, hi, n)
        return S.Arg((v.col >= lo.col) & (v.col <= hi.col), "bool")

    def comparable(self, a: S.Arg, b: S.Arg, node) -> tuple[S.Arg, S.Arg]:
        known = {a.kind, b.kind} - {"null", "unknown"}
        if len(known) > 1 and not known <= NUMERIC:
            cast = {"int": "int", "float": "float", "string": "string", "bool": "bool", "timestamp": "timestamp"}.get(a.kind, "string")
            self.error("S002", f"{a.kind} and {b.kind} don't compare", node, f"cast one side: {cast}(...)")
        return a, b

    def on_binary(self, n: Binary) -> S.Arg:
        op = n.op
        if op in ("and", "or"):
            a, b = self.predicate(n.left), self.predicate(n.right)
            return S.Arg(a & b if op == "and" else a | b, "bool")
        if op == "in":
            return self.membership(n)
        a, b = self.compile(n.left), self.compile(n.right)
        if op == "??":
            kind = a.kind if a.kind != "null" else b.kind
            if a.kind == "null":
                return S.Arg(b.col, b.kind)
            return S.Arg(F.coalesce(a.col, b.col), "float" if {a.kind, b.kind} == NUMERIC else kind)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            a, b = self.comparable(a, b, n)
            made = {"==": a.col == b.col, "!=": a.col != b.col, "<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}
            return S.Arg(made[op], "bool")
        return self.arithmetic(op, a, b, n)

    def membership(self, n: Binary) -> S.Arg:
        a = self.compile(n.left)
        if isinstance(n.right, Array):
            items = [self.compile(x) for x in n.right.items]
            for i in items:
                self.comparable(a, i, n)
            return S.Arg(a.col.isin(*(i.col for i in items)) if items else F.lit(False), "bool")
        b = self.compile(n.right)
        if b.kind not in ("array", "unknown"):
            self.error("S003", f"`in` takes an array, not {b.kind}", n)
        return S.Arg(F.array_contains(b.col, a.col), "bool")

    def arithmetic(self, op: str, a: S.Arg, b: S.Arg, n) -> S.Arg:
        x, y, kinds = a.col, b.col, (a.kind, b.kind)
        if "null" in kinds:
            other = kinds[0] if kinds[1] == "null" else kinds[1]
            kind = other if other in NUMERIC else "null"
            return S.Arg(F.lit(None).cast({"int": "bigint", "float": "double"}.get(kind, "string")), kind)
        if op == "+" and kinds == ("string", "string"):
            return S.Arg(F.concat(x, y), "string")
        if "string" in kinds or "bool" in kinds:
            which = "string" if "string" in kinds else "bool"
            self.error("S003", f"`{op}` takes no {which} beside {kinds[1] if kinds[0] == which else kinds[0]}", n, "cast it with int(...), float(...) or string(...)")
        if "timestamp" in kinds or "duration" in kinds:
            return self.time_arithmetic(op, a, b, n)
        kind = "int" if kinds == ("int", "int") else "unknown" if "unknown" in kinds else "float"
        if op == "+":
            return S.Arg(x + y, kind)
        if op == "-":
            return S.Arg(x - y, kind)
        if op == "*":
            return S.Arg(x * y, kind)
        if op == "%":
            return S.Arg(F.when(y != 0, x % y), kind)
        if kind == "int":
            return S.Arg(F.when(y != 0, F.call_function("div", x, y)), "int")
        return S.Arg(F.when(y != 0, x / y), "float")

    def time_arithmetic(self, op: str, a: S.Arg, b: S.Arg, n) -> S.Arg:
        x, y, kinds = a.col, b.col, (a.kind, b.kind)
        if kinds == ("timestamp", "timestamp") and op == "-":
            return S.Arg(x - y, "duration")
        if kinds == ("timestamp", "duration") and op in "+-":
            return S.Arg(x + y if op == "+" else x - y, "timestamp")
        if kinds == ("duration", "timestamp") and op == "+":
            return S.Arg(y + x, "timestamp")
        if kinds == ("duration", "duration"):
            if op in "+-":
                return S.Arg(x + y if op == "+" else x - y, "duration")
            if op == "/":
                return S.Arg(F.when(seconds(y) != 0, seconds(x) / seconds(y)), "float")
        if kinds[0] == "duration" and kinds[1] in NUMERIC and op in "*/":
            us = micros(x).cast("double")
            return S.Arg(of_micros((us * y if op == "*" else F.when(y != 0, us / y)).cast("bigint")), "duration")
        if kinds[1] == "duration" and kinds[0] in NUMERIC and op == "*":
            return S.Arg(of_micros((micros(y).cast("double") * x).cast("bigint")), "duration")
        self.error("S003", f"`{op}` isn't defined for {kinds[0]} and {kinds[1]}", n)

    def on_lambda(self, n: Lambda):
        self.error("S003", "a lambda can only be an argument of any, all, filter and map", n)

    # calls

    def on_call(self, n: Call) -> S.Arg:
        if n.name in S.HIGHER:
            return self.higher(n)
        if n.name == "now":
            return S.Arg(F.lit(self.now.isoformat()).cast("timestamp"), "timestamp", self.now.isoformat(), True)
        if n.name in ("is_missing", "is_null", "exists") and len(n.args) == 1 and self.is_absent(n.args[0]):
            return S.Arg(F.lit(n.name == "is_missing"), "bool")
        if n.name == "is_missing":
            return S.Arg(F.lit(False), "bool")
        f = S.REGISTRY.get(n.name)
        if f is None:
            if n.name in A.REGISTRY or n.name in A.WINDOW_ONLY:
                self.error("S005", f"`{n.name}` is an aggregate", n, "use it in stats, eventstats or streamstats")
            self.error("S006", f"unknown function `{n.name}`", n, did_you_mean(n.name, [*S.REGISTRY, *S.HIGHER, "now"]))
        if not f.least <= len(n.args) <= f.most:
            self.error("S007", f"`{n.name}` takes {f.least if f.least == f.most else f'{f.least} to {f.most}'} arguments, not {len(n.args)}", n)
        args = [self.compile(a) for a in n.args]
        if n.name == "keys" or n.name == "values" or n.name in ("merge", "has_key"):
            args = [self.as_map(a) if a.kind == "object" else a for a in args]
        try:
            found = f.build(*args)
        except ValueError as e:
            self.error("S003", f"{n.name}: {e}", n)
        if n.strict:
            if not f.strict:
                self.error("S006", f"`{n.name}` has no strict form", n)
            why = F.concat(F.lit(f"{n.name}! can't convert "), args[0].col.cast("string"))
            found = F.when(args[0].col.isNotNull() & found.isNull(), F.raise_error(why)).otherwise(found)
        return self.typed(found, KINDS.get(n.name), n)

    def as_map(self, a: S.Arg) -> S.Arg:
        """An object as a map of strings, if it isn't a map."""
        t = self.type_of(a.col)
        if isinstance(t, T.StructType):
            kinds = {kind_of(f.dataType) for f in t.fields}
            value = (lambda f: a.col.getField(f.name)) if len(kinds) == 1 else (lambda f: S.string(S.Arg(a.col.getField(f.name), kind_of(f.dataType))))
            return S.Arg(F.create_map(*(x for f in t.fields for x in (F.lit(f.name), value(f)))), "object")
        return a

    def higher(self, n: Call) -> S.Arg:
        if len(n.args) != 2 or not isinstance(n.args[1], Lambda):
            self.error("S007", f"`{n.name}` takes an array and a lambda", n)
        arr, fn = self.compile(n.args[0]), n.args[1]
        t = self.type_of(arr.col)
        element = t.elementType if isinstance(t, T.ArrayType) else None

        def body(x: Column) -> Column:
            before = dict(self.locals)
            self.locals[fn.param] = S.Arg(x, kind_of(element) if element is not None else "unknown")
            try:
                return self.compile(fn.body).col
            finally:
                self.locals = before

        return S.Arg(S.HIGHER[n.name](arr.col, body), "bool" if n.name in ("any", "all") else "array")

    # aggregates

    def aggregate(self, call: Call, ctx: A.Context) -> Column:
        f = A.REGISTRY.get(call.name)
        if f is None:
            hint = did_you_mean(call.name, [*A.REGISTRY, *A.WINDOW_ONLY])
            self.error("S006", f"unknown aggregate `{call.name}`", call, hint if call.name not in A.WINDOW_ONLY else "use it in streamstats")
        if not f.least <= len(call.args) <= f.most:
            self.error("S007", f"`{call.name}` takes {f.least} to {f.most} arguments, not {len(call.args)}", call)
        args: list = [self.compile(a) for a in call.args]
        if args and call.name in NUMERIC_ONLY and args[0].kind not in (*NUMERIC, "null", "unknown", "duration"):
            self.error("S003", f"`{call.name}` takes numbers, not {args[0].kind}", call)
        first = args[0].col if args else None
        if args and args[0].kind == "null" and call.name in NUMERIC_ONLY:
            first = first.cast("double")
        if call.where is not None:
            first = F.when(self.predicate(call.where), F.lit(1) if first is None else first)
        rest = [a.value for a in args[1:]]
        return f.build(ctx, *([] if first is None else [first]), *rest)


KINDS = {"matches": "bool", "has": "bool", "contains": "bool", "contains_cs": "bool", "glob": "bool", "starts_with": "bool", "ends_with": "bool", "exists": "bool", "is_null": "bool", "cidr_match": "bool", "has_key": "bool", "lower": "string", "upper": "string", "string": "string", "len": "int", "int": "int", "float": "float", "round": "float", "floor": "int", "ceil": "int", "bool": "bool", "bin": "timestamp", "strftime": "string", "day_of_week": "int", "timestamp": "timestamp", "strptime": "timestamp", "duration": "duration"}
NUMERIC_ONLY = {"sum", "avg", "stdev", "var", "stdevp", "varp", "perc", "p25", "p50", "p75", "p90", "p95", "p99", "range", "sumsq", "per_second", "per_minute", "per_hour", "per_day"}
