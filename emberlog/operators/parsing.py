"""The parse stage: formats as columns over the input text.

A format is compiled to `Parsed`: whether the row parsed, and a column for each field.  Formats of fixed fields match
one regular expression once, whose groups go into an array.  Formats whose fields depend on the data (json, logfmt,
kv, w3c, extensions of cef and leef) take the fields of `into`, or those found by an aggregation over all rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, col
from ..functions.scalar import Arg, bool_, duration_, groups, java_regex
from ..functions.scalar import timestamp as to_timestamp
from ..functions.types import kind_of
from ..lang.ast import Field
from ..lang.errors import QueryError

MARK, SEP = "\u0002", "\u0001"


@dataclass
class Parsed:
    ok: Column
    fields: dict[str, Column]
    name: str


def typed(c: Column, kind: str | None) -> Column:
    a = Arg(c, "string")
    if kind in (None, "string", "rest"):
        return c
    if kind == "int":
        return F.trim(c).try_cast("bigint")
    if kind == "float":
        return F.trim(c).try_cast("double")
    if kind == "bool":
        return bool_(a)
    if kind == "timestamp":
        return to_timestamp(a)
    if kind == "duration":
        return duration_(a)
    raise QueryError("E033", f"unknown type `{kind}`", hint="string, int, float, bool, timestamp or duration")


class Input:
    """The text that a stage parses, and what helps to settle its fields."""

    def __init__(self, frame: Frame, text: Column, into: list[tuple[str, str | None]]):
        self.frame, self.text, self.into = frame, text, into
        self.made: dict[str, Column] = {}  # intermediate columns, computed once

    def texts(self) -> DataFrame:
        """All texts, in column t."""
        if self.frame.streaming:
            raise QueryError("S022", "a stream's fields can't be found beforehand", hint="declare them: into (name as type, ...)")
        return self.frame.df.select(self.text.alias("t")).where("t is not null")

    def found(self, pairs: Callable[[str], Iterable[tuple[str, str]]]) -> dict[str, set[str]]:
        """The kinds of each field that `pairs` finds in any row; in order of least place in a row, then name."""

        def run(batches):
            least: dict[tuple[str, str], int] = {}
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    for at, pair in enumerate(pairs(line)):
                        if at < least.get(pair, at + 1):
                            least[pair] = at
            names, kinds = ([pair[i] for pair in least] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(least.values(), pa.int32())], ["name", "kind", "at"])

        rows = self.texts().mapInArrow(run, "name string, kind string, at int").groupBy("name", "kind").agg(F.min("at").alias("at")).collect()
        out: dict[str, set[str]] = {}
        first: dict[str, int] = {}
        for r in rows:
            first[r["name"]] = min(r["at"], first.get(r["name"], r["at"]))
        for r in sorted(rows, key=lambda r: (first[r["name"]], r["name"])):
            out.setdefault(r["name"], set()).add(r["kind"])
        return out

    def keep(self, c: Column) -> Column:
        """A column computed before the fields are taken from it."""
        name = f"__p{len(self.made)}"
        self.made[name] = c
        return F.col(name)

    def groups_of(self, whole: str, part: str, numbers: Iterable[int]) -> Column:
        """The groups of a pattern by one replacement, the first after MARK; `whole` matches all of the text and `part`
        what is looked for.  A text that holds the marks itself is matched once for each group."""
        to = MARK + SEP.join(f"${i}" for i in numbers)
        each = [F.regexp_extract(self.text, part, i) for i in numbers]
        odd = F.array(F.concat(F.lit(MARK), each[0]), *each[1:]) if each else F.array(F.lit(MARK))
        odd = F.when(F.rlike(self.text, F.lit(part)), odd).otherwise(F.array(F.lit("")))
        return F.when(F.rlike(self.text, F.lit(f"[{MARK}{SEP}]")), odd).otherwise(F.split(F.regexp_replace(self.text, whole, to), SEP))

    def match(self, pattern: str, flags: str = "(?s)") -> tuple[Column, list[Column]]:
        """Whether the pattern matches the whole text, and its groups; an empty group is null."""
        n = groups(pattern)
        whole = f"{flags}^{java_regex(pattern)}$"
        got = self.keep(self.groups_of(whole, whole, range(1, n + 1)))
        ok = F.startswith(F.element_at(got, 1), F.lit(MARK))
        part = lambda i: F.when(ok, F.nullif(F.regexp_replace(F.try_element_at(got, F.lit(i + 1)), f"^{MARK}", "") if i == 0 else F.try_element_at(got, F.lit(i + 1)), F.lit("")))
        return F.coalesce(ok, F.lit(False)), [part(i) for i in range(n)]


def infer(value: str) -> str:
    if re.fullmatch(r"true|false", value, re.I):
        return "bool"
    if re.fullmatch(r"[-+]?\d{1,18}", value):
        return "int"
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.?\d+)([eE][-+]?\d+)?", value):
        return "float"
    return "string"


def widest(kinds: set[str]) -> str:
    kinds = kinds - {"null"}
    return kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "string"


# Formats of fixed fields


def fixed(name: str, pattern: str, fields: list[tuple[str, str | None]], dash: bool = False):
    def build(inp: Input, options: dict) -> Parsed:
        ok, parts = inp.match(pattern)
        made = {}
        for (f, kind), p in zip(fields, parts):
            if f:
                made[f] = typed(F.nullif(p, F.lit("-")) if dash else p, kind)
        return Parsed(ok, made, name)

    return build


_REQUEST = r'"((\S+) (\S+)(?: (\S+))?|[^"]*)"'
_COMMON = r"\s*(\S+) (\S+) (\S+) \[([^\]]+)\] " + _REQUEST + r" (\d{3}|-) (\d+|-)"
_COMMON_FIELDS = [("client_ip", None), ("ident", None), ("user", None), ("timestamp", None), ("request", None), ("method", None), ("uri", None), ("protocol", None), ("status", "int"), ("bytes", "int")]
combined = fixed("combined", _COMMON + r'(?: "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)")?.*', [*_COMMON_FIELDS, ("referer", None), ("user_agent", None)], dash=True)
clf = fixed("clf", _COMMON + r".*", _COMMON_FIELDS, dash=True)

#: Names by code (fixed values of the syslog protocol).
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")


def syslog(inp: Input, options: dict) -> Parsed:
    new_ok, new = inp.match(r"\s*<(\d{1,3})>(\d) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?")
    old_ok, old = inp.match(r"\s*(?:<(\d{1,3})>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?(.*)")
    both = lambda a, b: F.when(new_ok, F.nullif(a, F.lit("-"))).when(old_ok, b)
    none = F.lit(None).cast("string")
    priority = both(new[0], old[0]).try_cast("bigint")
    facility, severity = F.shiftright(priority, 3), F.pmod(priority, F.lit(8))
    named = lambda names, c: F.try_element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    made = {"priority": priority, "facility": facility, "severity": severity, "facility_name": named(FACILITIES, facility), "severity_name": named(SEVERITIES, severity), "format": F.when(new_ok, F.lit("rfc5424")).when(old_ok, F.lit("rfc3164")), "timestamp": both(new[2], old[1]), "hostname": both(new[3], old[2]), "appname": both(new[4], old[3]), "procid": both(new[5], old[4]), "version": both(new[1], none).try_cast("bigint"), "msgid": both(new[6], none), "structured_data": both(new[7], none), "message": both(new[8], old[5])}
    return Parsed(new_ok | old_ok, made, "syslog")


def nginx_error(inp: Input, options: dict) -> Parsed:
    ok, p = inp.match(r"\s*(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] (\d+)#(\d+): (?:\*(\d+) )?(.*?)(?:, (client: .*))?\s*")
    rest = p[6]
    tail = lambda k: F.when(ok, F.nullif(F.regexp_extract(rest, rf'(?:^|, ){k}: "?([^",]*)"?', 1), F.lit("")))
    request = tail("request")
    made = {"timestamp": p[0], "severity": p[1], "pid": p[2].try_cast("bigint"), "tid": p[3].try_cast("bigint"), "cid": p[4].try_cast("bigint"), "message": p[5]}
    made |= {k: tail(k) for k in ("client", "server", "request", "upstream", "host", "referrer")}
    made |= {"method": F.try_element_at(F.split(request, " "), F.lit(1)), "uri": F.try_element_at(F.split(request, " "), F.lit(2))}
    return Parsed(ok, made, "nginx_error")


apache_error = fixed("apache_error", r"\s*\[([^\]]+)\] \[(?:([\w-]*):)?(\w+)\](?: \[pid (\d+)(?::tid (\d+))?\])?(?: \[client ([^\]]+?)(?::(\d+))?\])?(?: (AH\d+):)? ?(.*)", [("timestamp", None), ("module", None), ("severity", None), ("pid", "int"), ("tid", "int"), ("client_ip", None), ("client_port", "int"), ("error_code", None), ("message", None)])
postgres = fixed("postgres", r"\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: [A-Z]+)?) \[(\d+)\](?: (?:\[?([^\s@]+)\]?@(\S+) )?)?\s*([A-Z]+\d?):\s+((?:duration: ([\d.]+) ms)?(?:\s+(?:statement|execute [^:]*): (.*))?.*)", [("timestamp", None), ("pid", "int"), ("user", None), ("database", None), ("severity", None), ("message", None), ("duration_ms", "float"), ("statement", None)])
mysql_slow = fixed("mysql_slow", r"\s*(?:# Time: (\S+(?: \S+)?)\s*\n)?# User@Host: ([^\[\s]*)\[[^\]]*\] @ +(\S*?) ?\[([^\]]*)\](?:\s+Id:\s+(\d+))?\s*\n(?:# Schema: (\S*)[^\n]*\n)?# Query_time: ([\d.]+)\s+Lock_time: ([\d.]+)\s+Rows_sent: (\d+)\s+Rows_examined: (\d+)[^\n]*\n(?:use [^\n]*\n)?(?:SET timestamp=\d+;\n)?(.*?)\s*", [("timestamp", None), ("user", None), ("host", None), ("client_ip", None), ("connection_id", "int"), ("schema", None), ("query_time", "float"), ("lock_time", "float"), ("rows_sent", "int"), ("rows_examined", "int"), ("statement", None)])
haproxy = fixed("haproxy", r'.*?(\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F:]+):(\d+) \[([^\]]+)\] (\S+) ([^/\s]+)/(\S+) ([-+\d]+)/([-+\d]+)/([-+\d]+)/([-+\d]+)/([-+\d]+) (\d{3}|-1) ([-+\d]+) \S+ \S+ (\S{4}) (\d+)/(\d+)/(\d+)/(\d+)/(\+?\d+) \d+/\d+(?: \{[^}]*\})*(?: "(\S+) (\S+)(?: (\S+))?")?.*', [("client_ip", None), ("client_port", "int"), ("timestamp", None), ("frontend", None), ("backend", None), ("server", None), ("tq", "int"), ("tw", "int"), ("tc", "int"), ("tr", "int"), ("tt", "int"), ("status", "int"), ("bytes", "int"), ("term_state", None), ("actconn", "int"), ("feconn", "int"), ("beconn", "int"), ("srv_conn", "int"), ("retries", "int"), ("method", None), ("uri", None), ("protocol", None)])


def redis(inp: Input, options: dict) -> Parsed:
    ok, p = inp.match(r"\s*(\d+):([A-Z]) (\d{1,2} \w{3}(?: \d{4})? \d\d:\d\d:\d\d\.\d+) ([.\-*#]) (.*)")
    # Names by character (fixed values of the format).
    role = F.create_map(*(F.lit(x) for x in ("M", "master", "S", "replica", "C", "rdb_child", "X", "sentinel")))
    level = F.create_map(*(F.lit(x) for x in (".", "debug", "-", "verbose", "*", "notice", "#", "warning")))
    made = {"pid": p[0].try_cast("bigint"), "role_char": p[1], "timestamp": p[2], "level_char": p[3], "message": p[4], "role": F.try_element_at(role, p[1]), "level": F.try_element_at(level, p[3])}
    return Parsed(ok, made, "redis")


# Formats of fields that depend on the data


def flatten(value, prefix: str = "") -> dict[str, str]:
    """Dotted leaves of a JSON object and their kinds; arrays stay text."""
    out = {}
    for k, v in value.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, name + ".")
        else:
            out[name] = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) and -(1 << 63) <= v < 1 << 63 else "float" if isinstance(v, (int, float)) else "string"
    return out


def json_fields(inp: Input) -> dict[str, str | None]:
    if inp.into:
        return dict(inp.into)

    def pairs(line: str):
        try:
            value = json.loads(line)
        except (ValueError, RecursionError):
            return ()
        return flatten(value).items() if isinstance(value, dict) else ()

    kinds = inp.found(pairs)
    # What is an object in some rows and a value in others stays text; a null isn't a value.
    parents = {k.rsplit(".", i)[0] for k in kinds for i in range(1, k.count(".") + 1)}
    both = {k for k in parents if kinds.get(k, {"null"}) != {"null"}}
    under = lambda k: any(k.rsplit(".", i)[0] in both for i in range(1, k.count(".") + 1))
    return {k: "string" if k in both else widest(v) for k, v in kinds.items() if not under(k) and (k in both or k not in parents)}


CORRUPT = "__corrupt"


def json_format(inp: Input, options: dict, name: str = "json") -> Parsed:
    """One pass of Spark's JSON reader over a schema of text leaves, whose types are then tried."""
    wanted = json_fields(inp)
    tree: dict = {}
    for f in wanted:
        at = tree
        *path, leaf = f.split(".")
        for p in path:
            at = at.setdefault(p, {})
            if at is None:
                break
        if at is not None:
            at.setdefault(leaf, None)

    def schema(t: dict) -> T.StructType:
        return T.StructType([T.StructField(k, schema(v) if v else T.StringType()) for k, v in t.items()])

    whole = schema(tree).add(CORRUPT, T.StringType())
    got = inp.keep(F.from_json(inp.text, whole, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}))
    ok = F.coalesce(inp.text.rlike(r"(?s)^\s*\{.*\S.*\}\s*$") & got.getField(CORRUPT).isNull(), F.lit(False))

    def leaf(f: str) -> Column:
        c = got
        for p in f.split("."):
            c = c.getField(p)
        return F.when(ok, c)

    return Parsed(ok, {f: typed(leaf(f), kind) for f, kind in wanted.items()}, name)


def docker(inp: Input, options: dict) -> Parsed:
    if not inp.into:
        inp = _declared(inp, [("log", None), ("stream", None), ("time", None)])
    out = json_format(inp, options, "docker")
    if "log" in out.fields:
        out.fields["log"] = F.regexp_replace(out.fields["log"], r"\r?\n$", "")
    return out


def _declared(inp: Input, into) -> Input:
    new = Input(inp.frame, inp.text, into)
    new.made = inp.made
    return new


def _pairs(inp: Input, text: Column, key: str, value: str, name: str, unquote: str = '"', cut=None) -> tuple[Column, dict[str, Column]]:
    """Fields of a text of pairs; `key` and `value` are patterns of the parts, the assign sign at the key's end."""
    keys = F.regexp_extract_all(text, F.lit(f"({key})(?:{value})"), F.lit(1))
    keys = F.transform(keys, lambda k: F.regexp_replace(k, r"^[\s,;|\t]*|.$", ""))
    values = F.regexp_extract_all(text, F.lit(f"(?:{key})({value})"), F.lit(1))
    q = re.escape(unquote)
    values = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, f"(?s)^{q}(.*){q}$", "$1"), rf"\\({q}|\\)", "$1"))
    got = inp.keep(F.when(text.isNotNull(), _last_wins(keys, values)))
    ok = F.coalesce(F.size(got) > 0, F.lit(False))
    wanted = dict(inp.into)
    if not wanted:
        py = re.compile(f"({key.replace('(?s)', '')})({value})")

        def pairs(line: str):
            for k, v in py.findall(cut(line) if cut else line):
                k = re.sub(r"^[\s,;|\t]*|.$", "", k)
                yield k, infer(v[1:-1] if len(v) > 1 and v[0] == v[-1] == unquote else v)

        wanted = {k: widest(v) for k, v in inp.found(pairs).items()}
    return ok, {f: typed(F.try_element_at(got, F.lit(f)), kind) for f, kind in wanted.items()}


def _last_wins(keys: Column, values: Column) -> Column:
    """A map in which a later pair replaces an earlier one of its key."""
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value"))))


def logfmt(inp: Input, options: dict) -> Parsed:
    ok, fields = _pairs(inp, inp.text, r'(?:^|(?<=\s))[^\s="]+=', r'"(?:[^"\\]|\\.)*"|[^\s]*', "logfmt")
    return Parsed(ok, fields, "logfmt")


def kv(inp: Input, options: dict) -> Parsed:
    sep, assign, quote = (str(options.get(k, d)) for k, d in (("sep", " "), ("assign", "="), ("quote", '"')))
    s, a, q = (re.escape(x).replace("/", r"\/") for x in (sep, assign, quote))
    key = rf"(?:^|(?<={s}))\s*[^{s}{a}]+{a}"
    ok, fields = _pairs(inp, inp.text, key, rf"{q}(?:[^{q}\\]|\\.)*{q}|[^{s}]*", "kv", quote)
    return Parsed(ok, fields, "kv")


def cef(inp: Input, options: dict) -> Parsed:
    names = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]
    ok, p = inp.match(r".*?CEF:\s*(\d+)\|" + r"((?:[^|\\]|\\.)*)\|" * 6 + "(.*)")
    made = {n: F.regexp_replace(c, r"\\([|\\])", "$1") for n, c in zip(names, p)}
    rest = inp.keep(p[7])
    extra = _declared(inp, [(n, k) for n, k in inp.into if n not in names])
    if extra.into or not inp.into:
        _, more = _pairs(extra, rest, r"(?:^|(?<=\s))[\w.]+=", r"(?:(?!\s[\w.]+=)(?:[^\\]|\\.))*", "cef", cut=lambda x: re.split(r"(?<!\\)\|", x, maxsplit=7)[-1])
        made |= {k: v for k, v in more.items() if k not in made}
    return Parsed(ok, made, "cef")


def _leef_rest(line: str) -> str:
    """The pairs of a line, apart by tabs."""
    parts = line.split("|", 5)
    rest = parts[-1]
    m = re.match(r"(x?[0-9A-Fa-f]{2,4}|[^|\w\s])\|", rest)
    if not m:
        return rest
    code = m[1].removeprefix("x")
    sep = chr(int(code, 16)) if re.fullmatch(r"[0-9A-Fa-f]{2,4}", code) else code
    return rest[m.end() :].replace(sep, "\t")


def leef(inp: Input, options: dict) -> Parsed:
    names = ["leef_version", "device_vendor", "device_product", "device_version", "event_id"]
    ok, p = inp.match(r".*?LEEF:\s*([\d.]+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(?:(x?[0-9A-Fa-f]{2,4}|[^|\w\s])\|)?(.*)")
    made = dict(zip(names, p))
    delimiter = F.when(p[5].isNull(), F.lit("\t")).when(p[5].rlike("^x?[0-9A-Fa-f]{2,4}$"), F.chr(F.conv(F.regexp_replace(p[5], "^x", ""), 16, 10).cast("bigint"))).otherwise(p[5])
    rest = inp.keep(F.call_function("replace", p[6], delimiter, F.lit("\t")))
    extra = _declared(inp, [(n, k) for n, k in inp.into if n not in names])
    if extra.into or not inp.into:
        _, more = _pairs(extra, rest, r"(?:^|(?<=[\t|^]))[\w.]+=", r"[^\t]*", "leef", cut=_leef_rest)
        made |= {k: v for k, v in more.items() if k not in made}
    return Parsed(ok, made, "leef")


def w3c(inp: Input, options: dict) -> Parsed:
    """Fields by place; the header is given, or the one #Fields line that the rows have."""
    header = options.get("header")
    if not header:
        headers = [r[0] for r in inp.texts().where(F.startswith("t", F.lit("#Fields:"))).select(F.trim("t")).distinct().limit(2).collect()]
        if len(headers) > 1:
            raise QueryError("S023", "w3c found several headers", hint='parse each part with its own: w3c("#Fields: date time ...")')
        header = headers[0] if headers else ""
    names = [re.sub(r"\W+", "_", n).strip("_") for n in re.sub(r"^#Fields:\s*", "", str(header)).split()]
    if not names:
        raise QueryError("S023", "w3c needs its header", hint='w3c("#Fields: date time ...")')
    parts = inp.keep(F.split(F.trim(inp.text), r"\s+"))
    ok = F.coalesce((F.size(parts) == len(names)) & ~F.startswith(inp.text, F.lit("#")), F.lit(False))
    kinds = dict(inp.into)
    return Parsed(ok, {n: typed(F.when(ok, F.nullif(F.try_element_at(parts, F.lit(i + 1)), F.lit("-"))), kinds.get(n)) for i, n in enumerate(names) if not kinds or n in kinds}, "w3c")


def regex_format(inp: Input, options: dict) -> Parsed:
    pattern = java_regex(str(options["pattern"]))
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    if not names:
        raise QueryError("E034", "the pattern has no named group", hint='r"user=(?<user>\\w+)"')
    opens = [m.start() for m in re.finditer(r"\((?!\?)|\(\?<(?![=!])", re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: "." * len(m[0]), pattern))]
    kinds = dict(inp.into)
    ok = F.coalesce(F.rlike(inp.text, F.lit(pattern)), F.lit(False))
    made = {}
    # Java has no underscores in names of groups: they are taken by number.
    plain = re.sub(r"\(\?<[A-Za-z]\w*>", "(", pattern)
    got = inp.keep(inp.groups_of(f"(?s)^.*?(?-s:{plain}).*$", plain, range(1, len(opens) + 1)))
    ok = F.coalesce(F.startswith(F.element_at(got, 1), F.lit(MARK)), F.lit(False))
    for m in re.finditer(r"\(\?<([A-Za-z]\w*)>", pattern):
        if m[1] in kinds or not kinds:
            i = opens.index(m.start())
            part = F.regexp_replace(F.try_element_at(got, F.lit(i + 1)), f"^{MARK}", "")
            made[m[1]] = typed(F.when(ok, F.nullif(part, F.lit(""))), kinds.get(m[1]))
    return Parsed(ok, made, "regex")


def pattern_format(inp: Input, options: dict) -> Parsed:
    """<name> and %{name:type} stand for what is between literals; <_> is skipped."""
    out, fields = [], []
    for lit, a, b, kind in re.findall(r"((?:(?!<\w+>|%\{\w+(?::\w+)?\}).)+)|<(\w+)>|%\{(\w+)(?::(\w+))?\}", str(options["pattern"]), re.S):
        if lit:
            out.append(re.escape(lit))
        else:
            out.append("(.*)" if kind == "rest" else "(.*?)")
            fields.append(("" if (a or b) == "_" else a or b, kind or None))
    kinds = dict(inp.into)
    fields = [(n if not kinds or n in kinds else "", kinds.get(n) or k) for n, k in fields]
    return fixed("pattern", "".join(out), fields)(inp, {})


FORMATS = {"json": json_format, "logfmt": logfmt, "kv": kv, "pattern": pattern_format, "regex": regex_format, "combined": combined, "clf": clf, "syslog": syslog, "nginx_error": nginx_error, "apache_error": apache_error, "cef": cef, "leef": leef, "docker": docker, "redis": redis, "postgres": postgres, "mysql_slow": mysql_slow, "haproxy": haproxy, "w3c": w3c}


def parsed(inp: Input, form: tuple) -> Parsed:
    name, options = form
    if name != "first_of":
        return FORMATS[name](inp, options)
    each = [parsed(inp, f) for f in options]
    ok, fields = F.lit(False), {}
    for p in each:
        now = p.ok & ~ok
        for f, c in p.fields.items():
            fields[f] = F.when(now, c) if f not in fields else F.coalesce(fields[f], F.when(now, c))
        ok = ok | p.ok
    return Parsed(ok, fields, "first_of")


def parse_stage(b, frame: Frame, stage) -> Frame:
    """Fields are added or fill nulls of fields that are there; what can't be parsed follows on_error."""
    a = stage.args
    ex = b.exprs(frame)
    found = ex.compile(a["from"] or Field("_raw"))
    inp = Input(frame, found.col.cast("string"), a["into"])
    try:
        p = parsed(inp, a["format"])
    except QueryError as e:
        raise QueryError(e.code, e.message, stage.at, b.text, e.hint) from None
    if a["into"]:
        missing = [n for n, _ in a["into"] if n not in p.fields]
        kinds = dict(a["into"])
        p.fields = {n: p.fields.get(n, F.lit(None).cast("string")) for n in kinds} if not missing else {n: typed(p.fields[n], kinds[n]) if n in p.fields else F.lit(None).cast("string") for n in kinds}
    before = list(inp.made)
    df = frame.df
    for name in before:  # each may rest on the one before
        df = df.withColumn(name, inp.made[name])
    ok = F.col("__ok")
    df = df.withColumn("__ok", p.ok)
    made: dict[str, Column] = {}
    for f, c in p.fields.items():
        out = f"{a['prefix']}{f}"
        if out in frame.columns:
            kind = frame.kind(out)
            c = F.coalesce(col(out), c.cast(kind) if kind_of(kind) != "unknown" else c)
        made[out] = c
    message = F.lit(f"parse:{p.name}: no fields extracted")
    mode = a["on_error"]
    if mode == "propagate":
        error = F.when(~ok, message)
        detail = F.when(~ok, F.struct(F.lit(p.name).alias("format"), F.lit("no_fields").alias("code"), F.lit("no fields extracted").alias("message")))
        made["_error"] = F.coalesce(col("_error"), error) if "_error" in frame.columns else error
        made["_error_detail"] = F.coalesce(col("_error_detail"), detail) if "_error_detail" in frame.columns else detail
    elif mode == "drop":
        df = df.where(ok)
    elif mode == "strict":
        # The check hangs on a filter, so that it runs even if no field is used.
        df = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(message, F.lit(" in: "), F.coalesce(F.substring(inp.text, 1, 200), F.lit("null")))).cast("boolean")))
    df = df.withColumns(made) if made else df
    rest = [c for c in made if c not in frame.columns]
    return frame.having(df.select(*map(col, frame.columns), *map(col, rest), *map(col, frame.hidden)))
