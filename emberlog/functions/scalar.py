"""Scalar functions: name, number of arguments, and how each is written as a column.

A builder gets `Arg`s (column, kind, literal value if there is one) and returns a column.  Null input gives null.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import bin_time, duration, micros, of_micros


@dataclass
class Arg:
    col: Column
    kind: str = "unknown"
    value: object = None
    literal: bool = False
    node: object = None


@dataclass(frozen=True)
class Function:
    least: int
    most: int
    build: Callable
    strict: bool = False


REGISTRY: dict[str, Function] = {}


def register(name: str, least: int, most: int | None = None, strict: bool = False):
    def put(build):
        REGISTRY[name] = Function(least, least if most is None else most, build, strict)
        return build

    return put


def simple(name: str, least: int, fn: Callable, most: int | None = None) -> None:
    REGISTRY[name] = Function(least, least if most is None else most, lambda *a: fn(*(x.col for x in a)))


def need_literal(a: Arg, what: str):
    if not a.literal:
        raise ValueError(f"{what} must be a literal")
    return a.value


def text(a: Arg) -> Column:
    """The string form of a value."""
    return string(a) if a.kind != "string" else a.col


# Conversion


@register("int", 1, strict=True)
def int_(a):
    if a.kind == "string":
        t = F.trim(a.col)
        return F.coalesce(t.try_cast("bigint"), F.floor(F.abs(t.try_cast("double"))).cast("bigint") * F.signum(t.try_cast("double")).cast("bigint"))
    if a.kind == "timestamp":
        return F.unix_seconds(a.col.cast("timestamp"))
    return a.col.try_cast("bigint")


@register("float", 1, strict=True)
def float_(a):
    return (F.trim(a.col) if a.kind == "string" else a.col).try_cast("double")


@register("string", 1)
def string(a):
    if a.kind == "timestamp":
        t = a.col.cast("timestamp")
        return F.regexp_replace(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0+Z$", "Z")
    if a.kind == "float":
        whole = (a.col == F.floor(a.col)) & (F.abs(a.col) < 1e15)
        return F.when(whole, a.col.cast("bigint").cast("string")).otherwise(a.col.cast("string"))
    if a.kind in ("array", "object"):
        return F.to_json(a.col)
    return a.col.cast("string")


@register("bool", 1, strict=True)
def bool_(a):
    if a.kind != "string":
        return a.col.cast("boolean")
    t = F.lower(F.trim(a.col))
    return F.when(t.isin("true", "t", "1", "yes", "y"), True).when(t.isin("false", "f", "0", "no", "n", ""), False)


#: strptime verbs and the letters of Spark's formatter.
VERBS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "p": "a", "I": "hh", "Z": "z", "z": "xx", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "j": "DDD", "y": "yy", "e": "d", "T": "HH:mm:ss", "F": "yyyy-MM-dd"}


def layout(fmt: str) -> str:
    out, plain = [], []

    def flush():
        if plain:
            body = "".join(plain).replace("'", "''")
            out.append(f"'{body}'" if re.search("[A-Za-z'\\[\\]{}#]", body) else body)
            plain.clear()

    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt) and fmt[i + 1] in VERBS:
            flush()
            out.append(VERBS[fmt[i + 1]])
            i += 2
        else:
            plain.append("%" if fmt[i : i + 2] == "%%" else fmt[i])
            i += 2 if fmt[i : i + 2] == "%%" else 1
    flush()
    return "".join(out)


@register("timestamp", 1, 2, strict=True)
def timestamp(a, fmt=None):
    if a.kind == "timestamp":
        return a.col
    if a.kind in ("int", "float"):
        return F.timestamp_micros((a.col * 1_000_000).cast("bigint"))
    if fmt is None:
        return F.coalesce(F.try_to_timestamp(a.col), F.try_to_timestamp(a.col, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")))
    return F.try_to_timestamp(a.col, F.lit(layout(need_literal(fmt, "a layout"))))


@register("strptime", 2, strict=True)
def strptime(a, fmt):
    return F.try_to_timestamp(a.col, F.lit(layout(need_literal(fmt, "a layout"))))


@register("duration", 1, strict=True)
def duration_(a):
    if a.kind == "duration":
        return a.col
    if a.literal and isinstance(a.value, str):
        from ..lang.lexer import UNITS

        m = re.fullmatch(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d|w)", a.value)
        return duration(float(m[1]) * UNITS[m[2]]) if m else F.lit(None).cast("interval day to second")
    pattern = r"^(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d|w)$"
    n, unit = F.regexp_extract(a.col, pattern, 1).try_cast("double"), F.regexp_extract(a.col, pattern, 2)
    factor = F.when(unit == "ns", 0.001).when(unit == "us", 1.0).when(unit == "ms", 1e3).when(unit == "s", 1e6).when(unit == "m", 6e7).when(unit == "h", 3.6e9).when(unit == "d", 8.64e10).when(unit == "w", 6.048e11)
    return F.when(n.isNotNull() & factor.isNotNull(), of_micros((n * factor).cast("long")))


# Conditions and nulls


@register("if", 3)
def if_(c, a, b):
    return F.when(c.col, a.col).when(~c.col, b.col)


@register("case", 2, 99)
def case(*args):
    out = None
    for c, v in zip(args[0::2], args[1::2]):
        out = F.when(c.col, v.col) if out is None else out.when(c.col, v.col)
    return out.otherwise(args[-1].col) if len(args) % 2 else out


simple("coalesce", 1, F.coalesce, 99)
simple("nullif", 2, F.nullif)
simple("exists", 1, lambda x: x.isNotNull())
simple("is_null", 1, lambda x: x.isNull())  # a field of no schema is missing, which the compiler settles


@register("typeof", 1)
def typeof(a):
    return F.when(a.col.isNull(), "null").otherwise(a.kind)


# Strings


@register("len", 1)
def len_(a):
    if a.kind == "array":
        return F.when(a.col.isNotNull(), F.size(a.col)).cast("bigint")
    if a.kind == "object":
        return F.when(a.col.isNotNull(), F.size(F.map_keys(a.col))).cast("bigint")
    return F.char_length(text(a)).cast("bigint")


simple("lower", 1, F.lower)
simple("upper", 1, F.upper)


def _trim(left: bool, right: bool):
    def build(a, chars=None):
        if chars is None:
            pattern = "|".join(p for p, on in ((r"^\s+", left), (r"\s+$", right)) if on)
            return F.regexp_replace(a.col, pattern, "")
        side = F.btrim if left and right else F.ltrim if left else F.rtrim
        return side(a.col, chars.col)

    return build


for _name, _sides in (("trim", (True, True)), ("ltrim", (True, False)), ("rtrim", (False, True))):
    register(_name, 1, 2)(_trim(*_sides))


@register("substr", 2, 3)
def substr(a, start, n=None):
    size = F.char_length(a.col)
    s = start.col.cast("int")
    at = F.when(s < 0, F.greatest(size + s, F.lit(0))).otherwise(F.least(s, size))
    rest = size - at
    width = rest if n is None else F.greatest(F.lit(0), F.least(n.col.cast("int"), rest))
    known = a.col.isNotNull() & s.isNotNull() & (F.lit(True) if n is None else n.col.isNotNull())
    return F.when(known, F.substring(a.col, at + 1, width))


#: Java's \b and \B know letters beyond ASCII; the language's don't, like its \w.
EDGES = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


def java_regex(p: str) -> str:
    """A pattern of the language for Java: named groups and ASCII word edges."""
    out = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: EDGES.get(m[0], m[0]), p, flags=re.S)
    return out.replace("(?P<", "(?<")


def _pattern(a: Arg) -> Column:
    return F.lit(java_regex(a.value)) if a.literal else a.col


@register("replace", 3)
def replace(a, p, w):
    new = F.lit(re.sub(r"\$\{(\w+)\}", r"$\1", w.value)) if w.literal else w.col
    return F.regexp_replace(a.col, _pattern(p), new)


@register("split", 2)
def split(a, sep):
    if sep.literal:
        return F.split(a.col, re.escape(sep.value) if sep.value else "")
    return F.split(a.col, F.concat(F.lit("\\Q"), sep.col, F.lit("\\E")))


simple("join", 2, lambda a, s: F.call_function("array_join", a.cast("array<string>"), s))
simple("starts_with", 2, F.startswith)
simple("ends_with", 2, F.endswith)


@register("printf", 1, 99)
def printf(fmt, *args):
    if fmt.literal:
        return F.format_string(re.sub(r"%[vq]", "%s", fmt.value), *(text(a) if re.search(r"%[vq]", fmt.value) and a.kind not in ("int", "float") else a.col for a in args))
    return F.call_function("format_string", fmt.col, *(a.col for a in args))


simple("urldecode", 1, F.try_url_decode)


@register("url_parse", 1)
def url_parse(a):
    part = lambda p: F.try_parse_url(a.col, F.lit(p))
    query = part("QUERY")
    authority = part("AUTHORITY")
    port = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit("")).try_cast("bigint")
    pairs = F.when(query.isNotNull(), F.map_from_entries(F.transform(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])), lambda k: F.struct(k.alias("key"), F.try_element_at(F.filter(F.transform(F.split(query, "&"), lambda y: F.struct(F.split(y, "=", 2)[0].alias("k"), F.try_element_at(F.split(y, "=", 2), F.lit(2)).alias("v"))), lambda z: z["k"] == k), F.lit(-1))["v"].alias("value")))))
    return F.when(a.col.isNotNull(), F.struct(part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), port.alias("port"), part("PATH").alias("path"), pairs.alias("query"), part("REF").alias("fragment")))


@register("path_normalize", 1)
def path_normalize(a):
    """Steps of a path one after another: empty ones and `.` go, `..` takes the step before, if there is one."""
    rooted, none = F.startswith(a.col, F.lit("/")), F.array().cast("array<string>")

    def step(done, p):
        last = F.try_element_at(done, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(p)))
        return F.when((p == "") | (p == "."), done).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    path = F.array_join(F.aggregate(F.split(a.col, "/"), none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), path)).when(a.col == "", "").when(path == "", ".").otherwise(path)


@register("useragent_parse", 1)
def useragent_parse(a):
    s = a.col
    pick = lambda *pairs: F.coalesce(*(F.when(s.rlike(p), F.lit(n)) for p, n in pairs), F.lit("Other"))
    browser = pick((r"bot|crawl|spider", "Bot"), (r"Edg/", "Edge"), (r"OPR/|Opera", "Opera"), (r"Firefox/", "Firefox"), (r"Chrome/", "Chrome"), (r"Safari/", "Safari"), (r"MSIE |Trident/", "IE"), (r"^curl/", "curl"), (r"^[Ww]get/", "Wget"))
    version = F.regexp_extract(s, r"(?:Edg|OPR|Firefox|Chrome|Version|curl|[Ww]get|MSIE)[/ ]([\d.]+)", 1)
    os = pick((r"Android", "Android"), (r"iPhone|iPad", "iOS"), (r"Windows", "Windows"), (r"Mac OS X|Macintosh", "macOS"), (r"Linux", "Linux"))
    device = F.when(s.rlike(r"Mobile|iPhone|Android"), "mobile").when(s.rlike(r"iPad|Tablet"), "tablet").otherwise("desktop")
    return F.when(s.isNotNull(), F.struct(browser.alias("browser"), F.nullif(version, F.lit("")).alias("version"), os.alias("os"), device.alias("device")))


# Search


TOKEN_SPLIT = r"[^\p{L}\p{Nd}]+"


def tokens_of(s: str) -> list[str]:
    """Runs of letters and decimal digits, in lower case."""
    return "".join(c if c.isalpha() or c.isdecimal() else " " for c in s.lower()).split()


@register("has", 2)
def has(f, term):
    body = text(f)
    if term.literal:
        wanted = tokens_of(str(term.value))
        if not wanted:
            return F.when(body.isNotNull(), F.lit(False))
        # A substring test comes first: it is cheap and rules most rows out.  A token is then a match between edges of
        # runs, found without making the list of all tokens.
        out = None
        for t in wanted:
            one = F.contains(F.lower(body), F.lit(t)) & F.rlike(F.lower(body), F.lit(rf"(?<![\p{{L}}\p{{Nd}}]){t}(?![\p{{L}}\p{{Nd}}])"))
            out = one if out is None else out & one
        return out
    return F.forall(F.filter(F.split(F.lower(term.col), TOKEN_SPLIT), lambda t: t != ""), lambda t: F.array_contains(F.split(F.lower(body), TOKEN_SPLIT), t))


@register("contains", 2)
def contains(f, sub):
    return F.contains(F.lower(text(f)), F.lit(str(sub.value).lower()) if sub.literal else F.lower(sub.col))


@register("contains_cs", 2)
def contains_cs(f, sub):
    return F.contains(text(f), sub.col)


def glob_regex(p: str, crosses: bool = False) -> str:
    """An anchored regular expression of a glob; * stops at / unless it `crosses`."""
    out, i, depth = [], 0, 0
    while i < len(p):
        c = p[i]
        if c == "*":
            out.append(".*" if crosses else "[^/]*")
        elif c == "?":
            out.append("." if crosses else "[^/]")
        elif c == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]")
            i = j
        elif c == "{" and "}" in p[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(p):
            i += 1
            out.append(re.escape(p[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


@register("glob", 2)
def glob(f, p):
    return F.rlike(text(f), F.lit("(?s)" + glob_regex(str(need_literal(p, "a glob")), crosses=getattr(f.node, "name", "") == "_raw")))


@register("matches", 2)
def matches(f, p):
    return F.rlike(text(f), _pattern(p))


def groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    body = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", body))


@register("extract", 2)
def extract(f, p):
    pattern = java_regex(str(need_literal(p, "a pattern")))
    body, n = text(f), 1 if groups(pattern) else 0
    return F.when(F.rlike(body, F.lit(pattern)), F.regexp_extract(body, pattern, n))


@register("extract_all", 2)
def extract_all(f, p):
    pattern = java_regex(str(need_literal(p, "a pattern")))
    found = F.regexp_extract_all(text(f), F.lit(pattern), F.lit(1 if groups(pattern) else 0))
    return F.when(F.size(found) > 0, found)


# Math

simple("abs", 1, F.abs)


@register("round", 1, 2)
def round_(x, d=None):
    return F.round(x.col.cast("double"), 0 if d is None else int(need_literal(d, "digits")))


simple("floor", 1, lambda x: F.floor(x).cast("bigint"))
simple("ceil", 1, lambda x: F.ceil(x).cast("bigint"))
simple("sqrt", 1, lambda x: F.when(x >= 0, F.sqrt(x)))
simple("ln", 1, lambda x: F.when(x > 0, F.ln(x)))


@register("log", 1, 2)
def log(x, base=None):
    value = F.log10(x.col) if base is None else F.ln(x.col) / F.ln(base.col)
    return F.when(x.col > 0, value)


simple("exp", 1, F.exp)
simple("pow", 2, F.pow)
simple("clamp", 3, lambda x, lo, hi: F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.least(F.greatest(x, lo), hi)))
simple("bucket", 2, lambda x, bounds: F.array_max(F.filter(bounds, lambda b: b <= x)))
for _name in ("sin", "cos", "tan", "asin", "acos", "atan"):
    simple(_name, 1, getattr(F, _name))
simple("atan2", 2, F.atan2)

# Time


@register("bin", 2)
def bin_(ts, span):
    if ts.kind == "int":  # nanoseconds
        return bin_time(F.timestamp_micros((ts.col / 1000).cast("bigint")), need_literal(span, "a span"))
    return bin_time(ts.col, need_literal(span, "a span"))


@register("strftime", 2)
def strftime(ts, fmt):
    return F.date_format(ts.col.cast("timestamp"), layout(need_literal(fmt, "a layout")))


simple("time_of_day", 1, lambda t: t.cast("timestamp") - F.date_trunc("day", t))
simple("day_of_week", 1, lambda t: (F.dayofweek(t) - 1).cast("bigint"))

# Hashes and networks

simple("md5", 1, F.md5)
simple("sha1", 1, F.sha1)
simple("sha256", 1, lambda s: F.sha2(s, 256))
simple("sha512", 1, lambda s: F.sha2(s, 512))


@register("xxhash64", 1)
def xxhash64(a):
    """XXH64 of seed 0 in hexadecimal; Spark's own has seed 42, so this one is a vectorised UDF."""

    @F.pandas_udf("string")
    def run(s):
        import xxhash

        return s.map(lambda x: f"{xxhash.xxh64_intdigest(x.encode()):x}", na_action="ignore")

    return run(text(a))


IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def _ipv4(c: Column) -> Column:
    parts = F.split(c, r"\.")
    n = sum(F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4))
    return F.when(F.rlike(c, F.lit(IPV4)), n)


@register("cidr_match", 2)
def cidr_match(cidr, ip):
    net = ipaddress.ip_network(str(need_literal(cidr, "a network")), strict=False)
    if net.version == 4:
        mask, base = int(net.netmask), int(net.network_address)
        return F.when(ip.col.isNotNull(), F.coalesce(_ipv4(ip.col).bitwiseAND(F.lit(mask).cast("bigint")) == base, F.lit(False)))

    @F.pandas_udf("boolean")
    def inside(s):
        def one(x):
            try:
                return ipaddress.ip_address(x) in net
            except ValueError:
                return False

        return s.map(one, na_action="ignore").astype(object)

    return inside(ip.col)


@register("ip_parse", 1)
def ip_parse(a):
    n = _ipv4(a.col)
    within = lambda net: n.bitwiseAND(F.lit(int(ipaddress.ip_network(net).netmask)).cast("bigint")) == int(ipaddress.ip_network(net).network_address)
    private = within("10.0.0.0/8") | within("172.16.0.0/12") | within("192.168.0.0/16")
    v6 = a.col.rlike(r"^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$") & n.isNull()
    low = F.lower(a.col)
    of = lambda v4, other: F.when(n.isNotNull(), v4).otherwise(other)
    made = F.struct(of(F.lit(4), F.lit(6)).cast("bigint").alias("version"), of(private, low.rlike("^f[cd]")).alias("private"), of(within("127.0.0.0/8"), low == "::1").alias("loopback"))
    return F.when(n.isNotNull() | v6, made)


@register("ipmask", 2)
def ipmask(mask, ip):
    a, b = (F.split(x.col, r"\.") for x in (mask, ip))
    octet = lambda i: F.try_element_at(a, F.lit(i)).try_cast("int").bitwiseAND(F.try_element_at(b, F.lit(i)).try_cast("int")).cast("string")
    return F.when(F.rlike(mask.col, F.lit(IPV4)) & F.rlike(ip.col, F.lit(IPV4)), F.concat_ws(".", *(octet(i) for i in range(1, 5))))


# Arrays


@register("slice", 2, 3)
def slice_(a, start, end=None):
    n = F.size(a.col)
    fix = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    lo, hi = fix(start.col.cast("int")), n if end is None else fix(end.col.cast("int"))
    return F.when(a.col.isNotNull(), F.slice(a.col, lo + 1, F.greatest(hi - lo, F.lit(0))))


simple("array_concat", 1, F.concat, 99)
simple("array_distinct", 1, F.array_distinct)
simple("array_sort", 1, F.array_sort)
simple("flatten", 1, F.flatten)
HIGHER = {"any": F.exists, "all": F.forall, "filter": F.filter, "map": F.transform}

# Objects and JSON


simple("keys", 1, lambda o: F.array_sort(F.map_keys(o)))
simple("values", 1, lambda o: F.transform(F.array_sort(F.map_keys(o)), lambda k: F.try_element_at(o, k)))
simple("merge", 2, lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))
simple("has_key", 2, F.map_contains_key)


@register("to_json", 1)
def to_json(a):
    return F.to_json(a.col) if a.kind in ("array", "object", "unknown") else text(a)


@register("from_json", 1, strict=True)
def from_json(a):
    return F.try_parse_json(a.col)


# Names of the former dialect that plans still hold

simple("ilike", 2, F.ilike)
simple("json_extract", 2, lambda s, p: F.call_function("get_json_object", s, p))
simple("json_valid", 1, lambda s: F.try_parse_json(s).isNotNull())
simple("json_keys", 1, F.json_object_keys)
simple("json_array_length", 1, lambda s: F.json_array_length(s).cast("bigint"))
simple("mvappend", 1, F.concat, 99)
simple("mvjoin", 2, lambda a, s: F.call_function("array_join", a.cast("array<string>"), s))
simple("mvdedup", 1, F.array_distinct)
simple("mvcount", 1, lambda a: F.when(a.isNotNull(), F.size(a)).cast("bigint"))
simple("greatest", 2, F.greatest, 99)
simple("least", 2, F.least, 99)
simple("random", 0, F.rand)


def _as_json(a) -> Column:
    """A value as JSON text; text that is a number counts as one."""
    plain = F.to_json(F.array(a.col), {"ignoreNullFields": "false"})
    plain = F.substring(plain, 2, F.length(plain) - 2)
    return F.when(a.col.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$"), a.col).otherwise(plain) if a.kind == "string" else plain


@register("json_object", 0, 99)
def json_object(*args):
    """Keys in order; of a repeated key the last value counts."""
    pairs = {str(need_literal(k, "a key")): v for k, v in zip(args[0::2], args[1::2])}
    parts = [F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(_as_json(pairs[k]), F.lit("null"))) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


@register("json_array", 0, 99)
def json_array(*args):
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(_as_json(a), F.lit("null")) for a in args)), F.lit("]"))


def _json_path(path) -> str:
    p = str(need_literal(path, "a path")) if path is not None else ""
    return p if p.startswith("$") else f"${'' if not p or p.startswith('[') else '.'}{p}"


@register("json_type", 1, 2)
def json_type(a, path=None):
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(a.col), _json_path(path), "variant"))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def _changed(change: Callable) -> Callable:
    """A vectorised function of JSON texts and arguments; null where a text isn't JSON."""

    def one(body, *args):
        try:
            return None if body is None or any(x is None for x in args) else json.dumps(change(json.loads(body), *args), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, TypeError, IndexError):
            return None

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns)], dtype=object)

    return run


def _steps(path: str) -> list:
    return [int(i) if i else name for name, i in re.findall(r"([^.\[\]$]+)|\[(\d+)\]", path)]


@register("json_set", 3)
def json_set(a, path, value):
    steps = _steps(str(need_literal(path, "a path")))

    def change(body, text):
        at = body
        for s, after in zip(steps, steps[1:]):
            at = at[s] if isinstance(s, int) else at.setdefault(s, [] if isinstance(after, int) else {})
        at[steps[-1]] = json.loads(text)
        return body

    return _changed(change)(a.col, F.coalesce(_as_json(value), F.lit("null")))


@register("json_remove", 2)
def json_remove(a, path):
    steps = _steps(str(need_literal(path, "a path")))

    def change(body):
        at = body
        for s in steps[:-1]:
            at = at[s] if isinstance(s, int) else at.get(s, {})
        if isinstance(at, dict):
            at.pop(steps[-1], None)
        elif isinstance(at, list) and steps[-1] < len(at):
            del at[steps[-1]]
        return body

    return _changed(change)(a.col)


@register("json_merge", 2)
def json_merge(a, b):
    return _changed(lambda x, y: x | json.loads(y))(a.col, b.col)


@register("isnum", 1)
def isnum(a):
    return a.col.isNotNull() if a.kind in ("int", "float") else F.coalesce(text(a).try_cast("double").isNotNull(), F.lit(False))


@register("isint", 1)
def isint(a):
    return a.col.isNotNull() if a.kind == "int" else F.coalesce(F.rlike(text(a), F.lit(r"^[-+]?\d+$")) & text(a).try_cast("bigint").isNotNull(), F.lit(False))


@register("isbool", 1)
def isbool(a):
    return a.col.isNotNull() if a.kind == "bool" else F.lit(False)


for _name, _kind, _mark in (("isarray", "array", "["), ("isobject", "object", "{")):
    register(_name, 1)(lambda a, k=_kind, m=_mark: a.col.isNotNull() if a.kind == k else F.coalesce(F.startswith(F.ltrim(text(a)), F.lit(m)) & F.try_parse_json(text(a)).isNotNull(), F.lit(False)) if a.kind == "string" else F.lit(False))


__all__ = ["Arg", "Function", "REGISTRY", "HIGHER", "micros"]
