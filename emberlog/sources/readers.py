"""Log files and wire envelopes as frames: text with a detected format, NDJSON, bulk, collector and OTLP payloads.

All read with Spark's own text and JSON readers, so they split, compress and scale as those do.  A line's place is its
file and its position there.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, col, from_dataframe
from ..lang.ast import Field, Stage

BUILTIN = ("_time", "_raw", "_source", "_sourcetype", "host", "index")
#: Layouts of times in logs, from the most to the least usual.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][,SSS]", "dd/MMM/yyyy:HH:mm:ss xx", "yyyy/MM/dd HH:mm:ss", "MMM d HH:mm:ss[.SSSSSS] yyyy", "dd MMM yyyy HH:mm:ss.SSS")
TIME_FIELDS = ("_time", "timestamp", "@timestamp", "time", "ts", "datetime", "date", "created_at")
_COMBINED = re.compile(r'^\S+ \S+ \S+ \[[^\]]+\] "[^"]*" \d{3} (\d+|-)')
_SYSLOG = re.compile(r"^(<\d{1,3}>|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d )")
_LOGFMT = re.compile(r'(?:^|\s)[\w.]+=("[^"]*"|\S+)')


def detect(lines: list[str]) -> str:
    """json, docker, combined, syslog, logfmt, csv, tsv or raw, by what most of the first lines look like."""
    lines = [x for x in lines if x.strip()][:20]
    if not lines:
        return "raw"
    votes: dict[str, int] = {}
    for line in lines:
        kind = "raw"
        if line.lstrip().startswith("{"):
            try:
                found = json.loads(line)
                kind = "docker" if isinstance(found, dict) and {"log", "stream", "time"} <= found.keys() else "json"
            except ValueError:
                pass
        elif _COMBINED.match(line):
            kind = "combined"
        elif _SYSLOG.match(line):
            kind = "syslog"
        elif len(_LOGFMT.findall(line)) >= 2:
            kind = "logfmt"
        votes[kind] = votes.get(kind, 0) + 1
    best = max(votes, key=votes.get)
    if best == "raw":
        for sep, kind in (("\t", "tsv"), (",", "csv")):
            counts = {line.count(sep) for line in lines}
            if len(lines) > 1 and len(counts) == 1 and counts != {0}:
                return kind
    return best


def detect_all(df: DataFrame) -> str:
    """What most of all lines (column value) look like, as `detect` tells it of a few; one pass."""
    v = F.col("value")
    fields = F.from_json(v, "log string, stream string, time string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    whole = v.rlike(r"^\s*\{") & fields["__bad"].isNull()
    kind = F.when(whole & fields["log"].isNotNull() & fields["stream"].isNotNull() & fields["time"].isNotNull(), "docker").when(whole, "json").when(v.rlike(_COMBINED.pattern), "combined").when(v.rlike(_SYSLOG.pattern), "syslog")
    kind = kind.when(F.size(F.regexp_extract_all(v, F.lit(_LOGFMT.pattern), F.lit(0))) >= 2, "logfmt").otherwise("raw")
    count = lambda sep: F.length(v) - F.length(F.replace(v, F.lit(sep)))
    ends = [f(count(sep)).alias(f"{f.__name__}{i}") for i, sep in enumerate("\t,") for f in (F.min, F.max)]
    votes = df.where(F.trim("value") != "").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), *ends).collect()
    if not votes:
        return "raw"
    best = max(votes, key=lambda r: (r["n"], r["kind"]))
    if best["kind"] == "raw" and len(votes) == 1 and best["n"] > 1:
        for i, name in enumerate(("tsv", "csv")):
            if best[f"min{i}"] == best[f"max{i}"] > 0:
                return name
    return best["kind"]


def any_time(c: Column) -> Column:
    """A time in any of the usual layouts, or in seconds, milliseconds, microseconds or nanoseconds since 1970."""
    number = F.when(c.rlike(r"^\d+(\.\d+)?([eE]\d+)?$") & (c.try_cast("double") >= 1e8), c.try_cast("double"))
    scale = F.when(number < 1e11, 1e6).when(number < 1e14, 1e3).when(number < 1e17, 1.0).otherwise(1e-3)
    c = F.regexp_replace(c, r"^[A-Z][a-z]{2},? (?=[A-Z][a-z]{2} )", "")  # a weekday says nothing new
    return F.coalesce(F.try_to_timestamp(c), *(F.try_to_timestamp(c, F.lit(x)) for x in LAYOUTS), F.timestamp_micros((number * scale).cast("bigint")))


def builtin(df: DataFrame, raw: Column, source: Column, kind: Column, index: str = "main", host: Column | None = None) -> DataFrame:
    """The columns that every event has, before its own; what the event itself has of them stays."""
    have = set(df.columns)
    time = F.coalesce(*(any_time(col(f).cast("string")) for f in TIME_FIELDS if f in have), F.lit(None).cast("timestamp"))
    made = {"_raw": raw, "_source": source, "_sourcetype": kind, "host": F.lit(None).cast("string") if host is None else host, "index": F.lit(index)}
    own = {n: (col(n) if n in have else c) for n, c in made.items()}
    rest = [c for c in df.columns if c not in BUILTIN]
    return df.select(time.alias("_time"), *(own[n].alias(n) for n in BUILTIN[1:]), *map(col, rest))


def read_lines(spark: SparkSession, items, index: str = "main") -> Frame:
    """Events of a list of lines, or of any open text file such as sys.stdin."""
    rows = [(str(x).rstrip("\r\n"), i) for i, x in enumerate(items)]
    frame = from_dataframe(spark.createDataFrame(rows, "_raw string, _at long"), ["_at"])
    return frame.having(builtin(frame.df.drop("_at"), col("_raw"), F.lit("lines"), F.lit("raw"), index))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _source (the file) and _at (its place in the file's part) of each line."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source"), F.monotonically_increasing_id().alias("_at"))


def read_logs(spark: SparkSession, path: str, kind: str | None = None, index: str = "main") -> Frame:
    """Lines of log files, with the fields of their format (what most lines look like, unless named)."""
    from ..operators.parsing import parse_stage
    from ..plans.build import Builder
    from .catalog import Catalog

    df = lines(spark, path)
    kind = kind or detect_all(df)
    if kind in ("csv", "tsv"):
        sep = "," if kind == "csv" else "\t"
        table = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
        raw = F.concat_ws(sep, *(col(c).cast("string") for c in table.columns))
        table = table.withColumns({"__s": F.input_file_name(), "__at": F.monotonically_increasing_id()})
        frame = from_dataframe(builtin(table, raw, col("__s"), F.lit(kind), index).drop("__s"), ["__at"])
        return frame.having(frame.df.drop("__at"))
    df = df.withColumnsRenamed({"value": "_raw"})
    frame = from_dataframe(df, ["_source", "_at"])
    if kind != "raw":
        stage = Stage("parse", {"format": (kind, {}), "from": Field("_raw"), "into": [], "prefix": "", "on_error": "null"})
        frame = parse_stage(Builder(Catalog(spark)), frame, stage)
    shown = builtin(frame.df.drop("_at"), col("_raw"), col("_source"), F.lit(kind), index)
    return frame.having(shown)


def read_ndjson(spark: SparkSession, path: str, index: str = "main") -> Frame:
    return read_logs(spark, path, "json", index)


def read_bulk(spark: SparkSession, path: str) -> Frame:
    """Bulk files: an action line, then (but for deletes) a document.  Lines pair up within each file by their order.

    A document may look like an action.  What isn't one, and a delete, leave the next line to be an action, so a line is
    a document if an odd number of lookalikes stands straight before it.
    """
    from pyspark.sql import Window

    df = lines(spark, path).where(F.trim("value") != "")
    order = Window.partitionBy("_source").orderBy("_at")
    like = F.col("value").rlike(r'^\s*\{\s*"(index|create|update)"\s*:\s*\{')
    df = df.withColumn("_before", F.lag("value").over(order)).withColumn("_like", like).withColumn("_n", F.row_number().over(order))
    since = F.max(F.when(~F.col("_like"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    docs = df.withColumn("_since", F.coalesce(since, F.lit(0))).where("(_n - 1 - _since) % 2 = 1")
    act = F.from_json("_before", "index struct<_index:string,_id:string>, create struct<_index:string,_id:string>, update struct<_index:string,_id:string>")
    target = F.coalesce(act["index"]["_index"], act["create"]["_index"], act["update"]["_index"], F.lit("main"))
    ident = F.coalesce(act["index"]["_id"], act["create"]["_id"], act["update"]["_id"])
    docs = docs.select(F.col("value").alias("_raw"), "_source", "_at", target.alias("index"), ident.alias("_id"))
    return _json_frame(docs)


def _json_frame(df: DataFrame, raw: str = "_raw") -> Frame:
    """Fields of the JSON text in `raw` beside the columns that are there."""
    from ..operators.parsing import parse_stage
    from ..plans.build import Builder
    from .catalog import Catalog

    frame = from_dataframe(df, ["_source", "_at"])
    stage = Stage("parse", {"format": ("json", {}), "from": Field(raw), "into": [], "prefix": "", "on_error": "null"})
    frame = parse_stage(Builder(Catalog(df.sparkSession)), frame, stage)
    shown = frame.df.drop("_at")
    index = col("index") if "index" in shown.columns else F.lit("main")
    shown = builtin(shown.withColumn("index", index), col("_raw"), col("_source"), F.lit("json"), "main")
    return frame.having(shown)


def read_hec(spark: SparkSession, path: str) -> Frame:
    """Collector envelopes {time, host, source, sourcetype, index, event, fields}, one a line; an event is text or an
    object."""
    df = lines(spark, path).where(F.trim("value") != "")
    v = F.from_json("value", "time string, host string, source string, sourcetype string, index string, event string, fields map<string,string>")
    made = df.select(v.alias("v"), "_source", "_at").where("v.event is not null")
    made = made.select(any_time(F.col("v.time")).alias("_time"), F.col("v.event").alias("_raw"), F.coalesce(F.col("v.source"), F.col("_source")).alias("_source"), F.coalesce(F.col("v.sourcetype"), F.lit("hec")).alias("_sourcetype"), F.col("v.host").alias("host"), F.coalesce(F.col("v.index"), F.lit("main")).alias("index"), F.col("v.fields").alias("fields"), "_at")
    out = from_dataframe(made, ["_source", "_at"])
    return out.having(out.df.drop("_at"))


def read_otlp(spark: SparkSession, path: str) -> Frame:
    """OTLP log exports in JSON: resourceLogs, scopeLogs and logRecords exploded, attributes as maps of text."""
    value = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
    attrs = f"array<struct<key:string,value:{value}>>"
    record = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:long,severityText:string,body:{value},attributes:{attrs},traceId:string,spanId:string>"
    schema = f"resourceLogs array<struct<resource:struct<attributes:{attrs}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<{record}>>>>>"
    df = lines(spark, path).select(F.from_json("value", schema).alias("v"), "_source", "_at")
    df = df.select(F.posexplode("v.resourceLogs").alias("i", "r"), "_source", "_at")
    df = df.select(F.col("r.resource.attributes").alias("ra"), F.posexplode("r.scopeLogs").alias("j", "s"), "i", "_source", "_at")
    df = df.select("ra", F.col("s.scope.name").alias("scope"), F.posexplode("s.logRecords").alias("k", "l"), "i", "j", "_source", "_at")
    text = lambda c: F.coalesce(c["stringValue"], c["intValue"], c["doubleValue"], c["boolValue"])
    to_map = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(attrs)), lambda x: F.struct(x["key"].alias("k"), text(x["value"]).alias("v"))))
    resource = to_map(F.col("ra"))
    nano = F.coalesce(F.nullif(F.col("l.timeUnixNano"), F.lit("0")), F.col("l.observedTimeUnixNano")).try_cast("bigint")
    made = df.select(F.timestamp_micros((nano / 1000).cast("bigint")).alias("_time"), text(F.col("l.body")).alias("_raw"), F.coalesce(F.try_element_at(resource, F.lit("service.name")), F.col("_source")).alias("_source"), F.lit("otlp").alias("_sourcetype"), F.try_element_at(resource, F.lit("host.name")).alias("host"), F.lit("main").alias("index"), F.col("l.severityText").alias("level"), F.col("l.severityNumber").alias("severity_number"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), F.col("scope").alias("scope"), to_map(F.col("l.attributes")).alias("attributes"), resource.alias("resource"), "_at", "i", "j", "k")
    out = from_dataframe(made, ["_at", "i", "j", "k"])
    return out.having(out.df.drop("_at", "i", "j", "k"))


def dedup_batch(df: DataFrame, keys: tuple[str, ...] = ("_time", "_raw", "_source", "host")) -> DataFrame:
    """Events that were delivered twice, once."""
    return df.dropDuplicates([k for k in keys if k in df.columns])
