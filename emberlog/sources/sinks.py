"""Results as files and as text."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = ("json", "ndjson", "csv", "tsv", "parquet", "raw")
#: Rows that the renderers for reading show, with a line that says so; files and the other kinds hold all.
SHOWN = 1000
READ = ("table", "markdown", "box", "ascii", "glimpse", "vertical", "line")


def write(df: DataFrame, path: str, kind: str = "json", mode: str = "append") -> None:
    """All rows as files of one kind."""
    w = df.write.mode(mode)
    if kind in ("json", "ndjson"):
        w.json(path)
    elif kind in ("csv", "tsv"):
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes))
        flat.write.mode(mode).csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind == "parquet":
        w.parquet(path)
    elif kind == "raw":
        df.select(F.col("_raw").cast("string").alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown kind {kind}; one of {', '.join(FILES)}")


def _plain(x):
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return round(x, 8)
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if hasattr(x, "isoformat"):
        text = x.isoformat()
        return text.replace("+00:00", "") + "Z" if "T" in text else text
    return str(x)


def render(df: DataFrame, kind: str = "table", limit: int | None = None) -> str:
    """Rows as table, markdown, box, ascii, glimpse, vertical, line (of these the first SHOWN, unless `limit` says
    otherwise, and a note if there are more), json, ndjson, csv, tsv or raw."""
    limit = SHOWN if limit is None and kind in READ else limit
    found = (df if limit is None else df.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        return render(df.sparkSession.createDataFrame(found[:limit], df.schema), kind, limit) + (f"\n... and more; the first {limit} rows are shown" if kind in READ else "")
    rows = [{c: _plain(r[c]) for c in df.columns} for r in found]
    cell = lambda x: "" if x is None else json.dumps(x) if isinstance(x, (dict, list, bool)) else str(x)
    if kind == "json":
        return json.dumps(rows, sort_keys=True)
    if kind == "ndjson":
        return "\n".join(json.dumps(r, sort_keys=True) for r in rows)
    if kind in ("csv", "tsv"):
        out = io.StringIO()
        w = csv.writer(out, delimiter="," if kind == "csv" else "\t", lineterminator="\n")
        w.writerow(df.columns)
        w.writerows([[cell(r[c]) for c in df.columns] for r in rows])
        return out.getvalue()
    if kind == "raw":
        return "\n".join(str(r.get("_raw") or "") for r in rows)
    if kind == "line":
        return "\n".join(" ".join(f"{c}={cell(r[c])}" for c in df.columns) for r in rows)
    if kind == "vertical":
        wide = max(map(len, df.columns), default=0)
        return "\n".join(f"--- {i + 1}\n" + "\n".join(f"{c:>{wide}}: {cell(r[c])}" for c in df.columns) for i, r in enumerate(rows))
    if kind == "glimpse":
        wide = max(map(len, df.columns), default=0)
        return "\n".join(f"{c:<{wide}} <{t}> " + ", ".join(cell(r[c]) for r in rows[:10]) for c, t in df.dtypes)
    table = [df.columns, *[[cell(r[c]) for c in df.columns] for r in rows]]
    wide = [max(len(row[i]) for row in table) for i in range(len(df.columns))]
    if kind in ("box", "ascii"):
        (a, b, c), (d, e, f), (g, h, i), bar, dash = ("┌┬┐", "├┼┤", "└┴┘", "│", "─") if kind == "box" else ("+++", "+++", "+++", "|", "-")
        edge = lambda x, y, z: x + y.join(dash * (w + 2) for w in wide) + z
        body = [bar + bar.join(f" {x.ljust(w)} " for x, w in zip(row, wide)) + bar for row in table]
        return "\n".join([edge(a, b, c), body[0], edge(d, e, f), *body[1:], edge(g, h, i)])
    lines = ["| " + " | ".join(x.ljust(w) for x, w in zip(row, wide)) + " |" for row in table]
    rule = "|" + "|".join("-" * (w + 2) for w in wide) + "|"
    if kind not in ("table", "markdown"):
        raise ValueError(f"unknown kind {kind}")
    return "\n".join([lines[0], rule, *lines[1:]])
