"""Line dedup (operator 6), native: lines that many sites carry are removed as boilerplate.

A line is what stands between line feeds, without white space at its ends; lines without a character are never
removed.  HyperLogLog sketches of the sites are built straight from the rows for each line's hash, within each task
first, and merged by aggregation: a line's share of the shuffle doesn't grow with its sites.  Lines whose estimate lies
within `margin` of the threshold get exact distinct counts, and only these lines' sites are dealt out one by one; the
rest are decided by the sketch, whose error is far smaller than the margin.  Lines of at least `min_sites` sites are
removed from every document.

A line that only one site carries is settled by the least and greatest site alone.  Null sites count as no site.  Null
texts stay null, empty texts stay empty, and a text whose lines all go becomes empty.  Repeated rows add no site and are
each cleaned; nothing depends on ties.  Long texts are split by Spark within their row.  Columns named as the results
are replaced.  Everything is DataFrame functions; sites per line are sketched or counted, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

MIN_SITES = 5
LG_K = 12  # a relative error of 1.6 %
MARGIN = 0.25


def _clean(line):
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _hashes(text):
    """Hashes of a text's lines in order; null for a blank line."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(_clean(x) != "", F.xxhash64(_clean(x))))


def spread_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """`line` long: the hashes of the lines that at least `min_sites` distinct sites carry."""
    rows = df.select(F.col(site).cast("string").alias("site"), F.explode(_hashes(F.col(text).cast("string"))).alias("line")).where("line is not null and site is not null")
    ends = rows.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b"))
    if min_sites <= 1:
        return ends.select("line")
    several = staged(ends.where("a <> b").select("line"))
    rows = rows.join(several, "line", "left_semi")
    sketches = staged(rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("sites")))
    sure = sketches.where(F.col("sites") >= min_sites * (1 + margin)).select("line")
    near = sketches.where((F.col("sites") < min_sites * (1 + margin)) & (F.col("sites") >= min_sites * (1 - margin))).select("line")
    pairs = rows.join(staged(near), "line", "left_semi").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line")
    return sure.unionByName(exact)


def remove_spread(df: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES, margin: float = MARGIN, out: str = "kept", counted: DataFrame | None = None, counts: bool = True) -> DataFrame:
    """`df` with `out` (the text without boilerplate lines) and, with `counts`, n_lines and n_removed.

    counted: the rows whose sites count, if not all (`one_of_each`).

    Rows of one key share the set of removed hashes, all of which are boilerplate, so repeated keys are right too.
    """
    # Written first: Spark then knows its size, and can split a skewed join over two plain exchanges.
    spread = staged(spread_lines(df if counted is None else counted, text, site, min_sites, margin))
    body, own, gone, left = F.col(text).cast("string"), *(fresh(df, x) for x in ("_key", "_gone", "_left"))
    rows = df.select(F.col(key).alias(own), F.explode(_hashes(body)).alias("line")).where("line is not null")
    hits = rows.join(spread, "line", "left_semi").groupBy(own).agg(F.collect_set("line").alias(gone))
    joined = df.join(hits, F.col(key).eqNullSafe(F.col(own)), "left")
    all_lines, removed = F.split(body, "\n"), F.coalesce(F.col(gone), F.array().cast("array<bigint>"))
    kept = F.filter(all_lines, lambda x: (_clean(x) == "") | ~F.array_contains(removed, F.xxhash64(_clean(x))))
    n = lambda x: F.coalesce(F.when(body.isNotNull(), F.size(x)), F.lit(0)).cast("long")
    joined = joined.withColumn(left, F.when(F.size(removed) > 0, kept).otherwise(all_lines))
    counts = [(n(all_lines), "n_lines"), (n(all_lines) - n(F.col(left)), "n_removed")] if counts else []
    rest = [F.col(c) for c in df.columns if c not in (out, *(name for _, name in counts))]
    return joined.select(*rest, F.array_join(left, "\n").alias(out), *(c.alias(name) for c, name in counts))


def one_of_each(df: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """`text` and `site` of one row of each group of texts that are equal but for case and white space.

    The row is that of least hash of text and site, so that groups which many sites carry fall to different sites.
    Rows without a site count for no line and are left out.
    """
    body = F.col(text).cast("string")
    words = F.btrim(F.regexp_replace(F.lower(body), "[ \\t\\n\\x0B\\f\\r]+", " "))
    rows = df.where(body.isNotNull() & F.col(site).isNotNull()).select(body.alias(text), F.col(site).cast("string").alias(site), F.xxhash64(words).alias("_same"))
    rows = rows.withColumn("_rank", F.xxhash64("_same", site, text))
    least = staged(rows.groupBy("_same").agg(F.min("_rank").alias("_rank")))
    return staged(rows.join(least, ["_same", "_rank"]).select(text, site))
