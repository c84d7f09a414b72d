"""A document that many sources carry whole is thinned out by near-dedup, not emptied by line dedup."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from emberlog.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_copies_keep_their_lines_and_boilerplate_goes(spark):
    copied = "a line of its own\nand another one"
    rows = [(i, copied if i % 2 else f"  {copied.upper()} ", f"s{i}") for i in range(12)] + [(20 + i, f"text {i}\nfooter of all", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {k: (t, len(t)) if k < 20 else (f"text {k - 20}", len(f"text {k - 20}")) for k, t, _ in rows}


def test_one_copy_survives_run(spark, tmp_path):
    docs = table(spark, SF, "documents")
    body = docs.where("lang = 'en' and n_chars > 1500").orderBy("doc_id").first().text[:900]
    marked = "\n".join(f"{x} number {i}" for i, x in enumerate(body.split(". ")))
    copies = spark.range(8).select((F.col("id") + 50_000).alias("doc_id"), F.lit(marked).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id")).alias("source"), F.lit(len(marked)).cast("long").alias("n_chars"))
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in kept.where("doc_id >= 50000").collect()} == {50_000}
