"""From raw documents to token counts: language ID, line dedup, near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of `documents`.  Line dedup changes `text` (and `n_chars`), mixing repeats or drops rows to reach the target
weights, and the last stage returns a row of digests for each row of the mix.

Null and empty texts have no language and go in the first stage.  Repeated rows are copies like any other: near-dedup
keeps one of them.  Rows without a doc_id can't be named, so near-dedup leaves them.  Rows without a source count for no
line and form a source of their own in the mix.  Extra columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, langid, lines, mixing, resemble
from emberlog.llm.common import fresh, held_out, prepare, staged, table
from emberlog.llm.queries import VOCABULARY

#: A text is rejected if it has no letter, or if no language is likelier than this.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in no known language."""
    prepare(spark)
    model = langid.fit(docs, ~held_out())
    place = [f"_{i}" for i in range(len(docs.columns))]  # clashing names can't meet the model's own
    moved = docs.toDF(*place).withColumn("_t", F.col(place[docs.columns.index("text")]))
    found = langid.predict(moved, model, text="_t", keep=tuple(place))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(p).alias(c) for p, c in zip(place, docs.columns)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that many sources carry in different texts: copies of a text count as one, so that a copied
    document keeps its lines and the next stage thins it out."""
    prepare(spark)
    kept = fresh(docs, "_kept")
    found = lines.remove_spread(docs, out=kept, counted=lines.one_of_each(docs), counts=False)
    new = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a five-word Jaccard similarity of at least 0.8: that of the least
    doc_id.  SimHash of five-word shingles links what differs in two bits, which is verified; what lies beyond that
    radius is found by prefixes."""
    prepare(spark)
    return resemble.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources meet their target weights."""
    prepare(spark)
    return mixing.repeat(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode each document of the mix."""
    import public_tokenizers

    prepare(spark)
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenize),
]
#: No SQL expresses the trained model of the first stage or the groups of the third; tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
