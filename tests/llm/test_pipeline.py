"""The pipeline's stages one by one, each against a plain version on what the one before has kept."""

import hashlib

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from emberlog.llm import langid, mixing  # noqa: E402
from emberlog.llm.common import held_out  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each one."""
    from emberlog.llm.common import staged, table

    extra = spark.createDataFrame([(10_001, None, "en", "src1", None), (10_002, "12 34 !!", "en", "src1", 8), (10_003, "", "fr", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = [staged(table(spark, SF, "documents").unionByName(extra))]
    for _, f in pipeline.STAGES:
        out.append(staged(f(spark, out[-1], SF)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_id_rejects_what_has_no_language(stages):
    model = langid.fit(stages[0], ~held_out())
    want = sorted(r.doc_id for r in stages[0].collect() if (p := model.predict(r.text))[0] != "und" and p[1] >= pipeline.LEAST_SCORE)
    got = sorted(r.doc_id for r in stages[1].collect())
    assert got == want and not {10_001, 10_002, 10_003} & set(got) and len(got) >= 195


def test_lines_of_many_sources_go(stages):
    rows = stages[1].collect()
    sites = {}
    for r in rows:
        for x in r.text.split("\n"):
            if x.strip(" \t\r\x0b\x0c") and r.source is not None:
                sites.setdefault(x.strip(" \t\r\x0b\x0c"), set()).add(r.source)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(sites.get(x.strip(" \t\r\x0b\x0c"), ())) < 5) for r in rows}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_one_of_each_near_duplicate_group_stays(stages):
    """The stage's rule is five words and a similarity of 0.8, not operator 4's own two bits of three words."""
    from tests.llm.test_near_copies import brute

    found = brute([(r.doc_id, r.text) for r in stages[2].collect()])
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(found.values())) and len(set(found.values())) < len(found)


def test_the_mix_follows_the_weights(stages):
    rows = mixing.mix(stages[3]).collect()
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {r.doc_id: r.copies for r in rows if r.copies} and max(got.values()) <= 2
    taken = sum(r["size"] * got.get(r.doc_id, 0) for r in rows)
    assert abs(taken - sum(r.taken for r in rows)) <= 0.1 * taken


def test_tokens_decode_to_the_texts(stages):
    texts = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in stages[5].collect()) == texts


def test_run_is_the_stages_in_turn(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.where(F.col("n_tokens") < 0).count() == 0 and got.count() > 150


def test_empty_input(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0


def test_clashing_names_and_repeated_rows(spark):
    """Columns named as what the operators make come through as they were; repeated rows are thinned to one."""
    from tests.llm.test_operators import clashing

    body = "the same words in a row make a text that stays in the language it was written in and no other one " * 3
    rows = [(1, body, "en", "s1", len(body))] * 3 + [(None, body, "en", "s2", 1), (2, "other words entirely, and of their own kind, for a second document", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = clashing(docs).withColumns({c: F.lit(7) for c in ("n_lines", "n_removed", "_kept", "_nth", "root", "sid")})
    lined = pipeline.line_dedup(spark, wide, "")
    assert lined.columns == wide.columns and {(r.n_lines, r.n_removed) for r in lined.collect()} == {(7, 7)}
    kept = pipeline.near_dedup(spark, lined, "")
    assert kept.columns == wide.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    mixed = pipeline.mix_sources(spark, kept, "")
    assert mixed.columns == wide.columns and {r.sid for r in mixed.collect()} <= {7}
