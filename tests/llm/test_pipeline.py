"""The pipeline on the smallest tables: each stage against its own input, and the rest of the library without it."""

import pytest

import corpus_pipeline
from weft.llm import jaccard, quality

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, D).cache()
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    second = corpus_pipeline.near_duplicates(spark, first, D).cache()
    assert second.columns == docs.columns
    assert {r.doc_id for r in second.collect()} == {r.component_id for r in jaccard.join(first).collect()}
    third = corpus_pipeline.secret_scans(spark, second, D).cache()
    assert third.columns == docs.columns and third.count() == second.count()
    fourth = corpus_pipeline.mixture(spark, third, D)
    assert fourth.columns == docs.columns and fourth.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _blob string, _copies int, hub int"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, stage):
    """Nulls in any column, empty and very long texts, repeated rows, rows that share an id, columns that clash; and no rows."""
    words = lambda k: " ".join(f"{chr(97 + (i * 7 + k) % 26) * 3}{i + k}" for i in range(40))
    rows = [(None, None, None, None, None, "x", 1, 2), (1, "", "en", "a", 0, None, None, None), (2, words(1), None, "a", 9, "x", 1, 2), (2, words(1), None, "a", 9, "x", 1, 2), (2, words(50), "en", None, 9, "x", 1, 2)]
    rows += [(3, LONG, "en", "b", 9, "x", 1, 2), (None, words(90), "en", "b", 9, "x", 1, 2), (4, words(200) + ' token = "abcdef0123456789"', "de", "b", 9, "x", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    apply = dict(corpus_pipeline.STAGES)[stage]
    out = apply(spark, docs, D)
    got = out.collect()
    last = stage == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == docs.columns
    kept = {"quality rules": lambda n: 5 <= n <= 6, "near duplicates": lambda n: n == 7, "secret scans": lambda n: n == 8, "mixture": lambda n: n > 0, "tokens": lambda n: n == 8}[stage]
    assert kept(len(got)), len(got)
    if stage == "secret scans":
        assert not any("abcdef0123456789" in (r.text or "") for r in got)
    if not last:
        assert {r._blob for r in got} <= {"x", None} and {r.hub for r in got} <= {2, None}
    assert apply(spark, docs.where("doc_id < -1"), D).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.count() and {"doc_id", "n_tokens"} <= set(out.columns)
