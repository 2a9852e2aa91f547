"""The whole pipeline against plain Python, and the queries with SQL against it."""

import pytest

import corpus_pipeline
from corpusloom.llm import quality_rules
from corpusloom.llm import queries as q

from ..oracle import connect, same
from . import plain
from .test_edges import ROWS


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_equals_sql(spark, sf, con, name):
    assert same(q.QUERIES[name](spark, sf), con, q.ORACLE[name]) is None


def test_run_equals_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.source, r.text) for r in docs.collect())
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = plain.good(rows, model, quality_rules.MIN_SCORE)
    rows = plain.without_repeats(rows)
    rows = plain.one_each(rows)
    rows = plain.clean(rows, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    taken, texts = plain.mixed(rows), {d: t for d, _, t in rows}
    got = sorted((r.doc_id, r.copy_no, r.text) for r in corpus_pipeline.run(spark, sf).collect())
    want = sorted((d, k, texts[d]) for d, n in taken.items() for k in range(1, n + 1))
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_take_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeated rows, other columns, and empty tables, at every stage."""
    rows = [(i, t, "en", None if i == 7 else "a", 1, "x") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k_id string")
    ids = {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf).collect()
        assert {r.doc_id for r in got} <= ids and {r.k_id for r in got} == {"x"}, name
        assert stage(spark, docs.limit(0), sf).collect() == [], name
    kept = lambda n: [r.doc_id for r in corpus_pipeline.STAGES[n][1](spark, docs, sf).collect()]
    assert 4 in kept(0) and not {2, 3} & set(kept(0))
    assert sorted(map(str, kept(1))) == sorted(map(str, (r[0] for r in rows)))
    assert sorted(map(str, kept(3))) == sorted(map(str, (r[0] for r in rows)))
    assert not {2, 3} & set(kept(4))


def test_a_stage_keeps_scratch_that_its_input_reads(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = corpus_pipeline.line_stage(spark, docs, sf)
    two = corpus_pipeline.near_stage(spark, one, sf)  # one is not written
    assert 0 < two.count() <= one.count()
