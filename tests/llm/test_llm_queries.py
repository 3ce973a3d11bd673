"""The registered queries and the pipeline."""

import pytest

from corpusmill.llm import queries

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_late_sessions", "op13_collocations"}))
def test_a_row_for_each_row(name, spark):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    source = "pages" if "page_id" in got.columns else "documents"
    n = spark.read.parquet(f"{DATA}/sf0.001/{source}.parquet").count()
    if name == "op10_packing":
        assert got.select("doc_id").distinct().count() == n
    else:
        assert got.count() == n


def test_quality_on_held_out_rows(spark):
    got = queries.QUERIES["op2_quality_classifier"](spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_imatch_tells_edits_from_neighbours(spark):
    rows = queries.QUERIES["op8_imatch_fingerprints"](spark, f"{DATA}/sf0.01").collect()
    assert sum(r.near_edited > 0.1 for r in rows) > 0.85 * len(rows)
    assert sum(r.near_next > 0.1 for r in rows) < 0.05 * len(rows)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    odd = [(90_001, None, None, None, None), (90_002, "", "en", "src0", 0), (90_003, "\x01\x02\x03" * 50, "en", "src0", 150), (None, "a null id", "en", "src0", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.orderBy("doc_id").limit(1))
    clean = docs.orderBy("doc_id").where("doc_id is not null")
    before = docs.count()
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, f"{DATA}/sf0.001"), name)
        if name != "packing":
            assert docs.columns == p.COLUMNS
            assert docs.count() <= before
            before = docs.count()
    assert docs.where("doc_id = 90003").count() == 0
    assert clean.count() > 0 and docs.agg({"length": "sum"}).first()[0] > 0


def test_pipeline_exact_dedup_judges_each_row_by_its_text(spark):
    import corpus_pipeline as p

    rows = [(0, "A"), (1, "A"), (1, "B"), (2, "B"), (3, "é c"), (3, "é  c"), (3, "D"), (4, None), (5, " \n"), (6, "D"), (6, "D"), (None, "A"), (None, "E")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in p.exact_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(0, "A"), (1, "B"), (3, "é  c"), (3, "D"), (5, " \n"), (None, "A"), (None, "E")], key=str)


def test_pipeline_stages_on_no_rows(spark):
    import corpus_pipeline as p

    none = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, f"{DATA}/sf0.001").collect() == []
