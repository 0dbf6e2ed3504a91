"""The pipeline: its stages' columns, and its rows against the operators applied one by one."""

import pytest

import corpus_pipeline
from codeloom.llm import near_dedup

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n <= before and docs.select("doc_id").distinct().count() == n
        if name == "near_dedup":
            assert near_dedup.link(docs, words=5).where("not stays").count() == 0
        before = n
    got = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, name string, n_tokens long, component_id long"


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with nulls in all columns, empty and very long texts, repeated rows and ids, and columns of the operators' own names."""
    texts = [None, "", " \n", "one word", "the same text in two rows of the table here", "the  same text in two\nrows of the table here", "a long text " * 20_000, *(f"some plain words of row {k} that nobody else has in this table {k * 7} {k * 11}" for k in range(30))]
    rows = [(k, t, "en", f"s{k % 3}", 1, True, "n", 5, 9) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (11, "another text of an id that comes twice and is not like the first", None, None, None, None, None, None, None), (None, "a text without an id of its own in this table", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k > 2), 0) for k in range(20)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, whole = docs.columns, {}
    for r in docs.collect():
        whole[tuple(r)] = whole.get(tuple(r), 0) + 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd).cache()
        assert docs.columns == columns
        left = {}
        for r in docs.collect():
            left[tuple(r)] = left.get(tuple(r), 0) + 1
        assert all(n <= whole.get(r, 0) for r, n in left.items()), name
        if name != "quality":
            texts = [" ".join((r[1] or "").split()) for r in left]
            assert len(texts) == len(set(texts)) and all(n == 1 for n in left.values()), name
        whole = left
    assert corpus_pipeline.run(spark, odd).count() == sum(whole.values()) > 10


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
