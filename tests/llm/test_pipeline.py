import corpus_pipeline
from gleaner.llm import quality_classifier, simhash_dedup


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]


def test_run(spark, docs, rows, tmp_path):
    here = f"file://{tmp_path}"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{here}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{here}/labels.parquet")
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(f"{here}/benchmark.parquet")
    d = spark.read.parquet(f"{here}/documents.parquet")
    good = {r.doc_id for r in quality_classifier.accepted(d, spark.read.parquet(f"{here}/labels.parquet")).collect()}
    out = corpus_pipeline.run(spark, here).collect()
    ids = {r.doc_id for r in out}
    assert ids <= good and 9 not in ids
    one = {r.doc_id for r in simhash_dedup.survivors(d.where(d.doc_id.isin(list(good)) | d.doc_id.isNull())).collect()}
    assert ids <= one and len(ids & {3, *range(100, 108)}) <= 1
    assert {"doc_id", "size", "shard", "slot"} <= set(out[0].asDict())


def test_queries_against_sql(spark):
    import os
    import sys

    import pytest

    from gleaner.llm import queries

    here = "/root/testdata/sf0.001"
    if not os.path.isdir(here):
        pytest.skip("no tables here")
    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    import oracle

    con = oracle.connection(here)
    for name, sql in queries.oracle_sql().items():
        assert oracle.compare(queries.queries()[name](spark, here), con, sql) == "", name
