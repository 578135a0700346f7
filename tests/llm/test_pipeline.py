"""The pipeline's stages on what their predecessors kept."""

import corpus_pipeline
from curlew.llm.decontaminate import decontaminate
from curlew.llm.ngram_join import similar_documents


def test_stages_keep_columns_and_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "n-gram Jaccard join":
            groups = similar_documents(docs).select("component_id").distinct()
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.component_id for r in groups.collect())
        if name == "benchmark decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate(out, items).filter("contaminated").isEmpty()
        if name == "secret scans":
            assert out.count() == docs.count()
            assert out.filter(out.text.rlike("AKIA[0-9A-Z]{16}")).isEmpty()
        docs = out
    assert {"shard", "slot", "doc_id", "words"} <= set(docs.columns)


def test_one_row_of_each_group_stays(spark, sf):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "clean text of its own here"), (1, "another text with nothing in common"), (None, long), (None, long), (None, long + " end"), (None, ""), (None, "")]
    rows += [(4, long.upper().replace("W", "v")), (None, long.replace("w", "v")), (4, long.replace("w", "v") + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()]
    assert {r for r in rows if r[0] == 1} <= set(out)
    assert sum(i is None and (t or "").startswith("w0") for i, t in out) == 1
    assert sum((t or "").lower().startswith("v0") for _, t in out) == 1 and sum(i == 4 for i, _ in out) == 1
    assert out.count((None, "")) == 2 and len(out) == 6


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.isEmpty()
