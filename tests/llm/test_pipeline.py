import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_odd_rows(spark, tmp_path):
    from test_edges import DOCS, rows  # noqa: PLC0415

    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, data in enumerate((rows(), [])):
        docs = spark.createDataFrame(data, DOCS).withColumn("n_chars", pipeline.F.length("text").cast("long"))
        columns = docs.columns
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(pipeline.STAGES) - 1:
                assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{n}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}/{name}")
        assert (docs.count() > 0) == bool(data)
