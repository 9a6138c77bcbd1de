"""Incremental ingest processes each file once across runs."""

from clauselens.streaming.incremental import incremental_ingest


def test_incremental_exactly_once(spark, tmp_path):
    schema = "doc_id string, text string"
    src, sink, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("a", "Agreement between A Corp and B Ltd. Payment Terms: net 30.")], schema) \
        .write.parquet(src + "/batch=1")
    n1 = incremental_ingest(spark, src, spark.createDataFrame([], schema).schema, sink, ck, "doc_id")
    spark.createDataFrame([("b", "Nothing here."), ("c", "Termination. Either party may end it.")], schema) \
        .write.parquet(src + "/batch=2")
    n2 = incremental_ingest(spark, src, spark.createDataFrame([], schema).schema, sink, ck, "doc_id")
    n3 = incremental_ingest(spark, src, spark.createDataFrame([], schema).schema, sink, ck, "doc_id")
    out = spark.read.parquet(sink)
    assert (n1, n2, n3) == (1, 2, 0)
    assert sorted(r["doc_id"] for r in out.collect()) == ["a", "b", "c"]
    assert out.where("doc_id = 'a'").collect()[0]["party_a"] == "A Corp"
