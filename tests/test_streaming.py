from tidemark.streaming import ingest


def test_records_arrive_as_a_stream(spark, folder, tmp_path):
    schema = spark.read.parquet(f"{folder}/records.parquet").schema
    (tmp_path / "in").mkdir()
    rows = spark.read.parquet(f"{folder}/records.parquet")
    rows.unionByName(rows).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    ingest.into_corpus(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    good, bad = spark.read.parquet(str(tmp_path / "out/records")), spark.read.parquet(str(tmp_path / "out/refused"))
    assert good.count() + bad.count() == rows.where("ingested_at is not null").count()
    assert good.groupBy("record_id").count().where("count > 1").isEmpty()
