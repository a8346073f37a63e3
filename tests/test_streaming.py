from kinsieve.streaming.incremental import start


def test_groups_over_several_files(spark, tmp_path):
    rows = [(1, "The cat sat"), (2, "sat THE cat"), (3, "other"), (4, "The cat sat"), (5, None), (6, "")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append" if k else "overwrite")
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    start(stream, "stream_groups", f"{tmp_path}/state").awaitTermination(60)
    got = [(r.forms, r.first_id) for r in spark.table("stream_groups").where("forms >= 2").collect()]
    assert got == [(3, 1)]
