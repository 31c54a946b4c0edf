from labelprism.streaming import scored_stream


def test_scoring_runs_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "the cat and of"), (2, "nothing here")], "id long, text string") \
         .write.parquet(str(src))
    stream = spark.readStream.schema("id long, text string").parquet(str(src))
    q = (scored_stream(stream, "id", "text", [(["the"], 1.0), (["and", "of"], 2.0)])
         .writeStream.format("memory").queryName("scored").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.score for r in spark.sql("SELECT * FROM scored").collect()}
    assert got == {1: 3.0, 2: 0.0}


def test_start_scoring_file_sink_resumes(spark, tmp_path):
    from labelprism.streaming import start_scoring
    src, sink, ck = tmp_path / "src", tmp_path / "sink", tmp_path / "ck"
    spark.createDataFrame([(1, "the and of")], "id long, text string").write.parquet(str(src / "a"))
    rules = [(["the"], 1.0), (["and", "of"], 2.0)]
    q = start_scoring(spark, str(src / "*"), "id long, text string", "id", "text", rules, str(sink), str(ck))
    q.processAllAvailable()
    q.stop()
    # a new file arrives; the restarted query only scores what is new
    spark.createDataFrame([(2, "the")], "id long, text string").write.parquet(str(src / "b"))
    q = start_scoring(spark, str(src / "*"), "id long, text string", "id", "text", rules, str(sink), str(ck))
    q.processAllAvailable()
    q.stop()
    got = sorted((r.id, r.score) for r in spark.read.parquet(str(sink)).collect())
    assert got == [(1, 3.0), (2, 1.0)]
