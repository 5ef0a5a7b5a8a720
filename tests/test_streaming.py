from foliospark.streaming import text_stream as S


def _run(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_event_windows_equal_batch(spark, sf):
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = _run(spark, S.event_windows(stream), "complete", "w")
    want = S.event_windows(batch)
    key = lambda df: sorted((str(r.bucket), r.event_type, r.n, round(r.total or 0, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_chunks_equal_batch(spark, sf):
    batch = spark.read.parquet(f"{sf}/documents.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    key = lambda df: sorted((r.doc_id, r.chunk_index, r.content) for r in df.collect())
    assert key(_run(spark, S.stream_chunks(stream, 64, 8), "append", "c")) == key(S.stream_chunks(batch, 64, 8))


def test_text_positions(spark, tmp_path):
    rows = [("a", 0, 0, "one", 12.0), ("a", 0, 1, "two", 12.0), ("b", 0, 0, "x", 4.0), ("b", 0, 1, None, 12.0)]
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, seq int, text string, font_size double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = [(r.doc_id, r.first_position, r.last_position, r.text) for r in _run(spark, S.stream_text(stream, 6.0), "append", "t").collect()]
    assert got == [("a", 0, 7, "one two")]
