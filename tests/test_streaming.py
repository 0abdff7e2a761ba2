from ledgerloom.streaming.live import follow


def test_events_wait_for_the_gap_before_them(spark, tmp_path):
    batches = [[("a", 2, "Response"), ("a", 3, "Request")], [("a", 1, "Request"), ("b", 1, "Request"), ("a", 2, "Response"), (None, 1, "x")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "log_id string, time bigint, kind string").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        if i == 0:
            stream = spark.readStream.schema("log_id string, time bigint, kind string").parquet(str(tmp_path / "in"))
            query = (
                follow(stream).writeStream.format("memory").queryName("followed").outputMode("append")
                .option("checkpointLocation", str(tmp_path / "cp")).start()
            )
        query.processAllAvailable()
    rows = sorted(map(tuple, spark.sql("select * from followed").collect()))
    query.stop()
    assert rows == [
        ("a", 1, "Request", "accepted", 1), ("a", 2, "Response", "accepted", 0), ("a", 2, "Response", "duplicate", 0),
        ("a", 3, "Request", "accepted", 1), ("b", 1, "Request", "accepted", 1),
    ]
