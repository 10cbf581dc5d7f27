"""State and windows over small file streams."""

from pyspark.sql import functions as F

from quillon.streaming import state, windows

JOBS = "job_id string, state string, at timestamp"


def polled(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "job_id string, state string, at string").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def ran(df, spark, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_changes_only(spark, tmp_path):
    stream = polled(spark, tmp_path, [("a", "queued", "2024-01-01 00:00:00")], [("a", "queued", "2024-01-01 00:05:00")], [("a", "running", "2024-01-01 00:10:00"), ("b", "queued", "2024-01-01 00:10:00")])
    got = sorted(((j, o, n) for j, o, n, _ in ran(state.changes(stream), spark, tmp_path, "changes")), key=str)
    assert got == sorted([("a", None, "queued"), ("a", "queued", "running"), ("b", None, "queued")], key=str)


def test_expiry_by_event_time(spark, tmp_path):
    stream = polled(spark, tmp_path, [("a", "queued", "2024-01-01 00:00:00")], [("b", "queued", "2024-01-01 02:00:00")], [("c", "queued", "2024-01-01 02:01:00")])
    assert ("a",) in ran(state.expired(stream, 600), spark, tmp_path, "expired")


def test_stream_windows_agree_with_table(spark, tmp_path, data):
    table = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "user_id")
    table.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "e"))
    got = ran(windows.tumbling(stream, "ts", "1 day", "event_type"), spark, tmp_path, "days", "complete")
    assert sorted(got) == sorted(tuple(r) for r in windows.tumbling(table, "ts", "1 day", "event_type").collect())


def test_activity_is_incremental(spark, tmp_path):
    log = spark.createDataFrame([("n1", "write", "2024-01-01"), ("n1", "read", "2024-01-02"), (None, "read", "2024-01-02")], "notebook string, op string, t string").select("notebook", "op", F.to_timestamp("t").alias("timestamp"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    assert [(r[0], r[2], r[3]) for r in ran(state.activity(stream), spark, tmp_path, "activity", "complete")] == [("n1", 1, 1)]
