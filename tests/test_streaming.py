from pyspark.sql import functions as F

from quire.streaming import jobs as J

SCHEMA = "id bigint, status string, task_type string, created_at timestamp_ntz"


def write(spark, folder, rows):
    spark.createDataFrame(rows, "id bigint, status string, task_type string, at string").select("id", "status", "task_type", F.to_timestamp_ntz("at").alias("created_at")).coalesce(1).write.mode("append").parquet(folder)


def test_counts_bursts_and_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, "queued", "a", "2024-01-01 00:00:00"), (1, "queued", "a", "2024-01-01 00:00:00"), (2, "Queued ", "a", "2024-01-01 00:00:01"), (3, "done", "a", "2024-01-01 00:01:00"), (4, "done", "a", "2024-01-02 00:00:00")])
    stream = J.read_stream(spark, src, SCHEMA)
    query = J.status_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["status"]: r["n"] for r in spark.table("counts").collect()} == {"queued": 3, "done": 2}
    J.start(J.once_within(stream, "id", "created_at"), str(tmp_path / "once"), str(tmp_path / "ck1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 4
    J.start(J.bursts(stream, "created_at"), str(tmp_path / "bursts"), str(tmp_path / "ck2")).awaitTermination(120)
    assert sorted(r["jobs"] for r in spark.read.parquet(str(tmp_path / "bursts")).collect())[-1] == 3
