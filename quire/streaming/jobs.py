"""The job log as a stream: counts, bursts and duplicates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.relational import status_name


def read_stream(spark: SparkSession, folder: str, schema, max_files: int = 16) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per status; for output mode complete. Its state is one row per status."""
    return jobs.groupBy(status_name(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def once_within(jobs: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first delivery of a key; repeats within the watermark are dropped and the state stays bounded."""
    return jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def bursts(jobs: DataFrame, at: str, gap: str = "2 seconds", late: str = "1 hour") -> DataFrame:
    """Bursts of jobs of a type: sessions that end after a gap; for output mode append."""
    rows = jobs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy("task_type", F.session_window(at, gap).alias("w")).agg(F.count("*").alias("jobs")).select("task_type", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "jobs")


def start(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Writes what is there now and stops; exactly once through the checkpoint."""
    return rows.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
