"""Sinks: reports as JSON and guarded CSV, subtitles, and one folder per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.names import csv_safe, srt_time


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A report of several sheets: one sub-folder each, readable again by name."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(rows: DataFrame, folder: str) -> None:
    """All columns quoted; strings that a spreadsheet would run as formulas are guarded."""
    safe = [csv_safe(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in rows.dtypes]
    rows.select(*safe).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(folder)


def write_by_language(rows: DataFrame, folder: str, language: str = "lang") -> None:
    """One sub-folder per language. Rows stay in their partitions, so a hot language is no single task."""
    rows.withColumn(language, F.coalesce(language, F.lit("none"))).write.mode("overwrite").partitionBy(language).parquet(folder)


def srt_blocks(segments: DataFrame) -> DataFrame:
    """Subtitle blocks of ``task_id, segment_no, start, stop, text``; text for a text sink."""
    block = F.concat_ws("\n", F.col("segment_no").cast("string"), F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("stop"))), "text", F.lit(""))
    return segments.select("task_id", "segment_no", block.alias("value"))


def transcript_lines(segments: DataFrame) -> DataFrame:
    """Segments of ``task_id, segment_no, start, stop, text`` in the four forms of export; a VTT file begins with ``WEBVTT``."""
    span = lambda mark: F.concat(srt_time(F.col("start"), mark), F.lit(" --> "), srt_time(F.col("stop"), mark))
    srt = F.concat_ws("\n", F.col("segment_no").cast("string"), span(","), "text", F.lit(""))
    vtt = F.concat_ws("\n", span("."), "text", F.lit(""))
    tsv = F.concat_ws("\t", *(F.bround(F.col(c) * 1000, 0).cast("bigint").cast("string") for c in ("start", "stop")), F.regexp_replace("text", r"[\t\r\n]+", " "))
    return segments.select("task_id", "channel_id", "block", "segment_no", srt.alias("srt"), vtt.alias("vtt"), F.col("text").alias("txt"), tsv.alias("tsv"))
