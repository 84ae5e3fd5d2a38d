"""Parquet tables by name, and the redelivery rule of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of ``<name>.parquet`` files or folders."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """Each record once: repeats under a key differ at most in ``loaded_at``.

    The shuffle is by key, which has a few rows at most, so no hot group forms. Rows whose key is null
    count as one record.
    """
    return df.drop("loaded_at").dropDuplicates([key])


def spread(df: DataFrame) -> DataFrame:
    """A scan ahead of heavy expressions, over all cores.

    A table that is read in fewer partitions than there are cores is small, at most a split per core, so moving
    it is cheap; larger tables stay as their files lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many partitions as the session shuffles to; the grouping that follows reuses it.

    Named partitions are not merged by their bytes at run time: groups that compute much are small in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
