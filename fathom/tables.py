"""Reading the input tables and the few small ones the driver may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than the cluster has cores, dealt out to all of them; larger ones are left alone.

    Fewer parts than cores are little data, so the rows move cheaply, and costly
    work on them uses all cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def small_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that is fixed in size; more than ``most`` rows is an error, not a truncation."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is meant to be a small fixed table")
    return rows
