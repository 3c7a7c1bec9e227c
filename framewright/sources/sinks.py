"""Sinks: canonical frames by dataset and file, and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_canonical(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by dataset and source_file; an existing output stays unless asked otherwise.

    Rows are dealt by sampled ranges of (dataset, source_file, can_id, ts_us): a long file is written by
    many tasks, each a sorted range of its ids and times, and short ones share a task.
    """
    order = ("dataset", "source_file", "can_id", "ts_us")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite" if overwrite else "ignore").partitionBy("dataset", "source_file").parquet(path)


def missing_files(files: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Files that an earlier run has not written yet."""
    done = spark.read.parquet(path).select("source_file").distinct()
    return files.join(done, "source_file", "left_anti")


def metrics_long(wide: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per metric."""
    return wide.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(keys, values, "metric", "value")


def metrics_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per run, with its metrics as an object in the order of their names."""
    return metrics.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("m")).select(*keys, F.to_json(F.struct(*keys, F.map_from_entries("m").alias("metrics"))).alias("document"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(f"{path}/parquet")
    metrics.write.mode("overwrite").json(f"{path}/json")
