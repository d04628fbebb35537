"""Batch tables: temporary views for SQL, and the full-refresh load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_views(
    spark: SparkSession,
    calls: DataFrame,
    towers: DataFrame | None = None,
    *,
    calls_name: str = "mono_signal",
    towers_name: str = "tower_signal",
) -> None:
    """Make the span tables available to ``spark.sql``."""
    calls.createOrReplaceTempView(calls_name)
    if towers is not None:
        towers.createOrReplaceTempView(towers_name)


def refresh_table(rows: DataFrame, path: str) -> DataFrame:
    """Replace everything stored at ``path`` by ``rows`` and return the stored table.

    The rows must not be read from ``path`` itself. The overwrite is one job: readers see
    the old files until it starts, and a failed job can simply be run again.
    """
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
