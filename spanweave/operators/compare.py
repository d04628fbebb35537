"""Comparing the results of two queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows in which two results differ, as multisets.

    ``side`` says where the surplus is and ``copies`` how large it is; equal results give no
    rows. One aggregation that combines before the shuffle, so many copies of one row cost
    one row per map task and are reported as a count, never written out.
    """
    columns = left.columns
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.select(*columns).withColumn("_n", F.lit(-1)))
    surplus = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    return surplus.select(
        F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"),
        *columns,
        F.abs("_n").alias("copies"),
    )
