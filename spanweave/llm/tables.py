"""Reading given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.session import new_folder

#: A side is broadcast only if it has been counted and holds no more rows than this.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def join_small(rows: DataFrame, few: DataFrame, on: list[str] | str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast if its count is within ``limit``."""
    if few.limit(limit + 1).count() <= limit:
        few = F.broadcast(few)
    return rows.join(few, on, how)


def numbered(df: DataFrame, order: list, name: str, label: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them into one task.

    Rows are cut into ranges of the order and written (so that the cuts stay as they are);
    each range counts its rows, and the counts before it are its offset. The ranges are as
    many as shuffle partitions; only their counts meet in one place.
    """
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    kept = keep(ranges, label)
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        join_small(kept, offsets, "_range")
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_range", "_before")
    )


def drop(table: DataFrame) -> None:
    """Delete the files of a table that ``keep`` wrote, once nothing reads it any more."""
    jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
    folders = {f.rpartition("/")[0] for f in table.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def ship(function: Callable) -> Callable:
    """``function`` for a Python task, also where the task's Python does not know this package.

    The function is unpickled inside the task, once the folder of the package is on its path.
    """
    payload, root = cloudpickle.dumps(function), str(Path(__file__).resolve().parents[2])

    def run(batches):
        import sys
        from importlib.util import find_spec

        from pyspark import cloudpickle as pickles

        if find_spec("spanweave") is None:
            sys.path.append(root)
        yield from pickles.loads(payload)(batches)

    return run


def ship_whole(function: Callable) -> Callable:
    """As ``ship``, for a function of one group's table, or of the tables of two joint groups."""
    payload, root = cloudpickle.dumps(function), str(Path(__file__).resolve().parents[2])

    def load():
        import sys
        from importlib.util import find_spec

        from pyspark import cloudpickle as pickles

        if find_spec("spanweave") is None:
            sys.path.append(root)
        return pickles.loads(payload)

    if function.__code__.co_argcount == 1:
        return lambda table: load()(table)
    return lambda left, right: load()(left, right)
