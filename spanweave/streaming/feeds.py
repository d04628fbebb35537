"""Replaying a table as a stream in a given order."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.times import millis
from spanweave.schemas import to_instants
from spanweave.session import new_folder
from spanweave.sources.signals import read_signal, write_signal

# A file is sorted, written and read by one task each.
_ROWS_PER_FILE = 250_000
_ROWS_PER_SLICE = 50_000_000


@dataclass(frozen=True)
class Feed:
    """Files that a stream reads slice by slice: ``files_per_slice`` make up one slice."""

    path: str
    schema: T.StructType
    files_per_slice: int
    files: int = 0

    def read(self, spark: SparkSession) -> DataFrame:
        rows = (
            spark.readStream.schema(self.schema)
            .option("maxFilesPerTrigger", self.files_per_slice)
            .parquet(self.path)
        )
        return to_instants(rows)

    def read_csv(self, spark: SparkSession, schema: T.StructType, **options) -> DataFrame:
        return read_signal(
            spark, self.path, schema, streaming=True, files_per_batch=self.files_per_slice, **options
        )


def stage_feed(
    rows: DataFrame,
    order: list[str],
    *,
    slices: int = 8,
    csv: bool = False,
    header: bool = False,
    close_after_ms: int | None = None,
) -> Feed:
    """Write ``rows`` as consecutive slices in the given order, whose first column is a time.

    There are ``slices`` of about equal size, or more for large tables, so that a micro-batch
    never holds more than about 50 million rows. One job sorts and writes the table. The
    file source takes files by modification time, so each file is given the time that its place
    in the order asks for, whenever its task ended; the file system must be able to set times.
    An empty table gives a feed without rows.

    ``close_after_ms`` adds one row with the key -1 to the last slice, that long after all
    others: a stream closes its last windows only when a later event moves the watermark on.
    (Not a null key: a join on the key drops null keys right after the source, unseen by the
    watermark.)
    """
    facts = rows.agg(F.max(millis(order[0])).alias("last"), F.count(F.lit(1)).alias("n")).first()
    slices = max(slices, math.ceil(facts["n"] / _ROWS_PER_SLICE))
    files = max(1, math.ceil(facts["n"] / slices / _ROWS_PER_FILE))
    schema = rows.schema
    if close_after_ms is not None and facts["last"] is not None:
        end = F.timestamp_millis(F.lit(facts["last"] + close_after_ms))
        rows = rows.unionByName(_closing_row(rows, order[0], end))
    sliced = rows.repartitionByRange(slices * files, *order).sortWithinPartitions(*order)
    feed = Feed(new_folder(rows.sparkSession, "feed"), schema, files)
    return _write(feed, sliced, csv=csv, header=header)


def stage_slices(rows: DataFrame, slice_number: Column, slices: int) -> Feed:
    """Write ``rows`` as slices 0, 1, ... as ``slice_number`` says, one file each (also empty ones)."""
    schema = rows.schema
    placed = rows.withColumn("_slice", slice_number.cast("int"))
    sliced = placed.repartitionById(slices, F.col("_slice")).drop("_slice")
    return _write(Feed(new_folder(rows.sparkSession, "feed"), schema, 1), sliced)


def extend_feed(feed: Feed, more: Feed) -> Feed:
    """``feed`` with the slices of ``more`` after its own, as when a table grows under a stream."""
    spark = SparkSession.active()
    paths, system = _files(spark, more.path)
    for n, path in enumerate(paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{feed.path}/more-{feed.files + n:06d}-{path.getName()}")
        system.rename(path, target)
        system.setTimes(target, _time_of(feed, feed.files + n), -1)
    return replace(feed, files=feed.files + len(paths))


#: Files are dated one second apart, the first one of every feed a day back.
_BEGAN_MS = round(time.time() * 1000) - 86_400_000


def _time_of(feed: Feed, place: int) -> int:
    return _BEGAN_MS + 1000 * place


def _files(spark: SparkSession, folder: str):
    """The data files of a folder by name, which is the order of their partitions, and their file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [f.getPath() for f in system.listStatus(path) if f.getPath().getName().startswith("part-")]
    return sorted(found, key=lambda p: p.getName()), system


def _write(feed: Feed, sliced: DataFrame, *, csv: bool = False, header: bool = False) -> Feed:
    spark = sliced.sparkSession
    if csv:
        write_signal(sliced, feed.path, header=header)
    else:
        sliced.write.parquet(feed.path)
    paths, system = _files(spark, feed.path)
    for place, path in enumerate(paths):
        system.setTimes(path, _time_of(feed, place), -1)
    return replace(feed, files=len(paths))


def _closing_row(rows: DataFrame, time: str, at: Column) -> DataFrame:
    given = {time: at, "unique_id": F.lit(-1)}
    one = rows.sparkSession.range(1)
    return one.select(
        *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields)
    )
