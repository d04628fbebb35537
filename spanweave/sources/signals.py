"""CSV sources for the four signals, as batch or streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave import schemas
from spanweave.functions.times import parse_time


def read_calls(spark: SparkSession, path: str, **options) -> DataFrame:
    """Call spans, one row per finished call."""
    return read_signal(spark, path, schemas.CALLS, **options)


def read_towers(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tower spans, one row per finished visit."""
    return read_signal(spark, path, schemas.TOWERS, **options)


def read_call_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """START and END events of calls."""
    return read_signal(spark, path, schemas.CALL_EVENTS, **options)


def read_tower_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """START and END events of tower visits."""
    return read_signal(spark, path, schemas.TOWER_EVENTS, **options)


def read_signal(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    streaming: bool = False,
    header: bool = False,
    files_per_batch: int | None = 1,
    bytes_per_batch: int | None = None,
    computed_times: bool = False,
    timestamp_format: str = schemas.TIMESTAMP_FORMAT,
    files: str = "*.csv*",
) -> DataFrame:
    """Every file below ``path`` that is named like ``files``, compressed or not, with a fixed schema.

    A row whose key or one of whose times cannot be read is dropped; this also removes a
    header line in files read with ``header=False``. Keep ``header`` off unless every file
    has a header: with it on, Spark skips the first line of each file.

    ``computed_times`` reads times as text and parses them in a computed column; otherwise
    the CSV reader parses them. ``files_per_batch`` and ``bytes_per_batch`` limit one
    micro-batch of a stream (one of the two applies; the byte limit wins).
    """
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    on_disk = schema
    if computed_times:
        on_disk = T.StructType(
            [T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in schema]
        )
    reader = (
        (spark.readStream if streaming else spark.read)
        .schema(on_disk)
        .option("header", str(header).lower())
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", files)
        .option("timestampFormat", timestamp_format)
    )
    if streaming and bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", int(bytes_per_batch))
    elif streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.csv(path)
    if computed_times:
        rows = rows.withColumns({name: parse_time(name, timestamp_format) for name in times})
    usable = F.col("unique_id").isNotNull()
    for name in times:
        usable = usable & F.col(name).isNotNull()
    return rows.where(usable)


def write_signal(df: DataFrame, path: str, *, header: bool = False, mode: str = "error") -> None:
    """Write rows as signal CSV files."""
    (
        df.write.mode(mode)
        .option("header", str(header).lower())
        .option("timestampFormat", schemas.TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", schemas.TIMESTAMP_FORMAT)
        .csv(path)
    )
