"""Column names, types and fixed values of the signals and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the input signals.
START = 0
END = 1
CONNECTED = "connected"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_LONG, _INT, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()

# The order of the fields is the order of the columns in the CSV files.
CALLS = _schema(
    ("unique_id", _LONG),
    ("start_ts", _TIME),
    ("end_ts", _TIME),
    ("caller", _TEXT),
    ("callee", _TEXT),
    ("disposition", _TEXT),
    ("imei", _LONG),
    ("row_id", _LONG),
)
TOWERS = _schema(
    ("unique_id", _LONG),
    ("tower", _TEXT),
    ("start_ts", _TIME),
    ("end_ts", _TIME),
    ("row_id", _LONG),
)
CALL_EVENTS = _schema(
    ("unique_id", _LONG),
    ("event_type", _INT),
    ("caller", _TEXT),
    ("callee", _TEXT),
    ("ts", _TIME),
    ("disposition", _TEXT),
    ("imei", _LONG),
    ("row_id", _LONG),
)
TOWER_EVENTS = _schema(
    ("unique_id", _LONG),
    ("tower", _TEXT),
    ("event_type", _INT),
    ("ts", _TIME),
    ("row_id", _LONG),
)

_NTZ = T.TimestampNTZType()

# The table that calls and towers are derived from.
EVENTS = _schema(
    ("event_id", _LONG),
    ("ts", _NTZ),
    ("user_id", _LONG),
    ("event_type", _TEXT),
    ("value", T.DoubleType()),
    ("props", _TEXT),
)

# Result layouts.
OVERLAP_BY_ID = _schema(
    ("call_id", _LONG),
    ("tower", _TEXT),
    ("call_start", _NTZ),
    ("call_end", _NTZ),
    ("tower_start", _NTZ),
    ("tower_end", _NTZ),
)
GAP_SECONDS = _schema(
    ("caller", _TEXT),
    ("prev_end_timestamp", _NTZ),
    ("next_start_timestamp", _NTZ),
    ("time_gap_seconds", _LONG),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to the declared columns and types of ``schema``, in its order."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def _cast_all(df: DataFrame, found: type[T.DataType], wanted: T.DataType) -> DataFrame:
    return df.select(
        *(
            F.col(f.name).cast(wanted).alias(f.name) if isinstance(f.dataType, found) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def to_instants(df: DataFrame) -> DataFrame:
    """Zone-free time columns as TIMESTAMP, which watermarks need."""
    return _cast_all(df, T.TimestampNTZType, T.TimestampType())


def to_zone_free(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns as zone-free times, the type of batch tables and results."""
    return _cast_all(df, T.TimestampType, T.TimestampNTZType())
