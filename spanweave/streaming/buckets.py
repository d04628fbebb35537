"""A keyed table in hash buckets, of which each micro-batch rewrites only those it touches.

Every batch writes the buckets it replaces to a folder of its own and then the list of which batch
last wrote which bucket. A batch starts from the list of the batch before, so one that is
run again after a failure overwrites its own folder and nothing else, and readers see whole
batches. Buckets that a finished batch has replaced are deleted once the next one begins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16

Versions = dict[int, int]


class BucketTable:
    """Rows by ``key`` in ``buckets`` buckets below ``folder``. The lists hold one row per bucket."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = BUCKETS):
        self._spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self._known: dict[int, Versions] = {}
        self._schema: StructType | None = None

    def bucket(self) -> Column:
        # Without a key there is one bucket.
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def versions(self, batch: int) -> Versions:
        """The batch that last wrote each bucket, once ``batch`` is done."""
        if batch < 0:
            return {}
        if batch not in self._known:
            system, path = self._at(f"{self.folder}/versions/{batch}")
            stream = system.open(path)
            try:
                listed = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            self._known[batch] = {int(b): v for b, v in listed.items()}
        return self._known[batch]

    def read(self, versions: Versions, touched: list[int] | None = None) -> DataFrame | None:
        """The rows of some buckets, or of all; None if these hold none."""
        wanted = versions if touched is None else [b for b in touched if b in versions]
        paths = [f"{self.folder}/rows/batch={versions[b]}/bucket={b}" for b in wanted]
        reader = self._spark.read if self._schema is None else self._spark.read.schema(self._schema)
        return reader.parquet(*sorted(paths)) if paths else None

    def replace(self, batch: int, rows: DataFrame, touched: list[int]) -> None:
        """Let ``rows`` stand in the touched buckets after ``batch``."""
        before, path = self.versions(batch - 1), f"{self.folder}/rows/batch={batch}"
        placed = rows.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        now = {b: v for b, v in before.items() if b not in set(touched)}
        now |= {int(name.partition("=")[2]): batch for name in self._names(path) if name.startswith("bucket=")}
        self._schema = rows.schema
        system, hidden = self._at(f"{self.folder}/versions/_{batch}")
        stream = system.create(hidden, True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        # The list appears as a whole.
        listed = self._at(f"{self.folder}/versions/{batch}")[1]
        system.delete(listed, False)
        system.rename(hidden, listed)
        self._known = {batch - 1: before, batch: now}

    def forget_replaced(self, batch: int) -> None:
        """Delete what the batch before ``batch`` replaced; ``batch`` starts, so that one is final."""
        if batch < 2:
            return
        older, newer = self.versions(batch - 2), self.versions(batch - 1)
        for bucket, version in older.items():
            if newer.get(bucket) != version:
                self._delete(f"{self.folder}/rows/batch={version}/bucket={bucket}")

    def current(self) -> DataFrame | None:
        """The rows after the last whole batch."""
        done = [int(n) for n in self._names(f"{self.folder}/versions") if n.isdigit()]
        return self.read(self.versions(max(done))) if done else None

    def _at(self, path: str):
        hadoop = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()), hadoop

    def _names(self, path: str) -> list[str]:
        system, at = self._at(path)
        return [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []

    def _delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)
