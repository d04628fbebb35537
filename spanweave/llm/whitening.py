"""Whitening of embeddings through the covariance of distinct vectors, weighted by multiplicity.

Each entry c of a vector becomes the integer ``floor(scale * c) + shift``. Rows with identical integer vectors
are grouped (counts combine before the shuffle); everything after that works on the distinct
vectors: exact integer sums, a weighted product of centred vectors per task, whose entries are
summed by a shuffle, and the projection on the leading eigenvectors. Each row then gets the
result of its vector by a join on the vector's digest.

The fit list is all vectors (``weights="counts"``) or each distinct vector once (``weights="one"``); n
and every covariance (divisor n) are over it. Centring is exact: ``n * x - sum`` is an integer.

Only sums per dimension and pair of dimensions reach the driver: for d dimensions at most
d * (d + 1) / 2 numbers, whatever the number of rows. A vector that more than one in 10,000 rows share is joined by a
broadcast (there are fewer than 10,000 such vectors); the others meet their rows by a shuffle, at most
one in 10,000 rows, or ``HOT_ROWS``, per vector.

Defined cases: rows whose vector is null, or holds a null or non-finite entry, are left out; of the others the most
frequent length counts (the smaller one of a tie) and rows of another length, or of none, are left out; entries
beyond 2**52 / scale are cut to that; repeated rows and null ids stay and count; components whose eigenvalue is not above
``RANK_TOLERANCE`` times the largest are not given, so identical vectors alone give no rows; a squared deviation that no
long holds is null; an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import keep, ship

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors with more rows than this, and than one row in HOT_SHARE, are joined by a broadcast.
HOT_ROWS, HOT_SHARE = 20_000, 10_000
RANK_TOLERANCE = 1e-12
_LARGEST = float(2**52)
_SHAPE = "id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The integer vector; null if the vector is null or holds a null or non-finite entry."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    cut = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(_LARGEST)), F.lit(-_LARGEST))
    return F.when(finite, F.transform(vector, lambda c: F.floor(cut(c)) + shift))


def _digest(x: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", x.cast("array<string>")), 256))


def _matrix(batch: pa.RecordBatch, column: int, dim: int, kind: type) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind, copy=False).reshape(-1, dim)


def _pair_sums(rows: DataFrame, vector: str, dim: int, centred: Callable[[np.ndarray], np.ndarray], n: int, kind: type) -> np.ndarray:
    """Sum of weight * v v' over all rows, divided by n: one product per task, added up by a shuffle."""
    upper = np.triu_indices(dim)

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = centred(_matrix(batch, 1, dim, kind))
            total += (v * batch.column(0).to_numpy()[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], ["i", "j", "v"])

    parts = rows.select("weight", vector).mapInArrow(ship(compute), "i int, j int, v double")
    out = np.zeros((dim, dim))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def _sums(rows: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """The fit list's length and its exact sum in each dimension."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            weight = batch.column(0).to_numpy()
            total += weight @ _matrix(batch, 1, dim, np.int64)
            n += int(weight.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array(np.concatenate([[n], total]))], ["i", "s"])

    parts = rows.select("weight", "x").mapInArrow(ship(compute), "i int, s bigint")
    found = {r.i: r.s for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(dim)], np.int64)


def principal_axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    real = values > max(values[0], 0.0) * RANK_TOLERANCE if len(values) else np.zeros(0, bool)
    values, vectors = values[real], vectors[:, real]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def _project(table: DataFrame, dim: int, n: int, sums: np.ndarray, axes: np.ndarray) -> DataFrame:
    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = n * _matrix(batch, 2, dim, np.int64) - sums
            rough = np.square(whole.astype(np.float64)).sum(1)
            fits = rough < 2.0**62
            exact = np.square(np.where(fits[:, None], whole, 0)).sum(1)
            for row in np.flatnonzero(~fits):
                value = sum(int(v) ** 2 for v in whole[row])
                fits[row], exact[row] = value < 2**63, value if value < 2**63 else 0
            white = (whole / n) @ axes
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * axes.shape[1]), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact, mask=~fits), listed], ["key", "weight", "deviation", "whitened"])

    return table.select("key", "weight", "x").mapInArrow(ship(compute), "key binary, weight bigint, deviation bigint, whitened array<double>")


def whiten(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "counts",
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """Per row and component: id, component, n, deviation, whitened, explained, identity_error."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    spark = rows.sparkSession
    shape = _SHAPE.format(id=rows.schema[id_col].dataType.simpleString())
    named = rows.select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale, shift).alias("x")).where(F.size("x") > 0)
    lengths = named.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], shape)
    dim, n_rows = lengths[0]["dim"], lengths[0]["count"]
    named = named.where(F.size("x") == dim)
    grouped = named.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    distinct = keep(grouped.select("x", _digest(F.col("x")).alias("key"), "copies", weight.alias("weight")), "whitening-distinct")

    n, sums = _sums(distinct, dim)
    covariance = _pair_sums(distinct, "x", dim, lambda x: (n * x - sums) / n, n, np.int64)
    values, vectors = principal_axes(covariance, components)
    if not len(values):
        return spark.createDataFrame([], shape)
    done = keep(_project(distinct, dim, n, sums, vectors / np.sqrt(values)), "whitening-done")
    error = np.abs(_pair_sums(done, "whitened", len(values), lambda v: v, n, np.float64) - np.eye(len(values))).max()
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])

    keyed = named.select("id", _digest(F.col("x")).alias("key"))
    hot_rows = max(HOT_ROWS, n_rows // HOT_SHARE)
    hot = distinct.where(F.col("copies") > hot_rows).select("key")
    if hot.limit(1).count():
        frequent = done.join(F.broadcast(hot), "key", "left_semi")
        rare = keyed.join(F.broadcast(hot), "key", "left_anti").join(done, "key")
        joined = keyed.join(F.broadcast(frequent), "key").unionByName(rare)
    else:
        joined = keyed.join(done, "key")
    each = joined.select("id", "deviation", F.posexplode("whitened").alias("nth", "whitened"))
    return each.select(
        "id",
        (F.col("nth") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("nth") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
