"""Looking back within a key, without putting a hot key into one task.

``with_previous`` gives each row a value taken from the rows before it that have the same
key. Usually this is one window: one shuffle and one sort by key. A window puts all rows of a
key into one task, so keys that hold too many rows take another path:

1. the rows of hot keys are range-partitioned on (key, order), which cuts a hot key into
   runs of about equal size, and written to a table so that the cuts stay the same;
2. each run is summarised to one row, and the summaries of a key (as many as it has runs)
   are folded into what each run receives from the runs before it;
3. that value joins its run as one extra first row, and the window runs per (key, run).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanweave.session import new_folder


@dataclass(frozen=True)
class HotKeyPolicy:
    """When a key counts as hot: with more rows than ``rows_per_task``.

    A hot key is split into runs of about this size. ``broadcast_keys``: up to so many hot
    keys are sent to all tasks; a longer list is joined by a shuffle.
    """

    rows_per_task: int = 4_000_000
    broadcast_keys: int = 10_000


DEFAULT_POLICY = HotKeyPolicy()


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a table (nulls count as a key): a stored table, their number and rows."""

    key: str
    listed: DataFrame | None
    keys: int
    rows: int
    broadcast_keys: int

    def __bool__(self) -> bool:
        return self.keys > 0

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``df`` as (rows of other keys, rows of hot keys)."""
        listed = self.listed.select(F.col(self.key).alias("_hot"))
        if self.keys <= self.broadcast_keys:
            listed = F.broadcast(listed)
        same = F.col(self.key).eqNullSafe(F.col("_hot"))
        return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def find_hot_keys(df: DataFrame, key: str, policy: HotKeyPolicy = DEFAULT_POLICY) -> HotKeys:
    """The keys with more than ``rows_per_task`` rows, counted exactly and stored.

    Two stages, neither of which shuffles a row per key. First rows are counted per cell, a hash of the key: a
    fixed number of counts per task. A key can only be hot in a heavy cell, so the second stage
    counts the keys of heavy cells alone. There are several times as many cells as
    tasks' worth of rows, so few cells are heavy without a hot key, however many keys there are.
    """
    cells, rows, heavy = _heavy_cells(df, key, policy.rows_per_task, _CELLS)
    wanted = _CELLS_PER_TASK * math.ceil(rows / max(1, policy.rows_per_task))
    if heavy and wanted > cells:
        cells, _, heavy = _heavy_cells(df, key, policy.rows_per_task, 2 ** math.ceil(math.log2(wanted)))
    if not heavy:
        return HotKeys(key, None, 0, 0, policy.broadcast_keys)
    # At most one heavy cell per task's worth of rows: a list this short may be broadcast.
    listed = df.sparkSession.createDataFrame([(c,) for c in heavy], "_cell bigint")
    few = df.select(key).join(F.broadcast(listed), _cell(key, cells) == F.col("_cell"), "left_semi")
    counted = few.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > policy.rows_per_task)
    path = new_folder(df.sparkSession, "hot-keys")
    counted.write.parquet(path)
    listed = df.sparkSession.read.schema(counted.schema).parquet(path)
    facts = listed.agg(F.count(F.lit(1)).alias("keys"), F.sum("_rows").alias("rows")).first()
    if not facts["keys"]:
        return HotKeys(key, None, 0, 0, policy.broadcast_keys)
    return HotKeys(key, listed, facts["keys"], facts["rows"], policy.broadcast_keys)


#: Cells of the first count, and how many of them there shall be per ``rows_per_task`` rows.
_CELLS = 4096
_CELLS_PER_TASK = 8


def _cell(key: str, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells))


def _heavy_cells(df: DataFrame, key: str, limit: int, cells: int) -> tuple[int, int, list[int]]:
    """(cells, rows of the table, cells with more than ``limit`` rows: at most rows / limit of them)."""
    counted = df.groupBy(_cell(key, cells).alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = F.collect_list(F.when(F.col("_rows") > limit, F.col("_cell")))
    facts = counted.agg(F.sum("_rows").alias("rows"), heavy.alias("heavy")).first()
    return cells, facts["rows"] or 0, facts["heavy"]


def with_previous(
    rows: DataFrame,
    key: str,
    order: list[str],
    carry: Column,
    *,
    latest: bool,
    seed: DataFrame | None = None,
    policy: HotKeyPolicy | None = DEFAULT_POLICY,
) -> DataFrame:
    """``rows`` plus a column ``prev`` taken from the earlier rows of the same key.

    ``latest=True``: the ``carry`` of the row just before, in the given order (a lag).
    ``latest=False``: the greatest ``carry`` of all rows before (a running maximum).
    ``seed`` (columns ``key`` and ``carried``, one row per key) stands for rows that come
    before all of these, see ``carry_after``. ``policy=None`` skips the hot-key pass.
    """
    hot = find_hot_keys(rows, key, policy) if policy is not None else None
    if not hot:
        return _one_window(rows, key, order, carry, latest, seed)
    cold, heavy = hot.split(rows)
    runs = max(2, math.ceil(hot.rows / policy.rows_per_task))
    return _one_window(cold, key, order, carry, latest, seed).unionByName(
        _window_per_run(heavy, key, order, carry, latest, seed, runs)
    )


def carry_after(
    rows: DataFrame, key: str, order: list[str], carry: Column, *, latest: bool, seed: DataFrame | None = None
) -> DataFrame:
    """What the next batch of rows receives as its ``seed``: one row per key."""
    ends = rows.groupBy(key).agg(_summary(carry, order, latest).alias("carried"))
    if seed is None:
        return ends
    both = ends.withColumn("_age", F.lit(1)).unionByName(seed.withColumn("_age", F.lit(0)))
    merged = F.max_by("carried", "_age") if latest else F.max("carried")
    return both.groupBy(key).agg(merged.alias("carried"))


def _summary(carry: Column, order: list[str], latest: bool) -> Column:
    return F.max_by(carry, F.struct(*order)) if latest else F.max(carry)


def _look_back(carry: Column, latest: bool, window: WindowSpec) -> Column:
    if latest:
        return F.lag(carry).over(window)
    return F.max(carry).over(window.rowsBetween(Window.unboundedPreceding, -1))


def _one_window(
    rows: DataFrame, key: str, order: list[str], carry: Column, latest: bool, seed: DataFrame | None
) -> DataFrame:
    if seed is None:
        return rows.withColumn("prev", _look_back(carry, latest, Window.partitionBy(key).orderBy(*order)))
    firsts = seed.select(key, F.col("carried").alias("_carry"))
    return _with_firsts(rows.withColumn("_carry", carry), firsts, [key], order, latest)


def _with_firsts(tagged: DataFrame, firsts: DataFrame, group: list[str], order: list[str], latest: bool) -> DataFrame:
    both = tagged.withColumn("_first", F.lit(False)).unionByName(
        firsts.withColumn("_first", F.lit(True)), allowMissingColumns=True
    )
    window = Window.partitionBy(*group).orderBy(F.col("_first").desc(), *order)
    found = both.withColumn("prev", _look_back(F.col("_carry"), latest, window))
    return found.where(~F.col("_first")).drop("_first", "_carry")


def _window_per_run(
    heavy: DataFrame,
    key: str,
    order: list[str],
    carry: Column,
    latest: bool,
    seed: DataFrame | None,
    runs: int,
) -> DataFrame:
    # _seq also tells exact copies apart, so that a group of copies can be cut, too.
    cut = (
        heavy.withColumn("_carry", carry)
        .withColumn("_seq", F.monotonically_increasing_id())
        .repartitionByRange(runs, key, *order, "_seq")
        .withColumn("_run", F.spark_partition_id())
    )
    path = new_folder(heavy.sparkSession, "runs")
    cut.write.parquet(path)
    pinned = heavy.sparkSession.read.schema(cut.schema).parquet(path)
    order = [*order, "_seq"]
    ends = pinned.groupBy(key, "_run").agg(_summary(F.col("_carry"), order, latest).alias("carried"))
    if seed is not None:
        seed = seed.join(ends.select(F.col(key).alias("_hot")).distinct(), F.col(key).eqNullSafe(F.col("_hot")), "left_semi")
        ends = ends.unionByName(seed.select(key, F.lit(-1).alias("_run"), "carried"))
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    received = F.last("carried") if latest else F.max("carried")
    firsts = ends.select(key, "_run", received.over(earlier).alias("_carry")).where(F.col("_run") >= 0)
    return _with_firsts(pinned, firsts, [key, "_run"], order, latest).drop("_seq", "_run")
