"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating; they share
``share`` times all words; a target stops at ``most`` times its source's size and the excess is
shared again by weight until none is above.

Rates: among all rates r_i in 0..``most`` of a source's documents that meet the source's constraints, the ones
of least relative entropy to the corpus, counted by word, are r_i = min(most, exp(lambda . x_i)). One
constraint is the target of tokens. The other draws the sources' lengths together: the word-weighted
mean of the length class (floor of log2(size + 1)) shall be that of the whole corpus. Not every source can reach that
at its target, so the aim lies at most ``reach`` of the way to the least or greatest mean that rates up to ``most``
allow; a source at ``most`` times its size has no way to go. Other constraints are given as ``Aim``s.

The dual, sum size_i f(lambda . x_i) - lambda . aim with f' = min(most, exp), is convex; Newton's steps need only the dual's value, a
gradient and a Hessian per source, which are sums over its documents (combined before the
shuffle). One pass tries several step lengths for each source and the lowest dual is taken. Steps go on
until every source's constraints are met; a source that can't get there raises an error.

Copies: a source is dealt by hash into blocks of about ``block_rows`` documents. A block is
walked from large to small documents and each gets the copies, 0 to ``most``, that bring the
words taken closest to the sum of rates so far, so the error of a block is about its smallest
document. Blocks and ties follow a hash of the whole row, so rows of one id (or without one) spread over
the blocks, and reruns agree whatever the order of rows; only exact repeats of a whole row share a block.

Defined cases: null text has size 0; documents of size 0 get one copy; a source of size 0 has
target 0; null is a source; repeated rows are documents of their own; an empty table gives
no rows; clashing columns are kept aside and returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.tables import BROADCAST_ROWS, join_small, keep, numbered, ship

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_ROWS = 2_000
#: How far the mean length class may go towards the least or greatest one possible.
REACH = 0.5
#: Step lengths tried at once; the last ones let a step that overshoots come back.
STEP_LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001, 0.0001)
#: Newton's method converges in about ten steps; a dual that needs more than this has no solution and raises.
NEWTON_STEPS = 100


@dataclass(frozen=True)
class Aim:
    """A feature column of few distinct values (a class, a flag); its word-weighted mean per source is drawn to
    the corpus's, at most ``reach`` of the way to the least or greatest mean possible. With 0 it stays."""

    column: str
    reach: float = REACH


def word_count(text: str) -> Column:
    """How many runs of ``[^\\x20\\x09-\\x0D]+`` the text has."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sid, source, source_size, documents, target) from rows (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    placed = numbered(sums, [F.col("source").isNull().asc(), F.encode("source", "UTF-8").asc()], "sid", "balance-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = keep(placed.withColumn("weight", weight), "balance-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    limit, full, n_full, level = F.col("source_size") * float(most), F.lit(False), -1, 0.0
    while True:
        left = rows.agg(
            F.sum(F.when(full, limit).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if left["n"] == n_full or not left["weights"]:
            break
        n_full, level = left["n"], (share * total - left["taken"]) / left["weights"]
        full = F.col("weight") * F.lit(level) > limit
    target = F.when(full, limit).otherwise(F.col("weight") * F.lit(float(level)))
    return rows.select("sid", "source", "source_size", "documents", target.cast("double").alias("target"))


def _reachable(cells: DataFrame, sources: DataFrame, k: int, most: float) -> DataFrame:
    """(sid, low, high): the least and greatest mean of feature ``k`` among rates up to ``most`` that meet the target."""
    of = cells.groupBy("sid", F.col("x")[k].alias("v")).agg((F.sum("size") * float(most)).alias("room")).join(sources.select("sid", "target"), "sid")

    def mean(order: Column) -> Column:
        before = Window.partitionBy("sid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        filled = F.coalesce(F.sum("room").over(before), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.col("room"), F.col("target") - filled))

    taken = of.select("sid", "v", "target", mean(F.asc("v")).alias("least"), mean(F.desc("v")).alias("greatest"))
    return taken.groupBy("sid").agg(*[(F.sum(F.col("v") * F.col(c)) / F.max("target")).alias(n) for c, n in (("least", "low"), ("greatest", "high"))])


def _aims(cells: DataFrame, sources: DataFrame, aims: list[Aim], most: float) -> DataFrame:
    """(sid, source_size, target, aim): the sums that the constraints ask for, for sources with words."""
    state = sources.where("target > 0").select("sid", "source_size", "target").withColumn("aim", F.array("target"))
    for k, aim in enumerate(aims, 1):
        v, size = F.col("x")[k], F.col("size")
        whole = cells.agg(F.sum(v * size) / F.sum(size)).first()[0]
        own = cells.groupBy("sid").agg((F.sum(v * size) / F.sum(size)).alias("own"))
        bounds = _reachable(cells, sources, k, most).join(own, "sid")
        low, high = (F.col("own") + aim.reach * (F.col(c) - F.col("own")) for c in ("low", "high"))
        wanted = F.least(F.greatest(F.lit(float(whole or 0.0)), low), high)
        state = state.join(bounds.select("sid", wanted.alias("mean")), "sid")
        state = state.select("sid", "source_size", "target", F.array_append("aim", F.col("target") * F.col("mean")).alias("aim"))
    return state


def _newton(width: int, tolerance: float):
    """For rows (sid, target, aim, lam, tried): the step of lowest dual, and the next Newton direction from there.

    ``tried`` holds (length, value, grad, hess) of each step length; ``off`` is how far the sums are from the aim.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lams, moves, offs = [], [], []
            for row in pdf.itertuples():
                lam, aim, move = np.array(row.lam), np.array(row.aim), np.array(row.move)
                # Where rounding hides the difference of values, the sums decide; no step at all is among the tries.
                least = min(t["value"] for t in row.tried)
                close = [t for t in row.tried if t["value"] <= least + 1e-11 * max(abs(least), row.target)]
                off_by = lambda t: float((np.abs(np.array(t["grad"]) - aim) / np.maximum(np.abs(aim), row.target)).max())  # noqa: B023, E731
                best = min(close, key=off_by)
                grad, off = np.array(best["grad"]), off_by(best)
                lam = lam + best["length"] * move
                hess = np.array(best["hess"]).reshape(width, width)
                # A little of the diagonal keeps a direction where all rates are at their limit.
                hess = hess + np.diag(1e-10 * (np.abs(np.diag(hess)) + row.target))
                move = np.linalg.solve(hess, aim - grad) if off > tolerance else np.zeros(width)
                lams.append(lam.tolist())
                moves.append((move / max(1.0, float(np.abs(move).max()) / 2.0)).tolist())
                offs.append(off)
            yield pdf[["sid", "target", "aim"]].assign(lam=lams, move=moves, off=offs)

    return step


def solve_dual(rows: DataFrame, sources: DataFrame, aims: list[Aim], most: float = MOST, tolerance: float = 1e-7) -> DataFrame:
    """(sid, lam): Newton's iterations on the dual. ``rows``: (sid, size, one column per aim).

    Documents of equal features enter the sums alike, so their sizes are added up first. A dual that
    is not solved to ``tolerance`` raises ``ArithmeticError``.
    """
    width = 1 + len(aims)
    x = F.array(F.lit(1.0), *[F.col(a.column).cast("double") for a in aims])
    cells = keep(rows.where("size > 0").withColumn("x", x).groupBy("sid", "x").agg(F.sum("size").cast("double").alias("size")), "balance-cells")
    zeros = F.array_repeat(F.lit(0.0), width - 1)
    start = F.concat(F.array(F.log(F.col("target") / F.col("source_size"))), zeros)
    state = _aims(cells, sources, aims, most).select("sid", "target", "aim", start.alias("lam"), F.array_repeat(F.lit(0.0), width).alias("move"))
    state = keep(state, "balance-dual")
    few = state.count() <= BROADCAST_ROWS
    shape = "sid bigint, target double, aim array<double>, lam array<double>, move array<double>, off double"
    for _ in range(NEWTON_STEPS):
        tries = F.explode(F.array(*[F.lit(v) for v in (*STEP_LENGTHS, 0.0)])).alias("length")
        tried = state.select("sid", "aim", "lam", "move", tries)
        at = F.zip_with("lam", "move", lambda a, b: a + F.col("length") * b)
        tried = tried.select("sid", "length", "aim", at.alias("at"))
        met = cells.join(F.broadcast(tried) if few else tried, "sid")
        tilt = sum((F.col("at")[k] * F.col("x")[k] for k in range(1, width)), F.col("at")[0] * F.col("x")[0])
        full = tilt >= float(np.log(most))
        rate = F.when(full, F.lit(float(most))).otherwise(F.exp(tilt))
        # The integral of the rate over the tilt.
        value = F.when(full, most * (1.0 + tilt - float(np.log(most)))).otherwise(F.exp(tilt))
        bent = F.col("size") * F.when(full, 0.0).otherwise(F.exp(tilt))
        sums = met.groupBy("sid", "length").agg(
            (F.sum(F.col("size") * value) - F.first(sum(F.col("at")[k] * F.col("aim")[k] for k in range(width)))).alias("value"),
            F.array(*[F.sum(F.col("size") * rate * F.col("x")[k]) for k in range(width)]).alias("grad"),
            F.array(*[F.sum(bent * F.col("x")[k] * F.col("x")[j]) for k in range(width) for j in range(width)]).alias("hess"),
        )
        sums = sums.groupBy("sid").agg(F.collect_list(F.struct("length", "value", "grad", "hess")).alias("tried"))
        stepped = state.select("sid", "target", "aim", "lam", "move").join(sums, "sid")
        state = keep(stepped.mapInPandas(ship(_newton(width, tolerance)), shape), "balance-step")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            return state.select("sid", "lam")
    off = state.orderBy(F.desc("off")).first()
    raise ArithmeticError(f"the dual of source number {off['sid']} is off by {off['off']:.3g} of its target after {NEWTON_STEPS} steps")


def _deal(most: int):
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, expected, taken = None, 0.0, 0
        for batch in batches:
            copies = []
            for sid, b, size, rate in zip(*(batch.column(n).to_pylist() for n in ("_sid", "_block", "_size", "_rate"))):
                if (sid, b) != block:
                    block, expected, taken = (sid, b), 0.0, 0
                expected += rate * size
                n = 1 if size == 0 else min(most, max(0, round((expected - taken) / size)))
                taken += n * size
                copies.append(n)
            names = ["_row", "_sid", "_size", "_rate"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(copies, pa.int64())], [*names, "copies"])

    return walk


def _whole_row(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash, go in as JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    plain = lambda kind: "map<" not in kind and "variant" not in kind
    return F.xxhash64(*[F.col(c) if plain(k) else F.to_json(F.struct(c)) for c, k in kinds.items()], *[F.col(c).isNull() for c in kinds])


def mix_sources(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", carry: list[str] | None = None,
                weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block_rows: int = BLOCK_ROWS, reach: float = REACH) -> DataFrame:
    """The columns ``carry`` (default: all) of each document plus size, source_size, target, rate and copies."""
    row = F.struct(*[F.col(c) for c in (carry or docs.columns)]).alias("_row")
    sized = docs.select(row, _whole_row(docs).alias("_hash"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    length_class = F.floor(F.log2(F.col("size") + 1.0))
    sizes = keep(sized.select("source", "size", length_class.alias("length_class")), "balance-sizes")
    sources = keep(source_targets(sizes, weights, share, most), "balance-targets")
    by_source = sources.select(F.col("source").alias("_source"), "sid", "documents", "target", "source_size")
    same = F.col("source").eqNullSafe(F.col("_source"))
    numbers = join_small(sizes, by_source, same).select("sid", "size", "length_class")
    dual = solve_dual(numbers, sources, [Aim("length_class", reach)], most)
    rated = join_small(sized, keep(by_source.join(dual, "sid", "left"), "balance-rates"), same)
    tilt = F.col("lam")[0] + F.col("lam")[1] * length_class
    rate = F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.exp(tilt))).otherwise(0.0)
    blocks = F.ceil(F.col("documents") / block_rows)
    rated = rated.select("_row", F.col("sid").alias("_sid"), F.pmod("_hash", blocks).alias("_block"), F.col("size").alias("_size"), F.coalesce(rate, F.lit(0.0)).alias("_rate"), "_hash")
    walked = rated.repartition("_sid", "_block").sortWithinPartitions("_sid", "_block", F.desc("_size"), "_hash")
    shape = f"_row {rated.schema['_row'].dataType.simpleString()}, _sid bigint, _size bigint, _rate double, copies bigint"
    dealt = walked.mapInArrow(ship(_deal(most)), shape)
    back = join_small(dealt, sources.select(F.col("sid").alias("_sid"), "source_size", "target"), "_sid")
    made = [F.col("_size").alias("size"), "source_size", "target", F.col("_rate").alias("rate"), "copies"]
    return back.select("_row", *made)
