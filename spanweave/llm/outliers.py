"""Quality rules: base statistics of a text and robust multivariate outliers.

Each document has a vector of transformed statistics. Per language and source a minimum
covariance determinant (MCD) estimate gives a centre and a covariance that outlying documents
do not move; a document whose Mahalanobis distance from its group's centre is too large is
rejected.

MCD over a distributed table: start from medians and median deviations, then C-steps. A step
measures the distance of every row, keeps the ``SUPPORT`` share of each group with the least
distances, and takes mean and covariance of these. The share's limit comes from exact counts
of the distances in bins of 1/16 of an octave, so no group is sorted or collected: all sums
are combined before the shuffle and a hot group costs no more than others. A group rests once its own
determinant falls no more, and keeps the estimate of the least one; steps go on with the others, as many as it takes.

Groups: (language, source) if it has ``MIN_ROWS`` rows, else all such rows of the language,
if enough, else all such rows; with fewer than ``MIN_ROWS`` rows in that last one nothing is rejected.
The variance of each statistic is at least its ``RESOLUTION`` squared, so that a statistic that is the
same in most documents does not make every other value an outlier.

Defined cases: null text is an empty text (all counts 0, fails the base rules); null language
and source are values of their own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.tables import BROADCAST_ROWS, keep, ship
from spanweave.llm.textscan import U64, Hasher, mix, per_text, pieces, repeated, scan_words, windows

WINDOW = 5
SUPPORT = 0.75
#: A group's log determinant falls if it does by this much.
LEAST_FALL = 1e-3
MIN_ROWS = 200
#: Least standard deviation of: log word length, symbol, line and repetition rates.
RESOLUTION = (0.05, 0.25, 0.25, 0.05)
#: Rows are rejected above this quantile of the distance's reference distribution.
TAIL = 1e-6
#: Chi-square quantiles for four statistics: 0.75 (support) and 1 - TAIL; fixed values.
CHI_SUPPORT, CHI_LIMIT = 5.3853, 33.3768
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    if not len(data):
        return [np.zeros(len(ends) - 1, np.int64)] * len(_COUNTS)
    hasher = Hasher(data)
    words = scan_words(data, ends, hasher=hasher)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.start, 1)
    np.subtract.at(inside, words.end, 1)
    chars = per_text((np.cumsum(inside[:-1]) > 0) & (data & 0xC0 != 0x80), ends)

    starts = np.zeros(len(data) + 1, bool)
    starts[1:] = data == 0x0A
    starts[ends] = True
    starts = np.flatnonzero(starts[:-1])
    stops = np.append(starts[1:], len(data))
    stops = stops - ((stops > starts) & (data[stops - 1] == 0x0A))
    first = np.searchsorted(starts, ends)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    worded = np.searchsorted(words.start, stops) > np.searchsorted(words.start, starts)
    lines = np.flatnonzero(worded)
    keys = mix(hasher.of(starts[lines], stops[lines]) + mix(doc[lines].astype(np.uint64) + U64(1)))
    later = np.zeros(len(starts), bool)
    later[lines] = repeated(keys)[1]
    dup_lines = np.diff(np.append(0, np.cumsum(later))[first])

    hashes, owner = windows(words, WINDOW)
    at = np.flatnonzero(owner >= 0)
    keys = mix(hashes[at] + mix(owner[at].astype(np.uint64) + U64(1)))
    again = at[repeated(keys)[0]]
    cover = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(cover, again, 1)
    np.subtract.at(cover, again + WINDOW, 1)
    repeats = np.diff(np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))[words.first])
    return [np.diff(words.first), chars, per_text(_SYMBOL[data], ends), dup_lines, repeats]


def text_statistics(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and the counts of each text."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, ends in pieces(batch.column(len(carry))):
                counts = [pa.array(c.astype(np.int64)) for c in _count(data, ends)]
                own = [batch.column(c).slice(row, n) for c in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*own, *counts], [*carry, *_COUNTS])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + [f"{c} bigint" for c in _COUNTS]
    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(ship(compute), ", ".join(kinds))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistic vector; rates of short texts are drawn toward usual values."""
    n = F.col("n_words") + 20.0
    return [
        F.log((F.col("word_chars") + 100.0) / n),
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.log1p(100.0 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]


def _invert(pdf: pd.DataFrame, p: int) -> pd.DataFrame:
    """Adds the inverse of each row's covariance (flat) and the log determinant."""
    inverse, dets = [], []
    for flat in pdf["cov"]:
        cov = np.array(flat, float).reshape(p, p)
        cov = (cov + cov.T) / 2 + np.diag(np.maximum(0.0, np.square(RESOLUTION) - np.diag(cov)))
        values, vectors = np.linalg.eigh(cov)
        values = np.maximum(values, np.square(RESOLUTION).min() / 4)
        inverse.append(((vectors / values) @ vectors.T).ravel().tolist())
        dets.append(float(np.log(values).sum()))
    return pdf[["grp", "centre"]].assign(inverse=inverse, logdet=dets)


def _with_inverse(rows: DataFrame, p: int) -> DataFrame:
    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _invert(pdf, p)

    return rows.mapInPandas(ship(invert), "grp bigint, centre array<double>, inverse array<double>, logdet double")


def _distance(p: int) -> Column:
    off = [F.col("x")[i] - F.col("centre")[i] for i in range(p)]
    return sum(F.col("inverse")[i * p + j] * off[i] * off[j] for i in range(p) for j in range(p))


def mcd(rows: DataFrame, p: int, support: float = SUPPORT) -> DataFrame:
    """(grp, centre, inverse, logdet) for rows (grp, x); ``inverse`` is scaled for consistency."""
    mids = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], 0.5, 1000).alias(f"m{i}") for i in range(p)], F.count(F.lit(1)).alias("n"))
    mids = keep(mids, "mcd-start")
    few = mids.count() <= BROADCAST_ROWS
    near = lambda df: rows.join(F.broadcast(df) if few else df, "grp")
    spread = near(mids).groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col("x")[i] - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(p)])
    start = mids.join(spread, "grp").select(
        "grp",
        F.array(*[F.col(f"m{i}") for i in range(p)]).alias("centre"),
        F.array(*[F.pow(1.4826 * F.col(f"d{i}"), F.lit(2)) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("cov"),
    )
    # The first step is always taken; each further one lowers every moving group's determinant, which is bounded.
    state = keep(_with_inverse(start, p).withColumn("moves", F.lit(True)).withColumn("logdet", F.lit(float("inf"))), "mcd-state")
    while not state.where("moves").isEmpty():
        measured = near(state.where("moves").select("grp", "centre", "inverse")).select("grp", "x", F.floor(F.log2(_distance(p) + 1e-6) * 16).alias("bin"))
        bins = measured.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("grp")
        limit = bins.select("grp", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
        limit = limit.where(F.col("upto") >= support * F.col("all")).groupBy("grp").agg(F.min("bin").alias("last"))
        inner = measured.join(F.broadcast(limit) if few else limit, "grp").where("bin <= last")
        mean = [F.avg(F.col("x")[i]) for i in range(p)]
        moved = inner.groupBy("grp").agg(
            F.array(*mean).alias("centre"),
            F.array(*[F.covar_pop(F.col("x")[i], F.col("x")[j]) for i in range(p) for j in range(p)]).alias("cov"),
        )
        new = _with_inverse(moved, p).select("grp", F.struct("centre", "inverse", "logdet").alias("new"))
        falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - LEAST_FALL, F.lit(False))
        taken = [F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "inverse", "logdet")]
        state = keep(state.join(F.broadcast(new) if few else new, "grp", "left").select("grp", *taken, falls.alias("moves")), "mcd-state")
    # The covariance of the inner part of a normal distribution is too small by this factor.
    measured = near(state.select("grp", "centre", "inverse")).select("grp", _distance(p).alias("d"))
    scale = measured.groupBy("grp").agg(F.percentile_approx("d", support, 1000).alias("at"))
    scale = scale.select("grp", F.greatest(F.lit(1.0), F.col("at") / CHI_SUPPORT).alias("scale"))
    return keep(state.drop("moves").join(scale, "grp"), "mcd-scaled")


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str]) -> DataFrame:
    """``carry``, the counts, base_failed, distance (squared, null without a group) and kept."""
    p = len(RESOLUTION)
    named = docs.select(F.struct(*carry).alias("_row"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_txt"))
    stats = text_statistics(named, "_txt", ["_row", "_lang", "_source"]).withColumn("x", F.array(*transformed()))
    stats = keep(stats.withColumn("g1", F.xxhash64(F.lit(1), "_lang", F.col("_lang").isNull(), "_source", F.col("_source").isNull())).withColumn("g2", F.xxhash64(F.lit(2), "_lang", F.col("_lang").isNull())), "mcd-stats")
    ones = stats.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n1"))
    small = ones.where(F.col("n1") < MIN_ROWS).groupBy("g2").agg(F.sum("n1").alias("n2"))
    chosen = ones.join(small, "g2", "left").select("g1", F.when(F.col("n1") >= MIN_ROWS, F.col("g1")).when(F.col("n2") >= MIN_ROWS, F.col("g2")).otherwise(F.lit(0)).alias("grp"), "n1")
    chosen = keep(chosen, "mcd-groups")
    few = chosen.count() <= BROADCAST_ROWS
    rest = chosen.where("grp = 0").agg(F.sum("n1")).first()[0] or 0
    by_group = chosen.select("g1", "grp")
    rows = stats.join(F.broadcast(by_group) if few else by_group, "g1")
    fitted = mcd(rows.where(F.lit(rest >= MIN_ROWS) | (F.col("grp") != 0)).select("grp", "x"), p)
    measured = rows.join(F.broadcast(fitted) if few else fitted, "grp", "left").withColumn("distance", _distance(p) / F.col("scale"))
    measured = measured.withColumn("base_failed", base_failed())
    return measured.select("_row.*", *_COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CHI_LIMIT)).alias("kept"))
