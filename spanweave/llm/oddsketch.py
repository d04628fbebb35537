"""Near-duplicate documents: MinHash bands for candidates, odd sketches for verification.

A document's set is its distinct k-word shingles (64-bit hashes). ``samples`` MinHash values
are cut into bands of ``BAND_ROWS``; documents that share a band meet in a bucket. The same
samples are folded into a bitmap by parity (the odd sketch): bits that differ between two
bitmaps count samples that differ, which estimates high similarities closely, so a bitmap
comparison settles nearly all candidates before whole texts are read. Links are then
confirmed on the full sets.

The number of bands follows the threshold: a pair at the threshold is missed with
probability ``MISS``. The bitmap test leaves five standard deviations of room.

Large buckets: documents with equal sets are one class from the start. In a bucket each class
is first compared with one leader, the class that meets the most others over all its buckets, so a large group
has few leaders; confirmed links give components. Buckets that still hold several components go on, with their
leader as the centre.

What is left is never compared all with all. Per centre, a shingle counts as usual if more than half of its
classes have it; let D be the shingles in which a class differs from the usual ones. Two classes differ in
|D_x| + |D_y| - 2 |D_x and D_y| shingles, and a link allows K (n_x + n_y), K = (1 - t) / (1 + t). With the excess
e = |D| - K n of a class, a pair with e_x + e_y <= 0 needs no common deviation, but then both link to the class of least
excess, and meet only that. Every other link needs (e_x + e_y) / 2 common deviations. So classes meet on
deviations that another class of the centre shares, rarest first, each on only as many as it cannot do
without (a prefix filter), and only where both have enough of them left; a class with too few shared
deviations meets nobody. No link between components is lost.

Defined cases: a null or empty text, or one without words, has an empty set, links with
nothing and is kept; fewer than k words make one shingle; rows of the same id are one
document whose text is the smallest; rows without an id are left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.components import components
from spanweave.llm.tables import keep, ship
from spanweave.llm.textscan import LOWER, U64, mix, pieces, scan_words, shingle_sets

BAND_ROWS = 5
MISS = 1e-6
BITMAP_BITS = 512


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**BAND_ROWS))


def bitmap_limit(threshold: float, samples: int) -> int:
    """The most differing bits of a pair at the threshold, with five deviations of room."""
    low = threshold - 5 * math.sqrt(threshold * (1 - threshold) / samples)
    odd = lambda s: BITMAP_BITS / 2 * (1 - (1 - 2 / BITMAP_BITS) ** (2 * samples * (1 - s)))
    return math.ceil(odd(low) + 5 * math.sqrt(odd(low)) / 2)


def _minhashes(hashes: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """[text, sample]: the least value of each hash function; rows of texts without shingles are 0."""
    rng = np.random.default_rng(7)
    times = rng.integers(1, 2**63, samples, dtype=np.uint64) * U64(2) + U64(1)
    plus = rng.integers(0, 2**63, samples, dtype=np.uint64)
    filled = np.flatnonzero(np.diff(first))
    out = np.zeros((samples, len(first) - 1), np.uint64)
    if len(filled):
        # In slices that stay in the processor's cache.
        for n in range(0, len(filled), 64):
            texts = filled[n : n + 64]
            own = hashes[first[texts[0]] : first[texts[-1] + 1]]
            at = first[texts] - first[texts[0]]
            for j in range(samples):
                out[j, texts] = np.minimum.reduceat((own ^ plus[j]) * times[j], at)
    return out.T


def _bitmaps(minhash: np.ndarray) -> np.ndarray:
    """[text, word]: for each sample one bit, chosen by its value, is turned over."""
    n, samples = minhash.shape
    salted = mix(minhash + np.arange(samples, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    bit = (salted % U64(BITMAP_BITS)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * BITMAP_BITS + bit).ravel(), minlength=n * BITMAP_BITS)
    bits = (counts.reshape(n, BITMAP_BITS // 64, 64) & 1).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, n, data, ends in pieces(column):
        yield row, n, *shingle_sets(scan_words(LOWER[data], ends), k)


def features(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int) -> DataFrame:
    """(id, n_shingles, same, bands, bitmap): ``same`` identifies the set."""
    kind = docs.schema[id_col].dataType.simpleString()
    samples = bands * BAND_ROWS
    steps = np.random.default_rng(11).integers(1, 2**63, BAND_ROWS, dtype=np.uint64) * U64(2) + U64(1)

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, hashes, first in _sets(batch.column(1), k):
                least = _minhashes(hashes, first, samples)
                keys = mix((least.reshape(n, bands, BAND_ROWS) * steps).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=total[0, 1:])
                np.cumsum(mix(hashes ^ U64(0x5851F42D4C957F2D)), out=total[1, 1:])
                same = (total[:, first[1:]] - total[:, first[:-1]]).astype(np.int64)
                columns = [
                    batch.column(0).slice(row, n),
                    pa.array(np.diff(first)),
                    pa.array([f"{a:x}{b:x}" for a, b in same.view(np.uint64).T.tolist()]),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(_bitmaps(least).view(np.int64).ravel()), BITMAP_BITS // 64).cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "same", "bands", "bitmap"])

    return docs.select(id_col, text_col).mapInArrow(ship(compute), f"id {kind}, n_shingles bigint, same string, bands array<bigint>, bitmap array<bigint>")


def _similar(threshold: float, k: int):
    """Keeps the pairs (a, b, text_a, text_b) whose full sets are similar enough."""
    percent = round(100 * threshold)

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few thousand pairs at a time keep the sets small.
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                linked = np.zeros(some.num_rows, bool)
                left = [h[f[d] : f[d + 1]] for _, n, h, f in _sets(some.column(2), k) for d in range(n)]
                right = [h[f[d] : f[d + 1]] for _, n, h, f in _sets(some.column(3), k) for d in range(n)]
                for n, (x, y) in enumerate(zip(left, right)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[n] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked)) for c in some.columns[:2]], ["a", "b"])

    return verify


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(ship(_similar(threshold, k)), f"a {kind}, b {kind}")


def _may_link(left: str, right: str, threshold: float, limit: int) -> Column:
    """Sizes and bitmaps allow the threshold."""
    differ = sum(F.bit_count(F.col(f"{left}.bitmap")[w].bitwiseXOR(F.col(f"{right}.bitmap")[w])) for w in range(BITMAP_BITS // 64))
    x, y = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (differ <= limit) & (F.least(x, y) >= F.greatest(x, y) * F.lit(threshold - 1e-9))


def _extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b)."""
    if links.isEmpty():
        return parts
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    over = components(joined, "odd-over").select(F.col("node").alias("component"), F.col("component").alias("top"))
    alone = over.join(parts.select(F.col("node").alias("component")), "component", "left_anti")
    alone = alone.select(F.col("component").alias("node"), F.col("top").alias("component"))
    return parts.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")).unionByName(alone)


def _still_mixed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (bucket, leader, id, component) of buckets with several components."""
    placed = buckets.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(several.select("bucket"), "bucket")


def _one_per_id(docs: DataFrame) -> DataFrame:
    """Rows with an id, and of several rows of one id the one with the smallest text."""
    docs = docs.where(F.col("id").isNotNull())
    repeated = keep(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "odd-repeated")
    if repeated.isEmpty():
        return docs
    once = docs.join(repeated.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return docs.join(repeated.hint("merge"), "id", "left_anti").unionByName(once)


def _deviations(of: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(centre, id, n, item) for classes (centre, id): the shingles that only one of the two has."""
    kind = of.schema["id"].dataType.simpleString()

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                own = [h[f[d] : f[d + 1]] for _, n, h, f in _sets(some.column(2), k) for d in range(n)]
                centre = [h[f[d] : f[d + 1]] for _, n, h, f in _sets(some.column(3), k) for d in range(n)]
                items = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(own, centre)]
                rows = pa.array(np.repeat(np.arange(len(items)), [len(i) for i in items]))
                sizes = pa.array(np.array([len(x) for x in own], np.int64)).take(rows)
                found = pa.array(np.concatenate(items).view(np.int64)) if items else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(rows), some.column(1).take(rows), sizes, found], ["centre", "id", "n", "item"])

    x = texts.select("id", F.col("text").alias("own"))
    c = texts.select(F.col("id").alias("centre"), F.col("text").alias("other"))
    both = of.join(x, "id").join(c, "centre").select("centre", "id", "own", "other")
    return both.mapInArrow(ship(compute), f"centre {kind}, id {kind}, n bigint, item bigint").drop("n")


def _from_the_usual(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Deviations (centre, id, item) from the centre turned into those from what more than half of its classes have.

    Where more than half deviate, the others do instead; so there are never more rows than before.
    """
    size = members.groupBy("centre").agg(F.count(F.lit(1)).alias("size"))
    often = rows.groupBy("centre", "item").agg(F.count(F.lit(1)).alias("df")).join(size, "centre")
    often = keep(often.where("2 * df > size").select("centre", "item"), "odd-usual")
    others = members.select("centre", "id").join(often, "centre").join(rows, ["centre", "id", "item"], "left_anti")
    return rows.join(often, ["centre", "item"], "left_anti").unionByName(others.select(*rows.columns))


def _meet_on_deviations(members: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) of classes (centre, id, n, component) that may link, see the head of this module."""
    allowed = (1 - threshold) / (1 + threshold)
    rows = keep(_from_the_usual(keep(_deviations(members.select("centre", "id"), texts, k), "odd-deviations"), members), "odd-deviations")
    counts = rows.groupBy("centre", "id").agg(F.count(F.lit(1)).alias("d"))
    sized = members.join(counts, ["centre", "id"], "left").withColumn("excess", F.coalesce("d", F.lit(0)) - allowed * F.col("n")).drop("d", "n")
    least = sized.groupBy("centre").agg(F.min(F.struct("excess", "id", "component")).alias("least"))
    sized = keep(sized.join(least, "centre"), "odd-excess")
    apart = F.col("component") != F.col("least.component")
    usual = sized.where(apart & (F.col("excess") + F.col("least.excess") <= 1e-9))
    usual = usual.select(F.least("id", "least.id").alias("a"), F.greatest("id", "least.id").alias("b"))

    shared = rows.groupBy("centre", "item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("centre", "id")
    held = rows.join(shared, ["centre", "item"]).withColumn("place", F.row_number().over(own.orderBy("df", "item"))).withColumn("common", F.count(F.lit(1)).over(own))
    held = held.join(sized, ["centre", "id"])
    needed = F.greatest(F.ceil((F.col("excess") + F.col("least.excess")) / 2 - 1e-9), F.lit(1))
    prefix = held.where(F.col("place") <= F.col("common") - needed + 1).withColumn("left", F.col("common") - F.col("place") + 1)
    side = F.struct("id", "component", "excess", "left").alias
    pairs = prefix.select("centre", "item", side("x")).join(prefix.select("centre", "item", side("y")), ["centre", "item"])
    enough = F.least("x.left", "y.left") >= (F.col("x.excess") + F.col("y.excess")) / 2 - 1e-9
    pairs = pairs.where((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & enough)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).unionByName(usual).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id reachable over links, one row per id."""
    bands = bands_for(threshold)
    limit = bitmap_limit(threshold, bands * BAND_ROWS)
    docs = _one_per_id(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    made = keep(features(docs, "id", "text", k, bands), "odd-features")
    filled = made.where("n_shingles > 0")
    classes = filled.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    leading = filled.join(classes.select(F.col("rep").alias("id"), "same"), ["id", "same"], "left_semi").dropDuplicates(["id", "same"])

    band = F.posexplode("bands").alias("band", "value")
    placed = leading.select("id", band).select("id", F.xxhash64("band", "value").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = keep(placed.join(shared, "bucket"), "odd-buckets")
    meets = buckets.groupBy("id").agg(F.sum("members").alias("meets"))
    ranked = buckets.select("bucket", "id").join(meets, "id")
    leaders = ranked.groupBy("bucket").agg(F.max_by("id", F.struct("meets", F.xxhash64("id"), "id")).alias("leader"))
    buckets = keep(buckets.select("bucket", "id").join(leaders, "bucket"), "odd-led")
    met = buckets.select("id").distinct()
    known = keep(leading.join(met, "id", "left_semi").select("id", "n_shingles", "bitmap"), "odd-classes")
    # The ids grow with the input; the hint keeps one plan at every size.
    texts = keep(docs.join(known.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "odd-texts")

    led = buckets.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    left, right = known.select(F.col("id").alias("a"), F.struct("n_shingles", "bitmap").alias("x")), known.select(F.col("id").alias("b"), F.struct("n_shingles", "bitmap").alias("y"))
    first = keep(led.join(left, "a").join(right, "b").where(_may_link("x", "y", threshold, limit)).select("a", "b"), "odd-first")
    links = keep(_confirm(first, texts, threshold, k), "odd-links")

    parts = keep(components(links), "odd-parts")
    mixed = _still_mixed(buckets, parts).select(F.col("leader").alias("centre"), "id", "component").distinct()
    mixed = keep(mixed.join(known.select("id", F.col("n_shingles").alias("n")), "id"), "odd-mixed")
    rest = _meet_on_deviations(mixed, texts, threshold, k).join(first, ["a", "b"], "left_anti")
    rest = keep(rest.join(left, "a").join(right, "b").where(_may_link("x", "y", threshold, limit)).select("a", "b"), "odd-rest")
    final = _extended(parts, keep(_confirm(rest, texts, threshold, k), "odd-links")).select(F.col("node").alias("rep"), "component")
    named = classes.join(final, "rep", "left").select("same", F.coalesce("component", "rep").alias("component"))
    return (
        made.join(named, "same", "left")
        .groupBy("id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.min(F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"))
    )
