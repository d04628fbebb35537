"""Document fingerprints by spot signatures.

A spot is an anchor (a common word) with the ``CHAIN`` content words that follow it; its hash is a
signature, and its repetitions count as further ones. Texts without common words, such as lists, have anchors too: every word whose
hash is 0 modulo ``RARE_ANCHOR``. A text whose words make no spot has one signature, of all its words; a
text without words has one of its characters, and an empty text has none.

A fingerprint names the number of signatures, a digest of all of them and the ``KEPT`` smallest ones
in hex, so sets that differ anywhere have different fingerprints. Likeness is the Jaccard index of
the whole sets, whatever their size.

Defined cases: null is the empty text; two empty texts have likeness 1, an empty and another
text 0; equal texts have equal fingerprints; rows of equal id follow each other by text; a null id comes
last; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import keep, ship
from spanweave.llm.textscan import LOWER, U64, Hasher, mix, pieces, scan_words

CHAIN = 2
KEPT = 128
#: Texts are compared in lots of about this many characters.
CHARS_AT_ONCE = 500_000
RARE_ANCHOR = 4
#: Common words of English, German, French and Spanish; fixed values.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine es ist mit nicht sich und von zu "
    "au avec dans de des du en est et la le les par pour que qui sur un une "
    "al como con del el las lo los no por se su una y"
).split()
#: Everything in ASCII but letters and digits parts words.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _anchor_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(ANCHORS).encode(), np.uint8)
    return np.unique(scan_words(data, np.array([0, len(data)])).hash)


def signatures(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures sorted within texts, offsets by text) of a piece of texts."""
    n_texts = len(ends) - 1
    data = LOWER[data]
    hasher = Hasher(data)
    words = scan_words(data, ends, _PARTS, hasher)
    doc = words.doc
    common = np.isin(words.hash, _anchor_hashes())
    content = np.flatnonzero(~common)
    anchor = np.flatnonzero(common | (words.hash % U64(RARE_ANCHOR) == 0))
    after = np.searchsorted(content, anchor, "right")
    fits = after + CHAIN <= len(content)
    anchor, after = anchor[fits], after[fits]
    fits = doc[content[after + CHAIN - 1]] == doc[anchor] if len(anchor) else np.zeros(0, bool)
    anchor, after = anchor[fits], after[fits]
    spots = mix(words.hash[anchor])
    for j in range(CHAIN):
        spots = mix(spots * U64(3) + words.hash[content[after + j]])
    owner = doc[anchor]
    bare = np.setdiff1d(np.flatnonzero(np.diff(ends) > 0), owner)
    if len(bare):
        # All words in order, or the text as it is.
        place = words.hash * (np.arange(len(doc), dtype=np.uint64) - words.first[doc].astype(np.uint64) + U64(1))
        total = np.append(U64(0), np.cumsum(mix(place), dtype=np.uint64))
        whole = mix(total[words.first[bare + 1]] - total[words.first[bare]])
        none = words.first[bare + 1] == words.first[bare]
        whole[none] = mix(hasher.of(ends[bare[none]], ends[bare[none] + 1]))
        spots, owner = np.append(spots, whole), np.append(owner, bare)
    order = np.argsort(spots)
    order = order[np.argsort(owner[order], kind="stable")]
    spots, owner = spots[order], owner[order]
    # A multiset: the second, third ... of equal spots are signatures of their own.
    new = np.ones(len(spots), bool)
    new[1:] = (spots[1:] != spots[:-1]) | (owner[1:] != owner[:-1])
    nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(new, np.arange(len(spots)), 0))
    again = nth > 0
    spots[again] = mix(spots[again] + nth[again].astype(np.uint64))
    order = np.argsort(spots)
    order = order[np.argsort(owner[order], kind="stable")]
    spots, owner = spots[order], owner[order]
    return spots, np.searchsorted(owner, np.arange(n_texts + 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def to_text(own: np.ndarray) -> str:
    raw = own.astype(">u8").tobytes()
    return f"{len(own)}:{hashlib.sha256(raw).hexdigest()}:{raw[: 8 * KEPT].hex()}"


def _sets(texts: list[str]) -> list[np.ndarray]:
    return [s[f[d] : f[d + 1]] for _, n, data, ends in pieces(pa.array(texts, pa.large_string())) for s, f in [signatures(data, ends)] for d in range(n)]


def _edit(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_signatures, fingerprint, signatures): one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, data, ends in pieces(batch.column(1)):
                spots, first = signatures(data, ends)
                own = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(spots.view(np.int64)))
                text = pa.array([to_text(spots[first[d] : first[d + 1]]) for d in range(n)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(first)), text, own], ["id", "n_signatures", "fingerprint", "signatures"])

    return docs.select(id_col, text_col).mapInArrow(ship(compute), f"id {kind}, n_signatures bigint, fingerprint string, signatures array<bigint>")


def near_pairs(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness): pairs of classes of equal fingerprint with Jaccard at or above ``threshold``.

    A class stands for all documents of its fingerprint and is named by its smallest id. Sets are
    dealt into partitions by length, each as wide as one factor ``threshold``, so that a set
    can only match sets of its own partition or the next. Within them a set is found by its
    rarest signatures alone: two sets that alike share one of the first
    ``n - ceil(threshold * n) + 1`` of either.
    """
    made = keep(fingerprints(docs, id_col=id_col, text_col=text_col).where("n_signatures > 0"), "spots")
    classes = keep(made.groupBy("fingerprint").agg(F.min("id").alias("id"), F.first("n_signatures").alias("n"), F.first("signatures").alias("signatures")), "spot-classes")
    spots = classes.select("id", "n", F.explode("signatures").alias("signature"))
    ranked = spots.join(spots.groupBy("signature").agg(F.count(F.lit(1)).alias("df")), "signature").where("df > 1 or n > 0")
    ordered = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "signature"))).alias("all"))
    rare = ordered.select("id", "n", F.explode(F.expr(f"slice(all, 1, int(n - ceil({threshold} * n) + 1))")).alias("s")).where("s.df > 1")
    part = F.floor(F.log(F.col("n")) / -F.log(F.lit(threshold))) if threshold < 1 else F.col("n")
    placed = rare.select("id", "n", F.col("s.signature").alias("signature"), part.alias("part"))
    other = placed.select(F.col("id").alias("b"), F.col("n").alias("nb"), "signature", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    close = (F.col("nb") >= F.col("n")) & (F.col("n") >= threshold * F.col("nb")) & ((F.col("nb") > F.col("n")) | (F.col("id") < F.col("b")))
    pairs = placed.join(other, ["signature", "part"]).where(close).select(F.col("id").alias("a"), "b").distinct()
    x, y = classes.select(F.col("id").alias("a"), F.col("signatures").alias("x")), classes.select(F.col("id").alias("b"), F.col("signatures").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    scored = pairs.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("likeness"))
    return scored.where(F.col("likeness") >= threshold)


def against_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness, see ``_edit``.

    The next document is the one before in ascending order of id, the first one's being the
    last. Documents are dealt into ranges of ids, as many as shuffle partitions; each range also receives
    the first document of the range that follows it, so no range waits for another.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("key", [n / n_ranges for n in range(1, n_ranges)], 0.1 / n_ranges)))
    cut_rows = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    ranged = rows.withColumn("range", F.size(F.filter(cut_rows, lambda c: F.col("key") >= c)))
    # One row per range: the driver holds as many ids as there are partitions.
    heads = sorted(ranged.groupBy("range").agg(F.max("key").alias("head")).collect(), reverse=True)
    follow = [(h["range"], heads[(n + 1) % len(heads)]["head"]) for n, h in enumerate(heads)]
    tails = spark.createDataFrame(follow, "range int, key long")
    tail = rows.join(F.broadcast(tails), "key").select("id", "key", "text", "range", F.lit(True).alias("tail"))
    dealt = ranged.withColumn("tail", F.lit(False)).unionByName(tail)
    dealt = dealt.repartition(n_ranges, "range").sortWithinPartitions(F.desc("range"), "tail", F.desc("key"), "text")

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, ranges, tails = [], [], [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for column, held in zip(batch.slice(at, 200).columns, (ids, texts, ranges, tails)):
                    held.extend(column.to_pylist())
                if sum(map(len, texts)) >= CHARS_AT_ONCE:
                    yield _compare(ids[:-1], texts, ranges, tails[:-1])
                    for held in (ids, texts, ranges, tails):
                        del held[:-1]
        if len(texts) > 1:
            yield _compare(ids[:-1], texts, ranges, tails[:-1])

    def _compare(ids, texts, ranges, tails) -> pa.RecordBatch:
        rows = [n for n in range(len(ids)) if not tails[n]]
        edited = [_edit(texts[n], texts[n + 1]) for n in rows]
        own, changed = _sets(texts), _sets(edited)
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array([ids[n] for n in rows], kind),
                "n_chars": pa.array([len(texts[n]) for n in rows], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array([to_text(own[n]) for n in rows], pa.string()),
                "edited_fingerprint": pa.array([to_text(s) for s in changed], pa.string()),
                "near_edited": pa.array([likeness(own[n], s) for n, s in zip(rows, changed)], pa.float64()),
                "near_next": pa.array([likeness(own[n], own[n + 1]) for n in rows], pa.float64()),
            }
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("id", "text", "range", "tail").mapInArrow(ship(compute), shape)
