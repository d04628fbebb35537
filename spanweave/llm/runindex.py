"""Removal of repeated byte strings by run-length Burrows-Wheeler indexes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is
repeated. Strings never cross documents and are judged on the input.

1. Anchors. Of the ``GRAM``-byte hashes inside a string of ``length`` bytes the least one, the leftmost
   of equals, is its anchor, so equal strings have equal anchors. The strings of a text with
   one and the same anchor start side by side; their bytes together are a segment.
2. Counting. Segments are grouped by anchor (combined before the shuffle). An anchor seen once has
   no repeated string; equal segments at several places are repeated as a whole.
3. Index. What is left, different segments of one anchor, is dealt by anchor into shards of
   about ``SHARD_BYTES``. A shard is sorted by suffixes, its Burrows-Wheeler transform is cut into
   runs, and only at the first and last row of a run the common length with the row above or
   below is measured. From these samples the matching statistic of every position is streamed:
   between samples it falls by one from byte to byte. Positions that match ``length`` bytes start repeated strings.
4. Frequent anchors. With more than ``SEGMENTS`` different segments, an anchor's strings are regrouped by the
   bytes that ``PART`` neighbouring ones have in common, and what is still frequent then by whole strings. Each
   step drops what is single, so no group goes whole into one task and no string is left out.

Defined cases: null and empty texts, and texts shorter than ``length``, have nothing removed; rows of
equal id and text are repeated by each other; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import drop, keep, ship
from spanweave.llm.textscan import U64, Hasher, pieces

LENGTH = 200
GRAM = 32
PART = 21
SEGMENTS = 4000
SHARD_BYTES = 1_500_000
_END = 0xFF  # never a byte of UTF-8


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost place of the least of ``values[i : i + width]``."""
    n = len(values)
    bits = max(22, n.bit_length())
    packed = (values >> U64(bits) << U64(bits)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & U64((1 << bits) - 1)).astype(np.int64)


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, number of strings, anchor hash, segment hash) of a piece."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    hasher = Hasher(data)
    at = np.arange(len(data) - gram + 1)
    hashes = hasher.of(at, at + gram)
    anchor = _sliding_argmin(hashes, length - gram + 1)
    room = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(data))
    start = np.flatnonzero(room[: len(anchor)] >= length)
    if not len(start):
        return none
    own = anchor[start]
    new = np.ones(len(start), bool)
    # Texts never share an anchor, but the last and first strings of two texts may be neighbours.
    new[1:] = (own[1:] != own[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, own = start[first], own[first]
    text = np.searchsorted(ends, begin, "right") - 1
    return text, begin - ends[text], count, hashes[own].view(np.int64), hasher.of(begin, begin + count + length - 1).view(np.int64)


def _find(length: int, gram: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, ends in pieces(batch.column(2)):
                text, start, count, key, same = segments(data, ends, length, gram)
                rows = pa.array(text + row)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "th", "start", "strings", "key", "same"])

    return find


def _suffixes(data: np.ndarray, to_end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(rank of each suffix, ranks by depth). Every end mark differs from every other one."""
    n = len(data)
    padded = np.append(data, np.full(8, _END, np.uint8)).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(8):
        keys = (keys << U64(8)) | np.where(to_end >= j, padded[j : n + j], U64(_END))
    order = np.argsort(keys, kind="stable")
    ended = to_end < 8
    new = np.ones(n, bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | ended[order][1:]
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = place
    by_depth, depth = [(8, rank.copy())], 8
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_ = order[np.repeat(size > 1, size)]
    while len(open_):
        pair = (rank[open_].astype(np.int64) << 32) | rank[open_ + depth]
        by = np.argsort(pair)
        open_, pair = open_[by], pair[by]
        outer, inner = np.ones(len(by), bool), np.ones(len(by), bool)
        outer[1:] = (pair[1:] >> 32) != (pair[:-1] >> 32)
        inner[1:] = pair[1:] != pair[:-1]
        nth = np.arange(len(by))
        rank[open_] = (pair >> 32) + np.maximum.accumulate(np.where(inner, nth, 0)) - np.maximum.accumulate(np.where(outer, nth, 0))
        size = np.diff(np.append(np.flatnonzero(inner), len(by)))
        open_ = open_[np.repeat(size > 1, size)]
        depth *= 2
        by_depth.append((depth, rank.copy()))
    return rank, by_depth


def _common(x: np.ndarray, y: np.ndarray, data: np.ndarray, by_depth: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The common length of the suffixes at x and y."""
    total = np.zeros(len(x), np.int64)
    n = len(data)
    for depth, rank in reversed(by_depth):
        while True:
            a, b = x + total, y + total
            inside = np.maximum(a, b) < n
            a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
            same = inside & (rank[a] == rank[b]) & (a != b)
            total += depth * same
            if depth != by_depth[-1][0] or not same.any():
                break
    for _ in range(7):
        a, b = np.minimum(x + total, n - 1), np.minimum(y + total, n - 1)
        total += (data[a] == data[b]) & (data[a] != _END) & (np.maximum(x, y) + total < n)
    return total


def matching_statistics(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(longest match elsewhere at each position, offsets of the parts, runs of the transform).

    The text is the parts, each followed by an end mark.
    """
    data = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    offset = np.append(0, np.cumsum(sizes + 1))
    n = len(data)
    to_end = np.repeat(offset[1:] - 1, sizes + 1) - np.arange(n)
    rank, by_depth = _suffixes(data, to_end)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    before = data[suffix - 1]
    change = np.ones(n + 1, bool)
    change[1:n] = (before[1:] != before[:-1]) | (before[1:] == _END)
    longest = np.zeros(n, np.int64)
    for head, other in ((change[:n], -1), (change[1:], 1)):
        at = np.flatnonzero(head)
        inside = at[(at + other >= 0) & (at + other < n)]
        sample = np.zeros(n, np.int64)
        sample[suffix[inside]] = _common(suffix[inside], suffix[inside + other], data, by_depth)
        is_sample = np.zeros(n, bool)
        is_sample[suffix[at]] = True
        last = np.maximum.accumulate(np.where(is_sample, np.arange(n), 0))
        longest = np.maximum(longest, sample[last] - (np.arange(n) - last))
    return longest, offset, int(change[:n].sum())


def _marks(starts: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to) of the maximal stretches that strings at ``starts`` cover."""
    part = np.searchsorted(offset, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (np.diff(starts) > length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    part = part[first] if len(starts) else part
    return part, starts[first] - offset[part], starts[last] - offset[part] + length


def _index(length: int):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None

        def resolve() -> pa.RecordBatch:
            longest, offset, _ = matching_statistics([h[3] for h in held])
            part, begin, end = _marks(np.flatnonzero(longest >= length), offset, length)
            own = [held[p] for p in part.tolist()]
            start = np.array([h[2] for h in own], np.int64)
            columns = [pa.array([h[0] for h in own], pa.int64()), pa.array([h[1] for h in own], pa.int64()), pa.array(start + begin), pa.array(start + end)]
            return pa.RecordBatch.from_arrays(columns, ["k", "th", "begin", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[4] != key and size >= SHARD_BYTES:
                    yield resolve()
                    held, size = [], 0
                key = row[4]
                held.append(row)
                size += len(row[3])
        if held:
            yield resolve()

    return index


def _regroup(length: int, part: int):
    """Segments cut into runs of ``part`` strings from fixed places around the anchor, by common bytes."""

    def regroup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows: list[list] = [[] for _ in range(6)]
                some = batch.slice(at, 2000)
                for k, th, start, raw, key in zip(*(c.to_pylist() for c in some.columns)):
                    # Where the anchor is found again: equal strings have it at equal places.
                    data = np.frombuffer(raw, np.uint8)
                    grams = np.arange(len(raw) - GRAM + 1)
                    anchor = int(np.flatnonzero(Hasher(data).of(grams, grams + GRAM).view(np.int64) == key)[0]) if part > 1 else 0
                    n = len(raw) - length + 1
                    first = 0
                    while first < n:
                        # The bytes that all strings of the whole run have, also where it is cut off here.
                        begin = first - (first - anchor) % part
                        last = min(n, begin + part)
                        core = raw[begin + part - 1 : begin + length]
                        own = raw[first : last + length - 1]
                        label = int.from_bytes(hashlib.blake2b(core + bytes([(begin - anchor) // part % 251, part]) if part > 1 else core, digest_size=8).digest(), "little", signed=True)
                        for column, value in zip(rows, (k, th, start + first, own, label, last - first)):
                            column.append(value)
                        first = last
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["k", "th", "start", "raw", "key", "strings"])

    return regroup


_RAW = "k bigint, th bigint, start int, raw binary, key bigint, strings int"


def _whole(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("k", "th", F.col("start").cast("long").alias("begin"), (F.col("start").cast("long") + F.col("strings") + (length - 1)).alias("end"))


def _settle(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of segments (key, same, k, th, start, strings): what is repeated whole, and what is to be compared.

    The latter has one place for each different segment of a key, and ``kinds``, their number.
    """
    counted = rows.groupBy("key", "same").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "th", "start")).alias("place"))
    counted = keep(counted, "run-counted")
    kinds = counted.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    whole = _whole(rows.join(counted.where("times > 1").select("key", "same"), ["key", "same"]), length)
    places = counted.join(kinds, "key").select("key", "same", "kinds", "place.*")
    return whole, places


def _compared(segs: DataFrame, length: int) -> DataFrame:
    """Marks (k, th, begin, end) from segments with bytes (k, th, start, raw, key)."""
    dealt = segs.select("k", "th", "start", "raw", "key").repartition("key").sortWithinPartitions("key", "raw", "k", "th", "start")
    return dealt.mapInArrow(ship(_index(length)), "k bigint, th bigint, begin bigint, end bigint")


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(k, th, ranges): for hashes of id and text, the ranges of repeated bytes, unmerged."""
    rows = docs.select(F.xxhash64(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    gram = min(GRAM, length)
    shape = "k bigint, th bigint, start int, strings int, key bigint, same bigint"
    found = keep(rows.mapInArrow(ship(_find(length, gram)), shape), "run-segments")
    by_key = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("low"), F.max("same").alias("high")).where("n > 1")
    several = keep(found.join(by_key.select("key", (F.col("low") == F.col("high")).alias("alike")), "key"), "run-several")
    drop(found)
    marks = [_whole(several.where("alike"), length)]
    mixed = several.where("not alike")
    whole, places = _settle(mixed, length)
    marks.append(whole)
    sized = mixed.select("key", "same", "k", "th", "start", "strings").join(places, ["key", "same", "k", "th", "start"]).dropDuplicates(["key", "same"])
    raw = F.expr(f"substring(cast(text as binary), start + 1, strings + {length - 1})")
    texts = rows.dropDuplicates(["k", "th"]) if False else rows
    segs = sized.join(texts, ["k", "th"]).select("k", "th", "start", raw.alias("raw"), "key", "kinds")
    segs = keep(segs, "run-bytes")
    marks.append(_compared(segs.where(F.col("kinds") <= SEGMENTS), length))
    for part in (PART, 1):
        segs = segs.where(F.col("kinds") > SEGMENTS).select("k", "th", "start", "raw", "key")
        cut = keep(segs.mapInArrow(ship(_regroup(length, part)), _RAW), "run-parts").withColumn("same", F.xxhash64("raw"))
        whole, places = _settle(cut, length)
        marks.append(whole)
        segs = cut.join(places, ["key", "same", "k", "th", "start"]).dropDuplicates(["key", "same"])
        segs = keep(segs.select("k", "th", "start", "raw", "key", "kinds"), "run-bytes")
        if part > 1:
            marks.append(_compared(segs.where(F.col("kinds") <= SEGMENTS), length))
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    ranges = every.distinct().groupBy("k", "th").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    return keep(ranges, "run-ranges")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges of the union."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _cut(whole_chars: bool, with_text: bool):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sizes, removed, spans, sums, left = [], [], [], [], []
                for text, ranges in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                    raw = (text or "").encode()
                    gone = merged([(r["begin"], r["end"]) for r in ranges or ()])
                    if whole_chars:
                        # Characters that are only partly covered stay.
                        is_start = lambda b: b >= len(raw) or raw[b] & 0xC0 != 0x80
                        gone = [(next(b for b in range(x, x + 4) if is_start(b)), next(b for b in range(y, y - 4, -1) if is_start(b))) for x, y in gone]
                    kept = b"".join(raw[x:y] for x, y in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(raw)]))
                    sizes.append(len(raw))
                    removed.append(sum(y - x for x, y in gone))
                    spans.append(len(gone))
                    sums.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode() if with_text else None)
                columns = [some.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(sums, pa.string()), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return cut


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str], with_text: bool = False) -> DataFrame:
    """``carry``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the text that stays.

    With the text, characters that are only partly repeated stay whole.
    """
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, length=length)
    row = F.struct(*carry)
    keyed = docs.select(row.alias("_row"), F.xxhash64(id_col).alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("_text"))
    joined = keyed.join(ranges, ["k", "th"], "left").select("_row", "_text", "ranges")
    kind = keyed.schema["_row"].dataType.simpleString()
    shape = f"_row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    cut = joined.mapInArrow(ship(_cut(with_text, with_text)), shape)
    return cut.select("_row.*", *[c for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")], *(["kept_text"] if with_text else []))
