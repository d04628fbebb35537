"""Text scores by context-tree weighting over bytes.

A byte is eight binary decisions, one per node of a binary tree; each node has a tree of contexts,
the 0 to ``depth`` bytes before. Every context estimates its node's bit after Krichevsky and Trofimov,
kt(bit) = (n_bit + 1/2) / (n + 1), and the weighting mixes the estimates of all depths: a context's
weighted probability is half its own estimate of all it has seen and half the product over its longer
contexts. Learning counts; scoring leaves the counts as they are, so a text's probability is the product over
its bytes and an end mark. Byte 0xFF, which no text holds, stands for what precedes a text and for its end.
A code length per byte is -log2 p / (bytes + 1).

How it runs. A unit is a byte with its ``depth`` bytes before, packed into one integer with the
nearest byte foremost, so that sorted units lie in the order of the context tree. All texts are dealt into chunks of
about ``CHUNK_BYTES``; a chunk sends each of its distinct units once, with its count in training texts. Counts
are summed by unit, so a frequent unit costs one row per chunk. The distinct units are cut into ranges of about
``RANGE_UNITS``, each worked out in numpy from the deepest contexts up. Contexts that a border
may cut (those of a range's first and last unit, at most 2 * (depth + 1) a range with 255 nodes each) are
summed over ranges on the driver, which holds under one row per hundred units for them. Then each range gives its units' log
probabilities, which are joined to the chunks that asked; a chunk's task looks them up for its texts. Words for
the base score travel the same way as 64-bit hashes with counts.

Base: tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; the sum of
log10((c + 0.1) / (N + 0.1 * (V + 1))) over the text's tokens.

Defined cases: a null text is empty, and scored as its end alone; without training texts every bit has probability 1/2;
repeated rows and ids, null ids included, are texts of their own; an empty table gives no rows; a text longer
than a chunk is a chunk of its own, read in blocks; columns are carried by name in a struct, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm import textscan
from spanweave.llm.tables import keep, ship, ship_whole

DEPTH = 4
CHUNK_BYTES = 32_000_000
RANGE_UNITS = 300_000
#: Units are made in blocks of about this many bytes.
BLOCK = 4_000_000
EDGE = 0xFF
U64 = np.uint64
_LOG_HALF = math.log(0.5)


# --- units and words of texts -------------------------------------------------------


def units_of(data: np.ndarray, ends: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit, text) of every byte and end mark, text by text, in blocks of about ``BLOCK``."""
    sizes = np.diff(ends)
    n = len(sizes)
    frame = np.full(len(data) + n * (depth + 1), EDGE, np.uint8)
    shift = (np.arange(n) + 1) * depth + np.arange(n)
    if n == 1:
        frame[depth : depth + len(data)] = data
    else:
        frame[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    first = ends[:-1] + shift  # where a text's first byte (or its end mark) stands
    for at in range(depth, len(frame), BLOCK):
        stop = min(at + BLOCK, len(frame))
        keys = np.zeros(stop - at, U64)
        for back in range(1, depth + 1):
            keys = (keys << U64(8)) | frame[at - back : stop - back]
        keys = (keys << U64(8)) | frame[at:stop]
        place = np.arange(at, stop)
        text = np.searchsorted(first, place, "right") - 1
        real = place <= (first + sizes)[text]
        yield keys[real], text[real]


def words_of(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of every lower-cased word; a long text is cut at separators into blocks."""
    cuts = [0, len(data)]
    if len(ends) == 2 and len(data) > BLOCK:
        gaps = np.flatnonzero(textscan.SPACE_WORDS[data])
        at = gaps[np.minimum(np.searchsorted(gaps, np.arange(BLOCK, len(data), BLOCK)), len(gaps) - 1)] if len(gaps) else []
        cuts = sorted({0, len(data), *(int(c) for c in at)})
    for a, b in zip(cuts, cuts[1:]):
        words = textscan.scan_words(textscan.LOWER[data[a:b]], ends if len(cuts) == 2 else np.array([0, b - a]))
        yield words.hash, words.doc


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


class _Distinct:
    """Distinct keys with the sum of their counts; merged whenever enough have come together."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, weight: np.ndarray | None) -> None:
        if weight is None:
            found, counts = np.unique(keys, return_counts=True)
        else:
            found, where = np.unique(keys, return_inverse=True)
            counts = np.bincount(where, weight, len(found))
        self.keys.append(found)
        self.counts.append(counts)
        self.held += len(found)
        if self.held > 4 * BLOCK:
            keys, counts = self.result()
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.keys, self.counts)


# --- the steps ----------------------------------------------------------------------


def _chunked(docs: DataFrame, text: Column, train: Column, carry: list[str]) -> DataFrame:
    """Rows (chunk, train, text, carried), kept: a chunk is a stretch of a task's rows."""
    carried = F.struct(*carry) if carry else F.struct(F.lit(1).alias("none"))
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"), carried.alias("carried"))

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = size + np.cumsum(lengths) - lengths
            size += int(lengths.sum())
            chunks = chunk + before // CHUNK_BYTES
            yield pa.RecordBatch.from_arrays([pa.array(chunks), *batch.columns], ["chunk", *batch.schema.names])

    shape = f"chunk bigint, text string, train boolean, carried {rows.schema['carried'].dataType.simpleString()}"
    return keep(rows.mapInArrow(ship(compute), shape), "context-chunks")


def _asked(chunks: DataFrame, depth: int) -> DataFrame:
    """(chunk, word, key, n): each distinct key of a chunk, with its count in training texts."""

    def rows(chunk: int, parts: tuple[_Distinct, _Distinct]) -> Iterator[pa.RecordBatch]:
        for word, part in enumerate(parts):
            keys, counts = part.result()
            columns = [pa.array(np.full(len(keys), chunk)), pa.array(np.full(len(keys), bool(word))), pa.array(keys.view(np.int64)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "word", "key", "n"])

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, (_Distinct(), _Distinct())
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and numbers[a] != now:
                    yield from rows(now, parts)
                    parts = (_Distinct(), _Distinct())
                now = int(numbers[a])
                learns = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                for row, n, data, ends in textscan.pieces(batch.column(1).slice(a, b - a)):
                    own = learns[row : row + n]
                    weight = lambda text, own=own: None if own.all() else own[text].astype(np.float64)
                    for keys, text in units_of(data, ends, depth):
                        parts[0].add(keys, weight(text))
                    for words, text in words_of(data, ends):
                        parts[1].add(words, weight(text))
        if now is not None:
            yield from rows(now, parts)

    return keep(chunks.select("chunk", "text", "train").mapInArrow(ship(compute), "chunk bigint, word boolean, key bigint, n bigint"), "context-asked")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: raised above 12 by its recurrence, then Stirling's series."""
    steps = np.maximum(12 - np.floor(x), 0)
    product = np.ones_like(x)
    for j in range(12):
        product *= np.where(j < steps, x + j, 1.0)
    y = x + steps
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _log_weighted(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    return _LOG_HALF + np.logaddexp(kt, below)


def _grouped(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the other arrays over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums))


class Range:
    """A stretch of sorted units, its contexts at every depth and their sums.

    A place is a context of some depth and a node of the byte's binary tree, packed as
    context << 8 | node with the nearest byte foremost. ``opened`` maps (depth, place) to (zeros, ones, below)
    where a border may cut the context; ``below`` is the sum of log weighted probabilities over longer contexts.
    """

    def __init__(self, units: np.ndarray, counts: np.ndarray, depth: int, opened: tuple[np.ndarray, ...] | None = None):
        self.units, self.depth, self.levels = units, depth, [None] * (depth + 1)
        sym = units & U64(255)
        self.bits = [((sym >> U64(7 - j)) & U64(1)).astype(np.int64) for j in range(8)]
        self.nodes = [(U64(1) << U64(j)) | (sym >> U64(8 - j)) for j in range(8)]
        context = units >> U64(8)
        seen = counts > 0
        places = np.concatenate([(context[seen] << U64(8)) | node[seen] for node in self.nodes])
        ones = np.concatenate([np.where(bit[seen] == 1, counts[seen], 0) for bit in self.bits])
        both = np.tile(counts[seen], 8)
        keys, ones, both = _grouped(places, ones, both)
        below = np.zeros(len(keys))
        for d in range(depth, -1, -1):
            zeros = both - ones
            open_here = self._is_open(keys, d)
            if opened is not None:
                keys, zeros, ones, below = self._with_opened(keys, zeros, ones, below, open_here, d, opened)
                open_here = self._is_open(keys, d)
                both = zeros + ones
            kt = log_kt(zeros.astype(float), ones.astype(float))
            weighted = _log_weighted(kt, below) if d < depth else kt
            self.levels[d] = (keys, zeros, ones, below, weighted, kt, open_here)
            if d:
                # What open contexts pass on is added where all ranges meet.
                up = ((keys >> U64(16)) << U64(8)) | (keys & U64(255))
                keys, ones, both, below = _grouped(up, ones, both, np.where(open_here, 0.0, weighted))

    def _prefix(self, unit: int, d: int) -> int:
        return int(unit) >> (8 * (self.depth - d + 1))

    def _is_open(self, keys: np.ndarray, d: int) -> np.ndarray:
        if not len(self.units):
            return np.zeros(len(keys), bool)
        at_edge = [U64(self._prefix(self.units[n], d)) for n in (0, -1)]
        context = keys >> U64(8)
        return (context == at_edge[0]) | (context == at_edge[1])

    def _with_opened(self, keys, zeros, ones, below, open_here, d, opened):
        """The level with its open contexts as all ranges together know them."""
        at, place, o_zeros, o_ones, o_below = opened
        mine = (at == d) & self._is_open(place, d)
        keys = np.concatenate([keys[~open_here], place[mine]])
        order = np.argsort(keys, kind="stable")
        parts = ((zeros, o_zeros), (ones, o_ones), (below, o_below))
        return keys[order], *(np.concatenate([own[~open_here], theirs[mine]])[order] for own, theirs in parts)

    def open_rows(self) -> tuple[np.ndarray, ...]:
        """(depth, place, zeros, ones, below) of the open contexts, as far as this range knows."""
        parts = []
        for d, (keys, zeros, ones, below, _, _, open_here) in enumerate(self.levels):
            parts.append((np.full(int(open_here.sum()), d), keys[open_here], zeros[open_here], ones[open_here], below[open_here]))
        return tuple(np.concatenate(column) for column in zip(*parts))

    def log_probabilities(self) -> np.ndarray:
        """The natural log of the mixed probability of each unit's byte."""
        total = np.zeros(len(self.units))
        for bit, node in zip(self.bits, self.nodes):
            p = np.full(len(self.units), 0.5)
            for d in range(self.depth, -1, -1):
                keys, zeros, ones, _, weighted, kt, _ = self.levels[d]
                place = ((self.units >> U64(8 * (self.depth - d + 1))) << U64(8)) | node
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, place), len(keys) - 1)
                known = keys[at] == place
                n_bit = np.where(bit == 1, ones[at], zeros[at])
                own = (n_bit + 0.5) / (zeros[at] + ones[at] + 1.0)
                share = np.exp(_LOG_HALF + kt[at] - weighted[at]) if d < self.depth else np.ones(len(at))
                p = np.where(known, share * own + (1 - share) * p, p)
            total += np.log(p)
        return total


def solve_open(rows: tuple[np.ndarray, ...], depth: int) -> tuple[np.ndarray, ...]:
    """Open contexts of all ranges: sums over ranges, then ``below`` from the deepest up."""
    at, place, zeros, ones, below = rows
    out, passed = [], (np.zeros(0, U64), np.zeros(0))
    for d in range(depth, -1, -1):
        mine = at == d
        none = np.zeros(len(passed[0]), np.int64)
        keys, z, o, b = _grouped(
            np.concatenate([place[mine], passed[0]]),
            np.concatenate([zeros[mine], none]),
            np.concatenate([ones[mine], none]),
            np.concatenate([below[mine], passed[1]]),
        )
        out.append((np.full(len(keys), d), keys, z, o, b))
        kt = log_kt(z.astype(float), o.astype(float))
        passed = ((((keys >> U64(16)) << U64(8)) | (keys & U64(255))), _log_weighted(kt, b) if d < depth else kt)
    return tuple(np.concatenate(column) for column in zip(*out))


def _sorted_range(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("key").to_numpy().view(U64)
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order]


def _unit_values(units: DataFrame, depth: int) -> DataFrame:
    """(key, value): the natural log probability of every unit."""
    ranges = max(1, math.ceil(units.count() / RANGE_UNITS))
    cut = keep(units.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "context-ranges")
    by_range = cut.groupBy("range")

    def report(table: pa.Table) -> pa.Table:
        at, place, zeros, ones, below = Range(*_sorted_range(table), depth).open_rows()
        return pa.table({"at": pa.array(at.astype(np.int32)), "place": pa.array(place.view(np.int64)), "zeros": pa.array(zeros.astype(np.int64)), "ones": pa.array(ones.astype(np.int64)), "below": pa.array(below)})

    found = by_range.applyInArrow(ship_whole(report), "at int, place bigint, zeros bigint, ones bigint, below double").toArrow()
    columns = [found.column(name).to_numpy() for name in ("at", "place", "zeros", "ones", "below")]
    columns[1] = columns[1].view(U64)
    opened = solve_open(tuple(columns), depth)

    def value(table: pa.Table) -> pa.Table:
        keys, counts = _sorted_range(table)
        return pa.table({"key": pa.array(keys.view(np.int64)), "value": pa.array(Range(keys, counts, depth, opened).log_probabilities())})

    return by_range.applyInArrow(ship_whole(value), "key bigint, value double")


def score(
    docs: DataFrame,
    *,
    train: Column,
    text_col: str = "text",
    carry: list[str],
    depth: int = DEPTH,
) -> DataFrame:
    """``carry``, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text.

    ``train`` says which rows are learned from (null counts as true). ``score`` is the log10 probability of the whole text.
    """
    if not 1 <= depth <= 7:
        raise ValueError("a unit of 1 to 7 context bytes fits one integer")
    chunks = _chunked(docs, F.col(text_col), train, carry)
    asked = _asked(chunks, depth)
    counts = keep(asked.groupBy("word", "key").agg(F.sum("n").alias("n")), "context-counts")
    known = counts.where("word and n > 0").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("tokens")).first()
    texts = chunks.where("train").count()
    n_train, n_kinds = (known["tokens"] or 0) + texts, known["kinds"] + (1 if texts else 0)

    by_unit = _unit_values(counts.where("not word").select("key", "n"), depth).select(F.lit(False).alias("word"), "key", "value")
    by_word = counts.where("word").select("word", "key", F.col("n").cast("double").alias("value"))
    answers = asked.select("chunk", "word", "key").join(by_unit.unionByName(by_word), ["word", "key"])
    floor = math.log10(n_train + 0.1 * (n_kinds + 1))
    of_end = math.log10(texts + 0.1) - floor

    def compute(table: pa.Table, answer: pa.Table) -> pa.Table:
        is_word = answer.column("word").to_numpy(zero_copy_only=False).astype(bool)
        keys, values = answer.column("key").to_numpy().view(U64), answer.column("value").to_numpy()
        sides = []
        for side in (~is_word, is_word):
            order = np.argsort(keys[side])
            sides.append((keys[side][order], values[side][order]))
        (units, logs), (words, seen) = sides
        n = table.num_rows
        nats, base, n_tokens, n_known, n_bytes = np.zeros(n), np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for row, n_rows, data, ends in textscan.pieces(table.column("text")):
            own = slice(row, row + n_rows)
            n_bytes[own] = np.diff(ends)
            for found, text in units_of(data, ends, depth):
                nats[own] += np.bincount(text, logs[np.searchsorted(units, found)], n_rows)
            for found, text in words_of(data, ends):
                count = seen[np.searchsorted(words, found)]
                base[own] += np.bincount(text, np.log10(count + 0.1) - floor, n_rows)
                n_tokens[own] += np.bincount(text, minlength=n_rows)
                n_known[own] += np.bincount(text, count > 0, n_rows).astype(np.int64)
        columns = {
            "carried": table.column("carried"),
            "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(n_known + (1 if texts else 0)),
            "train_tokens": pa.array(np.full(n, n_train, np.int64)),
            "base_score": pa.array(base + of_end),
            "score": pa.array(nats / math.log(10)),
            "bits_per_byte": pa.array(-nats / math.log(2) / (n_bytes + 1)),
        }
        return pa.table(columns)

    sides = chunks.select("chunk", "text", "carried").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    shape = f"carried {chunks.schema['carried'].dataType.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    scored = sides.applyInArrow(ship_whole(compute), shape)
    return scored.select(*[F.col(f"carried.`{c}`").alias(c) for c in carry], *scored.columns[1:])
