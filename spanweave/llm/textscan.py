"""Vectorised scanning of the words of many texts at once, inside Python tasks.

A batch of texts stays one byte buffer with offsets (Arrow's own layout). Words, lines and
their 64-bit hashes come from prefix sums over that buffer, so that no Python loop runs over
words. Hash of bytes b at positions i..j: sum of T[b] * B**i modulo 2**64, shifted to position
zero and mixed; T is a fixed random table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 2**64)
_STEPS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}

SPACE_WORDS = np.zeros(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are scanned in pieces of about this many bytes.
PIECE_BYTES = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(n: int, inverse: bool) -> np.ndarray:
    name = "inverse" if inverse else "forward"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = np.full(max(n, PIECE_BYTES + 1), _B_INV if inverse else _B, dtype=np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= PIECE_BYTES + 1:
            _powers[name] = have
    return have


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(ends, ends[row] + PIECE_BYTES, "right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, last - row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


class Hasher:
    """Hashes of any stretches of one byte buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power(len(data), False)[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _power(len(self.sums), True)[start]
        return mix(h + (end - start).astype(np.uint64) * U64(0x632BE59BD9B4E019))


@dataclass
class Words:
    """Words of a piece, in order; ``first[d]:first[d + 1]`` are those of text ``d``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def scan_words(data: np.ndarray, ends: np.ndarray, separators: np.ndarray = SPACE_WORDS, hasher: Hasher | None = None) -> Words:
    """The maximal runs of bytes that are no separators; none crosses texts."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = (hasher or Hasher(data)).of(start, end)
    return Words(start, end, np.searchsorted(start, ends), hashes)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``k`` words within a text, at the index of its first word."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words.hash[j : n - k + 1 + j] * _STEPS[j]
    doc = words.doc
    whole = doc[: n - k + 1] == doc[k - 1 :]
    total = mix(total)
    return np.where(whole, total, U64(0)), np.where(whole, doc[: n - k + 1], -1)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles per text as (hashes sorted within texts, offsets by text).

    A text of fewer than ``k`` words but at least one has one shingle: its whole sequence.
    """
    n_docs = len(words.first) - 1
    hashes, doc = windows(words, k)
    keep = doc >= 0
    hashes, doc = hashes[keep], doc[keep]
    counts = np.diff(words.first)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hash[words.first[d] : words.first[d + 1]]
        seed = np.array([len(own)], np.uint64) * _STEPS[15]
        hashes = np.append(hashes, mix(seed + (own * _STEPS[: len(own)]).sum(dtype=np.uint64)))
        doc = np.append(doc, d)
    order = np.lexsort((hashes, doc)) if len(doc) and (np.diff(doc) < 0).any() else None
    if order is None:
        out = np.argsort(hashes)
        order = out[np.argsort(doc[out], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(n_docs + 1))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member of a key found twice or more, not the first of its key), by position."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[ends])
