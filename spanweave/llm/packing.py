"""Packing documents by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary parts of n: as many
pieces of ``longest`` tokens as fit, then one piece for each set bit of the rest, longest
first. Pieces of equal length form a bucket, each piece is a sequence of its own, so a batch
taken from one bucket has no padding and no sequence crosses documents.

Defined cases: a null or empty text has the end token only (one piece of length 1); repeated
rows are packed once for each row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import keep, numbered, ship
from spanweave.llm.textscan import SPACE_WORDS, Hasher
from spanweave.llm.textscan import pieces as text_pieces

LONGEST = 2048
END_ID = 1
#: Distinct chunks a task remembers; a memory bound, not a limit of the input.
REMEMBERED = 700_000
_in_process: dict[str, ChunkTokenizer] = {}


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of chunks: the texts, and white space after what is surely no white space."""
    white = SPACE_WORDS[data]
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = white[1:] & ~white[:-1]
    # White space outside ASCII ends in these bytes; a cut left out changes no id.
    if len(data) > 3:
        two, three = data[:-2], data[:-3]
        start[2:-1] &= ~((two == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
        start[3:-1] &= ~((three >= 0xE1) & (three <= 0xE3) & np.isin(data[1:-2], (0x9A, 0x80, 0x81)))
    start[ends] = True
    return np.flatnonzero(start[:-1])


class ChunkTokenizer:
    """Whole-text ids, by encoding each distinct chunk of the texts once.

    The byte-level pattern joins white space only to what follows it, so a text may be cut
    before any white space that follows something else. ``ranks`` is the vocabulary file in
    the form that the fast encoder reads; ``tests/llm`` compares with the ``tokenizers`` file.
    Texts are split at the strings in ``added``, which have ids of their own; without any, such
    strings are ordinary text.
    """

    def __init__(self, ranks: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self._encode = encoding.encode_ordinary
        self._known: dict[int, bytes] = {}
        self._added = {t.encode(): i for t, i in (added or {}).items()}
        self._find = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None

    def _split(self, raw: bytes, ends: np.ndarray) -> list[int]:
        """Both ends of every added token that stands within one text."""
        if self._find is None or not self._find.search(raw):
            return []
        bounds = ends.tolist()
        return [at for low, high in zip(bounds, bounds[1:]) for m in self._find.finditer(raw, low, high) for at in m.span()]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a piece, offsets of the texts among them)."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        if len(self._known) > REMEMBERED:
            self._known.clear()
        raw = data.tobytes()
        start = _cuts(data, ends)
        if split := self._split(raw, ends):
            start = np.union1d(start, split)
            start = start[start < len(data)]
        end = np.append(start[1:], len(data))
        hashes, at, which = np.unique(Hasher(data).of(start, end), return_index=True, return_inverse=True)
        known, parts = self._known, []
        for h, s, e in zip(hashes.tolist(), start[at].tolist(), end[at].tolist()):
            part = known.get(h)
            if part is None:
                own = self._added.get(raw[s:e])
                part = known[h] = array("I", [own] if own is not None else self._encode(raw[s:e].decode())).tobytes()
            parts.append(part)
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        firsts = (np.cumsum(sizes) - sizes)[which]
        counts = sizes[which]
        upto = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        ids = flat[np.repeat(firsts - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, ends)]


def added_tokens(ranks: str) -> dict[str, int]:
    """The added tokens of the ``tokenizers`` file beside the vocabulary file ``ranks``."""
    listed = json.loads(Path(ranks).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
    if any(t[flag] for t in listed for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token takes more than its own string")
    return {t["content"]: t["id"] for t in listed}


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of a document of ``n`` tokens."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens and, if asked, ``ids``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _in_process:
            _in_process[ranks] = ChunkTokenizer(ranks, added_tokens(ranks))
        tok = _in_process[ranks]
        for batch in batches:
            keys = batch.column(0)
            for first, n_texts, data, ends in text_pieces(batch.column(1)):
                rows, start, length, crc, total, ids = [], [], [], [], [], []
                flat, at_text = tok.encode(data, ends)
                for n in range(n_texts):
                    own = np.append(flat[at_text[n] : at_text[n + 1]], np.uint32(END_ID)).astype("<u4")
                    at, raw = 0, memoryview(own).cast("B")
                    for size in binary_lengths(len(own), longest):
                        rows.append(first + n)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        total.append(len(own))
                        at += size
                    if with_ids:
                        ids.append(own.view("<i4"))
                columns = [keys.take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    # The pieces of a text follow each other, so its ids are theirs in order.
                    upto = np.append(0, np.cumsum(length)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(id_col, text_col).mapInArrow(ship(cut), schema + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """Pieces with ``sequence_id`` (consecutive within a bucket, long buckets first) and ``offset`` 0."""
    made = pieces(docs, ranks, id_col, text_col, longest, with_ids)
    order = [F.desc("length"), F.asc("doc_id"), F.asc("start"), F.asc("ids_crc32")]
    if with_ids:
        # Texts are encoded once, and only rows without ids are sorted; the ids come back by row.
        made = keep(made.withColumn("_row", F.monotonically_increasing_id()), "pieces")
        places = numbered(made.drop("ids"), order, "sequence_id", "packing").select("_row", "sequence_id")
        packed = made.join(places, "_row").drop("_row")
    else:
        packed = numbered(made, order, "sequence_id", "packing")
    return packed.withColumn("offset", F.lit(0).cast("long"))


def digests(packed: DataFrame) -> DataFrame:
    """Rows of ``pack`` with the checksum of their ids, taken from the rows as they are, in place of the ids."""
    others = [c for c in packed.columns if c not in ("ids", "ids_crc32")]

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(others))
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            ends = ids.offsets.to_pylist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(crc, pa.int64())], [*others, "ids_crc32"])

    kinds = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in others)
    return packed.select(*others, "ids").mapInArrow(ship(check), f"{kinds}, ids_crc32 bigint").select(*(c for c in packed.columns if c != "ids"))
