"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over buffers that never change: the
text as it came and the sentinels. Cutting splits descriptors, an arrangement
permutes them, its inverse permutation restores the text, and digests stream the descriptors; parts are
joined only for the output column. Each batch of rows is worked on apart, so the
transformation neither shuffles nor depends on how rows fall into tasks.

Units are lines (``[^\\n]*\\n|[^\\n]+``). The cuts and the form come from the first four 8-digit groups of the hex
sha256 of ``seed:id``: the prefix ends after the smaller of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after
the larger; ``h3 % 100 < rate`` takes part, ``h4 % 100 < spm_rate`` puts the suffix first.

Defined cases: a null text is empty; an empty text, or one that contains a sentinel, stays plain; a null
id counts as an empty one (``seed:``); rows are independent, so repeated rows give repeated results; an empty table
gives no rows; a text of any length is one row, cut without copying; columns that are not named
in ``carry`` are not read, so their names cannot clash. Restoring a plain or null output gives it back (null: empty).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanweave.llm.tables import ship

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A result batch is handed on once it holds so many bytes.
BATCH_BYTES = 16_000_000

TEXT, MARKS = 0, 1
# A cut document in reading order: a sentinel and its part, three times.
_PREFIX, _MIDDLE, _SUFFIX = (0, 1), (2, 3), (4, 5)
ORDERS = {PSM: (*_PREFIX, *_SUFFIX, *_MIDDLE), SPM: (*_SUFFIX, *_PREFIX, *_MIDDLE)}

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, length) over immutable buffers."""

    buffers: tuple[memoryview, ...]
    pieces: tuple[Piece, ...]

    def split(self, piece: int, at: int) -> PieceTable:
        """Descriptor ``piece`` as two, the first ``at`` bytes long (either may be empty)."""
        buffer, start, length = self.pieces[piece]
        halves = ((buffer, start, at), (buffer, start + at, length - at))
        return PieceTable(self.buffers, (*self.pieces[:piece], *halves, *self.pieces[piece + 1 :]))

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[n] for n in order))

    def restored(self, order: Sequence[int]) -> PieceTable:
        """The table that ``arranged(order)`` was made from."""
        return self.arranged(np.argsort(order).tolist())

    def of_buffer(self, buffer: int) -> PieceTable:
        return PieceTable(self.buffers, tuple(p for p in self.pieces if p[0] == buffer))

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def content(self) -> bytes:
        return b"".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


@dataclass(frozen=True)
class Marks:
    """The sentinel buffer and where each sentinel lies in it."""

    names: tuple[str, str, str] = SENTINELS

    def __post_init__(self):
        firsts = {name[:1] for name in self.names}
        if len(set(self.names)) < 3 or not all(self.names) or any(c in firsts for name in self.names for c in name[1:]):
            # Otherwise a sentinel could arise where a text and a sentinel meet.
            raise ValueError("sentinels must differ, and their first characters may occur nowhere else in them")

    @property
    def encoded(self) -> list[bytes]:
        return [name.encode() for name in self.names]

    def cut(self, text: memoryview, first: int, second: int) -> PieceTable:
        """``text`` cut at two byte positions, each part after its sentinel, in reading order."""
        prefix, suffix, middle = self.encoded
        whole = PieceTable((text, memoryview(prefix + suffix + middle)), ((TEXT, 0, len(text)),))
        parts = whole.split(0, first).split(1, second - first).pieces
        p, s, m = (MARKS, 0, len(prefix)), (MARKS, len(prefix), len(suffix)), (MARKS, len(prefix + suffix), len(middle))
        return PieceTable(whole.buffers, (p, parts[0], m, parts[1], s, parts[2]))

    def parse(self, output: bytes, form: str) -> PieceTable:
        """An arranged output as descriptors over itself, sentinels in the sentinel buffer."""
        prefix, suffix, middle = self.encoded
        listed = (prefix, suffix, middle) if form == PSM else (suffix, prefix, middle)
        at = [output.index(mark) for mark in listed]
        ends = [*at[1:], len(output)]
        pieces: list[Piece] = []
        for mark, begin, end in zip(listed, at, ends):
            pieces += [(MARKS, 0, len(mark)), (TEXT, begin + len(mark), end - begin - len(mark))]
        return PieceTable((memoryview(output), memoryview(b"")), tuple(pieces))


def draws(seed: int, key: object) -> tuple[int, ...]:
    """The first four 8-digit groups of the hex sha256 of ``seed:key``."""
    hexed = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(hexed[n : n + 8], 16) for n in range(0, 32, 8))


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _buffers(column: pa.Array) -> tuple[np.ndarray, memoryview, np.ndarray]:
    """A string column's bytes (twice) and offsets; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    view = memoryview(held) if held is not None else memoryview(b"")
    return np.frombuffer(view, np.uint8), view, ends


def _batches(rows: Iterable[tuple[list, int]], n_columns: int, kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [[] for _ in range(n_columns)], 0
    for row, n_bytes in rows:
        for column, value in zip(held, row):
            column.append(value)
        size += n_bytes + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names)
            held, size = [[] for _ in range(n_columns)], 0
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names)


def _arrow_kinds(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in schema.fields]


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """Columns id, n (units), form, prefix_chars, middle_chars, output and output_sha256 of each row."""
    marks = Marks(sentinels)
    schema = StructType(
        [StructField("id", docs.schema[id_col].dataType)]
        + [StructField(n, t) for n, t in (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType()), ("output_sha256", StringType()))]
    )

    def one(key: object, text: memoryview, data: np.ndarray, breaks: np.ndarray) -> list:
        n = len(breaks) + int(len(data) > 0 and data[-1] != 10)
        h1, h2, h3, h4 = draws(seed, key)
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        raw = bytes(text) if len(data) else b""
        if not raw or h3 % 100 >= rate or any(mark in raw for mark in marks.encoded):
            table = PieceTable((memoryview(raw),), ((TEXT, 0, len(raw)),))
            return [key, n, PLAIN, None, None, raw.decode(), table.sha256()]
        first, second = (0 if c == 0 else len(data) if c > len(breaks) else int(breaks[c - 1]) + 1 for c in cuts)
        form = SPM if h4 % 100 < spm_rate else PSM
        table = marks.cut(text, first, second).arranged(ORDERS[form])
        return [key, n, form, _code_points(data[:first]), _code_points(data[first:second]), table.content().decode(), table.sha256()]

    def rows(batches):
        for batch in batches:
            data, view, ends = _buffers(batch.column(1))
            breaks = np.flatnonzero(data[ends[0] : ends[-1]] == 10) + ends[0]
            within = np.searchsorted(breaks, ends)
            for n, key in enumerate(batch.column(0).to_pylist()):
                a, b = int(ends[n]), int(ends[n + 1])
                yield one(key, view[a:b], data[a:b], breaks[within[n] : within[n + 1]] - a), b - a

    kinds, names = _arrow_kinds(schema), schema.names

    def compute(batches):
        yield from _batches(rows(batches), len(names), kinds, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(ship(compute), schema)


def restore(made: DataFrame, *, carry: Sequence[str] = ("id",), sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The texts behind the columns ``output`` and ``form``: ``carry``, restored and restored_sha256.

    Each output is parsed into descriptors over itself and put back by the inverse permutation of its form.
    """
    marks = Marks(sentinels)
    schema = StructType([*(made.schema[c] for c in carry), StructField("restored", StringType()), StructField("restored_sha256", StringType())])
    kinds, names = _arrow_kinds(schema), schema.names

    def rows(batches):
        for batch in batches:
            for form, output, *kept in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (output or "").encode()
                if form in ORDERS:
                    table = marks.parse(raw, form).restored(ORDERS[form]).of_buffer(TEXT)
                else:
                    table = PieceTable((memoryview(raw),), ((TEXT, 0, len(raw)),))
                yield [*kept, table.content().decode(), table.sha256()], len(raw)

    def compute(batches):
        yield from _batches(rows(batches), len(names), kinds, names)

    return made.select("form", "output", *carry).mapInArrow(ship(compute), schema)
