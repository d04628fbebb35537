"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens the
parts of a turn in order: texts are escaped, other parts become a placeholder that counts
as many tokens as the part expands to, and their references are recorded. The formatted
conversation is

    <|begin|>  then for each turn  <|turn|>role<|body|>content<|end|>

Control strings (``CONTROLS``: the template's own and other templates' usual ones) inside texts and
roles get a backslash after their first character and backslashes are doubled, so no text can
write a control string, and reading back gives the text itself.

Conversations are dealt by id and walked turn by turn in the order of turn, role and text; only one turn
at a time is in memory, whatever the length of a conversation.

Defined cases: a null text is the empty text, a null role the empty role; a null turn comes
first; turns of equal number stay in the order of role and text; repeated rows are turns of their
own; rows without a conversation id form one conversation; an empty table gives no rows;
further columns are ignored. In parts: null elements and null lists add nothing; a null type is text; sizes that are
null, negative, not a number or infinite count as 0 tokens; an unknown type is an error that names it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import ship

BEGIN, TURN, BODY, END = "<|begin|>", "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Template strings that texts must not be able to write; fixed values.
CONTROLS = [BEGIN, TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: Tokens of a part: pixels by square patches, sound by second, documents by page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattened:
    """What a visitor makes of one turn: text, references (type, ref, place, tokens) and expanded tokens."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0


def _size(value: float | None) -> float:
    return value if value is not None and math.isfinite(value) and value > 0 else 0


class PartVisitor:
    """Visits parts in order; each type has its own method, an unknown one is an error."""

    def __init__(self) -> None:
        self.out = Flattened()
        self._chars = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown content part: {kind!r}")
        handler(part)

    def _add(self, piece: str) -> None:
        self.out.pieces.append(piece)
        self._chars += len(piece)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def _attach(self, part: dict, tokens: int) -> None:
        kind = part["type"]
        self.out.attachments.append({"type": kind, "ref": part.get("ref") or "", "place": self._chars, "tokens": tokens})
        self.out.tokens += tokens
        self._add(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil(_size(part.get("width")) / PATCH) * math.ceil(_size(part.get("height")) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil(_size(part.get("seconds")) * PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach(part, _size(part.get("pages")) * PER_PAGE)


def flatten(parts: list[dict | None]) -> Flattened:
    visitor = PartVisitor()
    for part in parts:
        if part is not None:
            visitor.visit(part)
    return visitor.out


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, content) of one formatted turn; the content is unescaped and keeps its placeholders."""
    if not (formatted.startswith(TURN) and formatted.endswith(END)):
        raise ValueError("not a turn")
    role, found, body = formatted[len(TURN) : -len(END)].partition(BODY)
    if not found or any(c in part for c in (TURN, BODY, END) for part in (role, body)):
        raise ValueError("not a turn")
    return unescape(role), unescape(body)


def format_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None,
                 learned_role: str = "assistant") -> DataFrame:
    """One row per turn, in order: formatted, place in the conversation's output, loss range, attachments, tokens.

    The content is ``parts_col`` (of type ``PARTS``) or else the one text of ``text_col``. The loss range
    (from, to) is in characters of the conversation's output; it is null for other roles.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    content = F.col(parts_col).cast(PARTS) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("parts"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "parts")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, nth, begun = None, 0, 0, False
        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("nth", "place", "formatted", "loss_from", "loss_to", "attachments", "tokens")}
            for conv, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "parts"))):
                first = not begun or conv != last
                if first:
                    last, at, nth, begun = conv, 0, 0, True
                flat = flatten(parts or [])
                head = (BEGIN if first else "") + TURN + escape(role) + BODY
                body = "".join(flat.pieces)
                learned = role == learned_role
                made["nth"].append(nth)
                made["place"].append(at)
                made["formatted"].append(head + body + END)
                made["loss_from"].append(at + len(head) if learned else None)
                made["loss_to"].append(at + len(head) + len(body) if learned else None)
                made["attachments"].append(flat.attachments)
                made["tokens"].append(flat.tokens)
                at += len(head) + len(body) + len(END)
                nth += 1
            attached = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), attached, pa.int64()]
            columns = [batch.column("conv"), *(pa.array(v, t) for v, t in zip(made.values(), kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", *made])

    shape = f"conv {kind}, nth bigint, place bigint, formatted string, loss_from bigint, loss_to bigint, attachments array<struct<type:string,ref:string,place:bigint,tokens:bigint>>, tokens bigint"
    return rows.mapInArrow(ship(walk), shape)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_turns``."""
    kind = formatted.schema["conv"].dataType.simpleString()
    rows = formatted.select("conv", "nth", "place", "formatted", "loss_from", "loss_to").repartition("conv").sortWithinPartitions("conv", "nth")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def row(some: list[list]) -> pa.RecordBatch:
            done = [[h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5]] for h in some]
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in enumerate(kinds)], names)

        conv_type = None
        for batch in batches:
            conv_type, done = batch.column("conv").type, []
            for conv, nth, place, text, loss_from, loss_to in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or nth == 0:
                    if held is not None:
                        done.append(held)
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if nth == 0 and not text.startswith(BEGIN):
                    raise ValueError("not a conversation")
                role, content = read_turn(text[len(BEGIN) :] if nth == 0 else text)
                held[1] += 1
                held[2].update(f"{role}\n{content}\n".encode())
                if loss_from is not None:
                    learned = unescape(text[loss_from - place : loss_to - place])
                    held[3] += len(learned)
                    held[4].update(learned.encode())
                held[5] += len(text)
            if done:
                yield row(done)
        if held is not None:
            yield row([held])

    shape = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(ship(read), shape)
