"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nyström landmarks.

Kernel: a stretch of a sentence is described by all its subsequences of three symbols that lie
within ``SPAN`` characters, each weighted by ``DECAY`` to the power of the characters it skips;
stretches are compared by the product of these weights over the roots of their sums of
squares. Letters put in, left out or replaced, and spaces put between letters, change only some of
the subsequences. The features of a stretch are its kernel values with the landmarks, whitened by the
landmarks' own kernel matrix (Nyström); a linear machine with squared hinge loss is trained on them. As
the kernel is a product of weights, the trained machine is one weight per symbol triple, and
scoring needs no comparison with the landmarks.

Sentences end at a line break or at ``.!?`` before white space. Their symbols are lower-case
letters, a word border (any white space) and a gap (digits); marks are left out. Runs of single letters
set apart by spaces stand once more as one word, a sentence of its own. A sentence's
decision is the largest among its stretches of ``STRETCH`` symbols, over word borders (triples that begin in
the last five symbols belong to later stretches); a shorter sentence is one stretch.

Training: labels mark documents, so sentences are labelled in rounds (multiple instances). Each
toxic document puts forward the ``BAG`` sentences with the largest decisions as positive, each with the stretch
that decides it; sentences of clean documents are negative, the hardest first. The first round takes, in
place of decisions, how much oftener toxic documents hold a run of a sentence's letters. The landmarks of a round are
deciding stretches of both sides. Copies of positive stretches with a letter, gap or space put in or changed are positive, too. The sample is bounded: at most ``SAMPLE`` toxic and ``SAMPLE_CLEAN``
other labelled rows in the order of a hash, and ``SAMPLE_CHARS`` characters of a row, from four places of longer texts.

Scoring: all sentences of a whole text. The ``POOL`` largest decisions of a document are turned into a
probability by logistic regression.

Defined cases: null, empty and wordless texts get the score of a text without any insult;
repeated rows score alike; an empty table gives no rows; without labels of both classes every
score is 0; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.tables import ship
from spanweave.llm.textscan import U64, mix

SPAN = 6
DECAY = 0.6
STRETCH = 14
BAG = 12
LEVELS = (0.98, 0.998)
POOL = 3
LANDMARKS = 800
SAMPLE = 1500
SAMPLE_CLEAN = 3000
NEGATIVES = 6000
COST = 2.0
DISTURBED = 3000
FIRST_RUNS = (5, 6, 7)
CELLS = 22
ROWS = 1000
ROUNDS = 6
SAMPLE_CHARS = 20_000
#: Texts are worked on in lots of about this many characters; a longer one is cut at a line break, or at a space.
CHARS_AT_ONCE = 250_000
_SPACED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
_GAPS = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]
_BORDER = 27
#: What each code point below 0x3000 is; all beyond are letters. 255 is left out, 254 ends a line, 253 a sentence.
_KIND = np.array([29 + c % 35 if chr(c).isalnum() else _BORDER if chr(c).isspace() else 255 for c in range(0x3000)], np.uint8)
_KIND[ord("a") : ord("z") + 1] = np.arange(1, 27)
_KIND[ord("0") : ord("9") + 1] = 0
_KIND[ord("\n")] = 254
_KIND[[ord(c) for c in ".!?"]] = 253


@dataclass
class Sentences:
    """Symbols of many sentences, ``SPAN`` gaps apart; ``doc`` names each one's text."""

    symbols: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def sentences(texts: list[str | None]) -> Sentences:
    low = [(t or "").lower() for t in texts]
    low = ["\n".join([t, *(run.replace(" ", "") for run in _SPACED.findall(t))]) for t in low]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
    kind = np.where(codes < 0x3000, _KIND[np.minimum(codes, 0x2FFF)], 29 + codes % 35).astype(np.uint8)
    space = (kind == _BORDER) | (kind == 254)
    stop = kind == 253
    # Of several marks in a row the last one decides.
    ends_here = (kind == 254) | (stop & np.append(space[1:], True))
    kind[stop] = 255
    kind[ends_here] = 254
    at = np.flatnonzero(kind != 255)
    kind = kind[at]
    border = (kind == _BORDER) | (kind == 254)
    # A run of borders is one; it ends a sentence if any of them does.
    begin = border & ~np.append(False, border[:-1])
    run = np.cumsum(begin) - 1
    breaks = np.zeros(int(begin.sum()), bool)
    breaks[run[kind == 254]] = True
    kept = ~border | begin
    symbols, at, run = kind[kept], at[kept], run[kept]
    border = border[kept]
    symbols[border] = _BORDER
    cut = np.zeros(len(symbols), bool)
    cut[border] = breaks[run[border]]
    # A break is the border that ends a sentence, SPAN gaps, and the border that begins the next one.
    width = np.where(cut, SPAN + 2, 1)
    place = np.cumsum(width) - width + 1
    out = np.zeros(int(width.sum()) + 2, np.uint8)
    out[0] = _BORDER
    out[place] = symbols
    stops = place[cut]
    out[stops + SPAN + 1] = _BORDER
    first = np.append(0, stops + SPAN + 1)[: len(stops)]
    doc = np.searchsorted(ends, at[cut], "right")
    full = stops + 1 - first > 2
    return Sentences(out, first[full], stops[full] + 1, doc[full])


def _lots(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, pieces of them) of about ``CHARS_AT_ONCE`` characters."""
    numbers, held, size = [], [], 0
    for n, text in enumerate(texts):
        text, begin = text or "", 0
        while True:
            end = min(begin + CHARS_AT_ONCE, len(text))
            if end < len(text):
                end = max(text.rfind("\n", begin, end), begin - 1) + 1 or end
                end = end if end > begin else text.rfind(" ", begin, begin + CHARS_AT_ONCE) + 1
                end = end if end > begin else begin + CHARS_AT_ONCE
            numbers.append(n)
            held.append(text[begin:end])
            size, begin = size + end - begin, end
            if size >= CHARS_AT_ONCE:
                yield numbers, held
                numbers, held, size = [], [], 0
            if begin >= len(text):
                break
    if numbers:
        yield numbers, held


def _all_sentences(texts: list[str | None]) -> Sentences:
    made, size = [], 0
    for numbers, held in _lots(texts):
        own = sentences(held)
        made.append((own.symbols, own.first + size, own.last + size, np.array(numbers)[own.doc]))
        size += len(own.symbols) + SPAN
        made[-1] = (np.append(own.symbols, np.zeros(SPAN, np.uint8)), *made[-1][1:])
    return Sentences(*(np.concatenate(c) for c in zip(*made))) if made else sentences([])


def _parts(found: Sentences) -> Iterator[tuple[Sentences, slice]]:
    """Views of whole documents, of about ``CHARS_AT_ONCE`` symbols, and their place."""
    if not len(found.doc):
        return
    begins = np.flatnonzero(np.append(True, found.doc[1:] != found.doc[:-1]))
    lots = found.first[begins] // CHARS_AT_ONCE
    cuts = [*begins[np.flatnonzero(np.append(True, lots[1:] != lots[:-1]))].tolist(), len(found.doc)]
    for a, b in zip(cuts, cuts[1:]):
        low = found.first[a]
        yield Sentences(found.symbols[low : found.last[b - 1] + SPAN], found.first[a:b] - low, found.last[a:b] - low, found.doc[a:b]), slice(a, b)


def _triples(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Codes of the triples that begin at each place, by gaps; 0 if one of the symbols is a gap."""
    wide = symbols.astype(np.int32)
    there = np.where(wide > 0, 1, 0).astype(np.int32)
    for i, j in _GAPS:
        n = len(wide) - i - j
        code = wide[:n] << 12
        code += wide[i : i + n] << 6
        code += wide[i + j :]
        code *= there[:n] & there[i : i + n] & there[i + j :]
        yield code, DECAY ** (i + j - 2)


def _sums(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, over the places before each, of triple weights and of squared decays."""
    value, square = np.zeros(len(symbols) + 1), np.zeros(len(symbols) + 1)
    for code, decay in _triples(symbols):
        value[1 : len(code) + 1] += decay * weights[code]
        square[1 : len(code) + 1] += decay**2 * (code > 0)
    return np.cumsum(value), np.cumsum(square)


#: The triples of a stretch begin in its first places, so that none ends beyond it. As sentences are ``SPAN`` gaps
#: apart and have three symbols at least, a short one's stretch meets no other sentence.
_INNER = STRETCH - SPAN + 1


def best_stretches(found: Sentences, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest normed sum of each sentence, where its stretch begins)."""
    top, begin = np.zeros(len(found.first), np.float32), np.zeros(len(found.first), np.int64)
    for part, at in _parts(found):
        top[at], begin[at] = _best_of(part, weights)
        begin[at] += found.first[at.start]
    return top, begin


def _best_of(found: Sentences, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, square = _sums(found.symbols, weights)
    n = len(found.symbols)
    upto = np.minimum(np.arange(n) + _INNER, n)
    normed = (value[upto] - value[:n]) / np.sqrt(np.maximum(square[upto] - square[:n], 1.0))
    # The last stretch of a sentence, and with it the only one of a short one, ends where the sentence does.
    size = np.maximum(found.last - found.first - _INNER, 0) + 1
    offset = np.cumsum(size) - size
    places = np.repeat(found.first - offset, size) + np.arange(int(size.sum()))
    own = normed[places].astype(np.float32)
    top = np.maximum.reduceat(own, offset)
    hit = np.flatnonzero(own == np.repeat(top, size))
    return top, places[hit[np.searchsorted(hit, offset)]]


def stretch_rows(found: Sentences, begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """[stretch, place]: symbols from ``begin`` in sentences ``which``, gaps beyond their ends."""
    at = begin[:, None] + np.arange(STRETCH)
    inside = at < found.last[which][:, None]
    return np.where(inside, found.symbols[np.minimum(at, len(found.symbols) - 1)], 0)


def _row_triples(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    flat = np.hstack([rows, np.zeros((len(rows), SPAN), np.uint8)]).ravel()
    for code, decay in _triples(np.append(flat, np.zeros(SPAN, np.uint8))):
        yield code[: len(flat)].reshape(len(rows), -1)[:, :_INNER], decay


class Landmarks:
    """Kernel values with a list of stretches; ``rows`` numbers the triples that they hold."""

    def __init__(self, some: np.ndarray):
        codes = np.unique(np.concatenate([code.ravel() for code, _ in _row_triples(some)]))
        codes = codes[codes > 0]
        self.rows = np.zeros(64**3, np.int32)
        self.rows[codes] = np.arange(1, len(codes) + 1)
        self.profile = np.zeros((len(codes) + 1, len(some)), np.float32)
        for code, decay in _row_triples(some):
            row, place = np.nonzero(code)
            np.add.at(self.profile, (self.rows[code[row, place]], row), decay)
        self.profile *= _norms(some)

    def products(self, some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), self.profile.shape[1]), np.float32)
        for code, decay in _row_triples(some):
            at = self.rows[code]
            for place in range(code.shape[1]):
                hit = np.flatnonzero(at[:, place])
                out[hit] += np.float32(decay) * self.profile[at[hit, place]]
        return out * _norms(some)[:, None]

    def weights(self, by_landmark: np.ndarray) -> np.ndarray:
        """One weight per triple code of a linear combination of the landmarks."""
        return (self.profile @ by_landmark).astype(np.float32)[self.rows]


def _norms(rows: np.ndarray) -> np.ndarray:
    square = sum(decay**2 * (code > 0).sum(axis=1) for code, decay in _row_triples(rows))
    return (1.0 / np.sqrt(np.maximum(square, 1.0))).astype(np.float32)


@dataclass
class Model:
    """One weight per symbol triple, and the line that turns a document's decisions into a probability."""

    weights: np.ndarray
    bias: float
    line: np.ndarray

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """([text, n]: the ``POOL`` largest decisions of its sentences; the stretch that decides most)."""
        pooled, told = np.full((len(texts), POOL), min(self.bias, -1.0)), [""] * len(texts)
        for numbers, held in _lots(texts):
            found = sentences(held)
            found.doc = np.array(numbers)[found.doc]
            top, begin = best_stretches(found, self.weights)
            first = numbers[0]
            own, most = _pool(top, found.doc - first, numbers[-1] + 1 - first, self.bias)
            ahead = np.flatnonzero((most >= 0) & ((own[:, 0] > pooled[first : numbers[-1] + 1, 0]) | (np.array([told[n] == "" for n in range(first, numbers[-1] + 1)]))))
            rows = stretch_rows(found, begin[most[ahead]], most[ahead])
            for n, row in zip(ahead.tolist(), rows):
                told[first + n] = _spell(row)
            both = np.hstack([pooled[first : numbers[-1] + 1], own])
            pooled[first : numbers[-1] + 1] = -np.sort(-both, axis=1)[:, :POOL]
        return pooled, told

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(pooled @ self.line[:-1] + self.line[-1], -30, 30)))


def _spell(row: np.ndarray) -> str:
    return "".join("*" if s == 0 else chr(96 + s) if s < 27 else " " if s == _BORDER else "#" for s in row.tolist()).strip("* ")


def _pool(top: np.ndarray, doc: np.ndarray, n: int, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Largest decisions by text, -1 or the bias where there are fewer, and the sentence of the first one."""
    order = np.lexsort((-top, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    pooled, most = np.full((n, POOL), min(bias, -1.0)), np.full(n, -1)
    near = rank < POOL
    pooled[doc[order][near], rank[near]] = np.clip(top[order][near] + bias, -3, 3)
    most[doc[order][rank == 0]] = order[rank == 0]
    return pooled, most


def _first_guess(found: Sentences, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``best_stretches``, by how far the documents that hold a run of letters differ between the labels.

    Runs have ``FIRST_RUNS`` symbols and are counted once a document, in 2**``CELLS`` cells of their hash; the measure is
    the difference of the two shares over its standard error.
    """
    n = [max(int((toxic == side).sum()), 1) for side in (0, 1)]
    best = [np.zeros(len(part.symbols), np.float32) for part, _ in _parts(found)]
    for length in FIRST_RUNS:
        df = np.zeros((2, 2**CELLS), np.int32)
        for part, _ in _parts(found):
            cell, begin = _cells(part, length)
            doc = part.doc[np.searchsorted(part.first, begin, "right") - 1]
            pairs = np.unique(cell << 32 | doc)
            for side in (0, 1):
                np.add.at(df[side], pairs[toxic[pairs & (2**32 - 1)] == side] >> 32, 1)
        share = (df[0] + df[1]) / np.float32(n[0] + n[1])
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * np.float32(1 / n[0] + 1 / n[1]))
        measure = ((df[1] / np.float32(n[1]) - df[0] / np.float32(n[0])) / error).astype(np.float32)
        for (part, _), own in zip(_parts(found), best):
            cell, begin = _cells(part, length)
            own[begin] = np.maximum(own[begin], measure[cell])
    top, start = np.zeros(len(found.first), np.float32), np.zeros(len(found.first), np.int64)
    for (part, at), own in zip(_parts(found), best):
        size = part.last - part.first
        offset = np.cumsum(size) - size
        places = np.arange(int(size.sum())) + np.repeat(part.first - offset, size)
        top[at] = np.maximum.reduceat(own[places], offset)
        hit = np.flatnonzero(own[places] == np.repeat(top[at], size))
        start[at] = np.maximum(places[hit[np.searchsorted(hit, offset)]] - 1, part.first) + found.first[at.start]
    return top, start


def _cells(found: Sentences, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash cell, place) of all runs of ``length`` symbols without a gap."""
    wide = found.symbols.astype(np.uint64)
    room = max(len(wide) - length + 1, 0)
    code, there = np.zeros(room, np.uint64), np.ones(room, bool)
    for k in range(length):
        code = code << U64(6) | wide[k : k + room]
        there &= wide[k : k + room] > 0
    begin = np.flatnonzero(there)
    begin = begin[(begin >= found.first[0]) & (begin < found.last[-1])]
    return (mix(code[begin]) >> U64(64 - CELLS)).astype(np.int64), begin


def _unlike(found: Sentences, n: int) -> np.ndarray:
    """Which of ``n`` texts are not near copies of an earlier one, which would count twice."""
    marks = np.full((n, 3), 2**64 - 1, np.uint64)
    for part, _ in _parts(found):
        four = next(iter(_triples(part.symbols)))[0].astype(np.uint64)
        four[:-3] |= four[3:] << U64(18)
        for salt in range(3):
            hashed = np.append(mix(four + U64(salt << 40)), np.full(len(part.symbols) - len(four), 2**64 - 1, np.uint64))
            low = np.minimum.reduceat(hashed, np.stack([part.first, part.last], axis=1).ravel())[::2]
            np.minimum.at(marks[:, salt], part.doc, low)
    _, first = np.unique(marks, axis=0, return_index=True)
    out = np.zeros(n, bool)
    out[first] = True
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights with the bias last, by Newton's steps on the rows inside the margin, ``ROWS`` at a time."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        gram, right = ridge.copy(), np.zeros(len(w))
        for n in range(0, len(x), ROWS):
            rows = np.hstack([x[n : n + ROWS], np.ones((len(x[n : n + ROWS]), 1))])
            rows, own = (c[y[n : n + ROWS] * (rows @ w) < 1] for c in (rows, y[n : n + ROWS]))
            gram += COST * rows.T @ rows
            right += COST * rows.T @ own
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _bags(top: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The ``BAG`` sentences of largest decision of each document, the first of each ahead."""
    order = np.lexsort((-top, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    near = rank < BAG
    return order[near][np.argsort(rank[near], kind="stable")]


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows, the most frequent first, then in their order."""
    _, at, times = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return rows[at[np.lexsort((at, -times))][:n]]


def _disturbed(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copies with a letter, a gap or a border at one place, put in or in place of what is there."""
    at = rng.integers(2, STRETCH - 3, len(rows))[:, None]
    mark = rng.choice(np.concatenate([np.arange(1, 27), np.repeat([0, _BORDER], 13)]), len(rows))[:, None]
    place = np.arange(STRETCH)
    shift = (place > at) & (rng.random(len(rows)) < 0.6)[:, None]
    moved = np.take_along_axis(rows, place - shift, axis=1)
    return np.where(place == at, mark, moved).astype(np.uint8)


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model from (text, label) rows; None without rows of both labels."""
    rows = sorted(set(rows))
    found = _all_sentences([t for t, _ in rows])
    if not len(found.first):
        return None
    new = _unlike(found, len(rows))
    rows = [r for r, keep in zip(rows, new) if keep]
    found = _all_sentences([t for t, _ in rows])
    label = np.array([y for _, y in rows], np.int64)
    bad = label[found.doc] == 1
    if not bad.any() or bad.all():
        return None
    toxic, clean = np.flatnonzero(bad), np.flatnonzero(~bad)
    rng = np.random.default_rng(5)
    held = rng.permutation(clean)[: NEGATIVES // 3]
    held_rows = stretch_rows(found, found.first[held], held)
    n_docs = len(np.unique(found.doc[toxic]))
    (top, begin), bias = _first_guess(found, label), -np.inf
    for _ in range(ROUNDS):
        # Few sentences of clean documents lie above these levels; the first of a document needs less.
        lower, upper = np.quantile(top[clean], LEVELS)
        bag = toxic[_bags(top[toxic], found.doc[toxic])]
        bag = bag[top[bag] > np.where(np.arange(len(bag)) < n_docs, lower, upper)]
        if not len(bag):
            return None
        positive = stretch_rows(found, begin[bag], bag)
        hard = clean[np.argsort(-top[clean], kind="stable")][: NEGATIVES // 3]
        hard = hard[top[hard] + bias > -1] if np.isfinite(bias) else hard
        hard_rows = stretch_rows(found, begin[hard], hard)
        held_rows = np.unique(np.vstack([held_rows, hard_rows]), axis=0)
        listed = np.vstack([_spread(positive, LANDMARKS // 2), _spread(hard_rows, LANDMARKS // 4), rng.permutation(held_rows)[: LANDMARKS // 4]])
        marks = Landmarks(np.unique(listed, axis=0))
        kernel = marks.products(np.unique(listed, axis=0)).astype(float)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        good = values > 1e-3 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        odd = _disturbed(positive[rng.permutation(len(positive))[:DISTURBED]], rng)
        every = np.vstack([positive, odd, held_rows])
        x = np.vstack([(marks.products(every[n : n + ROWS]) @ whiten).astype(np.float32) for n in range(0, len(every), ROWS)])
        y = np.repeat([1.0, -1.0], [len(positive) + len(odd), len(held_rows)])
        w = _squared_hinge(x, y)
        weights, bias = marks.weights(whiten @ w[:-1]), float(w[-1])
        top, begin = best_stretches(found, weights)
    pooled, _ = _pool(top, found.doc, len(rows), bias)
    return Model(weights, bias, _line(pooled, label.astype(float)))


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of a label on decisions, slightly drawn to zero; the offset is last."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - y) + 0.1 * w
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move / max(1.0, np.abs(move).max() / 3)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _stretch_of(text_col: str):
    """A text, or of a long one four stretches from its whole length, as lines."""
    part = SAMPLE_CHARS // 4
    places = [F.substring(F.col(text_col), F.floor((F.length(text_col) - part) * n / 3).cast("int") + 1, F.lit(part)) for n in range(4)]
    return F.when(F.length(text_col) > SAMPLE_CHARS, F.concat_ws("\n", *places)).otherwise(F.col(text_col))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fits on the bounded sample; only its ids are broadcast."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    take = lambda label, n: known.where(F.col("_label") == label).orderBy(F.xxhash64(id_col), id_col).limit(n)
    some = take(1, SAMPLE).unionByName(take(0, SAMPLE_CLEAN))
    rows = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select(_stretch_of(text_col).alias("_text"), "_label").where("_text is not null").collect()
    return fit([(r[0], int(r[1])) for r in rows])


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", carry: list[str]) -> DataFrame:
    """``carry``, score, and ``worst``: the stretch of the text that decided it."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                scores, worst = np.zeros(some.num_rows), [""] * some.num_rows
                if model is not None:
                    texts = some.column(len(carry)).to_pylist()
                    pooled, worst = model.decide(texts)
                    scores = model.probability(pooled).round(6)
                own = [some.column(c) for c in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array(worst, pa.string())], [*carry, "score", "worst"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(ship(compute), ", ".join([*kinds, "score double", "worst string"]))
