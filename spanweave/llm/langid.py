"""Language identification by a bidirectional gated recurrent network over bytes.

One network reads the bytes forward, one backward; at every position the two states give a
probability for each language. A document's probabilities are the mean over its positions.
The network is trained here, in numpy, by backpropagation through time.

Training: at most ``SAMPLE`` rows of each language, in the order of a hash, and of each
``STRETCHES`` stretches of ``TRAIN_BYTES`` bytes from hashed places of the whole text. Scoring: whole
texts, in stretches of ``READ_BYTES`` bytes with ``OVERLAP`` bytes of context before and after, read
side by side; memory does not grow with a text's length.

Defined cases: a text that is null or has no letter is ``und`` with score 0; repeated rows are
labelled alike; of equal probabilities the first language by name wins; an empty table gives
no rows; without labelled rows every text is ``und``; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.tables import ship
from spanweave.llm.textscan import pieces

STATE = 8
SAMPLE = 400
STRETCHES = 4
TRAIN_BYTES = 96
STEPS = 500
BATCH = 128
READ_BYTES = 256
OVERLAP = 8
#: Stretches read side by side; their states fit the processor's cache.
SIDE_BY_SIDE = 1536
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Reader:
    """One direction: input weights per byte (256, 3H), state weights (H, 3H); gates z, r, candidate."""

    inputs: np.ndarray
    states: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Reader:
        return cls(rng.normal(0, 0.3, (256, 3 * STATE)), rng.normal(0, 0.3 / np.sqrt(STATE), (STATE, 3 * STATE)))

    def forward(self, data: np.ndarray) -> tuple[np.ndarray, list]:
        """States (T, N, H) of byte sequences (T, N), and what the way back needs."""
        h, out, kept = np.zeros((data.shape[1], STATE)), [], []
        for at in data:
            x = self.inputs[at]
            s = h @ self.states
            z = _sigmoid(x[:, :STATE] + s[:, :STATE])
            r = _sigmoid(x[:, STATE : 2 * STATE] + s[:, STATE : 2 * STATE])
            c = np.tanh(x[:, 2 * STATE :] + r * s[:, 2 * STATE :])
            kept.append((h, z, r, c, s[:, 2 * STATE :]))
            h = h + z * (c - h)
            out.append(h)
        return np.stack(out), kept

    def backward(self, data: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d_in, d_st, dh = np.zeros_like(self.inputs), np.zeros_like(self.states), np.zeros_like(d_out[0])
        for t in range(len(data) - 1, -1, -1):
            h, z, r, c, sc = kept[t]
            dh = dh + d_out[t]
            dz = dh * (c - h) * z * (1 - z)
            dc = dh * z * (1 - c * c)
            dr = dc * sc * r * (1 - r)
            gates = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(d_in, data[t], gates)
            through = np.concatenate([dz, dr, dc * r], axis=1)
            d_st += h.T @ through
            dh = dh * (1 - z) + through @ self.states.T
        return d_in, d_st


@dataclass
class Model:
    languages: list[str]
    ahead: Reader
    behind: Reader
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.inputs, self.ahead.states, self.behind.inputs, self.behind.states, self.out, self.bias]


def fit(texts: list[bytes], labels: list[str], seed: int = 3) -> Model | None:
    """Trains on byte stretches; each position of a stretch has the stretch's label."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    model = Model(languages, Reader.fresh(rng), Reader.fresh(rng), rng.normal(0, 0.1, (2 * STATE, len(languages))), np.zeros(len(languages)))
    order = sorted(range(len(texts)), key=lambda n: (labels[n], texts[n]))
    rows = np.zeros((len(texts), TRAIN_BYTES), np.uint8)
    there = np.zeros((len(texts), TRAIN_BYTES))
    for n, k in enumerate(order):
        own = np.frombuffer(texts[k][:TRAIN_BYTES], np.uint8)
        rows[n, : len(own)], there[n, : len(own)] = own, 1
    goal = np.array([languages.index(labels[k]) for k in order])
    each = [np.flatnonzero(goal == n) for n in range(len(languages))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    for step in range(1, STEPS + 1):
        # Languages are drawn alike, however many rows they have.
        pick = np.array([rng.choice(each[n % len(each)]) for n in range(BATCH)])
        data, weight, y = rows[pick].T, there[pick].T, goal[pick]
        a, kept_a = model.ahead.forward(data)
        b, kept_b = model.behind.forward(data[::-1])
        both = np.concatenate([a, b[::-1]], axis=2)
        logits = both @ model.out + model.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        d = p * (weight / max(weight.sum(), 1))[:, :, None]
        d_both = d @ model.out.T
        grads = [*model.ahead.backward(data, kept_a, d_both[:, :, :STATE])]
        grads += model.behind.backward(data[::-1], kept_b, d_both[::-1, :, STATE:])
        grads += [np.einsum("tnh,tnc->hc", both, d), d.sum(axis=(0, 1))]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for value, grad, (m, v) in zip(model.parameters(), grads, moments):
            grad = grad / max(1.0, size)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


class Scorer:
    """The trained network on many stretches at once, features before stretches."""

    def __init__(self, model: Model):
        half = np.ones(3 * STATE)
        half[: 2 * STATE] = 0.5
        side = lambda r: (np.ascontiguousarray((r.inputs * half).astype(np.float32)), np.ascontiguousarray((r.states * half).T.astype(np.float32)))
        self.sides = [side(model.ahead), side(model.behind)]
        self.out = np.ascontiguousarray(model.out.T.astype(np.float32))
        self.bias = model.bias.astype(np.float32)[:, None]

    def states(self, data: np.ndarray, side: int) -> np.ndarray:
        """(T, H, N) for bytes (T, N), in the order of ``data``."""
        inputs, states = self.sides[side]
        length, n = data.shape
        out = np.empty((length, STATE, n), np.float32)
        h, s, gates = np.zeros((STATE, n), np.float32), np.empty((3 * STATE, n), np.float32), np.empty((2 * STATE, n), np.float32)
        c = np.empty((STATE, n), np.float32)
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            x = inputs[data[t]].T
            np.dot(states, h, out=s)
            np.add(s[: 2 * STATE], x[: 2 * STATE], out=gates)
            np.tanh(gates, out=gates)
            gates += 1.0
            gates *= 0.5
            np.multiply(gates[STATE:], s[2 * STATE :], out=c)
            c += x[2 * STATE :]
            np.tanh(c, out=c)
            c -= h
            c *= gates[:STATE]
            h = np.add(h, c, out=out[t])
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (T, C, N) of every position."""
        ahead, behind = self.states(data, 0), self.states(data, 1)
        p = np.matmul(self.out[:, :STATE], ahead)
        p += np.matmul(self.out[:, STATE:], behind)
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def pooled(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, C): the sum of the probabilities of all positions of each text."""
        sizes = np.diff(ends)
        parts = -(-sizes // READ_BYTES)
        text = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = ends[text] + nth * READ_BYTES
        stop = np.minimum(start + READ_BYTES, ends[text + 1])
        left, right = np.minimum(OVERLAP, start - ends[text]), np.minimum(OVERLAP, ends[text + 1] - stop)
        total = np.zeros((len(sizes), len(self.out)))
        length = stop - start + left + right
        order = np.argsort(length, kind="stable")
        padded = np.append(data, np.zeros(READ_BYTES + 2 * OVERLAP, np.uint8))
        for n in range(0, len(order), SIDE_BY_SIDE):
            own = order[n : n + SIDE_BY_SIDE]
            longest = int(length[own].max())
            # Shorter stretches end early: what follows is read but not counted, and the
            # backward reader starts at their own ends.
            at = np.arange(longest)[:, None]
            rows = padded[np.minimum((start - left)[own] + at, len(padded) - 1)]
            rows = np.where(at < length[own], rows, 0)
            p = self.positions(rows)
            counted = (at >= left[own]) & (at < (length - right)[own])
            np.add.at(total, text[own], np.einsum("tcn,tn->nc", p, counted.astype(np.float32)))
        return total


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on the bounded sample; only stretches of bounded length come to the driver."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    size = F.length(text_col)
    places = [F.pmod(F.xxhash64(id_col, F.lit(n)), F.greatest(size - TRAIN_BYTES, F.lit(1))).cast("int") + 1 for n in range(STRETCHES)]
    cut = F.array(*[F.substring(F.col(text_col), p, TRAIN_BYTES) for p in places])
    some = known.select(F.xxhash64(id_col).alias("_order"), F.col(lang_col).alias("_lang"), cut.alias("_cut"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_cut"))
    rows = some.withColumn("_place", place).where(F.col("_place") <= SAMPLE).select("_cut", "_lang").collect()
    flat = [(t.encode(), r["_lang"]) for r in rows for t in r["_cut"] if _LETTER.search(t)]
    return fit([t for t, _ in flat], [y for _, y in flat])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", carry: list[str]) -> DataFrame:
    """``carry``, lang_pred, score (its probability) and the probabilities of all languages."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            texts = batch.column(len(carry))
            for row, n, data, ends in pieces(texts):
                lettered = [t is not None and _LETTER.search(t) is not None for t in texts.slice(row, n).to_pylist()]
                if scorer is None:
                    found, score, shares = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                else:
                    total = scorer.pooled(data, ends)
                    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                    best = total.argmax(axis=1)
                    found = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                    score = np.where(lettered, total.max(axis=1), 0.0).clip(0, 1).round(6)
                    shares = total.round(6).tolist()
                own = [batch.column(c).slice(row, n) for c in range(len(carry))]
                columns = [*own, pa.array(found), pa.array(score), pa.array(shares, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "lang_pred", "score", "shares"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(ship(compute), ", ".join([*kinds, "lang_pred string, score double, shares array<double>"]))


def label_positions(model: Model, text: str) -> list[str]:
    """The likeliest language at each byte of one text."""
    data = np.frombuffer(text.encode(), np.uint8)[:, None]
    return [model.languages[n] for n in Scorer(model).positions(data)[:, :, 0].argmax(axis=1)] if len(data) else []
