"""Context-tree weighting against the plain recursion, its base score against a count of words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import treeweights
from tests.conftest import DATA

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["abab", "abba ab", "", None, "é a", "Ab aB ab", "zzzz", "abab"]
TRAIN = [True, True, True, True, False, False, True, False]


def _frame(text, depth):
    return [255] * depth + list((text or "").encode()) + [255]


def _bits(byte):
    node = 1
    for j in range(7, -1, -1):
        bit = byte >> j & 1
        yield node, bit
        node = node * 2 + bit


class Recursion:
    """Weighted probabilities straight from the definition; KT as a product over the bits seen."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            frame = _frame(text, depth)
            for n in range(depth, len(frame)):
                for node, bit in _bits(frame[n]):
                    self._add(node, frame[n - depth : n][::-1], bit, 1)

    def _add(self, node, context, bit, times):
        for d in range(self.depth + 1):
            self.counts[node, tuple(context[:d])][bit] += times
            if d < self.depth:
                self.children[node, tuple(context[:d])].add(context[d])

    def weighted(self, node, context=()):
        zeros, ones = self.counts.get((node, context), (0, 0))
        kt = 1.0
        for n in range(zeros):
            kt *= (n + 0.5) / (n + 1)
        for n in range(ones):
            kt *= (n + 0.5) / (zeros + n + 1)
        if len(context) == self.depth:
            return kt
        below = math.prod(self.weighted(node, (*context, c)) for c in self.children.get((node, context), ()))
        return 0.5 * kt + 0.5 * below

    def log10(self, text):
        frame, total = _frame(text, self.depth), 0.0
        for n in range(self.depth, len(frame)):
            for node, bit in _bits(frame[n]):
                before = self.weighted(node)
                context = frame[n - self.depth : n][::-1]
                self._add(node, context, bit, 1)
                total += math.log10(self.weighted(node) / before)
                self._add(node, context, bit, -1)
        return total


def _docs(spark, texts=TEXTS, train=TRAIN):
    rows = [(n, t, k) for n, (t, k) in enumerate(zip(texts, train))]
    return spark.createDataFrame(rows, "doc_id long, text string, learns boolean")


@pytest.mark.parametrize("units, chunk, depth", [(10**6, 10**6, 2), (3, 5, 2), (7, 10**6, 3)])
def test_scores_equal_the_recursion(spark, monkeypatch, units, chunk, depth):
    monkeypatch.setattr(treeweights, "RANGE_UNITS", units)
    monkeypatch.setattr(treeweights, "CHUNK_BYTES", chunk)
    plain = Recursion([t for t, k in zip(TEXTS, TRAIN) if k], depth)
    got = {r.doc_id: r for r in treeweights.score(_docs(spark), train=F.col("learns"), carry=["doc_id"], depth=depth).collect()}
    assert len(got) == len(TEXTS)
    for n, text in enumerate(TEXTS):
        assert got[n].score == pytest.approx(plain.log10(text), rel=1e-9)
        assert got[n].bits_per_byte == pytest.approx(-plain.log10(text) / math.log10(2) / (len((text or "").encode()) + 1))


def test_base_scores_equal_a_count_of_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(_docs(spark).selectExpr("doc_id + 100000 AS doc_id", "text"))
    learns = F.col("doc_id") % 10 != 0
    rows = docs.select("doc_id", "text", learns.alias("learns")).collect()
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(UPPER)), None] for r in rows}
    counts = Counter(w for r in rows if r.learns for w in tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in treeweights.score(docs, train=learns, carry=["doc_id"]).collect()}
    for r in rows:
        row, own = got[r.doc_id], tokens[r.doc_id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
    held_out = [got[r.doc_id].bits_per_byte for r in rows if not r.learns and len(r.text or "") > 200]
    assert np.median(held_out) < 3


def test_probabilities_of_all_bytes_sum_to_one():
    data = np.frombuffer(b"abracadabra", np.uint8)
    units, counts = np.unique(np.concatenate([k for k, _ in treeweights.units_of(data, np.array([0, len(data)]), 3)]), return_counts=True)
    context = np.uint64(int.from_bytes(b"rba"))
    asked = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    both = np.union1d(units, asked)
    seen = np.zeros(len(both), np.int64)
    seen[np.searchsorted(both, units)] = counts
    logs = treeweights.Range(both, seen, 3).log_probabilities()
    assert np.exp(logs[np.searchsorted(both, asked)]).sum() == pytest.approx(1)


def test_units_and_words_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(b"one Two  three\n" * 40 + b"x" * 60 + b" y", np.uint8)
    whole = [treeweights.units_of, treeweights.words_of]
    ends = np.array([0, len(data)])
    want = [np.concatenate([k for k, _ in (f(data, ends, 4) if f is treeweights.units_of else f(data, ends))]) for f in whole]
    monkeypatch.setattr(treeweights, "BLOCK", 17)
    got = [np.concatenate([k for k, _ in (f(data, ends, 4) if f is treeweights.units_of else f(data, ends))]) for f in whole]
    assert all((a == b).all() for a, b in zip(want, got)) and len(want[0]) == len(data) + 1 and len(want[1]) == 122


def test_log_gamma_is_exact():
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e3, 123456.5, 1e12]])
    assert np.allclose(treeweights._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert treeweights.score(none, train=F.lit(True), carry=["doc_id"]).count() == 0
    rows = [(None, "a b"), (None, "a b"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "key", "word", "n", "score", "carried")})
    untaught = treeweights.score(docs, train=F.lit(False), carry=["doc_id", "key"]).collect()
    assert sorted((r.bits_per_byte, r.n_tokens, r.n_known, r.base_score, r.key) for r in untaught) == [(8.0, 1, 0, 0.0, "x"), (8.0, 3, 0, 0.0, "x"), (8.0, 3, 0, 0.0, "x")]
