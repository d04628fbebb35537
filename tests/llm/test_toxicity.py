"""The string-kernel machine against plain versions of its parts, and its held-out accuracy by language."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from spanweave.llm import toxicity
from spanweave.llm.toxicity import DECAY, SPAN, STRETCH

TEXTS = ["You idiot. Go away!\nnow 3.5 go", None, "", " .. ", "a", "É i d i o t\t\tx1y", "no stop", "x" * 40 + " y! z", "\n\n ab\n", "漢字 \U0001f600 ok?"]


def _sentences(text):
    """Symbols of each sentence, one character at a time."""
    low = (text or "").lower()
    low = "\n".join([low, *(r.replace(" ", "") for r in re.findall(r"(?<!\S)\w(?: \w){2,}(?!\S)", low))])
    for part in re.split(r"(?:[.!?]+(?=\s|$))|\n", low):
        own = [27]
        for c in part:
            if c.isspace():
                own += [27] if own[-1] != 27 else []
            elif "a" <= c <= "z":
                own.append(ord(c) - 96)
            elif "0" <= c <= "9":
                own.append(0)
            elif ord(c) >= 0x3000 or c.isalnum():
                own.append(29 + ord(c) % 35)
        own += [27] if own[-1] != 27 else []
        if len(own) > 2:
            yield own


def _features(stretch):
    """Triples that begin in the first places, with their weights, repeated ones apart."""
    for a, b, c in combinations(range(len(stretch)), 3):
        if c - a < SPAN and a <= STRETCH - SPAN and stretch[a] and stretch[b] and stretch[c]:
            yield (stretch[a], stretch[b], stretch[c]), DECAY ** (c - a - 2)


def _kernel(x, y):
    left, right = list(_features(x)), list(_features(y))
    total = sum(u * v for s, u in left for t, v in right if s == t)
    return total / np.sqrt(max(sum(u * u for _, u in left), 1)) / np.sqrt(max(sum(v * v for _, v in right), 1))


def _stretches(sentence):
    return [sentence[n : n + STRETCH] for n in range(max(len(sentence) - (STRETCH - SPAN + 1), 0) + 1)]


def test_sentences_equal_a_plain_reading():
    found = toxicity.sentences(TEXTS)
    got = [(int(d), found.symbols[a:b].tolist()) for d, a, b in zip(found.doc, found.first, found.last)]
    assert got == [(n, s) for n, t in enumerate(TEXTS) for s in _sentences(t)]
    assert len(toxicity.sentences([]).first) == 0


def _landmarks():
    found = toxicity.sentences(["you utter idiot", "go away now", "the quick brown fox jumps"])
    return toxicity.stretch_rows(found, found.first, np.arange(3))


def test_kernel_values_equal_brute_force():
    found = toxicity.sentences(TEXTS)
    rows = toxicity.stretch_rows(found, found.first, np.arange(len(found.first)))
    got = toxicity.Landmarks(_landmarks()).products(rows)
    expected = [[_kernel(r, m) for m in _landmarks().tolist()] for r in rows.tolist()]
    assert np.allclose(got, expected, atol=1e-5) and got.max() > 0.1


def test_decisions_equal_the_largest_kernel_combination():
    marks = toxicity.Landmarks(_landmarks())
    by_landmark = np.array([1.0, 0.5, -0.7])
    model = toxicity.Model(marks.weights(by_landmark), -0.25, np.array([1.0, 0.0, 0.0, 0.0]))
    pooled, _ = model.decide(TEXTS)
    for n, text in enumerate(TEXTS):
        own = sorted((max(np.dot(by_landmark, [_kernel(x, m) for m in _landmarks().tolist()]) for x in _stretches(s)) - 0.25 for s in _sentences(text)), reverse=True)
        own = (own + [-1.0] * toxicity.POOL)[: toxicity.POOL]
        assert np.allclose(pooled[n], own, atol=1e-4)


def test_lots_do_not_change_scores(spark, monkeypatch):
    marks = toxicity.Landmarks(_landmarks())
    model = toxicity.Model(marks.weights(np.array([1.0, 0.5, -0.7])), -0.25, np.array([4.0, 1.0, 1.0, 0.0]))
    docs = spark.createDataFrame(list(enumerate([*TEXTS, "you idiot\n" * 5000])), "doc_id long, text string")
    whole = {r.doc_id: r.score for r in toxicity.score(docs, model, carry=["doc_id"]).collect()}
    # Lots of a few characters also cut texts at their line breaks, which end sentences anyway.
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 40_000)
    apart = model.probability(np.vstack([model.decide([t])[0] for t in [*TEXTS, "you idiot\n" * 5000]])).round(6)
    assert whole == pytest.approx(dict(enumerate(apart.tolist())))


def test_long_labelled_texts_are_used_in_four_stretches(spark):
    text = "".join(f"{n} " for n in range(20_000))
    row = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(toxicity._stretch_of("text").alias("t")).collect()
    parts = row[0].t.split("\n")
    assert len(parts) == 4 and all(len(p) == toxicity.SAMPLE_CHARS // 4 and p in text for p in parts)
    assert text.startswith(parts[0]) and text.endswith(parts[3]) and (row[1].t, row[2].t) == ("short", None)


def test_one_label_or_no_sentence_gives_no_model():
    assert toxicity.fit([]) is None and toxicity.fit([("a b", 1)]) is None and toxicity.fit([("", 1), ("", 0)]) is None
    assert toxicity.fit([("plain words here", 0), ("more of them", 0)]) is None


def test_held_out_toxic_documents_of_every_language():
    labels = dict(zip(*pq.read_table("/root/testdata/sf0.1/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()))
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    docs = [(d["doc_id"], d["text"], d["lang"], labels[d["doc_id"]]) for d in docs if d["doc_id"] in labels and d["text"] is not None]
    out = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    learned = {d[0] for d in docs} - {d[0] for d in out}
    model = toxicity.fit([(t[: toxicity.SAMPLE_CHARS], y) for i, t, _, y in docs if i in learned])
    said = model.probability(model.decide([d[1] for d in out])[0]) >= 0.5
    for lang in ("en", "de", "fr", "es"):
        own = np.array([d[2] == lang for d in out])
        toxic = np.array([d[3] == 1 for d in out])
        assert said[own & toxic].mean() >= 0.8 and said[own & ~toxic].mean() <= 0.05
    more = ["you are a worthless moron", "you i d i o t now", "you idiiot now"]
    assert (model.probability(model.decide(more)[0]) > 0.5).all()
    assert model.probability(model.decide(["", "the thing of the"])[0]).max() < 0.1
