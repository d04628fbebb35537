"""Fill-in-the-middle against brute force over strings, and its restoration."""

from __future__ import annotations

import hashlib
import re

import pytest

from spanweave.llm import piecetable

TEXTS = ["", None, "\n", "a", "one\ntwo\nthree", "one\ntwo\n", "\n\n\n", "é\r\n🙂\nüü", "has <S> in it\nx", "<P\n>P>\n<\n<M", "x\n" * 5000, "long " * 300_000]


def _brute(key, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[n : n + 8], 16) for n in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 0)])
def test_equals_brute_force_and_restores(spark, rate, spm_rate):
    rows = [(n, t) for n in range(0, 700, 100) for t in TEXTS[:-2]] + [(n, t) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "output")
    made = piecetable.fill_in_middle(docs, text_col="output", rate=rate, spm_rate=spm_rate).cache()
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((key, *_brute(key, text, rate, spm_rate)) for key, text in rows), key=str)
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in made.collect())
    back = sorted((r.id, r.restored, r.restored_sha256) for r in piecetable.restore(made).collect())
    assert back == sorted((key, t or "", hashlib.sha256((t or "").encode()).hexdigest()) for key, t in rows)


def test_forms_are_all_met(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'a\nb\nc' AS text")
    forms = {r.form: r["count"] for r in piecetable.fill_in_middle(docs).groupBy("form").count().collect()}
    assert set(forms) == {"psm", "spm"} and min(forms.values()) > 120


def test_splitting_arranging_and_restoring_keep_the_bytes():
    table = piecetable.Marks().cut(memoryview(b"abcdef"), 2, 2)
    assert table.content() == b"<P>ab<M><S>cdef"
    for order in piecetable.ORDERS.values():
        there = table.arranged(order)
        assert there.restored(order) == table
        assert there.restored(order).of_buffer(piecetable.TEXT).content() == b"abcdef"


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (None, "a\nb")], "doc_id long, text string")
    assert len({(r.output, r.form) for r in piecetable.fill_in_middle(docs).collect()}) == 1
    assert piecetable.restore(piecetable.fill_in_middle(docs.where("false"))).count() == 0


def test_sentinels_that_could_arise_at_a_cut_are_refused():
    for names in (("<P>", "<P>", "<M>"), ("aba", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            piecetable.Marks(names)
