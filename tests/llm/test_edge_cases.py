"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every
operator and every stage of the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanweave.llm import balance, chat, langid, license_scan, oddsketch, outliers, packing, runindex, spotsigs, toxicity

LONG = "the quick word and another " * 8000
ROWS = [
    (1, None, None, None, 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 4),
    (4, "one", "en", None, 3),
    (5, LONG, "en", "s", len(LONG)),
    (6, LONG, "en", "s", len(LONG)),
    (7, "the cat and the dog cc by", "en", "t", 25),
    (7, "the cat and the dog cc by", "en", "t", 25),
    (None, "no id at all", "fr", "t", 12),
]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["k", "th", "key", "size", "score", "_row", "id", "copies", "start", "words"]


def _ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, SHAPE)
    return docs.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.createDataFrame([(n, f"the idiot thing {n}" if n % 2 else f"a fine day {n} für", "en" if n % 2 else "de") for n in range(60)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    return toxicity.train(docs, labels), langid.train(docs)


OPERATORS = {
    "license": lambda d, m: license_scan.scan(d),
    "outliers": lambda d, m: outliers.judge(d, carry=["doc_id"]),
    "langid": lambda d, m: langid.predict(d, m[1], carry=["doc_id"]),
    "runindex": lambda d, m: runindex.remove_repeated(d, carry=["doc_id"]),
    "toxicity": lambda d, m: toxicity.score(d, m[0], carry=["doc_id"]),
    "spotsigs": lambda d, m: spotsigs.against_next(d),
    "balance": lambda d, m: balance.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_one_row_per_row(odd, models, name):
    assert OPERATORS[name](odd, models).count() == len(ROWS)
    assert OPERATORS[name](odd.where("false"), models).count() == 0


def test_packing_and_near_duplicates_of_odd_rows(odd):
    made = packing.pack(odd, _ranks(), with_ids=False)
    ends = {r.doc_id: r.n for r in made.groupBy("doc_id").agg(F.count(F.when(F.col("start") == 0, 1)).alias("n")).collect()}
    assert ends == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, None: 1}
    assert packing.pack(odd.where("false"), _ranks()).count() == 0
    found = {r.id: r.component_id for r in oddsketch.near_duplicates(odd.where("doc_id is not null")).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert oddsketch.near_duplicates(odd.where("false")).count() == 0


def test_odd_results(odd, models):
    languages = {(r.doc_id, r.lang_pred == langid.UNKNOWN) for r in langid.predict(odd, models[1], carry=["doc_id"]).collect()}
    assert {(1, True), (2, True), (3, True), (4, False)} <= languages
    removed = {r.doc_id: r.n_removed for r in runindex.remove_repeated(odd, carry=["doc_id"]).collect()}
    assert removed[5] == removed[6] == len(LONG) and removed[1] == removed[7] == 0
    empty = {r.score for r in toxicity.score(odd.where("doc_id in (1, 2, 3)"), models[0], carry=["doc_id"]).collect()}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert {r.score for r in toxicity.score(odd, None, carry=["doc_id"]).collect()} == {0.0}


def test_chat_of_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "x"), (None, 1, "user", "y"), (2, 5, "user", "long " * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nth", F.lit(1))
    got = {r.conv: r.n_turns for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got == {1: 3, 2: 1, None: 1}
    assert chat.digests(chat.format_turns(turns.where("false"))).count() == 0


@pytest.mark.parametrize("n", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, odd, tmp_path, n):
    spark.createDataFrame([(4, 0), (7, 1), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[n]
    for docs, least in ((odd, 1), (odd.where("false"), 0)):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= least
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    if name == "near_dedup":
        kept = sorted((r.doc_id for r in stage(spark, odd, str(tmp_path)).collect()), key=str)
        assert kept == [1, 2, 3, 4, 5, 7, None]
