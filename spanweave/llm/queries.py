"""The registered queries of this subpackage; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import balance, chat, langid, license_scan, oddsketch, outliers, packing, piecetable, runindex, spotsigs, toxicity, treeweights, whitening
from spanweave.llm.oracles import oracles
from spanweave.llm.tables import read


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return license_scan.scan(docs).withColumnRenamed("id", "doc_id").drop("spans")


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return outliers.judge(docs, carry=["doc_id"])


def _dealt(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(_dealt(4) != 2))
    held_out = (F.coalesce(_dealt(4), F.lit(-1)) == 2).alias("held_out")
    return langid.predict(docs, model, carry=["doc_id"]).select("doc_id", held_out, "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.digests(packing.pack(docs, _tokenizer()))


def op5_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return runindex.remove_repeated(docs, carry=["doc_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(_dealt(5) != 0)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (F.coalesce(_dealt(5), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_turns(turns.unionByName(added))).withColumnRenamed("conv", "conv_id")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return spotsigs.against_next(docs).withColumnRenamed("id", "doc_id")


def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = oddsketch.near_duplicates(docs, k=3, threshold=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    mixed = balance.mix_sources(docs, carry=["doc_id"])
    return mixed.select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piecetable.fill_in_middle(read(spark, sf_dir, "documents", "doc_id", "text"))
    back = piecetable.restore(made, carry=["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"])
    return back.drop("restored").withColumnRenamed("id", "doc_id")


def op12_tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = treeweights.score(docs, train=_dealt(10) != 0, carry=["doc_id"])
    held_out = (F.coalesce(_dealt(10), F.lit(-1)) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return whitening.whiten(vectors).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_robust_outliers, op3_language_id, op4_packing, op5_run_index, op6_toxicity, op7_chat_format, op8_spotsigs, op9_odd_sketches, op10_mixing, op11_piece_table, op12_tree_weights, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return oracles()
