"""The corpus pipeline: toxicity, near duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which has the columns of
``documents`` and possibly more; all but the last return these columns. ``run`` writes each
stage's result to the shared folder and reads it back for the next one.

Defined cases: rows with a null text stay (as empty documents for the last stages); rows without
a doc_id take no part in near-duplicate search and stay; rows of equal doc_id count as one document
there and one of them stays; an empty table gives no rows. Each operator states its own cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import balance, oddsketch, packing, runindex, toxicity
from spanweave.llm.tables import keep, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents with a toxicity score of 0.5 or more."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model, carry=["_row"])
    return scored.where("score < 0.5").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group (five-word shingles, similarity 0.8)."""
    named = docs.where(F.col("doc_id").isNotNull())
    found = oddsketch.near_duplicates(named, k=5, threshold=0.8)
    kept = found.where("id = component_id").select(F.col("id").alias("doc_id"))
    rows = named.select("doc_id", F.struct(*docs.columns).alias("_row")).join(kept, "doc_id", "left_semi")
    one = rows.groupBy("doc_id").agg(F.min("_row").alias("_row")).select("_row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur elsewhere out of the texts; documents stay."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    marked = docs.select("text", "doc_id", F.struct(*others, F.col("text").isNull().alias("_null")).alias("_other"))
    cut = runindex.remove_repeated(marked, carry=["_other"], with_text=True)
    text = F.when(~F.col("_other._null"), F.col("kept_text"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[(made[c] if c in made else F.col(f"_other.{c}")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = balance.mix_sources(docs).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids, each a sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_strings),
    ("mixing", mix),
    ("packing", pack),
]
#: The model, the rounding and the tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
