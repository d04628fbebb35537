"""Licence scans by diagonal voting, with DataFrame operations only.

Every run of ``K`` consecutive words of every text is hashed and joined to the runs of the
licence templates. A hit of text position i and template position t votes for the diagonal
i - t. Votes are added up per text, template and diagonal; neighbouring diagonals (words
put in or left out) are merged; a span stands if enough of the template's words are
found in it, in a stretch not much longer than the template. A hit counts only if its words are
the template's words, so a clash of hashes cannot vote.

Phrases (``BASE``) must stand exactly: every run on one and the same diagonal. Notices (``NOTICES``)
may differ in some words. Templates are of any length: the words that a diagonal's votes cover are bits
in as many longs as the longest template needs. A template of one word has no run and is looked up by that word.

The join is a broadcast of the templates' runs, a fixed list; only hits are shuffled, by
text. Rows of equal id and text have equal hits, which are counted once.

Defined cases: null and empty texts have no words and no spans; rows of the same id and text
give the same result each; overlapping places of a phrase all count; an empty table gives no
rows; further columns are ignored; a template without a word is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


K = 2
#: Phrase or notice and its label; fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}
#: Diagonals this far apart are merged.
NEIGHBOURS = 2
#: Share of a notice's words that a span must hold.
SIMILARITY = 0.8
#: A span may be this many times as long as its notice.
STRETCH = 1.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), SEPARATORS), "")


def _lengths(*listed: dict[str, str]) -> list[int]:
    lengths = [len([w for w in re.split(SEPARATORS, text) if w]) for texts in listed for text in texts]
    if not all(lengths):
        raise ValueError("a template without a word")
    return lengths


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per run of each template: number, position, words, the template's length, label, exact, hash."""
    listed = [
        F.struct(F.lit(n).alias("nth"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(exact).alias("exact"))
        for exact, texts in ((True, base), (False, notices))
        for n, (text, label) in enumerate(texts.items())
    ]
    none = "array<struct<nth:int,text:string,label:string,exact:boolean>>"
    each = spark.range(1).select(F.explode(F.array(*listed).cast(none)).alias("row")).select("row.*")
    each = each.withColumn("words", _split(F.col("text"))).withColumn("n_template", F.size("words"))
    each = each.select("nth", "label", "exact", "n_template", "words", F.posexplode("words").alias("t", "w0"))
    runs = each.withColumn("w1", F.get("words", F.col("t") + K - 1)).where("w1 is not null or n_template = 1").drop("words")
    return runs.withColumn("run", F.xxhash64("w0", "w1"))


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), _split(text).alias("words"))


def spans(docs: DataFrame, id_col: str, text_col: str, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Verified spans: id, th (hash of the text), label, exact, start, length (in words), score."""
    lengths = _lengths(base, notices)
    known = F.broadcast(templates(docs.sparkSession, base, notices))  # a fixed list
    # The array of words is made once for each text and read in place for each run.
    each = words(docs, id_col, text_col).select("id", "th", "words", F.posexplode_outer("words").alias("i", "word"))
    after = F.get("words", F.col("i") + K - 1)
    runs = each.select("id", "th", "i", "word", after.alias("next"), F.xxhash64("word", after).alias("run"))
    same = (F.col("word") == F.col("w0")) & ((F.col("next") == F.col("w1")) | (F.col("n_template") == 1))
    hits = runs.join(known.where("n_template > 1"), "run").where(same)
    if 1 in lengths:
        single = known.where("n_template = 1").drop("run")
        hits = hits.unionByName(runs.join(single, F.col("word") == F.col("w0")).select(*hits.columns))
    hits = hits.select("id", "th", "exact", "nth", "label", "n_template", "t", F.col("i").cast("long").alias("i"))
    # A run covers its word and the next one; the bits of template words 64 n to 64 n + 63 make up long n.
    longs = [f"covered{n}" for n in range(-(-max(lengths, default=0) // 64))]
    bit = lambda n, at: F.when(F.floor(at / 64) == n, F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    last = F.col("t") + F.least(F.lit(K), F.col("n_template")) - 1
    covers = [F.bit_or(bit(n, F.col("t")).bitwiseOR(bit(n, last))).alias(c) for n, c in enumerate(longs)]
    diagonal = hits.groupBy("id", "th", "exact", "nth", "label", "n_template", (F.col("i") - F.col("t")).alias("diagonal")).agg(
        *covers, F.min("i").alias("low"), F.max("i").alias("high")
    )
    order = Window.partitionBy("id", "th", "exact", "nth").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True)) | F.col("exact")
    merged = diagonal.withColumn("part", F.sum(far.cast("int")).over(order)).groupBy("id", "th", "exact", "nth", "label", "n_template", "part").agg(
        *[F.bit_or(c).alias(c) for c in longs], F.min("low").alias("low"), F.max("high").alias("high")
    )
    covered = sum((F.bit_count(c) for c in longs), F.lit(0))
    length = F.col("high") - F.col("low") + F.least(F.lit(K), F.col("n_template"))
    score = covered / F.greatest(F.col("n_template").cast("long"), F.when(F.col("exact"), length).otherwise(F.ceil(length / F.lit(STRETCH))))
    found = merged.select("id", "th", "label", "exact", F.col("low").alias("start"), length.alias("length"), score.cast("double").alias("score"))
    return found.where(F.when(F.col("exact"), F.col("score") == 1.0).otherwise(F.col("score") >= SIMILARITY))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: n_words, places of phrases, labels, score and the verified spans."""
    found = spans(docs, id_col, text_col, base, notices)
    joined = lambda kinds: F.array_join(F.sort_array(F.collect_set(kinds)), ",")
    exact = F.col("exact")
    per_text = found.groupBy("id", "th").agg(
        F.sum(exact.cast("long")).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).alias("first_word"),
        F.max(F.when(exact, F.col("start"))).alias("last_word"),
        joined(F.when(exact, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.round(F.max("score"), 6).alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "length", "label", "exact", "score"))).alias("spans"),
    )
    counted = words(docs, id_col, text_col).select("id", "th", F.size("words").cast("long").alias("n_words"))
    whole = counted.join(per_text, (counted["id"].eqNullSafe(per_text["id"])) & (counted["th"] == per_text["th"]), "left")
    return whole.select(
        counted["id"], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
