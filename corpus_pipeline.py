"""Corpus pipeline: language ID, line dedup, near-duplicate join, repeated-passage removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of the documents they were given; a stage that changes a text renews n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstape.llm import langid, line_templates, ngram_orders, packing, suffix_dedup
from crosstape.llm.columns import keep, read, text_key

#: Language ID rejects below this mean probability (four languages by chance: 0.25), and `und`.
MIN_SCORE = 0.35
NO_ID = -(2**63)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null texts, texts without a letter, texts no language fits."""
    model = langid.train(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    told = langid.predict(docs, model, lang_out="_lang_told_here", score_out="_score_told_here")
    return told.filter((F.col("_lang_told_here") != "und") & (F.col("_score_told_here") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first, short ones too (up to three tokens only equal
    lines share a template); a document of which nothing is left goes."""
    cut = line_templates.drop_recurring(docs, dropped_col="_lines_dropped_here", min_tokens=1)
    return _recounted(cut.filter((F.col("_lines_dropped_here") == 0) | (F.trim("text") != "")).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays (one without an id only if none has
    one; ties by the text's key); texts without a word all stay."""
    found = ngram_orders.similarity_components(docs, k=5, threshold=75)
    ident = lambda row, every: [F.coalesce(f"{row}doc_id", F.lit(NO_ID)).alias("_id"), F.col(f"{row}key").alias("_key"), F.lit(every).alias("_all")]
    empty = found.filter("n_shingles = 0").select(*ident("", True))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    first = found.filter("n_shingles > 0").groupBy("component").agg(least.alias("row")).select(*ident("row.", False))
    stays = empty.union(first).distinct()
    keyed = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), text_key(F.col("text").cast("string")).alias("_key"))
    joined = keyed.join(stays, ["_id", "_key"])
    once = joined.filter(~F.col("_all")).dropDuplicates(["_id", "_key"])
    return once.unionByName(joined.filter("_all")).select("_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go; a document of which nothing is left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_c{i}" for i, c in enumerate(rest)}
    cut = suffix_dedup.remove_repeats(docs, length=100, with_kept="text", _null=F.col("text").isNull(), **{names[c]: docs[c] for c in rest})
    cut = cut.filter((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    text = F.when(~F.col("_null"), F.col("kept_text"))
    kinds = dict(docs.dtypes)
    return _recounted(cut.select(*((text if c == "text" else F.col("doc_id") if c == "doc_id" else F.col(names[c])).cast(kinds[c]).alias(c) for c in docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, end_id=1)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", pack),
]

#: Language ID is a trained network, so no SQL gives these rows; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
