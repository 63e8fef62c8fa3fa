"""The registered queries of this package and their check statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audio, bitsliced, byte_pieces, collocations, digest_index, dual_tree, langid, line_templates, ngram_orders, packing, suffix_dedup, token_counts, url_filter
from .columns import read, scratch


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, end_id=1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(read(spark, sf_dir, "documents"))


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op5_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_columns(read(spark, sf_dir, "documents"), with_media=False)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=100, with_kept=False)


def op8_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op9_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_in_batches(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-counts"), limit=512)


def op10_ngram_orders_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_orders.similarity_components(read(spark, sf_dir, "documents"), k=5, threshold=75).select("doc_id", "n_shingles", "component_id")


def op11_misra_gries_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), min_count=10, max_words=3, top=2000, inside_percent=50)


def op12_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicate(read(spark, sf_dir, "documents"), scratch(spark, "digest-index"))


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_power_of_two_packing,
        op2_line_templates,
        op3_url_vocabulary,
        op4_bit_sliced_top_k,
        op5_byte_gru_language,
        op6_audio_features,
        op7_suffix_array_dedup,
        op8_byte_pieces,
        op9_digest_cache_counts,
        op10_ngram_orders_join,
        op11_misra_gries_collocations,
        op12_digest_index_dedup,
        op13_dual_tree_search,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_line_templates": line_templates.ORACLE, "op3_url_vocabulary": url_filter.oracle(), "op4_bit_sliced_top_k": bitsliced.ORACLE, "op11_misra_gries_collocations": collocations.ORACLE, "op12_digest_index_dedup": digest_index.ORACLE, "op13_dual_tree_search": dual_tree.ORACLE}
