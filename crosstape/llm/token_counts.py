"""Token counts through a digest cache.

Key: digest of the normalised content (null becomes the empty string; anything more would
change the count) and digest of the tokenizer's version (its file's bytes and the settings).
Contents whose key is stored are not encoded again; each distinct miss is encoded once and
appended to the cache as new Parquet files in the shared folder.

Null and empty texts count 0 tokens. Every row gets its count, repeated ones too. Extra
columns are ignored. An empty table gives no rows and appends none.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import documents
from .pieces import Pieces, batches, encode_chunks, tokenizer, worker_cache

CACHE_SCHEMA = "content_digest binary, version_digest string, n_tokens long"


def version_digest(tokenizer_path: str) -> str:
    import tokenizers

    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{tokenizers.__version__}|no added tokens, no truncation".encode()).hexdigest()


def _digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def stored(spark, cache_path: str) -> DataFrame:
    """The cache so far; an empty one if nothing was ever appended."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_counts(distinct: DataFrame, tokenizer_path: str) -> DataFrame:
    """content_digest, n_tokens of the texts given."""

    def run(stream):
        tok = tokenizer(tokenizer_path)
        cache = worker_cache(("counts", tokenizer_path), lambda: Pieces(lambda texts: [len(x) // 4 for x in encode_chunks(tok, texts)]))
        for batch in stream:
            counts: list[int] = []
            for _, texts in batches([t or "" for t in batch.column("text").to_pylist()]):
                cut = [Pieces.chunks(t) for t in texts]
                cache.fill(cut)
                counts += [sum(map(cache.__getitem__, c)) for c in cut]
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return distinct.mapInArrow(run, "content_digest binary, n_tokens long")


def _version(cache_path: str, version: str, spark) -> DataFrame:
    return stored(spark, cache_path).filter(F.col("version_digest") == version)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest(F.col("text")).alias("content_digest"))


def append_misses(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each distinct content that the cache doesn't hold, once, and append its count."""
    version = version_digest(tokenizer_path)
    before = _version(cache_path, version, docs.sparkSession).select("content_digest")
    misses = _read(docs, id_col, text_col).select("content_digest", "text").join(before, "content_digest", "left_anti").groupBy("content_digest").agg(F.first("text").alias("text"))
    fresh = encode_counts(misses, tokenizer_path).withColumn("version_digest", F.lit(version))
    fresh.select("content_digest", "version_digest", "n_tokens").write.mode("append").parquet(cache_path)


def look_up(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored counts of documents whose contents the cache holds.

    Two appends at once may store a key twice, so the read takes one count per key."""
    known = _version(cache_path, version_digest(tokenizer_path), docs.sparkSession).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = _read(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    return rows.join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    append_misses(docs, tokenizer_path, cache_path, id_col, text_col)
    return look_up(docs, tokenizer_path, cache_path, limit, id_col, text_col)


def count_in_batches(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """count_tokens of a table that comes in two batches, the upper half of its ids first: the second batch meets what
    the first has stored, and only contents that it alone holds are encoded then. Rows without an id come second."""
    key = docs[id_col].cast("long")
    low, high = docs.agg(F.min(key), F.max(key)).first()
    upper = F.coalesce(key > F.lit(0 if low is None else (low + high) // 2), F.lit(False))
    for batch in (docs.filter(upper), docs.filter(~upper)):
        append_misses(batch, tokenizer_path, cache_path, id_col, text_col)
    return look_up(docs, tokenizer_path, cache_path, limit, id_col, text_col)
