"""Small helpers shared by the operators: input columns, flat text buffers, mixing of 64-bit words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstape.session import shared_dir

U64 = np.uint64


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only the columns an operator reads, under its own names: extra or clashing ones never reach it."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(c.alias(k) for k, c in more.items()))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark, name: str) -> str:
    """A fresh path in the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values end to end, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]] if len(at) else raw[:0]), (at - at[0] if len(at) else np.zeros(1, np.int64))


def slices(column: pa.Array, most_bytes: int):
    """Row ranges of a batch that hold about most_bytes of text each, so working memory doesn't follow the batch."""
    _, at = flat(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most_bytes, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = min(hi, len(column))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit word over all its bits (two multiply and shift rounds)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: later steps start from files that
    survive a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
