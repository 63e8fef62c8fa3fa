"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / max_len) pieces of max_len tokens and one piece for
each set bit of the rest, largest first. Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding; equal lengths form a bucket.

Empty and null texts hold the end token alone: one piece of length 1. Each row is packed as a
document of its own, so repeated rows and repeated or null ids are packed as often as they
stand there. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import documents, flat, slices
from .pieces import ChunkIds, chunk_starts, encode_chunks, gathered, tokenizer, worker_cache

#: Text bytes packed together.
SLICE = 8 << 20


def piece_lengths(n: int, max_len: int) -> list[int]:
    """max_len as often as it fits, then the binary digits of the rest, largest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece_lengths of many documents: the document, the start in it and the length of every piece, in order."""
    whole, rest = n // max_len, n % max_len
    count = whole + np.bitwise_count(rest).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(doc), max_len)
    left, step = rest[doc], nth - whole[doc]
    for b in range(max_len.bit_length() - 2, -1, -1):
        here = (left >> b & 1 == 1) & (step >= 0)
        length[here & (step == 0)] = 1 << b
        step -= here
    upto = np.cumsum(length)
    return doc, upto - length - (np.cumsum(n) - n)[doc], length


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length), ids
    (with_ids), sequence_id, offset. No shuffle: sequence ids come from the partition and the row in it,
    and a task that is run again numbers its rows as before."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids

    def run(stream):
        tok = tokenizer(tokenizer_path)
        cache = worker_cache(("chunk ids", tokenizer_path, end_id), lambda: ChunkIds(lambda texts: encode_chunks(tok, texts), end_id))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"] + ["ids"] * with_ids
        for batch in stream:
            for lo, hi in slices(batch.column("text"), SLICE):
                data, at = flat(batch.column("text").slice(lo, hi - lo))
                starts = chunk_starts(data, at)
                chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
                held = cache.rows(chunks.dictionary.to_pylist())
                # The end id (row 0) behind the last chunk of each document.
                rows = np.insert(held[chunks.indices.to_numpy()] if len(held) else held, np.searchsorted(starts, at[1:]), 0)
                entry, size = gathered(cache.at, rows)
                ids = cache.ids[entry]
                ends = np.cumsum(size)[np.flatnonzero(rows == 0)]
                n = np.diff(ends, prepend=0)
                doc, start, length = cut(n, max_len)
                bounds = np.concatenate(([0], np.cumsum(length)))
                view, at4 = memoryview(ids.astype("<u4").tobytes()), (4 * bounds).tolist()
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at4[:-1], at4[1:], strict=True)]
                keys = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc))
                bucket = np.bitwise_count(length - 1).astype(np.int32)
                columns = [keys, *(pa.array(c, pa.int64()) for c in (start, length, crc, n[doc])), pa.array(bucket)]
                yield pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))] * with_ids, names=names)

    made = documents(docs, id_col, text_col).mapInArrow(run, schema)
    return made.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder per bucket: a loader reads sequences of one length without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
