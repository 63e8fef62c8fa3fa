"""Exact top-k by integer inner product over a bit-sliced index.

Each component x becomes the integer floor(scale * x). A block of rows keeps, for every dimension,
one bitmap over its rows per binary digit (of the value less the block's least one). For a
query, digit j of |q_d| adds the slices of dimension d shifted by j (their complements where q_d is
negative), with carry-save adders on whole bitmaps; the sum is again a number in slices. From
its most significant slice downward the rows that must be in the top k are told from those
that can't be; rows that still tie at the end are resolved by id. Scores are read off the
sum's slices, so they are exact.

Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part.
A missing component (shorter vector) counts as zero; values beyond 2**31 saturate. Rows with the
query's own id are no candidates of it; where rows share a query's id, the least usable vector is the
query, so an id is asked once. Ties go to the smaller id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import U64, keep

BLOCK, QUERIES = 16_384, 256


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers of the usable vectors (rows x dimensions), and which rows these are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    usable = ~np.asarray(column.is_null())
    usable[row[~np.isfinite(values)]] = False
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(column), dims))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.nan_to_num(values, posinf=0, neginf=0)
    return np.clip(np.floor(scale * out[usable]), -(2**31), 2**31 - 1).astype(np.int64), usable


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slices (dimensions x digits x words), least values, digits per dimension."""
    n, dims = x.shape
    low = x.min(axis=0) if n else np.zeros(dims, np.int64)
    y = x - low
    width = np.array([int(v).bit_length() for v in (y.max(axis=0) if n else low)], np.int64)
    words = -(-n // 64)
    out = np.zeros((dims, int(width.max(initial=0)), words), U64)
    for b in range(out.shape[1]):
        bits = np.packbits((y >> b & 1).astype(bool), axis=0, bitorder="little")
        padded = np.zeros((words * 8, dims), np.uint8)
        padded[: len(bits)] = bits
        out[:, b] = np.ascontiguousarray(padded.T).view("<u8")
    return out, low, width


def add_slices(by_weight: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps, each weighing 2**weight per row: slices of the sum, least significant first."""
    out = []
    w = 0
    while by_weight:
        if w not in by_weight:
            out.append(None)
            w += 1
            continue
        stack = by_weight.pop(w)
        while len(stack) > 1:
            t = len(stack) // 3
            if t:
                a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
                half = a ^ b
                carry = (a & b) | (c & half)
                rest = stack[3 * t :]
                stack = np.concatenate((half ^ c, rest)) if len(rest) else half ^ c
            else:
                carry = (stack[0] & stack[1])[None]
                stack = (stack[0] ^ stack[1])[None]
            by_weight[w + 1] = np.concatenate((by_weight[w + 1], carry)) if w + 1 in by_weight else carry
        out.append(stack[0])
        w += 1
    return out


def score_slices(slices: np.ndarray, flipped: np.ndarray, low: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[list, int]:
    """Slices of the rows' scores, and what is to be added to each."""
    used = min(len(q), len(width))
    dims, shifts, flip = [], [], []
    base = 0
    for d in range(used):
        v = int(q[d])
        base += v * int(low[d])
        if v < 0:
            base += v * ((1 << int(width[d])) - 1)
        for j in range(abs(v).bit_length()):
            if abs(v) >> j & 1:
                dims.append(d)
                shifts.append(j)
                flip.append(v < 0)
    if not dims:
        return [], base
    dims, shifts, flip = np.array(dims), np.array(shifts), np.array(flip)
    digits = width[dims]
    which = np.repeat(np.arange(len(dims)), digits)
    digit = np.arange(len(which)) - np.repeat(np.cumsum(digits) - digits, digits)
    weight = shifts[which] + digit
    deep = slices.shape[1]
    index = dims[which] * deep + digit + np.where(flip[which], slices.shape[0] * deep, 0)
    both = np.concatenate((slices, flipped)).reshape(-1, slices.shape[2]) if flipped.ndim == 3 else flipped
    return add_slices({int(w): both[index[weight == w]] for w in np.unique(weight)}), base


def top_rows(slices: list, allowed: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best rows of the allowed ones; ties go to the smaller id."""
    sure, maybe = np.zeros_like(allowed), allowed
    for s in reversed(slices):
        if s is None:
            s = np.zeros_like(allowed)
        tried = sure | (maybe & s)
        n = int(np.bitwise_count(tried).sum())
        if n > k:
            maybe = maybe & s
        else:
            sure, maybe = tried, maybe & ~s
            if n == k:
                break
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    got = rows(sure)
    if len(got) < k:
        tied = rows(maybe)
        more = k - len(got)
        if len(tied) > more:
            tied = tied[np.argpartition(ids[tied], more - 1)[:more]]
        got = np.concatenate((got, tied))
    return got


def scores_of(slices: list, base: int, rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), base, np.int64)
    for w, s in enumerate(slices):
        if s is not None:
            out += ((s[rows >> 6] >> (rows & 63).astype(U64)) & U64(1)).astype(np.int64) << w
    return out


def index(vectors: DataFrame, scale: int, blocks: int) -> DataFrame:
    """One row per block: block, ids, slices, low, width (packed). vectors: vec_id, embedding."""

    def run(stream):
        ids, parts = [], []
        for batch in stream:
            x, usable = quantised(batch.column("embedding"), scale)
            ids.append(batch.column("vec_id").to_numpy()[usable])
            parts.append(x)
        if sum(map(len, ids)):
            x = np.zeros((sum(map(len, parts)), max(p.shape[1] for p in parts)), np.int64)
            lo = 0
            for p in parts:
                x[lo : lo + len(p), : p.shape[1]] = p
                lo += len(p)
            s, low, width = build(x)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (np.concatenate(ids).astype(np.int64), s, low, width)], names=["ids", "slices", "low", "width"])

    packed = vectors.repartition(blocks).mapInArrow(run, "ids binary, slices binary, low binary, width binary")
    return packed.withColumn("block", F.spark_partition_id())


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query (ids divisible by every)."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("embedding")).filter("vec_id is not null and embedding is not null")
    blocks = max(1, -(-v.count() // BLOCK))
    built = keep(index(v, scale, blocks), "slices")
    # Queries in chunks, a copy of each chunk for every block: all queries meet all rows, in blocks.
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = v.filter((F.col("vec_id") % every == 0) & finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    chunks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // QUERIES)))).alias("chunk")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    met = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(built, "block")

    def run(stream):
        for batch in stream:
            for row in range(batch.num_rows):
                ids, s, low, width = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("ids", np.int64), ("slices", U64), ("low", np.int64), ("width", np.int64)))
                words, deep = -(-len(ids) // 64), int(width.max(initial=0))
                s = s.reshape(len(width), deep, words)
                both = np.concatenate((s, ~s)).reshape(-1, words)
                every_row = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
                queries = batch.column("queries")[row].values
                q, usable = quantised(queries.field("embedding"), scale)
                out = [[], [], []]
                for qid, vec in zip(queries.field("vec_id").to_numpy()[usable].tolist(), q, strict=True):
                    allowed = every_row.copy()
                    own = np.flatnonzero(ids == qid)
                    np.bitwise_and.at(allowed, own >> 6, ~(U64(1) << (own & 63).astype(U64)))
                    total, base = score_slices(s, both, low, width, vec)
                    got = top_rows(total, allowed, ids, k)
                    out[0].append(np.full(len(got), qid))
                    out[1].append(ids[got])
                    out[2].append(scores_of(total, base, got))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = met.select("ids", "slices", "low", "width", "queries").mapInArrow(run, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
