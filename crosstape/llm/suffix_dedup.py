"""Removal of byte strings that also start earlier in the corpus, by suffix arrays per shard.

Every byte that lies in a string of `length` bytes which also starts earlier (smaller doc_id, or
the same document at an earlier place) goes. Strings are judged on the input; they never
cross documents.

1. anchors: the least 32-gram hash of each window (a string of `length` bytes). Equal windows
   have equal least hashes, so a window whose hash stands in one place only is unique. Runs of
   windows with one hash travel as (hash, digest of the run's bytes, place), packed by hash range.
2. runs: of runs with equal bytes all but the first repeat it as a whole. First ones whose hash
   other runs share, or in which the hash stands twice, are open; of these only the windows
   whose bytes on one side of the hashed gram (half of the rest) another run holds there too.
3. shards: documents are dealt to shards by id. A shard sorts the suffixes of its open
   stretches (Larsson and Sadakane), takes common prefixes (Kasai) and so finds windows that
   repeat inside it. The first of each class leaves for the merge as a sorted run of digests, cut
   by digest range.
4. merge: each range merges the shards' sorted runs pair by pair by binary search; the
   earlier place wins.
5. removal: the shard's texts lose what is covered.

Groups are a range or a shard, as many as spark.sql.shuffle.partitions, so the session sets their
size. A hash, passage or document that very many rows hold adds one packed entry of some 20
bytes for each run to its range, and one window to its shard.

Null and empty texts, and texts under `length` bytes, lose nothing. Rows with the same doc_id and
text are one document (each row gets its result); rows with one doc_id and different texts are
ordered by a 64-bit hash of the text; a null doc_id comes before all others. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import U64, documents, flat, mix, slices, text_key
from .suffix_arrays import common_prefixes, merge_runs, suffix_array, window_digests, words_at

GRAM = 32
#: Text handled at once, and runs held before they are sent.
CHUNK, FLUSH = 500_000, 500_000
#: Windows in one run at most (longer runs are cut; their parts share the hash).
RUN = 30_000
#: No place of the gram is known.
TWICE = 255
NO_ID = -(2**63)


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over every width neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def runs_of(data: np.ndarray, at: np.ndarray, length: int):
    """For each run of windows with one least hash: hash, place in data, windows, and how far into
    the run its gram starts (TWICE if it may stand there more than once)."""
    n, wide = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U64), none, none, none
    w = words_at(data)
    h = w[: n - GRAM + 1] * U64(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h += w[k : k + len(h)] * U64(c)
    h ^= h >> U64(32)
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(29)
    least = _sliding(np.minimum, h, wide)
    step = np.zeros(n + 1, np.int32)
    ends = at[1:]
    np.add.at(step, np.maximum(ends - (length - 1), at[:-1]), 1)
    np.add.at(step, ends, -1)
    start = np.flatnonzero(np.cumsum(step[: n - length + 1]) == 0)  # windows inside one document
    if not len(start):
        return none.astype(U64), none, none, none
    m = least[start]
    new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.append(new, len(start)))
    if (count > RUN).any():
        parts = -(-count // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        new = np.repeat(new, parts) + nth * RUN
        count = np.diff(np.append(new, len(start)))
    place, m = start[new], m[new]
    last = place + count - 1
    # Places where some window has its least hash. Every run holds its gram behind the start of its last window.
    most = _sliding(np.maximum, np.concatenate((np.zeros(wide - 1, U64), least, np.zeros(wide - 1, U64))), wide)
    minima = np.flatnonzero(h == most)
    k = np.searchsorted(minima, last)
    seek = np.arange(len(k))
    while len(seek := seek[h[minima[k[seek]]] != m[seek]]):
        k[seek] += 1
    into = minima[k] - place
    # Neighbouring minima with one hash make a run suspect.
    twice = np.flatnonzero(h[minima[1:]] == h[minima[:-1]])
    if len(twice):
        one, two = minima[twice], minima[twice + 1]
        k = np.searchsorted(one, place)
        ok = np.flatnonzero(k < len(one))
        into[ok[two[k[ok]] <= last[ok] + wide - 1]] = TWICE
    into[into > TWICE] = TWICE
    return mix(m), place, count, into  # least hashes crowd near zero; mixed, they fall evenly into ranges


class Places:
    """Packed (document, start, windows) entries with any number of further columns."""

    @staticmethod
    def pack(doc: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray, keys: np.ndarray, *more: np.ndarray) -> bytes:
        used, local = np.unique(doc, return_inverse=True)
        head = struct.pack("<II", len(doc), len(used))
        # Halves apart: the upper ones are mostly zero and compress away.
        halves = [(x >> k & 0xFFFF).astype("<u2").tobytes() for x in (local, start) for k in (0, 16)]
        return b"".join([head, *halves, count.astype("<u2").tobytes(), ids[used].astype("<i8").tobytes(), keys[used].astype("<i8").tobytes(), *(x.tobytes() for x in more)])

    @staticmethod
    def unpack(raw: bytes, *kinds: str):
        m, d = struct.unpack_from("<II", raw)
        at, out = 8, []
        for kind, size in (*[("<u2", m)] * 5, ("<i8", d), ("<i8", d), *((k, m) for k in kinds)):
            out.append(np.frombuffer(raw, kind, size, at))
            at += out[-1].nbytes
        l0, l1, s0, s1, count, ids, keys, *more = out
        local, start = l0 | l1.astype(np.int64) << 16, s0 | s1.astype(np.int64) << 16
        return (ids[local], keys[local], start, count.astype(np.int64), *more)

    @staticmethod
    def gather(blobs, *kinds: str):
        parts = [Places.unpack(b, *kinds) for b in blobs]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _document_ranks(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each entry's document by (doc_id, key), and the documents' ids and keys by rank."""
    by = np.lexsort((keys, ids))
    i, k = ids[by], keys[by]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (k[1:] != k[:-1]))) if len(by) else np.zeros(0, bool)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank, i[new], k[new]


def _shard(ids: np.ndarray, keys: np.ndarray, shards: int) -> np.ndarray:
    return (ids % shards + keys % shards) % shards


def _by_shard(kind: int, rank, start, count, ids, keys, shards: int):
    """One packed row per shard: (shard, kind, entries)."""
    to = _shard(ids, keys, shards)[rank] if len(rank) else rank
    by = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[by], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        w = by[cuts[s] : cuts[s + 1]]
        yield int(s), kind, Places.pack(rank[w], start[w], count[w], ids, keys)


def _joined(rank: np.ndarray, start: np.ndarray):
    """Single windows as runs of neighbours."""
    by = np.lexsort((start, rank))
    rank, start = rank[by], start[by]
    if not len(rank):
        return rank, start, start
    new = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (start[1:] != start[:-1] + 1) | (np.arange(1, len(rank)) % RUN == 0))))
    return rank[new], start[new], np.diff(np.append(new, len(rank)))


def _side(length: int) -> int:
    """Every window holds so many bytes on one side of its gram at least."""
    return (length - GRAM) // 2


def _sides(data: np.ndarray, place: np.ndarray, into: np.ndarray, side: int) -> np.ndarray:
    """16-bit digests of the bytes left and right of each gram (those outside the data count as zero)."""
    padded = np.concatenate((np.zeros(side, np.uint8), data, np.zeros(side + TWICE, np.uint8)))
    word = words_at(padded)
    gram = place + into + side
    out = []
    for lo in (gram - side, gram + GRAM):
        h = np.zeros(len(lo), U64)
        for k in [*range(0, side - 8, 8), side - 8]:
            h = (h ^ word[lo + k]) * U64(0x9FB21C651E98DF25)
            h ^= h >> U64(29)
        out.append((mix(h) >> U64(48)).astype("<u2"))
    return np.stack(out)


def _shared(group: np.ndarray, side: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of the chosen entries: those whose side another chosen entry of the group has too."""
    out = np.zeros(len(group), bool)
    key = group[chosen] << np.int64(16) | side[chosen]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    out[chosen] = times[back] > 1
    return out


def anchors(docs: DataFrame, length: int, ranges: int) -> DataFrame:
    """part, entries: packed runs by hash range."""

    def run(stream):
        held: list[list] = [[] for _ in range(7)]
        held_ids, held_keys = [], []
        size = docs_held = 0

        def out():
            h, place, count, into, digest, sides, doc = (np.concatenate(c, axis=-1) for c in held)
            ids, keys = np.concatenate(held_ids), np.concatenate(held_keys)
            by = np.argsort(h)
            part = ((h[by] >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            low = (h & U64(0xFFFFFFFF)).astype("<u4")
            rows = []
            for r in np.flatnonzero(np.diff(cuts)):
                w = by[cuts[r] : cuts[r + 1]]
                rows.append((int(r), Places.pack(doc[w], place[w], count[w], ids, keys, low[w], digest[w].astype("<u4"), (digest[w] >> U64(32)).astype("<u2"), into[w].astype("u1"), sides[0][w], sides[1][w])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "entries"])

        for batch in stream:
            for lo, hi in slices(batch.column("text"), CHUNK):
                data, at = flat(batch.column("text")[lo:hi])
                h, place, count, into = runs_of(data, at, length)
                if len(h):
                    view = memoryview(data)
                    digest = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(place.tolist(), (place + count + length - 1).tolist(), strict=True)], U64)
                    doc = np.searchsorted(at, place, "right") - 1
                    for c, x in zip(held, (h, place - at[doc], count, into, digest, _sides(data, place, into, _side(length)), doc + docs_held), strict=True):
                        c.append(x)
                    held_ids.append(batch.column("doc_id")[lo:hi].to_numpy())
                    held_keys.append(batch.column("key")[lo:hi].to_numpy())
                    docs_held += hi - lo
                    size += len(h)
                if size > FLUSH:
                    yield out()
                    for c in (*held, held_ids, held_keys):
                        c.clear()
                    size = docs_held = 0
        if size:
            yield out()

    return docs.select("doc_id", "key", "text").mapInArrow(run, "part int, entries binary")


def runs(packed: DataFrame, length: int, shards: int) -> DataFrame:
    """shard, kind, entries: kind 0 are runs that repeat an earlier one, kind 1 open ones."""

    half = _side(length)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, keys, start, count, h, d0, d1, into, left, right = Places.gather(pdf["entries"], "<u4", "<u4", "<u2", "u1", "<u2", "<u2")
        # Of a hash that stands once, nothing is left to decide.
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        more = (times[back] > 1) | (into == TWICE)
        digest = d0[more] | d1[more].astype(np.int64) << 32
        ids, keys, start, count, h, into, left, right = (x[more] for x in (ids, keys, start, count, h, into, left, right))
        rank, doc_ids, doc_keys = _document_ranks(ids, keys)
        by = np.lexsort((start, rank, digest, h))
        rank, start, count, h, digest, into, left, right = (x[by] for x in (rank, start, count, h, digest, into.astype(np.int64), left, right))
        if not len(h):
            return pd.DataFrame({"shard": [], "kind": [], "entries": []})
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        lead = new_h | np.concatenate(([True], digest[1:] != digest[:-1]))
        group = np.cumsum(new_h) - 1
        again = np.concatenate(([False], (rank[1:] == rank[:-1]) & (start[1:] == start[:-1])))  # a repeated row
        # A window holds half bytes or more on one side of its gram: those up to `turn` on the left.
        turn = np.clip(into - half + 1, 0, count)
        vague = np.zeros(len(h), bool)
        vague[np.isin(group, group[lead & (into == TWICE)])] = True
        kinds = np.bincount(group, lead)
        vague &= lead & ((kinds[group] > 1) | (into == TWICE))
        lower = (lead & (turn > 0) & _shared(group, left, lead & (turn > 0))) | vague
        upper = (lead & (turn < count) & _shared(group, right, lead & (turn < count))) | vague
        lo, hi = np.where(lower, 0, turn), np.where(upper, count, turn)
        is_open = (lower | upper) & (hi > lo)
        rows = list(_by_shard(0, rank[~lead & ~again], start[~lead & ~again], count[~lead & ~again], doc_ids, doc_keys, shards))
        rows += _by_shard(1, rank[is_open], (start + lo)[is_open], (hi - lo)[is_open], doc_ids, doc_keys, shards)
        return pd.DataFrame(rows, columns=["shard", "kind", "entries"])

    return packed.groupBy("part").applyInPandas(settle, "shard int, kind int, entries binary")


class Shard:
    """The texts of a shard in document order, one after the other."""

    def __init__(self, table: pa.Table):
        ids, keys = table.column("doc_id").to_numpy(), table.column("key").to_numpy().astype(np.int64)
        self.rows = np.lexsort((keys, ids))
        self.ids, self.keys = ids[self.rows], keys[self.rows]
        self.data, self.at = flat(table.column("text").take(pa.array(self.rows)))

    def where(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The first row of each document."""
        rank, i, k = _document_ranks(np.concatenate((self.ids, ids)), np.concatenate((self.keys, keys)))
        first = np.full(len(i), len(self.ids), np.int64)
        np.minimum.at(first, rank[: len(self.ids)], np.arange(len(self.ids)))
        return first[rank[len(self.ids) :]]


def _cover(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in [lo, hi) of some entry. One byte a place: overlaps are joined first."""
    step = np.zeros(n + 1, np.int8)
    if len(lo):
        by = np.argsort(lo, kind="stable")
        lo, hi = lo[by], np.maximum.accumulate(hi[by])
        new = np.concatenate(([True], lo[1:] > hi[:-1]))
        step[lo[new]] = 1
        step[hi[np.concatenate((new[1:], [True]))]] = -1
    return np.cumsum(step[:n], dtype=np.int8).view(bool)


def shards(docs: DataFrame, settled: DataFrame, length: int, count_of: int) -> DataFrame:
    """shard, kind, entries: kind 0 repeated windows (runs of them), kind 2 the first windows of the
    shard's classes, sorted by digest; the latter under the number count_of + digest range."""

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [(s, 0, e) for s, k, e in zip(*(right.column(c).to_pylist() for c in ("shard", "kind", "entries")), strict=True) if k == 0]
        blobs = [e for k, e in zip(right.column("kind").to_pylist(), right.column("entries").to_pylist(), strict=True) if k == 1]
        if blobs:
            shard = Shard(left)
            ids, keys, start, windows = Places.gather(blobs)
            place = shard.at[shard.where(ids, keys)] + start
            n = len(shard.data)
            mine = _cover(place, place + windows, n)  # where open windows start
            stretch = _cover(place, place + windows + length - 1, n)
            to_flat = np.flatnonzero(stretch)
            data, valid = shard.data[to_flat], mine[to_flat]
            order = suffix_array(data, length)
            same = common_prefixes(data, order, length) >= length
            cls = np.cumsum(~same, dtype=np.int32) - 1
            least = np.full(cls[-1] + 1, len(data), np.int32)
            usable = valid[order]
            np.minimum.at(least, cls[usable], order[usable])
            del order, same, cls, usable
            first = np.zeros(len(data), bool)
            first[least[least < len(data)]] = True
            doc_of = lambda at: np.searchsorted(shard.at, at, "right") - 1
            again = to_flat[valid & ~first]
            doc = doc_of(again)
            rank, s, c = _joined(doc, again - shard.at[doc])
            rows += _by_shard(0, rank, s, c, shard.ids, shard.keys, count_of)
            own = np.flatnonzero(first)
            one, two = window_digests(data, own, length)
            by = np.argsort(one)
            one, two, own = one[by], two[by], to_flat[own[by]]
            doc = doc_of(own)
            offset = own - shard.at[doc]
            # Cut the sorted run at the range bounds by binary search.
            bounds = np.array([(k << 64) // count_of for k in range(1, count_of)], U64)
            cuts = np.concatenate(([0], np.searchsorted(one, bounds), [len(one)]))
            for r in np.flatnonzero(np.diff(cuts)):
                w = slice(cuts[r], cuts[r + 1])
                rows.append((count_of + int(r), 2, Places.pack(doc[w], offset[w], np.ones(cuts[r + 1] - cuts[r]), shard.ids, shard.keys, one[w], two[w].astype("<u2"))))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "entries": pa.array([r[2] for r in rows], pa.binary())})

    return docs.groupBy("shard").cogroup(settled.groupBy("shard")).applyInArrow(sort, "shard int, kind int, entries binary")


def merge(found: DataFrame, count_of: int) -> DataFrame:
    """shard, entries: all repeated windows, those of kind 0 as they came and those that lost in a merge."""

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < count_of:
            return pdf[["shard", "entries"]]
        parts = [Places.unpack(e, "<u8", "<u2") for e in pdf["entries"]]
        ids, keys = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        rank, doc_ids, doc_keys = _document_ranks(ids, keys)
        sorted_runs, lo = [], 0
        for p in parts:
            sorted_runs.append((p[4], p[5], rank[lo : lo + len(p[0])] << np.int64(32) | p[2]))
            lo += len(p[0])
        lost = [np.zeros(0, np.int64)]
        while len(sorted_runs) > 1:
            half = []
            for a, b in zip(sorted_runs[::2], sorted_runs[1::2], strict=False):
                merged, out = merge_runs(a, b)
                half.append(merged)
                lost.append(out)
            sorted_runs = half + sorted_runs[len(sorted_runs) & ~1 :]
        gone = np.concatenate(lost)
        r, s, c = _joined(gone >> np.int64(32), gone & np.int64(0xFFFFFFFF))
        rows = [(s_, e) for s_, _, e in _by_shard(0, r, s, c, doc_ids, doc_keys, count_of)]
        return pd.DataFrame(rows, columns=["shard", "entries"])

    return found.groupBy("shard").applyInPandas(settle, "shard int, entries binary")


def removal(docs: DataFrame, gone: DataFrame, length: int, with_kept: bool | str) -> DataFrame:
    extra = [f for f in docs.schema.fields if f.name not in ("doc_id", "key", "text", "shard", "id_null")]
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + {False: "", True: ", kept binary, spans array<struct<start:long,length:long>>", "text": ", kept_text string"}[with_kept])
    schema = T.StructType([*schema.fields, *extra])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left)
        n = len(shard.data)
        lo = hi = np.zeros(0, np.int64)
        if right.num_rows:
            ids, keys, start, windows = Places.gather(right.column("entries").to_pylist())
            place = shard.at[shard.where(ids, keys)] + start
            lo, hi = place, place + windows + length - 1
        covered = _cover(lo, hi, n)
        # Rows of one document share its result: copy the cover of its first row.
        first = shard.where(shard.ids, shard.keys)
        for r in np.flatnonzero(first != np.arange(len(first))):
            covered[shard.at[r] : shard.at[r + 1]] = covered[shard.at[first[r]] : shard.at[first[r] + 1]]
        view, stats, kept, spans = shard.data, [], [], []
        for a, b in zip(shard.at[:-1], shard.at[1:], strict=True):
            c = covered[a:b]
            if c.any():
                raw = view[a:b][~c].tobytes()
                edge = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0]))))
            else:
                raw, edge = view[a:b].tobytes(), np.zeros(0, np.int64)
            stats.append((b - a, b - a - len(raw), len(edge) // 2, hashlib.sha256(raw).hexdigest()))
            if with_kept == "text":
                kept.append(raw.decode("utf-8", "ignore"))
            elif with_kept:
                kept.append(raw)
                spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        rows = left.combine_chunks().take(pa.array(shard.rows))
        null = rows.column("id_null").to_numpy()
        out = {"doc_id": pa.array(shard.ids, pa.int64(), mask=null)}
        for i, name in enumerate(("n_bytes", "n_removed", "n_spans")):
            out[name] = pa.array([int(s[i]) for s in stats], pa.int64())
        out["kept_sha256"] = pa.array([s[3] for s in stats], pa.string())
        if with_kept == "text":
            out["kept_text"] = pa.array(kept, pa.string())
        elif with_kept:
            out["kept"] = pa.array(kept, pa.binary())
            out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        return pa.table(out | {f.name: rows.column(f.name) for f in extra})

    return docs.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(cut, schema)


def remove_repeats(docs: DataFrame, length: int = 100, with_kept: bool | str = True, id_col: str = "doc_id", text_col: str = "text", **carried) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, the kept bytes and the
    removed spans, or with_kept="text" the kept bytes as kept_text (a character that lost some of its
    bytes goes). carried: further columns, by name, to hand through."""
    if length < GRAM + 16:
        raise ValueError(f"length must be at least {GRAM + 16}")
    spark = docs.sparkSession
    count_of = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = documents(docs, id_col, text_col, **carried).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("id_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("key", text_key(F.col("text")))
    n = F.lit(count_of)
    d = d.withColumn("shard", F.pmod(F.pmod("doc_id", n) + F.pmod("key", n), n).cast("int"))
    settled = runs(anchors(d, length, count_of), length, count_of)
    found = shards(d, settled, length, count_of)  # both groupings of d share one exchange
    return removal(d, merge(found, count_of), length, with_kept)
