"""N-gram Jaccard join with several global token orders.

Two documents link when the Jaccard similarity of their word-shingle sets is at least
threshold / 100. If |x & y| >= c, the first |x| - c + 1 tokens of x and the first |y| - c + 1 of
y share one, under any order that holds for all documents. So a candidate pair must share a
prefix token under every order used here.

Order 0 carries the inverted lists: ordinary tokens by a mixed hash, then the (at most HEAVY)
most frequent ones, rarest first. That keeps a line or passage that very many documents hold
out of nearly all prefixes. The other orders rank the same two classes by other hashes; they
are tested on the pair before its sets are intersected.

Before a pair's texts are fetched, counts of its tokens in 256 bins give an upper bound of what
the sets share.

Sets that are equal share one digest and are one entity from the start, so exact copies cost
nothing. Large groups of near copies don't become all pairs either: round 1 tests every
entry of a list against the list's centre only (a star), then components are taken;
round 2 tests the pairs of a list that are still in different components, leaving out those
in which both stand in the list's main component. A pair within one component adds nothing
to the result, so no link that matters is lost.

Null and empty texts, and texts without a word, have an empty set, link with nothing and are
their own component. Repeated rows and rows of one doc_id with different texts take part as
they stand; component_id is the least doc_id of the component's rows (null if all are null).
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import U64, documents, flat, keep, mix, slices, text_key
from .components import components
from .shingles import set_digest, shingle_sets

#: Most tokens that can be called frequent: a proven bound on what is sent to the tasks (12 bytes each).
HEAVY = 1_000_000
#: Tokens that are counted together, and in how many of their documents one must stand to be called frequent.
COUNTED, OFTEN = 3_000_000, 3
#: Text handled at once, and list entries held before they are sent.
CHUNK, FLUSH = 500_000, 500_000
#: Rows (24 bytes each) up to which the chosen documents are broadcast; beyond it they are joined by a shuffle.
SMALL = 200_000
#: Entries of one token in one flush beyond which they skip the reducer (they are shared already).
DIRECT = 64
#: Bins of a set's sketch (a byte each).
BINS = 256
NO_ID = -(2**63)
NAMES = ["kind", "doc_id", "key", "n", "dg", "sketch"]
SEEDS = (0x0, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def required(n: int, threshold: int) -> int:
    """ceil(threshold / 100 * n)"""
    return -(-threshold * n // 100)


def in_order(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray, seed: int, count: int) -> np.ndarray:
    """Indices of the first count tokens under the order of this seed."""
    key = mix(tokens ^ U64(seed)) >> U64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        frequent = heavy[at] == tokens
        if frequent.any():
            own = rank[at[frequent]].astype(U64)
            if seed:
                own = mix(own ^ U64(seed)) >> U64(1)
            key[frequent] = own | U64(1 << 63)
    if count < len(key):
        part = np.argpartition(key, count - 1)[:count]
        return part[np.argsort(key[part])]
    return np.argsort(key)


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of BINS bins, 255 for more."""
    return np.minimum(np.bincount((tokens >> U64(20)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Two sets share no more tokens of a bin than the smaller count there. False where the sum of these is
    under what a link needs (rows of sketches; full bins prove nothing)."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    full = ((x == 255) & (y == 255)).any(axis=1)
    return full | ((100 + threshold) * most >= threshold * (n + m))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: doc_id, key (of the text), n (set size), dg (set digest), sketch. kind 1: tokens (dg) that stand in
    OFTEN documents or more of some COUNTED tokens, and in how many (n). A token with a share of
    OFTEN / COUNTED of all tokens has it in some such part, so none of these is missed."""
    schema = "kind int, doc_id long, key long, n long, dg long, sketch binary"

    def frequent(held):
        every = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        count = np.diff(np.append(starts, len(every)))
        often = count >= OFTEN
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(none), np.int32)), none, none, pa.array(count[often].astype(np.int64)), pa.array(every[starts[often]].view(np.int64)), pa.nulls(len(none), pa.binary())], names=NAMES)

    def run(stream):
        held, size = [], 0
        for batch in stream:
            for lo, hi in slices(batch.column("text"), CHUNK):
                sets = shingle_sets(*flat(batch.column("text")[lo:hi]), k)
                out = [pa.array(np.zeros(hi - lo, np.int32)), batch.column("doc_id")[lo:hi], batch.column("key")[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=NAMES)
                for s in sets:
                    if len(s):
                        held.append(s)
                        size += len(s)
                if size >= COUNTED:
                    yield frequent(held)
                    held, size = [], 0
        if size:
            yield frequent(held)

    return docs.mapInArrow(run, schema)


def frequent_tokens(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY tokens, sorted, and their ranks (rarest first)."""
    top = signed.filter("kind = 1").groupBy("dg").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "dg").limit(HEAVY).select("dg").toArrow()
    tokens = top.column("dg").to_numpy()[::-1].copy().view(U64)
    by = np.argsort(tokens)
    return tokens[by], by.astype(np.uint32)


def _blob(tok, doc, pos, names, sizes) -> bytes:
    used, local = np.unique(doc, return_inverse=True)
    head = struct.pack("<II", len(tok), len(used))
    return head + tok.astype("<u4").tobytes() + local.astype("<u2").tobytes() + np.minimum(pos, 65535).astype("<u2").tobytes() + names[used].tobytes() + sizes[used].astype("<u4").tobytes()


def _unblob(raw: bytes):
    m, d = struct.unpack_from("<II", raw)
    at = 8
    tok = np.frombuffer(raw, "<u4", m, at)
    local = np.frombuffer(raw, "<u2", m, at + 4 * m)
    pos = np.frombuffer(raw, "<u2", m, at + 6 * m)
    names = np.frombuffer(raw, "<i8", d, at + 8 * m)
    sizes = np.frombuffer(raw, "<u4", d, at + 8 * m + 8 * d)
    return tok, names[local], sizes[local], pos


def prefix_lists(docs: DataFrame, heavy: np.ndarray, rank: np.ndarray, k: int, threshold: int, ranges: int) -> DataFrame:
    """tok, dg, n, pos: the order-0 prefix entries of tokens that at least two entities share.
    Entries travel as packed arrays by token range. Of a token with over DIRECT entries in one
    flush, two stand for the rest in the reducer; the rest is known to be shared and passes by."""

    def send(stream):
        tok, pos, doc, names, sizes, seen, held = [], [], [], [], [], set(), 0

        def flush():
            t, p, d = np.concatenate(tok), np.concatenate(pos), np.concatenate(doc)
            name, size = np.array(names, np.int64), np.array(sizes, np.int64)
            by = np.argsort(t, kind="stable")
            t, p, d = t[by], p[by], d[by]
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            nth = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
            many = np.repeat(np.diff(np.append(first, len(t))) > DIRECT, np.diff(np.append(first, len(t))))
            part = ((t >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
            low = (t & U64(0xFFFFFFFF)).astype(np.uint32)
            for direct in (False, True):
                chosen = many & (nth >= 2) if direct else ~(many & (nth >= 2))
                where = np.flatnonzero(chosen)
                cuts = np.searchsorted(part[where], np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)):
                    w = where[cuts[r] : cuts[r + 1]]
                    yield int(r), direct, _blob(low[w], d[w], p[w], name, size)

        def out():
            rows = list(flush())
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "direct", "entries"])
            for c in (tok, pos, doc, names, sizes, seen):
                c.clear()
            return batch

        for batch in stream:
            for lo, hi in slices(batch.column("text"), CHUNK):
                for s in shingle_sets(*flat(batch.column("text")[lo:hi]), k):
                    dg = set_digest(s)
                    if len(s) and dg not in seen:
                        seen.add(dg)
                        first = in_order(s, heavy, rank, SEEDS[0], len(s) - required(len(s), threshold) + 1)
                        tok.append(s[first])
                        pos.append(np.arange(len(first)))
                        doc.append(np.full(len(first), len(names)))
                        names.append(dg)
                        sizes.append(len(s))
                        held += len(first)
                        if held > FLUSH or len(names) >= 65_000:
                            yield out()
                            held = 0
        if names:
            yield out()

    def shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part, direct = int(key[0]), bool(key[1])
        tok, dg, n, pos = (np.concatenate(c) for c in zip(*map(_unblob, pdf["entries"]), strict=True))
        by = np.lexsort((dg, tok))
        tok, dg, n, pos = tok[by], dg[by], n[by].astype(np.int64), pos[by]
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (dg[1:] != dg[:-1])))
        tok, dg, n, pos = tok[new], dg[new], n[new], pos[new]
        if not direct and len(tok):
            near = tok[1:] == tok[:-1]
            some = np.concatenate((near, [False])) | np.concatenate(([False], near))
            tok, dg, n, pos = tok[some], dg[some], n[some], pos[some]
        return pd.DataFrame({"tok": tok.astype(np.int64) | (np.int64(part) << np.int64(32)), "dg": dg, "n": n.astype(np.int32), "pos": pos.astype(np.int32)})

    sent = docs.select("text").mapInArrow(send, "part int, direct boolean, entries binary")
    return sent.groupBy("part", "direct").applyInPandas(shared, "tok long, dg long, n int, pos int")


def _close(threshold: int):
    """Sizes fit, and the shared token leaves enough room behind it in both sets. The first token
    that a linked pair shares passes, as nothing before it is shared."""
    a, b, pa_, pb = F.col("n"), F.col("m"), F.col("pos"), F.col("pos2")
    need = F.ceil((a + b) * F.lit(threshold) / F.lit(100 + threshold))
    return (a * 100 >= b * threshold) & (b * 100 >= a * threshold) & (1 + F.least(a - 1 - pa_, b - 1 - pb) >= need)


def _pairs(left: DataFrame, right: DataFrame, threshold: int, more=None) -> DataFrame:
    """a < b: entities of both sides that share a token and pass the size and position filters."""
    found = left.join(right, "tok").filter((F.col("dg") != F.col("dg2")) & _close(threshold))
    if more is not None:
        found = found.filter(more)
    return found.select(F.least("dg", "dg2").alias("a"), F.greatest("dg", "dg2").alias("b")).distinct()


def _right(lists: DataFrame, *more) -> DataFrame:
    return lists.select("tok", F.col("dg").alias("dg2"), F.col("n").alias("m"), F.col("pos").alias("pos2"), *more)


def _endpoints(pairs: DataFrame) -> DataFrame:
    """Distinct entities of the pairs (dg); broadcast where they are few."""
    ids = keep(pairs.select(F.col("a").alias("dg")).union(pairs.select("b")).distinct(), "ends")
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def plausible(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sketches leave room for a link."""
    sketches = keep(signed.filter("kind = 0").join(_endpoints(pairs), "dg").groupBy("dg").agg(F.first("n").alias("n"), F.first("sketch").alias("s")), "sketches")
    a, b = (sketches.select(F.col("dg").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab")

    def run(stream):
        for batch in stream:
            if batch.num_rows:
                rows = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS)
                ok = pa.array(may_link(rows("sa"), rows("sb"), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, signed: DataFrame, docs: DataFrame, heavy: np.ndarray, rank: np.ndarray, k: int, threshold: int) -> DataFrame:
    """The pairs that link. Sketches are compared first, then the other orders' prefixes, then the sets."""
    pairs = keep(plausible(pairs, signed, threshold), "plausible")
    named = signed.filter("kind = 0").join(_endpoints(pairs), "dg")
    one = named.groupBy("dg").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key")).alias("row")).select("dg", F.col("row.doc_id").alias("doc_id"), F.col("row.key").alias("key"))
    one = keep(one, "chosen")
    if one.count() <= SMALL:
        one = F.broadcast(one)
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    texts = keep(keyed.join(one, ["doc_id", "key"]).groupBy("dg").agg(F.first("text").alias("text")), "texts")
    first = pairs.join(texts.withColumnRenamed("dg", "a").withColumnRenamed("text", "x"), "a")
    both = first.join(texts.withColumnRenamed("dg", "b").withColumnRenamed("text", "y"), "b")

    def run(stream):
        for batch in stream:
            lo = 0
            while lo < batch.num_rows:
                hi = min(lo + 256, batch.num_rows)
                xs, ys = (shingle_sets(*flat(batch.column(c)[lo:hi]), k) for c in ("x", "y"))
                ok = np.zeros(hi - lo, bool)
                for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                    px, py = len(x) - required(len(x), threshold) + 1, len(y) - required(len(y), threshold) + 1
                    if all(len(np.intersect1d(x[in_order(x, heavy, rank, s, px)], y[in_order(y, heavy, rank, s, py)], assume_unique=True)) for s in SEEDS[1:]):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok[i] = 100 * both >= threshold * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([batch.column(c)[lo:hi].filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])
                lo = hi

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similarity_components(docs: DataFrame, k: int = 5, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key (of its text), n_shingles, component_id, component (a set digest that names
    the component, as different ones can have the same component_id; null without a word)."""
    spark = docs.sparkSession
    d = documents(docs, id_col, text_col, key=text_key(docs[text_col]))
    signed = keep(signatures(d, k), "signatures")
    heavy, rank = frequent_tokens(signed)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = keep(prefix_lists(d, heavy, rank, k, threshold, ranges), "lists")

    # The centre of a list: the entity of which the largest part of the prefix is shared. Among near
    # copies that is the one with the fewest changes, which most others link with.
    part = lists.groupBy("dg").agg(F.count(F.lit(1)).alias("shared"))
    lists = keep(lists.join(part, "dg").withColumn("apart", -F.col("shared") / (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1)).drop("shared"), "lists")
    least = lists.groupBy("tok").agg(F.min(F.struct("apart", "dg", "n", "pos")).alias("p")).select("tok", F.col("p.dg").alias("dg2"), F.col("p.n").alias("m"), F.col("p.pos").alias("pos2"))
    tried = keep(_pairs(lists, least, threshold), "pairs")
    links = keep(verified(tried, signed, d, heavy, rank, k, threshold), "linked")
    label = components(links)

    own = lists.join(label.withColumnRenamed("node", "dg"), "dg", "left").withColumn("label", F.coalesce("label", "dg"))
    main = own.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("apart", "dg", "label")).alias("p")).filter("lo != hi").select("tok", F.col("p.label").alias("main"))
    open_ = keep(own.join(main, "tok"), "open")
    rest = _pairs(open_.filter("label != main"), _right(open_, F.col("label").alias("label2")), threshold, F.col("label") != F.col("label2"))
    more = keep(verified(keep(rest.join(tried, ["a", "b"], "left_anti"), "pairs"), signed, d, heavy, rank, k, threshold), "linked")
    label = components(links.union(more))

    rows = signed.filter("kind = 0").select("doc_id", "key", "n", "dg")
    named = rows.join(label.withColumnRenamed("node", "dg"), "dg", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "dg")))
    least_id = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(least_id, "label", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("label").alias("component"))
