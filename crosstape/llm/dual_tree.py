"""Ranked lexical search by a dual-tree search.

A document's coordinate for a term is its saturated, length-normalised count; an item's is the term's weight times its
occurrences in the item. A score is the inner product of the two. Documents of a task form blocks of up to BLOCK, sorted so
that like ones stand together, and each block a tree: leaves of LEAF documents, nodes of FAN leaves, nodes of FAN such nodes.
Items form a tree of the same kind, with single items at its foot. Every node of either tree holds its coordinate maxima, so the
inner product of two nodes bounds all scores below the pair. From the root pairs down, a pair is
opened only if its bound reaches the weakest of its items' k-th scores so far; at an item the best bounds come
first. A pair that falls short is dropped with all items and documents below it. Nothing that could be ranked is ever
dropped: bounds and scores are whole numbers below 2**53, exact in doubles (beyond it, scores are summed in 64-bit integers
and bounds are widened by more than their rounding).

Counts. Terms of a text are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
lower-cased. One pass counts every document's terms (looked up among the items' terms, byte for byte) and is
written down; corpus statistics and the search read that.

Null text has no term; a document without a term counts nowhere. Each row is a document of its own, so repeated rows
are ranked as often as they stand there; a null doc_id comes before others of equal score. Rows of one item_id and text
are one item; other rows are items of their own, also under a repeated or null id. Items without a term, and scores of 0,
give no rows. Extra columns are ignored.

Items are broadcast in parts of at most ITEM_BYTES of text (a single longer item is a part of its own); each part takes
one pass over the documents. A task sends at most k rows per item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .columns import keep, slices

GAP = spans.byte_set([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TEXT_BLOCK = 1 << 20
BLOCK, LEAF, FAN, LEVELS = 8192, 4, 8, 3
#: Cells of a block's leaves (4 bytes each); with very many item terms a block holds fewer documents.
CELLS = 8_000_000
ITEM_FAN = 8
ITEM_BYTES = 8 << 20
NO_ID = -(2**63)
EXACT = 2**53


# --- terms -----------------------------------------------------------------------------


class Vocabulary:
    """Terms by number; finds their occurrences among the words of a buffer."""

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.large_string())
        data, at = spans.flat(self.terms)
        # A word's hash doesn't depend on where it stands.
        self.hashes = np.sort(spans.hashes(data, at[:-1], at[1:])) if len(terms) else np.zeros(0, np.uint64)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are terms, and the terms' numbers. The hash only sorts out; bytes decide."""
        h = spans.hashes(data, starts, ends)
        may = np.flatnonzero(self.coarse[(h >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[may])
        may = may[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[may])] if len(self.hashes) else may[:0]
        found = pc.index_in(spans.strings(data, starts[may], ends[may]), value_set=self.terms)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        return may[hit], found.drop_null().to_numpy().astype(np.int64)


def terms_of(text: str | None) -> list[str]:
    data, _ = spans.ended(pa.array([text], pa.large_string()))
    data = spans.LOWER[data]
    return spans.strings(data, *spans.words(data, GAP)).to_pylist()


def _counts(stream, terms: list[str]):
    """doc_id, n (terms), term numbers ascending and their counts, of each document."""
    vocabulary = Vocabulary(terms)
    size = max(len(terms), 1)
    for batch in stream:
        for first, last in slices(batch.column("text"), 4 * TEXT_BLOCK):
            data, at = spans.ended(batch.column("text").slice(first, last - first))
            n = np.zeros(last - first, np.int64)
            doc, term = [], []
            done = 0
            for block in spans.blocks(data, GAP, TEXT_BLOCK):
                block = spans.LOWER[block]
                starts, ends = spans.words(block, GAP)
                of = np.searchsorted(at, starts + done, "right") - 1
                n += np.bincount(of, minlength=len(n))
                hit, number = vocabulary.numbers(block, starts, ends)
                doc.append(of[hit])
                term.append(number)
                done += len(block)
            pair, tf = np.unique(np.concatenate(doc) * size + np.concatenate(term), return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in ((pair % size).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])


# --- the search inside a task ----------------------------------------------------------


def sparse(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, columns, values."""
    at = np.cumsum([0, *map(len, rows)])
    cols = np.fromiter((c for r in rows for c in sorted(r)), np.int64, at[-1])
    return at, cols, np.fromiter((r[c] for r in rows for c in sorted(r)), np.int64, at[-1])


def picked(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries of these rows: the row's place in rows, and the entry's position."""
    size = at[rows + 1] - at[rows]
    place = np.repeat(np.arange(len(rows)), size)
    return place, np.arange(len(place)) + np.repeat(at[rows] - (np.cumsum(size) - size), size)


def likeness_order(at: np.ndarray, cols: np.ndarray, often: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows in an order that brings like ones together: by the column with most of `often` in the row (ties: the
    first one), which tells languages and topics apart, then by the row's whole weight. Rows without a column come first."""
    n = len(at) - 1
    rows = np.repeat(np.arange(n), np.diff(at))
    lead = np.full(n, -1)
    some = at[1:] > at[:-1]
    lead[some] = cols[np.lexsort((cols, -often, rows))][at[:-1][some]]
    return np.lexsort((np.bincount(rows, weight, n), lead))


def climbed(nodes: np.ndarray, fan: int) -> np.ndarray:
    """Maxima of each fan rows."""
    return np.maximum.reduceat(nodes, np.arange(0, len(nodes), fan), axis=0)


class Block:
    """Documents in a tree. levels[0] holds a row of coordinate maxima for each LEAF documents, every further level one
    for each FAN rows below; columns are the terms that occur here."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, cols: np.ndarray, tf: np.ndarray, values: np.ndarray, weights: np.ndarray):
        order = likeness_order(at, cols, tf, values * weights[cols].astype(np.float64))
        place, entry = picked(at, order)
        self.ids, self.values = ids[order], values[entry]
        self.at = np.concatenate(([0], np.cumsum((at[1:] - at[:-1])[order])))
        used, self.cols = np.unique(cols[entry], return_inverse=True)
        self.column_of = np.full(len(weights), -1)
        self.column_of[used] = np.arange(len(used))
        # Coordinates are below 10**6, so exact in 32 bits.
        leaves = np.zeros((-(-len(ids) // LEAF), len(used)), np.float32)
        np.maximum.at(leaves, (place // LEAF, self.cols), self.values.astype(np.float32))
        self.levels = [leaves]
        while len(self.levels) < LEVELS and len(self.levels[-1]) > FAN:
            self.levels.append(climbed(self.levels[-1], FAN))

    def roots(self) -> np.ndarray:
        return np.arange(len(self.levels[-1]))

    def bounds(self, level: int, nodes: np.ndarray, columns: np.ndarray, top: np.ndarray) -> np.ndarray:
        return self.levels[level][np.ix_(nodes, columns)].astype(np.float64) @ top

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Children of nodes; of leaves, their documents."""
        fan, n = (FAN, len(self.levels[level - 1])) if level else (LEAF, len(self.ids))
        under = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return under[under < n]

    def scores(self, docs: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        narrow = np.full(self.levels[0].shape[1], -1)
        narrow[columns] = np.arange(len(columns))
        place, entry = picked(self.at, docs)
        column = narrow[self.cols[entry]]
        ours = column >= 0
        coordinates = np.zeros((len(docs), len(columns)), weights.dtype)
        coordinates[place[ours], column[ours]] = self.values[entry[ours]]
        return (coordinates @ weights).astype(np.int64)


class Node:
    """Items below, their columns and the maxima over them. A node without children is one item."""

    def __init__(self, cols: np.ndarray, top: np.ndarray, members: list[int], children: list[Node]):
        self.cols, self.top, self.members, self.children = cols, top, members, children

    @classmethod
    def over(cls, children: list[Node]) -> Node:
        cols = np.unique(np.concatenate([c.cols for c in children]))
        top = np.zeros(len(cols))
        for c in children:
            where = np.searchsorted(cols, c.cols)
            top[where] = np.maximum(top[where], c.top)
        return cls(cols, top, [m for c in children for m in c.members], children)


class Items:
    """The item tree and each item's k best documents so far."""

    def __init__(self, rows: list[dict[int, int]], weights: np.ndarray, k: int):
        """rows: term number -> occurrences."""
        self.k, self.n = k, len(rows)
        at, cols, occurrences = sparse(rows)
        whole = (weights[cols] * occurrences).astype(np.float64)
        exact = max((float(whole[a:b].sum()) for a, b in zip(at[:-1], at[1:], strict=True)), default=0.0) * 1e6 < EXACT
        kind = np.float64 if exact else np.int64
        # 64-bit sums are rounded once per term in a bound, so a little is added to it.
        self.slack = 1.0 if exact else 1 + 1e-9
        order = likeness_order(at, cols, -weights[cols], whole)
        level = [Node(cols[at[i] : at[i + 1]], (weights[cols] * occurrences)[at[i] : at[i + 1]].astype(kind), [i], []) for i in order.tolist()]
        while len(level) > ITEM_FAN:
            level = [Node.over(level[lo : lo + ITEM_FAN]) for lo in range(0, len(level), ITEM_FAN)]
        self.roots = level
        self.scores = np.zeros((self.n, k), np.int64)  # ascending; 0: none yet
        self.ids = np.full((self.n, k), NO_ID)
        #: Pairs of an item and a document: all, and those scored.
        self.pairs, self.scored = 0, 0

    def offer(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keep the k best of what is known and what is new."""
        good = scores >= max(1, self.scores[item, 0])
        if not good.any():
            return
        held = self.scores[item] > 0
        s = np.concatenate((self.scores[item][held], scores[good]))
        i = np.concatenate((self.ids[item][held], ids[good]))
        best = np.lexsort((i, -s))[: self.k][::-1]
        self.scores[item, self.k - len(best) :] = s[best]
        self.ids[item, self.k - len(best) :] = i[best]

    def search(self, block: Block) -> None:
        """Meet a block of documents."""
        self.pairs += self.n * len(block.ids)
        for root in self.roots:
            self._pairs(root, block, len(block.levels) - 1, block.roots())

    def _pairs(self, node: Node, block: Block, level: int, alive: np.ndarray) -> None:
        """All pairs of an item node and document nodes of one level; descends on both sides."""
        columns = block.column_of[node.cols]
        here = columns >= 0
        columns, top = columns[here], node.top[here]
        if not len(columns):
            return
        bound = block.bounds(level, alive, columns, top.astype(np.float64)) * self.slack
        far = bound >= max(1, self.scores[node.members, 0].min())
        alive, bound = alive[far], bound[far]
        if not len(alive):
            return
        if node.children:
            if level > 1:
                level, alive = level - 1, block.below(level, alive)
            for child in node.children:
                self._pairs(child, block, level, alive)
            return
        while level:
            level, alive = level - 1, block.below(level, alive)
            bound = block.bounds(level, alive, columns, top.astype(np.float64)) * self.slack
            far = bound >= max(1, self.scores[node.members[0], 0])
            alive, bound = alive[far], bound[far]
        best = np.argsort(-bound, kind="stable")
        alive, bound = alive[best], bound[best]
        lo, step = 0, 8
        while lo < len(alive):
            weakest = max(1, self.scores[node.members[0], 0])
            hi = min(lo + step, int(np.searchsorted(-bound, -float(weakest), "right")))
            if hi <= lo:
                return
            docs = block.below(0, alive[lo:hi])
            scores = block.scores(docs, columns, top)
            self.scored += len(docs)
            self.offer(node.members[0], block.ids[docs], scores)
            lo, step = hi, min(2 * step, 128)


def lengths_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 75 + (75 * n * N) div L."""
    if int(n.max(initial=0)) * 75 * documents < 2**63:
        return 25 + (75 * documents * n) // max(terms, 1)
    return np.array([25 + 75 * documents * x // terms for x in n.tolist()], np.int64)


def _searched(stream, rows: list[dict[int, int]], weights: np.ndarray, k: int, documents: int, total: int):
    """item (number), doc_id, score: the task's best k of each item."""
    items = Items(rows, weights, k)
    most = LEAF * max(FAN, min(BLOCK // LEAF, CELLS // max(len(weights), 1)))
    waiting: list[tuple] = []
    held = 0

    def block():
        ids, size, *entries = (np.concatenate(c) for c in zip(*waiting, strict=True))
        waiting.clear()
        items.search(Block(ids, np.concatenate(([0], np.cumsum(size))), *entries, weights))

    for batch in stream:
        n = batch.column("n").to_numpy()
        size = batch.column("terms").value_lengths().to_numpy()
        cols = batch.column("terms").flatten().to_numpy().astype(np.int64)
        tf = batch.column("tfs").flatten().to_numpy()
        values = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(lengths_norm(n, documents, total), size))
        at = np.concatenate(([0], np.cumsum(size)))
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        for lo in range(0, len(ids), most):
            hi = min(lo + most, len(ids))
            waiting.append((ids[lo:hi], size[lo:hi], *(c[at[lo] : at[hi]] for c in (cols, tf, values))))
            held += hi - lo
            if held >= most:
                block()
                held = 0
    if held:
        block()
    got = items.scores > 0
    item = np.repeat(np.arange(items.n), got.sum(axis=1))
    for lo in range(0, len(item), 100_000):
        part = slice(lo, lo + 100_000)
        ids = items.ids[got][part]
        yield pa.RecordBatch.from_arrays([pa.array(item[part]), pa.array(ids, mask=ids == NO_ID), pa.array(items.scores[got][part])], names=["item", "doc_id", "score"])


# --- on the cluster --------------------------------------------------------------------


def _search_part(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    """item_id, rank, doc_id, score for a part of the items, (item_id, terms) each."""
    spark = docs.sparkSession
    number: dict[str, int] = {}
    for _, terms in items:
        for t in terms:
            number.setdefault(t, len(number))
    names = spark.sparkContext.broadcast(list(number))
    counted = keep(docs.mapInArrow(lambda s: _counts(s, names.value), "doc_id long, n long, terms array<int>, tfs array<long>").filter("n > 0"), "term-counts")
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A row per term of the items.
    df = np.zeros(len(number), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    rows: list[dict[int, int]] = []
    for _, terms in items:
        row: dict[int, int] = {}
        for t in terms:
            row[number[t]] = row.get(number[t], 0) + 1
        rows.append(row)
    sent = spark.sparkContext.broadcast((rows, weights))
    found = counted.filter(F.size("terms") > 0).mapInArrow(lambda s: _searched(s, *sent.value, k, documents, total), "item long, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(ids, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    asked = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text")).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    if parts > 1:
        asked = keep(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts))), "items")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(2 * parts if parts > 1 else parts):
        chosen = asked.filter(F.col("part") == part) if parts > 1 else asked
        rows = sorted(((r.item_id, r.text) for r in chosen.select("item_id", "text").toLocalIterator()), key=lambda r: (r[0] is not None, r))
        told = [(key, terms) for key, text in rows if (terms := terms_of(text))]
        if told:
            out = out.unionByName(_search_part(d, told, k))
    return out


#: DuckDB.
ORACLE = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
asked as (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
lens as (select doc_id, count(*) as n from terms group by doc_id),
total as (select count(*) as docs, sum(n)::bigint as len from lens),
tf as (select doc_id, term, count(*) as tf from terms where term in (select term from asked) group by doc_id, term),
weight as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term),
scored as (
  select a.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * l.n * t.docs) // t.len))))::bigint as score
  from asked a join tf f on f.term = a.term join weight w on w.term = a.term join lens l on l.doc_id = f.doc_id, total t group by a.item_id, f.doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""
