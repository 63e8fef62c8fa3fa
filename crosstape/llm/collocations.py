"""Phrase collocation mining in two passes.

Pass 1. Every phrase of 1 to max_words words is hashed (language and length included) to a hash partition and
a 32-bit key there. Tasks send a summary of each partition, keys with their counts, and each partition's
summaries are merged into one Misra-Gries summary: counters beyond its capacity make it lose
the (capacity + 1)-th largest count from all of them. Its capacity is SLACK * mass / min_count + 1, the mass being
all occurrences in the partition, so no count is short by min_count / SLACK or more, and every phrase with min_count
occurrences is found among the counters whose count plus that loss reaches min_count. Keys that collide only add.

Pass 2. The keys that are left set bits of a filter (2**FILTER_BITS bits, whatever the input; too many keys make it
let more pass, never less). Phrases that pass it are counted exactly, as strings, and those under min_count go.

Scores: a phrase of a occurrences is cut after each of its words; l and r count the parts. The least
floor(SCALE * a * a / (l * r)) is its score (ties: the earliest cut). A phrase inside a longer one that stands at least
half as often goes. Each language's best phrases are returned: score, then a (both descending), then UTF-8 order.

Texts are lower-cased (A-Z), split into pieces at BREAK bytes and at the text's ends, pieces into words at blanks and
tabs. Null text is empty, a null language is `und`. Repeated rows count again. Ids and extra columns are ignored.
An empty table gives no rows. Memory follows neither a text nor a batch, only the longest piece.

A frequent word or phrase is one counter of a task's summary, one row of a task's exact counts, and the splittable
side of the two look-ups of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .columns import U64, keep, mix, slices

BREAK = spans.byte_set([*b".,;:!?", *range(0x0A, 0x0E)])
GAP = BREAK | spans.byte_set(b" \t")
#: Text bytes looked at together, phrases per summary or count that a task sends, text bytes per hash partition.
BLOCK, FLUSH, PER_PART = 1 << 20, 1_500_000, 4 << 20
SLACK, FILTER_BITS, SCALE = 4, 27, 1_000_000
UNKNOWN = "und"


class Summary:
    """A mergeable Misra-Gries summary of 32-bit keys with at most `capacity` counters; `lost` bounds what any count lacks."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts of distinct keys. Counts from 2**32 on are taken as 2**32 - 1."""
        self.waiting.append(keys.astype(U64) << U64(32) | np.minimum(counts, 0xFFFFFFFF).astype(U64))
        self.held += len(keys)
        if self.held > max(self.capacity, 1_000_000):
            self.fold()

    def fold(self) -> None:
        self.waiting.append(self.keys << U64(32) | np.minimum(self.counts, 0xFFFFFFFF).astype(U64))
        both = np.concatenate(self.waiting)
        both.sort()
        self.waiting, self.held = [], 0
        keys = both >> U64(32)
        first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
        counts = np.add.reduceat((both & U64(0xFFFFFFFF)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keys = keys[first]
        over = len(counts) - self.capacity
        if over > 0:
            least = int(np.partition(counts, over - 1)[over - 1])
            counts = counts - least
            keys, counts = keys[counts > 0], counts[counts > 0]
            self.lost += least
        self.keys, self.counts = keys, counts

    def reaching(self, least: int) -> np.ndarray:
        """Keys that may have that count."""
        self.fold()
        return self.keys[self.counts + self.lost >= least]


class Cells:
    """Where a phrase's hash stands: partition, key in it, bit of the filter; and the sizes tasks work by."""

    def __init__(self, parts: int):
        self.parts = min(parts, 1 << 23)
        self.bits = max(3, FILTER_BITS - (self.parts - 1).bit_length())
        self.block, self.flush = BLOCK, FLUSH

    def cell(self, h: np.ndarray) -> np.ndarray:
        """partition << 32 | key, in the order of h."""
        return ((h >> U64(24)) * U64(self.parts)) >> U64(8)

    def bit(self, cell: np.ndarray) -> np.ndarray:
        return cell >> U64(32 - self.bits)


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[tuple[str, np.ndarray]]:
    """Language and lower-cased bytes, in blocks that end where a piece ends."""
    for lo, hi in slices(batch.column("text"), 4 * most):
        lang, text = batch.column("lang").slice(lo, hi - lo).fill_null(UNKNOWN), batch.column("text").slice(lo, hi - lo)
        for name in pc.unique(lang).to_pylist():
            data, _ = spans.ended(text.filter(pc.equal(lang, name)))
            for block in spans.blocks(data, BREAK, most):
                yield name, spans.LOWER[block]


class _Words:
    """The words of a block end to end with one blank between, and the hashes of its phrases."""

    def __init__(self, lang: str, block: np.ndarray, max_words: int):
        starts, ends = spans.words(block, GAP)
        self.n = len(starts)
        piece = np.searchsorted(np.flatnonzero(BREAK[block]), starts)
        stays = ~GAP[block]
        stays[ends[ends < len(block)]] = True
        self.data = block[stays]
        self.data[GAP[self.data]] = 0x20
        size = ends - starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        own = spans.hashes(self.data, self.starts, self.ends)
        seed = U64(xxhash.xxh64_intdigest(lang.encode()))
        self.hashes: list[tuple[int, np.ndarray, np.ndarray]] = []
        rolled, at = own, np.arange(self.n)
        for k in range(1, max_words + 1):
            if k > 1:
                at = at[: max(0, self.n - k + 1)]
                rolled = mix(rolled[: len(at)] * U64(0xA0761D6478BD642F) + own[k - 1 :][: len(at)])
            whole = piece[k - 1 :][: len(at)] == piece[: len(at)]
            self.hashes.append((k, at[whole], mix(rolled[whole] ^ (seed + U64(k)))))


def _summaries(stream, cells: Cells, max_words: int):
    """Rows of a task's summaries. kind 0 holds the mass alone and comes first when sorted."""
    names = ["part", "kind", "mass", "ones", "more", "counts"]

    def sent(waiting):
        cell = np.concatenate(waiting)
        cell.sort()
        cell = cells.cell(cell)
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), cell[1:] != cell[:-1])))
        bounds, n = np.append(first, len(cell)), len(cell)
        cell, counts = cell[first], np.diff(bounds)
        part = (cell >> U64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate((np.ones(1, bool), part[1:] != part[:-1], np.ones(1, bool))))
        rows: list[list] = [[], [], [], [], [], []]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            key, c = (cell[lo:hi] & U64(0xFFFFFFFF)).astype(np.uint32), counts[lo:hi]
            once = c == 1
            mass = int(bounds[hi] - bounds[lo]) if hi < len(bounds) else n - int(bounds[lo])
            for row in ((0, mass, None, None, None), (1, 0, key[once].tobytes(), key[~once].tobytes(), np.minimum(c[~once], 0xFFFFFFFF).astype(np.uint32).tobytes())):
                for out, x in zip(rows, (int(part[lo]), *row), strict=True):
                    out.append(x)
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    waiting, held = [], 0
    for batch in stream:
        for lang, block in _pieces(batch, cells.block):
            for _, _, h in _Words(lang, block, max_words).hashes:
                waiting.append(h)
                held += len(h)
            if held >= cells.flush:
                yield sent(waiting)
                waiting, held = [], 0
    if held:
        yield sent(waiting)


def _merged(stream, cells: Cells, min_count: int):
    """Of each partition (rows come sorted by part and kind): its slice of the filter."""
    part, mass, summary = None, 0, None

    def done():
        keys = summary.reaching(min_count) if summary else np.zeros(0, U64)
        bits = np.zeros(1 << cells.bits, bool)
        bits[cells.bit(keys).astype(np.int64)] = True
        row = [[part], [np.packbits(bits, bitorder="little").tobytes()], [mass], [len(keys)], [summary.lost if summary else 0]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["part", "bits", "mass", "left", "lost"])

    for batch in stream:
        for row in range(batch.num_rows):
            p, kind = batch.column("part")[row].as_py(), batch.column("kind")[row].as_py()
            if p != part:
                if part is not None:
                    yield done()
                part, mass, summary = p, 0, None
            if kind == 0:
                mass += batch.column("mass")[row].as_py()
                continue
            if summary is None:
                summary = Summary(SLACK * mass // min_count + 1)
            ones, more, counts = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint32) for c in ("ones", "more", "counts"))
            summary.add(ones, np.ones(len(ones), np.int64))
            summary.add(more, counts)
    if part is not None:
        yield done()


def frequent_filter(texts: DataFrame, min_count: int, max_words: int) -> tuple[Cells, bytes, DataFrame]:
    """Pass 1: the cells, the filter's bytes, and the report of each partition (part, mass, left, lost)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = Cells(max(1, -(-size // PER_PART)))
    summaries = texts.mapInArrow(lambda s: _summaries(s, cells, max_words), "part int, kind int, mass long, ones binary, more binary, counts binary")
    dealt = summaries.repartition("part").sortWithinPartitions("part", "kind")
    report = keep(dealt.mapInArrow(lambda s: _merged(s, cells, min_count), "part int, bits binary, mass long, left long, lost long"), "summaries")
    # 2**FILTER_BITS bits in all, 16 MB.
    whole = np.zeros((cells.parts, (1 << cells.bits) // 8), np.uint8)
    got = report.select("part", "bits").toArrow()
    for part, bits in zip(got.column("part").to_pylist(), got.column("bits"), strict=True):
        whole[part] = np.frombuffer(bits.as_buffer(), np.uint8)
    return cells, whole.tobytes(), report.drop("bits")


def _counted(stream, cells: Cells, sieve: np.ndarray, max_words: int):
    """lang, words, phrase, n of the phrases that pass the filter; words 0: all words of the language."""
    waiting: dict[tuple[str, int], list[pa.Array]] = {}
    total: dict[str, int] = {}
    held = 0

    def sent():
        for (lang, k), parts in waiting.items():
            c = pc.value_counts(pa.chunked_array(parts))
            phrase, n = c.field("values"), c.field("counts")
            for lo in range(0, len(c), 100_000):
                p = phrase.slice(lo, 100_000).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(p)), pa.array(np.full(len(p), k, np.int32)), p, n.slice(lo, 100_000).cast(pa.int64())], names=["lang", "words", "phrase", "n"])
        waiting.clear()

    for batch in stream:
        for lang, block in _pieces(batch, cells.block):
            w = _Words(lang, block, max_words)
            total[lang] = total.get(lang, 0) + w.n
            for k, at, h in w.hashes:
                bit = cells.bit(cells.cell(h))
                hit = at[(sieve[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1]
                if len(hit):
                    waiting.setdefault((lang, k), []).append(spans.strings(w.data, w.starts[hit], w.ends[hit + k - 1]))
                    held += len(hit)
            if held >= cells.flush:
                yield from sent()
                held = 0
    yield from sent()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(np.zeros(len(total), np.int32)), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "words", "phrase", "n"])


def frequent_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, words, phrase, n: the exact counts of all phrases of 1 to max_words words with min_count
    occurrences; and a row with words 0 and no phrase for each language, its number of words."""
    texts = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    cells, sieve, _ = frequent_filter(texts, min_count, max_words)
    sieve = docs.sparkSession.sparkContext.broadcast(sieve)
    rows = texts.mapInArrow(lambda s: _counted(s, cells, np.frombuffer(sieve.value, np.uint8), max_words), "lang string, words int, phrase string, n long")
    counts = rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("words") == 0) | (F.col("n") >= min_count))


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, inside_percent: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to max_words words."""
    found = keep(frequent_phrases(docs, min_count, max_words, text_col, lang_col), "phrases")
    counts = found.filter("words > 0").select("lang", "phrase", "words", F.col("n").alias("a"))
    wide = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    text = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = wide.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "cut", text(F.lit(1), F.col("cut")).alias("left"), text(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # Decimals of 38 digits hold SCALE * a * a for counts up to 10**15.
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    both = both.withColumn("up", whole("a") * whole("a") * F.lit(SCALE).cast("decimal(7,0)")).withColumn("down", whole("l") * whole("r"))
    cut = F.struct(F.expr("up div down").alias("score"), "cut", "l", "r")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(cut).alias("c"))
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda lo: text(lo, n))))
    inner = wide.filter("words > 2").select("lang", F.explode(F.array_distinct(spots)).alias("phrase"), F.col("a").alias("longer"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = scored.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(found.filter("words = 0").select("lang", "n"), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


#: DuckDB, with exact 128-bit arithmetic.
ORACLE = r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
s as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
total as (select lang, sum(len(w))::bigint as n from s group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from s, (values (1), (2), (3)) as v(k))),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 10),
c as (select *, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select lang, phrase, k, a, cut, array_to_string(w[:cut], ' ') as lef, array_to_string(w[cut + 1:], ' ') as rig from (select *, unnest(range(1, k)) as cut from c)),
scored as (
  select u.lang, u.phrase, u.a, x.a as l, y.a as r, ((1000000::hugeint * u.a * u.a) // (x.a::hugeint * y.a))::bigint as score, u.cut
  from cuts u join f x on x.lang = u.lang and x.phrase = u.lef join f y on y.lang = u.lang and y.phrase = u.rig
  qualify row_number() over (partition by u.lang, u.phrase order by score, cut) = 1),
inner_ as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where k = 3),
longer as (select lang, phrase, max(a) as longer from inner_ group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
  from scored s left join longer o on o.lang = s.lang and o.phrase = s.phrase where o.longer is null or 100 * o.longer < 50 * s.a)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join total t on t.lang = r.lang where rank <= 2000"""
