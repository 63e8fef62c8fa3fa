"""Line templates, the n-gram join and suffix arrays against plain brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from crosstape.llm import digest_index, line_templates, ngram_orders, suffix_dedup
from crosstape.llm.columns import scratch
from crosstape.llm.components import components
from crosstape.llm.suffix_arrays import common_prefixes, merge_runs, suffix_array

from .conftest import ROWS


def toy(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- suffix arrays ---------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    r = np.random.default_rng(seed)
    data = r.integers(0, 2 + seed, 700).astype(np.uint8) + 1
    if seed % 2:
        data = np.concatenate((data, data[50:400], data[:300]))
    raw = data.tobytes()
    order = suffix_array(data, 64)
    padded = lambda i: raw[i : i + 64].ljust(64, b"\0")
    assert [padded(i) for i in order] == sorted(padded(i) for i in range(len(raw)))
    got = common_prefixes(data, order, 40, lanes=16)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[k] == min(n, 40)


def test_merge_runs():
    a = (np.array([1, 5, 9], np.uint64), np.array([0, 0, 0]), np.array([10, 20, 30]))
    b = (np.array([0, 5, 9, 12], np.uint64), np.array([0, 0, 1, 0]), np.array([1, 2, 3, 4]))
    (d, c, p), lost = merge_runs(a, b)
    assert d.tolist() == [0, 1, 5, 9, 9, 12] and sorted(p.tolist()) == [1, 2, 3, 4, 10, 30] and lost.tolist() == [20]


def brute_spans(rows, length=100):
    """Documents by (doc_id, hash of text) as the operator orders them; rows of one document share a result."""
    seen, out = set(), {}
    for key, text in rows:
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(cover))]
        out[key] = (len(b), sum(cover), len(spans), hashlib.sha256(kept).hexdigest(), kept, [(a, e - a) for a, e in spans])
    return out


def test_repeats_on_the_odd_table(spark, table):
    from pyspark.sql import functions as F

    keyed = [(r.doc_id, r.h, r.text) for r in table.select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    order = sorted({((i is not None, i or 0), h, t) for i, h, t in keyed}, key=lambda x: x[:2])
    want = brute_spans([((i[1] if i[0] else None, t or ""), t) for i, h, t in order])
    rows = suffix_dedup.remove_repeats(table, carried=table["text"]).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept), [tuple(s) for s in r.spans]) == want[r.doc_id, r.carried or ""]
    assert sum(w[1] for w in want.values()) > 80_000


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(40)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(r.randint(1, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[r.randint(0, 119)][1]) for i in range(20)]
    rows += [(300, "ab" * 900), (301, "abab" * 500), (302, "the " * 200 + passages[0])]
    want = brute_spans(rows)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(toy(spark, rows).repartition(5), with_kept=False).collect()}
    assert got == {k: v[:4] for k, v in want.items()}


def test_texts_of_one_id_whose_short_hashes_are_equal(spark):
    """Spark's 32-bit hash is equal for texts 0 and 1 (of different lengths), and for 2 and 3 (of one length)."""
    from pyspark.sql import functions as F

    from crosstape.llm.columns import text_key

    from .conftest import PASSAGE

    texts = [f"text {n} {PASSAGE}" for n in ("12107", "387589", "70458 and some more words", "82894 and some more words")]
    df = toy(spark, [(None, t) for t in texts])
    keyed = {r.text: (r.h, r.k) for r in df.select("text", F.hash("text").alias("h"), text_key(F.col("text")).alias("k")).collect()}
    assert [keyed[t][0] for t in texts[::2]] == [keyed[t][0] for t in texts[1::2]] and len({k for _, k in keyed.values()}) == 4
    want = brute_spans([(t, t) for t in sorted(texts, key=lambda t: keyed[t][1])])
    rows = suffix_dedup.remove_repeats(df, carried=df["text"]).collect()
    assert {r.carried: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {t: w[:4] for t, w in want.items()} and len(rows) == 4


# --- n-gram join -----------------------------------------------------------------------


def brute_links(rows, k=5, threshold=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)].append(d)
    return Counter((d, len(sets[i]), (min(least[top(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def links(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_orders.similarity_components(df).collect())


def test_links_on_the_odd_table(table):
    assert links(table) == brute_links(ROWS)


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_links_at_random(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_orders, "DIRECT", 8)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    common = text(40)
    texts = [text(r.randint(1, 120)) for _ in range(60)]
    for size, edits in ((90, 3), (30, 6), (12, 4), (2, 2)):
        texts += near_copies(r, text(100), size, edits)
    texts += [common + " " + text(r.randint(5, 25)) for _ in range(60)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 100, 8)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert links(toy(spark, rows).repartition(4)) == brute_links(rows)


def test_frequent_tokens_come_last():
    tokens = np.arange(10, dtype=np.uint64)
    heavy, rank = np.array([2, 5, 7], np.uint64), np.array([1, 0, 2], np.uint64)
    assert ngram_orders.in_order(tokens, heavy, rank, 0, 10)[-3:].tolist() == [5, 2, 7]
    first = ngram_orders.in_order(tokens, heavy, rank, 0, 10)
    assert ngram_orders.in_order(tokens, heavy, rank, 0, 4).tolist() == first[:4].tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 240)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 240)]}


# --- line templates --------------------------------------------------------------------


def brute_lines(rows, depth=3, min_tokens=1, min_docs=10, similarity=0.7):
    """(doc key, text) -> numbers of the lines that go. Keys sort as documents do."""
    lines = []
    for key, text in rows:
        for no, raw in enumerate((text or "").split("\n")):
            t = re.sub("[0-9]+", "<*>", re.sub("[ \t\r]+", " ", raw).strip(" ")).split(" ")
            if t != [""] and len(t) >= min_tokens:
                lines.append((key, no, tuple(t), (len(t), *t[:depth])))
    size = Counter(x[3] for x in lines)
    lines = [x for x in lines if size[x[3]] >= min_docs]
    count = Counter((x[3], x[2]) for x in lines)
    seeds = {}
    for (leaf, t), n in count.items():
        best = seeds.get(leaf)
        if best is None or (-n, " ".join(t)) < best[:2]:
            seeds[leaf] = (-n, " ".join(t), t)
    named = [(k, no, leaf if sum(a == b for a, b in zip(t, seeds[leaf][2], strict=True)) >= similarity * len(t) else t) for k, no, t, leaf in lines]
    docs = defaultdict(set)
    for k, _, name in named:
        docs[name].add(k)
    gone = defaultdict(set)
    for k, no, name in named:
        if len(docs[name]) >= min_docs and k != min(docs[name]):
            gone[k].add(no)
    return gone


def test_lines(spark):
    r = random.Random(5)
    words = [f"tok{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(60):
        body = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(6)]
        body.append(f"request  from host {r.choice(['bob', 'eve', 'kim'])} took {i} ms  in total")
        if i % 3:
            body.insert(r.randint(0, 5), "All rights are reserved by nobody.")
        body += ["a b c"] * (i % 2) + [""]
        rows.append((i, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "request from host ann took 9 ms in total"), (102, "request from host ann took 9 ms in total")]
    gone = brute_lines(list(dict.fromkeys(rows)))
    df = toy(spark, rows)
    got = line_templates.drop_recurring(df.repartition(3)).collect()
    assert len(got) == len(rows)
    for x in got:
        text = dict(rows)[x.doc_id]
        want = None if text is None else "\n".join(t for n, t in enumerate(text.split("\n")) if n not in gone[x.doc_id])
        assert (x.text, x._dropped) == (want, len(gone[x.doc_id]))
    found = {t.text: t.docs for t in line_templates.templates(df).collect()}
    assert found["request from host <*> took <*> ms in total"] == 61 and found["All rights are reserved by nobody."] == 40


def test_lines_beyond_the_broadcast_bound(spark, table, monkeypatch):
    rows = [(i, f"request {i} took {i} ms in total\nown words of document{chr(97 + i % 7)} {chr(97 + i % 5)}") for i in range(40)]
    for df in (toy(spark, rows), table):
        report = lambda d=df: Counter(map(tuple, line_templates.line_report(d, min_docs=2).collect()))
        small = report()
        with monkeypatch.context() as m:
            m.setattr(line_templates, "SMALL", -1)
            assert report() == small
        assert sum(n for _, _, n, _ in small.elements()) > 0


def test_lines_on_the_odd_table(table, nothing):
    got = line_templates.drop_recurring(table, min_docs=2).collect()
    assert len(got) == len(ROWS) and set(got[0].asDict()) == {*table.columns, "_dropped"}
    assert sum(r._dropped for r in got) == 2 and all(r.text == "" for r in got if r._dropped)
    assert line_templates.line_report(table).count() == len(ROWS)
    assert line_templates.line_report(nothing).count() == line_templates.templates(nothing).count() == 0


def test_empty_tables(nothing):
    assert ngram_orders.similarity_components(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_sketches_never_lose_a_link():
    r = np.random.default_rng(4)
    pool = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64))
    for n in (1, 30, 400, 3000):
        x = np.sort(r.choice(pool, n, replace=False))
        for kept in (0.3, 0.7, 0.8, 0.86, 1.0):
            y = np.unique(np.concatenate((r.choice(x, max(1, int(n * kept)), replace=False), r.integers(0, 2**63, int(n * (1 - kept))).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            rows = [np.frombuffer(ngram_orders.sketch(s), np.uint8)[None] for s in (x, y)]
            ok = ngram_orders.may_link(*rows, np.array([len(x)]), np.array([len(y)]), 75)[0]
            assert ok or 100 * both < 75 * (len(x) + len(y) - both)
    full = np.full((1, 256), 255, np.uint8)
    assert ngram_orders.may_link(full, full, np.array([10**6]), np.array([10**6]), 75)[0]


def kept_by_hand(rows):
    """doc_id, keep_id, group_size, kept of each row, by plain Python: the largest id of equal texts stays."""
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(text or "", []).append((key is not None, key or 0, -i, i))
    stays = {text: max(g) for text, g in groups.items()}
    size = {text: len(g) for text, g in groups.items()}
    keep_id = lambda t: stays[t][1] if stays[t][0] else None
    return [(key, keep_id(text or ""), size[text or ""], stays[text or ""][3] == i, hashlib.sha256((text or "").encode()).hexdigest()) for i, (key, text) in enumerate(rows)]


def _sorted(rows):
    return sorted(rows, key=str)


def test_digest_index_of_odd_rows(spark, table, nothing):
    got = digest_index.deduplicate(table, scratch(spark, "digests"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert _sorted(map(tuple, got.collect())) == _sorted(kept_by_hand(ROWS))
    assert digest_index.deduplicate(nothing, scratch(spark, "digests")).collect() == []


def test_digest_index_lives_on(spark, table):
    """A second batch meets the first one's texts, a repeated batch changes nothing, and a dropped catalogue entry is found again by its path."""
    path = scratch(spark, "digests")
    first = digest_index.DigestIndex(spark, path, expect=20)
    early, late = table.filter("doc_id <= 8"), table.filter("doc_id > 8 or doc_id is null")
    assert first.drop_copies(early, "a").count() == 6  # of 1 2 2 3 4 5 6 7 8 one of 1, 2, 2 and one of 3, 4 stays
    spark.sql(f"DROP TABLE {first.table}")
    again = digest_index.DigestIndex(spark, path)
    assert again.buckets == first.buckets and again.stored().count() == 6
    more = again.drop_copies(late, "b")
    assert more.columns == table.columns
    texts = {t or "" for i, t in ROWS if i is None or i > 8} - {t or "" for i, t in ROWS if i is not None and i <= 8}
    assert sorted(r.text or "" for r in more.collect()) == sorted(texts)
    before = _sorted(map(tuple, again.report().collect()))
    again.add(late, "b")
    assert _sorted(map(tuple, again.report().collect())) == before and again.stored().count() == 6 + len(texts)


def test_digest_index_hot_group(spark, monkeypatch):
    """A group with most of the rows takes the broadcast side, the rest the shuffle."""
    rows = [(i, "same") for i in range(300)] + [(i, f"text {i % 40}") for i in range(300, 400)]
    monkeypatch.setattr(digest_index, "HOT", 2)
    got = digest_index.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "digests"))
    assert _sorted(map(tuple, got.collect())) == _sorted(kept_by_hand(rows))


def test_digest_index_is_native(spark, table):
    plan = digest_index.deduplicate(table, scratch(spark, "digests"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
