"""Dual-tree search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from crosstape.llm import dual_tree as dt

from .conftest import ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(lower))


def by_hand(docs, items, k=10):
    """Every document of every item, with Python's integers."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for key, text in sorted(set(items), key=str):
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            s = sum(weight(t) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i))
        out += [(key, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = dt.search(d, spark.createDataFrame(items, "item_id long, text string"), **kw)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_scoring_all(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Été", "ÀB", "x1y2", "日本"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "-", "\n", "_"]) for _ in range(r.randint(0, n)))
    docs = [(i, text(r.choice([3, 40, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(30)] + [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (6, None), (None, "w1 w2 w4")]
    items = [(i, text(40)) for i in range(70)] + [(70, docs[3][1]), (71, "w1 w1 w1 w2"), (72, None), (73, " ... "), (74, "unseen words only"), (71, "w1 w1 w1 w2"), (None, "w7 w8")]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_items_in_parts(spark, monkeypatch):
    docs = [(i, f"alpha w{i % 7} w{i % 11} beta") for i in range(90)]
    items = [(i, f"w{i % 7} w{(3 * i) % 11} alpha") for i in range(40)]
    monkeypatch.setattr(dt, "ITEM_BYTES", 200)
    assert found(spark, docs, items, k=4) == by_hand(docs, items, k=4)


def blocks_of(docs, rows, n_terms):
    ids = np.arange(len(docs))
    size = np.array([len(d) for d in docs])
    cols = np.concatenate([np.array(sorted(d), np.int64) for d in docs])
    tf = np.concatenate([np.array([d[t] for t in sorted(d)], np.int64) for d in docs])
    return ids, np.concatenate(([0], np.cumsum(size))), cols, tf


@pytest.mark.parametrize("scale", [1, 10**7])
def test_bounds_prune_and_lose_nothing(scale):
    """Two topics: most pairs are dropped by node bounds, the best stay. With huge weights sums are 64-bit integers."""
    r = random.Random(3)
    topic = lambda i: 0 if i < 1500 else 60
    docs = [dict(Counter(topic(i) + min(59, int(r.paretovariate(0.8))) for _ in range(r.choice([4, 20, 80])))) for i in range(3000)]
    rows = [dict(Counter(topic(1500 * (j % 2)) + r.randrange(60) for _ in range(12))) for j in range(40)]
    weights = np.array([scale * r.randrange(1, 9000) for _ in range(120)], np.int64)
    ids, at, cols, tf = blocks_of(docs, rows, 120)
    values = 1_000_000_000 * tf // (1000 * tf + 800)
    items = dt.Items(rows, weights, 10)
    assert (items.slack == 1.0) == (scale == 1)
    for lo, hi in ((0, 1000), (1000, 2200), (2200, 3000)):
        cut = slice(at[lo], at[hi])
        items.search(dt.Block(ids[lo:hi], at[lo : hi + 1] - at[lo], cols[cut], tf[cut], values[cut], weights))
    full = defaultdict(list)
    for j, row in enumerate(rows):
        for i, d in enumerate(docs):
            s = sum(int(weights[t]) * q * (1_000_000_000 * d[t] // (1000 * d[t] + 800)) for t, q in row.items() if t in d)
            full[j].append((-s, i))
    for j in range(len(rows)):
        want = [(i, -s) for s, i in sorted(full[j])[:10]]
        assert list(zip(items.ids[j][::-1].tolist(), items.scores[j][::-1].tolist(), strict=True)) == want
    assert items.pairs == 40 * 3000 and items.scored < 0.5 * items.pairs


def test_node_maxima_bound_every_pair():
    r = np.random.default_rng(5)
    docs = [{int(t): int(r.integers(1, 5)) for t in r.choice(50, 6, replace=False)} for _ in range(300)]
    ids, at, cols, tf = blocks_of(docs, None, 50)
    weights = r.integers(1, 1000, 50)
    values = 1_000_000_000 * tf // (1000 * tf + 800)
    block = dt.Block(ids, at, cols, tf, values, weights)
    columns, top = np.arange(block.levels[0].shape[1]), np.ones(block.levels[0].shape[1], np.int64)
    for level in range(len(block.levels)):
        nodes = np.arange(len(block.levels[level]))
        bound = block.bounds(level, nodes, columns, top.astype(float))
        for node in nodes.tolist():
            under = np.array([node])
            for step in range(level, -1, -1):
                under = block.below(step, under)
            assert block.scores(under, columns, top).max() <= bound[node]


def test_odd_rows(spark, table, nothing):
    items = [(1, "the quick brown FOX"), (2, "palabra ñandú"), (3, "text without an id"), (4, None)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, dt.search(table, asked).collect()), key=str) == by_hand(ROWS, items)
    assert dt.search(nothing, asked).collect() == [] and dt.search(table, asked.filter("false")).collect() == []
