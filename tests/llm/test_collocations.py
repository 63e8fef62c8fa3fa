"""Phrase mining against plain counting, and the summaries' guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crosstape.llm import collocations as co
from crosstape.llm import spans

from .conftest import ROWS


def by_hand(rows, min_count=10, max_words=3, top=2000, inside=50):
    """lang, rank, phrase, a, l, r, n, score of (text, lang) rows, in plain Python with its unbounded integers."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    kept = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= min_count}
    longer = Counter()
    for (lang, w), n in kept.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], n)
    found = {}
    for (lang, w), a in kept.items():
        if 100 * longer[lang, w] >= inside * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:c]] * f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=80), min_size=1, max_size=8), st.integers(2, 12), st.integers(1, 5))
def test_merged_summaries_keep_every_frequent_key(parts, min_count, slack):
    """Whatever way a stream is split: no count lacks min_count / slack or more, none is too high, few counters are held."""
    mass = sum(map(len, parts))
    capacity = slack * mass // min_count + 1
    s = co.Summary(capacity)
    for p in parts:
        keys, counts = np.unique(np.array(p, np.uint32), return_counts=True)
        s.add(keys, counts)
        s.fold()
        assert len(s.keys) <= capacity
    true = Counter(x for p in parts for x in p)
    assert slack * s.lost < min_count
    for key, n in zip(s.keys.tolist(), s.counts.tolist(), strict=True):
        assert true[key] - s.lost <= n <= true[key]
    assert {k for k, n in true.items() if n >= min_count} <= set(s.reaching(min_count).tolist())


def test_small_capacity_loses_counts_but_no_frequent_key():
    s = co.Summary(3)
    for _ in range(20):
        s.add(np.array([1, 2], np.uint32), np.array([5, 4]))
        s.add(np.arange(10, 20, dtype=np.uint32), np.ones(10, np.int64))
        s.fold()
    assert s.lost > 0 and len(s.keys) <= 3 and {1, 2} <= set(s.keys.tolist())


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_counting(spark, monkeypatch, seed):
    """Many partitions, tiny blocks and flushes; common words in two languages and the unknown one."""
    r = random.Random(seed)
    vocab = ["The", "of", "été", "x-1", "naïve", "red", "fox", "it's", "ñ"]
    text = lambda: "".join(r.choice(vocab[: r.randint(2, 9)]) + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", " ; "]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "en", "fr", None, "und"])) for _ in range(250)] + [(None, "en"), ("", None), ("single", "zz")]
    for name, value in (("PER_PART", 600), ("BLOCK", 500), ("FLUSH", 700)):
        monkeypatch.setattr(co, name, value)
    got = co.collocations(frame(spark, rows).repartition(5), top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == by_hand(rows, top=40)


def test_longer_phrases(spark):
    rows = [("a b c d e a b c d e. x y", "en")] * 7 + [("b c d q", "en")] * 9
    got = co.collocations(frame(spark, rows), min_count=5, max_words=4)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, min_count=5, max_words=4)


def test_large_products_are_exact(spark):
    """1000000 * a * a passes 64 bits."""
    n = 6_000_000
    assert 1_000_000 * n * n > 2**63
    counts = [("en", 0, None, 3 * n), ("en", 1, "a", n + 1), ("en", 1, "b", n + 3), ("en", 2, "a b", n)]
    made = spark.createDataFrame(counts, "lang string, words int, phrase string, n long")
    original = co.frequent_phrases
    co.frequent_phrases = lambda *a: made
    try:
        row = co.collocations(frame(spark, [("a", "en")])).first()
    finally:
        co.frequent_phrases = original
    assert tuple(row) == ("en", 1, "a b", n, n + 1, n + 3, 3 * n, 1_000_000 * n * n // ((n + 1) * (n + 3)))


def test_odd_rows(spark, table, nothing):
    rows = [(r.text, r.lang) for r in table.collect()]
    assert len(rows) == len(ROWS)
    assert sorted(map(tuple, co.collocations(table).collect())) == by_hand(rows)
    assert co.collocations(nothing).collect() == []


def test_blocks_end_where_a_piece_ends():
    data = np.frombuffer(b"aaaa bb.cccccccccccccccccccc dd\nee", np.uint8)
    parts = [p.tobytes() for p in spans.blocks(data, co.BREAK, 9)]
    assert b"".join(parts) == data.tobytes() and parts == [b"aaaa bb.", b"cccccccccccccccccccc dd\n", b"ee"]
