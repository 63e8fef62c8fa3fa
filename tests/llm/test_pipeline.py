"""Each stage on its predecessor's rows, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosstape.llm import packing
from crosstape.llm.columns import keep

from .conftest import PASSAGE
from .test_duplicates import brute_lines, brute_links, brute_spans, near_copies

STAGE = dict(corpus_pipeline.STAGES)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(9)
    words = ["river", "stone", "cloud", "light", "the", "of", "and", "window", "garden", "paper", "sing", "walks"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [text(r.randint(20, 90)) for _ in range(25)]
    texts += near_copies(r, text(80), 8, 3)
    texts = [t + "\n" + "Read the full terms at our site now." * (i % 2) for i, t in enumerate(texts)]
    texts += [text(30) + " " + PASSAGE + " " + text(20) for _ in range(3)]
    texts += [None, "", " ", "123 ...", "Read the full terms at our site now."]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def texts_of(df):
    return sorted((x.doc_id, x.text) for x in df.collect())


def test_stages(spark, docs):
    step = keep(STAGE["language ID"](spark, docs, ""), "t")
    assert step.columns == docs.columns
    # No clean document goes; those without a letter do.
    assert texts_of(step) == [(i, t) for i, t in texts_of(docs.filter("text is not null")) if any(map(str.isalpha, t))]

    before = texts_of(step)
    gone = brute_lines(before)
    left = [(i, "\n".join(t for n, t in enumerate(x.split("\n")) if n not in gone[i])) for i, x in before]
    assert sum(map(len, gone.values())) > 10
    step = keep(STAGE["line dedup"](spark, step, ""), "t")
    assert texts_of(step) == [(i, t) for i, t in left if t.strip() or not gone[i]]
    assert step.filter(F.length("text") != F.col("n_chars")).count() == 0

    before = texts_of(step)
    stay = {c for _, _, c in brute_links(before)}
    step = keep(STAGE["n-gram Jaccard join"](spark, step, ""), "t")
    assert texts_of(step) == [x for x in before if x[0] in stay] and len(stay) < len(before)

    before = texts_of(step)
    want = brute_spans([(x, x[1]) for x in before])
    step = keep(STAGE["suffix-array dedup"](spark, step, ""), "t")
    assert texts_of(step) == [(i, want[i, t][4].decode(errors="ignore")) for i, t in before if want[i, t][4].strip()]
    assert sum(w[1] for w in want.values()) >= 2 * 100 and step.columns == docs.columns

    pieces = STAGE["packing"](spark, step, "").collect()
    same = packing.pack(step, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((p.doc_id, p.start, tuple(p.ids)) for p in pieces) == sorted((p.doc_id, p.start, tuple(p.ids)) for p in same)
    assert {p.doc_id for p in pieces} == {x.doc_id for x in step.collect()}


def test_line_dedup_of_short_lines(spark):
    rows = [(i, f"own{chr(97 + i)} line\nLes.\n" + "And ornd.\n" * (i < 9) + f"page {i}") for i in range(12)]
    got = texts_of(STAGE["line dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    assert got == [rows[0]] + [(i, "\n".join(t for t in x.split("\n") if t != "Les." and not t.startswith("page"))) for i, x in rows[1:]]
    want = brute_lines(rows, min_tokens=1)
    assert got == [(i, "\n".join(t for n, t in enumerate(x.split("\n")) if n not in want[i])) for i, x in rows]


def test_near_duplicates_one_row_per_class(spark):
    """Classes that share an id, or have none, each keep one row."""
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(200))
    alone, (a, b), near, mixed, same = [text() for _ in range(6)], (text(), text()), near_copies(r, text(), 4, 1), near_copies(r, text(), 3, 1), near_copies(r, text(), 2, 1)
    rows = [(None, t) for t in (*alone, *near, alone[0], mixed[0], None, "")] + [(15, a), (15, b), (9, mixed[1]), (7, mixed[2]), (20, same[0]), (20, same[1]), (20, same[1])]
    got = [(x.doc_id, x.text) for x in STAGE["n-gram Jaccard join"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    for t in alone:
        assert got.count((None, t)) == 1
    assert sorted(x for x in got if x[0] == 15) == sorted([(15, a), (15, b)])
    assert sum((None, t) in got for t in near) == 1
    assert [x for x in got if x[1] in mixed] == [(7, mixed[2])]
    assert len([x for x in got if x[0] == 20]) == 1
    assert len(got) == 6 + 2 + 1 + 1 + 1 + 2  # and the two without a word


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(spark, table, nothing, name):
    out = STAGE[name](spark, table, "")
    rows = out.collect()
    assert rows
    if name != "packing":
        assert out.columns == table.columns and {r.key for r in rows} == {"?"}
    assert STAGE[name](spark, nothing, "").count() == 0


def test_run(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(hashlib.sha256(str(r.ids).encode()) for r in rows) and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
