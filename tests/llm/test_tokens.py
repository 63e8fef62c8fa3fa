"""Packing, token counts and byte-level pieces against their libraries, row by row."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from crosstape.llm import byte_pieces, packing, token_counts
from crosstape.llm.columns import scratch
from crosstape.llm.pieces import Pieces

from .conftest import ROWS

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ids():
    tok = Tokenizer.from_file(JSON)
    return [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS]


def test_chunks_join_to_the_text():
    for t in ["", " ", "a", " a", "a  b", "a \n b\n c", "\n \n x ", "a　 b"]:
        parts = Pieces.chunks(t)
        assert "".join(p[0] if isinstance(p, tuple) else " " + p for p in parts) == t


def test_cache_keeps_what_is_asked_for_again():
    seen = []
    c = Pieces(lambda texts: seen.extend(texts) or [len(t) for t in texts], most=3)
    c.fill([["a", "b", "c"]])
    c.fill([["a", "d"]])
    assert seen == sorted(seen) or set(seen) == {" a", " b", " c", " d"}
    assert len(seen) == 4 and c["a"] == 2 and c["d"] == 2


def test_piece_lengths():
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.piece_lengths(1, 2048) == [1] and packing.piece_lengths(2048, 2048) == [2048]


def test_packing(table, ids):
    rows = packing.pack(table, JSON).collect()
    pieces = Counter()
    for i, x in ids:
        x, start = np.array([*x, 1], np.uint32), 0
        for k in packing.piece_lengths(len(x), 2048):
            part = x[start : start + k]
            pieces[i, start, k, zlib.crc32(part.tobytes()), len(x), tuple(part.tolist())] += 1
            start += k
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows) == pieces
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)


def test_counts_and_cache(spark, table, ids):
    path = scratch(spark, "counts")
    want = Counter((i, len((t or "").encode()), len(x), len(x) > 512) for (i, t), (_, x) in zip(ROWS, ids, strict=True))
    part = token_counts.count_tokens(table.filter("doc_id < 9"), JSON, path).count()
    assert part == sum(1 for i, _ in ROWS if i is not None and i < 9)
    before = {bytes(r.content_digest) for r in token_counts.stored(spark, path).collect()}
    for _ in range(2):
        rows = token_counts.count_tokens(table, JSON, path).collect()
        assert Counter(map(tuple, rows)) == want
    stored = token_counts.stored(spark, path).collect()
    assert len(stored) == len({bytes(r.content_digest) for r in stored}) == len({t or "" for _, t in ROWS}) > len(before)


def test_second_batch_meets_the_first(spark, table, ids, monkeypatch):
    encoded = []
    plain = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda d, path: encoded.append(d.count()) or plain(d, path))
    want = Counter((i, len((t or "").encode()), len(x), len(x) > 512) for (i, t), (_, x) in zip(ROWS, ids, strict=True))
    rows = token_counts.count_in_batches(table, JSON, scratch(spark, "counts")).collect()
    assert Counter(map(tuple, rows)) == want
    known = [i for i, _ in ROWS if i is not None]
    middle = (min(known) + max(known)) // 2
    first = {t or "" for i, t in ROWS if i is not None and i > middle}
    second = {t or "" for i, t in ROWS if i is None or i <= middle}
    assert encoded == [len(first), len(second - first)]


def test_byte_pieces(table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in ROWS:
        x = enc.encode_ordinary(t or "")
        want[i, len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode()), tuple(x), (t or "").encode()] += 1
    rows = byte_pieces.encode_decode(table, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), bytes(r.decoded)) for r in rows) == want


def test_byte_characters_are_distinct():
    assert len(set(byte_pieces.byte_characters())) == 256


def test_empty_tables(spark, nothing):
    assert packing.pack(nothing, JSON).count() == 0
    assert byte_pieces.encode_decode(nothing, RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(nothing, JSON, scratch(spark, "counts")).count() == 0
    assert token_counts.count_in_batches(nothing, JSON, scratch(spark, "counts")).count() == 0
