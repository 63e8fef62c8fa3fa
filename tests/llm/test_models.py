"""URL rules, bit-sliced search, language ID and audio columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crosstape.llm import audio, bitsliced, langid, url_filter

from .conftest import ROWS

# --- URL filter ------------------------------------------------------------------------

URLS = [
    None,
    "",
    "no scheme here",
    "http://Example.COM/en/1",
    "http://www.example.com/en/1",
    "http://a.www.example.com/en/x?y=/en/",
    "http://example.com",
    "http://example.com/de/porn",
    "https://x.net/es/a",
    "https://x.net/fr/a#b",
    "https://net/fr/",
    "https://xnet/fr/",
    "https://y.org/adult/1",
    "https://y.org/adulthood",
    "https://y.org/free-free",
    "https://y.org/free-poker",
    "https://y.org/q?t=free&u=poker",
    "https://casino.org",
    "x://h://p?q",
    "http://example.com:80/en/",
    "https://ÉX.org/Path",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    low = (url or "").lower()
    count = lambda words: sum(any((m.start() == 0 or not low[m.start() - 1].isalnum()) and (m.end() == len(low) or not low[m.end()].isalnum()) for m in re.finditer(w, low)) for w in words)
    strict, soft = count(url_filter.STRICT), count(url_filter.SOFT)
    best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "block" if strict or soft >= 2 else "allow", strict, soft


def test_urls(spark):
    urls = URLS + URLS[:3]
    df = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rows = url_filter.judge(df).collect()
    assert Counter(tuple(r) for r in rows) == Counter((i if i else None, *brute_url(u)) for i, u in enumerate(urls))
    verdict = {u: r.verdict for u, r in zip(urls, sorted(rows, key=lambda r: r.page_id or 0), strict=True)}
    assert verdict["http://www.example.com/en/1"] == "allow" and verdict["http://Example.COM/en/1"] == "block"
    assert verdict["http://example.com/de/porn"] == "allow" and verdict["https://y.org/adult/1"] == "block"
    assert verdict["https://y.org/free-free"] == "allow" and verdict["https://y.org/free-poker"] == "block"
    assert url_filter.judge(df.filter("false")).count() == 0


def test_no_rules_and_no_terms(spark):
    df = spark.createDataFrame([(1, "http://a.com/porn")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(df, rules=(), strict=(), soft=()).collect()] == [(None, "allow")]


# --- bit-sliced search -----------------------------------------------------------------


def brute_top(rows, k, every=50, scale=256):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % every == 0 and v is not None:
            asked.setdefault(i, []).append(v)
    out = []
    for q, v in ok:
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, seed, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK", 97)
    monkeypatch.setattr(bitsliced, "QUERIES", 3)
    r = np.random.default_rng(seed)
    rows = [(i, (r.standard_normal(9) * (1 if seed else 40)).astype(np.float32).tolist()) for i in range(400)]
    rows[50] = (50, [0.0] * 9)
    rows[100] = (100, rows[7][1])
    rows[3:6] = [(3, None), (4, [1.0, None] + [0.0] * 7), (5, [float("nan")] + [0.0] * 8)]
    rows[150] = (150, [float("inf")] + [0.0] * 8)
    rows[8] = (8, [0.5, -0.5])
    rows += [(None, [1.0] * 9)] + [(1000 + i, rows[7][1]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, ids int, block int")
    got = sorted(map(tuple, bitsliced.top_k(df).collect()))
    assert got == sorted(brute_top(rows, 5))


def test_top_k_of_ids_with_a_bad_row(spark):
    """A row that takes no part hides no usable row of its id."""
    inf = float("inf")
    rows = [(50, [1.0, 1.0]), (50, [1.0, None]), (50, [None, 1.0]), (100, [-inf, 0.0]), (100, [1.0, 0.0]), (100, [float("nan"), 0.0]), (7, [2.0, 0.0]), (150, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(50, 1, 7, 131072), (50, 2, 100, 65536), (100, 1, 7, 131072), (100, 2, 50, 65536)]
    assert sorted(map(tuple, bitsliced.top_k(df).collect())) == want


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (7, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, bitsliced.top_k(df).collect())) == [(0, 1, 50, 131072), (0, 2, 7, -65536), (50, 1, 0, 131072), (50, 2, 7, -131072)]
    assert bitsliced.top_k(df.filter("false")).count() == 0 == bitsliced.top_k(df.filter("vec_id = 0")).count()


# --- language ID -----------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    m = langid.BiGru(["a", "b", "c"], embed=3, hidden=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    data, size = langid.padded([b"ab", b"xyz", b"q"])
    data, live = data.T, np.arange(3)[:, None] < size
    label, weight = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        prob = m.positions(data, live)[0]
        w = live * weight
        return -(np.log(prob[:, np.arange(3), label]) * w).sum() / w.sum()

    # States are kept in single precision, so the steps are coarse.
    g = m.gradients(data, live, label, weight)
    r = np.random.default_rng(0)
    for name in m.p:
        step = r.standard_normal(m.p[name].shape)
        before = m.p[name]
        m.p[name] = before + 1e-2 * step
        up = loss()
        m.p[name] = before - 1e-2 * step
        down = loss()
        m.p[name] = before
        assert np.isclose((up - down) / 2e-2, (g[name] * step).sum(), rtol=0.05, atol=2e-3), name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, table, nothing):
    rows = langid.identify(table).collect()
    assert len(rows) == len(ROWS)
    langs = {"en", "es", "und"}
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert r.doc_id == i and r.lang_pred in langs and r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    by_text = dict(zip([r.doc_id for r in rows], [r.lang_pred for r in rows], strict=True))
    assert by_text[3] == by_text[4] == by_text[5] == by_text[16] == "und" and by_text[8] == "es"
    assert langid.identify(nothing).count() == 0
    unlabelled = langid.identify(table.withColumn("lang", table["lang"].substr(1, 0)).filter("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


# --- audio columns ---------------------------------------------------------------------


def test_audio(table, nothing):
    rows = audio.audio_columns(table).collect()
    want = Counter()
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    by_text = {}
    for r in rows:
        media, tensors = bytes(r.media), bytes(r.tensors)
        assert len(media) == r.media_bytes and hashlib.sha256(media).hexdigest() == r.media_sha256
        assert hashlib.sha256(audio.from_wav(media)).hexdigest() == r.payload_sha256
        mel, batch = audio.from_arrow(tensors)
        assert isinstance(batch.schema.field("mel").type, pa.FixedShapeTensorType) and mel.shape[1:] == audio.SHAPE
        assert sum(batch.column("frames").to_pylist()) == r.frames and len(r.spans) == r.segments
        assert all(a.end_s <= b.start_s for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert by_text.setdefault(r.media_sha256, r.feature) == r.feature
        digest = zlib.crc32(np.round(mel * 16).astype("<i2").tobytes())
        assert r.feature == f"f{r.frames} t{len(mel)} s{len(r.spans)} e{float(mel.reshape(-1, audio.MELS)[: r.frames].mean()):.2f} c{digest:08x}"
    assert audio.audio_columns(nothing).count() == 0
    thin = audio.audio_columns(table, with_media=False)
    assert "tensors" not in thin.columns and Counter(r.feature for r in thin.collect()) == Counter(r.feature for r in rows)


def test_log_mel_and_segments_by_hand():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=9000) * np.repeat(rng.uniform(0.01, 1, 30), 300)).astype(np.float32)
    mel = audio.log_mel(x)
    assert len(mel) == -(-(len(x) - audio.FRAME) // audio.HOP) + 1
    k, n = np.arange(audio.FRAME // 2 + 1)[:, None], np.arange(audio.FRAME)[None]
    wave = np.exp(-2j * np.pi * k * n / audio.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / audio.FRAME)
    for f in range(0, len(mel), 7):
        piece = np.zeros(audio.FRAME)
        cut = x[f * audio.HOP : f * audio.HOP + audio.FRAME]
        piece[: len(cut)] = cut
        power = np.abs(wave @ (piece * window)) ** 2
        assert np.allclose(mel[f], np.maximum(audio.FLOOR, np.log(power @ audio.mel_bank() + 1e-12)), atol=2e-3)
    energy = [float(np.mean(m)) for m in mel]
    mean, spread = float(np.mean(energy)), float(np.std(energy))
    on, start, want = False, 0, []
    for i, e in enumerate([*energy, -1e9]):
        if not on and e >= mean + 0.25 * spread:
            on, start = True, i
        elif on and e < mean - 0.25 * spread:
            on = False
            want.append([start, i])
    assert audio.segments(mel).tolist() == want and len(want) > 1


def test_resampling_in_blocks_is_direct_convolution(monkeypatch):
    monkeypatch.setattr(audio, "BLOCK", 4)
    x = np.random.default_rng(1).standard_normal(300).astype(np.float32)
    taps = audio.phases()
    flat = np.zeros(audio.UP * audio.TAPS)
    for p in range(audio.UP):
        flat[p :: audio.UP] = taps[p][::-1]
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    want = np.convolve(up, flat)[: len(up)][:: audio.DOWN]
    assert np.allclose(audio.resample(x), want[: len(audio.resample(x))], atol=1e-5)


def test_tone_lands_in_its_band_and_segment():
    t = np.arange(16_000) / audio.RATE
    x = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    mel = audio.log_mel(audio.resample(x))
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 3000 / 700), audio.MELS + 2) / 2595) - 1)
    loud = int(mel[len(mel) // 2].argmax())
    assert edge[loud] < 1000 < edge[loud + 2]
    ((a, b),) = audio.segments(mel)
    assert abs(audio.seconds(a) - 0.5) < 0.06 and abs(audio.seconds(b) - 1.5) < 0.06


def test_random_bytes_survive(spark):
    r = random.Random(3)
    rows = [(i, "".join(chr(r.choice([0, 1, 127, 200, 0x20AC, 0x1F600, 65])) for _ in range(r.randint(0, 200)))) for i in range(50)]
    got = {x.doc_id: x for x in audio.audio_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert audio.from_wav(bytes(got[i].media))[: got[i].n_bytes] == t.encode()
