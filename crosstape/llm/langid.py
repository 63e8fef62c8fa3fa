"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a word's bytes from both ends and gives every byte position a distribution
over the languages; a document's probabilities are the mean over all its positions. Its state
starts anew at white space (and every SEGMENT bytes in longer words), so equal words get equal
labels and each distinct word is run once. Trained in numpy by backpropagation through time.

It is fitted on the driver on a bounded sample: SAMPLE_DOCS labelled documents by hash order, of
these at most SAMPLE_WORDS (word, language) pairs, most frequent first. Documents whose
crc32(doc_id) mod 4 is 2 are held out, as are null ids, texts and labels. Everything else covers all rows.

Null texts and texts without a letter are `und` with score 0, and so is everything if no label can be
learned. A null id is not held out. Each row is judged by its text alone, so repeated rows agree;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import slices
from .pieces import _LOADED

SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_LANGS = 3_000, 24_000, 64
SEGMENT = 24
WORD_CACHE = 250_000


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Byte embedding, a gated recurrent layer in each direction, a softmax at each position."""

    def __init__(self, langs: list[str], embed: int = 12, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": draw(256, embed) * 8, "out": draw(2 * hidden, len(langs)), "out_b": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(embed, 3 * hidden), f"h{d}": draw(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _direction(self, d: str, data: np.ndarray, live: np.ndarray, trace: bool):
        """States of one direction for data (time x batch), padding held; live says what is no padding."""
        p, n = self.p, self.hidden
        table = p["embed"] @ p[f"x{d}"] + p[f"b{d}"]
        h = np.zeros((data.shape[1], n), np.float32)
        states, kept = np.empty((*data.shape, n), np.float32), []
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            x, a = table[data[t]], h @ p[f"h{d}"]
            z, r = _sigmoid(x[:, :n] + a[:, :n]), _sigmoid(x[:, n : 2 * n] + a[:, n : 2 * n])
            c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
            on = live[t][:, None]
            new = np.where(on, (1 - z) * h + z * c, h)
            if trace:
                kept.append((t, h, z, r, c, a[:, 2 * n :], on))
            h = new
            states[t] = h
        return states, kept

    def positions(self, data: np.ndarray, live: np.ndarray, trace: bool = False):
        f, kf = self._direction("f", data, live, trace)
        b, kb = self._direction("b", data, live, trace)
        both = np.concatenate((f, b), axis=2)
        logits = both @ self.p["out"] + self.p["out_b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both, kf, kb

    def gradients(self, data: np.ndarray, live: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Backpropagation through time of the mean cross entropy over positions."""
        p, n, g = self.p, self.hidden, {}
        prob, both, kf, kb = self.positions(data, live, True)
        d = prob.copy()
        d[:, np.arange(len(label)), label] -= 1
        w = live * weight
        d *= (w / max(w.sum(), 1e-9))[:, :, None]
        g["out"], g["out_b"] = np.einsum("tbh,tbc->hc", both, d, optimize=True), d.sum((0, 1))
        up = d @ p["out"].T
        g["embed"] = np.zeros_like(p["embed"])
        for name, kept, part in (("f", kf, up[:, :, :n]), ("b", kb, up[:, :, n:])):
            wh, table = p[f"h{name}"], np.zeros((256, 3 * n), np.float32)
            gh, back = np.zeros_like(wh), np.zeros((data.shape[1], n), np.float32)
            for t, h, z, r, c, ac, on in reversed(kept):
                dh = back + part[t]
                live_dh = np.where(on, dh, 0)
                dz, dc = live_dh * (c - h) * z * (1 - z), live_dh * z * (1 - c * c)
                dr = dc * ac * r * (1 - r)
                da = np.concatenate((dz, dr, dc * r), axis=1)
                gh += h.T @ da
                np.add.at(table, data[t], np.concatenate((dz, dr, dc), axis=1))
                back = np.where(on, live_dh * (1 - z) + da @ wh.T, dh)
            g[f"h{name}"], g[f"b{name}"] = gh, table.sum(0)
            g[f"x{name}"] = p["embed"].T @ table
            g["embed"] += table @ p[f"x{name}"].T
        return g

    def fit(self, data: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 384, rate: float = 8e-3, seed: int = 11) -> BiGru:
        """Adam over batches of words of like length."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(size) // batch)
        for _ in range(epochs):
            order = np.argsort(size + r.random(len(size)) * 2, kind="stable")
            cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
            for k in r.permutation(len(cuts)):
                rows = cuts[k]
                longest = int(size[rows].max())
                g = self.gradients(data[rows, :longest].T, np.arange(longest)[:, None] < size[rows], label[rows], weight[rows])
                step += 1
                now = rate * (1 - step / total) + 1e-4
                for name, x in g.items():
                    m[name] += 0.1 * (x - m[name])
                    s[name] += 0.01 * (x * x - s[name])
                    self.p[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its positions' distributions."""
        segments, owner = [], []
        for i, w in enumerate(words):
            for lo in range(0, len(w), SEGMENT):
                segments.append(w[lo : lo + SEGMENT])
                owner.append(i)
        out = np.zeros((len(words), len(self.langs)), np.float64)
        data, size = padded(segments)
        owner = np.array(owner, np.int64)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 2_048):
            rows = order[lo : lo + 2_048]
            longest = int(size[rows].max())
            live = np.arange(longest)[:, None] < size[rows]
            prob = self.positions(data[rows, :longest].T, live)[0]
            np.add.at(out, owner[rows], (prob * live[:, :, None]).sum(axis=0))
        return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, filled with zeros, and their lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, size


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_words(docs: DataFrame) -> list:
    """Rows lang, word, n of the bounded sample. docs: doc_id, text, lang."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64("doc_id")
    last = usable.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return []
    words = usable.filter((h <= last) & F.col("text").isNotNull()).select("lang", F.explode(F.split("text", r"\s+")).alias("word"))
    return words.filter(F.length("word").between(1, 64)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang", "word").limit(SAMPLE_WORDS).collect()


def train(docs: DataFrame) -> BiGru | None:
    rows = training_words(docs)
    total: dict[str, int] = {}
    for r in rows:
        total[r.lang] = total.get(r.lang, 0) + r.n
    langs = sorted(sorted(total, key=lambda k: (-total[k], k))[:SAMPLE_LANGS])
    if not langs:
        return None
    words, label, weight = [], [], []
    for r in rows:
        if r.lang in total and r.lang in langs:
            raw = r.word.encode()
            for lo in range(0, len(raw), SEGMENT):
                words.append(raw[lo : lo + SEGMENT])
                label.append(langs.index(r.lang))
                weight.append(r.n**0.5)
    data, size = padded(words)
    return BiGru(langs).fit(data, size, np.array(label), np.array(weight, np.float32))


def predict(docs: DataFrame, model: BiGru | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs, all columns, with the language and its mean probability."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(stream):
        known: dict = {}
        if model is not None:
            # Equal models share a cache in a worker that is used again.
            known = _LOADED.setdefault(("langid", model.p["out"].tobytes()), {"row": {}, "sums": np.zeros((0, len(model.langs)), np.float32)})
        for batch in stream:
            for lo, hi in slices(batch.column(text_col), 3_000_000):
                part = batch.slice(lo, hi - lo)
                cut = [t.split() if model is not None and t is not None and any(map(str.isalpha, t)) else [] for t in part.column(text_col).to_pylist()]
                new = set().union(*cut) - known.get("row", {}).keys()
                if new:
                    if len(known["row"]) + len(new) > WORD_CACHE:
                        known["row"], known["sums"] = {}, known["sums"][:0]
                        new = set().union(*cut)
                    fresh = sorted(new)
                    known["row"].update(zip(fresh, range(len(known["row"]), len(known["row"]) + len(fresh)), strict=True))
                    known["sums"] = np.concatenate((known["sums"], *(model.word_sums([w.encode() for w in fresh[i : i + 20_000]]).astype(np.float32) for i in range(0, len(fresh), 20_000))))
                names, scores = [], []
                for words in cut:
                    if not words:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    total = known["sums"][np.fromiter(map(known["row"].__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
                    best = int(np.argmax(total))
                    names.append(model.langs[best])
                    scores.append(float(min(1.0, total[best] / total.sum())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    return predict(d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(d)).drop("text")
