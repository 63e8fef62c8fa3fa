"""Encode long texts through a bounded cache of space-delimited chunks.

The byte-level pre-tokenisers handled here start a new pre-token at any space that
follows a character other than white space. So a text may be cut before such spaces and
every chunk encoded by itself: the ids joined are those of the whole text. Natural text
repeats its chunks, so most of them come from the cache.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

#: A chunk must not end in white space (a run of white space is one match of the pattern).
_RUN = re.compile(r"\s ")


class Pieces(dict):
    """chunk -> value of encode(list of chunk texts). A chunk stands for the text " " + chunk;
    the first one of a text, which has no space before it, is kept as the tuple (chunk,)."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 600_000):
        super().__init__()
        self.encode, self.most, self.before = encode, most, {}

    @staticmethod
    def chunks(text: str) -> list:
        parts: list = text.split(" ")
        if _RUN.search(text):
            whole = [parts[0]]
            for p in parts[1:]:
                if whole[-1][-1:].isspace() or (not whole[-1] and len(whole) > 1):
                    whole[-1] += " " + p
                else:
                    whole.append(p)
            parts = whole
        parts[0] = (parts[0],)
        return parts if parts[0][0] else parts[1:]

    def fill(self, texts: Iterable[list]) -> None:
        """Encode the chunks that are not known yet. A full cache becomes the one before, of which
        only what is asked for again moves on."""
        new = set().union(*texts) - self.keys()
        if len(self) + len(new) > self.most:
            self.before = dict(self)
            self.clear()
            new = set().union(*texts)
        known = new & self.before.keys()
        self.update((k, self.before[k]) for k in known)
        keys = list(new - known)
        for lo in range(0, len(keys), 20_000):
            part = keys[lo : lo + 20_000]
            self.update(zip(part, self.encode([k[0] if isinstance(k, tuple) else " " + k for k in part]), strict=True))


#: Bytes a text isn't cut behind, the ASCII blanks.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_POINT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_POINT[list(b".,;:!?")] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def chunk_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the chunks of texts laid end to end start: at every text, at every space behind a character
    that is no white space, and at every _POINT behind a Latin letter (letters and points never share a
    pre-token, and points open no longer one with letters before them), and behind a lone line feed. Behind a character that may be white space
    (its first byte being that of some other blank) there is no cut, which only makes a chunk longer."""
    space = np.flatnonzero(data == 0x20)
    space = space[space > 0]
    one, two, three = (data[np.maximum(space - k, 0)] for k in (1, 2, 3))
    cut = np.where(one < 0x80, ~_BLANK[one], np.where(two >= 0xC0, two != 0xC2, (three < 0xC0) | (three == 0xE0) | (three > 0xE3)))
    starts = np.zeros(len(data) + 1, bool)
    starts[space[cut]] = True
    point = np.flatnonzero(_POINT[data])
    point = point[point > 0]
    one, two = data[point - 1], data[np.maximum(point - 2, 0)]
    starts[point[_LETTER[one] | ((one >= 0x80) & (one != 0x97) & (one != 0xB7) & (two == 0xC3))]] = True
    # Behind a single line feed that a letter follows: it is a pre-token, or the end of one, either way.
    line = np.flatnonzero(data == 0x0A)
    line = line[(line > 0) & (line < len(data) - 1)]
    before = data[line - 1]
    starts[line[(before < 0x80) & ~_BLANK[before] & _LETTER[data[line + 1]]] + 1] = True
    starts[at] = True
    return np.flatnonzero(starts[:-1])


def gathered(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ragged rows, end to end, and the rows' lengths."""
    size = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class ChunkIds:
    """Ids of chunks in one growing ragged array; a chunk is encoded once while it is held. Row 0 holds the end id.
    Of more than `most` chunks the half used longest ago goes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], end_id: int, most: int = 600_000):
        self.encode, self.most, self.turn = encode, most, 0
        self.row: dict[str, int] = {}
        self.ids, self.at = np.array([end_id], np.uint32), np.array([0, 1])
        self.used = np.zeros(1, np.int64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """Row of each (distinct) chunk."""
        self.turn += 1
        got = np.fromiter(map(self.row.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(got < 0)
        if len(self.row) + len(missing) > self.most and self.row:
            self.used[got[got >= 0]] = self.turn
            self._forget()
            got = np.fromiter(map(self.row.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
            missing = np.flatnonzero(got < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            found = [x for lo in range(0, len(new), 20_000) for x in self.encode(new[lo : lo + 20_000])]
            first = len(self.at) - 1
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(found), "<u4")))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) // 4 for x in found])))
            got[missing] = first + np.arange(len(new))
            self.row.update(zip(new, got[missing].tolist(), strict=True))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        self.used[got] = self.turn
        return got

    def _forget(self) -> None:
        """Keep the more recently used half, and all of this turn."""
        line = min(int(np.median(self.used[1:])) + 1, self.turn)
        stays = np.flatnonzero(self.used >= line)
        stays = np.concatenate(([0], stays[stays > 0]))
        moved = np.full(len(self.used), -1)
        moved[stays] = np.arange(len(stays))
        entry, size = gathered(self.at, stays)
        self.ids, self.at, self.used = self.ids[entry], np.concatenate(([0], np.cumsum(size))), self.used[stays]
        to = moved.tolist()
        self.row = {k: to[r] for k, r in self.row.items() if to[r] >= 0}


_LOADED: dict = {}


def tokenizer(path: str):
    """A tokenizers.Tokenizer per worker, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _LOADED[path] = t
    return _LOADED[path]


def encode_chunks(tok, texts: list[str], together: int = 64) -> list[bytes]:
    """Ids (unsigned 32-bit) of each chunk text. Chunks that start with a space or a Latin letter and don't end in
    white space are encoded together, as one text; the bytes that each token stands for tell where a chunk ends."""
    if ("length", id(tok)) not in _LOADED:
        length = np.zeros(tok.get_vocab_size(), np.int64)
        for piece, i in tok.get_vocab().items():
            length[i] = len(piece)  # a character stands for a byte
        _LOADED["length", id(tok)] = length
    length = _LOADED["length", id(tok)]
    out: list = [None] * len(texts)
    letter = lambda t: t[0].isascii() and t[0].isalpha()
    joint = [i for i, t in enumerate(texts) if t and not t[-1].isspace() and (t[0] == " " or letter(t))]
    groups = [joint[lo : lo + together] for lo in range(0, len(joint), together)]
    # A line feed keeps a chunk that starts with a letter from the one before.
    told = [[texts[i] if texts[i][0] == " " else "\n" + texts[i] for i in g] for g in groups]
    for group, parts, e in zip(groups, told, tok.encode_batch_fast(["".join(p) for p in told], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        at = np.concatenate(([0], np.cumsum(length[ids])))
        size = np.array([len(p.encode()) for p in parts])
        ends = np.cumsum(size)
        starts = ends - size + np.array([p[0] == "\n" for p in parts])
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
        if at[-1] == ends[-1] and (at[lo] == starts).all() and (at[hi] == ends).all():
            raw = ids.tobytes()
            for i, x, y in zip(group, (4 * lo).tolist(), (4 * hi).tolist(), strict=True):
                out[i] = raw[x:y]
    alone = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(alone, tok.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def worker_cache(key: tuple, make: Callable[[], Pieces]) -> Pieces:
    """The cache outlives a task: Spark reuses its Python workers."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def batches(texts: list[str], most_chars: int = 4_000_000):
    """Groups of whole texts, so that their chunk lists stay small."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most_chars:
            yield lo, texts[lo:i]
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]
