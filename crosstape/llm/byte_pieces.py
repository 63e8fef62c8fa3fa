"""Byte-level BPE through a sentencepiece model that is serialised straight from the ranks.

Every byte string of the vocabulary becomes one piece: its bytes are mapped to printable
characters, its score is its negative rank, so the best-scored merge is the lowest rank.
Normalisation is the identity, no dummy prefix, no white-space escape. Pre-tokens are
encoded one by one; decoding maps ids back to their byte strings.

Null and empty texts have no ids. Each row is encoded by itself, repeated rows alike; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import documents
from .pieces import Pieces, batches, worker_cache


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _int(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(ranks: list[bytes]) -> bytes:
    """A ModelProto: piece 0 is the unknown piece, piece 1 + r has rank r.

    Fields: 1 pieces (1 text, 2 score, 3 type; 2 = unknown), 2 trainer (3 model type, 2 = BPE;
    35 byte fallback; 40 to 43 the ids of unknown, begin, end, pad), 3 normaliser (1 name, 3 dummy
    prefix, 4 extra white space removed, 5 white space escaped)."""
    chars = byte_characters()
    out = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int(3, 2))]
    for rank, piece in enumerate(ranks):
        out.append(_field(1, _field(1, "".join(map(chars.__getitem__, piece)).encode()) + b"\x15" + struct.pack("<f", -float(rank))))
    none = (1 << 64) - 1  # -1: no such piece
    out.append(_field(2, _int(3, 2) + _int(4, len(ranks) + 1) + _int(35, 0) + _int(40, 0) + _int(41, none) + _int(42, none) + _int(43, none)))
    out.append(_field(3, _field(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        self.split = regex.compile(pattern).findall
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Its pre-tokens are encoded once each."""
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut) - self.known.keys()) if cut else []
        if len(self.known) + len(new) > 200_000:
            self.known.clear()
            new = list(set().union(*cut))
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in new]
        self.known.update(zip(new, ([i - 1 for i in ids] for ids in self.model.encode(mapped, num_threads=1)), strict=True))
        return [[i for w in words for i in self.known[w]] for words in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def both(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Ids as text and what they decode to."""
        return [(" ".join(map(str, ids)), self.decode(ids)) for ids in self.encode(texts)]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and the decoded bytes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(stream):
        def make() -> Pieces:
            bpe = ByteBpe(ranks_path, pattern)
            return Pieces(bpe.both, most=400_000)

        cache = worker_cache(("pieces", ranks_path, pattern), make)
        for batch in stream:
            keys = batch.column("doc_id")
            for lo, texts in batches([t or "" for t in batch.column("text").to_pylist()]):
                cut = [Pieces.chunks(t) for t in texts]
                cache.fill(cut)
                ids, raw = [], []
                for chunks in cut:
                    got = list(map(cache.__getitem__, chunks))
                    ids.append(" ".join([g[0] for g in got]))
                    raw.append(b"".join([g[1] for g in got]))
                sha = lambda x: hashlib.sha256(x).hexdigest()
                out = [keys[lo : lo + len(texts)], pa.array([s.count(" ") + bool(s) for s in ids], pa.int64()), pa.array([sha(s.encode()) for s in ids]), pa.array(list(map(sha, raw)), pa.string())]
                if with_ids:
                    out += [pa.array([list(map(int, s.split())) for s in ids], pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return documents(docs, id_col, text_col).mapInArrow(run, schema)
