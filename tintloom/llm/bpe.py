"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The rank file becomes a sentencepiece BPE model: every token's bytes are mapped to printable characters,
one character a byte, its score is the negative rank, and normalisation is the identity. A text is parted by
the pattern, each part is mapped, encoded, and the ids' pieces mapped back to bytes when decoding.

Nulls count as empty texts. An empty text has no ids (n_tokens 0, digests of the empty string). Repeated rows
give repeated results; texts of any length are encoded whole. A null doc_id stays null. An empty table gives an empty result. Only doc_id and text are read, whatever
other columns are named.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_of, small_batches, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """For each byte a printable character of its own: itself if printable and no blank, else one from U+0100 on."""
    spare = iter(range(0x100, 0x200))
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= 2**64 - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    """A protocol buffer field: a varint, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(pieces: list[str]) -> bytes:
    """A sentencepiece ModelProto: piece i has score -i; the unknown piece comes last."""
    out = [_field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -i) + _field(3, 1)) for i, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Coder(dict):
    """Maps a stretch of text (white space, then what follows up to the next white space) to its ids as text.

    As a dict it keeps what it has met, in two generations so that it stays bounded.
    """

    most = 150_000
    #: A match of the pattern never runs from other characters into white space, so a text may be cut here.
    stretches = re.compile(r"\s*\S+|\s+").findall
    #: Python takes these for white space, the pattern doesn't.
    odd = re.compile("[\x1c-\x1f]").search

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        super().__init__()
        chars = byte_characters()
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be 0, 1, 2 ... and cover all single bytes")
        self.tokens = sorted(ranks, key=ranks.get)
        pieces = [t.decode("latin-1").translate(dict(enumerate(chars))) for t in self.tokens]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(pieces))
        self.to_piece = dict(enumerate(chars))
        self.parts = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {str(i): bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(pieces))}
        # A part that is a token as a whole is that token, even where merging its bytes ends elsewhere.
        self.whole = {p: i for i, (p, got) in enumerate(zip(pieces, self.model.encode(pieces), strict=True)) if got != [i]}
        self.older: dict[str, str] = {}

    def encode_part(self, part: str) -> list[int]:
        piece = part.encode("utf-8").decode("latin-1").translate(self.to_piece)
        return [self.whole[piece]] if piece in self.whole else self.model.encode(piece)

    def __missing__(self, stretch: str) -> str:
        ids = self.older.get(stretch)
        if ids is None:
            ids = " ".join(str(i) for part in self.parts(stretch) for i in self.encode_part(part))
        if len(stretch) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal, joined by one space."""
        found = [text] if self.odd(text) else self.stretches(text)
        return " ".join([self[s] for s in found]) if text else ""

    def decode(self, ids: str) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.split(" ")]) if ids else b""


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Coder(ranks, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or default_path(VOCABULARY), pattern or public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), with keep_ids also ids array<int> and decoded string.

    path: the rank file's place on every executor. One narrow pass: no shuffle.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep_ids else []

    def run(batches):
        code = coder(*_settings(path, pattern))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(text.as_py())
                data = code.decode(ids)
                row = (doc, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest())
                rows.append((*row, [int(i) for i in ids.split(" ")] if ids else [], data.decode("utf-8")) if keep_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(id_of().alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op5_byte_bpe(spark, sf_dir):
    from .common import table

    return encode_decode(table(spark, sf_dir, "documents"))


