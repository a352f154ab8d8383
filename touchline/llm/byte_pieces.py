"""Byte-level BPE run by sentencepiece, from a model serialised straight from a rank file.

The rank file lists byte strings and their ranks. Each becomes a piece whose bytes are mapped one to one to printable
characters and whose score is its negative rank, under an identity normaliser, so that the library's best-score-first merging
is lowest-rank-first merging. Texts are cut by the vocabulary's pattern; every pre-token is encoded on its own.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from touchline.llm.common import slices

CACHED_PRETOKENS = 100_000  # a worker's cache of encoded pre-tokens is emptied beyond this many; results don't depend on it


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in rank order (ranks must be 0..n-1)."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in rows}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be the numbers from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(maxsize=1)
def byte_characters() -> str:
    """One printable character per byte: a byte that prints stands for itself, the others for 256, 257, ... in turn."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in prints else chr(next(others)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, float (32 bit) or whole number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


# Fixed values of the sentencepiece model format: field numbers and enumeration values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE = 3, 2, 4
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the byte strings: piece i has id i; the unknown piece, which byte texts never need, is last."""
    characters = byte_characters()
    out = [
        _field(PIECES, _field(PIECE_TEXT, "".join(characters[b] for b in piece).encode()) + _field(PIECE_SCORE, float(-rank))
               + _field(PIECE_TYPE, NORMAL))
        for rank, piece in enumerate(pieces)
    ]
    out.append(_field(PIECES, _field(PIECE_TEXT, b"<unk>") + _field(PIECE_SCORE, 0.0) + _field(PIECE_TYPE, UNKNOWN)))
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces) + 1)))
    out.append(_field(NORMALIZER, _field(NAME, b"identity") + _field(ADD_DUMMY_PREFIX, 0) + _field(REMOVE_EXTRA_WHITESPACES, 0)
                      + _field(ESCAPE_WHITESPACES, 0)))
    return b"".join(out)


class _Encoder(dict):
    """Pre-token -> its ids as packed int32. A pre-token that is a piece is that piece, as in the reference library of ranks."""

    def __init__(self, pieces: list[bytes], model: bytes):
        self.whole = {piece: i for i, piece in enumerate(pieces)}
        self.map = {i: c for i, c in enumerate(byte_characters())}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)

    def __missing__(self, pretoken: str) -> bytes:
        raw = pretoken.encode("utf-8", "replace")
        i = self.whole.get(raw)
        ids = [i] if i is not None else self.processor.encode(raw.decode("latin-1").translate(self.map))
        self[pretoken] = packed = np.array(ids, np.int32).tobytes()
        return packed


def _white_space(pattern: str) -> str:
    """The pattern with \\s as Unicode white space, whatever the regular-expression library takes \\s for."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class BytePieces:
    """Encoder and decoder of text columns. `ranks_path` is read once, where the object is made; executors get the model."""

    def __init__(self, ranks_path: str, pattern: str):
        self.pieces = read_ranks(ranks_path)
        self.pattern = _white_space(pattern)
        self.model = serialise(self.pieces)

    def encode(self, text: Column) -> Column:
        """Ids (array<int>) of whole texts, without special tokens; null and empty texts give an empty array."""
        pieces, pattern, model = self.pieces, self.pattern, self.model

        @arrow_udf("array<int>")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder, cut = _Encoder(pieces, model), regex.compile(pattern).findall
            for texts in slices(batches):
                packed, offsets = [], np.zeros(len(texts) + 1, np.int32)
                for k, text in enumerate(texts):
                    if len(encoder) > CACHED_PRETOKENS:
                        encoder.clear()
                    row = b"".join(map(encoder.__getitem__, cut(text.as_py() or "")))
                    packed.append(row)
                    offsets[k + 1] = offsets[k] + len(row) // 4
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                yield pa.ListArray.from_arrays(pa.array(offsets), values)

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of id arrays, by the inverse mapping. A null array gives no bytes; an unknown id raises an error."""
        pieces = self.pieces

        @arrow_udf("binary")
        def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            vocabulary = pa.array(pieces, pa.binary())
            for rows in slices(batches):
                rows = pc.fill_null(rows, pa.scalar([], rows.type)) if rows.null_count else rows
                taken = vocabulary.take(rows.flatten())  # its data are the documents' bytes one after another
                ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
                cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends[cuts].tobytes()), taken.buffers()[2]
                                                                     or pa.py_buffer(b"")])

        return raw(ids)


def with_ids(df, text: str, coder: BytePieces, out: str = "token_ids"):
    """The frame with the ids of its text column; all other columns are kept."""
    return df.withColumn(out, coder.encode(F.col(text)))
