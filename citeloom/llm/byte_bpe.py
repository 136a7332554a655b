"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file.

The vocabulary (base64 token, rank) is written straight into sentencepiece's protobuf: every token is a
piece over 256 stand-in characters, one for each byte, with score ``-rank``; the normaliser is the
identity.  sentencepiece's BPE then merges the pair with the best score, i.e. the lowest rank, leftmost
first.  A text is cut into pre-tokens by the tokenizer's pattern; each is encoded on its own, and whole
vocabulary entries are taken as they are.  Decoding maps ids back to bytes.

Defined results: null is an empty text; an empty text has no ids and decodes to nothing.  A text of any
length is encoded whole; memory beyond the text itself is the id list and a cache of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

#: Pieces whose ids a task remembers; a full cache takes no more. About 15 MB with the pre-tokens.
CACHE = 1 << 16
#: Bytes of text that are encoded and handed on together; a longer text stands alone.
TOGETHER = 1 << 18
#: Marks that the pattern makes a pre-token of their own after letters.
_MARKS = frozenset(".,;:!?")
#: White space beside a space, and white space outside ASCII (with the separators that Python counts).
_WIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \x0b", "\x0b ", " \x0c", "\x0c ", "\x1c", "\x1d", "\x1e", "\x1f")
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_BASE = 0x4E00  # stand-in of byte b is chr(_BASE + b): letters that no normaliser or rule touches


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float by the type of the value."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def stand_in(data: bytes) -> str:
    """Each byte as its stand-in character."""
    return (np.frombuffer(data, np.uint8) + np.uint16(_BASE)).astype("<u2").tobytes().decode("utf-16-le")


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer spec (2), normaliser spec (3)."""
    size = max(ranks.values(), default=-1) + 1
    pieces = [b""] * size
    for token, rank in ranks.items():
        pieces[rank] = _field(1, stand_in(token).encode()) + _field(2, -float(rank)) + _field(3, 1)
    if not all(pieces):
        raise ValueError("ranks must be the numbers from 0 on, without gaps")
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size)  # BPE, vocabulary size, id of <unk>
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in [*pieces, unknown]) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary; get one for each process from ``codec``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.whole = pattern != public_tokenizers.PATTERN  # the cuts of _pieces hold for that pattern only
        self.ids = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.tokens = np.empty(len(ranks), object)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}  # by piece
        self.words: dict[str, bytes] = {}  # by pre-token

    def _pieces(self, text: str) -> list[str]:
        """The text cut at single spaces, the first part led by a mark; a text with white space beside a
        space, at its start or at its end is left whole, led by another mark, and so is every text under
        another pattern.

        No match of the pattern holds a space after a character that isn't white space, so parts can be
        encoded apart, each with the space before it."""
        if self.whole or any(map(text.__contains__, _WIDE)) or text[:1].isspace() or text[-1:].isspace() or not text.isascii() and _OTHER_SPACE(text):
            return ["\n\n" + text]
        parts = text.split(" ")
        parts[0] = "\n" + parts[0]
        return parts

    def _words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; the two common shapes without the pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        if piece[0] == "\n":
            return self.find(piece[2:] if piece[1:2] == "\n" else piece[1:])
        return self.find(" " + piece)

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece as little-endian 32-bit integers: vocabulary entries as they are, the
        other pre-tokens by sentencepiece, all in one call."""
        known, ids = self.ids, dict[str, bytes | None]()
        cut = list(map(self._words, pieces))
        hard = []
        for words in cut:
            for w in words:
                if w not in ids:
                    ids[w] = known.get(w.encode()) or self.words.get(w)
                    if ids[w] is None:
                        hard.append(w)
        data = [w.encode() for w in hard]
        joined, at, spans = stand_in(b"".join(data)), 0, []
        for w in data:
            spans.append(joined[at : at + len(w)])
            at += len(w)
        for w, found in zip(hard, self.model.encode(spans, out_type=int, num_threads=1)):
            ids[w] = array("I", found).tobytes()
        if len(self.words) < CACHE // 2:
            self.words.update((w, ids[w]) for w in hard if len(w) <= 40)
        return {p: b"".join([ids[w] for w in words]) for p, words in zip(pieces, cut)}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cache = self.cache
        cut = [self._pieces(t) for t in texts]
        found = [list(map(cache.get, pieces)) for pieces in cut]
        missing = {p for pieces, got in zip(cut, found) if None in got for p, ids in zip(pieces, got) if ids is None}
        new = self._encode_pieces(list(missing))
        out = []
        for pieces, got in zip(cut, found):
            if None in got:
                got = [new[p] if ids is None else ids for p, ids in zip(pieces, got)]
            out.append(np.frombuffer(b"".join(got), "<u4"))
        if len(cache) < CACHE:
            cache.update((p, ids) for p, ids in new.items() if len(p) <= 40)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())

    def forget(self) -> None:
        """Empty the caches: the process serves other stages too."""
        self.cache, self.words = {}, {}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def parts(batch: pa.RecordBatch, at: int, most: int = TOGETHER):
    """The batch in parts of consecutive rows with about ``most`` bytes in column ``at`` together."""
    first, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    yield batch.slice(first)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


OUTPUT = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
_ARROW = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_documents(docs: DataFrame, path: str, pattern: str, outputs: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the ``outputs`` asked for: ids, decoded, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is the rank file, which every executor must be able to read.  No shuffle: one pass.
    """
    keep = [c for c in docs.columns if c not in outputs]
    at = keep.index(text)
    schema = T.StructType([docs.schema[c] for c in keep])
    for name in outputs:
        schema = schema.add(name, OUTPUT[name])

    def run(batches):
        c = codec(path, pattern)
        for part in (p for batch in batches for p in parts(batch, at)):
            got: dict[str, list] = {name: [] for name in outputs}
            for ids in c.encode_batch([t or "" for t in part.column(at).to_pylist()]):
                decoded = c.decode(ids) if "decoded" in got or "decoded_sha256" in got else b""
                for name, value in (
                    ("ids", lambda: ids.astype(np.int32)), ("decoded", lambda: decoded), ("n_tokens", lambda: len(ids)),
                    ("ids_sha256", lambda: _digest(ids.tobytes())), ("decoded_sha256", lambda: _digest(decoded)),
                ):
                    if name in got:
                        got[name].append(value())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(got[n], _ARROW[n]) for n in outputs)], [*keep, *outputs]
            )
        c.forget()

    return docs.select(*keep).mapInArrow(lean(run), schema)
