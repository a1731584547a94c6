"""Operator 5: byte-level BPE with a sentencepiece model written from the vocabulary."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import clean_text


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable and no space, else the next from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece r is rank r in byte letters, scored -r; the unknown piece is last.

    The normaliser is the identity: no character map, no dummy prefix, spaces neither removed nor escaped.
    """
    letters = byte_letters()
    pieces = []
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if rank != len(pieces):
            raise ValueError("ranks must be 0 to n - 1")
        piece = "".join([letters[b] for b in raw]).encode()
        pieces.append(field(1, field(1, piece) + field(2, float(-rank)) + field(3, 1)))
    pieces.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2)))
    trainer = field(3, 2) + field(4, len(pieces)) + field(40, len(pieces) - 1)
    normalizer = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(pieces) + field(2, trainer) + field(3, normalizer)


class ByteBpe:
    """encode() gives the ids that the ranks' own merges give for each pre-token; decode() is the inverse.

    Texts are cut at single spaces between other characters, where no match of the pattern can cross, and a space
    belongs to the part after it. The parts after a text's first are remembered (without their space); a new part is split by the pattern, its matches are looked up
    whole and otherwise merged by the sentencepiece model.
    """

    #: A space with white space beside it: then spaces between other characters must be found one by one.
    WIDE = re.compile(r"\s | \s")
    NARROW = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, pattern: str, most: int = 600_000):
        import regex
        import sentencepiece

        self.ranks, self.most = read_ranks(path), most
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.split = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.table = [raw for raw, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.parts: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _merge(self, tokens: list[str]) -> None:
        slow = []
        for t in tokens:
            rank = self.ranks.get(t.encode())
            if rank is None:
                slow.append(t)
            else:
                self.tokens[t] = struct.pack("<I", rank)
        if slow:
            letters = self.letters
            mapped = [t.encode().decode("latin-1").translate(letters) for t in slow]
            found = self.model.encode(mapped, out_type=int, num_threads=1)
            self.tokens.update((t, struct.pack(f"<{len(ids)}I", *ids)) for t, ids in zip(slow, found, strict=True))

    def _known(self, token: str) -> bytes:
        if token not in self.tokens:
            self._merge([token])
        return self.tokens[token]

    def _learn(self, parts: set[str]) -> None:
        split = self.split
        cut = {p: split(" " + p) for p in parts}
        tokens = self.tokens
        new = list(set(chain.from_iterable(cut.values())).difference(tokens))
        if new:
            self._merge(new)
        self.parts.update((p, b"".join([tokens[t] for t in found])) for p, found in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.NARROW.split(t) if self.WIDE.search(t) else t.split(" ") for t in texts]
        first = [b"".join(self._known(x) for x in self.split(parts.pop(0))) for parts in cut]
        for known in (self.tokens, self.parts):
            if len(known) > self.most:
                known.clear()
        new = set(chain.from_iterable(cut)).difference(known)
        if new:
            self._learn(new)
        get = known.__getitem__
        return [before + b"".join(map(get, parts)) for before, parts in zip(first, cut, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder a Python worker and vocabulary."""
    return CODERS.get((path, pattern)) or CODERS.setdefault((path, pattern), ByteBpe(path, pattern))


def coded(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """df without the text, with n_tokens, ids (binary, if with_ids), ids_sha256 and decoded_sha256.

    ids are little-endian unsigned 32-bit integers; decoded_sha256 is of the bytes that decoding the ids gives. A null
    text counts as empty: no ids, and the digests of nothing. Columns of the added names are replaced; all others
    stay. Every row is coded alone, so nulls, ties and repeated rows elsewhere make no difference.
    """
    added = ["n_tokens", *["ids"][: int(with_ids)], "ids_sha256", "decoded_sha256"]
    others = [c for c in df.columns if c not in (*added, text_col)]
    rows = df.select(*others, clean_text(df, text_col).alias(text_col))
    schema = rows.drop(text_col).schema
    for name, kind in (("n_tokens", "long"), ("ids", "binary"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        if name in added:
            schema = schema.add(name, kind)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = bpe.encode(part.column(len(others)).to_pylist())
                out = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                out["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])
                yield pa.record_batch([*part.columns[: len(others)], *(out[c] for c in added)], names=[*others, *added])

    return rows.mapInArrow(code, schema)
