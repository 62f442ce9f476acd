"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank vocabulary.

A vocabulary of byte strings with ranks becomes a sentencepiece BPE model without any training: each byte
is shown as one printable character (the 256 Braille patterns), a vocabulary entry becomes the piece of
its bytes' characters with its negative rank as score, so the best-scored merge is the lowest-ranked one,
and normalisation is the identity. Texts are split by the pre-token pattern; each pre-token that is itself
an entry gets that id, any other goes through the model. Decoding maps pieces back to their bytes.

Whole texts are encoded where they are read: one narrow pass, no shuffle, memory bounded by an Arrow batch
and a cache of recent pre-tokens.

Defined results: null and empty texts have no ids, the empty string's hashes and 0 tokens; text that looks
like a special token is ordinary text; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import text_of

#: One printable character for each byte: the Unicode block of Braille patterns.
FIRST_CHARACTER = 0x2800
SHOWN = {b: FIRST_CHARACTER + b for b in range(256)}

CACHED_PRE_TOKENS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def shown(raw: bytes) -> str:
    return raw.decode("latin-1").translate(SHOWN)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The model file's bytes: piece ids are ranks, and one more id for what cannot occur."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without an entry: {missing}")
    normal, unknown, bpe = 1, 2, 2
    piece = lambda text, score, kind: _bytes_field(
        1, _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind)
    )
    pieces = [piece(shown(t), -float(rank), normal) for rank, t in enumerate(by_rank)] + [piece("<unk>", 0.0, unknown)]
    none = (1 << 64) - 1  # -1: no such piece
    trainer = (
        _int_field(3, bpe) + _int_field(4, len(pieces)) + _int_field(40, len(by_rank))
        + _int_field(41, none) + _int_field(42, none) + _int_field(43, none)
    )
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(pieces) + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


class BytePieces:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        n = self.pieces.get_piece_size() - 1
        self.raw = [bytes(ord(c) - FIRST_CHARACTER for c in self.pieces.id_to_piece(i)) for i in range(n)]
        self.whole = {token: i for i, token in enumerate(self.raw)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _learn(self, fresh: set[str]) -> None:
        merged = []
        for token in fresh:
            raw = token.encode("utf-8")
            if (i := self.whole.get(raw)) is not None:
                self.cache[token] = (i,)
            else:
                merged.append((token, shown(raw)))
        for (token, _), ids in zip(merged, self.pieces.encode([s for _, s in merged], num_threads=1), strict=True):
            self.cache[token] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        known = self.cache
        if fresh := {t for t in set(tokens) if t not in known}:
            if len(known) + len(fresh) > CACHED_PRE_TOKENS:
                known.clear()
                fresh = set(tokens)
            self._learn(fresh)
        return list(chain.from_iterable(map(known.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


_OPEN: dict[int, BytePieces] = {}


def _opened(model: bytes, pattern: str) -> BytePieces:
    key = hash((model, pattern))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = BytePieces(model, pattern)
    return _OPEN[key]


def encode(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and its ids (array of int); `vocabulary` is the path of a rank file that the driver can read."""
    model = documents.sparkSession.sparkContext.broadcast(serialised_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _opened(model.value, pattern)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": [pieces.encode(t) for t in rows["text"]]})

    return text_of(documents).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""
    model = encoded.sparkSession.sparkContext.broadcast(serialised_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _opened(model.value, pattern)
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "raw": [pieces.decode(i) for i in rows["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, raw binary")


def round_trip(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, only digests leave it."""
    model = documents.sparkSession.sparkContext.broadcast(serialised_model(read_ranks(vocabulary)))

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _opened(model.value, pattern)
        decimal = [str(i) for i in range(len(pieces.raw))]
        for texts in batches:
            out = []
            for text in texts:
                ids = pieces.encode(text)
                listed = ",".join(map(decimal.__getitem__, ids)).encode()
                out.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(pieces.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run = F.pandas_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return text_of(documents).select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
