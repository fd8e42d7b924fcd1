"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

A sentencepiece BPE model is serialised straight from the vocabulary: each piece is a token's bytes
mapped to visible characters, its score is the negative rank, and normalisation is the identity. Texts
are cut into pre-tokens, each pre-token is encoded once for each task and remembered, and decoding
maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Distinct pre-tokens that a task remembers; when full, it starts afresh.
REMEMBERED = 1_000_000
#: Texts whose new pre-tokens are encoded together.
TOGETHER = 500

# The pre-token pattern of the vocabulary, with white space spelled out as Unicode has it.
_WS = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"




def _letters_and_numbers(last: int) -> tuple[str, str]:
    """Letters and numbers up to a code point, as the insides of two character classes."""
    kinds = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(last + 1)]
    return "".join(re.escape(c) for c, k in kinds if k == "L"), "".join(re.escape(c) for c, k in kinds if k == "N")


#: Texts of Latin letters and general punctuation only are cut by an equal pattern without Unicode classes, which is faster.
_LATIN_L, _LATIN_N = _letters_and_numbers(0x24F)
_OTHER = re.compile("[^\x00-\u024f\u2010-\u205e\u20a0-\u20bf]").search
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN_L}]+| ?[{_LATIN_N}]+| ?[^{_WS}{_LATIN_L}{_LATIN_N}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
_ANY = regex.compile(PRE_TOKEN).findall


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    return _LATIN(text) if _OTHER(text) is None else _ANY(text)


def byte_characters() -> str:
    """The visible character of each byte, by rule: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return "".join(out)


_CHARS = byte_characters()
_TO_CHARS = {i: c for i, c in enumerate(_CHARS)}
_TO_BYTES = {ord(c): i for i, c in enumerate(_CHARS)}


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: text or message, integer, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the id after the last one is the unknown piece."""
    normal, unknown = 1, 2
    out = [_field(1, _field(1, t.decode("latin-1").translate(_TO_CHARS).encode()) + _field(2, float(-i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def _characters(pre: str) -> str:
    """The visible characters of a text's bytes."""
    return pre.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARS)


class Encoder(dict):
    """Encodes texts; as a dictionary it holds the ids of the pre-tokens met so far."""

    def __init__(self, model: bytes):
        super().__init__()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)

    def __missing__(self, pre: str) -> list[int]:
        return self.pieces.encode(_characters(pre))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the pre-tokens of texts that are not held yet in one call; very long ones are not kept."""
        new = [x for x in set().union(*texts).difference(self) if len(x) < 64]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = [x for x in set().union(*texts) if len(x) < 64]
        self.update(zip(new, self.batch(new)))

    def batch(self, pre: list[str]) -> list[list[int]]:
        """Ids of several pre-tokens in one call; none of them is kept."""
        return self.pieces.encode([_characters(x) for x in pre], num_threads=1)

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of texts, null and empty ones included, in their order."""
        for k in range(0, len(texts), TOGETHER):
            cut = [pre_tokens(t) if t else [] for t in texts[k : k + TOGETHER]]
            self.learn(cut)
            for pre in cut:
                yield list(chain.from_iterable(map(self.__getitem__, pre)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pre_tokens(text))))

    def size(self, text: str) -> int:
        """Number of tokens of a text."""
        return sum(map(len, map(self.__getitem__, pre_tokens(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces are joined and mapped back to bytes."""
        return bytes(map(_TO_BYTES.__getitem__, map(ord, "".join(map(self.pieces.id_to_piece, ids))))).decode("utf-8", "surrogatepass")


_ENCODERS: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model, made once in each process."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _shared_model(documents: DataFrame, tokenizer: str, folder: str):
    """The serialised model as a broadcast value: a vocabulary file bounds its size (about 1 MB)."""
    return documents.sparkSession.sparkContext.broadcast(serialised_model(vocabulary(f"{folder}/{tokenizer}.tiktoken")))


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Each document (doc_id, text) as (doc_id, ids). Null and empty texts both give an empty list.

    Strings that look like special tokens are ordinary text. Whole texts are encoded, however long.
    """
    model = _shared_model(documents, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            ids = list(e.encode_all(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens, same): whether decoding a document's ids gives its text again; null counts as empty."""
    model = _shared_model(documents, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [(i, t or "") for i, t in zip(e.encode_all(texts), texts)]
            rows = [b.column("doc_id"), pa.array([len(i) for i, _ in ids], pa.int32()), pa.array([e.decode(i) == t for i, t in ids], pa.bool_())]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "tokens", "same"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, tokens int, same boolean")
