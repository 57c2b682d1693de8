"""Byte-level BPE by a sentencepiece model that is serialised from a vocabulary of ranks, and back.

A byte b is written as the character U+0100 + b, a token as the characters of its bytes, a piece with the score -rank, so
the model merges the pair of the lowest rank first, the leftmost of equals, as byte-level BPE does. The model normalises
nothing. It is given one match of the pattern at a time; a match that is a token itself is that token."""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_columns

#: Matches whose ids a worker process remembers from task to task: so many last used ones, and as many from before.
REMEMBERED = 400_000
#: Characters of a text that are split at once.
STRETCH = 1 << 18
#: Matches given to the model at once.
ASKED = 20_000


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


TO_CHARACTERS = {b: 0x100 + b for b in range(256)}


def characters(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_CHARACTERS)


def bytes_of(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields: tuple[int, object]) -> bytes:
    """A protobuf message of `(number, value)`: whole numbers and truth values, floats, texts and messages."""
    out = []
    for number, value in fields:
        if isinstance(value, int):
            out.append(_varint(number << 3) + _varint(value))
        elif isinstance(value, float):
            out.append(_varint(number << 3 | 5) + struct.pack("<f", value))
        else:
            raw = value.encode() if isinstance(value, str) else value
            out.append(_varint(number << 3 | 2) + _varint(len(raw)) + raw)
    return b"".join(out)


#: Fixed values of the sentencepiece model format: kinds of model and of pieces.
BPE, NORMAL, UNKNOWN = 2, 1, 2


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: a piece for each rank from 0 on, and one more for what is unknown, which no byte is. A rank
    that the vocabulary leaves free is a piece of two characters that stand for no byte."""
    tokens = {rank: characters(token) for token, rank in ranks.items()}
    n = max(tokens) + 1
    pieces = [_message((1, tokens.get(i) or chr(0x4E00) + chr(0x5000 + i)), (2, float(-i)), (3, NORMAL)) for i in range(n)]
    pieces.append(_message((1, "<unk>"), (2, 0.0), (3, UNKNOWN)))
    trainer = _message((3, BPE), (4, n + 1), (40, n), (41, -1 & (1 << 64) - 1), (42, -1 & (1 << 64) - 1), (43, -1 & (1 << 64) - 1))
    normalizer = _message((1, "identity"), (3, False), (4, False), (5, False))
    return _message(*((1, p) for p in pieces), (2, trainer), (3, normalizer))


KINDS = (r"\p{L}", r"\p{N}", r"\s")


@lru_cache(maxsize=1)
def other_characters() -> dict[int, str]:
    """Characters that the `regex` module counts to another class (letter, number, white space, else) than the tiktoken
    library, whose Unicode is another version, each with a stand-in that both count to tiktoken's class."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def theirs(kind):
        own = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return own.decode(own.encode_ordinary(every))

    a, b = ({c: kind for kind in KINDS for c in find(kind)} for find in (theirs, lambda kind: regex.findall(kind, every)))
    stand_in = dict(zip((*KINDS, None), "é² §"))
    return {ord(c): stand_in[a.get(c)] for c in a.keys() | b.keys() if a.get(c) != b.get(c)}


class ByteBpe:
    """Ids of texts and bytes of ids, as the tiktoken library gives them for the ranks in the file at `path`."""

    CUT = regex.compile(r"(?<=\S)\s")

    def __init__(self, path: str, pattern: str, others: dict[int, str]):
        from sentencepiece import SentencePieceProcessor

        self.ranks = ranks_of(path)
        self.model = SentencePieceProcessor(model_proto=model_of(self.ranks))
        self.tokens = [bytes_of(p) if (p := self.model.id_to_piece(i))[0] < chr(0x200) else None for i in range(max(self.ranks.values()) + 1)]
        self.pattern, self.others = regex.compile(pattern), others
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def matches(self, text: str):
        """The pattern's matches, a list for each stretch. A stretch ends before white space that follows something else: no
        match goes over such a place, and what comes before it does not depend on what comes after."""
        own = text
        if not text.isascii() and not self.others.keys().isdisjoint(map(ord, set(text))):
            own = text.translate(self.others)
        at = 0
        while at < len(text):
            cut = self.CUT.search(own, at + STRETCH) if len(text) - at > STRETCH else None
            end = cut.start() if cut else len(text)
            yield self.pattern.findall(text, at, end) if own is text else [text[m.start() : m.end()] for m in self.pattern.finditer(own, at, end)]
            at = end

    def _learn(self, new: list[str]) -> None:
        raw = [x.encode() for x in new]
        whole = [self.ranks.get(x) for x in raw]
        rest = [(x, b) for x, b, rank in zip(new, raw, whole) if rank is None]
        self.known.update((x, (rank,)) for x, rank in zip(new, whole) if rank is not None)
        for at in range(0, len(rest), ASKED):
            part = rest[at : at + ASKED]
            got = self.model.encode([characters(b) for _, b in part], out_type=int, num_threads=1)
            self.known.update((x, tuple(ids)) for (x, _), ids in zip(part, got))

    def encode(self, text: bytes):
        """The ids, a list for each stretch of the text."""
        for own in self.matches(text.decode("utf-8", "replace")):
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            known, before = self.known, self.before
            new = set(own).difference(known)
            known.update((x, before[x]) for x in new if x in before)
            if new := [x for x in new if x not in known]:
                self._learn(new)
            yield list(chain.from_iterable(map(known.__getitem__, own)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str, others: tuple) -> ByteBpe:
    """The model and the matches known so far, kept by a worker process for all its tasks."""
    return ByteBpe(path, pattern, dict(others))


def _starter(path: str | None, pattern: str | None):
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    own = (path or vocabulary_path(), pattern, tuple(sorted(other_characters().items())))
    return lambda: _codec(*own)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", name: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole text in column `name`.

    A null text has no ids, like an empty one; a long one is split and encoded in stretches; repeated rows stay; an empty
    table gives no rows; the new column is named apart from columns that are there (more underscores before it)."""
    codec = _starter(path, pattern)

    def start():
        own = codec()
        return lambda texts: [pa.array([np.fromiter(chain.from_iterable(own.encode(t)), np.int32) for t in texts], pa.list_(pa.int32()))]

    return with_columns(docs, [(free_name(docs, name), "array<int>")], start, text_col)


def decoded(rows: DataFrame, path: str | None = None, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """`rows` with the bytes of the ids of column `ids_col` in column `name`; null ids give null, unknown ones an error."""
    codec, name = _starter(path, None), free_name(rows, name)

    def run(batches):
        own = codec()
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            if (pc.min(pc.list_flatten(ids)).as_py() or 0) < 0:
                raise ValueError("decoded: an id is negative")
            yield b.append_column(name, pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.binary()))

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(None).cast("binary")).schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with `n_tokens`, `ids_sha256` (of the decimal ids joined by commas) and `decoded_sha256` (of the bytes that the
    ids give back), with the edge cases of encoded()."""
    codec = _starter(path, pattern)

    def start():
        own = codec()
        decimals = [str(i) for i in range(len(own.tokens))]

        def made(texts):
            out = []
            for t in texts:
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in own.encode(t):
                    of_ids.update(("," * bool(n) + ",".join(map(decimals.__getitem__, ids))).encode())
                    of_bytes.update(own.decode(ids))
                    n += len(ids)
                out.append((n, of_ids.hexdigest(), of_bytes.hexdigest()))
            n, ids, back = zip(*out) if out else ((), (), ())
            return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

        return made

    return with_columns(docs, [(free_name(docs, n), k) for n, k in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))], start, text_col)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).drop("text")
