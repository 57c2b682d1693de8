"""Token ids in a bit-packed binary format, written block by block in ascending id order and read back."""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_path
from .common import column, raw_text

#: Ids of a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Words whose ids a worker process remembers from task to task: so many last used ones, and as many from before.
REMEMBERED = 500_000

BLOCKS = "shard int, block int, first_id long, bits int, doc_ids array<long>, doc_lengths array<long>, packed binary"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, the high bit first; the last byte is filled with zeros."""
    whole = np.ascontiguousarray(ids.astype(">u4")).view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return whole[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(whole, axis=1)[:, 32 - bits :]).tobytes()


def unpack(packed: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """Ids start .. start + n - 1 of a block, without reading those before."""
    first = start * bits // 8
    raw = np.frombuffer(packed, np.uint8)[first : -(-(start + n) * bits // 8)]
    whole = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        whole[:, 4 - bits // 8 :] = raw.reshape(n, bits // 8)
        return whole.view(">u4").ravel().astype("<u4")
    flat = np.unpackbits(raw)[start * bits - first * 8 :][: n * bits].reshape(n, bits)
    return np.packbits(np.pad(flat, ((0, 0), (32 - bits, 0))), axis=1).view(">u4").ravel().astype("<u4")


class WordIds:
    """The ids of texts as little-endian uint32 bytes, asking the tokenizer once for each word.

    A vocabulary whose words end in `</w>` drops white space, and ASCII white space never lies within a token, so the ids of
    a text are those of its words. A word of letters and a tail of ASCII signs is asked for as those two; letters alone are
    one word of the vocabulary's own split, so many can be asked for at once and told apart by their ends. For other
    vocabularies whole texts are encoded."""

    LETTERS = re.compile(rb"^(?:((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)|.*)$", re.M)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ask(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _ask_letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {b"": b""}
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.frombuffer(self._ask([b" ".join(part)])[0], "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(part):
                out.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))
            else:
                out.update(zip(part, self._ask(part)))
        return out

    def _learn(self, words: list[bytes]) -> None:
        split = self.LETTERS.findall(b"\n".join(words).lower())
        whole = [w for w, (own, _) in zip(words, split) if not own]
        self.known.update(zip(whole, self._ask(whole)))
        ids = self._ask_letters(list({own for own, _ in split if own}))
        tails = list({tail for _, tail in split if tail})
        tail_ids = {b"": b""} | dict(zip(tails, self._ask(tails)))
        self.known.update((w, ids[own] + tail_ids[tail]) for w, (own, tail) in zip(words, split) if own)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.ends.any():
            return self._ask(texts)
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [w for w in set().union(*split) if w not in known]
        known.update((w, before[w]) for w in new if w in before)
        if new := [w for w in new if w not in known]:
            self._learn(new)
        look = known.__getitem__
        return [b"".join(map(look, words)) for words in split]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The vocabulary and the words known so far, kept by a worker process for all its tasks."""
    return WordIds(path)


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, `end_id` after each, to the table of blocks at `path`.

    Texts are dealt by ranges of id and sorted within them; ties by the text's hash, and equal rows by place, so the rows of
    one id can be in several ranges. A shard is one range. A block names its first id's place in the shard and its
    documents' lengths, so any document can be unpacked alone."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("bits", pa.int32()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("packed", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = word_ids(tokenizer_path)
        bits = max(max(ids_of.size - 1, end_id).bit_length(), 1)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[shard], [block], [first], [bits], [names], [[len(p) // 4 for p in parts]], [pack(ids, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for name, ids in zip(column(part, "id").to_pylist(), ids_of(column(part, "_text").to_pylist())):
                    if held and held + len(ids) // 4 >= BLOCK_IDS:
                        yield flush()
                        block, first = block + 1, first + held
                        names, parts, held = [], [], 0
                    names.append(name)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
        if held:
            yield flush()

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    rows = raw_text(named, "id", "hash").withColumn("row", F.monotonically_increasing_id())
    order = (F.col("id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("id", "_text").mapInArrow(run, BLOCKS).write.parquet(path)


def read_token_blocks(spark, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` from the files: each block is unpacked; `start` counts all ids before."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.max(F.col("first_id") + F.aggregate("doc_lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, at = {}, 0
    for shard, n in sorted(map(tuple, totals.collect())):  # one row for each task that wrote
        before[shard], at = at, at + n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                shard, first, bits, names, lengths, packed = (column(b, n)[i].as_py() for n in ("shard", "first_id", "bits", "doc_ids", "doc_lengths", "packed"))
                ids = memoryview(unpack(packed, bits, sum(lengths)).tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                cols = (names, starts + (before[shard] + first), lengths, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, **columns) -> DataFrame:
    """Write the ids of `docs` in the shared folder and read them back, one row for each row of `docs`.

    Null and empty texts have the end id alone; a null id comes first; repeated ids keep all their rows, in the order of
    the texts' hashes; an empty table gives no rows. A text longer than a block has a block of its own. Other columns,
    whatever their names, are not read. The packed width follows the vocabulary's size."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_blocks(docs, path, tokenizer_path or vocabulary_path(), end_id, **columns)
    return read_token_blocks(spark, path)


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids are written and read back; the result has a row for each row of `docs`, with the edge cases of
    token_output(). Other columns, whatever their names, are not read."""
    return token_output(docs)
