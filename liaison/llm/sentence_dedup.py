"""Substring dedup: runs of consecutive sentences that stand elsewhere already are removed.

A run is any number of consecutive sentences, SENTENCES and WORDS at least. Of all runs those are hashed that no shorter run
from the same first sentence, or to the same last one, makes needless: any longer run that is repeated is made up of them,
sentence by sentence, and they are repeated with it, so exactly the sentences that all runs would cover are removed.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .common import column, looked_up, raw_text, words_of

#: A run has at least so many sentences and so many words. A sentence of over LONG words counts as several: it ends after any
#: two words whose hash is a multiple of CUT, wherever they stand, or else after PIECE words.
SENTENCES, WORDS, LONG, CUT, PIECE = 2, 20, 24, 6, 24

_END = re.compile(rb"[.!?]+(?=[\x20\x09-\x0d])|\n+")
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """`(start, end, words)` of each sentence: to the end of a run of `.!?` before white space, or of a line."""
    out, at = [], 0
    for cut in [m.end() for m in _END.finditer(text)] + [len(text)]:
        words = words_of(text[at:cut])
        if len(words) > LONG:
            places = [at + m.start() for m in _WORD.finditer(text[at:cut])]
            ends = cuts(words)
            starts = [at, *(places[k] for k in ends[:-1])]
            out += [(a, b, words[i:j]) for a, b, i, j in zip(starts, [*starts[1:], cut], [0, *ends], ends)]
        elif words:
            out.append((at, cut, words))
        at = cut
    return out


def cuts(words: list[bytes]) -> list[int]:
    """Where the pieces of a long sentence end; equal words are cut at equal places, but for those at their edges."""
    crc, out, last = zlib.crc32, [], 0
    before = 0
    for i, w in enumerate(words, 1):
        own = crc(w)
        if crc(w, before) % CUT == 0 or i - last == PIECE:
            out.append(i)
            last = i
        before = own
    return out if last == len(words) else [*out, len(words)]


def runs(parts: list[tuple[int, int, list[bytes]]]) -> list[tuple[int, int, int]]:
    """`(first, last, hash)`: the shortest runs from each sentence on, and the shortest up to each, that are long enough."""
    hashes = [xxhash.xxh64_digest(b" ".join(w)) for _, _, w in parts]
    ends, n = np.cumsum([0] + [len(w) for _, _, w in parts]), len(parts)
    last = np.maximum(np.searchsorted(ends, ends[:-1] + WORDS), np.arange(n) + SENTENCES)
    first = np.minimum(np.searchsorted(ends, ends[1:] - WORDS, "right") - 1, np.arange(n) + 1 - SENTENCES)
    spans = {(i, j) for i, j in enumerate(last.tolist()) if j <= n} | {(i, j) for j, i in enumerate(first.tolist(), 1) if i >= 0}
    digest, join = xxhash.xxh64_intdigest, b"".join
    return [(i, j - 1, digest(join(hashes[i:j]))) for i, j in sorted(spans)]


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_sentences, n_removed, removed, first_docs, text)` for each document that loses sentences.

    A run's first place is in the smallest id, and there the earliest; sentences that any other place covers are removed.
    `removed` has their positions, `first_docs` the ids where they stand first, `text` what is left. Rows of one id are one
    document to each other: between them no run is a repeat. A null id counts as the smallest. Null, empty and short texts
    have no runs; an empty table gives no rows. Texts of any length are taken whole, each in the task that reads it; other
    columns, whatever their names, are not read."""
    schema = pa.schema([("id", pa.int64()), ("hash", pa.list_(pa.int64())), ("again", pa.bool_())])

    def hashed(batches):
        for b in batches:
            rows: list[tuple] = []
            for t in column(b, "_text").to_pylist():
                found = runs(sentences(t))
                seen = {h for *_, h in found}
                rows.append((np.fromiter(seen, np.uint64, len(seen)).view(np.int64), len(seen) < len(found)))
            cols = [column(b, "id"), *(pa.array(list(x), f.type) for x, f in zip(zip(*rows), list(schema)[1:]))]
            if rows:
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = materialise(raw_text(ids, "id").mapInArrow(hashed, "id long, hash array<long>, again boolean"), "runs")
    spans = kept.select("id", F.explode("hash").alias("hash"))
    total = kept.agg(F.sum(F.size("hash"))).first()[0] or 0
    low = spans.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("high > low")
    later = looked_up(spans, materialise(low.select("hash", "low", "n"), "low"), "hash", "n", total).where("id > low")
    later = later.groupBy("id").agg(F.collect_set("hash").alias("hashes"), F.array_sort(F.collect_set("low")).alias("first_docs"))
    touched = later.union(kept.where("again").select("id", F.array().cast("array<long>"), F.array().cast("array<long>")))
    touched = touched.groupBy("id").agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.flatten(F.collect_list("first_docs")).alias("first_docs"))

    kinds = "doc_id long, n_sentences int, n_removed int, removed array<int>, first_docs array<long>, text string"
    out = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.list_(pa.int32())), ("first_docs", pa.list_(pa.int64())), ("text", pa.string())])

    def cut(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc, text, hashes, firsts in zip(*(column(b, n).to_pylist() for n in ("doc_id", "_text", "hashes", "first_docs"))):
                parts, gone, seen = sentences(text), set(), set()
                old = {h & (2**64 - 1) for h in hashes}
                for i, j, h in runs(parts):
                    if h in old or h in seen:
                        gone.update(range(i, j + 1))
                    seen.add(h)
                left = b"".join(text[a:z] for k, (a, z, _) in enumerate(parts) if k not in gone)
                if gone:
                    rows.append((doc, len(parts), len(gone), sorted(gone), firsts, left.decode("utf-8", "replace")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), out)], schema=out)

    return raw_text(ids, "id", "doc_id").join(touched, "id").select("doc_id", "_text", "hashes", "first_docs").mapInArrow(cut, kinds)


def op6_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return repeated_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
