"""Benchmark decontamination: every passage of the corpus is a BM25 query on an inverted index of the test items.

Passages are bounded in bulk: by the largest impacts of their terms, as WAND finds that there is no pivot, then by those in each
block of items, as block-max WAND skips blocks; only blocks that can reach the threshold are scored. Many passages go through
an index at once, so no cursors are walked one by one, which took six times the time here."""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .common import column, free_name, raw_text, with_columns, words_of

#: A passage is WINDOW words, one every half window; an item is retrieved at THRESHOLD of its own score and confirmed when
#: both its question and its answer have OVERLAP of their word pairs in the passage. An item of over half a window is held
#: against stretches as long as itself and a half window on either side, one every half window, with the same shares.
WINDOW, THRESHOLD, OVERLAP = 128, 0.6, 0.6
K1, B = 1.2, 0.75
#: Items of an index and of a block, bytes of an index's items. A larger benchmark is taken in several indexes, so many of them
#: in one pass over the corpus.
INDEX_ITEMS, INDEX_BYTES, BLOCK, AT_ONCE = 1024, 4 << 20, 32, 8
#: Signs that a term does not have at its ends, however many there are: index, search and overlap share this one definition.
SIGNS = string.punctuation.encode()


def terms_of(text: bytes) -> list[bytes]:
    return [w.strip(SIGNS) or w for w in words_of(text)]


def parts_of(text: bytes) -> tuple[set, set]:
    """Word pairs of the question and of the answer: the answer is what follows the last question mark that is not at the
    end, or else the last third of the words."""
    at = text.rstrip().rstrip(SIGNS).rfind(b"?")
    terms = terms_of(text)
    cut = len(terms_of(text[: at + 1])) if at > 0 else len(terms) - len(terms) // 3
    pairs = lambda x: set(zip(x, x[1:])) or set(zip(x))
    return pairs(terms[:cut]), pairs(terms[cut:] or terms)


class Index:
    """Inverted index of items with the largest impact of each term in all, in each block and in each item.

    Impacts are divided by the item's threshold, so an item is retrieved when its impacts add up to 1."""

    def __init__(self, items: list[tuple[int, bytes]], df: dict[bytes, int], n: int, mean: float):
        self.items = [(i, t) for i, t in sorted(items, key=lambda x: x[0]) if terms_of(t)]
        self.parts = [parts_of(t) for _, t in self.items]
        self.strides = [-(-len(terms_of(t)) // (WINDOW // 2)) for _, t in self.items]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, t in self.items for w in terms_of(t)}))}
        blocks = -(-len(self.items) // BLOCK)
        self.block_max = np.zeros((len(self.ids), blocks), np.float32)
        self.blocks = []
        for b in range(blocks):
            own = self.items[b * BLOCK : (b + 1) * BLOCK]
            counts = [Counter(terms_of(t)) for _, t in own]
            row = np.zeros(len(self.ids), np.int32)
            here = sorted({self.ids[w] for c in counts for w in c})
            row[here] = np.arange(1, len(here) + 1)
            impact = np.zeros((len(here) + 1, BLOCK), np.float32)
            for k, c in enumerate(counts):
                length = sum(c.values())
                score = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for w, f in c.items()}
                limit = THRESHOLD * sum(score.values()) * self._share(b * BLOCK + k)
                for w, s in score.items():
                    impact[row[self.ids[w]], k] = s / limit
            self.blocks.append((row, impact))
            self.block_max[here, b] = impact[1:].max(axis=1)
        self.term_max = self.block_max.max(axis=1) if blocks else np.zeros(0, np.float32)

    def _share(self, k: int) -> float:
        """The part of an item's score that one window at least has when a stretch has it all: so many windows cover one."""
        return 1 / (1 if self.strides[k] < 2 else -(-(self.strides[k] + 2) // 2))

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, float]]:
        """`(text, window, item, score)` of all windows and items that reach the threshold."""
        half, get = WINDOW // 2, self.ids.get
        windows, terms, base, starts = [], [], 0, []
        for t in texts:
            own = np.array([get(w, -1) for w in terms_of(t)], np.int64)
            chunks = -(-len(own) // half)
            at = np.flatnonzero(own >= 0)
            chunk, last = at // half, max(chunks - 2, 0)
            for w in (chunk, chunk - 1):
                ok = (w >= 0) & (w <= last)
                windows.append(base + w[ok])
                terms.append(own[at[ok]])
            starts.append(base)
            base += last + 1
        if not self.items or not texts:
            return []
        size = len(self.ids)
        key = np.unique(np.concatenate(windows) * size + np.concatenate(terms))
        window, term = key // size, key % size
        window, term = self._pruned(window, term, self.term_max[term][:, None])[:2]
        if not len(window):
            return []
        window, term, hit = self._pruned(window, term, self.block_max[term])
        names, out = np.unique(window), []
        for b in np.flatnonzero(hit.any(axis=0)).tolist():
            row, impact = self.blocks[b]
            chosen = np.isin(window, names[hit[:, b]])
            w, t = window[chosen], term[chosen]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            score = np.add.reduceat(impact[row[t]], first, axis=0)
            for x, k in zip(*np.nonzero(score >= 1)):
                name = int(w[first[x]])
                d = int(np.searchsorted(starts, name, "right")) - 1
                out.append((d, name - starts[d], b * BLOCK + int(k), float(score[x, k]) * THRESHOLD))
        return out

    @staticmethod
    def _pruned(window, term, bounds):
        """Windows whose summed bounds reach 1 in any column, with the columns that do."""
        if not len(window):
            return window, term, np.zeros((0, bounds.shape[1]), bool)
        first = np.flatnonzero(np.diff(window, prepend=-1))
        hit = np.add.reduceat(bounds, first, axis=0) >= 1 - 1e-4
        some = hit.any(axis=1)
        keep = np.repeat(some, np.diff(np.append(first, len(window))))
        return window[keep], term[keep], hit[some]

    def confirmed(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """`(text, item_id, score, question, answer)`: the best of the windows or stretches that hold question and answer."""
        best: dict[tuple[int, int], tuple] = {}
        long: dict[tuple[int, int], list[int]] = {}
        for d, w, k, score in self.search(texts):
            if self.strides[k] > 1:
                long.setdefault((d, k), []).append(w)
                continue
            terms = terms_of(b" ".join(words_of(texts[d])[w * WINDOW // 2 : (w + 2) * WINDOW // 2]))
            pairs = set(zip(terms, terms[1:])) | set(zip(terms))
            q, a = (len(p & pairs) / len(p) for p in self.parts[k])
            if min(q, a) >= OVERLAP:
                best[d, k] = max(best.get((d, k), ()), (score, q, a))
        at, terms = -1, []
        for d, k in sorted(long):
            at, terms = d, terms if d == at else terms_of(texts[d])
            if got := self._stretched(terms, k, long[d, k]):
                best[d, k] = got
        return [(d, self.items[k][0], *x) for (d, k), x in sorted(best.items())]

    def _stretched(self, terms: list[bytes], k: int, windows: list[int]) -> tuple:
        """`(score, question, answer)` of the best stretch that holds the item and meets one of `windows`, or nothing.

        What enters and leaves from one stretch to the next is counted, so the work grows with the text alone."""
        half, n, (row, impact) = WINDOW // 2, self.strides[k] + 2, self.blocks[k // BLOCK]
        own = {t: float(impact[row[self.ids[t]], k % BLOCK]) * THRESHOLD * self._share(k) for t in set(terms_of(self.items[k][1]))}
        worth = {(t,): [s, 0, 0] for t, s in own.items()}
        for i, part in enumerate(self.parts[k], 1):
            for x in part:
                worth.setdefault(x, [0.0, 0, 0])[i] = 1
        size, chunks = [1.0, *map(len, self.parts[k])], -(-len(terms) // half)
        held: Counter = Counter()
        total, best, first, end = [0.0, 0, 0], (), 0, 0

        def moved(chunk: int, sign: int) -> None:
            x = terms[chunk * half : (chunk + 1) * half + 1]
            for f in (*zip(x, x[1:]), *zip(x[:half])):
                if f in worth:
                    held[f] += sign
                    if held[f] == (sign > 0):
                        total[:] = [t + sign * v for t, v in zip(total, worth[f])]

        for start in sorted({s for w in windows for s in range(max(0, w - n + 2), min(w + 2, chunks))}):
            if start >= end:
                held.clear()
                total, first, end = [0.0, 0, 0], start, start
            while end < min(start + n, chunks):
                moved(end, 1)
                end += 1
            while first < start:
                moved(first, -1)
                first += 1
            score, q, a = (t / s for t, s in zip(total, size))
            if score >= THRESHOLD - 1e-4 and min(q, a) >= OVERLAP:
                best = max(best, (min(score, 1.0), q, a))
        return best


def indexes(benchmark: DataFrame):
    """Lists of AT_ONCE indexes at most, one list at a time, each index of at most about INDEX_ITEMS items; term counts and lengths are those of the whole benchmark."""
    rows = materialise(raw_text(benchmark.where("item_id is not null"), "item_id").dropDuplicates(), "items")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("b")).first()
    if not total["n"]:
        return

    def counted(batches):
        for b in batches:
            terms = [terms_of(t) for t in column(b, "_text").to_pylist()]
            got = [(w, 1, 0) for x in terms for w in set(x)] + [(b"", int(len(x) > 0), len(x)) for x in terms]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["term", "df", "length"])

    counts = rows.mapInArrow(counted, "term binary, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    counts = materialise(counts, "item_terms")  # each index looks its terms up in it
    whole = counts.where(F.length("term") == 0).first()
    n = max(1, math.ceil(total["n"] / INDEX_ITEMS), math.ceil(total["b"] / INDEX_BYTES))
    out = []
    for k in range(n):
        own = [(r["item_id"], bytes(r["_text"])) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]  # one index
        words = benchmark.sparkSession.createDataFrame([(bytearray(w),) for w in {w for _, t in own for w in terms_of(t)} | {b""}], "term binary")
        df = {bytes(r["term"]): r["df"] for r in counts.join(F.broadcast(words), "term").collect()}
        out.append(Index(own, df, whole["df"], max(1.0, whole["length"] / max(1, whole["df"]))))
        if len(out) == AT_ONCE or k == n - 1:
            yield out
            out = []


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, item_id, score, question_overlap, answer_overlap)`, a row for each test item that a document holds.

    Every passage of every text is a query. Items without words, or with a null id, match nothing; null and empty texts
    hold nothing; an empty benchmark or corpus gives no rows. Items of equal texts are all found. Repeated documents are
    each reported. A score is the share of the item's own BM25 score. Texts of any length are searched whole; other columns,
    whatever their names, are not read."""
    kinds = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap"))])
    rows = raw_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    found = docs.sparkSession.createDataFrame([], kinds)
    for some in indexes(benchmark):

        def run(batches, some=some):
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    part = b.slice(at, 200)
                    names = column(part, "doc_id").to_pylist()
                    texts = column(part, "_text").to_pylist()
                    got = [(names[d], *x) for index in some for d, *x in index.confirmed(texts)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*got), schema)], schema=schema)

        found = found.union(rows.mapInArrow(run, kinds))
    return found


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; a map over the texts for each list of indexes.

    Edge cases are those of contamination(): null and empty texts and rows without an id hold nothing they do not say, so
    they stay; repeated rows stay or go together; an empty table or benchmark changes nothing. All columns are kept,
    whatever their names."""
    clean_col = free_name(docs, "clean")
    for some in indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):

        def clean(texts, some=some):
            held = {at + d for at in range(0, len(texts), 200) for index in some for d, *_ in index.confirmed(texts[at : at + 200])}
            return [pa.array([d not in held for d in range(len(texts))], pa.bool_())]

        docs = with_columns(docs, [(clean_col, "boolean")], lambda clean=clean: clean).where(F.col(clean_col)).drop(clean_col)
    return docs
