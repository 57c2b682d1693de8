"""Language-model scores: a hierarchical Pitman-Yor model whose seatings are sampled by Gibbs.

Three levels: a uniform base over the training words and one unknown, a restaurant of words, and a restaurant for each
context (the word before); all contexts share the restaurant of words as parent. A restaurant's customers are tokens; each
table that a context opens for a word is a customer of the parent.

A sweep redraws the seating of every (context, word) given the tables of all others and its parent's, as a block: what
a seating leaves behind is its number of tables, so that is drawn from its conditional law. Then the parent redraws its
seating of every word. Tables of one restaurant are drawn at once against its total of the sweep before, which is what
lets the sweep be distributed. Discounts follow the counts of counts.

Pairs of word and context are dealt by the word, those of frequent words by word and context, so none makes a task large.
Which words are frequent is estimated on rows chosen by a hash of id and text; it decides where pairs are worked on and
nothing else. What crosses the buckets of pairs are sums by word and by context: each bucket sends its own by ranges of their hash, they
are added up there, and totals return in the same order. Only pairs of two customers and more take part in sweeps, as one
customer has one table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .common import column, fold, raw_text, table_batch, words_of

#: Tokens of a bucket, about; documents and bytes of a block, at most (a longer text is a block of its own).
BUCKET_TOKENS, BLOCK_DOCS, BLOCK_BYTES = 1_000_000, 1000, 8 << 20
#: Strengths of the contexts and of their parent; sweeps before the first sample, samples, proposals of a sweep for a large pair.
STRENGTH, PARENT_STRENGTH, BURN_IN, SAMPLES, PROPOSALS, SEED = 1.0, 1.0, 1, 3, 4, 5
#: Contexts are told apart by so many bits of the hash, which saves a fifth of the disk: of n contexts any has another's
#: restaurant with probability n / 2 ** 48. Words have the whole hash.
CONTEXT_BITS = 48
#: A word is frequent that has this share of the tokens, in one of so many rows.
FREQUENT, ONE_IN = 1 / 4000, 64
#: Customers up to which tables are drawn from their exact law.
SMALL = 64
END = b"\n"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, as few as the largest needs."""
    a = np.ascontiguousarray(a, dtype="<u8")
    planes = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(b)[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : b[0]] = raw.T
    return out.view("<u8").ravel()


def ascending(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def restored(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b), dtype=np.uint64)


def ints(b: bytes) -> np.ndarray:
    return unsqueeze(b).view(np.int64)


def rows_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def a_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


# --- seatings ---


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / y - shift


def stirling(d: float, most: int) -> list[np.ndarray]:
    """For c customers, in how many ways weighed by the discount they fill 1 .. c tables, up to a factor; rows 0 .. most."""
    rows = [np.zeros(0), np.ones(1)]
    for c in range(1, most):
        row = np.append(rows[-1] * (c - d * np.arange(1, c + 1)), 0)
        row[1:] += rows[-1]
        rows.append(row / row.max())
    return rows


class Seating:
    """Draws the numbers of tables at which customers of one dish sit, given everything else in the model.

    `count` customers of which `now` tables are open; the restaurant's other tables give new ones the weight `others` plus
    the discount for each that is opened, times the share `(first + growth * opened) / (total + growth * opened)` of the
    dish in the parent, where `later` is taken off the first sum from the second table on. The law of t tables is then the weighed number of seatings
    times the product of these weights. It is drawn as it is for up to SMALL customers. For more, a proposal is drawn
    from the seating rule whose law comes nearest (exact up to SMALL customers, from there on as a birth process in the
    logarithm of their number, right to the order of 1 / SMALL) and accepted by the ratio of the weights; a `fresh` seating,
    whose tables now mean nothing yet, begins with a proposal."""

    def __init__(self, discount: float, rng: np.random.Generator, fresh: bool = False):
        self.d, self.rng, self.fresh, self.ways = discount, rng, fresh, stirling(discount, SMALL)

    def draw(self, count, now, others, first, total, growth, later=0.0) -> np.ndarray:
        out = np.minimum(count, 1).astype(np.int64)
        later, total = np.broadcast_to(later, len(count)), np.broadcast_to(total, len(count))
        order = np.argsort(count, kind="stable")
        cuts = np.searchsorted(count[order], np.arange(2, SMALL + 2))
        for c, (a, z) in enumerate(zip(cuts[:-1], cuts[1:]), 2):
            for at in range(a, z, 1 << 15):
                own = order[at : min(z, at + (1 << 15))]
                out[own] = self._exact(self.ways[c], others[own], first[own], total[own], growth, later[own])
        own = order[cuts[-1] :]
        for at in range(0, len(own), 1 << 12):
            part = own[at : at + (1 << 12)]
            out[part] = self._proposed(count[part], now[part], others[part], first[part], total[part], growth)
        return out

    def _exact(self, ways, others, first, total, growth, later):
        j = np.arange(len(ways))
        step = (others[:, None] + self.d * j) * np.maximum(first[:, None] + growth * j - later[:, None] * (j > 0), 1e-12) / (total[:, None] + growth * j)
        return self._pick(np.cumprod(step, axis=1) * ways)

    def _pick(self, weights):
        up = np.cumsum(weights, axis=1)
        return 1 + (up < (self.rng.random(len(up)) * up[:, -1])[:, None]).sum(axis=1).clip(max=weights.shape[1] - 1)

    def _proposed(self, count, now, others, first, total, growth):
        d, c = self.d, count.astype(float)
        low, high = np.full(len(c), 1e-9), np.full(len(c), 1e9)  # of 1 + strength / discount of the rule
        for _ in range(60):  # where the weights of t and t + 1 tables are even, at the rule's own mean of t
            r = np.sqrt(low * high)
            a = d * (r - 1)
            mean = np.clip(r * np.exp(log_gamma(c + a + d) - log_gamma(c + a) + log_gamma(a + 1) - log_gamma(a + d + 1)) - (r - 1), 1, c)
            over = d * (r - 1 + mean) > (others + d * mean) * (first + growth * mean) / (total + growth * mean)
            low, high = np.where(over, low, r), np.where(over, r, high)
        r = np.sqrt(low * high)
        a = d * (r - 1)

        def weight(t):
            share = log_gamma(t + first) - log_gamma(first) - log_gamma(t + total) + log_gamma(total) if growth else t * np.log(first / total)
            return share + log_gamma(t + others / d) - log_gamma(others / d) - log_gamma(t + r - 1) + log_gamma(r)

        opened = np.cumsum(np.log(r[:, None] + np.arange(SMALL - 1)), axis=1)
        logs = np.hstack([np.zeros((len(r), 1)), opened]) + np.arange(SMALL) * math.log(d) + np.log(np.maximum(self.ways[SMALL], 1e-300))
        early = np.exp(logs - logs.max(axis=1, keepdims=True))
        t = np.clip(now, 1, count)
        for k in range(PROPOSALS + self.fresh):
            began = self._pick(early)
            more = self.rng.negative_binomial(began + r - 1 + 1e-12, np.clip(((SMALL + a) / (c + a)) ** d, 1e-12, 1))
            new = np.minimum(began + more, count)
            with np.errstate(over="ignore"):
                taken = self.rng.random(len(t)) < np.exp(np.minimum(weight(new.astype(float)) - weight(t.astype(float)), 0))
            t = new if self.fresh and not k else np.where(taken, new, t)
        return t


class Law:
    """The parent's predictions, from numbers of the whole model: words, customers and tables of the parent, discounts."""

    def __init__(self, words: float, customers: float, tables: float, discount: float, parent_discount: float):
        self.words, self.customers, self.tables, self.d, self.d0 = words, customers, tables, discount, parent_discount
        self.total = PARENT_STRENGTH + customers
        self.base = (PARENT_STRENGTH + parent_discount * tables) / (words + 1)  # of a word, in units of one customer

    def share(self, customers, tables):
        return (np.maximum(customers - self.d0 * tables, 0) + self.base) / self.total

    def context_tables(self, seating: Seating, count, now, restaurant_tables, customers, parent_tables) -> np.ndarray:
        """New tables of pairs: those they have now leave the restaurant and, as customers, the parent."""
        left = np.maximum(customers - now, 0)
        first = np.maximum(left - self.d0 * np.minimum(parent_tables, left), 0) + self.base
        return seating.draw(count, now, STRENGTH + self.d * np.maximum(restaurant_tables - now, 0), first, self.total - now, 1, self.d0 * (left == 0))

    def parent_seats(self, seating: Seating, customers, now) -> np.ndarray:
        others = PARENT_STRENGTH + self.d0 * np.maximum(self.tables - now, 0)
        return seating.draw(customers, now, others, np.full(len(customers), 1.0), self.words + 1, 0)


# --- pairs of word and context ---


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted hashes of all words, with one end for each text; each token's place in them, that of the token before it
    (its context), and the tokens' texts."""
    split = [words_of(t) + [END] for t in texts]
    known = {w: word_hash(w) for w in set().union(*split)} if split else {}
    names = np.unique(np.fromiter(known.values(), np.uint64, len(known)))
    place = dict(zip(known, np.searchsorted(names, np.fromiter(known.values(), np.uint64, len(known))).tolist()))
    size = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((place[w] for own in split for w in own), np.int64, size.sum())
    before = np.roll(words, 1)
    if len(words):
        before[np.append(0, np.cumsum(size)[:-1])] = place[END]
    return names, words, before, np.repeat(np.arange(len(texts)), size)


def blocks_of(batches):
    """The rows in lists of BLOCK_DOCS documents or BLOCK_BYTES at most."""
    rows, size = [], 0
    for b in batches:
        for row in zip(*(column(b, n).to_pylist() for n in ("doc_id", "held_out", "_text"))):
            if rows and (len(rows) == BLOCK_DOCS or size + len(row[2]) > BLOCK_BYTES):
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    if rows:
        yield rows


PACKED = "bucket int, block long, docs array<long>, held array<boolean>, words binary, names binary, context binary, doc binary, n binary"


def frequent_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the words, fewer than 1 / FREQUENT, that are frequent in one of ONE_IN rows, in order."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for part in blocks_of(batches):
            names, words, *_ = tokens_of([x for *_, x in part])
            yield table_batch(schema, word=names.view(np.int64), n=np.bincount(words, minlength=len(names)))

    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "_text"), F.lit(ONE_IN)) == 0)
    counts = materialise(chosen.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r["word"] for r in counts.where(F.col("n") > total * FREQUENT).collect()], np.int64).view(np.uint64))


def packed_tokens(rows: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Blocks of documents, cut by buckets: the pairs' words in order, the contexts' names and each pair's place in them, the
    documents that have the pairs, and twice how often, plus 1 for a training document. A row with a negative bucket names a
    block's documents."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("words", "names", "context", "doc", "n"))])

    def run(batches):
        for block, part in enumerate(blocks_of(batches), TaskContext.get().partitionId() << 24):
            ids, held, texts = map(list, zip(*part))
            names, words, before, doc = tokens_of(texts)
            keys = words << 32 | before
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order]
            first = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            n = np.diff(np.append(first, len(keys)))
            keys, doc = keys[first], doc[first]
            n = 2 * n + ~np.array(held, bool)[doc]
            word, context = names[keys >> 32], keys & 0xFFFFFFFF
            own = np.where(np.isin(word, hot), word ^ (names[context] * np.uint64(0x9E3779B97F4A7C15)), word) * np.uint64(0xC2B2AE3D27D4EB4F)
            to = ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            out = [(-1 - block % buckets, block, ids, held, *[None] * 5)]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[k] : cuts[k + 1]]
                here, place = np.unique(names[context[own]] >> np.uint64(64 - CONTEXT_BITS), return_inverse=True)
                out.append((k, block, None, None, ascending(word[own]), ascending(here), squeeze(place), squeeze(doc[own]), squeeze(n[own])))
            yield a_batch(schema, out)

    return rows.mapInArrow(run, PACKED)


MERGED = "bucket int, words binary, word binary, names binary, context binary, count binary, blocks array<long>, sizes array<int>, at binary, doc binary, n binary, docs array<long>, held array<boolean>"


def merged(packed: DataFrame) -> DataFrame:
    """One row for each bucket, with its distinct pairs (places in its words and contexts) and their training customers; rows
    of documents pass through."""
    columns = [x.split()[0] for x in MERGED.split(", ")]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf.assign(blocks=[[x] for x in pdf["block"]]).drop(columns=["words", "names", "context", "doc", "n"]).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)
        words, names = [restored(x) for x in pdf["words"]], [restored(x) for x in pdf["names"]]
        firsts = [np.flatnonzero(np.diff(x, prepend=x[:1] + np.uint64(1))) for x in words]
        every_word = np.unique(np.concatenate([w[f] for w, f in zip(words, firsts)]))
        every_name = np.unique(np.concatenate(names))
        keys = []
        for w, f, c, own in zip(words, firsts, names, pdf["context"]):
            word = np.repeat(np.searchsorted(every_word, w[f]), np.diff(np.append(f, len(w))))
            keys.append(word << 32 | np.searchsorted(every_name, c)[ints(own)])
        n_all = np.concatenate([unsqueeze(x) for x in pdf["n"]])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, (n_all >> np.uint64(1)) * (n_all & np.uint64(1)), len(every)).astype(np.uint64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        moved = np.concatenate([np.diff(x, prepend=0) for x in np.split(at, cuts)])
        return pd.DataFrame({
            "bucket": pdf["bucket"].iloc[:1], "words": [ascending(every_word)], "word": [ascending(every >> 32)], "names": [ascending(every_name)],
            "context": [squeeze(every & 0xFFFFFFFF)], "count": [squeeze(count)], "blocks": [pdf["block"].tolist()], "sizes": [[len(k) for k in keys]],
            "at": [squeeze(moved.view(np.uint64))], "doc": [squeeze(np.concatenate([unsqueeze(d) for d in pdf["doc"]]))], "n": [squeeze(n_all >> np.uint64(1))], "docs": [None], "held": [None],
        })

    return packed.groupBy("bucket").applyInPandas(merge, MERGED)


# --- sums that cross buckets ---
# A part is a range of hashes of words (0 .. parts - 1) or of contexts (parts .. 2 * parts - 1).


def cut_by_part(names: np.ndarray, parts: int, bits: int) -> list[int]:
    """Where the ascending `names`, of so many bits, are cut by equal ranges."""
    to = ((names >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64)).tolist()


ACTIVE = "bucket int, word binary, context binary, count binary, word_cuts array<int>, context_cuts array<int>"


def active_pairs(table: DataFrame, parts: int) -> DataFrame:
    """The pairs of two customers and more of each bucket, as places in the bucket's words and contexts that have such pairs."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("word", "context", "count")), *((n, pa.list_(pa.int32())) for n in ("word_cuts", "context_cuts"))])

    def run(batches):
        for row in rows_of(batches):
            count = ints(row["count"])
            on = np.flatnonzero(count > 1)
            w, word = np.unique(restored(row["word"])[on], return_inverse=True)
            c, context = np.unique(ints(row["context"])[on], return_inverse=True)
            cuts = [cut_by_part(restored(row[n])[x.astype(np.int64)], parts, bits) for n, x, bits in (("words", w, 64), ("names", c, CONTEXT_BITS))]
            yield a_batch(schema, [(row["bucket"], squeeze(word), squeeze(context), squeeze(count[on]), *cuts)])

    return table.select("bucket", "words", "word", "names", "context", "count").mapInArrow(run, ACTIVE)


def gathered_names(table: DataFrame, parts: int) -> DataFrame:
    """A row for each part: its buckets, where each one's names stand among those of the part (all, and those of active
    pairs), and the names' customers and pairs over all buckets; and numbers for the whole model."""
    sent = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("names", "active", "count", "pairs"))])

    def send(batches):
        for row in rows_of(batches):
            count, out = ints(row["count"]), []
            for k, (names, at) in enumerate(((restored(row["words"]), restored(row["word"]).view(np.int64)), (restored(row["names"]), ints(row["context"])))):
                sums = [np.bincount(at, x, len(names)).astype(np.uint64) for x in (count, count > 0, count > 1)]
                for p, (a, b) in enumerate(zip(cuts := cut_by_part(names, parts, (64, CONTEXT_BITS)[k]), cuts[1:])):
                    if a < b:
                        out.append((k * parts + p, row["bucket"], ascending(names[a:b]), squeeze(sums[2][a:b] > 0), squeeze(sums[0][a:b]), squeeze(sums[1][a:b])))
            yield a_batch(sent, out)

    kinds = "part int, buckets array<int>, at array<binary>, active array<binary>, count binary, pairs binary, n_words long, n_tokens long, n_pairs long, ones long, twos long"

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [restored(x) for x in pdf["names"]]
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        count, pairs = (np.bincount(at, np.concatenate([unsqueeze(x) for x in pdf[n]]), len(every)).astype(np.int64) for n in ("count", "pairs"))
        own = np.split(at, np.cumsum([len(x) for x in names])[:-1])
        part = int(pdf["part"].iloc[0])
        numbers = [(count > 0).sum(), count.sum(), pairs.sum(), (pairs == 1).sum(), (pairs == 2).sum()] if part < parts else [0] * 5
        return pd.DataFrame([[part, pdf["bucket"].tolist(), [ascending(x) for x in own], [ascending(x[unsqueeze(a) > 0]) for x, a in zip(own, pdf["active"])], squeeze(count), squeeze(pairs), *map(int, numbers)]], columns=[x.split()[0] for x in kinds.split(", ")])

    pairs = table.select("bucket", "words", "word", "names", "context", "count")
    return pairs.mapInArrow(send, "part int, bucket int, names binary, active binary, count binary, pairs binary").groupBy("part").applyInPandas(gather, kinds)


def returned(state: DataFrame, at: str, *values: str) -> DataFrame:
    """`(bucket, back)`: for each bucket the parts' `values` at its own names, in the order of parts."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("values", pa.list_(pa.binary()))])

    def run(batches):
        for row in rows_of(batches):
            x = [ints(row[v]) for v in values]
            places = [restored(a).astype(np.int64) for a in row["places"]]
            yield a_batch(schema, [(b, row["part"], [squeeze(v[p]) for v in x]) for b, p in zip(row["buckets"], places) if len(p)])

    rows = state.select("part", "buckets", F.col(at).alias("places"), *values).mapInArrow(run, "bucket int, part int, values array<binary>")
    return rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("part", "values"))).alias("back"))


def by_name(back: list[dict], parts: int, k: int, contexts: bool) -> np.ndarray:
    """Value `k` of a bucket's words or contexts."""
    own = [ints(x["values"][k]) for x in back or [] if (x["part"] >= parts) == contexts]
    return np.concatenate(own) if own else np.zeros(0, np.int64)


def sweep(active: DataFrame, state: DataFrame, law: Law, number: int, parts: int) -> DataFrame:
    """The pairs' new tables: rows of a bucket's sums by part (tables but one of each pair), and with part -1 the tables."""
    schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        for row in rows_of(batches):
            seating = Seating(law.d, np.random.default_rng([SEED, number, row["bucket"]]), number == 1)
            word, context, count = (ints(row[n]) for n in ("word", "context", "count"))
            now = ints(row["tables"]) + 1 if row["tables"] else np.ones(len(word), np.int64)
            customers, seats, tables = by_name(row["back"], parts, 0, False), by_name(row["back"], parts, 1, False), by_name(row["back"], parts, 0, True)
            new = law.context_tables(seating, count, now, tables[context], customers[word], seats[word]) - 1
            out = [(-1, row["bucket"], squeeze(new))]
            for k, (at, cuts) in enumerate(((word, row["word_cuts"]), (context, row["context_cuts"]))):
                sums = np.bincount(at, new, cuts[-1]).astype(np.uint64)
                out += [(k * parts + p, row["bucket"], squeeze(sums[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            yield a_batch(schema, out)

    return materialise(active.join(returned(state, "active", "x", "y"), "bucket", "left").mapInArrow(run, "part int, bucket int, sums binary"), "sweep")


STATE = "part int, buckets array<int>, active array<binary>, x binary, y binary, customers long, seats long, ones long, twos long"


def settled(names: DataFrame, state: DataFrame | None, sent: DataFrame | None, law: Law | None, number: int, parts: int) -> DataFrame:
    """For each part what the contexts' tables add up to (x) and, for words, the tables of the parent (y), drawn anew."""
    schema = pa.schema([("part", pa.int32()), ("buckets", pa.list_(pa.int32())), ("active", pa.list_(pa.binary())), ("x", pa.binary()), ("y", pa.binary()), *((n, pa.int64()) for n in ("customers", "seats", "ones", "twos"))])

    def run(batches):
        for row in rows_of(batches):
            x, is_word = ints(row["pairs"]).copy(), row["part"] < parts
            where = dict(zip(row["buckets"], row["active"]))
            for s in row.get("sent") or []:
                np.add.at(x, restored(where[s["bucket"]]).astype(np.int64), ints(s["sums"]))
            if not is_word:
                y, numbers = np.zeros(len(x), np.int64), [0] * 4
            else:
                y = np.minimum(x, 1)
                if law:
                    seating = Seating(law.d0, np.random.default_rng([SEED, number, 1 << 30, row["part"]]), number == 1)
                    y = law.parent_seats(seating, x, np.minimum(ints(row["y"]), x))
                numbers = [x.sum(), y.sum(), (x == 1).sum(), (x == 2).sum()]
            yield a_batch(schema, [(row["part"], row["buckets"], row["active"], squeeze(x), squeeze(y), *map(int, numbers))])

    rows = names.select("part", "buckets", "active", "pairs")
    if sent is not None:
        rows = rows.join(state.select("part", "y"), "part")
        rows = rows.join(sent.where("part >= 0").groupBy("part").agg(F.collect_list(F.struct("bucket", "sums")).alias("sent")), "part", "left")
    return materialise(rows.mapInArrow(run, STATE), "state")


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.05, 0.95))


SUMS = "block long, docs array<long>, held array<boolean>, doc binary, sums array<binary>"


def scores(table: DataFrame, laws: list[Law], tokens: int, words: int, parts: int) -> DataFrame:
    """For each block what this bucket adds to those of its documents that have words here: tokens, known tokens, base score
    and score, the scores in units of 1e-9 and 1e-6 (none is above 0)."""
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("doc", pa.binary()), ("sums", pa.list_(pa.binary()))])

    def run(batches):
        for row in rows_of(batches):
            word, context, count = restored(row["word"]).view(np.int64), ints(row["context"]), ints(row["count"])
            own = by_name(row["back"], parts, 0, False)
            base, known = -np.log10((own + 1) / (tokens + words + 1))[word], (own > 0)[word]
            total, active = STRENGTH + by_name(row["back"], parts, 0, True)[context], np.flatnonzero(count > 1)
            seen = np.zeros(len(word))
            for k, law in enumerate(laws):
                tables = np.minimum(count, 1)
                tables[active] += ints(row[f"tables{k}"])
                share = law.share(by_name(row["back"], parts, 1 + 2 * k, False), by_name(row["back"], parts, 2 + 2 * k, False))
                new = (STRENGTH + law.d * by_name(row["back"], parts, 1 + 2 * k, True)[context]) / total
                seen += np.maximum(count - law.d * tables, 0) / total + new * share[word]
            value = -np.log10(np.clip(seen / len(laws), 1e-300, 1))
            out, cuts = [], np.cumsum(row["sizes"])[:-1]
            for block, at, doc, n in zip(row["blocks"], *(np.split(ints(row[k]), cuts) for k in ("at", "doc", "n"))):
                at = np.cumsum(at)
                has, place = np.unique(doc, return_inverse=True)
                sums = [np.bincount(place, n * x, len(has)) for x in (1, known[at], base[at] * 1e9, value[at] * 1e6)]
                out.append((block, None, None, ascending(has.view(np.uint64)), [squeeze(np.rint(x)) for x in sums]))
            yield a_batch(schema, out)

    return table.mapInArrow(run, SUMS)


def pitman_yor(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)` for every row of `docs`.

    Rows of fold `held_out` are scored only. Null and empty texts are one end token. A null id is learnt from; repeated rows
    each count and are each scored. Without training rows every word is unknown. An empty table gives no rows. A text of any
    length is taken whole, in a block of its own if need be; other columns, whatever their names, are not read. Scores do
    not depend on how the rows are split into files."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)))
    rows = raw_text(rows, "doc_id", "held_out")
    size = rows.agg(F.sum(F.length("_text") + 1).alias("n")).first()["n"] or 0
    parts = buckets = max(16, math.ceil(size / 6 / BUCKET_TOKENS))  # a word and a blank are about six bytes
    every_bucket = materialise(merged(packed_tokens(rows, buckets, frequent_words(rows))), "buckets")
    table = every_bucket.where("bucket >= 0").drop("docs", "held")
    names = materialise(gathered_names(table, parts), "names")
    active = materialise(active_pairs(table, parts), "active")
    got = names.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_pairs", "ones", "twos"))).first()
    words, tokens = got["n_words"], got["n_tokens"]
    d = discount(*pair_ones_and_twos(table))
    law = Law(words, got["n_pairs"], words, d, discount(got["ones"], got["twos"]))
    state, samples = settled(names, None, None, None, 0, parts), []
    tables = None
    for number in range(1, BURN_IN + SAMPLES + 1):
        own = active.join(tables, "bucket", "left") if tables is not None else active.withColumn("tables", F.lit(None).cast("binary"))
        sent = sweep(own, state, law, number, parts)
        state = settled(names, state, sent, law, number, parts)
        tables = sent.where("part = -1").select("bucket", F.col("sums").alias("tables"))
        got = state.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "seats", "ones", "twos"))).first()
        law = Law(words, got["customers"], got["seats"], d, discount(got["ones"], got["twos"]))
        if number > BURN_IN:
            samples.append((state, tables, law))
    totals, scored = names.select("part", "buckets", "at", "count"), table
    for k, (state, tables, _) in enumerate(samples):
        totals = totals.join(state.select("part", F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), "part")
        scored = scored.join(tables.withColumnRenamed("tables", f"tables{k}"), "bucket", "left")
    scored = scored.join(returned(totals, "at", "count", *(f"{v}{k}" for k in range(len(samples)) for v in "xy")), "bucket", "left")
    by_block = every_bucket.where("bucket < 0").select(F.col("blocks")[0].alias("block"), "docs", "held", F.lit(None).cast("binary").alias("doc"), F.lit(None).cast("array<binary>").alias("sums"))
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's rows, as many as its documents' words have buckets, into a row for each document."""
        own = pdf[pdf["docs"].notna()].iloc[0]
        total = np.zeros((4, len(own["docs"])))
        for doc, sums in zip(pdf["doc"], pdf["sums"]):
            if doc is not None:
                total[:, restored(doc).astype(np.int64)] += [unsqueeze(x) for x in sums]
        ids = pd.array([None if x is None or x != x else int(x) for x in own["docs"]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": list(own["held"]), "n_tokens": total[0].astype(np.int64), "n_known": total[1].astype(np.int64), "base_score": -total[2] / 1e9, "score": -total[3] / 1e6})

    found = by_block.union(scores(scored, [law for *_, law in samples], tokens, words, parts)).groupBy("block").applyInPandas(summed, kinds)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def pair_ones_and_twos(table: DataFrame) -> tuple[int, int]:
    """How many pairs have one training customer, and two."""
    schema = pa.schema([("ones", pa.int64()), ("twos", pa.int64())])

    def run(batches):
        for row in rows_of(batches):
            count = ints(row["count"])
            yield a_batch(schema, [(int((count == 1).sum()), int((count == 2).sum()))])

    got = table.select("count").mapInArrow(run, "ones long, twos long").agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    return got[0], got[1]


def op2_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return pitman_yor(spark.read.parquet(f"{sf_dir}/documents.parquet"))
