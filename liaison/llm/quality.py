"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .common import column, fold, free_name, raw_text, sum_arrays, table_batch, with_columns

#: Random features, kernel width in standard deviations for each statistic, ridge penalty for each row, calibration bins.
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 5.0, 1e-3, 4096, 7
THRESHOLD = 0.3

_KINDS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-()?", b"!", b"|", b"%&$#*@^~+=<>/\\_[]{}`", bytes(range(128, 256))), 1):
    _KINDS[list(_bytes)] = _k
STATISTICS = 26


def statistics(text: bytes) -> np.ndarray:
    """Lengths, kinds of characters, repetition and line shape of a text; all zero for an empty one."""
    out = np.zeros(STATISTICS)
    words, n = text.split(), len(text)
    if not words:
        return out
    m = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=hist, minlength=11)
    share = hist[hist > 0] / n
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    ends = Counter(w[-1] for w in words)
    letters = kinds[1] + kinds[2] + kinds[10]
    out[:11] = kinds / n
    out[11:] = (
        math.log1p(n), math.log1p(m), n / m, -(share * np.log(share)).sum(), len(counts) / m, counts.most_common(1)[0][1] / m,
        sum(map(eq, words, words[1:])) / m, len(set(lines)) / max(1, len(lines)), math.log1p(m / max(1, len(lines))),
        sum(c for b, c in ends.items() if _KINDS[b] in (0, 7, 8, 9)) / m, sum(w.isupper() for w in words) / m, letters / n,
        sum(len(w) < 4 for w in words) / m, math.log1p(kinds[6]) - math.log1p(m), len(set(zip(words, words[1:]))) / m,
    )
    return out


def statistics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, x)`: the statistics of each row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in column(b, "_text").to_pylist()], np.float32).reshape(-1, STATISTICS)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS, x.ravel())
            yield table_batch(schema, doc_id=column(b, "doc_id"), x=lists)

    rows = raw_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return rows.mapInArrow(run, "doc_id long, x array<float>")


class Model:
    """Standardised statistics -> cosine features -> ridge scores -> calibrated probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, *self.knots)


def _array(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(column(batch, "x").flatten()).reshape(-1, STATISTICS).astype(float)


def isotonic(at: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centres and rates of the pools, in ascending order."""
    pools: list[list[float]] = []
    for x, p, c in zip(at, positive, count):
        pools.append([x * c, p, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    sums = np.array(pools).T
    return sums[0] / sums[2], (sums[1] + 0.5 * sums[1].sum() / sums[2].sum()) / (sums[2] + 0.5)


def fit(rows: DataFrame) -> Model:
    """Fit on `(x, label, fold)`, all rows. Folds serve the calibration: a row's score there comes from the other folds.

    Without rows of both labels the score is the share of label 1 (no rows: a half) for every text."""
    parts = [F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("s")).alias(f"f{i}") for i in range(STATISTICS)]
    got = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p"), *parts).first()
    if not got["n"] or not 0 < got["p"] < got["n"]:
        model = Model(np.zeros(STATISTICS), np.ones(STATISTICS))
        model.knots = (np.array([0.0, 1.0]), np.full(2, got["p"] / got["n"] if got["n"] else 0.5))
        return model
    model = Model(np.array([got[f"f{i}"]["m"] for i in range(STATISTICS)]), np.array([max(got[f"f{i}"]["s"], 1e-6) for i in range(STATISTICS)]))
    size = FEATURES + 1

    def normal_equations(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z, y, folds = model.features(_array(b)), column(b, "label").to_numpy().astype(float), column(b, "fold").to_numpy()
            for k in np.unique(folds).tolist():
                own = z[folds == k]
                part = np.vstack([own.T @ own, own.T @ y[folds == k]])
                sums[k] = sums[k] + part if k in sums else part
        schema = pa.schema([("fold", pa.int32()), ("packed", pa.binary())])
        yield table_batch(schema, fold=list(sums), packed=[s.tobytes() for s in sums.values()])

    packed = sum_arrays(rows.mapInArrow(normal_equations, "fold int, packed binary"), ["fold"]).collect()  # a matrix for each fold
    sums = {r["fold"]: np.frombuffer(r["packed"]).reshape(size + 1, size) for r in packed}
    total = sum(sums.values())
    solve = lambda s: np.linalg.solve(s[:size] + RIDGE * max(s[size - 1, size - 1], 1) * np.eye(size), s[size])
    model.beta = solve(total)
    others = {k: solve(total - s) for k, s in sums.items()} if len(sums) > 1 else {k: model.beta for k in sums}

    def held_out(batches):
        schema = pa.schema([("bin", pa.int32()), ("label", pa.int32())])
        for b in batches:
            folds = column(b, "fold").to_numpy()
            betas = np.array([others[k] for k in folds.tolist()]).reshape(-1, size)
            raw = (model.features(_array(b)) * betas).sum(axis=1)
            yield table_batch(schema, bin=((np.clip(raw, -1, 2) + 1) / 3 * BINS).astype(np.int32), label=column(b, "label"))

    bins = rows.mapInArrow(held_out, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    bins = bins.orderBy("bin").toPandas()  # BINS rows at most
    model.knots = isotonic((bins["bin"].to_numpy() + 0.5) / BINS * 3 - 1, bins["p"].to_numpy(float), bins["n"].to_numpy(float))
    return model


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, held_out, score, predicted)` for every row of `docs`.

    `labels` has the id and `quality`; rows of fold `held_out` and rows without a label are not learnt from. Null and empty
    texts have statistics of zero and get a score like any other. Repeated rows are each scored; a repeated label counts
    each time. A null id is never labelled, and is not held out."""
    stats = materialise(statistics_of(docs, id_col, text_col), "statistics")
    model = learn(stats, labels, folds, held_out, id_col)

    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            yield table_batch(schema, doc_id=column(b, "doc_id"), score=model.score(_array(b)) if b.num_rows else [])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learn(stats: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id") -> Model:
    """Fit on the statistics of all labelled rows outside fold `held_out`."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label is not null")
    rows = stats.join(named, "doc_id").select("doc_id", "x", "label", fold(F.col("doc_id"), folds).alias("fold")).where(F.col("fold") != held_out)
    return fit(materialise(rows, "labelled"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are predicted 0 go. The statistics of all rows are taken for the fit, as a few numbers a row can be joined with
    the labels and texts need not be shuffled; the filter is a map over all texts.

    Edge cases are those of quality(): null and empty texts are scored like any other, repeated rows are kept or go together,
    rows without an id are scored, an empty table stays empty. All columns are kept, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(materialise(statistics_of(rows), "statistics"), labels)
    made = lambda texts: [pa.array(model.score(np.array([statistics(t) for t in texts], np.float32).reshape(-1, STATISTICS).astype(float)))]
    score = free_name(docs, "score")
    return with_columns(docs, [(score, "double")], lambda: made).where(F.col(score) >= THRESHOLD).drop(score)
