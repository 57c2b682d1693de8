"""Mixing to target weights: soft domain memberships, and document rates that bring expected domain totals to their targets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .common import column, free_name, raw_text, sum_arrays, table_batch, with_columns

#: Buckets of byte pairs; domains at most; weights of the evidence among which held-out likelihood chooses.
BUCKETS, MAX_DOMAINS, TEMPERS = 4096, 64, tuple(2.0**-k for k in range(13))
ROUNDS, TOLERANCE = 40, 1e-6
#: Rows that the pipeline makes of one document, at most.
MAX_COPIES = 16.0
#: The classifier is fitted on so many labelled rows at most, those of the smallest id hash; the bound keeps them broadcast.
MAX_LABELLED = 20_000
#: Production targets of the query and the pipeline: shares of tokens for each language.
TARGETS = {"en": 0.55, "fr": 0.16, "de": 0.15, "es": 0.14}


def pair_counts(text: bytes) -> np.ndarray:
    a = np.frombuffer(text.lower(), np.uint8).astype(np.int64)
    return np.bincount((a[:-1] * 67 + a[1:] * 259) % BUCKETS, minlength=BUCKETS)


class Membership:
    """Multinomial naive Bayes on byte pairs. Pairs of one text are not independent, so their evidence counts for `temper` of
    itself, which is chosen by the likelihood of labelled rows that the rates were not counted on."""

    def __init__(self, counts: np.ndarray, texts: np.ndarray, temper: float = 1.0):
        rate = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.log_rate, self.log_prior, self.temper = np.log(rate).T, np.log((texts + 0.5) / (texts + 0.5).sum()), temper

    def evidence(self, text: bytes) -> np.ndarray:
        own = pair_counts(text)
        used = np.flatnonzero(own)
        return own[used] @ self.log_rate[used]

    def __call__(self, text: bytes) -> np.ndarray:
        odds = self.log_prior + self.temper * self.evidence(text)
        p = np.exp(odds - odds.max())
        return p / p.sum()


def fit_membership(rows: DataFrame, domains: list[str]) -> Membership:
    """From all rows `(domain, half, _text)` whose domain is one of `domains`; each half, 0 or 1, tests what the other says."""
    at = {d: k for k, d in enumerate(domains)}
    packed = pa.schema([("k", pa.int32()), ("packed", pa.binary())])

    def counted(batches):
        sums = np.zeros((2 * len(domains), BUCKETS + 1))
        for b in batches:
            for d, half, t in zip(*(column(b, n).to_pylist() for n in ("domain", "half", "_text"))):
                sums[2 * at[d] + half, :BUCKETS] += pair_counts(t)
                sums[2 * at[d] + half, BUCKETS] += 1
        some = np.flatnonzero(sums[:, BUCKETS]).tolist()
        yield table_batch(packed, k=some, packed=[sums[k].tobytes() for k in some])

    total = np.zeros((2 * len(domains), BUCKETS + 1))
    for r in sum_arrays(rows.mapInArrow(counted, "k int, packed binary"), ["k"]).collect():  # two rows for each domain
        total[r["k"]] = np.frombuffer(r["packed"])
    total = total.reshape(len(domains), 2, -1)
    halves = [Membership(total[:, 1 - h, :BUCKETS], total[:, 1 - h, BUCKETS]) for h in range(2)]

    def tested(batches):
        likely = np.zeros(len(TEMPERS))
        for b in batches:
            for d, half, t in zip(*(column(b, n).to_pylist() for n in ("domain", "half", "_text"))):
                odds = halves[half].log_prior + np.outer(TEMPERS, halves[half].evidence(t))
                top = odds.max(axis=1)
                likely += odds[:, at[d]] - top - np.log(np.exp(odds - top[:, None]).sum(axis=1))
        yield table_batch(packed, k=[0], packed=[likely.tobytes()])

    likely = sum_arrays(rows.mapInArrow(tested, "k int, packed binary"), ["k"]).first()
    temper = TEMPERS[int(np.frombuffer(likely["packed"]).argmax())] if likely else 1.0
    total = total.sum(axis=1)
    return Membership(total[:, :BUCKETS], total[:, BUCKETS], temper)


def fit_steps(soft: DataFrame, targets: np.ndarray, floor: float, ceiling: float) -> tuple[list[np.ndarray], float]:
    """The steps of projected gradient descent on the squared gap between expected totals and targets, and what gap is left
    as a share of the targets.

    `soft` has `(p array, n)`: each document's membership and tokens. A rate starts at 1 and loses p . step each round, and is
    brought back between `floor` and `ceiling`; a step is the gap times the inverse of the memberships' second moments. Every
    round is one pass over the documents; what it sends to the driver is a vector and a matrix of the domains' number."""
    k, steps = len(targets), []

    def totals(batches):
        out = np.zeros(k + k * k)
        for b in batches:
            p, n = np.asarray(column(b, "p").flatten()).reshape(-1, k), column(b, "n").to_numpy().astype(float)
            r = rates(p, steps, floor, ceiling)
            out[:k] += (r * n) @ p
            free = ((r > floor) & (r < ceiling)) | (not steps)
            out[k:] += ((p[free] * n[free, None]).T @ p[free]).ravel()
        yield table_batch(pa.schema([("k", pa.int32()), ("packed", pa.binary())]), k=[0], packed=[out.tobytes()])

    best, kept = math.inf, []
    for _ in range(ROUNDS):
        got = np.frombuffer(sum_arrays(soft.mapInArrow(totals, "k int, packed binary"), ["k"]).first()["packed"])
        gap, moment = got[:k] - targets, got[k:].reshape(k, k)
        size = float(np.abs(gap).sum() / max(targets.sum(), 1))
        if size < best:
            best, kept = size, list(steps)
        if size < TOLERANCE:
            break
        steps.append(np.linalg.solve(moment + 1e-9 * max(np.trace(moment), 1e-9) * np.eye(k), gap))
    return kept, best


def rates(p: np.ndarray, steps: list[np.ndarray], floor: float, ceiling: float = math.inf) -> np.ndarray:
    r = np.ones(len(p))
    for s in steps:
        r = np.clip(r - p @ s, floor, ceiling)
    return r


class Mixture:
    """The classifier and the steps that turn a membership into a rate, and the memberships of the rows it was fitted on."""

    def __init__(self, docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str, floor: float, ceiling: float, id_col: str, text_col: str):
        self.domains = sorted(targets)
        assert 0 < len(self.domains) <= MAX_DOMAINS
        weights = np.array([targets[d] for d in self.domains]) / sum(targets.values())
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(domain_col).cast("string").alias("domain"))
        named = labels.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
        named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
        known = rows.where(F.col("domain").isin(self.domains)).join(F.broadcast(named), "doc_id", "left_semi").withColumn("half", half)
        self.model = fit_membership(materialise(raw_text(known, "domain", "half"), "labelled"), self.domains)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("p", pa.list_(pa.float64()))])
        memberships, k = self.memberships, len(self.domains)

        def member(batches):
            for b in batches:
                texts = column(b, "_text").to_pylist()
                p = memberships(texts)
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * k, p.ravel())
                yield table_batch(schema, doc_id=column(b, "doc_id"), n=[len(t.split()) for t in texts], p=lists)

        self.soft = materialise(raw_text(rows, "doc_id").mapInArrow(member, "doc_id long, n long, p array<double>"), "memberships")
        have = np.array([x or 0.0 for x in self.soft.agg(*(F.sum(F.col("p")[i] * F.col("n")).alias(f"t{i}") for i in range(k))).first()])
        self.steps, self.residual = fit_steps(self.soft, weights * max(have / np.maximum(weights, 1e-12)), floor, ceiling) if have.sum() else ([], 0.0)

    @property
    def memberships(self):
        model, k = self.model, len(self.domains)

        def of(texts: list[bytes]) -> np.ndarray:
            return np.array([model(t) for t in texts], float).reshape(-1, k)

        return of


def mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", floor: float = 0.0, ceiling: float = math.inf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_tokens, membership, rate, residual)` for every row of `docs`.

    `targets` has a weight for each domain of the classifier (MAX_DOMAINS at most). It learns from rows whose id is in
    `labels` (MAX_LABELLED ids at most) and whose `domain_col` is one of the targets; with no such rows memberships are
    equal. The totals aimed at have the targets' proportions and are the least that no domain has to shrink for. Null and
    empty texts have 0 tokens and the prior's membership; repeated rows each count; a null id or domain is never learnt
    from. `floor` and `ceiling` are the least and largest rates allowed; `residual`, the same for all rows, is what they leave
    of the gap to the targets, as a share. Texts of any length are taken whole; other columns, whatever their names, are not
    read; an empty table gives no rows."""
    mix = Mixture(docs, labels, targets, domain_col, floor, ceiling, id_col, text_col)
    domains, steps = mix.domains, mix.steps

    def rated(batches):
        for b in batches:
            p = np.asarray(column(b, "p").flatten()).reshape(-1, len(domains))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates(p, steps, floor, ceiling))], ["doc_id", "n", "p", "rate"])

    found = mix.soft.mapInArrow(rated, "doc_id long, n long, p array<double>, rate double")
    by_name = F.map_from_arrays(F.array(*map(F.lit, domains)), "p")
    return found.select("doc_id", F.col("n").alias("n_tokens"), by_name.alias("membership"), "rate", F.lit(mix.residual).alias("residual"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixing(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    share = [F.col("membership")[d].alias(f"p_{d}") for d in sorted(TARGETS)]
    return found.select("doc_id", "n_tokens", *share, F.round("rate", 9).alias("rate"), "residual")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is given as many rows as its rate says: the whole part, and one more by its id's hash for the rest.

    Rates are 1 at least, so no document is lost, and MAX_COPIES at most. The rates are found in a map over the texts. Edge
    cases are those of mixing(): null and empty texts have the prior's rate, repeated rows are each repeated, a null id takes
    the same rest as any other null id, an empty table stays empty. All columns are kept, whatever their names."""
    mix = Mixture(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, "lang", 1.0, MAX_COPIES, "doc_id", "text")
    memberships, steps = mix.memberships, mix.steps
    rate = free_name(docs, "rate")
    rated = with_columns(docs, [(rate, "double")], lambda: lambda texts: [pa.array(rates(memberships(texts), steps, 1.0, MAX_COPIES))])
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mixing")), F.lit(1 << 20)) / (1 << 20)
    times = F.greatest(F.floor(F.col(rate) + u).cast("int"), F.lit(1))
    copy = free_name(rated, "copy")
    return rated.select("*", F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(rate, copy)
