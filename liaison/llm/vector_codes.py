"""Codes of vectors: each cut into equal parts, each part the index of its nearest codebook entry, fitted by Lloyd's rounds.

Everything is counted in whole numbers. Vectors are packed into blocks once and written in buckets of the block's number; so
are each round's assignments, so a round meets the last assignments with its vectors without a shuffle. A task adds up what
the parts whose assignment changed give to their new entries and take from their old ones; these sums, of at most
entries * positions rows a task, are all that is shuffled, and the running sums and counts of the codebooks take them up."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, shared_path
from .common import looked_up

SCALE = 4096
#: Vectors of a block, and of a bucket about.
BLOCK, BUCKET = 1024, 1 << 20
NONE = 255


def whole_numbers(vec: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, filled with zeros to `width`: int64, or Python's integers if some are too large."""
    flat = np.asarray(vec.values.slice(vec.offsets[0].as_py(), vec.offsets[-1].as_py() - vec.offsets[0].as_py()), float)
    sizes = np.diff(np.asarray(vec.offsets))
    big = np.abs(flat).max(initial=0) * scale >= 2**52
    out = np.zeros((len(sizes), width), object if big else np.int64)
    rows, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = [int(x) * scale if abs(x) >= 2**52 else int(x * scale // 1) for x in flat.tolist()] if big else np.floor(flat * scale).astype(np.int64)
    return out


def packed(x: np.ndarray) -> bytes:
    """Fixed-width integers as small as they can be, or decimals joined by commas."""
    if x.dtype != object:
        least = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
        for kind, bits in ((np.int16, 15), (np.int32, 31), (np.int64, 63)):
            if least < 1 << bits:
                return np.dtype(kind).str.encode() + x.astype(kind).tobytes()
    return b"<o0" + ",".join(map(str, x.ravel().tolist())).encode()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    if raw[:3] == b"<o0":
        return np.array(list(map(int, raw[3:].split(b","))), object).reshape(-1, width)
    return np.frombuffer(raw, raw[:3].decode(), offset=3).astype(np.int64).reshape(-1, width)


def exact(x: np.ndarray, *others: np.ndarray) -> bool:
    """Whether squared distances of rows of these arrays fit 64 bits."""
    most = max(int(abs(y).max(initial=0)) for y in (x, *others))
    return x.shape[-1] * (2 * most) ** 2 < 2**62


def nearest_entries(x: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the nearest entry (ties: the lower) and its squared distance."""
    book = np.array(entries, object)
    kind = np.int64 if x.dtype != object and exact(x, book) else object
    gap = x.astype(kind)[:, None, :] - book.astype(kind)[None]
    d = (gap * gap).sum(axis=2)
    code = d.argmin(axis=1)
    return code.astype(np.uint8), d[np.arange(len(d)), code]


class Codebooks:
    """Entries by position, with the running sums and counts of the parts that are assigned to each."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.sums = [[[0] * len(e) for e in book] for book in entries]
        self.counts = [[0] * len(book) for book in entries]

    def take(self, rows) -> None:
        """Add `(position, entry, count, sums)`, then set every used entry to the floor of its mean."""
        for p, e, count, sums in rows:
            self.counts[p][e] += count
            self.sums[p][e] = [a + int(b) for a, b in zip(self.sums[p][e], sums)]
        for p, book in enumerate(self.entries):
            for e, n in enumerate(self.counts[p]):
                if n:
                    book[e] = [s // n for s in self.sums[p][e]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for e in book for x in e).encode()).hexdigest()


def changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, parts: int, into: dict) -> None:
    """Add to `into[(position, entry)] = [count, sums]` what parts with another assignment than before give and take."""
    size = x.shape[1] // parts
    most = max(int(x.max(initial=0)), -int(x.min(initial=0))) if len(x) else 0
    x = x if x.dtype == object or most * max(len(x), 1) < 2**62 else x.astype(object)
    for p in range(parts):
        moved = np.flatnonzero(old[:, p] != new[:, p])
        for codes, sign in ((new, 1), (old, -1)):
            own = codes[moved, p]
            for e in np.unique(own[own != NONE]).tolist():
                rows = x[moved[own == e], p * size : (p + 1) * size]
                held = into.setdefault((p, e), [0, [0] * size])
                held[0] += sign * len(rows)
                held[1] = [a + sign * int(b) for a, b in zip(held[1], rows.sum(axis=0).tolist())]


class Bucketed:
    """Tables that are written by buckets of column `block`, so that they can be joined on it without a shuffle."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets = spark, buckets

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"liaison_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", shared_path(self.spark, name)).saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # resolved: the name can go, the files stay
        self.spark.sql(f"DROP TABLE {table}")
        return out


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """`(id, label, code, error)` of every vector that is not null and has only finite components, and the codebooks.

    The codebooks begin with the vectors of the `entries` smallest ids (ties: by the vector; null ids last), fewer if there
    are fewer. Vectors shorter than the longest count as filled with zeros, as all do up to a multiple of `parts`. Repeated
    rows and ids count each. An error over 2^63 - 1 is given as that. An empty table gives no rows and empty codebooks.
    Columns that are not named are not read, whatever their names."""
    if entries >= NONE:
        raise ValueError("vector_codes: at most 254 entries, as a code is one byte")
    spark = vectors.sparkSession
    named = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("vec"), vectors[label_col].alias("label"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = named.where(F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    n, longest = kept.agg(F.count("*"), F.max(F.size("vec"))).first()
    width = -(-max(longest or 0, 1) // parts) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()  # so many vectors
    own = whole_numbers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width, scale).tolist() if first else []
    size = width // parts
    books = Codebooks([[v[p * size : (p + 1) * size] for v in own] for p in range(parts)])
    kinds = {c: vectors.schema[name].dataType.simpleString() for c, name in (("id", id_col), ("label", label_col))}

    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                ids, vecs, labels = b.slice(at, BLOCK).columns
                row = [[block], [len(ids)], [ids.to_pylist()], [labels.to_pylist()], [packed(whole_numbers(vecs.cast(pa.list_(pa.float64())), width, scale))]]
                types = [pa.int64(), pa.int32(), pa.list_(ids.type), pa.list_(labels.type), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["block", "n", "ids", "labels", "vecs"])
                block += 1

    tables = Bucketed(spark, int(min(max(n // BUCKET, spark.sparkContext.defaultParallelism), 50_000)))
    blocks = kept.select("id", "vec", "label").mapInArrow(pack, f"block long, n int, ids array<{kinds['id']}>, labels array<{kinds['label']}>, vecs binary")
    blocks = tables.write(blocks.repartition(tables.buckets, "block"), "blocks")

    def assign(entries_now):
        def run(batches):
            into, before = {}, None
            schema = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("changes", pa.list_(pa.struct([("p", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])))])
            for b in batches:
                for r in b.to_pylist():
                    if before is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*before, []), schema)], schema=schema)
                    x = unpacked(r["vecs"], width)
                    old = np.full((len(x), parts), NONE, np.uint8) if r["codes"] is None else np.frombuffer(r["codes"], np.uint8).reshape(-1, parts)
                    new = np.stack([nearest_entries(x[:, p * size : (p + 1) * size], book)[0] for p, book in enumerate(entries_now)], axis=1)
                    changes(x, old, new, parts, into)
                    before = (r["block"], new.tobytes())
            if before is not None:  # the task's sums go with its last block
                rows = [{"p": p, "e": e, "n": c, "sums": [str(s) for s in sums]} for (p, e), (c, sums) in into.items()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*before, rows), schema)], schema=schema)

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, x))) for x in zip(*pdf["sums"])]
        return pd.DataFrame({"p": pdf["p"].iloc[:1], "e": pdf["e"].iloc[:1], "n": [int(pdf["n"].sum())], "sums": [sums]})

    last = None
    for _ in range(rounds if first else 0):
        rows = blocks.select("block", "vecs")
        rows = rows.withColumn("codes", F.lit(None).cast("binary")) if last is None else rows.join(last.select("block", "codes"), "block")
        now = [[list(e) for e in book] for book in books.entries]
        last = tables.write(rows.mapInArrow(assign(now), "block long, codes binary, changes array<struct<p int, e int, n long, sums array<string>>>"), "codes")
        deltas = last.select(F.explode("changes").alias("c")).select("c.*")
        books.take(deltas.groupBy("p", "e").applyInPandas(add, "p int, e int, n long, sums array<string>").collect())  # at most parts * entries rows

    final = [[list(e) for e in book] for book in books.entries]

    def encode(batches):
        for b in batches:
            kinds = [b.schema.field(n).type.value_type for n in ("ids", "labels")]
            for r in b.to_pylist():
                x = unpacked(r["vecs"], width)
                found = [nearest_entries(x[:, p * size : (p + 1) * size], book) for p, book in enumerate(final)]
                codes = np.stack([c for c, _ in found], axis=1)
                errors = [min(sum(map(int, d)), 2**63 - 1) for d in zip(*(d.tolist() for _, d in found))]
                cols = [pa.array(r["ids"], kinds[0]), pa.array(r["labels"], kinds[1]), pa.array([bytes(c).hex() for c in codes]), pa.array(errors, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "label", "code", "error"])

    return blocks.select("ids", "labels", "vecs").mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with `label_error`, the error summed over the rows of equal label, nulls together; over 2^63 - 1 it is that."""
    codes = materialise(codes.withColumn("_key", F.coalesce(F.concat(F.lit("+"), F.col("label").cast("string")), F.lit(""))), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = materialise(codes.groupBy("_key").agg(total.alias("label_error"), F.count("*").alias("_n")), "label_errors")
    return looked_up(codes, sums, "_key", "_n", codes.count()).drop("_key")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = with_label_errors(codes)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same rows in SQL, all assignments made anew in each round, for vectors of one length that `parts` divides."""
    # sums of integers are HUGEINT, so floors of means are taken on whole numbers: // rounds to zero, so negative rests go down
    floor = "CAST((s // n) - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT)"
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS (SELECT r, unnest(range({parts})) AS p, v FROM kept)",
        f"piece AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM cut)",
        f"c0 AS (SELECT p, r - 1 AS e, x AS c FROM piece WHERE r <= {entries})",
    ]
    near = "(SELECT r, p, min((d, e)) AS best FROM (SELECT r, a.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM piece a JOIN {c} b ON a.p = b.p) GROUP BY r, p)"
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED {near.format(c=f'c{k}')}")
        steps.append(f"s{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, {floor} AS m FROM (SELECT a.p, best[2] AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k} a JOIN piece b ON a.r = b.r AND a.p = b.p, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL)) GROUP BY p, e)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(s.c, o.c) AS c FROM c{k} o LEFT JOIN s{k} s ON o.p = s.p AND o.e = s.e)")
    steps.append(f"final AS {near.format(c=f'c{rounds}')}")
    steps.append("coded AS (SELECT r, string_agg(lower(lpad(to_hex(best[2]), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM final GROUP BY r)")
    return f"""WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (r)"""
