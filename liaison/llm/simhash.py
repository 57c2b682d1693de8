"""SimHash near-duplicates: bit-sliced comparison within blocks that share half of the bits."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import materialise
from .common import column, looked_up, raw_text, table_batch, words_of

RADIUS = 2
#: A block of more members than this is divided by further bits.
LARGE = 4096


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half of the shingles' XXH64 have it; no words: 0."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    counts, n, join = np.zeros(64, np.int64), len(words) - width + 1, b" ".join
    for at in range(0, n, 1 << 16):
        part = words[at : min(n, at + (1 << 16)) + width - 1]
        h = np.array([digest(join(x), seed) for x in zip(*(part[i:] for i in range(width)))], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One `(id, fp)` per row of `docs`; fp is the fingerprint's bits as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in column(b, "_text").to_pylist()), np.uint64, b.num_rows)
            yield table_batch(schema, id=column(b, "id"), fp=pa.array(fps.view(np.int64)))

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return raw_text(named, "id").mapInArrow(run, "id long, fp long")


class Planes:
    """Fingerprints stored vertically: plane b holds bit b of 64 members in each word."""

    def __init__(self, fps: np.ndarray, block: int = 1 << 14):
        self.n, self.blocks = len(fps), []
        for at in range(0, self.n, block):
            part = fps[at : at + block]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
            packed = np.packbits(bits, axis=1, bitorder="little")
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
            self.blocks.append((at, len(part), np.ascontiguousarray(packed).view("<u8")))

    def near(self, fp: int, start: int = 0) -> np.ndarray:
        """Positions from `start` on of the members within RADIUS bits of `fp`.

        Carry-save counters of two bits and a sticky overflow take plane after plane; a block is given up once all its
        lanes exceed the radius."""
        found = []
        for at, n, planes in self.blocks:
            if at + n <= start:
                continue
            ones, twos, over = (np.zeros(planes.shape[1], np.uint64) for _ in range(3))
            for b in range(64):
                x = ~planes[b] if fp >> b & 1 else planes[b]
                carry = ones & x
                ones ^= x
                over |= twos & carry
                twos ^= carry
                if b % 8 == 7 and not (~(over | (ones & twos))).any():
                    break
            else:
                lanes = np.unpackbits((~(over | (ones & twos))).view(np.uint8), bitorder="little")[:n]
                hit = np.flatnonzero(lanes) + at
                found.append(hit[hit >= start])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of one block, as few as keep its linked members together."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= RADIUS else []
    planes, up, links = Planes(fps), list(range(len(fps))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, fp in enumerate(fps.tolist()):
        for j in planes.near(fp, i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                up[b] = a
                links.append((i, j))
    return links


def _blocks(fp: Column, first: int, width: int) -> Column:
    """Keys of the pairs of blocks: of four blocks of `width` bits, two bits can spoil two, so two are equal."""
    part = [F.shiftrightunsigned(fp, first + width * i).bitwiseAND((1 << width) - 1) for i in range(4)]
    return F.array(*(
        F.shiftleft(F.lit(k).cast("long"), 2 * width).bitwiseOR(F.shiftleft(part[i], width)).bitwiseOR(part[j])
        for k, (i, j) in enumerate(combinations(range(4), 2))
    ))


def _further(fp: Column, k1: Column) -> Column:
    """For a large block, keys from the bits that its own key leaves free: at most 2^16 distinct members share them."""
    case = None
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        a, b = (x for x in range(4) if x not in (i, j))
        free = F.shiftleft(F.shiftrightunsigned(fp, 16 * a).bitwiseAND(0xFFFF), 16).bitwiseOR(F.shiftrightunsigned(fp, 16 * b).bitwiseAND(0xFFFF))
        hit, keys = F.shiftrightunsigned(k1, 32) == k, _blocks(free, 0, 8)
        case = F.when(hit, keys) if case is None else case.when(hit, keys)
    return case


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """`(a, b)` between distinct fingerprints of column `fp`: enough of the pairs within RADIUS bits to connect all of them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys = fps.select("fp", F.explode(_blocks(F.col("fp"), 0, 16)).alias("k1"))
    heavy = keys.groupBy("k1").count().where(F.col("count") > large).select("k1", F.lit(True).alias("heavy"))
    keys = keys.join(heavy, "k1", "left").select(
        "fp", "k1", F.explode(F.when(F.col("heavy"), _further(F.col("fp"), F.col("k1"))).otherwise(F.array(F.lit(-1).cast("long")))).alias("k2")
    )

    def run(batches):
        held = (np.zeros(0, np.int64),) * 3
        for b in batches:
            k1, k2, fp = (np.concatenate([h, column(b, n).to_numpy()]) for h, n in zip(held, ("k1", "k2", "fp")))
            if not len(k1):
                continue
            cut = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield linked(np.concatenate([[0], cut]).astype(int), fp[:last])
            held = (k1[last:], k2[last:], fp[last:])
        if len(held[0]):
            yield linked(np.array([0, len(held[0])]), held[2])

    def linked(edges: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for s in np.flatnonzero(np.diff(edges) > 1).tolist():
            part = fp[edges[s] : edges[s + 1]]
            out += [(part[i], part[j]) for i, j in _forest(part.view(np.uint64))]
        return table_batch(schema, a=np.array([x for x, _ in out], np.int64), b=np.array([x for _, x in out], np.int64))

    dealt = keys.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """`(doc_id, fp, component_id)` for every row: the smallest id that can be reached over links of RADIUS bits or fewer.

    Null text counts as empty (fingerprint zero). Rows without an id get a row too; an id that is null is never the
    smallest. Repeated rows are kept. Copies share a fingerprint and are compared once; an empty table gives no rows. Long
    texts are hashed a part of their words at a time; other columns, whatever their names, are not read.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "classes")
    roots = connected_components(links(distinct), "a", "b")
    tree = materialise(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "low", "root"), "tree")
    lows = materialise(tree.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n")), "lows")
    moved = looked_up(tree, lows, "root", "n", tree.count()).select("fp", "component")
    classes = materialise(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id"), "n"), "classes")
    return looked_up(fps, classes, "fp", "n", fps.count()).select(F.col("id").alias("doc_id"), "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; rows without an id stay. An id that stands on several
    rows stays if one of them is its group's smallest."""
    found = near_duplicates(docs).where("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first")
    return docs.join(gone.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)
