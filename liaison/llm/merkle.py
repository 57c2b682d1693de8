"""A Merkle manifest of a table: one tree for each value of a column, one over those trees, and proofs for every row.

Nodes are hashed from runs of FANOUT consecutive nodes; a last run may be shorter, even one, and is not padded; a tree ends
where one node remains, so a lone leaf is its own tree. Rows are dealt by ranges of (tree, id) and packed into parts. A task
that walks a part knows the place of its first leaf, and keeps a stack with one unfinished run for each level: a full run
is hashed, recorded and carried up. Where a run's first nodes lie in an earlier part, or its last in a later one, its nodes
are given out as pieces, and the pieces of a run are merged level by level. Nothing of the size of the table is in one task
or the driver, which receives two names and a count for each range."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialise

FANOUT = 16
#: Leaves of a part, at most.
PART = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tagged(c: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:` and the value; so no two lists of values give one text."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(tagged(v) for v in values)), 256))


def tree_key(c: Column) -> Column:
    """A text that orders as the values do, null first and then bytewise, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit(""))


def run_hash(run: bytes) -> bytes:
    """The hash of a run of 32-byte digests, taken as lowercase hex text."""
    return hashlib.sha256(run.hex().encode()).digest()


def _fields(**kinds: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k) if isinstance(k, str) else k) for n, k in kinds.items()])


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def _parts(leaves: DataFrame) -> DataFrame:
    """Consecutive leaves of one tree in a row: `(range, tree, first, ends, last, offset, n, ids, leaves, now)`. `offset` counts
    the tree's leaves before it in its range of rows; `first`: it is the tree that the range begins with; `ends`: the range has
    no more of the tree; `last`: nor of any other."""
    kind = T.ArrayType(leaves.schema["id"].dataType)
    schema = _fields(range="int", tree="string", first="boolean", ends="boolean", last="boolean", offset="long", n="int", ids=kind, leaves="array<binary>", now="array<binary>")

    def run(batches):
        place, kinds, begun, tree, held, offset = TaskContext.get().partitionId(), {}, None, None, [], 0

        def part(ends, last):
            return _batch([(place, tree, tree == begun, ends, last, offset, len(held), *map(list, zip(*held)))], kinds)

        for b in batches:
            listed = {n + s: pa.list_(b.schema.field(n).type) for n, s in (("id", "s"), ("leaf", ""), ("now", ""))}
            kinds = {"range": pa.int32(), "tree": b.schema.field("tree").type, "first": pa.bool_(), "ends": pa.bool_(), "last": pa.bool_(), "offset": pa.int64(), "n": pa.int32(), "ids": listed["ids"], "leaves": listed["leaf"], "now": listed["now"]}
            for own, *row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("tree", "id", "leaf", "now"))):
                if own != tree or len(held) == PART:
                    if held:
                        yield part(own != tree, False)
                    begun = own if begun is None else begun
                    offset, tree, held = offset + len(held) if own == tree else 0, own, []
                held.append(row)
        if held:
            yield part(True, True)

    order = (F.col("tree").asc(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc())
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "id", "leaf", "now")
    return materialise(dealt.mapInArrow(run, schema), "parts")


def _places(parts: DataFrame) -> tuple[dict[int, int], set[int]]:
    """For each range of rows, how many leaves of its first tree lie before it; and the ranges whose last tree goes on."""
    rows = parts.groupBy("range").agg(F.min("tree").alias("a"), F.max(F.struct("tree", (F.col("offset") + F.col("n")).alias("n"))).alias("b"))
    before, more, tree, n, was = {}, set(), None, 0, None
    for place, first, (last, count) in sorted(map(tuple, rows.collect())):  # one row for each range
        before[place] = n if first == tree else 0
        if first == tree:
            more.add(was)
        tree, n, was = last, count + (before[place] if first == last else 0), place
    return before, more


class Peaks:
    """The stack of one part: the unfinished run of each level. `add` takes the leaves from place `start` of their tree on."""

    def __init__(self, start: int, fanout: int = FANOUT):
        self.fanout, self.at, self.levels, self.runs, self.pieces = fanout, start, [], [], []

    def add(self, digest: bytes, item: tuple) -> None:
        self._put(0, self.at, digest, item)
        self.at += 1

    def _put(self, level: int, at: int, digest: bytes, item: tuple | None) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((at, digest, item))
        if at % self.fanout == self.fanout - 1:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run of this level gets no more nodes: it is hashed and carried, or given out in pieces if it began earlier."""
        own, self.levels[level] = self.levels[level], []
        at, rest = divmod(own[0][0], self.fanout)
        if rest:
            self.pieces += ((level, *node) for node in own)
            return
        run = b"".join(digest for _, digest, _ in own)
        self.runs.append((level, at, run_hash(run), run, [item for *_, item in own]))
        self._put(level + 1, at, self.runs[-1][2], None)

    def finish(self, ended: bool) -> None:
        """After the part's last leaf. If the tree ends here its short runs are hashed, up to the level that has one node;
        else the unfinished runs are given out in pieces."""
        level, n = 0, self.at
        while level < len(self.levels) and not (ended and n == 1):
            if self.levels[level] and ended:
                self._close(level)
            else:
                self.pieces += ((level, *node) for node in self.levels[level])
            level, n = level + 1, -(-n // self.fanout)


@dataclass
class Forest:
    """`nodes`: `(tree, level, at, digest, run, ids, now)`, for every run its digests, and `digest` with its place at the next
    level; at level 0 with the leaves' ids and `now`. A lone leaf is a run of one whose digest is its own. `sizes`: `(tree, n)`."""

    nodes: DataFrame
    sizes: DataFrame
    levels: int
    fanout: int

    def tops(self) -> DataFrame:
        """`(tree, level, digest, n)`: the run that ends each tree."""
        rows = self.nodes.where("at = 0").select("tree", "level", "digest").join(self.sizes, "tree")
        return rows.where(F.col("n") <= F.pow(F.lit(float(self.fanout)), F.col("level") + 1))

    def paths(self, above: DataFrame) -> DataFrame:
        """The runs of leaves, `(tree, run, ids, now, lone, top, path)`. `path` has, from below up to the root, the place of the
        node and the whole run it stands in; `above(tree, path)` has what lies above each tree, `top` is the tree's digest."""
        tops, found = self.tops().join(above, "tree").select("tree", "level", F.col("digest").alias("top"), (F.col("n") == 1).alias("lone"), "path"), None
        for level in reversed(range(self.levels)):
            own = self.nodes.where(F.col("level") == level).select("tree", "at", "run", *(["ids", "now"] if level == 0 else []))
            here = own.where("at = 0").join(tops.where(F.col("level") == level).drop("level"), "tree")
            if found is not None:
                up = found.select("tree", F.col("at").alias("_up"), F.col("run").alias("_run"), "top", "path")
                step = F.struct((F.col("at") % self.fanout).cast("int").alias("pos"), F.col("_run").alias("run"))
                rest = own.withColumn("_up", F.floor(F.col("at") / self.fanout)).join(up, ["tree", "_up"])
                here = here.unionByName(rest.select(*own.columns, "top", F.lit(False).alias("lone"), F.concat(F.array(step), "path").alias("path")))
            found = materialise(here, "paths") if level else here  # else the plan holds the joins of all levels
        return found.drop("at") if found is not None else self.nodes.select("tree", "run", "ids", "now", F.lit(None).cast("boolean").alias("lone"), F.col("digest").alias("top"), F.lit(None).cast("array<struct<pos int, run binary>>").alias("path")).limit(0)


def forest(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """The trees of `(tree, id, leaf, now, row)`, whose leaves are in the order of id (null first), leaf and row."""
    parts = _parts(leaves)
    before, more = _places(parts)
    schema = _fields(tree="string", level="int", at="long", piece="boolean", digest="binary", run="binary", ids=parts.schema["ids"].dataType, now="array<binary>")

    def walk(batches):
        for b in batches:
            kind = {n: b.schema.field(n).type for n in b.schema.names}
            kinds = {"tree": kind["tree"], "level": pa.int32(), "at": pa.int64(), "piece": pa.bool_(), "digest": pa.binary(), "run": pa.binary(), "ids": kind["ids"], "now": kind["now"]}
            for r in b.to_pylist():
                start = r["offset"] + (before[r["range"]] if r["first"] else 0)
                ended = r["ends"] and not (r["last"] and r["range"] in more)
                peaks, items = Peaks(start, fanout), lambda own: map(list, zip(*own)) if own[0] else (None, None)
                if ended and start == 0 and r["n"] == 1:
                    peaks.runs = [(0, 0, r["leaves"][0], r["leaves"][0], [(r["ids"][0], r["now"][0])])]
                else:
                    for digest, item in zip(r["leaves"], zip(r["ids"], r["now"])):
                        peaks.add(digest, item)
                    peaks.finish(ended)
                rows = [(r["tree"], level, at, False, digest, run, *items(own)) for level, at, digest, run, own in peaks.runs]
                rows += [(r["tree"], level, at, True, digest, digest, *items([item])) for level, at, digest, item in peaks.pieces]
                yield _batch(rows, kinds)

    table = materialise(parts.mapInArrow(walk, schema), "nodes")
    sizes = materialise(parts.groupBy("tree").agg(F.sum("n").alias("n")), "sizes")
    most, levels = sizes.agg(F.max("n")).first()[0] or 0, 0
    while most and (levels == 0 or fanout**levels < most):
        levels += 1
    nodes, carried = table.where("not piece").drop("piece"), None
    for level in range(0 if table.where("piece").isEmpty() else levels):
        rows = table.where(F.col("piece") & (F.col("level") == level)).select("tree", "at", "digest", "ids", "now")
        rows = rows if carried is None else rows.unionByName(carried)
        run = F.array_sort(F.collect_list(F.struct("at", "digest", "ids", "now")))  # of a fanout at most
        rows = rows.groupBy("tree", F.floor(F.col("at") / fanout).alias("up")).agg(run.alias("run"))
        text = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        own = [F.flatten(F.col(f"run.{n}")).alias(n) for n in ("ids", "now")]
        merged = rows.select("tree", F.lit(level).alias("level"), F.col("up").alias("at"), F.unhex(F.sha2(text, 256)).alias("digest"), F.unhex(text).alias("run"), *own)
        merged = materialise(merged, "merged")
        nodes = nodes.unionByName(merged)
        first = merged.where("at = 0").join(sizes, "tree").where(F.col("n") > fanout ** (level + 1)).drop("n")
        carried = merged.where("at > 0").unionByName(first).select("tree", "at", "digest", *(F.lit(None).cast(schema[n].dataType).alias(n) for n in ("ids", "now")))
    return Forest(nodes, sizes, levels, fanout)


@dataclass
class Manifest:
    """`trees`, the forest of the rows by tree; `over`, the tree over their digests, whose leaf ids are the trees' keys; and
    the digest of all, None for an empty table."""

    trees: Forest
    over: Forest
    root: bytes | None

    def proofs(self, id_name: str = "doc_id") -> DataFrame:
        """A row for each leaf: id, leaf, subroot, root, the hash of its siblings up to the root, the root that folds from
        `now` (else the leaf) and those siblings, and whether that is the root."""
        spark, root, kind = self.trees.nodes.sparkSession, self.root, self.trees.nodes.schema["ids"].dataType.elementType
        nothing = F.array().cast("array<struct<pos int, run binary>>")
        top = self.over.paths(spark.createDataFrame([("", [])], "tree string, path array<struct<pos int, run binary>>"))
        own = F.when(F.col("lone"), nothing).otherwise(F.array(F.struct(F.col("pos"), F.col("run"))))
        above = top.select("run", "lone", "path", F.posexplode("ids").alias("pos", "key")).select(F.col("key").alias("tree"), F.concat(own, "path").alias("path"))
        above = materialise(above, "above")
        schema = _fields(**{id_name: kind}, leaf="string", subroot="string", root="string", proof_sha256="string", folded_root="string", verified="boolean")
        names = schema.names

        def fold(batches):
            sha = hashlib.sha256
            for b in batches:
                kinds = dict(zip(names, [b.schema.field("ids").type.value_type, *[pa.string()] * 5, pa.bool_()]))
                for r in b.to_pylist():
                    runs = [(s["pos"], s["run"].hex().encode()) for s in r["path"]]
                    sides = [(run[: 64 * pos], run[64 * pos + 64 :]) for pos, run in runs]
                    rest, run, rows = b"".join(x for side in sides for x in side), r["run"].hex().encode(), []
                    for k, (name, now) in enumerate(zip(r["ids"], r["now"])):
                        own = [] if r["lone"] else [(run[: 64 * k], run[64 * k + 64 :])]
                        leaf = run[64 * k : 64 * k + 64]
                        proof = sha(b"".join(x for side in own for x in side) + rest).hexdigest()
                        got = leaf.decode() if now is None else now.hex()
                        for left, right in own + sides:
                            got = sha(left + got.encode() + right).hexdigest()
                        rows.append((name, leaf.decode(), r["top"].hex(), root.hex(), proof, got, got == root.hex()))
                    yield _batch(rows, kinds)

        return self.trees.paths(above).select("run", "ids", "now", "lone", "top", "path").mapInArrow(fold, schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", now: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The Merkle trees of `docs`, a leaf for each row: the hash of its `fields`. `now`, a column of the same rows, is the leaf
    to hold against the trees where it is not null.

    A null field counts as `-`, so it differs from an empty text. Rows without a tree's name have a tree of their own; rows
    without id come first. Repeated rows are leaves each; rows of one id are ordered by leaf. A text of any length is hashed
    whole. An empty table has no nodes and no root. Columns that are not named are not read, whatever their names."""
    leaf = leaf_hash(*(docs[c] for c in fields))
    now = F.lit(None).cast("binary") if now is None else now
    rows = docs.select(tree_key(docs[tree_col]).alias("tree"), docs[id_col].alias("id"), leaf.alias("leaf"), now.alias("now"), F.monotonically_increasing_id().alias("row"))
    trees = forest(materialise(rows, "leaves"), fanout)
    tops = trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("now"), F.lit(0).alias("row"))
    over = forest(materialise(tops, "subroots"), fanout)
    top = over.tops().select("digest").first()
    return Manifest(trees, over, bytes(top[0]) if top else None)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Every row's leaf, proof and the root that folds from it; rows whose id's crc32 is a multiple of 5 are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = leaf_hash(*(F.translate(docs[c], UPPER, LOWER) if c == "text" else docs[c] for c in FIELDS))
    now = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, changed)
    return manifest(docs, now=now).proofs()


def oracle(levels: int = 8, over: int = 4, fanout: int = FANOUT) -> str:
    """The same rows in SQL, for trees of up to fanout ** levels leaves and fanout ** over trees."""
    tag = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(tag(text if c == "text" else c) for c in FIELDS) + ")"
    crc = """xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
        lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)))"""
    steps = [f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} END AS now FROM documents)",
             "a0 AS (SELECT source AS tree, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, doc_id, leaf, coalesce(now, leaf) AS now FROM d)"]

    def level(k: int, name: str, tree: str) -> list[str]:
        """Runs of the nodes of level k, and the nodes of level k + 1; a tree of one node stays as it is."""
        own = f"{name}{k}"
        return [
            f"{own}n AS (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {own})",
            f"{own}r AS (SELECT {tree} AS tree, ix // {fanout} AS up, list(h ORDER BY ix) AS run, n FROM {own}n GROUP BY ALL)",
            f"{name}{k + 1} AS (SELECT tree, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, up AS ix FROM {own}r)",
        ]

    for k in range(levels):
        steps += level(k, "a", "tree")
    steps.append(f"b0 AS (SELECT '' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS ix FROM a{levels})")
    for k in range(over):
        steps += level(k, "b", "tree")
    steps.append("w0 AS (SELECT a0.doc_id, a0.leaf, a0.tree AS source, a0.ix, b0.ix AS top_ix, b0.h AS subroot, a0.now AS folded, '' AS proof FROM a0 JOIN b0 ON a0.tree IS NOT DISTINCT FROM b0.source)")
    done = 0
    for name, count, place, tree in (("a", levels, "ix", "w.source"), ("b", over, "top_ix", "''")):
        for k in range(count):
            pos = f"w.{place} // {fanout**k} % {fanout}"
            left, right = f"array_to_string(r.run[1:{pos}], '')", f"array_to_string(r.run[{pos} + 2:], '')"
            steps.append(f"""w{done + 1} AS (SELECT w.* EXCLUDE (folded, proof), CASE WHEN r.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded, proof || {left} || {right} AS proof
                FROM w{done} w JOIN {name}{k}r r ON r.tree IS NOT DISTINCT FROM {tree} AND r.up = w.{place} // {fanout ** (k + 1)})""")
            done += 1
    return f"""WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT h FROM b{over}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
        folded = (SELECT h FROM b{over}) AS verified FROM w{done}"""
