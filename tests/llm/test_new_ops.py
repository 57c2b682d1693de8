"""Manifests, byte-level BPE and vector codes against plain versions, SQL and the library, and on odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from liaison.llm import byte_bpe, merkle, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(df):
    pdf = df.toPandas() if hasattr(df, "toPandas") else df
    pdf = pdf[sorted(pdf)]
    return sorted(map(tuple, pdf.astype(object).where(pdf.notna(), None).values.tolist()), key=repr)


def odd_documents(spark, n=700):
    """A hot source, single ones, a null and an empty one, null ids and texts, repeated rows, a long text, clashing names."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "ß", "Z", None, ""]), "en", 3, rng.choice(["Some Text", None, "", "é漢字", f"t{i}"])) for i in range(n)]
    rows += [(10_000, "alone", None, None, None), (None, "a", "en", 1, "no id"), (None, None, None, None, None), (5, "a", "en", 3, "twice"), (5, "a", "en", 3, "twice"), (10_001, "b", "en", 1, "Long " * 400_000)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "leaf", "now", "row", "id", "run", "ids", "n_tokens", "_bytes", "label", "vec"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- manifest ---


def plain_manifest(rows, fanout):
    """Every level of every tree as lists; (id, leaf, proof, folded, root) for each row."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tag = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, low=False: h("".join(tag(r[c].translate({x: x + 32 for x in range(65, 91)}) if low and c == "text" and r[c] is not None else r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
            yield run[: at % fanout], run[at % fanout + 1 :]
            at //= fanout

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in names}
    over, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            steps = [*way(trees[s], at), *way(over, k)]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            got = leaf(r, changed)
            for left, right in steps:
                got = h("".join(left) + got + "".join(right))
            out.append((r["doc_id"], got, leaf(r), h("".join(x for side in steps for part in side for x in part)), over[-1][0], trees[s][-1][0], got == over[-1][0]))
    return sorted(out, key=repr)


def tampered(docs):
    changed = merkle.leaf_hash(*(F.translate(docs[c], merkle.UPPER, merkle.LOWER) if c == "text" else docs[c] for c in merkle.FIELDS))
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, changed)


@pytest.fixture
def many_ranges(spark):
    """Small shuffles are not put together, so a tree lies over several ranges of rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("fanout, part", [(16, 1 << 16), (2, 3)])
def test_manifest_against_plain_lists(spark, monkeypatch, many_ranges, fanout, part):
    """Also when parts are short, so that runs lie over parts and ranges at every level."""
    monkeypatch.setattr(merkle, "PART", part)
    docs = odd_documents(spark)
    found = merkle.manifest(docs, now=tampered(docs), fanout=fanout).proofs()
    assert rows_of(found) == plain_manifest(docs.collect(), fanout)


def test_manifest_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert rows_of(merkle.op11_merkle(spark, SF)) == rows_of(con.execute(merkle.oracle()).df())


@pytest.mark.parametrize("n", [0, 1, 257])
def test_manifest_of_so_many_rows(spark, n):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"T{i}") for i in range(n)], DOCS)
    m = merkle.manifest(docs, now=tampered(docs))
    assert rows_of(m.proofs()) == plain_manifest(docs.collect(), 16)
    assert (m.root is None) == (n == 0)


@pytest.mark.parametrize("cuts", [[40], [1, 2, 3, 39], [16, 32], [5, 21, 22, 37]])
def test_peaks_and_pieces_make_whole_runs(cuts):
    """Whatever the parts, each run is whole in one of them or its nodes are pieces."""
    leaves, fanout, n = [hashlib.sha256(bytes([i])).digest() for i in range(40)], 4, 40
    runs, pieces, start = {}, {}, 0
    for end in [*cuts, n] if cuts[-1] < n else cuts:
        peaks = merkle.Peaks(start, fanout)
        for x in leaves[start:end]:
            peaks.add(x, (None, None))
        peaks.finish(end == n)
        runs |= {(level, at): run for level, at, _, run, _ in peaks.runs}
        pieces |= {(level, at): digest for level, at, digest, _ in peaks.pieces}
        start = end
    nodes = leaves
    for level in range(3):
        whole = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for at, run in enumerate(whole):
            for k, digest in enumerate(run):  # each node has its run, or is a piece, or comes from a run in pieces
                assert (level, at) in runs or pieces.get((level, at * fanout + k), digest) == digest
            assert runs.get((level, at), b"".join(run)) == b"".join(run)
        nodes = [merkle.run_hash(b"".join(run)) for run in whole]


def test_no_task_of_a_manifest_gets_a_whole_tree(spark, monkeypatch, many_ranges):
    """All rows are of one source: ranges share them, and a part has PART leaves at most."""
    monkeypatch.setattr(merkle, "PART", 700)
    rows = spark.range(5000).select(F.lit("").alias("tree"), "id", merkle.leaf_hash(F.col("id")).alias("leaf"), F.lit(None).cast("binary").alias("now"), F.lit(0).alias("row"))
    parts = merkle._parts(rows).collect()
    assert sum(r["n"] for r in parts) == 5000 and max(r["n"] for r in parts) <= 700
    assert len({r["range"] for r in parts}) > 1
    before, more = merkle._places(merkle._parts(rows))
    assert len(more) == len(before) - 1 and min(before.values()) == 0


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def codec():
    return byte_bpe._starter(None, None)()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(byte_bpe.vocabulary_path()), special_tokens={})


def ids_of(codec, text):
    return [i for ids in codec.encode(text.encode()) for i in ids]


def test_ids_equal_the_library(codec, library, monkeypatch):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert ids_of(codec, every) == library.encode_ordinary(every)
    rng = random.Random(3)
    pool = "ab's 't're\n\t  é漢字12３　 .,!?'՘\U0001f600-_\r"
    monkeypatch.setattr(byte_bpe, "STRETCH", 40)  # long texts are split in stretches
    for _ in range(3000):
        s = "".join(rng.choice(pool if rng.random() < 0.9 else every) for _ in range(rng.randint(0, 200)))
        ids = ids_of(codec, s)
        assert ids == library.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()


def test_tokens_and_their_neighbours(codec, library):
    for token in list(codec.ranks)[::7]:
        s = token.decode("utf-8", "replace")
        for text in (s, s + s, " " + s, s + "x"):
            assert ids_of(codec, text) == library.encode_ordinary(text)


def test_a_text_of_one_match(codec, library):
    s = "x" * 200_000 + "漢" * 100_000 + " " * 50_000
    assert ids_of(codec, s) == library.encode_ordinary(s)


def test_the_model_is_serialised_from_the_ranks():
    """Also with ranks left free: they are pieces that no text has."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 260, b"abc": 258, b"bc": 259}
    model = SentencePieceProcessor(model_proto=byte_bpe.model_of(ranks))
    assert model.vocab_size() == 262 and model.unk_id() == 261
    own = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcab", "xabcbc", "▁ a b", "aabbcc"):
        assert model.encode(byte_bpe.characters(text.encode())) == own.encode_ordinary(text)


def test_bpe_columns(spark, library):
    docs = odd_documents(spark, 60)
    rows = byte_bpe.round_trip(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:  # the name n_tokens is taken
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        assert r["_n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    both = byte_bpe.decoded(byte_bpe.encoded(docs.drop("ids"))).select("text", "ids", "decoded").collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == library.encode_ordinary(r["text"] or "") for r in both)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="negative"):
        byte_bpe.decoded(spark.createDataFrame([([-1],)], "ids array<int>")).collect()


def test_op12(spark, library):
    rows = byte_bpe.op12_byte_bpe(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in rows.collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


# --- vector codes ---


def plain_codes(rows, parts, entries, rounds, scale=4096):
    """(id, label, code, error) and the books, with Python's integers and all assignments made anew."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in good), default=1) // parts) * parts or parts
    size = width // parts
    whole = [([int(x * scale // 1) for x in r[1]] + [0] * width)[:width] for r in good]
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))[:entries]
    books = [[whole[k][p * size : (p + 1) * size] for k in order] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds if good else 0):
        found = [[near(v, p)[1] for p in range(parts)] for v in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * size : (p + 1) * size] for v, f in zip(whole, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for r, v in zip(good, whole):
        best = [near(v, p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in best), min(sum(d for d, _ in best), 2**63 - 1)))
    return sorted(out, key=repr), books


@pytest.mark.parametrize("block", [1024, 3])
def test_codes_against_plain_integers(spark, monkeypatch, block):
    """Null and non-finite components, ties, repeated rows and ids, short vectors, huge components."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(10)], rng.choice([0, 1, None])) for i in range(80)]
    rows += [(3, [0.5] * 10, 1), (3, [0.5] * 10, 1), (None, [0.25] * 10, 2), (90, None, 1), (91, [None] + [0.0] * 9, 1), (92, [float("nan")] * 10, 1), (93, [float("inf")] * 10, 0), (94, [1.0, 2.0], 0), (95, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("clash")).withColumn("id", F.lit(1))
    codes, books = vector_codes.vector_codes(df.repartition(5), parts=4, entries=6, rounds=4)
    want, plain = plain_codes(rows, 4, 6, 4)
    assert books.entries == plain
    assert sorted(map(tuple, codes.collect()), key=repr) == want
    huge = [*rows, (1, [1e30, -1e300] + [0.0] * 8, 7), (200, [2e15] * 10, 7)]
    codes, books = vector_codes.vector_codes(spark.createDataFrame(huge, df.select("vec_id", "embedding", "label").schema), parts=4, entries=6, rounds=2)
    want, plain = plain_codes(huge, 4, 6, 2)
    assert books.entries == plain
    assert sorted(map(tuple, codes.collect()), key=repr) == want
    codes, _ = vector_codes.vector_codes(spark.createDataFrame(huge, df.select("vec_id", "embedding", "label").schema), parts=4, entries=1, rounds=0)
    assert sorted(map(tuple, codes.collect()), key=repr) == plain_codes(huge, 4, 1, 0)[0]
    assert vector_codes.with_label_errors(codes).where("label = 7").first()["label_error"] == 2**63 - 1


def test_codes_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert rows_of(vector_codes.op13_vector_codes(spark, SF)) == rows_of(con.execute(vector_codes.oracle()).df())


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    codes, books = vector_codes.vector_codes(spark.createDataFrame([(2, [1.0] * 8, 0), (1, [0.0] * 8, 0)], kind))
    assert sorted(r["code"] for r in codes.collect()) == ["00" * 8, "01" * 8] and len(books.entries[0]) == 2
    codes, books = vector_codes.vector_codes(spark.createDataFrame([], kind))
    assert codes.count() == 0 and vector_codes.with_label_errors(codes).count() == 0
    assert books.digest() == hashlib.sha256(b"").hexdigest()


def test_only_changes_are_summed():
    """A part that stays gives nothing; one that moves gives to one entry and takes from another."""
    x = np.arange(12, dtype=np.int64).reshape(3, 4)
    old, new, into = np.array([[0, 1], [2, 2], [1, 0]], np.uint8), np.array([[0, 1], [3, 2], [1, 0]], np.uint8), {}
    vector_codes.changes(x, old, new, 2, into)
    assert into == {(0, 3): [1, [4, 5]], (0, 2): [-1, [-4, -5]]}


def test_rounds_join_buckets_without_a_shuffle(spark):
    tables = vector_codes.Bucketed(spark, 4)
    a = tables.write(spark.range(100).select(F.col("id").alias("block"), F.lit(1).alias("x")), "a")
    b = tables.write(spark.range(100).select(F.col("id").alias("block"), F.lit(2).alias("y")), "b")
    both = a.join(b.hint("merge"), "block")
    assert both.count() == 100
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
