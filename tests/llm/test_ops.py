"""Each operator against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from liaison.llm import decontamination, mixing, pii, pitman_yor, quality, sentence_dedup, simhash, token_output, toxicity, webp
from liaison.llm.common import looked_up, sum_arrays

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a tie, one long text, and columns whose names operators might use."""
    long = " ".join(f"word{i % 997} the." for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "A b c d e."), (3, "Same text here, the same."), (3, "Same text here, the same."), (4, "Same text here, the same."), (5, long), (6, " \t\n "), (7, "é ß 漢字 \x85")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for c in ("score", "id", "_text", "p", "n", "rate", "block", "fp", "label", "fold"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}


# --- SimHash ---


def naive_fingerprint(t: bytes) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t.decode()))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps: dict) -> dict:
    low = {i: i for i in fps}
    ids, changed = sorted(fps), True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if low[a] > low[b] and (fps[a] ^ fps[b]).bit_count() <= 2:
                    low[a], changed = low[b], True
    return low


def test_simhash_against_brute_force(docs):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: naive_fingerprint(t) for i, t in texts_of(docs).items()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in found.items()} == fps
    assert {i: r["component_id"] for i, r in found.items()} == classes(fps)


@pytest.mark.parametrize("large", [1, 4096])
def test_simhash_links_connect_all_near_pairs(spark, large):
    """Also when every block counts as large and is divided further."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(15)} | {0, 1})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(spark.createDataFrame(signed, "fp long"), large).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert {x: root(x) for x in fps} == classes({x: x for x in fps})


def test_bit_planes_find_what_popcount_finds():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    fps[1:400] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 399).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 399).astype(np.uint64))
    planes = simhash.Planes(fps, block=64)
    for i in (0, 3, 450):
        want = [j for j in range(i + 1, 500) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2]
        assert planes.near(int(fps[i]), i + 1).tolist() == want


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9 and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 6)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.stage(spark, odd, SF).collect()]
    assert sorted(x for x in kept if x) == [1, 3, 3, 5, 7] and None in kept


# --- tokens ---


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    packed = token_output.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_output.unpack(packed, bits, 1001) == ids).all()
    assert (token_output.unpack(packed, bits, 20, 333) == ids[333:353]).all()


ADVERSE = ["á ́b  c\x0bd<|endoftext|>e\xa0f <|startoftext|>", "ΑΣ ΣΑΣ İ it's\x1cx\x85y", "don't 12345 ½ 漢字 é\r\né ab!'s x.<|endoftext|> É×é÷ª ÀÉ!!", "", "  ", "a..b ...c d'll"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_equal_the_tokenizer(docs, name):
    ids = token_output.WordIds(token_output.vocabulary_path(name))
    texts = ADVERSE + [t.decode() for t in list(texts_of(docs).values())[:40]]
    for t, got in zip(texts, ids([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_output_against_brute_force(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 5000)
    tokenizer = token_output.WordIds(token_output.vocabulary_path()).tokenizer
    found, at = {r["doc_id"]: r for r in token_output.token_output(docs).collect()}, 0
    for i, t in sorted(texts_of(docs).items()):
        ids = tokenizer.encode(t.decode(), add_special_tokens=False).ids + [1]
        assert tuple(found[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = token_output.token_output(odd).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6, 7] and [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 6)] == [1, 1, 1]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert token_output.token_output(empty).count() == 0


# --- quality and toxicity ---


def held_out_accuracy(rows, labels, column):
    want = {r["doc_id"]: r[column] for r in labels.collect()}
    own = [(want[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in want]
    return np.mean([y == p for y, _, p in own])


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert held_out_accuracy(rows, labels, "quality") > 0.9


def test_quality_and_toxicity_odd_rows(spark, odd, empty, labels):
    for f in (quality.quality, toxicity.toxicity):
        rows = f(odd, labels).collect()
        assert len(rows) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        none = f(odd, labels.limit(0)).collect()
        assert len(none) == 9 and all(0 <= r["score"] <= 1 for r in none)
        assert f(empty, labels).count() == 0


def test_labels_outside_the_folds_do_not_matter(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r["doc_id"]: round(r["score"], 9) for r in quality.quality(docs, x).collect()}
    assert score(labels) == score(turned)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    at, n = np.arange(50.0), rng.integers(1, 9, 50).astype(float)
    x, y = quality.isotonic(at, rng.binomial(n.astype(int), np.linspace(0.1, 0.9, 50)).astype(float), n)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1


def test_subwords_carry_to_unseen_spellings():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randrange(3, 8)))
    texts, labels = [], []
    for k in range(300):
        words = [word() for _ in range(rng.randrange(20, 120))]
        if k % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["grumbelix", "grumbelok", "grumbelan"])
        texts.append(" ".join(words).encode())
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts, np.array(labels), 0.25)
    score = toxicity.Scorer(*model.margins(), model.level)
    clean = b" ".join(word().encode() for _ in range(60))
    assert score([clean + b" grumbelzz"])[0] > 0.3 > score([clean])[0]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"  # the smaller tables have 14 toxic texts in the fold
    docs, named = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, named).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(r["toxic"], rows[r["doc_id"]]) for r in named.where("toxic is not null").collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    toxic, clean = ([r["predicted"] for y, r in held if y == k] for k in (1, 0))
    assert np.mean([r["predicted"] == y for y, r in held]) > max(len(clean), len(toxic)) / len(held) and np.mean(toxic) > 0.5 > 0.1 > np.mean(clean)


def test_toxicity_learns_from_bounded_rows_outside_the_fold(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_ROWS", {1: 20, 0: 30})
    named = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = named.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (toxicity.sample(docs, x, 4, 2) for x in (named, flipped))
    assert one[0] == other[0] and one[1].tolist() == other[1].tolist() and one[2] == other[2]
    some = docs.select("doc_id", "text").where("doc_id = 1").limit(1)
    many = docs.select("doc_id", "text").union(some.crossJoin(spark.range(300)).select("doc_id", F.concat("text", F.col("id").cast("string")).alias("text")))
    texts, labels, _ = toxicity.sample(many, named.union(named), 4, 2)
    assert len(texts) <= 50 and labels.sum() <= 20 and all(len(t) <= toxicity.MAX_TEXT + 1000 for t in texts)


# --- Pitman-Yor ---


def test_pitman_yor_base_and_folds(docs, odd, empty):
    texts = {i: pitman_yor.words_of(t) + [b"\n"] for i, t in texts_of(docs).items()}
    train = {i: w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for own in train.values() for w in own)
    n, v = sum(c.values()), len(c)
    rows = pitman_yor.pitman_yor(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in train, len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert len(pitman_yor.pitman_yor(odd).collect()) == 9 and pitman_yor.pitman_yor(empty).count() == 0


def seat_one_by_one(pairs: dict, sweeps: int, d: float, d0: float, rng) -> tuple[float, float, dict]:
    """The model by moves of single customers, table by table: mean tables of contexts and of the parent, and mean shares of
    the words in the parent. `pairs` has the customers of each (context, word)."""
    words = sorted({w for _, w in pairs})
    tables = {k: [] for k in pairs}  # customers of each table; each has a table of the parent
    above = {w: [] for w in words}
    draw = lambda weights: min(int(np.searchsorted(np.cumsum(weights), rng.random() * sum(weights))), len(weights) - 1)

    def share(w):
        n, t = sum(sum(x) for x in above.values()), sum(map(len, above.values()))
        return (sum(above[w]) - d0 * len(above[w]) + (1 + d0 * t) / (len(words) + 1)) / (1 + n)

    def add(u, w):
        opened = sum(len(x) for (c, _), x in tables.items() if c == u)
        own = tables[u, w]
        at = draw([*(n - d for n in own), (1 + d * opened) * share(w)])
        if at < len(own):
            own[at] += 1
            return
        own.append(1)
        t = sum(map(len, above.values()))
        up = draw([*(n - d0 for n in above[w]), (1 + d0 * t) / (len(words) + 1)])
        if up < len(above[w]):
            above[w][up] += 1
        else:
            above[w].append(1)

    def leave(u, w):
        own = tables[u, w]
        at = draw(own)
        own[at] -= 1
        if not own[at]:
            own.pop(at)
            up = draw(above[w])
            above[w][up] -= 1
            if not above[w][up]:
                above[w].pop(up)

    for (u, w), n in pairs.items():
        for _ in range(n):
            add(u, w)
    seen, parent, shares = [], [], collections.Counter()
    for k in range(sweeps):
        for (u, w), n in pairs.items():
            for _ in range(n):
                leave(u, w)
                add(u, w)
        if k >= sweeps // 4:
            seen.append(sum(map(len, tables.values())))
            parent.append(sum(map(len, above.values())))
            shares.update({w: share(w) for w in words})
    return np.mean(seen), np.mean(parent), {w: shares[w] / len(seen) for w in words}


def test_blocked_draws_match_single_moves():
    rng, d, d0 = np.random.default_rng(3), 0.6, 0.4
    pairs = {(u, w): int(rng.integers(1, 9)) for u in range(6) for w in range(8) if rng.random() < 0.5}
    tables, parent, shares = seat_one_by_one(pairs, 1000, d, d0, rng)
    context, word = (np.array(x) for x in zip(*pairs))
    count = np.array(list(pairs.values()))
    now, seats, words = np.minimum(count, 1), np.ones(8, np.int64), len(set(word.tolist()))
    got = np.zeros(2)
    mean = np.zeros(8)
    for k in range(2500):
        customers = np.bincount(word, now, 8)
        law = pitman_yor.Law(words, customers.sum(), seats.sum(), d, d0)
        now = law.context_tables(pitman_yor.Seating(d, rng), count, now, np.bincount(context, now, 6)[context], customers[word], seats[word])
        customers = np.bincount(word, now, 8).astype(np.int64)
        law = pitman_yor.Law(words, customers.sum(), np.minimum(seats, customers).sum(), d, d0)
        seats = law.parent_seats(pitman_yor.Seating(d0, rng), customers, np.minimum(seats, customers))
        if k >= 500:
            got += now.sum(), seats.sum()
            mean += pitman_yor.Law(words, customers.sum(), seats.sum(), d, d0).share(customers, seats)
    assert np.allclose(got / 2000, (tables, parent), rtol=0.06), (got / 2000, tables, parent)
    assert all(abs(mean[w] / 2000 - x) < 0.02 for w, x in shares.items())


@pytest.mark.parametrize("others, first", [(1.0, 2.0), (300.0, 40.0), (5000.0, 900.0), (2.0, 0.01)])
def test_proposals_match_the_exact_law(others, first):
    """Above SMALL customers tables are proposed and accepted; the exact law of 400 customers is known from the same rule."""
    rng, c, total = np.random.default_rng(1), 400, 1000.0
    n = 3000
    args = np.full(n, c), np.ones(n, np.int64), np.full(n, others), np.full(n, first), total, 1
    seating, now = pitman_yor.Seating(0.6, rng, fresh=True), args[1]
    for _ in range(3):
        now = seating.draw(args[0], now, *args[2:])
        seating.fresh = False
    ways = np.zeros(1)  # logarithms
    for k in range(1, c):
        more = np.append(ways + np.log(k - 0.6 * np.arange(1, k + 1)), -np.inf)
        ways = np.logaddexp(more, np.append(-np.inf, ways))
    logs = ways + np.cumsum(np.log((others + 0.6 * np.arange(c)) * (first + np.arange(c)) / (total + np.arange(c))))
    law = np.exp(logs - logs.max())
    mean = (law * np.arange(1, c + 1)).sum() / law.sum()
    assert (now >= 1).all() and (now <= c).all() and abs(now.mean() - mean) < 0.05 * mean


def test_tables_of_two_customers():
    two = pitman_yor.Seating(0.5, np.random.default_rng(0)).draw(np.full(4000, 2), np.ones(4000), np.full(4000, 2.0), np.full(4000, 1.0), 1.0, 0)
    assert abs((two == 2).mean() - 2.5 / 3.0) < 0.03  # together 1 - d, apart others + d, each with one opening before


def test_rows_that_are_only_scored_change_no_score(spark):
    rng = random.Random(0)
    words = [f"w{k}" for k in range(40)]
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2][:60]
    held = [i for i in range(3000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=200))) for i in ids]
    some = list(zip(held, [f"w0 {w}" for w in words]))
    more = list(zip(held[100:], [f"{w} unknown{w}" for w in words]))
    got, every = ({r["doc_id"]: r["score"] for r in pitman_yor.pitman_yor(spark.createDataFrame(rows + x, "doc_id long, text string")).collect()} for x in (some, some + more))
    assert all(abs(every[i] - got[i]) < 1e-4 for i in got)


def test_a_context_s_law_sums_to_one():
    rng = np.random.default_rng(5)
    count, word, context = rng.integers(1, 30, 200), np.arange(200) % 50, np.arange(200) % 7
    tables = np.minimum(count, rng.integers(1, 4, 200))
    customers = np.bincount(word, tables, 50).astype(np.int64)
    seats = np.minimum(customers, rng.integers(1, 3, 50))
    law = pitman_yor.Law(50, customers.sum(), seats.sum(), 0.7, 0.5)
    share = np.append(law.share(customers, seats), law.base / law.total)
    assert abs(share.sum() - 1) < 1e-12
    total = 1 + np.bincount(context, count, 7)
    seen = np.bincount(context, count - 0.7 * tables, 7) + (1 + 0.7 * np.bincount(context, tables, 7)) * share.sum()
    assert np.allclose(seen / total, 1)


def test_scores_do_not_depend_on_the_split_into_files(spark, docs):
    own = docs.where("doc_id < 60")
    one, many = ({r["doc_id"]: r["score"] for r in pitman_yor.pitman_yor(own.repartition(n)).collect()} for n in (1, 23))
    assert one == pytest.approx(many, abs=2e-5)


def test_words_are_contexts_of_their_own(spark):
    a, b = "c1", "c2"
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000, 4000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, f"{a} left" if k % 2 else f"{b} right") for k, i in enumerate(ids)]
    probes = dict(zip(held, (f"{a} left", f"{a} right", f"{b} right", f"{b} left")))
    got = {r["doc_id"]: r["score"] for r in pitman_yor.pitman_yor(spark.createDataFrame([*rows, *probes.items()], "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1 and got[held[2]] > got[held[3]] + 1


# --- WebP ---


def images():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (1, 7), (5, 3), (40, 64)):
        for k in (1, 2, 5, 16, 17, 250):
            yield (rng.integers(0, 256, k, dtype=np.uint32) * 0x010101 | 0xFF000000)[rng.integers(0, k, (h, w))]
        yield rng.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)


@pytest.mark.parametrize("tools", [{}, {"cache_bits": 5}, {"cache_bits": 10, "repeats": True}, {"repeats": True}, *({"predictor": p} for p in range(14)), {"cross": (20, 200, 77)}, {"predictor": 2, "cross": (1, 2, 250), "subtract_green": True, "cache_bits": 3}])
def test_webp_round_trip(tools):
    for image in images():
        assert (webp.decode(webp.encode(image, **tools)) == image).all()


def test_webp_palette_and_back_references():
    for image in images():
        if len(np.unique(image)) <= 256:
            assert (webp.decode(webp.encode(image, palette=True, repeats=True)) == image).all()
    rng = np.random.default_rng(3)
    tile = np.tile((rng.integers(0, 255, 50, dtype=np.uint32) * 0x010101 | 0xFF000000), 40).reshape(20, 100)
    for tools in ({}, {"cache_bits": 8}, {"palette": True}):
        data = webp.encode(tile, repeats=True, **tools)
        assert len(data) < 300 and (webp.decode(data) == tile).all()


def test_webp_pixels_in_turn_equal_pixels_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    tile = np.tile((rng.integers(0, 255, 30, dtype=np.uint32) * 0x010101 | 0xFF000000), 60).reshape(30, 60)
    data = [webp.encode(tile, repeats=True, cache_bits=b) for b in (0, 6)] + [webp.encode(tile, predictor=11, cross=(9, 8, 7))]
    monkeypatch.setattr(webp, "_pixels_at_once", lambda bits, w, h, cache, codes: webp._pixels_in_turn(bits, w, h, cache, [codes], None, 0))
    assert all((webp.decode(x) == tile).all() for x in data)


def test_webp_rejects_what_is_cut_or_foreign():
    data = webp.encode(next(images()).repeat(64).reshape(8, 8))
    for bad in (b"", b"RIFF", data[:-4], b"GIF89a" + data):
        with pytest.raises(webp.Corrupt):
            webp.decode(bad)


def test_media_columns(docs, odd, empty):
    for r in webp.media_columns(odd.unionByName(docs, allowMissingColumns=True)).join(odd.unionByName(docs, allowMissingColumns=True).select(F.col("doc_id").alias("d"), "text"), F.expr("doc_id <=> d")).where("doc_id not in (1, 2, 3, 4, 5, 6, 7)").limit(60).collect():
        text = (r["text"] or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and webp.load(bytes(r["media"]))[: len(payload)] == payload
    rows = webp.media_columns(odd).collect()
    assert len(rows) == 9 and len({r["feature"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert webp.media_columns(empty).count() == 0


def test_payloads_of_over_a_megabyte():
    payload = bytes(random.Random(0).choices(range(97, 123), k=64 * 16384 + 64))
    assert webp.load(webp.store(payload)) == payload


def test_smooth_payloads_are_predicted():
    smooth = bytes((np.cumsum(np.random.default_rng(0).integers(0, 3, 6400)) & 255).astype(np.uint8))
    assert webp.load(webp.store(smooth)) == smooth and len(webp.store(smooth)) < 0.5 * len(smooth)


# --- sentence spans ---


def test_sentences_cover_the_text(docs):
    for t in texts_of(docs).values():
        parts = sentence_dedup.sentences(t)
        assert [w for _, _, own in parts for w in own] == sentence_dedup.words_of(t)


def test_sentence_spans_against_brute_force(spark, docs, odd, empty):
    passage = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. Last words of the passage are these ones here."
    more = spark.createDataFrame([(9001, f"Intro of it.\n{passage}\nTail."), (9002, f"{passage} Other end of the text."), (9003, "Short. Short. Short.")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    found = {r["doc_id"]: list(r["removed"]) for r in sentence_dedup.repeated_sentences(both).collect()}
    first, want, parts = {}, {}, {i: [w for *_, w in sentence_dedup.sentences(t)] for i, t in sorted(texts_of(both).items())}

    def every_run(p):
        for a in range(len(p)):
            for z in range(a + 2, min(a + 30, len(p)) + 1):
                key = tuple(w for x in p[a:z] for w in x)
                if len(key) >= 20:
                    yield a, z, tuple(map(tuple, p[a:z]))

    for i, p in parts.items():
        for a, _, key in every_run(p):
            first.setdefault(key, (i, a))
    for i, p in parts.items():
        gone = sorted({s for a, z, key in every_run(p) if first[key] != (i, a) for s in range(a, z)})
        if gone:
            want[i] = gone
    assert found == want and found[9002][:3] == [0, 1, 2] and 9001 not in found and 9003 not in found
    assert sentence_dedup.repeated_sentences(odd).count() <= 2 and sentence_dedup.repeated_sentences(empty).count() == 0


def test_every_sentence_of_a_repeated_run_goes(spark):
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "." for n in (19, 10, 3)]
    rows = [(1, "A lead. " + " ".join(lines) + " One end."), (2, "Quite another start here. " + " ".join(lines) + " Another tail.")]
    got = sentence_dedup.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], list(r["removed"])) for r in got] == [(2, [1, 2, 3])]


def test_unpunctuated_passages_are_found_at_any_offset(spark):
    rng = random.Random(9)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [word(n) for n in (60, 80, 120, 200) for _ in range(20)]
    rows = [(i, f"{word(rng.randrange(90))} {p} {word(rng.randrange(90))}") for i, p in enumerate(passages)]
    rows += [(1000 + i, f"{word(rng.randrange(90))} {p} {word(rng.randrange(90))}") for i, p in enumerate(passages)]
    left = {r["doc_id"]: r["text"] for r in sentence_dedup.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = [1 - len(set(left.get(1000 + i, p).split()) & set(p.split())) / len(p.split()) for i, p in enumerate(passages)]
    assert np.mean([g > 0.5 for g in gone]) >= 0.95 and min(gone[40:]) > 0.4 and min(left) >= 1000


def test_hot_keys_are_looked_up_in_a_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = looked_up(rows, table, "k", "n", 5000)
    assert got.count() == 5000 and got.where("v <> 2 * k").count() == 0


# --- decontamination ---


def test_pruned_search_equals_plain_scores(spark, docs):
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    terms = [decontamination.terms_of(t) for _, t in items]
    df = collections.Counter(w for own in terms for w in set(own))
    mean = sum(map(len, terms)) / len(terms)
    index = decontamination.Index(items, df, len(items), mean)
    texts = list(texts_of(docs).values())[:80]
    found = {(d, w, k): s for d, w, k, s in index.search(texts)}

    def impacts(own):
        c = collections.Counter(own)
        return {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, f in c.items()}

    scores, want, half = [impacts(t) for t in terms], {}, decontamination.WINDOW // 2
    for d, t in enumerate(texts):
        words = decontamination.words_of(t)
        for w in range(max(-(-len(words) // half) - 1, 1)):
            own = {decontamination.terms_of(x)[0] for x in words[w * half : (w + 2) * half] if decontamination.terms_of(x)}
            for k, s in enumerate(scores):
                share = sum(v for x, v in s.items() if x in own) / sum(s.values())
                if share >= decontamination.THRESHOLD + 1e-6:
                    want[d, w, k] = share
    assert set(want) <= set(found) and all(abs(found[k] - v) < 1e-4 for k, v in want.items())
    assert all(v > decontamination.THRESHOLD - 1e-4 for v in found.values())


def test_contamination_finds_planted_items(spark, docs, odd, empty, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join(t.lower().split())
    items = {r["item_id"]: flat(r["text"]) for r in bench.collect()}
    texts = {i: flat(t.decode()) for i, t in texts_of(docs).items()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench).collect()} == want and want
    monkeypatch.setattr(decontamination, "INDEX_ITEMS", 15)  # several indexes
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench).collect()} == want
    strange = bench.select("item_id", "text").union(spark.createDataFrame([(None, "x y z"), (900, None), (901, "")], "item_id long, text string"))
    assert decontamination.contamination(odd, strange).count() == 0 == decontamination.contamination(empty, bench).count()
    assert decontamination.contamination(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 65, 100, 150, 213, 250, 1000])
def test_copies_of_long_items_are_found_at_every_offset(size):
    rng = random.Random(size)
    words = [f"w{rng.randrange(4 * size)}" for _ in range(size)]
    words[size * 2 // 3] += "?"
    filler = [f"f{rng.randrange(500)}" for _ in range(3 * size + 400)]
    items = [(7, " ".join(words).encode()), (8, " ".join(f"x{i}" for i in range(30)).encode())]
    df = collections.Counter(w for _, t in items for w in set(decontamination.terms_of(t)))
    index = decontamination.Index(items, df, 2, (size + 30) / 2)
    copies = [" ".join([*filler[:n], *words, *filler[n:]]).encode() for n in range(64)]
    ends = [" ".join([*filler[:n], *words]).encode() for n in range(64)]
    found = index.confirmed([*copies, *ends])
    assert [(d, k) for d, k, *_ in found] == [(d, 7) for d in range(128)]
    assert all(abs(score - 1) < 1e-4 and q == a == 1 for _, _, score, q, a in found)
    half, mixed = words[: size // 2], rng.sample(words, size)
    apart = [*words[: size * 2 // 3], *filler, *filler, *words[size * 2 // 3 :]]
    assert not index.confirmed([" ".join([*filler, *x, *filler]).encode() for x in (half, mixed, apart)])


@pytest.mark.parametrize("before, after", [("", ""), ('"', '"'), ('["', '",'), ("[", "]"), ("(", ")"), ("", "..."), ("'", "'?!"), ("**", "**"), ("`", "`;"), ("{", "}"), ("<", ">")])
def test_items_whose_words_bear_signs_are_found(before, after):
    """However each word is quoted, bracketed or ended, in the passage or in the item, short items and long ones."""
    rng = random.Random(3)
    short, long = ([f"w{rng.randrange(300)}" for _ in range(n)] for n in (40, 150))
    short[25] += "?"
    other = " ".join(f"x{i}" for i in range(30)).encode()
    signed = lambda words: " ".join(before + w + after for w in words)
    filler = " ".join(f"f{rng.randrange(500)}" for _ in range(200))
    for words in (short, long):
        for item, copy in ((" ".join(words), signed(words)), (signed(words), " ".join(words))):
            items = [(7, item.encode()), (8, other)]
            df = collections.Counter(w for _, t in items for w in set(decontamination.terms_of(t)))
            index = decontamination.Index(items, df, 2, (len(words) + 30) / 2)
            found = index.confirmed([f"{filler} {copy} {filler}".encode(), filler.encode()])
            assert [(d, k) for d, k, *_ in found] == [(0, 7)]
            assert found[0][2] > 0.99 and found[0][3] > 0.9


# --- mixing ---


def test_mixing_meets_its_targets(spark, docs, odd, empty, labels):
    named = spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.mixing(docs, named, mixing.TARGETS).collect()
    total = {k: sum(r["membership"][k] * r["rate"] * r["n_tokens"] for r in rows) for k in mixing.TARGETS}
    assert all(abs(v / sum(total.values()) - mixing.TARGETS[k]) < 1e-3 for k, v in total.items())
    assert all(r["rate"] >= 0 and abs(sum(r["membership"].values()) - 1) < 1e-9 for r in rows)
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([max(r["membership"], key=r["membership"].get) == langs[r["doc_id"]] for r in rows]) > 0.95
    assert len(mixing.mixing(odd, labels, mixing.TARGETS).collect()) == 9 and mixing.mixing(empty, labels, mixing.TARGETS).count() == 0


# --- personal data ---


def test_permutations_are_permutations(spark):
    numbers = [r[0] for r in spark.range(17 * 43).select(pii.permuted_number(F.col("id"), 17, 43, "k", "t")).collect()]
    assert sorted(numbers) == list(range(17 * 43)) and numbers != sorted(numbers)
    words = [r[0] for r in spark.range(1000).select(pii.permuted_string(F.lpad(F.col("id").cast("string"), 3, "0"), "0123456789", "k", "t")).collect()]
    assert sorted(words) == [f"{i:03d}" for i in range(1000)]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    text = "Mail und.34@mail7.example.com or +1 (017) 555-7713, 555-123-4567; born 1987-02-28, 03/12/2001; 123-45-6789; 97.51.17.173; 4111 1111 1111 1111 / 4111111111111111 but 4111111111111112."
    rows = spark.createDataFrame([(1, text), (2, "again 1987-02-28 and 4111-1111-1111-1111"), (3, None), (4, ""), (None, "1987-02-30 999.1.1.1 000-11-2222")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.pseudonymise(rows, "k").collect()}
    one = found[1]["text"]
    assert tuple(found[1])[1:7] == (1, 2, 1, 1, 2, 2)
    shape = lambda t: re.sub(r"[a-z]", "x", re.sub(r"\d", "0", t))
    assert len(one) >= len(text) - 8 and "4111111111111112" in one and "@mail7.example.com" in one and "1987-02-28" not in one
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", one)[0]
    assert luhn(card) and card.replace(" ", "") in one and card.replace(" ", "-") in found[2]["text"]
    assert re.search(r"(\d{4}-\d{2}-\d{2})", one)[0] in found[2]["text"] and shape("555-123-4567") in shape(one)
    assert found[3]["text"] is None and found[4]["text"] == "" and found[None]["text"] == "1987-02-30 999.1.1.1 000-11-2222"
    assert pii.pseudonymise(rows, "other key").where("doc_id = 2").first()["text"] != found[2]["text"]
    assert not [n for n in pii.pseudonymise(rows, "k")._jdf.queryExecution().executedPlan().toString().split() if "Python" in n or "Arrow" in n]


def test_pseudonyms_leave_other_text_alone(docs, odd, empty):
    before, after = texts_of(docs), {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    for i, r in after.items():
        if not sum(tuple(r)[1:7]):
            assert r["text"].encode() == before[i]
    assert pii.pseudonymise(odd, "k").count() == 9 and pii.pseudonymise(empty, "k").count() == 0


# --- pipeline and sums ---


def test_sum_arrays(spark):
    rows = spark.createDataFrame([(k % 3, np.full(4, float(k)).tobytes()) for k in range(30)], "k int, packed binary").repartition(7)
    got = {r["k"]: np.frombuffer(r["packed"]).tolist() for r in sum_arrays(rows, ["k"], fan=3).collect()}
    assert got == {k: [float(sum(range(k, 30, 3)))] * 4 for k in range(3)}


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), None
    quality_of = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, d), "test")
        kept.append((name, before, docs))
        names = docs.columns
        if name != "token ids":
            assert names == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda x: sorted(r["doc_id"] for r in x.select("doc_id").collect())
    assert ids(kept[0][2]) == sorted(i for i, p in quality_of.items() if p)
    low = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(kept[1][1]).collect()}
    assert ids(kept[1][2]) == sorted(i for i, c in low.items() if i == c)
    held = {r["doc_id"] for r in decontamination.contamination(kept[2][1], spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert ids(kept[2][2]) == sorted(set(ids(kept[2][1])) - held)
    assert set(ids(kept[3][2])) == set(ids(kept[3][1])) and ids(kept[4][2]) == ids(kept[3][2])


def test_stages_with_odd_rows(spark, odd, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is it? it is a thing of the past and more")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = odd
    for name in ("_score", "__rate", "clean", "COPY", "_bytes", "__text_bytes", "hash", "row", "words", "k"):
        rows = rows.withColumn(name, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialise(stage(spark, rows, str(tmp_path)), "odd")
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage_joins_no_texts(spark, tmp_path, monkeypatch):
    """What is joined with the labels are statistics, so texts are not shuffled, and learning takes all labelled rows."""
    from liaison.llm import quality

    docs = spark.createDataFrame([(i, "good words in a plain sentence. " * (3 + i % 4) if i % 2 else "zzz zzz " * (2 + i % 5)) for i in range(60)], "doc_id long, text string")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, of = [], quality.statistics_of
    monkeypatch.setattr(quality, "statistics_of", lambda rows, *a: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or of(rows, *a))
    kept = {r["doc_id"] for r in quality.stage(spark, docs, str(tmp_path)).collect()}
    assert len(seen) == 1 and "Join" not in seen[0] and kept == set(range(1, 60, 2))
