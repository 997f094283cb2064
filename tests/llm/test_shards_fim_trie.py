"""Operators 11 to 13 against brute-force versions, laws and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("postmill.llm")
from postmill.llm import fim, sharding, trie

# ---------------------------------------------------------------- sharding


def check_law(rows, texts, shards, slack):
    """Sizes, checksums and gapless slots; shards' bytes within ``slack``."""
    assert len(rows) == len(texts)
    made = sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows)
    raw = [(i if i is not None else -1, (t or "").encode()) for i, t in texts]
    assert made == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s, members in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in members) == list(range(len(members)))
        assert all(r.law == "bytes" and r.grown_shard is None for r in members)
    total = sum(len(t) + 1 for _, t in raw)
    for s in range(shards):
        assert abs(sum(r.size for r in by[s]) - total / shards) <= slack


def test_shards_have_near_equal_bytes(spark):
    rng = random.Random(3)
    texts = [(i, "x" * int(rng.paretovariate(0.9) * 20) + str(i)) if i % 3 else (i, "the same text of a third of all rows") for i in range(6000)]
    texts = [(i, t[:4000]) for i, t in texts]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = sharding.sharded(docs, ranges=64).collect()
    check_law(rows, texts, 8, 4001)
    # the copies outweigh a range: dealt out over tasks, yet a run of neighbouring shards
    held = sorted({r.shard for r in rows if r.size == 37 and r.doc_id % 3 == 0})
    assert held == list(range(held[0], held[-1] + 1))


def test_copies_that_fit_a_range_stay_together(spark):
    texts = [(i, f"text {i // 4} " + "y" * 30) for i in range(20_000)]
    rows = sharding.sharded(spark.createDataFrame(texts, "doc_id long, text string"), ranges=16).collect()
    check_law(rows, texts, 8, 4 * 50)
    where = defaultdict(set)
    for r in rows:
        where[r.doc_id // 4].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_hot_text_is_dealt_over_tasks(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.materialise(sharding.weighed(docs), "t")
    total = rows.agg(F.sum("size")).head()[0]
    bounds = sharding.splitters(rows, total, 64)
    key = rows.where("size = 4").head().key
    assert bounds.count(key) > 20
    at = rows.withColumn("range", sharding.range_of(F.col("key"), bounds)).groupBy("range").agg(F.min("key"), F.max("key"), F.sum("size")).collect()
    for r in at:
        assert (r.range == 0 or bounds[r.range - 1] <= r[1]) and (r.range == 63 or r[2] < bounds[r.range])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 63, 64])
def test_range_of_counts_boundaries(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.choice(range(40)) for _ in range(n))
    got = spark.range(45).select("id", sharding.range_of(F.col("id"), bounds).alias("r")).collect()
    assert all(r.r == sum(b <= r.id for b in bounds) for r in got)


def test_shards_of_edges(spark, docs, empty):
    assert sharding.sharded(empty).count() == 0
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = sharding.sharded(docs, shards=3).collect()
    check_law(rows, texts, 3, 200_000)
    kept = sharding.sharded(docs.withColumn("shard", F.lit("mine")), keep=("shard", "score")).toDF(*(f"c{i}" for i in range(10))).collect()
    assert {r.c0 for r in kept} == {"mine"} and len(kept) == len(texts)
    assert {r.shard for r in sharding.sharded(docs, shards=1).collect()} == {0}


def test_written_shards_are_read_back(spark, docs, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for s in range(4):
        slots = sorted(r[0] for r in back.where(F.col("shard") == s).select("__slot").collect())
        assert slots == list(range(len(slots)))


# ---------------------------------------------------------- fill in the middle


def brute_fim(doc_id, text, unit="line"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a\r\nb\r\n", "<P>no", "x<M>", "<S", "<\n<S\n<P\n>", "naïve\nÜnï\n日本語\n🙂🙂\n" * 40, "line\n" * 70_000, " " * 500, " a\u0085b\nc",
]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fim_like_brute_force(spark, unit):
    rng = random.Random(5)
    texts = FIM_TEXTS + ["".join(rng.choice("ab \n\né🙂<S>") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fim.fill_in_middle(df, unit=unit, keep=("text",))
    got = sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())))
    assert got == sorted(map(str, ((i, *brute_fim(i, t, unit)) for i, t in rows)))
    assert made.where(fim.restore() != F.coalesce("text", F.lit(""))).count() == 0


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 4, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(classes)
        at = np.arange(n + 1)
        for c in range(4):
            assert (matrix.rank(c, at) == np.append(0, np.cumsum(classes == c))).all()


def test_fim_on_edges(spark, docs, empty):
    assert fim.fill_in_middle(empty).count() == 0
    clash = docs.withColumn("form", F.lit("f")).withColumn("output", F.lit("o"))
    assert fim.fill_in_middle(clash, keep=("form", "output")).toDF(*"abcdefgh").where("b = 'f' AND c = 'o'").count() == docs.count()
    assert fim.fill_in_middle(docs, rate=0).where("form <> 'plain'").count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="word")


# ------------------------------------------------------------------- the trie


def brute_trie(paths):
    """``paths``: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += own
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k)))).encode()).hexdigest())
        for k, m in members.items()
    )


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table_of(spark, paths, turnless=()):
    rows = [(c, i, *t) for c, p in paths.items() for i, t in enumerate(p)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


@pytest.mark.parametrize("seed", range(3))
def test_trie_like_brute_force_over_many_shards(spark, seed):
    rng = random.Random(seed)
    paths = {c: [(rng.choice(("user", "assistant")), rng.choice(("a", "bé", "c" * 50))) for _ in range(rng.randrange(1, 7))] for c in range(rng.choice((5, 300, 900)))}
    paths |= {5000 + c: [("user", "hot"), ("assistant", "hot")] for c in range(2500)}  # more ids than a row of them holds
    paths |= {9000: [("user", str(i)) for i in range(300)], 9001: [("user", str(i)) for i in range(250)]}
    got = trie_rows(trie.prefix_trie(trie.conversation_paths(table_of(spark, paths)), shard_bytes=2000))
    assert got == brute_trie(paths)


def test_rebuilt_trie_like_brute_force(spark):
    rng = random.Random(9)
    own = {c: [(rng.choice(("user", "assistant")), rng.choice("abc")) for _ in range(rng.randrange(1, 9))] for c in range(200) if c % 25 or c % 2}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert any(not p for p in built.values())  # turnless ones are members of the root
    assert trie_rows(trie.prefix_trie(trie.rebuilt(trie.conversation_paths(table_of(spark, own))))) == brute_trie(built)


def test_trie_on_edges(spark):
    schema = "conv_id long, turn long, role string, text string, path string, depth long"
    assert trie.prefix_trie(trie.conversation_paths(spark.createDataFrame([], schema))).count() == 0
    rows = [
        (1, None, None, None, "x", 9), (1, 0, "user", "", "x", 9), (1, 0, "user", "", "x", 9),  # null first, repeated turn
        (2, 3, "", "", "x", 9), (None, 0, "user", "lost", "x", 9), (3, 0, "us", "er", "x", 9), (4, 0, "use", "r", "x", 9), (5, 0, "user", "long " * 200_000, "x", 9),
    ]
    got = trie_rows(trie.prefix_trie(trie.conversation_paths(spark.createDataFrame(rows, schema))))
    paths = {1: [("", ""), ("user", ""), ("user", "")], 2: [("", "")], 3: [("us", "er")], 4: [("use", "r")], 5: [("user", "long " * 200_000)]}
    assert got == brute_trie(paths)


def test_double_array_finds_all_children():
    rng = random.Random(4)
    parent, label, used = [0], [0], {0: set()}
    while len(parent) < 3000:
        p = rng.randrange(len(parent)) if rng.random() < 0.5 else rng.randrange(min(20, len(parent)))
        x = rng.randrange(400)
        if x not in used[p]:
            used[p].add(x)
            used[len(parent)] = set()
            parent.append(p)
            label.append(x)
    made = trie.DoubleArray(np.array(parent), np.array(label))
    assert len(set(made.slot.tolist())) == len(parent)
    assert (made.child(made.slot[np.array(parent[1:])], np.array(label[1:])) == made.slot[1:]).all()
    with pytest.raises(KeyError):
        made.child(np.array([0]), np.array([next(x for x in range(500) if x not in used[0])]))
