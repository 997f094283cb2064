import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from messy import ROWS

from postmill.llm import exact_dedup, ngram_join, secret_scan
from postmill.llm.components import components


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("support", [0.0005, 0.3])
def test_exact_dedup(docs, support):
    got = exact_dedup.exact_dedup(docs, support=support).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[bare(t)].append((-len(t or ""), i if i is not None else 1 << 60, i))
    keep = {k: min(v)[2] for k, v in groups.items()}
    by_id = {i: t for i, t, *_ in ROWS}
    for r in got:
        key = bare(by_id[r.doc_id])
        assert r.keep_id == keep[key] and r.group_size == len(groups[key])
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_one_row_of_each(docs, empty):
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({bare(t) for _, t, *_ in ROWS})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_unique(empty).count() == 0


def brute_components(rows, words=3, percent=90):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(a)] = find(b)
    members = defaultdict(list)
    for a in range(len(sets)):
        members[find(a)].append(sets[a][0])
    return [(i, len(s), min(members[find(a)])) for a, (i, s) in enumerate(sets)]


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_jaccard_join_against_brute_force(spark, chunk):
    rng = random.Random(5)
    rows = [(i, t) for i, t, *_ in ROWS if i is not None and i != 12]
    for g in range(6):
        base = " ".join(f"v{rng.randrange(400)}" for _ in range(rng.choice([9, 11, 40, 200])))
        rows += [(100 * (g + 1) + k, edited(rng, base, rng.randrange(0, 6))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, chunk=chunk).collect())
    assert got == sorted(brute_components(rows))


def test_jaccard_join_edges(docs, empty):
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).select("doc_id", "component_id").collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (9, 6), (7, 6)} <= got
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.keep_first(docs.where("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {5, 7, 9} == set()


def test_t_occurrence_finds_what_counting_finds():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(200)]
    lists, sizes = ngram_join.inverted(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 70 * len(np.union1d(q, s))]
        assert ngram_join.t_occurrence(q, lists, sizes, 70).tolist() == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_short_list(spark, percent, buckets):
    """Every pair at the threshold meets in a block, whatever the lists' order."""
    import numpy as np

    rng, sets = np.random.default_rng(percent), []
    for size in [2, 5, 9, 10, 12, 19, 20, 37, 100, 400]:
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        common = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(12):
            cut, more = (int(rng.integers(0, size * (100 - percent) // 150 + 2)) for _ in range(2))
            kept = rng.permutation(base)[cut:]
            sets.append(np.unique(np.concatenate([kept, rng.permutation(common)[:more]])))
    sets = [s for s in {s.tobytes(): s for s in sets}.values() if ngram_join.has_partners(len(s), percent)]
    rows = [(i, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows + rows[:9], "set_id long, shingles binary").repartition(3)
    sizes = spark.createDataFrame([(i, i, len(s)) for i, s in enumerate(sets)], "set_id long, rep long, size long")
    blocks = defaultdict(set)
    for r in ngram_join.short_lists(ngram_join.shared_shingles(frame, buckets), sizes, percent).collect():
        blocks[r.rep].add(r.block)
    seen = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(np.intersect1d(a, sets[j])) >= percent * len(np.union1d(a, sets[j])):
                seen += 1
                assert blocks[i] & blocks[j], (len(a), len(sets[j]))
    assert seen > 30


def test_shingles_that_agree_in_their_terms_lose_no_link(spark):
    """Shingles of one set with the same 32 bits count each."""
    import numpy as np

    low = np.arange(10, dtype=np.uint64)
    a = np.sort(np.concatenate([low, low[:9] + np.uint64(1 << 32)]))
    b = np.sort(np.append(a, np.uint64(77)))
    frame = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes()))], "set_id long, shingles binary")
    sizes = spark.createDataFrame([(1, 1, len(a)), (2, 2, len(b))], "set_id long, rep long, size long")
    found = ngram_join.short_lists(ngram_join.shared_shingles(frame, 1), sizes, 90).collect()
    blocks = {k: {r.block for r in found if r.rep == k} for k in (1, 2)}
    assert blocks[1] & blocks[2]


def test_a_bucket_holds_more_sets_than_a_position_counts(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, bytearray(rng.integers(0, 2**63, 3, dtype=np.uint64).tobytes())) for i in range(68_000)]
    rows += [(68_000 + k, bytearray(np.arange(k, 20 + k, dtype=np.uint64).tobytes())) for k in range(2)]
    frame = spark.createDataFrame(rows, "set_id long, shingles binary").coalesce(1)
    found = ngram_join.shared_shingles(frame, 1).collect()
    assert {r.set_id: sorted(r.terms) for r in found if r.set_id >= 68_000} == {68_000: list(range(1, 20)), 68_001: list(range(1, 20))}


def test_sets_without_partners():
    for percent in (80, 90):
        for n in range(1, 60):
            want = any(m != n and 100 * min(n, m) >= percent * max(n, m) for m in range(1, 90))
            assert ngram_join.has_partners(n, percent) == want


def test_near_dedup_stage_against_brute_force(spark):
    """Five words at 0.8; one word in 45 to 57 is enough for a near copy."""
    rng, rows = random.Random(11), []
    for g, n in enumerate([12, 45, 46, 49, 52, 56, 57, 90, 300]):
        base = " ".join(f"v{g}_{k}" for k in range(n))
        middle = base.split()
        middle[n // 2] = "changed"
        rows += [(100 * g, base), (100 * g + 1, " ".join(middle))] + [(100 * g + k, edited(rng, base, rng.randrange(0, 8))) for k in range(2, 20)]
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    assert want != {c for _, _, c in brute_components(rows, 3, 90)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, df, "").collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [4, 1024])
def test_jaccard_join_of_a_table_united_with_itself(spark, chunk):
    rng, rows = random.Random(5), []
    for g in range(8):
        base = " ".join(f"v{rng.randrange(400)}" for _ in range(rng.choice([11, 40, 200])))
        rows += [(100 * g + k, edited(rng, base, rng.randrange(0, 6))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df.unionAll(df), chunk=chunk).collect())
    assert got == sorted(2 * brute_components(rows))


def test_rows_with_null_ids_link_and_are_kept_once(spark):
    base = " ".join(f"n{k}" for k in range(80))
    other = base.replace("n", "m")
    rows = [
        (None, "alone and unique"), (None, "Alone and UNIQUE"), (None, base), (7, base + " tail"), (None, other), (None, other + " tail"), (None, other),
        (None, None), (None, " \t"), (8, "eight words"), (None, "eight words"), (9, "nine"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.component_id or 0) for r in ngram_join.jaccard_components(df).collect())
    assert got == sorted([("None", 0)] * 7 + [("None", 7), ("7", 7), ("8", 8), ("None", 8), ("9", 9)])
    kept = ngram_join.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [7, 8, 9]
    left = [r.text for r in kept if r.doc_id is None]
    assert len(left) == 4 and None in left and " \t" in left
    assert len([t for t in left if t and t.lower() == "alone and unique"]) == 1 and len([t for t in left if t and t.startswith("m0")]) == 1


def test_messy_table_keeps_its_null_id(docs):
    assert [r.text for r in ngram_join.keep_first(docs).where("doc_id IS NULL").collect()] == ["a null id"]


def test_redact_masks_rows_with_null_ids(spark):
    secret, tame = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "a null row without any"
    rows = [(None, f'token = "{secret}"', "en", "a.env", 60), (None, tame, "en", "b", 22), (None, None, "en", "b", 0), (1, f'token = "{secret}"', "en", "a.env", 60)]
    got = secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert len(got) == 4 and not any(secret in (r.text or "") for r in got)
    assert sum("<SECRET>" in (r.text or "") for r in got) == 2 and tame in {r.text for r in got}
