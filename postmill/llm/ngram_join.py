"""Operator 6, n-gram Jaccard join by T-occurrence search.

Two documents link when the Jaccard similarity of their word-shingle sets
reaches ``threshold``; a component is what is reachable by links.

1. One narrow pass hashes every text's shingles to 64 bits and gives its set
   size, a key of the whole set and the hashes.  Documents with equal sets
   collapse into one row with a partial aggregation, so a group of copies,
   however large, costs one row per task.
2. Inverted lists.  One exchange by shingle brings all postings together, packed
   by hash, and answers each set with those of its shingles that other sets have
   and the lengths of their lists.  A partner of a set of n shingles holds at
   least T = ceil(t n) of them, so a set with fewer shared ones is done here.
3. Short lists.  T-occurrence search over the whole corpus with the T - 1 longest
   lists of a set put aside (DivideSkip's choice of L): what is left to merge are
   its n - T + 1 shortest, ordered by length, then hash, the same order for all
   sets.  Two sets that reach the threshold have their first common shingle
   among the short ones of both, so they meet in a block, the sets that have one
   shingle as a short one.  No pair within the threshold is missed.
4. Star links.  Of the first sets of its blocks each set is tested against the
   one that it meets most often; a connected-components step merges what linked.
   A large group of near copies costs a row per member here, not a pair of
   members.
5. Rest.  Only blocks whose members are still in several components are
   searched, and of blocks with the same members only one: small blocks by their
   untested pairs, each once; in larger ones all members outside the block's
   largest component query an inverted index of the members, queries and index
   both in chunks of bounded size.  Pairs whose sizes cannot link are dropped
   before any text travels.
6. Every test is a T-occurrence search again: with T the overlap that the two
   sizes require, the L longest lists of a query are set aside, the short ones
   are merged in one sorted run, what reaches T - L is probed in the long ones by
   binary search, and what reaches T is a link (DivideSkip).

Defined results: null text counts as empty; a text without words has an empty
set, size 0, and is its own component; a text with fewer words than a shingle
has the whole sequence as its one shingle; repeated rows are each returned; an
empty table gives an empty result; further columns are ignored.  A row with a
null doc_id is a document of its own text: it links as any other, its
component is named by the smallest doc_id that is not null, and by null where
no row of the component has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.shared import blocks, bounded_batches, discard, documents, materialise, texts_of

WORDS, PERCENT = 3, 90

#: Members of a block that one task indexes, or asks for, at a time.
CHUNK = 1024

#: Shingles whose inverted lists share a bucket, and sets that a packed batch holds.
SHINGLES_PER_BUCKET = 8_000_000
PACKED_SETS = 1000

#: Blocks of up to so many members are searched pair by pair, larger ones in
#: chunks; both are exact.
SMALL = 32

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


_HASHES = _WordHash()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX2


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text.  A-Z count as
    a-z; words are what ASCII white space separates, which is what splitting
    UTF-8 bytes does."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for k in range(1, n):
        out = mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def has_partners(size: int, percent: int = PERCENT) -> bool:
    """Can a set of ``size`` shingles link with any but an equal set?"""
    return size > 0 and (100 * size >= percent * (size + 1) or 100 * (size - 1) >= percent * size)


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: doc_id, or a hash of the text where it is null."""
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))))


def shingle_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, n_shingles, set_key (128 bits of the whole set), set_id (64
    of them), shingles (8 bytes each; none where only an equal set can link)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n, key, short, packed = [], [], [], []
            for text in texts_of(block):
                found = shingles(text, words)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                n.append(len(found))
                key.append(digest)
                short.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                packed.append(found.tobytes() if has_partners(len(found), percent) else b"")
            arrays = [block.column("doc_id"), block.column("key"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(short, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_shingles", "set_key", "set_id", "shingles"])

    rows = with_key(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(sets, "doc_id long, key long, n_shingles long, set_key binary, set_id long, shingles binary")


def t_occurrence(query: np.ndarray, lists: dict[int, np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Positions of the indexed sets that overlap ``query`` as their sizes
    require.  ``lists``: shingle -> sorted positions; ``sizes``: of the sets.
    """
    size = len(query)
    low, high = -(-percent * size // 100), 100 * size // percent
    least = least_overlap(size, low, percent)  # the smallest overlap that any partner needs
    own = [x for x in map(lists.get, query.tolist()) if x is not None]
    if len(own) < least:
        return np.empty(0, np.int64)
    own.sort(key=len)
    longest = len(own[-1])
    aside = min(least - 1, int(least / (0.05 * np.log2(max(longest, 2)) + 1)))
    short, long = own[: len(own) - aside], own[len(own) - aside :]
    merged = np.sort(np.concatenate(short), kind="stable")  # as a heap of cursors would
    edges = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    found, count = merged[edges], np.diff(np.append(edges, len(merged)))
    fits = (count >= least - aside) & (sizes[found] >= low) & (sizes[found] <= high)
    found, count = found[fits], count[fits]
    for probed in long:
        if not len(found):
            break
        at = np.searchsorted(probed, found)
        count = count + (probed[np.minimum(at, len(probed) - 1)] == found)
    needed = -(-percent * (size + sizes[found]) // (100 + percent))
    return found[count >= needed]


def inverted(sets: list[np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Inverted lists of ``sets`` and their sizes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return {}, sizes
    of = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    edges = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return dict(zip(flat[edges].tolist(), np.split(of, edges[1:]))), sizes


def shared_shingles(sets: DataFrame, buckets: int) -> DataFrame:
    """set_id, shared, lengths, terms: of each set and bucket the shingles that
    several sets have (as 64-bit terms) and how many have each; ``sets``: set_id,
    shingles.

    A batch of sets sends each bucket 4 bytes of hash and 2 of position a shingle;
    two shingles of a bucket that agree in them count as one term, which can only
    lengthen a list, alike for all its sets.  Equal sets (64 bits of hash are taken
    as their identity) are sent once a batch and counted once.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACKED_SETS):
                batch = whole.slice(start, PACKED_SETS)
                own = dict(zip(batch.column("set_id").to_pylist(), batch.column("shingles").to_pylist()))
                ids = np.fromiter(own, np.int64, len(own))
                found = [np.frombuffer(x, np.uint64) for x in own.values()]
                flat, row = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
                bucket = (flat >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, row, hashes = bucket[order], row[order], flat[order].astype(np.uint32)
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                out = [[], [], []]
                for i, j in zip(edges, np.append(edges[1:], len(bucket))):
                    new = np.append(True, row[i + 1 : j] != row[i : j - 1])
                    out[0].append(ids[row[i:j][new]].tobytes())
                    out[1].append((np.cumsum(new) - 1).astype(np.uint16).tobytes())
                    out[2].append(hashes[i:j].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32) if len(edges) else [], pa.int32()), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "ids", "position", "hashes"])

    def answered(key: tuple, table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        # a set that several batches sent counts once
        kept = np.zeros(sum(map(len, ids)), bool)
        kept[np.unique(np.concatenate(ids), return_index=True)[1]] = True
        starts = np.cumsum([0, *map(len, ids)])
        position = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int32) + k for x, k in zip(table.column("position").to_pylist(), starts.tolist())])
        hashes = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()])
        kept = kept[position]
        sets, hashes = np.concatenate(ids)[position[kept]], hashes[kept]
        order = np.argsort(hashes, kind="stable")
        hashes, sets = hashes[order], sets[order]
        lengths = np.diff(np.flatnonzero(np.append(np.append(True, hashes[1:] != hashes[:-1]), True)))
        lengths = np.repeat(lengths, lengths)
        several = lengths > 1
        hashes, sets, lengths = hashes[several], sets[several], lengths[several]
        order = np.argsort(sets, kind="stable")
        hashes, sets, lengths = hashes[order], sets[order], lengths[order]
        terms = (np.uint64(key[0].as_py()) << np.uint64(32) | hashes.astype(np.uint64)).view(np.int64)
        edges = np.flatnonzero(np.append(True, sets[1:] != sets[:-1])[: len(sets)])
        offsets = np.append(edges, len(sets))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (lengths, terms)]
        return pa.table([pa.array(sets[edges], pa.int64()), pa.array(np.diff(offsets), pa.int64()), *lists], ["set_id", "shared", "lengths", "terms"])

    rows = bounded_batches(sets, PACKED_SETS).select("set_id", "shingles").mapInArrow(packed, "bucket int, ids binary, position binary, hashes binary")
    return rows.groupBy("bucket").applyInArrow(answered, "set_id long, shared long, lengths array<long>, terms array<long>")


def short_lists(answers: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(block, rep): the terms that a set has among its short lists (step 3
    above); ``sizes``: set_id, rep, size.  Terms that no other set has come first
    in the order and are not listed."""
    need = f"({percent} * size + 99) DIV 100"
    shared = answers.groupBy("set_id").agg(F.sum("shared").alias("shared"))
    able = sizes.join(shared, "set_id").where(f"shared >= {need}")
    whole = answers.select("set_id", F.arrays_zip("lengths", "terms").alias("lists")).join(able, "set_id").groupBy("set_id", "rep", "size", "shared").agg(F.flatten(F.collect_list("lists")).alias("lists"))
    short = F.slice(F.sort_array("lists"), F.lit(1), F.expr(f"cast(shared - {need} + 1 AS int)"))
    return whole.select("rep", F.explode(short.getField("terms")).alias("block")).distinct()


def fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sizes allow a link; ``sizes``: rep, size."""
    side = lambda x: sizes.select(F.col("rep").alias(x), F.col("size").alias(f"{x}_size"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")).select(*pairs.columns).distinct()


def star_links(pairs: DataFrame, docs: DataFrame, words: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """The pairs (a, b) that link: each a is a query against its bs.  The bs of
    an a are dealt out in slices of about ``chunk`` rows, each of which gets the
    text of a once, so that no task and no a gathers an unbounded group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked, met = [], None, True
        for block in blocks(batches):
            a, b, texts = block.column("a").to_pylist(), block.column("b").to_pylist(), texts_of(block)
            out_a, out_b, sets, ids = [], [], [], []

            def flush() -> None:
                lists, sizes = inverted(sets) if sets else ({}, None)
                for query in queries if sets else ():
                    for hit in t_occurrence(query, lists, sizes, percent):
                        out_a.append(asked)
                        out_b.append(ids[hit])
                sets.clear()
                ids.clear()

            for x, y, text in zip(a, b, texts):
                if y is None:  # the query comes before what it is asked against
                    flush()
                    queries = [*(queries if x == asked and not met else []), shingles(text, words)]  # an id may have several texts
                    asked, met = x, False
                else:
                    met = True
                    sets.append(shingles(text, words))
                    ids.append(y)
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    texts = docs.select(F.col("doc_id").alias("of"), "text")
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("slices"))
    dealt = pairs.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"))
    asked = slices.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = dealt.unionByName(asked).withColumn("of", F.coalesce("b", "a")).join(texts, "of").select("a", "slice", "b", "text")
    return rows.repartition("a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("b")).select("a", "b", "text").mapInArrow(search, "a long, b long")


def chunk_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links within (block, ask_chunk, held_chunk): rows with ``asks`` query the
    rows with ``held``; of a query's partners the first of each component is
    named."""

    def search(table: pa.Table) -> pa.Table:
        ids, comp = table.column("rep").to_pylist(), table.column("component").to_pylist()
        held = [i for i, x in enumerate(table.column("held").to_pylist()) if x]
        asks = [i for i, x in enumerate(table.column("asks").to_pylist()) if x]
        out = set()
        if held and asks:
            sets = [shingles(t or "", words) for t in table.column("text").to_pylist()]
            lists, sizes = inverted([sets[i] for i in held])
            for q in asks:
                met = {}
                for hit in t_occurrence(sets[q], lists, sizes, percent):
                    i = held[hit]
                    if comp[i] != comp[q]:
                        met.setdefault(comp[i], ids[i])
                out.update((ids[q], x) for x in met.values())
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.groupBy("block", "ask_chunk", "held_chunk").applyInArrow(search, "a long, b long")


def keyed_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_shingles, component_id, and
    ``first_key``, the key of the component's document to keep."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialise(shingle_sets(docs, words, percent), "shingle-sets")
    docs = with_key(docs).select(F.col("key").alias("doc_id"), "text")

    # equal sets are one row from here on
    keyed = sets.where("set_key IS NOT NULL").groupBy("set_key")
    groups = materialise(keyed.agg(F.coalesce(F.min("doc_id"), F.min("key")).alias("rep"), F.min("doc_id").alias("known"), F.max("n_shingles").alias("size"), F.min("set_id").alias("set_id")), "set-groups")
    buckets = 8 + int(groups.agg(F.sum("size")).head()[0] or 0) // SHINGLES_PER_BUCKET
    answers = materialise(shared_shingles(sets.where("length(shingles) > 0"), buckets), "shared-shingles")
    plain = materialise(sets.drop("shingles", "set_id"), "set-keys")
    discard(sets)

    # blocks of several sets; each set is tested against the first that it meets most often
    sizes = groups.select("set_id", "rep", "size")
    signed = materialise(short_lists(answers, sizes, percent), "short-lists")
    discard(answers)
    first = signed.groupBy("block").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialise(signed.join(first, "block"), "members")
    discard(signed)
    met = members.where("rep <> first").groupBy(F.col("first").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    sizes = sizes.select("rep", "size")
    pairs = fitting(met, sizes, percent).groupBy("b").agg(F.max_by("a", F.struct(F.col("met"), -F.col("a"))).alias("a"))
    pairs = materialise(pairs.select("a", "b"), "star-pairs")
    # only texts that share a block are read again, gathered once
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(docs.join(wanted, "doc_id", "left_semi").withColumn("print", F.xxhash64("text")).dropDuplicates(["doc_id", "print"]).drop("print"), "texts")
    stars = materialise(star_links(pairs, texts, words, percent), "star-links")
    first_round = materialise(components(stars), "star-components")

    # the rest: blocks that still hold several components, each member set once
    label = first_round.select(F.col("node").alias("rep"), F.col("component").alias("found"))
    placed = materialise(members.join(label, "rep", "left").select("block", "rep", F.coalesce("found", "rep").alias("component")), "placed")
    per = placed.groupBy("block", "component").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("who"))
    mixed_blocks = (
        per.groupBy("block")
        .agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("members"), F.max(F.struct("size", "component")).alias("most"), F.bit_xor("who").alias("who"))
        .where("parts > 1")
        .groupBy("who", "members")
        .agg(F.min("block").alias("block"), F.max("most").alias("most"))
        .select("block", "members", F.col("most.component").alias("most"), (F.col("members") - F.col("most.size")).alias("askers"))
    )
    open_rows = materialise(placed.join(mixed_blocks, "block"), "open-rows")

    # few members: their untested pairs, each once
    few = open_rows.where(F.col("members") <= SMALL)
    left = few.select("block", F.col("rep").alias("a"), F.col("component").alias("a_c"))
    right = few.select("block", F.col("rep").alias("b"), F.col("component").alias("b_c"))
    open_pairs = left.join(right, "block").where((F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c"))).select("a", "b").distinct()
    untested = fitting(open_pairs.join(pairs, ["a", "b"], "left_anti"), sizes, percent)

    # many members: all outside the largest component query the members, both in chunks
    many = open_rows.where(F.col("members") > SMALL).withColumn("asks", F.col("component") != F.col("most"))
    many = many.withColumn("held_chunks", F.ceil(F.col("members") / chunk).cast("int")).withColumn("ask_chunks", F.ceil(F.col("askers") / chunk).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    asking = many.where("asks").select("block", "rep", "component", F.lit(True).alias("asks"), F.lit(False).alias("held"), own("ask_chunks", 1).alias("ask_chunk"), F.explode(each("held_chunks")).alias("held_chunk"))
    holding = many.select("block", "rep", "component", F.lit(False).alias("asks"), F.lit(True).alias("held"), own("held_chunks", 2).alias("held_chunk"), F.explode(each("ask_chunks")).alias("ask_chunk"))
    spread = asking.unionByName(holding)
    searched = spread.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("block", "ask_chunk", "held_chunk", "rep", "component", "asks", "held", "text")
    rest = star_links(untested, texts, words, percent).unionByName(chunk_links(searched, words, percent).distinct())
    links = stars.unionByName(rest)
    final = materialise(components(materialise(links, "links")), "components").select(F.col("node").alias("rep"), F.col("component").alias("found"))

    named = groups.join(final, "rep", "left").select("set_key", "known", F.coalesce("found", "rep").alias("first_key"))
    if groups.where("known IS NULL").limit(1).count():  # a key that is no doc_id names no component that has one
        least = named.groupBy("first_key").agg(F.min("known").alias("component_id"))
        named = named.drop("known").join(least, "first_key").select("set_key", "component_id", F.coalesce("component_id", "first_key").alias("first_key"))
    else:
        named = named.select("set_key", F.col("first_key").alias("component_id"), "first_key")
    rows = plain.select("doc_id", "key", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    return rows.select("doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("key")).otherwise(F.col("first_key")).alias("first_key"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id that links reach)."""
    return keyed_components(docs, words, percent, chunk).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    doc_id (same columns).  Of a component whose doc_ids are all null one row
    is kept; texts without words are all kept, each a component of its own."""
    found = keyed_components(docs, words, percent)
    # few rows lose, so the table of those is the smaller side of the join
    verdicts = found.groupBy(F.col("key").alias("__key"), F.col("doc_id").isNull().alias("__null")).agg(F.bool_or(F.col("key") == F.col("first_key")).alias("__first"))
    firsts = materialise(verdicts.where("__null = __first"), "verdicts")  # losers that have a doc_id, winners that have none
    known = docs.where("doc_id IS NOT NULL").join(firsts.where("NOT __null"), F.col("doc_id") == F.col("__key"), "left_anti")
    unnamed = docs.where("doc_id IS NULL")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    keyed = unnamed.where(~wordless).withColumn("__text_key", F.xxhash64("text"))
    once = keyed.join(firsts.where("__null"), F.col("__text_key") == F.col("__key"), "left_semi").dropDuplicates(["__text_key"]).select(*docs.columns)
    return known.unionAll(once).unionAll(unnamed.where(wordless))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
