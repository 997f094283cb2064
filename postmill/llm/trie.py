"""Operator 13, prefix trie of conversations in double arrays.

1. Turns become keys of 128 bits of a hash (role and text) and their text's
   length; one shuffle gathers a conversation's turns into a path, packed, so
   that no text moves.
2. Equal paths are one path.  Paths are range-partitioned by (path, conv_id), so
   a path that very many conversations share is spread over tasks; each packs
   the ids that it holds in order, a thousand to a row.  A second exchange, by
   path alone, hashes those rows as they stream by and leaves one row per path.
3. That exchange makes the shards: a shard is a range of paths in order, so a
   prefix that many paths share spans many shards.  Each shard is told the last
   path before it and the first after it, which is all it needs to know which of
   its nodes other shards have too.
4. In a shard the turns get dense ids, and its paths are packed into a
   double-array trie: BASE[node] + id is the child's slot, where CHECK names the
   node.  Paths are walked through the arrays, all together turn by turn, which
   gives the nodes; sums climb from CHECK to CHECK.
5. Nodes of one shard are done.  Of the nodes that shards share, the prefixes
   that neighbouring shards have in common, the partial sums are merged globally.
   All sums are additive: a node is owned by one shard, the first that has it.

Defined results: null roles and texts count as empty; turns are ordered by their
number (null first), then role, then the turn's hash; repeated rows repeat their
turns; texts are hashed where they are read, so a very long one costs no more
than its hash; a path is one value, so a conversation's turns (20 bytes each) are
what one task holds at least; rows with a null conv_id belong to no conversation
and are left out; a conversation without turns is a member of the root; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.shared import materialise

#: Bytes of a turn in a packed path: a key, then the length of the text.
KEY, LENGTH = 16, 4
TURN = KEY + LENGTH

#: Bytes of paths in a shard, and ids in a row of them.
SHARD_BYTES, IDS = 16 << 20, 1000

NOTHING = hashlib.sha256(b"").hexdigest()


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path: an array of packed turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length keeps role and text apart
    key = F.substring(F.unhex(F.sha2(F.concat_ws(" ", F.length(role).cast("string"), role, text), 256)), 1, KEY)
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), F.concat(key, size).alias("packed")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).getField("packed").alias("path"))


class DoubleArray:
    """A trie over labels 0 to n - 1 in BASE and CHECK arrays.  ``parent`` and
    ``label`` describe the nodes, parents first; node 0 is the root.  ``slot``
    is where a node lies."""

    def __init__(self, parent: np.ndarray, label: np.ndarray) -> None:
        nodes, labels = len(parent), int(label[1:].max(initial=0)) + 1
        self.base, self.check = np.zeros(nodes + labels + 1, np.int64), np.full(nodes + labels + 1, -1, np.int64)
        self.slot = np.zeros(nodes, np.int64)
        self.check[0] = 0
        order = np.lexsort((label[1:], parent[1:])) + 1
        owners, starts, sizes = np.unique(parent[order], return_index=True, return_counts=True)
        bases = np.zeros(nodes, np.int64)
        # nodes with several children by first fit, the largest first; then single children in whatever is free
        free = 1
        for i in np.argsort(-sizes, kind="stable"):
            if sizes[i] == 1:
                break
            kids = label[order[starts[i] : starts[i] + sizes[i]]]
            while self.check[free] >= 0:
                free += 1
            at = free
            while True:
                self._reach(at + int(kids[-1] - kids[0]))
                if self.check[at] < 0 and (self.check[at + (kids - kids[0])] < 0).all():
                    break
                at += 1
            bases[owners[i]] = at - kids[0]
            self.check[at + (kids - kids[0])] = nodes  # taken; the owner's slot is not known yet
        single = np.flatnonzero(sizes == 1)
        self._reach(nodes + labels + len(single))
        gaps = np.flatnonzero(self.check < 0)[: len(single)]
        bases[owners[single]] = gaps - label[order[starts[single]]]
        # children's slots follow from their parents' bases
        self.slot[1:] = bases[parent[1:]] + label[1:]
        self._reach(int(self.slot.max(initial=0)))
        self.base[self.slot] = bases
        self.check[self.slot[1:]] = self.slot[parent[1:]]

    def _reach(self, last: int) -> None:
        if last >= len(self.check):
            more = max(last + 1 - len(self.check), len(self.check) // 2)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def child(self, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Slots of the children of the nodes in slots ``at`` by ``label``."""
        to = self.base[at] + label
        if (to < 0).any() or (to >= len(self.check)).any() or (self.check[to] != at).any():
            raise KeyError("no such child")
        return to


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two packed paths share at their start; -1 where one is none."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    differ = np.flatnonzero(x != y)
    return (int(differ[0]) if len(differ) else n) // TURN


def _prefix_key(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: depth * TURN], digest_size=16).digest()


SHARD_SCHEMA = "shared boolean, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard: ``path``, ``conv_id``, ``n``, ``ends`` of its
    distinct paths, and with ``n`` null the paths next to it.

    A shard's sums count a node's own bytes once, in the shard that owns it.
    """
    order = np.array(sorted(range(table.num_rows), key=table.column("path").to_pylist().__getitem__))
    table = table.take(pa.array(order, pa.int64()))
    n = table.column("n").to_pylist()
    own = [i for i, x in enumerate(n) if x is not None]
    every = table.column("path").to_pylist()
    previous = every[0] if own[0] > 0 else None
    following = every[-1] if own[-1] < len(n) - 1 else None
    paths = [every[i] for i in own]
    conv = np.array(table.column("conv_id").to_pylist(), dtype=object)[own].astype(np.int64)
    copies = np.array([n[i] for i in own], np.int64)
    ends = [table.column("ends")[i].as_py() for i in own]

    # dense ids of turns, in the order of their bytes
    lengths = np.array([len(p) // TURN for p in paths], np.int64)
    flat = np.frombuffer(b"".join(paths), f"V{TURN}")
    keys, ids = np.unique(flat, return_inverse=True)
    sizes = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, TURN)[:, KEY:].copy().view(">u4").reshape(-1).astype(np.int64)
    starts = np.cumsum(lengths) - lengths

    # of paths in order, a path's new nodes are those below what it shares with the one before
    shared = np.array([0, *(common(a, b) for a, b in zip(paths, paths[1:]))], np.int64)
    of = np.repeat(np.arange(len(paths)), lengths)
    depth = np.arange(len(flat)) - starts[of] + 1
    fresh = depth > shared[of]
    node_at = np.zeros(len(flat), np.int64)  # the node of each turn of each path
    node_at[fresh] = np.arange(1, fresh.sum() + 1)
    for p in range(len(paths)):  # a path's shared turns have the nodes of the path before
        a, k = int(starts[p]), int(shared[p])
        if k:
            b = int(starts[p - 1])
            node_at[a : a + k] = node_at[b : b + k]
    above = np.zeros(len(flat), np.int64)
    above[1:] = node_at[:-1]
    above[starts[lengths > 0]] = 0
    parent, label = np.append(0, above[fresh]), np.append(0, ids[fresh])
    trie = DoubleArray(parent, label)

    # walk all paths through the arrays, turn by turn
    size = len(trie.check)
    convs, least, deep = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    value, owned = np.zeros(size, np.int64), np.ones(size, bool)
    convs[0], least[0] = copies.sum(), conv.min()
    at, ending = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
    levels, going = [np.zeros(1, np.int64)], np.arange(len(paths))
    top = common(previous, paths[0])
    owned[0] = previous is None
    for d in range(int(lengths.max(initial=0))):
        ending[going[lengths[going] == d]] = at[lengths[going] == d]
        keep = lengths[going] > d
        going, at = going[keep], at[keep]
        turn = ids[starts[going] + d]
        at = trie.child(at, turn)
        np.add.at(convs, at, copies[going])
        np.minimum.at(least, at, conv[going])
        deep[at], value[at] = d + 1, sizes[turn]
        if d < top and going[0] == 0:
            owned[at[0]] = False
        levels.append(np.unique(at))
    ending[going] = at

    # sums climb to the parents
    leaves, saved, children = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    childless = np.ones(size, bool)
    for level in levels[1:]:
        childless[trie.check[level]] = False
        np.add.at(children, trie.check[level], owned[level].astype(np.int64))
    if common(paths[-1], following) == lengths[-1]:  # the next shard goes on from the last path
        childless[ending[-1]] = False
    for level in reversed(levels):
        leaves[level] += childless[level]
        saved[level] += (convs[level] - owned[level]) * value[level]
        if level[0]:
            np.add.at(leaves, trie.check[level], leaves[level])
            np.add.at(saved, trie.check[level], saved[level])

    # nodes that neighbours have too lie on the first and on the last path
    both = np.zeros(size, bool)
    name = {}
    for path, depth_ in ((paths[0], top), (paths[-1], common(paths[-1], following))):
        slot = 0
        for d in range(depth_ + 1):
            if d:
                slot = int(trie.child(np.array([slot]), ids[[(starts[0] if path is paths[0] else starts[-1]) + d - 1]])[0])
            both[slot] = True
            name[slot] = _prefix_key(path, d)
    hashes = np.full(size, "", dtype=object)
    hashes[ending] = ends
    slots = np.concatenate(levels)
    up = trie.check[slots]
    inner = slots != 0
    return pa.table(
        [
            pa.array(both[slots]), pa.array([name.get(s) for s in slots.tolist()], pa.binary()), pa.array([name.get(u) if i else None for u, i in zip(up.tolist(), inner)], pa.binary()),
            pa.array(deep[slots]), pa.array(least[slots]), pa.array(least[up], mask=~inner | both[up]), pa.array(convs[slots]), pa.array(children[slots]), pa.array(leaves[slots]), pa.array(saved[slots]),
            pa.array([x or None for x in hashes[slots]], pa.string()),
        ],
        ["shared", "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    )


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, conv_id) in order to rows (path, conv_id, n, ids): up to
    ``IDS`` neighbouring ids of a path, the first of them, joined."""
    now, held = None, []

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.binary()), pa.array([x[0] for _, x in done], pa.int64()), pa.array([len(x) for _, x in done], pa.int64()), pa.array([",".join(map(str, x)) for _, x in done], pa.string())],
            ["path", "conv_id", "n", "ids"],
        )

    for batch in batches:
        done = []
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (path != now or len(held) == IDS):
                done.append((now, held))
                held = []
            now = path
            held.append(conv)
        yield rows(done)
    yield rows([(now, held)] if held else [])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed ids in order to one row per path: its smallest id, how
    many there are, and the hash of all of them."""
    now = first = digest = None
    total = 0

    def rows(done: list) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["path", "conv_id", "n", "ends"])

    for batch in batches:
        done = []
        for path, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "n", "ids"))):
            if path != now:
                if digest:
                    done.append((now, first, total, digest.hexdigest()))
                now, first, total, digest = path, conv, 0, hashlib.sha256()
            elif total:
                digest.update(b",")
            digest.update(ids.encode())
            total += n
        yield rows(done)
    yield rows([(now, first, total, digest.hexdigest())] if digest else [])


def prefix_trie(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per node of the trie over ``paths`` (conv_id, path): conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    joined = F.unhex(F.array_join(F.transform("path", F.hex), ""))  # only texts can be joined
    packed = materialise(paths.select("conv_id", joined.alias("path")), "paths")
    total = packed.agg(F.sum(F.length("path"))).head()[0] or 0
    shards = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // shard_bytes + 1)

    spread = packed.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = materialise(spread.select("path", "conv_id").mapInArrow(_packed_ids, "path binary, conv_id long, n long, ids string"), "packed-ids")
    once = rows.repartitionByRange(shards, "path").sortWithinPartitions("path", "conv_id").mapInArrow(_hashed_ids, "path binary, conv_id long, n long, ends string")
    distinct = materialise(once.withColumn("shard", F.spark_partition_id()), "distinct-paths")

    # a row per shard tells its neighbours where it begins and ends
    edges = distinct.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")
    sides = edges.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    beside = sides.select("shard", F.explode(F.array("before", "after")).alias("path")).where("path IS NOT NULL")
    told = distinct.unionByName(beside, allowMissingColumns=True)
    nodes = materialise(told.groupBy("shard").applyInArrow(lambda table: shard_nodes(table), SHARD_SCHEMA), "trie-nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where("shared").groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    merged = materialise(merged, "upper-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")]
    done = nodes.where("NOT shared AND parent IS NULL").select(*columns)
    below = nodes.where("NOT shared AND parent IS NOT NULL").drop("shared", "parent_conv_id").unionByName(merged.where("parent IS NOT NULL"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    root = merged.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return done.unionAll(below.join(above, "parent", "left").select(*columns)).unionAll(root.select(*columns))


def rebuilt(paths: DataFrame) -> DataFrame:
    """``paths`` with the first h turns of conversation c - c % 5 in place of
    each conversation's own first h, where h is crc32(c) % 9.  A family of
    conversations shares one key, so all of it takes one shuffle by that key."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % 9).cast("int")
    family = Window.partitionBy("family")
    base = F.max(F.when(c == F.col("family"), F.slice("path", 1, 8))).over(family)
    both = paths.withColumn("family", c - c % 5).withColumn("base", F.coalesce(base, F.array().cast("array<binary>")))
    rest = F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0)))
    return both.select("conv_id", F.concat(F.slice("base", F.lit(1), h), rest).alias("path"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversation_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(turn ORDER BY pos) AS own,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)),
           lambda crc, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), xor(crc, x)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 9 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT o.conv_id, list_concat(coalesce(b.own[1:o.h], []), o.own[CAST(o.h AS BIGINT) + 1:]) AS path
  FROM o LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 5
), v AS (
  SELECT conv_id, len(path) AS n, d AS depth, sha256(CAST(path[1:d] AS VARCHAR)) AS node, sha256(CAST(path[1:d - 1] AS VARCHAR)) AS up, CASE WHEN d > 0 THEN strlen(path[d].t) ELSE 0 END AS size
  FROM r, unnest(range(0, len(path) + 1)) AS u(d)
), g AS (
  SELECT node, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM v GROUP BY node, depth
), k AS (
  SELECT g.*, (SELECT count(*) FROM g AS c WHERE c.up = g.node AND c.depth = g.depth + 1) AS n_children FROM g
), a AS (
  SELECT v.node, v.depth, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((k.n_convs - 1) * k.size) AS saved_tokens
  FROM k JOIN v AS own ON own.conv_id = k.conv_id AND own.depth = k.depth JOIN v ON v.conv_id = k.conv_id AND v.depth <= k.depth
  GROUP BY v.node, v.depth
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN a USING (node, depth) LEFT JOIN k AS p ON k.depth > 0 AND p.node = k.up AND p.depth = k.depth - 1
"""
