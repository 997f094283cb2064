"""Operator 11, sharding by sampled splitters.

Records are ordered by a hash of their text and cut into shards of near equal
bytes; built-in functions only.

1. One narrow pass makes a row of fixed size per record (size, checksum, key,
   tie key), written to the shared folder.
2. Splitters.  Every row is drawn with a probability that follows its size,
   about ``SAMPLES`` rows whatever the table's size; the quantiles of their keys,
   computed in Spark, are the boundaries of ``shards * RANGES`` ranges of near
   equal bytes.  A row finds its range by binary search in that array.
3. Overfull ranges.  A key that outweighs a range, such as that of a group of
   copies, is a boundary by itself (the lowest key of its range); its exact
   bytes are counted, and its rows are dealt out by their tie key to as many
   sub-ranges as it has ranges' worth of bytes.  No task holds more.
4. Counts and bytes of the ranges, a table whose length does not depend on the
   data, give each range its offset; running sums inside a range give each row
   its place in the order of all bytes, and so its shard and slot.

Equal texts have equal keys and stay in one shard, unless they outweigh a range
(``1 / RANGES`` of a shard); sizes of shards differ by one such group, or one
record, at most.

Defined results: the law is ``bytes``; a record's size is its UTF-8 bytes plus
one, so null and empty texts weigh one; a very long text is one record and
may outweigh a shard, whose neighbours then may be empty; repeated rows are
placed each; the doc_id may be null; an empty table gives an empty result; of
further columns those named in ``keep`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.shared import documents, materialise

SHARDS = 8

#: Ranges of a shard, and rows drawn for each of all ranges.  The array of
#: boundaries has ``shards * RANGES - 1`` entries.
RANGES, DRAWS = 256, 32

SEED = 11


def weighed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, key (52 bits of a hash of the text), tie (a
    hash that spreads equal keys) and the columns ``keep`` as keep0, keep1..."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(whole), 12).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)),
    )
    return rows.withColumn("tie", F.xxhash64("doc_id", "row")).drop("row")


def splitters(rows: DataFrame, total: int, ranges: int, draws: int = DRAWS, seed: int = SEED) -> list[int]:
    """``ranges - 1`` keys in order, quantiles of a sample that is weighted by
    size; a key that outweighs a range occurs more than once."""
    share = F.col("size") * F.lit(ranges * draws / total)
    drawn = rows.where(F.rand(seed) < share).select("key", F.greatest(F.round(share), F.lit(1)).cast("long").alias("weight"))
    parts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    found = drawn.agg(F.percentile("key", parts, F.col("weight")).alias("at")).head()[0] if ranges > 1 else None
    return [int(x) for x in found or [0] * (ranges - 1)]


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at most ``key``, by binary search."""
    width = 1 << len(bounds).bit_length()
    table = F.array(*(F.lit(b).cast("long") for b in bounds), *[F.lit((1 << 63) - 1)] * (width - 1 - len(bounds)))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(width.bit_length() - 1))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.element_at(table, at + step) <= key, step).otherwise(0))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, then doc_id, size,
    text_crc32, law, shard (from 0), slot (gapless from 0 in its shard),
    grown_shard (null: only a law of keys has it) and range."""
    if shards < 1:
        raise ValueError("there must be a shard")
    rows = materialise(weighed(docs, text, doc_id, keep), "weighed")
    total = rows.agg(F.sum("size")).head()[0] or 1
    bounds = splitters(rows, total, shards * ranges)
    fair = total / (shards * ranges)

    # the key that opens a range is told from the others in it, and is split where it outweighs a range
    opens = F.array(F.lit(-1).cast("long"), *(F.lit(b).cast("long") for b in bounds))
    ranged = rows.withColumn("range", range_of(F.col("key"), bounds)).withColumn("lead", F.element_at(opens, F.col("range") + 1) == F.col("key"))
    weights = ranged.groupBy("range", "lead").agg(F.sum("size").alias("bytes"))
    pieces = weights.where("lead").select("range", F.ceil(F.col("bytes") / F.lit(fair)).cast("int").alias("pieces"))  # at most a row per range
    dealt = ranged.join(F.broadcast(pieces), "range", "left").withColumn("sub", F.when(F.col("lead"), F.pmod("tie", F.col("pieces")).cast("int")).otherwise(F.lit((1 << 31) - 1)))
    units = dealt.groupBy("range", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)  # at most three rows per range
    starts = units.select("range", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))

    # within a range the order of its rows
    own = Window.partitionBy("range", "sub").orderBy("key", "tie")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({"rank": F.row_number().over(own).cast("long") - 1, "start": F.sum("size").over(upto) - F.col("size")})
    group = Window.partitionBy("range", "sub", "key")
    placed = placed.withColumns({"group_start": F.min("start").over(group), "group_bytes": F.sum("size").over(group)})
    begins = F.when((F.coalesce("pieces", F.lit(1)) > 1) & F.col("lead") | (F.col("group_bytes") > F.lit(fair)), F.col("start")).otherwise(F.col("group_start"))
    placed = placed.withColumn("begins", begins).join(F.broadcast(starts), ["range", "sub"])
    placed = placed.withColumns({"shard": F.expr(f"cast((bytes_before + begins) * {shards} div {total} AS int)"), "index": F.col("rows_before") + F.col("rank")})
    placed = materialise(placed.drop("key", "tie", "lead", "pieces", "start", "group_start", "group_bytes", "begins", "rows_before", "bytes_before", "rank", "sub"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)), "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "range",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the columns of ``docs`` and their slot as Parquet, a folder
    ``shard=k`` for each shard; a file holds a range, in the order of slots."""
    names = tuple(docs.columns)
    placed = sharded(docs.withColumns({"__text": F.col("text"), "__id": F.col("doc_id")}), shards, "__text", "__id", names)
    # positions instead of names, which may clash with those of the columns kept
    n = len(names)
    flat = placed.toDF(*(f"c{i}" for i in range(len(placed.columns))))
    shard, slot, part = f"c{n + 4}", f"c{n + 5}", f"c{n + 7}"
    whole = flat.repartition(shard, part).sortWithinPartitions(shard, slot)
    kept = whole.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col(slot).alias("__slot"), F.col(shard).alias("shard"))
    kept.write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir)).drop("range")
