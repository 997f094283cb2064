"""Operator 5, stupid-backoff language-model scores.

The model counts token bigrams of the whole corpus; tokens are those of a
public byte-level BPE vocabulary, so that a bigram is an exact 32-bit key and
the unigram table is bounded by the vocabulary (at most 65,535 entries, which
bounds its broadcast).  A document is scored by what the others hold: its own
bigrams do not count for it (``leave_out``; else those of the whole corpus do).
Every count above 0 counts.  The score of a token w after v is

    others(v w) / count(v)           if others(v w) > 0
    0.4 * count(w) / tokens          otherwise

and a document's score is the sum of its tokens' base-10 logarithms; a text
starts after a boundary token whose count is the number of texts.

1. Unigrams: each task sums its tokens; one small aggregation by token.
2. Bigrams: texts are exploded to their distinct bigrams with multiplicity, in
   blocks of documents, and shuffled once, by the hash of the bigram.
3. In each partition of that shuffle the bigram count table is built by
   summing, joined to the exploded rows it came from (they are in the same
   partition already), and summed per document: for each block of documents the
   sums of those that have a bigram there, so that what travels grows with the
   bigrams, not with blocks times partitions.  A last shuffle by block adds them.

A bigram costs at most a row per document, so no frequent one makes a hot
partition; the number of hash partitions follows the number of tokens, which
bounds what a task holds.  Logarithms are summed as whole millionths, so the
result does not depend on the order of summation.

Defined results: null text counts as empty; a text without tokens has
n_tokens 0, log10_score 0 and no mean; rows with the same doc_id are parts of
one document; a null doc_id is a document of its own; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents, texts_of
from postmill.llm.tokens import byte_bpe

BACKOFF = 0.4

#: Tokens of the corpus per hash partition.
TOKENS_PER_BUCKET = 4_000_000

EDGE, NO_ID = 0xFFFF, np.iinfo(np.int64).min
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def bigrams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams (earlier token in the high half) and their counts."""
    before = np.append(np.uint32(EDGE), ids)[: len(ids)].astype(np.uint32)
    return np.unique(before << np.uint32(16) | ids.astype(np.uint32), return_counts=True)


def unigram_counts(docs: DataFrame, vocabulary: str) -> np.ndarray:
    """Counts by token id, 65,536 of them; the last one counts the texts that
    have tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, total = byte_bpe(vocabulary), np.zeros(EDGE + 1, np.int64)
        for block in blocks(batches):
            for t in texts_of(block):
                ids = bpe.ids(t)
                if len(ids):
                    total += np.bincount(ids, minlength=EDGE + 1)
                    total[EDGE] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["token", "n"])

    rows = docs.select("text").mapInArrow(counted, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(EDGE + 1, np.int64)
    for r in rows.collect():  # bounded by the vocabulary
        out[r.token] = r.n
    return out


def exploded(docs: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """Blocks of documents as (bucket, block, row, grams, counts): for each
    bucket the block's bigrams, which of its documents has them, how often.
    One row of each block also carries its doc_ids and their token numbers.
    A block is named by the hash of its ids, so a task that runs again names
    it alike, and blocks of the same ids add up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for block in blocks(batches):
            ids = block.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            name = xxhash.xxh3_64_intdigest(ids) >> 1
            grams, counts, lengths, tokens = [], [], [], []
            for t in texts_of(block):
                found = bpe.ids(t)
                g, n = bigrams(found)
                grams.append(g)
                counts.append(n)
                lengths.append(len(g))
                tokens.append(len(found))
            gram, count = np.concatenate(grams), np.concatenate(counts).astype(np.uint32)
            row = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
            bucket = ((gram * _SPREAD >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32 if buckets > 65535 else np.uint16)
            order = np.argsort(bucket, kind="stable")
            gram, count, row, bucket = gram[order], count[order], row[order], bucket[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
            ends = np.append(edges[1:], len(bucket))[: len(edges)]
            cut = lambda a: [a[i:j].tobytes() for i, j in zip(edges, ends)] + [b""]
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*bucket[edges].tolist(), name % buckets], pa.int32()), pa.array([name] * (n + 1), pa.int64()), *(pa.array(cut(a), pa.binary()) for a in (row, gram, count)),
                    pa.array([None] * n + [ids], pa.binary()), pa.array([None] * n + [np.array(tokens, "<i8").tobytes()], pa.binary()),
                ],
                ["bucket", "block", "row", "grams", "counts", "doc_ids", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "bucket int, block long, row binary, grams binary, counts binary, doc_ids binary, tokens binary")


def bucket_scores(unigrams: np.ndarray, backoff: float = BACKOFF, leave_out: bool = True):
    """The count table of one hash partition, joined to the rows it came from
    and summed per document of each block (millionths): the documents' numbers
    in the block and their sums."""
    tokens = max(int(unigrams[:EDGE].sum()), 1)

    def scores(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        grams, counts, rows = read("grams", np.uint32), read("counts", np.uint32), read("row", np.uint16)
        keys, at = np.unique(np.concatenate(grams), return_inverse=True)
        count = np.concatenate(counts).astype(np.int64)
        total = np.bincount(at, count, len(keys))
        of_others = total[at] - (count if leave_out else 0)
        left, right = (keys >> np.uint32(16))[at], (keys & np.uint32(0xFFFF))[at]
        share = np.where(of_others > 0, of_others / np.maximum(unigrams[left], 1), backoff * unigrams[right] / tokens)
        part, ends, out = np.rint(np.log10(np.maximum(share, 1e-300)) * 1e6).astype(np.int64) * count, np.cumsum([len(g) for g in grams]), []
        for row, end in zip(rows, ends):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)  # rows are in order
            sums = np.add.reduceat(part[end - len(row) : end], first) if len(row) else np.empty(0, np.int64)
            out.append((row[first].tobytes(), sums.tobytes()))
        return pa.table({"block": table.column("block"), "row": pa.array([r for r, _ in out], pa.binary()), "sums": pa.array([s for _, s in out], pa.binary()), "doc_ids": table.column("doc_ids"), "tokens": table.column("tokens")})

    return scores


def add_blocks(table: pa.Table) -> pa.Table:
    """One block's sums added; its ids once, its token numbers added."""
    ids, tokens = None, 0
    for i, n in zip(table.column("doc_ids").to_pylist(), table.column("tokens").to_pylist()):
        if i is not None:
            ids, tokens = np.frombuffer(i, "<i8"), tokens + np.frombuffer(n, "<i8")
    if ids is None:
        raise ValueError("a block without its ids: the input of the scores must give the same batches when it is read again")
    micro = np.zeros(len(ids), np.int64)
    for row, sums in zip(table.column("row").to_pylist(), table.column("sums").to_pylist()):
        micro[np.frombuffer(row, np.uint16)] += np.frombuffer(sums, np.int64)
    return pa.table({"doc_id": ids, "micro": micro, "n": tokens})


def lm_scores(docs: DataFrame, vocabulary: str, backoff: float = BACKOFF, leave_out: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, log10_score, mean_log10 per document."""
    rows = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    unigrams = unigram_counts(rows, vocabulary)
    buckets = max(8, -(-int(unigrams[:EDGE].sum()) // TOKENS_PER_BUCKET))
    summed = exploded(rows, vocabulary, buckets).groupBy("bucket").applyInArrow(bucket_scores(unigrams, backoff, leave_out), "block long, row binary, sums binary, doc_ids binary, tokens binary")
    parts = summed.groupBy("block").applyInArrow(add_blocks, "doc_id long, micro long, n long")
    total = parts.groupBy("doc_id").agg(F.sum("micro").alias("micro"), F.sum("n").alias("n_tokens"))
    return total.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_tokens",
        (F.col("micro") / 1e6).alias("log10_score"),
        F.when(F.col("n_tokens") > 0, F.round(F.col("micro") / 1e6 / F.col("n_tokens"), 6)).alias("mean_log10"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scores(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
