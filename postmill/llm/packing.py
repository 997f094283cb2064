"""Operator 10, packing by power-of-two decomposition.

A document of n token ids (its text's ids, then the end id) is cut into
pieces whose lengths are the powers of two of n's binary form, the window
length first and as often as it fits.  Each piece is a sequence of its own, so
no sequence crosses documents, nothing is padded, and sequences of equal
length form the buckets that a trainer draws whole batches from.  The job is
one narrow stage: no shuffle, and memory bounded by one text.

Defined results: null text counts as empty and gives the one piece that holds
the end id; a null doc_id stays null; a very long text is cut whole; repeated
rows give their pieces again under other sequence ids; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents, texts_of
from postmill.llm.tokens import byte_bpe

WINDOW, END_ID = 1024, 0


def binary_lengths(n: int, window: int = WINDOW) -> list[int]:
    """``n`` as whole windows and then falling powers of two below one."""
    whole, rest = divmod(n, window)
    return [window] * whole + [1 << k for k in range(window.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (binary logarithm of
    the length), ids (little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id, offset.

    ``sequence_id`` is unique in the result; the sequence's length is a power
    of two, at most ``window``.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("the window must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for block in blocks(batches):
            of, start, length, ids, total = [], [], [], [], []
            for i, t in enumerate(texts_of(block)):
                doc = np.append(bpe.ids(t), np.uint32(end_id)).astype("<u4")
                at, raw = 0, memoryview(doc.tobytes())
                for n in binary_lengths(len(doc), window):
                    of.append(i)
                    start.append(at)
                    length.append(n)
                    ids.append(bytes(raw[4 * at : 4 * (at + n)]))
                    total.append(len(doc))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(of, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    cut = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long").select(
        "doc_id",
        "start",
        "length",
        F.log2("length").cast("int").alias("bucket"),
        "ids",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def packed_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
