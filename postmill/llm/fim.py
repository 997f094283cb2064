"""Operator 12, fill-in-the-middle transformation over wavelet matrices.

Every byte of a text belongs to one of four character classes (line feed,
white space, other first byte of a character, continuation byte).  A wavelet
matrix holds the classes of a block of texts as two bit planes with a rank
directory each; all questions about boundaries are rank queries on it:

- units of a text: lines are the line feeds in it, plus one where its last byte
  is none; characters are all classes but continuation bytes, so their count is
  a sum of ranks;
- end of unit k: the smallest position whose rank reaches k, found by bisection
  on ranks, for all texts of a block at once;
- lengths in code points: ranks of continuation bytes, taken from byte lengths.

Two cuts at unit boundaries, drawn from a hash of the row's id, make prefix,
middle and suffix, which are put out in prefix-suffix-middle (psm) or
suffix-prefix-middle (spm) order behind their markers.  ``restore`` gives the
text back, as no marker occurs in a transformed text.  The job is one narrow
stage without a shuffle; memory is bounded by one block or one text.

Defined results: null text counts as empty; a text that is empty or holds a
marker stays as it is (form ``plain``, null lengths); a null id draws as the
empty string does; repeated rows are transformed alike; texts are never decoded,
so a very long one costs its bytes and two bits each (and a directory); an empty
table gives an empty result; of further columns those named in ``keep`` are
returned, whatever their names, and the others ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50

FEED, SPACE, FIRST, CONTINUATION = range(4)


def _classes() -> np.ndarray:
    of = np.full(256, FIRST, np.uint8)
    of[[9, 11, 12, 13, 32]] = SPACE
    of[10] = FEED
    of[0x80:0xC0] = CONTINUATION
    return of


CLASS_OF_BYTE = _classes()


class BitPlane:
    """Bits in words of 64, with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank queries over a sequence of four classes: a plane for each bit, the
    higher one first; between them the zeros move stably before the ones."""

    def __init__(self, classes: np.ndarray) -> None:
        high = (classes >> 1).astype(bool)
        self.high = BitPlane(high)
        self.low = BitPlane(np.concatenate([classes[~high], classes[high]]) & 1)

    def rank(self, wanted: int, at: np.ndarray) -> np.ndarray:
        """How often class ``wanted`` is among the first ``at`` symbols."""
        start = np.zeros_like(at)
        ones = self.high.ones(at)
        if wanted & 2:
            start, at = start + self.high.zeros, self.high.zeros + ones
        else:
            at = at - ones
        ones = self.low.ones(at) - self.low.ones(start)
        return ones if wanted & 1 else at - start - ones

    def units(self, kind: str, at: np.ndarray) -> np.ndarray:
        """Ends of units ("line") or characters ("char") among the first ``at``."""
        if kind == "line":
            return self.rank(FEED, at)
        return self.rank(FEED, at) + self.rank(SPACE, at) + self.rank(FIRST, at)

    def select(self, kind: str, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest position in [low, high] before which ``wanted`` units
        are counted, by bisection on ranks; ``high`` where there is none."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.units(kind, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hash of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def cuts(texts: list[bytes], drawn: np.ndarray, unit: str = "line") -> tuple[np.ndarray, ...]:
    """Of each text: units, ends of prefix and middle (in bytes), and code
    points of prefix and middle; ``drawn``: a row of two numbers for each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    matrix = WaveletMatrix(CLASS_OF_BYTE[data])
    before = matrix.units(unit, starts)
    n = matrix.units(unit, ends) - before
    if unit == "line":
        last = data[np.maximum(ends - 1, 0)] if len(data) else np.full(len(texts), 10, np.uint8)
        n = n + ((sizes > 0) & (last != 10))
    picked = np.sort(drawn % (n + 1)[:, None], axis=1)

    def end_of(k: np.ndarray) -> np.ndarray:
        at = matrix.select(unit, before + k, starts, ends)
        if unit == "char":  # a character ends before the next one begins
            after = matrix.select(unit, before + k + 1, starts, ends)
            at = np.where(k == 0, starts, np.where(k >= n, ends, after - 1))
        return at

    first, second = end_of(picked[:, 0]), end_of(picked[:, 1])
    points = lambda a, b: b - a - (matrix.rank(CONTINUATION, b) - matrix.rank(CONTINUATION, a))
    return n, first - starts, second - starts, points(starts, first), points(first, second)


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars,
    middle_chars, output, and the columns ``keep``.

    ``rate`` per cent of the rows are transformed, ``spm`` per cent of these in
    suffix-prefix-middle order; ``unit``: "line" or "char".
    """
    if unit not in ("line", "char"):
        raise ValueError("unit must be line or char")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            texts = [t or b"" for t in block.column("__text").cast(pa.binary()).to_pylist()]
            h = np.array([draws(i, seed) for i in block.column("__id").to_pylist()], np.int64)
            n, first, second, prefix_chars, middle_chars = cuts(texts, h[:, :2], unit)
            forms, out = [], []
            for i, t in enumerate(texts):
                if not t or h[i, 2] % 100 >= rate or any(x in t for x in marks):
                    forms.append("plain")
                    out.append(t)
                    continue
                a, b = int(first[i]), int(second[i])
                if h[i, 3] % 100 < spm:
                    forms.append("spm")
                    out.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
                else:
                    forms.append("psm")
                    out.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in ("__id", *carried)), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), pa.array(out, pa.binary())],
                ["__id", *carried, "__n", "__form", "__prefix", "__middle", "__out"],
            )

    carried = [f"__keep{i}" for i in range(len(keep))]
    cut = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("__id"), *(F.col(c).alias(k) for c, k in zip(keep, carried)), F.col(text).alias("__text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    made = cut.mapInArrow(transformed, f"{kinds}, __n long, __form string, __prefix long, __middle long, __out binary")
    return made.select(
        F.col("__id").alias("doc_id"), *(F.col(k).alias(c) for c, k in zip(keep, carried)), F.col("__n").alias("n"), F.col("__form").alias("form"),
        F.col("__prefix").alias("prefix_chars"), F.col("__middle").alias("middle_chars"), F.col("__out").cast("string").alias("output"),
    )


def restore(output="output", form="form"):
    """The text that an output was made of: a Column of built-in functions.
    The last part needs no marker behind it, the others end at the next one."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    between = F.when(F.col(form) == "psm", SUFFIX).otherwise(PREFIX)
    one = F.split_part(body, between, F.lit(1))
    rest = F.substr(body, F.length(one) + len(PREFIX) + 1)
    two = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    return F.when(F.col(form) == "psm", F.concat(one, middle, two)).when(F.col(form) == "spm", F.concat(two, middle, one)).otherwise(F.col(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), k AS (
  SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM d
), c AS (
  SELECT *, coalesce(array_to_string(l[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(l[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(l[greatest(a, b) + 1:], ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
