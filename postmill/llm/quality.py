"""Operator 8, quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is web
text without a usable label.  The learner minimises the non-negative unbiased
risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with the logistic loss over a linear model of text features, where ``prior``,
the share of good text among unlabelled text, is estimated first: a
probabilistic classifier of positive against unlabelled is fitted, and the
prior is the mean over unlabelled text of its odds, scaled by what it gives to
held-back positives (the labelling-frequency estimate).

Features read the whole text: a byte histogram and word statistics, in Arrow
batches inside the tasks; lang, source, doc_id and labels are never features.
The fit uses at most ``MOST_ROWS`` rows of each kind, chosen by the hash of the
text, and runs on the driver over a table of that bounded size; scoring is one
narrow pass over all documents.

Defined results: null text counts as empty; empty texts are scored like any
other; repeated rows are each scored; rows with the same text get the same
score; labels with a null id or quality are ignored; without any usable label
every score is the prior 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import blocks, bounded_batches, documents, materialise, texts_of

#: Bound on the rows of each kind (positive, unlabelled) that the fit reads.
MOST_ROWS = 10_000
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46, 58, 59, 63, 39, 34, 40, 41, 45]] = True

FEATURES = ("log_bytes", "upper", "lower", "digit", "mark", "stop", "wide", "line_breaks", "bang", "pipe", "marked_words", "word_length", "distinct_words", "top_word", "repeats", "long_run", "short", "distinct_lines")


def features(text: str) -> list[float]:
    """Shares and ratios that describe a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if n == 0:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    count = max(len(words), 1)
    counted = Counter(words)
    top = max(counted.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    longest = run = 0
    if same:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 0
            longest = max(longest, run)
    lines = raw.split(b"\n")
    marks = float(hist[_MARK].sum())
    return [
        float(np.log1p(n)),
        hist[_UPPER].sum() / n,
        hist[_LOWER].sum() / n,
        hist[_DIGIT].sum() / n,
        marks / n,
        hist[_STOP].sum() / n,
        hist[128:].sum() / n,
        hist[10] / n,
        hist[33] / n,
        hist[124] / n,
        min(marks / count, 4.0),
        min(n / count, 40.0),
        len(counted) / count,
        top / count,
        same / count,
        float(np.log1p(longest)),
        float(count < 5),
        len(set(lines)) / len(lines),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _descend(gradient, size: int, steps: int = 1500, rate: float = 0.05) -> np.ndarray:
    """Adam with a falling rate, from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, ridge: float = 1e-3) -> float:
    """Share of positives among unlabelled rows, from a positive-against-
    unlabelled classifier and its mean odds on every third positive, which it
    does not see."""
    held = np.arange(len(pos)) % 3 == 2
    seen = pos[~held]
    x = np.vstack([seen, unl])
    y = np.r_[np.ones(len(seen)), np.zeros(len(unl))]

    def gradient(w):
        return x.T @ (_sigmoid(x @ w) - y) / len(x) + ridge * w

    w = _descend(gradient, x.shape[1], 600)
    odds = lambda rows: _sigmoid(rows @ w) / (1 - _sigmoid(rows @ w))
    at_pos = np.median(odds(pos[held])) if held.any() else np.median(odds(seen))
    return float(np.clip(np.minimum(odds(unl) / max(at_pos, 1e-9), 1).mean(), 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, ridge: float = 1e-4) -> dict:
    """The weights that minimise the non-negative risk."""
    if not len(pos) or not len(unl):
        return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "weights": np.zeros(2 * len(FEATURES) + 1), "prior": 0.5}
    both = np.vstack([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = _expand(pos, mean, scale), _expand(unl, mean, scale)
    share = estimate_prior(p, u) if prior is None else prior

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.logaddexp(0, u @ w).mean() - share * np.logaddexp(0, p @ w).mean()
        of_pos = share * (p.T @ (sp - 1)) / len(p)
        of_neg = u.T @ su / len(u) - share * (p.T @ sp) / len(p)
        return (of_pos + of_neg if negative >= 0 else -of_neg) + ridge * w

    return {"mean": mean, "scale": scale, "weights": _descend(gradient, p.shape[1]), "prior": share}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    return _sigmoid(_expand(x, model["mean"], model["scale"]) @ model["weights"]) if len(x) else np.empty(0)


def feature_rows(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and an array of the text's features."""
    fields = {f.name: f for f in docs.schema.fields}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            x = matrix(texts_of(block))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carried), pa.array(list(x), pa.list_(pa.float64()))], [*carried, "features"])

    schema = ", ".join([*(f"{c} {fields[c].dataType.simpleString()}" for c in carried), "features array<double>"])
    return bounded_batches(docs).select(*carried, "text").mapInArrow(rows, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict:
    """Fit on at most ``most`` trusted positives and ``most`` unlabelled
    texts.  Labels of the held-out fold are not read."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    trusted = known.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    # what is drawn from: ids and hashes only, equal texts once
    keys = materialise(docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("chance")), "text-keys")

    def drawn(rows: DataFrame, kind: int) -> DataFrame:
        return rows.groupBy("chance").agg(F.min("doc_id").alias("doc_id")).orderBy("chance").limit(most).withColumn("kind", F.lit(kind))

    good = drawn(keys.join(trusted, "doc_id", "left_semi"), 1)
    web = drawn(keys.join(labels.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_anti"), 0)
    picked = materialise(good.unionByName(web), "picked")  # at most 2 * most rows
    texts = docs.select(F.col("doc_id").alias("d_id"), "text", F.xxhash64("text").alias("d_chance"))
    met = texts.join(F.broadcast(picked), F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_chance") == F.col("chance")))
    got = feature_rows(met.select("kind", "chance", "text"), "kind", "chance").dropDuplicates(["kind", "chance"]).orderBy("kind", "chance").drop("chance").toArrow()
    kind = got.column("kind").to_numpy()
    table = np.array(got.column("features").to_pylist(), np.float64).reshape(len(kind), len(FEATURES))
    return fit(table[kind == 1], table[kind == 0])


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are kept for evaluation."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: dict, *carried: str, name: str = "score") -> DataFrame:
    """The carried columns and the score, under ``name``, for every row."""
    fields = {f.name: f for f in docs.schema.fields}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in carried), pa.array(score(matrix(texts_of(block)), model), pa.float64())], [*carried, name])

    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in carried), f"`{name}` double"])
    inputs = list(dict.fromkeys([*carried, "text"]))
    return bounded_batches(docs).select(*inputs).mapInArrow(rows, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, "doc_id").select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
