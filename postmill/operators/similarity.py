"""Vector and name similarity."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_NINTH = Decimal("1e-9")


def _nine_digits(x: float) -> float:
    """Rounded as Spark rounds: half away from zero, in decimals."""
    return float(Decimal(repr(x)).quantize(_NINTH, ROUND_HALF_UP)) if math.isfinite(x) else x


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows summed from the first to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _known(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and their lengths, and the ids of those that are null or
    hold a null."""
    ids = t["vec_id"].to_numpy()
    lists = t["embedding"].combine_chunks()
    if lists.flatten().null_count:
        lists = pa.array([x if x is None or None not in x else None for x in lists.to_pylist()], lists.type)
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    some = lists.drop_null()
    widths = np.unique(pc.list_value_length(some).to_numpy())
    if len(widths) > 1:
        raise ValueError("vectors differ in length")
    vectors = some.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(some), -1 if len(some) else 0)
    n = np.sqrt(_in_order(vectors, vectors))
    if not (n > 0).all():
        raise ValueError("a vector has no direction")
    return ids[there], vectors, n, np.sort(ids[~there])


def _best_of(k: int, at_once: int = 64):
    """For cogrouped tables of queries and vectors: each query's best k.  A
    matrix product finds what may be among them; those are scored exactly.
    What has no similarity comes last."""

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q_id": [], "vec_id": [], "similarity": []}

        def add(q_id, ids, similarity):
            out["q_id"] += [int(q_id)] * len(ids)
            out["vec_id"] += ids.tolist()
            out["similarity"] += similarity

        if asked.num_rows and rows.num_rows:
            (q_ids, q, q_n, q_null), (ids, v, n, null) = _known(asked), _known(rows)
            for q_id in q_null:
                first = np.sort(np.concatenate([ids, null]))[:k]
                add(q_id, first, [None] * len(first))
            for start in range(0, len(q), at_once):
                part = slice(start, start + at_once)
                rough = (q[part] @ v.T) / (q_n[part, None] * n) if len(v) else np.empty((len(q[part]), 0))
                for i, scores in enumerate(rough, start):
                    least = np.partition(scores, -k)[-k] - 1e-8 if len(scores) > k else -np.inf
                    maybe = np.flatnonzero(scores >= least)
                    exact = _in_order(v[maybe], np.broadcast_to(q[i], (len(maybe), len(q[i])))) / (n[maybe] * q_n[i]) if len(maybe) else scores
                    distinct, back = np.unique(exact, return_inverse=True)
                    rounded = np.array([_nine_digits(x) for x in distinct.tolist()], "float64")[back]
                    first = np.lexsort((ids[maybe], -rounded))[:k]
                    add(q_ids[i], ids[maybe][first], rounded[first].tolist())
                    add(q_ids[i], null[: k - len(first)], [None] * len(null[: k - len(first)]))
        return pa.table({"q_id": pa.array(out["q_id"], "int64"), "vec_id": pa.array(out["vec_id"], "int64"), "similarity": pa.array(out["similarity"], "float64")})

    return best


def top_similar(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024, chunk: int = 16384) -> DataFrame:
    """The k most similar vectors of a stated query set, by cosine, against
    all rows: every block of queries meets every chunk of vectors in a group of
    bounded size, which keeps each query's best k; these meet by query.  The
    work is the product of both counts, spread over all groups.  A null has no
    similarity and comes last; other lengths or no direction end the job."""
    n_blocks, n_chunks = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // chunk))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked, rows = (x.select("vec_id", "embedding") for x in (queries, vectors))
    asked = asked.select("*", place(n_blocks).alias("b")).select("*", every(n_chunks).alias("c"))
    rows = rows.select("*", place(n_chunks).alias("c")).select("*", every(n_blocks).alias("b"))
    found = asked.groupBy("b", "c").cogroup(rows.groupBy("b", "c")).applyInArrow(_best_of(k), "q_id long, vec_id long, similarity double")
    order = Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def trigrams(name):
    """Distinct three-letter pieces of a padded, lower-case name."""
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_pairs(names: DataFrame, least: float) -> DataFrame:
    """Pairs of names whose trigram sets reach a Jaccard similarity: partners
    share one of the rarest pieces of both (prefix filter), verified exactly."""
    t = names.select("id", trigrams(F.col("name")).alias("t"))
    pieces = t.select("id", F.explode("t").alias("g"))
    rare = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = pieces.join(rare, "g").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("df", "g")))
    sized = ranked.join(t.select("id", F.size("t").alias("n")), "id").where(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "g", "n")
    a, b = (sized.select(F.col("id").alias(x), "g", F.col("n").alias(f"{x}_n")) for x in ("a", "b"))
    maybe = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n"))).select("a", "b").distinct()
    both = maybe.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    found = both.select("a", "b", shared.alias("m"), (F.size("ta") + F.size("tb") - shared).alias("u")).where(F.col("m") >= least * F.col("u"))
    return found.select("a", "b", F.round(F.col("m") / F.col("u"), 6).alias("similarity"))
