"""Vector search: blocks and chunks give what comparing all pairs gives."""

import random

from postmill.operators.similarity import top_similar


def cosine(a, b):
    dot = lambda x, y: sum(map(float.__mul__, x, y))
    return round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 9)


def test_blocks_and_chunks_find_the_same_neighbours(spark):
    draw = random.Random(7)
    rows = [(i, [draw.choice((-2.0, -1.0, 1.0, 3.0)) for _ in range(3)]) for i in range(120)] + [(i, [1.0, 1.0, 1.0]) for i in range(120, 160)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_similar(vectors.where("vec_id % 10 = 0"), vectors, 4, block=5, chunk=50)
    want = {q: sorted((-cosine(v, w), i) for i, w in rows)[:4] for q, v in rows if q % 10 == 0}
    assert {(r.q_id, r.rank): (r.vec_id, r.similarity) for r in got.collect()} == {(q, n): (i, -s) for q, best in want.items() for n, (s, i) in enumerate(best, 1)}
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_null_has_no_similarity_and_comes_last(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 1.0]), (3, [None, 1.0])], "vec_id long, embedding array<float>")
    got = top_similar(vectors.where("vec_id < 2"), vectors, 4, chunk=1).orderBy("q_id", "rank").collect()
    assert [(r.q_id, r.vec_id, r.similarity) for r in got] == [(0, 0, 1.0), (0, 2, 0.707106781), (0, 1, None), (0, 3, None), (1, 0, None), (1, 1, None), (1, 2, None), (1, 3, None)]
