"""Exact search with more queries than are broadcast."""

import random

from kilnwork.operators import similarity


def test_cosine_topk_of_many_queries(spark):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(4_100)] + [(5_000, None), (5_001, [0.0] * 4)]
    e = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3).cache()
    rows = e.where("vec_id % 50 = 0")
    joined = similarity.cosine_topk(e, rows, 3)
    assert "CartesianProduct" in joined._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, joined.collect()))
    want = [tuple(r) for a in range(0, 6_000, 1_500) for r in similarity.cosine_topk(e.where(f"vec_id >= {a} AND vec_id < {a + 1500}"), rows, 3).collect()]
    assert got == sorted(want) and len(got) == 3 * len(data)


def test_cosine_topk_is_that_of_plain_sums(spark):
    """Missing, empty, zero and shorter vectors, ties, and text ids, against plain Python."""
    rng = random.Random(5)
    data = [(f"v{i:03d}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(120)] + [("a", None), ("b", []), ("c", [0.0] * 3), ("d", [1.0, 2.0]), ("e", [2.0, 4.0]), ("f", [1.0, None, 0.0])]
    e = spark.createDataFrame(data, "vec_id string, embedding array<double>").repartition(4)

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or None in x or None in y:
            return 0.0
        norm = sum(v * v for v in x) ** 0.5 * sum(v * v for v in y) ** 0.5
        return round(min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / norm)), 6) if norm else 0.0

    want = []
    for i, x in data:
        best = sorted((-cosine(x, y), j) for j, y in data if j != i)[:4]
        want += [(i, j, -s, n) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, similarity.cosine_topk(e, e, 4).collect())) == sorted(want)
