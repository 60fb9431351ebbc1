"""The k best rows by blocks of numbers, against scores of all pairs in columns."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions.numeric import cosine_sim
from kilnwork.model import Field, Retrieval
from kilnwork.operators import similarity

FIELDS = (Field("material"), Field("size", True), Field("price", True))
COLUMNS = "id string, process string, material string, size int, price double, v array<float>"


def every_pair(queries, rows, k, embedding):
    """What the operator is to give: all pairs of a process, scored in columns."""
    q, r = queries.select(F.struct("*").alias("q")), rows.select(F.struct("*").alias("r"))
    score, _ = similarity.structured_score(FIELDS, lambda f: F.col(f"q.{f}"), lambda f: F.col(f"r.{f}"))
    semantic = cosine_sim(F.col("q.v"), F.col("r.v")) if embedding else F.lit(0.0)
    pairs = q.join(r, F.col("q.process") == F.col("r.process")).withColumn("total", F.bround(0.8 * score + 0.2 * semantic, 6))
    best = W.partitionBy("q.id").orderBy(F.desc("total"), "r.id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q.id", "r.id", "total", "rank")


@pytest.fixture(scope="module")
def parts(spark):
    """Values that repeat and tie, missing ones, a NaN, vectors of several lengths, one process with most rows."""
    rng = random.Random(7)
    any_of = lambda *x: rng.choice(x)
    data = []
    for i in range(900):
        v = any_of(None, [], [0.0, 0.0], [1.0, 2.0, 3.0], [rng.uniform(-1, 1), rng.uniform(-1, 1)], [1.0, None], [1.0, 1.0])
        data.append((f"p{i * 7919 % 1000:03d}", any_of("a", "a", "a", "b", None), any_of("x", "y", "ß", None), any_of(None, 0, 1, 2, -3, 40), any_of(None, 0.0, -0.0, 1.5, 1000.0, 1000.0005, 1000.001, rng.uniform(990, 1010)), v))
    data.append(("nan", "b", "x", 1, float("nan"), [float("nan"), 1.0]))
    return spark.createDataFrame(data, COLUMNS).repartition(5, "id").cache()


@pytest.mark.parametrize("k", [1, 5, 2000])
@pytest.mark.parametrize("embedding", [None, "v"])
def test_same_as_all_pairs(parts, monkeypatch, k, embedding):
    monkeypatch.setattr(similarity, "SMALL_BLOCK", 50)
    monkeypatch.setattr(similarity, "FEW_BLOCKS", 5)
    monkeypatch.setattr(similarity, "QUERIES_IN_BLOCK", 20)
    queries = parts.where("hash(id) % 9 = 0")
    got = similarity.similar_rows(queries, parts, "process", FIELDS, "id", "id", k, Retrieval(), embedding).select("q.id", "r.id", "total_score", "rank")
    want = sorted(map(repr, map(tuple, every_pair(queries, parts, k, embedding).collect())))
    assert sorted(map(repr, map(tuple, got.collect()))) == want and want


def test_rows_of_equal_values_are_compared_once(spark, parts):
    """Sixty copies of every row leave each query as few pairs as one does: k for each block."""
    copies = parts.crossJoin(spark.range(60).withColumnRenamed("id", "n")).withColumn("id", F.concat_ws("-", "id", "n")).drop("n")
    queries = parts.where("id < 'p050'")
    near = similarity.candidates(queries, copies, "process", FIELDS, "id", "id", 5, Retrieval(), None)
    per = near.groupBy("__q").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert per <= 10


def test_no_rows(parts):
    none = parts.where("id = 'none'")
    assert similarity.similar_rows(parts, none, "process", FIELDS, "id", "id", 5).collect() == []
    assert similarity.similar_rows(none, parts, "process", FIELDS, "id", "id", 5).collect() == []
