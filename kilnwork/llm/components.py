"""Connected components of a graph given by its edges, in DataFrame functions.

Alternates two steps until nothing changes: every node hangs its greater neighbours on its least neighbour,
then its lesser ones. Each step is a grouped minimum and a join, so no neighbourhood is gathered in one place,
and the rounds grow with the logarithm of the longest path. Every round is written to the shared folder, which
cuts the lineage where all machines can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.blocks import saved


def _least(directed: DataFrame) -> DataFrame:
    """(u, v) -> with the least of u and its neighbours."""
    low = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return directed.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).drop("w")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v) of any orderable type -> (node, root): the least node of the component of each node that has an edge."""
    spark = edges.sparkSession
    # greater, lesser
    stars = saved(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).drop("w")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = saved(spark, small.where("u <> v").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")) for seed in (1, 2)]).first()  # 128 bits and the count tell a table from the one before
        if now == mark or now[0] == 0:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
