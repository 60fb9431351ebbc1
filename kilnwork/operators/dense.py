"""Approximate search by cosine: an inverted file of cells around centroids.

Centroids are fitted by spherical k-means on at most ``sample`` rows, those with the least hashes of their ids, in one task's worth of work;
every row is then assigned to its nearest one and the index is written as blocks of unit vectors by cell. A query looks into its ``probes`` nearest
cells only. A cell with more than ``PART_ROWS`` rows, as of many copies, is dealt into parts that queries visit all of, so none meets
in one task. ``similarity.cosine_topk`` is the exact way, and with all cells probed this one gives its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kilnwork.operators.similarity import best_of_blocks
from kilnwork.sources.shared import saved

SAMPLE, ROUNDS, PART_ROWS, BLOCK = 20_000, 10, 1 << 16, 2048


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; zeros for vectors of another length or without direction."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            out[i] = v
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.nan_to_num(out / np.where(norm > 0, norm, 1.0))


def centroids(rows: DataFrame, cells: int, id_col: str, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids, fitted on the driver from a sample of bounded size."""
    dim = rows.agg(F.max(F.size(vector))).first()[0] or 0
    taken = rows.where(F.size(vector) == dim).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample).select(vector).toArrow()
    x = _matrix(taken.column(0).combine_chunks(), dim)
    if not len(x) or not dim:
        return np.zeros((1, max(1, dim)))
    c = x[np.random.default_rng(1).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), c)
    return c


def _nearest(df: DataFrame, id_col: str, vector: str, c: np.ndarray, probes: int) -> DataFrame:
    """(id, cell, data): each row with its nearest cells, nearest first, and its unit vector in bytes."""
    shared, kind = df.sparkSession.sparkContext.broadcast(c), df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column(1), c.shape[1])
                cell = np.argsort(-(x @ c.T), 1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(x)), cell.shape[1])
                yield pa.record_batch([part.column(0).take(pa.array(row)), pa.array(cell.ravel().astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row))], names=["id", "cell", "data"])

    return df.select(F.col(id_col).alias("id"), vector).mapInArrow(run, f"id {kind.simpleString()}, cell int, data binary")


def _blocks(rows: DataFrame, dim: int, prefix: str) -> DataFrame:
    """(cell, part) and blocks of ids and vectors, from rows sorted by cell and part."""
    kind = rows.schema["id"].dataType
    ids = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))) if len(cell) else []
            for a, z in zip(starts, np.append(starts[1:], len(cell)) if len(cell) else []):
                for b in range(a, z, BLOCK):
                    n = min(BLOCK, z - b)
                    data = b"".join(batch.column(3).slice(b, n).to_pylist())
                    yield pa.record_batch([pa.array([cell[a]]), pa.array([part[a]]), pa.array([batch.column(2).slice(b, n).to_pylist()], ids), pa.array([dim], pa.int32()), pa.array([data], pa.binary())], names=["cell", "part", f"{prefix}_ids", f"{prefix}_dim", f"{prefix}_data"])

    sorted_rows = rows.select("cell", "part", "id", "data").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return sorted_rows.mapInArrow(run, f"cell int, part int, {prefix}_ids array<{kind.simpleString()}>, {prefix}_dim int, {prefix}_data binary")


class Index:
    """Cells of all rows; made once and asked often."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS):
        spark = rows.sparkSession
        self.cells = cells or max(1, min(4096, int(rows.count() ** 0.5)))
        self.centroids = centroids(rows, self.cells, id_col, vector, sample)
        assigned = saved(spark, _nearest(rows, id_col, vector, self.centroids, 1), "assigned")
        self.parts = saved(spark, assigned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")), "cells")
        dealt = assigned.join(F.broadcast(self.parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row for each of at most 4096 cells
        self.kind = assigned.schema["id"].dataType
        self.blocks = saved(spark, _blocks(dealt, self.centroids.shape[1], "r"), "cell-blocks")

    def topk(self, queries: DataFrame, k: int, probes: int, query_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, row_id, similarity, rank: the best ``k`` of the cells looked into; a row isn't its own result. Ties go to the lesser id. A vector without direction, or of another length than most, has similarity 0."""
        asked = _nearest(queries, query_id, vector, self.centroids, probes).join(F.broadcast(self.parts), "cell")
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = self.blocks.join(_blocks(asked, self.centroids.shape[1], "q"), ["cell", "part"]).select("r_ids", "r_dim", "r_data", "q_ids", "q_dim", "q_data")
        found = pairs.mapInArrow(*best_of_blocks(k, queries.schema[query_id].dataType, self.kind))
        first = W.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
        return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows that were found."""
    hits = exact.select("query_id", "row_id").join(found.select("query_id", "row_id"), ["query_id", "row_id"], "left_semi").count()
    return hits / max(1, exact.count())
