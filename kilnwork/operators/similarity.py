"""Similar rows: hard filter by an equality key, weighted scores over fields that both sides have, top k."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions.numeric import TINY, cat_sim, cosine_sim, num_sim
from kilnwork.model import Field, Retrieval
from kilnwork.sources.shared import saved

Side = Callable[[str], Column]


def structured_score(fields: Sequence[Field], left: Side, right: Side) -> tuple[Column, Column]:
    """(score, map of scores by field). Fields that a side lacks don't count, and the other weights are scaled up; 0 without any."""
    total, weight, names, values = F.lit(0.0), F.lit(0.0), [], []
    for f in fields:
        s = (num_sim if f.numeric else cat_sim)(left(f.name), right(f.name))
        total = total + F.coalesce(s * f.weight, F.lit(0.0))
        weight = weight + F.when(s.isNotNull(), F.lit(f.weight)).otherwise(F.lit(0.0))
        names.append(F.lit(f.name))
        values.append(F.bround(s, 6))
    by_field = F.map_filter(F.map_from_arrays(F.array(*names), F.array(*values)), lambda _, v: v.isNotNull())
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0)), by_field


#: Rows of one key that are compared at once: small blocks as long as there are few, then larger ones, less large with vectors; queries in a block; pairs of numbers in memory; and bytes of blocks sent to Python at once.
FEW_BLOCKS, SMALL_BLOCK, LARGE_BLOCK, LARGE_BLOCK_OF_VECTORS, QUERIES_IN_BLOCK, PAIRS, SENT_BYTES = 64, 2_048, 65_536, 8_192, 1_000, 1 << 18, 8 << 20


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit rows of the vectors that have a direction, by their length."""
    flat, sizes = column.flatten(), np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    values, missing = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    out = {}
    with np.errstate(all="ignore"):
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dim)
            cells = starts[at][:, None] + np.arange(dim)
            m = values[cells]
            norm = np.sqrt((m * m).sum(1))
            some = ~missing[cells].any(1) & ~(norm == 0)
            out[dim] = at[some], m[some] / norm[some][:, None]
    return out


def candidates_of_blocks(fields: Sequence[Field], k: int, cfg: Retrieval, embedded: bool, slack: float, kinds: tuple[pa.DataType, pa.DataType]):
    """For mapInArrow over (r, q), arrays of structs (id, a field each, vector) with rows in the order of ids: pairs that may be among a query's ``k`` best of the block.

    A pair's rounded score lies between ``lo`` and ``hi`` millionths, which differ only where the score is within ``slack`` of a half. ``k`` rows come before
    all that are left out: those of the greatest ``lo``, at equal ones of the lesser ids.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                r, q = batch.column(0)[x].values, batch.column(1)[x].values
                n, sides = len(r), []
                for at, f in enumerate(fields, 1):
                    rv, qv = r.field(at), q.field(at)
                    if f.numeric:
                        rv, qv = rv.cast(pa.float64()), qv.cast(pa.float64())
                        values = [v.to_numpy(zero_copy_only=False) for v in (rv, qv)]
                    else:
                        codes = pa.concat_arrays([rv, qv]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                        values = [codes[:n], codes[n:]]
                    sides.append((f, *values, *[v.is_null().to_numpy(zero_copy_only=False) for v in (rv, qv)]))
                rm, qm = (_vectors(v.field(len(fields) + 1)) if embedded else {} for v in (r, q))
                step = max(1, PAIRS // max(1, n))
                for a in range(0, len(q), step):
                    z = min(a + step, len(q))
                    total, weight = np.zeros((z - a, n)), np.zeros((z - a, n))
                    with np.errstate(all="ignore"):
                        for f, rv, qv, rn, qn in sides:
                            one = qv[a:z, None]
                            if f.numeric:
                                s = np.abs(one - rv)
                                s /= np.maximum(np.maximum(np.abs(one), np.abs(rv)), TINY)
                                np.subtract(1.0, s, out=s)
                                np.maximum(s, 0.0, out=s)
                            else:
                                s = (one == rv).astype(np.float64)
                            s *= f.weight
                            if rn.any() or qn[a:z].any():
                                known = ~(qn[a:z, None] | rn)
                                total += np.where(known, s, 0.0)
                                weight += np.where(known, f.weight, 0.0)
                            else:
                                total += s
                                weight += f.weight
                        total = cfg.structured_weight * np.where(weight > 0, total / weight, 0.0)
                        for dim in rm.keys() & qm.keys():
                            (ra, ru), (qa, qu) = rm[dim], qm[dim]
                            mine = (qa >= a) & (qa < z)
                            m = np.clip(qu[mine] @ ru.T, 0.0, 1.0)
                            total[np.ix_(qa[mine] - a, ra)] += cfg.semantic_weight * np.where(np.isnan(m), 1.0, m)
                    total[np.isnan(total)] = np.inf  # as Spark orders them
                    least = np.partition(total, n - k, 1)[:, n - k] if n > k else np.full(z - a, -np.inf)
                    i, j = np.nonzero(total >= (least - 1e-6 - 2 * slack)[:, None])
                    lo, hi = np.ceil((total[i, j] - slack) * 1e6 - 0.5), np.floor((total[i, j] + slack) * 1e6 + 0.5)
                    order = np.lexsort((j, -lo, i))
                    i, j, lo, hi = i[order], j[order], lo[order], hi[order]
                    first = np.searchsorted(i, np.arange(z - a))
                    place, last = np.arange(len(i)) - first[i], lo[np.minimum(first + k - 1, len(lo) - 1)] if len(lo) else lo
                    kept = (place < k) | (hi > last[i]) | ((hi == last[i]) & (lo < hi))
                    i, j = pa.array(i[kept] + a), pa.array(j[kept])
                    yield pa.record_batch([q.field(0).take(i).cast(kinds[0]), r.field(0).take(j).cast(kinds[1]), pa.array(lo[kept]), pa.array(hi[kept])], names=["__q", "__r", "lo", "hi"])

    return best


def candidates(queries: DataFrame, rows: DataFrame, on: str, fields: Sequence[Field], query_id: str, row_id: str, k: int, cfg: Retrieval, embedding: str | None) -> DataFrame:
    """(__q, __r): ids of queries and rows, among which are the k best rows of each query, and few others.

    Rows of equal key, fields and vector have equal scores, so only their k least ids are compared. The rest is dealt out by key, and within a key by hashes of the ids, in
    blocks; a query goes to each block of its key, as numbers in arrays, and leaves it with its best k.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, names = queries.sparkSession, [f"__f{i}" for i in range(len(fields))]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT_BYTES))
    vector = [F.col(embedding).cast("array<double>").alias("__e")] if embedding else []
    slim = lambda df, i: df.where(F.col(on).isNotNull()).select(F.col(on).alias("__on"), F.col(i).alias("__id"), *[(F.col(f.name) if f.numeric else F.col(f.name).cast("string")).alias(n) for f, n in zip(fields, names)], *vector)
    columns = ["__id", *names, *["__e"][: len(vector)]]
    r = slim(rows, row_id).withColumn("__n", F.row_number().over(W.partitionBy("__on", *columns[1:]).orderBy("__id"))).where(F.col("__n") <= k).drop("__n")
    r = saved(spark, r, "compared")
    n, most = F.col("__n"), F.lit(LARGE_BLOCK_OF_VECTORS if vector else LARGE_BLOCK)
    small = F.ceil(n / SMALL_BLOCK)
    parts = r.groupBy("__on").agg(F.count(F.lit(1)).alias("__n")).select(F.col("__on"), F.when(small <= FEW_BLOCKS, small).otherwise(F.greatest(F.lit(FEW_BLOCKS), F.ceil(n / most))).cast("int").alias("__parts"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = r.join(parts, "__on").withColumn("__part", F.pmod(F.xxhash64("__id", *names), F.col("__parts")).cast("int")).repartition(width, "__on", "__part")
    blocks = dealt.groupBy("__on", "__part").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("r"))
    q = slim(queries, query_id)
    asked = q.groupBy("__on").agg(F.ceil(F.count(F.lit(1)) / QUERIES_IN_BLOCK).cast("int").alias("__few")).join(parts, "__on")
    q = q.join(asked, "__on").groupBy("__on", "__parts", F.pmod(F.xxhash64("__id", *names), F.col("__few")).alias("__own")).agg(F.collect_list(F.struct(*columns)).alias("q"))
    q = q.select("__on", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "q")
    kinds = queries.schema[query_id].dataType, rows.schema[row_id].dataType
    slack = 1e-5 if any(f.numeric and df.schema[f.name].dataType.typeName() == "decimal" for f in fields for df in (queries, rows)) else 1e-9
    score = candidates_of_blocks(fields, k, cfg, bool(vector), slack, tuple(map(to_arrow_type, kinds)))
    found = blocks.join(q.hint("shuffle_hash"), ["__on", "__part"]).select("r", "q").mapInArrow(score, f"__q {kinds[0].simpleString()}, __r {kinds[1].simpleString()}, lo double, hi double")
    best = found.withColumn("__at", F.row_number().over(W.partitionBy("__q").orderBy(F.desc("lo"), "__r")))
    best = best.withColumn("__last", F.max(F.when(F.col("__at") == k, F.col("lo"))).over(W.partitionBy("__q")))
    kept = (F.col("__at") <= k) | (F.col("hi") > F.col("__last")) | ((F.col("hi") == F.col("__last")) & (F.col("lo") < F.col("hi")))
    return best.where(kept).select("__q", "__r").distinct()


def similar_rows(queries: DataFrame, rows: DataFrame, on: str, fields: Sequence[Field], query_id: str, row_id: str, k: int, cfg: Retrieval = Retrieval(), embedding: str | None = None) -> DataFrame:
    """The k best rows of each query: q (struct), r (struct), structured_score, semantic_score, total_score, field_scores, rank.

    Ties go to the lesser row id. A missing embedding counts as similarity 0, without scaling the other weight up.
    Whole rows meet only where blocks of numbers have shown that the pair may be among the best, and are scored then in columns.
    """
    near = candidates(queries, rows, on, fields, query_id, row_id, k, cfg, embedding)
    q = queries.select(F.struct("*").alias("q"))
    r = rows.select(F.struct("*").alias("r"))
    asked = near.join(q, F.col("__q").eqNullSafe(F.col(f"q.{query_id}")))
    pairs = asked.join(r, F.col("__r").eqNullSafe(F.col(f"r.{row_id}"))).where(F.col(f"q.{on}") == F.col(f"r.{on}"))
    structured, by_field = structured_score(fields, lambda f: F.col(f"q.{f}"), lambda f: F.col(f"r.{f}"))
    semantic = cosine_sim(F.col(f"q.{embedding}"), F.col(f"r.{embedding}")) if embedding else F.lit(0.0)
    scored = pairs.select("q", "r", structured.alias("s"), semantic.alias("m"), by_field.alias("field_scores"))
    total = F.bround(cfg.structured_weight * F.col("s") + cfg.semantic_weight * F.col("m"), 6)
    scored = scored.select("q", "r", F.bround("s", 6).alias("structured_score"), F.bround("m", 6).alias("semantic_score"), total.alias("total_score"), "field_scores")
    best = W.partitionBy(f"q.{query_id}").orderBy(F.desc("total_score"), F.col(f"r.{row_id}"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Queries and rows that are compared at once, and queries and bytes of their vectors up to which their blocks are broadcast.
QUERY_BLOCK, ROW_BLOCK, BROADCAST_QUERIES, BROADCAST_BYTES = 1_000, 4_096, 4_096, 32 << 20


def _packed(df: DataFrame, id_col: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Blocks of rows: their ids, and their vectors of one length as a matrix of unit rows (zeros where there is no direction)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    ids = to_arrow_type(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(vectors).to_pylist()])
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                for a in range(0, len(mine), size):
                    part = pa.array(mine[a : a + size])
                    values = pc.fill_null(vectors.take(part).flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) if dim else np.zeros(0)
                    m = np.asarray(values, np.float64).reshape(len(part), dim)
                    norm = np.sqrt((m * m).sum(1, keepdims=True))
                    unit = np.where(norm > 0, m / np.where(norm > 0, norm, 1.0), 0.0)
                    yield pa.record_batch([pa.array([batch.column(0).take(part).to_pylist()], pa.list_(ids)), pa.array([dim], pa.int32()), pa.array([np.nan_to_num(unit).tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_dim", f"{prefix}_data"])

    return df.select(F.col(id_col), F.col(vector)).mapInArrow(pack, f"{prefix}_ids array<{kind.simpleString()}>, {prefix}_dim int, {prefix}_data binary")


def best_of_blocks(k: int, q_kind, r_kind):
    """For mapInArrow over pairs of blocks (r_ids, r_dim, r_data, q_ids, q_dim, q_data): each query's best ``k`` of each block, and the schema."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(q_kind), to_arrow_type(r_kind), pa.float64()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r_ids, r_dim, r_data, q_ids, q_dim, q_data in zip(*(c.to_pylist() for c in batch.columns)):
                r, q = np.array(r_ids), np.array(q_ids)
                turn = np.argsort(r, kind="stable")
                r = r[turn]
                if q_dim == r_dim and q_dim:
                    m = np.frombuffer(r_data).reshape(-1, r_dim)[turn]
                    s = np.round(np.clip(np.frombuffer(q_data).reshape(-1, q_dim) @ m.T, 0.0, 1.0), 6)
                else:
                    s = np.zeros((len(q), len(r)))
                s[q[:, None] == r] = -1.0
                least = np.partition(s, -k, 1)[:, -k] if len(r) > k else np.full(len(q), 0.0)
                i, j = np.nonzero((s >= least[:, None]) & (s >= 0))
                order = np.lexsort((j, -s[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                yield pa.record_batch([pa.array(x.tolist(), t) for x, t in zip((q[i], r[j], s[i, j]), kinds)], names=["query_id", "row_id", "similarity"])

    return best, f"query_id {q_kind.simpleString()}, row_id {r_kind.simpleString()}, similarity double"


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "vec_id", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact top k by cosine over all rows, for any number of queries: query_id, row_id, similarity, rank.

    Queries and rows meet as blocks, and a pair of blocks is one product of matrices that gives each query's best k of the
    block; the best of these are the result. Blocks of queries up to BROADCAST_QUERIES and BROADCAST_BYTES are broadcast; beyond, they are dealt out against parts of the rows, whose blocks are written once.
    A vector that is missing, empty or null has similarity 0 to all, so have vectors of different lengths. Ties go to the lesser id.
    """
    q = _packed(queries, query_id, vector, QUERY_BLOCK, "q")
    n, longest = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    few = n <= BROADCAST_QUERIES and n * 8 * max(1, longest or 0) <= BROADCAST_BYTES
    blocks = _packed(rows, row_id, vector, ROW_BLOCK, "r")
    pairs = blocks.join(F.broadcast(q)) if few else saved(rows.sparkSession, blocks, "vectors").join(q.hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(*best_of_blocks(k, queries.schema[query_id].dataType, rows.schema[row_id].dataType))
    first = W.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def requirement_text(labels: dict[str, str], sep: str = "，") -> Column:
    """Labelled fields that aren't null, joined."""
    return F.concat_ws(sep, *[F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c).cast("string"))) for c, label in labels.items()])


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def diverse_bases(matches: DataFrame, query: Sequence[str], condition_key: Sequence[str], signature: str, order: Sequence[Column], count: int) -> DataFrame:
    """Up to ``count`` rows of each query: one for each condition key (nulls equal), unseen signatures first, then by order.

    Taking rows in order, keeping those with a new signature and filling up with the others in order, is the same
    as sorting by whether the signature came before.
    """
    first = W.partitionBy(*query, *condition_key).orderBy(*order)
    kept = matches.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    seen = W.partitionBy(*query, signature).orderBy(*order)
    kept = kept.withColumn("__seen", F.row_number().over(seen) > 1)
    pick = W.partitionBy(*query).orderBy(F.col("__seen"), *order)
    return kept.withColumn("base_rank", F.row_number().over(pick)).where(F.col("base_rank") <= count).drop("__seen")
