"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share a budget of words in proportion to their weights, but none gets more than ``max_epochs`` times
its own size; what a source can't take goes to the others by weight, until none is above its cap. Sorted by
cap over weight, the capped sources are a prefix, so one pass of running sums over the table of sources finds
the level, without iteration or collecting.

A source's target is then met by seeded repetitions: each document is taken ``floor(target / size)`` times
whole, and once more for as many documents, in the order of a seeded hash, as bring the words taken nearest
to the target. The place of a document in that order is found without sorting a source: sizes are summed by
the first digits of a row's key, and only the one slot in which the target falls is put in order. If that slot has more than
``SLOT_ROWS`` rows, it alone is summed again by more characters: of the hash, then of the size, of the row's content, and at
last of its place, for rows that are equal throughout. So a source, or an id, with a third of all rows is spread like any other, and
ids that don't repeat cost two scans.

Defined cases: a null text has size 0; so has one without words. A null source is a source, the last. A null id
is hashed by its text, and rows with the same hash stand in the order of size and then of all their columns, so that
reruns agree row by row; only rows that are equal throughout may stand for each other. A very long text is one row and only measured. An empty table gives no rows; a source without words gets target 0. Other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.llm.blocks import saved

#: Fixed weights, for sources by code point with null last.
WEIGHTS = (3, 1, 2)
#: Rows of the slot that is put in order, and the characters of the key by which slots are told at each step: hash 32, size 12, content 32, place 16.
SLOT_ROWS = 1 << 16
LEVELS = (3, 7, 44, 48, 52, 80, 84)
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """source, source_size -> with weight and target. One row for each source goes in."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    cap = F.col("source_size") * max_epochs
    order = W.orderBy(cap / F.col("weight"), "rank")
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = weighed.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") <= cap)
    final = leveled.withColumn("final", F.min(F.when(F.col("below"), F.struct(cap / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)["level"])
    return final.select("source", "source_size", "weight", F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") > cap), cap.cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


#: Rows of the table of sources up to which it is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: str = "mix", slot_rows: int = SLOT_ROWS, broadcast_sources: int = BROADCAST_SOURCES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` as struct ``row``, and size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    at = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.{id_col}").cast("string"), F.sha2(F.coalesce(F.col(f"row.{text_col}").cast("binary"), F.lit(b"")), 256))))
    size = F.coalesce(F.regexp_count(F.col(f"row.{text_col}"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place"))
    content = F.md5(F.col("row").cast("string").cast("binary"))
    whole_key = (at, F.lpad(size.cast("string"), 12, "0"), content, F.lower(F.lpad(F.hex(F.xxhash64("place")), 16, "0")))

    def placed(level: int) -> DataFrame:
        used = whole_key[: 1 if level <= 32 else 2 if level <= 44 else 3 if level <= 76 else 4]
        return rows.select("row", "place", F.col(f"row.{source_col}").alias("from"), F.substring(F.concat(*used), 1, level).alias("slot"))

    def summed(of: DataFrame) -> DataFrame:
        return saved(spark, of.groupBy(F.col("from").alias("source"), "slot").agg(F.sum(size).alias("slot_size"), F.count(F.lit(1)).alias("n")), "mix")

    def cut_at(targets: DataFrame, slots: DataFrame, start: Column) -> DataFrame:
        """The slot of each source in which the words still wanted after whole repetitions are reached, and the words before it."""
        ends = slots.select(F.col("source").alias("of"), F.struct(F.col("slot").alias("cut"), "slot_size", "n").alias("s"), F.sum("slot_size").over(W.partitionBy("source").orderBy("slot")).alias("end"))
        met = targets.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("end") + start > F.col("wanted")), "left")
        return met.groupBy("source", "source_size", "target", "whole", "wanted", *["start"] * ("start" in targets.columns)).agg(F.min(F.struct("s", "end")).alias("first")).select(
            "source", "source_size", "target", "whole", "wanted", F.col("first.s.cut").alias("cut"), F.col("first.s.n").alias("n"), (start + F.col("first.end") - F.col("first.s.slot_size")).alias("start")
        )

    levels = iter(LEVELS)
    level = next(levels)
    slots = summed(placed(level))
    targets = water_fill(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    small = slots.select("source").distinct().count() <= broadcast_sources
    plan = saved(spark, cut_at(targets, slots, F.lit(0)), "mix-plan")
    for finer in levels:
        if (plan.agg(F.max("n")).first()[0] or 0) <= slot_rows:
            break
        before, here = plan.drop("cut", "n"), plan.select(F.col("source").alias("in"), "cut")
        inside = placed(finer).join(F.broadcast(here) if small else here, F.col("from").eqNullSafe(F.col("in")) & (F.substring("slot", 1, level) == F.col("cut")))
        level, plan = finer, saved(spark, cut_at(before, summed(inside), F.col("start")), "mix-plan")
    if small:
        plan = F.broadcast(plan)
    placed = placed(level)

    met = F.col("from").eqNullSafe(F.col("source"))
    sure = placed.join(plan, met).where(~F.col("slot").eqNullSafe(F.col("cut")))
    sure = sure.select("*", size.alias("size"), F.when(F.col("slot") < F.col("cut"), 1).otherwise(0).alias("extra"))
    # Nearest: a document whose middle lies before the words wanted is taken.
    edge = placed.join(plan, met & (F.col("slot") == F.col("cut"))).select("*", size.alias("size"), F.concat(*whole_key).alias("at"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("from", "slot").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("extra", F.when(F.col("start") + before + F.col("size") / 2 <= F.col("wanted"), 1).otherwise(0)).drop("at")
    out = sure.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    return out.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB: the rows of op10_mix_sources.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, '')))) AS hx FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
o AS (SELECT *, source_size * 2 AS cap, CAST(source_size * 2 AS DOUBLE) / w AS ratio FROM s),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
  / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level FROM o),
f AS (SELECT (SELECT level FROM l WHERE level * w <= cap ORDER BY ratio, rk LIMIT 1) AS final),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * w > cap THEN CAST(cap AS DOUBLE) ELSE final * w END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
b AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS wanted,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hx, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN before + size / 2 <= wanted AND source_size > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM b
"""
