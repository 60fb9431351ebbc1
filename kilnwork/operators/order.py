"""Order-dependent operators over windows: runs, gaps, clusters, nesting, numbering, fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.sources.shared import saved


def class_transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """Rows whose class differs from the class before, with ``before``; rows without a class don't count."""
    known = df.where(F.col(kind).isNotNull())
    return known.withColumn("before", F.lag(kind).over(W.partitionBy(*keys).orderBy(*order))).where(F.col("before") != F.col(kind))


def linear_gap_fill(df: DataFrame, keys: Sequence[str], position: str, number: str) -> DataFrame:
    """Adds ``filled``: the number itself, or what lies between two neighbouring numbers if they grow as the positions do."""
    back = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(position).rowsBetween(0, W.unboundedFollowing)
    mark = F.when(F.col(number).isNotNull(), F.struct(F.col(position).alias("p"), F.col(number).alias("n")))
    a, b = F.last(mark, True).over(back), F.first(mark, True).over(ahead)
    d = df.withColumn("__a", a).withColumn("__b", b)
    fits = (F.col("__b.n") - F.col("__a.n")) == (F.col("__b.p") - F.col("__a.p"))
    return d.withColumn("filled", F.coalesce(F.col(number), F.when(fits, F.col("__a.n") + F.col(position) - F.col("__a.p")))).drop("__a", "__b")


def nonlinear_gaps(df: DataFrame, keys: Sequence[str], position: str, number: str) -> DataFrame:
    """Neighbouring numbers more than one position apart that don't grow as the positions do."""
    w = W.partitionBy(*keys).orderBy(position)
    d = df.where(F.col(number).isNotNull()).select(*keys, F.lag(position).over(w).alias("p0"), F.lag(number).over(w).alias("n0"), F.col(position).alias("p1"), F.col(number).alias("n1"))
    return d.where((F.col("p1") - F.col("p0") > 1) & (F.col("n1") - F.col("n0") != F.col("p1") - F.col("p0")))


def duplicate_numbers(df: DataFrame, keys: Sequence[str], position: str, number: str) -> DataFrame:
    """Rows whose number an earlier position holds, with that position as ``first_at``."""
    w = W.partitionBy(*keys, number)
    return df.where(F.col(number).isNotNull()).withColumn("first_at", F.min(position).over(w)).where(F.col(position) > F.col("first_at"))


def first_regression(df: DataFrame, keys: Sequence[str], position: str, number: str) -> DataFrame:
    """The first place at which the number falls, for each key."""
    w = W.partitionBy(*keys).orderBy(position)
    d = df.where(F.col(number).isNotNull()).withColumn("before", F.lag(number).over(w)).where(F.col(number) < F.col("before"))
    return d.groupBy(*keys).agg(F.min_by(F.struct(F.col(position).alias("at"), "before", F.col(number).alias("after")), F.col(position)).alias("r")).select(*keys, "r.*")


def cluster_1d(df: DataFrame, keys: Sequence[str], value: str, tie: str, gap: float) -> DataFrame:
    """Adds ``cluster``, from 0: a new one wherever the next greater value is more than ``gap`` away."""
    w = W.partitionBy(*keys).orderBy(value, tie)
    far = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__far", far).withColumn("cluster", F.sum("__far").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__far")


def parents(df: DataFrame, keys: Sequence[str], position: str, level: str, levels: int = 6) -> DataFrame:
    """Adds ``parent_at``: the nearest earlier position with a lower level; null without one."""
    w = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(position)), True).over(w) for k in range(1, levels)]
    named = df.select("*", *[c.alias(f"__l{k}") for k, c in enumerate(last, 1)])
    at = F.greatest(*[F.when(F.col(level) > k, F.col(f"__l{k}")) for k in range(1, levels)], F.lit(None).cast("long"))
    return named.withColumn("parent_at", at).drop(*[f"__l{k}" for k in range(1, levels)])


def ends(df: DataFrame, keys: Sequence[str], position: str, level: str, levels: int = 6) -> DataFrame:
    """Adds ``next_at``: the nearest later position with the same or a lower level; null without one."""
    w = W.partitionBy(*keys).orderBy(position).rowsBetween(1, W.unboundedFollowing)
    nxt = [F.first(F.when(F.col(level) == k, F.col(position)), True).over(w) for k in range(1, levels + 1)]
    named = df.select("*", *[c.alias(f"__n{k}") for k, c in enumerate(nxt, 1)])
    at = F.least(*[F.when(F.col(level) >= k, F.col(f"__n{k}")) for k in range(1, levels + 1)], F.lit(None).cast("long"))
    return named.withColumn("next_at", at).drop(*[f"__n{k}" for k in range(1, levels + 1)])


def bind_last(df: DataFrame, keys: Sequence[str], position: str, marker: Column, out: str) -> DataFrame:
    """Adds the last value of ``marker`` at or before each row."""
    return df.withColumn(out, F.last(marker, True).over(W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)))


def level_numbers(sections: DataFrame, keys: Sequence[str], position: str, level: str, own: str, parent: str = "parent_at", levels: int = 6) -> DataFrame:
    """Adds ``number``: the parent's number and the own one, made unique by -2, -3, ... in order of position.

    Levels follow one another, as a parent's number has to be final; each is written, so the plan doesn't double.
    """
    spark, out = sections.sparkSession, None
    sections = saved(spark, sections, "levels")
    for k in range(1, levels + 1):
        at = sections.where(F.col(level) == k)
        if out is None:
            at = at.withColumn("base", F.col(own))
        else:
            up = out.select(*[F.col(x).alias(f"__{x}") for x in keys], F.col(position).alias("__p"), F.col("number").alias("__number"))
            met = [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in keys]
            at = at.join(up, [*met, F.col(parent) == F.col("__p")], "left").drop("__p", *[f"__{x}" for x in keys])
            bare = F.regexp_replace("__number", "^front:", "")
            at = at.withColumn("base", F.when(F.col("__number").isNull(), F.col(own)).otherwise(F.concat_ws(".", bare, F.col(own)))).drop("__number")
        n = F.row_number().over(W.partitionBy(*keys, "base").orderBy(position))
        at = at.withColumn("number", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n))).drop("base")
        at = saved(spark, at, f"level-{k}")
        out = at if out is None else out.unionByName(at)
    return out


def ancestor_titles(sections: DataFrame, keys: Sequence[str], position: str, title: str, parent: str = "parent_at", levels: int = 6) -> DataFrame:
    """Adds ``path``: the titles from the top down to the row's own."""
    out = sections.withColumn("path", F.array(title)).withColumn("__up", F.col(parent))
    for _ in range(levels - 1):
        up = sections.select(*[F.col(x).alias(f"__{x}") for x in keys], F.col(position).alias("__p"), F.col(title).alias("__t"), F.col(parent).alias("__pp"))
        met = [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in keys]
        out = out.join(up, [*met, F.col("__up") == F.col("__p")], "left")
        out = out.withColumn("path", F.when(F.col("__t").isNull(), F.col("path")).otherwise(F.concat(F.array("__t"), "path"))).withColumn("__up", F.col("__pp")).drop("__p", "__t", "__pp", *[f"__{x}" for x in keys])
    return out.drop("__up")


def level_jumps(sections: DataFrame, keys: Sequence[str], position: str, level: str, parent: str = "parent_at") -> DataFrame:
    """Rows more than one level below their parent; top rows are none."""
    up = sections.select(*[F.col(x).alias(f"__{x}") for x in keys], F.col(position).alias("__p"), F.col(level).alias("parent_level"))
    met = [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in keys]
    return sections.join(up, [*met, F.col(parent) == F.col("__p")]).where(F.col(level) > F.col("parent_level") + 1).drop("__p", *[f"__{x}" for x in keys])


def islands(df: DataFrame, keys: Sequence[str], position: str, boundary: Column) -> DataFrame:
    """Adds ``island``: how many boundaries lie at or before the row."""
    w = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.coalesce(boundary.cast("int"), F.lit(0))).over(w).cast("int"))


def fuse(df: DataFrame, keys: Sequence[str], position: str, text: str, sep: str = "") -> DataFrame:
    """One row for each key: the texts joined in order, the number of members and the first and last position."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias("text"), F.count(F.lit(1)).alias("n_members"), F.min(position).alias("first_at"), F.max(position).alias("last_at"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


#: Rows of a task of windows, whose sorts lie in memory together.
TASK_ROWS = 250_000


def spread(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``n`` rows by key in as many partitions as keep a task's share where it is, however many rows there are: windows by the keys then use these."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(width, -(-n // TASK_ROWS)), *keys)


def running_numbers(df: DataFrame, groups: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """Numbers 1, 2, ... through all rows, groups in order, without one window over all rows: counts by group first, then places within."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy(*groups).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    met = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    both = df.alias("a").join(before.alias("b"), met).select("a.*", "b.__before")
    return both.withColumn(out, F.col("__before") + F.row_number().over(W.partitionBy(*groups).orderBy(*order))).drop("__before")


def crossline(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_heading: Column, level: Column, top: Column, bottom: Column, gap: float = 40) -> DataFrame:
    """Adds ``merged``: whether the next row is a heading, too, both of level 1 and close below."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__h", is_heading).withColumn("__l", level).withColumn("__t", top).withColumn("__b", bottom)
    nxt = lambda c: F.lead(c).over(w)
    merged = F.col("__h") & nxt("__h") & (F.col("__l") == 1) & (nxt("__l") == 1) & (nxt("__t") - F.col("__b") < gap)
    return d.withColumn("merged", F.coalesce(merged, F.lit(False))).drop("__h", "__l", "__t", "__b")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
