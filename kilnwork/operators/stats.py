"""Robust statistics by group: weighted median, dispersion, quantiles, deltas, conflicts, consensus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "weighted_median") -> DataFrame:
    """The first value, in ascending order, at which half of the group's weight is reached. Equal values are summed first, so a group never has to fit one row per input row; null without positive weight."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    run = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    at = sums.withColumn("__c", F.sum("__w").over(run)).withColumn("__t", F.sum("__w").over(W.partitionBy(*keys)))
    return at.groupBy(*keys).agg(F.min(F.when((F.col("__t") > 0) & (F.col("__c") >= F.col("__t") / 2), F.col(value))).alias(out))


def mad_dispersion(df: DataFrame, keys: Sequence[str], value: str, out: str = "dispersion") -> DataFrame:
    """min(1, MAD / |median|) with upper medians; null for fewer than two values. Uses ranks over counted values, not collected lists."""

    def upper(x: DataFrame, c: str, name: str) -> DataFrame:
        n = x.groupBy(*keys, c).agg(F.sum("__n").alias("__n"))
        n = n.withColumn("__c", F.sum("__n").over(W.partitionBy(*keys).orderBy(c).rowsBetween(W.unboundedPreceding, 0))).withColumn("__t", F.sum("__n").over(W.partitionBy(*keys)))
        return n.groupBy(*keys).agg(F.min(F.when(F.col("__c") > F.floor(F.col("__t") / 2), F.col(c))).alias(name), F.max("__t").alias(f"{name}_n"))

    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    mid = upper(counted, value, "__m")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = counted.alias("a").join(mid.alias("b"), same, "inner").select(*[F.col(f"a.{k}").alias(k) for k in keys], F.abs(F.col(value) - F.col("__m")).alias("__d"), "__n", "__m")
    mad = upper(met, "__d", "__mad").join(mid.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__m"), [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return mad.select(*keys, F.when(F.col("__mad_n") >= 2, F.least(F.lit(1.0), F.col("__mad") / F.greatest(F.abs("__m"), F.lit(1e-9)))).alias(out))


#: Parts of a group's values when its quantiles are counted, a power of two.
PARTS = 128


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation, exact; groups of any size, as no group's values have to meet in one place.

    Equal values are counted, and the counts are summed by part of the group, which spreads it over ``PARTS`` keys; the parts' limits are
    approximate quantiles of its distinct values, so an outlier doesn't gather all others in one part. The two order statistics of each quantile then lie in parts known from those sums, and only these parts go on, to
    have running sums made within. Nulls don't count; a group without values has null quantiles.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    counted = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], v.alias("__v")).agg(F.count(v).alias("__n"))
    same = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    span = counted.groupBy(*names).agg(F.sum("__n").alias("__all"), F.percentile_approx("__v", [i / PARTS for i in range(1, PARTS)], 1000).alias("__limits"))
    placed = counted.where("__n > 0").alias("a").join(F.broadcast(span).alias("b") if not keys else span.alias("b"), same("a", "b") or None, "inner" if names else "cross").select(*[F.col(f"a.{n}") for n in names], "__v", "__n", "__all", "__limits", F.lit(0).alias("__part"))
    step = PARTS // 2
    while step:  # the number of limits below the value, by halves
        placed, step = placed.withColumn("__part", F.col("__part") + F.when(F.get("__limits", F.col("__part") + (step - 1)) < F.col("__v"), step).otherwise(0)), step // 2
    placed = placed.drop("__limits")
    sums = placed.groupBy(*names, "__part").agg(F.sum("__n").alias("__m"), F.max("__all").alias("__all"))
    starts = sums.withColumn("__before", F.sum("__m").over(W.partitionBy(*names).orderBy("__part")) - F.col("__m"))
    holds = [(F.col("__before") <= f(F.lit(q) * (F.col("__all") - 1))) & (f(F.lit(q) * (F.col("__all") - 1)) < F.col("__before") + F.col("__m")) for q in at.values() for f in (F.floor, F.ceil)]
    starts = starts.where(reduce(or_, holds)).drop("__m", "__all")
    met = placed.alias("a").join(starts.alias("b"), [*same("a", "b"), F.col("a.__part") == F.col("b.__part")]).select("a.*", "b.__before")
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy(*names, "__part").orderBy("__v"))
    met = met.withColumn("__upto", upto)
    aggregates = []
    for name, q in at.items():
        spot = F.lit(q) * (F.col("__all") - 1)  # counted from 0
        low, high = (F.min(F.when(F.col("__upto") > f(spot), F.col("__v"))) for f in (F.floor, F.ceil))
        aggregates.append((low + (high - low) * F.max(spot - F.floor(spot))).alias(name))
    found = met.groupBy(*names).agg(*aggregates)
    every = span.select(*names).alias("a").join(found.alias("b"), same("a", "b") or F.lit(True), "left")
    return every.select(*[F.col(f"a.{n}").alias(k) for n, k in zip(names, keys)], *[F.col(f"b.{name}") for name in at])


def directions(df: DataFrame, keys: Sequence[str], change: str) -> DataFrame:
    """keys, n_changes, direction: null if rules contradict each other or name no direction. Unknown is a change of its own."""
    token = F.coalesce(F.col(change), F.lit("?"))
    out = df.groupBy(*keys).agg(F.countDistinct(token).alias("n_changes"), F.min(token).alias("one"))
    return out.select(*keys, "n_changes", F.when((F.col("n_changes") == 1) & F.col("one").isin("increase", "decrease"), F.col("one")).alias("direction"), (F.col("n_changes") > 1).alias("conflict"))


def sign_fits(delta: Column, direction: Column) -> Column:
    return ((direction == "increase") & (delta > 0)) | ((direction == "decrease") & (delta < 0))


def delta_estimates(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From rows (keys, direction, base_value, support_value, weight, same_material, support_id, support_rank) one row for each key.

    Deltas against the direction are dropped and counted. If any fitting delta comes from the same material,
    only those count. raw_delta null means that the caller falls back on one step.
    """
    d = pairs.withColumn("delta", F.col("support_value") - F.col("base_value"))
    d = d.withColumn("fits", F.coalesce(sign_fits(F.col("delta"), F.col("direction")), F.lit(False)))
    same = F.max(F.when(F.col("fits"), F.col("same_material"))).over(W.partitionBy(*keys))
    d = d.withColumn("used", F.col("fits") & (~F.coalesce(same, F.lit(False)) | F.col("same_material")))
    known = F.col("base_value").isNotNull()
    # Supports of a key are a retrieval's top k (at most five), so their lists are short.
    used = F.array_sort(F.collect_list(F.when(F.col("used"), F.struct("support_rank", "support_id", "delta"))))
    counts = d.groupBy(*keys).agg(
        F.count(F.when(F.col("used"), 1)).alias("n_valid"),
        F.count(F.when(known & F.col("support_value").isNotNull() & ~F.col("fits"), 1)).alias("n_filtered"),
        F.count(F.when(known & F.col("support_value").isNull() & F.col("support_id").isNotNull(), 1)).alias("n_missing"),
        used.alias("used"),
        F.percentile(F.when(F.col("used"), F.abs("delta")), F.lit(0.33)).alias("q33"),
        F.percentile(F.when(F.col("used"), F.abs("delta")), F.lit(0.67)).alias("q67"),
    )
    valid = d.where("used")
    medians = weighted_median(valid, keys, "delta", "weight", "raw_delta")
    spread = mad_dispersion(valid, keys, "delta")
    return counts.join(medians, list(keys), "left").join(spread, list(keys), "left").withColumn("fallback", F.col("raw_delta").isNull())


def pairwise_consensus(values: DataFrame, group: str, member: str, item: str, value: str) -> DataFrame:
    """(group, member, consensus): mean closeness to the other members' values of the same items, less for fewer than three members.

    ``values`` has one row for each member and item; the number of members is that of the group.
    """
    a, b = values.alias("a"), values.alias("b")
    close = F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) / F.greatest(F.abs(F.col(f"a.{value}")), F.abs(F.col(f"b.{value}")), F.lit(1e-9)))
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{member}") != F.col(f"b.{member}")))
    mean = pairs.groupBy(F.col(f"a.{group}").alias(group), F.col(f"a.{member}").alias(member)).agg(F.avg(close).alias("close"))
    members = values.groupBy(group).agg(F.countDistinct(member).alias("n_members"))
    everyone = values.select(group, member).distinct().join(members, group).join(mean, [group, member], "left")
    return everyone.select(group, member, F.bround(F.coalesce("close", F.lit(0.0)) * F.least(F.lit(1.0), (F.col("n_members") - 1) / 2.0), 4).alias("consensus"))


def backfilled(kept: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``kept``, and the rows of ``best`` for the keys of which it has none; ``backfilled`` tells which."""
    missing = best.join(kept.select(*keys).distinct(), list(keys), "left_anti")
    return kept.withColumn("backfilled", F.lit(False)).unionByName(missing.withColumn("backfilled", F.lit(True)))


def argmax_ties(df: DataFrame, keys: Sequence[str], score: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose score is the group's greatest, ties kept. Maxima are taken before anything is shuffled, so a large group is a join that can be split."""
    best = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(score).alias("__best"))
    met = df.join(best, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return met.where(F.col(score) >= F.col("__best") - tolerance).select(*[F.col(f"`{c}`") for c in df.columns])
