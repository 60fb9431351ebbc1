"""Bounded path patterns over typed edges: condition, parameter, mechanisms, quality.

Edges may not repeat within a path; nodes may. Hop counts are fixed, so every pattern is a chain of equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions.numeric import ordered_union

EMPTY = "array<string>"


def chains(edges: DataFrame, nodes: DataFrame, hops: int, first: str = "Parameter", inner: str = "Mechanism", last: str = "Quality", lead: Sequence[str] = ("AFFECTS",), between: Sequence[str] = ("AFFECTS", "DETERMINES"), end: Sequence[str] = ("AFFECTS",)) -> DataFrame:
    """Paths first -> inner (-> inner) x hops -> last: start, finish, node_keys, rels (id, confidence, source_refs), hops.

    ``edges``: id, type, src, dst, confidence, source_refs; ``nodes``: id, label, key.
    """
    rel = F.struct("id", "confidence", F.coalesce("source_refs", F.array().cast(EMPTY)).alias("source_refs"))
    labelled = edges.select("type", "src", "dst", rel.alias("rel")).join(nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"), F.col("key").alias("src_key")), "src")
    labelled = labelled.join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"), F.col("key").alias("dst_key")), "dst")

    def step(types: Sequence[str], source: str, target: str) -> DataFrame:
        return labelled.where(F.col("type").isin(*types) & (F.col("src_label") == source) & (F.col("dst_label") == target)).select("src", "dst", "src_key", "dst_key", "rel")

    head = step(lead, first, inner)
    path = head.select(F.col("src_key").alias("start"), F.col("dst").alias("at"), F.array("src_key", "dst_key").alias("node_keys"), F.array("rel").alias("rels"))
    for types, target in [*[(between, inner)] * hops, (end, last)]:
        nxt = step(types, inner, target).select("src", F.col("dst").alias("to"), F.col("dst_key").alias("to_key"), F.col("rel").alias("next"))
        path = path.join(nxt, F.col("at") == F.col("src")).where(~F.array_contains(F.transform("rels", lambda r: r["id"]), F.col("next.id")))
        path = path.select("start", F.col("to").alias("at"), F.array_append("node_keys", F.col("to_key")).alias("node_keys"), F.array_append("rels", F.col("next")).alias("rels"))
    return path.select("start", F.element_at("node_keys", -1).alias("finish"), "node_keys", "rels", F.lit(hops).alias("hops"))


def tails(edges: DataFrame, nodes: DataFrame, most_hops: int = 2, **pattern) -> DataFrame:
    return reduce(DataFrame.unionByName, [chains(edges, nodes, h, **pattern) for h in range(most_hops + 1)])


def distinct_chains(found: DataFrame) -> DataFrame:
    """One chain for each start and node sequence, the one with the least hops and edge ids."""
    w = W.partitionBy("start", "node_keys").orderBy("hops", F.transform("rels", lambda r: r["id"]))
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rules(edges: DataFrame, nodes: DataFrame, source: str = "Condition", target: str = "Parameter", kind: str = "SUGGESTS_ADJUSTMENT") -> DataFrame:
    """id, condition_code, parameter_code, target_change, confidence, condition_text, provenance_type, source_refs."""
    c = nodes.where(F.col("label") == source).select(F.col("id").alias("src"), F.col("key").alias("condition_code"))
    p = nodes.where(F.col("label") == target).select(F.col("id").alias("dst"), F.col("key").alias("parameter_code"))
    e = edges.where(F.col("type") == kind).join(c, "src").join(p, "dst")
    return e.select("id", "condition_code", "parameter_code", "target_change", "confidence", "condition_text", "provenance_type", F.coalesce("source_refs", F.array().cast(EMPTY)).alias("source_refs"))


def limits(edges: DataFrame, nodes: DataFrame, equipment_id: str | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """LIMITS rows, by equipment and parameter codes if given; no codes means no filter."""
    e = nodes.where("label = 'Equipment'").select(F.col("id").alias("src"), F.col("key").alias("equipment_id"))
    p = nodes.where("label = 'Parameter'").select(F.col("id").alias("dst"), F.col("key").alias("parameter_code"))
    out = edges.where("type = 'LIMITS'").join(e, "src").join(p, "dst").withColumnRenamed("id", "edge_id").drop("src", "dst", "type")
    if equipment_id is not None:
        out = out.where(F.col("equipment_id") == equipment_id)
    return out.where(F.col("parameter_code").isin(*codes)) if codes else out


def flat_limits(found: DataFrame) -> DataFrame:
    """One row for each limit, in the order of parameter codes and then of equipment."""
    return found.orderBy("parameter_code", "equipment_id", "edge_id")


def first_limits(found: DataFrame) -> DataFrame:
    w = W.partitionBy("parameter_code").orderBy("equipment_id", "edge_id")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grouped_limits(found: DataFrame) -> DataFrame:
    return found.groupBy("parameter_code").agg(F.array_sort(F.collect_list(F.struct("equipment_id", "edge_id"))).alias("equipment_limits"))


def path_sources(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    return edges.where(F.col("id").isin(*ids)).select("id", F.coalesce("source_refs", F.array().cast(EMPTY)).alias("source_refs"))


def reasoning_paths(diffs: DataFrame, rule_rows: DataFrame, tail_rows: DataFrame, limit: int = 5, quality: str | None = None, query: str = "requirement_id") -> DataFrame:
    """Candidate paths for each query's differences (query, ord, code).

    For each difference, paths with the same end and node sequence are one; at most ``limit`` stay, fewer hops and
    lesser sequences first. Ids number them through a query as p000, p001, ...
    """
    t = tail_rows if quality is None else tail_rows.where(F.col("finish") == quality)
    head = rule_rows.select(F.col("condition_code").alias("code"), "parameter_code", F.struct("id", "confidence", "source_refs").alias("head"))
    met = diffs.select(query, "ord", "code").join(head, "code").join(t, F.col("parameter_code") == F.col("start"))
    full = met.select(query, "ord", "code", "finish", "hops", F.concat(F.array("code"), "node_keys").alias("node_keys"), F.concat(F.array("head"), "rels").alias("rels"), "parameter_code")
    ids = F.transform("rels", lambda r: r["id"])
    one = W.partitionBy(query, "code", "finish", "node_keys").orderBy("ord", "hops", ids)
    full = full.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    few = W.partitionBy(query, "ord").orderBy("hops", "node_keys", ids)
    full = full.withColumn("__k", F.row_number().over(few)).where(F.col("__k") <= limit)
    number = F.row_number().over(W.partitionBy(query).orderBy("ord", "__k")) - 1
    return full.select(query, F.concat(F.lit("p"), F.lpad(number.cast("string"), 3, "0")).alias("path_id"), F.col("code").alias("difference_code"), "parameter_code", "hops", "node_keys", "rels", ordered_union(F.transform("rels", lambda r: r["source_refs"])).alias("source_refs"))


def knowledge_paths(rule_rows: DataFrame, chain_rows: DataFrame, query: Sequence[str] = ()) -> DataFrame:
    """Rules joined with the chains of their parameter; a parameter without chains keeps the rule alone.

    Confidence is the mean of those that edges have, rounded to 4; ids path_01, ... go by parameter, nodes and edges.
    """
    r = rule_rows.select(*query, "parameter_code", "condition_code", F.struct("id", "confidence", "source_refs").alias("head"))
    c = chain_rows.select(F.col("start"), F.col("node_keys").alias("chain"), F.col("rels").alias("chain_rels"))
    met = r.join(c, F.col("parameter_code") == F.col("start"), "left")
    rels = F.concat(F.array("head"), F.coalesce("chain_rels", F.array().cast("array<struct<id:string,confidence:double,source_refs:array<string>>>")))
    tail = F.when(F.col("chain").isNull(), F.array().cast(EMPTY)).otherwise(F.slice("chain", F.lit(2), F.size("chain")))
    met = met.select(*query, "parameter_code", F.concat(F.array("condition_code", "parameter_code"), tail).alias("node_codes"), rels.alias("rels"))
    known = F.filter(F.transform("rels", lambda x: x["confidence"]), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(F.lit(0.0))
    met = met.withColumn("relationship_ids", F.transform("rels", lambda x: x["id"])).withColumn("confidence", F.bround(mean, 4)).withColumn("source_refs", ordered_union(F.transform("rels", lambda x: x["source_refs"])))
    w = W.partitionBy(*query).orderBy("parameter_code", "node_codes", "relationship_ids")
    return met.withColumn("n", F.row_number().over(w)).withColumn("path_id", F.concat(F.lit("path_"), F.lpad(F.col("n").cast("string"), 2, "0"))).drop("n", "rels")


def valid_ids(chosen, allowed):
    """Chosen ids that are candidates, in order, and those that aren't."""
    return F.array_intersect(chosen, allowed), F.array_except(chosen, allowed)
