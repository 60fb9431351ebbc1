"""Validated, idempotent ingest: normalise, validate against a whitelist, classify by hash, write all or nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.model import GraphSchema

CONCEPTS = ("Condition", "Parameter", "Mechanism", "Quality", "Equipment")


def props_hash(*columns: str) -> Column:
    """A hash of named values, the same whatever their order."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def trimmed(df: DataFrame) -> DataFrame:
    """Strings and lists of strings without white space at both ends."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.trim(c) if kind == "string" else F.transform(c, lambda x: F.trim(x)) if kind == "array<string>" else c).alias(f.name))
    return df.select(*out)


def _first_of(keys: Sequence[str], order: str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(order))


def duplicate_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows after the first of each key."""
    return df.withColumn("__n", _first_of(keys, order)).where("__n > 1").drop("__n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_nodes(nodes: DataFrame, schema: GraphSchema = GraphSchema()) -> DataFrame:
    """(ord, id, error) for nodes (ord, id, label, key, name, definition, layer, source_refs)."""
    concept = F.col("label").isin(*CONCEPTS)
    checks = [
        (~F.col("label").isin(*schema.keys), "unknown_label"),
        (F.col("id_n") > 1, "duplicate_id"),
        (F.coalesce(F.trim("key"), F.lit("")) == "", "missing_key"),
        (concept & F.col("name").isNull(), "missing_name"),
        (concept & F.col("definition").isNull(), "missing_definition"),
        (concept & F.col("source_refs").isNull(), "missing_source_refs"),
        ((F.col("label") == "Mechanism") & F.col("layer").isNotNull() & ~F.col("layer").isin(*schema.layers), "bad_layer"),
        ((F.col("key_n") > 1) & (F.col("id_n") == 1), "duplicate_key"),
    ]
    n = nodes.withColumn("id_n", _first_of(["id"], "ord")).withColumn("key_n", _first_of(["label", "key"], "ord"))
    return n.select("ord", "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in checks]))).alias("error"))


def validate_edges(edges: DataFrame, nodes: DataFrame, schema: GraphSchema = GraphSchema()) -> DataFrame:
    """(ord, id, error) for edges (ord, id, type, src, dst)."""
    ends = nodes.select(F.col("id").alias("nid"), "label").dropDuplicates(["nid"])
    e = edges.withColumn("id_n", _first_of(["id"], "ord")).withColumn("same_n", _first_of(["src", "type", "dst"], "ord"))
    e = e.join(ends.select(F.col("nid").alias("src"), F.col("label").alias("src_label")), "src", "left").join(ends.select(F.col("nid").alias("dst"), F.col("label").alias("dst_label")), "dst", "left")
    allowed = [f"{t}|{a}|{b}" for t, pairs in schema.pairs.items() for a, b in pairs]
    known = F.col("type").isin(*schema.pairs)
    both = F.col("src_label").isNotNull() & F.col("dst_label").isNotNull()
    checks = [
        (F.col("id_n") > 1, "duplicate_id"),
        (~known, "unknown_type"),
        (known & ~both, "missing_endpoint"),
        (known & both & ~F.concat_ws("|", "type", "src_label", "dst_label").isin(*allowed), "forbidden_pair"),
        ((F.col("same_n") > 1) & (F.col("id_n") == 1), "duplicate_edge"),
    ]
    return e.select("ord", "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in checks]))).alias("error"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Incoming rows merged into stored ones: the columns of ``incoming`` and action (created, updated, skipped, kept).

    A row is updated if any column outside the keys differs; columns in ``keep_if_null`` keep what is stored when
    nothing comes in, and don't count as a difference then.
    """
    rest = [c for c in incoming.columns if c not in keys]
    a = stored.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in rest], F.lit(True).alias("in_a"))
    b = incoming.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in rest], F.lit(True).alias("in_b"))
    met = a.join(b, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys], "full")
    new = {c: F.coalesce(f"b_{c}", f"a_{c}") if c in keep_if_null else F.col(f"b_{c}") for c in rest}
    same = F.lit(True)
    for c in rest:
        same = same & new[c].eqNullSafe(F.col(f"a_{c}"))
    action = F.when(F.col("in_b").isNull(), "kept").when(F.col("in_a").isNull(), "created").when(same, "skipped").otherwise("updated")
    values = [F.when(F.col("in_b").isNull(), F.col(f"a_{c}")).otherwise(new[c]).alias(c) for c in rest]
    return met.select(*[F.coalesce(f"b_{k}", f"a_{k}").alias(k) for k in keys], *values, action.alias("action"))


def import_counts(*merged: DataFrame) -> DataFrame:
    """created, updated, skipped over all merged tables."""
    union = merged[0].select("action")
    for m in merged[1:]:
        union = union.unionByName(m.select("action"))
    return union.where("action <> 'kept'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def ref_parts(ref: Column) -> Column:
    """(kind, code) of 'kind:code', split at the first colon; null without one."""
    at = F.instr(ref, ":")
    return F.when(at > 0, F.struct(F.substring(ref, F.lit(1), at - 1).alias("kind"), F.substring(ref, at + 1, F.length(ref)).alias("code")))


def bad_refs(df: DataFrame, refs: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("row_key"), F.explode(refs).alias("ref")).where(F.instr("ref", ":") == 0)


def missing_refs(df: DataFrame, refs: str, targets: DataFrame, target_key: str, sample: int = 20) -> DataFrame:
    """n_missing and the first few missing values, in order."""
    wanted = df.select(F.explode(refs).alias("ref")).distinct()
    missing = wanted.join(targets.select(F.col(target_key).cast("string").alias("ref")).distinct(), "ref", "left_anti")
    few = missing.orderBy("ref").limit(sample).agg(F.lit(1).alias("k"), F.array_sort(F.collect_list("ref")).alias("first_missing"))
    return missing.agg(F.lit(1).alias("k"), F.count(F.lit(1)).alias("n_missing")).join(few, "k").drop("k")  # one row each


def case_edges(cases: DataFrame) -> DataFrame:
    """Distinct (src, type, dst) of the references that cases hold."""
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), F.coalesce(c, F.array().cast("array<string>")).alias("codes")) for t, c in (("HAS_CONDITION", "conditions"), ("HAS_PARAMETER", "parameters"), ("HAS_RESULT", "results"))])
    each = cases.select(F.col("case_id").alias("src"), F.explode(kinds).alias("k")).select("src", "k.type", F.explode("k.codes").alias("code"))
    return each.select("src", "type", F.when(F.instr("code", ":") > 0, ref_parts(F.col("code"))["code"]).otherwise(F.col("code")).alias("dst")).distinct()


def enrich_refs(case_edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each case's references as sorted 'label:key' lists by kind."""
    n = nodes.select(F.col("key").alias("dst"), F.concat(F.lower("label"), F.lit(":"), F.col("key")).alias("ref"))
    e = case_edge_rows.join(n, "dst")
    pick = lambda t: F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("ref"))))
    return e.groupBy(F.col("src").alias("case_id")).agg(pick("HAS_CONDITION").alias("conditions"), pick("HAS_PARAMETER").alias("parameters"), pick("HAS_RESULT").alias("results"))


def without_prefix(df: DataFrame, key: str, prefix: str, refs: str | None = None, ref_prefix: str | None = None) -> DataFrame:
    """Rows whose key doesn't begin with the prefix, nor any reference with the other."""
    gone = F.coalesce(F.col(key).startswith(prefix), F.lit(False))
    if refs and ref_prefix:
        gone = gone | F.coalesce(F.exists(refs, lambda r: r.startswith(ref_prefix)), F.lit(False))
    return df.where(~gone)


def priority_steps(limit_rows: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """(parameter_code, step, unit, source_type, source_refs): the manual step before the project's default; none without either."""
    step = F.coalesce("adjustment_step", "default_step")
    kind = F.when(F.col("adjustment_step").isNotNull(), "manual").otherwise("project_default")
    refs = F.coalesce("source_refs", F.array().cast("array<string>"))
    return limit_rows.where(step.isNotNull() & F.col("parameter_code").isin(*parameters)).select("parameter_code", step.alias("step"), F.coalesce("unit", F.lit("")).alias("unit"), kind.alias("source_type"), F.when(kind == "manual", 1.0).otherwise(0.8).alias("confidence"), refs.alias("source_refs"))


def import_graph(nodes: DataFrame, edges: DataFrame, stored_nodes: DataFrame, stored_edges: DataFrame, schema: GraphSchema = GraphSchema()):
    """(errors, merged nodes, merged edges); with any error nothing is merged and the last two are None."""
    nodes, edges = trimmed(nodes), trimmed(edges).withColumn("source_refs", F.coalesce("source_refs", F.array().cast("array<string>")))
    errors = validate_nodes(nodes, schema).unionByName(validate_edges(edges, nodes, schema)).orderBy("ord", "id", "error")
    if not errors.isEmpty():
        return errors, None, None
    n = upsert(stored_nodes, nodes.drop("ord"), ["label", "key"])
    e = upsert(stored_edges, edges.drop("ord"), ["src", "type", "dst"])
    return errors, n, e


#: Reference columns of cases, with the edge type and the node label each one means.
REFERENCES = (("conditions", "HAS_CONDITION", "Condition"), ("parameters", "HAS_PARAMETER", "Parameter"), ("results", "HAS_RESULT", "Quality"))


def case_errors(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(error, value): ids that come twice, references without a colon, references to nodes that aren't there."""
    parts = [duplicate_keys(cases, ["case_id"]).select(F.lit("duplicate_case").alias("error"), F.col("case_id").alias("value"))]
    for column, _, label in REFERENCES:
        refs = cases.select(F.explode(column).alias("ref")).distinct()
        known = nodes.where(F.col("label") == label).select(F.col("key").alias("code")).distinct()
        bad = F.instr("ref", ":") == 0
        parts.append(refs.where(bad).select(F.lit(f"bad_{column}").alias("error"), F.col("ref").alias("value")))
        parts.append(refs.where(~bad).select(ref_parts(F.col("ref"))["code"].alias("code")).distinct().join(known, "code", "left_anti").select(F.lit(f"missing_{column}").alias("error"), F.col("code").alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def import_cases(cases: DataFrame, stored: DataFrame, stored_edges: DataFrame, nodes: DataFrame, embedder=None):
    """(errors, merged cases, merged edges, counts); with any error nothing is merged and the rest is None.

    Texts are embedded by ``embedder`` where one is given; a case without an embedding keeps the stored one. A case is
    updated if the hash of its properties differs. The edges of every incoming case are merged, also where the case itself
    is as it was; ``stored_edges`` (src, type, dst) lose none.
    """
    from kilnwork.operators.embedding import with_embeddings

    errors = case_errors(cases, nodes)
    if not errors.isEmpty():
        return errors, None, None, None
    incoming = with_embeddings(cases.drop("embedding"), embedder) if embedder else cases
    own = [c for c in incoming.columns if c not in ("ord", "embedding", "embedding_warning", *(r[0] for r in REFERENCES))]
    incoming = incoming.select(*own, *([c for c in ("embedding",) if c in incoming.columns]))
    incoming = incoming.withColumn("props_hash", props_hash(*own))
    if "embedding" not in stored.columns:
        stored = stored.withColumn("embedding", F.lit(None).cast("array<float>"))
    if "embedding" not in incoming.columns:
        incoming = incoming.withColumn("embedding", F.lit(None).cast("array<float>"))
    if "props_hash" not in stored.columns:
        stored = stored.withColumn("props_hash", props_hash(*own))
    merged = upsert(stored, incoming, ["case_id"], ["embedding"])
    edges = stored_edges.select("src", "type", "dst").unionByName(case_edges(cases)).distinct()
    return errors, merged, edges, import_counts(merged)


def deleted_by_prefix(df: DataFrame, key: str, prefix: str, refs: str | None = None, ref_prefix: str | None = None) -> tuple[DataFrame, int]:
    """What stays after deleting by prefix, and how many rows went."""
    stay = without_prefix(df, key, prefix, refs, ref_prefix)
    return stay, df.count() - stay.count()
