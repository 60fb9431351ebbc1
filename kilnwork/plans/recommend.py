"""Flow: requirements -> similar cases -> diverse bases -> one proposal for each base -> consensus -> ranking.

All requirements, bases and parameters go through one lazy plan; nothing loops over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions.numeric import magnitude_label, ordered_union, quantize, range_check, round_to, step_decimals, support_score, voltage_blocked, weighted_confidence
from kilnwork.model import PARAMETER_COLUMNS, Adjustment, Retrieval
from kilnwork.operators import diff, graph, ingest, similarity, stats
from kilnwork.plans.reasoning import Selector, choose_basis
from kilnwork.sources.shared import saved

TEXTS = "array<string>"


def check_limits(top_k: int, count: int) -> None:
    """1 to 5 cases and 1 to 3 proposals; booleans are no numbers."""
    for name, value, most in (("top_k", top_k, 5), ("count", count, 3)):
        if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
            raise ValueError(f"{name} must be a whole number from 1 to {most}")


def recommend(requirements: DataFrame, cases: DataFrame, rule_rows: DataFrame, chain_rows: DataFrame, limit_rows: DataFrame, top_k: int = 5, count: int = 3, retrieval: Retrieval = Retrieval(), cfg: Adjustment = Adjustment(), embedding: str | None = None, selector: Selector | None = None) -> tuple[DataFrame, DataFrame]:
    """(proposals, adjustments) of each requirement.

    proposals: requirement_id, proposal_id, base_case_id, valid, partial scores, confidence, rank, low_confidence,
    basis, warnings. adjustments: requirement_id, proposal_id, parameter_code and what is recommended with its support.
    ``rule_rows``, ``chain_rows`` and ``limit_rows`` come from the graph operators (limits of one equipment).

    ``selector`` may choose knowledge paths and write the basis. It changes no computed number but the score of knowledge,
    which counts the paths kept. Unknown ids are rejected; without a usable choice the deterministic paths stay, and a
    parameter of which no path was chosen gets its own back.
    """
    check_limits(top_k, count)
    spark = requirements.sparkSession
    fields = retrieval.fields
    matches = similarity.similar_rows(requirements, cases, "process", fields, "requirement_id", "case_id", top_k, retrieval, embedding)
    m = matches.select(F.col("q.requirement_id").alias("requirement_id"), "q", "r", "total_score", "rank")
    m = m.withColumn("diffs", diff.diff_rows(fields, lambda f: F.col(f"q.{f}"), lambda f: F.col(f"r.{f}")))
    m = m.withColumn("codes", diff.condition_codes(F.col("diffs"))).withColumn("sig", diff.signature(F.col("codes")))
    m = saved(spark, m, "matches")
    bases = similarity.diverse_bases(m, ["requirement_id"], [f"r.{f.name}" for f in fields], "sig", [F.col("rank")], count)
    bases = bases.select("requirement_id", F.concat(F.lit("prop_"), F.lpad(F.col("base_rank").cast("string"), 2, "0")).alias("proposal_id"), "q", F.col("r").alias("base"), F.col("total_score").alias("similarity"), "codes", diff.gaps(F.col("diffs")).alias("gaps"))
    bases = saved(spark, bases, "bases")
    key = ["requirement_id", "proposal_id"]

    # Rules for the differences, and each parameter's direction.
    wanted = rule_rows.where(F.col("parameter_code").isin(*PARAMETER_COLUMNS))
    ruled = bases.select(*key, F.explode("codes").alias("condition_code")).join(wanted, "condition_code")
    ruled = saved(spark, ruled, "ruled")
    direction = stats.directions(ruled, [*key, "parameter_code"], "target_change")

    # What the equipment says about the parameter, and the base's value.
    steps = ingest.priority_steps(limit_rows, list(PARAMETER_COLUMNS)).select("parameter_code", "step", F.col("source_refs").alias("step_refs"))
    bounds = graph.first_limits(limit_rows).select("parameter_code", "min_value", "max_value", "range_rule", "unified_mode_rule")
    value = lambda case: F.coalesce(*[F.when(F.col("parameter_code") == p, F.col(f"{case}.{c}")) for p, c in PARAMETER_COLUMNS.items()])
    facts = direction.where("direction is not null").join(bases.select(*key, "q", "base"), key).join(steps, "parameter_code", "left").join(bounds, "parameter_code", "left").withColumn("base_value", value("base"))
    stop = F.when(F.col("step").isNull(), "no_step").when((F.col("parameter_code") == "arc_voltage") & voltage_blocked(F.col("unified_mode_rule"), F.col("q.control_mode")), "mode_blocked").when(F.col("base_value").isNull(), "no_base_value")
    facts = saved(spark, facts.withColumn("stopped", stop), "facts")
    live = facts.where("stopped is null")

    # Deltas from the other matches that differ from the base in a way that the requirement does, too.
    supports = m.select("requirement_id", F.col("r").alias("support"), F.col("rank").alias("support_rank"), F.col("total_score").alias("weight"))
    near = bases.select(*key, "base", "codes").join(supports, "requirement_id").where(F.col("support.case_id") != F.col("base.case_id"))
    support_codes = diff.condition_codes(diff.diff_rows(fields, lambda f: F.col(f"support.{f}"), lambda f: F.col(f"base.{f}")))
    near = near.where((F.size("codes") == 0) | F.arrays_overlap("codes", support_codes)).select(*key, "support", "support_rank", "weight")
    pairs = live.select(*key, "parameter_code", "direction", "base_value", "base").join(near, key, "left")
    pairs = pairs.select(*key, "parameter_code", "direction", "base_value", value("support").alias("support_value"), "weight", F.col("support.material").eqNullSafe(F.col("base.material")).alias("same_material"), F.col("support.case_id").alias("support_id"), "support_rank")
    estimate = stats.delta_estimates(saved(spark, pairs, "pairs"), [*key, "parameter_code"])

    a = live.join(estimate, [*key, "parameter_code"])
    a = a.withColumn("raw", F.coalesce("raw_delta", F.when(F.col("direction") == "increase", F.col("step")).otherwise(-F.col("step"))))
    a = a.withColumn("quantized", quantize(F.col("raw"), F.col("step"))).withColumn("decimals", step_decimals(F.col("step")))
    a = a.withColumn("recommended", round_to(F.col("base_value") + F.col("quantized"), F.col("decimals")))
    a = a.withColumn("check", range_check(F.col("recommended"), F.col("min_value"), F.col("max_value")))
    a = a.withColumn("step_rule", F.col("n_valid") < cfg.quantile_cases)
    a = a.withColumn("magnitude", magnitude_label(F.abs("raw"), F.col("step"), F.col("n_valid"), F.col("q33"), F.col("q67"), cfg.quantile_cases))
    a = a.withColumn("support", support_score(F.col("fallback"), F.col("n_valid"), F.col("dispersion"), F.col("step_rule"), cfg))

    a = saved(spark, a, "adjustments")
    # Full knowledge paths of the parameters that are adjusted; the best of each parameter stay.
    paths = graph.knowledge_paths(ruled.join(a.select(*key, "parameter_code"), [*key, "parameter_code"], "left_semi"), chain_rows, key)
    paths = saved(spark, paths, "candidates")
    best = stats.argmax_ties(paths, [*key, "parameter_code"], "confidence")
    choice = None
    if selector is not None:
        choice = saved(spark, chosen_paths(bases, a, paths, key, selector), "choice")
        wanted_ids = choice.select(*key, F.explode("selected_path_ids").alias("path_id"))
        best = stats.backfilled(paths.join(wanted_ids, [*key, "path_id"], "left_semi"), best, [*key, "parameter_code"])
    kept = saved(spark, best, "paths")
    by_parameter = kept.groupBy(*key, "parameter_code").agg(F.array_sort(F.collect_list(F.struct("path_id", "relationship_ids", "source_refs"))).alias("paths"))
    a = a.join(by_parameter, [*key, "parameter_code"], "left")
    a = a.withColumn("path_ids", F.array_sort(F.array_distinct(F.flatten(F.transform("paths", lambda p: p["relationship_ids"])))))
    a = a.withColumn("source_refs", ordered_union(F.concat(F.transform("paths", lambda p: p["source_refs"]), F.array("step_refs"))))
    names = F.transform("used", lambda u: u["support_id"])
    adjustments = a.select(*key, "parameter_code", "direction", "base_value", round_to(F.col("raw"), F.col("decimals") + 2).alias("raw_delta"), "quantized", "recommended", "step", "magnitude", "fallback", "n_valid", "n_filtered", "n_missing", "dispersion", "support", names.alias("support_case_ids"), F.transform("paths", lambda p: p["path_id"]).alias("knowledge_path_ids"), "path_ids", "source_refs", "check")

    adjustments = saved(spark, adjustments, "adjusted")
    # Partial scores of each proposal.
    knowledge = kept.groupBy(*key).agg(F.bround(F.avg("confidence") * F.avg((F.size("source_refs") > 0).cast("double")), 4).alias("knowledge"))
    credit = (2 + F.when(F.col("check.verified"), 1.0).otherwise(cfg.unknown_range_credit)) / 3
    basis = F.concat_ws(" ", F.col("parameter_code"), F.col("direction"), F.abs("quantized").cast("string"), F.lit("by"), F.col("step").cast("string"), F.lit("from"), F.size("support_case_ids").cast("string"), F.lit("cases; paths"), F.array_join("knowledge_path_ids", ","))
    warn = F.array_compact(F.array(F.when(~F.col("check.ok"), F.concat("parameter_code", F.lit(": "), F.array_join("check.problems", ","))), F.when(~F.col("check.verified"), F.concat("parameter_code", F.lit(": range not verified"))), F.when(F.col("fallback"), F.concat("parameter_code", F.lit(": one step, no supporting delta")))))
    summed = adjustments.groupBy(*key).agg(
        F.bround(F.avg("support"), 4).alias("case_support"),
        F.sum(credit).alias("credit"),
        F.count(F.lit(1)).alias("n_facts"),
        F.min("check.ok").alias("in_range"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parameter_code", basis.alias("b")))), lambda x: x["b"]), "; ").alias("what"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("parameter_code", warn.alias("w")))), lambda x: x["w"])).alias("fact_warnings"),
    )
    stopped = facts.where("stopped is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n_stopped"), F.array_sort(F.collect_list(F.concat("parameter_code", F.lit(": "), "stopped"))).alias("stop_warnings"))
    conflicts = direction.where("direction is null").groupBy(*key).agg(F.array_sort(F.collect_list(F.concat("parameter_code", F.lit(": no single direction")))).alias("conflict_warnings"))
    texts = lambda *cols: F.flatten(F.array(*[F.coalesce(c, F.array().cast(TEXTS)) for c in cols]))
    if choice is None:
        chosen = bases.select(*key).withColumn("chosen_basis", F.lit(None).cast("string")).withColumn("choice_warnings", F.array().cast(TEXTS))
    else:
        late = kept.where("backfilled").join(choice.where(F.size("selected_path_ids") > 0).select(*key), key, "left_semi")
        late = late.groupBy(*key).agg(F.transform(F.array_sort(F.collect_set("parameter_code")), lambda c: F.concat(c, F.lit(": no path selected, the best kept"))).alias("late"))
        chosen = choice.join(late, key, "left").select(*key, F.col("basis").alias("chosen_basis"), texts("warnings", "late").alias("choice_warnings"))
    p = bases.join(chosen, key, "left").join(summed, key, "left").join(stopped, key, "left").join(conflicts, key, "left").join(knowledge, key, "left")
    p = p.withColumn("equipment", F.bround(F.col("credit") / (F.col("n_facts") + F.coalesce("n_stopped", F.lit(0))), 4)).withColumn("valid", F.coalesce("in_range", F.lit(False)))
    p = p.select(*key, F.col("base.case_id").alias("base_case_id"), "valid", F.bround("similarity", 4).alias("similarity"), "knowledge", "case_support", "equipment", F.coalesce("chosen_basis", programmatic_basis("base.case_id", "codes", "what")).alias("basis"), texts("gaps", "conflict_warnings", "stop_warnings", "choice_warnings", "fact_warnings").alias("warnings"))
    return _finalize(saved(spark, p, "proposals"), adjustments, key, cfg)


def programmatic_basis(base: str, codes: str, facts: str) -> Column:
    """The computed basis: what differs from the base, then what was adjusted."""
    differs = F.when(F.size(codes) > 0, F.array_join(codes, ",")).otherwise(F.lit("nothing"))
    return F.concat_ws("; ", F.concat(F.lit("differs from "), F.col(base), F.lit(" in "), differs), facts)


CHOICE = "requirement_id string, proposal_id string, selected_path_ids array<string>, basis string, warnings array<string>"


def chosen_paths(bases: DataFrame, adjusted: DataFrame, paths: DataFrame, key: list[str], selector: Selector) -> DataFrame:
    """CHOICE: what the selector says to each proposal, asked once for each by the executors. A proposal has a few paths for each of a few parameters."""
    fact = F.concat_ws(" ", "parameter_code", "direction", F.abs("quantized").cast("string"), F.lit("in steps of"), F.col("step").cast("string"), F.lit("from"), F.col("n_valid").cast("string"), F.lit("cases"))
    facts = adjusted.groupBy(*key).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    offered = paths.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path_id", "parameter_code", F.col("node_codes").alias("node_keys"), "confidence"))).alias("paths"))
    asked = bases.select(*key, F.col("base.case_id").alias("base_case_id"), "codes").join(facts, key).join(offered, key, "left")

    def ask(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                paths = [] if r["paths"] is None else [dict(x) for x in r["paths"]]
                rows.append({k: r[k] for k in key} | choose_basis(r["base_case_id"], list(r["codes"]), list(r["facts"]), paths, selector))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHOICE.split(", ")])

    return asked.mapInPandas(ask, CHOICE)


def flow_warnings(proposals: DataFrame, cfg: Adjustment = Adjustment(), most: int = 3) -> DataFrame:
    """(requirement_id, warning) about a run: bases that gave no valid proposal, with their first reasons, and a best proposal of low confidence."""
    few = F.array_join(F.slice("warnings", 1, most), "; ")
    excluded = proposals.where(~F.col("valid") & (F.size("warnings") > 0)).select("requirement_id", F.concat(F.lit("base case "), "base_case_id", F.lit(" excluded: "), few).alias("warning"))
    low = proposals.where("rank = 1 and low_confidence").select("requirement_id", F.concat(F.lit("best proposal "), "proposal_id", F.lit(" has confidence "), F.col("confidence").cast("string"), F.lit(f" below {cfg.low_confidence}")).alias("warning"))
    return excluded.unionByName(low)


def _finalize(p: DataFrame, adjustments: DataFrame, key: list[str], cfg: Adjustment) -> tuple[DataFrame, DataFrame]:
    """Scales by the number of valid proposals, adds consensus, ranks. Invalid proposals stay, unranked."""
    ok = p.where("valid")
    values = adjustments.join(ok.select(*key), key, "left_semi")
    consensus = stats.pairwise_consensus(values, "requirement_id", "proposal_id", "parameter_code", "recommended")
    n = F.count(F.lit(1)).over(W.partitionBy("requirement_id"))
    ok = ok.withColumn("case_support", F.bround(F.col("case_support") * F.least(F.lit(1.0), n / 3.0), 4)).join(consensus, key, "left")
    scores = {c: F.col(c) for c in ("similarity", "knowledge", "case_support", "consensus", "equipment")}
    ok = ok.withColumn("confidence", weighted_confidence(scores, cfg.weights))
    order = W.partitionBy("requirement_id").orderBy(F.desc("confidence"), "proposal_id")
    ok = ok.withColumn("rank", F.row_number().over(order)).withColumn("low_confidence", F.col("confidence") < cfg.low_confidence)
    return ok.unionByName(p.where("not valid"), allowMissingColumns=True), values.drop("check")
