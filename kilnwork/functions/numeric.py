"""Numeric column functions of similarity, statistics and recommendation. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6


def num_sim(a: Column, b: Column) -> Column:
    """1 minus the relative distance, not below 0; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(TINY))))


def cat_sim(a: Column, b: Column) -> Column:
    """1 if equal as text, else 0; null if either is null."""
    return (a.cast("string") == b.cast("string")).cast("double")


def cosine_sim(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; 0 if a vector is missing, empty or null, or lengths differ. Sums run in element order."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(fits, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def step_decimals(step: Column) -> Column:
    """Decimals of a step, up to ten, without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.10f", step.cast("double")), r"\.?0+$", "")
    return F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(F.lit(0))


def round_to(value: Column, decimals: Column) -> Column:
    """Half-even rounding to a number of decimals that is itself a column."""
    scale = F.pow(F.lit(10.0), decimals)
    return F.rint(value * scale) / scale


def quantize(raw: Column, step: Column) -> Column:
    """The nearest whole number of steps, at least one, with the sign of ``raw``; 0 stays 0; null for a step that isn't positive."""
    steps = F.greatest(F.lit(1.0), F.rint(F.abs(raw) / step))
    return F.when(step > 0, F.when(raw == 0, F.lit(0.0)).otherwise(round_to(F.signum(raw) * steps * step, step_decimals(step))))


def range_check(value: Column, low: Column, high: Column) -> Column:
    """(ok, verified, problems): no bounds at all is ok but not verified."""
    problems = F.array_compact(F.array(F.when(value < low, F.lit("below_min")), F.when(value > high, F.lit("above_max"))))
    return F.struct((F.size(problems) == 0).alias("ok"), (low.isNotNull() | high.isNotNull()).alias("verified"), problems.alias("problems"))


def voltage_blocked(unified_rule: Column, control_mode: Column) -> Column:
    """Where voltage follows current in unified mode, it is not adjusted unless the mode is known to be another."""
    return (F.coalesce(unified_rule, F.lit("")) != "") & (control_mode.isNull() | (control_mode == "unified"))


def magnitude_label(size: Column, step: Column, n: Column, q_medium: Column, q_large: Column, least: int = 3) -> Column:
    """small, medium or large: by quantiles of at least ``least`` deltas, else by steps (1, 2 to 3, more)."""
    steps = F.greatest(F.lit(1.0), F.rint(size / step))
    by_steps = F.when(steps <= 1, "small").when(steps <= 3, "medium").otherwise("large")
    by_quantile = F.when(size <= q_medium, "small").when(size <= q_large, "medium").otherwise("large")
    return F.when(n >= least, by_quantile).otherwise(by_steps)


def support_score(fallback: Column, n: Column, dispersion: Column, step_rule: Column, cfg) -> Column:
    """How far supporting cases back a delta."""
    backed = F.least(F.lit(1.0), n / float(cfg.full_support_cases)) * (1 - F.coalesce(dispersion, F.lit(cfg.unknown_dispersion)))
    score = F.when(fallback, F.lit(cfg.fallback_support)).otherwise(backed)
    return F.bround(F.when(step_rule, score * cfg.step_rule_factor).otherwise(score), 4)


def weighted_confidence(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name in scores:
        total = total + F.lit(float(weights.get(name, 0.0))) * scores[name]
    return F.bround(F.least(F.lit(1.0), total), 4)


def ordered_union(arrays: Column) -> Column:
    """Distinct elements of an array of arrays in the order of first occurrence."""
    return F.array_distinct(F.flatten(F.transform(arrays, lambda a: F.coalesce(a, F.array().cast("array<string>")))))
