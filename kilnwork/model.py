"""Row contracts as Spark schemas, configuration, and row invariants as violation queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameters that recommendations cover, with the case column of each.
PARAMETER_COLUMNS = {"welding_current": "welding_current_a", "arc_voltage": "welding_voltage_v", "welding_speed": "welding_speed_mm_s"}

REQUIREMENT = (
    "requirement_id string, process string, material string, thickness_mm double, joint_type string, position string, "
    "wire_diameter_mm double, shielding_gas string, target_quality string, control_mode string"
)
CASE = (
    "case_id string, process string, material string, thickness_mm double, joint_type string, position string, "
    "wire_diameter_mm double, shielding_gas string, welding_current_a double, welding_voltage_v double, welding_speed_mm_s double, "
    "retrieval_text string, embedding array<float>, source_refs array<string>, conditions array<string>, parameters array<string>, results array<string>"
)
NODE = "id string, label string, properties string"
EDGE = "id string, type string, `from` string, `to` string, properties string"
NODE_PROPERTIES = "code string, equipment_id string, case_id string, name string, definition string, layer string, source_refs array<string>"
EDGE_PROPERTIES = (
    "source_change string, target_change string, condition_text string, confidence double, provenance_type string, source_refs array<string>, "
    "adjustment_step double, default_step double, unit string, min_value double, max_value double, range_rule string, unified_mode_rule string, "
    "separate_mode_rule string, setting_method string, supports_direct_setting boolean, control_modes array<string>"
)


@dataclass(frozen=True)
class Field:
    name: str
    numeric: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class Retrieval:
    structured_weight: float = 0.8
    semantic_weight: float = 0.2
    top_k: int = 5
    fields: tuple[Field, ...] = (
        Field("material"),
        Field("thickness_mm", True),
        Field("joint_type"),
        Field("position"),
        Field("wire_diameter_mm", True),
        Field("shielding_gas"),
    )


@dataclass(frozen=True)
class Adjustment:
    weights: dict[str, float] = field(default_factory=lambda: {"similarity": 0.30, "knowledge": 0.25, "case_support": 0.15, "consensus": 0.15, "equipment": 0.15})
    low_confidence: float = 0.5
    unknown_range_credit: float = 0.5
    full_support_cases: int = 3
    fallback_support: float = 0.25
    unknown_dispersion: float = 0.5
    step_rule_factor: float = 0.8
    quantile_cases: int = 3
    quantiles: tuple[float, float] = (0.33, 0.67)

    def __post_init__(self):
        if any(w < 0 for w in self.weights.values()) or abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("confidence weights must not be negative and must sum to 1")
        if not 0 <= self.unknown_range_credit <= 1:
            raise ValueError("the credit for unknown ranges must lie in [0, 1]")


@dataclass(frozen=True)
class GraphSchema:
    """Node labels with their unique keys, and the label pairs that each relationship type may join."""

    keys: dict[str, str] = field(default_factory=lambda: {"Case": "case_id", "Condition": "code", "Parameter": "code", "Mechanism": "code", "Quality": "code", "Equipment": "equipment_id"})
    pairs: dict[str, tuple[tuple[str, str], ...]] = field(
        default_factory=lambda: {
            "HAS_CONDITION": (("Case", "Condition"),),
            "HAS_PARAMETER": (("Case", "Parameter"),),
            "HAS_RESULT": (("Case", "Quality"),),
            "SUGGESTS_ADJUSTMENT": (("Condition", "Parameter"),),
            "AFFECTS": (("Parameter", "Mechanism"), ("Mechanism", "Mechanism"), ("Mechanism", "Quality")),
            "DETERMINES": (("Mechanism", "Mechanism"),),
            "LIMITS": (("Equipment", "Parameter"),),
        }
    )
    layers: tuple[str, ...] = ("arc", "transfer", "pool")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each row and each rule whose condition is false; unknown counts as kept."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).alias("row_key"), F.explode(broken).alias("rule"))


def adjustment_rules() -> dict[str, Column]:
    """Invariants of a parameter adjustment: known parameter, sign of its direction, whole number of steps."""
    steps = F.abs(F.col("quantized")) / F.col("step")
    return {
        "parameter": F.col("parameter_code").isin(*PARAMETER_COLUMNS),
        "sign": F.when(F.col("direction") == "increase", F.col("quantized") >= 0).when(F.col("direction") == "decrease", F.col("quantized") <= 0),
        "whole_steps": F.abs(steps - F.rint(steps)) <= 1e-6,
        "step": F.col("step") > 0,
    }


def step_rules() -> dict[str, Column]:
    return {
        "parameter": F.col("parameter_code").isin(*PARAMETER_COLUMNS),
        "step": F.col("step") > 0,
        "source": F.col("source_type").isin("manual", "project_default"),
        "confidence": F.col("confidence").between(0, 1),
    }


def proposal_rules() -> dict[str, Column]:
    """What is recommended is the base value plus the adjustment, and every partial score lies in [0, 1]."""
    scores = reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in ("similarity", "knowledge", "case_support", "consensus", "equipment")])
    return {"sum": F.abs(F.col("recommended") - F.col("base_value") - F.col("quantized")) <= 1e-6, "scores": scores}
