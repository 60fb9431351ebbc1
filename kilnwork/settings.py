"""Validated configuration: files over defaults, each checked before it is used; and service addresses from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from kilnwork.functions import text as T
from kilnwork.model import Adjustment, Field, GraphSchema, Retrieval
from kilnwork.operators import document as D
from kilnwork.sources.json_files import read_config


@dataclass(frozen=True)
class Services:
    """Where an injected selector and embedder are reached. Their keys are never shown."""

    llm_url: str = "http://localhost:8000/v1"
    llm_model: str = ""
    llm_key: str = "EMPTY"
    embedding_url: str = "http://localhost:8001/v1"
    embedding_model: str = ""
    embedding_key: str = "EMPTY"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "KILNWORK_") -> Services:
        """Each field from the variable of its name in capitals, blank values as if unset."""
        env = os.environ if env is None else env
        return cls(**{f.name: env[prefix + f.name.upper()] for f in fields(cls) if env.get(prefix + f.name.upper(), "").strip()})

    def __repr__(self) -> str:
        return f"Services({', '.join(f'{f.name}=***' if f.name.endswith('_key') else f'{f.name}={getattr(self, f.name)!r}' for f in fields(self))})"


def _unit(name: str, value, low: float = 0.0, high: float = 1.0) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must be a number from {low:g} to {high:g}, not {value!r}")
    return float(value)


ADJUSTMENT = {
    "confidence_weights": dict(Adjustment().weights),
    "low_confidence_threshold": 0.5,
    "equipment": {"unknown_range_credit": 0.5},
    "case_delta": {"min_valid_for_full_support": 3, "fallback_support_factor": 0.25, "unknown_dispersion_penalty": 0.5, "step_rule_penalty": 0.8},
    "magnitude": {"min_cases_for_quantiles": 3, "quantile_medium": 0.33, "quantile_large": 0.67},
}


def adjustment(path: str | None = None) -> Adjustment:
    """Weights must be there, none negative, with sum 1; shares lie in [0, 1]; quantiles rise."""
    c = read_config(path, ADJUSTMENT) if path else ADJUSTMENT
    weights = c["confidence_weights"]
    if set(weights) != set(ADJUSTMENT["confidence_weights"]):
        raise ValueError(f"confidence_weights must name {', '.join(sorted(ADJUSTMENT['confidence_weights']))}")
    delta, size = c["case_delta"], c["magnitude"]
    quantiles = tuple(_unit(f"magnitude.{k}", size[k]) for k in ("quantile_medium", "quantile_large"))
    if not quantiles[0] < quantiles[1]:
        raise ValueError("magnitude.quantile_medium must be less than quantile_large")
    return Adjustment(
        weights={k: _unit(f"confidence_weights.{k}", v) for k, v in weights.items()},
        low_confidence=_unit("low_confidence_threshold", c["low_confidence_threshold"]),
        unknown_range_credit=_unit("equipment.unknown_range_credit", c["equipment"]["unknown_range_credit"]),
        full_support_cases=int(_unit("case_delta.min_valid_for_full_support", delta["min_valid_for_full_support"], 1, 1000)),
        fallback_support=_unit("case_delta.fallback_support_factor", delta["fallback_support_factor"]),
        unknown_dispersion=_unit("case_delta.unknown_dispersion_penalty", delta["unknown_dispersion_penalty"]),
        step_rule_factor=_unit("case_delta.step_rule_penalty", delta["step_rule_penalty"]),
        quantile_cases=int(_unit("magnitude.min_cases_for_quantiles", size["min_cases_for_quantiles"], 1, 1000)),
        quantiles=quantiles,
    )


RETRIEVAL = {"filter_field": "process", "structured_weight": 0.8, "semantic_weight": 0.2, "top_k": 5, "structured_fields": {f.name: {"type": "numeric" if f.numeric else "categorical", "weight": f.weight} for f in Retrieval().fields}}


def retrieval(path: str | None = None) -> Retrieval:
    """Fields are numeric or categorical with weights of 0 or more, at least one above; both parts' weights lie in [0, 1]."""
    c = read_config(path, RETRIEVAL) if path else RETRIEVAL
    given = []
    for name, f in c["structured_fields"].items():
        if f.get("type") not in ("numeric", "categorical"):
            raise ValueError(f"structured_fields.{name}.type must be numeric or categorical")
        given.append(Field(name, f["type"] == "numeric", _unit(f"structured_fields.{name}.weight", f.get("weight", 1.0), 0, 1e6)))
    if not any(f.weight for f in given):
        raise ValueError("structured_fields must have a weight above 0")
    k = c["top_k"]
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"top_k must be a whole number above 0, not {k!r}")
    return Retrieval(_unit("structured_weight", c["structured_weight"]), _unit("semantic_weight", c["semantic_weight"]), k, tuple(given))


def graph_schema(path: str) -> GraphSchema:
    """node_labels {label: {key: name}}, relationships {type: [[from, to], ...]}; every label of a pair must be known."""
    c = read_config(path, {"node_labels": {}, "relationships": {}})
    keys = {label: spec["key"] if isinstance(spec, dict) else spec for label, spec in c["node_labels"].items()}
    pairs = {t: tuple((a, b) for a, b in ends) for t, ends in c["relationships"].items()}
    unknown = sorted({label for ends in pairs.values() for pair in ends for label in pair} - set(keys))
    if not keys or unknown:
        raise ValueError(f"unknown labels in relationships: {unknown}" if unknown else "node_labels must not be empty")
    return GraphSchema(keys, pairs)


DOCUMENT = {
    "document": {"id": "doc", "version": "v1"},
    "page": {"bounds": [0, 0, 1000, 1040], "bbox_tolerance": 10, "front_last_page": D.FRONT_LAST, "pdf_pages_expected": None},
    "source_ref_codes": dict(D.REF_CODES),
    "heading": {"level_patterns": [{"regex": p, "level": level} for p, level in T.LEVELS], "cross_line_gap": 40},
    "association": {"caption_gap": 60, "min_confidence": 0.6},
    "assets": {"x_scale": 0.7485, "y_scale": 1.0, "margin_ratio": 0.1, "dpi": 150},
    "validation": {"forbidden_fields": "entity|relation|process_?window|effect_?rule|adjustment_?rule", "last_page_share": 0.05, "expected_assets": {}},
}


def document(path: str | None = None) -> dict:
    """The document flow's configuration: an id and a version, four bounds, heading levels 1 to 6, codes, and plausible numbers."""
    c = read_config(path, DOCUMENT) if path else DOCUMENT
    if not c["document"].get("id") or not c["document"].get("version"):
        raise ValueError("document.id and document.version must not be empty")
    bounds = c["page"]["bounds"]
    if not isinstance(bounds, list) or len(bounds) != 4 or bounds[0] >= bounds[2] or bounds[1] >= bounds[3]:
        raise ValueError("page.bounds must be [x0, y0, x1, y1]")
    patterns = c["heading"]["level_patterns"]
    if not patterns or any(p.get("level") not in range(1, 7) or not p.get("regex") for p in patterns):
        raise ValueError("heading.level_patterns must not be empty, with levels 1 to 6")
    if not c["source_ref_codes"]:
        raise ValueError("source_ref_codes must not be empty")
    _unit("association.min_confidence", c["association"]["min_confidence"])
    _unit("association.caption_gap", c["association"]["caption_gap"], 0, 1e6)
    _unit("heading.cross_line_gap", c["heading"]["cross_line_gap"], 0, 1e6)
    _unit("validation.last_page_share", c["validation"]["last_page_share"])
    return c
