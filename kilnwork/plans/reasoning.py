"""Flow: requirements -> best similar case -> typed differences -> bounded paths -> selection -> report."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.model import Retrieval
from kilnwork.operators import diff, graph, similarity

#: Gets a prompt, gives the answer's text. None selects nothing by a model.
Selector = Callable[[str], str]


def reason(requirements: DataFrame, cases: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 5, quality: str | None = None, cfg: Retrieval = Retrieval(), embedding: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, differences of the best match, paths with the limits of their parameter) for all requirements."""
    matches = similarity.similar_rows(requirements, cases, "process", cfg.fields, "requirement_id", "case_id", cfg.top_k, cfg, embedding)
    best = matches.where("rank = 1")
    diffs = best.select(F.col("q.requirement_id").alias("requirement_id"), F.col("r.case_id").alias("case_id"), F.explode(diff.diff_rows(cfg.fields, lambda f: F.col(f"q.{f}"), lambda f: F.col(f"r.{f}"))).alias("d")).select("requirement_id", "case_id", "d.*")
    paths = graph.reasoning_paths(diffs, graph.rules(edges, nodes), graph.tails(edges, nodes), limit, quality)
    limited = graph.grouped_limits(graph.limits(edges, nodes))
    return matches, diffs, paths.join(limited, "parameter_code", "left")


def parse_selection(text: str) -> dict | None:
    """The JSON object in a model's answer, with or without a code fence; anything else is None."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = fenced[1] if fenced else text
    at = body.find("{")
    for candidate in (body, body[at : body.rfind("}") + 1] if at >= 0 else ""):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def prompt(requirement: dict, base_id: str, diffs: list[dict], paths: list[dict]) -> str:
    """What a selector is asked: the requirement, the differences and the candidate paths, without their sources."""
    need = ", ".join(f"{k}={v}" for k, v in requirement.items() if v is not None)
    lines = [f"requirement: {need}", f"base case: {base_id}", "differences:"]
    lines += [f"- {d['code']}: {d['before']} -> {d['after']}" for d in diffs]
    lines += ["candidate paths:", *(f"[{p['path_id']}] {' > '.join(p['node_keys'])}" for p in paths)]
    return "\n".join([*lines, 'answer with one JSON object: {"selected_path_ids": [...], "selection_reason": "..."}; choose only from the candidates'])


def select_paths(requirement: dict, base_id: str, diffs: list[dict], paths: list[dict], selector: Selector | None) -> dict:
    """Selected ids in the answer's order, the reason, and warnings; no candidates or no differences select nothing, and so does a failing selector."""
    out = {"selected_path_ids": [], "selection_reason": "", "warnings": []}
    if not paths or not diffs:
        return out | {"warnings": ["nothing to select from"]}
    if selector is None:
        return out | {"warnings": ["no selector"]}
    try:
        answer = parse_selection(selector(prompt(requirement, base_id, diffs, paths)))
    except Exception as error:  # noqa: BLE001  whatever the injected selector raises
        return out | {"warnings": [f"selector failed: {error}"]}
    if answer is None:
        return out | {"warnings": ["the answer holds no JSON object"]}
    known = {p["path_id"] for p in paths}
    chosen = [x for x in answer.get("selected_path_ids") or [] if isinstance(x, str)]
    unknown = [x for x in chosen if x not in known]
    return {"selected_path_ids": list(dict.fromkeys(x for x in chosen if x in known)), "selection_reason": str(answer.get("selection_reason") or ""), "warnings": [f"unknown path {x}" for x in unknown]}


def basis_prompt(base_id: str, codes: list[str], facts: list[str], paths: list[dict]) -> str:
    """What a selector is asked about a proposal: its facts, and its knowledge paths with their confidence."""
    lines = [f"base case: {base_id}", "differences: " + (", ".join(codes) or "none"), "computed adjustments:", *(f"- {f}" for f in facts), "candidate knowledge paths:"]
    lines += [f"[{p['path_id']}] {p['parameter_code']}: {' > '.join(p['node_keys'])} (confidence {p['confidence']:.4f})" for p in paths]
    return "\n".join([*lines, 'answer with one JSON object: {"selected_path_ids": [...], "basis": "..."}; choose only from the candidates and change no number'])


def choose_basis(base_id: str, codes: list[str], facts: list[str], paths: list[dict], selector: Selector, longest: int = 200) -> dict:
    """The paths that a selector keeps, its sentence, and warnings. No usable choice gives no ids, and no usable sentence none: the caller has its own."""
    out = {"selected_path_ids": [], "basis": None, "warnings": []}
    if not paths:
        return out
    try:
        answer = parse_selection(selector(basis_prompt(base_id, codes, facts, paths)))
    except Exception as error:  # noqa: BLE001  whatever the injected selector raises
        return out | {"warnings": [f"selector failed, deterministic paths kept: {error}"]}
    if answer is None:
        return out | {"warnings": ["the answer holds no JSON object, deterministic paths kept"]}
    given = answer.get("selected_path_ids")
    given = [x for x in given if isinstance(x, str)] if isinstance(given, list) else []
    known = {p["path_id"] for p in paths}
    chosen, unknown = list(dict.fromkeys(x for x in given if x in known)), [x for x in given if x not in known]
    warnings = [f"unknown paths rejected: {', '.join(unknown)}"] if unknown else []
    if not chosen:
        warnings.append("no path selected, deterministic paths kept")
    basis = str(answer.get("basis") or "").strip()[:longest] or None
    if basis is None:
        warnings.append("no basis given, the computed one stands")
    return {"selected_path_ids": chosen, "basis": basis, "warnings": warnings}


def _number(v) -> str:
    return f"{v:g}" if isinstance(v, float) else str(v)


def field_line(row: dict, fields: list[str]) -> str:
    """'name=value' of fields that aren't null."""
    return ", ".join(f"{f}={_number(row[f])}" for f in fields if row.get(f) is not None)


def diff_line(d: dict) -> str:
    return f"{d['field']}: {d['before']} -> {d['after']} ({d['change']})" + (f" [{d['note']}]" if d.get("note") else "")


def path_chain(p: dict, change: str | None = None) -> str:
    """The nodes in order; the second, which the first rule moves, with the direction of its change."""
    return " > ".join(node_with_direction(k, change if i == 1 else None) for i, k in enumerate(p["node_keys"]))


def path_segments(p: dict) -> list[str]:
    """A line for each edge, with its confidence where it has one."""
    keys = p["node_keys"]
    return [f"{a} -> {b}" + (f" (confidence {r['confidence']:.2f})" if r["confidence"] is not None else "") for a, b, r in zip(keys, keys[1:], p["rels"])]


def equipment_notes(limit_rows: list[dict]) -> list[str]:
    """Distinct notes in order: the step and range, or that the parameter is set directly."""
    notes = []
    for x in limit_rows:
        step = x.get("adjustment_step") or x.get("default_step")
        note = f"{x['equipment_id']}: " + (f"step {_number(step)} {x.get('unit') or ''}".strip() if step else "set directly") + (f", {x['range_rule']}" if x.get("range_rule") else "")
        if note not in notes:
            notes.append(note)
    return notes


def conclusions(paths: list[dict], selected: list[str], rule_rows: list[dict], base: dict, columns: dict[str, str]) -> list[str]:
    """One line for each parameter, from the first selected path that has it."""
    by_edge = {r["id"]: r for r in rule_rows}
    out: dict[str, str] = {}
    for p in paths:
        if p["path_id"] in selected and p["parameter_code"] not in out:
            r = by_edge.get(p["rels"][0]["id"], {})
            at = base.get(columns.get(p["parameter_code"], ""))
            out[p["parameter_code"]] = f"{p['parameter_code']}: {r.get('target_change') or 'adjust'}" + (f" from {_number(at)}" if at is not None else "") + (f" ({r['condition_text']})" if r.get("condition_text") else "")
    return list(out.values())


def node_with_direction(key: str, change: str | None) -> str:
    """A node's key with an arrow for the direction in which it changes."""
    return key + {"increase": " ↑", "decrease": " ↓"}.get(change or "", "")


def report(requirement: dict, base: dict | None, score: float | None, diffs: list[dict], paths: list[dict], selection: dict, fields: list[str], others: list[tuple[str, float]] = (), limit_rows: list[dict] = (), rule_rows: list[dict] = (), columns: dict[str, str] | None = None, parts: dict[str, float] | None = None) -> str:
    """A text for people; a requirement without a similar case says so.

    ``others``: further cases with their scores; ``parts``: the score's structured and semantic parts; ``limit_rows`` and
    ``rule_rows`` give the equipment's notes and, with ``columns`` (parameter -> case column), the conclusions.
    """
    lines = ["Requirement: " + field_line(requirement, ["process", *fields])]
    if base is None:
        return "\n".join([*lines, "No similar case was found."])
    split = f" = {', '.join(f'{k} {v:.4f}' for k, v in parts.items())}" if parts else ""
    lines += [f"Most similar case: {base['case_id']} ({score:.4f}{split}): " + field_line(base, fields)]
    if others:
        lines.append("Other candidates: " + ", ".join(f"{i} ({s:.4f})" for i, s in others))
    lines += ["Differences:", *("  " + diff_line(d) for d in diffs)]
    changes = {r["id"]: r.get("target_change") for r in rule_rows}
    lines.append("Paths:")
    for p in paths:
        lines.append(("* " if p["path_id"] in selection["selected_path_ids"] else "  ") + f"{p['path_id']} {path_chain(p, changes.get(p['rels'][0]['id']) if p['rels'] else None)}")
        lines += ["      " + s for s in path_segments(p)]
    done = conclusions(paths, selection["selected_path_ids"], list(rule_rows), base, columns or {})
    if done:
        lines += ["Conclusions:", *("  " + c for c in done)]
    if limit_rows:
        lines += ["Equipment:", *("  " + n for n in equipment_notes(list(limit_rows)))]
    return "\n".join([*lines, *(["Reason: " + selection["selection_reason"]] if selection["selection_reason"] else []), *("Warning: " + w for w in selection["warnings"])])
