"""The recommendation flow against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from kilnwork.model import REQUIREMENT, Adjustment, adjustment_rules, violations
from kilnwork.plans.recommend import check_limits, flow_warnings, recommend

REL = "array<struct<id:string,confidence:double,source_refs:array<string>>>"
RULES = "id string, condition_code string, parameter_code string, target_change string, confidence double, condition_text string, provenance_type string, source_refs array<string>"
LIMITS = "edge_id string, equipment_id string, parameter_code string, adjustment_step double, default_step double, unit string, min_value double, max_value double, range_rule string, unified_mode_rule string, source_refs array<string>"
CASE_COLUMNS = "case_id string, process string, material string, thickness_mm double, joint_type string, position string, wire_diameter_mm double, shielding_gas string, welding_current_a double, welding_voltage_v double, welding_speed_mm_s double"


def cases(spark):
    rows = [("s1", 5.0, "inside_corner", 120.0, 16.0, 7.0), ("s2", 4.0, "inside_corner", 115.0, 15.8, 7.5), ("a", 3.0, "inside_corner", 100.0, 15.0, 8.0), ("b", 1.0, "inside_corner", 90.0, 14.6, 9.0), ("c", 2.0, "lap", 95.0, 14.8, 8.5)]
    return spark.createDataFrame([(i, "GMAW", "carbon_steel", t, j, "vertical", 0.8, "CO2_100", c, v, s) for i, t, j, c, v, s in rows], CASE_COLUMNS)


def requirement(spark, mode=None):
    return spark.createDataFrame([("r", "GMAW", "carbon_steel", 6.0, "inside_corner", "vertical", 0.8, "CO2_100", None, mode)], REQUIREMENT)


def rules(spark, extra=()):
    rows = [("ru_c", "welding_current", "increase", 0.8), ("ru_v", "arc_voltage", "increase", 0.75), ("ru_s", "welding_speed", "decrease", 0.7), ("ru_x", "wire_extension", "increase", 0.6), *extra]
    return spark.createDataFrame([(i, "thickness_increase", p, d, c, None, None, [f"src:{i}"]) for i, p, d, c in rows], RULES)


def chains(spark):
    rows = [("welding_current", "heat", "depth", 0.9, 0.85), ("welding_current", "transfer", "stability", 0.8, 0.75), ("arc_voltage", "arc", "width", 0.88, 0.82), ("welding_speed", "density", "depth", 0.86, 0.84)]
    return spark.createDataFrame([(p, [p, m, q], [(f"{p}-{m}", x, ["src:1"]), (f"{m}-{q}", y, ["src:2"])]) for p, m, q, x, y in rows], f"start string, node_keys array<string>, rels {REL}")


def limits(spark, speed=True, top=None, unified=None):
    rows = [("e1", "w", "welding_current", 5.0, None, "A", 50.0 if top else None, top, "text", None, ["src:l"]), ("e2", "w", "arc_voltage", 0.2, None, "V", None, None, "text", unified, ["src:l"])]
    if speed:
        rows.append(("e3", "w", "welding_speed", None, 0.5, "mm/s", None, None, None, None, ["src:l"]))
    return spark.createDataFrame(rows, LIMITS)


def run(spark, mode=None, extra=(), **kw):
    p, a = recommend(requirement(spark, mode), cases(spark), rules(spark, extra), chains(spark), limits(spark, **kw))
    return p.orderBy(F.col("rank").asc_nulls_last(), "proposal_id").collect(), {(r.proposal_id, r.parameter_code): r for r in a.collect()}, a


def test_ranked_proposals(spark):
    p, a, frame = run(spark)
    assert [(r.proposal_id, r.base_case_id) for r in p] == [("prop_03", "a"), ("prop_01", "s1"), ("prop_02", "s2")]
    assert [r.confidence for r in p] == [0.7388, 0.7377, 0.7241]
    assert [r.consensus for r in p] == [0.9794, 0.9587, 0.9794]
    assert [r.case_support for r in p] == [0.2756, 0.2, 0.1333]
    assert [r.similarity for r in p] == [0.7333, 0.7778, 0.7556]
    assert {r.knowledge for r in p} == {0.8222} and {r.equipment for r in p} == {0.8333}
    get = lambda q: [(a[q, c].quantized, a[q, c].recommended, a[q, c].magnitude) for c in ("welding_current", "arc_voltage", "welding_speed")]
    assert get("prop_03") == [(20.0, 120.0, "large"), (1.0, 16.0, "large"), (-1.0, 7.0, "medium")]
    assert get("prop_01") == [(5.0, 125.0, "small"), (0.2, 16.2, "small"), (-0.5, 6.5, "small")]
    assert get("prop_02") == [(5.0, 120.0, "small"), (0.2, 16.0, "small"), (-0.5, 7.0, "small")]
    assert a["prop_01", "welding_current"].fallback and not a["prop_03", "welding_current"].fallback
    assert a["prop_03", "welding_current"].path_ids == ["heat-depth", "ru_c", "welding_current-heat"]
    assert "wire_extension" not in {c for _, c in a}
    assert violations(frame, adjustment_rules(), "proposal_id").count() == 0


def test_missing_step_stops_one_parameter(spark):
    p, a, _ = run(spark, speed=False)
    assert len(p) == 3 and {c for _, c in a} == {"welding_current", "arc_voltage"}
    assert "welding_speed: no_step" in p[0].warnings


def test_out_of_range_makes_all_invalid(spark):
    p, a, _ = run(spark, top=110.0)
    assert not any(r.valid for r in p) and not a and all(r.rank is None for r in p)
    assert any("above_max" in w for w in p[0].warnings)


@pytest.mark.parametrize("mode, blocked", [(None, True), ("unified", True), ("separate", False)])
def test_voltage_follows_mode(spark, mode, blocked):
    _, a, _ = run(spark, mode=mode, unified="voltage follows current")
    assert (("prop_01", "arc_voltage") not in a) == blocked


def test_contradicting_rules_stop_a_parameter(spark):
    p, a, _ = run(spark, extra=[("ru_no", "welding_current", "decrease", 0.5)])
    assert "welding_current" not in {c for _, c in a}
    assert "welding_current: no single direction" in p[0].warnings


@pytest.mark.parametrize("k, n", [(0, 1), (6, 1), (1, 0), (1, 4), (True, 1), (1, 2.0)])
def test_limits_of_counts(k, n):
    with pytest.raises(ValueError):
        check_limits(k, n)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        Adjustment(weights={"similarity": 0.5})
    with pytest.raises(ValueError):
        Adjustment(unknown_range_credit=1.5)


def offered(spark, **more):
    p, a = recommend(requirement(spark), cases(spark), rules(spark), chains(spark), limits(spark), **more)
    return p.orderBy("proposal_id").collect(), {(r.proposal_id, r.parameter_code): r for r in a.collect()}


NUMBERS = ("raw_delta", "quantized", "recommended", "step", "magnitude", "support_case_ids")


def test_selector_keeps_paths_and_changes_no_number(spark):
    plain, before = offered(spark)
    import json

    first = sorted(p for r in before.values() for p in r.knowledge_path_ids)[0]
    p, a = offered(spark, selector=lambda text: json.dumps({"selected_path_ids": [first], "basis": "thicker, so more current"}))
    assert [r.proposal_id for r in p] == [r.proposal_id for r in plain]
    for k in before:
        assert [a[k][n] for n in NUMBERS] == [before[k][n] for n in NUMBERS]
        assert a[k].path_ids  # a parameter of which no path was chosen has its best one
    assert {r.basis for r in p} == {"thicker, so more current"}
    assert any("no path selected, the best kept" in w for r in p for w in r.warnings)


def test_unknown_paths_are_rejected(spark):
    plain, before = offered(spark)
    p, a = offered(spark, selector=lambda text: '{"selected_path_ids": ["path_99", "nope"], "basis": ""}')
    assert all("unknown paths rejected: path_99, nope" in r.warnings and "no path selected, deterministic paths kept" in r.warnings for r in p)
    assert [r.basis for r in p] == [r.basis for r in plain] and all(a[k].path_ids == before[k].path_ids for k in before)
    assert [r.confidence for r in p] == [r.confidence for r in plain]


def test_failing_selector_degrades(spark):
    plain, before = offered(spark)

    def fails(text):
        raise RuntimeError("down")

    for selector, says in ((fails, "selector failed"), (lambda text: "no json", "holds no JSON object"), (lambda text: '{"selected_path_ids": 5}', "no path selected")):
        p, a = offered(spark, selector=selector)
        assert [r.basis for r in p] == [r.basis for r in plain] and all(a[k].path_ids == before[k].path_ids for k in before)
        assert all(any(says in w for w in r.warnings) for r in p)


def test_warnings_of_a_run(spark):
    p, _ = recommend(requirement(spark), cases(spark), rules(spark), chains(spark), limits(spark, top=110.0))
    assert sorted(r.warning.split(":")[0] for r in flow_warnings(p).collect()) == ["base case a excluded", "base case s1 excluded", "base case s2 excluded"]
    p, _ = recommend(requirement(spark), cases(spark), rules(spark), chains(spark), limits(spark), cfg=Adjustment(low_confidence=0.9))
    assert [r.warning for r in flow_warnings(p, Adjustment(low_confidence=0.9)).collect()] == ["best proposal prop_03 has confidence 0.7388 below 0.9"]


def test_report_has_all_its_parts():
    from kilnwork.plans.reasoning import report

    path = {"path_id": "p1", "node_keys": ["thickness_increase", "welding_current", "depth"], "rels": [{"id": "r1", "confidence": 0.8}, {"id": "r2", "confidence": None}], "parameter_code": "welding_current"}
    text = report(
        {"process": "GMAW", "material": "steel"}, {"case_id": "c1", "material": "steel", "welding_current_a": 100.0}, 0.8, [{"field": "thickness_mm", "before": 3, "after": 6, "change": "increase"}], [path],
        {"selected_path_ids": ["p1"], "selection_reason": "thicker", "warnings": ["w"]}, ["material"], others=[("c2", 0.7)], limit_rows=[{"equipment_id": "e", "adjustment_step": 5.0, "unit": "A"}],
        rule_rows=[{"id": "r1", "target_change": "increase", "condition_text": "if thick"}], columns={"welding_current": "welding_current_a"}, parts={"structured": 0.8, "semantic": 0.0},
    )
    for part in ("structured 0.8000", "Other candidates: c2 (0.7000)", "* p1 thickness_increase > welding_current ↑ > depth", "welding_current: increase from 100 (if thick)", "e: step 5 A", "Reason: thicker", "Warning: w"):
        assert part in text
