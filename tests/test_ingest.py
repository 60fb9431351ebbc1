"""Sources, sinks, ingest, reasoning and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from kilnwork.model import REQUIREMENT
from kilnwork.operators import graph, ingest
from kilnwork.plans import reasoning
from kilnwork.sources import json_files as J
from kilnwork.streaming.requests import stream_requirements

NODES = [
    {"id": "c", "label": "Condition", "properties": {"code": "thickness_increase", "name": " n ", "definition": "d", "source_refs": ["s:1"]}},
    {"id": "p", "label": "Parameter", "properties": {"code": "welding_current", "name": "n", "definition": "d", "source_refs": ["s:1"]}},
    {"id": "m", "label": "Mechanism", "properties": {"code": "heat", "layer": "pool", "name": "n", "definition": "d", "source_refs": ["s:1"]}},
    {"id": "m2", "label": "Mechanism", "properties": {"code": "melt", "layer": "pool", "name": "n", "definition": "d", "source_refs": ["s:1"]}},
    {"id": "q", "label": "Quality", "properties": {"code": "depth", "name": "n", "definition": "d", "source_refs": ["s:1"]}},
    {"id": "e", "label": "Equipment", "properties": {"equipment_id": "w", "name": "n", "definition": "d", "source_refs": ["s:1"]}},
]
EDGES = [
    {"id": "1", "type": "SUGGESTS_ADJUSTMENT", "from": "c", "to": "p", "properties": {"target_change": "increase", "confidence": 0.8, "source_refs": ["s:2", "s:1"]}},
    {"id": "2", "type": "AFFECTS", "from": "p", "to": "m", "properties": {"confidence": 0.9, "source_refs": ["s:1", "s:3"]}},
    {"id": "3", "type": "AFFECTS", "from": "m", "to": "q", "properties": {}},
    {"id": "4", "type": "DETERMINES", "from": "m", "to": "m2", "properties": {}},
    {"id": "5", "type": "AFFECTS", "from": "m2", "to": "m", "properties": {}},
    {"id": "6", "type": "LIMITS", "from": "e", "to": "p", "properties": {"adjustment_step": 5, "unit": "A"}},
]
CASE = {"case_id": "k1", "process": "MIG", "material": "steel", "thickness_mm": 3.0, "joint_type": "butt", "position": "flat", "wire_diameter_mm": 1.0, "shielding_gas": "CO2", "conditions": ["condition:thickness_increase"], "parameters": ["welding_current"]}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("json")
    (d / "graph.json").write_text(json.dumps({"nodes": NODES, "relationships": EDGES}, indent=1))
    (d / "cases.json").write_text(json.dumps({"cases": [CASE, CASE | {"case_id": "k2", "thickness_mm": None, "material": "x"}]}))
    (d / "need.json").write_text(json.dumps({"_comment": 1, "process": "MIG", "material": "steel", "thickness_mm": 6, "position": "vertical"}))
    (d / "doc.json").write_text(json.dumps([[{"type": "title"}], [], [{"type": "list"}, {"type": "x"}]]))
    (d / "bad.json").write_text(json.dumps({"a": 1}))
    return d


def test_readers(spark, files):
    nodes, edges = J.read_graph(spark, f"file://{files}/graph.json")
    assert [(r.id, r.key, r.layer) for r in nodes.orderBy("ord").collect()][2:] == [("m", "heat", "pool"), ("m2", "melt", "pool"), ("q", "depth", None), ("e", "w", None)]
    assert edges.where("id = '6'").first().adjustment_step == 5.0
    assert J.read_cases(spark, f"file://{files}/cases.json").orderBy("ord").select("case_id").collect()[1][0] == "k2"
    assert J.read_requirements(spark, f"file://{files}/need.json").first().requirement_id.endswith("need.json")
    assert [(r.pdf_page, r.original_index) for r in J.read_blocks(spark, f"file://{files}/doc.json").collect()] == [(1, 0), (3, 0), (3, 1)]
    with pytest.raises(Exception, match="list of lists"):
        J.read_blocks(spark, f"file://{files}/bad.json").collect()


def test_sinks(spark, tmp_path):
    J.write_json_atomic(f"{tmp_path}/a.json", {"b": 1, "a": "é"})
    assert (tmp_path / "a.json").read_text().index('"a"') < (tmp_path / "a.json").read_text().index('"b"')
    for n in (3, 5):
        J.write_table_atomic(spark, spark.range(n), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 5
    assert J.without_field({"a": [{"embedding": 1, "b": 2}], "embedding": 3}) == {"a": [{"b": 2}]}
    (tmp_path / "c.json").write_text('{"x": {"b": 2}}')
    assert J.read_config(f"{tmp_path}/c.json", {"x": {"a": 1, "b": 1}, "y": 0}) == {"x": {"a": 1, "b": 2}, "y": 0}


def test_import_is_idempotent_and_all_or_nothing(spark, files):
    nodes, edges = J.read_graph(spark, f"file://{files}/graph.json")
    errors, n, e = ingest.import_graph(nodes, edges, nodes.drop("ord").limit(0), edges.drop("ord").limit(0))
    assert errors.isEmpty() and {(r.action, r.n) for r in ingest.import_counts(n, e).collect()} == {("created", 12)}
    assert n.where("id = 'c'").first().name == "n"
    _, n2, e2 = ingest.import_graph(nodes, edges, n.drop("action"), e.drop("action"))
    assert {(r.action, r.n) for r in ingest.import_counts(n2, e2).collect()} == {("skipped", 12)}
    bad = edges.withColumn("dst", F.when(F.col("id") == "2", "q").when(F.col("id") == "3", "zz").otherwise(F.col("dst")))
    errors, n, _ = ingest.import_graph(nodes, bad, nodes.drop("ord"), edges.drop("ord"))
    assert {(r.id, r.error) for r in errors.collect()} == {("2", "forbidden_pair"), ("3", "missing_endpoint")} and n is None


def test_upsert_keeps_vectors(spark):
    a = spark.createDataFrame([(1, "x", [1.0]), (2, "y", [2.0])], "k int, t string, v array<double>")
    b = spark.createDataFrame([(1, "x", None), (2, "z", None), (3, "w", None)], "k int, t string, v array<double>")
    assert {(r.k, r.t, tuple(r.v or ()), r.action) for r in ingest.upsert(a, b, ["k"], ["v"]).collect()} == {(1, "x", (1.0,), "skipped"), (2, "z", (2.0,), "updated"), (3, "w", (), "created")}


def test_case_references(spark, files):
    nodes, _ = J.read_graph(spark, f"file://{files}/graph.json")
    e = ingest.case_edges(J.read_cases(spark, f"file://{files}/cases.json"))
    assert e.count() == 4
    r = ingest.enrich_refs(e, nodes).where("case_id = 'k1'").first()
    assert (r.conditions, r.parameters, r.results) == (["condition:thickness_increase"], ["parameter:welding_current"], [])


def test_reasoning(spark, files):
    nodes, edges = J.read_graph(spark, f"file://{files}/graph.json")
    need = J.read_requirements(spark, f"file://{files}/need.json").withColumn("requirement_id", F.lit("r"))
    matches, diffs, paths = reasoning.reason(need, J.read_cases(spark, f"file://{files}/cases.json"), nodes, edges)
    best = matches.where("rank = 1").first()
    assert (best.r.case_id, best.structured_score) == ("k1", 0.5)
    assert {r.code for r in diffs.collect()} == {"material_same", "thickness_increase", "position_to_vertical"}
    p = [r.asDict(True) for r in paths.orderBy("path_id").collect()]
    # no edge twice: with two hops the way over m2 comes back to m and on to q
    assert [(x["path_id"], x["hops"], x["node_keys"][1:]) for x in p] == [("p000", 0, ["welding_current", "heat", "depth"]), ("p001", 2, ["welding_current", "heat", "melt", "heat", "depth"])]
    assert p[0]["source_refs"] == ["s:2", "s:1", "s:3"] and p[0]["equipment_limits"][0]["equipment_id"] == "w"
    d = [r.asDict() for r in diffs.orderBy("ord").collect()]
    picked = reasoning.select_paths({"process": "MIG"}, "k1", d, p, lambda text: '```json\n{"selected_path_ids": ["p001", "p9"], "selection_reason": "because"}\n```')
    assert picked["selected_path_ids"] == ["p001"] and picked["warnings"] == ["unknown path p9"]
    text = reasoning.report({"process": "MIG"}, {"case_id": "k1", "material": "steel"}, 0.5, d, p, picked, ["material"])
    assert "* p001" in text and "confidence 0.80" in text and "because" in text
    rule_rows = [r.asDict() for r in graph.rules(edges, nodes).collect()]
    assert reasoning.conclusions(p, ["p001"], rule_rows, {"welding_current_a": 100.0}, {"welding_current": "welding_current_a"}) == ["welding_current: increase from 100"]
    limits = [r.asDict() for r in graph.limits(edges, nodes, "w", ["welding_current"]).collect()]
    assert reasoning.equipment_notes(limits * 2) == ["w: step 5 A"]
    assert "No similar case" in reasoning.report({}, None, None, [], [], picked, [])


def test_selection_degrades():
    d, p = [{"code": "x", "before": "1", "after": "2"}], [{"path_id": "p000", "node_keys": ["a", "b"]}]
    assert reasoning.parse_selection('say {"a": 1} end') == {"a": 1} and reasoning.parse_selection("[1]") is None

    def broken(_):
        raise OSError("down")

    for selector in (None, broken, lambda _: "no"):
        out = reasoning.select_paths({}, "b", d, p, selector)
        assert out["selected_path_ids"] == [] and out["warnings"]
    assert reasoning.select_paths({}, "b", [], p, None)["warnings"] == ["nothing to select from"]


def test_stream(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"requirement_id": "r1", "process": "MIG"}\n')
    stream_requirements(spark, f"file://{tmp_path}/in", lambda b: b.select("requirement_id", "process"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert [r.requirement_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["r1"]
    assert "requirement_id" in REQUIREMENT
