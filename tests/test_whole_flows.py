"""Acceptance, publishing, settings, case import, block lines, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from kilnwork import settings
from kilnwork.__main__ import main
from kilnwork.operators import document, ingest
from kilnwork.plans import document as plan
from kilnwork.sources import json_files as files
from tests.test_document import PAGES, block

NO_CROPS = "source_ref string, content binary"


@pytest.fixture(scope="module")
def raw(spark):
    pages = dict(PAGES)
    pages[16] = [block("page_header", 0, "焊接手册的页眉"), block("page_header", 5, "页眉"), block("paragraph", 30, "焊接手册的页眉 。正文在此"), block("paragraph", 60, "页眉短"), block("paragraph", 90, "焊接手册的页眉"), block("page_number", 900, "??")]
    return spark.createDataFrame([("d", p, i, b) for p, bs in pages.items() for i, b in enumerate(bs)], "doc_id string, pdf_page int, original_index int, block string")


@pytest.fixture(scope="module")
def done(spark, raw):
    p = plan.prepare(raw)
    crops = p.blocks.where("block_type = 'table'").select("source_ref", F.lit(b"png").alias("content"))
    files_ = spark.createDataFrame([("a.png", bytearray(b"x"))], "path string, content binary")
    return p, document.assets(p.blocks, files_, crops)


def test_acceptance(raw, done):
    p, records = done
    got = plan.accept(p, raw, records, plan.prepare(raw))
    assert len(got) == 17 and {k: v for k, v in got.items() if not v["ok"]} == {}
    assert plan.accept(p, raw, records)["16_deterministic"] == {"ok": None, "violations": None}


def test_acceptance_notices_damage(spark, raw, done):
    p, records = done
    hurt = lambda **new: plan.accept(plan.Prepared(**{**vars(p), **new}), raw, records)
    bad = lambda r: {k.split("_")[0] for k, v in r.items() if v["ok"] is False}
    assert {"1"} <= bad(hurt(sections=p.sections.unionByName(p.sections.limit(1))))
    assert {"4"} <= bad(hurt(items=p.items.withColumn("item_order", F.col("item_order") + 1)))
    assert {"5", "7"} <= bad(hurt(items=p.items.where("item_type <> 'text_segment'")))
    assert "15" in bad(hurt(items=p.items.withColumn("EntityName", F.lit(1))))
    assert "14" in bad(hurt(blocks=p.blocks.withColumn("raw_text", F.lit("x"))))
    assert "3" in bad(hurt(blocks=p.blocks.withColumn("section_id", F.lit("x"))))
    gone = records.withColumn("exists", F.lit(False)).withColumn("origin", F.lit("failed"))
    assert {"8", "9", "12"} <= bad(plan.accept(p, raw, gone))
    cfg = settings.document() | {"validation": settings.DOCUMENT["validation"] | {"expected_assets": {"pdf_crop": 33}}}
    assert "11" in bad(plan.accept(p, raw, records, cfg=cfg))
    listed = records.withColumn("origin", F.lit("parsed_asset"))
    assert "10" in bad(plan.accept(plan.Prepared(**{**vars(p), "blocks": p.blocks.withColumn("image_path", F.lit("img/"))}), raw, listed))


def test_header_residue(done):
    b = {r.raw_text: r for r in done[0].blocks.where("pdf_page = 16 and block_type = 'paragraph'").collect()}
    assert b["焊接手册的页眉 。正文在此"].normalized_text == "正文在此" and "header_residue_stripped" in b["焊接手册的页眉 。正文在此"].rules
    assert [i.code for i in b["焊接手册的页眉 。正文在此"].issues] == ["header_residue_stripped"]
    assert b["页眉短"].normalized_text == "页眉短"
    assert b["焊接手册的页眉"].status == "needs_review" and [i.code for i in b["焊接手册的页眉"].issues] == ["header_residue_stripped", "empty_text"]


def test_issues_and_origin(done):
    b = done[0].blocks
    assert {i.code for r in b.where("block_type in ('list_item', 'unknown', 'figure_title')").collect() for i in r.issues} == {"list_bbox_shared", "unknown_type", "missing_bbox", "caption_bbox_inherited"}
    assert b.where("parent_origin[0] <> pdf_page or parent_origin[1] <> original_index").count() == 0


def test_structure_registry_and_notes(done):
    p, records = done
    s = plan.structure(p, "Book").orderBy("section_order").collect()
    assert s[0].section_id.endswith("root") and s[0].title == "Book" and s[0].start_page is None and s[1].level == 1
    assert [i.item_order for r in s if r.content for i in r.content][:2] == [1, 2]
    reg = {r.block_type: (r.asset_path, r.asset_origin) for r in plan.registry(p, records).collect()}
    assert reg["figure"] == ("a.png", "parsed_asset") and reg["table"][1] == "pdf_crop" and reg["paragraph"] == (None, None)
    assert [r.notes for r in document.visual_notes(p.captions, p.blocks).collect()] == [["注"]]
    left = {(r.why, r.block_type): r.n for r in plan.skipped_margins(p).collect()}
    assert left["margin", "page_number"] == 6 and left["caption", "figure_title"] == 1


def test_page_number_audit(raw):
    r = plan.page_number_audit(document.derive(raw), 2).first()
    assert r.page_number_blocks == 6 and r.pages_without == [12]
    assert [(h.pdf_page, [(v.kind, v.value) for v in h["values"]]) for h in r.head] == [(0, [("roman", "Ⅱ")]), (11, [("arabic", "5")])]
    assert [t.pdf_page for t in r.tail] == [15, 16] and r.tail[1]["values"][0].kind == "unknown"


def test_block_lines_round_trip(spark):
    lines = ['{"block_id":"b1","pdf_page":3,"text":"a \\"q\\" é","latex":"x^2","odd":{"k":[1,2.5,null]},"flag":true,"n\\"k":null}', '{"block_id":"b2","pdf_page":null,"text":null}']
    schema = "block_id string, pdf_page int, text string"
    b = document.block_from_json(spark.createDataFrame([(x,) for x in lines], "value string"), schema)
    out = [json.loads(r.value) for r in document.block_json(b, ["block_id", "pdf_page", "text"]).collect()]
    assert sorted(out, key=lambda x: x["block_id"]) == [json.loads(x) for x in lines]


@pytest.mark.parametrize("path, want", [("img/a.png", "/base/img/a.png"), ("./x/../a.png", "/base/a.png"), ("/abs/a.png", "/abs/a.png"), ("s3://b/a.png", "s3://b/a.png"), (" ", None), (None, None)])
def test_resolved_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(document.resolved_path(F.col("p"), "/base/").alias("p")).first().p == want


def test_settings(tmp_path):
    def written(value):
        (tmp_path / "c.json").write_text(json.dumps(value))
        return str(tmp_path / "c.json")

    assert settings.adjustment() == settings.Adjustment() and settings.retrieval() == settings.Retrieval()
    assert settings.adjustment(written({"low_confidence_threshold": 0.7})).low_confidence == 0.7
    assert [f.name for f in settings.retrieval(written({"top_k": 3})).fields][:2] == ["material", "thickness_mm"]
    for load, wrong in (
        (settings.adjustment, {"confidence_weights": {"similarity": 0.9}}), (settings.adjustment, {"confidence_weights": {"similarity": -0.3}}), (settings.adjustment, {"equipment": {"unknown_range_credit": 2}}),
        (settings.adjustment, {"magnitude": {"quantile_medium": 0.9}}), (settings.retrieval, {"top_k": 0}), (settings.retrieval, {"structured_fields": {"material": {"type": "text"}}}),
        (settings.document, {"document": {"id": ""}}), (settings.document, {"page": {"bounds": [0, 0, 1]}}), (settings.document, {"heading": {"level_patterns": [{"regex": "x", "level": 7}]}}),
        (settings.document, {"source_ref_codes": None}), (settings.graph_schema, {"node_labels": {"A": "code"}, "relationships": {"R": [["A", "B"]]}}),
    ):
        with pytest.raises(ValueError):
            load(written(wrong))
    s = settings.Services.from_env({"KILNWORK_LLM_URL": "http://x", "KILNWORK_LLM_KEY": "secret", "KILNWORK_EMBEDDING_URL": " "})
    assert s.llm_url == "http://x" and s.embedding_url == settings.Services().embedding_url and "secret" not in repr(s)


def test_case_import(spark):
    nodes = spark.createDataFrame([("Condition", "flat"), ("Parameter", "current"), ("Quality", "good")], "label string, key string")
    kind = "case_id string, process string, retrieval_text string, conditions array<string>, parameters array<string>, results array<string>"
    cases = spark.createDataFrame([("c1", "GMAW", "text", ["condition:flat"], ["parameter:current"], []), ("c2", "MIG", None, [], [], ["quality:good"])], kind)
    none = cases.select("case_id", "process", "retrieval_text").limit(0)
    no_edges = spark.createDataFrame([], "src string, type string, dst string")
    errors, merged, edges, counts = ingest.import_cases(cases, none, no_edges, nodes, lambda texts: [[1.0, 2.0] for _ in texts])
    assert errors.count() == 0 and {r.action: r.n for r in counts.collect()} == {"created": 2}
    assert sorted(tuple(r) for r in edges.collect()) == [("c1", "HAS_CONDITION", "flat"), ("c1", "HAS_PARAMETER", "current"), ("c2", "HAS_RESULT", "good")]
    stored = spark.createDataFrame(merged.drop("action").collect(), merged.drop("action").schema)
    # Again without an embedder: nothing changes, the embedding stays, a new reference is merged all the same.
    more = cases.where("case_id = 'c2'").withColumn("parameters", F.array(F.lit("parameter:current")))
    _, again, edges, counts = ingest.import_cases(more, stored, edges, nodes)
    assert {r.action: r.n for r in counts.collect()} == {"skipped": 1} and edges.count() == 4
    assert again.where("case_id = 'c1'").first().embedding == [1.0, 2.0]
    _, _, _, counts = ingest.import_cases(more.withColumn("process", F.lit("TIG")), stored, edges, nodes)
    assert {r.action: r.n for r in counts.collect()} == {"updated": 1}
    wrong = spark.createDataFrame([("c1", "G", None, ["condition:no", "bad"], [], []), ("c1", "G", None, [], [], [])], kind)
    errors, merged, _, _ = ingest.import_cases(wrong, none, no_edges, nodes)
    assert merged is None and {(r.error, r.value) for r in errors.collect()} == {("duplicate_case", "c1"), ("bad_conditions", "bad"), ("missing_conditions", "no")}
    stay, gone = ingest.deleted_by_prefix(cases, "case_id", "c1")
    assert gone == 1 and stay.count() == 1


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for n in (3, 5):
        files.publish(spark, {"a": spark.range(n), "b": spark.range(n)}, path)
        assert files.published(spark, path, "a").count() == files.published(spark, path, "b").count() == n
    for n in (2, 4):
        files.write_table_atomic(spark, spark.range(n), f"file://{tmp_path}/t")
        assert spark.read.parquet(f"file://{tmp_path}/t").count() == n
    assert sorted(x.name for x in tmp_path.iterdir()) == ["store", "t"]


def test_command_line(spark, tmp_path, capsys):
    pages = [[json.loads(b) for b in PAGES.get(i, [])] for i in (0, 11, 12)]
    (tmp_path / "doc.json").write_text(json.dumps(pages, ensure_ascii=False))
    assert main(["docs", "audit", "--input", f"file://{tmp_path}/doc.json"], spark) == 0
    assert "paragraph" in capsys.readouterr().out
    assert main(["docs", "run", "--input", f"file://{tmp_path}/doc.json", "--out", f"file://{tmp_path}/out"], spark) == 1  # visuals without assets
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert set(report) == {"meta", "input_audit", "stages", "quality"} and report["quality"]["1_sections_valid"]["ok"]
    capsys.readouterr()
    graph = {"nodes": [{"id": "n1", "label": "Parameter", "properties": {"code": "current", "name": "n", "definition": "d", "source_refs": ["s:1"]}}, {"id": "n2", "label": "Condition", "properties": {"code": "flat", "name": "n", "definition": "d", "source_refs": ["s:1"]}}], "relationships": [{"id": "r1", "type": "SUGGESTS_ADJUSTMENT", "from": "n2", "to": "n1", "properties": {"confidence": 0.5}}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    for action in ("created", "skipped"):
        assert main(["import-graph", "--graph", f"file://{tmp_path}/g.json", "--store", f"file://{tmp_path}/graph"], spark) == 0
        assert [c["action"] for c in json.loads(capsys.readouterr().out)["counts"]] == [action]
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"case_id": "k", "process": "GMAW", "conditions": ["condition:flat"], "parameters": ["parameter:current"], "results": []}]}))
    assert main(["import-cases", "--cases", f"file://{tmp_path}/c.json", "--graph-store", f"file://{tmp_path}/graph", "--store", f"file://{tmp_path}/cases"], spark) == 0
    assert files.published(spark, f"file://{tmp_path}/cases", "edges").count() == 2
