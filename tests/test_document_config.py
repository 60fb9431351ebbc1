"""Each key of the document configuration changes a result; captions compete; crops come in by the command."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from kilnwork import settings
from kilnwork.__main__ import main
from kilnwork.operators import document
from kilnwork.plans import document as plan
from kilnwork.sources import json_files as files
from tests.test_document import PAGES


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("d", p, i, b) for p, bs in PAGES.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "doc_id string, pdf_page int, original_index int, block string")


def changed(**keys):
    cfg = copy.deepcopy(settings.document())
    for key, value in keys.items():
        part, name = key.split("__")
        cfg[part][name] = value
    return cfg


@pytest.fixture(scope="module")
def base(raw):
    return plan.prepare(raw)


def test_names(raw, base):
    p = plan.prepare(raw, cfg=changed(document__id="manual", document__version="v7"))
    assert {r.section_id.split(":sec:")[0] for r in p.sections.collect()} == {"manual:v7"}
    assert all(r.item_id.startswith("manual:v7:") for r in p.items.collect()) and all(r.source_ref.startswith("MANUAL:V7:PDFP") for r in p.blocks.collect())
    assert all(r.section_id.startswith("doc:v1:sec:") for r in base.sections.collect())


def test_codes_and_levels(raw, base):
    cfg = changed()
    cfg["source_ref_codes"] = {**cfg["source_ref_codes"], "figure": "pic"}
    cfg["heading"]["level_patterns"] = [{"regex": r"^1\.1", "level": 5}, *cfg["heading"]["level_patterns"]]
    p = plan.prepare(raw, cfg=cfg)
    assert p.blocks.where("block_type = 'figure'").first().source_ref.endswith("pic01")
    assert {r.level for r in p.sections.where("title = '1.1 基础'").collect()} == {5} != {r.level for r in base.sections.where("title = '1.1 基础'").collect()}


def test_pages_and_gaps(raw, base):
    front = lambda p: p.sections.where("number like 'front:%'").count()
    assert front(plan.prepare(raw, cfg=changed(page__front_last_page=-1))) == 0 < front(base)
    near = lambda p: p.captions.where("origin like 'proximity:%'").count()
    assert near(base) == 1 and near(plan.prepare(raw, cfg=changed(association__caption_gap=1))) == 0
    sure = plan.prepare(raw, cfg=changed(association__min_confidence=1.0)).captions.where("origin like 'proximity:%'").first()
    assert sure.confidence == 1.0 > base.captions.where("origin like 'proximity:%'").first().confidence
    assert sure.caption_no == "1-2"


def test_bounds(raw):
    few = lambda cfg: {x["problem"]: x["n"] for x in plan.audit(raw, cfg)["boxes"]}.get("out_of_bounds", 0)
    assert few(changed(page__bounds=[0, 0, 50, 50])) > few(changed(page__bounds=[0, 0, 50, 50], page__bbox_tolerance=500)) >= few(changed())


def test_crops(raw, base, spark):
    records = document.assets(base.blocks, spark.createDataFrame([], "path string, content binary"), spark.createDataFrame([], "source_ref string, content binary"))
    small, large = (plan.crop_requests(base, records, changed(assets__dpi=d)).orderBy("source_ref").collect() for d in (72, 144))
    assert len(small) == len(large) == 2 and all(b.box.w in (2 * a.box.w, 2 * a.box.w + 1) for a, b in zip(small, large))


def test_issues_of_captions(base):
    got = {(r.code, r.severity) for r in base.caption_issues.collect()}
    assert ("reclassified_from_paragraph", "info") in got
    bare = base.blocks.where("block_type in ('figure', 'table')").count() - base.captions.where("part_type <> 'table_note'").select("visual_id").distinct().count()
    assert base.caption_issues.where("code = 'caption_missing'").count() == bare


def test_each_text_is_one_caption(spark):
    rows = [
        (1, "figure", [0.0, 100.0, 9.0, 200.0], ""), (2, "figure", [0.0, 220.0, 9.0, 300.0], ""), (3, "table", [0.0, 320.0, 9.0, 400.0], ""), (4, "figure", [0.0, 900.0, 9.0, 950.0], ""),
        (5, "paragraph", [0.0, 205.0, 9.0, 215.0], "图 1-1 a"), (6, "paragraph", [0.0, 305.0, 9.0, 315.0], "表 1-2 b"), (7, "paragraph", [0.0, 330.0, 9.0, 331.0], "no caption"),
    ]
    b = spark.createDataFrame([("d", 1, f"b{n}", n, k, n, x, t, "normal", False) for n, k, x, t in rows], "doc_id string, pdf_page int, block_id string, original_index int, block_type string, pos int, bbox array<double>, normalized_text string, status string, in_tree boolean")
    none = document.embedded_captions(b)
    got = document.proximity_captions(b, none)
    assert "Arrow" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.visual_id, r.caption_id, r.caption_no, r.caption_type) for r in got.collect()) == [("b1", "b5", "1-1", "figure_title"), ("b2", "b6", "1-2", "figure_title")]
    assert sorted(r.block_id for r in document.caption_issues(b, none, got).where("code = 'caption_missing'").collect()) == ["b3", "b4"]


def test_command_with_crops(spark, tmp_path, capsys):
    pages = [[json.loads(b) for b in PAGES.get(i, [])] for i in (0, 11, 12)]
    (tmp_path / "doc.json").write_text(json.dumps(pages, ensure_ascii=False))
    args = ["docs", "run", "--input", f"file://{tmp_path}/doc.json", "--out", f"file://{tmp_path}/out"]
    assert main(args, spark) == 1  # visuals without assets
    asked = files.published(spark, f"file://{tmp_path}/out", "crop_requests").collect()
    (tmp_path / "crops").mkdir()
    for r in asked:
        (tmp_path / "crops" / f"{r.source_ref.replace(':', '_')}.png").write_bytes(b"png of " + r.source_ref.encode())
    main([*args, "--crops", f"file://{tmp_path}/crops"], spark)
    registry = files.published(spark, f"file://{tmp_path}/out", "registry")
    assert {r.asset_origin for r in registry.where("block_type in ('figure', 'table')").collect()} == {"pdf_crop"}
    assert files.published(spark, f"file://{tmp_path}/out", "crop_requests").count() == 0
    assert registry.where(F.col("asset_origin") == "failed").count() == 0
