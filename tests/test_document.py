"""The document flow on a synthetic document, and its parts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.functions import text as T
from kilnwork.operators import checks, document, order
from kilnwork.plans.document import anomalies, prepare, validate


def fragments(s):
    return [{"type": "text", "content": s}]


def block(kind, y, text=None, x=0, x2=100, y2=None, **content):
    if text is not None:
        content[f"{kind}_content"] = fragments(text)
    return json.dumps({"type": kind, "bbox": [x, y, x2, y2 or y + 10], "content": content}, ensure_ascii=False)


PAGES = {
    0: [block("title", 0, "前言"), block("paragraph", 30, "前言正文。"), block("page_number", 900, "Ⅱ")],
    11: [
        block("paragraph", 0, "第 0 段"),
        block("title", 20, "第一章 概述"),
        block("title", 40, "1.1 基础"),
        block("paragraph", 60, "1.1.1 焊接电流的选择 这里是正文内容很长的一段。"),
        block("paragraph", 80, "正文 A，继续　　内容"),
        block("image", 100, image_caption=fragments("图1-1 说明"), image_footnote=fragments("注"), image_source={"path": "a.png"}),
        block("table", 300, y2=400, html="<t/>"),
        block("paragraph", 410, "表 1-2 数据"),
        block("paragraph", 450, "1. 小标题"),
        block("list", 500, list_items=[{"item_content": fragments("一")}, {"item_content": fragments("二")}]),
        block("page_number", 900, "5"),
    ],
    12: [block("paragraph", 0, "续前页"), block("title", 20, "1.1 基础"), block("title", 60, "附录A 表")],
    13: [block("page_number", 900, "7")],
    14: [block("paragraph", 10, "a", 0, 100), block("paragraph", 5, "b", 600, 700), block("paragraph", 30, "c", 0, 100), block("paragraph", 40, "d", 600, 700), block("page_number", 900, "7")],
    15: [block("page_number", 900, "3"), block("paragraph", 20, "1.2 没有空格的段落开头因此不能可靠地拆分，标记。"), json.dumps({"type": "odd"})],
}


@pytest.fixture(scope="module")
def prepared(spark):
    rows = [("d", p, i, b) for p, bs in PAGES.items() for i, b in enumerate(bs)]
    raw = spark.createDataFrame(rows, "doc_id string, pdf_page int, original_index int, block string")
    return prepare(raw), document.derive(raw)


def test_sections(prepared):
    s = prepared[0].sections.orderBy("pos").collect()
    assert [(r.number, r.level, r.parent_id.rsplit(":", 1)[1]) for r in s] == [("front:前言", 1, "root"), ("1", 1, "root"), ("1.1", 2, "1"), ("1.1.1", 3, "1.1"), ("1.1.1.1", 4, "1.1.1"), ("1.1-2", 2, "1"), ("1.A", 2, "1")]
    assert s[4].path == ["第一章 概述", "1.1 基础", "1.1.1 焊接电流的选择", "1. 小标题"]
    assert s[2].end_ref.endswith("0012:para01") and s[2].end_page == 12


def test_printed_pages(prepared):
    got = {r.pdf_page: (r.kind, r.number, r.inferred) for r in prepared[0].pages.collect()}
    assert got == {0: ("roman", 2, False), 11: ("arabic", 5, False), 12: ("arabic", 6, True), 13: ("arabic", 7, False), 14: ("arabic", 7, False), 15: ("arabic", 3, False)}
    codes = {(r.code, r.detail) for r in anomalies(*prepared).collect()}
    assert codes == {("class_transition", "11 roman arabic"), ("duplicate", "7 13 14"), ("regression", "15 7 3")}


def test_captions(prepared):
    got = {(r.text, r.origin, round(r.confidence, 4)) for r in prepared[0].captions.collect()}
    assert got == {("图1-1 说明", "embedded", 1.0), ("注", "embedded", 1.0), ("表 1-2 数据", "proximity:below", 0.9333)}


def test_content(prepared):
    items = prepared[0].items.where("section_id like '%:1.1.1'").orderBy("item_order").collect()
    assert [(r.item_type, r.text) for r in items] == [("text_segment", "这里是正文内容很长的一段。正文 A，继续 内容"), ("figure", None), ("table", None), ("subsection", None)]
    numbers = sorted(int(r.item_id[-4:]) for r in prepared[0].items.where("item_type <> 'subsection'").collect())
    assert numbers == list(range(1, len(numbers) + 1))


def test_columns_and_outcomes(prepared):
    b = prepared[0].blocks
    assert [r.raw_text for r in b.where("pdf_page = 14 and block_type = 'paragraph'").orderBy("pos").collect()] == ["a", "c", "b", "d"]
    assert {r.outcome: r.status for r in b.where("outcome is not null").collect()} == {"split": "normal", "reclassified": "normal", "flagged": "needs_review"}
    assert b.where("block_type = 'unknown'").first().status == "needs_review"


def test_checks_pass_and_notice_damage(prepared):
    p = prepared[0]
    assert set(validate(p).values()) == {0}
    secs = p.sections.withColumn("next_at", F.when(F.col("level") == 2, F.lit(1)).otherwise(F.col("next_at")))
    assert checks.wrong_ends(secs, ["doc_id"], "pos", "level", "next_at").count() == 3
    assert checks.wrong_bindings(p.blocks.withColumn("section_id", F.lit("x")), p.sections, ["doc_id"], "pos", "section_id").count() > 0
    assert checks.fingerprint(p.blocks) == checks.fingerprint(p.blocks.repartition(3))
    assert checks.forbidden_fields(p.blocks, "^(entity|normalized)") == ["normalized_text"]


def test_cycles(spark):
    d = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 9)], "k int, up int")
    assert {r.k for r in checks.cycles(d, "k", "up").collect()} == {3, 4}
    assert [r.k for r in checks.orphans(d, "k", "up").collect()] == [5]


def test_assets(spark, prepared):
    files = spark.createDataFrame([("a.png", bytearray(b"x"))], "path string, content binary")
    crops = spark.createDataFrame([], "source_ref string, content binary")
    got = document.assets(prepared[0].blocks, files, crops)
    assert sorted((r.origin, r.mime_type) for r in got.collect()) == [("failed", None), ("parsed_asset", "image/png")]
    assert checks.asset_counts(got, {"parsed_asset": 1, "failed": 0}).collect()[0].origin == "failed"
    assert checks.changed_assets(got, files.withColumn("content", F.lit(b"y"))).count() == 1
    box = spark.range(1).select(document.crop_box(F.array(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(200.0))).alias("b")).first().b
    assert (box.x, box.y, box.w, box.h) == (124, 187, 374, 250)


CLEAN = [("a\tb", "a b", []), ("焊接 ，电流", "焊接，电流", ["strip_cjk_punct_spaces"]), ("1．5 和 3：4", "1.5 和 3:4", ["fullwidth_unify"]), ("10 ～ 20", "10~20", ["range_symbol_unify"]), ("  x  y ", "x y", ["collapse_spaces", "strip_edges"])]


@pytest.mark.parametrize("text, want, rules", CLEAN)
def test_clean_text(spark, text, want, rules):
    c = spark.createDataFrame([(text,)], "t string").select(T.clean_text(F.col("t"), F.lit("paragraph")).alias("c"), T.clean_text(F.col("t"), F.lit("list_item")).alias("same")).first()
    assert (c.c.text, c.c.rules, c.same.text) == (want, rules, text)


def parent_by_stack(levels):
    stack, out = [], []
    for i, v in enumerate(levels):
        while stack and levels[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else None)
        stack.append(i)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=30), min_size=1, max_size=20))
def test_nesting(spark, runs):
    rows = [(k, i, v) for k, run in enumerate(runs) for i, v in enumerate(run)]
    d = spark.createDataFrame(rows, "k int, p long, level int")
    got = {(r.k, r.p): (r.parent_at, r.next_at) for r in order.ends(order.parents(d, ["k"], "p", "level"), ["k"], "p", "level").collect()}
    for k, run in enumerate(runs):
        up = parent_by_stack(run)
        for i, v in enumerate(run):
            end = next((j for j in range(i + 1, len(run)) if run[j] <= v), None)
            assert got[k, i] == (up[i], end)
