"""Flow: raw blocks -> typed blocks -> reading order -> sections -> clean text -> captions -> ordered content -> checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import text as T
from kilnwork.operators import checks
from kilnwork.operators import document as D
from kilnwork.operators import order as O
from kilnwork.sources.shared import saved


@dataclass
class Prepared:
    blocks: DataFrame
    pages: DataFrame
    sections: DataFrame
    captions: DataFrame
    items: DataFrame
    glue: DataFrame
    caption_issues: DataFrame


def prepare(raw: DataFrame, front_last: int | None = None, cfg: dict | None = None) -> Prepared:
    """All documents of ``raw`` (doc_id, pdf_page, original_index, block) at once. ``cfg``: as ``settings.document`` gives it."""
    from kilnwork.settings import document as settings

    spark, cfg = raw.sparkSession, cfg or settings()
    front_last = cfg["page"]["front_last_page"] if front_last is None else front_last
    prefix, levels = prefix_of(cfg), [(p["regex"], p["level"]) for p in cfg["heading"]["level_patterns"]]
    b = saved(spark, D.split_headings(saved(spark, D.derive(raw), "derived"), front_last, levels), "split")
    pages = saved(spark, D.printed_pages(b), "pages")
    b = saved(spark, D.merge_crossline(D.reading_order(b, prefix, cfg["source_ref_codes"]), cfg["heading"]["cross_line_gap"], levels), "ordered")
    secs = saved(spark, D.section_ends(D.sections(b, front_last, f"{prefix}:sec:", levels), b), "sections")
    b = D.clean(D.bind(b, secs, f"{prefix}:sec:")).join(pages.select("doc_id", "pdf_page", F.col("value").alias("printed_page"), F.col("number").alias("printed_number")), ["doc_id", "pdf_page"], "left")
    b = saved(spark, b, "blocks")
    near = D.embedded_captions(b)
    far = D.proximity_captions(b, near, cfg["association"]["caption_gap"], cfg["association"]["min_confidence"])
    far = saved(spark, far, "near-captions")
    captions = near.select("doc_id", "visual_id", "part_id", "part_type", "text", F.when(F.col("part_type") != "table_note", T.caption_no(F.col("text"))).alias("caption_no"), F.lit(1.0).alias("confidence"), F.lit("embedded").alias("origin"))
    captions = saved(spark, captions.unionByName(far.select("doc_id", "visual_id", F.col("caption_id").alias("part_id"), F.lit("caption").alias("part_type"), F.col("caption").alias("text"), "caption_no", "confidence", F.concat(F.lit("proximity:"), "place").alias("origin"))), "captions")
    skipped = captions.select("doc_id", F.col("part_id").alias("block_id")).distinct()
    return Prepared(b, pages, secs, captions, saved(spark, D.content_items(b, secs, skipped, prefix), "items"), D.glue_flags(b), D.caption_issues(b, near, far))


def prefix_of(cfg: dict) -> str:
    return f"{cfg['document']['id']}:{cfg['document']['version']}"


def crop_requests(p: Prepared, records: DataFrame, cfg: dict) -> DataFrame:
    """(doc_id, source_ref, pdf_page, box): the rectangles to cut out of rendered pages for visuals without an asset."""
    a = cfg["assets"]
    bare = records.where("not exists").select("doc_id", "source_ref")
    box = D.crop_box(F.col("bbox"), a["x_scale"], a["y_scale"], a["margin_ratio"], a["dpi"])
    return p.blocks.where("bbox is not null").join(bare, ["doc_id", "source_ref"], "left_semi").select("doc_id", "source_ref", "pdf_page", box.alias("box"))


def validate(p: Prepared) -> dict[str, int]:
    """Violations by check; all 0 for a sound result."""
    body = p.blocks.where(~F.col("block_type").isin("page_header", "page_footer", "page_number", "page_aside_text"))
    skipped = p.captions.select("doc_id", F.col("part_id").alias("block_id")).distinct()
    text = body.where("not in_tree and block_type not in ('figure', 'table')").join(skipped, ["doc_id", "block_id"], "left_anti").select("doc_id", "block_id")
    members = p.items.where("item_type = 'text_segment'").select("doc_id", F.explode("member_ids").alias("block_id"))
    return checks.acceptance(
        {
            "unique_sections": checks.not_unique(p.sections, ["doc_id", "section_id"]),
            "orphans": checks.orphans(p.sections.withColumn("k", F.concat_ws("|", "doc_id", "section_id")).withColumn("up", F.when(F.col("parent_at").isNotNull(), F.concat_ws("|", "doc_id", "parent_id"))), "k", "up"),
            "cycles": checks.cycles(p.sections.withColumn("k", F.concat_ws("|", "doc_id", "section_id")).withColumn("up", F.when(F.col("parent_at").isNotNull(), F.concat_ws("|", "doc_id", "parent_id"))), "k", "up"),
            "ranges": checks.wrong_ends(p.sections, ["doc_id"], "pos", "level", "next_at"),
            "binding": checks.wrong_bindings(p.blocks, p.sections, ["doc_id"], "pos", "section_id"),
            "order": checks.not_consecutive(p.items, ["doc_id", "section_id"], "item_order"),
            "fusion_complete": checks.both_ways(text, members),
            "unique_blocks": checks.not_unique(p.blocks, ["doc_id", "block_id"]),
        }
    )


def traversal(p: Prepared) -> tuple[DataFrame, DataFrame]:
    """(expected, actual) tokens of each document by place: blocks as they are read, and what a walk through the content gives."""
    skipped = p.captions.select("doc_id", F.col("part_id").alias("block_id")).distinct()
    margins = ("page_header", "page_footer", "page_number", "page_aside_text")
    read = p.blocks.where(~F.col("block_type").isin(*margins)).join(skipped, ["doc_id", "block_id"], "left_anti")
    heads = p.sections.select("doc_id", "block_id", F.col("section_id").alias("sid"))
    token = F.when(F.col("sid").isNotNull(), F.concat(F.lit("sub:"), "sid")).when(F.col("block_type").isin("figure", "table"), F.col("source_ref")).otherwise(F.col("block_id"))
    expected = read.join(heads, ["doc_id", "block_id"], "left").select("doc_id", "pos", token.alias("token"))
    # A section's own content lies before its children's, so the walk is by section, then by item, the root first.
    at = p.sections.select("doc_id", "section_id", F.col("pos").alias("section_pos"), "parent_id")
    own = p.items.where("item_type <> 'subsection'").join(at.drop("parent_id"), ["doc_id", "section_id"], "left")
    tokens = F.when(F.col("item_type") == "text_segment", F.col("member_ids")).otherwise(F.col("source_refs"))
    inner = own.select("doc_id", F.coalesce("section_pos", F.lit(-1)).alias("a"), F.lit(1).alias("b"), F.col("item_order").alias("c"), F.posexplode(tokens).alias("d", "token"))
    listed = p.items.where("item_type = 'subsection'").select("doc_id", F.col("child_id").alias("section_id"), "item_id").join(at.drop("parent_id"), ["doc_id", "section_id"])
    heads_met = listed.select("doc_id", F.col("section_pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), F.concat(F.lit("sub:"), "item_id").alias("token"))
    walk = inner.unionByName(heads_met).withColumn("pos", F.struct("a", "b", "c", "d")).select("doc_id", "pos", "token")
    return expected, walk


def accept(p: Prepared, raw: DataFrame, records: DataFrame, again: Prepared | None = None, cfg: dict | None = None) -> dict[str, dict]:
    """The 17 items of acceptance: whether each holds, and how many rows break it. ``records``: of all visuals, as ``assets`` gives them.

    ``again`` is a second run's result, for the check that runs agree; without one that item is not judged. Numbers of
    assets are judged where the configuration expects some.
    """
    from kilnwork.settings import document as settings

    cfg = cfg or settings()
    rules = cfg["validation"]
    found = validate(p)
    visuals = p.blocks.where("block_type in ('figure', 'table')").select("doc_id", "block_id", "block_type", "source_ref", "image_path")
    held = visuals.join(records.select("doc_id", "source_ref", "origin", F.col("exists").alias("has")), ["doc_id", "source_ref"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    expected, walk = traversal(p)
    members = p.items.where("item_type = 'text_segment'").select("doc_id", "item_id", F.explode("member_ids").alias("block_id")).join(p.blocks.select("doc_id", "block_id", "pos"), ["doc_id", "block_id"])
    fused = members.groupBy("doc_id", "item_id").agg(F.min("pos").alias("first_at"), F.max("pos").alias("last_at"))
    walls = p.blocks.where("in_tree or block_type in ('figure', 'table')").select("doc_id", F.col("pos").alias("at"))
    last_page = p.blocks.groupBy("doc_id").agg(F.max("pdf_page").alias("last_page"))
    at_end = p.sections.join(last_page, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("end_page") == F.col("last_page")).alias("ending"))
    late = at_end.where((F.col("n") >= 1 / rules["last_page_share"]) & (F.col("ending") >= F.col("n") * rules["last_page_share"])).count()
    forbidden = [f for df in (p.blocks, p.sections, p.items) for f in checks.forbidden_fields(df, f"(?i){rules['forbidden_fields']}")]
    wanted = rules["expected_assets"]
    n = {
        "1_sections_valid": found["unique_sections"] + found["orphans"] + found["cycles"],
        "2_section_ranges_valid": found["ranges"] + late,
        "3_blocks_bound_to_deepest_section": found["binding"],
        "4_content_order_strict": found["order"],
        "5_traversal_matches_reading_order": checks.first_difference(expected, walk, ["doc_id"], "pos", "token").count(),
        "6_fusion_no_cross_boundary": checks.boundary_inside(fused, walls, ["doc_id"]).count(),
        "7_fusion_restores_all_text_blocks": found["fusion_complete"],
        "8_all_figures_have_assets": held.where("block_type = 'figure' and not has").count(),
        "9_all_tables_have_assets": held.where("block_type = 'table' and not has").count(),
        "10_asset_path_not_directory": held.where("has and origin = 'parsed_asset' and image_path like '%/'").count(),
        "11_asset_counts": checks.asset_counts(records, wanted).count() if wanted else 0,
        "12_visual_source_ref_resolvable": unresolved(p, records).count(),
        "13_captions_not_duplicated": caption_repeated(p).count(),
        "14_raw_text_preserved": raw_preserved(p, raw).count(),
        "15_no_knowledge_fields": len(forbidden),
        "16_deterministic": None if again is None else sum(checks.fingerprint(a) != checks.fingerprint(b) for a, b in ((p.blocks, again.blocks), (p.sections, again.sections), (p.items, again.items))),
        "17_no_human_gate": 0,
    }
    return {name: {"ok": None if v is None else v == 0, "violations": v} for name, v in n.items()}


def anomalies(p: Prepared, raw_blocks: DataFrame) -> DataFrame:
    """(doc_id, code, detail) of page numbers: class changes, gaps, duplicates, the first fall."""
    a = D.page_anchors(raw_blocks)
    arabic = a.where("kind = 'arabic'")
    parts = [
        O.class_transitions(a, ["doc_id"], ["pdf_page"], "kind").select("doc_id", F.lit("class_transition").alias("code"), F.concat_ws(" ", "pdf_page", "before", "kind").alias("detail")),
        O.nonlinear_gaps(arabic, ["doc_id"], "pdf_page", "number").select("doc_id", F.lit("nonlinear_gap").alias("code"), F.concat_ws(" ", "p0", "p1", "n0", "n1").alias("detail")),
        O.duplicate_numbers(p.pages, ["doc_id"], "pdf_page", "number").select("doc_id", F.lit("duplicate").alias("code"), F.concat_ws(" ", "number", "first_at", "pdf_page").alias("detail")),
        O.first_regression(p.pages, ["doc_id"], "pdf_page", "number").select("doc_id", F.lit("regression").alias("code"), F.concat_ws(" ", "at", "before", "after").alias("detail")),
    ]
    return O.union_all(parts)


def registry(p: Prepared, records: DataFrame | None = None) -> DataFrame:
    """Where each reference stands, by reference; visuals with their asset's path and origin (blank without one, null for other blocks)."""
    blocks = p.blocks
    if records is not None:
        a = records.select("doc_id", "source_ref", F.when(F.col("exists"), F.coalesce("original_path", F.lit(""))).otherwise("").alias("asset_path"), F.when(F.col("exists"), F.col("origin")).otherwise("").alias("asset_origin"))
        blocks = blocks.join(a, ["doc_id", "source_ref"], "left")
    else:
        blocks = blocks.withColumn("asset_path", F.lit(None).cast("string")).withColumn("asset_origin", F.lit(None).cast("string"))
    return blocks.select("asset_path", "asset_origin", "doc_id", "source_ref", "block_id", "block_type", "pdf_page", "printed_page", "printed_number", "bbox", "section_id").orderBy("doc_id", "source_ref")


def structure(p: Prepared, title: str = "", prefix: str = "doc:v1:sec:") -> DataFrame:
    """One row for each section of each document, the root first, with its place and its ordered content."""
    root = p.blocks.select("doc_id").distinct().select("doc_id", F.lit(f"{prefix}root").alias("section_id"), F.lit(title).alias("title"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("int").alias("start_page"), F.lit(None).cast("string").alias("start_ref"), F.lit(None).cast("string").alias("end_ref"), F.lit(None).cast("int").alias("end_page"))
    rows = p.sections.select("doc_id", "section_id", "title", "level", "parent_id", "path", F.col("pdf_page").alias("start_page"), F.col("source_ref").alias("start_ref"), "end_ref", "end_page")
    item = F.struct("item_order", "item_type", "item_id", "text", "member_ids", "source_refs")
    content = p.items.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(item)).alias("content"))
    s = root.unionByName(rows).join(content, ["doc_id", "section_id"], "left")
    order = F.row_number().over(O.W.partitionBy("doc_id").orderBy(F.col("start_page").asc_nulls_first(), "section_id"))
    return s.withColumn("section_order", order)


def skipped_margins(p: Prepared) -> DataFrame:
    """How many blocks of each kind the content leaves out: margins, and captions that belong to a visual."""
    own = p.captions.select("doc_id", F.col("part_id").alias("block_id")).distinct().withColumn("why", F.lit("caption"))
    margin = F.when(F.col("block_type").isin("page_header", "page_footer", "page_number", "page_aside_text"), "margin")
    b = p.blocks.join(own, ["doc_id", "block_id"], "left").withColumn("why", F.coalesce(margin, "why")).where("why is not null")
    return b.groupBy("doc_id", "why", "block_type").agg(F.count(F.lit(1)).alias("n"))


def page_number_audit(blocks: DataFrame, k: int = 5) -> DataFrame:
    """For each document: how many page-number blocks, the pages without one, and the first and last ``k`` pages with their values."""
    kinds = T.page_class(F.col("raw_text"))
    marks = blocks.where("block_type = 'page_number'").select("doc_id", "pdf_page", "original_index", kinds.alias("c"))
    page = marks.groupBy("doc_id", "pdf_page").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("original_index", F.struct(F.coalesce("c.kind", F.lit("unknown")).alias("kind"), F.col("c.value").alias("value")).alias("v")))), lambda x: x["v"]).alias("values"))
    every = blocks.select("doc_id", "pdf_page").distinct().join(page, ["doc_id", "pdf_page"], "left")
    seen = O.W.partitionBy("doc_id")
    every = every.withColumn("up", F.sum(F.col("n").isNotNull().cast("int")).over(seen.orderBy("pdf_page"))).withColumn("all", F.count("n").over(seen))
    sample = F.struct("pdf_page", "values")
    have = F.col("n").isNotNull()
    return every.groupBy("doc_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("page_number_blocks"),
        F.array_sort(F.collect_list(F.when(~have, F.col("pdf_page")))).alias("pages_without"),
        F.array_sort(F.collect_list(F.when(have & (F.col("up") <= k), sample))).alias("head"),
        F.array_sort(F.collect_list(F.when(have & (F.col("up") > F.col("all") - k), sample))).alias("tail"),
    )


def run_report(raw: DataFrame, p: Prepared, quality: dict, meta: dict, cfg: dict | None = None) -> dict:
    """What a run is reported with: its metadata, the input's audit, each stage's numbers, and acceptance."""
    rows = lambda df: [r.asDict(True) for r in df.collect()]  # noqa: E731  a few rows each
    stages = {
        "blocks": rows(checks.histogram(p.blocks, "block_type")), "status": rows(checks.histogram(p.blocks, "status")), "cleaning": rows(D.rule_counts(p.blocks)), "sections": rows(checks.histogram(p.sections, "level")),
        "items": rows(checks.histogram(p.items, "item_type")), "captions": rows(checks.histogram(p.captions, "origin")), "left_out": rows(skipped_margins(p).groupBy("why", "block_type").agg(F.sum("n").alias("n"))), "glued": p.glue.count(), "caption_issues": rows(checks.histogram(p.caption_issues, "code")),
    }
    return {"meta": meta, "input_audit": audit(raw, cfg), "stages": stages, "quality": quality}


def raw_text(raw: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, original_index, text): all readable text of a raw block, its parts in order."""
    parts = F.array_sort(F.collect_list(F.struct("derived_seq", F.coalesce("raw_text", F.lit("")).alias("t"))))
    return D.derive(raw).groupBy("doc_id", "pdf_page", "original_index").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def audit(raw: DataFrame, cfg: dict | None = None, samples: int = 20) -> dict[str, list[dict]]:
    """Metrics of raw documents, as small tables: types, pages, texts, boxes, duplicates, visuals, page numbers. What has a row for each document is shown for the ``samples`` first of them, with the number of all."""
    from kilnwork.settings import document as settings

    page = (cfg or settings())["page"]
    spark = raw.sparkSession
    b = saved(spark, D.derive(raw), "audit")
    keyed = b.withColumn("head", F.substring("raw_text", 1, 80)).withColumn("box", F.col("bbox").cast("string"))
    visual = b.where("block_type in ('figure', 'table')")
    captions = b.where("block_type in ('figure_title', 'table_title')").select("doc_id", "pdf_page", "original_index").withColumn("has", F.lit(True))
    tables = {
        "types": checks.histogram(b.dropDuplicates(["doc_id", "pdf_page", "original_index"]), "original_type"),
        "pages": checks.page_summary(b, ["doc_id"], "pdf_page"),
        "texts": checks.text_audit(b.where("block_type in ('paragraph', 'list_item')"), ["doc_id"], "block_type", "raw_text"),
        "boxes": checks.bad_boxes(b, page["bounds"], page["bbox_tolerance"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n")),
        "duplicates": checks.duplicate_blocks(keyed.where("derived_seq = 0"), ["doc_id", "pdf_page", "original_type", "head", "box"], "original_index").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
        "visuals": visual.join(captions, ["doc_id", "pdf_page", "original_index"], "left").groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("without_caption"), F.count_if(F.coalesce("ocr_html", F.lit("")) != "").alias("with_html")),
        "page_numbers": D.page_anchors(b).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    }
    out = {name: [r.asDict() for r in (t.orderBy("doc_id").limit(samples) if "doc_id" in t.columns else t).collect()] for name, t in tables.items()}
    return {**out, "documents": [b.agg(F.count_distinct("doc_id").alias("n")).first().asDict()]}


def raw_preserved(p: Prepared, raw: DataFrame) -> DataFrame:
    """Derived texts that no block holds, and block texts that no raw block gave."""
    a = D.derive(raw).select("doc_id", "pdf_page", "original_index", "raw_text").distinct()
    return checks.both_ways(a, p.blocks.select("doc_id", "pdf_page", "original_index", "raw_text").distinct())


def caption_repeated(p: Prepared) -> DataFrame:
    """Captions of a visual that the content holds as text, too."""
    members = p.items.select("doc_id", F.explode("member_ids").alias("part_id"))
    return p.captions.join(members, ["doc_id", "part_id"], "left_semi")


def unresolved(p: Prepared, records: DataFrame) -> DataFrame:
    """Visual items without a page, a box or an asset."""
    v = p.items.where("item_type in ('figure', 'table')").select("doc_id", "item_id", F.element_at("source_refs", 1).alias("source_ref"))
    full = v.join(p.blocks.select("doc_id", "source_ref", "pdf_page", "bbox"), ["doc_id", "source_ref"], "left").join(records.where("exists").select("doc_id", "source_ref", "origin"), ["doc_id", "source_ref"], "left")
    return full.where("pdf_page is null or bbox is null or origin is null")


def write(p: Prepared, path: str, fail_on_error: bool = False, records: DataFrame | None = None, prefix: str = "doc:v1:sec:", more: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Structure, registry, blocks, items and captions as one version of a store at ``path``, all of it or nothing; gives the checks' counts. ``fail_on_error`` publishes nothing if a check fails."""
    from kilnwork.sources.json_files import publish

    found = validate(p)
    if fail_on_error and any(found.values()):
        raise ValueError(f"checks failed: {found}")
    tables = {
        "structure": structure(p, prefix=prefix).orderBy("doc_id", "section_order"), "registry": registry(p, records), "blocks": p.blocks.orderBy("doc_id", "pos"), "items": p.items.orderBy("doc_id", "section_id", "item_order"),
        "captions": p.captions.orderBy("doc_id", "visual_id", "part_id"), "caption_issues": p.caption_issues.orderBy("doc_id", "block_id", "code"), **(more or {}),
    }
    publish(p.blocks.sparkSession, tables, path)
    return found
