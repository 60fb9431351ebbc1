"""Document blocks: deriving, splitting, paging, reading order, sections, captions, content, assets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as T
from kilnwork.operators import order as O

FRAGMENTS = "array<struct<type:string,content:string>>"
TEXT_FIELDS = ("title", "paragraph", "page_header", "page_footer", "page_number", "page_footnote", "page_aside_text")
RAW = (
    "type string, bbox array<double>, content struct<"
    + ", ".join(f"{t}_content:{FRAGMENTS}" for t in TEXT_FIELDS)
    + f", list_items:array<struct<item_content:{FRAGMENTS}>>, html:string, table_caption:{FRAGMENTS}, table_footnote:{FRAGMENTS}, image_caption:{FRAGMENTS}, image_footnote:{FRAGMENTS}, image_source:struct<path:string>, math_content:string>"
)
#: Codes of block types in references.
REF_CODES = {"heading": "heading", "paragraph": "para", "table": "table", "table_title": "tabtitle", "table_note": "tabnote", "figure": "fig", "figure_title": "figtitle", "formula": "form", "list_item": "list", "page_header": "header", "page_footer": "footer", "page_number": "pagenum", "page_footnote": "footnote", "page_aside_text": "aside"}
FRONT_LAST = 10
KEYS = ["doc_id"]
PAGE = ["doc_id", "pdf_page"]


def derive(raw: DataFrame) -> DataFrame:
    """Raw blocks (doc_id, pdf_page, original_index, block JSON) -> typed blocks, one or more for each.

    Lists give an item each (an empty list one empty item), tables and images themselves with caption and note.
    """
    b = raw.select(*PAGE, "original_index", F.from_json("block", RAW).alias("b")).select(*PAGE, "original_index", "b.*")
    text = lambda c: T.concat_content(F.col(f"content.{c}"))
    part = lambda kind, t: F.struct(F.lit(kind).alias("block_type"), t.alias("raw_text"))
    optional = lambda kind, c: F.when(F.size(F.coalesce(F.col(f"content.{c}"), F.array().cast(FRAGMENTS))) > 0, part(kind, text(c)))
    items = F.transform("content.list_items", lambda i: part("list_item", T.concat_content(i["item_content"])))
    listed = F.when(F.size(F.coalesce("content.list_items", F.array().cast(f"array<struct<item_content:{FRAGMENTS}>>"))) > 0, items).otherwise(F.array(part("list_item", F.lit(""))))
    kinds = {"title": F.array(part("heading", text("title_content"))), "paragraph": F.array(part("paragraph", text("paragraph_content"))), "equation_interline": F.array(part("formula", F.coalesce("content.math_content", F.lit("")))), "list": listed}
    kinds["table"] = F.array_compact(F.array(part("table", F.lit("")), optional("table_title", "table_caption"), optional("table_note", "table_footnote")))
    kinds["image"] = F.array_compact(F.array(part("figure", F.lit("")), optional("figure_title", "image_caption"), optional("table_note", "image_footnote")))
    kinds |= {t: F.array(part(t, text(f"{t}_content"))) for t in TEXT_FIELDS[2:]}
    parts = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in kinds.items()], F.array(part("unknown", F.lit(""))))
    out = b.select(*PAGE, "original_index", F.coalesce("type", F.lit("unknown")).alias("original_type"), "bbox", F.col("content.html").alias("ocr_html"), F.col("content.image_source.path").alias("image_path"), F.posexplode_outer(parts).alias("derived_seq", "p"))
    status = F.when(F.col("bbox").isNull() | (F.size("bbox") != 4), "needs_review").otherwise("normal")
    out = out.select(*PAGE, "original_index", "derived_seq", "original_type", "p.block_type", "p.raw_text", F.when(F.size("bbox") == 4, F.col("bbox")).alias("bbox"), "ocr_html", "image_path", status.alias("status"))
    return out.withColumn("parent_origin", F.array(F.col("pdf_page").cast("long"), F.col("original_index").cast("long"))).withColumn("issues", derived_issues())


ISSUE = "array<struct<code:string,message:string,severity:string>>"


def issue(when: Column, code: str, message: Column | str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(severity).alias("severity")))


def derived_issues() -> Column:
    """What a block's derivation has to say for review."""
    listed = F.col("block_type") == "list_item"
    inherited = F.col("block_type").isin("table_title", "figure_title", "table_note") & F.col("original_type").isin("table", "image")
    return F.array_compact(F.array(
        issue((F.col("block_type") == "unknown"), "unknown_type", F.concat(F.lit("unknown type "), "original_type"), "warning"),
        issue(listed & (F.col("raw_text") == ""), "empty_list", "a list without items", "warning"),
        issue(listed & (F.col("raw_text") != ""), "list_bbox_shared", "the box is that of the whole list", "info"),
        issue(inherited, "caption_bbox_inherited", "the box is that of its table or figure", "info"),
        issue(F.col("bbox").isNull(), "missing_bbox", "no box of four numbers", "warning"),
    ))


def split_headings(blocks: DataFrame, front_last: int = FRONT_LAST, levels=None) -> DataFrame:
    """Paragraphs that begin with a heading number: whole headings, heading and body, or flagged. Adds ``split_text`` and ``outcome``."""
    t = T.title_norm(F.col("raw_text"))
    number = F.regexp_extract("t", T.u("^(" + "|".join(p.removeprefix("^") for p, _ in levels or T.LEVELS) + ")"), 1)
    b = blocks.withColumn("t", t).withColumn("num", number)
    rest = T.replaced(F.substring("t", F.length("num") + 1, F.length("t")), r"^\s+", "")
    b = b.withColumn("rest", rest).withColumn("space", F.instr("rest", " ") - 1)
    title = F.substring(F.col("t"), F.lit(1), F.length("t") - F.length("rest") + F.col("space"))
    b = b.withColumn("title", T.replaced(title, r"^\s+|\s+$", "")).withColumn("body", T.replaced(F.substring("rest", F.col("space") + 2, F.length("rest")), r"^\s+|\s+$", ""))
    name = T.replaced(F.substring("title", F.length("num") + 1, F.length("title")), r"^\s+|\s+$", "")
    marks = "[。！？；，]"
    mine = (F.col("block_type") == "paragraph") & (F.col("status") == "normal") & (F.col("pdf_page") > front_last) & (F.col("num") != "")
    whole = (F.length("t") <= 30) & ~F.col("t").rlike(marks) & ~F.col("t").rlike(r"\d{2,4}$")
    splits = F.col("space").between(1, 24) & (F.length("rest") > F.col("space") + 4) & (F.length(name) >= 4) & (F.col("body") != "") & ~F.col("title").rlike(marks)
    b = b.withColumn("outcome", F.when(mine & whole, "reclassified").when(mine & splits, "split").when(mine, "flagged"))
    pieces = F.when(F.col("outcome") == "split", F.array(F.struct(F.lit("heading").alias("k"), F.col("title").alias("x")), F.struct(F.lit("paragraph").alias("k"), F.col("body").alias("x")))).otherwise(F.array(F.struct(F.when(F.col("outcome") == "reclassified", "heading").otherwise(F.col("block_type")).alias("k"), F.when(F.col("outcome") == "reclassified", F.col("t")).alias("x"))))
    out = b.select(*[c for c in blocks.columns if c not in ("block_type", "status")], F.when(F.col("outcome") == "flagged", "needs_review").otherwise(F.col("status")).alias("status"), "outcome", F.posexplode_outer(pieces).alias("split_seq", "piece"))
    return out.withColumn("block_type", F.col("piece.k")).withColumn("split_text", F.col("piece.x")).drop("piece")


def page_anchors(blocks: DataFrame) -> DataFrame:
    """Of each page the lowest printed page number: kind, value, number, conflict (its blocks disagree in kind)."""
    n = blocks.where("block_type = 'page_number'").select(*PAGE, "original_index", F.coalesce(F.get("bbox", F.lit(1)), F.lit(0.0)).alias("y"), T.page_class(F.col("raw_text")).alias("c"))
    kinds = n.groupBy(*PAGE).agg(F.countDistinct(F.coalesce("c.kind", F.lit("?"))).alias("kinds"))
    top = n.withColumn("n", F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("y"), "original_index"))).where("n = 1")
    return top.join(kinds, PAGE).select(*PAGE, "c.kind", "c.value", "c.number", (F.col("kinds") > 1).alias("conflict"))


def printed_pages(blocks: DataFrame) -> DataFrame:
    """All pages with kind, value and number, missing Arabic numbers filled where they grow as the pages do."""
    a = page_anchors(blocks)
    pages = blocks.select(*PAGE).distinct().join(a, PAGE, "left").withColumn("arabic", F.when(F.col("kind") == "arabic", F.col("number")))
    filled = O.linear_gap_fill(pages, KEYS, "pdf_page", "arabic")
    inferred = F.col("arabic").isNull() & F.col("filled").isNotNull()
    return filled.select(*PAGE, F.when(inferred, "arabic").otherwise(F.col("kind")).alias("kind"), F.when(inferred, F.col("filled").cast("string")).otherwise(F.col("value")).alias("value"), F.when(inferred, F.col("filled")).otherwise(F.col("number")).alias("number"), inferred.alias("inferred"), "conflict")


def columns(blocks: DataFrame, gap: float = 250) -> DataFrame:
    """Adds ``column`` and ``layout_review``: two clusters of centres with two blocks each are columns, anything else but one is for review."""
    margin = F.col("block_type").isin(*T.MARGIN_TYPES, "page_footnote")
    b = blocks.withColumn("is_margin", margin).withColumn("centre", F.when(~margin, F.coalesce((F.element_at("bbox", 1) + F.element_at("bbox", 3)) / 2, F.lit(0.0))))
    b = b.withColumn("tie", F.col("original_index") * 100_000 + F.col("derived_seq") * 10 + F.col("split_seq"))
    b = O.cluster_1d(b, [*PAGE, "is_margin"], "centre", "tie", gap)
    size = F.count(F.lit(1)).over(W.partitionBy(*PAGE, "is_margin", "cluster"))
    page = W.partitionBy(*PAGE, "is_margin")
    b = b.withColumn("size", size).withColumn("last", F.max("cluster").over(page)).withColumn("least", F.min("size").over(page))
    two = (F.col("last") == 1) & (F.col("least") >= 2)
    return b.withColumn("column", F.when(~F.col("is_margin") & two, F.col("cluster")).otherwise(0)).withColumn("layout_review", ~F.col("is_margin") & (F.col("last") > 0)).drop("centre", "cluster", "size", "last", "least")


def reading_order(blocks: DataFrame, prefix: str = "doc:v1", codes: dict[str, str] | None = None) -> DataFrame:
    """Adds ``block_order`` (margins last), ``block_id``, ``source_ref`` (numbered by page and type) and ``pos`` through the document."""
    y, x = F.coalesce(F.element_at("bbox", 2), F.lit(0.0)), F.coalesce(F.element_at("bbox", 1), F.lit(0.0))
    b = columns(blocks).withColumn("block_order", F.row_number().over(W.partitionBy(*PAGE).orderBy("is_margin", "column", y, F.when(~F.col("is_margin"), x), "tie")) - 1)
    code = F.coalesce(*[F.when(F.col("block_type") == k, v) for k, v in (codes or REF_CODES).items()], F.lit("unk"))
    b = b.withColumn("code", code).withColumn("n", F.row_number().over(W.partitionBy(*PAGE, "code").orderBy("block_order")))
    page = F.concat(F.lit(f"{prefix}:pdfp"), F.lpad(F.col("pdf_page").cast("string"), 4, "0"))
    pad = lambda c, k: F.when(F.length(c.cast("string")) >= k, c.cast("string")).otherwise(F.lpad(c.cast("string"), k, "0"))
    b = b.withColumn("block_id", F.concat(page, F.lit(":b"), pad(F.col("block_order"), 3))).withColumn("source_ref", F.concat(F.upper(page), F.lit(":"), "code", pad(F.col("n"), 2)))
    # A page has far fewer than a million blocks, so this orders a document's blocks without a window over all of them.
    return b.withColumn("pos", F.col("pdf_page").cast("long") * 1_000_000 + F.col("block_order")).drop("code", "n", "tie")


def merge_crossline(blocks: DataFrame, gap: float = 40, levels=None) -> DataFrame:
    """Unnumbered headings on two lines: the first is merged into the second."""
    heading = (F.col("block_type") == "heading") & (F.col("status") == "normal")
    titled = blocks.withColumn("__title", F.when(heading, T.title_norm(F.col("raw_text")))).withColumn("__level", T.title_level(F.col("__title"), levels))
    b = O.crossline(titled, PAGE, ["block_order"], heading, F.col("__level"), F.element_at("bbox", 2), F.element_at("bbox", 4), gap)
    return b.withColumn("status", F.when(F.col("merged"), "merged").otherwise(F.col("status"))).drop("merged", "__title", "__level")


def sections(blocks: DataFrame, front_last: int = FRONT_LAST, prefix: str = "doc:v1:sec:", levels=None) -> DataFrame:
    """One row for each heading that counts: level, number, ids of itself and its parent, path, where it ends. The root isn't a row."""
    h = blocks.where("block_type = 'heading' and status in ('normal', 'needs_review')")
    h = h.select("doc_id", "pos", "pdf_page", "block_id", "source_ref", T.title_norm(F.coalesce("split_text", "raw_text")).alias("title"))
    h = h.withColumn("level", T.title_level(F.col("title"), levels)).withColumn("own", T.own_number(F.col("title"), levels))
    h = h.withColumn("own", F.when((F.col("level") == 1) & (F.col("pdf_page") <= front_last), F.concat(F.lit("front:"), "own")).otherwise(F.col("own")))
    h = O.ends(O.parents(h, KEYS, "pos", "level"), KEYS, "pos", "level")
    h = O.ancestor_titles(O.level_numbers(h, KEYS, "pos", "level", "own"), KEYS, "pos", "title")
    h = h.withColumn("section_id", F.concat(F.lit(prefix), "number"))
    up = h.select(F.col("doc_id").alias("__d"), F.col("pos").alias("__p"), F.col("section_id").alias("parent_id"), F.col("level").alias("parent_level"))
    h = h.join(up, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("parent_at") == F.col("__p")), "left").drop("__d", "__p")
    h = h.withColumn("parent_id", F.coalesce("parent_id", F.lit(f"{prefix}root"))).withColumn("level_jump", F.coalesce(F.col("level") > F.col("parent_level") + 1, F.lit(False)))
    return h.drop("parent_level")


def section_ends(secs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds end_ref and end_page: the last block in the section that is no margin, or its heading."""
    body = blocks.where(~F.col("block_type").isin(*T.MARGIN_TYPES)).select("doc_id", "pos", "pdf_page", "source_ref")
    w = W.partitionBy("doc_id").orderBy("pos")
    # The last block before each heading and before the document's end.
    marks = secs.select("doc_id", F.col("next_at").alias("pos")).where("pos is not null").distinct().withColumn("mark", F.lit(True)).select("doc_id", "pos", F.lit(None).cast("int").alias("pdf_page"), F.lit(None).cast("string").alias("source_ref"), "mark")
    both = body.withColumn("mark", F.lit(False)).select("doc_id", "pos", "pdf_page", "source_ref", "mark").unionByName(marks)
    last = F.last(F.when(~F.col("mark"), F.struct("pdf_page", "source_ref")), True).over(W.partitionBy("doc_id").orderBy("pos", F.desc("mark")).rowsBetween(W.unboundedPreceding, -1))
    before = both.withColumn("l", last).where("mark").select(F.col("doc_id").alias("__d"), F.col("pos").alias("__p"), "l")
    final = body.groupBy(F.col("doc_id").alias("__e")).agg(F.max_by(F.struct("pdf_page", "source_ref"), "pos").alias("f"))
    s = secs.join(before, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("next_at") == F.col("__p")), "left").join(final, F.col("doc_id").eqNullSafe(F.col("__e")), "left")
    end = F.when(F.col("next_at").isNull(), F.col("f")).otherwise(F.col("l"))
    return s.withColumn("end_ref", F.coalesce(end["source_ref"], "source_ref")).withColumn("end_page", F.coalesce(end["pdf_page"], "pdf_page")).drop("__d", "__p", "__e", "l", "f")


def bind(blocks: DataFrame, secs: DataFrame, prefix: str = "doc:v1:sec:") -> DataFrame:
    """Adds section_id and heading_path of the last heading at or before each block."""
    s = secs.select(F.col("doc_id").alias("__d"), F.col("pos").alias("__p"), F.struct("section_id", "path").alias("__s"))
    b = blocks.join(s, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("pos") == F.col("__p")), "left").drop("__d", "__p")
    b = O.bind_last(b, KEYS, "pos", F.col("__s"), "__last")
    return b.withColumn("section_id", F.coalesce("__last.section_id", F.lit(f"{prefix}root"))).withColumn("heading_path", F.coalesce("__last.path", F.array().cast("array<string>"))).withColumn("in_tree", F.col("__s").isNotNull()).drop("__s", "__last")


def clean(blocks: DataFrame) -> DataFrame:
    """Adds normalized_text and the cleaning rules that fired; texts left empty are for review."""
    kind = F.when(F.col("block_type").isin("heading", "paragraph"), F.col("block_type")).when(F.col("block_type").isin("list_item", "table_title", "table_note", "figure_title", *T.MARGIN_TYPES, "page_footnote"), "none").otherwise("other")
    b = blocks.withColumn("__c", T.clean_text(F.coalesce("split_text", "raw_text"), kind))
    captions = F.col("block_type").isin("table_title", "figure_title")
    b = b.withColumn("normalized_text", F.when(captions, T.clean_caption(F.col("__c.text"))).otherwise(F.col("__c.text"))).withColumn("rules", F.col("__c.rules")).drop("__c")
    b = without_header_residue(b)
    empty = F.col("block_type").isin("paragraph", "list_item") & (F.trim("normalized_text") == "")
    noted = F.concat("issues", F.array_compact(F.array(issue(empty, "empty_text", "nothing is left of the text", "warning")))) if "issues" in b.columns else F.array().cast(ISSUE)
    return b.withColumn("issues", noted).withColumn("status", F.when(empty, "needs_review").otherwise(F.col("status")))


def without_header_residue(blocks: DataFrame, least: int = 6) -> DataFrame:
    """Paragraphs that begin with a header or footer of their page lose it, the longest that fits; ``rules`` and ``issues`` tell. Shorter ones than ``least`` stay."""
    texts = F.when(F.length(F.trim("normalized_text")) >= least, F.trim("normalized_text"))
    margins = blocks.where(F.col("block_type").isin("page_header", "page_footer")).groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.struct((-F.length(texts)).alias("n"), texts.alias("t")))).alias("__margins"))
    b = blocks.join(margins, PAGE, "left")
    fits = F.filter("__margins", lambda m: F.col("normalized_text").startswith(m["t"]))
    b = b.withColumn("__residue", F.when(F.col("block_type") == "paragraph", F.get(fits, F.lit(0))["t"]))
    hit = F.col("__residue").isNotNull()
    rest = F.regexp_replace(F.expr("substring(normalized_text, length(__residue) + 1)"), "^[ 。，、]+", "")
    b = b.withColumn("normalized_text", F.when(hit, rest).otherwise(F.col("normalized_text"))).withColumn("rules", F.when(hit, F.array_append("rules", F.lit("header_residue_stripped"))).otherwise(F.col("rules")))
    if "issues" in b.columns:
        b = b.withColumn("issues", F.concat("issues", F.array_compact(F.array(issue(hit, "header_residue_stripped", F.concat(F.lit("a header stood before the text: "), "__residue"), "info")))))
    return b.drop("__margins", "__residue")


def visual_notes(parts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, visual_id, notes): the notes that came with a visual, in reading order."""
    at = blocks.select("doc_id", F.col("block_id").alias("part_id"), F.col("pos").alias("at"))
    notes = parts.where("part_type = 'table_note'").join(at, ["doc_id", "part_id"])
    return notes.groupBy("doc_id", "visual_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda n: n["text"]).alias("notes"))


def resolved_path(path: Column, base: str) -> Column:
    """An absolute path: a relative one below ``base``, without . and .. steps; an absolute one or a URL stays; blank is null."""
    given = F.trim(F.coalesce(path, F.lit("")))
    whole = F.when(given.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), given).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), given))
    steps = F.split(F.regexp_replace(whole, "/+", "/"), "/")
    tidy = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, x: F.when(x == ".", kept).when((x == "..") & (F.size(kept) > 1), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.array_append(kept, x)))
    return F.when(given == "", None).when(whole.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), whole).otherwise(F.array_join(tidy, "/"))


def block_json(blocks: DataFrame, standard: Sequence[str], extra: str = "extra") -> DataFrame:
    """One JSON object a row: the standard fields in their order, nulls included, then what ``extra`` (key -> variant) holds, by key."""
    known = F.to_json(F.struct(*standard), {"ignoreNullFields": "false"})
    more = F.transform(F.array_sort(F.map_keys(extra)), lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), F.coalesce(F.to_json(F.element_at(extra, k)), F.lit("null"))))
    body = F.array_join(F.concat(F.array(F.substring(known, F.lit(2), F.length(known) - 2)), F.coalesce(more, F.array().cast("array<string>"))), ",")
    return blocks.select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def block_from_json(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Blocks from JSON objects: the fields of ``schema``, and every other key with its value of any kind in ``extra``."""
    names = [x.split()[0] for x in schema.split(", ")]
    b = lines.select(F.from_json(value, schema).alias("b"), F.from_json(value, "map<string,variant>").alias("m"))
    return b.select("b.*", F.map_filter("m", lambda k, _: ~k.isin(*names)).alias("extra"))


def rule_counts(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def glue_flags(blocks: DataFrame) -> DataFrame:
    """Headings whose next block is a paragraph that begins with a clause of one or two characters."""
    w = W.partitionBy("doc_id").orderBy("pos")
    b = blocks.select("doc_id", "pos", "block_id", "block_type", "status", "split_text", F.lead("block_type").over(w).alias("next_type"), F.lead("block_id").over(w).alias("next_id"), F.lead("normalized_text").over(w).alias("next_text"))
    clause = F.trim(F.element_at(F.split("next_text", "[，。；！？]"), 1))
    return b.where("block_type = 'heading' and status = 'normal' and split_text is null and next_type = 'paragraph'").withColumn("fragment", clause).where(F.length("fragment").between(1, 2)).select("doc_id", "block_id", "next_id", "fragment")


def vertical_gap(a: Column, b: Column) -> Column:
    """Between two boxes; 0 where they overlap."""
    at = lambda c, i: F.element_at(c, i)
    return F.greatest(F.lit(0.0), at(b, 2) - at(a, 4), at(a, 2) - at(b, 4))


def embedded_captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, visual_id, part_id, part_type, text) of captions and notes that came with their visual."""
    own = blocks.where("block_type in ('figure', 'table')").select(*PAGE, "original_index", F.col("block_id").alias("visual_id"))
    part = blocks.where("block_type in ('figure_title', 'table_title', 'table_note')").select(*PAGE, "original_index", F.col("block_id").alias("part_id"), F.col("block_type").alias("part_type"), F.col("normalized_text").alias("text"), "pos")
    return part.join(own, [*PAGE, "original_index"])


def proximity_captions(blocks: DataFrame, embedded: DataFrame, most: float = 60, least_confidence: float = 0.6) -> DataFrame:
    """Captions for visuals without one: the nearest caption-like text on the page, each used once, visuals in order. With the caption's number, and the type that its block becomes.

    Candidates come from an equi-join on the page with a range condition. A page's visuals, with their candidates best first, are one
    array, bounded by the page, over which a fold carries the texts that are taken.
    """
    captioned = embedded.where("part_type <> 'table_note'").select("doc_id", F.col("visual_id").alias("block_id")).distinct()
    v = blocks.where("block_type in ('figure', 'table') and bbox is not null").join(captioned, ["doc_id", "block_id"], "left_anti").select(*PAGE, F.col("block_id").alias("visual_id"), F.col("block_type").alias("kind"), F.col("pos").alias("visual_pos"), F.col("bbox").alias("vbox"))
    like = F.col("block_type").isin("paragraph", "list_item", "heading") & (F.col("status") == "normal") & ~F.col("in_tree") & (F.length(F.trim("normalized_text")) <= 120) & F.trim("normalized_text").rlike(T.u(T.CAPTION_LIKE))
    c = blocks.where(like & F.col("bbox").isNotNull()).select(*PAGE, F.col("block_id").alias("caption_id"), F.col("pos").alias("caption_pos"), F.col("bbox").alias("cbox"), F.col("normalized_text").alias("caption"))
    pairs = v.join(c, PAGE).withColumn("gap", vertical_gap(F.col("vbox"), F.col("cbox"))).where(F.col("gap") <= most)
    confidence = 1 - F.col("gap") / most * (1 - least_confidence)
    place = F.when(F.element_at("cbox", 4) <= F.element_at("vbox", 2), "above").otherwise("below")
    candidate = F.struct((-confidence).alias("order"), "caption_pos", "caption_id", "caption", confidence.alias("confidence"), place.alias("place"))
    near = pairs.groupBy(*PAGE, "visual_pos", "visual_id", "kind").agg(F.array_sort(F.collect_list(candidate)).alias("near"))
    page = near.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("visual_pos", "visual_id", "kind", "near"))).alias("visuals"))
    kinds = page.schema["visuals"].dataType.elementType
    none = F.struct(F.array().cast(f"array<{near.schema['near'].dataType.elementType['caption_id'].dataType.simpleString()}>").alias("taken"), F.array().cast(f"array<struct<v:{kinds.simpleString()},c:{near.schema['near'].dataType.elementType.simpleString()}>>").alias("out"))

    def choose(state: Column, visual: Column) -> Column:
        best = F.get(F.filter(visual["near"], lambda x: ~F.array_contains(state["taken"], x["caption_id"])), 0)
        return F.when(best.isNull(), state).otherwise(F.struct(F.concat(state["taken"], F.array(best["caption_id"])).alias("taken"), F.concat(state["out"], F.array(F.struct(visual.alias("v"), best.alias("c")))).alias("out")))

    chosen = page.select(*PAGE, F.explode(F.aggregate("visuals", none, choose, lambda s: s["out"])).alias("x"))
    kind = F.when(F.col("x.v.kind") == "figure", "figure_title").otherwise("table_title")
    return chosen.select(*PAGE, "x.v.visual_id", "x.v.visual_pos", "x.c.caption_id", "x.c.caption_pos", "x.c.caption", "x.c.confidence", "x.c.place", T.caption_no(F.col("x.c.caption")).alias("caption_no"), kind.alias("caption_type"))


def caption_issues(blocks: DataFrame, embedded: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, block_id, code, message, severity): visuals with a box that have no caption, and texts that became one."""
    captioned = embedded.where("part_type <> 'table_note'").select("doc_id", F.col("visual_id").alias("block_id")).unionByName(near.select("doc_id", F.col("visual_id").alias("block_id"))).distinct()
    bare = blocks.where("block_type in ('figure', 'table') and bbox is not null").select("doc_id", "block_id").join(captioned, ["doc_id", "block_id"], "left_anti")
    missing = bare.select("doc_id", "block_id", F.lit("caption_missing").alias("code"), F.lit("no caption came with the visual or stands near it").alias("message"), F.lit("warning").alias("severity"))
    message = F.concat(F.lit("a text beside a visual is its caption, confidence "), F.format_number("confidence", 2))
    return missing.unionByName(near.select("doc_id", F.col("caption_id").alias("block_id"), F.lit("reclassified_from_paragraph").alias("code"), message.alias("message"), F.lit("info").alias("severity")))


def content_items(blocks: DataFrame, secs: DataFrame, skipped: DataFrame, prefix: str = "doc:v1") -> DataFrame:
    """Ordered items of each section: fused text, figures, tables, references to child sections.

    ``skipped``: (doc_id, block_id) of captions that belong to a visual. The root's content lies before the first
    heading. Items are numbered through the document, sections in order and the root last.
    """
    b = blocks.where(~F.col("block_type").isin(*T.MARGIN_TYPES)).join(skipped, ["doc_id", "block_id"], "left_anti").where("not in_tree")
    visual = F.col("block_type").isin("figure", "table")
    b = O.islands(b, ["doc_id", "section_id"], "pos", visual | F.coalesce(F.lag(visual).over(W.partitionBy("doc_id", "section_id").orderBy("pos")), F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("normalized_text", F.lit("")).alias("t"), "block_id", "source_ref", "block_type", "heading_path")))
    items = b.groupBy("doc_id", "section_id", "island").agg(parts.alias("m"))
    first = F.element_at("m", 1)
    is_visual = first["block_type"].isin("figure", "table")
    items = items.select("doc_id", "section_id", first["pos"].alias("pos"), F.when(is_visual, first["block_type"]).otherwise("text_segment").alias("item_type"), F.when(~is_visual, F.array_join(F.transform("m", lambda x: x["t"]), "")).alias("text"), F.transform("m", lambda x: x["block_id"]).alias("member_ids"), F.transform("m", lambda x: x["source_ref"]).alias("source_refs"), first["heading_path"].alias("heading_path"), F.lit(None).cast("string").alias("child_id"))
    children = secs.select("doc_id", F.col("parent_id").alias("section_id"), "pos", F.lit("subsection").alias("item_type"), F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("member_ids"), F.array().cast("array<string>").alias("source_refs"), "path", F.col("section_id").alias("child_id")).withColumnRenamed("path", "heading_path")
    every = items.unionByName(children)
    every = O.numbered(every, ["doc_id", "section_id"], ["pos"], "item_order")
    start = secs.select("doc_id", "section_id", F.col("pos").alias("section_pos"))
    every = every.join(start, ["doc_id", "section_id"], "left").withColumn("is_root", F.col("section_pos").isNull())
    counted = every.where("item_type <> 'subsection'")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("is_root", "section_pos", "item_order"))
    abbr = F.when(F.col("item_type") == "text_segment", "seg").when(F.col("item_type") == "figure", "fig").otherwise("tab")
    named = counted.withColumn("n", number).withColumn("item_id", F.concat(F.lit(f"{prefix}:item:"), abbr, F.when(F.col("n") < 10_000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string")))).drop("n")
    return named.unionByName(every.where("item_type = 'subsection'").withColumn("item_id", F.col("child_id"))).drop("section_pos")


#: File extensions with their types.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def path_class(path: Column, known: Column, is_dir: Column) -> Column:
    """empty, dir, file or missing, from whether a listing has the path."""
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", "empty").when(is_dir, "dir").when(known, "file").otherwise("missing")


def assets(blocks: DataFrame, files: DataFrame, crops: DataFrame) -> DataFrame:
    """One record for each visual: the parsed file if there is one, else the crop made for it, else failed.

    ``files``: path, content (as the binaryFile reader gives them, paths as in the document); ``crops``: source_ref, content.
    """
    v = blocks.where("block_type in ('figure', 'table')").select("doc_id", "source_ref", "image_path")
    f = files.select(F.col("path").alias("image_path"), F.sha2("content", 256).alias("file_sha"))
    c = crops.select("source_ref", F.sha2("content", 256).alias("crop_sha"))
    a = v.join(f, "image_path", "left").join(c, "source_ref", "left")
    origin = F.when(F.col("file_sha").isNotNull(), "parsed_asset").when(F.col("crop_sha").isNotNull(), "pdf_crop").otherwise("failed")
    ext = F.lower(F.regexp_extract("image_path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(origin == "pdf_crop", "image/png").when(origin == "parsed_asset", F.coalesce(*[F.when(ext == k, m) for k, m in MIME.items()], F.lit("application/octet-stream")))
    return a.select("doc_id", "source_ref", F.col("image_path").alias("original_path"), origin.alias("origin"), (origin != "failed").alias("exists"), F.coalesce("file_sha", "crop_sha").alias("sha256"), mime.alias("mime_type"))


def crop_box(bbox: Column, x_scale: float = 0.7485, y_scale: float = 1.0, margin: float = 0.1, dpi: int = 150, least: tuple[float, float] = (40.0, 24.0)) -> Column:
    """Pixel rectangle (x, y, w, h) of a box in page units, with a margin, not left of or above the page."""
    x0, y0, x1, y1 = (F.element_at(bbox, i) * s for i, s in ((1, x_scale), (2, y_scale), (3, x_scale), (4, y_scale)))
    w, h = F.greatest(x1 - x0, F.lit(least[0])), F.greatest(y1 - y0, F.lit(least[1]))
    k = dpi / 72
    left, top = F.greatest(F.lit(0.0), x0 - w * margin), F.greatest(F.lit(0.0), y0 - h * margin)
    return F.struct(*[(c * k).cast("int").alias(n) for c, n in ((left, "x"), (top, "y"), (w * (1 + 2 * margin), "w"), (h * (1 + 2 * margin), "h"))])


def all_pages(df: DataFrame) -> Iterator[Sequence]:
    """Page keys, for callers that publish a page at a time."""
    return df.select(*PAGE).distinct().orderBy(*PAGE).toLocalIterator()
