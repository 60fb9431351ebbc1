"""More operators over the driver's tables, each with its SQL: documents, text, graph rows, imports. ``queries`` adds them to its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import text as T
from kilnwork.model import Field
from kilnwork.operators import checks, diff, document, embedding, graph, ingest, order, stats
from kilnwork.plans import document as plan
from kilnwork.registry import query, table

# Text functions, on texts made from keys and names.


@query("SELECT p_partkey AS part_key, p_brand || p_size || ' ≥' || p_size || ' ×2 a' || p_size || '/b ^' || p_size || ' (' || p_brand || ')' AS plain FROM part")
def latex_plain(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    t = F.concat(F.lit(r"  \mathrm{"), "p_brand", F.lit("}_{"), size, F.lit(r"} \geqslant "), size, F.lit(r"  \times 2 \frac{a"), size, F.lit(r"}{b}  ^{"), size, F.lit(r"} \quad ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), T.latex_to_plain(t).alias("plain"))


@query("SELECT p_partkey AS part_key, p_name || ' x ' || p_brand AS stripped, trim(regexp_replace(p_name || ' x ' || p_brand, '\\s+', ' ', 'g')) AS norm, substr(regexp_replace(p_name, '\\s+', '', 'g'), 1, 40) AS slug FROM part")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("\\("), "p_name", F.lit("\\) x "), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), T.strip_latex(t).alias("stripped"), T.title_norm(F.concat(F.lit("  "), t, F.lit(" "))).alias("norm"), T.slug(F.col("p_name")).alias("slug"))


#: For key k: titles of each kind.
_TITLES = "CASE k % 9 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {d} WHEN 4 THEN {e} WHEN 5 THEN {f} WHEN 6 THEN {g} WHEN 7 THEN {h} ELSE {i} END"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_name AS name FROM part)
SELECT k AS part_key, {_TITLES.format(a=1, b=3, c=2, d=4, e=5, f=6, g=2, h=1, i=1)} AS level,
{_TITLES.format(a="CAST(k % 90 + 10 AS VARCHAR)", b="CAST(k AS VARCHAR)", c="CAST(k AS VARCHAR)", d="CAST(k AS VARCHAR)", e="CAST(k AS VARCHAR)", f="CAST(k AS VARCHAR)", g="chr(CAST(65 + k % 26 AS INTEGER))", h="'参考文献'", i="substr(regexp_replace('x' || name, '\\s+', '', 'g'), 1, 40)")} AS own FROM p""")
def title_level(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    n = k % 90 + 10
    digit = lambda c: F.substring(F.lit(T.CN_DIGITS), (c + 1).cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    numeral = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise(""))
    forms = [F.concat(F.lit("第"), numeral, F.lit("章 "), "p_name"), F.concat(F.lit("2.3."), s, F.lit(" x")), F.concat(F.lit("2."), s, F.lit(" x")), F.concat(s, F.lit(". x")), F.concat(F.lit("（"), s, F.lit("）x")), F.concat(s, F.lit("）x")), F.concat(F.lit("附录 "), F.char(65 + k % 26), F.lit(" x")), F.lit("参考文献"), F.concat(F.lit("x"), "p_name")]
    title = F.coalesce(*[F.when(k % 9 == i, t) for i, t in enumerate(forms)])
    t = table(spark, d, "part").select("p_partkey", title.alias("title"))
    return t.select(F.col("p_partkey").alias("part_key"), T.title_level(F.col("title")).alias("level"), T.own_number(F.col("title")).alias("own"))


@query("""SELECT o_orderkey AS order_key, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'roman' ELSE 'arabic' END AS kind,
CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(o_orderkey % 399 + 1 AS BIGINT) ELSE CAST(o_orderkey AS BIGINT) END AS number FROM orders""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers as digits, as full-width digits, as Roman numerals, and as words."""
    n, s = (F.col("o_orderkey") % 399 + 1).cast("int"), F.col("o_orderkey").cast("string")
    place = lambda k, names: F.get(F.array(*map(F.lit, names)), F.floor(n / k).cast("int") % 10)
    roman = F.concat(place(100, ["", "C", "CC", "CCC"] + [""] * 6), place(10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]), place(1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    text = F.when(F.col("o_orderkey") % 4 == 3, "p. x").when(F.col("o_orderkey") % 4 == 2, roman).when(F.col("o_orderkey") % 4 == 1, F.translate(s, T.DIGITS, T.FULL_DIGITS)).otherwise(F.concat(F.lit(" "), s))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return o.select(F.col("o_orderkey").alias("order_key"), T.page_class(F.col("t")).alias("c")).select("order_key", "c.kind", "c.number")


@query("""SELECT p_partkey AS part_key, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE p_size || '-' || p_partkey END AS no,
CASE p_partkey % 4 WHEN 0 THEN '图 ' || p_size || '-' || p_partkey || ' ' || p_brand WHEN 1 THEN '表' || p_size || '—' || p_partkey || ' 数据' WHEN 2 THEN '图' || p_size ELSE p_brand END AS cleaned FROM part""")
def caption_no(spark: SparkSession, d: str) -> DataFrame:
    k, size, s = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    stray = F.concat(F.lit("827 表"), size, F.lit("—"), s, F.lit("  数据 392"))
    t = F.when(k % 4 == 0, F.concat(F.lit("图 "), size, F.lit("-"), s, F.lit("  "), "p_brand")).when(k % 4 == 1, stray).when(k % 4 == 2, F.concat(F.lit("图"), size)).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(k.alias("part_key"), T.caption_no(t).alias("no"), T.clean_caption(t).alias("cleaned"))


@query("SELECT p_partkey AS part_key, p_name || '\\(' || p_brand || '\\)' AS line FROM part")
def fragments(spark: SparkSession, d: str) -> DataFrame:
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("content"))
    pieces = F.array(part("text", F.col("p_name")), part("text", F.lit(None).cast("string")), part("equation_inline", F.col("p_brand")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), T.concat_content(pieces).alias("line"))


# Blocks of documents.


def _fragments(*cols):
    return F.array(*[F.struct(F.lit("text").alias("type"), c.alias("content")) for c in cols])


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents: users' turns are titles, assistants' lists with an item for each line, others tables with a caption."""
    c = table(spark, d, "conversations")
    items = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.array(F.struct(F.lit("text").alias("type"), x.alias("content"))).alias("item_content")))
    user = F.to_json(F.struct(F.lit("title").alias("type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("bbox"), F.struct(_fragments(F.col("text")).alias("title_content")).alias("content")))
    listed = F.to_json(F.struct(F.lit("list").alias("type"), F.struct(items.alias("list_items")).alias("content")))
    shown = F.to_json(F.struct(F.lit("table").alias("type"), F.struct(_fragments(F.col("text")).alias("table_caption")).alias("content")))
    block = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", listed).otherwise(shown)
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") % 3).cast("int").alias("pdf_page"), F.col("turn").cast("int").alias("original_index"), block.alias("block"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
b AS (SELECT conv_id, turn, 0 AS derived_seq, 'heading' AS block_type, text, '' AS codes FROM c WHERE role = 'user'
UNION ALL SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))), 'list_item', unnest(string_split(text, chr(10))), NULL FROM c WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 0, 'table', '', 'missing_bbox' FROM c WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, turn, 1, 'table_title', text, 'caption_bbox_inherited,missing_bbox' FROM c WHERE role NOT IN ('user', 'assistant'))
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS original_index, CAST(derived_seq AS INTEGER) AS derived_seq, block_type, md5(text) AS text_md5,
coalesce(codes, CASE WHEN text = '' THEN 'empty_list,missing_bbox' ELSE 'list_bbox_shared,missing_bbox' END) AS codes FROM b""")
def derived_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = document.derive(_raw(spark, d))
    return b.select("doc_id", "original_index", "derived_seq", "block_type", F.md5("raw_text").alias("text_md5"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS original_index, md5(CASE WHEN role = 'user' THEN coalesce(text, '') WHEN role = 'assistant' THEN replace(coalesce(text, ''), chr(10), ' ') ELSE ' ' || coalesce(text, '') END) AS text_md5 FROM conversations""")
def raw_texts(spark: SparkSession, d: str) -> DataFrame:
    return plan.raw_text(_raw(spark, d)).select("doc_id", "original_index", F.md5("text").alias("text_md5"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS part_key, CASE k % 4 WHEN 0 THEN 'reclassified' WHEN 1 THEN 'split' WHEN 2 THEN 'flagged' END AS outcome, CASE WHEN k % 4 < 2 THEN 'heading' ELSE 'paragraph' END AS block_type,
CASE k % 4 WHEN 0 THEN '2.' || k || ' Abcd' WHEN 1 THEN '2.' || k || ' Heading' END AS split_text, CASE WHEN k % 4 = 2 THEN 'needs_review' ELSE 'normal' END AS status FROM p
UNION ALL SELECT k, 'split', 'paragraph', 'body text that is long enough', 'normal' FROM p WHERE k % 4 = 1""")
def split_headings(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    t = F.when(k % 4 == 0, F.concat(F.lit("2."), s, F.lit(" Abcd"))).when(k % 4 == 1, F.concat(F.lit("2."), s, F.lit(" Heading body text that is long enough"))).when(k % 4 == 2, F.concat(F.lit("2."), s, F.lit(" Hea body text that is long enough here"))).otherwise(F.concat(F.lit("plain text "), s))
    b = table(spark, d, "part").select(F.lit("d").alias("doc_id"), F.lit(20).alias("pdf_page"), k.alias("part_key"), F.lit("paragraph").alias("block_type"), t.alias("raw_text"), F.lit("normal").alias("status"))
    return document.split_headings(b).select("part_key", "outcome", "block_type", "split_text", "status")


@query("""WITH b AS (SELECT l_orderkey AS o, l_linenumber AS l, l_returnflag = 'R' AS margin, l_quantity AS y, l_suppkey AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY margin, y, CASE WHEN NOT margin THEN x % 50 END, i) - 1 AS block_order FROM b)
SELECT o AS order_key, i AS original_index, CAST(block_order AS INTEGER) AS block_order, 'doc:v1:pdfp' || lpad(CAST(o % 10000 AS VARCHAR), 4, '0') || ':b' || lpad(CAST(block_order AS VARCHAR), 3, '0') AS block_id,
'DOC:V1:PDFP' || lpad(CAST(o % 10000 AS VARCHAR), 4, '0') || ':' || CASE WHEN margin THEN 'header' ELSE 'para' END || lpad(CAST(row_number() OVER (PARTITION BY o, margin ORDER BY block_order) AS VARCHAR), 2, '0') AS source_ref FROM r""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as blocks: an order is a page, the quantity the height, the supplier the place across."""
    li = table(spark, d, "lineitem")
    li = order.numbered(order.spread(li, ["l_orderkey"], li.count()), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "i")
    x, y = (F.col("l_suppkey") % 50).cast("double"), F.col("l_quantity").cast("double")
    b = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") % 10_000).cast("int").alias("pdf_page"), F.col("i").cast("long").alias("original_index"), F.lit(0).alias("derived_seq"), F.lit(0).alias("split_seq"), F.when(F.col("l_returnflag") == "R", "page_header").otherwise("paragraph").alias("block_type"), F.array(x, y, x + 10, y + 1).alias("bbox"))
    return document.reading_order(b).select(F.col("doc_id").alias("order_key"), "original_index", F.col("block_order").cast("int").alias("block_order"), "block_id", "source_ref")


@query("""WITH l AS (SELECT conv_id, turn, role, lead(role) OVER w AS r2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS VARCHAR) AS block_id, CAST(t2 AS VARCHAR) AS next_id, CASE t2 % 3 WHEN 1 THEN 'ab' ELSE 'x' END AS fragment FROM l WHERE role = 'user' AND r2 <> 'user' AND t2 % 3 > 0""")
def glued_headings(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 1, "ab，rest").when(F.col("turn") % 3 == 2, "x；y").otherwise("long clause，rest")
    b = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("block_id"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("block_type"), F.lit("normal").alias("status"), F.lit(None).cast("string").alias("split_text"), text.alias("normalized_text"))
    return document.glue_flags(b)


def _visuals(spark: SparkSession, d: str) -> DataFrame:
    """An order is a page with one figure; every second has a caption of its own, every third two notes; two free texts stand near."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    box = lambda top, bottom: F.array(F.lit(0.0), top.cast("double"), F.lit(100.0), bottom.cast("double"))
    part = lambda n, kind, index, text, b, when=None: F.when(when if when is not None else F.lit(True), F.struct(F.lit(n).alias("pos"), F.lit(kind).alias("block_type"), F.lit(index).alias("original_index"), text.alias("normalized_text"), b.alias("bbox")))
    k, c = F.col("k"), F.col("c")
    parts = [
        part(0, "paragraph", 0, F.concat(F.lit("图 1 above "), k), box(90 - k % 90, 100 - k % 90)), part(1, "figure", 1, F.lit(""), box(F.lit(100), F.lit(200))), part(2, "figure_title", 1, F.concat(F.lit("own "), k), box(F.lit(100), F.lit(200)), c % 2 == 0),
        part(3, "table_note", 1, F.concat(F.lit("n1 "), k), box(F.lit(100), F.lit(200)), c % 3 == 0), part(4, "table_note", 1, F.concat(F.lit("n2 "), k), box(F.lit(100), F.lit(200)), c % 3 == 0), part(5, "paragraph", 2, F.concat(F.lit("图 1 below "), k), box(200 + c % 80, 210 + c % 80)),
    ]
    b = o.select(k.alias("doc_id"), F.lit(1).alias("pdf_page"), F.explode(F.array_compact(F.array(*parts))).alias("b")).select("doc_id", "pdf_page", "b.*")
    return b.withColumn("block_id", F.concat_ws(":", "doc_id", "pos")).withColumn("status", F.lit("normal")).withColumn("in_tree", F.lit(False))


@query("SELECT o_orderkey AS doc_id, o_orderkey || ':1' AS visual_id, 'own ' || o_orderkey AS caption, CASE WHEN o_custkey % 3 = 0 THEN 'n1 ' || o_orderkey || '|n2 ' || o_orderkey END AS notes FROM orders WHERE o_custkey % 2 = 0")
def embedded_captions(spark: SparkSession, d: str) -> DataFrame:
    b = _visuals(spark, d)
    parts = document.embedded_captions(b)
    notes = document.visual_notes(parts, b).select("doc_id", "visual_id", F.array_join("notes", "|").alias("notes"))
    return parts.where("part_type = 'figure_title'").select("doc_id", "visual_id", F.col("text").alias("caption")).join(notes, ["doc_id", "visual_id"], "left")


@query("""WITH g AS (SELECT o_orderkey AS k, CAST(o_orderkey % 90 AS DOUBLE) AS a, CAST(o_custkey % 80 AS DOUBLE) AS b FROM orders WHERE o_custkey % 2 = 1),
p AS (SELECT k, 'above' AS place, a AS gap FROM g WHERE a <= 60 AND a <= CASE WHEN b <= 60 THEN b ELSE 1000 END UNION ALL SELECT k, 'below', b FROM g WHERE b <= 60 AND b < CASE WHEN a <= 60 THEN a ELSE 1000 END)
SELECT k AS doc_id, place, '图 1 ' || place || ' ' || k AS caption, round_even(1 - gap / 60 * 0.4, 6) AS confidence FROM p""")
def proximity_captions(spark: SparkSession, d: str) -> DataFrame:
    b = _visuals(spark, d)
    found = document.proximity_captions(b, document.embedded_captions(b))
    return found.select("doc_id", "place", "caption", F.bround("confidence", 6).alias("confidence"))


@query("""WITH g AS (SELECT o_orderkey AS k, CAST(205 + o_orderkey % 21 AS DOUBLE) AS y1, CAST(225 + o_custkey % 80 AS DOUBLE) AS y2 FROM orders),
c AS (SELECT k, v, n, greatest(0, y - bottom, top - y - 5) AS gap, y + 5 <= top AS above FROM (SELECT k, 1 AS v, 100 AS top, 200 AS bottom, y1, y2 FROM g UNION ALL SELECT k, 2, 260, 300, y1, y2 FROM g) x, LATERAL (SELECT 1 AS n, y1 AS y UNION ALL SELECT 2, y2) t),
a AS (SELECT * FROM c WHERE v = 1 AND gap <= 60 QUALIFY row_number() OVER (PARTITION BY k ORDER BY gap, n) = 1),
b AS (SELECT c.* FROM c LEFT JOIN a ON a.k = c.k WHERE c.v = 2 AND c.gap <= 60 AND a.n IS DISTINCT FROM c.n QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY c.gap, c.n) = 1)
SELECT k AS doc_id, v AS visual, CASE WHEN above THEN 'above' ELSE 'below' END AS place, '图 ' || n || '-' || k || ' t' AS caption, n || '-' || k AS caption_no, CASE v WHEN 1 THEN 'figure_title' ELSE 'table_title' END AS caption_type,
round_even(1 - gap / 60 * 0.4, 6) AS confidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def caption_competition(spark: SparkSession, d: str) -> DataFrame:
    """A figure and a table on each page compete for two texts; the figure comes first."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    box = lambda top, bottom: F.array(F.lit(0.0), top.cast("double"), F.lit(100.0), bottom.cast("double"))
    part = lambda n, kind, text, b: F.struct(F.lit(n).alias("pos"), F.lit(kind).alias("block_type"), F.lit(n).alias("original_index"), text.alias("normalized_text"), b.alias("bbox"))
    y1, y2 = 205 + F.col("k") % 21, 225 + F.col("c") % 80
    caption = lambda n: F.concat(F.lit(f"图 {n}-"), F.col("k"), F.lit(" t"))
    parts = [part(1, "figure", F.lit(""), box(F.lit(100), F.lit(200))), part(2, "table", F.lit(""), box(F.lit(260), F.lit(300))), part(3, "paragraph", caption(1), box(y1, y1 + 5)), part(4, "paragraph", caption(2), box(y2, y2 + 5))]
    b = o.select(F.col("k").alias("doc_id"), F.lit(1).alias("pdf_page"), F.explode(F.array(*parts)).alias("b")).select("doc_id", "pdf_page", "b.*")
    b = b.withColumn("block_id", F.concat_ws(":", "doc_id", "pos")).withColumn("status", F.lit("normal")).withColumn("in_tree", F.lit(False))
    found = document.proximity_captions(b, document.embedded_captions(b))
    return found.select("doc_id", F.col("visual_pos").alias("visual"), "place", "caption", "caption_no", "caption_type", F.bround("confidence", 6).alias("confidence"))


@query("""WITH m AS (SELECT conv_id, turn, turn % 3 AS kind FROM conversations), h AS (SELECT DISTINCT conv_id FROM m WHERE kind = 0)
SELECT m.conv_id AS doc_id, turn, CASE WHEN kind = 0 THEN 'Header of ' || m.conv_id WHEN kind = 1 AND h.conv_id IS NOT NULL THEN 'body ' || turn WHEN kind = 1 THEN 'Header of ' || m.conv_id || ' ，body ' || turn ELSE 'Head ' || turn END AS text,
kind = 1 AND h.conv_id IS NOT NULL AS stripped FROM m LEFT JOIN h ON m.conv_id = h.conv_id""")
def header_residue(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("turn") % 3, F.col("turn").cast("string")
    head = F.concat(F.lit("Header of "), F.col("conv_id").cast("string"))
    text = F.when(k == 0, head).when(k == 1, F.concat(head, F.lit(" ，body "), t)).otherwise(F.concat(F.lit("Head "), t))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("pdf_page"), "turn", F.when(k == 0, "page_header").otherwise("paragraph").alias("block_type"), text.alias("normalized_text"), F.array().cast("array<string>").alias("rules"))
    out = document.without_header_residue(b)
    return out.select("doc_id", "turn", F.col("normalized_text").alias("text"), F.array_contains("rules", "header_residue_stripped").alias("stripped"))


@query("""SELECT p_partkey AS part_key, CASE p_partkey % 4 WHEN 0 THEN '/base/img/' || p_partkey || '.png' WHEN 1 THEN '/base/' || p_partkey || '.png' WHEN 2 THEN '/abs/' || p_partkey END AS path,
CASE p_partkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'missing' WHEN 2 THEN 'dir' ELSE 'empty' END AS class FROM part""")
def paths_resolved(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("img//"), s, F.lit(".png"))).when(k % 4 == 1, F.concat(F.lit("./x/../"), s, F.lit(".png"))).when(k % 4 == 2, F.concat(F.lit("/abs/"), s)).otherwise(" ")
    whole = document.resolved_path(path, "/base/")
    return table(spark, d, "part").select(k.alias("part_key"), whole.alias("path"), document.path_class(path, whole.endswith(".png") & whole.contains("/img/"), whole.startswith("/abs/")).alias("class"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.7485 AS x0, l_tax * 1000 AS y0, (l_quantity + 10 * l_linenumber) * 0.7485 AS x1, l_tax * 1000 + l_linenumber * 9 AS y1 FROM lineitem),
s AS (SELECT *, greatest(x1 - x0, 40.0) AS w, greatest(y1 - y0, 24.0) AS h FROM b)
SELECT l_orderkey AS order_key, l_linenumber AS line_number, count(*) AS n, CAST(sum(trunc(greatest(0, x0 - w * 0.1) * (150 / 72::DOUBLE))) AS BIGINT) AS x, CAST(sum(trunc(w * 1.2 * (150 / 72::DOUBLE))) AS BIGINT) AS w FROM s GROUP BY ALL""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    n, q, y = F.col("l_linenumber"), F.col("l_quantity").cast("double"), F.col("l_tax") * 1000
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), n.alias("line_number"), document.crop_box(F.array(q, y, q + 10 * n, y + n * 9)).alias("b"))
    return li.groupBy("order_key", "line_number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b.x").cast("long")).alias("x"), F.sum(F.col("b.w").cast("long")).alias("w"))


def _assets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    b = p.select(F.lit("d").alias("doc_id"), s.alias("source_ref"), F.when(k % 2 == 0, "figure").otherwise("table").alias("block_type"), F.concat(s, F.when(k % 6 == 0, ".JPG").otherwise(".png")).alias("image_path"))
    files = p.where("p_partkey % 3 = 0").select(F.concat(s, F.when(k % 6 == 0, ".JPG").otherwise(".png")).alias("path"), F.col("p_name").cast("binary").alias("content"))
    return document.assets(b, files, p.where("p_partkey % 3 <= 1").select(s.alias("source_ref"), F.col("p_brand").cast("binary").alias("content"))), files


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source_ref, CASE p_partkey % 3 WHEN 0 THEN 'parsed_asset' WHEN 1 THEN 'pdf_crop' ELSE 'failed' END AS origin, CASE p_partkey % 3 WHEN 0 THEN sha256(p_name) WHEN 1 THEN sha256(p_brand) END AS sha256,
CASE WHEN p_partkey % 6 = 0 THEN 'image/jpeg' WHEN p_partkey % 3 < 2 THEN 'image/png' END AS mime_type FROM part""")
def asset_records(spark: SparkSession, d: str) -> DataFrame:
    return _assets(spark, d)[0].select("source_ref", "origin", "sha256", "mime_type")


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_ref, p_partkey % 15 = 0 AS gone FROM part WHERE p_partkey % 3 = 0 AND (p_partkey % 15 = 0 OR p_partkey % 21 = 0)")
def changed_assets(spark: SparkSession, d: str) -> DataFrame:
    records, files = _assets(spark, d)
    number = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    now = files.where(number % 15 != 0).withColumn("content", F.when(number % 21 == 0, F.lit(b"other")).otherwise(F.col("content")))
    return checks.changed_assets(records.where("origin = 'parsed_asset'"), now).select("source_ref", F.col("now").isNull().alias("gone"))


@query("""WITH p AS (SELECT conv_id, turn // 2 AS page, list(CAST(turn AS VARCHAR) ORDER BY turn) FILTER (WHERE role = 'user') AS v FROM conversations GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(coalesce(sum(len(v)), 0) AS BIGINT) AS page_number_blocks, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE v IS NULL), '') AS without FROM p GROUP BY 1""")
def page_number_audit(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("pdf_page"), F.col("turn").alias("original_index"), F.when(F.col("role") == "user", "page_number").otherwise("paragraph").alias("block_type"), F.col("turn").cast("string").alias("raw_text"))
    a = plan.page_number_audit(b)
    return a.select("doc_id", F.col("page_number_blocks").cast("long").alias("page_number_blocks"), F.array_join(F.col("pages_without").cast("array<string>"), ",").alias("without"))


@query("""SELECT p_partkey AS part_key, md5('{"part_key":' || p_partkey || ',"name":"' || p_name || '","size":' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || ',"odd":{"brand":"' || p_brand || '","list":[1,null,"x"]},"yes":true}') AS line_md5 FROM part""")
def block_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines read into fields and others, and written again."""
    size = F.when(F.col("p_partkey") % 5 == 0, "null").otherwise(F.col("p_size").cast("string"))
    line = F.concat(F.lit('{"yes":true,"part_key":'), F.col("p_partkey").cast("string"), F.lit(',"odd":{"brand":"'), "p_brand", F.lit('","list":[1,null,"x"]},"name":"'), "p_name", F.lit('","size":'), size, F.lit("}"))
    b = document.block_from_json(table(spark, d, "part").select(line.alias("value")), "part_key long, name string, size int")
    out = document.block_json(b, ["part_key", "name", "size"])
    return out.select(F.get_json_object("value", "$.part_key").cast("long").alias("part_key"), F.md5("value").alias("line_md5"))


_NUMBERED = ", ".join(
    [f"l1 AS (SELECT *, own AS base FROM s WHERE level = 1), n1 AS (SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS number FROM l1 WINDOW w AS (PARTITION BY conv_id, base ORDER BY turn)), a1 AS (SELECT * FROM n1)"]
    + [f"l{k} AS (SELECT s.*, coalesce(u.number || '.' || own, own) AS base FROM s LEFT JOIN a{k - 1} u ON s.conv_id = u.conv_id AND s.up = u.turn WHERE level = {k}), n{k} AS (SELECT conv_id, turn, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS number FROM l{k} WINDOW w AS (PARTITION BY conv_id, base ORDER BY turn)), a{k} AS (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM n{k})" for k in range(2, 7)]
)


@query(f"""WITH c AS (SELECT conv_id, turn, 1 + length(text) % 6 AS level, CAST(length(text) % 4 AS VARCHAR) AS own FROM conversations),
s AS (SELECT a.conv_id, a.turn, a.level, a.own, max(b.turn) AS up FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY ALL), {_NUMBERED} SELECT * FROM a6""")
def section_number(spark: SparkSession, d: str) -> DataFrame:
    leveled = table(spark, d, "conversations").withColumn("level", (1 + F.length("text") % 6).cast("int"))
    p = order.parents(leveled, ["conv_id"], "turn", "level").withColumn("own", (F.length("text") % 4).cast("string"))
    return order.level_numbers(p, ["conv_id"], "turn", "level", "own").select("conv_id", "turn", "number")


@query("SELECT conv_id FROM (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE (conv_id + turn) % 5 <> 1 GROUP BY 1) WHERE n <> d OR lo <> 1 OR hi <> n")
def chk_order(spark: SparkSession, d: str) -> DataFrame:
    return checks.not_consecutive(table(spark, d, "conversations").where("(conv_id + turn) % 5 <> 1"), ["conv_id"], "turn").select("conv_id")


@query("WITH p AS (SELECT conv_id, turn // 2 + CASE WHEN turn > 4 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS page, count(*) AS n FROM conversations GROUP BY ALL) SELECT conv_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS blocks, min(n) AS least, max(n) AS most, round_even(avg(n), 4) AS mean, max(page) - min(page) + 1 = count(*) AS continuous FROM p GROUP BY 1")
def page_continuity(spark: SparkSession, d: str) -> DataFrame:
    page = F.floor(F.col("turn") / 2) + F.when((F.col("turn") > 4) & (F.col("conv_id") % 3 == 0), 1).otherwise(0)
    return checks.page_summary(table(spark, d, "conversations").withColumn("page", page), ["conv_id"], "page")


# Graph rows: regions equip nations, market segments suggest them.


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    node = lambda df, p, i, label, key: df.select(F.concat(F.lit(p), F.col(i).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("key")).distinct()
    nodes = order.union_all([node(n, "n", "n_nationkey", "Parameter", "n_name"), node(r, "r", "r_regionkey", "Equipment", "r_name"), node(c, "m", "c_mktsegment", "Condition", "c_mktsegment")])
    limit = n.select(F.concat(F.lit("l"), "n_nationkey").alias("id"), F.lit("LIMITS").alias("type"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), (F.col("n_nationkey") / 10).cast("double").alias("confidence"), F.array(F.lit("a:1")).alias("source_refs"), F.lit(None).cast("string").alias("target_change"))
    rule = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("SUGGESTS_ADJUSTMENT").alias("type"), F.concat(F.lit("m"), "c_mktsegment").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit(0.5).alias("confidence"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.col("c_name"))).alias("source_refs"), F.when(F.col("c_acctbal") > 0, "increase").otherwise("decrease").alias("target_change"))
    edges = limit.unionByName(rule).withColumn("condition_text", F.lit(None).cast("string")).withColumn("provenance_type", F.lit(None).cast("string"))
    return nodes, edges


@query("SELECT r_name AS equipment_id, n_name AS parameter_code, 'l' || n_nationkey AS edge_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <= 'ASIA'")
def equip_limits(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _rows(spark, d)
    found = [graph.limits(edges, nodes, e) for e in ("AFRICA", "AMERICA", "ASIA")]
    return order.union_all(found).select("equipment_id", "parameter_code", "edge_id")


@query("SELECT n_name AS parameter_code, r_name || ':l' || n_nationkey AS equipment FROM nation JOIN region ON n_regionkey = r_regionkey")
def attached_limits(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _rows(spark, d)
    g = graph.grouped_limits(graph.limits(edges, nodes))
    return g.select("parameter_code", F.array_join(F.transform("equipment_limits", lambda x: F.concat_ws(":", x["equipment_id"], x["edge_id"])), ",").alias("equipment"))


@query("SELECT 'c' || c_custkey AS id, c_mktsegment AS condition_code, n_name AS parameter_code, CASE WHEN c_acctbal > 0 THEN 'increase' ELSE 'decrease' END AS target_change, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS refs FROM customer JOIN nation ON c_nationkey = n_nationkey")
def adjust_rules(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _rows(spark, d)
    return graph.rules(edges, nodes).select("id", "condition_code", "parameter_code", "target_change", F.array_join("source_refs", ",").alias("refs"))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_refs FROM customer WHERE c_custkey IN (1, 2, 3, 10)")
def path_sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_sources(_rows(spark, d)[1], ["c1", "c2", "c3", "c10"]).select("id", F.size("source_refs").alias("n_refs"))


@query("""WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_discount, max(l_discount) OVER (PARTITION BY l_suppkey) AS m FROM lineitem), k AS (SELECT * FROM b WHERE l_suppkey % 3 = 0 AND l_discount = 0.02)
SELECT l_suppkey AS supp_key, l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key, false AS backfilled FROM k UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, true FROM b WHERE l_discount >= m - 1e-9 AND l_suppkey NOT IN (SELECT l_suppkey FROM k)""")
def backfill_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines with some discount as chosen paths of a supplier, and the best ones of suppliers without."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp_key"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_key"), "l_discount")
    return stats.backfilled(li.where("supp_key % 3 = 0 and l_discount = 0.02"), stats.argmax_ties(li, ["supp_key"], "l_discount"), ["supp_key"]).drop("l_discount")


@query("""WITH p AS (SELECT p_partkey, ['flat', 'vertical', 'overhead'][1 + p_size % 3] AS pos, lag(['flat', 'vertical', 'overhead'][1 + p_size % 3]) OVER (ORDER BY p_partkey) AS old FROM part)
SELECT p_partkey AS part_key, CASE WHEN old IS NULL THEN 'position_changed' WHEN pos = old THEN 'position_same' WHEN pos = 'vertical' THEN 'position_to_vertical' WHEN pos = 'overhead' THEN 'position_to_overhead' ELSE 'position_changed' END AS code, CASE WHEN old IS NULL THEN 'missing in base' END AS note FROM p""")
def diff_position_code(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("flat", "vertical", "overhead"))), 1 + F.col("p_size") % 3).alias("position"))
    numbered = order.running_numbers(p.withColumn("span", F.floor(F.col("p_partkey") / 65_536)), ["span"], ["p_partkey"], "n")
    before = numbered.select((F.col("n") + 1).alias("n"), F.col("position").alias("old"))
    both = numbered.join(before, "n", "left").withColumn("x", F.explode(diff.diff_rows((Field("position"),), lambda f: F.col("position"), lambda f: F.col("old"))))
    return both.select(F.col("p_partkey").alias("part_key"), "x.code", "x.note")


# Imports.


@query("SELECT c_custkey AS row_key, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(length(c_name) AS DOUBLE) END AS size, CASE WHEN c_custkey % 10 = 0 THEN 'not embedded' END AS warning FROM customer")
def case_embed(spark: SparkSession, d: str) -> DataFrame:
    def embedder(texts):
        if any(t.endswith("0") for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 10 == 0, F.lit("0")).otherwise("x")).alias("retrieval_text"))
    e = embedding.with_embeddings(c, embedder)
    return e.select(F.col("c_custkey").alias("row_key"), (F.element_at("embedding", 1) - 1).cast("double").alias("size"), F.col("embedding_warning").alias("warning"))


def _cases(spark: SparkSession, d: str):
    p = table(spark, d, "part")
    none = F.array().cast("array<string>")
    cases = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("string").alias("case_id"), F.when(F.col("p_partkey") % 5 == 0, "changed").otherwise(F.col("p_type")).alias("process"), F.array(F.concat(F.lit("condition:"), "p_brand")).alias("conditions"), none.alias("parameters"), none.alias("results"))
    stored = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("case_id"), F.col("p_type").alias("process"))
    edges = stored.select(F.col("case_id").alias("src"), F.lit("HAS_CONDITION").alias("type"), F.lit("old").alias("dst"))
    nodes = p.select(F.lit("Condition").alias("label"), F.col("p_brand").alias("key")).distinct()
    return ingest.import_cases(cases, stored, edges, nodes)


@query("""WITH i AS (SELECT p_partkey AS k, p_partkey % 4 <> 0 AS inc, p_partkey % 3 <> 0 AS old, p_partkey % 5 = 0 AND p_type <> 'changed' AS ch FROM part)
SELECT CAST(k AS VARCHAR) AS case_id, CASE WHEN NOT inc THEN 'kept' WHEN NOT old THEN 'created' WHEN ch THEN 'updated' ELSE 'skipped' END AS action FROM i WHERE inc OR old""")
def upsert_cases(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)[1].select("case_id", "action")


@query("SELECT CAST(p_partkey AS VARCHAR) AS src, p_brand AS dst FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'old' FROM part WHERE p_partkey % 3 <> 0")
def case_edges(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)[2].select("src", "dst")


@query("""WITH e AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS n FROM customer)
SELECT error, count(*) AS n FROM (SELECT 'bad_conditions' AS error FROM (SELECT DISTINCT seg FROM e WHERE k % 7 = 0) UNION ALL SELECT 'missing_parameters' FROM (SELECT DISTINCT n FROM e WHERE n % 4 = 0)) GROUP BY 1""")
def case_errors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    nation = F.col("c_nationkey").cast("string")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.array(F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("condition:"), "c_mktsegment"))).alias("conditions"), F.array(F.concat(F.lit("parameter:"), nation)).alias("parameters"), F.array().cast("array<string>").alias("results"))
    nodes = c.select(F.lit("Condition").alias("label"), F.col("c_mktsegment").alias("key")).unionByName(c.where("c_nationkey % 4 <> 0").select(F.lit("Parameter").alias("label"), nation.alias("key"))).distinct()
    return ingest.case_errors(cases, nodes).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS row_key, c_mktsegment AS conditions FROM customer")
def enriched_refs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    none = F.array().cast("array<string>")
    edges = ingest.case_edges(c.select(F.col("c_custkey").alias("case_id"), F.array(F.concat(F.lit("condition:"), "c_mktsegment"), F.lit("condition:nowhere")).alias("conditions"), none.alias("parameters"), none.alias("results")))
    nodes = c.select(F.lit("Condition").alias("label"), F.col("c_mktsegment").alias("key")).distinct()
    return ingest.enrich_refs(edges, nodes).select(F.col("case_id").alias("row_key"), F.regexp_replace(F.array_join("conditions", ","), "condition:", "").alias("conditions"))
