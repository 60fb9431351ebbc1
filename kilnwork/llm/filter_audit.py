"""How filters interact: what each of five would remove at each place of each of their 120 orders.

A document fails some of the filters A to E; its failures are a mask of five bits. For each part and each label (all documents, good
ones, toxic ones) 32 signed sums are aggregated, one for each set of filters: documents that fail an odd number of the set count -1,
all others +1. That is the Walsh-Hadamard transform of the counts by mask, summed where the rows are and merged like any sum. The
fast transform of five butterflies, divided by 32, gives the 32 cells back exactly, and from a part's cells follow all orders and
steps: what a step removes is the cells with its bit and none of the earlier ones. The Shapley column needs no order: a document that
fails k filters falls to each of them in 120 / k orders.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals (A-Z) > 5 * code points; D holds one of #$%&*|;
E the text of a row with a lesser id, anywhere in the table. Words are maximal runs without blanks and 0x09 to 0x0D.

Texts are read once and go no further than the scan: digests, masks and parts are shuffled. A group of copies is summed by part and label before its least id
is sought, so a text that a third of all rows share is spread like any other.

Defined cases: a null text is empty; a null source is the part ''. A row with a null id is no copy and makes none, and has no labels; of
rows with equal ids and texts none is the other's copy. Labels that repeat an id count as good or toxic if one of them says so. An empty
table gives no rows. Columns other than id, text and source (id, quality and toxic of labels) are not read. A text's words are one array of its row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.blocks import saved

FILTERS = "ABCDE"
LABELS = ("all", "good", "toxic")
BLANKS = r"[ \t-\r]+"
CELLS = 1 << len(FILTERS)


def failures(text: Column) -> Column:
    """Bits 0 to 3: which of A to D a text fails."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, distinct.cast("long") * 100 < n.cast("long") * 65, capitals.cast("long") * 100 > F.length(text).cast("long") * 5, text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, good, toxic, mask, n: rows that are alike in these, up to their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    known = rows.where("id is not null").join(judged, F.col("id") == F.col("of"), "left").select("id", "part", "mask", "digest", no("good"), no("toxic"))
    alike = ["digest", "part", "mask", "good", "toxic"]
    # By id first, so that the least id of a group comes with the number of its rows.
    each = known.groupBy(*alike, "id").agg(F.count(F.lit(1)).alias("n"))
    groups = saved(docs.sparkSession, each.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first")), "alike")
    least = groups.groupBy("digest").agg(F.min("first.id").alias("least"), F.sum("n").alias("copies")).where("copies > 1")
    met = groups.join(least.select(F.col("digest").alias("as"), "least"), F.col("digest") == F.col("as"), "left")
    firsts = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    split = met.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", firsts.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - firsts).alias("n")))).alias("c"))
    nameless = rows.where("id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    return split.where("c.n > 0").select("part", "good", "toxic", "c.mask", "c.n").unionByName(nameless)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, label, sums: for each of the 32 sets of filters, rows that fail an even number of them less those that fail an odd number."""
    of = F.array(F.lit(LABELS[0]), *[F.when(F.col(c), F.lit(c)) for c in LABELS[1:]])
    long = rows.select("part", "mask", "n", F.explode(F.array_compact(of)).alias("label"))
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    return long.groupBy("part", "label").agg(*[F.sum(sign(s) * F.col("n")).alias(f"s{s}") for s in range(CELLS)]).select("part", "label", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """Counts by mask from the signed sums: the transform is its own inverse up to a division by the number of cells."""

    steps = F.array(*[F.lit(1 << b) for b in range(len(FILTERS))])
    butterfly = lambda a, s: F.transform(a, lambda x, i: F.when(i.bitwiseAND(s) == 0, x + F.get(a, i + s)).otherwise(F.get(a, i - s) - x))
    return F.transform(F.aggregate(steps, sums, butterfly), lambda x: F.shiftright(x, len(FILTERS)))


def _total(counts: Column, where) -> Column:
    return F.aggregate(F.transform(counts, lambda x, m: F.when(where(m), x).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part, order and step."""
    sums = parity_sums(masked(docs, labels, id_col, text_col, source_col)).select("part", "label", cells(F.col("sums")).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    parts = sums.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS])
    per = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    letters = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.substring(F.col("filter_order"), i, F.lit(1)))
    bits = F.transform(letters, lambda c: F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(FILTERS) for x in (c, 1 << i)]), c))
    per = per.withColumn("bits", bits).select("*", F.posexplode("bits").alias("at", "bit"))
    before = F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda a, b: a.bitwiseOR(b))
    per = per.withColumn("before", before)
    fails, earlier = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    here = lambda m: fails(m) & ~earlier(m)
    fair = F.transform("all", lambda x, m: x * (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("long"))
    return per.select(
        "part",
        "filter_order",
        (F.col("at") + 1).alias("step"),
        _total(F.col("all"), lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _total(F.col("all"), here).alias("removed"),
        _total(F.col("all"), lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("all", F.col("bit")).alias("unique_fails"),
        _total(F.col("good"), here).alias("good_lost"),
        _total(F.col("toxic"), here).alias("toxic_lost"),
        _total(fair, fails).alias("shapley"),
    )


#: DuckDB: the rows of op12_filter_audit, from each document's five failures and every order in turn.
ORACLE_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
  len(ws) < 50,
  100 * len(list_distinct(ws)) < 65 * len(ws),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  regexp_matches(t, '[#$%&*|]'),
  coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n, CAST(len(list_filter(fails, lambda x: x)) AS BIGINT) AS k FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places FROM l a, l b, l c, l d, l e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, step, places[step] AS i, places[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (SELECT part, filter_order, step, n, k, good, toxic, fails[i] AS own, len(list_filter(before, lambda x: fails[x])) > 0 AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE own AND k = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(k, 1)) FILTER (WHERE own), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step
"""
