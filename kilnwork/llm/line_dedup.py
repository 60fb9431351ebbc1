"""Line deduplication over a corpus, in DataFrame functions only.

Every text is split at line feeds; a line's key is the line without ASCII white space at both ends, A-Z
lower-cased. Distinct key hashes are exploded per document and counted over distinct documents; the lines
whose keys reach the threshold go from every document, and the others are joined again in their order.

Shuffles: 16-byte key hashes with their document ids; the places of lines to drop; then texts once, to meet the
places that their row has. A document's lines are never exploded as texts. Counting is pre-aggregated
before each shuffle, so a line that a third of all documents share is no hot key. Work grows in proportion to a
document's lines, however many of them are dropped.

Defined cases: a null or empty text is one empty line, which stays. Keys shorter than ``min_chars`` code
points always stay. Rows with the same id are one document for counting and each keeps its row; rows with a
null id are one document together; rows equal in id and text share the places that are dropped. A very long text is one row, its lines
one array. Columns other than id and text are not read unless ``passed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.blocks import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
#: Frequent keys up to which they are broadcast (16 bytes each); beyond, the join shuffles and AQE splits what is skewed.
BROADCAST_KEYS = 500_000
#: Stands for a null id while ids are compared.
NO_ID = "\x00"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits, so that unequal keys don't meet: two 64-bit hashes with different seeds (the literal comes first, as each column's hash seeds the next)."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", passed: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text) for each row; ``passed`` adds the other columns of ``docs`` as struct ``row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]) if passed else F.lit(None)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = _hash(text)
    base = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit(NO_ID)).alias("id"), named["a"].alias("ta"), named["b"].alias("tb"), F.split(text, "\n", -1).alias("lines"))
    keys = F.transform("lines", line_key)
    keyed = base.select("id", F.explode(F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), _hash))).alias("h"))
    frequent = keyed.select("id", F.col("h.a").alias("a"), F.col("h.b").alias("b")).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    frequent = saved(docs.sparkSession, frequent, "frequent-lines")
    if frequent.count() <= broadcast_keys:  # then a line of very many documents doesn't meet in one task
        frequent = F.broadcast(frequent)
    placed = base.select("id", "ta", "tb", F.posexplode(F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, _hash(k)))).alias("at", "h")).where("h is not null")
    gone = placed.select("id", "ta", "tb", "at", F.col("h.a").alias("a"), F.col("h.b").alias("b")).join(frequent, ["a", "b"], "left_semi")
    gone = gone.groupBy("id", "ta", "tb").agg(F.collect_set("at").alias("drop"))
    out = base.join(gone.hint("shuffle_hash"), ["id", "ta", "tb"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    out = out.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(*["row"] * passed, "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))


#: DuckDB: one row for each document, as the query op3_line_dedup gives them.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-')) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id, r
"""
