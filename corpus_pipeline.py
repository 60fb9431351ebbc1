"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on the documents that the one before it kept; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them again for the next. All stages but the last
return the columns of ``documents``.

1. toxicity: documents that score 0.5 or more go. Learns from labelled documents outside the held-out fold.
2. line_dedup: lines whose keys at least 10 documents share go from all texts; ``n_chars`` follows.
3. near_duplicates: of each group that five-word Jaccard similarity of 0.8 links, the document with the least
   id stays. Documents without words are linked with nothing and stay.
4. decontamination: documents that hold a ten-word window of a benchmark item go.
5. mixing: words are taken as the mixing operator says; a row for each repetition of a document, numbered from
   1 in ``repetition``.

Defined cases: a null text counts as empty and is empty after line dedup. An empty document stays up to
mixing, which takes no documents without words, as they add none. Rows with equal ids are one document for
every decision; of those with equal texts, too, near-duplicate removal keeps one. Rows with a null id are kept
by every filter but toxicity and decontamination, which judge them by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import decontaminate, line_dedup, mixing, ngram_jaccard, toxicity
from kilnwork.llm.blocks import saved, shared_dir
from kilnwork.sources.shared import scratch

#: Ids to remove up to which they are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, _table(spark, sf_dir, "labels"), passed=True)
    return scored.where("score < 0.5").select(*COLUMNS)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs.select(*COLUMNS), passed=True)
    return out.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.length("kept").cast("long").alias("n_chars"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = saved(spark, ngram_jaccard.ngram_jaccard(docs).where("doc_id is not null"), "near-duplicates")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    out = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    repeated = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if repeated.isEmpty():
        return out
    single = out.join(repeated, F.col("doc_id") == F.col("again"), "left_anti")
    return single.unionByName(out.join(repeated, F.col("doc_id") == F.col("again"), "left_semi").dropDuplicates(["doc_id", "text"]))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    checked = decontaminate.decontaminate(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"), passed=True)
    return checked.where("n_hit = 0").select("row.*")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0 and size > 0")
    return mixed.select("row.*", "size", "source_size", "target", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("repetition"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
]

#: Toxicity is a trained model, so SQL can't express the rows; a test holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage keeps on the way goes once its rows are written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
