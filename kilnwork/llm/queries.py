"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import collocations, decontaminate, filter_audit, line_dedup, media_ts, mixing, ngram_jaccard, ngram_lm, packing, pii, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = ngram_lm.fit(docs.where(ngram_lm.fold() != 0))
    out = ngram_lm.score_texts(docs, store)
    return out.withColumn("held_out", F.coalesce(ngram_lm.fold() == 0, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.size(F.filter("base.kind", F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_ts.transport_columns(_table(spark, sf_dir, "documents"), keep_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_prefix_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_store=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False).drop("ids")


QUERIES = {f.__name__: f for f in (op1_ngram_lm, op2_decontaminate, op3_line_dedup, op4_ngram_jaccard, op5_toxicity, op6_suffix_dedup, op7_pii, op8_transport_streams, op9_token_counts, op10_mix_sources, op11_collocations, op12_filter_audit, op13_packing)}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE_SQL, "op3_line_dedup": line_dedup.ORACLE_SQL.format(docs="documents"), "op10_mix_sources": mixing.ORACLE_SQL.format(docs="documents"), "op11_collocations": collocations.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
