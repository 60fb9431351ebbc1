"""What only shows at scale, by small bounds: hot families, repeated ids, many buckets, shuffles in place of broadcasts, ids of other types, long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import blocks, decontaminate, line_dedup, media_ts, mixing, ngram_jaccard, ngram_lm, pii, queries, suffix_dedup, token_counts, toxicity
from tests.llm import brute
from tests.llm.conftest import prose


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_templates_are_strangers(spark):
    """Rows that differ in their last word share most n-grams and can't link, so they form no family."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.format_string("a b c d e f g h w%d", F.col("id") % 19_999).alias("text")).repartition(4)
    got = ngram_jaccard.ngram_jaccard(df).where("doc_id <> component_id").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(19_999, 0)]


@pytest.mark.parametrize("elements,sets", [(1 << 20, 3), (300, 2), (1 << 20, 1 << 13)])
def test_families_in_parts(spark, elements, sets):
    """Near copies and strangers that share n-grams, in tiles of a few sets."""
    rng = random.Random(elements + sets)
    base = prose(rng, 60).split()
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(6)}"
        texts.append(" ".join(w[: rng.choice([60, 60, 55, 50, 30, 9, 8])]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_jaccard.ngram_jaccard(df, part_elements=elements, part_sets=sets).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.jaccard(list(enumerate(texts))))


def test_without_broadcasts(spark, docs, texts):
    """The ways beyond each bound on a broadcast give the same rows."""
    got = ngram_jaccard.ngram_jaccard(docs, part_elements=300, part_sets=4, pivot_bytes=0, broadcast_bands=0).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(repr, brute.jaccard(rows(docs))))
    one, two = (suffix_dedup.suffix_dedup(docs, hot_bytes=500, broadcast_groups=n).select("doc_id", "n_removed", "kept").collect() for n in (500_000, 0))
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and any(r.n_removed for r in one)
    items = spark.createDataFrame([(1, " ".join(texts[30].split()[3:20])), (2, "A b C d")], "item_id long, text string")
    one, two = (decontaminate.decontaminate(docs, items, broadcast_items=n).select("doc_id", "n_hit", "items").collect() for n in (200_000, 0))
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and any(r.n_hit for r in one)


def test_more_buckets_than_files(spark, docs):
    files, buckets = 3, 12
    keys = np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)
    b = blocks.home(keys, buckets, files)
    assert sorted(set(b.tolist())) == list(range(buckets)) and ((b // 4) == blocks.file_of(keys, buckets, files)).all()
    for f in range(files):  # buckets of a file stand in the order of their keys
        mine = blocks.file_of(keys, buckets, files) == f
        order = np.argsort(keys[mine])
        assert (np.diff(b[mine][order]) >= 0).all()
    got = ngram_jaccard.ngram_jaccard(docs, files=files).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(repr, brute.jaccard(rows(docs))))


def test_maps_beyond_the_bound(tmp_path):
    for i in range(9):
        blocks.save(str(tmp_path / str(i)), np.arange(i + 1))
    cache: dict = {}
    for _ in range(2):
        for i in range(9):
            assert blocks.mapped(cache, str(tmp_path / str(i)), np.int64, most=4).tolist() == list(range(i + 1))
    assert len(cache) == 4


def test_one_id_for_very_many_rows(spark):
    """Slots of one id split by content, and by place where all columns agree."""
    same = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("v "), (F.col("id") % 5).cast("int"))).alias("text"), F.lit("a").alias("source"))
    null = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("b").alias("source"))
    docs = same.unionByName(null).unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("c").alias("source")))
    for sources in (100_000, 0):
        got = mixing.mix_sources(docs, slot_rows=500, broadcast_sources=sources).groupBy("row.source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most"), F.count("*").alias("n")).collect()
        assert {r.source: r.n for r in got} == {"a": 30_000, "b": 30_000, "c": 100}
        for r in got:
            assert abs(r.taken - r.target) <= 5 and r.most <= 2


def test_equal_rows_share_dropped_lines(spark):
    texts = [(1, "common\nown")] * 50 + [(i, f"common\nline {i}") for i in range(2, 12)] + [(None, "common"), (None, "common")]
    for keys in (500_000, 0):
        out = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), broadcast_keys=keys).collect()
        assert {(r.doc_id, r.n_dropped, r.kept) for r in out} == {(1, 1, "own"), (None, 1, ""), *((i, 1, f"line {i}") for i in range(2, 12))}


def test_ids_of_any_type(spark, texts):
    named = spark.createDataFrame([(f"k-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    number = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("b-1", " ".join(texts[30].split()[3:20]))], "item_id string, text string")
    one = {"a": named, "b": number}
    path = queries.tokenizer_path()
    store = ngram_lm.fit(number)
    runs = [
        lambda d: ngram_lm.score_texts(d, store),
        lambda d: decontaminate.decontaminate(d, items),
        lambda d: suffix_dedup.suffix_dedup(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"),
        lambda d: pii.find_pii(d),
        lambda d: media_ts.transport_columns(d, keep_media=False),
        lambda d: token_counts.token_prefix_counts(d, path, keep_store=False),
    ]
    for run in runs:
        got = {k: run(d) for k, d in one.items()}
        assert [t for _, t in got["a"].dtypes[1:]] == [t for _, t in got["b"].dtypes[1:]] and got["a"].schema["doc_id"].dataType.typeName() == "string"
        assert sorted(repr(tuple(r)) for r in got["b"].select(F.format_string("k-%d", "doc_id"), *got["b"].columns[1:]).collect()) == sorted(repr(tuple(r)) for r in got["a"].collect())
    label = lambda df: {x: {r.doc_id for r in df.where(F.col("component_id") == x).collect()} for x in {r.component_id for r in df.collect()}}
    a, b = (label(ngram_jaccard.ngram_jaccard(d)) for d in one.values())
    assert sorted(sorted(x) for x in a.values()) == sorted(sorted(f"k-{i}" for i in x) for x in b.values())


def test_texts_over_a_mebibyte(spark):
    long = "plain words and a line of them\n" * 40_000 + "mail ann@example.org"
    df = spark.createDataFrame([(1, long), (2, long[:-1]), (3, "short")], "doc_id long, text string")
    n = len(long)
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, min_docs=2).collect()} == {(1, 40_001, 40_000), (2, 40_001, 40_000), (3, 1, 0)}
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(df).collect()) == sorted(brute.jaccard(rows(df)))
    items = spark.createDataFrame([(1, "of them mail ann example org")], "item_id long, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate.decontaminate(df, items).collect()} == {(1, 6), (2, 0), (3, 0)}
    assert {r.doc_id: r.n_bytes for r in token_counts.token_prefix_counts(df, queries.tokenizer_path(), keep_store=False).collect()} == {1: n, 2: n - 1, 3: 5}
    assert {r.doc_id: [s.kind for s in r.base] for r in pii.find_pii(df).collect()} == {1: ["email"], 2: ["email"], 3: []}
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(df, labels).count() == 3
    assert {r.size for r in mixing.mix_sources(df.withColumn("source", F.lit("s"))).collect()} == {len(long.split()), 1}


def test_kept_once_replaces_an_incomplete_folder(spark):
    from kilnwork.sources.shared import kept_once, shared_base

    path = f"{shared_base(spark)}/kept-test"
    spark.range(3).write.parquet(path)
    spark._jvm.java.io.File(f"{path.removeprefix('file://')}/_SUCCESS").delete()
    for _ in range(2):
        assert kept_once(spark, "kept-test", lambda: spark.range(5)).count() == 5
