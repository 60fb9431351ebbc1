"""Line dedup, decontamination, Jaccard join, suffix dedup and language model against plain Python."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.llm import decontaminate, line_dedup, ngram_jaccard, ngram_lm, suffix_dedup, textscan
from tests.llm import brute


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    order = lambda xs: sorted(map(repr, xs))
    assert order(got) == order(want)


def test_line_dedup(docs):
    got = line_dedup.line_dedup(docs).collect()
    want = brute.lines([("-" if i is None else i, t) for i, t in rows(docs)])
    same([("-" if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got], want)
    assert any(r.n_dropped for r in got)


def test_line_dedup_passes_other_columns(docs):
    out = line_dedup.line_dedup(docs, passed=True)
    assert out.select("row.lang", "row.size", "kept").count() == docs.count()


@pytest.mark.parametrize("parts", [1 << 20, 100])
def test_jaccard(docs, parts):
    got = ngram_jaccard.ngram_jaccard(docs, part_elements=parts).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute.jaccard(rows(docs)))
    assert sum(r.component_id != r.doc_id for r in got if r.doc_id is not None) > 10


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontaminate(spark, docs, texts, limit):
    w = texts[30].split()
    items = [(1, " ".join(w[3:20])), (2, " ".join(w[3:20]).upper()), (10, "A b C d"), (3, None), (4, "..."), (5, " ".join(w[1:10])), (6, "nowhere in any of these texts are so many words to be found")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, tests, broadcast_bytes=limit).collect()
    same([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], brute.contamination(rows(docs), items))
    assert any(r.n_hit for r in got)
    passed = decontaminate.decontaminate(docs, tests, broadcast_bytes=limit, passed=True)
    assert passed.select("row.size", "n_hit").count() == docs.count()


def test_winnowing_guarantee():
    rng = random.Random(1)
    for _ in range(300):
        shared = [rng.randrange(5) for _ in range(10)]
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(8))] + shared + [rng.randrange(5) for _ in range(rng.randrange(8))] for _ in range(2))
        fa, fb = (set(decontaminate.winnow(textscan.mix(np.array(x, np.uint64) + np.uint64(9)), np.array([0, len(x)]))[0].tolist()) for x in (a, b))
        assert fa & fb


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BYTES, 500])
def test_suffix_dedup(docs, hot):
    got = suffix_dedup.suffix_dedup(docs, hot_bytes=hot).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], brute.repeated_bytes(rows(docs)))
    assert any(0 < r.n_removed < r.n_bytes for r in got) and any(r.n_removed == r.n_bytes > 0 for r in got)


def test_suffix_dedup_of_periodic_text(spark):
    d = [(1, "ab" * 400), (2, "x" * 399), (3, "y" * 401), (4, "q" + "ab" * 200), (5, "abcdefghijk lmno " * 300), (6, "0" + "abcdefghijk lmno " * 40)]
    for hot in (suffix_dedup.HOT_BYTES, 0):
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(d, "doc_id long, text string"), hot_bytes=hot).collect()
        same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], brute.repeated_bytes(d))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4))
def test_suffix_order(seed, letters):
    rng = np.random.default_rng(seed)
    parts = [np.tile(rng.integers(97, 97 + letters, rng.integers(200, 700)), 3)[: rng.integers(400, 900)] for _ in range(4)]
    text = np.concatenate(parts).astype(np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = textscan.ragged(np.cumsum(sizes) - sizes, sizes - 399)
    order, equal = suffix_dedup.suffix_classes(text, starts, most=100)
    strings = [text[i : i + 400].tobytes() for i in starts[order]]
    assert strings == sorted(strings)
    assert equal.tolist() == [False, *(a == b for a, b in zip(strings, strings[1:]))]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.sampled_from(suffix_dedup.STEPS))
def test_equal_suffixes_are_dealt_out_alike(seed, letters, step):
    """Runs cover every suffix of a segment once, and equal strings have equal keys in whatever surroundings."""
    rng = np.random.default_rng(seed)
    shared = rng.integers(97, 97 + letters, 700)
    keys: dict[bytes, set[int]] = {}
    for _ in range(3):
        text = np.concatenate([rng.integers(97, 97 + letters, rng.integers(0, 300)), shared, rng.integers(97, 97 + letters, rng.integers(0, 300))]).astype(np.uint8)
        least = suffix_dedup.sliding_least(textscan.fixed_hash(text, suffix_dedup.CORE), 400 - suffix_dedup.CORE + 1)
        for a, z in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.append(True, least[1:] != least[:-1])), len(least)))):
            covered = []
            for key, c, e in suffix_dedup.finer(text[a : z + 399], step):
                covered += range(c, e)
                for i in range(c, e):
                    keys.setdefault(text[a + i : a + i + 400].tobytes(), set()).add(key)
            assert covered == list(range(z - a))
    assert all(len(k) == 1 for k in keys.values())


def test_suffix_dedup_of_a_hot_passage(spark):
    """A passage that every text holds in other surroundings, with copies of some."""
    rng = random.Random(12)
    word = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = word(120)
    d = [(i, f"{word(rng.randint(0, 60))} {passage[rng.randint(0, 60):]} {word(rng.randint(0, 60))}") for i in range(60)]
    d += [(100, d[3][1]), (None, d[4][1]), (None, d[4][1]), (7, d[8][1])]
    frame = spark.createDataFrame(d, "doc_id long, text string")
    want = brute.repeated_bytes(d)
    for hot in (suffix_dedup.HOT_BYTES, 20_000, 0):
        same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame, hot_bytes=hot).collect()], want)


def test_suffix_dedup_of_very_long_texts(spark):
    """Texts over 1 MiB, with repeats within and across the borders of the parts that are scanned."""
    rng = random.Random(13)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=(1 << 20) + 150_000))
    border = long[(1 << 20) - 700 : (1 << 20) + 300]
    d = [(1, long[:500_000] + long[2_000:3_500] + long[500_000:]), (2, "x " + border + " y"), (3, long[-450:]), (4, long[-399:])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(d, "doc_id long, text string")).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], brute.repeated_bytes(d))


def test_tables_by_digest(spark, tmp_path):
    """All rows of a digest are found in the bucket that SQL computes; digests that agree in their first half are told apart."""
    import pyarrow as pa

    digests = [bytes([i]) + b"\xff" * 15 for i in range(40)] + [bytes([7]) + b"\xff" * 7 + b"x" * 8]
    spark.createDataFrame([(d, i, -i) for i, d in enumerate(digests)] + [(digests[3], 100, 5)], "h binary, a long, b long").createOrReplaceTempView("t")
    suffix_dedup.write_table(spark.table("t"), str(tmp_path), 7)
    asked = [*digests, b"none" * 4]
    got = suffix_dedup.table_rows(str(tmp_path), 7, {}, suffix_dedup._halves(pa.array(asked)), 2)
    assert {i: x.tolist() for i, x in got.items()} == {i: [[3, 100], [-3, 5]] if i == 3 else [[i], [-i]] for i in range(41)}


def test_covers():
    for r in range(4):
        v, d = suffix_dedup.wide_cover(r)
        assert len({(a - b) % v for a in d for b in d}) == v


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, order):
    data = rows(docs)
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    want, total = brute.kneser_ney([t for i, t in data if fold(i)], data, order)
    store = ngram_lm.fit(docs.where(ngram_lm.fold() != 0), order)
    got = ngram_lm.score_texts(docs, store).collect()
    assert {r.train_tokens for r in got} == {total}
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got), key=key), sorted(((i, n, k, round(b, 6), round(s, 6)) for i, n, k, b, s in want), key=key)):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-5)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, order):
    d = spark.createDataFrame([(1, "a b a c a b b"), (2, "c a b"), (3, "a a d"), (4, "a a b")], "doc_id long, text string")
    model = ngram_lm.Store(ngram_lm.fit(d, order))
    import pyarrow as pa

    for start in ("b", "a a", "a b", "zz a", "d d"):
        data, off = textscan.utf8(pa.array([*(f"{start} {w}" for w in ("a", "b", "c", "d")), start, f"{start} zz"]))
        codes, at = ngram_lm.tokens(data, off)
        n, total = len(start.split()), 0.0
        for r in range(6):  # the next token: a, b, c, d, end, unknown
            two = codes[at[r] : at[r] + n + 1]
            total += 10 ** (model.score(two, np.array([0, n + 1]))[2][0] - model.score(two[:n], np.array([0, n]))[2][0])
        assert total == pytest.approx(1), start


def test_language_model_of_hot_words_and_long_texts(spark):
    """Words that are hot in their bucket go two ways; counts beyond two bytes stand apart."""
    rng = random.Random(4)
    letters = [f"w{int(rng.expovariate(0.2))}" for _ in range(5000)]
    data = [(i, " ".join(letters[i * 500 : i * 500 + 500])) for i in range(8)] + [(8, "x y " * 70_000), (9, " ".join(letters)), (20, None)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    want, total = brute.kneser_ney([t for i, t in data if zlib.crc32(str(i).encode()) % 10], data)
    store = ngram_lm.fit(frame.where(ngram_lm.fold() != 0))
    assert len(ngram_lm.Store(store).hot) > 2
    got = ngram_lm.score_texts(frame, store).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(i, n, k, total) for i, n, k, _, _ in want]
    assert [r.score for r in got] == pytest.approx([w[4] for w in want], rel=1e-9) and [r.base_score for r in got] == pytest.approx([w[3] for w in want], rel=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), max_size=30), st.sampled_from([0, 1 << 33]))
def test_pairs_of_a_bucket(pairs, more):
    from collections import Counter

    v, w = (np.array([p[i] + more * (p[i] > 1) for p in pairs], np.int64) for i in (0, 1))
    v, w, a = ngram_lm._distinct_pairs(v, w, np.array([0]), np.array([5]), np.array([7]))
    want = Counter((x + more * (x > 1), y + more * (y > 1)) for x, y in pairs)
    assert [*zip(v.tolist(), w.tolist(), a.tolist())] == [(0, 5, 7), *((x, y, want[x, y]) for x, y in sorted(want))]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_pieces_keep_their_contexts(size):
    import pyarrow as pa

    texts = ["a b c d e f g h i j k", "", None, "x", "a b " * 30]
    got = list(ngram_lm._pieces(iter([pa.record_batch([pa.array(texts)], names=["text"])] * 2), 3, size))
    assert max(len(w) for _, _, w in got) <= size
    want = next(ngram_lm._pieces(iter([pa.record_batch([pa.array(texts * 2)], names=["text"])]), 3))
    assert all(np.concatenate(x).tolist() == y.tolist() for x, y in zip(zip(*got), want))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 1 << 39)] * 3, st.integers(1, 1 << 39)) | st.tuples(*[st.integers(0, 3)] * 3, st.integers(1, 3)), min_size=1, max_size=40))
def test_blocks_of_triples(rows):
    v, u, w, n = ngram_lm.sorted_triples([np.array(x, np.int64) for x in zip(*rows)])
    want = {}
    for a, b, c, k in rows:
        want[a, b, c] = want.get((a, b, c), 0) + k
    assert [*zip(v.tolist(), u.tolist(), w.tolist(), n.tolist())] == [(*t, want[t]) for t in sorted(want)]
    if max(want.values()) >> 40 == 0:
        role, cols = ngram_lm.decode(ngram_lm.encode(2, v, u, w, n), len(v))
        assert role == 2 and all(x.tolist() == y.tolist() for x, y in zip(cols, (v, u, w, n)))


def test_empty_tables(spark, empty):
    tests = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.line_dedup(empty).collect() == []
    assert ngram_jaccard.ngram_jaccard(empty).collect() == []
    assert suffix_dedup.suffix_dedup(empty).collect() == []
    assert decontaminate.decontaminate(empty, tests).collect() == []
    store = ngram_lm.fit(empty)
    assert ngram_lm.score_texts(empty, store).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = ngram_lm.score_texts(one, store).first()
    assert (r.n_tokens, r.n_known, r.score) == (3, 0, 0.0)
    assert decontaminate.decontaminate(one, tests).first().n_hit == 0


@given(st.lists(st.text(alphabet="aB é\n\t.1日", max_size=30), max_size=6))
@settings(max_examples=50, deadline=None)
def test_words_of_slices(texts):
    import pyarrow as pa

    data, off = textscan.utf8(pa.array(texts, pa.string()))
    for inside, words in ((textscan.NOT_SPACE, brute.space_words), (textscan.ALNUM, brute.alnum_words)):
        got = []
        for _, _, part, part_off in textscan.slices(data, off, 16):
            part = textscan.LOWER[part]
            a, z, row = textscan.words(part, part_off, inside)
            got += [[part[i:j].tobytes().decode() for i, j in zip(a[p:q], z[p:q])] for p, q in zip(row, row[1:])]
        assert got == [words(t) for t in texts]


def test_line_hashes_are_independent(spark):
    """The second 64 bits are no function of the first: among texts they differ from a hash of the first ones."""
    d = spark.range(200).selectExpr("cast(id as string) as t").select(line_dedup._hash(F.col("t")).alias("h"), F.xxhash64("t", F.lit(1)).alias("chained"))
    assert d.where("h.b = chained").count() == 0 and d.select("h.b").distinct().count() == 200


def test_line_dedup_of_a_document_with_many_frequent_lines(spark):
    many = "\n".join(f"line {i}" for i in range(3000))
    data = [(i, many + f"\nown {i}\nline 5") for i in range(10)] + [(3, "line 1\nother"), (None, "line 2\n\n"), (None, "line 2\n\n")]
    got = line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = brute.lines([("-" if i is None else i, t) for i, t in data])
    same([("-" if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got], want)
