"""Phrases, the audit of filters and packing, against plain counting."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import collocations, filter_audit, packing, queries

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Phrases


def plain_phrases(rows, least, top=2000, keep=80):
    totals, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for n in range(1, 5):
                for i in range(len(ws) - n + 1):
                    f[lang][tuple(ws[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        counts = {p: a for p, a in counts.items() if a >= least}
        longer = Counter()
        for p, a in counts.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and not 100 * longer[p] >= keep * a:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(5)
    words = ["new", "york", "city", "Hall", "of", "records", "é", "日本", "a", "b"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", ";"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows += [("new york city hall", "en")] * 40 + [("x x x x x x x x", "de")] * 4 + [(None, "en"), ("", None), (" \t.\n,,", "fr")]
    rows.append(("york\tnew  york " * 160_000 + "end of. records", "en"))  # over 2 MiB, without a separator for long
    rows.append(("hall of records. " * 90_000, None))
    return rows


def test_phrases(spark, phrase_rows):
    df = spark.createDataFrame(phrase_rows, "text string, lang string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    for least, shard, top in ((5, 1000, 2000), (30, 1 << 22, 3)):
        got = collocations.collocations(df, min_count=least, shard=shard, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(phrase_rows, least, top)


def test_phrases_of_nothing(spark, empty):
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).collect() == []


@pytest.mark.parametrize("depth", [2, 4])
def test_intervals(depth):
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 4, 3000)
    counted = 2500
    got = {}
    for d, at, n in collocations.intervals(seq, collocations.suffix_order(seq, depth), depth, counted):
        for i, c in zip(at.tolist(), n.tolist()):
            assert tuple(seq[i : i + d]) not in got
            got[tuple(seq[i : i + d])] = c
    want = Counter(tuple(seq[i : i + d]) for d in range(2, depth + 1) for i in range(counted) if i + d <= len(seq) and all(seq[i : i + d]))
    assert got == want


def test_chunks_are_whole():
    texts = ["a b. c " * 50, "", "x" * 400, "one two", ",. " * 100, "ab " * 99 + "."]
    off = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    langs = np.zeros(len(texts), np.uint64)
    for limit in (8, 64, 1000):
        codes, begins = [], []
        for part, ends, a, joined, _ in collocations.chunks(data, off, limit):
            code, _, _, _, begin = collocations.word_codes(part, ends, langs[: len(ends) - 1], joined)
            codes += code.tolist()
            begins += begin.tolist()
        code, _, _, _, begin = collocations.word_codes(data, off, langs)
        assert codes == code.tolist() and begins == begin.tolist()


# Audit of filters


def plain_audit(docs, labels):
    good, toxic, least = defaultdict(bool), defaultdict(bool), {}
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out, fair = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                here = [(m, g, t) for m, g, t in rows if f in m and not m & before]
                fair[part, f] += len(here)
                out[part, "".join(order), s + 1] = [sum(not m & (before | {f}) for m, _, _ in rows), len(here), sum(f in m and bool(m & before) for m, _, _ in rows), sum(m == {f} for m, _, _ in rows), sum(g for _, g, _ in here), sum(t for _, _, t in here)]
    return {(p, o, s): (*v, fair[p, o[s - 1]]) for (p, o, s), v in out.items()}


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "Bb", "c#", "DD", "é", "zz" + str(rng.randint(0, 99))]) for _ in range(rng.choice([3, 49, 50, 80]))) for _ in range(60)]
    docs = [(rng.randint(1, 150), rng.choice([*texts, None, "", texts[0], texts[0]]), rng.choice(["s1", "s2", "", None])) for _ in range(250)]
    docs += [(None, texts[0], "s1"), (None, None, "only null ids"), (7, texts[1], "s1"), (7, texts[1], "s2"), (9, "A\nb\tc\x0bd " * 200_000, "long")]
    labels = [(rng.randint(1, 150), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(120)] + [(None, 1, 1)]
    return docs, labels


def test_audit(spark, audit_rows):
    docs, labels = audit_rows
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("good", F.lit(3)).withColumn("mask", F.lit("x")).repartition(3)
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in filter_audit.audit(d, la).collect()}
    assert got == plain_audit(docs, labels)


def test_audit_with_sql_and_names(spark, audit_rows):
    docs = [r for r in audit_rows[0] if len(r[1] or "") < 10_000]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    la = spark.createDataFrame(audit_rows[1], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("labels", la.toArrow())
    cols = ["part", "filter_order", "step", *AUDIT]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({filter_audit.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in filter_audit.audit(d, la).select(*cols).collect()) == want
    text = lambda df: df.withColumn("doc_id", F.format_string("k%05d", "doc_id"))
    assert sorted(tuple(r) for r in filter_audit.audit(text(d.where("doc_id is not null")), text(la.where("doc_id is not null"))).select(*cols).collect()) == sorted(
        tuple(r) for r in filter_audit.audit(d.where("doc_id is not null"), la).select(*cols).collect()
    )


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).collect() == []


def test_transform_is_inverted(spark):
    counts = [random.Random(2).randint(0, 10**12) for _ in range(32)]
    sums = [sum(c * (1 - 2 * (bin(m & s).count("1") % 2)) for m, c in enumerate(counts)) for s in range(32)]
    assert spark.createDataFrame([(sums,)], "s array<long>").select(filter_audit.cells(F.col("s")).alias("c")).first().c == counts


# Packing


@pytest.fixture(scope="module")
def words_library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_ids_are_the_librarys(words_library):
    rng = random.Random(3)
    hard = ["it's", "'store", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "a", "É", "é", "́", "ß", "×", "÷", "1", "23", "½", "...", "-", " ", "\xa0", "　", "\x85", "\x1c", "\x00", "漢字", "İ", "Σας", "ΟΔΟΣ", "\n", "\t", "The", "naïve", "Ã", "ÿ", "Ÿ", "_", "ﬁ", "가", "가", "🙂", "ª", "µ"]
    texts = ["".join(rng.choice(hard) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "word " * 300_000, "y" * 5000]
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    own = packing.Ids(queries.tokenizer_path("word_bpe_49k.json"))
    assert own.split
    for _ in range(2):  # the second time from the cache
        ids, at = own(np.frombuffer("".join(texts).encode(), np.uint8), off)
        for i, e in enumerate(words_library.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i][:80]
    other = packing.Ids(queries.tokenizer_path())
    assert not other.split and other(np.frombuffer(b"Hello world", np.uint8), np.array([0, 5, 11]))[1].tolist()[-1] > 1


def check_pieces(rows, ids, window):
    """Each id in exactly one piece, sequences without gaps, padding nowhere."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc"]].append(r)
        seqs[r["seq"]].append(r)
    assert docs.keys() == ids.keys()
    for doc, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["total"] == len(ids[doc])
            assert r["crc"] == zlib.crc32(np.array(ids[doc][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
    return seqs


def test_packing(spark, docs, words_library):
    docs = docs.where("doc_id is not null and doc_id <> 5").withColumn("start", F.lit("x"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {k: words_library.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}
    for window, most in ((4096, 2048), (64, 3)):
        out = packing.pack_documents(docs.repartition(3, "doc_id"), queries.tokenizer_path("word_bpe_49k.json"), window=window, max_open=most)
        rows = [{"doc": r.doc_id, "start": r.start, "length": r.length, "crc": r.ids_crc32, "total": r.doc_tokens, "seq": r.sequence_id, "offset": r.offset} for r in out.collect()]
        check_pieces(rows, ids, window)
        whole = {r.sequence_id: r for r in packing.sequences(out).collect()}
        for r in out.collect():
            assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


def test_packing_of_strange_rows(spark, docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert packing.pack_documents(empty, path).collect() == []
    out = packing.pack_documents(spark.createDataFrame([("a", None), ("a", ""), (None, "b " * 1_200_000), ("c", "b")], "doc_id string, text string").coalesce(1), path)
    got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert {(r.doc_id, r.n) for r in got} == {("a", 2), (None, 1_200_001), ("c", 2)}
    assert out.agg(F.max("doc_tokens")).first()[0] == 1_200_001
    with pytest.raises(ValueError):
        packing.pack_documents(empty, path, window=100)


def test_places_minimise_the_squares():
    rng = random.Random(1)
    w = 32
    packer, levels = packing.Packer(w, 10**6), Counter()
    for i in range(2000):
        size = rng.randint(1, w - 1)
        before = dict(levels)

        def squares(level):
            after = Counter(before)
            after[level] -= level > 0
            after[level + size] += level + size < w
            return sum(v * v for v in after.values())

        best = min(squares(g) for g in [0, *[g for g, n in before.items() if n and g + size <= w]])
        packer.add(i, np.zeros(size, np.uint32))
        levels = Counter({g: int(n) for g, n in enumerate(packer.levels) if n})
        assert sum(v * v for v in levels.values()) == best
        assert levels == Counter({g: len(s) for g, s in packer.open.items() if s}) and sum(levels.values()) == packer.n_open
    done = len(packer.done)
    assert done > 800 and packer.n_open < 200  # few of some 1000 stay open
    packer.drain(last=True)
    assert packer.n_open == 0 and sum(len(p[2]) for s in packer.done[done:] for p in s) == sum(g * n for g, n in levels.items())
