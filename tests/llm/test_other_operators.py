"""Token counts, media columns, personal data, toxicity, mixing and the pipeline."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.llm import components, media_ts, mixing, pii, queries, token_counts, toxicity
from tests.llm import brute

HARD = ["", "hello world", "  a   b\n\n c\t\td  ", "I'll we've they're don't 'l x're", "a<|endoftext|>b !<|endoftext|> c", "日本語 テスト 🎉🎉 naïve  x", "x" * 300, " " * 200 + "y", "12345 ٣٤٥ ½ Ⅷ", "--- !!! ...\r\n\r\nfoo", "ÃÂ" * 30, "'' 's'll", "a \x00\x1c b"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_every_prefix(library):
    table = token_counts.PrefixTable(queries.tokenizer_path())
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab eE'\n\t  lsrtvemd12.,<|>endoftx é日ß") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for t in texts:
        store = table.store(t)
        assert len(store) == len(t)
        for i in range(len(t) + 1) if len(t) < 60 else (30, len(t)):
            assert token_counts.tokens_at(store, i) == len(library.encode(t[:i], add_special_tokens=False).ids), (t, i)


def test_tokens_that_stay_apart():
    table = token_counts.PrefixTable(queries.tokenizer_path())
    rng = random.Random(4)
    ids = [t for t in table.ids if len(t) < 12]
    short = [t for t in ids if len(t) < 4]
    seen = Counter()
    for _ in range(30_000):
        a, b = rng.choice(short if rng.random() < 0.7 else ids), rng.choice(short if rng.random() < 0.7 else ids)
        whole = a + b
        want = table.merged([whole[i : i + 1] for i in range(len(whole))]) == [a, b]
        assert table.stays(a, b) == want, (a, b)
        seen[want] += 1
    for a, b in [(b"a", b"a"), (b"aa", b"a"), (b"a", b"aa"), (b"aa", b"aa"), (b"  ", b" "), (b" ", b"  "), (b"--", b"-"), (b"-", b"--")]:
        if a in table.ids and b in table.ids:
            whole = a + b
            assert table.stays(a, b) == (table.merged([whole[i : i + 1] for i in range(len(whole))]) == [a, b])
    assert min(seen.values()) > 1000


def test_token_counts(spark, docs, empty, library):
    got = token_counts.token_prefix_counts(docs, queries.tokenizer_path()).collect()
    text = {r.doc_id: r.text for r in docs.where("doc_id <> 5").collect()}
    for r in got:
        if r.doc_id in text:
            t = text[r.doc_id] or ""
            assert (r.n_bytes, r.n_chars, r.n_tokens) == (len(t.encode()), len(t), len(library.encode(t, add_special_tokens=False).ids))
            cut = token_counts.cut_for_budget(bytes(r.prefix_store), 12)
            assert len(library.encode(t[:cut], add_special_tokens=False).ids) <= 12
    assert len(got) == docs.count()
    assert token_counts.token_prefix_counts(empty, queries.tokenizer_path()).collect() == []


@pytest.mark.parametrize("n", [1, 3, 510, 511, 512, 1023, 1024 * 9])
def test_transport_stream_round_trip(n):
    payload = random.Random(n).randbytes(64 * n)
    media = media_ts.pack(payload).tobytes()
    s = media_ts.unpack(media)
    assert s.payload == payload and s.continuity_errors == 0 and len(media) % 188 == 0
    assert s.timestamps == sorted(s.timestamps) and len(s.timestamps) == -(-len(payload) // media_ts.UNIT)
    assert s.access_points == [p for p in range(0, len(payload), media_ts.UNIT * media_ts.ACCESS)]


def test_damaged_streams():
    media = media_ts.pack(bytes(40_000))
    assert media_ts.unpack(np.delete(media, 10, 0)).continuity_errors == 1
    torn = media.copy()
    torn[0, 9] ^= 1
    with pytest.raises(ValueError):
        media_ts.unpack(torn)
    with pytest.raises(ValueError):
        media_ts.unpack(media.tobytes()[:-1])
    lost = media.copy()
    lost[3, 0] = 0
    with pytest.raises(ValueError):
        media_ts.unpack(lost)


def test_transport_columns(docs, empty):
    got = media_ts.transport_columns(docs).collect()
    text = {r.doc_id: r.text for r in docs.where("doc_id <> 5").collect()}
    for r in got:
        assert media_ts.unpack(bytes(r.media)).payload[r.n_bytes :] == bytes(r.payload_bytes - r.n_bytes)
        if r.doc_id in text:
            want = media_ts.padded((text[r.doc_id] or "").encode())
            assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (brute.sha(want), zlib.crc32(want[-64:]), len(want))
    assert media_ts.transport_columns(empty).collect() == []


def test_streams_kept_in_a_table(spark, docs, tmp_path):
    """What is written to disk is read back, texts over 1 MiB too."""
    long = spark.createDataFrame([(1, "long text é " * 120_000), (2, None)], "doc_id long, text string")
    media_ts.store_streams(long).write.parquet(f"{tmp_path}/streams")
    got = {r.doc_id: r for r in media_ts.read_streams(spark.read.parquet(f"{tmp_path}/streams")).collect()}
    want = media_ts.padded(("long text é " * 120_000).encode())
    assert got[1].payload_sha256 == brute.sha(want) and got[1].media_bytes == len(got[1].media) and got[2].payload_bytes == 64


def plain_spans(text):
    """The base spans by definition: leftmost matches of each pattern, those that fail dropped."""
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    t = "é a.b+c@x-y.co.uk, 1.2.3.4 256.1.1.1; 4539 1488 0343 6467; +1 (269) 555-3296 +12 3"
    assert [(k, t[a:z]) for k, a, z in pii.base_spans(t)] == [("email", "a.b+c@x-y.co.uk"), ("ip", "1.2.3.4"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (269) 555-3296")]
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    zeros = "0" * 60 + "1.2.3.4"
    assert pii.base_spans(zeros) == plain_spans(zeros) == [("ip", 0, 67)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"a.-@+1 0(é\n_%", "1.2", "a@b", ".c", "255", "256", "4539148803436467", "+1 (269) 555-3296", "x@y.z", "0.0.0.0"]), max_size=25))
def test_base_spans_by_definition(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert pii.base_spans(r.text or "") == plain_spans(r.text or "")


def test_base_spans_of_long_runs():
    """Work grows with the text alone."""
    n = 1_000_000
    for text, want in (("a" * n + " x@y.zz", 1), ("1" * n + ". @", 0), ("a@" * (n // 2), 0), ("1." * (n // 2) + "@", n // 8), ("+1" + "(" * n + "@.", 0), ("a" * n + "@b.cc", 1)):
        begin = time.process_time()
        assert len(pii.base_spans(text)) == want
        assert time.process_time() - begin < 5


def test_added_spans_touch_no_other():
    base = [("email", 10, 20), ("ip", 15, 40), ("card", 50, 66)]
    text = "1234567890" * 20
    added = [("secret", 0, 10), ("secret", 2, 10), ("secret", 35, 44), ("secret", 40, 50), ("secret", 66, 80), ("phone", 70, 90), ("secret", 80, 90), ("secret", 100, 104)]
    assert [s for s in pii.all_spans(base, added, text) if s not in base] == [("secret", 0, 10), ("secret", 40, 50), ("secret", 66, 80), ("secret", 80, 90)]


@pytest.fixture(scope="module")
def field():
    return pii.train_field(pii.small_labelled_table())


def test_random_field_learns_its_rows():
    """Trained on few rows, the field finds what they mark."""
    again = pii.train_field(pii.small_labelled_table(30), rounds=40)
    table = pii.small_labelled_table(30)
    assert sum(set(a) >= set(b) for a, (_, b) in zip(pii.field_spans(again, [t for t, _ in table]), table)) >= 28


def test_fitted_field_is_kept(spark):
    table = pii.small_labelled_table(20, 1)
    one, two = pii.fitted(spark, table), pii.fitted(spark, table)
    here = pii.train_field(table)
    for a, b, c in zip(*((f.emit, f.move, f.first) for f in (one, two, here))):
        assert (a == b).all() and a == pytest.approx(c, abs=1e-6)


def test_random_field_on_unseen_rows(field):
    table = pii.small_labelled_table(200, 99)
    got = pii.field_spans(field, [t for t, _ in table])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(got, table))
    assert right / sum(map(len, got)) > 0.85 and right / sum(len(b) for _, b in table) > 0.85


def test_viterbi_is_the_best_path(field):
    from itertools import product

    tokens, starts, ends = pii.tokenize("call 269-555 x")
    gaps = [i == 0 or ends[i - 1] < starts[i] for i in range(len(tokens))]
    f = pii.features(tokens, gaps)
    emit = np.array([field.emit[c].sum(0) for c in f])
    move, first = field.move + pii._BAD, field.first + pii._NO_START
    score = lambda p: first[p[0]] + emit[0, p[0]] + sum(move[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
    best = max(product(range(len(pii.TAGS)), repeat=len(tokens)), key=score)
    short = pii.viterbi(field, [f, f[:2]])
    assert short[0].tolist() == list(best) and len(short[1]) == 2


def test_find_pii(spark, empty):
    rows = [(1, "x\npassword=e1c093f22d3955eaac mail bob.1@mail3.example.com"), (2, None), (3, "Licensed under CC BY-NC 4.0."), (None, "call 269-555-3296 now"), (1, "")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = [[(s.kind, t[s.start : s.stop]) for s in r.spans] for r, (_, t) in zip(got, rows)]
    assert spans == [[("email", "bob.1@mail3.example.com"), ("secret", "e1c093f22d3955eaac")], [], [], [("phone", "269-555-3296")], []]
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    assert pii.find_pii(empty).collect() == []


WITHOUT_DIGITS = [
    ("write to jane at example dot org today", "email", "jane at example dot org"), ("bob [at] example [dot] com", "email", "bob [at] example [dot] com"), ("bob [at] mail3 [dot] com", "email", "bob [at] mail3 [dot] com"),
    ("mail jane.doe [at] mail3 [dot] com now", "email", "jane.doe [at] mail3 [dot] com"), ("password=correcthorsebattery", "secret", "correcthorsebattery"), ('token = "abcdefghijkl"', "secret", "abcdefghijkl"),
]


def test_spans_far_from_any_digit(spark, field):
    texts = [f"First line.\n{t}\nlook at the dot on the map and call me at noon" for t, _, _ in WITHOUT_DIGITS]
    want = [[(k, w)] for _, k, w in WITHOUT_DIGITS]
    assert [[(k, t[a:z]) for k, a, z in f] for t, f in zip(texts, pii.field_spans(field, texts))] == want
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[(s.kind, texts[r.doc_id][s.start : s.stop]) for s in r.spans] for r in sorted(got, key=lambda r: r.doc_id)] == want


def decoded_plainly(field, text):
    """Spans of the field by the features and Viterbi of each whole line."""
    out, at = [], 0
    for line in text.split("\n"):
        tokens, starts, ends = pii.tokenize(line)
        tags = pii.viterbi(field, [pii.features(tokens, [i == 0 or ends[i - 1] < starts[i] for i in range(len(tokens))])])[0].tolist()
        for i, t in enumerate(tags):
            if pii.TAGS[t][0] == "B":
                z = i + 1
                while z < len(tags) and tags[z] == t + 1:
                    z += 1
                out.append((pii.TAGS[t][2:], at + starts[i], at + ends[z - 1]))
        at += len(line) + 1
    return out


def test_decoding_is_that_of_whole_lines(field):
    rng = random.Random(5)
    parts = [*"aB é\n\t.1日_@-x²ǅK=[]", "at", "dot", "com", "password", "token", "12", "ab", "   ", "Key", "AKIA", "Þ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [t for t, _ in pii.small_labelled_table(60, 5)] + ["", "\n"]
    assert pii.field_spans(field, texts) == [decoded_plainly(field, t) for t in texts]


def test_secrets_in_a_long_line_of_codes(field):
    rng = random.Random(8)
    text, want = "", []
    for _ in range(200):
        text += f'{rng.randint(1000, 9999)} token = "'
        want.append(("secret", len(text), len(text) + 40))
        text += "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" '
    got = pii.field_spans(field, [text])[0]
    assert got == decoded_plainly(field, text)
    assert [s for s in got if s not in want and any(s[1] < z and a < s[2] for _, a, z in want)] == [] and len(set(got) & set(want)) == len(want)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    bad = ["grobnix", "vilesnark", "mudwretch"]
    rows, labels = [], []
    for i in range(700):
        w = " ".join(rng.choice(["the", "onle", "winda", "tion", "merat", "suvi", "fenna"]) + rng.choice(["", "er", "la", "tion"]) for _ in range(rng.randint(20, 80))).split()
        y = i % 5 == 0
        if y:
            for _ in range(1 + len(w) // 20):
                x = list(rng.choice(bad))
                if i % 3 == 0:
                    x[rng.randrange(2, 5)] = "x"
                w.insert(rng.randrange(len(w)), "".join(x))
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 0, int(y)))
    rows += [(9000, None, "en", "a", 0), (9001, "", "en", "a", 0), (None, "winda", "en", "a", 0)]
    labels += [(None, 0, 1), (9000, 0, None), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_the_held_out_fold(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    assert [r.score for r in toxicity.toxicity(docs, labels).orderBy("doc_id").collect()] == [r.score for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id))]


def test_toxicity_passes_columns_with_clashing_names(labelled):
    docs, labels = labelled
    out = toxicity.toxicity(docs.withColumn("score", F.lit("x")).withColumn("__text", F.lit("y")), labels, passed=True)
    assert out.where("score < 0.5").select("score", "__text", "lang").dtypes[0] == ("score", "double")
    assert out.where("score >= 0.5").count() > 50


def test_odds_fitted_last():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.1).astype(int)
    odds = rng.normal(0, 2, 4000) + 30 * y - 90  # far below 0, as with few toxic rows
    slope, shift = toxicity.scaled(odds, y)
    assert ((slope * odds + shift > 0) == (y == 1)).mean() > 0.99 and slope > 0
    assert toxicity.scaled(odds, np.zeros(4000, int)) == (1.0, 0.0)


def test_bags_by_definition():
    import pyarrow as pa
    import re

    texts = ["Ab cd, é", "", "x", "hello World"]
    data, off = toxicity.utf8(pa.array(texts))
    ids, ends = toxicity.bag(data, off)
    for i, t in enumerate(texts):
        words = [b" " + brute.low(w).encode() + b" " for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
        assert ends[i + 1] - ends[i] == sum(sum(max(0, len(w) - n + 1) for n in toxicity.SIZES) + 1 for w in words)
    one, _ = toxicity.bag(*toxicity.utf8(pa.array(["hello World"])))
    assert sorted(ids[ends[3] : ends[4]]) == sorted(one)
    weights = np.arange(1 << toxicity.BITS, dtype=np.float32) / (1 << toxicity.BITS)
    z = np.array([weights[ids[a:b]].mean() if b > a else 0.0 for a, b in zip(ends, ends[1:])])
    assert toxicity.score(weights, 0.25, data, off) == pytest.approx(1 / (1 + np.exp(-z - 0.25)), abs=1e-5)


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 3) for r in toxicity.toxicity(docs, none).collect()} == {0.05}
    assert toxicity.toxicity(empty, none).collect() == []


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water-filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: each * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.row.source] += r["size"]
        assert r["size"] == len(brute.space_words(r.row.text))
    want, taken = fill(sizes), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.row.source]) and r.source_size == sizes[r.row.source]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.row.source] += r.taken
    largest = {s: max(r["size"] for r in got if r.row.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = {(r.row.doc_id, r.row.text): r.taken for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert len(got) == docs.count() and all(again[r.row.doc_id, r.row.text] == r.taken for r in got)
    assert mixing.mix_sources(empty).collect() == []


def test_mixing_takes_the_same_rows_again(spark):
    """Ties: equal and null ids with equal sizes and other texts; slots are made finer where they have many rows."""
    rng = random.Random(6)
    data = [(None if i % 3 == 0 else i % 7, " ".join(rng.choice("abcd") for _ in range(5)), "en", "abc"[i % 3], i) for i in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    took = lambda frame, **more: sorted((repr(r.row), r.copies) for r in mixing.mix_sources(frame, **more).collect())
    first = took(d)
    assert took(d.repartition(5).orderBy("n_chars")) == took(d.orderBy(F.desc("n_chars"))) == first
    assert took(d, slot_rows=5) == first


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(group[a], group[b])
            if (group[a], group[b]) != (m, m):
                group[a] = group[b] = m
                changed = True
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {a for a, b in edges if a == b}
    assert {k: v for k, v in group.items() if k in got} == got and set(group) - set(got) <= alone


def test_pipeline(spark, labelled, docs, tmp_path):
    """Each stage against plain Python on its own input."""
    import corpus_pipeline as cp

    base, labels = labelled
    w = docs.where("doc_id = 12").first().text.split()
    base.unionByName(docs.select(*base.columns).withColumn("doc_id", F.col("doc_id") + 2000)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(w[2:14])), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        before = d.collect()
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        after = d.collect()
        rows = [(r.doc_id, r.text) for r in before]
        assert name == "mixing" or d.columns == cp.COLUMNS
        if name == "toxicity":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert 100 < len(gone) < 180 and sum(i is not None and i < 700 and i % 5 == 0 for i in gone) >= 0.95 * len(gone)
        elif name == "line_dedup":
            assert sorted((str(r.doc_id), r.text) for r in after) == sorted((str(i), t) for i, _, _, t in brute.lines([("-" if i is None else i, t) for i, t in rows]) for i in [None if i == "-" else i])
        elif name == "near_duplicates":
            stay = {i for i, _, c in brute.jaccard(rows) if i is None or i == c} - {i for i, _, c in brute.jaccard(rows) if i is not None and i != c}
            assert {r.doc_id for r in after} == stay and len(after) == len({(r.doc_id, r.text) for r in after})
        elif name == "decontamination":
            clean = [i for i, _, n, _ in brute.contamination(rows, [(1, " ".join(w[2:14]))]) if not n]
            assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in after) and len(after) < len(before)
        else:
            sizes = defaultdict(int)
            for r in before:
                sizes[r.source] += len(brute.space_words(r.text))
            taken = Counter()
            for r in after:
                taken[r.source] += r["size"]
            want = fill(sizes)
            assert all(abs(taken[s] - want[s]) <= max(len(brute.space_words(r.text)) for r in before if r.source == s) for s in sizes)
            assert max(r.repetition for r in after) <= 2
    assert cp.run(spark, str(tmp_path)).count() == len(after)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PrefixTable(str(tmp_path / "t.json"))
    spec["model"]["ignore_merges"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="ignore_merges"):
        token_counts.PrefixTable(str(tmp_path / "t.json"))
