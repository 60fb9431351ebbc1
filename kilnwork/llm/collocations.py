"""Phrases of two to four words that come together more often than their parts, from suffix arrays over word numbers.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks; everything is counted per language.

1. Words. Tasks sum the words of their texts; sums by (language, word) are merged. Words seen ``min_count`` times get numbers, and a
   sorted array from 64-bit hashes to numbers, in files that workers map into memory.
2. Pairs. A shard is a sequence of word numbers, 0 where a piece ends or a word is too rare. Its suffixes are sorted by prefix doubling
   (ranks of one word, then of two), neighbours' common prefixes are measured, and each interval of common prefixes of two words or more is a
   pair with its count. Pairs are two 32-bit numbers, so keys are exact; blocks of sorted keys go to buckets, where counts are added.
3. Threes and fours, likewise with one more doubling, where sequences also break between words that are no frequent pair: all parts of a
   phrase are at least as frequent as the phrase, so no phrase that reaches ``min_count`` is lost. What a shard sends are its distinct
   n-grams, so one that fills a third of a corpus is a row of each shard.
4. In DataFrames: candidates inside a longer one that is nearly as frequent go; the others are scored by their worst cut, in exact decimals;
   each language's first ``top`` are found in two steps, of which the second orders at most ``SALT`` * ``top`` rows.

A worker holds one shard (``SHARD`` words, some 100 bytes each) and its batch; a reducer one bucket of about 24 MB of the input. A very long text is
cut into words part by part; its numbers (8 bytes a word) are one sequence. A rare word that shares its 64-bit hash with a frequent one would be taken
for it, with a chance of 2 ** -64 for each two; two frequent ones that do are an error.

Defined cases: a null text is empty, a null language is ``und``. Repeated rows count each; ids and other columns are not read. Without
candidates, or without rows, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.llm.blocks import BLOCK_SCHEMA, arrow_batches, block_batch, buckets_for, by_bucket, exchange, gather, mounted, pack, saved, shared_dir
from kilnwork.llm.ngram_lm import _Files, _write_file
from kilnwork.llm.textscan import LOWER, U64, distinct, mix, ragged, span_hash, utf8

MOST_WORDS = 4
#: Words of a shard; bytes of text that are cut into words at once; words of a file of numbers; distinct words that a task holds before it sends them.
SHARD, CHUNK, FILE_WORDS, HELD = 1 << 20, 1 << 20, 1 << 20, 1 << 19
#: Parts of a language in the first step of its order.
SALT = 256
UNKNOWN = "und"
_STEP = U64(0x9E3779B97F4A7C15)
#: 0 blanks, 1 ends of pieces, 2 all else.
KIND = np.full(256, 2, np.uint8)
KIND[[0x20, 0x09]] = 0
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 1


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool, bool]]:
    """Bytes, offsets of rows, the number of the first row, and whether it goes on from the chunk before and into the next: whole rows of about ``limit`` bytes, or parts of a long one, cut where a word ends."""
    a, n = 0, len(off) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        at, end = int(off[a]), int(off[z])
        if end - at <= limit:
            yield data[at:end], off[a : z + 1] - off[a], a, False, False
        else:
            while at < end:
                stop = end
                for near in (at + limit, end) if end - at > limit else ():
                    inside = KIND[data[at + limit // 2 : near]] == 2
                    cuts = np.flatnonzero(inside[:-1] & ~inside[1:])
                    if len(cuts):
                        stop = at + limit // 2 + int(cuts[-1 if near < end else 0]) + 1
                        break
                yield data[at:stop], np.array([0, stop - at]), a, at > off[a], stop < end
                at = stop
        a = z


def word_codes(data: np.ndarray, off: np.ndarray, lang: np.ndarray, joined: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of (language, word), starts, ends, rows, and which words begin a piece. ``lang`` has a hash for each row; ``joined`` bytes follow a word."""
    kind = KIND[data]
    inside = kind == 2
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    row = np.searchsorted(off, starts, "right") - 1
    seps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 1, out=seps[1:])
    begins = np.ones(len(starts), bool)
    begins[1:] = (seps[starts[1:]] != seps[starts[:-1]]) | (row[1:] != row[:-1])
    begins[:1] &= (not joined) | (seps[starts[:1]] > 0)
    return mix(span_hash(LOWER[data], starts, ends) * _STEP + lang[row]), starts, ends, row, begins


def lang_hashes(column: pa.Array) -> np.ndarray:
    data, off = utf8(column)
    return mix(span_hash(data, off[:-1], off[1:]) + U64(1))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    length = ends - starts
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=off[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, length)]).tobytes()))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> lang, word, n, and for each language all its words as word null."""
    held: list[tuple] = []
    size, totals = 0, {}

    def send() -> pa.RecordBatch:
        key = np.concatenate([h[0] for h in held])
        order = np.argsort(key, kind="stable")
        first, _ = distinct(key[order])
        n = np.add.reduceat(np.concatenate([h[1] for h in held])[order], first)
        lang, word = (pa.concat_arrays([h[i] for h in held]).take(pa.array(order[first])) for i in (2, 3))
        return pa.record_batch([lang.cast(pa.string()), word.cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    for batch in batches:
        data, off = utf8(batch.column(0))
        langs = batch.column(1)
        hashes, coded = lang_hashes(langs), langs.dictionary_encode()
        names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        for part, ends, a, _, _ in chunks(data, off):
            code, s, e, row, _ = word_codes(part, ends, hashes[a : a + len(ends) - 1])
            key, example, n = np.unique(code, return_index=True, return_counts=True)
            held.append((key, n.astype(np.int64), langs.take(pa.array(a + row[example])), strings(LOWER[part], s[example], e[example])))
            size += len(key)
            for name, c in zip(names, np.bincount(of[a + row], minlength=len(names)).tolist()):
                totals[name] = totals.get(name, 0) + c
            if size > HELD:
                yield send()
                held, size = [], 0
    if size:
        yield send()
    if totals:
        yield pa.record_batch([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "n"])


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` words (a power of two), by prefix doubling; 0 ends a suffix."""
    rank = np.unique(np.append(seq, 0), return_inverse=True)[1][:-1]
    width = 1
    while width < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:]
        key = np.where(rank > 0, rank * (int(rank.max(initial=0)) + 1) + after, 0)
        rank = np.unique(np.append(key, 0), return_inverse=True)[1][:-1]
        width *= 2
    return np.argsort(rank, kind="stable")


def intervals(seq: np.ndarray, order: np.ndarray, depth: int, counted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For two words to ``depth``: (words, places of one occurrence of each n-gram, counts of those that begin before ``counted``). An n-gram is an interval of suffixes with a common prefix of so many words."""
    after = np.append(seq, np.zeros(depth, seq.dtype))
    common, length = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)
    same, whole = np.ones(max(0, len(order) - 1), bool), np.ones(len(order), bool)
    for j in range(depth):
        word = after[order + j]
        whole &= word != 0
        length += whole
        same &= (word[1:] == word[:-1]) & whole[1:]
        common[1:] += same
    for d in range(2, depth + 1):
        held = length >= d
        first = np.flatnonzero(held & (common < d))
        if not len(first):
            return
        run = np.zeros(len(order) + 1, np.int64)
        np.cumsum(held & (order < counted), out=run[1:])
        n = np.diff(np.append(run[first], run[-1]))
        yield d, order[first[n > 0]], n[n > 0]


class Numbers:
    """Numbers of frequent words and membership of frequent pairs, from mapped files."""

    def __init__(self, path: str, word_files: int, pair_files: int):
        self.files, self.path, self.n = _Files(), path, {"words": word_files, "pairs": pair_files}

    def find(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """The numbers of distinct keys, 0 where there is none."""
        out, files = np.zeros(len(keys), np.int64), self.n[kind]
        order, ends = by_bucket(keys, (mix(keys) % U64(files)).astype(np.int32), files)
        for b in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[b] : ends[b + 1]]
            have = self.files.array(f"{self.path}/{kind}-{b}", "hash")
            if have is not None and len(have):
                at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
                hit = have[at] == keys[mine]
                out[mine[hit]] = self.files.array(f"{self.path}/{kind}-{b}", "number")[at[hit]]
        return out

    def of(self, kind: str, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, np.int64)
        one, turn = np.unique(keys, return_inverse=True)
        return self.find(kind, one)[turn]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(U64) << U64(32) | right.astype(U64)


def squeezed(seq: np.ndarray) -> np.ndarray:
    """Breaks in a row become one, and words between two breaks go, as they begin no n-gram."""
    gap = seq == 0
    before, after = np.append(True, gap[:-1]), np.append(gap[1:], True)
    seq = seq[~(~gap & before & after)]
    gap = seq == 0
    return seq[~(gap & np.append(True, gap[:-1]))]


def shards(batches: Iterator[pa.RecordBatch], numbers: Numbers, pairs: bool, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """Sequences of word numbers and how many of their places count; a sequence that is cut ends with the words that n-grams of its last places need."""
    parts: list[np.ndarray] = []
    text: list[tuple[np.ndarray, np.ndarray]] = []
    have = 0
    for batch in batches:
        data, off = utf8(batch.column(0))
        hashes = lang_hashes(batch.column(1))
        for part, ends, a, joined, more in chunks(data, off):
            code, _, _, _, begins = word_codes(part, ends, hashes[a : a + len(ends) - 1], joined)
            text.append((numbers.of("words", code), begins))
            if more:
                continue
            found, begins = (np.concatenate(x) for x in zip(*text))
            text = []
            seq = np.zeros(len(found) + int(begins.sum()) + 1, np.int64)
            seq[np.arange(len(found)) + np.cumsum(begins)] = found
            if pairs:
                seq = squeezed(seq)
                both = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
                cut = both[numbers.of("pairs", pair_keys(seq[both], seq[both + 1])) == 0] + 1
                seq = np.insert(seq, cut, 0)
            parts.append(squeezed(seq))
            have += len(parts[-1])
            while have > size:
                seq = np.concatenate(parts)
                yield seq[: size + MOST_WORDS - 1], size
                parts, have = [seq[size:]], have - size
    if have:
        yield np.concatenate(parts), have


def _summed(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys of one or two columns, with sums of the last."""
    *key, n = cols
    order = np.lexsort(key[::-1]) if len(key) > 1 else np.argsort(key[0], kind="stable")
    key = [k[order] for k in key]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    first = np.flatnonzero(new)
    return [*(k[first] for k in key), np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)]


def frequent_grams(docs: DataFrame, min_count: int, shard: int = SHARD, file_words: int = FILE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(number, lang, word, n) of frequent words, (ids, a) of all frequent n-grams up to four words, (lang, n) of all words. ``docs`` has text and lang."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    buckets, path = buckets_for(docs), mounted(shared_dir(spark, "collocations"))
    summed = docs.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = saved(spark, summed.where((F.col("n") >= min_count) | F.col("word").isNull()), "words")
    totals, often = often.where("word is null").select("lang", "n"), often.where("word is not null")
    word_files = max(1, -(-often.count() // file_words))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            code = mix(span_hash(data, off[:-1], off[1:]) * _STEP + lang_hashes(batch.column(0)))
            file = (mix(code) % U64(word_files)).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(code.view(np.int64)), pa.array(file)], names=["lang", "word", "n", "code", "file"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        mine = pa.Table.from_batches(held)
        codes, files = mine["code"].to_numpy().view(U64), mine["file"].to_numpy()
        for b in np.unique(files).tolist():
            at = np.flatnonzero(files == b)
            at = at[np.argsort(codes[at])]
            if (codes[at][1:] == codes[at][:-1]).any():
                raise ValueError("two frequent words share a 64-bit hash")
            numbers = 1 + np.arange(len(at)) * word_files + b
            if int(numbers[-1]) >> 32:
                raise ValueError("more than 2 ** 32 frequent words")
            _write_file(f"{path}/words-{b}", {"hash": codes[at], "number": numbers})
            rows = mine.take(pa.array(at)).combine_chunks().to_batches()[0]
            yield pa.record_batch([pa.array(numbers), rows["lang"], rows["word"], rows["n"]], names=["number", "lang", "word", "n"])

    coded_words = often.mapInArrow(coded, "lang string, word string, n long, code long, file int")
    words = saved(spark, coded_words.repartitionById(word_files, F.col("file")).mapInArrow(number, "number long, lang string, word string, n long"), "numbered-words")

    def count(depth: int, least: int):
        kinds = [U64, np.uint32] if depth == 2 else [U64, U64, np.uint32]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for seq, counted in shards(batches, Numbers(path, word_files, buckets), depth > 2, shard):
                rows: list[tuple] = []
                for d, at, n in intervals(seq, suffix_order(seq, depth), depth, counted):
                    if d < least:
                        continue
                    key = [pair_keys(seq[at], seq[at + 1])]
                    if depth > 2:
                        key.append(pair_keys(seq[at + 2], seq[at + 3] if d > 3 else np.zeros(len(at), np.int64)))
                    turn, ends = by_bucket(at, (mix(key[0] if depth == 2 else mix(key[0]) + key[1]) % U64(buckets)).astype(np.int32), buckets)
                    cols = [*(k[turn] for k in key), n[turn].astype(np.uint32)]
                    for b in np.flatnonzero(np.diff(ends)).tolist():
                        rows += pack(b, [c[ends[b] : ends[b + 1]] for c in cols], 8 * len(key) + 4)
                for i in range(0, len(rows), 64):
                    yield block_batch(rows[i : i + 64])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, cols in gather(batches, kinds, _summed):
                *key, n = cols
                key, n = [k[n >= min_count] for k in key], n[n >= min_count]
                if depth == 2:
                    _write_file(f"{path}/pairs-{b}", {"hash": key[0], "number": n})
                low = U64((1 << 32) - 1)
                ids = np.stack([x for k in key for x in ((k >> U64(32)).astype(np.int64), (k & low).astype(np.int64))], 1)
                used = ids > 0
                off = np.append(0, np.cumsum(used.sum(1))).astype(np.int32)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(off), pa.array(ids[used])), pa.array(n)], names=["ids", "a"])

        blocks = exchange(docs.mapInArrow(send, BLOCK_SCHEMA), buckets)
        return saved(spark, blocks.mapInArrow(merge, "ids array<long>, a long"), f"grams-{depth}")

    pairs = count(2, 2)
    grams = words.select(F.array("number").alias("ids"), F.col("n").alias("a")).unionByName(pairs).unionByName(count(4, 3))
    return words, grams, totals


def inner_phrases(ids: Column) -> Column:
    """The phrases of two words and more inside a longer one."""
    inside = [F.when(F.size(ids) >= max(a + n - 1, n + 1), F.slice(ids, a, n)) for n in range(2, MOST_WORDS) for a in range(1, MOST_WORDS - n + 2)]
    return F.array_compact(F.array(*inside))


def collocations(docs: DataFrame, min_count: int = 30, keep: int = 80, scale: int = 2_000_000, top: int = 2000, shard: int = SHARD, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases. A candidate goes if a longer one that holds it has ``keep`` percent of its count."""
    if min_count < 1:
        raise ValueError("min_count must be 1 at least")
    words, grams, totals = frequent_grams(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), min_count, shard)
    phrases = grams.where(F.size("ids") > 1)
    longer = phrases.where(F.size("ids") > 2).select(F.explode(inner_phrases(F.col("ids"))).alias("part"), F.col("a").alias("of")).groupBy("part").agg(F.max("of").alias("most"))
    kept = phrases.join(longer, F.col("ids") == F.col("part"), "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * keep)).select("ids", "a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    parts = cuts.join(grams.select(F.col("ids").alias("head"), F.col("a").alias("l")), "head").join(grams.select(F.col("ids").alias("tail"), F.col("a").alias("r")), "tail")
    score = F.expr(f"cast(a as decimal(20, 0)) * {scale} div (l + r)")
    worst = parts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("ids", "a", "cut.score", "cut.l", "cut.r")
    spelt = worst.select("*", F.posexplode("ids").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    spelt = spelt.groupBy("ids", "a", "score", "l", "r").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = spelt.withColumn("rank", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB: the rows of op11_collocations, from every n-gram of every piece.
ORACLE_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
s AS (SELECT unnest([1, 2, 3, 4]) AS size),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, s WHERE len(ws) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
i AS (SELECT lang, unnest(list_transform(range(1, size - m + 2), lambda b: array_to_string(ws[b:b + m - 1], ' '))) AS phrase, a AS longer FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < size),
m AS (SELECT lang, phrase, max(longer) AS most FROM i GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN m ON m.lang = c.lang AND m.phrase = c.phrase WHERE most IS NULL OR 100 * most < 80 * a),
t AS (SELECT k.lang, k.phrase, k.a, x.cut, l.a AS l, r.a AS r, CAST(2000000 AS HUGEINT) * k.a // (l.a + r.a) AS score
  FROM k JOIN (SELECT unnest([1, 2, 3]) AS cut) x ON x.cut < k.size
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:x.cut], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[x.cut + 1:], ' ')),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT o.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
