"""A word n-gram model with interpolated modified Kneser-Ney smoothing, of order three or two, as sorted hash arrays.

1. Words. Tasks sum 64-bit word hashes of their texts and send them in blocks to buckets; a reducer writes its words
   sorted by hash, with their counts and numbers: the k-th most frequent word of bucket b has number 1 + k * buckets + b,
   and the mark before a text 0. So n-grams are counted as triples of numbers, exactly, and frequent words have short codes.
2. Triples (u, v, w). Tasks pack the triples of their texts into 64-bit keys over the words they hold, sort, sum and
   send blocks of differences, byte plane by byte plane and compressed, to the bucket of the middle word. There, all that
   has the context (u, v) and all that has the pair (v, w) lies together: counts of triples, totals of contexts with the
   numbers of followers seen once, twice and more often, the number of different u before each pair, and its sums by v. A
   middle word that would fill half a bucket goes two ways, by (u, v) for the one and by (v, w) for the other, and
   its sums are added when the store is opened. A reducer writes one file of sorted 48-bit hashes with values; n-grams
   seen once, the most by far, are hashes alone, and contexts seen once are not written, as a seen pair tells them.
3. Words again. The number of different words before each word goes to the word's bucket.

Workers map the files into memory and look up sorted queries; neither a worker's nor the driver's memory grows with the
corpus. Within a bucket, whose size does not depend on the corpus, a hash of 48 bits takes an n-gram that was never
seen for one that was with a chance of about 2 ** -26. Counting knows no such chance but for the words' 64-bit hashes.

The probability of w after u v is (c(uvw) - D[c]) / c(uv) + g(uv) * p(w | v); p(w | v) is the same over the numbers of
different words before v w, p(w) over those of different words before w, and falls back on an equal share for each of the V
known words and the unknown. N-grams that begin with the mark before a text keep their counts. Discounts D for 1, 2
and more come from counts of counts at each level. A text starts after marks and its end counts as a token. With order two
the first level has the context v and falls back on p(w).

Defined cases: null and empty texts are the end token alone. Rows with a null id are scored and never learnt
from; repeated rows count each. Very long texts are cut into pieces that keep their contexts. Without training rows every
token has probability 1. Only ids and texts are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.blocks import BLOCK_SCHEMA, MAPPED, arrow_batches, block_batch, buckets_for, by_bucket, exchange, gather, id_schema, mapped, mounted, pack, save, shared_dir
from kilnwork.llm.textscan import LOWER, NOT_SPACE, U64, distinct, mix, row_sums, slices, span_hash, utf8, words

BEGIN, END = U64(0x1D8AF066A5C3E2B7), U64(0x7C159E3779B97F4A)
ORDER = 3
#: Texts of this many bytes are scored together; tokens that are counted together (their words have 21 bits); triples merged at once.
CHUNK, PIECE, MERGE = 4 << 20, (1 << 21) - 8, 4 << 20
#: Words of a bucket that may be found hot, and the part of a bucket beyond which one is.
HOT_WORDS, HOT_PART = 4, 2
SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What a block's triples are for: totals of contexts, pairs, or both.
CONTEXT, PAIR = 1, 2
BOTH = CONTEXT | PAIR


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and the texts' offsets."""
    starts, ends, row = words(data, off, NOT_SPACE)
    codes = span_hash(LOWER[data], starts, ends)
    n = len(off) - 1
    out = np.full(len(codes) + n, END)
    at = row + np.arange(n + 1)
    out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(row))] = codes
    return out, at


def before(codes: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """The token before each one, ``first`` at the start of a text."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[at[:-1]] = first
    return out


def gram_hash(*numbers: np.ndarray) -> np.ndarray:
    """64 bits of words' numbers in their order."""
    h = np.zeros(len(numbers[0]), U64)
    for x in numbers:
        h = mix(h * U64(0x9E3779B97F4A7C15) + x.astype(U64) + U64(1))
    return h


def home(v: np.ndarray, other: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the middle word, or of ``other`` (a hash of context or pair) where the word is hot."""
    out = (v.astype(np.int64) - 1) % buckets
    i = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    salted = hot[i] == v
    out[salted] = (other[salted] % U64(buckets)).astype(np.int64)
    return out.astype(np.int32)


def _summed(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(key)
    first, _ = distinct(key[order])
    return key[order][first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data.reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def encode(role: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Triples sorted by v, u and w as compressed planes of differences."""
    dv = np.diff(v, prepend=0)
    du = np.where(dv == 0, np.diff(u, prepend=0), u)
    dw = np.where((dv == 0) & (du == 0), np.diff(w, prepend=0), w)
    du[:1], dw[:1] = u[:1], w[:1]
    if max(int(v.max()), int(u.max()), int(w.max())) >> 40:
        raise ValueError("more than 2 ** 40 words")
    return bytes([role]) + pa.compress(_planes(dv, 5) + _planes(du, 5) + _planes(dw, 5) + _planes(n, 5), "zstd", asbytes=True)


def decode(payload: bytes, n: int) -> tuple[int, list[np.ndarray]]:
    data = np.frombuffer(pa.decompress(payload[1:], 20 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    dv, du, dw, counts = (_from_planes(x, n, 5) for x in data)
    v = np.cumsum(dv)

    def undo(d: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        fresh[0] = True
        run = np.cumsum(d)
        starts = np.flatnonzero(fresh)
        return run - np.repeat(run[starts] - d[starts], np.diff(np.append(starts, n)))

    u = undo(du, dv != 0)
    w = undo(dw, (dv != 0) | (np.diff(u, prepend=0) != 0))
    return payload[0], [*(x.astype(np.uint32) if int(x.max()) < 1 << 32 else x for x in (v, u, w)), counts]


def sorted_triples(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct triples in the order of v, u, w, with sums."""
    v, u, w, n = cols
    if not len(v):
        return cols
    bits = [int(x.max()).bit_length() for x in (v, u, w)]
    if sum(bits) <= 64:
        order = np.argsort(v.astype(U64) << U64(bits[1] + bits[2]) | u.astype(U64) << U64(bits[2]) | w.astype(U64))
    else:
        order = np.lexsort((w, u, v))
    v, u, w = v[order], u[order], w[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    return [v[first], u[first], w[first], np.add.reduceat(n[order], first)]


def _pieces(batches: Iterator[pa.RecordBatch], order: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, w) hashes of the tokens of all texts, ``size`` at a time at most."""
    parts: list[tuple] = []
    have = 0

    def out(least: int) -> Iterator[tuple]:
        nonlocal parts, have
        u, v, w = (np.concatenate(x) for x in zip(*parts))
        a = 0
        while len(w) - a > least:
            yield u[a : a + size], v[a : a + size], w[a : a + size]
            a += size
        parts, have = [(u[a:], v[a:], w[a:])], max(0, len(w) - a)

    for batch in batches:
        data, off = utf8(batch.column(0))
        for _, _, part, part_off in slices(data, off):
            w, at = tokens(part, part_off)
            v = before(w, at, BEGIN)
            parts.append((before(v, at, BEGIN) if order > 2 else np.full_like(v, BEGIN), v, w))
            have += len(w)
            if have > size:
                yield from out(size)
    if have:
        yield from out(0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _write_file(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays in one file: their number and an index of kinds, places and sizes, then the arrays."""
    index, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        index[name] = [x.dtype.str, at, len(x)]
        parts.append(raw + bytes(-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(index).encode()
    head += b" " * (-len(head) % 8)
    save(path, np.frombuffer(len(head).to_bytes(8, "little") + head + b"".join(parts), np.uint8))


class _Files:
    """The arrays of files, mapped as they are needed."""

    def __init__(self):
        self.maps: dict[str, np.ndarray | None] = {}
        self.heads: dict[str, tuple[dict, int]] = {}
        self.views: dict[tuple[str, str], np.ndarray | None] = {}

    def array(self, path: str, name: str) -> np.ndarray | None:
        if (path, name) not in self.views:
            if len(self.views) > 16 * MAPPED:  # beyond, arrays are mapped for one use
                return self._view(path, name)
            self.views[path, name] = self._view(path, name)
        return self.views[path, name]

    def _view(self, path: str, name: str) -> np.ndarray | None:
        raw = mapped(self.maps, path, np.uint8)
        if raw is None:
            return None
        if path not in self.heads:
            n = int(raw[:8].view("<u8")[0])
            self.heads[path] = json.loads(raw[8 : 8 + n].tobytes()), 8 + n
        index, base = self.heads[path]
        if name not in index:
            return None
        kind, at, n = index[name]
        return raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind)


_LOW48 = U64((1 << 48) - 1)


def _table(name: str, hashes: np.ndarray, values: np.ndarray | None) -> dict[str, np.ndarray]:
    """Arrays of a table from 48 bits of hashes to rows of values; rows that two bytes each can't hold are apart."""
    key = hashes & _LOW48
    if values is None:
        key = np.sort(key)
        return {f"{name}.hi": (key >> U64(16)).astype(np.uint32), f"{name}.lo": (key & U64(0xFFFF)).astype(np.uint16)}
    out = {}
    wide = (values > 0xFFFF).any(1)
    for part, rows, kind in ((name, ~wide, np.uint16), (f"{name}+", wide, np.int64)):
        order = np.argsort(key[rows])
        k = key[rows][order]
        out |= {f"{part}.hi": (k >> U64(16)).astype(np.uint32), f"{part}.lo": (k & U64(0xFFFF)).astype(np.uint16), f"{part}.values": values[rows][order].astype(kind).ravel()}
    return out


def discounts(counts_of_counts: list[int]) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of entries with count 1 to 4."""
    n1, n2, n3, n4 = counts_of_counts
    if min(n1, n2) == 0:
        return [0.0, 0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def _four(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run: the sum, and how many are one, two, more."""
    cols = (n, n == 1, n == 2, n > 2)
    return np.stack([np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for x in cols], 1)


class Store:
    """The model's files, mapped into memory as they are needed."""

    def __init__(self, path: str):
        self.path = path
        with open(f"{path}/model.json") as f:
            self.about = json.load(f)
        self.buckets = self.about["buckets"]
        self.hot = np.array(self.about["hot"], np.int64)
        self.hot_sums = np.array(self.about["hot_sums"], np.int64).reshape(-1, 4)
        self.files = _Files()

    def word_rows(self, codes: np.ndarray) -> np.ndarray:
        return look_up_words(self.files, self.path, self.buckets, codes)

    def before_words(self, numbers: np.ndarray) -> np.ndarray:
        """How many different words stand before each word."""
        out = np.zeros(len(numbers), np.int64)
        order, ends = by_bucket(numbers, ((numbers - 1) % self.buckets).astype(np.int32), self.buckets)
        for b in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[b] : ends[b + 1]]
            have = self.files.array(f"{self.path}/before-{b}", "n")
            if have is not None:
                rank = (numbers[mine] - 1) // self.buckets
                fits = rank < len(have)
                out[mine[fits]] = have[rank[fits]]
        return out

    def rows(self, tables: list[str], hashes: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        """The values of each n-gram, zeros where no table has it; a table without values stands for ones. Queries may repeat."""
        key = bucket.astype(U64) << U64(48) | hashes & _LOW48
        order = np.argsort(key)
        key = key[order]
        first, n = distinct(key)
        key = key[first]
        found = np.zeros((len(key), width), np.int64)
        ends = np.searchsorted(key >> U64(48), np.arange(self.buckets + 1).astype(U64))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            hi = ((key[ends[b] : ends[b + 1]] >> U64(16)) & U64(0xFFFFFFFF)).astype(np.uint32)
            lo = (key[ends[b] : ends[b + 1]] & U64(0xFFFF)).astype(np.uint16)
            left = np.arange(len(hi))
            for name in tables:
                path = f"{self.path}/grams-{b}"
                have = self.files.array(path, f"{name}.hi")
                if have is None or not len(have) or not len(left):
                    continue
                have_lo, values = self.files.array(path, f"{name}.lo"), self.files.array(path, f"{name}.values")
                spot, open_ = np.searchsorted(have, hi[left]), np.arange(len(left))
                hit = np.full(len(left), -1)
                while len(open_):
                    s = spot[open_]
                    inside = s < len(have)
                    inside[inside] = have[s[inside]] == hi[left[open_[inside]]]
                    open_, s = open_[inside], s[inside]
                    same = have_lo[s] == lo[left[open_]]
                    hit[open_[same]] = s[same]
                    open_ = open_[~same]
                    spot[open_] += 1
                got = hit >= 0
                found[ends[b] + left[got]] = values.reshape(-1, width)[hit[got]] if values is not None else 1
                left = left[~got]
        out = np.empty((len(order), width), np.int64)
        out[order] = np.repeat(found, n, 0)
        return out

    def score(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base log10 probability and the model's, for each text."""
        m = self.about
        if not m["tokens"]:
            zero = np.zeros(len(at) - 1)
            return zero.astype(np.int64), zero, zero
        vocabulary, inverse = np.unique(codes, return_inverse=True)
        counts, numbers = self.word_rows(vocabulary).T
        known = counts > 0
        numbers = np.where(known, numbers, -1)
        b = np.zeros(len(vocabulary), np.int64)
        b[known] = self.before_words(numbers[known])
        d = np.array(m["discounts"]["1"])
        lower = (b - d[np.minimum(b, 3)]) / m["pairs"] + (d[1:] * m["before"]).sum() / m["pairs"] / (m["words"] + 1)
        w = numbers[inverse]
        v = before(w, at, 0)
        u = before(v, at, 0) if m["order"] > 2 else np.zeros_like(v)
        p = lower[inverse]
        pair = np.flatnonzero((v >= 0) & (w >= 0))
        if m["order"] > 2:
            h = gram_hash(v[pair], w[pair])
            a = np.zeros(len(w), np.int64)
            a[pair] = self.rows(["pair1", "pair", "pair+"], h, home(v[pair], h, self.hot, self.buckets), 1)[:, 0]
            after = self._sums(np.append(numbers, 0))
            p = self._level(p, a, after[before(inverse, at, len(numbers))], m["discounts"]["2"])
            # A context was seen if its pair was; those that the table lacks were seen once.
            seen = before(a, at, 1) > 0
        else:
            seen = v >= 0
        seen &= (u >= 0) & (v >= 0)
        c, sums = np.zeros(len(w), np.int64), np.zeros((len(w), 4), np.int64)
        mine = np.flatnonzero(seen)
        h = gram_hash(u[mine], v[mine])
        found = self.rows(["context", "context+"], h, home(v[mine], h, self.hot, self.buckets), 4)
        found[found[:, 0] == 0] = 1, 1, 0, 0
        sums[mine] = found
        mine = mine[w[mine] >= 0]
        c[mine] = self.rows(["triple1", "triple", "triple+"], gram_hash(u[mine], v[mine], w[mine]), home(v[mine], gram_hash(u[mine], v[mine]), self.hot, self.buckets), 1)[:, 0]
        p = self._level(p, c, sums, m["discounts"]["3"])
        base = np.log10((counts + 0.1) / (m["tokens"] + 0.1 * (m["words"] + 1)))
        return row_sums(known[inverse].astype(np.int64), at), row_sums(base[inverse], at), row_sums(np.log10(p), at)

    def _sums(self, v: np.ndarray) -> np.ndarray:
        """What follows the word v: the sum over its pairs, and how many of them count one, two, more."""
        out = np.zeros((len(v), 4), np.int64)
        mine = np.flatnonzero(v >= 0)
        found = self.rows(["middle", "middle+"], gram_hash(v[mine]), ((v[mine] - 1) % self.buckets).astype(np.int32), 4)
        found[found[:, 0] == 0] = 1, 1, 0, 0  # words with one pair aren't written
        out[mine] = found
        i = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        is_hot = self.hot[i] == v
        out[is_hot] = self.hot_sums[i[is_hot]]
        return out

    @staticmethod
    def _level(p: np.ndarray, c: np.ndarray, sums: np.ndarray, discounts: list[float]) -> np.ndarray:
        d, total = np.array(discounts), np.maximum(sums[:, 0], 1)
        weight = np.where(sums[:, 0] > 0, (sums[:, 1:] * d[1:]).sum(1) / total, 1.0)
        return np.where(c > 0, (c - d[np.minimum(c, 3)]) / total, 0.0) + weight * p


def look_up_words(files: _Files, path: str, buckets: int, codes: np.ndarray) -> np.ndarray:
    """Count and number of sorted distinct word hashes, zeros for unknown ones."""
    out = np.zeros((len(codes), 2), np.int64)
    order, ends = by_bucket(codes, (codes % U64(buckets)).astype(np.int32), buckets)
    for b in np.flatnonzero(np.diff(ends)).tolist():
        mine = order[ends[b] : ends[b + 1]]
        have = files.array(f"{path}/words-{b}", "hash")
        if have is None or not len(have):
            continue
        at = np.minimum(np.searchsorted(have, codes[mine]), len(have) - 1)
        hit = have[at] == codes[mine]
        for i, name in enumerate(("count", "number")):
            out[mine[hit], i] = files.array(f"{path}/words-{b}", name)[at[hit]]
    return out


def fit(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Counts all texts of ``docs`` and returns the folder of the store."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(text_col).alias("text"))
    buckets = buckets_for(docs)
    path = mounted(shared_dir(spark, "ngram-lm"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)

        def send() -> pa.RecordBatch:
            turn, ends = by_bucket(keys, (keys % U64(buckets)).astype(np.int32), buckets)
            k, c = keys[turn], counts[turn].astype(np.uint32)
            return block_batch([row for b in np.flatnonzero(np.diff(ends)).tolist() for row in pack(b, [k[ends[b] : ends[b + 1]], c[ends[b] : ends[b + 1]]], 12)])

        for _, _, w in _pieces(batches, 2):
            w = np.sort(w)
            first, n = distinct(w)
            keys, counts = _summed(np.append(keys, w[first]), np.append(counts, n))
            if len(keys) > 1 << 21:
                yield send()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield send()

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b, (keys, counts) in gather(batches, [U64, np.uint32], lambda x: [*_summed(*x)]):
            often = np.lexsort((keys, -counts))
            number = np.empty(len(keys), np.int64)
            number[often] = 1 + np.arange(len(keys)) * buckets + b
            _write_file(f"{path}/words-{b}", {"hash": keys, "count": counts, "number": number})
            top = often[:HOT_WORDS]
            rows.append((int(counts.sum()), len(keys), number[top].tolist(), counts[top].tolist()))
        cols = [list(c) for c in zip(*rows)] if rows else [[]] * 4
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))], names=["tokens", "words", "top", "counts"])

    gathered = exchange(docs.mapInArrow(count_words, BLOCK_SCHEMA), buckets).mapInArrow(merge_words, "tokens long, words long, top array<long>, counts array<long>").collect()
    n_tokens, n_words = sum(r["tokens"] for r in gathered), sum(r["words"] for r in gathered)
    hot = np.array(sorted({0, *(i for r in gathered for i, c in zip(r["top"], r["counts"]) if c * HOT_PART * buckets > n_tokens)}), np.int64)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for u, v, w in _pieces(batches, order):
            codes = np.unique(np.concatenate([w, u[:2], v[:1]]))  # a piece's first contexts may lie before it
            have = np.concatenate([look_up_words(files, path, buckets, codes)[:, 1], [0]])
            turn = np.argsort(have)
            rank = np.empty(len(turn), np.int64)
            rank[turn] = np.arange(len(turn))
            have = have[turn]
            one = lambda x: rank[np.searchsorted(codes, x)] if x != BEGIN else 0  # noqa: B023,E731
            bits = U64(len(have).bit_length())
            low_w = rank[np.searchsorted(codes, w)].astype(U64)
            low_v = np.where(v == BEGIN, U64(0), np.append(U64(one(v[0])), low_w[:-1]))
            low_u = np.where(u == BEGIN, U64(0), np.append(U64(one(u[0])), low_v[:-1]))
            key = low_v << (bits + bits) | low_u << bits | low_w
            key.sort()
            first, n = distinct(key)
            key = key[first]
            low = (U64(1) << bits) - U64(1)
            v, u, w = have[(key >> (bits + bits)).astype(np.int64)], have[(key >> bits & low).astype(np.int64)], have[(key & low).astype(np.int64)]
            is_hot = np.isin(v, hot)
            rows = []
            for role, pick, to in (
                (BOTH, ~is_hot, lambda i: (v[i] - 1) % buckets),
                (CONTEXT, is_hot, lambda i: home(v[i], gram_hash(u[i], v[i]), hot, buckets)),
                (PAIR, is_hot, lambda i: home(v[i], gram_hash(v[i], w[i]), hot, buckets)),
            ):
                i = np.flatnonzero(pick)
                turn, ends = by_bucket(i, to(i).astype(np.int32), buckets)
                i = i[turn]
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    j = i[ends[b] : ends[b + 1]]
                    for s in range(0, len(j), 1 << 18):
                        k = j[s : s + (1 << 18)]
                        at = (v[k] - 1) // buckets if role == BOTH else v[k]
                        rows.append((b, len(k), encode(role, at, u[k], w[k], n[k])))
            yield block_batch(rows)

    def merge_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda x: sorted_triples([np.concatenate(c) for c in zip(*x)])
        for b, blocks in groupby(_blocks(batches), key=lambda x: x[0]):
            parts: dict[int, list[list[np.ndarray]]] = {}
            fresh: dict[int, int] = {}
            for _, n, payload in blocks:
                role, cols = decode(payload, n)
                if role == BOTH:
                    cols[0] = 1 + cols[0].astype(np.int64) * buckets + b
                    cols[0] = cols[0].astype(np.uint32) if int(cols[0].max()) < 1 << 32 else cols[0]
                parts.setdefault(role, []).append(cols)
                fresh[role] = fresh.get(role, 0) + n
                if fresh[role] > MERGE:
                    parts[role] = [joined(parts[role])]
                    fresh[role] = 0
            found = {role: joined(parts.pop(role)) for role in (BOTH, CONTEXT, PAIR) if role in parts}
            arrays, about, blocks = _bucket_tables(found, buckets)
            _write_file(f"{path}/grams-{b}", arrays)
            save(f"{path}/about-{b}.json", np.frombuffer(json.dumps(about).encode(), np.uint8))
            yield block_batch(blocks)

    def merge_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b, blocks in groupby(_blocks(batches), key=lambda x: x[0]):
            n = np.zeros(0, np.int64)
            for _, size, payload in blocks:
                _, (rank, _, _, counts) = decode(payload, size)
                rank, size = rank.astype(np.int64), int(rank.max()) + 1
                if size > len(n):
                    n = np.append(n, np.zeros(size - len(n), np.int64))
                n[rank] += counts  # ranks are distinct within a block
            _write_file(f"{path}/before-{b}", {"n": n})
            rows.append([int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())])
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["n1", "n2", "n3", "n4", "more"])

    words_again = exchange(exchange(docs.mapInArrow(count_triples, BLOCK_SCHEMA), buckets).mapInArrow(merge_triples, BLOCK_SCHEMA), buckets)
    ends = words_again.mapInArrow(merge_before, "n1 long, n2 long, n3 long, n4 long, more long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4", "more")]).first()
    pairs, counts, hot_sums = 0, np.zeros((2, 4), np.int64), np.zeros((len(hot), 4), np.int64)
    for b in range(buckets):
        if os.path.exists(f"{path}/about-{b}.json"):
            with open(f"{path}/about-{b}.json") as f:
                about = json.load(f)
            pairs += about["pairs"]
            counts += np.array(about["counts"])
            for h, sums in about["hot"].items():
                hot_sums[np.searchsorted(hot, int(h))] += np.array(sums)
    levels = {"1": discounts(list(ends[:4])), "2": discounts(counts[1].tolist()), "3": discounts(counts[0].tolist())}
    model = {"order": order, "buckets": buckets, "tokens": n_tokens, "words": n_words, "pairs": pairs, "discounts": levels, "before": [ends[0], ends[1], ends[4]], "hot": hot.tolist(), "hot_sums": hot_sums.tolist()}
    save(f"{path}/model.json", np.frombuffer(json.dumps(model).encode(), np.uint8))
    return path


def _distinct_pairs(v: np.ndarray, w: np.ndarray, v0: np.ndarray, w0: np.ndarray, n0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs after those given with their counts, in the order of v and w, each with how often it comes."""
    bits = int(w.max(initial=0)).bit_length()
    if bits + int(v.max(initial=0)).bit_length() <= 64:
        key = np.sort(v.astype(U64) << U64(bits) | w.astype(U64))
        first, a = distinct(key)
        v, w = (key[first] >> U64(bits)).astype(np.int64), (key[first] & ((U64(1) << U64(bits)) - U64(1))).astype(np.int64)
    else:
        order = np.lexsort((w, v))
        v, w = v[order].astype(np.int64), w[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        a = np.diff(np.append(first, len(v)))
        v, w = v[first], w[first]
    return np.append(v0, v), np.append(w0, w), np.append(n0, a)


def _bucket_tables(found: dict[int, list[np.ndarray]], buckets: int) -> tuple[dict, dict, list[tuple[int, int, bytes]]]:
    """From a bucket's sorted triples by role: its arrays, what the model sums over buckets, and blocks of the words after different words."""
    none = [np.zeros(0, np.int64)] * 4
    both, contexts, pairs = (found.get(role, none) for role in (BOTH, CONTEXT, PAIR))
    arrays, about = {}, {"pairs": 0, "counts": [], "hot": {}}
    v, u, w, n = (np.concatenate(x) for x in zip(both, contexts))
    h = gram_hash(u, v, w)
    arrays |= _table("triple1", h[n == 1], None) | _table("triple", h[n > 1], n[n > 1, None])
    about["counts"].append([int((n == k).sum()) for k in (1, 2, 3, 4)])
    del h
    first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])))[: len(v)]
    sums = _four(n, first)
    more = sums[:, 0] > 1
    arrays |= _table("context", gram_hash(u[first], v[first])[more], sums[more])

    v, u, w, n = (np.concatenate(x) for x in zip(both, pairs))
    begins = v == 0  # pairs after the mark before a text keep their counts
    v, w, a = _distinct_pairs(v[~begins], w[~begins], v[begins], w[begins], n[begins])
    h = gram_hash(v, w)
    arrays |= _table("pair1", h[a == 1], None) | _table("pair", h[a > 1], a[a > 1, None])
    about["pairs"] = len(a)
    about["counts"].append([int((a == k).sum()) for k in (1, 2, 3, 4)])
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))[: len(v)]
    sums = _four(a, first)
    arrays |= _table("middle", gram_hash(v[first])[sums[:, 0] > 1], sums[sums[:, 0] > 1])
    hot = set(pairs[0].tolist()) if len(pairs[0]) else set()
    for i in np.flatnonzero(np.isin(v[first], np.array(sorted(hot), np.int64))).tolist():
        about["hot"][str(int(v[first][i]))] = sums[i].tolist()

    w = np.sort(w).astype(np.int64)
    first, k = distinct(w)
    w = w[first]
    to = ((w - 1) % buckets).astype(np.int32)
    turn, ends = by_bucket(w, to, buckets)
    rank, k = (w[turn] - 1) // buckets, k[turn]
    zero = np.zeros(len(rank), np.int64)
    blocks = []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        a, z = ends[b], ends[b + 1]
        blocks.append((b, int(z - a), encode(0, rank[a:z], zero[a:z], zero[a:z], k[a:z])))
    return arrays, about, blocks


def score_texts(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of SCHEMA for each row of ``docs``; perplexity is 10 ** (-score / n_tokens)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Store(store)
        n = model.about["tokens"]
        for batch in batches:
            data, off = utf8(batch.column(1))
            for a, z, part, part_off in slices(data, off, CHUNK):
                codes, at = tokens(part, part_off)
                known, base, score = model.score(codes, at)
                yield pa.record_batch([batch.column(0).slice(a, z - a), pa.array(np.diff(at)), pa.array(known), pa.array(np.full(z - a, n, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, id_schema(docs, SCHEMA))


def fold(id_col: str = "doc_id", folds: int = 10) -> Column:
    """crc32 of the id as text, by the number of folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
