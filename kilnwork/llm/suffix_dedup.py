"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A set D of residues modulo v is a difference cover if any two positions have an offset below v at which both
fall on D. It is used twice.

1. Which suffixes can matter. At the positions on D of every text, windows of ``LENGTH - v + 1`` bytes are
   counted over the corpus (hashes in blocks, merged by bucket). Two equal strings of LENGTH bytes hold an equal
   window at one offset, so only suffixes that begin at most v - 1 bytes before a repeated window remain.
   Repeated windows go to sorted arrays in the shared folder that workers map into memory.
2. The order of those suffixes. They are dealt out by the least hash of the 64-byte strings that their first
   LENGTH bytes hold, which is equal for equal strings and changes seldom along a text: runs of suffixes travel
   together as one segment of text. A reducer sorts its suffixes one bucket of first bytes at a time; suffixes
   with equal first v bytes are told apart by the precomputed ranks of the cover sample, at the offset at which
   both lie on the sample, by a quicksort over all tied groups at once. The ranks come from sorting the sample's
   first v bytes and doubling the length compared, as a sample position plus v is a sample position. So no
   comparison runs along a long repeat, and memory is bound by the text that a reducer sorts at once.
3. Hot groups. A segment that occurs in more than one place is repeated as a whole, so only one of its copies is
   sorted. Where one least hash still has more than HOT_BYTES of different segments (a passage that a third of all
   documents hold in different surroundings), its suffixes are dealt out again by blocks of the place of the least
   string in them, each with a hash of the bytes that all suffixes of a block share; then by smaller blocks,
   and at last by the whole LENGTH bytes. What surrounds a passage then lies apart, and what lies inside it has
   the same bytes everywhere and is one segment.

A byte is removed if a string of LENGTH bytes that also begins anywhere else covers it. Texts that occur more
than once are removed as a whole, if they have LENGTH bytes, and one of them stands for all in the sorting.
What is found is written as sorted tables to the shared folder, where the last scan of the texts looks it up; whole
texts are never shuffled. Strings are compared as bytes when sorted; equal texts are told by 128 bits of SHA-256 and equal segments by
128 bits of BLAKE2b. The other hashes only choose what is sorted, and where.

Defined cases: null and empty texts and texts shorter than LENGTH lose nothing. Rows with the same id are
different documents. A null id is kept. Very long texts are scanned in parts of 1 MiB that share what a string
across their border needs. Only ids and texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.llm.blocks import BLOCK_SCHEMA, FILES, Appended, arrow_batches, block_batch, buckets_for, by_bucket, exchange, file_of, gather, home, id_schema, mapped, mounted, pack, save, saved, shared_dir
from kilnwork.llm.textscan import U64, distinct, fixed_hash, mix, ragged, utf8

LENGTH = 400
#: Bytes of the strings whose least hash deals suffixes out.
CORE = 64
#: Text bytes that a reducer sorts together, if its groups allow; suffixes sorted in one bucket of first bytes.
TEXT_BYTES, SUFFIXES = 1 << 20, 1 << 20
#: Text bytes of one group beyond which it is dealt out again, and the places in a block at each such step.
HOT_BYTES, STEPS = 1 << 20, (112, 16, 1)
#: Hot groups up to which their keys are broadcast (8 bytes each).
BROADCAST_GROUPS = 500_000
#: Stands for a null id while rows are matched.
NO_ID = -(1 << 63)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary"


def wide_cover(r: int) -> tuple[int, np.ndarray]:
    """Modulus and residues of the cover with 6 r + 4 residues whose steps follow a known pattern."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


def small_cover(v: int) -> np.ndarray:
    """A least set of residues whose differences give every residue modulo v, by search."""
    from itertools import combinations

    for size in range(1, v + 1):
        for rest in combinations(range(1, v), size - 1):
            d = (0, *rest)
            if len({(a - b) % v for a in d for b in d}) == v:
                return np.array(d)
    raise ValueError(v)


FILTER_V, FILTER_D = wide_cover(2)
WINDOW = LENGTH - FILTER_V + 1
V = 16
D = small_cover(V)
#: Bytes that ranks of the sample compare: what follows the first V bytes at any offset below V, and no more than LENGTH.
DEPTH = LENGTH - V
_ON = np.isin(np.arange(V), D)
#: For two positions' residues, an offset at which both lie on the sample.
OFFSET = np.array([[next(k for k in range(V) if _ON[(a + k) % V] and _ON[(b + k) % V]) for b in range(V)] for a in range(V)])


def big_words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number in byte order."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    out = padded[: len(text)].copy()
    for k in range(1, 8):
        out <<= U64(8)
        out |= padded[k : k + len(text)]
    return out


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks, equal for equal keys."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), np.int64)
    new[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ranks(a.astype(U64) << U64(32) | b.astype(U64))


def sample_ranks(word: np.ndarray) -> np.ndarray:
    """For each position on the cover, the rank of its DEPTH bytes among all such; -1 elsewhere. ``word`` are big_words."""
    n = len(word)
    at = np.flatnonzero(_ON[np.arange(n) % V])
    place = np.full(n + LENGTH + V, len(at), np.int64)  # positions past the end share a last place
    place[at] = np.arange(len(at))
    ahead = lambda r, k: np.append(r, -1)[place[at + k]] + 1
    after = np.append(word, np.zeros(V, U64))
    rank, have = _pair(_ranks(word[at]), _ranks(after[at + 8])), V
    while 2 * have <= DEPTH:
        rank = _pair(rank, ahead(rank, have))
        have *= 2
    if have < DEPTH:
        rank = _pair(rank, ahead(rank, DEPTH - have))
    out = np.full(n + LENGTH, -1, np.int64)
    out[at] = rank
    return out


def suffix_classes(text: np.ndarray, starts: np.ndarray, most: int = SUFFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first LENGTH bytes, and for each in that order whether it equals the one before.

    Every start has LENGTH bytes of text after it. Suffixes are sorted in blocks of about ``most`` with the same first bytes.
    """
    word = big_words(text)
    rank = sample_ranks(word)
    by_first = np.argsort(word[starts])
    first_word = word[starts[by_first]]
    edges = np.flatnonzero(np.append(True, first_word[1:] != first_word[:-1]))
    orders, equals = [], []
    a = 0
    while a < len(starts):
        z = edges[min(np.searchsorted(edges, a + most), len(edges) - 1)] if a + most < len(starts) else len(starts)
        z = int(z if z > a else len(starts))
        block = by_first[a:z]
        order, equal = _sort_block(word, rank, starts[block])
        orders.append(block[order])
        equals.append(equal)
        a = z
    return (np.concatenate(orders), np.concatenate(equals)) if orders else (np.zeros(0, np.int64), np.zeros(0, bool))


def _sort_block(word: np.ndarray, rank: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(s)
    head = _pair(_ranks(word[s]), _ranks(word[s + 8]))
    order = np.argsort(head)
    # group[i]: where the group of suffixes that aren't told apart yet begins, for place i of the order
    new = np.append(True, head[order][1:] != head[order][:-1])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    settled = np.zeros(n, bool)  # equal to the pivot of its group
    tail = _pair(_ranks(word[s + DEPTH]), _ranks(word[s + DEPTH + 8]))
    while True:
        size = np.bincount(group, minlength=n)
        live = np.flatnonzero((size[group] > 1) & ~settled)
        if not len(live):
            break
        g = group[live]
        mine, pivot = order[live], order[g + (size[g] * 5 // 8)]
        i, p = s[mine], s[pivot]
        k = OFFSET[i % V, p % V]
        side = rank[i + k] - rank[p + k]  # of DEPTH bytes from the offset on; the last V bytes follow if these are equal
        side = np.sign(np.where(side == 0, tail[mine] - tail[pivot], side)) + 1
        turn = np.argsort(g * 3 + side, kind="stable")
        order[live] = order[live][turn]
        g, side = g[turn], side[turn]
        new = np.append(True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]))
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        settled[live] = side == 1
    return order, group != np.arange(n)


def repeated_starts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at each start also stand at another one."""
    order, equal = suffix_classes(text, starts)
    out = np.zeros(len(starts), bool)
    out[order] = equal | np.append(equal[1:], False)
    return out


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    size = -(-len(h) // width) * width
    x = np.full(size, np.iinfo(h.dtype).max, h.dtype)
    x[: len(h)] = h
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _store_keys(path: str, buckets: int, cache: dict, keys: np.ndarray) -> np.ndarray:
    """Which keys the sorted arrays in the shared folder have."""
    out = np.zeros(len(keys), bool)
    order, ends = by_bucket(keys, file_of(keys, buckets), min(buckets, FILES))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        mine = order[ends[b] : ends[b + 1]]
        have = mapped(cache, f"{path}/{b}.keys", U64)
        if have is not None:
            q = keys[mine]
            out[mine] = have[np.minimum(np.searchsorted(have, q), len(have) - 1)] == q
    return out


def _halves(digests: pa.Array) -> np.ndarray:
    """128-bit digests as two rows of 64-bit numbers, most significant bytes first."""
    return np.ascontiguousarray(np.frombuffer(b"".join(digests.to_pylist()), ">u8").astype(U64).reshape(-1, 2).T)


def _home(digest: Column, buckets: int) -> Column:
    """The bucket of a digest: its first half modulo their number."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 8)), 16, 10).cast("decimal(20,0)"), F.lit(buckets)).cast("int")


def write_table(rows: DataFrame, path: str, buckets: int) -> None:
    """Rows of a 128-bit digest ``h`` and long columns, as one file of sorted columns for each bucket."""
    values = [c for c in rows.columns if c != "h"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            key = _halves(batch.column(0))
            block = np.concatenate([key, *(c.to_numpy().astype(np.int64).view(U64)[None] for c in batch.columns[1:])])
            of = key[0] % U64(buckets)
            for b in np.unique(of).tolist():
                found.setdefault(b, []).append(block[:, of == b])
        for b, x in found.items():
            x = np.concatenate(x, 1)
            save(f"{path}/{b}.table", x[:, np.lexsort(x[::-1])])
        yield pa.record_batch([pa.array([len(found)], pa.int64())], names=["n"])

    rows.select("h", *values, _home(F.col("h"), buckets).alias("bucket")).repartitionById(buckets, F.col("bucket")).select("h", *values).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def table_rows(path: str, buckets: int, cache: dict, key: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """For each digest that the table has, by its place in ``key``: its rows' ``width`` values."""
    out: dict[int, np.ndarray] = {}
    order, ends = by_bucket(key[0], (key[0] % U64(buckets)).astype(np.int32), buckets)
    for b in np.flatnonzero(np.diff(ends)).tolist():
        mine = order[ends[b] : ends[b + 1]]
        have = mapped(cache, f"{path}/{b}.table", U64)
        if have is None:
            continue
        have = have.reshape(width + 2, -1)
        lo, hi = np.searchsorted(have[0], key[0, mine]), np.searchsorted(have[0], key[0, mine], "right")
        for i, x, y in zip(mine[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            same = have[1, x:y] == key[1, i]
            if same.any():
                out[i] = have[2:, x:y][:, same].view(np.int64)
    return out


def _merge(cols: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(cols[0])
    keys = cols[0][order]
    first, _ = distinct(keys)
    return [keys[first], np.minimum(np.add.reduceat(cols[1][order].astype(np.int64), first), 2).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)]


def _repeated_windows(docs: DataFrame, buckets: int) -> str:
    """A folder of the hashes of cover windows that occur more than once. ``docs``: text of one row of each distinct text."""
    path = mounted(shared_dir(docs.sparkSession, "repeated-windows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        fresh = 0

        def send() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(parts))
            first, n = distinct(keys)
            order, ends = by_bucket(keys[first], home(keys[first], buckets), buckets)
            cols = [keys[first][order], np.minimum(n[order], 2).astype(np.uint8)]
            return block_batch([row for b in np.flatnonzero(np.diff(ends)).tolist() for row in pack(b, [x[ends[b] : ends[b + 1]] for x in cols], 9)])

        for batch in batches:
            data, off = utf8(batch.column(0))
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                for b in range(a, z, 1 << 20):  # a very long text in parts that share WINDOW - 1 bytes
                    h = fixed_hash(data[b : min(z, b + (1 << 20) + WINDOW - 1)], WINDOW)
                    at = np.flatnonzero(_FILTER_ON[(np.arange(len(h)) + (b - a)) % FILTER_V])
                    parts.append(h[at])
                    fresh += len(at)
                if fresh > 2 << 20:
                    yield send()
                    parts, fresh = [], 0
        if parts:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = [], Appended()
        for _, (keys, n) in gather(batches, [U64, np.uint8], _merge):
            out.add(f"{path}/{int(file_of(keys[:1], buckets)[0])}.keys", keys[n > 1])
            rows.append(int((n > 1).sum()))
        out.done()
        yield pa.record_batch([pa.array(rows, pa.int64())], names=["n"])

    exchange(docs.mapInArrow(count, BLOCK_SCHEMA), buckets).mapInArrow(merge, "n long").agg(F.sum("n")).collect()
    return path


_FILTER_ON = np.isin(np.arange(FILTER_V), FILTER_D)
SEGMENTS = "least long, h1 long, h2 long, n int, text binary, id long, h binary, at long"
RUNS = "id long, h binary, lo long, hi long"
#: Segments that a task remembers.
REMEMBERED = 200_000


class _Segments:
    """Collects rows of SEGMENTS. A segment that this task has seen lately is repeated as a whole: such rows are byte ranges, with n bytes and no text."""

    def __init__(self):
        self.seen: dict[bytes, tuple | None] = {}
        self.rows: list[list] = []
        self.last: list | None = None

    def add(self, least: int, raw: bytes, n: int, row: tuple[int, bytes], at: int) -> None:
        name = hashlib.blake2b(raw, digest_size=16).digest()
        if name in self.seen:
            if self.seen[name]:
                self.known(*self.seen[name])
                self.seen[name] = None
            self.known(row, at, len(raw))
            return
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        self.seen[name] = (row, at, len(raw))
        h1, h2 = int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)
        self.rows.append([least, h1, h2, n, raw, *row, at])

    def known(self, row: tuple[int, bytes], at: int, size: int) -> None:
        last = self.last
        if last and (last[5], last[6]) == row and last[7] <= at <= last[7] + last[3]:  # runs on, as in a periodic text
            last[3] = max(last[3], at + size - last[7])
        else:
            self.last = [None, None, None, size, None, *row, at]
            self.rows.append(self.last)

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows))
        self.rows, self.last = [], None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["least", "h1", "h2", "n", "text", "id", "h", "at"])


def _segments(docs: DataFrame, store: str, buckets: int) -> DataFrame:
    """Runs of suffixes that can be repeated, with equal least hashes: their number, their bytes, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        out = _Segments()
        for batch in batches:
            ids, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, off = utf8(batch.column(2))
            texts = []
            for r, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                if z - a >= LENGTH:
                    for b in range(0, z - a, 1 << 20):
                        part = data[a + b : min(z, a + b + (1 << 20) + LENGTH - 1)]
                        h = fixed_hash(part, WINDOW)
                        at = np.flatnonzero(_FILTER_ON[(np.arange(len(h)) + b) % FILTER_V])
                        texts.append((r, b, part, h[at], at))
            if not texts:
                continue
            keys = np.concatenate([t[3] for t in texts])
            order = np.argsort(keys)
            hit = np.empty(len(keys), bool)
            hit[order] = _store_keys(store, buckets, cache, keys[order])
            done = 0
            for r, b, part, h, at in texts:
                q = at[hit[done : done + len(at)]]
                done += len(at)
                if not len(q):
                    continue
                mark = np.zeros(len(part) + 1, np.int32)
                lo, hi = np.maximum(q + WINDOW - LENGTH, 0), np.minimum(q, min(len(part) - LENGTH, (1 << 20) - 1)) + 1
                np.add.at(mark, lo[hi > lo], 1)
                np.add.at(mark, hi[hi > lo], -1)
                on = np.cumsum(mark) > 0
                flips = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]])))
                for x, y in flips.reshape(-1, 2).tolist():
                    piece = part[x : y + LENGTH - 1]
                    least = sliding_least(fixed_hash(piece, CORE), LENGTH - CORE + 1)
                    cuts = np.append(np.flatnonzero(np.append(True, least[1:] != least[:-1])), len(least)).tolist()
                    for c, e in zip(cuts, cuts[1:]):
                        out.add(int(least[c].view(np.int64)), piece[c : e + LENGTH - 1].tobytes(), e - c, (ids[r], names[r]), b + x + c)
            if out.rows:
                yield out.batch()

    return docs.mapInArrow(run, SEGMENTS)


def finer(text: np.ndarray, step: int) -> list[tuple[int, int, int]]:
    """Deals the suffixes of a segment out again: (key, first, end) of runs whose least string lies in the same block of places.

    A suffix of LENGTH bytes with its least string at offset o has block o // step. All suffixes of the block hold the same
    LENGTH + 1 - step bytes around the string, whose hash with the block is the key.
    """
    n = len(text) - LENGTH + 1
    h = fixed_hash(text, CORE)
    least = np.flatnonzero(h == sliding_least(h, LENGTH - CORE + 1)[0])
    where = least[np.searchsorted(least, np.arange(n))]
    block = (where - np.arange(n)) // step
    cuts = np.append(np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (block[1:] != block[:-1]))), n).tolist()
    shared = fixed_hash(text, LENGTH + 1 - step)
    return [(int(mix(shared[where[c] - block[c] * step : where[c] - block[c] * step + 1] + U64(block[c] + 1))[0].view(np.int64)), c, e) for c, e in zip(cuts, cuts[1:])]


def _finer_segments(hot: DataFrame, step: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Segments()
        for batch in batches:
            for raw, number, name, at in zip(*(c.to_pylist() for c in batch.columns)):
                for key, c, e in finer(np.frombuffer(raw, np.uint8), step):
                    out.add(key, raw[c : e + LENGTH - 1], e - c, (number, name), at + c)
            if out.rows:
                yield out.batch()

    return hot.select("text", "id", "h", "at").mapInArrow(run, SEGMENTS)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments in the order of their groups: the byte ranges that repeated strings cover, in one place of each segment."""
    names: dict[tuple[int, int], int] = {}
    group: list[tuple] = []
    size, last = 0, None

    def sort() -> pa.RecordBatch:
        raw, ids, hashes, ats = zip(*group)
        sizes = np.array([len(x) for x in raw])
        base = np.cumsum(sizes) - sizes
        n = sizes - LENGTH + 1
        dup = repeated_starts(np.frombuffer(b"".join(raw), np.uint8), ragged(base, n))
        edge = np.cumsum(n) - n
        who, lo, hi = [], [], []
        for k in range(len(raw)):
            flips = np.flatnonzero(np.diff(np.concatenate([[False], dup[edge[k] : edge[k] + n[k]], [False]])))
            for a, z in flips.reshape(-1, 2).tolist():
                who.append(k)
                lo.append(ats[k] + a)
                hi.append(ats[k] + z + LENGTH - 1)
        return pa.record_batch([pa.array([ids[k] for k in who], pa.int64()), pa.array([hashes[k] for k in who], pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["id", "h", "lo", "hi"])

    for batch in batches:
        least, h1, h2, ids, hashes, ats = (batch.column(i).to_pylist() for i in (0, 1, 2, 5, 6, 7))
        for i in range(len(least)):
            if least[i] != last:  # groups of one least hash stay together
                names.clear()
                if size > TEXT_BYTES:
                    yield sort()
                    group, size = [], 0
            last = least[i]
            if (h1[i], h2[i]) not in names:
                names[h1[i], h2[i]] = 1
                group.append((batch.column(4)[i].as_py(), ids[i], hashes[i], ats[i]))
                size += len(group[-1][0])
    if group:
        yield sort()


def _runs(spark: SparkSession, segments: DataFrame, parts: int, hot_bytes: int, steps: tuple[int, ...], broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """RUNS: the byte ranges that repeated strings cover."""
    segments = saved(spark, segments, "segments")
    names = ["least", "h1", "h2"]
    texts = segments.where("text is not null")
    spread = texts.groupBy(*names).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*names)  # at most one from each task
    whole = segments.where("text is null").select("id", "h", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
    whole = whole.unionByName(texts.select(*names, "n", "id", "h", "at").join(spread, names, "left_semi").select("id", "h", F.col("at").alias("lo"), (F.col("at") + F.col("n") + LENGTH - 1).alias("hi")))
    if steps:
        weight = texts.groupBy("least").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > hot_bytes)
        hot = saved(spark, weight.select("least"), "hot-groups")
        n_hot = hot.count()
        if n_hot:
            key = F.broadcast(hot) if n_hot <= broadcast_groups else hot
            one = texts.join(key, "least", "left_semi").groupBy(*names).agg(*[F.first(c).alias(c) for c in ("text", "id", "h", "at")])
            whole = whole.unionByName(_runs(spark, _finer_segments(one, steps[0]), parts, hot_bytes, steps[1:], broadcast_groups))
            texts = texts.join(key, "least", "left_anti").select(*segments.columns)
    dealt = texts.repartition(min(parts, 8 * FILES), "least").sortWithinPartitions("least", "h1", "h2")
    return whole.unionByName(dealt.mapInArrow(_repeats, RUNS))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed byte ranges as flat start, end pairs, and the bytes kept, for each row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Tells rows of one text apart, next to its digest.
    number = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    docs = docs.withColumn("number", F.coalesce(number, F.lit(NO_ID)))
    docs = docs.withColumn("h", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    buckets = buckets_for(docs)
    tables = min(buckets, FILES)
    long_enough = docs.where(F.octet_length("text") >= LENGTH).select(F.col("number").alias("id"), "h", "text")

    # Texts that occur more than once, with the row that stands for them.
    copies, repeats = (mounted(shared_dir(spark, name)) for name in ("copies", "repeats"))
    write_table(long_enough.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("stands")).where("m > 1").select("h", "stands"), copies, tables)

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            ids, keep = batch.column(0).to_numpy(), np.ones(batch.num_rows, bool)
            for i, (stands,) in table_rows(copies, tables, cache, _halves(batch.column(1)), 1).items():
                keep[i] = ids[i] == stands[0]
            yield batch.filter(pa.array(keep))

    one = long_enough.mapInArrow(stand, "id long, h binary, text string")
    store = _repeated_windows(one.select("text"), buckets)
    write_table(_runs(spark, _segments(one, store, buckets), buckets, hot_bytes, STEPS, broadcast_groups).select("h", "id", "lo", "hi"), repeats, tables)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            key = _halves(batch.column(1))
            whole, runs = table_rows(copies, tables, cache, key, 1), table_rows(repeats, tables, cache, key, 3)
            rows: list[tuple] = []
            for i, (number, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                data = text.encode()
                spans = _union(runs[i][1:, runs[i][0] == number]) if i in runs else []
                rows.append(_cut(data, [(0, len(data))] if i in whole else spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return docs.select("doc_id", "h", "text", "number").mapInArrow(cut, id_schema(docs, SCHEMA))


def _union(runs: np.ndarray) -> list[tuple[int, int]]:
    """Rows of starts and ends as ordered ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(*runs.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, list[int], bytes]:
    kept, at = [], 0
    for a, z in spans:
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    return len(data), sum(z - a for a, z in spans), len(spans), [x for s in spans for x in s], b"".join(kept)
