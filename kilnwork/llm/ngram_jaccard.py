"""Which documents have nearly the same set of word n-grams: a Jaccard join, exact over hashed n-grams.

1. Every document's distinct n-gram hashes are counted over the corpus (blocks, merged by bucket); those that
   occur more than once go, with their counts, to sorted arrays in the shared folder that workers map.
2. With rare n-grams first and the hash as tie-breaker, two sets that reach the threshold share one of their
   first ``n - ceil(t * n) + 1`` n-grams. N-grams of one document alone come first, so a set with enough of
   them has no partner and is done. The others, a small part, give their first repeated n-grams as keys. The smaller
   of two such sets has the first n-gram they share among its first ``n - ceil(2 * t / (1 + t) * n) + 1``, so a key connects only sets
   one of which has it there: rows of a template that differ in a word are strangers unless they can reach the threshold.
3. Equal sets are one class by a 128-bit sum. Classes connected by keys form families; a family is one tile if it has at most
   ``part_elements`` n-grams and ``part_sets`` sets, so that a tile's pairs are bounded, too.
   In a large one, all members are first compared with one of them, its largest; those that link with it are connected
   and need no comparison among themselves. The family is then cut into bands of set size and parts, the connected
   members apart from the open ones, and any two parts with open members whose sizes can reach the threshold are a tile.
   So a family of near copies costs in proportion to its size. Families are dealt out as names and sizes; sets meet
   their tile by their own name, and a worker holds one tile, of no more than two parts, at a time.
4. In a tile, each set has a bitmap to whose bits its hashes are added without carry. Bits that differ can't
   outnumber the elements that differ, so counting them bounds the overlap from above; only pairs that pass,
   and aren't connected yet, are intersected as sorted arrays. The tile gives the links that connect.
5. Components of the links, and the least document of each.

Nothing is capped: a frequent passage only moves its n-grams to the end of the order, and copies of one text
are one class from the first task on.

Defined cases: fewer words than n make one n-gram of all words; without words the set is empty and linked with
nothing. Rows with the same id each get a row. A null id has the component of its class, or null if that has
no known id. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.llm.blocks import BLOCK_SCHEMA, FILES, Appended, arrow_batches, block_batch, buckets_for, by_bucket, exchange, file_of, gather, home, mapped, mounted, pack, saved, shared_dir
from kilnwork.llm.components import components
from kilnwork.llm.textscan import LOWER, NOT_SPACE, U64, distinct, grams, mix, slices, span_hash, utf8, words

#: Elements and sets in a part of a large family: a tile of two parts compares 2 ** 26 pairs at most.
PART_ELEMENTS, PART_SETS = 1 << 20, 1 << 13
#: Classes that a task remembers, so that it counts copies of one text once.
REMEMBERED = 100_000
SETS = "n long, a long, b long, elements binary, keys array<long>, early int"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, joined; their offsets; two 64-bit sums that name each set."""
    data = LOWER[data]
    starts, ends, row = words(data, off, NOT_SPACE)
    codes = span_hash(data, starts, ends)
    n = len(off) - 1
    size = np.diff(row)
    g = grams(codes, k)
    owner = np.repeat(np.arange(n), size)[: len(g)]
    whole = np.arange(len(g)) + k <= row[owner + 1]
    g, owner = g[whole], owner[whole]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        one = np.array([grams(codes[row[r] : row[r + 1]], int(size[r]))[0] for r in short], U64)
        g, owner = np.append(g, mix(one + size[short].astype(U64))), np.append(owner, short)
    order = np.argsort(g)
    kind = np.int16 if n < 1 << 15 else np.int64
    order = order[np.argsort(owner[order].astype(kind), kind="stable")]
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    at = np.searchsorted(owner, np.arange(n + 1))
    sums = []
    for seed in (U64(0x2545F4914F6CDD1D), U64(0x9E6C63D0876A3F25)):
        run = np.zeros(len(g) + 1, U64)
        np.cumsum(mix(g ^ seed), out=run[1:])
        sums.append(run[at[1:]] - run[at[:-1]])
    return g, at, sums[0], sums[1]


def _merge_counts(cols: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(cols[0])
    keys = cols[0][order]
    first, _ = distinct(keys)
    return [keys[first], np.add.reduceat(cols[1][order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)]


def repeated_store(docs: DataFrame, k: int, buckets: int, files: int = FILES) -> str:
    """A folder of sorted arrays of the n-gram hashes that more than one document has, with their counts."""
    path = mounted(shared_dir(docs.sparkSession, "repeated-ngrams"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        parts: list[np.ndarray] = []
        fresh = 0

        def send() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(parts))
            first, n = distinct(keys)
            keys = keys[first]
            order, ends = by_bucket(keys, home(keys, buckets, files), buckets)
            cols = [keys[order], np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32)]
            return block_batch([row for b in np.flatnonzero(np.diff(ends)).tolist() for row in pack(b, [x[ends[b] : ends[b + 1]] for x in cols], 12)])

        for batch in batches:
            data, off = utf8(batch.column(0))
            for _, _, part, part_off in slices(data, off):
                g, at, a, second = shingle_sets(part, part_off, k)
                keep = []
                for r, name in enumerate(zip(a.tolist(), second.tolist())):
                    if name not in seen:
                        seen.add(name)
                        keep.append(g[at[r] : at[r + 1]])
                if len(seen) > REMEMBERED:
                    seen.clear()
                parts += keep
                fresh += sum(map(len, keep))
                if fresh > 3 << 20:
                    yield send()
                    parts, fresh = [], 0
        if parts:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = [], Appended()
        for _, (keys, n) in gather(batches, [U64, np.uint32], _merge_counts):
            f = int(file_of(keys[:1], buckets, files)[0])
            out.add(f"{path}/{f}.keys", keys[n > 1])
            out.add(f"{path}/{f}.counts", np.minimum(n[n > 1], 0xFFFFFFFF).astype(np.uint32))
            rows.append(len(keys))
        out.done()
        yield pa.record_batch([pa.array(rows, pa.int64())], names=["n"])

    exchange(docs.select("text").mapInArrow(count, BLOCK_SCHEMA), buckets, files).mapInArrow(merge, "n long").agg(F.sum("n")).collect()
    return path


def needed(n: np.ndarray | int, t: int):
    """The least overlap that a set of size n has with any set that it links with: ceil(t% of n)."""
    return -(-n * t // 100)


def needed_of_larger(n: np.ndarray | int, t: int):
    """The least overlap that a set of size n has with any set at least as large that it links with."""
    return -(-2 * n * t // (100 + t))


def keyed_sets(docs: DataFrame, store: str, buckets: int, k: int, percent: int, files: int = FILES) -> DataFrame:
    """Each row's set size and name; for one row of each class in a task that can have partners, the set, its keys and how many of them come early enough to find larger partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str, np.ndarray | None] = {}
        seen: set[tuple[int, int]] = set()

        def counts_of(keys: np.ndarray) -> np.ndarray:
            """For sorted keys: their counts, 1 if only one document has them."""
            out = np.ones(len(keys), np.int64)
            n_files = min(buckets, files)
            order, ends = by_bucket(keys, file_of(keys, buckets, files), n_files)
            for b in np.flatnonzero(np.diff(ends)).tolist():
                mine = order[ends[b] : ends[b + 1]]
                have = mapped(maps, f"{store}/{b}.keys", U64)
                if have is not None:
                    at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
                    hit = have[at] == keys[mine]
                    out[mine[hit]] = mapped(maps, f"{store}/{b}.counts", np.uint32)[at[hit]]
            return out

        for batch in batches:
            data, off = utf8(batch.column(1))
            for first, last, part, part_off in slices(data, off):
                g, at, a, b = shingle_sets(part, part_off, k)
                order = np.argsort(g)
                df = np.empty(len(g), np.int64)
                df[order] = counts_of(g[order])
                n = np.diff(at)
                lone = np.zeros(len(g) + 1, np.int64)
                np.cumsum(df == 1, out=lone[1:])
                lone = lone[at[1:]] - lone[at[:-1]]
                prefix = n - needed(n, percent) + 1
                early = np.maximum(0, np.minimum(prefix, n - needed_of_larger(n, percent) + 1) - lone)
                sets: list[bytes | None] = [None] * len(n)
                keys: list[np.ndarray | None] = [None] * len(n)
                for r in np.flatnonzero((n > 0) & (lone < prefix)).tolist():
                    name = (int(a[r]), int(b[r]))
                    if name in seen:
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    x, c = g[at[r] : at[r + 1]], df[at[r] : at[r + 1]]
                    rare = np.lexsort((x, c))[lone[r] : prefix[r]]
                    sets[r], keys[r] = x.tobytes(), x[rare].view(np.int64)
                yield pa.record_batch(
                    [batch.column(0).slice(first, last - first), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(early.astype(np.int32))],
                    names=["doc_id", "n", "a", "b", "elements", "keys", "early"],
                )

    kinds = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(SETS)])
    return docs.mapInArrow(run, kinds)


def _tile_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets among ``left`` x ``right`` (both flags for a tile of one part)."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, left, right = size[order], left[order], right[order]
    bits = 256
    while bits < min(8192, 4 * int(size[-1])):
        bits *= 2
    bitmap = np.zeros((len(sets), bits // 64), U64)
    for i, o in enumerate(order.tolist()):
        spot, count = np.unique((sets[o] >> U64(20)) % U64(bits), return_counts=True)
        spot = spot[count % 2 == 1].astype(np.int64)
        np.bitwise_or.at(bitmap[i], spot >> 6, U64(1) << (spot & 63).astype(U64))
    group = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        z = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        j = np.arange(i + 1, z)
        j = j[(group[i + 1 : z] != group[i]) & ((left[i] & right[i + 1 : z]) | (right[i] & left[i + 1 : z]))]
        if not len(j):
            continue
        unlike = np.bitwise_count(bitmap[j] ^ bitmap[i]).sum(1, dtype=np.int64)
        both = size[i] + size[j]
        # 100 * overlap >= percent * union, with overlap + union = both
        j = j[(both - unlike) // 2 * (100 + percent) >= percent * both]
        x = sets[order[i]]
        for m in j.tolist():
            if group[m] == group[i]:
                continue
            y = sets[order[m]]
            at = np.searchsorted(y, x)
            overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if overlap * (100 + percent) >= percent * (len(x) + len(y)):
                links.append((int(order[i]), int(order[m])))
                group[group == group[m]] = group[i]
    return links


LINKS = "a long, b long, a2 long, b2 long"
#: Bytes of the sets with which large families are compared, up to which they are broadcast.
PIVOT_BYTES = 64 << 20
#: Bands of large families up to which their layout is broadcast.
BROADCAST_BANDS = 100_000


def _linked_pairs(percent: int):
    """Keeps the names of pairs of sets that link, from rows (a, b, set, a2, b2, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(5)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (s, t))
                at = np.searchsorted(y, x)
                overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(overlap * (100 + percent) >= percent * (len(x) + len(y)))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 3, 4])

    return run


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", part_elements: int = PART_ELEMENTS, part_sets: int = PART_SETS, files: int = FILES, pivot_bytes: int = PIVOT_BYTES, broadcast_bands: int = BROADCAST_BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = buckets_for(docs, files=files)
    store = repeated_store(docs, k, buckets, files)
    rows = saved(spark, keyed_sets(docs, store, buckets, k, percent, files), "sets")

    named = rows.where("elements is not null").select(F.struct("a", "b").alias("c"), "n", "elements", "keys", "early")
    classes = saved(spark, named.groupBy("c").agg(F.first(F.struct("n", "elements", "keys", "early")).alias("s")).select("c", "s.*"), "classes")
    keyed = classes.select("c", "n", "early", F.posexplode("keys").alias("at", "key"))
    least = F.min(F.when(F.col("at") < F.col("early"), F.struct("n", "c")))
    heads = keyed.groupBy("key").agg(least.alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1 and head is not null")
    edges = keyed.join(heads, "key").where("n >= head.n").select(F.col("c").alias("u"), F.col("head.c").alias("v"))
    families = components(edges)

    # Members of large families are first compared with one of theirs; those that link with it are done among themselves.
    members = families.select(F.col("node").alias("c"), "root").join(classes.select("c", "n"), "c")
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("sets"))
    members = saved(spark, members.join(weight, "root"), "members")
    is_large = (F.col("weight") > part_elements) | (F.col("sets") > part_sets)
    large = members.where(is_large)
    pivots = large.groupBy("root").agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("pivot")).join(classes.select(F.col("c").alias("pivot"), F.col("elements").alias("against")), "pivot")
    pivots = saved(spark, pivots, "pivots")
    size = pivots.agg(F.coalesce(F.sum(F.octet_length("against")), F.lit(0))).first()[0]
    beside = F.broadcast(pivots) if size <= pivot_bytes else pivots
    compared = large.select("c", "root").join(classes.select("c", "elements"), "c").join(beside, "root").where("c <> pivot")
    near = saved(spark, compared.select("c.a", "c.b", "elements", F.col("pivot.a").alias("a2"), F.col("pivot.b").alias("b2"), "against").mapInArrow(_linked_pairs(percent), LINKS), "pivot-links")

    # Parts of large families: bands of set size, a ratio over the threshold's apart, so partners lie at most a band apart;
    # those that are done apart from those still open, as two that are done need no comparison.
    done = near.select(F.struct("a", "b").alias("c"), F.lit(True).alias("done")).unionByName(pivots.select(F.col("pivot").alias("c"), F.lit(True).alias("done")))
    banded = large.join(done, "c", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    banded = banded.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(100.1 / percent)))).cast("int"))
    split = banded.groupBy("root", "done", "band").agg(F.ceil(F.greatest(F.sum("n") / part_elements, F.count(F.lit(1)) / part_sets)).cast("int").alias("parts"))
    around = F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band")
    facing = split.select("root", F.explode(F.when(F.col("done"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("to_done"), F.struct(F.col("done").alias("k"), F.col("band").alias("b"), F.col("parts").alias("p")).alias("other"), "band")
    facing = facing.select("root", F.col("to_done").alias("done"), "other", around).groupBy("root", "done", "band").agg(F.collect_set("other").alias("others"))
    layout = saved(spark, split.join(facing, ["root", "done", "band"]), "layout")  # a row for each band of a large family
    placed = banded.join(F.broadcast(layout) if layout.count() <= broadcast_bands else layout, ["root", "done", "band"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    mine = F.struct(F.col("done").alias("k"), F.col("band").alias("b"), F.col("part").alias("p"))
    others = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["p"] - 1), lambda i: F.struct(o["k"].alias("k"), o["b"].alias("b"), i.cast("int").alias("p")))))
    tiled = placed.select("c", "root", mine.alias("mine"), F.explode(others).alias("other"))
    name = F.concat_ws(":", F.col("root.a"), F.col("root.b"))
    whole = members.where(~is_large).select("c", name.alias("tile"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    tiled = tiled.select("c", F.concat_ws(":", name, F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string")).alias("tile"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles come one after the other, so one is in memory at a time."""
        last, members = None, []

        def found() -> pa.RecordBatch:
            pairs = _tile_links([m[2] for m in members], np.array([m[3] for m in members]), np.array([m[4] for m in members]), percent) if len(members) > 1 else []
            out = [(*members[i][:2], *members[j][:2]) for i, j in pairs]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["a", "b", "a2", "b2"])

        for batch in batches:
            for a, b, s, tile, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != last and members:
                    yield found()
                    members = []
                last = tile
                members.append((a, b, np.frombuffer(s, U64), left, right))
        if members:
            yield found()

    spread = whole.unionByName(tiled).join(classes.select("c", "elements"), "c").select("c.a", "c.b", "elements", "tile", "left", "right").repartition(min(buckets, 8 * FILES), "tile").sortWithinPartitions("tile")
    links = spread.mapInArrow(link, LINKS).unionByName(near)
    joined = components(links.select(F.struct("a", "b").alias("u"), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")).alias("v")))

    own = rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("m"))
    linked = own.join(joined.select("node.a", "node.b", "root"), ["a", "b"], "left")
    lowest = linked.where("root is not null").groupBy("root").agg(F.min("low").alias("lowest"))
    named = linked.where("root is not null or m > 1").join(lowest, "root", "left").select("a", "b", F.coalesce("lowest", "low").alias("component"))
    out = rows.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))
