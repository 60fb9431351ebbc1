"""Benchmark decontamination by winnowing.

Texts become lower-case words. Of every ``window`` consecutive ``k``-word hashes the least is kept, on both
sides alike, so any span of ``k + window - 1`` words that a document shares with an item leaves a common
fingerprint at the same place of the span. Fingerprints of documents and items are joined; each hit is then
extended word by word in both directions and counts when the common run has ``span`` words. Runs are confirmed
on the bytes of the words, so hashes decide nothing alone. Items shorter than a span are one window each and
are looked up by hashes of exactly their length.

The items' index goes to every worker when the items' texts have at most ``BROADCAST_BYTES``; beyond that the
fingerprints are joined by a shuffle, and each document is checked against the items that it met there. Of items
shorter than a span only the lengths that occur (nine at most) give hashes on the documents' side, each hash once in a
document. Fingerprints meet items with equal texts once for all of them, and AQE splits those that very many documents have.

Defined cases: null and empty texts have no words; such an item is never found. Items with equal texts all
count. A null id is kept; repeated rows each get a row, and texts, not ids, tell
documents apart in the join. Very long texts are read whole. Only ids and texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.llm.blocks import arrow_batches, id_schema
from kilnwork.llm.textscan import ALNUM, LOWER, grams, slices, span_hash, utf8, words

K, WINDOW, SPAN = 5, 6, 10
#: Bytes of all items' texts up to which their index is broadcast, and rows of the item table likewise.
BROADCAST_BYTES, BROADCAST_ITEMS = 32 << 20, 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<long>"


def winnow(codes: np.ndarray, off: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of word hashes in rows ``off``, and the positions where their k words begin."""
    g = grams(codes, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n)
    best = g[:n].copy()
    for j in range(1, window):
        better = g[j : j + n] <= best
        best[better] = g[j : j + n][better]
        at[better] = np.flatnonzero(better) + j
    row_end = np.repeat(off[1:], np.diff(off))[:n]
    keep = np.zeros(len(g), bool)
    keep[at[np.arange(n) + k + window - 1 <= row_end]] = True
    at = np.flatnonzero(keep)
    return g[at], at


class ItemIndex:
    """The items' words, the fingerprints of long items and the whole hashes of short ones."""

    def __init__(self, items: Iterable[tuple[object, str | None]], k: int = K, window: int = WINDOW, span: int = SPAN):
        items = [(str(i), t or "") for i, t in items if i is not None]
        self.k, self.window, self.span = k, window, span
        self.ids = [i for i, _ in items]
        data, off = utf8(pa.array([t for _, t in items], pa.large_string()))
        self.data = LOWER[data]
        self.starts, self.ends, self.off = words(self.data, off, ALNUM)
        self.codes = span_hash(self.data, self.starts, self.ends)
        fp, at = winnow(self.codes, self.off, k, window)
        order = np.argsort(fp, kind="stable")
        self.fp, self.at = fp[order], at[order]
        self.item_of = np.repeat(np.arange(len(items)), np.diff(self.off))
        sizes = np.diff(self.off)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, span):
            mine = np.flatnonzero(sizes == n)
            if len(mine):
                h = grams(self.codes, n)[self.off[mine]]
                order = np.argsort(h, kind="stable")
                self.short[n] = h[order], mine[order]

    def check(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[set[int], list[tuple[int, int]]]]]:
        """Word counts of each row, and for rows with hits the items and the hit word runs (start, end)."""
        data = LOWER[data]
        starts, ends, row = words(data, off, ALNUM)
        codes = span_hash(data, starts, ends)
        found: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}

        def same(i: int, j: int, n: int) -> bool:
            return all(data[starts[i + m] : ends[i + m]].tobytes() == self.data[self.starts[j + m] : self.ends[j + m]].tobytes() for m in range(n))

        def add(r: int, item: int, a: int, z: int) -> None:
            got = found.setdefault(r, (set(), []))
            got[0].add(item)
            got[1].append((a - int(row[r]), z - int(row[r])))

        def ranges(h: np.ndarray, index: np.ndarray) -> Iterator[tuple[int, int, int]]:
            lo, hi = np.searchsorted(index, h), np.searchsorted(index, h, "right")
            for x in np.flatnonzero(hi > lo).tolist():
                yield x, int(lo[x]), int(hi[x])

        if len(self.fp) and len(codes):
            fp, at = winnow(codes, row, self.k, self.window)
            rows = np.searchsorted(row, at, "right") - 1
            done: dict[tuple[int, int, int], int] = {}
            for x, lo, hi in ranges(fp, self.fp):
                p, r = int(at[x]), int(rows[x])
                for q in self.at[lo:hi].tolist():
                    item = int(self.item_of[q])
                    line = (r, item, p - q)
                    if done.get(line, -1) >= p + self.k:
                        continue
                    i0, i1 = int(self.off[item]), int(self.off[item + 1])
                    back, ahead = min(p - int(row[r]), q - i0), min(int(row[r + 1]) - p, i1 - q)
                    unlike = np.flatnonzero(codes[p - back : p] != self.codes[q - back : q])
                    a = p - back + (int(unlike[-1]) + 1 if len(unlike) else 0)
                    unlike = np.flatnonzero(codes[p : p + ahead] != self.codes[q : q + ahead])
                    z = p + (int(unlike[0]) if len(unlike) else ahead)
                    done[line] = z
                    if z - a >= self.span and same(a, a - p + q, z - a):
                        add(r, item, a, z)
        for n, (index, items) in self.short.items():
            h = grams(codes, n)
            fits = np.flatnonzero(np.arange(len(h)) + n <= np.repeat(row[1:], np.diff(row))[: len(h)])
            for x, lo, hi in ranges(h[fits], index):
                p = int(fits[x])
                for item in items[lo:hi].tolist():
                    if same(p, int(self.off[item]), n):
                        add(int(np.searchsorted(row, p, "right")) - 1, item, p, p + n)
        return np.diff(row), found


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _rows(ids: pa.Array, counts: np.ndarray, found: dict, names: list[str], *more: pa.Array) -> pa.RecordBatch:
    hit, items, spans = [], [], []
    for r in range(len(ids)):
        got = found.get(r)
        runs = _union(got[1]) if got else []
        hit.append(sum(z - a for a, z in runs))
        items.append(sorted({names[i] for i in got[0]}) if got else [])
        spans.append([x for run in runs for x in run])
    return pa.record_batch([ids, pa.array(counts.astype(np.int64)), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64())), *more], names=["doc_id", "n_words", "n_hit", "items", "spans", "row"][: 5 + len(more)])


def decontaminate(docs: DataFrame, tests: DataFrame, k: int = K, window: int = WINDOW, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, broadcast_items: int = BROADCAST_ITEMS, passed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items found (as strings, sorted) and their hit word runs as flat start, end pairs; ``passed`` adds the columns of ``docs`` as struct ``row``."""
    if k + window - 1 != span:
        raise ValueError("k + window - 1 must be the span that is guaranteed")
    spark = docs.sparkSession
    arrow_batches(spark)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if passed else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    schema = T.StructType([*id_schema(docs, SCHEMA), *([docs.schema["row"]] if passed else [])])
    own = lambda batch: [batch.column(batch.schema.names.index("row"))] if passed else []
    tests = tests.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id is not null")
    size, n = tests.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)), F.count(F.lit(1))).first()
    if size <= broadcast_bytes and n <= broadcast_items:
        shared = spark.sparkContext.broadcast([tuple(r) for r in tests.collect()])  # bounded just above

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, k, window, span)
            for batch in batches:
                data, off = utf8(batch.column(1))
                for a, z, part, part_off in slices(data, off):
                    counts, found = index.check(part, part_off)
                    yield _rows(batch.column(0).slice(a, z - a), counts, found, index.ids, *(x.slice(a, z - a) for x in own(batch)))

        return docs.mapInArrow(check, schema)

    def marks(of_items: bool, lengths: list[int]):
        """(key, fingerprint, length) of the winnowed hashes of each text, and of its windows of these lengths, each once."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = utf8(batch.column(1))
                for a, _, part, part_off in slices(data, off):
                    part = LOWER[part]
                    starts, ends, row = words(part, part_off, ALNUM)
                    codes = span_hash(part, starts, ends)
                    fp, at = winnow(codes, row, k, window)
                    got = [(fp, at, 0)]
                    for n in lengths:
                        h = grams(codes, n)
                        p = np.arange(len(h))
                        r = np.searchsorted(row, p, "right") - 1
                        fits = (row[r + 1] - row[r] == n) & (p == row[r]) if of_items else p + n <= row[r + 1]
                        got.append((h[fits], p[fits], n))
                    for h, p, n in got:
                        owner = np.searchsorted(row, p, "right") - 1
                        order = np.lexsort((h, owner))
                        h, owner = h[order], owner[order]
                        once = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
                        ids = batch.column(0).take(pa.array(owner[once] + a))
                        yield pa.record_batch([ids, pa.array(h[once].view(np.int64)), pa.array(np.full(int(once.sum()), n, np.int32))], names=["key", "fp", "n"])

        return emit

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            yield pa.record_batch([pa.array(np.unique(np.minimum(np.diff(words(data, off, ALNUM)[2]), span)), pa.int64())], names=["n"])

    name = lambda text: F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    lengths = sorted(r.n for r in tests.select("item_text").mapInArrow(sizes, "n long").distinct().collect() if 0 < r.n < span)
    items = tests.groupBy(name(F.col("item_text")).alias("item_key")).agg(F.first("item_text").alias("item_text"), F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    named = docs.withColumn("key", name(F.col("text")))
    left = named.select("key", "text").mapInArrow(marks(False, lengths), "key binary, fp long, n int")
    right = items.select("item_key", "item_text").mapInArrow(marks(True, lengths), "key binary, fp long, n int").select(F.col("key").alias("item_key"), "fp", "n")
    met = left.join(right, ["fp", "n"]).select(F.col("key").alias("met_key"), "item_key").distinct()
    met = met.join(items, "item_key").groupBy("met_key").agg(F.collect_list(F.struct("item_ids", "item_text")).alias("met"))
    pairs = named.join(met, F.col("key") == F.col("met_key"), "left").select("doc_id", "text", "met", *["row"] * passed)

    def check_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, met_items in enumerate(batch.column(2).to_pylist()):
                index = ItemIndex([(i, x["item_text"]) for x in met_items or () for i in x["item_ids"]], k, window, span)
                data, off = utf8(batch.column(1).slice(r, 1))
                yield _rows(batch.column(0).slice(r, 1), *index.check(data, off), index.ids, *(x.slice(r, 1) for x in own(batch)))

    return pairs.mapInArrow(check_own, schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: DuckDB: the rows of op2_decontaminate.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, unnest(range(1, CAST(greatest(len(w) - 9, 1) AS BIGINT) + 1)) AS p, least(len(w), 10) AS n, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM iw),
dp AS (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 1 AS BIGINT) + 1)) AS p FROM d, (SELECT DISTINCT n FROM win) x WHERE len(w) >= n),
dw AS (SELECT r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM dp),
h AS (SELECT r, p, dw.n, item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
