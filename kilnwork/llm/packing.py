"""Packing token sequences into windows by the sum-of-squares rule, in one pass over each partition.

A document's ids, with an end id, are cut at whole windows; what is left over is placed as it arrives. ``levels[f]`` counts the
open windows that hold ``f`` ids; the place taken, an open window or a new one, is the one that leaves the least sum of the squares of
these counts (a full window counts for nothing). So windows come to an exact fill, and only a few hundred are open at a time. Where
a partition ends, or more than ``MAX_OPEN`` windows are open because its lengths don't complete each other, what is open
is joined and cut at whole windows. A partition's last ids, fewer than a window, become sequences of powers of two, the layout's
lengths without padding. Nothing is padded then; a window is cut into where it was drained, a few hundred a partition.

There is no shuffle: a task holds its batch, its open windows (at most ``MAX_OPEN`` * 16 KB of ids) and a cache of words.
A lost task gives the same pieces again, as sequence numbers come from the partition and its rows' order.

Ids are the tokenizer's own. Its time goes into texts, of which words repeat: for a tokenizer with the pipeline ``LOWER_WORDS`` a text is split by
bytes at white space, which no token spans; chunks of ASCII and Latin-1 letters, digits and signs are split further as the pipeline's pattern would,
all others stay whole, and each distinct unit is given to the tokenizer once. Units are told by 64-bit hashes within a worker's cache of
``CACHE`` units. Other tokenizers get whole texts.

Defined cases: a null or empty text is the end id alone. Rows with equal or null ids are documents of their own. Other columns are not read.
A very long text is one row of ids, 4 bytes each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.llm.blocks import arrow_batches
from kilnwork.llm.textscan import LOWER, NOT_SPACE, U64, ragged, slices, span_hash, utf8, words

WINDOW, END_ID = 4096, 2
#: Open windows beyond which they are drained, distinct units that a worker remembers, and a unit's bytes to be remembered.
MAX_OPEN, CACHE, LONGEST = 2048, 1 << 20, 1 << 12
#: The pipeline that splitting by bytes stands for.
LOWER_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
LETTER, DIGIT, SIGN, WHOLE = 1, 2, 3, 4
#: Kinds of ASCII bytes; ' begins endings of words and < special tokens, so chunks that hold them stay whole, as do those with bytes of no kind.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
KIND[[0x27, 0x3C]] = WHOLE
KIND[0x7F:] = WHOLE
KIND[:0x20] = WHOLE
KIND[~NOT_SPACE] = 0
#: How a byte-level model writes bytes: printable ones as Latin-1, the others from U+0100 on.
_shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _shown)}


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with letters of split chunks lower-cased, the units' starts, ends and whether they are whole chunks, and the rows' offsets into them."""
    starts, ends, _ = words(data, off, NOT_SPACE)
    kind, low = KIND[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    capital = lead[data[lead + 1] < 0x9F] + 1
    low[capital] += 0x20
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == WHOLE, out=odd[1:])
    whole = odd[ends] > odd[starts]
    inside = ragged(starts[whole], (ends - starts)[whole])
    kind[inside], low[inside] = WHOLE, data[inside]
    first = np.zeros(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first |= kind == DIGIT
    first &= kind > 0
    first[starts] = True
    at = np.flatnonzero(first)
    chunk = np.searchsorted(starts, at, "right") - 1
    return low, at, np.minimum(np.append(at[1:], len(data)), ends[chunk] if len(at) else ends), whole[chunk] if len(at) else whole, np.searchsorted(at, off)


class Ids:
    """Token ids of texts, each distinct unit tokenized once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.split = all(given.get(k) == v for k, v in LOWER_WORDS.items()) and not given.get("truncation") and not given.get("padding") and all(t["content"].startswith("<") and not t["normalized"] for t in given["added_tokens"])
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.length, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def unit(self, text: bytes, whole: bool) -> list[int]:
        if whole or len(text) > LONGEST:
            return self.encode([text.decode()])[0]
        shown = text.decode("latin-1")
        return [t.id for t in self.model.tokenize(shown if shown.isascii() else shown.translate(BYTE_CHARS))]

    def learn(self, keys: np.ndarray, found: list[list[int]]) -> None:
        length = np.array([len(x) for x in found], np.int64)
        start = len(self.flat) + np.cumsum(length) - length
        self.flat = np.append(self.flat, np.array([i for x in found for i in x], np.uint32))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.length = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.length, at, length)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the rows' offsets into them."""
        if not self.split:
            found = self.encode([bytes(data[a:z]).decode() for a, z in zip(off[:-1], off[1:])])
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([0, *map(len, found)])
        low, starts, ends, whole, row = units(data, off)
        keys, example, turn = np.unique(span_hash(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self.learn(keys[new], [self.unit(bytes(low[starts[i] : ends[i]]), whole[i]) for i in example[new].tolist()])
        at = np.searchsorted(self.keys, keys)[turn]
        length = self.length[at]
        run = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=run[1:])
        return self.flat[ragged(self.start[at], length)], run[row]


class Packer:
    """The windows of one partition. A piece is (document, start, ids, the document's ids in all); ``done`` has the sequences that are closed."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.done: list[list[tuple]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.done.append([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        if at < total:
            self.place((doc, at, ids[at:].copy(), total))

    def place(self, piece: tuple) -> None:
        size, w = len(piece[2]), self.window
        held = np.flatnonzero(self.levels[: w - size + 1])
        # Growth of the sum of squares: a window leaves its level (a new one leaves none) and comes to another, a full one to none.
        cost = np.append(np.where(held + size < w, 2 * self.levels[held + size] + 1, 0) - 2 * self.levels[held] + 1, 2 * self.levels[size] + 1)
        best = np.flatnonzero(cost == cost.min())
        level = int(held[best[best < len(held)][-1]]) if best[0] < len(held) else 0  # of equal ones the fullest
        if level:
            seq = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            seq = []
        seq.append(piece)
        self.keep(seq, level + size)
        if self.n_open > self.max_open:
            self.drain()

    def keep(self, seq: list[tuple], level: int) -> None:
        if level == self.window:
            self.done.append(seq)
            return
        self.open.setdefault(level, []).append(seq)
        self.levels[level] += 1
        self.n_open += 1

    def drain(self, last: bool = False) -> None:
        """Open windows, fullest first, are joined and cut into whole windows; the rest stays open or, at the ``last``, becomes powers of two."""
        seqs = [s for level in sorted(self.open, reverse=True) for s in self.open[level]]
        self.levels[:], self.open, self.n_open = 0, {}, 0
        left = sum(len(p[2]) for s in seqs for p in s)
        room = full = min(self.window, 1 << left.bit_length() - 1) if last and left else self.window
        seq: list[tuple] = []
        for doc, start, ids, total in (p for s in seqs for p in s):
            at = 0
            while at < len(ids):
                n = min(room, len(ids) - at)
                seq.append((doc, start + at, ids[at : at + n], total))
                at, room, left = at + n, room - n, left - n
                if not room:
                    self.done.append(seq)
                    seq = []
                    room = full = min(self.window, 1 << left.bit_length() - 1) if last and left else self.window
        if seq:
            self.keep(seq, full - room)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True, max_open: int = MAX_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (null without ``keep_ids``)."""
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Ids(tokenizer), Packer(window, max_open)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        kind = pa.null()

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            done, packer.done = packer.done, []
            names, rows, ids = [], [], []
            for seq in done:
                at = 0
                for doc, start, part, total in seq:
                    names.append(doc)
                    rows.append((start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, number, at))
                    ids.append(part.astype(np.int32) if keep_ids else None)
                    at += len(part)
                number += 1
            if rows:
                cols = np.array(rows, np.int64).T
                yield pa.record_batch([pa.array(names, kind), *map(pa.array, cols), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", *longs, "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            data, off = utf8(batch.column(1))
            for a, z, part, ends in slices(data, off, 2 << 20):
                ids, at = encode(part, ends)
                for i in range(z - a):
                    packer.add(names[a + i], np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
                yield from closed()
        packer.drain(last=True)
        yield from closed()

    return docs.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: pieces with ids put together again, a window at most in each group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
