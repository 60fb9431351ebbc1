"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A text's bag holds its words and the character n-grams of its words (3 to 6 bytes, with the words' ends as
characters), each hashed to a row of an embedding table. The mean of the rows goes through a linear softmax
with two classes. Table and softmax are fitted together by gradient descent with momentum over the whole
sample, with steps that shrink when they overshoot; the gradient reaches every row that a text's bag holds, so a
misspelling never seen before is scored by the n-grams that it shares with words that were. Byte case is folded for A-Z
only. (With two classes, two dimensions say all that a linear softmax can tell apart; more would change nothing.)

Slope and bias of the odds are fitted last, with smoothed targets, so that few toxic rows, too, put the threshold between
the classes as they are scored. Seen on the invented tables, ranking is good from some hundred labels on, but texts held
out reach the threshold only with some thousand.

Fitting takes a bounded sample: at most ``MAX_ROWS`` labelled rows, chosen by a seeded hash of their ids, with
texts of at most ``MAX_BYTES`` bytes, so at most 96 MB reach the one task that fits the model. Scoring reads every text as a whole.

Defined cases: a null or empty text has an empty bag, whose score comes from the bias alone. Labels other
than 0 and 1 and labels without a text are no training rows; with no training rows or a single class every
score is the (smoothed) share of class 1. A null id is kept; repeated rows each get a row. Ids, labels,
languages and sources are never features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.blocks import arrow_batches
from kilnwork.llm.textscan import ALNUM, LOWER, distinct, ragged, row_sums, slices, span_hash, utf8, words

MAX_ROWS, MAX_BYTES = 12_000, 4 << 10
BITS, DIM, SIZES = 18, 2, (3, 4, 5, 6)
ROUNDS, RATE, MOMENTUM, DECAY = 120, 20.0, 0.9, 1e-6
_FOLD = np.where(ALNUM, LOWER, np.uint8(0x20)).astype(np.uint8)
_U = np.uint64
_SHIFT = _U(64 - BITS)


def _line(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words in one line of folded bytes with a blank before and after each, where each word begins and ends in it, and where each text's part begins."""
    starts, ends, row = words(data, off, ALNUM)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths
    line = np.full(int((lengths + 1).sum()) + 1, 0x20, np.uint8)
    line[ragged(at, lengths)] = _FOLD[data[ragged(starts, lengths)]]
    return line, at, at + lengths, np.append(at, len(line))[row] - 1


def _windows(line: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size n: the bytes from each position on as a number, and whether all but the first and the last of them lie in a word."""
    inner = line != 0x20
    wide = line.astype(np.uint64)
    code, solid = wide, np.ones(len(line), bool)
    for n in range(2, max(SIZES) + 1):
        code = code[:-1] | wide[n - 1 :] << _U(8 * (n - 1))
        solid = solid[:-1] & inner[n - 2 : len(line) - 1] if n > 2 else solid[:-1]
        if n in SIZES:
            yield n, code, solid


def _features(line: np.ndarray, at: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, table rows) of the n-grams of each size, then of the words."""
    for n, code, solid in _windows(line):
        p = np.flatnonzero(solid)
        yield p, (code[p] * _U(0x9E3779B97F4A7C15 + 2 * n) >> _SHIFT).astype(np.int64)
    yield at, (span_hash(line, at, ends) >> _SHIFT).astype(np.int64)


def bag(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each text's bag, joined, and the texts' offsets."""
    line, at, ends, text_at = _line(data, off)
    where, ids = (np.concatenate(x) for x in zip(*_features(line, at, ends)))
    order = np.argsort(where, kind="stable")
    return ids[order], np.searchsorted(where[order], text_at)


@dataclass
class Model:
    table: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        """What each row of the table adds to the log odds of class 1, once averaged."""
        return self.table @ (self.softmax[:, 1] - self.softmax[:, 0])

    def odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _sums(local: np.ndarray, ids: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each bag's vector."""
    out = np.empty((len(at) - 1, DIM))
    for a in range(0, len(at) - 1, 500):  # keeps what a round allocates small
        z = min(len(at) - 1, a + 500)
        i, w = ids[at[a] : at[z]], weights[at[a] : at[z]]
        out[a:z] = np.stack([row_sums(local[:, d][i] * w, at[a : z + 1] - at[a]) for d in range(DIM)], 1)
    return out


def _loss(x: np.ndarray, softmax: np.ndarray, bias: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss, and the softmax's errors."""
    z = x @ softmax + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean()
    p[np.arange(len(y)), y] -= 1
    return float(loss), p / len(y)


def scaled(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias that make log odds fit labels, with Platt's smoothed targets, by Newton's steps."""
    many, few = int((y == 0).sum()), int((y == 1).sum())
    if not many or not few:
        return 1.0, 0.0
    target = np.where(y == 1, (few + 1) / (few + 2), 1 / (many + 2))
    spread = max(float(odds.std()), 1e-9)
    x = np.stack([(odds - odds.mean()) / spread, np.ones(len(y))], 1)
    fit = np.array([1.0, np.log(few / many)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * fit)
        fit = fit - np.clip(step, -2, 2)
    slope = max(fit[0], 1e-3) / spread
    return float(slope), float(fit[1] - slope * odds.mean())


def train(texts: list[str | None] | pa.Array, labels: list[int], rounds: int = ROUNDS, rate: float = RATE) -> Model:
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(5)
    table = (rng.standard_normal((1 << BITS, DIM)) * 0.01).astype(np.float32)
    softmax = rng.standard_normal((DIM, 2)) * 0.5
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros_like(table), softmax, bias)
    ids, sizes, weights = [], [], []
    data, off = utf8(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
    for a, z, part, part_off in slices(data, off, 1 << 18):
        h, ends = bag(part, part_off)
        for r in range(z - a):
            u = np.sort(h[ends[r] : ends[r + 1]]).astype(np.int32)
            first, c = distinct(u)
            ids.append(u[first])
            sizes.append(len(first))
            weights.append((c / max(1, c.sum())).astype(np.float32))
    del texts, data
    ids = np.concatenate(ids)
    weights, sizes = np.concatenate(weights), np.array(sizes)
    used = np.flatnonzero(np.bincount(ids, minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    ids = place[ids]
    local = table[used]
    at = np.append(0, np.cumsum(sizes))
    # A step in proportion to the size of a bag's vector, so that short and long texts train alike.
    pace = rate / float((weights.astype(np.float64) ** 2).sum() / len(y))
    speed, swing, lean = np.zeros_like(local), np.zeros_like(softmax), np.zeros(2)
    best = (np.inf, local, softmax, bias)
    for _ in range(rounds):
        x = _sums(local, ids, weights, at)
        loss, wrong = _loss(x, softmax, bias, y)
        if not loss <= best[0] * 1.02:  # a step too long: back to the best so far, with shorter ones
            _, local, softmax, bias = best
            pace /= 2
            speed, swing, lean = np.zeros_like(local), np.zeros_like(softmax), np.zeros(2)
            continue
        if loss < best[0]:
            best = (loss, local, softmax, bias)
            pace *= 1.03
        push = np.zeros(len(used))
        for a in range(0, len(y), 500):
            z = min(len(y), a + 500)
            push += np.bincount(ids[at[a] : at[z]], weights[at[a] : at[z]] * np.repeat(wrong[a:z, 1], sizes[a:z]), len(used))
        # both classes' errors are opposite, so a row's gradient lies along the difference of the classes
        speed = MOMENTUM * speed - pace * np.outer(push, softmax[:, 1] - softmax[:, 0]) - DECAY * local
        swing = MOMENTUM * swing - 0.05 * (x.T @ wrong)
        lean = MOMENTUM * lean - 0.05 * wrong.sum(0)
        local, softmax, bias = (local + speed).astype(np.float32), softmax + swing, bias + lean
    _, local, softmax, bias = best
    z = _sums(local, ids, weights, at) @ softmax + bias
    slope, shift = scaled(z[:, 1] - z[:, 0], y)
    table = np.zeros_like(table)
    table[used] = local
    return Model(table, softmax * slope, np.array([0.0, slope * (bias[1] - bias[0]) + shift]))


def score(rows: np.ndarray, odds: float, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The softmax's share of class 1 for each text; sums are made where the features lie, without sorting them."""
    line, at, ends, text_at = _line(data, off)
    total, count = np.zeros(len(line), np.float32), np.zeros(len(line), np.int8)
    total[at] = rows[(span_hash(line, at, ends) >> _SHIFT).astype(np.int64)]
    count[at] = 1
    for n, code, solid in _windows(line):
        part = rows[(code * _U(0x9E3779B97F4A7C15 + 2 * n) >> _SHIFT).view(np.int64)]
        part *= solid
        total[: len(part)] += part
        count[: len(part)] += solid
    z = row_sums(total, text_at) / np.maximum(row_sums(count, text_at), 1) + odds
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The bounded sample (doc_id, text, label), at most ``2 * max_rows`` rows should ids repeat, never from the held-out fold."""
    key = F.col(id_col).cast("string")
    chosen = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"), key.alias("key")).where(f"label in (0, 1) and key is not null and crc32(cast(key as binary)) % {folds} <> {held}")
    chosen = chosen.orderBy(F.md5(F.concat(F.lit("toxicity:"), "key")), "label").limit(max_rows).drop("key")
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return got.select("doc_id", "text", "label").orderBy("doc_id", "label", F.md5("text")).limit(2 * max_rows)


def fitted(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Row weights and odds of the model that is trained on the sample, in one task of an executor; the weights take 1 MB, whatever the input."""

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(sample.schema["doc_id"].dataType)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", kind), ("text", pa.string()), ("label", pa.int32())]))
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        model = train(rows.column("text").combine_chunks(), rows.column("label").to_pylist())  # texts stay as Arrow bytes
        yield pa.record_batch([pa.array([model.rows().astype(np.float32).tobytes()]), pa.array([model.odds()])], names=["rows", "odds"])

    got = sample.repartition(1).mapInArrow(fit, "rows binary, odds double").first()
    if got is None:  # Spark runs no task for a sample that it knows to be empty
        model = train([], [])
        return model.rows().astype(np.float32), model.odds()
    return np.frombuffer(got["rows"], np.float32), got["odds"]


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", passed: bool = False, **sample) -> DataFrame:
    """doc_id, score of each row of ``docs``; ``passed`` gives the columns of ``docs`` before the score instead (but for one named score, which it replaces). Learns from ``train_docs``, or else from ``docs``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(fitted(training_rows(train_docs if train_docs is not None else docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **sample)))
    kept = [c for c in docs.columns if c != "score"] if passed else [id_col]
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, odds = shared.value
        for batch in batches:
            data, off = utf8(batch.column(at))
            scores = [score(weights, odds, part, part_off) for _, _, part, part_off in slices(data, off, 1 << 18)]
            cols = [batch.column(i) for i in range(at)]
            yield pa.record_batch([*cols, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names[:at], "score"])

    sent = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(f"text of {uuid.uuid4().hex}"))  # a name that no column has
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*sent.schema.fields[:at], StructField("score", DoubleType())])
    return sent.mapInArrow(run, schema)
