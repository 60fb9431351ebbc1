"""Shuffling numpy arrays as blocks, and the shared folder that all machines see.

A corpus-wide count over billions of small keys costs most in handling rows. Here a task packs the keys
that belong to one reduce bucket into a few binary blocks; Spark shuffles (bucket, block) rows, each of
bounded size, and the reducer merges arrays. Spark's own shuffle gives recovery from lost executors.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.sources.shared import saved, shared_dir

__all__ = ["saved", "shared_dir"]

#: Bytes of a block's payload at most, and bytes of text or blocks that go to a Python worker at once.
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

#: Files of an operator's sorted arrays, whatever its input, and files that a worker keeps mapped at once (an operator has up to three kinds).
FILES, MAPPED = 4096, 12288

BLOCK_SCHEMA = "bucket int, n int, payload binary"
BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])


def arrow_batches(spark: SparkSession) -> None:
    """Bounds what goes to a worker at once by bytes, as rows may hold long texts or blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_schema(docs: DataFrame, ddl: str) -> T.StructType:
    """The columns of ``ddl``, of which the first, doc_id, has the type that it has in ``docs``."""
    return T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(ddl).fields[1:]])


def pack(bucket: int, arrays: list[np.ndarray], width: int) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of columns of equal length; ``width`` is the bytes of one entry over all columns."""
    n, step = len(arrays[0]), max(1, BLOCK_BYTES // width)
    for a in range(0, n, step):
        z = min(n, a + step)
        yield bucket, z - a, b"".join(np.ascontiguousarray(x[a:z]).tobytes() for x in arrays)


def unpack(payload: memoryview | bytes, n: int, kinds: list) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * kind.itemsize
    return out


def block_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, n, p = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(p, pa.binary())], schema=BLOCK_ARROW)


def by_bucket(values: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal buckets together, and the buckets' offsets in it."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def home(keys: np.ndarray, buckets: int, files: int = 0) -> np.ndarray:
    """The bucket of each key. Up to ``files`` buckets each have a file; more of them share files, and within a file the buckets stand in the order of their keys."""
    files = files or FILES
    if buckets <= files:
        return (keys % np.uint64(buckets)).astype(np.int32)
    each = buckets // files
    return ((keys % np.uint64(files)).astype(np.int64) * each + ((keys >> np.uint64(32)) * np.uint64(each) >> np.uint64(32)).astype(np.int64)).astype(np.int32)


def file_of(keys: np.ndarray, buckets: int, files: int = 0) -> np.ndarray:
    """The file in which a key's bucket is, a number below min(buckets, files)."""
    return (keys % np.uint64(min(buckets, files or FILES))).astype(np.int32)


def exchange(blocks: DataFrame, buckets: int, files: int = 0) -> DataFrame:
    """Bucket i goes to partition i, or with more buckets than files all buckets of a file to its partition, one after the other."""
    files = files or FILES
    if buckets <= files:
        return blocks.repartitionById(buckets, F.col("bucket"))
    return blocks.repartitionById(files, F.floor(F.col("bucket") / (buckets // files)).cast("int")).sortWithinPartitions("bucket")


def gather(batches: Iterator[pa.RecordBatch], kinds: list, merge: Callable | None = None, limit: int = 1 << 22) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket of a partition with all its blocks joined, one after the other; ``merge`` shrinks what came so far whenever ``limit`` entries are new."""
    parts: list[list[np.ndarray]] = []
    fresh, last = 0, None

    def joined() -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*parts)]
        return merge(out) if merge else out

    for batch in batches:
        for b, n, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != last:
                if parts:
                    yield last, joined()
                parts, fresh, last = [], 0, b
            parts.append([x.copy() for x in unpack(p.as_buffer(), n, kinds)])
            fresh += n
            if merge and fresh > limit:
                parts, fresh = [joined()], 0
    if parts:
        yield last, joined()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; where it has none, the bytes of the rows as strings."""
    try:
        n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())
    except Exception:  # noqa: BLE001  not every session lets Python see the plan
        n = -1
    if 0 <= n < 1 << 60:
        return n
    return df.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))), F.lit(0))).first()[0]


def buckets_for(df: DataFrame, per: int = 24 << 20, least: int = 12, files: int = 0) -> int:
    """Reduce buckets in proportion to the input, a multiple of the files where there are more than files."""
    n, files = max(least, -(-input_bytes(df) // per)), files or FILES
    return n if n <= files else -(-n // files) * files


def mounted(path: str) -> str:
    """The local name of a shared folder, for memory-mapping; the folder must be mounted on every machine."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"memory-mapped stores need a mounted shared folder in spark.checkpoint.dir, not {path}")
    path = path.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def mapped(cache: dict, path: str, kind, most: int = MAPPED) -> np.ndarray | None:
    """An array file mapped into memory, None if it is missing or empty; ``cache`` keeps ``most`` of them, and those beyond are mapped for one use."""
    if path in cache:
        return cache[path]
    array = np.asarray(np.memmap(path, kind, "r")) if os.path.exists(path) and os.path.getsize(path) else None
    if len(cache) < most:
        cache[path] = array
    return array


class Appended:
    """Files that grow array by array and appear, whole, when all is written, so that a second attempt of a task does no harm."""

    def __init__(self):
        self.open: dict[str, tuple] = {}

    def add(self, path: str, array: np.ndarray) -> None:
        if path not in self.open:
            part = f"{path}.{uuid.uuid4().hex}.part"
            self.open[path] = part, open(part, "wb")  # noqa: SIM115  closed in done
        self.open[path][1].write(np.ascontiguousarray(array).tobytes())

    def done(self) -> None:
        for path, (part, f) in self.open.items():
            f.close()
            os.replace(part, path)
        self.open = {}


def save(path: str, array: np.ndarray) -> None:
    """Writes a file as a whole or not at all, so that a second attempt of a task does no harm."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(part, path)
