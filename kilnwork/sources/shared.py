"""The folder that driver and executors share, and tables written there to cut a plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made, oldest first.
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which only a local master may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    _made.append(f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start from there, on any machine."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, kept under a name that tells its contents, so that later runs read it. Made by two at once, one stays; a folder that was left incomplete is replaced."""
    jvm, path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, f"{shared_base(spark)}/{name}"
    target = jvm(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = lambda: files.exists(jvm(f"{path}/_SUCCESS"))
    if not whole():
        fresh = f"{path}-{uuid.uuid4().hex}"
        make().write.parquet(fresh)
        if files.exists(target) and not whole():
            aside = jvm(f"{fresh}.incomplete")
            if files.rename(target, aside):
                files.delete(aside, True)
        if not files.exists(target):
            files.rename(jvm(fresh), target)
        if files.exists(jvm(fresh)):
            files.delete(jvm(fresh), True)
        if not whole():
            raise OSError(f"{path} can't be kept")
    return spark.read.parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the folders made so far but for the oldest ``keep``. Frames that still read them can't run after that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in _made[keep:]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    del _made[keep:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside go at the end; results must have been written elsewhere, or made outside, by then."""
    keep = len(_made)
    try:
        yield
    finally:
        release(spark, keep)
