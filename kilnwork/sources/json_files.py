"""Readers of the JSON inputs and writers of deterministic outputs."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.model import CASE, EDGE, EDGE_PROPERTIES, NODE, NODE_PROPERTIES, REQUIREMENT


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, key, props, ord) and edges (id, type, src, dst, promoted properties, props, ord) of a graph file."""
    raw = spark.read.schema(f"nodes array<struct<{_fields(NODE)}>>, relationships array<struct<{_fields(EDGE)}>>").json(path, multiLine=True)
    nodes = raw.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.id", "n.label", F.from_json("n.properties", NODE_PROPERTIES).alias("p"), F.col("n.properties").alias("props"))
    nodes = nodes.select("ord", "id", "label", F.coalesce("p.code", "p.equipment_id", "p.case_id").alias("key"), "p.name", "p.definition", "p.layer", "p.source_refs", "props")
    edges = raw.select(F.posexplode("relationships").alias("ord", "e")).select("ord", "e.id", "e.type", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.from_json("e.properties", EDGE_PROPERTIES).alias("p"), F.col("e.properties").alias("props"))
    return nodes, edges.select("ord", "id", "type", "src", "dst", "p.*", "props")


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (x.rsplit(" ", 1) for x in ddl.split(", ")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in CASE.split(", "))
    raw = spark.read.schema(f"cases array<struct<{fields}>>").json(path, multiLine=True)
    return raw.select(F.posexplode("cases").alias("ord", "c")).select("ord", "c.*")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """One requirement for each file or line; unknown keys are ignored; a file without an id is named by its path."""
    df = spark.read.schema(REQUIREMENT).json(path, multiLine=True)
    return df.withColumn("requirement_id", F.coalesce("requirement_id", F.input_file_name()))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pdf_page, original_index, block) of page lists of raw blocks; a file that isn't a list of lists is an error."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.from_json("value", "array<array<string>>").alias("pages"))
    checked = pages.select("doc_id", F.when(F.col("pages").isNull(), F.raise_error(F.lit("a document must be a list of lists of blocks"))).otherwise(F.col("pages")).alias("pages"))
    page = checked.select("doc_id", F.posexplode("pages").alias("p", "blocks")).select("doc_id", (F.col("p") + 1).alias("pdf_page"), "blocks")
    return page.select("doc_id", "pdf_page", F.posexplode("blocks").alias("original_index", "block"))


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``; dictionaries are merged, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_config(path: str, defaults: dict) -> dict:
    """JSON, or YAML where its library is installed, over defaults."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        given = json.loads(text)
    except ValueError:
        import yaml

        given = yaml.safe_load(text) or {}
    return deep_merge(defaults, given)


def write_text_atomic(path: str, text: str) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


def write_json_atomic(path: str, value) -> None:
    """Small driver-side results, with sorted keys."""
    write_text_atomic(path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")


def write_table_atomic(spark: SparkSession, df: DataFrame, path: str) -> None:
    """A table is written beside its place and moved there once it is whole; an older one steps aside first and goes last."""
    name = uuid.uuid4().hex
    part, old = f"{path}__{name}", f"{path}__{name}.old"
    df.write.parquet(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not fs.rename(target, hadoop.Path(old)):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(hadoop.Path(part), target):
        fs.rename(hadoop.Path(old), target)
        raise OSError(f"{path} can't be published")
    fs.delete(hadoop.Path(old), True)


class Conflict(Exception):
    """Another writer has published the next version first."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of a store's last version; 0 and None only where the file system says that there is no log. Whatever else fails is an error."""
    hadoop, fs = _files(spark, path)
    log = hadoop.Path(f"{path}/log")
    numbers = [int(x.getPath().getName()) for x in fs.listStatus(log) if x.getPath().getName().isdigit()] if fs.exists(log) else []
    if not numbers:
        return 0, None
    at = fs.open(hadoop.Path(f"{path}/log/{max(numbers):012d}"))
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8").strip()
    finally:
        at.close()
    if not re.fullmatch(r"version-[0-9a-f]{32}", name):
        raise ValueError(f"version {max(numbers)} of {path} can't be read")
    return max(numbers), name


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, after: int | None = None) -> int:
    """Tables that belong together as the version after number ``after`` (by default the last one): all are written to a new folder, then the log's next entry names it.

    That entry is made only if there is none, which the file system decides, so of two writers that started from the same version one gets
    ``Conflict`` and can merge again. Readers see the old version or the new one, whole.
    """
    after = current(spark, path)[0] if after is None else after
    version = f"version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    hadoop, fs = _files(spark, path)
    fs.mkdirs(hadoop.Path(f"{path}/log"))
    fresh, entry = hadoop.Path(f"{path}/{version}/entry"), hadoop.Path(f"{path}/log/{after + 1:012d}")
    out = fs.create(fresh, False)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.getScheme() == "file":  # a rename would replace
        try:
            os.link(fresh.toUri().getPath(), entry.toUri().getPath())
        except FileExistsError:
            raise Conflict(f"version {after + 1} of {path} is there already") from None
        return after + 1
    context = hadoop.FileContext.getFileContext(entry.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fresh, entry, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as error:
        if fs.exists(entry):
            raise Conflict(f"version {after + 1} of {path} is there already") from error
        raise
    return after + 1


def published(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the last version, or of the one whose folder is given."""
    version = version or current(spark, path)[1]
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(f"{path}/{version}/{name}")


def merged_version(spark: SparkSession, path: str, merge, tries: int = 5):
    """Publishes what ``merge`` makes of the last version: it takes a function from a table's name to the stored table (None if nothing is stored) and gives (tables or None, result). After a conflict it merges with the version that came first."""
    for left in reversed(range(tries)):
        number, version = current(spark, path)
        tables, result = merge(lambda name: published(spark, path, name, version) if version else None)  # noqa: B023
        if tables is None:
            return result
        try:
            publish(spark, tables, path, number)
            return result
        except Conflict:
            if not left:
                raise


def save_by_process(cases: DataFrame, name: str, path: str | None = None, key: str = "process", buckets: int = 64) -> DataFrame:
    """Cases as a table bucketed by process and sorted within, with statistics of the key: a filter on the key reads one bucket, and joins on it don't move the stored side.

    A process with very many cases is one bucket, read in file splits by filters and split by AQE in joins; choose ``buckets`` by the number of processes.
    """
    writer = cases.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, "case_id")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    cases.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {key}")
    return cases.sparkSession.table(name)


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a total order; the files' names follow it."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def without_field(value, name: str = "embedding"):
    """A nested value without a key, at any depth."""
    if isinstance(value, dict):
        return {k: without_field(v, name) for k, v in value.items() if k != name}
    return [without_field(v, name) for v in value] if isinstance(value, list) else value
