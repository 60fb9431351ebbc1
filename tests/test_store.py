"""Versions of a store: failing reads, two writers, layout by process."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from kilnwork.__main__ import main
from kilnwork.operators import graph
from kilnwork.sources import json_files as files


def graph_file(folder, code):
    node = {"id": code, "label": "Parameter", "properties": {"code": code, "name": "n", "definition": "d", "source_refs": ["s:1"]}}
    (folder / f"{code}.json").write_text(json.dumps({"nodes": [node], "relationships": []}))
    return ["import-graph", "--graph", f"file://{folder}/{code}.json", "--store", f"file://{folder}/store"]


def keys(spark, folder):
    return sorted(r.key for r in files.published(spark, f"file://{folder}/store", "nodes").collect())


def test_unreadable_store_is_no_empty_store(spark, tmp_path, capsys):
    assert main(graph_file(tmp_path, "p1"), spark) == 0
    entry = tmp_path / "store" / "log" / "000000000001"
    good = entry.read_bytes()
    entry.write_bytes(b"\xff not a version")
    (entry.parent / f".{entry.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        main(graph_file(tmp_path, "p2"), spark)
    entry.write_bytes(good)
    assert keys(spark, tmp_path) == ["p1"]
    assert main(graph_file(tmp_path, "p2"), spark) == 0
    assert keys(spark, tmp_path) == ["p1", "p2"]


def test_damaged_table_is_an_error(spark, tmp_path, capsys):
    assert main(graph_file(tmp_path, "p1"), spark) == 0
    version = files.current(spark, f"file://{tmp_path}/store")[1]
    (tmp_path / "store" / version / "nodes").rename(tmp_path / "aside")
    with pytest.raises(Exception):
        main(graph_file(tmp_path, "p2"), spark)
    (tmp_path / "aside").rename(tmp_path / "store" / version / "nodes")
    assert keys(spark, tmp_path) == ["p1"] and files.current(spark, f"file://{tmp_path}/store")[0] == 1


def test_two_writers(spark, tmp_path):
    """Both start from one version: one publishes, the other is told, merges again and loses nothing."""
    path = f"file://{tmp_path}/s"
    files.publish(spark, {"t": spark.range(1)}, path)
    assert files.publish(spark, {"t": spark.range(5)}, path, after=1) == 2
    with pytest.raises(files.Conflict):
        files.publish(spark, {"t": spark.range(9)}, path, after=1)
    assert files.published(spark, path, "t").count() == 5
    gate, seen = threading.Barrier(2, timeout=120), []

    def writer(number):
        first = []

        def merge(stored):
            old = stored("t")
            if not first:
                first.append(1)
                gate.wait()
            seen.append(number)
            return {"t": old.union(spark.createDataFrame([(number,)], "id long"))}, number

        assert files.merged_version(spark, path, merge) == number

    threads = [threading.Thread(target=writer, args=(n,)) for n in (100, 200)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.id for r in files.published(spark, path, "t").collect()) == [0, 1, 2, 3, 4, 100, 200]
    assert files.current(spark, path)[0] == 4 and len(seen) == 3


def test_an_absent_store(spark, tmp_path):
    assert files.current(spark, f"file://{tmp_path}/none") == (0, None)
    with pytest.raises(FileNotFoundError):
        files.published(spark, f"file://{tmp_path}/none", "t")


def test_cases_by_process(spark, tmp_path):
    """A filter reads one bucket, and a join on the process has no exchange on the side of the cases."""
    cases = spark.range(2000).select(F.format_string("c%05d", "id").alias("case_id"), F.format_string("p%d", F.col("id") % 40).alias("process"), F.col("id").cast("double").alias("thickness_mm"))
    spark.sql("DROP TABLE IF EXISTS cases_by_process")
    stored = files.save_by_process(cases, "cases_by_process", f"file://{tmp_path}/cases", buckets=16)
    try:
        one = stored.where("process = 'p7'")
        assert len(one.collect()) == 50
        read = lambda df: df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()  # noqa: E731  rows that the scan gave, before the filter
        every = stored.where("case_id > ''")
        every.collect()
        assert read(every) == 2000 and read(one) <= 250
        asked = spark.range(40).select(F.format_string("p%d", "id").alias("process"), "id")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = asked.join(stored, "process")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 2000
        side = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
        assert "Exchange" not in side.split("Sort")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS cases_by_process")


def test_flat_limits_have_an_order(spark):
    rows = [("v", "e2", "x"), ("a", "e1", "y"), ("v", "e1", "z")]
    got = graph.flat_limits(spark.createDataFrame(rows, "parameter_code string, equipment_id string, edge_id string")).collect()
    assert [tuple(r) for r in got] == [("a", "e1", "y"), ("v", "e1", "z"), ("v", "e2", "x")]
