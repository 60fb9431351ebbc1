"""Command line: ``python -m kilnwork docs audit|run|validate``, ``recommend``, ``reason``, ``import-graph``, ``import-cases``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork import settings
from kilnwork.operators import document, graph, ingest
from kilnwork.plans import document as plan
from kilnwork.plans.reasoning import reason
from kilnwork.plans.recommend import flow_warnings, recommend
from kilnwork.sources import json_files as files


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str))


#: Rows that a command shows at most; ``--out`` writes whole tables.
SHOWN = 1000


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.limit(SHOWN).collect()]


def _tables(a: argparse.Namespace, **tables: DataFrame) -> int:
    """Written whole below --out where it is given, else shown up to a bound."""
    if a.out:
        for name, df in tables.items():
            files.write_table_atomic(df.sparkSession, df, f"{a.out}/{name}")
    _show({name: _rows(df) for name, df in tables.items()})
    return 0


def docs(spark: SparkSession, a: argparse.Namespace) -> int:
    """audit: metrics of the input. run: tables and a report below --out. validate: acceptance over two runs."""
    raw, cfg = files.read_blocks(spark, a.input), settings.document(a.config)
    if a.mode == "audit":
        _show(plan.audit(raw, cfg))
        return 0
    p = plan.prepare(raw, cfg=cfg)
    found = lambda path: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content") if path else spark.createDataFrame([], "path string, content binary")
    # A crop's file has the name of the visual's reference, with _ for : and an ending.
    crops = p.blocks.where("block_type in ('figure', 'table')").select("source_ref", F.translate("source_ref", ":", "_").alias("name")).join(found(a.crops).select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1).alias("name"), "content"), "name").select("source_ref", "content")
    records = document.assets(p.blocks, found(a.assets), crops)
    again = plan.prepare(raw, cfg=cfg) if a.mode == "validate" else None
    quality = plan.accept(p, raw, records, again, cfg)
    if a.mode == "run":
        plan.write(p, a.out, a.fail_on_error, records, f"{plan.prefix_of(cfg)}:sec:", {"crop_requests": plan.crop_requests(p, records, cfg)})
        files.write_json_atomic(f"{a.out.removeprefix('file://')}/report.json", plan.run_report(raw, p, quality, cfg["document"], cfg))
    _show(quality)
    return int(any(q["ok"] is False for q in quality.values()))


def _graph(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return files.read_graph(spark, a.graph)


def run_recommend(spark: SparkSession, a: argparse.Namespace) -> int:
    nodes, edges = _graph(spark, a)
    limits = graph.limits(edges, nodes, a.equipment) if a.equipment else graph.limits(edges, nodes)
    cfg = settings.adjustment(a.config)
    proposals, adjustments = recommend(files.read_requirements(spark, a.requirements), files.read_cases(spark, a.cases), graph.rules(edges, nodes), graph.tails(edges, nodes), limits, a.top_k, a.count, cfg=cfg)
    return _tables(a, proposals=proposals, adjustments=adjustments, warnings=flow_warnings(proposals, cfg))


def run_reason(spark: SparkSession, a: argparse.Namespace) -> int:
    nodes, edges = _graph(spark, a)
    matches, diffs, paths = reason(files.read_requirements(spark, a.requirements), files.read_cases(spark, a.cases), nodes, edges)
    return _tables(a, matches=matches, differences=diffs, paths=paths)


def import_graph(spark: SparkSession, a: argparse.Namespace) -> int:
    nodes, edges = _graph(spark, a)

    def merge(stored):
        old = stored("nodes"), stored("edges")
        errors, n, e = ingest.import_graph(nodes, edges, *(x if x is not None else new.drop("ord").limit(0) for x, new in zip(old, (nodes, edges))))
        if n is None:
            return None, ("errors", errors)
        return {"nodes": n.drop("action"), "edges": e.drop("action")}, ("counts", _rows(ingest.import_counts(n, e)))

    return _imported(files.merged_version(spark, a.store, merge))


def import_cases(spark: SparkSession, a: argparse.Namespace) -> int:
    cases, nodes = files.read_cases(spark, a.cases), files.published(spark, a.graph_store, "nodes")

    def merge(stored):
        old, links = stored("cases"), stored("edges")
        if old is None:
            old, links = cases.drop("ord", "conditions", "parameters", "results").limit(0), spark.createDataFrame([], "src string, type string, dst string")
        errors, merged, links, counts = ingest.import_cases(cases, old, links, nodes)
        if merged is None:
            return None, ("errors", errors)
        return {"cases": merged.drop("action"), "edges": links}, ("counts", _rows(counts))

    return _imported(files.merged_version(spark, a.store, merge))


def _imported(result: tuple) -> int:
    kind, rows = result
    _show({kind: rows if isinstance(rows, list) else _rows(rows)})
    return int(kind == "errors")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="kilnwork")
    sub = p.add_subparsers(required=True)
    d = sub.add_parser("docs")
    d.add_argument("mode", choices=("audit", "run", "validate"))
    for flag in ("--input", "--out", "--config", "--assets", "--crops"):
        d.add_argument(flag, required=flag == "--input")
    d.add_argument("--fail-on-error", action="store_true")
    d.set_defaults(run=docs)
    for name, run in (("recommend", run_recommend), ("reason", run_reason)):
        r = sub.add_parser(name)
        for flag in ("--requirements", "--cases", "--graph"):
            r.add_argument(flag, required=True)
        r.add_argument("--equipment")
        r.add_argument("--config")
        r.add_argument("--out")
        r.add_argument("--top-k", type=int, default=5)
        r.add_argument("--count", type=int, default=3)
        r.set_defaults(run=run)
    g = sub.add_parser("import-graph")
    g.add_argument("--graph", required=True)
    g.add_argument("--store", required=True)
    g.set_defaults(run=import_graph)
    c = sub.add_parser("import-cases")
    for flag in ("--cases", "--graph-store", "--store"):
        c.add_argument(flag, required=True)
    c.set_defaults(run=import_cases)
    a = p.parse_args(argv)
    return a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
