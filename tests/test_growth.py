"""Queries whose tasks once grew with the tables: no window over all rows, as many partitions as rows ask for, and only the parts of a group that hold its quantiles."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork import queries as library
from kilnwork.operators import order, stats

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@needs_tables
def test_position_codes_have_no_window_over_all_parts(spark):
    plan = library.QUERIES["diff_position_code"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "span" in plan and "1 AS all" not in plan


def test_running_numbers_through_spans(spark):
    rows = spark.range(1, 3_000, 7).withColumn("span", F.floor(F.col("id") / 64)).repartition(5)
    got = sorted((r.id, r.n) for r in order.running_numbers(rows, ["span"], ["id"], "n").collect())
    assert got == [(i, n) for n, i in enumerate(range(1, 3_000, 7), 1)]


@needs_tables
def test_reading_order_in_more_tasks_with_more_rows(spark, monkeypatch):
    monkeypatch.setattr(order, "TASK_ROWS", 100)
    assert library.QUERIES["reading_order"](spark, SF).rdd.getNumPartitions() >= 50


def test_quantiles_of_many_values_and_copies(spark):
    """Groups of one value, of many, with an outlier, with nulls only."""
    rng = random.Random(2)
    data = {"one": [3.0] * 50, "many": [rng.uniform(0, 1) for _ in range(5_000)], "far": [rng.gauss(0, 1) for _ in range(999)] + [1e300], "few": [1.0, 2.0], "ties": [float(rng.randint(0, 3)) for _ in range(3_000)]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("none", None), (None, 1.0), ("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    at = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 0.999, "e": 1.0}
    found = stats.quantiles(df, ["k"], "v", at)
    got = {r.k: [r[n] for n in at] for r in found.collect()}
    assert got.pop("none") == [None] * 5 and got.pop(None) == [1.0] * 5
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, list(at.values())).tolist(), rel=1e-12)


def test_quantiles_sort_only_the_parts_that_hold_them(spark):
    """Values are compared with the limits by halves, not with each limit, and the parts without an order statistic are left out before the sort."""
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    plan = stats.quantiles(df, [], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(__limits" not in plan and "__before" in plan


def test_rewrites_are_skipped_only_where_they_cannot_match(spark, monkeypatch):
    """Cleaning and formula rules with their tests of characters give what they give when tried on every text."""
    from kilnwork.functions import text as T

    rng = random.Random(9)
    marks = list("ab1 2\t\n　 中文，。（）：．～〜–—%-{}_^\\") + ["\\alpha ", "\\frac{1}{2}", "{a}_{b}", "  ", "\\( x \\)"]
    rows = [("".join(rng.choices(marks, k=rng.randint(0, 9))), rng.choice(["heading", "paragraph", "none"])) for _ in range(3_000)] + [(None, "paragraph")]
    df = spark.createDataFrame(rows, "t string, kind string").repartition(2)
    cleaned = T.clean_text(F.col("t"), F.col("kind"))
    run = lambda: sorted(map(repr, df.select("t", cleaned.alias("c"), T.latex_to_plain(F.col("t")).alias("l")).collect()))
    got = run()
    monkeypatch.setattr(T, "CLEANING", tuple((n, tuple((p, by, "(?s)^") for p, by, _ in rules)) for n, rules in T.CLEANING))
    cleaned = T.clean_text(F.col("t"), F.col("kind"))
    plain = T._trim(T.replaced(T.reduce(lambda x, rule: T.replaced(x, *rule), T.LATEX, T._trim(F.col("t"))), r"\s+", " "))
    want = sorted(map(repr, df.select("t", cleaned.alias("c"), plain.alias("l")).collect()))
    assert got == want and len({r for r in got}) > 1_000
