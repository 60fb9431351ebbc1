"""Audit, publishing and embedding."""

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import document
from kilnwork.operators.embedding import with_embeddings
from kilnwork.plans import document as plan
from kilnwork.sources import json_files as files
from tests.test_document import PAGES


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([("d", p, i, b) for p, bs in PAGES.items() for i, b in enumerate(bs)], "doc_id string, pdf_page int, original_index int, block string")


def test_audit(raw):
    a = plan.audit(raw)
    assert {r["value"]: r["n"] for r in a["types"]}["paragraph"] == 12
    assert a["pages"][0]["pages"] == 6 and not a["pages"][0]["continuous"]
    assert {r["block_type"]: (r["n"], r["without_caption"], r["with_html"]) for r in a["visuals"]} == {"figure": (1, 0, 0), "table": (1, 1, 1)}
    assert {r["kind"]: r["n"] for r in a["page_numbers"]} == {"roman": 1, "arabic": 4}
    assert [r for r in a["boxes"] if r["problem"] == "malformed"][0]["n"] == 1


def test_publish_and_cross_checks(spark, raw, tmp_path):
    p = plan.prepare(raw)
    assert set(plan.write(p, f"file://{tmp_path}/out", fail_on_error=True).values()) == {0}
    assert files.published(spark, f"file://{tmp_path}/out", "items").count() == p.items.count()
    assert plan.raw_preserved(p, raw).count() == 0 and plan.caption_repeated(p).count() == 0
    listed = spark.createDataFrame([("a.png", bytearray(b"x"))], "path string, content binary")
    records = document.assets(p.blocks, listed, spark.createDataFrame([], "source_ref string, content binary"))
    assert [r.source_ref[-5:] for r in plan.unresolved(p, records).collect()] == ["ble01"]
    assert plan.raw_text(raw).where("pdf_page = 11 and original_index = 9").first().text == "一 二"


def test_embedding(spark):
    def embedder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    d = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, " "), (4, None)], "k int, retrieval_text string").coalesce(1)
    got = with_embeddings(d, embedder).orderBy("k").collect()
    assert [(r.embedding, r.embedding_warning) for r in got] == [([3.0, 1.0], None), (None, "not embedded"), (None, None), (None, None)]
    assert with_embeddings(d, embedder).where(F.col("embedding").isNull()).count() == 3
