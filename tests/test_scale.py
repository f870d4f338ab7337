"""What a worker holds does not grow with the number of bodies that reach it, and queries read the given tables."""

import os

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmap.functions import dom, markdown, udf
from quillmap.operators import dom_table as D
from quillmap.plans import catalogue

SF = os.environ.get("QUILLMAP_TEST_DATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def handed(f, bodies):
    return list(udf._handed(f, [(pd.Series(bodies),)], list))


def test_elements_are_handed_on_in_small_batches():
    """a batch of 10,000 pages is not held as one list of all their elements."""
    page = "<div><a href=x>text</a></div>" * 50
    batches = handed(dom.node_rows, [page] * 1000 + [""])
    assert [len(r) for b in batches for r in b] == [100] * 1000 + [0]
    assert max(sum(map(len, b)) for b in batches) <= udf.BATCH_CHARS // udf.ROW_CHARS + 100
    assert handed(dom.node_rows, []) == []


def test_elements_of_one_page_are_handed_on_in_pieces():
    """the elements of a large page were one piece, and a batch of bodies was copied before the first was parsed."""
    batch = pa.RecordBatch.from_pydict({"page": [7, None, 9], "html": ["<a href=x>text</a>" * 90_000, "", "<p>" + "x" * 3_000_000 + "</p><b>y</b>"]})
    pieces = list(D._parsed(iter([batch, batch.slice(0, 0)]), ("pre", "tag", "classes", "own")))
    assert max(p.num_rows for p in pieces) <= udf.BATCH_CHARS // udf.ROW_CHARS and len(pieces) == 6
    rows = pa.Table.from_batches(pieces).to_pylist()
    assert [(r["page"], r["pre"], r["tag"]) for r in rows] == [(7, k, "a") for k in range(90_000)] + [(9, 0, "p"), (9, 1, "b")]
    assert rows[0] == {"page": 7, "pre": 0, "tag": "a", "classes": [], "own": "text"} and len(rows[-2]["own"]) == 3_000_000


def test_links_are_handed_on_in_small_batches():
    """the same for the links of texts; one text that is larger than a batch is a batch of its own."""
    text = "[a](b.md) " * 300
    batches = handed(lambda x: markdown.links(x, "https://a.io/"), [text] * 700 + ["x" * 3_000_000, ""])
    assert sum(map(len, batches)) == 702 and max(map(len, batches)) <= udf.BATCH_CHARS // len(text) + 1
    assert [len(r) for b in batches for r in b] == [1] * 700 + [0, 0]


def test_batches_keep_rows_in_place(spark, monkeypatch):
    rows = [(k, f"<p>{k}</p>" * (k % 7), f"[x{k}](y{k}.md)") for k in range(300)] + [(300, None, None)]
    df = spark.createDataFrame(rows, "id int, html string, md string").coalesce(1)
    got = df.select("id", udf.nodes(F.col("html"), ("tag", "own")).alias("n"), udf.links(F.col("md"), F.lit("https://a.io/")).alias("l"), udf.page_metrics(F.col("html")).alias("m"), udf.pagination(F.col("md"), F.lit("https://a.io/")).alias("p")).collect()
    for r in got:
        assert [tuple(n) for n in r["n"]] == ([] if r["id"] == 300 else [("p", str(r["id"]))] * (r["id"] % 7))
        assert [x["url"] for x in r["l"]] == ([] if r["id"] == 300 else [f"y{r['id']}.md"])
        assert r["m"]["status"] == "pass" and r["p"]["signals"] == []
    assert D.elements(df, ["id"], fields=("tag",)).columns == ["id", "tag"]


@needs_tables
def test_pages_are_parsed_once(spark):
    """the joins read a table of elements; before, each of their sides parsed the pages again."""
    for name in ("dom_anchors_in_nav", "dom_headings"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "ArrowEvalPython" not in plan


@needs_tables
def test_pages_use_all_cores(spark):
    """parity and the other figures of pages ran in eight tasks, whatever the cores and the input."""
    for name in ("html_parity_self", "html_render_metrics", "html_to_markdown", "content_start", "html_heading_counts"):
        df = catalogue.queries()[name](spark, SF)
        assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert "RepartitionByExpression" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_parsed_once(monkeypatch):
    """one parse for the text and the items of a body, with the results of two."""
    body, parsed = "# T\n\n- a\n- b\n- a\n\n| x | y |\n| - | - |\n| 1 | 2 |\n\n```\n- c\n```\n[d]: /e\n", []
    want = {"text": markdown.plain_text(body)} | markdown.item_counts(body)
    real = markdown.Document
    monkeypatch.setattr(markdown, "Document", lambda x: parsed.append(x) or real(x))
    assert markdown.text_and_items(body) == want and parsed == [body]
    page = "<h1>T</h1><p>a <b>c</b></p>"
    assert dom.to_markdown(page, dom.parse(page)) == dom.to_markdown(page) and dom.rendering(page, dom.parse(page)) == dom.rendering(page)
