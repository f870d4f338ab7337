"""Queries over parsers of HTML and Markdown: the driver's pages, and literal bodies with known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import udf
from quillmap.operators import structure as S
from quillmap.plans.catalogue import literal, query, spread, table

PAGED = """(SELECT * FROM (VALUES (1, 'Showing 1-20 of 143 results. [Next page](?page=2)'), (2, 'Showing 20 of 20 items'), (3, 'Call /api/list?cursor=abc for more'), (4, 'Nothing'),
 (5, '[page 1](?page=1) and [two](/x/page/2)')) AS v(id, body))"""

TABBED = """(SELECT * FROM (VALUES ('u1', '<div><ul role="tablist"><li class="tabs__item" role="tab">npm</li><li class="tabs__item" role="tab">yarn</li></ul><div role="tabpanel"><h3>Install</h3></div><div role="tabpanel"><h3>Install</h3></div></div>'),
 ('u2', '<div class="tabbed-set"><div class="tabbed-labels"><label>A</label><label>B</label></div><div class="tabbed-content"><div class="tabbed-block"><h4>Use A</h4></div><div class="tabbed-block"><h4>Use B</h4></div></div></div>'),
 ('u3', '<Tabs><TabItem label="mac">
## Setup
</TabItem><TabItem label="win">
## Setup
</TabItem></Tabs>'), ('u4', '<p>plain</p>')) AS v(url, html))"""

@query("html_render_metrics")
def html_render_metrics(spark, d):
    pages = spread(table(spark, d, "pages"))
    return pages.select("page_id", udf.page_metrics(F.col("html")).alias("m")).select("page_id", "m.status", "m.headings", "m.paragraphs", "m.code_blocks", "m.visible", "m.has_content")


@query("html_anchor_counts", r"SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s'))::BIGINT AS anchors FROM pages")
def html_anchor_counts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("anchors"))


@query("html_to_markdown")
def html_to_markdown(spark, d):
    pages = spread(table(spark, d, "pages"))
    return pages.select("page_id", udf.page_markdown(F.col("html")).alias("md")).select("page_id", F.length("md").alias("chars"), F.md5("md").alias("digest"))


@query("content_start")
def content_start(spark, d):
    pages = spread(table(spark, d, "pages"))
    md = pages.select("page_id", udf.page_markdown(F.col("html")).alias("md"))
    start = md.select("page_id", udf.content_start(F.col("md")).alias("start"), F.length("md").alias("chars"))
    percent = F.floor(F.try_divide(100 * F.col("start"), F.col("chars")) + 0.5)
    return start.withColumn("percent", percent).withColumn("status", F.when(percent <= 10, "pass").when(percent <= 50, "warn").otherwise("fail"))


@query("html_parity_self")
def html_parity_self(spark, d):
    pages = spread(table(spark, d, "pages").select("url", "html"))
    return S.parity(pages.select("url", "html", udf.page_markdown(F.col("html")).alias("markdown")))


@query("pagination", "SELECT * FROM (VALUES (1, 2, '?page=2'), (2, 0, NULL), (3, 1, '/api/list?cursor=abc'), (4, 0, NULL), (5, 1, '/x/page/2')) AS v(id, signals, continuation)")
def pagination(spark, d):
    rows = literal(spark, PAGED).select("id", udf.pagination(F.col("body"), F.lit("https://a.io/d/list")).alias("p"))
    return rows.select("id", F.size("p.signals").alias("signals"), "p.continuation")


@query("tab_groups", "SELECT * FROM (VALUES ('u1', 'docusaurus', 0, 'npm'), ('u1', 'docusaurus', 1, 'yarn'), ('u2', 'mkdocs', 0, 'A'), ('u2', 'mkdocs', 1, 'B'), ('u3', 'mdx', 0, 'mac'), ('u3', 'mdx', 1, 'win')) AS v(url, framework, panel_ix, label)")
def tab_groups(spark, d):
    return S.tab_panels(literal(spark, TABBED)).select("url", "framework", "panel_ix", "label")


@query("tab_header_quality", "SELECT * FROM (VALUES ('u1', 2::BIGINT, 2::BIGINT, true), ('u2', 2, 0, false), ('u3', 2, 2, true)) AS v(url, headers, generic, generic_majority)")
def tab_header_quality(spark, d):
    return S.header_quality(S.tab_panels(literal(spark, TABBED))).select("url", "headers", "generic", "generic_majority")


CHROME_FREE = "regexp_replace(html, '(?is)<(nav|header|footer|aside|script|style|noscript|svg)\\b.*?</(nav|header|footer|aside|script|style|noscript|svg)>', '', 'g')"


@query("html_heading_counts", f"""SELECT page_id, len(list_filter(regexp_extract_all({CHROME_FREE}, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1),
lambda x: length(trim(regexp_replace(x, '<[^>]*>', '', 'g'))) > 3))::INT AS headings, len(regexp_extract_all({CHROME_FREE}, '(?i)<(pre|code)[\\s>]'))::INT AS code_blocks FROM pages""")
def html_heading_counts(spark, d):
    """Of the rendering figures those that patterns can tell on these pages."""
    pages = spread(table(spark, d, "pages"))
    return pages.select("page_id", udf.page_metrics(F.col("html")).alias("m")).select("page_id", "m.headings", "m.code_blocks")
