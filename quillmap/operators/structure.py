"""Header quality of tabbed content, parity of HTML and Markdown, and link plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions import text as T
from quillmap.functions import udf


def tab_panels(pages: DataFrame, body: str = "html") -> DataFrame:
    """(url, group_ix, framework, panel_ix, label, html) of the tab groups of pages(url, body)."""
    groups = pages.select("url", F.posexplode(udf.tab_groups(F.col(body))).alias("group_ix", "g"))
    return groups.select("url", "group_ix", "g.framework", F.posexplode("g.panels").alias("panel_ix", "p")).select("url", "group_ix", "framework", "panel_ix", "p.label", "p.html")


def header_quality(panels: DataFrame) -> DataFrame:
    """Per (url, group): headers, generic ones (in two panels or more and without the panel's label), and both flags."""
    several = F.count("*").over(Window.partitionBy("url", "group_ix")) >= 2
    rows = panels.withColumn("_several", several).filter("_several")
    each = rows.select("url", "group_ix", "framework", "label", F.explode(udf.panel_headers(F.col("html"))).alias("h")).withColumn("h", F.lower("h"))
    times = F.count("*").over(Window.partitionBy("url", "group_ix", "h"))
    labelled = F.coalesce(F.contains(F.col("h"), F.lower("label")), F.lit(False))
    marked = each.withColumn("_generic", (times >= 2) & ~labelled)
    per = marked.groupBy("url", "group_ix", "framework").agg(F.count("*").alias("headers"), F.count_if("_generic").alias("generic"))
    labels = rows.groupBy("url").agg(F.collect_set(F.lower("label")).alias("_labels"))
    shared = (
        each.groupBy("url", "h").agg(F.collect_set("group_ix").alias("_groups")).filter(F.size("_groups") >= 2).join(labels, "url")
        .filter(~F.exists("_labels", lambda x: F.contains(F.col("h"), x)))
        .select("url", F.explode("_groups").alias("group_ix")).distinct().withColumn("cross_group", F.lit(True))
    )
    out = per.join(shared, ["url", "group_ix"], "left").withColumn("cross_group", F.coalesce("cross_group", F.lit(False)))
    return out.withColumn("generic_majority", 2 * F.col("generic") > F.col("headers"))


# Items from which a structure counts, that each side needs, and the difference that is noise.
REPEATED, EACH_SIDE, TOLERANCE = 20, 5, 0.02


def item_divergence(html_items: Column, html_rows: Column, md_items: Column, md_distinct: Column, md_rows: Column, paginated: Column) -> Column:
    """struct(structure, html, markdown, distinct, duplicates, diverges, cause) where a list or table is long enough; else null.

    Distinct entries are compared: a list that holds its entries twice is not longer. More in Markdown than in HTML is a
    default filter of the page; fewer is pagination where the Markdown is paginated, else staleness.
    """
    lists, tables = F.greatest(html_items, md_items), F.greatest(html_rows, md_rows)
    of_list = lists >= tables
    html, markdown, distinct = F.when(of_list, html_items).otherwise(html_rows), F.when(of_list, md_items).otherwise(md_rows), F.when(of_list, md_distinct).otherwise(md_rows)
    apart = (F.least(html, distinct) >= EACH_SIDE) & (F.abs(html - distinct) > F.greatest(F.lit(1.0), TOLERANCE * F.greatest(html, distinct)))
    cause = F.when(apart, F.when(distinct > html, "default-filter").when(paginated, "pagination").otherwise("staleness"))
    row = F.struct(
        F.when(of_list, "list").otherwise("table").alias("structure"), html.alias("html"), markdown.alias("markdown"), distinct.alias("distinct"), (markdown - distinct).alias("duplicates"),
        apart.alias("diverges"), cause.alias("cause"),
    )
    return F.when(F.greatest(lists, tables) >= REPEATED, row)


def parity(pages: DataFrame, limits: tuple[int, int] = (5, 20), min_segments: int = 10, exclusions: tuple[str, ...] = ()) -> DataFrame:
    """(url, segments, missing, sample, items, status) of pages(url, html, markdown), with paginated if pages have it:
    HTML segments that the Markdown lacks, the first five of them, and how item counts differ."""
    rows = pages.withColumn("_m", udf.main_text(F.col("html"), exclusions)).withColumn("_t", udf.markdown_text(F.col("markdown")))
    paged = F.coalesce("paginated", F.lit(False)) if "paginated" in pages.columns else F.lit(False)
    items = item_divergence(F.col("_m.largest_list"), F.col("_m.largest_table"), F.col("_t.items"), F.col("_t.distinct"), F.col("_t.rows"), paged)
    # a segment may stand in the raw Markdown only (raw HTML, code), so both forms are searched
    rows = rows.select("url", T.segments(F.col("_m.text")).alias("segs"), F.concat_ws(" ", T.normal_segment(F.col("_t.text")), T.normal_segment(F.col("markdown"))).alias("md"), items.alias("items"))
    rows = rows.withColumn("_lost", F.filter("segs", lambda s: ~F.contains(F.col("md"), s)))
    out = rows.select("url", F.size("segs").alias("segments"), F.size("_lost").alias("missing"), F.slice("_lost", 1, 5).alias("sample"), "items")
    share = T.js_round(F.try_divide(100 * F.col("missing"), F.col("segments")))
    fail, warn = (limits[1], limits[0])
    status = F.when(F.col("segments") < min_segments, "pass").when((fail > 0) & (share >= fail), "fail").when((warn > 0) & (share >= warn), "warn").otherwise("pass")
    return out.withColumn("status", status)


def link_plan(links: DataFrame, most: int) -> DataFrame:
    """(run_id, page_ordinal, offset, fetch) -> the links to verify.

    Each page has a quota of floor(most / pages), 1 at least; a URL that is planned already costs nothing; `most`
    distinct URLs in all. The plan is greedy in page order, so it runs per run, over links that are cut beforehand: the
    first occurrence of a URL on a page, and of the URLs that no earlier page has the first `quota` (later ones cannot be
    planned there).
    """
    page = Window.partitionBy("run_id", "page_ordinal")
    each = links.groupBy("run_id", "page_ordinal", "fetch").agg(F.min("offset").alias("offset"))
    pages = each.select("run_id", "page_ordinal").distinct().groupBy("run_id").agg(F.count("*").alias("_pages"))
    each = each.withColumn("_new", F.row_number().over(Window.partitionBy("run_id", "fetch").orderBy("page_ordinal", "offset")) == 1)
    fresh = F.count_if("_new").over(page.orderBy("offset", "fetch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_pages")))
    cut = each.withColumn("_fresh", fresh).join(pages, "run_id").filter(~F.col("_new") | (F.col("_fresh") <= quota))
    links = cut.select("run_id", "page_ordinal", "offset", "fetch", "_pages")

    def one(pdf):
        import pandas as pd

        quota, planned, keep = max(1, most // max(1, int(pdf["_pages"].iloc[0]))), set(), []
        for _, page in pdf.sort_values(["page_ordinal", "offset"]).groupby("page_ordinal", sort=True):
            used = 0
            for k, url in zip(page.index, page["fetch"]):
                if url in planned:
                    keep.append(k)
                elif used < quota and len(planned) < most:
                    planned.add(url)
                    used += 1
                    keep.append(k)
        return pd.DataFrame(pdf.loc[keep, ["run_id", "page_ordinal", "offset", "fetch"]])

    return links.groupBy("run_id").applyInPandas(one, "run_id string, page_ordinal long, offset long, fetch string")
