"""Scans of robots.txt, sitemaps, llms.txt and page lists out of captured bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions import udf
from quillmap.functions import url as U
from quillmap.operators.locales import locale_sitemaps
from quillmap.operators.page_ops import budget, merge_first_wins
from quillmap.sources.capture import content_type, variant


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(run_id, ordinal, url) of Sitemap lines of robots.txt bodies(run_id, body)."""
    lines = robots.select("run_id", F.posexplode(F.split("body", "\n")).alias("ordinal", "line"))
    url = F.regexp_extract("line", r"(?i)^\s*Sitemap:\s*(\S+)", 1)
    return lines.select("run_id", "ordinal", url.alias("url")).filter("url <> ''")


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemap[\s>]")


def sitemap_locations(xml: Column) -> Column:
    """Locations of a sitemap, in order: of its child sitemaps if it is an index, else of its pages."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<sitemap[\s>].*?</sitemap>"), F.lit(0))
    loc = r"(?i)<loc>\s*(.*?)\s*</loc>"
    children = F.filter(F.transform(blocks, lambda b: F.regexp_extract(b, loc, 1)), lambda u: u != "")
    return F.when(is_sitemap_index(xml), children).otherwise(F.regexp_extract_all(xml, F.lit(loc), F.lit(1)))


def is_gzipped(url: Column) -> Column:
    return F.coalesce(U.path(url).rlike(r"(?i)\.gz$"), F.lit(False))


def gzipped_sitemaps(capture: DataFrame, roots: DataFrame) -> DataFrame:
    """(run_id, url) of the sitemaps that a walk skips since they are gzipped: roots, and children of indexes."""
    bodies = variant(capture).filter("status = 200").select("run_id", "url", "body")
    top = roots.select("run_id", "url")
    child = top.join(bodies, ["run_id", "url"]).filter(is_sitemap_index(F.col("body"))).select("run_id", F.explode(sitemap_locations(F.col("body"))).alias("url"))
    return top.unionByName(child).filter(is_gzipped(F.col("url"))).distinct()


def walk_sitemaps(
    capture: DataFrame, roots: DataFrame, prefix: str = "/", fetches: int = 20, max_bytes: int = 50 << 20, most: int = 500, wanted: DataFrame | None = None,
) -> DataFrame:
    """(run_id, ordinal, url) of the pages of sitemaps, one level of index deep, within the budgets.

    roots: (run_id, ordinal, url). Gzipped sitemaps are skipped; pages outside the site or the prefix use no slot. wanted:
    (run_id, wanted) locales; child sitemaps of other locales are then left out.
    """
    bodies = variant(capture).filter("status = 200").select("run_id", F.col("url").alias("u"), "body", "bytes")
    top = roots.filter(~is_gzipped(F.col("url"))).withColumnRenamed("url", "u").join(bodies, ["run_id", "u"])
    top = top.select("run_id", "ordinal", "u", "body", "bytes", is_sitemap_index(F.col("body")).alias("index"), F.posexplode(sitemap_locations(F.col("body"))).alias("p", "url"))
    child = top.filter("index").filter(~is_gzipped(F.col("url"))).select("run_id", F.col("url").alias("cu"), "ordinal", "p").dropDuplicates(["run_id", "cu"])
    if wanted is not None:
        child = locale_sitemaps(child.withColumnRenamed("cu", "url"), wanted).withColumnRenamed("url", "cu")
    found = child.join(bodies.withColumnRenamed("u", "cu"), ["run_id", "cu"])
    found = budget(found, ["run_id"], ["ordinal", "p", "cu"], "bytes", max_bytes, fetches - 1)
    deep = found.select("run_id", "ordinal", F.col("p").alias("p1"), F.posexplode(sitemap_locations(F.col("body"))).alias("p2", "url"))
    flat = top.filter("not index").select("run_id", "ordinal", F.lit(-1).alias("p1"), F.col("p").alias("p2"), "url")
    base = roots.groupBy("run_id").agg(F.min_by("url", "ordinal").alias("_base"))
    pages = flat.unionByName(deep).join(base, "run_id").filter(U.same_site(F.col("url"), F.col("_base")) & U.in_scope(F.col("url"), prefix))
    first = pages.groupBy("run_id", "url").agg(F.min(F.struct("ordinal", "p1", "p2")).alias("o"))
    ranked = first.select("run_id", "url", "o.*").withColumn("size", F.lit(1))
    return budget(ranked, ["run_id"], ["ordinal", "p1", "p2", "url"], "size", most).select("run_id", F.col("used").alias("ordinal"), "url")


def llms_txt_candidates(runs: DataFrame, explicit: str | None = None) -> DataFrame:
    """(run_id, ordinal, url): base, origin and origin/docs, distinct, in order; an explicit URL overrides them."""
    if explicit:
        return runs.select("run_id", F.lit(0).alias("ordinal"), F.lit(explicit).alias("url"))
    base = F.regexp_replace("base_url", "/$", "")
    o = U.origin(F.col("base_url"))
    urls = F.array_distinct(F.array(F.concat(base, F.lit("/llms.txt")), F.concat(o, F.lit("/llms.txt")), F.concat(o, F.lit("/docs/llms.txt"))))
    return runs.select("run_id", F.posexplode(urls).alias("ordinal", "url"))


def _served(candidates: DataFrame, capture: DataFrame) -> DataFrame:
    from quillmap.functions import text as T

    rows = candidates.join(variant(capture), ["run_id", "url"])
    ok = (F.col("status") == 200) & F.startswith(content_type(), F.lit("text/")) & ~T.looks_html(F.col("body")) & (F.trim("body") != "")
    return rows.filter(ok).select("run_id", "ordinal", "url", "final_url", "body", U.cross_host(F.col("url"), F.col("final_url")).alias("cross_host"))


def llms_txt_files(runs: DataFrame, capture: DataFrame, explicit: str | None = None) -> DataFrame:
    """Found files: (run_id, ordinal, url, final_url, body, cross_host); text that is neither HTML nor blank.

    Runs without one get a second look: at the origin to which their candidates or their base URL redirect, where that is
    another host.
    """
    first = llms_txt_candidates(runs, explicit)
    found = _served(first, capture)
    if explicit:
        return found
    asked = first.select("run_id", "url").unionByName(runs.select("run_id", F.col("base_url").alias("url")))
    moved = asked.join(variant(capture).select("run_id", "url", "final_url"), ["run_id", "url"]).filter(U.cross_host(F.col("url"), F.col("final_url")))
    origins = moved.join(found.select("run_id"), "run_id", "left_anti").groupBy("run_id").agg(F.min(U.origin(F.col("final_url"))).alias("_to"))
    more = origins.select("run_id", F.posexplode(F.array(F.concat("_to", F.lit("/llms.txt")), F.concat("_to", F.lit("/docs/llms.txt")))).alias("_k", "url"))
    more = more.join(first.select("run_id", "url"), ["run_id", "url"], "left_anti").select("run_id", (F.col("_k") + 10).alias("ordinal"), "url")
    return found.unionByName(_served(more, capture).withColumn("cross_host", F.lit(True)))


def files_for_analysis(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The canonical file of each run that has one for its base path, else all its files."""
    best = canonical_file(files, runs).select("run_id", F.col("url").alias("_best"))
    return files.join(best, "run_id", "left").filter(F.col("_best").isNull() | (F.col("url") == F.col("_best"))).drop("_best")


def canonical_file(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The file whose directory is the longest prefix of the base path; the first among equals."""
    rows = files.join(runs.select("run_id", "base_url"), "run_id")
    directory, base = U.directory(F.col("url")), F.regexp_replace(U.path(F.col("base_url")), "/$", "")
    inside = (directory == "") | (base == directory) | F.startswith(base, F.concat(directory, F.lit("/")))
    score = F.when(inside, 1 + F.length(directory)).otherwise(0)
    best = rows.withColumn("_k", F.struct(-score, "ordinal")).groupBy("run_id").agg(F.min_by(F.struct(*files.columns[1:]), "_k").alias("f"))
    return best.select("run_id", "f.*")


def file_links(files: DataFrame) -> DataFrame:
    """(run_id, ordinal, offset, url, fetch, text) of the links of llms.txt files."""
    each = files.select("run_id", "ordinal", F.explode(udf.links(F.col("body"), F.col("url"))).alias("l")).filter("not l.image and l.fetch is not null")
    return each.select("run_id", "ordinal", F.col("l.offset").alias("offset"), "l.url", F.col("l.fetch").alias("fetch"), F.col("l.text").alias("text"))


def walk_indexes(files: DataFrame, capture: DataFrame) -> dict[str, DataFrame]:
    """pages (run_id, ordinal, url, original_md) of llms.txt files and of the .txt indexes they link, one level deep; omitted: deeper ones."""
    key = F.concat(U.canonical_host(F.col("fetch")), F.lit(":"), F.coalesce(U.port(F.col("fetch")), F.lit("")), U.path(F.col("fetch")), U.query(F.col("fetch")))
    first = file_links(files).withColumn("_k", key).withColumn("_txt", U.path(F.col("fetch")).rlike(r"(?i)\.txt$"))
    home = files.select("run_id", F.col("url").alias("fetch")).withColumn("_k", key).select("run_id", "_k").distinct()
    indexes = first.filter("_txt").join(home, ["run_id", "_k"], "left_anti").dropDuplicates(["run_id", "_k"])
    bodies = variant(capture).filter("status = 200").select("run_id", F.col("url").alias("fetch"), "body")
    second = file_links(indexes.join(bodies, ["run_id", "fetch"]).select("run_id", "ordinal", F.col("fetch").alias("url"), "body"))
    second = second.withColumn("_k", key).withColumn("_txt", U.path(F.col("fetch")).rlike(r"(?i)\.txt$"))
    seen = home.unionByName(indexes.select("run_id", "_k")).distinct()
    omitted = second.filter("_txt").join(seen, ["run_id", "_k"], "left_anti").select("run_id", F.col("fetch").alias("url")).distinct()
    pages = first.filter("not _txt").select("run_id", F.lit(0).alias("level"), "ordinal", "offset", "fetch")
    pages = pages.unionByName(second.filter("not _txt").select("run_id", F.lit(1).alias("level"), "ordinal", "offset", "fetch"))
    pages = pages.filter(~U.is_non_page(F.col("fetch"))).withColumn("url", U.html_form(F.col("fetch")))
    out = pages.groupBy("run_id", "url").agg(F.min(F.struct("level", "ordinal", "offset")).alias("o"), F.min(F.when(U.is_markdown(F.col("fetch")), F.col("fetch"))).alias("original_md"))
    return {"pages": out.select("run_id", F.col("o").alias("ordinal"), "url", "original_md"), "omitted": omitted}


__all__ = ["merge_first_wins", "robots_sitemaps", "walk_indexes", "walk_sitemaps"]
