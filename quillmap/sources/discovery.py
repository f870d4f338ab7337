"""Pages of sites: from llms.txt, merged with sitemaps where that list is thin, else sitemaps alone, else the base URL; and samples.

All steps are joins and aggregates by run_id over the capture table, so any number of sites is one plan. runs has run_id and
base_url, and may have effective_origin (where the site's index turned out to live).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.dims import Options
from quillmap.functions import url as U
from quillmap.operators import locales, page_ops
from quillmap.session import cut
from quillmap.sources import indexes
from quillmap.sources.capture import variant

c = F.col
# Names of sitemaps that robots.txt does not tell, and pages that a sitemap adds at most.
SITEMAP_NAMES, MOST_PAGES, MOST_COVERAGE_PAGES = ("sitemap.xml", "sitemap-index.xml", "sitemap_index.xml"), 500, 50_000


def with_effective_origin(runs: DataFrame, files: DataFrame) -> DataFrame:
    """runs with effective_origin: the first origin other than the site's to which its llms.txt files redirect; null without one."""
    home = runs.select("run_id", U.origin(c("base_url")).alias("_o"))
    moved = files.join(home, "run_id").withColumn("_to", U.origin(F.coalesce("final_url", "url"))).filter("_to <> _o")
    first = moved.groupBy("run_id").agg(F.min_by("_to", "ordinal").alias("effective_origin"))
    return runs.drop("effective_origin").join(first, "run_id", "left")


def scope_base(base: Column, effective: Column) -> Column:
    """The URL whose path scopes discovery: the base, moved along with a redirect within the site; a foreign origin as a whole."""
    stays = effective.isNull() | (effective == U.origin(base))
    moved = F.concat(effective, F.regexp_replace(U.path(base), "/$", ""))
    return F.when(stays, base).when(U.same_site(U.origin(base), effective), moved).otherwise(effective)


def _swapped(url: Column, found: Column, wanted: str | None) -> Column:
    """url with its first segment that equals `found` replaced."""
    if wanted is None:
        return url
    segs = U.segments(url)
    at = F.array_position(F.transform(segs, F.lower), F.lower(found)) - 1
    new = F.transform(segs, lambda s, i: F.when(i == at, F.lit(wanted)).otherwise(s))
    return F.when(found.isNotNull() & (F.lower(found) != wanted.lower()), F.concat(U.origin(url), F.lit("/"), F.array_join(new, "/"))).otherwise(url)


def scopes(runs: DataFrame, options: Options) -> DataFrame:
    """(run_id, rank, path): path prefixes of a site's pages, with the preferred locale and version in place of the base's.

    Where the preference is a variant of the base's own language, the base's path is a second scope.
    """
    effective = c("effective_origin") if "effective_origin" in runs.columns else F.lit(None).cast("string")
    rows = runs.select("run_id", scope_base(c("base_url"), effective).alias("_base"))
    wanted = options.preferred_locale.lower() if options.preferred_locale else None
    versioned = lambda x: _swapped(x, U.version(x), options.preferred_version)
    rows = rows.withColumn("_loc", U.locale(c("_base"))).withColumn("_main", versioned(_swapped(c("_base"), c("_loc"), wanted)))
    if wanted is None:
        both = F.array("_main")
    else:
        kin = U.is_locale(F.lit(wanted)) & c("_loc").isNotNull() & (c("_loc") != wanted) & locales.stands_in(c("_loc"), F.lit(wanted))
        both = F.when(F.coalesce(kin, F.lit(False)), F.array(c("_main"), versioned(c("_base")))).otherwise(F.array("_main"))
    each = rows.select("run_id", F.posexplode(F.array_distinct(both)).alias("rank", "_url"))
    return each.select("run_id", "rank", F.regexp_replace(U.path(c("_url")), "/$", "").alias("path"))


def in_scopes(urls: DataFrame, where: DataFrame) -> DataFrame:
    """urls under a scope of their run; at most two scopes a run, so they travel as a short array."""
    paths = where.groupBy("run_id").agg(F.collect_list("path").alias("_paths"))
    p = U.path(c("url"))
    under = F.exists("_paths", lambda x: (x == "") | (p == x) | F.startswith(p, F.concat(x, F.lit("/"))))
    return urls.join(paths, "run_id").filter(~U.is_url(c("url")) | under).drop("_paths")


def sitemap_roots(runs: DataFrame, capture: DataFrame, docs: bool = False) -> DataFrame:
    """(run_id, ordinal, url): sitemaps that robots.txt tells, at the origin, else at the effective one; else the usual names
    there and under the base path. docs: the usual names under the base path only (for sites whose root has another sitemap)."""
    effective = c("effective_origin") if "effective_origin" in runs.columns else F.lit(None).cast("string")
    rows = runs.select("run_id", U.origin(c("base_url")).alias("_o"), effective.alias("_e"), F.regexp_replace(U.path(c("base_url")), "/$", "").alias("_p"))
    at = F.coalesce("_e", "_o")
    deep = F.when(c("_p") != "", F.array(*[F.concat(at, c("_p"), F.lit(f"/{n}")) for n in SITEMAP_NAMES])).otherwise(F.array().cast("array<string>"))
    if docs:
        return rows.select("run_id", F.posexplode(deep).alias("ordinal", "url"))
    robots = rows.select("run_id", F.posexplode(F.array_distinct(F.filter(F.array("_o", "_e"), lambda x: x.isNotNull()))).alias("_rank", "_at")).withColumn("url", F.concat("_at", F.lit("/robots.txt")))
    told = robots.join(variant(capture).filter("status between 200 and 299").select("run_id", "url", "body"), ["run_id", "url"])
    lines = told.select("run_id", "_rank", F.posexplode(F.split("body", "\n")).alias("ordinal", "_line"))
    lines = lines.withColumn("url", F.regexp_extract("_line", r"(?i)^\s*Sitemap:\s*(\S+)", 1)).filter("url <> ''")
    first = lines.withColumn("_best", F.min("_rank").over(Window.partitionBy("run_id"))).filter("_rank = _best").select("run_id", "ordinal", "url")
    usual = F.concat(F.array(*[F.concat(at, F.lit(f"/{n}")) for n in SITEMAP_NAMES]), deep)
    rest = rows.join(first.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.posexplode(usual).alias("ordinal", "url"))
    return first.unionByName(rest)


def _ranked(urls: DataFrame, order: list, *more: str) -> DataFrame:
    return urls.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("long")).select("run_id", "ordinal", "url", *more)


@dataclass
class Discovery:
    """urls (run_id, ordinal, url, original_md), sources (run_id, source), warnings (run_id, warning)."""

    urls: DataFrame
    sources: DataFrame
    warnings: DataFrame


def discover(runs: DataFrame, capture: DataFrame, files: DataFrame, options: Options = Options()) -> Discovery:
    where = scopes(runs, options)
    wish = lambda own, preferred: runs.select("run_id", (F.lit(preferred) if preferred else own).cast("string").alias("wanted"))
    locale, version = wish(U.locale(c("base_url")), options.preferred_locale), wish(U.version(c("base_url")), options.preferred_version)

    def refined(urls: DataFrame) -> DataFrame:
        return page_ops.version_dedupe_runs(locales.one_locale(urls, locale), version)

    # lists that later steps read several times are cut: unfolded, their plans would multiply
    walked = indexes.walk_indexes(files, capture)["pages"]
    listed = cut(_ranked(walked, ["ordinal"], "original_md"))
    scoped = in_scopes(listed, where)
    first = cut(refined(scoped.select("run_id", "ordinal", "url")))
    counts = runs.select("run_id").join(first.groupBy("run_id").agg(F.count("*").alias("_n")), "run_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    full = first.join(counts.filter(c("_n") >= options.max_links).select("run_id"), "run_id", "left_semi")

    short = runs.join(counts.filter(c("_n") < options.max_links).select("run_id"), "run_id", "left_semi")
    roots = sitemap_roots(short, capture)
    maps = indexes.walk_sitemaps(capture, roots, most=20 * MOST_PAGES, wanted=locale)
    maps = cut(_ranked(in_scopes(maps, where), ["ordinal"]))
    pool = scoped.join(short.select("run_id"), "run_id", "left_semi").select("run_id", F.lit(0).alias("_source"), "ordinal", "url").unionByName(maps.select("run_id", F.lit(1).alias("_source"), "ordinal", "url"))
    # the first list's rows before the second's, each URL once
    merged = pool.groupBy("run_id", "url").agg(F.min(F.struct("_source", "ordinal")).alias("_m")).select("run_id", "url", "_m._source", "_m.ordinal")
    merged = _ranked(merged, ["_source", "ordinal"], "_source")
    # a run without a page of its own list has the sitemap alone
    own = first.select("run_id").distinct().withColumn("_own", F.lit(True))
    merged = cut(merged.join(own, "run_id", "left").filter((c("_source") == 1) | c("_own")))
    kept = refined(merged.select("run_id", "ordinal", "url")).join(merged.select("run_id", "url", "_source"), ["run_id", "url"])
    added = F.sum("_source").over(Window.partitionBy("run_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    thin = kept.withColumn("_added", added).filter((c("_source") == 0) | (c("_added") <= MOST_PAGES)).select("run_id", "ordinal", "url")
    found = cut(full.select("run_id", "ordinal", "url").unionByName(thin))
    bare = runs.join(found.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.lit(1).cast("long").alias("ordinal"), c("base_url").alias("url"))
    urls = found.unionByName(bare).join(listed.select("run_id", "url", "original_md"), ["run_id", "url"], "left")

    sources = own.select("run_id", F.lit("llms-txt").alias("source")).unionByName(maps.select("run_id").distinct().withColumn("source", F.lit("sitemap"))).unionByName(bare.select("run_id", F.lit("fallback").alias("source")))
    seen = listed.groupBy("run_id").agg(F.count("*").alias("_all")).join(scoped.groupBy("run_id").agg(F.count("*").alias("_in")), "run_id", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    prefix = where.filter("rank = 0 and path <> ''").select("run_id", "path")
    narrow = seen.filter(c("_in") < 0.01 * c("_all")).join(prefix, "run_id").select("run_id", F.format_string("only %d of %d links of llms.txt are under %s", "_in", "_all", "path").alias("warning"))
    gzip = indexes.gzipped_sitemaps(capture, roots).select("run_id", F.concat(F.lit("skipped gzipped sitemap "), "url").alias("warning"))
    return Discovery(urls.select("run_id", "ordinal", "url", "original_md"), sources, narrow.unionByName(gzip))


def sample(urls: DataFrame, capture: DataFrame, options: Options = Options()) -> DataFrame:
    """The sample of each run: (run_id, ordinal, url, original_md), max_links pages at most.

    random: in the order of md5(seed:url). deterministic: pages at even strides of the sorted list first, then the rest.
    Pages that are known only from a .md link are passed over where the capture says that they are missing (404 or 410);
    the next in order take their places, while fewer than twice max_links were looked at when a batch begins.
    """
    k, run = options.max_links, Window.partitionBy("run_id")
    rows = urls.withColumn("_n", F.count("*").over(run))
    if options.sampling_strategy == "deterministic":
        i = F.row_number().over(run.orderBy("url")) - 1
        slot = F.ceil(c("_i") * k / c("_n"))
        rows = rows.withColumn("_i", i).withColumn("_late", ~((F.floor(slot * c("_n") / k) == c("_i")) & (slot < k)))
        order = [F.when(c("_n") > k, c("_late")), F.when(c("_n") > k, c("_i")), "ordinal"]
    else:
        order = [F.when(c("_n") > k, F.md5(F.concat(F.lit(f"{options.seed}:"), "url"))), "ordinal"]
    rows = rows.withColumn("_turn", F.row_number().over(run.orderBy(*order)).cast("long")).filter(c("_turn") <= 3 * k)
    status = variant(capture).select("run_id", "url", "status").dropDuplicates(["run_id", "url"])
    rows = rows.join(status, ["run_id", "url"], "left")
    present = c("original_md").isNull() | F.coalesce(~c("status").isin(404, 410), F.lit(True))
    kept = page_ops.backfill(rows.select("run_id", c("_turn").alias("ordinal"), "url", present.alias("present")), k)
    return kept.join(urls.select("run_id", "url", "original_md"), ["run_id", "url"]).select("run_id", "ordinal", "url", "original_md")


def sampled_pages(runs: DataFrame, capture: DataFrame, files: DataFrame, options: Options = Options(), curated: DataFrame | None = None) -> tuple[DataFrame, Discovery]:
    """(run_id, ordinal, url, original_md, tag) of the pages to test, and what discovery says.

    curated: (run_id, url, tag) of listed pages, the sample itself under that strategy; "none" tests the base URL alone.
    """
    spark = runs.sparkSession
    no_text = F.lit(None).cast("string")
    base = runs.select("run_id", F.lit(0).cast("long").alias("ordinal"), c("base_url").alias("url"), no_text.alias("original_md"), no_text.alias("tag"))
    quiet = Discovery(base.select("run_id", "ordinal", "url", "original_md"), spark.createDataFrame([], "run_id string, source string"), spark.createDataFrame([], "run_id string, warning string"))
    if options.sampling_strategy == "curated" and curated is not None:
        listed = curated.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal") if "ordinal" in curated.columns else Window.partitionBy("run_id").orderBy("url")).cast("long"))
        listed = listed.select("run_id", "ordinal", "url", no_text.alias("original_md"), "tag")
        rest = base.join(listed.select("run_id").distinct(), "run_id", "left_anti")
        return listed.unionByName(rest), quiet
    if options.sampling_strategy in ("none", "curated"):
        return base, quiet
    found = discover(runs, capture, files, options)
    return with_base(sample(found.urls, capture, options), runs), found


def with_base(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Sampled pages with a tag column, and the base URL of runs that have none."""
    no_text = F.lit(None).cast("string")
    rest = runs.join(pages.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.lit(0).cast("long").alias("ordinal"), c("base_url").alias("url"), no_text.alias("original_md"), no_text.alias("tag"))
    return pages.withColumn("tag", no_text).unionByName(rest)
