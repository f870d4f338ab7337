"""Relational operators over page URLs: locale and version statistics, scope, sampling, set operations, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions import url as U
from quillmap.session import cut


def narrow_prefix(pages: DataFrame, prefix: str, share: float = 0.01) -> DataFrame:
    """examined, matched and whether the prefix keeps so little that it is probably wrong."""
    hit = F.count_if(U.in_scope(F.col("url"), prefix))
    return pages.agg(F.count("*").alias("examined"), hit.alias("matched")).withColumn("narrow", F.col("matched") < share * F.col("examined"))


def segment_counts(pages: DataFrame) -> DataFrame:
    """How often each path segment stands at each position."""
    at = pages.select(F.posexplode(U.segments(F.col("url"))).alias("position", "segment"))
    return at.groupBy("position", F.lower("segment").alias("segment")).agg(F.count("*").alias("n"))


def locale_counts(pages: DataFrame) -> DataFrame:
    return segment_counts(pages).filter(U.is_locale(F.col("segment")))


def locale_position(pages: DataFrame) -> DataFrame:
    """The first position at which two locales or more stand and over half of the URLs have one."""
    total = pages.agg(F.count("*").alias("total"))
    by = locale_counts(pages).groupBy("position").agg(F.count("*").alias("codes"), F.sum("n").alias("urls"))
    ok = by.join(F.broadcast(total), (F.col("codes") >= 2) & (2 * F.col("urls") > F.col("total")))  # one row
    return ok.orderBy("position").limit(1).select("position", "codes", "urls")


def dominant_segment(pages: DataFrame, position: int = 0) -> DataFrame:
    """The segment that over half of the URLs have at a position, the first in order among equals; no row without one."""
    seg = F.lower(F.get(U.segments(F.col("url")), F.lit(position)))
    each = pages.select(seg.alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    top = each.agg(F.max_by("segment", F.struct("n", F.col("segment").isNotNull())).alias("segment"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.filter("segment is not null and 2 * n > total")


def locale_filter(pages: DataFrame, preferred: str) -> DataFrame:
    """URLs of the preferred locale, or without a locale where none has it."""
    loc = U.locale(F.col("url"))
    any_ = pages.agg(F.coalesce(F.bool_or(loc == preferred), F.lit(False)).alias("_any"))
    return pages.join(F.broadcast(any_), F.when(F.col("_any"), loc == preferred).otherwise(loc.isNull())).drop("_any")  # one row


def natural_key(version: Column) -> Column:
    """Numbers of a version, for comparing as arrays."""
    return F.transform(F.split(F.regexp_replace(F.lower(version), "^v", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(2147483647)))


def version_rank(version: Column) -> Column:
    """Unversioned 3, stable channels 2, numbers 1, pre-releases 0."""
    low = F.lower(version)
    return F.when(version.isNull(), 3).when(low.isin("latest", "stable", "current"), 2).when(low.isin("dev", "next", "nightly", "canary"), 0).otherwise(1)


def version_key(url: Column) -> Column:
    """Path without its first version segment that is not the last segment."""
    segs = U.segments(url)
    body = F.slice(segs, F.lit(1), F.greatest(F.size(segs) - 1, F.lit(0)))
    at = F.array_position(F.transform(body, lambda s: s.rlike(U.VERSION)), True)
    cut = F.concat(F.slice(segs, F.lit(1), (F.greatest(at, F.lit(1)) - 1).cast("int")), F.slice(segs, (at + 1).cast("int"), F.size(segs)))
    return F.concat(U.origin(url), F.lit("/"), F.array_join(F.when(at > 0, cut).otherwise(segs), "/"))


def version_dedupe_runs(urls: DataFrame, preferred: DataFrame, share: float = 0.2) -> DataFrame:
    """(run_id, ordinal, url): one version per page, in runs where `share` of the URLs or more are in groups of several.

    preferred: (run_id, wanted), null where any version will do. Groups are in the place of their first member.
    """
    rows = urls.join(preferred.select("run_id", F.lower("wanted").alias("_w")), "run_id", "left")
    rows = rows.withColumn("_key", version_key(F.col("url"))).withColumn("_v", U.version(F.col("url")))
    group = Window.partitionBy("run_id", "_key")
    mine = F.coalesce(F.lower("_v") == F.col("_w"), F.lit(False))
    best = group.orderBy(mine.desc(), version_rank(F.col("_v")).desc(), natural_key(F.col("_v")).desc(), "ordinal")
    rows = rows.withColumn("_n", F.count("*").over(group)).withColumn("_first", F.min("ordinal").over(group)).withColumn("_rn", F.row_number().over(best))
    dense = rows.groupBy("run_id").agg((F.count_if(F.col("_n") > 1) >= share * F.count("*")).alias("_dense"))
    kept = rows.join(dense, "run_id").filter(~F.col("_dense") | (F.col("_rn") == 1))
    return kept.select("run_id", F.when(F.col("_dense"), F.col("_first")).otherwise(F.col("ordinal")).alias("ordinal"), "url")


def version_dedupe(pages: DataFrame, preferred: str | None = None, share: float = 0.2) -> DataFrame:
    """(url, ordinal): version_dedupe_runs for one list of pages(url, ordinal)."""
    one = pages.withColumn("run_id", F.lit("one"))
    wish = one.sparkSession.range(1).select(F.lit("one").alias("run_id"), F.lit(preferred).cast("string").alias("wanted"))
    return version_dedupe_runs(one.select("run_id", "ordinal", "url"), wish, share).select("url", "ordinal")


def sample_hash(pages: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k URLs in the order of md5(seed:url): a top-k, without a full sort."""
    return pages.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("url")))).orderBy("_h", "url").limit(k).drop("_h")


def sample_stride(pages: DataFrame, k: int) -> DataFrame:
    """URLs at the positions floor(i * n / k) of the sorted list; all if there are k or fewer.

    URLs are range-partitioned, counted per partition, and ranked within each: no task sorts more than a partition, and
    the only table in one task has a row per partition.
    """
    parts = cut(pages.select("url").distinct().repartitionByRange("url").withColumn("_b", F.spark_partition_id()))
    counts = parts.groupBy("_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(0))))
    ranked = parts.join(counts, "_b").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("url")) - 1)
    slot = F.ceil(F.col("_i") * k / F.col("_n"))
    taken = (F.col("_n") <= k) | ((F.floor(slot * F.col("_n") / k) == F.col("_i")) & (slot < k))
    return ranked.filter(taken).select("url", F.col("_i").alias("position"))


def backfill(candidates: DataFrame, k: int, batch: int = 3) -> DataFrame:
    """(run_id, ordinal, url, present) -> the first k present URLs that a batched existence test would keep.

    A batch tests as many as are still missing; no batch starts at or after 2k candidates.
    """

    def one(pdf):
        pdf, kept, at = pdf.sort_values("ordinal"), [], 0
        while len(kept) < k and at < min(len(pdf), 2 * k):
            n = k - len(kept)
            part = pdf.iloc[at : at + n]
            kept += part.index[part["present"]].tolist()
            at += n
        return pdf.loc[kept, ["run_id", "ordinal", "url"]]

    # no batch begins at or after 2k and none is longer than k: later candidates are never looked at
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal"))
    return candidates.withColumn("_place", place).filter(F.col("_place") <= 3 * k).drop("_place").groupBy("run_id").applyInPandas(one, "run_id string, ordinal long, url string")


def merge_first_wins(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ordered union without repeats: (url, ordinal, source), the first list's rows before the second's."""
    both = first.select("url", F.lit(0).alias("source"), "ordinal").unionByName(second.select("url", F.lit(1).alias("source"), "ordinal"))
    return both.groupBy("url").agg(F.min(F.struct("source", "ordinal")).alias("_m")).select("url", "_m.source", "_m.ordinal")


def budget(rows: DataFrame, keys: list[str], order: list, size: str, limit: int, fetches: int | None = None) -> DataFrame:
    """Rows until the running sum of `size` before them reaches the limit (or so many rows were taken)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("used") < limit)
    if fetches is not None:
        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= fetches).drop("_rn")
    return out


def coverage(index: DataFrame, sitemap: DataFrame, omitted_prefixes: list[str] | None = None, exclusions: list[str] | None = None, limits=(95, 80)) -> dict[str, DataFrame]:
    """missing, unmatched, omitted and the rate of sitemap pages that an index lists, by coverage path."""
    normal = lambda df: df.select(U.coverage_path(F.col("url")).alias("path")).distinct()
    listed, pages = normal(index), normal(sitemap)
    pages = pages.filter(~U.is_excluded_path(F.col("path")))
    if exclusions:
        pages = pages.filter(~U.matches_globs(F.col("path"), exclusions))
    omitted = F.lit(False)
    for p in omitted_prefixes or []:  # no segment boundary, as published
        omitted = omitted | F.startswith(F.col("path"), F.lit(p))
    missing = pages.join(listed, "path", "left_anti")
    out = {"omitted": missing.filter(omitted), "missing": missing.filter(~omitted), "unmatched": listed.join(pages, "path", "left_anti")}
    in_both = pages.join(listed.withColumn("_hit", F.lit(1)), "path", "left")
    counts = in_both.agg(F.count("*").alias("pages"), F.count_if(F.col("_hit").isNotNull() | omitted).alias("covered"))
    rate = F.floor(F.coalesce(F.try_divide(100 * F.col("covered"), F.col("pages")), F.lit(100)) + 0.5)
    out["rate"] = counts.withColumn("rate", rate).withColumn("status", F.when(F.col("rate") >= limits[0], "pass").when(F.col("rate") >= limits[1], "warn").otherwise("fail"))
    return out
