"""Locales of many sites at once: where a site's paths carry them, which code stands in for a wanted one, and filters.

All tables have run_id; urls are (run_id, ordinal, url) with one row per URL. Nothing is collected: each step is a join or
an aggregate by run, so sites of any number and size are handled in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions import url as U

c = F.col


def located(urls: DataFrame) -> DataFrame:
    """urls by position of path segment: adds position, code (lower case), is_locale, whole and cut (the path without it)."""
    segs = U.segments(c("url"))
    rows = urls.select("run_id", "ordinal", "url", segs.alias("_s"), F.posexplode(segs).alias("position", "_seg"))
    cut = F.filter("_s", lambda x, i: i != c("position"))
    return rows.select(
        "run_id", "ordinal", "url", "position", F.lower("_seg").alias("code"), U.is_locale(c("_seg")).alias("is_locale"),
        F.array_join("_s", "/").alias("whole"), F.array_join(cut, "/").alias("cut"),
    )


def code_counts(urls: DataFrame) -> DataFrame:
    """(run_id, position, code, n, first): locale codes at each position, with the place where the position is first seen."""
    rows = located(urls).filter("is_locale")
    return rows.groupBy("run_id", "position", "code").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "position")).alias("first"))


def duplicated(urls: DataFrame) -> DataFrame:
    """(run_id, position, code, stripped, shared): of the distinct paths without the code, how many exist unprefixed."""
    rows = located(urls)
    stripped = rows.filter("is_locale").select("run_id", "position", "code", "cut").distinct()
    plain = rows.filter("not is_locale").select("run_id", "position", c("whole").alias("cut"), F.lit(1).alias("_hit")).distinct()
    both = stripped.join(plain, ["run_id", "position", "cut"], "left")
    return both.groupBy("run_id", "position", "code").agg(F.count("*").alias("stripped"), F.count("_hit").alias("shared"))


def positions(urls: DataFrame) -> DataFrame:
    """(run_id, position): where a site's paths carry locales; no row for sites that do not.

    First choice: two codes or more that over half of the URLs have. Else a code whose paths without it are, for over
    half of them, paths of the site too. Of several positions the one that is seen first counts.
    """
    total = urls.groupBy("run_id").agg(F.count("*").alias("_total"))
    codes = code_counts(urls)
    by = codes.groupBy("run_id", "position").agg(F.count("*").alias("_codes"), F.sum("n").alias("_n"), F.min("first").alias("_first"))
    strong = by.join(total, "run_id").withColumn("_strong", (c("_codes") >= 2) & (2 * c("_n") > c("_total")))
    twice = duplicated(urls).filter(2 * c("shared") > c("stripped")).select("run_id", "position", F.lit(True).alias("_twice")).distinct()
    found = strong.join(twice, ["run_id", "position"], "left").filter(c("_strong") | c("_twice"))
    order = F.struct((~c("_strong")).alias("weak"), c("_first"))
    return found.groupBy("run_id").agg(F.min_by("position", order).alias("position"))


def script_of(code: Column) -> Column:
    parts = F.split(F.lower(code), "-")
    return F.get(F.filter(F.slice(parts, 2, 9), lambda p: p.isin(U.SCRIPTS.split())), F.lit(0))


def stands_in(code: Column, wanted: Column) -> Column:
    """Whether a code has the wanted language, and no other script where both name one."""
    same = F.get(F.split(F.lower(code), "-"), F.lit(0)) == F.get(F.split(F.lower(wanted), "-"), F.lit(0))
    a, b = script_of(code), script_of(wanted)
    return same & F.coalesce(a == b, F.lit(True))


def variants(available: DataFrame, wanted: Column) -> DataFrame:
    """Of (run_id, code, n): the codes that stand in for the wanted one with their rank from 1. An exact match is alone;
    others are ranked by n, then by code."""
    rows = available.withColumn("_exact", c("code") == F.lower(wanted))
    any_ = F.bool_or("_exact").over(Window.partitionBy("run_id"))
    rows = rows.withColumn("_any", any_).filter(c("_exact") | (~c("_any") & stands_in(c("code"), wanted)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(c("n").desc(), "code"))).select("run_id", "code", "n", "rank")


def _at(urls: DataFrame) -> DataFrame:
    """urls of sites with a locale position, with it and the segment there (null on shorter paths)."""
    rows = urls.join(positions(urls), "run_id")
    return rows.withColumn("_seg", F.lower(F.get(U.segments(c("url")), c("position").cast("int"))))


def _chosen(at: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, _target, _exact, _variant) of the sites that want a locale: whether any URL has it, and else the best variant."""
    rows = at.join(wanted.select("run_id", F.lower("wanted").alias("_target")), "run_id")
    exact = rows.groupBy("run_id", "_target").agg(F.coalesce(F.bool_or(c("_seg") == c("_target")), F.lit(False)).alias("_exact"))
    codes = rows.filter(U.is_locale(c("_seg"))).groupBy("run_id", "_target", c("_seg").alias("code")).agg(F.count("*").alias("n"))
    best = _ranked(codes).filter("rank = 1").select("run_id", c("code").alias("_variant"))
    return exact.join(best, "run_id", "left")


def _ranked(codes: DataFrame) -> DataFrame:
    """variants() for (run_id, _target, code, n), each run with a target of its own."""
    fit = codes.filter(stands_in(c("code"), c("_target")))
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy((c("code") == c("_target")).desc(), c("n").desc(), "code")))


def one_locale(urls: DataFrame, wanted: DataFrame) -> DataFrame:
    """urls in the locale that each run (run_id, wanted) wants, English where that is null: pages with that very segment,
    else the best variant of its language, else unprefixed ones. Paths too short to tell stay, as do sites without
    locales, and sites of which nothing would be left."""
    wish = wanted.select("run_id", F.coalesce("wanted", F.lit("en")).alias("wanted"))
    at = _at(urls)
    rows = at.join(_chosen(at, wish), "run_id", "left")
    target = F.when(c("_exact"), c("_target")).otherwise(c("_variant"))
    keep = c("_seg").isNull() | F.when(target.isNotNull(), c("_seg") == target).otherwise(~U.is_locale(c("_seg")))
    rows = rows.withColumn("_keep", keep)
    left = rows.groupBy("run_id").agg(F.bool_or("_keep").alias("_any"), F.count("*").alias("_n"))
    judged = rows.join(left, "run_id").filter(c("_keep") | ~c("_any") | (c("_n") < 2)).select(*urls.columns)
    return urls.join(positions(urls).select("run_id"), "run_id", "left_anti").select(*urls.columns).unionByName(judged)


def coverage_scope(pages: DataFrame, listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sitemap pages that a coverage rate is about, with the column locale (null where nothing was cut).

    A run that wants a locale (run_id, wanted) gets its pages, else those of the best variant, else unprefixed ones;
    short paths go. Without a wish the segment that most listed URLs have there decides; where none does and under half
    of them have a locale, unprefixed pages count.
    """
    at = _at(pages)
    wish = wanted.filter("wanted is not null")
    chosen = _chosen(at, wish).select("run_id", F.coalesce(F.when(c("_exact"), c("_target")), c("_variant")).alias("_code"), F.lit(True).alias("_wish"))
    there = listed.join(at.select("run_id", "position").distinct(), "run_id")
    seg = F.lower(F.get(U.segments(c("url")), c("position").cast("int")))
    segs = there.withColumn("_seg", seg).groupBy("run_id", "_seg").agg(F.count("*").alias("_k"), F.count_if(U.is_locale(c("_seg"))).alias("_loc"), F.min("ordinal").alias("_o"))
    usual = segs.groupBy("run_id").agg(
        F.max_by("_seg", F.when(c("_seg").isNotNull(), F.struct("_k", -c("_o")))).alias("_top"), F.max(F.when(c("_seg").isNotNull(), c("_k"))).alias("_most"), F.sum("_k").alias("_all"), F.sum("_loc").alias("_with"))
    usual = usual.select("run_id", F.when(2 * c("_most") > c("_all"), c("_top")).alias("_dominant"), (2 * c("_with") < c("_all")).alias("_plain"))
    rows = at.join(chosen, "run_id", "left").join(usual, "run_id", "left")
    wishes, plain = F.coalesce("_wish", F.lit(False)), ~F.coalesce(U.is_locale(c("_seg")), F.lit(False))
    code = F.when(wishes, c("_code")).otherwise(c("_dominant"))
    unprefixed = code.isNull() & (wishes | F.coalesce("_plain", F.lit(False)))
    keep = F.when(code.isNotNull(), F.coalesce(c("_seg") == code, F.lit(False))).when(unprefixed, plain).otherwise(F.lit(True))
    rows = rows.withColumn("_keep", keep).withColumn("_label", F.when(code.isNotNull(), code).when(unprefixed, F.lit("default")))
    cut = F.bool_or(~c("_keep")).over(Window.partitionBy("run_id"))
    judged = rows.withColumn("locale", F.when(cut, c("_label"))).filter("_keep").select(*pages.columns, "locale")
    others = pages.join(at.select("run_id").distinct(), "run_id", "left_anti").withColumn("locale", F.lit(None).cast("string"))
    return others.select(*pages.columns, "locale").unionByName(judged)


# Fixed value: how names of sitemaps write a locale, language[-script][-region] in this order.
CODE = r"([a-z]{2}(?:-[a-z]{4})?(?:-[a-z]{2})?)"


def sitemap_code(url: Column) -> Column:
    """The locale that a child sitemap's name or folder tells: sitemap-fr.xml, /fr/sitemap.xml, docs_fr-fr_3.xml."""
    path = U.path(url)
    tails = F.split(path, "[_-]")
    # the end of the path from each delimiter on, from left to right
    after = lambda i: F.aggregate(F.slice(tails, 1, i), F.lit(1), lambda n, t: n + F.length(t) + 1)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tails) - 1, F.lit(1))), lambda i: F.substring(path, after(i), F.length(path)))
    names = F.transform(ends, lambda e: F.regexp_extract(e, rf"(?i)^{CODE}(?:[_-][0-9]+)?\.xml$", 1))
    all_ = F.concat(F.array(F.regexp_extract(path, rf"(?i)/sitemap-{CODE}\.xml$", 1), F.regexp_extract(path, rf"(?i)/{CODE}/sitemap[^/]*\.xml$", 1)), names)
    return F.lower(F.get(F.filter(all_, lambda x: (x != "") & U.is_locale(x)), F.lit(0)))


def locale_sitemaps(children: DataFrame, wanted: DataFrame) -> DataFrame:
    """Child sitemaps (run_id, url, ...) in the wanted locale's language, or English, with those that tell no locale.

    All stay where under two locales are told, or where the wish is no locale code (a site's own name for one).
    """
    rows = children.withColumn("_code", sitemap_code(c("url"))).join(wanted.select("run_id", F.lower("wanted").alias("_w")), "run_id", "left")
    kinds = rows.groupBy("run_id").agg(F.count_distinct("_code").alias("_codes"), F.max("_w").alias("_w")).withColumn("_own", c("_w").isNotNull() & ~U.is_locale(c("_w")))
    codes = rows.filter("_code is not null").groupBy("run_id", c("_code").alias("code")).agg(F.count("*").alias("n"))
    fit = lambda target: codes.join(kinds.select("run_id", target.alias("_t")), "run_id").filter(stands_in(c("code"), c("_t"))).withColumn("_x", F.bool_or(c("code") == c("_t")).over(Window.partitionBy("run_id"))).filter(~c("_x") | (c("code") == c("_t")))
    mine = fit(F.coalesce("_w", F.lit("en"))).select("run_id", c("code").alias("_code"), F.lit(1).alias("_mine"))
    english = fit(F.lit("en")).select("run_id", c("code").alias("_code"), F.lit(1).alias("_english"))
    has = mine.select("run_id", F.lit(1).alias("_has")).distinct()
    rows = rows.drop("_w").join(kinds, "run_id").join(mine, ["run_id", "_code"], "left").join(english, ["run_id", "_code"], "left").join(has, "run_id", "left")
    keep = c("_own") | (c("_codes") < 2) | c("_code").isNull() | F.when(c("_has").isNotNull(), c("_mine").isNotNull()).otherwise(c("_english").isNotNull())
    judged = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    none = ~F.bool_or("_keep").over(Window.partitionBy("run_id"))
    return judged.withColumn("_none", none).filter(c("_keep") | c("_none")).select(*children.columns)
