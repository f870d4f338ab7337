"""Scoring of audit runs as joins and aggregates.

Tables:
  check_result(run_id, check_id, status, pass_bucket, warn_bucket, fail_bucket, rate, requests, failed, max_chars)
  item_result(run_id, check_id, url, status)   statuses from item_status(), one row per page or file
  run(run_id, sampling_strategy, tested_pages, requests, failed)
  run_tag(run_id, url, tag)
All results keep run_id, so that one job scores any number of runs; the check dimension has 28 rows and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.dims import MIN_PAGES, TRUNCATION_LIMIT, dim_values


def dim_check(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {dim_values()} AS d")


def grade(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None))
    for least, name in ((100, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D")):
        out = out.when(score >= least, name)
    return out.otherwise("F")


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def item_status(row: dict[str, Column]) -> Column:
    """Status of a page or file of one check, from what the check said about it.

    row: check_id, status, classification, found, position_percent, error, supported, skipped, generic_majority,
    cross_group, link_count, has_h1, has_quote, characters.
    """
    c, check = row["classification"], row["check_id"]
    classes = (
        F.when(c.isin("markdown-with-correct-type", "correct-error", "no-redirect", "same-host", "accessible"), "pass")
        .when(c.isin("markdown-with-wrong-type", "cross-host", "soft-auth-gate"), "warn")
        .when(c.isin("html", "soft-404", "js-redirect", "auth-required", "auth-redirect"), "fail")
        .otherwise("skip")
    )
    found = F.coalesce(row["found"], F.lit(False))
    return (
        F.when(F.coalesce(row["skipped"], F.lit(False)), "skip")
        .when(check.isin("content-negotiation", "http-status-codes", "redirect-behavior", "auth-gate-detection"), classes)
        .when(check == "markdown-url-support", F.when(F.coalesce(row["supported"], F.lit(False)), "pass").otherwise("fail"))
        .when(
            check.isin("llms-txt-directive-html", "llms-txt-directive-md"),
            F.when(row["error"].isNotNull(), "skip").when(~found, "fail").when(row["position_percent"] > 50, "warn").otherwise("pass"),
        )
        .when(check == "section-header-quality", F.when(F.coalesce(row["generic_majority"], F.lit(False)), "fail").when(F.coalesce(row["cross_group"], F.lit(False)), "warn").otherwise("pass"))
        .when(check == "llms-txt-valid", F.when(F.coalesce(row["link_count"], F.lit(0)) == 0, "fail").when(row["has_h1"] & row["has_quote"], "pass").otherwise("warn"))
        .when(check == "llms-txt-size", F.when(row["characters"] <= 50_000, "pass").when(row["characters"] <= TRUNCATION_LIMIT, "warn").otherwise("fail"))
        .otherwise(F.coalesce(row["status"], F.lit("skip")))
    )


def _shares(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count("*").alias("_items"), F.count_if(F.col("status") == "pass").alias("_p"), F.count_if(F.col("status") == "warn").alias("_w"),
        F.count_if(F.col("status") == "fail").alias("_f"),
    )


def proportions(results: DataFrame, items: DataFrame, dim: DataFrame) -> DataFrame:
    """check_result rows that count, with the dimension and proportion.

    Skipped and failed-to-run checks are left out. Buckets, items and rates fall back to the status where they are
    missing; items that are all unscorable give 0, but for http-status-codes, which falls back.
    """
    ran = results.drop("category", "ordinal").filter(~F.col("status").isin("skip", "error")).join(F.broadcast(dim), "check_id")
    rows = ran.join(_shares(items, ["run_id", "check_id"]), ["run_id", "check_id"], "left")
    warn = F.col("warn_coefficient")
    by_status = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", warn).otherwise(0.0)
    zero = F.lit(0)
    p, w, f = (F.coalesce(F.col(c), zero) for c in ("pass_bucket", "warn_bucket", "fail_bucket"))
    buckets = F.try_divide(p + w * warn, p + w + f)
    scored = F.col("_p") + F.col("_w") + F.col("_f")
    from_items = F.when((F.col("_items") > 0) & ((scored > 0) | (F.col("check_id") != "http-status-codes")), F.coalesce(F.try_divide(F.col("_p") + F.col("_w") * warn, scored), F.lit(0.0)))
    severity = F.least(F.lit(1.0), F.try_divide(F.col("failed"), F.col("requests")) / 0.5)
    sliding = F.when((F.col("status") == "warn") & (F.col("requests") > 0), warn + (1 - warn) * (1 - severity))
    rule = F.col("proportion_rule")
    special = F.when(rule == "buckets", buckets).when(rule == "items", from_items).when(rule == "rate", F.col("rate") / 100).when(rule == "sliding", sliding)
    return rows.withColumn("proportion", F.coalesce(special, by_status).cast("double")).drop("_items", "_p", "_w", "_f")


def coefficients(results: DataFrame) -> DataFrame:
    """Per run: discovery, html and index coefficients."""
    def of(check: str, column: str = "status") -> Column:
        return F.max(F.when(F.col("check_id") == check, F.col(column)))

    wide = results.groupBy("run_id").agg(
        of("content-negotiation").alias("cn"), of("llms-txt-directive-html").alias("dh"), of("llms-txt-directive-md").alias("dm"),
        of("llms-txt-links-markdown").alias("lm"), of("rendering-strategy").alias("rs"), of("llms-txt-size").alias("sz"),
        *[of("rendering-strategy", f"{b}_bucket").alias(f"rs_{b}") for b in ("pass", "warn", "fail")], of("llms-txt-size", "max_chars").alias("chars"),
    )
    is_ = lambda c: F.coalesce(F.col(c) == "pass", F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = n("rs_pass") + n("rs_warn") + n("rs_fail")
    html = F.when(F.col("rs").isNull() | F.col("rs").isin("skip", "error"), 1.0).otherwise(F.coalesce(F.try_divide(n("rs_pass") + 0.5 * n("rs_warn"), total), F.lit(1.0)))
    index = F.when(F.col("sz") == "warn", 0.8).when(F.col("sz") == "fail", F.when(n("chars") > 0, F.least(F.lit(1.0), TRUNCATION_LIMIT / F.col("chars"))).otherwise(0.5)).otherwise(1.0)
    return wide.select(
        "run_id", F.when(is_("cn"), 1.0).when(is_("dh") | is_("dm"), 0.8).when(is_("lm"), 0.5).otherwise(0.0).alias("discovery"),
        html.cast("double").alias("html"), index.cast("double").alias("index"),
    )


def check_scores(results: DataFrame, items: DataFrame, runs: DataFrame, dim: DataFrame) -> DataFrame:
    """Per run and check: weight, coefficient, proportion, earned and whether it counts (numeric) or not (not applicable)."""
    rows = proportions(results, items, dim).join(coefficients(results), "run_id").join(runs.select("run_id", "sampling_strategy", "tested_pages"), "run_id")
    group = F.col("coefficient_group")
    coefficient = F.when(group == "discovery", F.col("discovery")).when(group == "html", F.col("html")).when(group == "index", F.col("index")).otherwise(1.0)
    few = F.coalesce(F.col("sampling_strategy").isin("random", "deterministic") & (F.col("tested_pages") < MIN_PAGES), F.lit(False))
    out = rows.withColumn("coefficient", coefficient).withColumn("effective_weight", F.col("weight") * F.col("coefficient"))
    return out.withColumn("earned", F.col("proportion") * F.col("effective_weight")).withColumn("numeric", ~(few & F.col("page_level"))).select(
        "run_id", "check_id", "category", "ordinal", "status", "weight", "warn_coefficient", "coefficient", "effective_weight", "proportion", "earned", "numeric")


def caps(scores: DataFrame, results: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per run the lowest cap and what set it; the first of equals in the order of the rules."""
    missing = results.filter("check_id = 'llms-txt-exists' and status = 'fail'").select("run_id", F.lit(59).alias("cap"), F.lit(0).alias("o"), F.col("check_id").alias("cause"))
    critical = scores.filter(F.col("check_id").isin("rendering-strategy", "auth-gate-detection") & F.col("numeric") & (F.col("proportion") <= 0.5))
    critical = critical.select("run_id", F.when(F.col("proportion") <= 0.25, 39).otherwise(59).alias("cap"), F.when(F.col("check_id") == "rendering-strategy", 1).otherwise(2).alias("o"), F.col("check_id").alias("cause"))
    found = diagnostics.filter(F.col("diagnostic").isin("no-viable-path", "single-page-sample"))
    found = found.select("run_id", F.when(F.col("diagnostic") == "no-viable-path", 39).otherwise(59).alias("cap"), F.when(F.col("diagnostic") == "no-viable-path", 3).otherwise(4).alias("o"), F.col("diagnostic").alias("cause"))
    each = missing.unionByName(critical).unionByName(found)
    return each.groupBy("run_id").agg(F.min(F.struct("cap", "o", "cause")).alias("m")).select("run_id", "m.cap", F.col("m.cause").alias("cap_cause"))


def overall(scores: DataFrame, runs: DataFrame, cap_rows: DataFrame) -> DataFrame:
    """Per run: raw score, cap where it is below, score and grade; 0 where nothing counts."""
    sums = scores.filter("numeric").groupBy("run_id").agg(F.sum("earned").alias("e"), F.sum("effective_weight").alias("m"))
    rows = runs.select("run_id").join(sums, "run_id", "left").join(cap_rows, "run_id", "left")
    raw = F.coalesce(F.try_divide(100 * F.col("e"), F.col("m")), F.lit(0.0))
    out = rows.withColumn("raw", raw).withColumn("score", rounded(F.least("raw", F.coalesce("cap", F.lit(1000)).cast("double"))).cast("long"))
    binds = F.col("cap") < F.col("raw")
    return out.select("run_id", "raw", F.when(binds, F.col("cap")).alias("cap"), F.when(binds, F.col("cap_cause")).alias("cap_cause"), "score", grade(F.col("score")).alias("grade"))


def categories(scores: DataFrame) -> DataFrame:
    """Per run and category: score and grade, null where all scored checks are not applicable."""
    sums = scores.groupBy("run_id", "category").agg(
        F.sum(F.when(F.col("numeric"), F.col("earned"))).alias("e"), F.sum(F.when(F.col("numeric"), F.col("effective_weight"))).alias("m"), F.bool_or("numeric").alias("any"))
    score = F.when(F.col("any"), rounded(F.coalesce(F.try_divide(100 * F.col("e"), F.col("m")), F.lit(0.0)))).cast("long")
    return sums.select("run_id", "category", score.alias("score")).withColumn("grade", grade(F.col("score")))


def totals(scores: DataFrame) -> DataFrame:
    """Earned and maximum by category and in all, as grouping sets (category null: the run)."""
    return scores.filter("numeric").groupingSets([["run_id"], ["run_id", "category"]], "run_id", "category").agg(
        F.sum("earned").alias("earned"), F.sum("effective_weight").alias("maximum"))


SITE_LEVEL = ["llms-txt-exists", "llms-txt-valid", "llms-txt-size", "llms-txt-links-resolve", "llms-txt-links-markdown", "llms-txt-coverage"]


def tag_scores(scores: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """Per run and tag: score and grade over the tag's pages, and its pages; tags without scorable pages have no row."""
    mine = items.filter(~F.col("check_id").isin(SITE_LEVEL)).join(tags, ["run_id", "url"])
    shares = _shares(mine, ["run_id", "tag", "check_id"]).withColumn("_n", F.col("_p") + F.col("_w") + F.col("_f")).filter("_n > 0")
    each = shares.join(scores.select("run_id", "check_id", "effective_weight", "warn_coefficient"), ["run_id", "check_id"])
    part = (F.col("_p") + F.col("_w") * F.col("warn_coefficient")) / F.col("_n")
    out = each.groupBy("run_id", "tag").agg(F.sum(part * F.col("effective_weight")).alias("e"), F.sum("effective_weight").alias("m")).filter("m > 0")
    pages = tags.groupBy("run_id", "tag").agg(F.count_distinct("url").alias("pages"))
    out = out.withColumn("score", rounded(100 * F.col("e") / F.col("m")).cast("long")).join(pages, ["run_id", "tag"])
    return out.select("run_id", "tag", "pages", "score", grade(F.col("score")).alias("grade"))
