"""Cross-check diagnostics: one wide row per run, one predicate per rule in order, and the true ones as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.dims import MIN_PAGES

#: diagnostic: severity, in the order of evaluation
DIAGNOSTICS = {
    "markdown-undiscoverable": "warning", "markdown-partially-discoverable": "warning", "truncated-index": "warning",
    "spa-shell-html-invalid": "info", "sparse-content-html": "info", "no-viable-path": "critical", "auth-no-alternative": "critical",
    "page-size-no-markdown-escape": "warning", "dynamic-content-rendered-statically": "warning", "bot-protection-scan-reliability": "warning",
    "single-page-sample": "warning", "cross-origin-llms-txt": "warning", "gzipped-sitemap-skipped": "info", "rate-limiting-severe": "warning",
}


def flattening(symptoms: DataFrame) -> DataFrame:
    """(run_id, page_key, directions): pages with two or more distinct directions of symptoms."""
    return symptoms.groupBy("run_id", "page_key").agg(F.count_distinct("direction").alias("directions")).filter("directions >= 2")


def _wide(results: DataFrame) -> DataFrame:
    def of(check: str, column: str = "status") -> Column:
        return F.max(F.when(F.col("check_id") == check, F.col(column)))

    return results.groupBy("run_id").agg(
        of("markdown-url-support").alias("md"), of("content-negotiation").alias("cn"), of("llms-txt-directive-html").alias("dh"),
        of("llms-txt-exists").alias("ex"), of("llms-txt-size").alias("sz"), of("rendering-strategy").alias("rs"),
        of("rendering-strategy", "pass_bucket").alias("rs_pass"), of("rendering-strategy", "warn_bucket").alias("rs_warn"),
        of("rendering-strategy", "fail_bucket").alias("rs_fail"), of("llms-txt-links-resolve").alias("lr"), of("llms-txt-links-resolve", "rate").alias("lr_rate"),
        of("auth-gate-detection").alias("ag"), of("auth-alternative-access").alias("aa"), of("page-size-html").alias("ph"),
        of("bot-protection-interference").alias("bp"), F.sum("rate_limited").alias("limited"), F.sum("tested").alias("tested"),
        of("llms-txt-links-resolve", "same_origin").alias("same"), of("llms-txt-links-resolve", "cross_origin").alias("cross"),
        F.bool_or(F.col("gzipped_skipped")).alias("gz"),
    )


def evaluate(results: DataFrame, runs: DataFrame, symptoms: DataFrame) -> DataFrame:
    """(run_id, position, diagnostic, severity) of the rules that hold.

    results: as for scoring, with tested, rate_limited, same_origin, cross_origin, gzipped_skipped (null where unknown).
    """
    flat = flattening(symptoms).select("run_id").distinct().withColumn("flat", F.lit(True))
    w = runs.join(_wide(results), "run_id", "left").join(flat, "run_id", "left")
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    n = lambda x: F.coalesce(c(x), F.lit(0))
    md_pass = yes(c("md") == "pass")
    no_directive = ~yes(c("dh") == "pass")
    undiscoverable = md_pass & ~yes(c("cn") == "pass") & no_directive
    partly = md_pass & yes(c("cn") == "pass") & no_directive
    rendered = c("rs").isNotNull() & ~c("rs").isin("pass", "skip")
    total = n("rs_pass") + n("rs_warn") + n("rs_fail")
    shell = rendered & yes(4 * n("rs_fail") > total) & (total > 0)
    sparse = rendered & (total > 0) & ~shell & yes(4 * n("rs_warn") > total)
    usable = yes(c("ex").isin("pass", "warn")) & ~(c("lr").isNotNull() & yes(c("lr_rate") < 10))
    no_html = c("rs").isNull() | c("rs").isin("fail", "skip")
    no_markdown = yes(c("md") == "fail") | undiscoverable | partly
    degraded = yes(c("bp").isin("warn", "fail")) | yes((c("requests") >= 20) & (5 * c("failed") >= c("requests")))
    rules = [
        undiscoverable, partly, yes(c("ex").isin("pass", "warn")) & yes(c("sz") == "fail"), shell, sparse, ~usable & no_html & no_markdown,
        yes(c("ag") == "fail") & yes(c("aa") == "fail"), yes(c("ph") == "fail") & no_markdown, yes(c("flat")), degraded,
        yes(c("sampling_strategy").isin("random", "deterministic") & (c("tested_pages") < MIN_PAGES)),
        c("lr").isNotNull() & yes(c("lr") != "skip") & (n("same") == 0) & (n("cross") > 0), yes(c("gz")), (n("tested") > 0) & (5 * n("limited") > n("tested")),
    ]
    each = [F.struct(F.lit(k).alias("position"), F.lit(d).alias("diagnostic"), F.lit(s).alias("severity"), r.alias("on")) for k, ((d, s), r) in enumerate(zip(DIAGNOSTICS.items(), rules))]
    return w.select("run_id", F.explode(F.array(*each)).alias("d")).filter("d.on").select("run_id", "d.position", "d.diagnostic", "d.severity")
