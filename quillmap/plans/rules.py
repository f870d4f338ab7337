"""Verdicts of the 28 checks from counts of their items, as one expression over all checks and runs.

figures has run_id, check_id and counts of items: p (pass), w (warn), f (fail), e (inputs that could not be fetched), u
(responses that say nothing), near (directives near the top), x (groups whose headers repeat across groups), ext and ext_f
(links to other origins, and those that fail), and wanted (whether the run has inputs for the check at all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.dims import CHECKS, Options

COUNTS = ("p", "w", "f", "e", "u", "near", "x", "ext", "ext_f")
# Fixed values of the published checks: shares from which links, Markdown links and Markdown pages are well.
RESOLVE_OVER, MARKDOWN_FROM, PAGES_FROM = (9, 10), (9, 10), 90
#: Checks whose inputs are fetched pages: that none could be had is a failure, not nothing to test.
FETCHED = (
    "llms-txt-directive-html", "llms-txt-directive-md", "rendering-strategy", "page-size-html", "page-size-transfer", "content-start-position", "tabbed-content-serialization",
    "embedded-data-serialization", "http-status-codes", "redirect-behavior", "markdown-content-parity", "cache-header-hygiene", "auth-gate-detection",
)
RATED = ("llms-txt-links-resolve", "llms-txt-links-markdown", "markdown-url-support", "content-negotiation", "llms-txt-coverage")


def figures(items: DataFrame) -> DataFrame:
    """Counts by run and check of items (run_id, check_id, status, external, near, crossed); external ones count apart."""
    inside = ~F.coalesce("external", F.lit(False))
    of = lambda s: F.count_if(inside & (F.col("status") == s))
    return items.groupBy("run_id", "check_id").agg(
        of("pass").alias("p"), of("warn").alias("w"), of("fail").alias("f"), of("error").alias("e"), of("skip").alias("u"), F.count_if(F.coalesce("near", F.lit(False))).alias("near"),
        F.count_if(F.coalesce("crossed", F.lit(False))).alias("x"), F.count_if(~inside).alias("ext"), F.count_if(~inside & (F.col("status") != "pass")).alias("ext_f"),
    )


def rate(check: Column) -> Column:
    """Rounded percentage of passed items; null without items."""
    return F.floor(F.try_divide(100 * F.col("p"), F.col("p") + F.col("w") + F.col("f")) + 0.5).cast("int")


def status(options: Options = Options()) -> Column:
    c = F.col
    p, w, f, n = c("p"), c("w"), c("f"), c("p") + c("w") + c("f")
    is_ = lambda *names: c("check_id").isin(*names)
    grades = lambda good, fair: F.when(good, "pass").when(fair, "warn").otherwise("fail")
    by_rate = grades(c("rate") >= PAGES_FROM, p + w > 0)
    worst = F.when(f > 0, "fail").when(w > 0, "warn").otherwise("pass")
    resolve = F.when(n == 0, F.when(c("ext_f") == 0, "pass").otherwise("warn")).when(f + w == 0, F.when(c("ext_f") > 0, "warn").otherwise("pass")).when(RESOLVE_OVER[1] * p > RESOLVE_OVER[0] * n, "warn").otherwise("fail")
    share = F.greatest(F.try_divide(f, n), F.try_divide(c("x"), n))
    empty = F.when(is_("llms-txt-links-resolve") & (c("ext") > 0), resolve).when(is_("http-status-codes") & (c("u") > 0), "warn").when(is_(*FETCHED) & (c("e") > 0), "fail").otherwise("skip")
    return F.when(n == 0, empty).otherwise(
        F.when(is_("llms-txt-links-resolve"), resolve)
        .when(is_("llms-txt-links-markdown"), grades(MARKDOWN_FROM[1] * p >= MARKDOWN_FROM[0] * n, w > 0))
        .when(is_("markdown-url-support", "content-negotiation"), by_rate)
        .when(is_("llms-txt-directive-html", "llms-txt-directive-md"), F.when(p + w == 0, "fail").when((w > 0) & (c("near") == 0), "warn").when(f > 0, "warn").otherwise("pass"))
        .when(is_("llms-txt-valid"), grades(p == n, p + w > 0))
        .when(is_("llms-txt-coverage"), grades(c("rate") >= options.coverage_limits[0], c("rate") >= options.coverage_limits[1]))
        .when(is_("section-header-quality"), F.when(share > 0.5, "fail").when(share > 0.25, "warn").otherwise("pass"))
        .when(is_("auth-gate-detection"), grades(f + w == 0, p > 0))
        .otherwise(worst)
    )


def verdicts(counts: DataFrame, options: Options = Options()) -> DataFrame:
    """(run_id, check_id, status, p, w, f, ..., rate) of figures; missing counts are 0."""
    rows = counts.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in COUNTS if k in counts.columns} | {k: F.lit(0) for k in COUNTS if k not in counts.columns})
    return rows.withColumn("rate", rate(F.col("check_id"))).withColumn("status", status(options))


# ------------------------------------------------------------------------------------------------ messages
#: What a check says: of passes, of warnings and failures; {p} {w} {f} {n} {e} {rate} {ext_f} stand for its counts.
SAYS = {
    "llms-txt-exists": ("an llms.txt file was found", "no llms.txt file on this host ({w} behind a redirect to another)", "no llms.txt file was found"),
    "llms-txt-valid": ("all {n} llms.txt files follow the proposed structure", "{p} of {n} llms.txt files follow the proposed structure", "no llms.txt file has links that can be parsed"),
    "llms-txt-size": ("all {n} llms.txt files fit one fetch", "{w} of {n} llms.txt files may be cut off", "{f} of {n} llms.txt files are too large for one fetch"),
    "llms-txt-links-resolve": ("all {n} links of the site resolve", "{p} of {n} links of the site resolve ({rate} %), {ext_f} external ones do not", "only {p} of {n} links of the site resolve ({rate} %)"),
    "llms-txt-links-markdown": ("{p} of {n} links lead to Markdown ({rate} %)", "{p} of {n} links lead to Markdown, {w} more have a Markdown form", "links lead to HTML, and no Markdown form was found"),
    "llms-txt-directive-html": ("all {n} pages point to llms.txt", "{p} of {n} pages point to llms.txt where it is seen, {w} only far down, {f} not at all", "none of {n} pages points to llms.txt"),
    "llms-txt-directive-md": ("all {n} Markdown pages point to llms.txt", "{p} of {n} Markdown pages point to llms.txt where it is seen, {w} only far down, {f} not at all", "none of {n} Markdown pages points to llms.txt"),
    "markdown-url-support": ("{p} of {n} pages have a Markdown URL ({rate} %)", "only {p} of {n} pages have a Markdown URL ({rate} %)", "no page has a Markdown URL"),
    "content-negotiation": ("{p} of {n} pages answer a wish for Markdown ({rate} %)", "{p} of {n} pages answer a wish for Markdown, {w} with the wrong type", "no page answers a wish for Markdown"),
    "rendering-strategy": ("all {n} pages hold their content", "{w} of {n} pages hold little content without scripts", "{f} of {n} pages are shells without scripts"),
    "page-size-markdown": ("all {n} Markdown pages fit one fetch", "{w} of {n} Markdown pages may be cut off", "{f} of {n} Markdown pages are too large"),
    "page-size-html": ("all {n} pages fit one fetch once converted", "{w} of {n} pages may be cut off once converted", "{f} of {n} pages are too large once converted"),
    "page-size-transfer": ("all {n} pages are served in reasonable size", "{w} of {n} pages are served with much payload", "{f} of {n} pages are served with too much payload"),
    "content-start-position": ("content starts early on all {n} pages", "content starts late on {w} of {n} pages", "content starts past half of {f} of {n} pages"),
    "single-fetch-completeness": ("all {n} Markdown pages are whole, or say early how they go on", "{w} of {n} Markdown pages say late or vaguely how they go on", "{f} of {n} Markdown pages are parts without a way to the rest"),
    "tabbed-content-serialization": ("tabs of all {n} pages serialise to little text", "tabs of {w} of {n} pages serialise to much text", "tabs of {f} of {n} pages serialise to too much text"),
    "section-header-quality": ("headings of tab panels tell their variant", "{f} of {n} tab groups have headings that do not tell their variant", "{f} of {n} tab groups have headings that do not tell their variant"),
    "markdown-code-fence-validity": ("all code fences of {n} documents are closed", "{w} of {n} documents have odd code fences", "{f} of {n} documents have a code fence that is never closed"),
    "markdown-link-portability": ("links of all {n} Markdown pages work from anywhere", "{w} of {n} Markdown pages have links that need the site's root", "{f} of {n} Markdown pages have links that do not resolve on their own"),
    "embedded-data-serialization": ("no page is mainly generated data", "{w} of {n} pages are mainly generated data", "{f} of {n} pages are mainly generated data beyond one fetch"),
    "http-status-codes": ("missing pages answer with an error", "no answer tells how missing pages are handled", "{f} of {n} missing pages answer as if they existed"),
    "redirect-behavior": ("redirects stay on the site", "{w} of {n} pages redirect to another host", "{f} of {n} pages redirect by script"),
    "llms-txt-coverage": ("llms.txt lists {rate} % of {n} pages of the sitemap", "llms.txt lists only {rate} % of {n} pages of the sitemap", "llms.txt lists only {rate} % of {n} pages of the sitemap"),
    "markdown-content-parity": ("Markdown and HTML of all {n} pages agree", "Markdown of {w} of {n} pages lacks some of the HTML", "Markdown of {f} of {n} pages lacks much of the HTML"),
    "cache-header-hygiene": ("all {n} answers can be kept fresh", "{w} of {n} answers may be a day old", "{f} of {n} answers may be old without a sign"),
    "auth-gate-detection": ("all {n} pages are open", "{p} of {n} pages are open, the others ask for a login", "all {n} pages ask for a login"),
    "auth-alternative-access": ("gated pages can be had another way", "some gated pages can be had another way", "gated pages cannot be had another way"),
    "bot-protection-interference": ("nothing interfered with the requests", "bot protection interfered with some requests", "bot protection interfered with requests to the end"),
}


def message() -> Column:
    """The sentence of a verdict, with what could not be fetched."""
    c = F.col
    n = (c("p") + c("w") + c("f")).cast("string")
    parts = {"p": c("p"), "w": c("w"), "f": c("f"), "e": c("e"), "ext_f": c("ext_f"), "rate": c("rate")}

    def filled(template: Column) -> Column:
        out = F.replace(template, F.lit("{n}"), n)
        for key, value in parts.items():
            out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("-")))
        return out

    table = F.create_map(*[x for check, said in SAYS.items() for k, s in enumerate(("pass", "warn", "fail")) for x in (F.lit(f"{check} {s}"), F.lit(said[k]))])
    said = filled(F.try_element_at(table, F.concat_ws(" ", "check_id", "status")))
    none = F.when(c("status") == "skip", F.lit("nothing to test")).otherwise(F.lit("nothing could be fetched"))
    text = F.when((c("p") + c("w") + c("f") + c("ext") + c("u") == 0) | (c("status") == "skip"), none).otherwise(said)
    late = F.when(c("e") > 0, F.format_string("; %d failed to fetch", c("e").cast("long"))).otherwise("")
    slow = F.when(c("limited") > 0, F.format_string("; %d were rate-limited", c("limited").cast("long"))).otherwise("")
    return F.concat(c("check_id"), F.lit(": "), F.coalesce(text, none), late, slow)


def categories() -> Column:
    return F.create_map(*[F.lit(x) for check, v in CHECKS.items() for x in (check, v[0])])
