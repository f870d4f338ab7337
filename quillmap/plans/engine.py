"""A whole audit: checks in order with their dependencies, scores, diagnostics and the report.

Each check writes its items to the audit's folder, several checks at a time; from there on all checks and runs are one
table, so that verdicts, scores and diagnostics are a few short plans whatever the number of checks.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.dims import CHECKS, Options
from quillmap.functions import url as U
from quillmap.operators import aggregates as A
from quillmap.operators import ledger as L
from quillmap.plans import dag, diagnostics, rules, scoring
from quillmap.plans.checks import ITEM, Tables, items
from quillmap.session import cut, stored

#: Checks that report rate-limited requests.
LIMITED = (
    "page-size-transfer", "page-size-html", "embedded-data-serialization", "llms-txt-links-markdown", "llms-txt-links-resolve", "markdown-url-support", "content-negotiation",
)
Progress = Callable[[dict], None]


def audit(
    tables: Tables, options: Options = Options(), warnings: DataFrame | None = None, progress: Progress | None = None, at_once: int = 6, context: str | None = None,
) -> dict[str, DataFrame]:
    """results, items, check_scores, scores, categories, diagnostics, tag_scores, requests, findings
    and foreign_origins (the host that most links to other hosts lead to) of all runs.

    warnings: (run_id, warning) of discovery. progress: called with the state of each check as it begins and ends. The
    results are tables of their own; tables.release() removes what was written on the way.
    """
    if wrong := options.validate(pages=True):
        raise ValueError("; ".join(wrong))
    spark = tables.runs.sparkSession
    tables.options = options
    chosen = [k for k in dag.order() if (not options.check_ids or k in options.check_ids) and k not in options.skip_check_ids]
    everything = _items(tables, options, chosen, progress or (lambda event: None), at_once)
    counts = rules.figures(everything)
    limited = everything.filter(F.col("check_id").isin(*LIMITED)).groupBy("run_id", "check_id").agg(F.count("*").cast("int").alias("tested"), F.count_if(F.col("code") == 429).cast("int").alias("limited"))
    grid = tables.runs.select("run_id", F.explode(F.array(*map(F.lit, chosen))).alias("check_id"))
    rows = rules.verdicts(grid.join(counts, ["run_id", "check_id"], "left").join(limited, ["run_id", "check_id"], "left"), options)
    rows = gated(cut(rows))
    results = rows.select(
        "run_id", "check_id", rules.categories()[F.col("check_id")].alias("category"), "status", F.col("p").cast("int").alias("pass_bucket"), F.col("w").cast("int").alias("warn_bucket"), F.col("f").cast("int").alias("fail_bucket"),
        "rate", F.col("e").cast("int").alias("fetch_errors"), "tested", F.col("limited").alias("rate_limited"), "ext", "ext_f", rules.message().alias("message"),
    )
    results = cut(results)
    # checks that the options leave out have a row, which neither dependencies nor scores see
    left_out = [k for k in dag.order() if k in options.skip_check_ids]
    skipped = tables.runs.select("run_id", F.explode(F.array(*map(F.lit, left_out)) if left_out else F.array().cast("array<string>")).alias("check_id"))
    skipped = skipped.select("run_id", "check_id", rules.categories()[F.col("check_id")].alias("category"), F.lit("skip").alias("status"), F.concat("check_id", F.lit(": skipped by the options")).alias("message"))
    typed, requests = _typed(results, everything, tables, warnings)
    runs = _runs(tables, options, requests)
    findings = symptoms(everything)
    found = cut(diagnostics.evaluate(typed, runs, findings))
    scores = cut(scoring.check_scores(typed, everything, runs, scoring.dim_check(spark)))
    out = {
        "results": results.unionByName(skipped, allowMissingColumns=True), "items": everything, "check_scores": scores, "scores": scoring.overall(scores, runs, scoring.caps(scores, typed, found)), "categories": scoring.categories(scores),
        "diagnostics": found, "findings": findings, "requests": requests, "runs": runs.withColumn("network_context", F.lit(context).cast("string")),
    }
    away = everything.filter("check_id = 'llms-txt-links-resolve' and external").select("run_id", U.origin(F.col("url")).alias("origin"), "url")
    out["foreign_origins"] = A.mode_first(away, ["run_id"], "origin", "url")
    if "tag" in tables.pages.columns:
        out["tag_scores"] = scoring.tag_scores(scores, everything, tables.pages.filter("tag is not null").select("run_id", "url", "tag"))
    return out


def _items(tables: Tables, options: Options, chosen: list[str], progress: Progress, at_once: int) -> DataFrame:
    spark, place = tables.runs.sparkSession, tables.place()

    def one(k: int, name: str) -> None:
        progress({"event": "start", "check_id": name, "index": k, "total": len(chosen)})
        stored(items(name, tables, options).drop("check_id"), f"{place}/items/check_id={name}")
        progress({"event": "done", "check_id": name, "index": k, "total": len(chosen)})

    tables.html(), tables.markdown(), tables.files(), tables.failures()  # several checks wait for these
    with ThreadPoolExecutor(at_once) as pool:
        for job in [pool.submit(one, k, name) for k, name in enumerate(chosen, 1)]:
            job.result()
    kinds = "run_id string, url string, status string, code int, error string, external boolean, near boolean, crossed boolean, details string, check_id string"
    return spark.read.schema(kinds).parquet(f"{place}/items").select(*ITEM)


def _typed(results: DataFrame, everything: DataFrame, tables: Tables, warnings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """results with what scores and diagnostics read besides, and the request figures of the runs.

    Requests and failures are the bot-protection check's own where it warned or failed, else the ledger's.
    """
    null = lambda kind: F.lit(None).cast(kind)
    if tables.events is not None:
        summary = L.summary(L.flags(tables.events)).select("run_id", F.col("requests").cast("int"), F.col("failed").cast("int"), "stalled_bodies", "challenge_pages", "fetch_errors", "failure_rate")
        own = everything.filter("check_id = 'bot-protection-interference'").select("run_id", F.get_json_object("details", "$.failed").cast("int").alias("_f"), F.get_json_object("details", "$.requests").cast("int").alias("_r"), F.col("status").alias("_s"))
        requests = summary.join(own, "run_id", "left")
        flagged = F.coalesce(F.col("_s").isin("warn", "fail"), F.lit(False))
        requests = requests.withColumn("failed", F.when(flagged, F.coalesce("_f", "failed")).otherwise(F.col("failed"))).withColumn("requests", F.when(flagged, F.coalesce("_r", "requests")).otherwise(F.col("requests"))).drop("_f", "_r", "_s")
    else:
        requests = tables.runs.select("run_id").limit(0).select("run_id", *[null("int").alias(x) for x in ("requests", "failed")], *[null("long").alias(x) for x in ("stalled_bodies", "challenge_pages", "fetch_errors", "failure_rate")])
    chars = everything.filter("check_id = 'llms-txt-size'").groupBy("run_id").agg(F.max(F.get_json_object("details", "$.characters").cast("int")).alias("_chars"))
    gz = warnings.filter("warning like 'skipped gzipped sitemap%'").select("run_id").distinct().withColumn("_gz", F.lit(True)) if warnings is not None else tables.runs.select("run_id").limit(0).withColumn("_gz", F.lit(True))
    rows = results.join(requests.select("run_id", F.col("requests").alias("_requests"), F.col("failed").alias("_failed")), "run_id", "left").join(chars, "run_id", "left").join(gz, "run_id", "left")
    only = lambda check, value, kind: F.when(F.col("check_id") == check, value).cast(kind)
    inside = F.col("pass_bucket") + F.col("warn_bucket") + F.col("fail_bucket")
    typed = rows.withColumns({
        "requests": only("bot-protection-interference", F.col("_requests"), "int"), "failed": only("bot-protection-interference", F.col("_failed"), "int"), "max_chars": only("llms-txt-size", F.col("_chars"), "int"),
        "same_origin": only("llms-txt-links-resolve", inside, "int"), "cross_origin": only("llms-txt-links-resolve", F.col("ext"), "int"), "gzipped_skipped": F.coalesce("_gz", F.lit(False)),
    }).drop("_requests", "_failed", "_chars", "_gz", "ext", "ext_f", "fetch_errors", "message")
    return cut(typed), cut(requests)


def _runs(tables: Tables, options: Options, requests: DataFrame) -> DataFrame:
    tested = tables.pages.groupBy("run_id").agg(F.count("*").cast("int").alias("tested_pages"))
    rows = tables.runs.select("run_id").join(tested, "run_id", "left").join(requests.select("run_id", "requests", "failed"), "run_id", "left")
    return cut(rows.select("run_id", F.lit(options.sampling_strategy).alias("sampling_strategy"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tested_pages", "requests", "failed")]))


def symptoms(everything: DataFrame) -> DataFrame:
    """(run_id, page_key, direction, evidence): what checks saw of dynamic pages that became static ones."""
    get = lambda k: F.get_json_object("details", f"$.{k}")
    flagged = F.col("status").isin("warn", "fail")
    check = F.col("check_id")
    counts, twice = get("items.diverges") == "true", get("items.duplicates").cast("int") > 0
    differs = F.coalesce(counts | twice, F.lit(False))
    direction = (
        F.when((check == "embedded-data-serialization") & flagged, "too much").when((check == "single-fetch-completeness") & flagged, "too little")
        .when((check == "markdown-content-parity") & (flagged | differs), "inconsistent").when((check == "markdown-link-portability") & flagged, "unnavigable")
    )
    evidence = (
        F.when(check == "embedded-data-serialization", F.concat(F.lit("generated data is "), get("share"), F.lit(" % of the converted content")))
        .when(check == "single-fetch-completeness", "the Markdown is one part of several")
        .when(F.coalesce(counts, F.lit(False)), F.concat(F.lit("the HTML shows "), get("items.html"), F.lit(" items, the Markdown "), get("items.distinct"), F.coalesce(F.concat(F.lit(" (likely "), get("items.cause"), F.lit(")")), F.lit(""))))
        .when(F.coalesce(twice, F.lit(False)), F.concat(F.lit("the Markdown lists "), get("items.markdown"), F.lit(" entries, of which "), get("items.distinct"), F.lit(" differ")))
        .when(check == "markdown-content-parity", F.concat(get("missing"), F.lit(" of "), get("segments"), F.lit(" passages of the HTML are missing")))
        .otherwise("links need the page's place to resolve")
    )
    rows = everything.withColumn("direction", direction).withColumn("evidence", evidence).filter("direction is not null")
    return rows.groupBy("run_id", U.page_key(F.col("url")).alias("page_key"), "direction").agg(F.min("evidence").alias("evidence"))


def gated(results: DataFrame) -> DataFrame:
    """Verdicts with those of checks whose dependencies are unmet turned into skips, dependencies first."""
    for level in (["llms-txt-exists"], [k for k, v in CHECKS.items() if v[6]]):
        skipped = dag.gate(results).filter("skipped").select("run_id", "check_id", F.lit(True).alias("_skip"))
        mine = F.col("check_id").isin(level)
        results = results.join(skipped, ["run_id", "check_id"], "left").withColumn("status", F.when(mine & F.col("_skip"), "skip").otherwise(F.col("status"))).drop("_skip")
    return results
