"""Scoring, gates and diagnostics over audits that are derived from the driver's order lines: 200 runs of 28 checks.

An order line is one item: its run is the order's number modulo 200, its check the supplier's modulo 28, its page the
part's modulo 40, its status the return flag. Results are what verdicts of such items would be. The SQL derives the same
tables on its own and scores them by the statements that the fixtures are compared with.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.dims import dim_values
from quillmap.operators import aggregates as A
from quillmap.plans import catalogue, dag, diagnostics, fixtures, scoring
from quillmap.plans.catalogue import GRADE, query, table

COLUMNS = ["run_id", "check_id", "status", "pass_bucket", "warn_bucket", "fail_bucket", "rate", "requests", "failed", "max_chars", "tested", "rate_limited", "same_origin", "cross_origin", "gzipped_skipped"]

ITEMS = f"""(SELECT run_id, check_id, url, CASE min(rank) WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status FROM (
 SELECT 'r' || (l_orderkey % 200) AS run_id, check_id, 'u' || (l_partkey % 40) AS url, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank
 FROM lineitem JOIN {dim_values()} AS dm ON dm.ordinal = l_suppkey % 28) GROUP BY ALL)"""
RESULTS = f"""(SELECT run_id, check_id, CASE WHEN f * 3 > n THEN 'fail' WHEN w * 2 > n THEN 'warn' WHEN n < 2 THEN 'skip' ELSE 'pass' END AS status, p AS pass_bucket, w AS warn_bucket, f AS fail_bucket,
 (100 * p // n) AS rate, 3 * n AS requests, f AS failed, 20000 * n AS max_chars, n AS tested, w AS rate_limited, p AS same_origin, f AS cross_origin, f % 2 = 1 AS gzipped_skipped
 FROM (SELECT run_id, check_id, count(*) AS n, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'warn') AS w, count(*) FILTER (status = 'fail') AS f FROM {ITEMS} AS i GROUP BY ALL))"""
RUNS = """(SELECT 'r' || (l_orderkey % 200) AS run_id, CASE (l_orderkey % 200) % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'curated' ELSE 'deterministic' END AS sampling_strategy, count(DISTINCT l_partkey % 40) % 12 AS tested_pages,
 count(*) AS requests, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1, 2)"""
TAGS = "(SELECT DISTINCT 'r' || (l_orderkey % 200) AS run_id, 'u' || (l_partkey % 40) AS url, 't' || (l_partkey % 40 % 3) AS tag FROM lineitem)"


def over_lines(sql: str) -> str:
    """A statement over the fixtures as one over the order lines."""
    for old, new in ((fixtures.RESULTS, RESULTS), (fixtures.ITEMS, ITEMS), (fixtures.RUNS, RUNS), (fixtures.TAGS, TAGS)):
        sql = sql.replace(old, new)
    return sql


SCORES = over_lines(catalogue.SCORES)


def _audit(spark, d):
    """(results, items, runs, tags) of the order lines."""
    lines = table(spark, d, "lineitem")
    run, url = F.concat(F.lit("r"), F.col("l_orderkey") % 200), F.concat(F.lit("u"), F.col("l_partkey") % 40)
    status = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").otherwise("pass")
    dim = F.broadcast(scoring.dim_check(spark).select("check_id", "ordinal"))  # 28 rows
    rows = lines.join(dim, F.col("ordinal") == F.col("l_suppkey") % 28)
    items = rows.groupBy(run.alias("run_id"), "check_id", url.alias("url")).agg(A.worst(status).alias("status"))
    per = items.groupBy("run_id", "check_id").agg(*A.bucket_counts(F.col("status")), F.count("*").alias("tested"))
    p, w, f, n = (F.col(x) for x in ("pass_bucket", "warn_bucket", "fail_bucket", "tested"))
    verdict = F.when(3 * f > n, "fail").when(2 * w > n, "warn").when(n < 2, "skip").otherwise("pass")
    results = per.withColumns({
        "status": verdict, "rate": F.floor(100 * p / n), "requests": 3 * n, "failed": f, "max_chars": 20000 * n, "rate_limited": w, "same_origin": p, "cross_origin": f, "gzipped_skipped": f % 2 == 1,
    }).select(*COLUMNS)
    kind = F.col("l_orderkey") % 200 % 3
    runs = lines.groupBy(run.alias("run_id"), F.when(kind == 0, "random").when(kind == 1, "curated").otherwise("deterministic").alias("sampling_strategy")).agg(
        (F.count_distinct(F.col("l_partkey") % 40) % 12).alias("tested_pages"), F.count("*").alias("requests"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    tags = lines.select(run.alias("run_id"), url.alias("url"), F.concat(F.lit("t"), F.col("l_partkey") % 40 % 3).alias("tag")).distinct()
    return results, items, runs, tags


def _scores(spark, d):
    results, items, runs, tags = _audit(spark, d)
    return scoring.check_scores(results, items, runs, scoring.dim_check(spark)), results, items, runs, tags


@query("score_proportion_of_lines", f"WITH {SCORES} SELECT run_id, check_id, round(proportion, 9) AS proportion FROM pr")
def score_proportion_of_lines(spark, d):
    results, items, _, _ = _audit(spark, d)
    return scoring.proportions(results, items, scoring.dim_check(spark)).select("run_id", "check_id", F.round("proportion", 9).alias("proportion"))


@query("score_coefficient_of_lines", f'WITH {SCORES} SELECT run_id, round(discovery, 9) AS discovery, round(html, 9) AS html, round("index", 9) AS "index" FROM co')
def score_coefficient_of_lines(spark, d):
    rows = scoring.coefficients(_audit(spark, d)[0])
    return rows.select("run_id", *[F.round(x, 9).alias(x) for x in ("discovery", "html", "index")])


@query("score_checks_of_lines", f'WITH {SCORES} SELECT run_id, check_id, round(effective_weight, 9) AS effective_weight, round(earned, 9) AS earned, "numeric" FROM cs')
def score_checks_of_lines(spark, d):
    return _scores(spark, d)[0].select("run_id", "check_id", F.round("effective_weight", 9).alias("effective_weight"), F.round("earned", 9).alias("earned"), "numeric")


@query("score_category_of_lines", f"""WITH {SCORES}, c AS (SELECT run_id, category, CASE WHEN bool_or("numeric") THEN floor(round(coalesce(100 * sum(earned) FILTER ("numeric") / nullif(sum(effective_weight) FILTER ("numeric"), 0), 0), 9) + 0.5)::BIGINT END AS score
FROM cs GROUP BY ALL) SELECT *, {GRADE} FROM c""")
def score_category_of_lines(spark, d):
    return scoring.categories(_scores(spark, d)[0])


@query("score_overall_of_lines", f"""WITH {SCORES}, t AS (SELECT run_id, coalesce(100 * sum(earned) FILTER ("numeric") / nullif(sum(effective_weight) FILTER ("numeric"), 0), 0) AS raw FROM rn LEFT JOIN cs USING (run_id) GROUP BY run_id),
k AS (SELECT run_id, 59 AS cap, 0 AS o, check_id AS cause FROM r WHERE check_id = 'llms-txt-exists' AND status = 'fail'
 UNION ALL SELECT run_id, CASE WHEN proportion <= 0.25 THEN 39 ELSE 59 END, CASE check_id WHEN 'rendering-strategy' THEN 1 ELSE 2 END, check_id FROM cs WHERE check_id IN ('rendering-strategy', 'auth-gate-detection') AND "numeric" AND proportion <= 0.5),
m AS (SELECT run_id, min({{'cap': cap, 'o': o, 'cause': cause}}) AS m FROM k GROUP BY run_id),
z AS (SELECT t.run_id, CASE WHEN m.m.cap < raw THEN m.m.cap END AS cap, CASE WHEN m.m.cap < raw THEN m.m.cause END AS cap_cause, floor(round(least(raw, coalesce(m.m.cap, 1000)), 9) + 0.5)::BIGINT AS score FROM t LEFT JOIN m USING (run_id)) SELECT *, {GRADE} FROM z""")
def score_overall_of_lines(spark, d):
    scores, results, _, runs, _ = _scores(spark, d)
    none = spark.createDataFrame([], "run_id string, diagnostic string")
    return scoring.overall(scores, runs, scoring.caps(scores, results, none)).drop("raw")


OF_PAGES = f"USING (run_id, url) WHERE check_id NOT IN ({', '.join(repr(x) for x in scoring.SITE_LEVEL)}) GROUP BY ALL)"


@query("score_tags_of_lines", over_lines(catalogue.ORACLES["score_tags"]).replace("USING (run_id, url) GROUP BY ALL)", OF_PAGES, 1))
def score_tags_of_lines(spark, d):
    scores, _, items, _, tags = _scores(spark, d)
    return scoring.tag_scores(scores, items, tags)


def _edges() -> str:
    from quillmap.dims import CHECKS

    return ", ".join(f"('{check}', {k}, '{dep}')" for check, v in CHECKS.items() for k, group in enumerate(v[6]) for dep in group)


@query("gate_of_lines", f"""WITH r AS (SELECT * FROM {RESULTS} AS q), e AS (SELECT * FROM (VALUES {_edges()}) AS v(check_id, g, dep)),
s AS (SELECT x.run_id, e.check_id, e.g, bool_or(coalesce(r.status IN ('pass', 'warn'), false)) AS ok, bool_or(r.status IS NOT NULL) AS ran FROM (SELECT DISTINCT run_id FROM r) x CROSS JOIN e LEFT JOIN r ON r.run_id = x.run_id AND r.check_id = e.dep GROUP BY ALL)
SELECT run_id, check_id, bool_or(ran) AND NOT bool_and(ok) AS skipped FROM s GROUP BY ALL""")
def gate_of_lines(spark, d):
    return dag.gate(_audit(spark, d)[0])


DIRECTIONS = {"embedded-data-serialization": "too much", "single-fetch-completeness": "too little", "markdown-content-parity": "inconsistent", "markdown-link-portability": "unnavigable"}
#: The rules of diagnostics as SQL over one wide row per run.
RULES = [
    ("markdown-undiscoverable", "warning", "undiscoverable"), ("markdown-partially-discoverable", "warning", "partly"), ("truncated-index", "warning", "ex IN ('pass', 'warn') AND sz = 'fail'"),
    ("spa-shell-html-invalid", "info", "rendered AND shell"), ("sparse-content-html", "info", "rendered AND total > 0 AND NOT shell AND 4 * rw > total"),
    ("no-viable-path", "critical", "NOT (coalesce(ex IN ('pass', 'warn'), false) AND NOT coalesce(lr IS NOT NULL AND lr_rate < 10, false)) AND (rs IS NULL OR rs IN ('fail', 'skip')) AND no_markdown"),
    ("auth-no-alternative", "critical", "ag = 'fail' AND aa = 'fail'"), ("page-size-no-markdown-escape", "warning", "ph = 'fail' AND no_markdown"), ("dynamic-content-rendered-statically", "warning", "flat"),
    ("bot-protection-scan-reliability", "warning", "coalesce(bp IN ('warn', 'fail'), false) OR (requests >= 20 AND 5 * failed >= requests)"),
    ("single-page-sample", "warning", "sampling_strategy IN ('random', 'deterministic') AND tested_pages < 5"), ("cross-origin-llms-txt", "warning", "lr <> 'skip' AND coalesce(same, 0) = 0 AND \"cross\" > 0"),
    ("gzipped-sitemap-skipped", "info", "gz"), ("rate-limiting-severe", "warning", "tested > 0 AND 5 * limited > tested"),
]
STATUS = {"md": "markdown-url-support", "cn": "content-negotiation", "dh": "llms-txt-directive-html", "ex": "llms-txt-exists", "sz": "llms-txt-size", "rs": "rendering-strategy", "lr": "llms-txt-links-resolve",
          "ag": "auth-gate-detection", "aa": "auth-alternative-access", "ph": "page-size-html", "bp": "bot-protection-interference"}
WIDE = f"""r AS (SELECT * FROM {RESULTS} AS q), rn AS (SELECT * FROM {RUNS} AS q),
sy AS (SELECT run_id, url, CASE check_id {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DIRECTIONS.items())} END AS direction FROM {ITEMS} AS q WHERE status = 'fail'),
fl AS (SELECT DISTINCT run_id FROM (SELECT run_id, url FROM sy GROUP BY ALL HAVING count(DISTINCT direction) >= 2)),
a AS (SELECT run_id, {', '.join(f"max(status) FILTER (check_id = '{check}') AS {k}" for k, check in STATUS.items())}, max(rate) FILTER (check_id = 'llms-txt-links-resolve') AS lr_rate,
 max(same_origin) FILTER (check_id = 'llms-txt-links-resolve') AS same, max(cross_origin) FILTER (check_id = 'llms-txt-links-resolve') AS "cross", coalesce(max(fail_bucket) FILTER (check_id = 'rendering-strategy'), 0) AS rf,
 coalesce(max(warn_bucket) FILTER (check_id = 'rendering-strategy'), 0) AS rw, coalesce(max(pass_bucket) FILTER (check_id = 'rendering-strategy'), 0) AS rp, sum(rate_limited) AS limited, sum(tested) AS tested, bool_or(gzipped_skipped) AS gz FROM r GROUP BY run_id),
b AS (SELECT rn.*, a.* EXCLUDE (run_id), fl.run_id IS NOT NULL AS flat, rf + rw + rp AS total, 4 * rf > rf + rw + rp AS shell, rs IS NOT NULL AND rs NOT IN ('pass', 'skip') AS rendered,
 md = 'pass' AND coalesce(cn, '') <> 'pass' AND coalesce(dh, '') <> 'pass' AS undiscoverable, md = 'pass' AND cn = 'pass' AND coalesce(dh, '') <> 'pass' AS partly FROM rn LEFT JOIN a USING (run_id) LEFT JOIN fl USING (run_id)),
w AS (SELECT *, coalesce(md = 'fail' OR undiscoverable OR partly, false) AS no_markdown FROM b)"""


@query("diagnostics_of_lines", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT run_id, {k} AS position, '{name}' AS diagnostic, '{severity}' AS severity FROM w WHERE {rule}" for k, (name, severity, rule) in enumerate(RULES)))
def diagnostics_of_lines(spark, d):
    results, items, runs, _ = _audit(spark, d)
    names = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    symptoms = items.filter("status = 'fail'").select("run_id", F.col("url").alias("page_key"), names[F.col("check_id")].alias("direction")).filter("direction is not null")
    return diagnostics.evaluate(results, runs, symptoms)
