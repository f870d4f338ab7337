"""Queries over whole audits and their parts: verdict rules, discovery, locales, challenge pages, item counts, the ledger of a capture."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quillmap.dims import CHECKS, Options
from quillmap.functions import text as T
from quillmap.functions import url as U
from quillmap.functions.challenge import challenge_page
from quillmap.functions import udf
from quillmap.operators import locales as LO
from quillmap.operators import structure as S
from quillmap.plans import engine, rules
from quillmap.plans.catalogue import PARTS, literal, query, table
from quillmap.plans.checks import Tables
from quillmap.sources import capture as C
from quillmap.sources import discovery, indexes

# ------------------------------------------------------------------------------------------------ verdict rules
#: counts around every boundary, for every check: p, w, f, e, u, near, x, ext, ext_f
CASES = [
    (0, 0, 0, 0, 0, 0, 0, 0, 0), (0, 0, 0, 3, 0, 0, 0, 0, 0), (0, 0, 0, 0, 2, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0, 0, 4, 0), (0, 0, 0, 0, 0, 0, 0, 4, 1), (5, 0, 0, 0, 0, 5, 0, 0, 0),
    (199, 0, 1, 0, 0, 9, 0, 0, 0), (361, 0, 39, 0, 0, 1, 0, 0, 0), (360, 0, 40, 0, 0, 1, 0, 0, 0), (10, 0, 0, 0, 0, 1, 0, 3, 3), (10, 0, 0, 0, 0, 1, 0, 3, 0), (9, 1, 0, 0, 0, 0, 0, 0, 0),
    (9, 1, 0, 0, 0, 1, 0, 0, 0), (9, 0, 1, 1, 0, 4, 0, 0, 0), (0, 4, 0, 0, 0, 0, 0, 0, 0), (0, 0, 4, 0, 0, 0, 0, 0, 0), (179, 0, 21, 0, 0, 0, 0, 0, 0), (178, 0, 22, 0, 0, 0, 0, 0, 0),
    (0, 3, 5, 0, 0, 0, 0, 0, 0), (189, 0, 11, 0, 0, 0, 0, 0, 0), (159, 0, 41, 0, 0, 0, 0, 0, 0), (2, 0, 1, 0, 0, 0, 0, 0, 0), (1, 0, 1, 0, 1, 0, 0, 0, 0), (1, 0, 2, 0, 0, 0, 0, 0, 0),
    (3, 0, 1, 0, 0, 0, 1, 0, 0), (2, 0, 0, 0, 0, 0, 2, 0, 0), (3, 0, 0, 0, 0, 0, 1, 0, 0), (8, 0, 3, 0, 0, 0, 0, 0, 0),
]
FIGURES = "(SELECT check_id, k, p, w, f, e, u, near, x, ext, ext_f FROM (VALUES " + ", ".join(f"('{c}')" for c in CHECKS) + ") AS a(check_id) CROSS JOIN (VALUES " + ", ".join(f"({k}, {', '.join(map(str, v))})" for k, v in enumerate(CASES)) + ") AS b(k, p, w, f, e, u, near, x, ext, ext_f))"
FETCHED = ", ".join(f"'{c}'" for c in rules.FETCHED)


@query("verdict_rules", f"""WITH g AS (SELECT *, p + w + f AS n, CASE WHEN p + w + f > 0 THEN floor(100.0::DOUBLE * p / (p + w + f) + 0.5) END::INT AS rate FROM {FIGURES} AS q)
SELECT check_id, k, rate, CASE
 WHEN n = 0 THEN CASE WHEN check_id = 'llms-txt-links-resolve' AND ext > 0 THEN CASE WHEN ext_f = 0 THEN 'pass' ELSE 'warn' END WHEN check_id = 'http-status-codes' AND u > 0 THEN 'warn' WHEN check_id IN ({FETCHED}) AND e > 0 THEN 'fail' ELSE 'skip' END
 WHEN check_id = 'llms-txt-links-resolve' THEN CASE WHEN p = n THEN CASE WHEN ext_f > 0 THEN 'warn' ELSE 'pass' END WHEN p > 0.9::DOUBLE * n THEN 'warn' ELSE 'fail' END
 WHEN check_id = 'llms-txt-links-markdown' THEN CASE WHEN 10 * p >= 9 * n THEN 'pass' WHEN w > 0 THEN 'warn' ELSE 'fail' END
 WHEN check_id IN ('markdown-url-support', 'content-negotiation') THEN CASE WHEN rate >= 90 THEN 'pass' WHEN p + w > 0 THEN 'warn' ELSE 'fail' END
 WHEN check_id IN ('llms-txt-directive-html', 'llms-txt-directive-md') THEN CASE WHEN f = n THEN 'fail' WHEN w > 0 AND near = 0 THEN 'warn' WHEN f > 0 THEN 'warn' ELSE 'pass' END
 WHEN check_id = 'llms-txt-valid' THEN CASE WHEN p = n THEN 'pass' WHEN f < n THEN 'warn' ELSE 'fail' END
 WHEN check_id = 'llms-txt-coverage' THEN CASE WHEN rate >= 95 THEN 'pass' WHEN rate >= 80 THEN 'warn' ELSE 'fail' END
 WHEN check_id = 'section-header-quality' THEN CASE WHEN 2 * greatest(f, x) > n THEN 'fail' WHEN 4 * greatest(f, x) > n THEN 'warn' ELSE 'pass' END
 WHEN check_id = 'auth-gate-detection' THEN CASE WHEN p = n THEN 'pass' WHEN p > 0 THEN 'warn' ELSE 'fail' END
 WHEN f > 0 THEN 'fail' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS status FROM g""")
def verdict_rules(spark, d):
    return rules.verdicts(literal(spark, FIGURES)).select("check_id", "k", "rate", "status")


# ------------------------------------------------------------------------------------------------ locales
@query("locale_one", f"WITH {PARTS} SELECT page_id FROM o WHERE len(segs) = 0 OR lower(segs[1]) = 'fr'")
def locale_one(spark, d):
    pages = table(spark, d, "pages").select(F.lit("all").alias("run_id"), F.col("page_id").alias("ordinal"), "url")
    wish = spark.range(1).select(F.lit("all").alias("run_id"), F.lit("fr-ca").alias("wanted"))  # the site has fr only
    return LO.one_locale(pages, wish).select(F.col("ordinal").alias("page_id"))


LOCALISED = """(SELECT * FROM (VALUES ('two', 0, 'https://a.io/docs'), ('two', 1, 'https://a.io/docs/en/a'), ('two', 2, 'https://a.io/docs/de/a'), ('two', 3, 'https://a.io/docs/en/b'),
 ('minority', 0, 'https://a.io/x/a'), ('minority', 1, 'https://a.io/x/b'), ('minority', 2, 'https://a.io/x/c'), ('minority', 3, 'https://a.io/x/fr/a'), ('topic', 0, 'https://a.io/go/a'), ('topic', 1, 'https://a.io/b')) AS v(run_id, ordinal, url))"""


@query("locale_positions", "SELECT * FROM (VALUES ('two', 1), ('minority', 1)) AS v(run_id, position)")
def locale_positions(spark, d):
    return LO.positions(literal(spark, LOCALISED))


@query("locale_coverage_scope", "SELECT * FROM (VALUES ('two', 1, 'en'), ('two', 3, 'en'), ('minority', 0, 'default'), ('minority', 1, 'default'), ('minority', 2, 'default'), ('topic', 0, NULL), ('topic', 1, NULL)) AS v(run_id, ordinal, locale)")
def locale_coverage_scope(spark, d):
    listed = literal(spark, "(SELECT * FROM (VALUES ('two', 0, 'https://a.io/docs/en/b'), ('minority', 0, 'https://a.io/x/c'), ('minority', 1, 'https://a.io/x/a')) AS v(run_id, ordinal, url))")
    wish = literal(spark, "(SELECT run_id, CAST(NULL AS STRING) AS wanted FROM (VALUES ('two'), ('minority'), ('topic')) AS v(run_id))")
    return LO.coverage_scope(literal(spark, LOCALISED), listed, wish).select("run_id", "ordinal", "locale")


# ------------------------------------------------------------------------------------------------ challenge pages, item counts
COUNTED = """(SELECT a.h, b.m, c.dist, a.h AS hr, b.m AS mr, p FROM (VALUES (0), (4), (19), (20), (98), (100)) AS a(h) CROSS JOIN (VALUES (0), (5), (20), (100), (102), (103)) AS b(m) CROSS JOIN (VALUES (1), (2)) AS c(dist) CROSS JOIN (VALUES (true), (false)) AS e(p))"""


@query("parity_items", f"""WITH g AS (SELECT h, m, dist, p, m // dist AS u FROM {COUNTED.replace(', a.h AS hr, b.m AS mr', '')} AS q)
SELECT h, m, dist, p, m - u AS duplicates, least(h, u) >= 5 AND abs(h - u) > greatest(1, 0.02 * greatest(h, u)) AS diverges,
CASE WHEN least(h, u) >= 5 AND abs(h - u) > greatest(1, 0.02 * greatest(h, u)) THEN CASE WHEN u > h THEN 'default-filter' WHEN p THEN 'pagination' ELSE 'staleness' END END AS cause FROM g WHERE greatest(h, m) >= 20""")
def parity_items(spark, d):
    c, zero = F.col, F.lit(0)
    distinct = F.floor(c("m") / c("dist")).cast("int")
    rows = literal(spark, COUNTED).withColumn("i", S.item_divergence(c("h"), zero, c("m"), distinct, zero, c("p")))
    return rows.filter("i is not null").select("h", "m", "dist", "p", "i.duplicates", "i.diverges", "i.cause")


MARKED = """(SELECT * FROM (VALUES (1, '- a
- b
  - nested
  - nested too
- a

text'), (2, '| x | y |
| - | - |
| 1 | 2 |
| 3 | 4 |'), (3, '# T

See [the *page*](x.md) and `code`.

> quoted **bold**

```js
let a = 1
```'), (4, '')) AS v(id, body))"""


@query("markdown_texts", """SELECT * FROM (VALUES (1, '- a
- b
nested
nested too
- a

text', 3, 2, 0), (2, 'x
y
1
2
3
4', 0, 0, 2), (3, 'T

See the page and code.

quoted bold

let a = 1', 0, 0, 0), (4, '', 0, 0, 0)) AS v(id, text, items, "distinct", "rows")""".replace("- a\n- b\nnested", "a\nb\nnested").replace("too\n- a", "too\na"))
def markdown_texts(spark, d):
    rows = literal(spark, MARKED).select("id", udf.markdown_text(F.col("body")).alias("t"))
    text = F.array_join(F.transform(F.split("t.text", "\n"), F.trim), "\n")
    return rows.select("id", text.alias("text"), "t.items", "t.distinct", "t.rows")


RENDERED = """(SELECT * FROM (VALUES (1, '<html><body><div id="root"></div></body></html>'), (2, concat('<html><body><main><h1>Title</h1>', repeat('<p>A paragraph of more than thirty characters.</p>', 3), '</main></body></html>')),
 (3, '<html><body><div id="__next"><h1>Title</h1></div></body></html>'), (4, '')) AS v(id, html))"""


@query("render_cases", "SELECT * FROM (VALUES (1, 'fail', 0, 0), (2, 'pass', 1, 3), (3, 'warn', 1, 0), (4, 'pass', 0, 0)) AS v(id, status, headings, paragraphs)")
def render_cases(spark, d):
    rows = literal(spark, RENDERED).select("id", udf.page_metrics(F.col("html")).alias("m"))
    return rows.select("id", "m.status", "m.headings", "m.paragraphs")


TEXTS = "(SELECT * FROM (VALUES (1, 'a%20b+c', '1,234', '<b>&'), (2, '100%', '12', 'x'), (3, '%C3%A9', ',1', ''), (4, '', 'x', '>')) AS v(id, url, n, html))"


@query("scalar_texts", "SELECT * FROM (VALUES (1, 'a b+c', 1234, '&lt;b&gt;&amp;'), (2, '100%', 12, 'x'), (3, 'é', NULL, ''), (4, '', NULL, '&gt;')) AS v(id, decoded, n, escaped)")
def scalar_texts(spark, d):
    c = F.col
    return literal(spark, TEXTS).select("id", T.percent_decoded(c("url")).alias("decoded"), T.grouped_number(c("n")).alias("n"), T.html_escaped(c("html")).alias("escaped"))


# ------------------------------------------------------------------------------------------------ a recorded site
NOW = datetime.datetime(2026, 1, 1)
PROSE = "This paragraph explains at length how the widget is set up and what to expect of it. "


def response(run, url, body="", status=200, kind="text/html", accept=None, redirect="follow", method="GET", second=0, **headers):
    """A row of a capture."""
    h = {"content-type": kind} | {k.replace("_", "-"): v for k, v in headers.items()}
    return (run, url, method, accept, redirect, status, url, False, h, body, len(body.encode()), len(body.encode()), None, "ok", None, NOW + datetime.timedelta(seconds=second))


def recorded_sites(spark):
    """Two sites: one that does well, and a single page without content. (runs, capture, sitemap)"""
    base, n, rows = "https://docs.acme.io", 6, []
    index = "# Acme\n\n> Docs of Acme\n\n## Pages\n\n" + "\n".join(f"- [P{k}]({base}/p{k}.md)" for k in range(n)) + "\n"
    rows.append(response("good", f"{base}/llms.txt", index, kind="text/plain", etag='"1"'))
    for k in range(n):
        url, text = f"{base}/p{k}", [f"{PROSE}{k}{i}" for i in range(12)]
        html = f"<html><head><title>P{k}</title></head><body><nav><a href='/'>Home</a></nav><main><p>See <a href='/llms.txt'>the index</a></p><h1>Page {k}</h1>" + "".join(f"<p>{x}</p>" for x in text) + "</main></body></html>"
        md = f"[index]({base}/llms.txt)\n\n# Page {k}\n\n" + "\n\n".join(text) + f"\n\n[this page]({base}/p{k}.md)\n"
        rows += [response("good", url, html, cache_control="max-age=60"), response("good", url, html, redirect="manual"), response("good", url, md, kind="text/markdown", accept="text/markdown")]
        rows += [response("good", f"{url}.md", md, kind="text/markdown"), response("good", f"{url}.md", kind="text/markdown", method="HEAD"), response("good", f"{url}-quillmap-missing-page", "no", status=404)]
    urls = "".join(f"<url><loc>{base}/p{k}</loc></url>" for k in range(n)) + f"<url><loc>{base}/extra</loc></url>"
    rows += [response("good", f"{base}/robots.txt", f"Sitemap: {base}/map.xml\n", kind="text/plain"), response("good", f"{base}/map.xml", f"<urlset>{urls}</urlset>", kind="application/xml")]
    shell = '<html><body><div id="root"></div></body></html>'
    rows += [response("bare", "https://spa.io", shell), response("bare", "https://spa.io", shell, redirect="manual")]
    runs = spark.createDataFrame([("good", base), ("bare", "https://spa.io")], "run_id string, base_url string")
    return runs, spark.createDataFrame(rows, C.SCHEMA)


FOUND = "('good', 'https://docs.acme.io/extra', NULL), ('bare', 'https://spa.io', NULL), " + ", ".join(f"('good', 'https://docs.acme.io/p{k}', 'https://docs.acme.io/p{k}.md')" for k in range(6))


@query("discovery_pages", f"SELECT * FROM (VALUES {FOUND}) AS v(run_id, url, original_md)")
def discovery_pages(spark, d):
    runs, captured = recorded_sites(spark)
    return discovery.discover(runs, captured, indexes.llms_txt_files(runs, captured)).urls.select("run_id", "url", "original_md")


GOOD = {k: "pass" for k in CHECKS} | {"llms-txt-coverage": "warn", "section-header-quality": "skip", "auth-alternative-access": "skip"}
BARE = {k: "skip" for k in CHECKS} | {
    "llms-txt-exists": "fail", "llms-txt-directive-html": "fail", "markdown-url-support": "fail", "rendering-strategy": "fail", "page-size-html": "pass", "page-size-transfer": "pass",
    "content-start-position": "pass", "tabbed-content-serialization": "pass", "embedded-data-serialization": "pass", "redirect-behavior": "pass", "cache-header-hygiene": "fail", "auth-gate-detection": "pass",
    "bot-protection-interference": "pass",
}
STATUSES = ", ".join(f"('{run}', '{k}', '{v}')" for run, table_ in (("good", GOOD), ("bare", BARE)) for k, v in table_.items())


@query("audit_statuses", f"SELECT * FROM (VALUES {STATUSES}) AS v(run_id, check_id, status)")
def audit_statuses(spark, d):
    """All checks of the recorded sites, from discovery on."""
    runs, captured = recorded_sites(spark)
    pages, found = discovery.sampled_pages(runs, captured, indexes.llms_txt_files(runs, captured))
    # the page that only the sitemap has was not recorded, so it is no sample
    tables = Tables(runs, pages.filter(~U.path(F.col("url")).contains("extra")), captured, C.ledger(captured))
    return engine.audit(tables, Options(), found.warnings)["results"].select("run_id", "check_id", "status")
