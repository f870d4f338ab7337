"""Small bodies, responses and runs with known results, one for each kind that the operators tell apart."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmap.dims import Options
from quillmap.functions import text as T
from quillmap.functions import udf
from quillmap.functions import url as U
from quillmap.functions.challenge import challenge_page
from quillmap.plans import dag, fixtures
from quillmap.plans.audited import response
from quillmap.plans.catalogue import DEPS, literal
from quillmap.sources import capture as C
from quillmap.sources import discovery
from tests.test_catalogue import plain

CASES = {}


def query(name, sql):
    return lambda f: CASES.setdefault(name, (f, sql))


@query("auth_class", "SELECT * FROM (VALUES (1,'accessible'),(2,'accessible'),(3,'accessible'),(4,'accessible'),(5,'accessible'),(6,'accessible'),(7,'accessible'),(8,'auth-required'),(9,'auth-redirect'),(10,'auth-redirect'),(11,'auth-required'),(12,'accessible'),(13,'accessible'),(14,'accessible'),(15,'accessible')) AS v(id, class)")
def auth_class(spark, d):
    c = F.col
    sso = c("status").between(300, 399) & T.sso_host(U.host(c("location")))
    return literal(spark, fixtures.REDIRECTS).select("id", F.when(c("status").isin(401, 403), "auth-required").when(sso, "auth-redirect").otherwise("accessible").alias("class"))


@query("body_classes", """SELECT * FROM (VALUES (1,true,false,false,NULL,false),(2,false,true,false,NULL,false),(3,false,true,true,NULL,false),(4,true,false,false,'title',false),(5,false,false,false,'form action',false),
(6,false,false,false,'password input',false),(7,false,false,false,NULL,true),(8,false,false,false,NULL,false),(9,false,false,false,NULL,false),(10,false,false,false,NULL,true),(11,false,true,false,NULL,false),(12,false,false,false,NULL,false),
(13,false,false,true,NULL,false),(14,false,false,false,NULL,false),(15,false,false,false,NULL,false),(16,false,false,false,NULL,false)) AS v(id, html, markdown, missing, login, redirects)""")
def body_classes(spark, d):
    b = F.col("body")
    return literal(spark, fixtures.BODIES).select(
        "id", T.looks_html(b).alias("html"), T.looks_markdown(b).alias("markdown"), T.soft_404(b).alias("missing"), T.login_form(b, F.lit(False)).alias("login"), T.js_redirect(b).alias("redirects"))


BULKY = """(SELECT 1 AS id, concat('intro text
', '| a | b |
| --- | --- |
', repeat('| 1 | 2 |
', 25)) AS body UNION ALL SELECT 2, concat('x ', repeat('QUJD', 600)) UNION ALL SELECT 3, 'small')"""


@query("bulk_data", "SELECT * FROM (VALUES (1, 'table', 'pipe-table', 25, 2), (2, 'base64', 'inline', NULL, NULL)) AS v(id, kind, form, \"rows\", \"columns\")")
def bulk_data(spark, d):
    rows = literal(spark, BULKY).select("id", udf.bulk_data(F.col("body")).alias("b"))
    return rows.select("id", F.explode("b.elements").alias("e")).select("id", "e.kind", "e.form", "e.rows", "e.columns")


@query("cache_header_status", "SELECT * FROM (VALUES (1,'pass'),(2,'warn'),(3,'fail'),(4,'pass'),(5,'pass'),(6,'fail'),(7,'pass'),(8,'pass'),(9,'warn'),(10,'pass'),(11,'fail'),(12,'pass'),(13,'pass')) AS v(id, status)")
def cache_header_status(spark, d):
    c = F.col
    return literal(spark, fixtures.HEADERS).select("id", T.cache_status(c("cache_control"), c("expires"), c("etag"), c("last_modified"), c("as_of")).alias("status"))


@query("capture_ledger", "SELECT * FROM (VALUES (1, 'u1', 200, NULL, false), (2, 'u2', 429, NULL, true), (3, 'u3', 429, NULL, false), (4, 'u4', 403, 'Cloudflare challenge', true)) AS v(seq, url, status, challenge, blocked)")
def capture_ledger(spark, d):
    rows = [response("r", "u2", status=429, second=2), response("r", "u1", second=1), response("r", "u4", "<title>Just a moment</title>", status=403, second=4), response("r", "u3", status=429, second=3, retry_after="5")]
    return C.ledger(spark.createDataFrame(rows, C.SCHEMA)).select(F.col("seq").cast("int").alias("seq"), "url", "status", "challenge", "blocked")


PROTECTED = """(SELECT * FROM (VALUES (1, 'text/html', '<html><title>Just a moment...</title><body></body></html>'), (2, 'text/html', '<html><body><p>Please verify you are human.</p></body></html>'),
 (3, 'text/html', '<html><body><div class="g-recaptcha"></div>Checking your browser before accessing</body></html>'), (4, 'text/markdown', '# Checking your browser before accessing'),
 (5, 'text/html', concat('<html><body><main><h1>How we verify that you are human</h1>', repeat('<p>This page explains at length how checks of browsers work and what readers do about them.</p>', 9), '</main></body></html>')),
 (6, 'text/html', '<html><body><script src="/cdn-cgi/challenge-platform/x.js"></script>Docs</body></html>'), (7, 'text/html', concat('<html>captcha-delivery.com', repeat('x', 100000)))) AS v(id, type, body))"""


@query("challenge_pages", "SELECT * FROM (VALUES (1, 'Cloudflare challenge'), (2, 'Browser verification interstitial'), (3, 'CAPTCHA widget'), (4, NULL), (5, NULL), (6, NULL), (7, NULL)) AS v(id, challenge)")
def challenge_pages(spark, d):
    return literal(spark, PROTECTED).select("id", challenge_page(F.col("body"), F.col("type")).alias("challenge"))


LEADING = """(SELECT * FROM (VALUES (1, '[Home](/) [Docs](/d)

# Title

This is a paragraph that tells readers what the page is about.'), (2, 'var a = 1;
b { c: d; }

A long line of prose without a heading that goes on for over eighty characters so that it counts.'), (3, '# Menu

[a](x)
[b](y)

# Menu two'), (4, 'Title
=====

| a | b |
| - | - |'), (5, '')) AS v(id, body))"""


@query("content_start_cases", "SELECT * FROM (VALUES (1, 22), (2, 24), (3, 34), (4, 0), (5, 1)) AS v(id, start)")
def content_start_cases(spark, d):
    return literal(spark, LEADING).select("id", udf.content_start(F.col("body")).alias("start"))


@query("dependency_gate", f"""WITH e AS (SELECT * FROM (VALUES {DEPS}) AS v(check_id, g, dep)), r AS (SELECT * FROM {fixtures.RESULTS} AS q), x AS (SELECT DISTINCT run_id FROM r),
gr AS (SELECT x.run_id, e.check_id, g, bool_or(coalesce(r.status IN ('pass', 'warn'), false)) AS ok, bool_or(r.status IS NOT NULL) AS ran FROM x CROSS JOIN e LEFT JOIN r ON r.run_id = x.run_id AND r.check_id = e.dep GROUP BY ALL)
SELECT run_id, check_id, bool_or(ran) AND NOT bool_and(ok) AS skipped FROM gr GROUP BY ALL""")
def dependency_gate(spark, d):
    return dag.gate(literal(spark, fixtures.RESULTS))


@query("discovery_scopes", "SELECT * FROM (VALUES ('a', 0, '/de/docs'), ('b', 0, '/en-gb/x'), ('c', 0, ''), ('d', 0, '/docs')) AS v(run_id, rank, path)")
def discovery_scopes(spark, d):
    runs = literal(spark, "(SELECT * FROM (VALUES ('a', 'https://a.io/en/docs', NULL), ('b', 'https://a.io/en-gb/x', 'https://a.io'), ('c', 'https://a.io/fr/x', 'https://b.io'), ('d', 'https://a.io/docs', 'https://www.a.io')) AS v(run_id, base_url, effective_origin))")
    de = discovery.scopes(runs.filter("run_id = 'a'"), Options(preferred_locale="de"))
    return de.unionByName(discovery.scopes(runs.filter("run_id <> 'a'"), Options()))


FENCED = """(SELECT * FROM (VALUES (1, '```
x
```'), (2, '```
open'), (3, '> ~~~
> a
> ~~~'), (4, '1. item

   ```js
   a
   ```
text'), (5, '````
```
````'), (6, 'no fence')) AS v(id, body))"""


@query("fences", "SELECT * FROM (VALUES (1, 1, NULL, 'pass'), (2, 1, 1, 'fail'), (3, 1, NULL, 'pass'), (4, 1, NULL, 'pass'), (5, 1, NULL, 'pass'), (6, 0, NULL, 'pass')) AS v(id, fences, open_line, status)")
def fences(spark, d):
    return literal(spark, FENCED).select("id", udf.fences(F.col("body")).alias("f")).select("id", F.col("f.count").alias("fences"), "f.open_line", "f.status")


@query("html_directive_position", "SELECT * FROM (VALUES (14, 4::BIGINT, '<a href=\"/docs/llms.txt\">index</a>'), (15, 8, '/llms.txt')) AS v(id, position, text)")
def html_directive_position(spark, d):
    return literal(spark, fixtures.BODIES).select("id", T.directive(F.col("body")).alias("d")).filter("d is not null").select("id", F.col("d.position").cast("long").alias("position"), "d.text")


LINKED = """(SELECT * FROM (VALUES (1, 'See [a](b.md), [a again](b.md), ![i](/i.png), [x](https://o.io/p.md#s), [f](#top) and [m](mailto:a@b.c)'),
 (2, '```
[no](code.md)
```
`[no](span.md)` [ref][one] and [one]

[one]: //cdn.io/x "t"
[one]: second.md'), (3, '[bad](a{b}) [amp](a?b=1&amp;c=2)')) AS v(id, body))"""


@query("links", """SELECT * FROM (VALUES (1, 'b.md', 'path-relative', 'https://a.io/d/b.md', false, true, false), (1, '/i.png', 'root-relative', 'https://a.io/i.png', false, false, true),
(1, 'https://o.io/p.md#s', 'absolute', 'https://o.io/p.md', true, true, false), (1, '#top', 'fragment', NULL, false, false, false), (1, 'mailto:a@b.c', 'other-scheme', NULL, false, false, false),
(2, '//cdn.io/x', 'protocol-relative', 'https://cdn.io/x', true, false, false), (3, 'a?b=1&c=2', 'path-relative', 'https://a.io/d/a?b=1&c=2', false, false, false)) AS v(id, url, class, "fetch", cross_origin, markdown, image)""")
def links(spark, d):
    rows = literal(spark, LINKED).select("id", F.explode(udf.links(F.col("body"), F.lit("https://a.io/d/page.md"))).alias("l"))
    return rows.select("id", "l.url", "l.class", "l.fetch", "l.cross_origin", "l.markdown", "l.image")


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    run, sql = CASES[name]
    df, rel = run(spark, None), duckdb.sql(sql)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == sorted([plain(r[k]) for k in at] for r in rel.fetchall())
