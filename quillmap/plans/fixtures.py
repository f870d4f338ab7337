"""Small literal tables, as SQL that Spark and other engines read alike, for operators the driver's tables have no case of."""

RESULTS = """(SELECT run_id, check_id, status, CAST(pass_bucket AS INT) AS pass_bucket, CAST(warn_bucket AS INT) AS warn_bucket, CAST(fail_bucket AS INT) AS fail_bucket,
 CAST(rate AS INT) AS rate, CAST(requests AS INT) AS requests, CAST(failed AS INT) AS failed, CAST(max_chars AS INT) AS max_chars, CAST(tested AS INT) AS tested,
 CAST(rate_limited AS INT) AS rate_limited, CAST(same_origin AS INT) AS same_origin, CAST(cross_origin AS INT) AS cross_origin, CAST(gzipped_skipped AS BOOLEAN) AS gzipped_skipped
FROM (VALUES
 ('a','llms-txt-exists','pass',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('a','llms-txt-size','fail',NULL,NULL,NULL,NULL,NULL,NULL,250000,NULL,NULL,NULL,NULL,NULL),
 ('a','llms-txt-links-resolve','warn',NULL,NULL,NULL,93,NULL,NULL,NULL,40,NULL,0,12,NULL),
 ('a','llms-txt-links-markdown','pass',NULL,NULL,NULL,96,NULL,NULL,NULL,40,NULL,NULL,NULL,NULL),
 ('a','llms-txt-directive-html','fail',NULL,NULL,NULL,NULL,NULL,NULL,NULL,50,NULL,NULL,NULL,NULL),
 ('a','markdown-url-support','pass',NULL,NULL,NULL,NULL,NULL,NULL,NULL,50,2,NULL,NULL,NULL),
 ('a','content-negotiation','warn',NULL,NULL,NULL,NULL,NULL,NULL,NULL,50,0,NULL,NULL,NULL),
 ('a','rendering-strategy','fail',20,10,20,NULL,NULL,NULL,NULL,50,NULL,NULL,NULL,NULL),
 ('a','page-size-html','fail',30,10,10,NULL,NULL,NULL,NULL,50,NULL,NULL,NULL,NULL),
 ('a','page-size-markdown','pass',50,0,0,NULL,NULL,NULL,NULL,50,NULL,NULL,NULL,NULL),
 ('a','cache-header-hygiene','warn',0,0,0,NULL,NULL,NULL,NULL,50,NULL,NULL,NULL,NULL),
 ('a','bot-protection-interference','warn',NULL,NULL,NULL,NULL,200,30,NULL,NULL,NULL,NULL,NULL,NULL),
 ('b','llms-txt-exists','fail',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('b','llms-txt-size','skip',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('b','rendering-strategy','fail',0,0,3,NULL,NULL,NULL,NULL,3,2,NULL,NULL,NULL),
 ('b','markdown-url-support','fail',NULL,NULL,NULL,NULL,NULL,NULL,NULL,3,1,NULL,NULL,NULL),
 ('b','http-status-codes','warn',NULL,NULL,NULL,NULL,NULL,NULL,NULL,3,NULL,NULL,NULL,NULL),
 ('b','auth-gate-detection','fail',NULL,NULL,NULL,NULL,NULL,NULL,NULL,3,NULL,NULL,NULL,NULL),
 ('b','auth-alternative-access','fail',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('b','llms-txt-coverage','skip',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,true),
 ('c','llms-txt-exists','pass',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('c','llms-txt-size','warn',NULL,NULL,NULL,NULL,NULL,NULL,60000,NULL,NULL,NULL,NULL,NULL),
 ('c','llms-txt-coverage','pass',NULL,NULL,NULL,97,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('c','content-negotiation','pass',NULL,NULL,NULL,NULL,NULL,NULL,NULL,10,NULL,NULL,NULL,NULL),
 ('c','markdown-content-parity','warn',7,2,1,NULL,NULL,NULL,NULL,10,NULL,NULL,NULL,NULL),
 ('c','rendering-strategy','pass',10,0,0,NULL,NULL,NULL,NULL,10,NULL,NULL,NULL,NULL),
 ('c','auth-gate-detection','pass',NULL,NULL,NULL,NULL,NULL,NULL,NULL,10,NULL,NULL,NULL,NULL),
 ('c','section-header-quality','error',NULL,NULL,NULL,NULL,NULL,NULL,NULL,10,NULL,NULL,NULL,NULL)
) AS v(run_id, check_id, status, pass_bucket, warn_bucket, fail_bucket, rate, requests, failed, max_chars, tested, rate_limited, same_origin, cross_origin, gzipped_skipped))"""

ITEMS = """(SELECT * FROM (VALUES
 ('a','markdown-url-support','u1','pass'), ('a','markdown-url-support','u2','pass'), ('a','markdown-url-support','u3','fail'),
 ('a','content-negotiation','u1','warn'), ('a','content-negotiation','u2','fail'), ('a','content-negotiation','u3','skip'),
 ('a','llms-txt-directive-html','u1','fail'), ('a','llms-txt-directive-html','u2','skip'),
 ('a','page-size-html','u1','pass'), ('a','page-size-html','u2','warn'), ('a','page-size-html','u3','fail'),
 ('b','http-status-codes','u1','skip'), ('b','markdown-url-support','u1','skip'), ('b','auth-gate-detection','u1','fail'), ('b','auth-gate-detection','u2','fail'),
 ('c','content-negotiation','u1','pass'), ('c','auth-gate-detection','u1','pass'), ('c','auth-gate-detection','u2','warn'), ('c','markdown-content-parity','u2','warn')
) AS v(run_id, check_id, url, status))"""

RUNS = "(SELECT * FROM (VALUES ('a','random',50,200,30), ('b','deterministic',3,60,20), ('c','curated',10,100,0), ('d','none',0,0,0)) AS v(run_id, sampling_strategy, tested_pages, requests, failed))"
TAGS = "(SELECT * FROM (VALUES ('a','u1','api'), ('a','u2','guide'), ('a','u3','guide'), ('b','u1','api'), ('c','u1','api'), ('c','u2','guide'), ('c','u9','none')) AS v(run_id, url, tag))"
SYMPTOMS = """(SELECT * FROM (VALUES ('a','p1','too much'), ('a','p1','too little'), ('a','p2','too much'), ('a','p2','too much'),
 ('c','p1','unnavigable'), ('c','p2','inconsistent')) AS v(run_id, page_key, direction))"""

VERSIONS = """(SELECT * FROM (VALUES (0,'https://d.io/v1/install'), (1,'https://d.io/v2.10/install'), (2,'https://d.io/v2.9/install'), (3,'https://d.io/latest/api'),
 (4,'https://d.io/3.0/api'), (5,'https://d.io/next/api'), (6,'https://d.io/guide'), (7,'https://d.io/dev/only'), (8,'https://d.io/api/v3'), (9,'https://d.io/42/page')) AS v(ordinal, url))"""

BODIES = """(SELECT * FROM (VALUES
 (1, '<!doctype html><html><body><h1>Hi</h1></body></html>'), (2, '# Title

Some text with a [link](x.md).'), (3, '# Page Not Found'), (4, '<html><head><title>Sign in | Acme</title></head><body></body></html>'),
 (5, '<form action="/oauth/start"><input type="text"></form>'), (6, '<input type="password">'), (7, '<script>window.location = "/new"</script>'),
 (8, 'if (window.location == x) stay()'), (9, '<pre>location.href = "x"</pre> only an example'), (10, '<meta http-equiv="refresh" content="0">'),
 (11, '```html
<html>
```
plain'), (12, ''), (13, 'Nothing here. 404'), (14, 'See <a href="/docs/llms.txt">index</a> first'), (15, '<nav>/llms.txt</nav><p>read /llms.txt now</p>'),
 (16, 'login help: <title>unable to login</title>')) AS v(id, body))"""

REDIRECTS = """(SELECT * FROM (VALUES
 (1, 'https://a.io/x', 301, 'https://a.io/y'), (2, 'https://a.io/x', 302, 'https://www.a.io/y'), (3, 'https://a.io/x', 308, 'https://b.io/y'), (4, 'https://a.io/x', 200, NULL),
 (5, 'https://a.io/x', 307, NULL), (6, 'http://a.io/x', 301, 'https://a.io:443/x'), (7, 'https://a.io/x', 301, 'https://a.io:8443/x'), (8, 'https://a.io/x', 401, NULL),
 (9, 'https://a.io/x', 302, 'https://login.a.io/'), (10, 'https://a.io/x', 302, 'https://acme.okta.com/app'), (11, 'https://a.io/x', 403, NULL), (12, 'https://a.io/x', 503, NULL),
 (13, 'https://a.io/x', 404, NULL), (14, 'https://a.io/x', 410, NULL), (15, 'https://a.io/x', 202, NULL)) AS v(id, url, status, location))"""

HEADERS = """(SELECT id, cache_control, expires, etag, last_modified, CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS as_of FROM (VALUES
 (1, 'max-age=60', NULL, NULL, NULL), (2, 'public, max-age=7200', NULL, NULL, NULL), (3, 'max-age=604800', NULL, '"x"', NULL), (4, 'no-store', NULL, NULL, NULL),
 (5, 'max-age=99999999, must-revalidate', NULL, '"x"', NULL), (6, NULL, NULL, NULL, NULL), (7, NULL, NULL, '"x"', NULL), (8, NULL, 'Thu, 01 Jan 2026 00:30:00 GMT', NULL, NULL),
 (9, NULL, 'Thu, 01 Jan 2026 12:00:00 GMT', NULL, NULL), (10, 'S-MAXAGE=10, max-age=999999', NULL, NULL, NULL), (11, 'private', NULL, NULL, NULL), (12, 'max-age=abc', NULL, NULL, 'Mon'),
 (13, NULL, 'Wed, 31 Dec 2025 00:00:00 GMT', NULL, NULL)) AS v(id, cache_control, expires, etag, last_modified))"""
