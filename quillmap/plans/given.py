"""Parsers, predicates and rules over responses, bodies and runs that are derived from the given tables, with SQL.

What a query reads is derived from the id of its row, so that every case occurs, and from texts, times and words of the
tables, so that the work grows with them; the statements derive the same rows on their own. `tests/test_literal_cases.py`
has the small cases that these queries read before.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.dims import Options, dim_values
from quillmap.functions import text as T
from quillmap.functions import udf
from quillmap.functions import url as U
from quillmap.functions.challenge import challenge_page
from quillmap.plans import catalogue, dag, scoring
from quillmap.plans.catalogue import LOCALE, PARTS, query, spread, table
from quillmap.sources import capture as C
from quillmap.sources import discovery

c = F.col


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _by_form(number, *bodies):
    """The body whose place is the number modulo how many there are."""
    out = F.when(number % len(bodies) == 0, bodies[0])
    for k, body in enumerate(bodies[1:], 1):
        out = out.when(number % len(bodies) == k, body)
    return out


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _forms(number: str, *bodies: str) -> str:
    """The same in SQL; each body is an expression."""
    return f"CASE {number} % {len(bodies)} " + " ".join(f"WHEN {k} THEN {body}" for k, body in enumerate(bodies)) + " END"


# ------------------------------------------------------------------------------------------------ responses
STATUSES = (401, 403, 503, 404, 202, 200, 301, 302, 307, 308, 302, 301)
LOCATIONS = ("https://login.a.io/", "https://acme.okta.com/app", "https://a.io/y", "https://www.a.io/y", "https://a.io:443/x", "https://notokta.com/", "https://AUTH.b.io/x", "https://x.sso.b.io/", "https://b.io/login.", "https://accounts.google.com", None)
SSO = "^(" + "|".join(h.replace(".", r"\.") for h in T.SSO_HOSTS) + r")|\.(" + "|".join(h.replace(".", r"\.") for h in T.SSO_HOSTS) + ")$"


@query("auth_class", f"""WITH r AS (SELECT event_id AS id, {_forms('event_id', *map(str, STATUSES))} AS status, {_forms('user_id', *(f"'{x}'" if x else 'NULL' for x in LOCATIONS))} AS location FROM events)
SELECT id, CASE WHEN status IN (401, 403) THEN 'auth-required' WHEN status BETWEEN 300 AND 399 AND regexp_matches(lower(regexp_extract(location, '^https?://([^/?#:]+)', 1)), '{SSO}') THEN 'auth-redirect' ELSE 'accessible' END AS class FROM r""")
def auth_class(spark, d):
    """Events as responses: their numbers give statuses, their users where redirects lead."""
    status, location = _by_form(c("event_id"), *map(F.lit, STATUSES)), _by_form(c("user_id"), *map(F.lit, LOCATIONS))
    rows = table(spark, d, "events").select(c("event_id").alias("id"), status.alias("status"), location.alias("location"))
    sso = c("status").between(300, 399) & T.sso_host(U.host(c("location")))
    return rows.select("id", F.when(c("status").isin(401, 403), "auth-required").when(sso, "auth-redirect").otherwise("accessible").alias("class"))


# ------------------------------------------------------------------------------------------------ bodies
TITLE = r"trim(regexp_extract(low, '<title[^>]*>(.*?)</title>', 1))"
CLASSED = f"""w AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z\\n ]+', '', 'g') AS w, chr(10) AS nl FROM documents),
b AS (SELECT doc_id AS id, {_forms('doc_id', "'<!doctype html><html><body><h1>' || w || '</h1></body></html>'", "'# ' || w", "w || nl || '[link](x.md)'", "'# Page Not Found' || nl || w",
 "'<html><head><title>Sign in | Acme</title></head><body>' || w || '</body></html>'", "'<form action=\"/oauth/start\"><input type=\"text\"></form>' || w", "w || '<input type=\"password\">'", "'<script>window.location = \"/new\"</script>' || w",
 "'if (window.location == x) ' || w", "'<pre>location.href = \"x\"</pre>' || w", "'```html' || nl || '<html>' || nl || '```' || nl || w", "w || ' 404'")} AS body FROM w),
s AS (SELECT *, lower(substr(body, 1, 50000)) AS low, substr(regexp_replace(regexp_replace(body, '(?sm)^```[^\\n]*\\n.*?\\n```[ \\t]*$', '', 'g'), '`[^`\\n]+`', '``', 'g'), 1, 2000) AS bare,
 regexp_extract(substr(body, 1, 500), '(?m)^#{{1,6}}\\s+(.+)', 1) AS heading, regexp_replace(substr(body, 1, 10000), '(?is)<(pre|code)\\b.*?</(pre|code)>', '', 'g') AS script FROM b),
h AS (SELECT *, regexp_matches(bare, '(?i)<!doctype\\s|<html[\\s>]|<head[\\s>]|<body[\\s>]') AS html FROM s)"""


@query("body_classes", rf"""WITH {CLASSED} SELECT id, html, NOT html AND regexp_matches(substr(body, 1, 5000), '(?m)^#{{1,6}}\s+\S|\[[^\]]+\]\([^)]+\)|^```') AS markdown,
(heading <> '' AND regexp_matches(heading, '{T.SOFT_404}')) OR (length(body) < 500 AND regexp_matches(body, '{T.SOFT_404}')) AS missing,
CASE WHEN contains(low, '<input') AND contains(low, 'type="password"') THEN 'password input' WHEN regexp_matches({TITLE}, '^(sign\s*in|log\s*in)\b') THEN 'title' WHEN regexp_matches(low, '<form[^>]*action\s*=\s*"[^"]*(saml|oauth|openid|sso|auth)[^"]*"') THEN 'form action' END AS login,
regexp_matches(script, '{T.JS_REDIRECT.replace("'", "''")}') AS redirects FROM h""")
def body_classes(spark, d):
    """Texts as bodies of twelve kinds."""
    w = F.regexp_replace("text", "[^A-Za-z\n ]+", "")
    body = _by_form(
        c("doc_id"), _text("<!doctype html><html><body><h1>", w, "</h1></body></html>"), _text("# ", w), _text(w, "\n[link](x.md)"), _text("# Page Not Found\n", w),
        _text("<html><head><title>Sign in | Acme</title></head><body>", w, "</body></html>"), _text('<form action="/oauth/start"><input type="text"></form>', w), _text(w, '<input type="password">'),
        _text('<script>window.location = "/new"</script>', w), _text("if (window.location == x) ", w), _text('<pre>location.href = "x"</pre>', w), _text("```html\n<html>\n```\n", w), _text(w, " 404"))
    b = c("body")
    return _documents(spark, d).select(c("doc_id").alias("id"), body.alias("body")).select(
        "id", T.looks_html(b).alias("html"), T.looks_markdown(b).alias("markdown"), T.soft_404(b).alias("missing"), T.login_form(b, F.lit(False)).alias("login"), T.js_redirect(b).alias("redirects"))


@query("bulk_data", """SELECT doc_id AS id, 'table' AS kind, 'pipe-table' AS form, len(string_split(text, chr(10)))::INT AS "rows", 2 AS "columns" FROM documents WHERE len(string_split(text, chr(10))) >= 20
UNION ALL SELECT doc_id, 'base64', 'inline', NULL, NULL FROM documents WHERE (strlen(text) + 2) // 3 * 4 >= 2000""")
def bulk_data(spark, d):
    """Texts as a table with a row for each line, and their bytes as base64 behind it."""
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("| "), F.length(x), F.lit(" | x |"))), "\n")
    body = _text("intro text\n\n| a | b |\n| --- | --- |\n", lines, "\n\n", F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", ""))
    rows = _documents(spark, d).select(c("doc_id").alias("id"), udf.bulk_data(body).alias("b"))
    return rows.select("id", F.explode("b.elements").alias("e")).select("id", "e.kind", "e.form", "e.rows", "e.columns")


CONTROLS = ("'max-age=' || (user_id * 97)", "'public, max-age=' || (user_id * 11)", "'no-store'", "'max-age=99999999, must-revalidate'", "'S-MAXAGE=' || (user_id * 90) || ', max-age=999999'", "'private'", "'max-age=abc'", "NULL", "NULL")
CACHED = f"""r AS (SELECT event_id AS id, {_forms('event_id', *CONTROLS)} AS cc, CASE WHEN event_id % 5 < 2 THEN greatest(0, epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts)) + 86400 * (user_id % 4 - 1)) END AS rest,
 event_id % 4 = 0 OR event_id % 7 = 0 AS validator FROM events),
a AS (SELECT *, coalesce(try_cast(regexp_extract(lower(cc), 's-maxage=(-?[0-9]+)', 1) AS BIGINT), try_cast(regexp_extract(lower(cc), '(^|[ ,])max-age=(-?[0-9]+)', 2) AS BIGINT), rest) AS age FROM r)"""


@query("cache_header_status", f"""WITH {CACHED} SELECT id, CASE WHEN cc = 'no-store' THEN 'pass' WHEN contains(cc, 'must-revalidate') AND validator THEN 'pass' WHEN age IS NULL THEN CASE WHEN validator THEN 'pass' ELSE 'fail' END
WHEN age <= 3600 THEN 'pass' WHEN age <= 86400 THEN 'warn' ELSE 'fail' END AS status FROM a""")
def cache_header_status(spark, d):
    """Events as responses: Cache-Control by their numbers, Expires by their times, seen at midnight before them."""
    control = _by_form(
        c("event_id"), F.concat(F.lit("max-age="), c("user_id") * 97), F.concat(F.lit("public, max-age="), c("user_id") * 11), F.lit("no-store"), F.lit("max-age=99999999, must-revalidate"),
        F.concat(F.lit("S-MAXAGE="), c("user_id") * 90, F.lit(", max-age=999999")), F.lit("private"), F.lit("max-age=abc"), F.lit(None), F.lit(None))
    later = c("ts") + F.make_dt_interval((c("user_id") % 4 - 1).cast("int"))
    expires = F.when(c("event_id") % 5 < 2, F.date_format(later, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    etag, modified = F.when(c("event_id") % 4 == 0, '"x"').when(c("event_id") % 4 == 1, ""), F.when(c("event_id") % 7 == 0, "Mon")
    rows = table(spark, d, "events").select(
        c("event_id").alias("id"), control.alias("cache_control"), expires.alias("expires"), etag.alias("etag"), modified.alias("last_modified"), F.date_trunc("day", "ts").cast("timestamp").alias("as_of"))
    return rows.select("id", T.cache_status(c("cache_control"), c("expires"), c("etag"), c("last_modified"), c("as_of")).alias("status"))


@query("capture_ledger", """SELECT user_id::VARCHAR AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, 'u' || event_id))::INT AS seq, 'u' || event_id AS url, CASE event_id % 8 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 5 THEN 200 WHEN 6 THEN 200 WHEN 7 THEN 404 ELSE 429 END AS status,
CASE WHEN event_id % 5 = 0 THEN 'Cloudflare challenge' END AS challenge, event_id % 8 IN (1, 2, 3, 4) AS blocked FROM events""")
def capture_ledger(spark, d):
    """Events as a capture: each user's are the answers that a run got."""
    status = _by_form(c("event_id"), *map(F.lit, (429, 429, 403, 503, 429, 200, 200, 404)))
    wait = _by_form(c("event_id"), *map(F.lit, ("5", None, "5", None, "120", None, "5", None)))  # 1 to 60 seconds can be waited
    body = F.when(c("event_id") % 5 == 0, "<title>Just a moment</title>").otherwise("<p>text</p>")
    headers = F.map_filter(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Retry-After"), wait), lambda k, v: v.isNotNull())
    values = {
        "run_id": c("user_id").cast("string"), "url": F.concat(F.lit("u"), "event_id"), "method": F.lit("GET"), "redirect_mode": F.lit("follow"), "status": status, "redirected": F.lit(False), "headers": headers, "body": body,
        "bytes": F.length(body), "wire_bytes": F.length(body), "outcome": F.lit("ok"), "fetched_at": c("ts"),
    }
    fields = [x.rsplit(" ", 1) for x in C.SCHEMA.replace("map<string,string>", "map").split(", ")]
    capture = table(spark, d, "events").select(*[values.get(n, F.lit(None)).cast(kind.replace("map", "map<string,string>")).alias(n) for n, kind in fields])
    return C.ledger(capture).select("run_id", c("seq").cast("int").alias("seq"), "url", "status", "challenge", "blocked")


SEEN = "length(trim(regexp_replace({} || w, ' +', ' ', 'g')))"  # what a page shows


@query("challenge_pages", f"""WITH w AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]+', ' ', 'g') AS w FROM documents)
SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN CASE WHEN length(w) + 75 <= 100000 THEN 'Cloudflare challenge' END
WHEN 1 THEN CASE WHEN {SEEN.format("'Please verify you are human. '")} < 1500 THEN 'Browser verification interstitial' END WHEN 2 THEN CASE WHEN {SEEN.format("'Checking your browser before accessing '")} < 1500 THEN 'CAPTCHA widget' END
WHEN 4 THEN CASE WHEN {SEEN.format("'How we verify that you are human'")} < 500 THEN 'Browser verification interstitial' END WHEN 6 THEN CASE WHEN length(w) + 27 <= 100000 THEN 'DataDome challenge' END END AS challenge FROM w""")
def challenge_pages(spark, d):
    """Texts as pages of seven kinds: long ones have content of their own and are no challenges."""
    w = F.regexp_replace("text", "[^A-Za-z ]+", " ")
    body = _by_form(
        c("doc_id"), _text("<html><title>Just a moment...</title><body><p>", w, "</p></body></html>"), _text("<html><body><p>Please verify you are human. ", w, "</p></body></html>"),
        _text('<html><body><div class="g-recaptcha"></div>Checking your browser before accessing ', w, "</body></html>"), _text("# Checking your browser before accessing ", w),
        _text("<html><body><main><h1>How we verify that you are human</h1><p>", w, "</p></main></body></html>"), _text('<html><body><script src="/cdn-cgi/challenge-platform/x.js"></script>Docs ', w, "</body></html>"),
        _text("<html>captcha-delivery.com ", w))
    kind = F.when(c("doc_id") % 7 == 3, "text/markdown").otherwise("text/html")
    return _documents(spark, d).select(c("doc_id").alias("id"), body.alias("body"), kind.alias("type")).select("id", challenge_page(c("body"), c("type")).alias("challenge"))


@query("content_start_cases", """WITH w AS (SELECT doc_id AS id, length(rtrim('The ' || regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z ]+', '', 'g'))) AS n FROM documents)
SELECT id, (CASE id % 5 WHEN 0 THEN CASE WHEN n >= 41 THEN 22 ELSE 32 + n END WHEN 1 THEN CASE WHEN n >= 80 THEN 24 ELSE 25 + n END WHEN 2 THEN CASE WHEN n >= 41 THEN 23 ELSE 36 + n END WHEN 3 THEN 0 WHEN 4 THEN CASE WHEN n >= 80 THEN 0 ELSE 1 + n END END)::INT AS start FROM w""")
def content_start_cases(spark, d):
    """First lines of texts behind links, script, menus and a table; short ones are no prose, so that nothing starts."""
    w = F.rtrim(_text("The ", F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "[^A-Za-z ]+", "")))
    body = _by_form(
        c("doc_id"), _text("[Home](/) [Docs](/d)\n\n# Title\n\n", w), _text("var a = 1;\nb { c: d; }\n\n", w), _text("# Menu\n\n[a](x)\n[b](y)\n\n# Menu two\n\n", w), _text("Title\n=====\n\n| a | b |\n| - | - |\n", w), w)
    return _documents(spark, d).select(c("doc_id").alias("id"), udf.content_start(body).alias("start"))


# ------------------------------------------------------------------------------------------------ runs
STATES = {"1": "pass", "2": "warn", "3": "fail", "4": "skip", "5": "error"}
ORDERED = f"""(SELECT o_custkey // 4 AS run_id, check_id, arg_max(CASE substr(o_orderpriority, 1, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} END, o_orderkey) AS status
 FROM orders JOIN {dim_values()} AS dm ON dm.ordinal = o_orderkey % 28 GROUP BY ALL)"""


@query("dependency_gate", f"""WITH e AS (SELECT * FROM (VALUES {catalogue.DEPS}) AS v(check_id, g, dep)), r AS (SELECT * FROM {ORDERED} AS q), x AS (SELECT DISTINCT run_id FROM r),
gr AS (SELECT x.run_id, e.check_id, g, bool_or(coalesce(r.status IN ('pass', 'warn'), false)) AS ok, bool_or(r.status IS NOT NULL) AS ran FROM x CROSS JOIN e LEFT JOIN r ON r.run_id = x.run_id AND r.check_id = e.dep GROUP BY ALL)
SELECT run_id, check_id, bool_or(ran) AND NOT bool_and(ok) AS skipped FROM gr GROUP BY ALL""")
def dependency_gate(spark, d):
    """Orders of four customers as the results of a run: their numbers give checks, their priorities statuses; the last one counts."""
    dim = F.broadcast(scoring.dim_check(spark).select("check_id", "ordinal"))  # 28 rows
    rows = table(spark, d, "orders").join(dim, c("ordinal") == c("o_orderkey") % 28)
    state = F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.substring("o_orderpriority", 1, 1))
    return dag.gate(rows.groupBy(F.floor(c("o_custkey") / 4).alias("run_id"), "check_id").agg(F.max_by(state, "o_orderkey").alias("status")))


SCOPED = f"""(SELECT CAST(page_id AS VARCHAR) AS run_id, page_id % 2 = 0 AS german, {_forms('page_id', "url", "replace(url, '/en/', '/en-gb/')", "replace(url, '/fr/', '/docs/fr/')", "replace(url, '/de/', '/de-at/')", "replace(url, '/es/', '/guide/')")} AS url, page_id % 4 = 1 AS abroad FROM pages)"""
SEGMENTS = "CASE WHEN german AND loc <> 'de' THEN list_concat(segs[1:list_position(lows, loc) - 1], ['de'], segs[list_position(lows, loc) + 1:]) ELSE segs END"


@query("discovery_scopes", rf"""WITH {PARTS.replace('FROM pages', f'FROM {SCOPED} AS r')}, l AS (SELECT *, {LOCALE} AS loc, list_transform(segs, lambda s: lower(s)) AS lows FROM o),
m AS (SELECT *, CASE WHEN abroad THEN '' WHEN german AND loc <> 'de' THEN '/' || array_to_string({SEGMENTS}, '/') ELSE regexp_replace(path, '/$', '') END AS main FROM l)
SELECT run_id, 0 AS rank, main AS path FROM m UNION ALL SELECT run_id, 1, regexp_replace(path, '/$', '') FROM m WHERE german AND NOT abroad AND starts_with(loc, 'de-')""")
def discovery_scopes(spark, d):
    """Pages as bases of runs: half of these prefer German; some sites have moved to another host, or abroad as a whole."""
    u = c("url")
    base = _by_form(c("page_id"), u, F.replace(u, F.lit("/en/"), F.lit("/en-gb/")), F.replace(u, F.lit("/fr/"), F.lit("/docs/fr/")), F.replace(u, F.lit("/de/"), F.lit("/de-at/")), F.replace(u, F.lit("/es/"), F.lit("/guide/")))
    moved = F.concat(U.scheme(u), F.lit("://www."), U.canonical_host(u))
    effective = _by_form(c("page_id"), F.lit(None).cast("string"), F.lit("https://b.test"), moved, U.origin(u))
    runs = table(spark, d, "pages").select("page_id", c("page_id").cast("string").alias("run_id"), base.alias("base_url"), effective.alias("effective_origin"))
    de = discovery.scopes(runs.filter("page_id % 2 = 0"), Options(preferred_locale="de"))
    return de.unionByName(discovery.scopes(runs.filter("page_id % 2 <> 0"), Options()))


# ------------------------------------------------------------------------------------------------ Markdown
FENCED = r"""x AS (SELECT doc_id AS id, list_transform(string_split(regexp_replace(text, '[^A-Za-z\n ]+', '', 'g'), chr(10)), lambda x: regexp_matches(x, '^[A-E]')) AS marks FROM documents),
m AS (SELECT id, len(list_filter(marks, lambda x: x)) AS n, len(marks) + 1 - list_position(list_reverse(marks), true) AS last FROM x)"""


@query("fences", f"""WITH {FENCED} SELECT id, (CASE id % 4 WHEN 3 THEN 1 ELSE (n + 1) // 2 END)::INT AS fences, (CASE WHEN id % 4 = 3 THEN 1 WHEN n % 2 = 1 THEN last + CASE id % 4 WHEN 2 THEN 2 ELSE 0 END END)::INT AS open_line,
CASE WHEN id % 4 = 3 OR n % 2 = 1 THEN 'fail' ELSE 'pass' END AS status FROM m""")
def fences(spark, d):
    """Lines that begin with A to E as fence marks: bare, in a quote, in a list item, and behind a longer mark that none closes."""
    w = F.regexp_replace("text", "[^A-Za-z\n ]+", "")
    marked = lambda mark: F.regexp_replace(w, "(?m)^[A-E][^\n]*$", mark)
    body = _by_form(
        c("doc_id"), marked("```"), _text("> ", F.replace(marked("~~~"), F.lit("\n"), F.lit("\n> "))), _text("1. item\n\n   ", F.replace(marked("```"), F.lit("\n"), F.lit("\n   "))), _text("````\n", marked("```")))
    rows = _documents(spark, d).select(c("doc_id").alias("id"), udf.fences(body).alias("f"))
    return rows.select("id", c("f.count").alias("fences"), "f.open_line", "f.status")


POINTED = r"""b AS (SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN replace(html, '</nav>', '</nav><a class="x" href="/docs/llms.txt">index</a>') WHEN 2 THEN replace(html, '</body>', '<p>read /llms.txt now</p></body>') ELSE replace(html, '<nav>', '<nav>/llms.txt') END AS html FROM pages),
i AS (SELECT id, CASE WHEN regexp_matches(html, '(?i)<body[\s>]') THEN regexp_replace(regexp_replace(html, '(?is)^.*?<body(\s[^>]*)?>', ''), '(?is)</body\s*>.*$', '') ELSE html END AS h FROM b),
s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g') AS h FROM i),
f AS (SELECT id, h, regexp_extract(h, '(?is)<a\s[^>]*href="[^"]*/llms\.txt([?#][^"]*)?"[^>]*>.*?</a>', 0) AS link FROM s)"""


@query("html_directive_position", f"""WITH {POINTED} SELECT id, (instr(h, CASE WHEN link <> '' THEN link ELSE '/llms.txt' END) - 1)::BIGINT AS position, CASE WHEN link <> '' THEN substr(link, 1, 200) ELSE '/llms.txt' END AS text FROM f WHERE contains(h, '/llms.txt')""")
def html_directive_position(spark, d):
    """Pages with a link to the index behind their navigation, a mention at the end, or one in the navigation, which does not count."""
    html = _by_form(
        c("page_id"), c("html"), F.replace("html", F.lit("</nav>"), F.lit('</nav><a class="x" href="/docs/llms.txt">index</a>')), F.replace("html", F.lit("</body>"), F.lit("<p>read /llms.txt now</p></body>")),
        F.replace("html", F.lit("<nav>"), F.lit("<nav>/llms.txt")))
    rows = table(spark, d, "pages").select(c("page_id").alias("id"), T.directive(html).alias("d")).filter("d is not null")
    return rows.select("id", c("d.position").cast("long").alias("position"), "d.text")


#: words by their first letters: how they are linked, and URL, class and fetched URL of that; null where code hides the link
LINKED = [
    ("A-C", "[$1]($1.md)", "w || '.md'", "path-relative", "'https://a.io/d/' || w || '.md'"), ("D-F", "![$1](/$1.png)", "'/' || w || '.png'", "root-relative", "'https://a.io/' || w || '.png'"),
    ("G-I", "[$1](https://o.io/$1.md#s)", "'https://o.io/' || w || '.md#s'", "absolute", "'https://o.io/' || w || '.md'"), ("J-L", "[$1](#$1)", "'#' || w", "fragment", "NULL"), ("M-O", "[$1](mailto:$1@b.c)", "'mailto:' || w || '@b.c'", "other-scheme", "NULL"),
    ("P-R", "[$1](//cdn.io/$1)", "'//cdn.io/' || w", "protocol-relative", "'https://cdn.io/' || w"), ("S-V", "[$1](a?b=$1&amp;c=2)", "'a?b=' || w || '&c=2'", "path-relative", "'https://a.io/d/a?b=' || w || '&c=2'"), ("W-Z", "`[$1](span.md)`", "NULL", "NULL", "NULL"),
]
_case = lambda k: "CASE " + " ".join(f"WHEN w BETWEEN '{x[0][0]}' AND '{x[0][2]}~' THEN " + (f"'{x[k]}'" if k == 3 else x[k]) for x in LINKED) + " END"


@query("links", f"""WITH w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, ' ([A-Z][a-z]+)', 1)) AS w FROM documents)
SELECT id, {_case(2)} AS url, {_case(3)} AS class, {_case(4)} AS "fetch", w BETWEEN 'G' AND 'I~' OR w BETWEEN 'P' AND 'R~' AS cross_origin, w < 'D' OR w BETWEEN 'G' AND 'I~' AS markdown, w BETWEEN 'D' AND 'F~' AS image FROM w WHERE w < 'W'""")
def links(spark, d):
    """Words that begin with a capital as links of every class."""
    body = c("text")
    for letters, link, *_ in LINKED:
        body = F.regexp_replace(body, f" ([{letters}][a-z]+)", f" {link}")
    rows = _documents(spark, d).select(c("doc_id").alias("id"), F.explode(udf.links(body, F.lit("https://a.io/d/page.md"))).alias("l"))
    return rows.select("id", "l.url", "l.class", "l.fetch", "l.cross_origin", "l.markdown", "l.image")
