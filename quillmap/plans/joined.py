"""Queries over links of converted pages, passages in texts, overlapping spans, prefixes of paths, and one long run."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import udf
from quillmap.functions import url as U
from quillmap.operators import dom_table as D
from quillmap.operators import joins as J
from quillmap.operators import ledger as L
from quillmap.operators.prefix_scan import prefix_scan
from quillmap.plans.catalogue import query, spread, table
from quillmap.session import cut

REFERENCES = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("page_markdown_links", rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"[^>]*>', 1)) AS url FROM pages WHERE contains(html, '<a '))
SELECT page_id, count(*) AS links, md5(string_agg({REFERENCES.format('url')}, chr(10) ORDER BY {REFERENCES.format('url')})) AS urls FROM a GROUP BY page_id""")
def page_markdown_links(spark, d):
    pages = spread(table(spark, d, "pages").select("page_id", "url", "html"))
    links = pages.select("page_id", F.explode(udf.all_links(udf.page_markdown(F.col("html")))).alias("l")).filter("not l.image")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.md5(F.array_join(F.sort_array(F.collect_list("l.url")), "\n")).alias("urls"))


@query("passages_in_documents", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passages_in_documents(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    patterns = table(spark, d, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"))
    return J.containing(texts, patterns).select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("item_id"))


LINES = """l AS (SELECT doc_id, i, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(x) - 1 AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, start::BIGINT AS start, (start + length(x))::BIGINT AS stop FROM l WHERE length(x) > 0 AND x IN (SELECT x FROM l GROUP BY x HAVING count(*) > 1))"""


def _lines(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("xs"))
    # where a line starts: the lengths of those before it, one running sum inside the row
    upto = F.aggregate("xs", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    starts = rows.select("doc_id", F.posexplode(F.zip_with("xs", F.slice(upto, F.lit(1), F.size("xs")), lambda x, s: F.struct(x.alias("x"), s.alias("start")))).alias("i", "l"))
    return starts.select("doc_id", "l.x", "l.start", (F.col("l.start") + F.length("l.x")).alias("end"))


@query("repeated_lines_with_numbers", f"""WITH {LINES}
SELECT s.doc_id, count(*) AS pairs, min(s.start) AS first_start, sum(s.stop - s.start)::BIGINT AS chars FROM s JOIN (SELECT doc_id, start::BIGINT AS start, (start + greatest(length(x), 1) + 30)::BIGINT AS stop FROM l WHERE regexp_matches(x, '[0-9]{{3}}')) m
ON s.doc_id = m.doc_id AND s.start < m.stop AND m.start < s.stop GROUP BY s.doc_id""")
def repeated_lines_with_numbers(spark, d):
    lines = _lines(spark, d)
    repeated = lines.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
    spans = lines.filter(F.length("x") > 0).join(repeated, "x", "left_semi").select("doc_id", "start", "end")
    # a line with a number, and 30 characters behind it
    numbers = lines.filter(F.col("x").rlike("[0-9]{3}")).select("doc_id", "start", (F.col("start") + F.greatest(F.length("x"), F.lit(1)) + 30).alias("end"))
    pairs = J.overlapping(spans, numbers, ["doc_id"])
    return pairs.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.min("a_start").alias("first_start"), F.sum(F.col("a_end") - F.col("a_start")).alias("chars"))


@query("page_longest_prefix", r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages),
x AS (SELECT DISTINCT host, regexp_replace(path, '/[^/]*$', '') AS prefix FROM p)
SELECT p.host, p.path, arg_max(x.prefix, length(x.prefix)) AS prefix FROM p JOIN x ON p.host = x.host AND (p.path = x.prefix OR starts_with(p.path, x.prefix || '/')) GROUP BY p.host, p.path""")
def page_longest_prefix(spark, d):
    pages = table(spark, d, "pages").select(U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    folders = pages.select("host", F.regexp_replace("path", "/[^/]*$", "").alias("prefix"))
    return J.below(pages, folders, ["host"])


EVENTS = "e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n, event_type = 'error' AS failed, event_id % 7 AS check_id, value, sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM events)"


@query("ledger_one_run", f"""WITH {EVENTS} SELECT max(n) AS n, max(n // 3) AS third, count(*) FILTER (failed AND rn <= n // 3) AS early_events, count(*) FILTER (failed AND rn > n - n // 3) AS late_events,
count(DISTINCT check_id) FILTER (failed AND rn > n - n // 3) AS late_checks, min(rn) FILTER (failed AND rn > n // 3) AS onset FROM e""")
def ledger_one_run(spark, d):
    """All events as one run: trend and onset by the prefix scan, without a task that holds the run."""
    e = table(spark, d, "events")
    rows = e.select(
        F.lit("all").alias("run_id"), "ts", "event_id", F.when(F.col("event_type") == "error", "fetch-error").otherwise("ok").alias("outcome"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("challenge"), F.lit(None).cast("string").alias("retry_after"), (F.col("event_id") % 7).cast("string").alias("check_id"))
    placed = L.scanned(L.flags(rows), ["ts", "event_id"])
    out = L.trend(placed, "failed", True).join(L.first_onset(placed), "run_id")
    return out.select("n", F.col("third").cast("long").alias("third"), "early_events", "late_events", "late_checks", "onset")


@query("events_within_budget", f"WITH {EVENTS} SELECT count(*) AS taken, floor(sum(value))::BIGINT AS total FROM e WHERE coalesce(used, 0) < (SELECT 0.3 * sum(value) FROM events)")
def events_within_budget(spark, d):
    """How many events of one run fit a budget of 30 % of their total, in order."""
    e = table(spark, d, "events").select("ts", "event_id", "value")
    rows = prefix_scan(e, [], ["ts", "event_id"], {"used": ("sum", "value")}, inclusive=False, totals=True)
    taken = rows.filter(F.coalesce("used", F.lit(0.0)) < 0.3 * F.col("used_all"))
    return taken.agg(F.count("*").alias("taken"), F.floor(F.sum("value")).cast("long").alias("total"))


def _nodes(spark, d):
    """Elements of the pages, parsed once: the joins read them several times."""
    return cut(D.elements(spread(table(spark, d, "pages").select("page_id", "html")), ["page_id"], fields=("pre", "last", "tag")))


BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<!--.*?-->', '', 'g')"


@query("dom_anchors_in_nav", rf"""WITH b AS (SELECT page_id, {BARE} AS h FROM pages), n AS (SELECT page_id, h, unnest(regexp_extract_all(h, '(?is)<nav\b.*?</nav>')) AS nav FROM b)
SELECT page_id, sum(len(regexp_extract_all(nav, '(?i)<a\s')))::BIGINT AS anchors, sum(len(regexp_extract_all(nav, '(?i)<li\b')))::BIGINT AS items FROM n GROUP BY page_id HAVING anchors + items > 0""")
def dom_anchors_in_nav(spark, d):
    """Links and list items below navigation, by a structural join."""
    tag = F.col("tag")
    pairs = D.below(_nodes(spark, d), tag.isin("a", "li"), tag == "nav", ["page_id"])
    once = D.nearest(pairs, ["page_id"])
    return once.groupBy("page_id").agg(F.count_if(F.col("inner_tag") == "a").alias("anchors"), F.count_if(F.col("inner_tag") == "li").alias("items"))


@query("dom_headings", rf"""WITH b AS (SELECT page_id, {BARE} AS h FROM pages) SELECT page_id, len(regexp_extract_all(h, '(?i)<h[1-6]\b'))::BIGINT AS headings,
len(regexp_extract_all(regexp_replace(h, '(?is)<(nav|header|footer|aside)\b.*?</(nav|header|footer|aside)>', '', 'g'), '(?i)<a\s'))::BIGINT AS anchors_outside FROM b""")
def dom_headings(spark, d):
    """Headings of each page, and its links outside chrome."""
    nodes, tag = _nodes(spark, d), F.col("tag")
    headings = nodes.groupBy("page_id").agg(F.count_if(tag.isin(*D.HEADINGS)).alias("headings"))
    free = D.outside(nodes, tag == "a", tag.isin("nav", "header", "footer", "aside"), ["page_id"]).groupBy("page_id").agg(F.count("*").alias("anchors_outside"))
    return headings.join(free, "page_id", "left").select("page_id", "headings", F.coalesce("anchors_outside", F.lit(0)).alias("anchors_outside"))
