"""Named queries of the audit engine and the SQL they are compared with.

Each entry of QUERIES is a function of (spark, sf_dir); each of ORACLES the equivalent SQL over the driver's tables or
over the literal tables of `fixtures`. Parsers of HTML and Markdown have no SQL and are tested on fixtures instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.dims import CHECKS, dim_values
from quillmap.functions import text as T
from quillmap.functions import url as U
from quillmap.operators import aggregates as A
from quillmap.operators import ledger as L
from quillmap.operators import page_ops as P
from quillmap.plans import dag, diagnostics, fixtures, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from quillmap.plans import audited, derived, given, joined, parsed, scored  # noqa: F401  register the queries of parsers, of joins and of audits

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores where the scan has fewer splits than there are (small files); larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def literal(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql} AS f")


# ------------------------------------------------------------------------------------------------ URLs
PARTS = r"""
u AS (SELECT *, lower(regexp_extract(url, '(?i)^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)) AS host,
      nullif(regexp_extract(url, '(?i)^https?://[^/?#:]+:([0-9]+)', 1), '') AS rawport,
      coalesce(nullif(regexp_extract(url, '(?i)^https?://[^/?#:]+(:[0-9]*)?([^?#]*)', 2), ''), '/') AS path,
      regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS fragment FROM pages),
p AS (SELECT *, CASE WHEN rawport = CASE scheme WHEN 'https' THEN '443' ELSE '80' END THEN NULL ELSE rawport END AS port FROM u),
o AS (SELECT *, scheme || '://' || host || coalesce(':' || port, '') AS origin,
      list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p)
"""


@query("url_parts", f"WITH {PARTS} SELECT page_id, scheme, host, regexp_replace(host, '^www\\.', '') AS canonical_host, port, path, query, fragment, origin FROM o")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.canonical_host(u).alias("canonical_host"), U.port(u).alias("port"),
        U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"), U.origin(u).alias("origin"))


@query("url_canonical_host", f"WITH {PARTS} SELECT regexp_replace(host, '^www\\.', '') AS host, count(*) AS pages FROM o GROUP BY 1")
def url_canonical_host(spark, d):
    return table(spark, d, "pages").groupBy(U.canonical_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


COVERAGE_PATH = "lower(CASE WHEN length(q) > 1 THEN regexp_replace(q, '/$', '') ELSE q END)"
NORMAL = f"n AS (SELECT *, {COVERAGE_PATH} AS norm FROM (SELECT *, regexp_replace(regexp_replace(path, '(?i)/index\\.(md|mdx|html?)$', '/'), '(?i)\\.(md|mdx|html?)$', '') AS q FROM o) AS x)"


@query("url_path_normalise", f"WITH {PARTS}, {NORMAL} SELECT page_id, norm FROM n")
def url_path_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", U.coverage_path(F.col("url")).alias("norm"))


@query("url_page_key", rf"""WITH {PARTS}, k AS (SELECT *, regexp_replace(path, '(?i)\.(md|mdx)$', '') AS q FROM o)
SELECT page_id, origin || CASE WHEN length(q) > 1 THEN regexp_replace(q, '/$', '') WHEN q = '' THEN '/' ELSE q END || query AS page_key FROM k""")
def url_page_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.page_key(F.col("url")).alias("page_key"))


@query("url_html_form", rf"""WITH {PARTS}, m AS (SELECT page_id, origin || regexp_replace(path, '(\.html?)?/?$', '') || '.md' AS url, origin, regexp_replace(path, '(\.html?)?/?$', '') AS bare FROM o)
SELECT page_id, origin || CASE WHEN bare = '' THEN '/' ELSE '' END || CASE WHEN bare = '' THEN '' ELSE bare END AS clean, origin || bare || '.html' AS html FROM m WHERE bare <> ''""")
def url_html_form(spark, d):
    u = F.col("url")
    bare = F.regexp_replace(U.path(u), r"(\.html?)?/?$", "")
    md = table(spark, d, "pages").select("page_id", F.concat(U.origin(u), bare, F.lit(".md")).alias("url"), bare.alias("bare")).filter("bare <> ''")
    return md.select("page_id", U.html_form(F.col("url")).alias("clean"), U.html_form(F.col("url"), "html").alias("html"))


@query("url_md_candidates", rf"""WITH {PARTS}, c AS (SELECT *, regexp_replace(path, '/$', '') AS q, regexp_extract(path, '([^/]*)$', 1) AS last FROM o),
l AS (SELECT page_id, CASE WHEN regexp_matches(path, '\.mdx?$') THEN [url]
  WHEN regexp_matches(last, '(?i)\.[a-z0-9]*[a-z][a-z0-9]*$') AND NOT regexp_matches(last, '(?i)\.html?$') AND NOT regexp_matches(last, '\.mdx?$') THEN []::VARCHAR[]
  ELSE [origin || regexp_replace(q, '\.html?$', '') || '.md' || query || fragment, origin || q || '/index.md' || query || fragment] END AS cs FROM c)
SELECT page_id, i - 1 AS position, cs[i] AS candidate FROM l, unnest(range(1, len(cs) + 1)) AS r(i)""")
def url_md_candidates(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(U.markdown_candidates(F.col("url"))).alias("position", "candidate")).withColumn("position", F.col("position").cast("long"))


@query("url_page_like", rf"""WITH {PARTS}, c AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS last FROM o)
SELECT page_id, regexp_matches(last, '(?i)\.[a-z0-9]*[a-z][a-z0-9]*$') AND NOT regexp_matches(last, '(?i)\.html?$') AND NOT regexp_matches(last, '\.mdx?$') AS non_page,
regexp_matches(path, '(?i)\.mdx?$') AS markdown FROM c""")
def url_page_like(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_non_page(F.col("url")).alias("non_page"), U.is_markdown(F.col("url")).alias("markdown"))


@query("url_prefix_scope", f"WITH {PARTS} SELECT page_id FROM o WHERE path = '/en' OR starts_with(path, '/en/')")
def url_prefix_scope(spark, d):
    return table(spark, d, "pages").filter(U.in_scope(F.col("url"), "/en/")).select("page_id")


@query("url_narrow_prefix", f"WITH {PARTS} SELECT count(*) AS examined, count(*) FILTER (path = '/xx' OR starts_with(path, '/xx/')) AS matched, count(*) FILTER (path = '/xx' OR starts_with(path, '/xx/')) < 0.01 * count(*) AS narrow FROM o")
def url_narrow_prefix(spark, d):
    return P.narrow_prefix(table(spark, d, "pages"), "/xx")


@query("url_excluded_paths", rf"""WITH {PARTS}, {NORMAL} SELECT page_id, regexp_matches(norm, '^/({"|".join(U.NON_DOC)})(/|$)')
OR (starts_with(norm, '/en') AND regexp_matches(substr(norm, 4), '^/({"|".join(U.NON_DOC)})(/|$)')) AS excluded,
regexp_matches(norm, '(?i)^/[^/]*/.*$') AS globbed FROM n""")
def url_excluded_paths(spark, d):
    n = U.coverage_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.is_excluded_path(n, "/en").alias("excluded"), U.matches_globs(n, ["/*/**"]).alias("globbed"))


CODES = ", ".join(f"'{c}'" for c in U.LANGUAGES.split())
LOCALE = f"lower(list_filter(segs[1:3], lambda s: lower(s) IN ({CODES}) OR regexp_matches(lower(s), '^({'|'.join(U.LANGUAGES.split())})-([a-z0-9]{{2}}|{'|'.join(U.SCRIPTS.split())})$'))[1])"


@query("url_locale", f"WITH {PARTS} SELECT page_id, {LOCALE} AS locale FROM o")
def url_locale(spark, d):
    return table(spark, d, "pages").select("page_id", U.locale(F.col("url")).alias("locale"))


@query("url_locale_counts", f"WITH {PARTS} SELECT i - 1 AS position, lower(segs[i]) AS segment, count(*) AS n FROM o, unnest(range(1, len(segs) + 1)) AS r(i) WHERE lower(segs[i]) IN ({CODES}) GROUP BY ALL")
def url_locale_counts(spark, d):
    return P.locale_counts(table(spark, d, "pages")).withColumn("position", F.col("position").cast("long"))


@query("url_locale_position", f"""WITH {PARTS}, c AS (SELECT i - 1 AS position, lower(segs[i]) AS s, count(*) AS n FROM o, unnest(range(1, len(segs) + 1)) AS r(i) WHERE lower(segs[i]) IN ({CODES}) GROUP BY ALL)
SELECT position, count(*) AS codes, sum(n)::BIGINT AS urls FROM c GROUP BY position HAVING count(*) >= 2 AND 2 * sum(n) > (SELECT count(*) FROM pages) ORDER BY position LIMIT 1""")
def url_locale_position(spark, d):
    return P.locale_position(table(spark, d, "pages")).withColumn("position", F.col("position").cast("long"))


@query("url_dominant_locale", f"WITH {PARTS}, c AS (SELECT lower(segs[1]) AS segment, count(*) AS n FROM o GROUP BY 1) SELECT segment, n, (SELECT count(*) FROM pages) AS total FROM c WHERE 2 * n > (SELECT count(*) FROM pages) AND segment IS NOT NULL")
def url_dominant_locale(spark, d):
    return P.dominant_segment(table(spark, d, "pages"))


@query("url_locale_filter", f"WITH {PARTS} SELECT page_id FROM o WHERE {LOCALE} = 'fr'")
def url_locale_filter(spark, d):
    return P.locale_filter(table(spark, d, "pages"), "fr").select("page_id")


@query("url_version_best", "SELECT * FROM (VALUES ('https://d.io/v2.10/install', 0::BIGINT), ('https://d.io/latest/api', 3), ('https://d.io/guide', 6), ('https://d.io/dev/only', 7), ('https://d.io/api/v3', 8), ('https://d.io/42/page', 9)) AS v(url, ordinal)")
def url_version_best(spark, d):
    return P.version_dedupe(literal(spark, fixtures.VERSIONS)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("url_paging_window", r"""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)[?&]page=') THEN coalesce(try_cast(regexp_extract(url, '(?i)[?&]page=([^&#]*)', 1) AS DOUBLE) >= 2, false)
WHEN regexp_matches(url, '(?i)[?&]offset=') THEN coalesce(try_cast(regexp_extract(url, '(?i)[?&]offset=([^&#]*)', 1) AS DOUBLE) > 0, false)
WHEN regexp_matches(url, '(?i)[?&](cursor|page_token|pageToken)=') THEN regexp_extract(url, '(?i)[?&](cursor|page_token|pageToken)=([^&#]*)', 2) <> ''
ELSE coalesce(try_cast(regexp_extract(url, '(?i)/page/([0-9]+)([/?#]|$)', 1) AS DOUBLE) >= 2, false) END AS later FROM pages""")
def url_paging_window(spark, d):
    return table(spark, d, "pages").select("page_id", U.points_later(F.col("url")).alias("later"))


# ------------------------------------------------------------------------------------------------ samples and sets
@query("sample_hash", "SELECT page_id FROM pages ORDER BY md5('1:' || url), url LIMIT 50")
def sample_hash(spark, d):
    return P.sample_hash(table(spark, d, "pages"), 50).select("page_id")


@query("sample_stride", """WITH d AS (SELECT DISTINCT url FROM pages), r AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS position, count(*) OVER () AS n FROM d)
SELECT url, position FROM r WHERE n <= 40 OR position IN (SELECT floor(i * n / 40.0)::BIGINT FROM range(40) AS t(i))""")
def sample_stride(spark, d):
    return P.sample_stride(table(spark, d, "pages"), 40)


@query("sample_backfill", """WITH RECURSIVE r AS (SELECT 'r' || (page_id % 4) AS run_id, page_id AS ordinal, url, page_id % 3 <> 0 AS present, row_number() OVER w AS rn,
count(*) FILTER (page_id % 3 <> 0) OVER w AS found, count(*) OVER (PARTITION BY page_id % 4) AS n FROM pages WINDOW w AS (PARTITION BY page_id % 4 ORDER BY page_id)),
s(run_id, pos, kept) AS (SELECT DISTINCT run_id, 0::BIGINT, 0::BIGINT FROM r UNION ALL
SELECT s.run_id, s.pos + 10 - s.kept, r.found FROM s JOIN r ON r.run_id = s.run_id AND r.rn = least(s.pos + 10 - s.kept, r.n) WHERE s.kept < 10 AND s.pos < least(r.n, 20))
SELECT r.run_id, r.ordinal, r.url FROM r JOIN (SELECT run_id, max(pos) AS pos FROM s GROUP BY run_id) AS e ON e.run_id = r.run_id WHERE present AND rn <= e.pos""")
def sample_backfill(spark, d):
    rows = table(spark, d, "pages").select(
        F.concat(F.lit("r"), (F.col("page_id") % 4).cast("string")).alias("run_id"), F.col("page_id").alias("ordinal"), "url", (F.col("page_id") % 3 != 0).alias("present"))
    return P.backfill(rows, 10)


@query("url_union_first_wins", r"""WITH a AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, 0 AS source, page_id AS ordinal FROM pages UNION ALL SELECT url, 1, page_id FROM pages)
SELECT url, source, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, ordinal) AS rn FROM a) WHERE rn = 1""")
def url_union_first_wins(spark, d):
    pages = table(spark, d, "pages").select("url", F.col("page_id").alias("ordinal"))
    return P.merge_first_wins(pages.withColumn("url", F.regexp_replace("url", "[?#].*$", "")), pages)


# ------------------------------------------------------------------------------------------------ coverage
SITES = rf"""{PARTS}, {NORMAL}, s AS (SELECT DISTINCT norm FROM n WHERE NOT regexp_matches(norm, '^/({"|".join(U.NON_DOC)})(/|$)')), x AS (SELECT DISTINCT CASE WHEN scheme = 'https' THEN norm ELSE regexp_replace(norm, '/[^/]*$', '/overview') END AS norm FROM n),
miss AS (SELECT norm FROM s WHERE norm NOT IN (SELECT norm FROM x))"""


def _coverage(spark, d):
    pages = table(spark, d, "pages")
    # the index has the secure pages themselves, and an overview in place of the others
    overview = F.concat(U.origin(F.col("url")), F.regexp_replace(U.coverage_path(F.col("url")), "/[^/]*$", "/overview"))
    index = pages.withColumn("url", F.when(U.scheme(F.col("url")) == "https", F.col("url")).otherwise(overview))
    return P.coverage(index, pages, ["/de/"])


@query("coverage_missing", f"WITH {SITES} SELECT norm AS path FROM miss WHERE NOT starts_with(norm, '/de/')")
def coverage_missing(spark, d):
    return _coverage(spark, d)["missing"]


@query("coverage_omitted_prefix", f"WITH {SITES} SELECT norm AS path FROM miss WHERE starts_with(norm, '/de/')")
def coverage_omitted(spark, d):
    return _coverage(spark, d)["omitted"]


@query("coverage_unmatched", f"WITH {SITES} SELECT norm AS path FROM x WHERE norm NOT IN (SELECT norm FROM s)")
def coverage_unmatched(spark, d):
    return _coverage(spark, d)["unmatched"]


@query("coverage_rate", f"""WITH {SITES}, c AS (SELECT count(*) AS pages, count(*) FILTER (norm IN (SELECT norm FROM x) OR starts_with(norm, '/de/')) AS covered FROM s)
SELECT pages, covered, floor(100.0 * covered / pages + 0.5)::BIGINT AS rate, CASE WHEN floor(100.0 * covered / pages + 0.5) >= 95 THEN 'pass' WHEN floor(100.0 * covered / pages + 0.5) >= 80 THEN 'warn' ELSE 'fail' END AS status FROM c""")
def coverage_rate(spark, d):
    return _coverage(spark, d)["rate"]


# ------------------------------------------------------------------------------------------------ page bodies
STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g')"


@query("html_strip_len", f"SELECT page_id, length({STRIPPED})::BIGINT AS chars, strlen({STRIPPED})::BIGINT AS bytes FROM pages")
def html_strip_len(spark, d):
    h = T.without_blocks(F.col("html"), "nav", "script", "style")
    return table(spark, d, "pages").select("page_id", F.length(h).cast("long").alias("chars"), F.octet_length(h).cast("long").alias("bytes"))


SIZED = f"s AS (SELECT regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, length({STRIPPED}) AS n FROM pages), b AS (SELECT *, CASE WHEN n < 1500 THEN 'pass' WHEN n <= 3000 THEN 'warn' ELSE 'fail' END AS st FROM s)"


def _sizes(spark, d):
    size = F.length(T.without_blocks(F.col("html"), "nav", "script", "style"))
    rows = table(spark, d, "pages").select(U.canonical_host(F.col("url")).alias("host"), size.alias("size"))
    return rows.withColumn("status", T.status_of(F.col("size"), (1500, 3000)))


@query("html_size_bucket", f"WITH {SIZED} SELECT host, count(*) FILTER (st = 'pass') AS pass_bucket, count(*) FILTER (st = 'warn') AS warn_bucket, count(*) FILTER (st = 'fail') AS fail_bucket, CASE max(CASE st WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM b GROUP BY host")
def html_size_bucket(spark, d):
    s = F.col("status")
    return _sizes(spark, d).groupBy("host").agg(*A.bucket_counts(s), A.worst(s).alias("verdict"))


@query("html_size_stats", f"WITH {SIZED} SELECT host, list_sort(list(n))[1 + floor(count(*) / 2)::INT]::BIGINT AS median, max(n)::BIGINT AS largest, floor(avg(n) + 0.5)::BIGINT AS mean FROM b GROUP BY host")
def html_size_stats(spark, d):
    rows = _sizes(spark, d)
    rest = rows.groupBy("host").agg(F.max("size").cast("long").alias("largest"), F.floor(F.avg("size") + 0.5).alias("mean"))
    return A.upper_median(rows, ["host"], "size").join(rest, "host").select("host", F.col("median").cast("long").alias("median"), "largest", "mean")


@query("html_transfer_bucket", r"SELECT page_id, strlen(html)::BIGINT AS bytes, CASE WHEN strlen(html) < 4000 THEN 'pass' WHEN strlen(html) <= 8000 THEN 'warn' ELSE 'fail' END AS status FROM pages")
def html_transfer_bucket(spark, d):
    n = F.octet_length("html")
    return table(spark, d, "pages").select("page_id", n.cast("long").alias("bytes"), T.status_of(n, (4000, 8000)).alias("status"))


@query("host_size_score", f"""WITH {SIZED}, c AS (SELECT host, count(*) FILTER (st = 'pass') AS p, count(*) FILTER (st = 'warn') AS w, count(*) AS n FROM b GROUP BY host)
SELECT host, n AS pages, floor(100.0 * (p + 0.5 * w) / n + 0.5)::BIGINT AS score, CASE WHEN floor(100.0 * (p + 0.5 * w) / n + 0.5) >= 100 THEN 'A+' WHEN floor(100.0 * (p + 0.5 * w) / n + 0.5) >= 90 THEN 'A'
WHEN floor(100.0 * (p + 0.5 * w) / n + 0.5) >= 80 THEN 'B' WHEN floor(100.0 * (p + 0.5 * w) / n + 0.5) >= 70 THEN 'C' WHEN floor(100.0 * (p + 0.5 * w) / n + 0.5) >= 60 THEN 'D' ELSE 'F' END AS grade FROM c""")
def host_size_score(spark, d):
    per = _sizes(spark, d).groupBy("host").agg(F.count("*").alias("pages"), *A.bucket_counts(F.col("status")))
    score = F.floor(100 * (F.col("pass_bucket") + 0.5 * F.col("warn_bucket")) / F.col("pages") + 0.5).cast("long")
    return per.select("host", "pages", score.alias("score")).withColumn("grade", scoring.grade(F.col("score")))


@query("html_nav_links", r"SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?is)<nav\b.*?</nav>', 0), '(?i)<a\s'))::BIGINT AS links FROM pages")
def html_nav_links(spark, d):
    nav = F.regexp_extract("html", r"(?is)<nav\b.*?</nav>", 0)
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all(nav, F.lit(r"(?i)<a\s"), F.lit(0))).cast("long").alias("links"))


# ------------------------------------------------------------------------------------------------ documents as Markdown bodies
@query("doc_size_status", "SELECT CASE WHEN length(text) < 2000 THEN 'pass' WHEN length(text) <= 6000 THEN 'warn' ELSE 'fail' END AS status, count(*) AS docs, max(length(text))::BIGINT AS largest FROM documents GROUP BY 1")
def doc_size_status(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy(T.status_of(n, (2000, 6000)).alias("status")).agg(F.count("*").alias("docs"), F.max(n).cast("long").alias("largest"))


def _norm(x: str) -> str:
    quote = lambda t: t.replace("'", "''")
    x = f"translate(translate({x}, '{T.INVISIBLE}', ''), '{T.QUOTES_DASHES}', '{quote(T.PLAIN)}')"
    x = f"replace(regexp_replace({x}, '-{{2,}}', '-', 'g'), '\u2026', '...')"
    x = f"regexp_replace(regexp_replace({x}, '<([^>\\n]+)>', '\\1', 'g'), '`', '', 'g')"
    x = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    return f"regexp_replace({x}, '^([-*+]|[0-9]+\\.)\\s+', '')"


def _segments(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 20 AND NOT regexp_matches(lower(x), '{T.NOISE}'))"
    return f"list_distinct(list_transform({lines}, lambda x: {_norm('x')}))"


@query("doc_normalise", f"SELECT doc_id, md5({_norm('text')}) AS normal FROM documents")
def doc_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal_segment(F.col("text"))).alias("normal"))


@query("doc_segments", f"SELECT doc_id, len({_segments('text')})::BIGINT AS segments FROM documents")
def doc_segments(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.size(T.segments(F.col("text"))).cast("long").alias("segments"))


@query("doc_parity_missing", f"""WITH p AS (SELECT a.doc_id, {_segments('a.text')} AS segs, {_norm('b.text')} AS md FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
c AS (SELECT doc_id, len(segs) AS n, len(list_filter(segs, lambda s: NOT contains(md, s))) AS missing FROM p)
SELECT doc_id, n::BIGINT AS segments, missing::BIGINT AS missing, CASE WHEN n < 10 THEN 'pass' WHEN floor(100.0 * missing / n + 0.5) >= 20 THEN 'fail' WHEN floor(100.0 * missing / n + 0.5) >= 5 THEN 'warn' ELSE 'pass' END AS status FROM c""")
def doc_parity_missing(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), T.normal_segment(F.col("text")).alias("md"))
    rows = docs.select("doc_id", T.segments(F.col("text")).alias("segs")).join(other, "doc_id")
    n, missing = F.size("segs"), F.size(F.filter("segs", lambda s: ~F.contains(F.col("md"), s)))
    out = rows.select("doc_id", n.cast("long").alias("segments"), missing.cast("long").alias("missing"))
    share = F.floor(F.try_divide(100 * F.col("missing"), F.col("segments")) + 0.5)
    return out.withColumn("status", F.when(F.col("segments") < 10, "pass").when(share >= 20, "fail").when(share >= 5, "warn").otherwise("pass"))


# ------------------------------------------------------------------------------------------------ responses
@query("redirect_class", rf"""SELECT id, CASE WHEN status < 300 OR status >= 400 OR location IS NULL THEN 'no-redirect'
WHEN regexp_replace(regexp_extract(url, '//([^/:]+)', 1), '^www\.', '') = regexp_replace(regexp_extract(location, '//([^/:]+)', 1), '^www\.', '')
 AND coalesce(nullif(regexp_extract(location, '//[^/:]+:([0-9]+)', 1), ''), '443') = '443' THEN 'same-host' ELSE 'cross-host' END AS class FROM {fixtures.REDIRECTS} AS f""")
def redirect_class(spark, d):
    c = F.col
    hop = c("status").between(300, 399) & c("location").isNotNull()
    return literal(spark, fixtures.REDIRECTS).select("id", F.when(~hop, "no-redirect").when(U.cross_host(c("url"), c("location")), "cross-host").otherwise("same-host").alias("class"))


@query("status_code_class", f"SELECT id, CASE WHEN status BETWEEN 400 AND 499 THEN 'correct-error' WHEN status = 202 OR status >= 500 THEN 'indeterminate' ELSE 'soft-404' END AS class FROM {fixtures.REDIRECTS} AS f")
def status_code_class(spark, d):
    s = F.col("status")
    return literal(spark, fixtures.REDIRECTS).select("id", F.when(s.between(400, 499), "correct-error").when((s == 202) | (s >= 500), "indeterminate").otherwise("soft-404").alias("class"))


# ------------------------------------------------------------------------------------------------ ledger
LEDGER = "e AS (SELECT (user_id % 10)::VARCHAR AS run_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id % 10) AS n, event_type = 'error' AS failed, (event_id % 7)::VARCHAR AS check_id, value FROM events)"


def _ledger(spark, d):
    e = table(spark, d, "events")
    outcome = F.when(F.col("event_type") == "error", "fetch-error").otherwise("ok")
    rows = e.select(
        (F.col("user_id") % 10).cast("string").alias("run_id"), F.struct("ts", "event_id").alias("seq"), outcome.alias("outcome"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("challenge"), F.lit(None).cast("string").alias("retry_after"), (F.col("event_id") % 7).cast("string").alias("check_id"), "value")
    return L.flags(rows)


@query("ledger_summary", f"WITH {LEDGER} SELECT run_id, count(*) AS requests, 0::BIGINT AS stalled_bodies, 0::BIGINT AS challenge_pages, count(*) FILTER (failed) AS fetch_errors, count(*) FILTER (failed) AS failed, floor(100.0 * count(*) FILTER (failed) / count(*) + 0.5)::BIGINT AS failure_rate FROM e GROUP BY run_id")
def ledger_summary(spark, d):
    return L.summary(_ledger(spark, d))


@query("ledger_trend", f"""WITH {LEDGER}, t AS (SELECT *, n // 3 AS third FROM e), a AS (SELECT run_id, max(n) AS n, max(third) AS third, count(*) FILTER (failed AND rn <= third) AS early_events,
count(*) FILTER (failed AND rn > n - third) AS late_events, count(DISTINCT check_id) FILTER (failed AND rn > n - third) AS late_checks FROM t GROUP BY run_id)
SELECT *, n >= 6 AND late_events >= 2 AND late_events / third >= 0.2 AND late_events / third >= 3 * (early_events / third) AND late_checks >= 2 AS correlated FROM a""")
def ledger_trend(spark, d):
    return L.trend(_ledger(spark, d), "failed", True)


@query("ledger_onset", f"""WITH {LEDGER}, o AS (SELECT run_id, min(rn) FILTER (failed AND rn > n // 3) AS onset FROM e GROUP BY run_id)
SELECT e.run_id, any_value(onset) AS onset, count(*) AS post_requests, count(*) FILTER (failed) AS post_failures FROM e JOIN o USING (run_id) WHERE rn >= onset GROUP BY e.run_id""")
def ledger_onset(spark, d):
    return L.onset(_ledger(spark, d)).withColumn("onset", F.col("onset").cast("long"))


@query("ledger_verdict", f"""WITH {LEDGER}, t AS (SELECT *, n // 3 AS third FROM e),
a AS (SELECT run_id, count(*) AS requests, count(*) FILTER (failed) AS failed, max(third) AS third, count(*) FILTER (failed AND rn <= third) AS early, count(*) FILTER (failed AND rn > n - third) AS late, min(rn) FILTER (failed AND rn > third) AS onset FROM t GROUP BY run_id),
b AS (SELECT a.run_id, count(*) AS post_requests, count(*) FILTER (e.failed) AS post_failures FROM e JOIN a USING (run_id) WHERE rn >= onset GROUP BY a.run_id),
c AS (SELECT a.*, post_requests, post_failures, requests >= 6 AND late >= 2 AND late / third >= 0.2 AND late / third >= 3 * (early / third) AS correlated FROM a LEFT JOIN b USING (run_id))
SELECT run_id, requests, 0::BIGINT AS stalled_bodies, 0::BIGINT AS challenge_pages, failed AS fetch_errors, failed, floor(100.0 * failed / requests + 0.5)::BIGINT AS failure_rate, 0::BIGINT AS interference_events, correlated, onset, post_requests, post_failures,
requests < 50 AS limited_evidence, CASE WHEN NOT correlated THEN 'pass' WHEN failed >= 5 AND 2 * failed >= requests OR coalesce(post_requests >= 10 AND post_failures >= 5 AND 2 * post_failures >= post_requests, false) THEN 'fail' ELSE 'warn' END AS status FROM c""")
def ledger_verdict(spark, d):
    return L.verdict(_ledger(spark, d).drop("failed", "interference", "denied", "rate_limited"))


@query("ledger_budget", f"WITH {LEDGER}, u AS (SELECT run_id, rn, coalesce(sum(1 + rn % 50) OVER (PARTITION BY run_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM e) SELECT run_id, rn, used FROM u WHERE used < 500 AND rn <= 20")
def ledger_budget(spark, d):
    rows = L.positioned(_ledger(spark, d)).withColumn("rn", F.col("rn").cast("long")).withColumn("bytes", 1 + F.col("rn") % 50)
    return P.budget(rows, ["run_id"], ["rn"], "bytes", 500, 20).select("run_id", "rn", F.col("used").cast("long").alias("used"))


@query("event_props_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("union_length", "SELECT * FROM (VALUES ('a', 12::BIGINT), ('b', 5)) AS v(k, covered)")
def union_length(spark, d):
    return A.union_length(literal(spark, "(SELECT * FROM (VALUES ('a',0,5),('a',3,8),('a',4,5),('a',10,14),('b',2,7)) AS v(k, start, end))"), ["k"]).withColumn("covered", F.col("covered").cast("long"))


# ------------------------------------------------------------------------------------------------ scores
SHARES = f"sh AS (SELECT run_id, check_id, count(*) AS items, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'warn') AS w, count(*) FILTER (status = 'fail') AS f FROM {fixtures.ITEMS} AS i GROUP BY ALL)"
SCORES = f"""d AS (SELECT * FROM {dim_values()} AS q), r AS (SELECT * FROM {fixtures.RESULTS} AS q), {SHARES}, rn AS (SELECT * FROM {fixtures.RUNS} AS q),
pr AS (SELECT r.*, d.category, d.ordinal, d.weight, d.warn_coefficient, d.page_level, d.coefficient_group, coalesce(CASE d.proportion_rule
  WHEN 'buckets' THEN CASE WHEN coalesce(pass_bucket,0) + coalesce(warn_bucket,0) + coalesce(fail_bucket,0) > 0 THEN (coalesce(pass_bucket,0) + coalesce(warn_bucket,0) * warn_coefficient) / (coalesce(pass_bucket,0) + coalesce(warn_bucket,0) + coalesce(fail_bucket,0)) END
  WHEN 'items' THEN CASE WHEN sh.items > 0 AND (p + w + f > 0 OR r.check_id <> 'http-status-codes') THEN CASE WHEN p + w + f > 0 THEN (p + w * warn_coefficient) / (p + w + f) ELSE 0 END END
  WHEN 'rate' THEN rate / 100
  WHEN 'sliding' THEN CASE WHEN r.status = 'warn' AND requests > 0 THEN warn_coefficient + (1 - warn_coefficient) * (1 - least(1.0::DOUBLE, (failed / requests) / 0.5::DOUBLE)) END END,
  CASE r.status WHEN 'pass' THEN 1 WHEN 'warn' THEN warn_coefficient ELSE 0 END)::DOUBLE AS proportion
  FROM r JOIN d USING (check_id) LEFT JOIN sh USING (run_id, check_id) WHERE r.status NOT IN ('skip', 'error')),
st AS (SELECT run_id, max(status) FILTER (check_id = 'content-negotiation') AS cn, max(status) FILTER (check_id = 'llms-txt-directive-html') AS dh, max(status) FILTER (check_id = 'llms-txt-directive-md') AS dm,
  max(status) FILTER (check_id = 'llms-txt-links-markdown') AS lm, max(status) FILTER (check_id = 'rendering-strategy') AS rs, max(status) FILTER (check_id = 'llms-txt-size') AS sz, max(max_chars) FILTER (check_id = 'llms-txt-size') AS chars,
  max(pass_bucket) FILTER (check_id = 'rendering-strategy') AS rp, max(warn_bucket) FILTER (check_id = 'rendering-strategy') AS rw, max(fail_bucket) FILTER (check_id = 'rendering-strategy') AS rf FROM r GROUP BY run_id),
co AS (SELECT run_id, CASE WHEN cn = 'pass' THEN 1.0 WHEN dh = 'pass' OR dm = 'pass' THEN 0.8 WHEN lm = 'pass' THEN 0.5 ELSE 0.0 END::DOUBLE AS discovery,
  CASE WHEN rs IS NULL OR rs IN ('skip', 'error') OR coalesce(rp,0) + coalesce(rw,0) + coalesce(rf,0) = 0 THEN 1.0 ELSE (coalesce(rp,0) + 0.5 * coalesce(rw,0)) / (coalesce(rp,0) + coalesce(rw,0) + coalesce(rf,0)) END::DOUBLE AS html,
  CASE WHEN sz = 'warn' THEN 0.8 WHEN sz = 'fail' THEN CASE WHEN chars > 0 THEN least(1.0, 100000 / chars) ELSE 0.5 END ELSE 1.0 END::DOUBLE AS "index" FROM st),
sc AS (SELECT pr.run_id, check_id, category, weight, CASE coefficient_group WHEN 'discovery' THEN discovery WHEN 'html' THEN html WHEN 'index' THEN "index" ELSE 1.0 END::DOUBLE AS coefficient, proportion, warn_coefficient,
  NOT (sampling_strategy IN ('random', 'deterministic') AND tested_pages < 5 AND page_level) AS "numeric" FROM pr JOIN co USING (run_id) JOIN rn USING (run_id)),
cs AS (SELECT *, weight * coefficient AS effective_weight, proportion * (weight * coefficient) AS earned FROM sc)"""
GRADE = "CASE WHEN score IS NULL THEN NULL WHEN score >= 100 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade"


def _scores(spark):
    dim = scoring.dim_check(spark)
    results, items, runs = (literal(spark, x) for x in (fixtures.RESULTS, fixtures.ITEMS, fixtures.RUNS))
    return scoring.check_scores(results, items, runs, dim), results, items, runs


@query("score_proportion", f"WITH {SCORES} SELECT run_id, check_id, round(proportion, 9) AS proportion FROM pr")
def score_proportion(spark, d):
    rows = scoring.proportions(literal(spark, fixtures.RESULTS), literal(spark, fixtures.ITEMS), scoring.dim_check(spark))
    return rows.select("run_id", "check_id", F.round("proportion", 9).alias("proportion"))


@query("score_coefficient", f'WITH {SCORES} SELECT run_id, discovery, html, "index" FROM co')
def score_coefficient(spark, d):
    return scoring.coefficients(literal(spark, fixtures.RESULTS))


@query("score_checks", f'WITH {SCORES} SELECT run_id, check_id, round(effective_weight, 9) AS effective_weight, round(earned, 9) AS earned, "numeric" FROM cs')
def score_checks(spark, d):
    return _scores(spark)[0].select("run_id", "check_id", F.round("effective_weight", 9).alias("effective_weight"), F.round("earned", 9).alias("earned"), "numeric")


@query("score_category", f'WITH {SCORES}, c AS (SELECT run_id, category, CASE WHEN bool_or("numeric") THEN floor(coalesce(100 * sum(earned) FILTER ("numeric") / nullif(sum(effective_weight) FILTER ("numeric"), 0), 0) + 0.5)::BIGINT END AS score FROM cs GROUP BY ALL) SELECT *, {GRADE} FROM c')
def score_category(spark, d):
    return scoring.categories(_scores(spark)[0])


@query("score_totals", f'WITH {SCORES} SELECT run_id, category, round(sum(earned), 6) AS earned, round(sum(effective_weight), 6) AS maximum FROM cs WHERE "numeric" GROUP BY GROUPING SETS ((run_id), (run_id, category))')
def score_totals(spark, d):
    return scoring.totals(_scores(spark)[0]).select("run_id", "category", F.round("earned", 6).alias("earned"), F.round("maximum", 6).alias("maximum"))


@query("score_overall", f"""WITH {SCORES}, t AS (SELECT run_id, coalesce(100 * sum(earned) FILTER ("numeric") / nullif(sum(effective_weight) FILTER ("numeric"), 0), 0) AS raw FROM rn LEFT JOIN cs USING (run_id) GROUP BY run_id),
k AS (SELECT * FROM (VALUES ('a', 59, 'rendering-strategy'), ('b', 39, 'no-viable-path'), ('c', 1000, NULL), ('d', 1000, NULL)) AS v(run_id, cap, cause)),
z AS (SELECT run_id, CASE WHEN cap < raw THEN cap END AS cap, CASE WHEN cap < raw THEN cause END AS cap_cause, floor(least(raw, cap) + 0.5)::BIGINT AS score FROM t JOIN k USING (run_id)) SELECT *, {GRADE} FROM z""")
def score_overall(spark, d):
    scores, results, _, runs = _scores(spark)
    found = diagnostics.evaluate(results, runs, literal(spark, fixtures.SYMPTOMS))
    return scoring.overall(scores, runs, scoring.caps(scores, results, found)).drop("raw")


@query("score_tags", f"""WITH {SCORES}, m AS (SELECT run_id, tag, check_id, count(*) FILTER (status = 'pass') AS p, count(*) FILTER (status = 'warn') AS w, count(*) FILTER (status IN ('pass','warn','fail')) AS n
FROM {fixtures.ITEMS} AS i JOIN {fixtures.TAGS} AS t USING (run_id, url) GROUP BY ALL), e AS (SELECT m.run_id, tag, sum((p + w * warn_coefficient) / n * effective_weight) AS e, sum(effective_weight) AS mx FROM m JOIN cs USING (run_id, check_id) WHERE n > 0 GROUP BY ALL),
g AS (SELECT run_id, tag, (SELECT count(DISTINCT url) FROM {fixtures.TAGS} AS t2 WHERE t2.run_id = e.run_id AND t2.tag = e.tag) AS pages, floor(100 * e / mx + 0.5)::BIGINT AS score FROM e WHERE mx > 0) SELECT *, {GRADE} FROM g""")
def score_tags(spark, d):
    scores, _, items, _ = _scores(spark)
    return scoring.tag_scores(scores, items, literal(spark, fixtures.TAGS))


@query("score_diagnostics", """SELECT * FROM (VALUES ('a','markdown-undiscoverable','warning'), ('a','truncated-index','warning'), ('a','spa-shell-html-invalid','info'), ('a','page-size-no-markdown-escape','warning'),
('a','dynamic-content-rendered-statically','warning'), ('a','bot-protection-scan-reliability','warning'), ('a','cross-origin-llms-txt','warning'), ('b','spa-shell-html-invalid','info'), ('b','no-viable-path','critical'),
('b','auth-no-alternative','critical'), ('b','bot-protection-scan-reliability','warning'), ('b','single-page-sample','warning'), ('b','gzipped-sitemap-skipped','info'), ('b','rate-limiting-severe','warning')) AS v(run_id, diagnostic, severity)""")
def score_diagnostics(spark, d):
    return diagnostics.evaluate(literal(spark, fixtures.RESULTS), literal(spark, fixtures.RUNS), literal(spark, fixtures.SYMPTOMS)).select("run_id", "diagnostic", "severity")


@query("score_grade", f"WITH g AS (SELECT i::BIGINT AS score FROM range(0, 101) AS t(i)) SELECT *, {GRADE} FROM g")
def score_grade(spark, d):
    return spark.range(101).select(F.col("id").alias("score")).withColumn("grade", scoring.grade(F.col("score")))


DEPS = ", ".join(f"('{c}', {k}, '{x}')" for c, v in CHECKS.items() for k, g in enumerate(v[6]) for x in g)


# ------------------------------------------------------------------------------------------------ at scale
FACT = "f AS (SELECT l_orderkey % 1000 AS run_id, CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE 'pass' END AS status, l_quantity FROM lineitem)"


def _facts(spark, d):
    s = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").otherwise("pass")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("run_id"), s.alias("status"), "l_quantity")


@query("bucket_at_scale", f"WITH {FACT} SELECT run_id, count(*) FILTER (status = 'pass') AS pass_bucket, count(*) FILTER (status = 'warn') AS warn_bucket, count(*) FILTER (status = 'fail') AS fail_bucket FROM f GROUP BY run_id")
def bucket_at_scale(spark, d):
    return _facts(spark, d).groupBy("run_id").agg(*A.bucket_counts(F.col("status")))


@query("worst_status_at_scale", f"WITH {FACT}, w AS (SELECT run_id, CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM f GROUP BY run_id) SELECT verdict, count(*) AS runs FROM w GROUP BY verdict")
def worst_status_at_scale(spark, d):
    return _facts(spark, d).groupBy("run_id").agg(A.worst(F.col("status")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("runs"))


@query("weighted_score_at_scale", f"WITH {FACT} SELECT run_id, floor(100 * sum(l_quantity * CASE status WHEN 'pass' THEN 1 WHEN 'warn' THEN 0.5 ELSE 0 END) / sum(l_quantity) + 0.5)::BIGINT AS score FROM f GROUP BY run_id")
def weighted_score_at_scale(spark, d):
    part = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    return _facts(spark, d).groupBy("run_id").agg(F.floor(100 * F.sum(F.col("l_quantity") * part) / F.sum("l_quantity") + 0.5).cast("long").alias("score"))


@query("mode_at_scale", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS o FROM orders GROUP BY ALL)
SELECT o_orderpriority, arg_max(o_orderstatus, n) AS o_orderstatus, max(n) AS n FROM c GROUP BY o_orderpriority""")
def mode_at_scale(spark, d):
    return A.mode_first(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey")
