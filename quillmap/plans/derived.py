"""Markdown that is derived from the driver's documents, so that its parsers meet whole texts and SQL can tell the result.

Lines that begin with A to E become fence marks; words that begin with an ASCII capital behind a blank become links.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import udf
from quillmap.plans.catalogue import query, spread, table

MARKS = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-E]')))"


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query("fences_of_documents", f"SELECT doc_id, (({MARKS} + 1) // 2)::BIGINT AS fences, CASE WHEN {MARKS} % 2 = 1 THEN 'fail' ELSE 'pass' END AS status FROM documents")
def fences_of_documents(spark, d):
    body = F.regexp_replace("text", r"(?m)^[A-E][^\n]*$", "```")
    return _documents(spark, d).select("doc_id", udf.fences(body).alias("f")).select("doc_id", F.col("f.count").cast("long").alias("fences"), "f.status")


WORDS = r"regexp_extract_all(text, ' ([A-Z][a-z]+)', 1)"


@query("links_of_documents", f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), f AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id) AS k FROM w)
SELECT doc_id, count(*) AS links, count(DISTINCT w) AS targets, md5(string_agg('https://docs.example.org/' || w || '.md' , chr(10) ORDER BY w)) AS urls FROM f GROUP BY doc_id""")
def links_of_documents(spark, d):
    body = F.regexp_replace("text", " ([A-Z][a-z]+)", " [$1](/$1.md)")
    found = _documents(spark, d).select("doc_id", F.explode(udf.all_links(body)).alias("l")).filter("not l.image").select("doc_id", "l.url")
    urls = F.array_join(F.transform(F.sort_array(F.collect_list("url")), lambda u: F.concat(F.lit("https://docs.example.org"), u)), "\n")
    return found.groupBy("doc_id").agg(F.count("*").alias("links"), F.count_distinct("url").alias("targets"), F.md5(urls).alias("urls"))


@query("link_classes_of_documents", f"""WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM documents)
SELECT doc_id, CASE WHEN w < 'M' THEN 'root-relative' ELSE 'absolute' END AS class, count(*) AS links, count(*) FILTER (w >= 'M') AS cross_origin, min(CASE WHEN w < 'M' THEN 'https://docs.example.org/' || w || '.md' ELSE 'https://other.example.com/' || w END) AS first_fetch FROM w GROUP BY ALL""")
def link_classes_of_documents(spark, d):
    body = F.regexp_replace(F.regexp_replace("text", " ([A-L][a-z]+)", " [$1](/$1.md#part)"), " ([M-Z][a-z]+)", ' [$1](https://other.example.com/$1 "a title")')
    found = _documents(spark, d).select("doc_id", F.explode(udf.links(body, F.lit("https://docs.example.org/guide/page.md"))).alias("l"))
    return found.groupBy("doc_id", F.col("l.class").alias("class")).agg(F.count("*").alias("links"), F.count_if(F.col("l.cross_origin")).alias("cross_origin"), F.min("l.fetch").alias("first_fetch"))


@query("content_start_of_documents", "SELECT doc_id, (3 * length('a{x: y;}' || chr(10)))::BIGINT AS start FROM documents WHERE regexp_matches(split_part(text, chr(10), 1), '^[A-Za-z ,]{80,}[A-Za-z]$')")
def content_start_of_documents(spark, d):
    """Documents that begin with a long line of plain words, behind three lines of style rules."""
    rows = _documents(spark, d).filter(F.split_part("text", F.lit("\n"), F.lit(1)).rlike("^[A-Za-z ,]{80,}[A-Za-z]$"))
    return rows.select("doc_id", udf.content_start(F.concat(F.lit("a{x: y;}\n" * 3), F.col("text"))).cast("long").alias("start"))
