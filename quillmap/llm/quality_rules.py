"""Quality rules: repetition figures of a document, and cross-document line frequency.

Method. Lines are normalised (case folded, white space collapsed) and hashed; for each host the number of distinct
documents per line is counted, documents with equal texts being one, so that copies do not make a line frequent.
Lines in more than `max_share` of a host's documents (and in more than `min_documents`) are removed; a document that
keeps less than `min_left` of its word characters is depleted and rejected. Duplicate lines of one document are one
line for the count, and all of them go. `cleaned_text` is the text without them; the figures are those of the text as
it came.

Distribution. Texts are read twice: for the hashes of their lines, which are written as a table, and for their figures.
The distinct count runs in two levels, so that a line in a third of all documents is summed from partial
counts. Only rows of frequent lines reach the last aggregate, which is by document. All of it is built-in column
expressions; repeated windows are found by sorting the window hashes of the documents that have any.

Defined results: null and empty texts have no words and fail the base rules. A null host is a host of its own. Rows that
repeat id, host and text get the same verdict each, the one that a single such row gets. No rows give no rows. Only id, text and host are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, words, written

WINDOW = 8
HAS_WORD = r"[^\x20\x09-\x0D]"
MAX_SHARE, MIN_DOCUMENTS, MIN_LEFT = 0.1, 20, 0.1


def _covered(starts: Column) -> Column:
    """How many positions the windows at the (sorted) starts cover."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        starts, zero,
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_rules(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of the column `text`."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(HAS_WORD))
    df = df.withColumn("_words", words(raw)).withColumn("_lines", lines)
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.length(raw) - F.length(F.regexp_replace(raw, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashed"),
    )
    size = F.size("_hashed")
    windows = F.when(
        size >= WINDOW,
        F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get("_hashed", i + k) for k in range(WINDOW)])),
    )
    df = df.withColumn("_windows", windows)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("_sorted", k)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: (at(k).eqNullSafe(at(k - 1))) | (at(k).eqNullSafe(at(k + 1))))
    starts = F.sort_array(F.transform(again, lambda k: F.get("_sorted", k)["i"]))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_sorted").isNotNull(), _covered(starts)), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # a filter on the verdict must not be pushed below the steps above: it would repeat them inside one expression
    barrier = F.monotonically_increasing_id() >= 0
    return df.withColumn("base_failed", failed & barrier).drop("_words", "_hashed", "_windows", "_sorted")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_frequency(df: DataFrame, id_col: str, text_col: str, host_col: str, max_share: float, min_documents: int) -> DataFrame:
    """id, _text_hash, _host, _removed and _gone: the word characters of the document's lines that are over the limit, and
    the hashes of these lines.

    Only documents that lose a line have a row.
    """
    named = lambda c: F.col(f"`{c}`")
    raw = F.coalesce(named(text_col), F.lit(""))
    slim = df.select(named(id_col).alias("_id"), named(host_col).alias("_host"), F.xxhash64(raw).alias("_text_hash"), raw.alias("_text"))
    lines = F.filter(F.transform(F.split("_text", "\n"), _normal), lambda x: x != "")
    marks = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("_line_hash"), F.length(F.replace(x, F.lit(" "), F.lit(""))).cast("long").alias("_chars")))
    # hashes of lines are made once; what follows reads this table, not the texts
    lined = written(slim.select("_id", "_host", "_text_hash", marks.alias("_lines")), "lines")
    each = lined.select("_id", "_host", "_text_hash", F.posexplode("_lines").alias("_at", "_line")).select("_id", "_host", "_text_hash", "_at", "_line.*")
    hosts = lined.groupBy("_host").agg(F.count_distinct("_text_hash").alias("_documents"))
    counts = each.groupBy("_host", "_line_hash", "_text_hash").agg(F.lit(1)).groupBy("_host", "_line_hash").agg(F.count("*").alias("_in"))
    # a line over the limit is in more than max_share of its host's documents, so few are: hosts x words of a document
    frequent = (
        counts.filter(F.col("_in") > min_documents)
        .join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
        .filter(F.col("_in") > max_share * F.col("_documents"))
        .select(F.col("_h"), F.col("_line_hash").alias("_lh"))
    )
    hit = each.join(frequent, (F.col("_line_hash") == F.col("_lh")) & F.col("_host").eqNullSafe(F.col("_h")), "left_semi")
    # rows that repeat id, host and text have the same lines at the same places, and each place counts once
    places = hit.groupBy("_id", "_host", "_text_hash", "_at", "_line_hash", "_chars").agg(F.lit(1))
    return places.groupBy("_id", "_host", "_text_hash").agg(F.sum("_chars").alias("_removed"), F.collect_set("_line_hash").alias("_gone"))


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_share: float = MAX_SHARE, min_documents: int = MIN_DOCUMENTS, min_left: float = MIN_LEFT,
) -> DataFrame:
    """Every input row with the base figures, base_failed, removed_chars, depleted, kept and cleaned_text (the text without
    the lines over the limit).

    Input columns named like a result column are replaced.
    """
    named = lambda c: F.col(f"`{c}`")
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "depleted", "kept", "cleaned_text")
    carried = [c for c in df.columns if c.lower() not in made]
    removed = line_frequency(df, id_col, text_col, host_col, max_share, min_documents).select(
        F.col("_id").alias("_rid"), F.col("_host").alias("_rhost"), F.col("_text_hash").alias("_rhash"), "_removed", "_gone")
    base = base_rules(
        df.select(
            F.struct(*[named(c) for c in carried]).alias("_row"), named(id_col).alias("_id"), named(host_col).alias("_host"),
            named(text_col).alias("_text"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("_text_hash"),
        ),
        "_text",
    ).drop("_lines", *(["_text"] if text_col in carried else []))  # the row has it already
    text = F.col("_row").getField(text_col) if text_col in carried else F.col("_text")
    # both sides have one normal form of the key: null-safe parts as a struct would not sort-merge, so nulls get a flag
    joined = base.join(
        removed,
        (F.col("_text_hash") == F.col("_rhash")) & F.col("_id").eqNullSafe(F.col("_rid")) & F.col("_host").eqNullSafe(F.col("_rhost")),
        "left",
    )
    lost = F.least(F.coalesce("_removed", F.lit(0)), F.col("word_chars")).cast("long")
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(_normal(x))))
    return (
        joined.withColumn("cleaned_text", F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(stays, "\n")))
        .withColumn("removed_chars", lost)
        .withColumn("depleted", (F.col("word_chars") > 0) & (F.col("word_chars") - F.col("removed_chars") < min_left * F.col("word_chars")))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .select(*[F.col("_row").getField(c).alias(c) for c in carried], *made)
    )


def op5(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, text, source, i, array_to_string(ws[i:i + 7], ' ') AS g
        FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS u(i)),
rep AS (SELECT *, count(*) OVER (PARTITION BY doc_id, source, text, g) AS c FROM win),
cov AS (SELECT doc_id, source, text, sum(least(8, i - coalesce(p, -7)))::BIGINT AS n
        FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, source, text ORDER BY i) AS p FROM rep WHERE c > 1) GROUP BY ALL),
ln AS (SELECT doc_id, source, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS x
       FROM d, unnest(string_split(text, chr(10))) AS u(x)),
fr AS (SELECT source, x FROM ln WHERE x <> '' GROUP BY source, x
       HAVING count(DISTINCT text) > 20
          AND count(DISTINCT text) > 0.1 * (SELECT count(DISTINCT e.text) FROM d e WHERE e.source IS NOT DISTINCT FROM ln.source)),
rem AS (SELECT doc_id, source, text, sum(length(replace(x, ' ', ''))) AS r FROM ln
        WHERE EXISTS (SELECT 1 FROM fr WHERE fr.x = ln.x AND fr.source IS NOT DISTINCT FROM ln.source) GROUP BY ALL),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(r, 0) AS r
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id AND cov.text = w.text
             LEFT JOIN rem ON rem.doc_id = w.doc_id AND rem.text = w.text),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars > 0 AND word_chars - least(r, word_chars) < 0.1 * word_chars) AS kept
FROM f
"""
