"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line with a word. Each is hashed to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors, component by component modulo 2^32. So the order of paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (`add`, `subtract`), without the rest of the text.

The vector of a paragraph has two parts. The first 16 components are the 512 bits of two SHA-256 digests of the paragraph:
they decide equality. The other 256 are a count sketch of the paragraph's 3-word shingles (the first two have fewer
words): each adds 1 or -1 to the component that its MD5 names. Sums of sketches are sketches of the sums, so two
fingerprints tell how alike their texts are: `likeness` is 1 - |a - b|^2 / (|a|^2 + |b|^2) over these components, 0 at
least, an estimate of 2 a.b / (|a|^2 + |b|^2) over shingle counts with a standard error of about 1/16.

Distribution. `with_next` gives each row its neighbour in the order of ids with one shuffle of texts: rows are dealt to
blocks of that order by splitters (the first keys of sampled ranges, at most `blocks` of them), and the row that opens a
block is also sent to the block before it, so that a window within blocks needs nothing from outside. The edited
fingerprint is the old one less the paragraphs from the cut on, plus those that come in. All of it is built-in column
expressions; sketches are sorted arrays within a row, of a size bounded by the text.

Defined results: null texts count as empty; their fingerprint is zero, and like that of another empty text (1), unlike
any other (0). Equal fingerprints have likeness 1. Null ids come last, equal ids are ordered by a hash of their texts; rows that
repeat id and text are each other's neighbours. A single row is its own neighbour. No rows give no rows. Only id and text
are read.
"""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents

LANES, BUCKETS, MODULUS = 16, 256, 2**32
BLANKS = " \t\n\x0b\f\r"
KEY = "nothing boolean, turned long, hash long"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: F.btrim(p, F.lit(BLANKS)) != "")


def _lanes(paras: Column) -> Column:
    """Sums of the paragraphs' digests, as 16 numbers of 32 bits."""
    hexes = F.transform(paras, lambda p: F.concat(F.sha2(F.concat(F.lit("0"), p), 256), F.sha2(F.concat(F.lit("1"), p), 256)))
    number = lambda h, i: F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    numbers = lambda h: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: number(h, i))
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.aggregate(hexes, zero, lambda a, h: F.zip_with(a, numbers(h), lambda x, y: (x + y) % MODULUS))


def _ordered(paras: Column) -> Column:
    """The codes of the paragraphs' shingles, doubled and sorted, with an odd mark after the occurrences of each code."""
    split = F.transform(paras, lambda p: F.split(F.btrim(p, F.lit(BLANKS)), SPACE))
    shingle = lambda ws, w, i: F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1), w)
    # never null, so that the sort works on plain numbers
    code = lambda s: F.coalesce(F.conv(F.substring(F.md5(s), 1, 3), 16, 10).cast("int") % (2 * BUCKETS), F.lit(0)) * 2
    codes = F.flatten(F.transform(split, lambda ws: F.transform(ws, lambda w, i: code(shingle(ws, w, i)))))
    marks = F.sequence(F.lit(1), F.lit(4 * BUCKETS - 1), F.lit(2))
    return F.sort_array(F.concat(codes, marks))


def _places(ordered: Column) -> Column:
    """The marks' places: how many codes there are up to each, and marks."""
    return F.filter(F.transform(ordered, lambda x, i: F.when(x % 2 == 1, i).otherwise(-1)), lambda i: i >= 0)


def _buckets(places: Column) -> Column:
    """The count sketch, as 256 signed numbers."""
    upto = lambda c: F.coalesce(F.get(places, c), F.lit(-1))
    # an even code adds, the odd one after it subtracts; both differences count one mark, which cancels
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: 2 * upto(2 * b) - upto(2 * b - 1) - upto(2 * b + 1))


def with_vectors(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """df with a fingerprint as numbers, struct(lanes, buckets), per name and text.

    The steps are columns of their own, each of them computed once.
    """
    df = df.withColumns({f"{n}_paras": paragraphs(F.coalesce(t, F.lit(""))) for n, t in texts.items()})
    df = df.withColumns({f"{n}_lanes": _lanes(F.col(f"{n}_paras")) for n in texts} | {f"{n}_places": _places(_ordered(F.col(f"{n}_paras"))) for n in texts})
    made = {n: F.struct(F.col(f"{n}_lanes").alias("lanes"), _buckets(F.col(f"{n}_places")).alias("buckets")) for n in texts}
    return df.withColumns(made).drop(*[f"{n}_{step}" for n in texts for step in ("paras", "lanes", "places")])


def _wrapped(x: Column) -> Column:
    """x modulo 2^32, as an int."""
    return (F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("int")


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs."""
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + y) % MODULUS).alias("lanes"),
        F.zip_with(a["buckets"], b["buckets"], lambda x, y: _wrapped(x.cast("long") + y)).alias("buckets"),
    )


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, which a has."""
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: F.pmod(x - y, F.lit(MODULUS))).alias("lanes"),
        F.zip_with(a["buckets"], b["buckets"], lambda x, y: _wrapped(x.cast("long") - y)).alias("buckets"),
    )


def fingerprint(v: Column) -> Column:
    """The components as 8 lower-case hex digits each."""
    digits = lambda x: F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(MODULUS))), 8, "0")
    return F.lower(F.concat_ws("", F.concat(F.transform(v["lanes"], digits), F.transform(v["buckets"], digits))))


def _squares(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1."""
    gap = _squares(F.zip_with(a["buckets"], b["buckets"], lambda x, y: x.cast("long") - y))
    size = _squares(a["buckets"]) + _squares(b["buckets"])
    known = F.greatest(F.lit(0.0), 1 - F.try_divide(gap, size))
    return F.when((a["lanes"] == b["lanes"]) & (a["buckets"] == b["buckets"]), 1.0).otherwise(F.coalesce(known, F.lit(0.0)))


def with_next(df: DataFrame, id_col: str, text_col: str, values: list[str], blocks: int | None = None) -> DataFrame:
    """df with `next_<value>` of the row that follows in the order of descending ids; of the last one, of the first.

    Ids are whole numbers. blocks: how many the order is cut into; by default eight for each shuffle partition.
    """
    ids, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # ascending order of the key: ids first, turned round bit by bit
    key = F.struct(ids.isNull().alias("nothing"), F.coalesce(F.bitwise_not(ids), F.lit(0).cast("long")).alias("turned"), F.xxhash64(text).alias("hash"))
    blocks = blocks or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key.alias("_key")).repartitionByRange(blocks, "_key")
    firsts = sorted(tuple(r["_first"]) for r in keys.groupBy(F.spark_partition_id()).agg(F.min("_key").alias("_first")).collect())
    step = max(1, round(len(firsts) ** 0.5))
    constant = lambda rows: F.from_json(F.lit(json.dumps([dict(zip(("nothing", "turned", "hash"), r)) for r in rows])), f"array<struct<{KEY.replace(' ', ':')}>>".replace(",:", ","))
    upto = lambda some: F.size(F.filter(some, lambda s: s <= F.col("_key")))
    rows = df.withColumn("_key", key).withColumn("_coarse", (upto(constant(firsts[::step])) - 1) * step)
    rows = rows.withColumn("_block", F.col("_coarse") + upto(F.slice(constant(firsts), F.col("_coarse") + 1, F.lit(step))) - 1)
    opens = F.get(constant(firsts), F.col("_block")) == F.col("_key")
    place = lambda block, copy: F.struct(block.alias("block"), F.lit(copy).alias("copy"))
    own = place(F.col("_block"), False)
    places = F.when(opens, F.array(own, place(F.pmod(F.col("_block") - 1, F.lit(max(1, len(firsts)))), True))).otherwise(F.array(own))
    rows = rows.withColumn("_place", F.explode(places)).drop("_block", "_coarse")
    order = Window.partitionBy("_place.block").orderBy("_place.copy", "_key")
    rows = rows.withColumns({f"next_{v}": F.lead(v).over(order) for v in values})
    return rows.filter(~F.col("_place.copy")).drop("_place", "_key")


def edited_halves(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """id, n_chars, edited (the text whose last half is replaced by as much of the next document's beginning), and the
    vectors _own, _edited and _next of the text, the edited text and the next document."""
    slim = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    # the paragraph that the cut goes through changes, those before it stay
    kept = F.substring("_text", F.lit(1), n - half)
    cut = F.col("_cut")
    slim = slim.withColumn("_cut", n - half - F.length(F.substring_index(kept, "\n", -1)))
    # the text is what stays and what goes, so its vector is their sum, and each word is hashed once
    slim = with_vectors(slim, {"_head": F.substring("_text", F.lit(1), cut), "_out": F.substring("_text", cut + 1, n)})
    slim = slim.withColumn("_own", add(F.col("_head"), F.col("_out"))).drop("_head")
    rows = with_next(slim, "_id", "_text", ["_text", "_own"], blocks)
    came = F.substring("next__text", F.lit(1), half)
    rows = with_vectors(rows, {"_in": F.concat(F.substring("_text", cut + 1, n - half - cut), came)})
    rows = rows.withColumn("_edited", add(subtract(F.col("_own"), F.col("_out")), F.col("_in")))
    return rows.select(F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), F.concat(kept, came).alias("edited"), "_own", "_edited", F.col("next__own").alias("_next"))


def op11(spark, sf_dir: str) -> DataFrame:
    rows = edited_halves(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS MATERIALIZED (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), (SELECT arg_max(t, doc_id) FROM d)) AS nx,
                          coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), (SELECT max(doc_id) FROM d)) AS nid FROM d),
u AS MATERIALIZED (SELECT doc_id, 0 AS kind, t FROM o UNION ALL SELECT doc_id, 1, substr(t, 1, n - n // 2) || substr(nx, 1, n // 2) FROM o),
p AS MATERIALIZED (SELECT doc_id, kind, x FROM (SELECT doc_id, kind, unnest(string_split(t, chr(10))) AS x FROM u) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
h AS (SELECT doc_id, kind, i, sum(('0x' || substr(sha256('0' || x) || sha256('1' || x), 8 * i + 1, 8))::BIGINT) % 4294967296 AS v FROM p, range(16) r(i) GROUP BY ALL),
w AS (SELECT doc_id, kind, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws FROM p),
s AS (SELECT doc_id, kind, concat_ws(' ', CASE WHEN i > 2 THEN ws[i - 2] END, CASE WHEN i > 1 THEN ws[i - 1] END, ws[i]) AS g FROM w, unnest(range(1, len(ws) + 1)) r(i)),
c AS (SELECT doc_id, kind, ('0x' || substr(md5(g), 1, 3))::BIGINT % 512 AS c FROM s),
b AS (SELECT doc_id, kind, c // 2 AS b, sum(1 - 2 * (c % 2)) AS v FROM c GROUP BY ALL),
f AS MATERIALIZED (
  SELECT u.doc_id, kind, any_value(t) AS t, list(coalesce(v, 0)::DOUBLE ORDER BY k) AS v, string_agg(printf('%08x', ((coalesce(v, 0) + 4294967296) % 4294967296)::BIGINT), '' ORDER BY k) AS fp
  FROM u, range(272) r(k) LEFT JOIN (SELECT doc_id AS d, kind AS q, i AS j, v FROM h UNION ALL SELECT doc_id, kind, b + 16, v FROM b) ON d = u.doc_id AND q = kind AND j = k
  GROUP BY u.doc_id, kind),
n AS (SELECT a.doc_id, length(a.t) AS n_chars, sha256(e.t) AS edited_sha256, a.fp AS fingerprint, e.fp AS edited_fingerprint, x.fp AS next_fp, a.v[17:] AS va, e.v[17:] AS ve, x.v[17:] AS vx
      FROM f a JOIN f e ON e.doc_id = a.doc_id AND e.kind = 1 JOIN o ON o.doc_id = a.doc_id JOIN f x ON x.doc_id = o.nid AND x.kind = 0 WHERE a.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN dot(va, va) + dot(ve, ve) = 0 THEN 0.0::DOUBLE
            ELSE greatest(0.0::DOUBLE, 1 - (dot(va, va) - 2 * dot(va, ve) + dot(ve, ve)) / (dot(va, va) + dot(ve, ve))) END AS near_edited,
       CASE WHEN fingerprint = next_fp THEN 1.0::DOUBLE WHEN dot(va, va) + dot(vx, vx) = 0 THEN 0.0::DOUBLE
            ELSE greatest(0.0::DOUBLE, 1 - (dot(va, va) - 2 * dot(va, vx) + dot(vx, vx)) / (dot(va, va) + dot(vx, vx))) END AS near_next
FROM n
""".replace("dot(", "list_dot_product(")
