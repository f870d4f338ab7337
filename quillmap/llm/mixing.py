"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets. Sources, in code-point order with null last, get the weights in turn. They share `share` of all words by
weight; a source is clamped at `max_epochs` times its own words, and the excess is shared again by weight until no
source is above its clamp. The end of that process is one water level: with sources in the order of clamp / weight, the
level is what is left after the clamped ones, over the weights of the rest, at the first place where it clamps nobody
else.

Repetitions. Each document of a source is taken floor(target / size of source) times; the fraction that remains is
taken from the documents in the order of md5(seed:id), until its words are reached. The document at the end counts in
part, so that a source's words meet its target to the word.

Distribution. Words are summed by (source, first three digits of the md5), with map-side pre-aggregation, so that a
source with a third of all rows is 4,096 partial sums; the bucket in which a source's fraction ends is summed by its
next three digits once more. Only the rows of the one bucket of six digits in which it ends, a sixteen-millionth of the
source, are sorted. The rows meet one plan row per source by a broadcast of up to `BROADCAST_SOURCES` of them, else by a
join that Spark may split.

Defined results: null texts have no words and null ids hash as the word null. Null sources are one source. Documents
without words are taken 0 words. Rows that repeat an id are in the order of their size, then of a hash of their text. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, n_words

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, 11
BROADCAST_SOURCES = 100_000


def _key(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to rows of (source, source_size), one per source."""
    # one task each, over a row per source
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    everything = Window.partitionBy(F.lit(0))
    level = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        sources.withColumn("_weight", weight)
        .withColumn("_clamp", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("_ratio", F.col("_clamp") / F.col("_weight"))
        .withColumn("_left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_clamp").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
        .withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"])
    )
    return rows.select("source", "source_size", F.least("_clamp", F.coalesce("_water", F.lit(float("inf"))) * F.col("_weight")).alias("target"))


def _ends(buckets: DataFrame, sources: DataFrame, before) -> DataFrame:
    """Of rows (source, _bucket, _words): the bucket of each source in which its rest ends, and the words before it."""
    inside = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = buckets.withColumn("_upto", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    return (
        upto.withColumnRenamed("source", "_source")
        .join(sources, F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("_upto", F.col("_upto") + before)
        .filter((F.col("_upto") < F.col("_rest")) & (F.col("_upto") + F.col("_words") >= F.col("_rest")))
        .select("_source", F.col("_bucket").alias("_end"), F.col("_upto").alias("_before"), F.col("_rest").alias("_ending"))
    )


def mix_plan(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source of (source, size, _key): source_size, target, _whole repetitions, _rest words of the
    fraction, and the bucket of six digits in which that ends with the words before it."""
    digits = lambda n: F.substring("_key", 1, n).alias("_bucket")
    buckets = slim.groupBy("source", digits(3)).agg(F.sum("size").alias("_words"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs)
    sources = sources.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("_rest", F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long"))
    wide = _ends(buckets, sources.select(F.col("source").alias("_s"), "_rest"), F.lit(0))
    there = slim.join(wide, F.col("source").eqNullSafe(F.col("_source")) & (F.substring("_key", 1, 3) == F.col("_end")))
    narrow = there.groupBy("source", digits(6)).agg(F.sum("size").alias("_words"))
    ends = _ends(narrow, wide.select(F.col("_source").alias("_s"), F.col("_ending").alias("_rest"), F.col("_before").alias("_first")), F.col("_first"))
    return sources.join(ends.drop("_ending"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, keep_columns: bool = True,
) -> DataFrame:
    """Every input row with size, source_size, target, copies (whole repetitions), part_words (of the one document at
    the end of its source's fraction, else 0) and taken = copies * size + part_words.

    Input columns named like a result column are replaced. keep_columns=False returns id, source and the results only.
    """
    made = ("size", "source_size", "target", "copies", "part_words", "taken")
    named = lambda c: F.col(f"`{c}`")
    carried = [c for c in df.columns if c.lower() not in made] if keep_columns else [id_col, source_col]
    text = named(text_col)
    base = df.select(F.struct(*[named(c) for c in carried]).alias("_row"), named(source_col).alias("source"), _key(named(id_col), seed).alias("_key"), n_words(text).alias("size"))
    if keep_columns:
        base = base.withColumn("_tie", F.xxhash64(F.col("_row").getField(text_col)) if text_col in carried else F.lit(0))
        slim = checkpointed(base.select("source", "size", "_key"))
    else:
        base = slim = checkpointed(base.withColumn("_tie", F.lit(0)))
    plan = checkpointed(mix_plan(slim.select("source", "size", "_key"), weights, share, max_epochs)).withColumnRenamed("source", "_s")
    base = base.withColumn("_bucket", F.substring("_key", 1, 6))
    # a row per source: with few sources the rows, texts and all, stay where they are
    small = plan.count() <= BROADCAST_SOURCES
    rows = base.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("_s")))
    here = (F.col("_rest") > 0) & (F.col("_bucket") == F.col("_end"))
    order = Window.partitionBy("source").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ending = rows.filter(here).withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("size").over(order), zero))
    ending = ending.withColumn("_extra", F.greatest(zero, F.least(F.col("size"), F.col("_rest") - F.col("_so_far"))))
    others = rows.filter(~F.coalesce(here, F.lit(False))).withColumn("_so_far", zero)
    others = others.withColumn("_extra", F.when((F.col("_rest") > 0) & (F.col("_bucket") < F.col("_end")), F.col("size")).otherwise(zero))
    out = others.unionByName(ending)
    full = (F.col("size") > 0) & (F.col("_extra") == F.col("size"))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in carried], "size", "source_size", "target",
        (F.col("_whole") + full.cast("long")).alias("copies"),
        F.when(full, zero).otherwise(F.col("_extra")).alias("part_words"),
        (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), keep_columns=False).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
                  md5('11:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS clamp FROM s),
r AS (SELECT *, clamp / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(clamp) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(clamp, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM p),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - so_far)))::BIGINT AS taken FROM c
"""
