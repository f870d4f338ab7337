"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters on (first 64 characters, 64-bit hash), so that a splitter
has a bounded size and boilerplate openings do not pile up in one partition. External sorting inside a partition puts
equal texts next to each other; the window compares neighbours by the whole text, never by the hash alone, and the
first of each run stays.

Very common texts (those of hashes with `hot_rows` rows or more, a bound that does not depend on the data) do not enter
the sort, so no sort partition holds a longer run: they are counted with map-side pre-aggregation on the whole text, and
their rows get the group's figures by a join, which is a broadcast only up to `BROADCAST_ROWS` such texts. Where no text
is that common that path is not planned at all. Everything is built-in column expressions.

Defined results: null texts count as empty and are equal to empty ones. Null ids sort as the smallest. Rows that repeat
both id and text are ties: one of them stays. No rows give no rows. Columns of the input other than id and text are
carried along under their own names; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

BROADCAST_ROWS = 200_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hot_rows: int = 1000
) -> DataFrame:
    """Every input row with keep_id, group_size, kept and text_sha256 of its normalised text.

    keep: which id of equal texts stays, "smallest" or "largest".
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    made = ("keep_id", "group_size", "kept", "text_sha256")
    carried = [c for c in df.columns if c.lower() not in made]
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row") if carried else F.lit(None).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        ascii_lower(F.col(f"`{text_col}`")).alias("_norm"),
    ).withColumn("_hash", F.xxhash64("_norm"))

    hot = written(base.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_rows).select("_hash"))
    n_hot = hot.count()
    rare = base.join(_sized(hot, n_hot), "_hash", "left_anti") if n_hot else base

    order: Column = F.col("_id").asc_nulls_first() if keep == "smallest" else F.col("_id").desc_nulls_last()
    run = Window.partitionBy("_start", "_hash", "_norm").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = (
        rare.withColumn("_start", F.substring("_norm", 1, 64))
        .repartitionByRange("_start", "_hash")
        .withColumn("keep_id", F.first("_id").over(whole))
        .withColumn("group_size", F.count("*").over(whole))
        .withColumn("kept", F.row_number().over(run) == 1)
        .withColumn("text_sha256", F.sha2("_norm", 256))
    )

    columns = ["_row", "keep_id", "group_size", "kept", "text_sha256"]
    result = lambda rows: rows.select(*[F.col("_row").getField(c).alias(c) for c in carried], *made)
    if not n_hot:
        return result(sorted_rows)

    common = base.join(_sized(hot, n_hot), "_hash", "left_semi")
    first_id = F.min if keep == "smallest" else F.max
    # min() and max() ignore nulls, so that a null id is the smallest only if it is told apart
    null_first = F.lit(keep == "smallest")
    totals = (
        common.groupBy("_norm")
        .agg(first_id("_id").alias("_best"), F.count("*").alias("group_size"), F.bool_or(F.col("_id").isNull()).alias("_nulls"))
        .select(
            F.sha2("_norm", 256).alias("text_sha256"),
            F.when(~(null_first & F.col("_nulls")), F.col("_best")).alias("keep_id"),
            "group_size",
        )
    )
    joined = common.withColumn("text_sha256", F.sha2("_norm", 256)).join(_sized(totals, n_hot), "text_sha256").drop("_norm")
    # of the rows with the id that stays one is chosen, first in each task, so that no group of ties is one task's
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    ties = joined.filter(stays).withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    ties = ties.withColumn("_first", F.row_number().over(Window.partitionBy("text_sha256", "_task").orderBy("_place")) == 1)
    among = Window.partitionBy("text_sha256", F.when(F.col("_first"), -1).otherwise(F.col("_task"))).orderBy("_place")
    common_rows = (
        ties.withColumn("kept", F.col("_first") & (F.row_number().over(among) == 1)).select(*columns)
        .unionByName(joined.filter(~stays).withColumn("kept", F.lit(False)).select(*columns))
    )
    return result(sorted_rows.select(*columns).unionByName(common_rows))


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    out = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM d
"""
