"""Aggregates of the audit: bucket counts, worst status, upper median, modes, interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_counts(status: Column) -> list[Column]:
    return [F.count_if(status == s).alias(f"{s}_bucket") for s in ("pass", "warn", "fail")]


def worst(status: Column) -> Column:
    """fail over warn over pass; pass of nothing."""
    rank = F.max(F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0))
    return F.when(rank == 2, "fail").when(rank == 1, "warn").otherwise("pass")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the element at floor(n / 2) of the ascending list, by counts of values and not by collecting them."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_c").over(group.orderBy(value))
    marked = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(group)).filter(F.col("_upto") > F.floor(F.col("_n") / 2))
    return marked.groupBy(*keys).agg(F.min(value).alias("median"))


def rate(hits: Column, total: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(hits, total), F.lit(empty))


def mode_first(df: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """(keys, value, n): the most frequent value, the first seen among equals."""
    each = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("_o"))
    return each.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("_o"))).alias("_m")).select(*keys, f"_m.{value}", "_m.n")


def union_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered): length of the union of intervals, by the running maximum of their ends."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(before), F.col(start))
    each = df.withColumn("_new", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach)))
    return each.groupBy(*keys).agg(F.sum("_new").alias("covered"))
