"""A corpus pipeline of five operators: quality rules, exact dedup, SimHash near-dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; run() writes each
as Parquet in the shared folder of checkpoints and rereads it as the next stage's docs. All but the last return the
columns of documents.

The stages' decisions take effect: rejected documents go, and lines over the limit go from those that stay; of equal
texts the row with the smallest doc_id stays; of a group of near-duplicates the row with the group's smallest doc_id,
nulls last; the mix repeats a document as often as it takes it (a fraction counts as a repetition from one half on) and
leaves out what it does not take; the last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm.common import checkpointed, written
from quillmap.llm.exact_dedup import exact_dedup
from quillmap.llm.mixing import mix_sources
from quillmap.llm.packing import pack_documents
from quillmap.llm.quality_rules import quality_rules
from quillmap.llm.simhash_dedup import simhash_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequency keep, without the lines over the limit; n_chars follows the text."""
    kept = quality_rules(docs.select(*COLUMNS)).filter("kept")
    changed = F.col("cleaned_text") != F.col("text")
    kept = kept.withColumn("n_chars", F.when(changed, F.length("cleaned_text").cast("long")).otherwise(F.col("n_chars")))
    return kept.withColumn("text", F.col("cleaned_text")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs.select(*COLUMNS), keep="smallest").filter("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, a null id only where no row has another."""
    # ids may be null or repeat, so rows get numbers, which the checkpoint makes lasting
    rows = checkpointed(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    groups = simhash_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    placed = groups.join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row"))
    stays = placed.groupBy("_group").agg(first.alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(docs.select(*COLUMNS))
    times = F.col("copies") + (2 * F.col("part_words") >= F.greatest("size", F.lit(1))).cast("long")
    return mixed.withColumn("_times", times.cast("int")).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Fingerprints, tokens and packing are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
