"""Dependencies of checks: order, and which checks a run skips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.dims import CATEGORIES, CHECKS


def order() -> list[str]:
    """Checks by category, then as registered."""
    names = list(CHECKS)
    return sorted(names, key=lambda c: (CATEGORIES.index(CHECKS[c][0]), names.index(c)))


def unmet(check: str, statuses: dict[str, str]) -> bool:
    """Whether a check is skipped: one of its dependencies ran, and some group of alternatives has no pass or warn."""
    groups = CHECKS[check][6]
    if not any(d in statuses for g in groups for d in g):
        return False
    return not all(any(statuses.get(d) in ("pass", "warn") for d in g) for g in groups)


def gate(results: DataFrame) -> DataFrame:
    """(run_id, check_id, skipped) of all checks with dependencies for all runs at once."""
    edges = [(c, k, d) for c, v in CHECKS.items() for k, g in enumerate(v[6]) for d in g]
    ran = results.select("run_id", F.col("check_id").alias("dep"), "status")
    runs = results.select("run_id").distinct()
    pairs = runs.withColumn("_e", F.explode(F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(k).alias("g"), F.lit(d).alias("dep")) for c, k, d in edges]))).select("run_id", "_e.*")
    rows = pairs.join(ran, ["run_id", "dep"], "left")
    groups = rows.groupBy("run_id", "check_id", "g").agg(F.bool_or(F.coalesce(F.col("status").isin("pass", "warn"), F.lit(False))).alias("ok"), F.bool_or(F.col("status").isNotNull()).alias("ran"))
    return groups.groupBy("run_id", "check_id").agg((F.bool_or("ran") & ~F.bool_and("ok")).alias("skipped"))
