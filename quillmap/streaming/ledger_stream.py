"""Extension: running request figures over a stream of ledger events.

The batch ledger of `operators.ledger` needs a run's end; this gives tumbling windows with a watermark while it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_failures(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(run_id, start, requests, failed, denied) per window of events(run_id, seq, ts, outcome, challenge, status, retry_after); repeated (run_id, seq) count once."""
    failed = F.col("outcome").isin("stalled-body", "fetch-error", "body-error") | F.col("challenge").isNotNull()
    denied = F.col("status").isin(403, 503) | ((F.col("status") == 429) & F.col("retry_after").isNull())
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])
    per = once.groupBy("run_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"), F.count_if(F.coalesce(denied, F.lit(False))).alias("denied"))
    return per.select("run_id", F.col("w.start").alias("start"), "requests", "failed", "denied")


def latest_outcome(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """The last outcome of each (run_id, url) so far, for bodies that stall after their headers arrived."""
    return events.withWatermark("ts", late).groupBy("run_id", "url").agg(F.max_by("outcome", "seq").alias("outcome"), F.max("seq").alias("seq"))
