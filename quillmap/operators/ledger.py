"""Analytics of the request ledger: summaries, early and late thirds, onset and the interference verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.operators.prefix_scan import prefix_scan

# Fixed values of the published bot-protection check.
MIN_EVIDENCE, LIMITED, SUSTAINED, POST_REQUESTS, POST_FAILURES = 5, 50, 0.5, 10, 5
LATE_RATE, MULTIPLIER, LATE_EVENTS, TREND_MIN, SPAN = 0.2, 3, 2, 6, 2


def flags(events: DataFrame) -> DataFrame:
    """Adds failed, interference, denied and rate_limited to ledger rows."""
    failed = F.col("outcome").isin("stalled-body", "fetch-error", "body-error") | F.col("challenge").isNotNull()
    hard = (F.col("outcome") == "stalled-body") | F.col("challenge").isNotNull()
    denied = F.col("status").isin(403, 503) | ((F.col("status") == 429) & F.col("retry_after").isNull())
    return (
        events.withColumn("failed", F.coalesce(failed, F.lit(False))).withColumn("interference", F.coalesce(hard, F.lit(False)))
        .withColumn("denied", F.coalesce(denied, F.lit(False))).withColumn("rate_limited", F.coalesce(F.col("status") == 429, F.lit(False)))
    )


def summary(events: DataFrame) -> DataFrame:
    """Per run: requests, stalled_bodies, challenge_pages, fetch_errors, failed, failure_rate (rounded per cent)."""
    return events.groupBy("run_id").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("outcome") == "stalled-body").alias("stalled_bodies"),
        F.count("challenge").alias("challenge_pages"),
        F.count_if(F.col("outcome").isin("fetch-error", "body-error")).alias("fetch_errors"),
        F.count_if("failed").alias("failed"),
        F.floor(100 * F.count_if("failed") / F.count("*") + 0.5).alias("failure_rate"),
    )


def positioned(events: DataFrame) -> DataFrame:
    """Adds rn (from 1), n and third = floor(n / 3); the middle remainder belongs to neither third."""
    run = Window.partitionBy("run_id")
    return (
        events.withColumn("rn", F.row_number().over(run.orderBy("seq"))).withColumn("n", F.count("*").over(run))
        .withColumn("third", F.floor(F.col("n") / 3))
    )


def scanned(events: DataFrame, order: list[str]) -> DataFrame:
    """events with rn, n and third as `positioned` adds them, by a prefix scan in the given order: for runs of any length."""
    rows = prefix_scan(events, ["run_id"], order, {"rn": ("count", F.lit(1))}, totals=True)
    return rows.withColumnRenamed("rn_all", "n").withColumn("third", F.floor(F.col("n") / 3))


def trend(events: DataFrame, event: str, require_span: bool) -> DataFrame:
    """Per run: events in the first and last third, the checks that the late ones span, and whether they correlate with volume."""
    rows = events if "third" in events.columns else positioned(events)
    early, late = F.col("rn") <= F.col("third"), F.col("rn") > F.col("n") - F.col("third")
    out = rows.groupBy("run_id").agg(
        F.max("n").alias("n"), F.max("third").alias("third"),
        F.count_if(early & F.col(event)).alias("early_events"), F.count_if(late & F.col(event)).alias("late_events"),
        F.count_distinct(F.when(late & F.col(event), F.coalesce("check_id", F.lit("(unattributed)")))).alias("late_checks"),
    )
    share = lambda c: F.coalesce(F.try_divide(c, F.col("third")), F.lit(0.0))
    correlated = (
        (F.col("n") >= TREND_MIN) & (F.col("late_events") >= LATE_EVENTS) & (share(F.col("late_events")) >= LATE_RATE)
        & (share(F.col("late_events")) >= MULTIPLIER * share(F.col("early_events")))
    )
    return out.withColumn("correlated", correlated & (F.col("late_checks") >= SPAN) if require_span else correlated)


def first_onset(rows: DataFrame) -> DataFrame:
    """(run_id, onset) of rows with positions: the first interference, else the first failure after the early third."""
    return rows.groupBy("run_id").agg(
        F.coalesce(F.min(F.when(F.col("interference"), F.col("rn"))), F.min(F.when((F.col("rn") > F.col("third")) & F.col("failed"), F.col("rn")))).alias("onset")
    )


def onset(events: DataFrame) -> DataFrame:
    """Per run: the first interference, else the first failure after the early third, and the failures from there on."""
    rows = events if "third" in events.columns else positioned(events)
    first = first_onset(rows)
    after = rows.join(first, "run_id").filter(F.col("rn") >= F.col("onset"))
    return after.groupBy("run_id").agg(F.first("onset").alias("onset"), F.count("*").alias("post_requests"), F.count_if("failed").alias("post_failures"))


def verdict(events: DataFrame) -> DataFrame:
    """Per run: pass without interference or trend, fail where it is sustained, else warn."""
    rows = flags(events)
    s, t, o = summary(rows), trend(rows, "failed", False), onset(rows)
    kinds = rows.groupBy("run_id").agg(F.count_if("interference").alias("interference_events"))
    out = s.join(kinds, "run_id").join(t.select("run_id", "correlated"), "run_id").join(o, "run_id", "left")
    seen = (F.col("interference_events") > 0) | F.col("correlated")
    late = (F.col("post_requests") >= POST_REQUESTS) & (F.col("post_failures") >= POST_FAILURES) & (F.col("post_failures") >= SUSTAINED * F.col("post_requests"))
    lasting = ((F.col("failed") >= POST_FAILURES) & (F.col("failed") >= SUSTAINED * F.col("requests"))) | F.coalesce(late, F.lit(False))
    return out.withColumn("limited_evidence", F.col("requests") < LIMITED).withColumn("status", F.when(~seen, "pass").when(lasting, "fail").otherwise("warn"))
