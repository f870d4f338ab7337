"""Figures of whole runs from a stream of ledger events: early and late thirds and the onset need a run's end.

State per run is a map from an event's number to what counts of it (failed, interference, check), so that repeated events
count once and a later outcome of an event (a body that stalls after its headers came) replaces the earlier one. A timer
closes a run when no event came for `quiet`, by the watermark; then the run's figures are one row, equal to those of
`operators.ledger.trend` and `onset` over the same events, and its state goes. Events of a run that come after its closing
begin a new one. Null run ids are a run; events without a number are dropped. State is spilled by the store of the session
(RocksDB, which this operator asks for), a run at a time passes through memory when it closes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmap.operators import ledger as L

FIGURES = "run_id string, n long, third long, early_events long, late_events long, late_checks long, correlated boolean, onset long, post_requests long, post_failures long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_figures(events: list[tuple[int, bool, bool, str | None]], require_span: bool = True) -> tuple:
    """(n, third, early, late, checks, correlated, onset, requests and failures from there on) of (number, failed, interference, check)."""
    events = sorted(events)
    n = len(events)
    third = n // 3
    late = [check or "(unattributed)" for k, (_, failed, _, check) in enumerate(events) if failed and k >= n - third]
    early, checks = sum(e[1] for e in events[:third]), len(set(late))
    correlated = n >= L.TREND_MIN and len(late) >= L.LATE_EVENTS and len(late) / third >= L.LATE_RATE and len(late) / third >= L.MULTIPLIER * (early / third)
    correlated = correlated and (checks >= L.SPAN or not require_span)
    onset = next((k for k, e in enumerate(events) if e[2]), next((k for k, e in enumerate(events) if k >= third and e[1]), None))
    after = events[onset:] if onset is not None else []
    return n, third, early, len(late), checks, correlated, None if onset is None else onset + 1, len(after) if after else None, sum(e[1] for e in after) if after else None


class RunProcessor(StatefulProcessor):
    def __init__(self, quiet_ms: int, require_span: bool):
        self.quiet_ms, self.require_span = quiet_ms, require_span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "at long, failed boolean, interference boolean, check_id string")
        self.closes = handle.getValueState("closes", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = 0
        for some in rows:
            for seq, at, *flags in zip(some["seq"].tolist(), some["at"].tolist(), some["failed"].tolist(), some["interference"].tolist(), some["check_id"].tolist()):
                last = max(last, at)
                # of two rows of an event the later one is right, whatever order they come in
                known = self.events.getValue((seq,)) if self.events.containsKey((seq,)) else None
                if known is None or known[0] <= at:
                    self.events.updateValue((seq,), (at, *flags))
        before = self.closes.get()[0] if self.closes.exists() else None
        due = max(last + self.quiet_ms, before or 0)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.closes.update((due,))
            self.handle.registerTimer(due)
        yield pd.DataFrame({name: pd.Series(dtype=object) for name in [x.split()[0] for x in FIGURES.split(", ")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(k[0], bool(v[1]), bool(v[2]), v[3]) for k, v in self.events.iterator()]
        self.events.clear()
        self.closes.clear()
        names = [x.split()[0] for x in FIGURES.split(", ")]
        yield pd.DataFrame([(key[0], *run_figures(found, self.require_span))], columns=names).astype(object)

    def close(self) -> None:
        pass


def closed_runs(events: DataFrame, quiet: str = "10 minutes", late: str = "5 minutes", require_span: bool = True) -> DataFrame:
    """A stream of FIGURES, one row per run once it is closed, of ledger events (run_id, seq, ts, outcome, challenge, status,
    retry_after, check_id), which may come in any order within `late`."""
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    number, unit = quiet.split()
    quiet_ms = int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    rows = L.flags(events.filter("seq is not null")).withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    rows = rows.select("run_id", F.col("seq").cast("long").alias("seq"), "ts", "at", "failed", "interference", "check_id")
    return rows.groupBy("run_id").transformWithStateInPandas(RunProcessor(quiet_ms, require_span), FIGURES, "Append", "EventTime")
