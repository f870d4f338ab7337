"""Closed runs of a stream in shuffled batches against the batch ledger."""

import datetime
import random

from pyspark.sql import functions as F

from quillmap.operators import ledger as L
from quillmap.streaming.run_state import closed_runs, run_figures

SCHEMA = "run_id string, seq long, ts timestamp, outcome string, challenge string, status int, retry_after string, check_id string"
START = datetime.datetime(2026, 1, 1)


def rows_of(seed, runs=5, n=90):
    rng = random.Random(seed)
    out = []
    for r in range(runs):
        for k in range(rng.randint(1, n)):
            bad = rng.random() < 0.1 + 0.4 * (k > n / 3) * (r % 2)
            out.append((f"r{r}", k, START + datetime.timedelta(seconds=k), rng.choice(["fetch-error", "stalled-body"] if r % 3 == 2 else ["fetch-error"]) if bad else "ok", None, 200, None, rng.choice(["a", "b", None])))
    return out


def batch(spark, rows):
    flagged = L.flags(spark.createDataFrame(rows, SCHEMA))
    both = L.trend(flagged, "failed", True).join(L.onset(flagged), "run_id", "left")
    names = ["n", "third", "early_events", "late_events", "late_checks", "correlated", "onset", "post_requests", "post_failures"]
    return {r["run_id"]: tuple(r[x] for x in names) for r in both.collect()}


def test_figures_of_a_run(spark):
    rows = rows_of(1, runs=40)
    want = batch(spark, rows)
    for run in want:
        hard = ("stalled-body",)
        mine = [(k, o != "ok", o in hard, c) for r, k, _, o, _, _, _, c in rows if r == run]
        random.Random(2).shuffle(mine)
        assert run_figures(mine) == want[run], run


def test_stream_equals_batch(spark, tmp_path):
    rows = rows_of(3)
    # earlier outcomes of some events, which later ones replace, and repeated rows
    shown = rows + [(*r[:2], r[2] - datetime.timedelta(milliseconds=500), "ok" if r[3] != "ok" else "fetch-error", *r[4:]) for r in rows[::7]] + rows[::5]
    random.Random(4).shuffle(shown)
    source = str(tmp_path / "events")
    for k in range(4):
        spark.createDataFrame(shown[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    # an event far later moves the watermark beyond the runs' ends
    end = [("end", 0, START + datetime.timedelta(hours=5), "ok", None, 200, None, None)]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = lambda: closed_runs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query().awaitTermination(120)
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    names = ["n", "third", "early_events", "late_events", "late_checks", "correlated", "onset", "post_requests", "post_failures"]
    assert {r["run_id"]: tuple(r[x] for x in names) for r in got.filter(F.col("run_id") != "end").collect()} == batch(spark, rows)
