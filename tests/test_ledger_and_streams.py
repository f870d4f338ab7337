"""The ledger's verdict on literal ledgers, checks over it, and the stream extension against a batch of the same rows."""

import datetime

from pyspark.sql import functions as F

from quillmap.dims import Options
from quillmap.operators import ledger as L
from quillmap.plans.checks import REGISTRY, Tables, verdicts
from quillmap.sources import capture as C
from quillmap.streaming import ledger_stream

T0 = datetime.datetime(2026, 1, 1)


def events(spark, runs):
    """runs: run -> string of o (ok), e (fetch error), s (stall), c (challenge), 4 (denied)."""
    kinds = {"o": ("ok", None, 200), "e": ("fetch-error", None, None), "s": ("stalled-body", None, 200), "c": ("ok", "phrase", 403), "4": ("ok", None, 403)}
    rows = [(run, k, f"u{k}", kinds[x][2], kinds[x][0], kinds[x][1], None, None, f"check{k % 3}", None) for run, said in runs.items() for k, x in enumerate(said)]
    return spark.createDataFrame(rows, C.EVENTS)


def test_verdicts_of_ledgers(spark):
    runs = {"clean": "o" * 30, "lasting": "o" * 10 + "c" * 20, "some": "o" * 25 + "s" + "o" * 24, "drift": "o" * 40 + "e" * 8 + "o" * 12, "early": "ee" + "o" * 28}
    got = {r["run_id"]: r for r in L.verdict(events(spark, runs)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"clean": "pass", "lasting": "fail", "some": "warn", "drift": "warn", "early": "pass"}
    assert (got["lasting"]["onset"], got["lasting"]["post_requests"], got["some"]["onset"], got["drift"]["onset"]) == (11, 20, 26, 41)
    assert got["clean"]["limited_evidence"] and got["lasting"]["failure_rate"] == 67


def test_denied_and_rate_limited(spark):
    rows = L.flags(events(spark, {"r": "o4ce"})).orderBy("seq").collect()
    assert [(r["failed"], r["interference"], r["denied"]) for r in rows] == [(False, False, False), (False, False, True), (True, True, True), (True, False, False)]


def site(spark):
    tabs = "".join(f'<div class="tabbed-block"><h3>Install</h3><p>{x}</p></div>' for x in "ab")
    html = f'<html><body><div class="tabbed-set"><div class="tabbed-labels"><label>npm</label><label>yarn</label></div><div class="tabbed-content">{tabs}</div></div></body></html>'
    head = {"content-type": "text/html"}
    rows = []
    for url, status, to in (("https://a.io/x", 200, None), ("https://a.io/y", 302, "https://acme.okta.com/in"), ("https://a.io/z", 401, None)):
        h = head | ({"location": to} if to else {})
        rows += [("r", url, "GET", None, mode, 200 if mode == "follow" else status, url, False, h, html, len(html), None, None, "ok", None, T0) for mode in ("follow", "manual")]
    runs = spark.createDataFrame([("r", "https://a.io")], "run_id string, base_url string")
    pages = spark.createDataFrame([("r", k, f"https://a.io/{x}", None) for k, x in enumerate("xyz")], "run_id string, ordinal long, url string, original_md string")
    return Tables(runs, pages, spark.createDataFrame(rows, C.SCHEMA), events=events(spark, {"r": "o" * 30}))


def test_checks_of_access_and_tabs(spark):
    t, o = site(spark), Options()
    gate = {r["url"][-1]: r["classification"] for r in REGISTRY["auth-gate-detection"](t, o).collect()}
    assert gate == {"x": "accessible", "y": "auth-redirect", "z": "auth-required"}
    status = {}
    for name in ("auth-gate-detection", "auth-alternative-access", "section-header-quality", "tabbed-content-serialization", "bot-protection-interference"):
        status[name] = verdicts(name, REGISTRY[name](t, o), t.runs, o).first()["status"]
    assert status == {"auth-gate-detection": "warn", "auth-alternative-access": "warn", "section-header-quality": "fail", "tabbed-content-serialization": "pass", "bot-protection-interference": "pass"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", k, f"u{k % 5}", T0 + datetime.timedelta(seconds=7 * k), "fetch-error" if k % 4 == 0 else "ok", None, 403 if k % 7 == 0 else 200, None) for k in range(60)]
    schema = "run_id string, seq long, url string, ts timestamp, outcome string, challenge string, status int, retry_after string"
    spark.createDataFrame(rows + rows[:10], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = ledger_stream.windowed_failures(stream).writeStream.format("memory").queryName("failures").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["start"]: (r["requests"], r["failed"], r["denied"]) for r in spark.table("failures").collect()}
    batch = spark.createDataFrame(rows, schema).groupBy(F.window("ts", "1 minute")["start"].alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") != "ok").alias("f"), F.count_if(F.col("status") == 403).alias("d"))
    assert got == {r["s"]: (r["n"], r["f"], r["d"]) for r in batch.collect()}


def test_latest_outcomes_of_a_stream(spark, tmp_path):
    """A body that stalls after its headers came replaces the outcome that was told first."""
    rows = [("r", k, f"u{k % 3}", T0 + datetime.timedelta(seconds=k), "stalled-body" if k == 5 else "ok") for k in range(7)]
    schema = "run_id string, seq long, url string, ts timestamp, outcome string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = ledger_stream.latest_outcome(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["url"], r["outcome"], r["seq"]) for r in spark.table("latest").collect()} == {("u0", "ok", 6), ("u1", "ok", 4), ("u2", "stalled-body", 5)}
