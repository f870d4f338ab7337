"""The capture table: every response an audit reads, fetched once and analysed any number of times.

`read_capture` reads a recorded table; `HttpSource` (format "quillmap_http") fetches URLs: one partition per host, so that
pacing holds per site, with so many requests at a time, retries on 429 with a usable Retry-After, a stall guard per
chunk and in all, no second try of a URL that stalled, and a cap on denied bodies. `ledger` derives the request ledger
from a capture.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.request
import zlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "run_id string, url string, method string, accept string, redirect_mode string, status int, final_url string, redirected boolean, "
    "headers map<string,string>, body string, bytes long, wire_bytes long, content_encoding string, outcome string, error string, fetched_at timestamp"
)
EVENTS = "run_id string, seq long, url string, status int, outcome string, challenge string, blocked boolean, retry_after string, check_id string, error string"
# Ports that browsers and fetch clients refuse.
BLOCKED_PORTS = (
    "1 7 9 11 13 15 17 19 20 21 22 23 25 37 42 43 53 69 77 79 87 95 101 102 103 104 109 110 111 113 115 117 119 123 135 137 139 143 161 179 389 427 465 512 513 514 "
    "515 526 530 531 532 540 548 554 556 563 587 601 636 989 990 993 995 1719 1720 1723 2049 3659 4045 4190 5060 5061 6000 6566 6665 6666 6667 6668 6669 6679 6697 10080"
)
MAX_RETRIES, MAX_DENIED = 2, 100_000


def read_capture(spark: SparkSession, path: str, canonical: str | None = None, target: str | None = None) -> DataFrame:
    """A recorded capture. With canonical and target, canonical URLs in text bodies point at the origin under test."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rewritten(rows, canonical, target) if canonical and target else rows


def rewritten(capture: DataFrame, canonical: str, target: str) -> DataFrame:
    """Bodies of text, XML, JSON and Markdown with the canonical origin replaced; sizes stay those that were served."""
    text = content_type().rlike("^text/|xml|json|markdown")
    return capture.withColumn("body", F.when(text, rewrite_origin(F.col("body"), canonical.rstrip("/"), target.rstrip("/"))).otherwise(F.col("body")))


def ledger(capture: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """The request ledger (EVENTS) of a capture: its requests in the order of their answers, with challenge pages told.

    checks: (run_id, url, check_id) for requests that a check made; others are not attributed. A stalled URL has one row.
    """
    from quillmap.functions.challenge import challenge_page

    run = Window.partitionBy("run_id").orderBy("fetched_at", "url", "method", F.col("accept").asc_nulls_first(), "redirect_mode")
    again = F.row_number().over(Window.partitionBy("run_id", "url", F.col("outcome") == "stalled-body").orderBy("fetched_at", "method"))
    rows = capture.withColumn("_again", again).filter((F.col("outcome") != "stalled-body") | (F.col("_again") == 1))
    retry = header("retry-after")
    blocked = F.col("status").isin(403, 503) | ((F.col("status") == 429) & ~usable_wait(retry))
    rows = rows.select(
        "run_id", F.row_number().over(run).cast("long").alias("seq"), "url", "status", "outcome", challenge_page(F.col("body"), content_type()).alias("challenge"),
        F.coalesce(blocked, F.lit(False)).alias("blocked"), retry.alias("retry_after"), "error",
    )
    who = rows.select("run_id", "url").limit(0).withColumn("check_id", F.lit(None).cast("string")) if checks is None else checks.dropDuplicates(["run_id", "url"])
    return rows.join(who, ["run_id", "url"], "left").select("run_id", "seq", "url", "status", "outcome", "challenge", "blocked", "retry_after", "check_id", "error")


def usable_wait(value: Column) -> Column:
    """Whether a Retry-After asks for 1 to 60 seconds."""
    return F.coalesce(value.try_cast("double").between(1, 60), F.lit(False))


def blocked_port_message(port: int) -> str:
    return f"port {port} is one that clients refuse to connect to; serve the site on another port, or behind a proxy on 80 or 443"


def variant(capture: DataFrame, method: str = "GET", accept: str | None = None, redirect: str = "follow") -> DataFrame:
    """Rows of one kind of request: (run_id, url) is a key of the result."""
    same = F.col("accept").eqNullSafe(F.lit(accept)) if accept is None else F.col("accept") == accept
    return capture.filter((F.col("method") == method) & same & (F.col("redirect_mode") == redirect))


def content_type() -> Column:
    return F.lower(F.coalesce(F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "content-type")), F.lit(0)), F.lit("")))


def header(name: str) -> Column:
    return F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == name)), F.lit(0))


def rewrite_origin(body: Column, canonical: str, target: str) -> Column:
    """Canonical URLs in a body pointed at the origin under test, at URL boundaries."""
    import re

    quoted = re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", canonical)
    return F.regexp_replace(body, quoted + r"(?=[/?#\s\"'<>)\]]|$)", target.replace("\\", "\\\\").replace("$", "\\$"))


def usable_retry_after(value: str | None) -> float | None:
    """Seconds to wait: 1 to 60, else null."""
    try:
        seconds = float(value or "")
    except ValueError:
        return None
    return seconds if 1 <= seconds <= 60 else None


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


class Fetcher:
    """Requests of one host: paced, with retries, time-outs and caps. settings: see HttpReader."""

    def __init__(self, settings: dict):
        get = settings.get
        self.workers = int(get("concurrency", 1))
        self.delay, self.timeout = float(get("delay_ms", 200)) / 1000, float(get("timeout_ms", 15_000)) / 1000
        self.headers = {"User-Agent": get("user_agent", "quillmap/1.0"), "Accept-Encoding": "gzip"}
        self.own = json.loads(get("headers", "{}"))

    def paced(self, requests: list[tuple[str, str, dict]]) -> Iterator[tuple]:
        """Rows of (run_id, url, variant) requests, which begin `delay` apart, at most `workers` at a time. A URL that
        stalled is not asked again."""
        stalled: set[str] = set()
        began = 0.0

        def one(run_id: str, url: str, variant: dict) -> tuple | None:
            if url in stalled:
                return None
            row = self.fetch(run_id, url, variant)
            if row[13] == "stalled-body":
                stalled.add(url)
            return row

        with ThreadPoolExecutor(self.workers) as pool:
            waiting = deque()
            for request in requests:
                time.sleep(max(0.0, began + self.delay - time.monotonic()))
                began = time.monotonic()
                waiting.append(pool.submit(one, *request))
                while len(waiting) >= self.workers or waiting and waiting[0].done():
                    if (row := waiting.popleft().result()) is not None:
                        yield row
            for job in waiting:
                if (row := job.result()) is not None:
                    yield row

    def request_headers(self, accept: str | None) -> dict[str, str]:
        """The reader's headers; the caller's own replace them whatever their case."""
        mine = self.headers | ({"Accept": accept} if accept else {})
        given = {k.lower() for k in self.own}
        return {k: v for k, v in mine.items() if k.lower() not in given} | self.own

    def _body(self, response, status: int, began: float) -> tuple[bytes, str, str | None]:
        """The body, with the outcome. Each chunk has the whole time-out of its own; all of them have four."""
        parts, size = [], 0
        try:
            while chunk := response.read1(65_536):
                parts.append(chunk)
                size += len(chunk)
                if time.monotonic() - began > 4 * self.timeout:
                    return b"".join(parts), "stalled-body", None
                if status in (403, 429, 503) and size > MAX_DENIED:
                    break
        except TimeoutError:
            return b"".join(parts), "stalled-body", None
        except Exception as e:
            return b"".join(parts), "body-error", f"{type(e).__name__}: {e}"
        return b"".join(parts), "ok", None

    def fetch(self, run_id: str, url: str, variant: dict) -> tuple:
        opener = urllib.request.build_opener(*([_NoRedirect()] if variant["redirect"] == "manual" else []))
        status = final = raw = error = None
        got: dict[str, str] = {}
        outcome, began = "ok", time.monotonic()
        try:
            port = urlsplit(url).port
        except ValueError:
            port = None
        if port is not None and str(port) in BLOCKED_PORTS.split():
            outcome, error = "fetch-error", blocked_port_message(port)
        for attempt in range(MAX_RETRIES + 1 if outcome == "ok" else 0):
            try:
                response = opener.open(urllib.request.Request(url, headers=self.request_headers(variant["accept"]), method=variant["method"]), timeout=self.timeout)
            except urllib.error.HTTPError as e:
                response = e
            except Exception as e:  # a response that never came is a row, not a failed task
                outcome, error = "fetch-error", f"{type(e).__name__}: {e}"
                break
            status, final = response.status, response.geturl()
            got = {k.lower(): v for k, v in response.headers.items()}
            wait = usable_retry_after(got.get("retry-after")) if status == 429 else None
            if wait is None or attempt == MAX_RETRIES:
                raw, outcome, error = self._body(response, status, began)
                break
            time.sleep(wait)
        body = raw
        if raw and got.get("content-encoding", "").lower() == "gzip":
            body = zlib.decompressobj(wbits=31).decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        size = len(body) if body is not None else None
        return (
            run_id, url, variant["method"], variant["accept"], variant["redirect"], status, final, bool(final and final != url), got, decoded(body, got.get("content-type", "")),
            size, len(raw) if raw is not None else None, got.get("content-encoding"), outcome, error, datetime.datetime.now(datetime.timezone.utc),
        )


class HttpReader(DataSourceReader):
    """Options: urls (a JSON list), run_id, variants (a JSON list of {method, accept, redirect}), or method, accept and
    redirect for one; delay_ms, timeout_ms, concurrency (per host), user_agent, headers (a JSON object)."""

    def __init__(self, options: dict):
        get = options.get
        self.options, self.urls, self.run_id = options, json.loads(get("urls", "[]")), get("run_id", "run")
        one = {"method": get("method", "GET"), "accept": get("accept"), "redirect": get("redirect", "follow")}
        self.variants = [one | v for v in json.loads(get("variants", "[{}]"))]

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(url).netloc.lower(), []).append(url)
        return [_Host(u) for u in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        yield from Fetcher(self.options).paced([(self.run_id, u, v) for v in self.variants for u in partition.urls])


def fetched(requests: DataFrame, settings: dict) -> DataFrame:
    """The capture rows of requests (run_id, url, method, accept, redirect_mode). A host's requests run in one task, so
    that pacing holds; hosts run side by side. settings: those of HttpReader, by name."""

    def run(frames):
        import pandas as pd

        fetcher, names = Fetcher(settings), [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            for _, host in frame.groupby(frame["url"].map(lambda u: urlsplit(u).netloc.lower()), sort=False):
                asked = [(r.run_id, r.url, {"method": r.method, "accept": None if pd.isna(r.accept) else r.accept, "redirect": r.redirect_mode}) for r in host.itertuples()]
                rows = list(fetcher.paced(asked))
                if rows:
                    yield pd.DataFrame(dict(zip(names, map(list, zip(*rows)))), columns=names).astype({"status": "Int32", "bytes": "Int64", "wire_bytes": "Int64"})

    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1))
    rows = requests.select("run_id", "url", "method", "accept", "redirect_mode").withColumn("_host", host).repartition("_host").sortWithinPartitions("_host", "method", "url")
    return rows.drop("_host").mapInPandas(run, SCHEMA)


def decoded(body: bytes | None, content_type: str) -> str | None:
    """A body by the charset of its type; UTF-8 where there is none or an unknown one."""
    if body is None:
        return None
    charset = (content_type.lower().partition("charset=")[2].split(";")[0].strip() or "utf-8").strip("\"'")
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmap_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HttpReader:
        return HttpReader(dict(self.options))
