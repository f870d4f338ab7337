"""A synthetic site through the whole audit, and parts of it on small inputs."""

import datetime
import json
import time

import pytest

from quillmap.dims import CHECKS, Options
from quillmap.plans import dag, engine, reports
from quillmap.plans.checks import REGISTRY, Tables, missing_url
from quillmap.sources import capture as C
from quillmap.sources import config, crawl, discovery, indexes
from pyspark.sql import functions as F

NOW = datetime.datetime(2026, 1, 1)
BASE = "https://docs.acme.io"
PROSE = "This paragraph explains at length how the widget is set up and what to expect of it. "


def row(url, body="", status=200, kind="text/html", accept=None, redirect="follow", method="GET", run="r", **headers):
    h = {"content-type": kind} | {k.replace("_", "-"): v for k, v in headers.items()}
    return (run, url, method, accept, redirect, status, url, False, h, body, len(body.encode()), None, None, "ok", None, NOW)


def page(k, extra=""):
    return f"<html><head><title>P{k}</title></head><body><nav><a href='/'>Home</a></nav><main><p>See <a href='/llms.txt'>the index</a></p><h1>Page {k}</h1>" + "".join(f"<p>{PROSE}{k}{i}</p>" for i in range(12)) + extra + "</main></body></html>"


def markdown(k):
    return f"[index](/llms.txt)\n\n# Page {k}\n\n" + "\n\n".join(PROSE + f"{k}{i}" for i in range(12)) + f"\n\n[this page]({BASE}/p{k}.md)\n"


@pytest.fixture(scope="module")
def site(spark):
    n = 6
    index = "# Acme\n\n> Docs of Acme\n\n## Pages\n\n" + "\n".join(f"- [P{k}]({BASE}/p{k}.md)" for k in range(n)) + "\n"
    rows = [row(f"{BASE}/llms.txt", index, kind="text/plain", etag='"1"')]
    for k in range(n):
        url = f"{BASE}/p{k}"
        rows += [row(url, page(k), cache_control="max-age=60"), row(url, page(k), redirect="manual"), row(url, markdown(k), kind="text/markdown", accept="text/markdown")]
        rows += [row(f"{url}.md", markdown(k), kind="text/markdown"), row(f"{url}.md", "", kind="text/markdown", method="HEAD"), row(f"{url}-quillmap-missing-page", "no", status=404)]
    rows += [row("https://spa.io/", "", run="s"), row("https://spa.io/a", '<html><body><div id="root"></div></body></html>', run="s"), row("https://spa.io/a", "", run="s", redirect="manual")]
    capture = spark.createDataFrame(rows, C.SCHEMA)
    runs = spark.createDataFrame([("r", BASE), ("s", "https://spa.io")], "run_id string, base_url string")
    pages = spark.createDataFrame([("r", k, f"{BASE}/p{k}", f"{BASE}/p{k}.md") for k in range(n)] + [("s", 0, "https://spa.io/a", None)], "run_id string, ordinal long, url string, original_md string")
    sitemap = pages.select("run_id", "url").filter("run_id = 'r'").unionByName(spark.createDataFrame([("r", f"{BASE}/extra")], "run_id string, url string"))
    return Tables(runs, pages, capture, sitemap=sitemap)


def test_whole_audit(spark, site):
    """All 28 checks of two sites: a good one, and one that is a shell without an index."""
    assert set(REGISTRY) == set(CHECKS)
    seen = []
    began = time.monotonic()
    events = C.ledger(site.capture)
    tables = Tables(site.runs, site.pages.withColumn("tag", F.when(F.col("ordinal") < 3, "first")), site.capture, events, site.sitemap)
    out = engine.audit(tables, Options(), progress=seen.append, context="ci")
    status = {(r["run_id"], r["check_id"]): r["status"] for r in out["results"].collect()}
    assert len(status) == 56 and len(seen) == 56 and time.monotonic() - began < 120
    good = {k: status[("r", k)] for k in CHECKS}
    # the directive's link to /llms.txt is root-relative; six of seven pages of the sitemap are listed; no tabs
    want = {k: "pass" for k in CHECKS} | {"markdown-link-portability": "warn", "llms-txt-coverage": "warn", "section-header-quality": "skip", "auth-alternative-access": "skip"}
    assert good == want
    assert status[("s", "llms-txt-exists")] == "fail" and status[("s", "rendering-strategy")] == "fail"
    assert status[("s", "llms-txt-valid")] == "skip" and status[("s", "page-size-markdown")] == "skip"
    scores = {r["run_id"]: r for r in out["scores"].collect()}
    assert scores["r"]["score"] >= 90 and scores["r"]["grade"] in ("A", "A+")
    assert scores["s"]["score"] <= 39 and scores["s"]["grade"] == "F"
    assert [(r["run_id"], r["tag"], r["pages"]) for r in out["tag_scores"].collect() if r["run_id"] == "r"] == [("r", "first", 3)]
    report = {r["run_id"]: r["report"] for r in reports.json_report(out).collect()}
    assert json.loads(report["r"])["score"] == scores["r"]["score"] and json.loads(report["r"])["tag_scores"][0]["tag"] == "first"
    text = reports.text_report(report["s"], fixes=True, verbose=True)
    assert "llms-txt-exists: no llms.txt file was found" in text and "fix:" in text and "a CI system" in text and "single-page-sample" in text
    assert "root-relative link" in reports.text_report(report["r"], verbose=True)
    assert reports.scorecard(report["r"]).startswith("overall") and "#first" in reports.scorecard(report["r"])
    assert reports.exit_status(out["results"]) == 1
    for _, check, verdict, message in reports.cases(out["results"].filter("run_id = 'r'")):
        reports.expect(verdict, message)
    with pytest.raises(AssertionError):
        reports.expect("fail", "x")
    tables.release()


def test_diagnostics_reach_the_audit(spark):
    """A site with flattened dynamic pages, rate limits, a gzipped sitemap, foreign links and bot protection."""
    base = "https://d.io"
    rows = [row(f"{base}/llms.txt", "# D\n\n" + "\n".join(f"- [x{k}](https://other.io/x{k})" for k in range(4)), kind="text/plain")]
    table = "| a | b |\n| - | - |\n" + "| value | other |\n" * 9000
    for k in range(6):
        url = f"{base}/p{k}"
        html = "<html><body><main><h1>T</h1><table>" + "<tr><th>a</th><th>b</th></tr>" + "<tr><td>value</td><td>other</td></tr>" * 9000 + "</table></main></body></html>"
        rows += [row(url, html, status=429 if k > 2 else 200), row(f"{url}.md", f"# T\n\n{table}\n[next page](?page=2) [rel](a.md)\n", kind="text/markdown", status=429 if k > 3 else 200)]
    rows += [row(f"{base}/robots.txt", f"Sitemap: {base}/s.xml.gz\n", kind="text/plain")]
    rows += [row(f"{base}/blocked{k}", "<html><title>Just a moment...</title></html>", status=403) for k in range(30)]
    capture = spark.createDataFrame([(*r[:-1], NOW + datetime.timedelta(seconds=i)) for i, r in enumerate(rows)], C.SCHEMA)
    runs = spark.createDataFrame([("r", base)], "run_id string, base_url string")
    pages = spark.createDataFrame([("r", k, f"{base}/p{k}", None) for k in range(6)], "run_id string, ordinal long, url string, original_md string")
    files = indexes.llms_txt_files(runs, capture)
    found = discovery.discover(runs, capture, files)
    assert [r["warning"] for r in found.warnings.collect()] == [f"skipped gzipped sitemap {base}/s.xml.gz"]
    tables = Tables(runs, pages, capture, C.ledger(capture))
    out = engine.audit(tables, Options(), found.warnings)
    told = {r["diagnostic"] for r in out["diagnostics"].collect()}
    assert {"dynamic-content-rendered-statically", "bot-protection-scan-reliability", "cross-origin-llms-txt", "gzipped-sitemap-skipped", "rate-limiting-severe"} <= told
    results = {r["check_id"]: r for r in out["results"].collect()}
    assert results["page-size-html"]["rate_limited"] == 3 and results["page-size-html"]["fetch_errors"] == 3 and results["bot-protection-interference"]["status"] == "fail"
    assert "3 failed to fetch; 3 were rate-limited" in results["page-size-html"]["message"]
    directions = {r["direction"] for r in out["findings"].filter(F.col("page_key").contains("/p0")).collect()}
    assert directions == {"too much", "too little", "unnavigable"}
    tables.release()


@pytest.mark.parametrize("name", ["llms-txt-size", "llms-txt-links-markdown", "llms-txt-directive-html", "llms-txt-directive-md", "page-size-transfer", "content-start-position", "single-fetch-completeness",
                                  "tabbed-content-serialization", "markdown-code-fence-validity", "embedded-data-serialization", "redirect-behavior", "markdown-content-parity", "cache-header-hygiene"])
def test_other_checks(site, name):
    rows = REGISTRY[name](site, Options()).filter("run_id = 'r'").select("url", "status").collect()
    assert rows and {r["status"] for r in rows} == {"pass"}, rows


def test_dependencies():
    order = dag.order()
    assert order[0] == "llms-txt-exists" and len(order) == 28
    assert dag.unmet("llms-txt-valid", {"llms-txt-exists": "fail"}) and not dag.unmet("llms-txt-valid", {})
    assert not dag.unmet("page-size-markdown", {"markdown-url-support": "fail", "content-negotiation": "warn"})


def test_options_and_config(tmp_path):
    assert Options().validate() == []
    assert len(Options(max_concurrency=0, size_limits=(10, 5), parity_limits=(30, 20), check_ids=("nope",)).validate()) == 4
    (tmp_path / "quillmap.config.yml").write_text("url: https://a.io\npages:\n - https://a.io/x\n - {url: https://a.io/y, tag: api}\noptions: {max_links: 5}\n")
    (tmp_path / "deep").mkdir()
    found = config.find_config(tmp_path / "deep")
    loaded, errors = config.load_config(found)
    assert errors == [] and loaded["options"].max_links == 5 and loaded["pages"][1]["tag"] == "api"
    assert config.network_context({"CI": "1"}) == "ci" and config.network_context({}) == "developer-machine"


def test_sitemap_walk(spark):
    pages = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    rows = [
        row("https://a.io/robots.txt", "User-agent: *\nSitemap: https://a.io/s.xml\n"),
        row("https://a.io/s.xml", "<sitemapindex><sitemap><loc>https://a.io/1.xml</loc></sitemap><sitemap><loc>https://a.io/2.xml.gz</loc></sitemap><sitemap><loc>https://a.io/3.xml</loc></sitemap></sitemapindex>"),
        row("https://a.io/1.xml", pages("https://a.io/d/a", "https://b.io/d/x", "https://www.a.io/d/b")),
        row("https://a.io/3.xml", pages("https://a.io/d/a", "https://a.io/other", "https://a.io/d/c")),
    ]
    capture = spark.createDataFrame(rows, C.SCHEMA)
    roots = indexes.robots_sitemaps(capture.filter("url like '%robots.txt'"))
    got = indexes.walk_sitemaps(capture, roots, prefix="/d")
    assert [r["url"] for r in got.orderBy("ordinal").collect()] == ["https://a.io/d/a", "https://www.a.io/d/b", "https://a.io/d/c"]
    assert indexes.walk_sitemaps(capture, roots, prefix="/d", most=1).count() == 1


def test_index_walk(spark):
    rows = [
        row("https://a.io/llms.txt", "# A\n[sub](https://a.io/sub.txt) [p](https://a.io/p.md) [self](https://a.io/llms.txt)", kind="text/plain"),
        row("https://a.io/sub.txt", "[q](https://a.io/q.md) [deep](https://a.io/x/deep.txt) [p](https://a.io/p.md)", kind="text/plain"),
    ]
    capture = spark.createDataFrame(rows, C.SCHEMA)
    runs = spark.createDataFrame([("r", "https://a.io")], "run_id string, base_url string")
    out = indexes.walk_indexes(indexes.llms_txt_files(runs, capture), capture)
    assert sorted((r["url"], r["original_md"]) for r in out["pages"].collect()) == [("https://a.io/p", "https://a.io/p.md"), ("https://a.io/q", "https://a.io/q.md")]
    assert [r["url"] for r in out["omitted"].collect()] == ["https://a.io/x/deep.txt"]


def test_http_source(spark):
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/old":
                self.send_response(301)
                self.send_header("Location", "/new")
                self.end_headers()
                return
            self.send_response(200 if self.path == "/new" else 404)
            self.send_header("Content-Type", "text/markdown" if self.headers.get("Accept") == "text/markdown" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("é".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(C.HttpSource)
    read = lambda **o: {r["url"].removeprefix(base): r for r in spark.read.format("quillmap_http").options(delay_ms=0, timeout_ms=3000, urls=json.dumps([base + "/old", base + "/gone", "http://127.0.0.1:1/"]), **o).load().collect()}
    got = read()
    assert (got["/old"]["status"], got["/old"]["final_url"], got["/old"]["body"], got["/old"]["redirected"]) == (200, base + "/new", "é", True)
    assert got["/gone"]["status"] == 404 and got["http://127.0.0.1:1/"]["outcome"] == "fetch-error"
    manual = read(redirect="manual", accept="text/markdown")
    assert manual["/old"]["status"] == 301 and manual["/old"]["headers"]["location"] == "/new"
    server.shutdown()
    assert [C.usable_retry_after(x) for x in ("5", "0", "61", "x", None)] == [5, None, None, None, None]


def test_record_and_audit_a_served_site(spark, tmp_path, capsys):
    """A site on a local port: recorded, recorded again without new requests, and audited from the command line."""
    import http.server
    import threading

    from quillmap.__main__ import main

    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def answer(self, send_body):
            asked.append((self.command, self.path))
            base = f"http://127.0.0.1:{self.server.server_port}"
            path, number = self.path.split("?")[0], self.path.removeprefix("/p").removesuffix(".md")
            md = f"[index]({base}/llms.txt)\n\n# Page {number}\n\n" + "\n\n".join(PROSE + f"{number}{i}" for i in range(12))
            body, kind, status = "not found", "text/plain", 404
            if path == "/llms.txt":
                body, kind, status = "# Site\n\n> Docs\n\n## Pages\n\n" + "\n".join(f"- [P{k}]({base}/p{k}.md)" for k in range(6)), "text/plain", 200
            elif number in "0 1 2 3 4 5 6".split():
                status = 200
                if path.endswith(".md") or self.headers.get("Accept") == "text/markdown":
                    body, kind = md, "text/markdown"
                else:
                    body, kind = page(number), "text/html"
            elif path == "/sitemap.xml":
                body, kind, status = "<urlset>" + "".join(f"<url><loc>{base}/p{k}</loc></url>" for k in range(7)) + "</urlset>", "application/xml", 200
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Cache-Control", "max-age=60")
            self.end_headers()
            if send_body:
                self.wfile.write(body.encode())

        def do_GET(self):
            self.answer(True)

        def do_HEAD(self):
            self.answer(False)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, path = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "capture")
    runs = spark.createDataFrame([("r", base)], "run_id string, base_url string")
    quick = {"delay_ms": "0"}
    sample = crawl.record(spark, runs, path, Options(), settings=quick)
    assert {r["url"] for r in sample.collect()} == {f"{base}/p{k}" for k in range(7)}
    before = len(asked)
    crawl.Recorder(spark, runs, path, Options(), quick).representations(sample)
    assert len(asked) == before
    server.shutdown()
    assert main([path, base, "--format", "text", "--fixes", "--checks", "llms-txt-exists,llms-txt-links-resolve,markdown-url-support,llms-txt-coverage"]) == 0
    text = capsys.readouterr().out
    assert "llms-txt-exists: an llms.txt file was found" in text and "7 pages tested (random)" in text and "0 fail" in text


def test_missing_url_and_rewrite(spark):
    df = spark.createDataFrame([("https://a.io/x/#t", 'go to https://c.io/y and https://c.io.evil/z "https://c.io"')], "u string, b string")
    got = df.select(missing_url(F.col("u")).alias("m"), C.rewrite_origin(F.col("b"), "https://c.io", "http://local$1").alias("r")).first()
    assert got["m"] == "https://a.io/x-quillmap-missing-page"
    assert got["r"] == 'go to http://local$1/y and https://c.io.evil/z "http://local$1"'
