"""One case per outcome of links, continuations and Markdown forms, and rows of checks that are left out."""

from pyspark.sql import functions as F

from quillmap.dims import Options
from quillmap.plans import engine
from quillmap.plans.checks import REGISTRY, Tables
from quillmap.sources import capture as C
from tests.test_audit import BASE, NOW, PROSE, row


def changed(r, **fields):
    names = [x.split()[0] for x in C.SCHEMA.replace("map<string,string>", "map").split(", ")]
    values = dict(zip(names, r)) | fields
    return tuple(values[n] for n in names)


def tables(spark, rows, pages):
    capture = spark.createDataFrame(rows, C.SCHEMA)
    runs = spark.createDataFrame([("r", BASE)], "run_id string, base_url string")
    pages = spark.createDataFrame([("r", k, u, f"{u}.md") for k, u in enumerate(pages)], "run_id string, ordinal long, url string, original_md string")
    return Tables(runs, pages, capture)


def prose(text):
    return f"# Title\n\n{PROSE * 3}\n\n{text}\n"


def test_links_by_outcome(spark):
    answers = {
        "ok": ("a.md", row(f"{BASE}/ok.md", prose("x"), kind="text/markdown")), "http-error": ("", row(f"{BASE}/http-error.md", "gone", status=404)), "empty": ("", row(f"{BASE}/empty.md", " \n", kind="text/markdown")),
        "soft-404": ("", row(f"{BASE}/soft-404.md", "# Page not found\n\nSorry", kind="text/markdown")), "not-markdown": ("", row(f"{BASE}/not-markdown.md", "<!DOCTYPE html><html><body>x</body></html>", kind="text/html")),
        "json": ("", row(f"{BASE}/json.md", '{"a": [1]}', kind="application/json")), "fetch-error": ("", changed(row(f"{BASE}/fetch-error.md", ""), status=None, error="ECONNRESET", outcome="fetch-error")),
        "html-redirect": ("", changed(row(f"{BASE}/html-redirect.md", "<!DOCTYPE html><html><body>x</body></html>"), redirected=True, final_url=f"{BASE}/elsewhere")),
        "shell-redirect": ("", changed(row(f"{BASE}/shell-redirect.md", "<!DOCTYPE html><html><body>x</body></html>"), redirected=True, final_url=f"{BASE}/other.md")),
        "plain": ("", row(f"{BASE}/plain.md", prose("x"), kind="application/octet-stream")), "unknown": ("", None),
    }
    rows = [r for _, r in answers.values() if r]
    for name in answers:
        rows += [row(f"{BASE}/p-{name}", "<html><body>x</body></html>"), row(f"{BASE}/p-{name}.md", prose(f"[link]({BASE}/{name}.md)"), kind="text/markdown")]
    t = tables(spark, rows, [f"{BASE}/p-{name}" for name in answers])
    got = {r["url"].rsplit("/p-")[1]: r for r in REGISTRY["markdown-link-portability"](t, Options()).collect()}
    fault = lambda name: [f["outcome"] for f in got[name]["faults"] or []]
    for name in ("http-error", "empty", "soft-404", "not-markdown", "fetch-error"):
        assert fault(name) == [name] and got[name]["status"] == "fail" and got[name]["broken"], name
    for name in ("json", "shell-redirect"):
        assert fault(name) == ["not-markdown"] and got[name]["status"] == "fail"
    assert fault("html-redirect") == ["html-redirect"] and got["html-redirect"]["status"] == "warn"
    for name in ("ok", "plain", "unknown"):
        assert fault(name) == [] and got[name]["status"] == "pass", name
    t.release()


def test_continuations_by_outcome(spark):
    html = "<!DOCTYPE html><html><body><p>more</p></body></html>"
    next_ = {
        "ok": [row(f"{BASE}/n?page=2&k=ok", html), row(f"{BASE}/n?page=2&k=ok", prose("second"), kind="text/markdown", accept="text/markdown")],
        "not-markdown": [row(f"{BASE}/n?page=2&k=not-markdown", html, accept="text/markdown")], "binary": [row(f"{BASE}/n?page=2&k=binary", "\x01\x02", kind="application/pdf")],
        "http-error": [row(f"{BASE}/n?page=2&k=http-error", "x", status=500)], "empty": [row(f"{BASE}/n?page=2&k=empty", "  ", kind="text/plain")],
        "soft-404": [row(f"{BASE}/n?page=2&k=soft-404", "# 404 - not found", kind="text/markdown")], "fetch-error": [],
        "same-content": [row(f"{BASE}/n?page=2&k=same-content", prose(f"[next page]({BASE}/n?page=2&k=same-content)"), kind="text/markdown")],
    }
    rows = [r for some in next_.values() for r in some]
    for name in next_:
        rows += [row(f"{BASE}/p-{name}", html), row(f"{BASE}/p-{name}.md", prose(f"[next page]({BASE}/n?page=2&k={name})"), kind="text/markdown")]
    t = tables(spark, rows, [f"{BASE}/p-{name}" for name in next_])
    got = {r["url"].rsplit("/p-")[1]: r for r in REGISTRY["single-fetch-completeness"](t, Options()).collect()}
    for name in next_:
        want = "not-markdown" if name == "binary" else name
        assert (got[name]["outcome"], got[name]["status"]) == (want, "pass" if name == "ok" else "fail"), name
    t.release()


def test_markdown_forms_of_linked_pages(spark):
    index = "# T\n\n> t\n\n" + "\n".join(f"- [{x}]({BASE}/{x})" for x in ("a.md", "negotiated", "second", "html", "full.txt"))
    rows = [row(f"{BASE}/llms.txt", index, kind="text/plain")]
    rows += [row(f"{BASE}/negotiated", "", method="HEAD"), row(f"{BASE}/negotiated", "", kind="text/markdown; charset=utf-8", method="HEAD", accept="text/markdown")]
    rows += [row(f"{BASE}/second", "", method="HEAD"), row(f"{BASE}/second.md", "", status=404, method="HEAD"), row(f"{BASE}/second/index.md", "", method="HEAD")]
    rows += [row(f"{BASE}/html", "", method="HEAD"), row(f"{BASE}/html.md", "", status=404, method="HEAD"), row(f"{BASE}/full.txt", "", kind="text/plain", method="HEAD"), row(f"{BASE}/full.txt", prose("[x](y)"), kind="text/plain")]
    t = tables(spark, rows, [f"{BASE}/negotiated"])
    got = {r["url"].removeprefix(f"{BASE}/"): r["status"] for r in REGISTRY["llms-txt-links-markdown"](t, Options()).collect()}
    assert got == {"a.md": "pass", "negotiated": "pass", "second": "warn", "html": "fail", "full.txt": "pass"}
    t.release()


def test_checks_left_out_have_rows(spark):
    t = tables(spark, [row(f"{BASE}/llms.txt", "# T\n\n> t\n\n## A\n\n[a](https://docs.acme.io/a.md)", kind="text/plain")], [f"{BASE}/a"])
    out = engine.audit(t, Options(check_ids=("llms-txt-exists", "llms-txt-valid", "llms-txt-size"), skip_check_ids=("llms-txt-exists",)))
    got = {r["check_id"]: (r["status"], r["message"]) for r in out["results"].collect()}
    assert got["llms-txt-exists"] == ("skip", "llms-txt-exists: skipped by the options")
    # what depends on it runs as if it had never been asked for
    assert got["llms-txt-valid"][0] == "pass" and set(got) == {"llms-txt-exists", "llms-txt-valid", "llms-txt-size"}
    assert "llms-txt-exists" not in {r["check_id"] for r in out["check_scores"].collect()}
    t.release()


def test_coverage_leaves_out_omitted_subtrees(spark):
    """Pages below an index that is not walked count as listed, without a segment boundary."""
    rows = [row(f"{BASE}/llms.txt", f"# T\n\n> t\n\n[sub]({BASE}/sub/llms.txt) [home]({BASE}/home)", kind="text/plain"), row(f"{BASE}/sub/llms.txt", f"# S\n\n[deep]({BASE}/x/deep/llms.txt) [a]({BASE}/sub/a.md)", kind="text/plain")]
    t = tables(spark, rows, [f"{BASE}/home"])
    t.sitemap = spark.createDataFrame([("r", f"{BASE}{p}") for p in ("/home", "/sub/a", "/x/deep/b", "/x/deeper", "/x", "/y")], "run_id string, url string")
    got = {r["url"].removeprefix(BASE): r["status"] for r in REGISTRY["llms-txt-coverage"](t, Options()).collect()}
    assert got == {"/home": "pass", "/sub/a": "pass", "/x/deep/b": "pass", "/x/deeper": "pass", "/x": "fail", "/y": "fail"}
    t.release()
