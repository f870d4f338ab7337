"""python -m quillmap CAPTURE BASE_URL [--record] [--format json|text|scorecard] [--fixes] [--verbose] [--config FILE]: audit a
recorded capture; with --record, fetch what it lacks first."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from quillmap.dims import Options
from quillmap.functions import url as U
from quillmap.plans import engine, reports
from quillmap.plans.checks import Tables
from quillmap.session import session
from quillmap.sources import capture as C
from quillmap.sources import crawl, discovery, indexes
from quillmap.sources.config import find_config, load_config, network_context


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillmap")
    parser.add_argument("capture", help="Parquet table of captured responses")
    parser.add_argument("base_url", nargs="?", help="base URL of the site (default: from the configuration)")
    parser.add_argument("--format", choices=["json", "text", "scorecard"], default="text")
    parser.add_argument("--fixes", action="store_true", help="say what to do about warnings and failures")
    parser.add_argument("--verbose", action="store_true", help="list the pages that did not pass")
    parser.add_argument("--config", help="configuration (default: the nearest one above the working folder)")
    parser.add_argument("--checks", default="")
    parser.add_argument("--skip-checks", default="")
    parser.add_argument("--urls", default="", help="pages to test instead of discovered ones")
    parser.add_argument("--record", action="store_true", help="fetch what the capture lacks")
    parser.add_argument("--sampling", choices=["random", "deterministic", "curated", "none"])
    args = parser.parse_args(argv)
    path = args.config or find_config(Path.cwd())
    config, errors = load_config(path) if path else ({"url": None, "pages": [], "options": Options()}, [])
    options = config.get("options") or Options()
    split = lambda x: tuple(filter(None, x.split(",")))
    options = replace(options, check_ids=split(args.checks) or options.check_ids, skip_check_ids=split(args.skip_checks) or options.skip_check_ids)
    listed = [{"url": u, "tag": None} for u in split(args.urls)] or config.get("pages") or []
    options = replace(options, sampling_strategy=args.sampling or ("curated" if listed else options.sampling_strategy))
    url = args.base_url or config.get("url") or (listed[0]["url"] if listed else None)
    errors = [e for e in errors if e != "neither url nor pages" or not url] + options.validate(pages=bool(listed))
    if errors or not url:
        print("\n".join(errors or ["a base URL is needed"]), file=sys.stderr)
        return 2
    for name in options.overlap():
        print(f"{name} is both asked for and skipped: it is skipped", file=sys.stderr)
    spark = session()
    base = spark.range(1).select(U.canonical_base(U.with_scheme(F.lit(url))).alias("u")).first()["u"]
    each = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(p["url"]).alias("url"), F.lit(p["tag"]).cast("string").alias("tag")) for k, p in enumerate(listed)]) if listed else None
    pages_of = lambda runs: runs.select("run_id", F.inline(each)) if listed else None
    if args.record:
        port = urlsplit(base).port
        if port is not None and str(port) in C.BLOCKED_PORTS.split():
            print(C.blocked_port_message(port), file=sys.stderr)
            return 2
        one = spark.createDataFrame([("run", base)], "run_id string, base_url string")
        crawl.record(spark, one, args.capture, options, pages_of(one))
    captured = C.read_capture(spark, args.capture, options.canonical_origin, base)
    runs = captured.select("run_id").distinct().withColumn("base_url", F.lit(base))
    files = indexes.llms_txt_files(runs, captured, options.llms_txt_url)
    runs = discovery.with_effective_origin(runs, files)
    pages, found = discovery.sampled_pages(runs, captured, files, options, pages_of(runs))
    tables = Tables(runs, pages, captured, C.ledger(captured), options=options)
    tables.pages = tables.once("pages", lambda: pages)
    tables.events = tables.once("events", lambda: tables.events)
    try:
        out = engine.audit(tables, options, found.warnings, lambda e: print(reports.progress_line(e), file=sys.stderr), context=network_context())
        for row in found.warnings.toLocalIterator():
            print(f"warning: {row['warning']}", file=sys.stderr)
        for row in reports.json_report(out).toLocalIterator():
            print({"json": lambda r: r, "text": lambda r: reports.text_report(r, args.fixes, args.verbose), "scorecard": reports.scorecard}[args.format](row["report"]))
        return reports.exit_status(out["results"])
    finally:
        tables.release()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
