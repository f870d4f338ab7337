"""The checks of an audit over captured responses.

Inputs are a `Tables` of DataFrames, each with run_id: runs(run_id, base_url), pages(run_id, ordinal, url, original_md, and
maybe tag), capture (see sources.capture), events (the request ledger). A check returns items: one row per page, file or
endpoint with run_id, url, status (pass, warn, fail, skip) and what it measured; `items` brings those of any check into one
form. Rules.py turns counts of items into verdicts.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.dims import CHECKS, Options
from quillmap.functions import text as T
from quillmap.functions import udf
from quillmap.functions import url as U
from quillmap.operators import joins as J
from quillmap.operators import ledger as L
from quillmap.operators import locales as LO
from quillmap.operators import structure as S
from quillmap.plans import rules
from quillmap.session import new_folder, remove_folder, stored
from quillmap.sources import discovery as D
from quillmap.sources import indexes as I
from quillmap.sources.capture import content_type, header, variant

c = F.col


@dataclass
class Tables:
    """What an audit reads. Tables that several checks read are written to a folder of their own in the shared folder, so
    that they survive lost executors and are read by column; `release` removes it."""

    runs: DataFrame
    pages: DataFrame
    capture: DataFrame
    events: DataFrame | None = None
    sitemap: DataFrame | None = None
    options: Options = Options()
    memo: dict[str, DataFrame] = field(default_factory=dict)
    folder: str | None = None
    lock: Any = field(default_factory=threading.RLock)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several checks read, made once."""
        with self.lock:
            if name not in self.memo:
                self.memo[name] = stored(make(), f"{self.place()}/{name}")
            return self.memo[name]

    def place(self) -> str:
        if self.folder is None:
            self.folder = new_folder(self.runs.sparkSession, "audit")
        return self.folder

    def release(self) -> None:
        if self.folder is not None:
            remove_folder(self.runs.sparkSession, self.folder)
            self.memo, self.folder = {}, None

    def failures(self) -> DataFrame:
        """(run_id, url, code, error): pages whose plain response is missing or an error."""

        def make() -> DataFrame:
            got = variant(self.capture).select("run_id", "url", c("status").alias("code"), c("error").alias("_e")).dropDuplicates(["run_id", "url"])
            rows = self.pages.select("run_id", "url").distinct().join(got, ["run_id", "url"], "left")
            return rows.filter(c("code").isNull() | (c("code") >= 400) | c("_e").isNotNull()).select("run_id", "url", "code", F.coalesce("_e", F.concat(F.lit("HTTP "), c("code").cast("string")), F.lit("no response")).alias("error"))

        return self.once("failures", make)

    def html(self) -> DataFrame:
        """Pages with their plain response, and all figures of the parsers in one pass."""

        def make() -> DataFrame:
            rows = self.pages.select("run_id", "ordinal", "url").join(variant(self.capture), ["run_id", "url"])
            ok = rows.filter((c("status") < 400) & c("error").isNull()).select("run_id", "ordinal", "url", "body", "bytes", "headers")
            return ok.withColumn("m", udf.page_metrics(c("body")))

        return self.once("html", make)

    def files(self) -> DataFrame:
        return self.once("files", lambda: I.llms_txt_files(self.runs, self.capture, self.options.llms_txt_url))

    def analysed_files(self) -> DataFrame:
        """The canonical file of each run, or all its files."""
        return self.once("analysed", lambda: I.files_for_analysis(self.files(), self.runs))

    def sites(self) -> DataFrame:
        """runs with effective_origin."""
        return self.once("sites", lambda: D.with_effective_origin(self.runs, self.files()))

    def markdown(self) -> DataFrame:
        """Pages with their Markdown."""
        return self.once("markdown", lambda: markdown_pages(self))


def markdown_pages(t: Tables) -> DataFrame:
    """Pages with their Markdown: the first candidate URL that serves it, else the negotiated response."""
    pages = t.pages.select("run_id", "ordinal", "url", "original_md")
    none = F.array().cast("array<string>")
    told = F.when(c("original_md").isNotNull(), F.array("original_md")).otherwise(none)
    parent = U.parent_markdown(c("url"), c("original_md"))
    urls = F.array_distinct(F.concat(told, F.when(parent.isNotNull(), F.array(parent)).otherwise(none), U.markdown_candidates(c("url"))))
    tries = pages.select("run_id", "ordinal", "url", F.posexplode(urls).alias("rank", "md_url"))
    got = variant(t.capture).filter("status = 200").select("run_id", c("url").alias("md_url"), "body", "headers")
    link = header("link").alias("link")
    direct = tries.join(got, ["run_id", "md_url"]).filter(is_markdown_response()).select("run_id", "ordinal", "url", "rank", "md_url", "body", F.lit("md-url").alias("source"), link)
    asked = variant(t.capture, accept="text/markdown").filter("status = 200").select("run_id", "url", "body", "headers")
    asked = pages.join(asked, ["run_id", "url"]).filter(is_markdown_response() & ~T.soft_404(c("body")))
    asked = asked.select("run_id", "ordinal", "url", F.lit(99).alias("rank"), c("url").alias("md_url"), "body", F.lit("negotiated").alias("source"), link)
    both = direct.unionByName(asked)
    best = both.groupBy("run_id", "url").agg(F.min_by(F.struct("ordinal", "md_url", "body", "source", "link"), "rank").alias("b"))
    return best.select("run_id", "url", "b.*")


def linked_markdown(t: Tables) -> DataFrame:
    """Markdown that llms.txt links lead to, for runs whose pages have none: links with a Markdown extension first, max_links
    at most, in the form of markdown_pages."""
    have = t.markdown().select("run_id").distinct()
    rows = I.file_links(t.analysed_files()).groupBy("run_id", "fetch").agg(F.min(F.struct("ordinal", "offset")).alias("_o")).join(have, "run_id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy((~U.is_markdown(c("fetch"))), "_o"))
    rows = rows.withColumn("ordinal", turn.cast("long")).filter(c("ordinal") <= t.options.max_links)
    got = variant(t.capture).filter("status = 200").select("run_id", c("url").alias("fetch"), "body", "headers")
    rows = rows.join(got, ["run_id", "fetch"]).filter(is_markdown_response())
    return rows.select("run_id", c("fetch").alias("url"), "ordinal", c("fetch").alias("md_url"), "body", F.lit("llms-txt").alias("source"), header("link").alias("link"))


def is_markdown_response() -> Column:
    return F.startswith(content_type(), F.lit("text/markdown")) | T.looks_markdown(c("body"))


Check = Callable[[Tables, Options], DataFrame]
REGISTRY: dict[str, Check] = {}


def check(name: str) -> Callable[[Check], Check]:
    if name not in CHECKS:
        raise ValueError(f"unknown check {name}")

    def keep(f: Check) -> Check:
        REGISTRY[name] = f
        return f

    return keep


def order_of(*pairs: tuple[Column, str], otherwise: str) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


# ------------------------------------------------------------------------------------------------ content discoverability
@check("llms-txt-exists")
def llms_txt_exists(t: Tables, o: Options) -> DataFrame:
    found = t.files().groupBy("run_id").agg(F.count("*").alias("files"), F.bool_and("cross_host").alias("cross"))
    rows = t.runs.join(found, "run_id", "left")
    return rows.select("run_id", c("base_url").alias("url"), order_of((c("files").isNull(), "fail"), (c("cross"), "warn"), otherwise="pass").alias("status"), F.coalesce("files", F.lit(0)).alias("files"))


def file_structure(body: Column) -> dict[str, Column]:
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x != "")
    return {
        "has_h1": F.coalesce(F.get(lines, F.lit(0)).rlike(r"^#\s+\S"), F.lit(False)),
        "has_quote": F.exists(lines, lambda x: F.startswith(x, F.lit("> "))),
        "headings": F.size(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+\S"))),
        "link_count": F.size(F.regexp_extract_all(body, F.lit(r"\[[^\]]+\]\([^)]+\)"), F.lit(0))),
    }


@check("llms-txt-valid")
def llms_txt_valid(t: Tables, o: Options) -> DataFrame:
    rows = t.files().withColumns(file_structure(c("body")))
    full = c("has_h1") & c("has_quote") & (c("headings") > 1) & (c("link_count") > 0)
    return rows.select("run_id", "url", "has_h1", "has_quote", "headings", "link_count", order_of((full, "pass"), (c("link_count") > 0, "warn"), otherwise="fail").alias("status"))


@check("llms-txt-size")
def llms_txt_size(t: Tables, o: Options) -> DataFrame:
    n = T.utf16_length(c("body"))
    return t.files().select("run_id", "url", n.alias("characters"), F.octet_length("body").alias("bytes"), T.status_of(n, o.size_limits, inclusive=True).alias("status"))


def _links(t: Tables, o: Options) -> DataFrame:
    """Distinct links of the files, a seeded sample of each origin class, with what HEAD (or GET after 405) said."""

    def make() -> DataFrame:
        base = t.runs.select("run_id", U.origin(c("base_url")).alias("_o"))
        rows = I.file_links(t.analysed_files()).groupBy("run_id", "fetch").agg(F.min("offset").alias("offset")).join(base, "run_id")
        rows = rows.withColumn("same_origin", U.origin(c("fetch")) == c("_o"))
        w = Window.partitionBy("run_id", "same_origin").orderBy(F.md5(F.concat(F.lit(f"{o.seed}:"), c("fetch"))))
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") <= o.max_links)
        of = lambda m: variant(t.capture, method=m).select("run_id", c("url").alias("fetch"), c("status").alias(f"_{m}"), content_type().alias(f"_{m}_type"), c("body").alias(f"_{m}_body"))
        asked = variant(t.capture, method="HEAD", accept="text/markdown").select("run_id", c("url").alias("fetch"), content_type().alias("_asked_type"))
        rows = rows.join(of("HEAD").drop("_HEAD_body"), ["run_id", "fetch"], "left").join(of("GET"), ["run_id", "fetch"], "left").join(asked, ["run_id", "fetch"], "left")
        return rows.withColumn("code", F.when(c("_HEAD").isNull() | (c("_HEAD") == 405), F.coalesce("_GET", "_HEAD")).otherwise(c("_HEAD")))

    return t.once("links", make)


@check("llms-txt-links-resolve")
def llms_txt_links_resolve(t: Tables, o: Options) -> DataFrame:
    ok = F.coalesce(c("code").between(200, 399), F.lit(False))
    return _links(t, o).select("run_id", c("fetch").alias("url"), "same_origin", "code", (~c("same_origin")).alias("external"), F.when(ok, "pass").otherwise("fail").alias("status"))


@check("llms-txt-links-markdown")
def llms_txt_links_markdown(t: Tables, o: Options) -> DataFrame:
    rows = _links(t, o).filter("same_origin")
    # any form at a Markdown URL of the page counts, by HEAD or in full
    ok = t.capture.filter(c("method").isin("HEAD", "GET") & c("accept").isNull() & (c("redirect_mode") == "follow") & c("status").between(200, 299)).select("run_id", c("url").alias("_md")).distinct()
    forms = rows.select("run_id", "fetch", F.explode(U.markdown_candidates(c("fetch"))).alias("_md")).join(ok, ["run_id", "_md"]).select("run_id", "fetch").distinct()
    rows = rows.join(forms.withColumn("_variant", F.lit(True)), ["run_id", "fetch"], "left")
    typed = F.contains(F.coalesce("_asked_type", F.lit("")), F.lit("text/markdown")) | F.startswith(F.coalesce("_HEAD_type", F.lit("")), F.lit("text/markdown"))
    served = U.path(c("fetch")).rlike(r"\.mdx?$") | typed
    text = U.path(c("fetch")).rlike(r"(?i)\.txt$") & F.coalesce(T.looks_markdown(c("_GET_body")), F.lit(False))
    return rows.select("run_id", c("fetch").alias("url"), "code", order_of((served | text, "pass"), (c("_variant"), "warn"), otherwise="fail").alias("status"))


def _directive(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_d", T.directive(c("body")))
    at = F.try_divide(c("_d.position"), c("_d.length"))
    return rows.select("run_id", "url", c("_d").isNotNull().alias("found"), at.alias("position"), F.coalesce(at <= 0.1, F.lit(False)).alias("near"), order_of((c("_d").isNull(), "fail"), (at > 0.5, "warn"), otherwise="pass").alias("status"))


@check("llms-txt-directive-html")
def directive_html(t: Tables, o: Options) -> DataFrame:
    return _directive(t.html())


@check("llms-txt-directive-md")
def directive_md(t: Tables, o: Options) -> DataFrame:
    return _directive(t.markdown())


# ------------------------------------------------------------------------------------------------ Markdown availability
@check("markdown-url-support")
def markdown_url_support(t: Tables, o: Options) -> DataFrame:
    have = t.markdown().filter("source = 'md-url'").select("run_id", "url", F.lit(True).alias("_y"))
    first = U.markdown_candidates(c("url"))[0]
    got = variant(t.capture).select("run_id", c("url").alias("_md"), c("status").alias("code"), "error").dropDuplicates(["run_id", "_md"])
    rows = t.pages.filter(~U.is_non_page(c("url"))).join(have, ["run_id", "url"], "left").withColumn("_md", F.coalesce("original_md", first)).join(got, ["run_id", "_md"], "left")
    return rows.select("run_id", "url", "code", "error", F.when(c("_y"), "pass").otherwise("fail").alias("status"))


@check("content-negotiation")
def content_negotiation(t: Tables, o: Options) -> DataFrame:
    rows = t.pages.join(variant(t.capture, accept="text/markdown"), ["run_id", "url"])
    typed, md = F.startswith(content_type(), F.lit("text/markdown")), T.looks_markdown(c("body"))
    kind = order_of((T.soft_404(c("body")), "html"), (typed & (md | ~T.looks_html(c("body"))), "markdown-with-correct-type"), (md, "markdown-with-wrong-type"), otherwise="html")
    rows = rows.select("run_id", "url", c("status").alias("code"), kind.alias("classification"))
    return rows.withColumn("status", order_of((c("classification") == "markdown-with-correct-type", "pass"), (c("classification") == "html", "fail"), otherwise="warn"))


# ------------------------------------------------------------------------------------------------ page size
@check("rendering-strategy")
def rendering_strategy(t: Tables, o: Options) -> DataFrame:
    return t.html().select("run_id", "url", c("m.status").alias("status"), c("m.spa_marker").alias("spa_marker"), c("m.visible").alias("visible"))


@check("page-size-markdown")
def page_size_markdown(t: Tables, o: Options) -> DataFrame:
    n = T.utf16_length(c("body"))
    return t.markdown().select("run_id", "url", "md_url", "source", n.alias("characters"), T.status_of(n, o.size_limits).alias("status"))


@check("page-size-html")
def page_size_html(t: Tables, o: Options) -> DataFrame:
    n = T.utf16_length(c("m.markdown"))
    waste = T.js_round(F.try_divide(100 * (c("m.length") - n), c("m.length")))
    return t.html().select("run_id", "url", n.alias("converted"), waste.alias("boilerplate_percent"), T.status_of(n, o.size_limits).alias("status"))


@check("page-size-transfer")
def page_size_transfer(t: Tables, o: Options) -> DataFrame:
    ratio = F.try_divide(c("bytes"), F.length("m.markdown"))
    return t.html().select("run_id", "url", "bytes", ratio.alias("ratio"), (ratio >= 20).alias("payload_heavy"), T.status_of(c("bytes"), o.transfer_limits).alias("status"))


@check("content-start-position")
def content_start_position(t: Tables, o: Options) -> DataFrame:
    rows = t.html().withColumn("_s", udf.content_start(c("m.markdown")))
    percent = F.coalesce(T.js_round(F.try_divide(100 * c("_s"), F.length("m.markdown"))), F.lit(0))
    return rows.select("run_id", "url", percent.alias("percent"), order_of((percent <= 10, "pass"), (percent <= 50, "warn"), otherwise="fail").alias("status"))


def _paged(t: Tables) -> DataFrame:
    return t.once("paged", lambda: t.markdown().unionByName(t.once("linked", lambda: linked_markdown(t))).withColumn("_p", udf.pagination(c("body"), c("md_url"), c("link"))))


@check("single-fetch-completeness")
def single_fetch_completeness(t: Tables, o: Options) -> DataFrame:
    n = F.length("body")
    top = F.least(F.lit(5000), F.greatest(F.lit(1000), F.floor(n / 10)))
    first = F.get(F.filter("_p.signals", lambda s: s["url"] == c("_p.continuation")), F.lit(0))
    rows = _paged(t).withColumn("_first", first).withColumn("_top", top)
    rows = rows.withColumn("_target", F.regexp_replace(udf.resolved(c("_p.continuation"), c("md_url")), "#.*$", ""))
    # asked for as Markdown unless its URL says so already; a capture without that request has the plain one
    answer = ["run_id", c("url").alias("_target"), F.struct("status", content_type().alias("type"), "body", "error", "outcome")]
    plain = variant(t.capture).select(*answer[:2], answer[2].alias("_plain"))
    asked = variant(t.capture, accept="text/markdown").select(*answer[:2], answer[2].alias("_asked"))
    rows = rows.join(plain, ["run_id", "_target"], "left").join(asked, ["run_id", "_target"], "left")
    got = F.when(U.is_markdown(c("_target")), c("_plain")).otherwise(F.coalesce("_asked", "_plain"))
    rows = rows.withColumn("_got", got)
    said, kind = c("_got.body"), c("_got.type")
    textual = (kind == "") | F.startswith(kind, F.lit("text/")) | F.contains(kind, F.lit("markdown"))
    html = F.contains(kind, F.lit("text/html")) | T.looks_html(said)
    failed = c("_got.error").isNotNull() | c("_got.status").isNull()
    outcome = order_of(
        (c("_p.continuation").isNull(), None), (c("_target").isNull(), "unresolvable"), (c("_got").isNull() | failed, "fetch-error"), (~c("_got.status").between(200, 299), "http-error"), (~said.rlike(r"\S"), "empty"),
        (html | (~textual & ~T.looks_markdown(said)), "not-markdown"), (T.soft_404(said), "soft-404"), (F.trim(said) == F.trim("body"), "same-content"), otherwise="ok",
    )
    rows = rows.withColumn("_outcome", outcome)
    broken = c("_outcome") != "ok"
    late = F.coalesce(c("_first.offset") > c("_top"), F.lit(True))
    relative = ~c("_p.continuation").rlike("(?i)^https?://")
    status = order_of((F.size("_p.signals") == 0, "pass"), (c("_p.continuation").isNull(), "fail"), (broken, "fail"), (late | relative, "warn"), otherwise="pass")
    return rows.select("run_id", "url", (F.size("_p.signals") > 0).alias("paginated"), c("_p.continuation").alias("continuation"), c("_outcome").alias("outcome"), status.alias("status"))


# ------------------------------------------------------------------------------------------------ content structure
def _panels(t: Tables) -> DataFrame:
    def make() -> DataFrame:
        # shells hold no tabs: their Markdown is looked at instead
        md = t.markdown().select("run_id", "url", c("body").alias("_md"))
        pages = t.html().select("run_id", "url", "body", (c("m.status") == "fail").alias("_shell")).join(md, ["run_id", "url"], "left")
        body = F.when(c("_shell") & c("_md").isNotNull(), c("_md")).otherwise(c("body"))
        return S.tab_panels(pages.select(F.concat_ws("\x1f", "run_id", "url").alias("url"), body.alias("html")))

    return t.once("panels", make)


def _split_key(df: DataFrame) -> DataFrame:
    parts = F.split("url", "\x1f")
    return df.withColumn("run_id", F.get(parts, F.lit(0))).withColumn("url", F.get(parts, F.lit(1)))


@check("tabbed-content-serialization")
def tabbed_content(t: Tables, o: Options) -> DataFrame:
    sized = _panels(t).withColumn("_n", F.length(udf.page_metrics(c("html"))["markdown"]))
    rows = _split_key(sized.groupBy("url").agg(F.sum("_n").alias("characters")))
    all_ = t.html().select("run_id", "url").join(rows, ["run_id", "url"], "left")
    n = F.coalesce("characters", F.lit(0))
    return all_.select("run_id", "url", n.alias("characters"), T.status_of(n, (50_000, 100_000), inclusive=True).alias("status"))


@check("section-header-quality")
def section_header_quality(t: Tables, o: Options) -> DataFrame:
    rows = _split_key(S.header_quality(_panels(t)))
    return rows.select("run_id", "url", "framework", "headers", "generic", c("cross_group").alias("crossed"), order_of((c("generic_majority"), "fail"), (c("cross_group"), "warn"), otherwise="pass").alias("status"))


@check("markdown-code-fence-validity")
def code_fences(t: Tables, o: Options) -> DataFrame:
    bodies = t.markdown().select("run_id", "url", "body").unionByName(t.files().select("run_id", "url", "body"))
    return bodies.withColumn("_f", udf.fences(c("body"))).select("run_id", "url", c("_f.count").alias("fences"), c("_f.open_line").alias("open_line"), c("_f.status").alias("status"))


#: What makes a link broken.
BROKEN = ("http-error", "empty", "soft-404", "not-markdown", "fetch-error")


def link_outcome() -> Column:
    """What verifying a link (fetch, _got) showed; null where the capture has no such request."""
    said, kind = c("_got.body"), F.trim(F.split_part(c("_got.type"), F.lit(";"), F.lit(1)))
    html = kind.isin("text/html", "application/xhtml+xml") | T.looks_html(said)
    text = F.startswith(kind, F.lit("text/")) | F.contains(kind, F.lit("markdown")) | (kind.isin("", "application/octet-stream") & T.looks_markdown(said))
    promised = U.is_markdown(c("fetch"))
    # a redirect that leads to an HTML page has the content, if not the form
    elsewhere = F.coalesce(c("_got.redirected"), F.lit(False)) & ~U.is_markdown(c("_got.final_url"))
    return order_of(
        (c("_got").isNull(), None), (c("_got.error").isNotNull() | c("_got.status").isNull(), "fetch-error"), (~c("_got.status").between(200, 299), "http-error"), (~said.rlike(r"\S"), "empty"), (T.soft_404(said), "soft-404"),
        (promised & html & elsewhere, "html-redirect"), (promised & (html | ~text), "not-markdown"), otherwise="ok",
    )


@check("markdown-link-portability")
def link_portability(t: Tables, o: Options) -> DataFrame:
    bodies = t.markdown().unionByName(t.once("linked", lambda: linked_markdown(t)))
    rows = bodies.select("run_id", "ordinal", "url", F.explode_outer(udf.links(c("body"), c("md_url"))).alias("l")).filter("l is null or not l.image")
    wanted = rows.filter("l.fetch is not null and not l.cross_origin").select("run_id", c("ordinal").alias("page_ordinal"), c("l.offset").cast("long").alias("offset"), c("l.fetch").alias("fetch"))
    plan = S.link_plan(wanted, o.max_links)
    got = variant(t.capture).select("run_id", c("url").alias("fetch"), F.struct("status", content_type().alias("type"), "body", "error", "redirected", "final_url").alias("_got"))
    tested = plan.join(got, ["run_id", "fetch"], "left").withColumn("_outcome", link_outcome())
    bad = tested.filter("_outcome <> 'ok'").groupBy("run_id", c("page_ordinal").alias("ordinal")).agg(
        F.bool_or(c("_outcome").isin(*BROKEN)).alias("_broken"), F.bool_or(c("_outcome") == "html-redirect").alias("_downgraded"),
        F.array_sort(F.collect_list(F.struct("fetch", c("_outcome").alias("outcome")))).alias("_faults"),  # as many as links are verified
    )
    of = lambda *k: F.count_if(c("l.class").isin(*k))
    per = rows.groupBy("run_id", "ordinal", "url").agg(of("path-relative").alias("path_relative"), of("root-relative", "protocol-relative").alias("root_relative"), F.count_if(c("l.unresolvable")).alias("unresolvable"))
    per = per.join(bad, ["run_id", "ordinal"], "left")
    fail = (c("path_relative") > 0) | (c("unresolvable") > 0) | F.coalesce("_broken", F.lit(False))
    warn = (c("root_relative") > 0) | F.coalesce("_downgraded", F.lit(False))
    return per.select("run_id", "url", "path_relative", "root_relative", "unresolvable", F.coalesce("_broken", F.lit(False)).alias("broken"), F.coalesce("_downgraded", F.lit(False)).alias("downgraded"), c("_faults").alias("faults"), order_of((fail, "fail"), (warn, "warn"), otherwise="pass").alias("status"))


@check("embedded-data-serialization")
def embedded_data(t: Tables, o: Options) -> DataFrame:
    size = T.status_of(T.utf16_length(c("m.markdown")), o.size_limits)
    rows = t.html().withColumn("_b", udf.bulk_data(c("m.markdown"), o.bulk_table_rows, o.bulk_blob_chars))
    dominant = c("_b.share") >= o.bulk_dominant_share
    # largest first, ten of them
    largest = F.slice(F.reverse(F.array_sort(F.transform("_b.elements", lambda e: F.struct(e["chars"].alias("chars"), -e["start"], e["kind"].alias("kind"), e["rows"].alias("rows"), e["share"].alias("share"))))), 1, 10)
    rows = rows.withColumn("_l", largest)
    what = lambda e: F.when(e["kind"] == "table", F.concat(F.lit("a table of "), e["rows"].cast("string"), F.lit(" rows"))).otherwise(F.concat(F.lit("a "), e["kind"], F.lit(" block")))
    told = F.transform("_l", lambda e: F.concat(what(e), F.lit(" ("), e["share"].cast("string"), F.lit(" %)")))
    return rows.select("run_id", "url", F.size("_b.elements").alias("elements"), told.alias("largest"), c("_b.share").alias("share"), F.when(dominant, size).otherwise("pass").alias("status"))


# ------------------------------------------------------------------------------------------------ URL stability
def missing_url(url: Column) -> Column:
    """A URL that no site should serve, beside a page."""
    return F.concat(U.origin(url), F.regexp_replace(U.path(url), "/$", ""), F.lit("-quillmap-missing-page"))


@check("http-status-codes")
def http_status_codes(t: Tables, o: Options) -> DataFrame:
    got = variant(t.capture).select("run_id", c("url").alias("_bad"), "status")
    rows = t.pages.select("run_id", "url", missing_url(c("url")).alias("_bad")).join(got, ["run_id", "_bad"])
    kind = order_of((c("status").between(400, 499), "correct-error"), ((c("status") == 202) | (c("status") >= 500), "indeterminate"), otherwise="soft-404")
    return rows.select("run_id", "url", kind.alias("classification")).withColumn("status", order_of((c("classification") == "soft-404", "fail"), (c("classification") == "correct-error", "pass"), otherwise="skip"))


def _resolved(url: Column, location: Column) -> Column:
    return F.when(location.rlike("(?i)^https?://"), location).when(F.startswith(location, F.lit("//")), F.concat(U.scheme(url), F.lit(":"), location)).otherwise(F.concat(U.origin(url), F.lit("/"), F.ltrim(location, F.lit("/"))))


@check("redirect-behavior")
def redirect_behavior(t: Tables, o: Options) -> DataFrame:
    rows = t.pages.select("run_id", "url").join(variant(t.capture, redirect="manual"), ["run_id", "url"]).withColumn("_to", header("location"))
    hop = c("status").between(300, 399) & c("_to").isNotNull()
    js = ~c("status").between(300, 399) & T.js_redirect(F.coalesce("body", F.lit("")))
    kind = order_of((js, "js-redirect"), (~hop, "no-redirect"), (U.cross_host(c("url"), _resolved(c("url"), c("_to"))), "cross-host"), otherwise="same-host")
    return rows.select("run_id", "url", kind.alias("classification")).withColumn("status", order_of((c("classification") == "js-redirect", "fail"), (c("classification") == "cross-host", "warn"), otherwise="pass"))


# ------------------------------------------------------------------------------------------------ observability
@check("llms-txt-coverage")
def llms_txt_coverage(t: Tables, o: Options) -> DataFrame:
    """One row per sitemap page in scope, of one locale where the site has several: pass if an llms.txt lists it."""
    walked = I.walk_indexes(t.analysed_files(), t.capture)
    links = t.once("listed", lambda: walked["pages"].select("run_id", "url", F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal")).alias("ordinal")))
    listed = links.select("run_id", U.coverage_path(c("url")).alias("path"), F.lit(True).alias("_y")).distinct()
    prefixes = walked["omitted"].select("run_id", U.omitted_prefix(c("url")).alias("prefix")).filter("prefix <> ''")

    def in_scope() -> DataFrame:
        if t.sitemap is not None:
            pages = t.sitemap
        else:
            walk = lambda docs: I.walk_sitemaps(t.capture, D.sitemap_roots(t.sites(), t.capture, docs), most=D.MOST_COVERAGE_PAGES)
            main = D.in_scopes(walk(False), D.scopes(t.sites(), o))
            # a site whose sitemap has none of the documentation may have one beside it
            pages = main.unionByName(walk(True).join(main.select("run_id").distinct(), "run_id", "left_anti"))
        pages = pages.withColumn("ordinal", F.monotonically_increasing_id()) if "ordinal" not in pages.columns else pages
        return D.in_scopes(pages.select("run_id", "ordinal", "url"), D.scopes(t.sites(), o)).filter(~U.is_non_page(c("url")))

    wish = t.runs.select("run_id", F.lit(o.preferred_locale).cast("string").alias("wanted"))
    pages = LO.coverage_scope(t.once("in_scope", in_scope), links, wish).withColumn("path", U.coverage_path(c("url"))).filter(~U.is_excluded_path(c("path")))
    if o.coverage_exclusions:
        pages = pages.filter(~U.matches_globs(c("path"), list(o.coverage_exclusions)))
    pages = pages.groupBy("run_id", "path").agg(F.min("url").alias("url")).join(listed, ["run_id", "path"], "left")
    # no segment boundary, as published; by equality of leading parts, so pages are not compared with every prefix
    pages = stored(pages, f"{t.place()}/coverage")
    omitted = J.below(pages.filter("_y is null"), prefixes, ["run_id"], segments=False).select("run_id", "path", F.lit(True).alias("_omitted"))
    pages = pages.join(omitted, ["run_id", "path"], "left")
    return pages.select("run_id", "url", F.when(c("_y") | c("_omitted"), "pass").otherwise("fail").alias("status"))


@check("markdown-content-parity")
def markdown_content_parity(t: Tables, o: Options) -> DataFrame:
    key = F.concat_ws("\x1f", "run_id", "url")
    paged = _paged(t).select("run_id", "url", (F.size("_p.signals") > 0).alias("paginated"))
    pages = t.html().select("run_id", "url", c("body").alias("html")).join(t.markdown().select("run_id", "url", c("body").alias("markdown")), ["run_id", "url"]).join(paged, ["run_id", "url"], "left")
    return _split_key(S.parity(pages.select(key.alias("url"), "html", "markdown", "paginated"), o.parity_limits, exclusions=o.parity_exclusions))


@check("cache-header-hygiene")
def cache_header_hygiene(t: Tables, o: Options) -> DataFrame:
    urls = t.pages.select("run_id", "url").unionByName(t.files().select("run_id", "url")).distinct()
    rows = urls.join(variant(t.capture), ["run_id", "url"]).filter("status < 400")
    status = T.cache_status(header("cache-control"), header("expires"), header("etag"), header("last-modified"), c("fetched_at"))
    return rows.select("run_id", "url", header("cache-control").alias("cache_control"), status.alias("status"))


# ------------------------------------------------------------------------------------------------ authentication
@check("auth-gate-detection")
def auth_gate_detection(t: Tables, o: Options) -> DataFrame:
    full = t.html().select("run_id", "url", c("m.substantive").alias("_s"))
    rows = t.pages.select("run_id", "url").join(variant(t.capture, redirect="manual"), ["run_id", "url"]).join(full, ["run_id", "url"], "left")
    to = _resolved(c("url"), header("location"))
    form = (c("status") == 200) & T.login_form(F.coalesce("body", F.lit("")), F.coalesce("_s", F.lit(False))).isNotNull()
    kind = order_of((c("status").isin(401, 403), "auth-required"), (c("status").between(300, 399) & T.sso_host(U.host(to)), "auth-redirect"), (form, "soft-auth-gate"), otherwise="accessible")
    return rows.select("run_id", "url", kind.alias("classification")).withColumn("status", order_of((c("classification") == "accessible", "pass"), (c("classification") == "soft-auth-gate", "warn"), otherwise="fail"))


@check("auth-alternative-access")
def auth_alternative_access(t: Tables, o: Options) -> DataFrame:
    gate = auth_gate_detection(t, o).groupBy("run_id").agg(F.count_if(c("classification") == "accessible").alias("open"), F.count("*").alias("n"))
    files = t.files().select("run_id").distinct().withColumn("_f", F.lit(True))
    md = t.markdown().select("run_id").distinct().withColumn("_m", F.lit(True))
    rows = t.runs.join(gate, "run_id").join(files, "run_id", "left").join(md, "run_id", "left")
    any_ = F.coalesce("_f", F.lit(False)) | F.coalesce("_m", F.lit(False)) | (c("open") > 0)
    status = order_of((c("open") == c("n"), "skip"), (~any_, "fail"), (F.coalesce("_m", F.lit(False)) | (2 * c("open") >= c("n")), "pass"), otherwise="warn")
    return rows.select("run_id", c("base_url").alias("url"), status.alias("status"))


@check("bot-protection-interference")
def bot_protection(t: Tables, o: Options) -> DataFrame:
    if t.events is None:
        return t.runs.select("run_id", c("base_url").alias("url"), F.lit("skip").alias("status"))
    return L.verdict(t.events).join(t.runs, "run_id").withColumn("url", c("base_url")).drop("base_url")


# ------------------------------------------------------------------------------------------------ items of any check
#: Checks over plain responses of pages: pages without one are items that failed to fetch.
OVER_PAGES = ("llms-txt-directive-html", "rendering-strategy", "page-size-html", "page-size-transfer", "content-start-position", "tabbed-content-serialization", "embedded-data-serialization")
ITEM = ("run_id", "check_id", "url", "status", "code", "error", "external", "near", "crossed", "details")


def items(name: str, t: Tables, o: Options) -> DataFrame:
    """The items of a check as (run_id, check_id, url, status, code, error, external, near, crossed, details), details in JSON."""
    rows = REGISTRY[name](t, o)
    kinds = {"code": "int", "error": "string", "external": "boolean", "near": "boolean", "crossed": "boolean"}
    more = [x for x in rows.columns if x not in ITEM]
    details = F.to_json(F.struct(*more)) if more else F.lit(None).cast("string")
    have = lambda k: c(k).cast(kinds[k]) if k in rows.columns else F.lit(None).cast(kinds[k])
    out = rows.select("run_id", F.lit(name).alias("check_id"), "url", "status", *[have(k).alias(k) for k in kinds], details.alias("details"))
    if name in OVER_PAGES:
        null = lambda k: F.lit(None).cast(k)
        lost = t.failures().select("run_id", F.lit(name).alias("check_id"), "url", F.lit("error").alias("status"), "code", "error", *[null("boolean").alias(k) for k in ("external", "near", "crossed")], null("string").alias("details"))
        out = out.unionByName(lost)
    return out.select(*ITEM)


def verdicts(name: str, rows: DataFrame, runs: DataFrame, o: Options) -> DataFrame:
    """Verdicts of one check from its own rows (see REGISTRY): one row per run, skip where there is nothing to test."""
    have = lambda k: c(k).cast("boolean") if k in rows.columns else F.lit(None).cast("boolean")
    slim = rows.select("run_id", F.lit(name).alias("check_id"), "status", *[have(k).alias(k) for k in ("external", "near", "crossed")])
    counts = runs.select("run_id", F.lit(name).alias("check_id")).join(rules.figures(slim), ["run_id", "check_id"], "left")
    return rules.verdicts(counts, o)
