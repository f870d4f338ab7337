"""Recording: the responses that an audit reads, fetched in a few rounds, each planned from what the rounds before brought.

The capture grows as a Parquet table; a request that it has already is not made again, so that an interrupted recording
goes on where it was. Rounds are plans over all sites at once; each host's requests are paced in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.dims import Options
from quillmap.functions import udf
from quillmap.functions import url as U
from quillmap.operators import structure as S
from quillmap.plans.checks import Tables, markdown_pages, missing_url
from quillmap.session import cut
from quillmap.sources import capture as C
from quillmap.sources import discovery, indexes

KEY = ["run_id", "url", "method", "accept", "redirect_mode"]


def _request(rows: DataFrame, url: Column | str = "url", method: str = "GET", accept: str | None = None, redirect: str = "follow") -> DataFrame:
    asked = (F.col(url) if isinstance(url, str) else url).alias("url")
    return rows.select("run_id", asked, F.lit(method).alias("method"), F.lit(accept).cast("string").alias("accept"), F.lit(redirect).alias("redirect_mode"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Recorder:
    """Appends to the capture at `path` what it lacks."""

    def __init__(self, spark: SparkSession, runs: DataFrame, path: str, options: Options, settings: dict | None = None):
        self.spark, self.runs, self.path, self.options = spark, runs, path, options
        self.settings = {"delay_ms": str(options.request_delay_ms), "timeout_ms": str(options.request_timeout_ms), "concurrency": str(options.max_concurrency)} | (settings or {})
        spark.createDataFrame([], C.SCHEMA).write.mode("append").parquet(path)

    def capture(self) -> DataFrame:
        return self.spark.read.schema(C.SCHEMA).parquet(self.path)

    def ask(self, requests: DataFrame) -> None:
        requests = requests.filter(F.col("url").rlike("(?i)^https?://")).withColumn("url", F.regexp_replace("url", "#.*$", "")).distinct()
        known = self.capture().select(*[F.col(k).alias(f"_{k}") for k in KEY])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        # planned before it runs: what is appended does not feed back into the plan
        missing = cut(requests.join(known, condition, "left_anti"))
        C.fetched(missing, self.settings).write.mode("append").parquet(self.path)

    # -------------------------------------------------------------------------------- rounds
    def site_files(self) -> None:
        """Base URLs, llms.txt and robots.txt; then what they point to: other hosts, indexes, sitemaps and their children."""
        o, runs = self.options, self.runs
        self.ask(_union(_request(runs, "base_url"), _request(indexes.llms_txt_candidates(runs, o.llms_txt_url)), _request(runs, F.concat(U.origin(F.col("base_url")), F.lit("/robots.txt")))))
        moved = self.capture().filter(U.cross_host(F.col("url"), F.col("final_url"))).select("run_id", U.origin(F.col("final_url")).alias("_to")).distinct()
        self.ask(_union(*[_request(moved, F.concat("_to", F.lit(x))) for x in ("/llms.txt", "/docs/llms.txt", "/robots.txt")]))
        files = indexes.llms_txt_files(runs, self.capture(), o.llms_txt_url)
        sites = discovery.with_effective_origin(runs, files)
        text = indexes.file_links(files).filter(U.path(F.col("fetch")).rlike(r"(?i)\.txt$"))
        roots = cut(discovery.sitemap_roots(sites, self.capture()).filter(~indexes.is_gzipped(F.col("url"))))
        self.ask(_union(_request(text, "fetch"), _request(roots)))
        bodies = C.variant(self.capture()).filter("status = 200").select("run_id", "url", "body")
        index = roots.join(bodies, ["run_id", "url"]).filter(indexes.is_sitemap_index(F.col("body")))
        child = index.select("run_id", "ordinal", F.posexplode(indexes.sitemap_locations(F.col("body"))).alias("_p", "url")).filter(~indexes.is_gzipped(F.col("url")))
        wish = runs.select("run_id", (F.lit(o.preferred_locale) if o.preferred_locale else U.locale(F.col("base_url"))).cast("string").alias("wanted"))
        child = discovery.locales.locale_sitemaps(child.dropDuplicates(["run_id", "url"]), wish)
        place = F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal", "_p"))
        self.ask(_request(child.withColumn("_k", place).filter("_k < 20")))

    def pages(self, curated: DataFrame | None = None) -> DataFrame:
        """The sample, after a round that tells which of its pages are missing."""
        o, captured = self.options, self.capture()
        files = cut(indexes.llms_txt_files(self.runs, captured, o.llms_txt_url))
        sites = cut(discovery.with_effective_origin(self.runs, files))
        if o.sampling_strategy in ("none", "curated"):
            sample = cut(discovery.sampled_pages(sites, captured, files, o, curated)[0])
            self.ask(_request(sample))
            return sample
        urls = cut(discovery.discover(sites, captured, files, o).urls)
        self.ask(_request(discovery.sample(urls, captured, o)))
        sample = cut(discovery.with_base(discovery.sample(urls, self.capture(), o), sites))
        self.ask(_request(sample))
        return sample

    def representations(self, sample: DataFrame) -> None:
        """Pages without following redirects, as negotiated Markdown and at their .md URLs, and pages that should not exist."""
        md = F.concat(F.when(F.col("original_md").isNotNull(), F.array("original_md")).otherwise(F.array().cast("array<string>")), U.markdown_candidates(F.col("url")))
        each = sample.select("run_id", F.explode(md).alias("url"))
        self.ask(_union(_request(sample, redirect="manual"), _request(sample, accept="text/markdown"), _request(each), _request(sample, missing_url(F.col("url")))))

    def links(self, sample: DataFrame) -> None:
        """Links of llms.txt by HEAD, in full where that is refused or a .txt; links and continuations of Markdown pages."""
        o, captured = self.options, self.capture()
        files = indexes.llms_txt_files(self.runs, captured, o.llms_txt_url)
        home = self.runs.select("run_id", U.origin(F.col("base_url")).alias("_o"))
        found = indexes.file_links(indexes.files_for_analysis(files, self.runs)).select("run_id", "fetch").distinct().join(home, "run_id").withColumn("_own", U.origin(F.col("fetch")) == F.col("_o"))
        order = Window.partitionBy("run_id", "_own").orderBy(F.md5(F.concat(F.lit(f"{o.seed}:"), "fetch")))
        some = cut(found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= o.max_links))
        self.ask(_request(some, "fetch", method="HEAD"))
        refused = self.capture().filter("method = 'HEAD' and (status = 405 or status is null)").select("run_id", F.col("url").alias("fetch"))
        text = some.filter(U.path(F.col("fetch")).rlike(r"(?i)\.txt$")).select("run_id", "fetch")
        own = some.filter("_own")
        forms = own.select("run_id", F.explode(U.markdown_candidates(F.col("fetch"))).alias("fetch"))
        md = cut(markdown_pages(Tables(self.runs, sample, self.capture())))
        wanted = md.select("run_id", "ordinal", F.explode(udf.links(F.col("body"), F.col("md_url"))).alias("l")).filter("not l.image and l.fetch is not null and not l.cross_origin")
        plan = S.link_plan(wanted.select("run_id", F.col("ordinal").alias("page_ordinal"), F.col("l.offset").cast("long").alias("offset"), F.col("l.fetch").alias("fetch")), o.max_links)
        on = md.select("run_id", "md_url", udf.pagination(F.col("body"), F.col("md_url"))["continuation"].alias("_c")).filter("_c is not null")
        on = on.select("run_id", udf.resolved(F.col("_c"), F.col("md_url")).alias("fetch"))
        asked = on.filter(~U.is_markdown(F.col("fetch")))
        self.ask(_union(*[_request(x, "fetch") for x in (refused, text, plan.select("run_id", "fetch"), on.filter(U.is_markdown(F.col("fetch"))))],
                        _request(forms, "fetch", method="HEAD"), _request(own, "fetch", method="HEAD", accept="text/markdown"), _request(asked, "fetch", accept="text/markdown")))


def record(spark: SparkSession, runs: DataFrame, path: str, options: Options = Options(), curated: DataFrame | None = None, settings: dict | None = None) -> DataFrame:
    """Fetches what an audit of runs (run_id, base_url) reads, appends it to the capture at `path`, and returns the sample."""
    recorder = Recorder(spark, runs, path, options, settings)
    recorder.site_files()
    sample = recorder.pages(curated)
    recorder.representations(sample)
    recorder.links(sample)
    return sample
