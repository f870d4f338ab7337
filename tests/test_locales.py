"""Locale positions, variants and filters of several sites in one table."""

import pytest
from pyspark.sql import functions as F

from quillmap.operators import locales as L


def urls(spark, **sites):
    return spark.createDataFrame([(run, k, f"https://a.io{p}") for run, paths in sites.items() for k, p in enumerate(paths)], "run_id string, ordinal long, url string")


def wishes(spark, **runs):
    return spark.createDataFrame(list(runs.items()), "run_id string, wanted string")


SITES = dict(
    two=["/docs", "/docs/en/a", "/docs/en/b", "/docs/de/a", "/docs/de/b"],
    minority=["/docs/a", "/docs/b", "/docs/c", "/docs/d", "/docs/fr/a", "/docs/fr/b"],
    topic=["/docs/go/a", "/docs/b", "/docs/c"],
    variant=["/en-us/a", "/en-us/b", "/en-gb/a", "/de-de/a", "/de-de/b"],
    script=["/zh-hans-cn/a", "/zh-hant/a", "/zh-hant/b"],
    own=["/latam/a", "/en/a", "/fr/a", "/en/b", "/fr/b"],
)


@pytest.fixture(scope="module")
def sites(spark):
    return urls(spark, **SITES)


def test_positions(sites):
    got = {r["run_id"]: r["position"] for r in L.positions(sites).collect()}
    assert got == {"two": 1, "minority": 1, "variant": 0, "script": 0, "own": 0}


def paths(df):
    out = {}
    for r in df.orderBy("ordinal").collect():
        out.setdefault(r["run_id"], []).append(r["url"].removeprefix("https://a.io"))
    return out


def test_one_locale(spark, sites):
    got = paths(L.one_locale(sites, wishes(spark, two="de", minority=None, topic="en", variant="en", script="zh-hans", own="latam")))
    assert got["two"] == ["/docs", "/docs/de/a", "/docs/de/b"]  # a path that is too short to tell stays
    assert got["minority"] == ["/docs/a", "/docs/b", "/docs/c", "/docs/d"] and got["topic"] == SITES["topic"]
    assert got["variant"] == ["/en-us/a", "/en-us/b"] and got["script"] == ["/zh-hans-cn/a"] and got["own"] == ["/latam/a"]
    assert paths(L.one_locale(sites.filter("run_id = 'two'"), wishes(spark, two="ja"))) == {"two": ["/docs"]}


def test_coverage_scope(spark, sites):
    listed = urls(spark, two=["/docs/en/a", "/docs/en/b"], minority=["/docs/a", "/docs/b"], variant=["/x"])
    got = paths(L.coverage_scope(sites, listed, wishes(spark, two=None, minority=None, variant="en")))
    assert got["two"] == ["/docs/en/a", "/docs/en/b"] and got["minority"] == ["/docs/a", "/docs/b", "/docs/c", "/docs/d"] and got["variant"] == ["/en-us/a", "/en-us/b"]
    labels = {r["run_id"]: r["locale"] for r in L.coverage_scope(sites, listed, wishes(spark, two=None, minority=None, variant="en")).select("run_id", "locale").distinct().collect()}
    assert (labels["two"], labels["minority"], labels["variant"], labels["topic"]) == ("en", "default", "en-us", None)


def test_variants(spark):
    codes = spark.createDataFrame([("r", "en-gb", 2), ("r", "en-us", 5), ("r", "en-au", 2), ("r", "de", 9), ("s", "en", 1), ("s", "en-us", 7)], "run_id string, code string, n long")
    got = [(r["run_id"], r["code"], r["rank"]) for r in L.variants(codes, F.lit("EN")).orderBy("run_id", "rank").collect()]
    assert got == [("r", "en-us", 1), ("r", "en-au", 2), ("r", "en-gb", 3), ("s", "en", 1)]


def test_locale_sitemaps(spark):
    names = ["/sitemap-en.xml", "/sitemap-fr.xml", "/de/sitemap.xml", "/dotnet-cs-docs-en-us_1.xml", "/misc.xml"]
    children = urls(spark, r=names, s=names, t=["/sitemap-en.xml", "/misc.xml"], u=names, v=names)
    assert [r["c"] for r in children.filter("run_id = 'r'").select(L.sitemap_code(F.col("url")).alias("c")).collect()] == ["en", "fr", "de", "en-us", None]
    got = paths(L.locale_sitemaps(children, wishes(spark, r="fr", s=None, t="fr", u="en-custom", v="ja")))
    assert got["r"] == ["/sitemap-fr.xml", "/misc.xml"] and got["s"] == ["/sitemap-en.xml", "/misc.xml"]
    assert got["t"] == ["/sitemap-en.xml", "/misc.xml"] and got["u"] == names and got["v"] == ["/sitemap-en.xml", "/misc.xml"]
